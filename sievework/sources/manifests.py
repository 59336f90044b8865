"""Dependency manifests as components: package.json, pom.xml, requirements.txt and go.mod from a table of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Manifests and their ecosystems, sections of package.json with what ships, words that are no Go module.
MANIFESTS = {"package.json": "npm", "pom.xml": "maven", "requirements.txt": "pypi", "go.mod": "go"}
LOCKFILES = {"npm": ("package-lock.json", "yarn.lock", "pnpm-lock.yaml"), "pypi": ("poetry.lock", "Pipfile.lock", "uv.lock")}
SECTIONS = (("dependencies", "runtime"), ("devDependencies", "development"))
DECLARED = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
NO_MODULE = ("module", "go", "require", ")")
COMPONENT = ("repo", "manifest", "ecosystem", "package", "version", "exposure")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "[^/]*$", "")


def named(files: DataFrame, name: str) -> DataFrame:
    return files.where(file_name(F.col("path")) == name)


def lines(files: DataFrame) -> DataFrame:
    return files.select("repo", "path", F.posexplode(F.split("text", "\r?\n")).alias("p", "line"))


def _component(df: DataFrame, ecosystem: str, package: Column, version: Column, exposure: Column | str = "runtime") -> DataFrame:
    ships = F.lit(exposure) if isinstance(exposure, str) else exposure
    return df.select("repo", F.col("path").alias("manifest"), F.lit(ecosystem).alias("ecosystem"), package.alias("package"), version.alias("version"), ships.alias("exposure"))


def npm(files: DataFrame) -> DataFrame:
    """Versions come from the lockfile beside the manifest, else from the range without its sign. What is no JSON has none."""
    doc = F.from_json("text", ", ".join(f"{s} map<string,string>" for s, _ in SECTIONS))
    rows = named(files, "package.json").withColumn("__d", doc).withColumn("__dir", folder(F.col("path")))
    every = None
    for section, exposure in SECTIONS:
        part = rows.select("repo", "path", "__dir", F.explode(f"__d.{section}").alias("package", "range"), F.lit(exposure).alias("exposure"))
        every = part if every is None else every.unionByName(part)
    lock = named(files, "package-lock.json").select("repo", folder(F.col("path")).alias("__dir"), F.explode(F.from_json("text", "packages map<string,struct<version:string>>")["packages"]).alias("k", "v"))
    pinned = lock.where("startswith(k, 'node_modules/')").select("repo", "__dir", F.regexp_replace("k", "^node_modules/", "").alias("package"), F.col("v.version").alias("pinned"))
    met = every.join(pinned, ["repo", "__dir", "package"], "left")
    version = F.coalesce(F.nullif("pinned", F.lit("")), F.regexp_replace("range", r"^[\^~>=<\s]+", ""))
    return _component(met.withColumn("v", version).where("v <> ''"), "npm", F.col("package"), F.col("v"), F.col("exposure"))


def maven(files: DataFrame) -> DataFrame:
    """group:artifact of each dependency with a version of its own; what a property decides is left out."""
    blocks = named(files, "pom.xml").select("repo", "path", F.explode(F.regexp_extract_all("text", F.lit("(?s)<dependency>(.*?)</dependency>"), 1)).alias("b"))
    tag = lambda t: F.regexp_extract("b", f"<{t}>([^<]+)</{t}>", 1)
    rows = blocks.withColumns({"g": tag("groupId"), "a": tag("artifactId"), "v": tag("version")}).where("g <> '' and a <> '' and v <> ''").where(~F.contains("v", F.lit("${")))
    return _component(rows, "maven", F.concat_ws(":", "g", "a"), F.col("v"))


def pypi(files: DataFrame) -> DataFrame:
    """Lines name==version."""
    rows = lines(named(files, "requirements.txt"))
    pattern = r"^\s*([A-Za-z0-9_.\-]+)==([A-Za-z0-9_.\-+]+)"
    return _component(rows.where(F.col("line").rlike(pattern)), "pypi", F.regexp_extract("line", pattern, 1), F.regexp_extract("line", pattern, 2))


def go(files: DataFrame) -> DataFrame:
    """Lines of a module and a version of three numbers."""
    rows = lines(named(files, "go.mod"))
    pattern = r"^\s*([\w./\-]+)\s+v?(\d+\.\d+\.\d+[^\s]*)"
    found = rows.where(F.col("line").rlike(pattern)).withColumn("m", F.regexp_extract("line", pattern, 1))
    return _component(found.where(~F.col("m").isin(*NO_MODULE) & ~F.startswith("m", F.lit("//"))), "go", F.col("m"), F.regexp_extract("line", pattern, 2))


def components(files: DataFrame) -> DataFrame:
    """repo, manifest, ecosystem, package, version, exposure of all manifests among files (repo, path, text)."""
    return npm(files).unionByName(maven(files)).unionByName(pypi(files)).unionByName(go(files))


def dependencies(files: DataFrame) -> DataFrame:
    """repo, path, ecosystem, name, spec, line of npm and Python manifests, as they are written there."""
    doc = F.from_json("text", ", ".join(f"{s} map<string,string>" for s, _ in SECTIONS))
    rows = named(files, "package.json").withColumn("__d", doc)
    pairs = F.flatten(F.array(*[F.coalesce(F.map_entries(f"__d.{s}"), F.array().cast("array<struct<key:string,value:string>>")) for s, _ in SECTIONS]))
    found = rows.select("repo", "path", "text", F.explode(pairs).alias("e"))
    at = F.instr("text", F.concat(F.lit('"'), F.col("e.key"), F.lit('"')))
    before = F.substring("text", F.lit(1), at)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    script = found.select("repo", "path", F.lit("npm").alias("ecosystem"), F.col("e.key").alias("name"), F.col("e.value").alias("spec"), line.cast("int").alias("line"))
    bare = lines(named(files, "requirements.txt")).withColumn("s", F.trim(F.split("line", "#")[0]))
    pattern = r"^([A-Za-z0-9_.\-]+)\s*(.*)$"
    kept = bare.where(F.col("s").rlike(pattern) & ~F.startswith("s", F.lit("-")) & ~F.startswith("s", F.lit("git+")))
    python = kept.select("repo", "path", F.lit("pypi").alias("ecosystem"), F.regexp_extract("s", pattern, 1).alias("name"), F.trim(F.regexp_extract("s", pattern, 2)).alias("spec"), (F.col("p") + 1).cast("int").alias("line"))
    return script.unionByName(python)


def declared_packages(files: DataFrame) -> DataFrame:
    """repo, package in small letters: what a repository's manifests name, whatever the version."""
    doc = F.from_json("text", ", ".join(f"{s} map<string,string>" for s in DECLARED))
    names = F.flatten(F.array(*[F.coalesce(F.map_keys(f"__d.{s}"), F.array().cast("array<string>")) for s in DECLARED]))
    script = named(files, "package.json").withColumn("__d", doc).select("repo", F.explode(names).alias("package"))
    python = lines(named(files, "requirements.txt")).select("repo", F.regexp_extract("line", r"^\s*([A-Za-z0-9_.\-]+)", 1).alias("package")).where("package <> '' and not startswith(package, '-')")
    first = F.split(F.regexp_replace("line", r"^\s+|\s+$", ""), r"\s+")
    modules = lines(named(files, "go.mod")).where(F.size(first) >= 2).select("repo", first[0].alias("package")).where(F.contains("package", F.lit(".")) & F.contains("package", F.lit("/")))
    return script.unionByName(python).unionByName(modules).select("repo", F.lower("package").alias("package")).distinct()


def locked(files: DataFrame) -> DataFrame:
    """repo, ecosystem with a lockfile."""
    rows = [files.where(file_name(F.col("path")).isin(*names)).select("repo", F.lit(eco).alias("ecosystem")) for eco, names in LOCKFILES.items()]
    return rows[0].unionByName(rows[1]).distinct()


def mapped_scopes(files: DataFrame) -> DataFrame:
    """repo, scope that an .npmrc sends to a registry of its own."""
    rows = lines(named(files, ".npmrc")).select("repo", F.lower(F.regexp_extract("line", r"(?i)^\s*(@[^:\s]+):registry\s*=", 1)).alias("scope"))
    return rows.where("scope <> ''").distinct()


def ecosystems(files: DataFrame) -> DataFrame:
    """repo, ecosystem of which there is a manifest."""
    names = F.create_map(*[F.lit(x) for pair in MANIFESTS.items() for x in pair])
    return files.select("repo", names[file_name(F.col("path"))].alias("ecosystem")).where("ecosystem is not null").distinct()
