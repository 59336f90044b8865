"""Dependencies: advisories, release cycles, cross-checks, merging of reports, attribution, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions.scalars import in_range, is_test_part, support_ended, version_digits, version_key

# Ecosystems of languages whose imports are read.
LANGUAGE_ECOSYSTEM = {"javascript": "npm", "typescript": "npm", "tsx": "npm", "python": "pypi", "go": "go", "java": "maven"}
# Calls with a package that only the running program knows.
DYNAMIC = {"npm": r"\b(?:require|import)\s*\(\s*[^'\"\s)]", "pypi": r"\b(?:__import__|importlib\.import_module)\s*\(\s*[^'\"\s)]"}


def affected_components(components: DataFrame, advisories: DataFrame) -> DataFrame:
    """Components (ecosystem, package, version, ...) with each advisory (introduced, fixed, ...) whose range has their version.

    Equality on ecosystem and package first; the range is tested on what meets. Versions compare piece by piece.
    """
    return components.join(advisories, ["ecosystem", "package"]).where(in_range(F.col("version"), F.col("introduced"), F.col("fixed")))


def affected_coordinates(components: DataFrame, advisories: DataFrame) -> DataFrame:
    """As `affected_components` for coordinates whose versions compare by their first four numbers alone."""
    have, low, high = version_digits(F.col("version")), F.coalesce("introduced", F.lit("")), F.coalesce("fixed", F.lit(""))
    after = (low == "") | (have >= version_digits(low))
    before = (high == "") | (have < version_digits(high))
    return components.join(advisories, ["ecosystem", "package"]).where(after & before)


def release_cycles(versions: DataFrame, cycles: DataFrame, today: Column) -> DataFrame:
    """versions (product, version) with cycle, eol, ended and reason: the longest cycle that equals the version or begins
    it before a dot. Unknown products and cycles, and cycles without an end, stay undetermined (null) with the reason.

    A version's own beginnings are looked up by equality, so no version meets every cycle.
    """
    parts = F.split("version", "[.]")
    begins = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    rows = versions.select("product", "version").distinct()
    met = rows.withColumn("cycle", F.explode(begins)).join(cycles.select("product", "cycle", "eol"), ["product", "cycle"])
    best = met.groupBy("product", "version").agg(F.max_by(F.struct("cycle", "eol"), F.length("cycle")).alias("b"))
    products = cycles.select("product").distinct().withColumn("known", F.lit(True))
    out = versions.join(best, ["product", "version"], "left").join(products, "product", "left")
    reason = F.when(F.col("known").isNull(), "product not in dataset").when(F.col("b").isNull(), "release cycle not in dataset").when(F.col("b.eol").isNull(), "no end-of-support date published")
    return out.select(*versions.columns, F.col("b.cycle").alias("cycle"), F.col("b.eol").alias("eol"), support_ended(F.col("b.eol"), today).alias("ended"), reason.alias("reason"))


def currency_rollup(outdated: DataFrame) -> DataFrame:
    """member, product, cycle, packages (package -> version), runtime: one row for packages that are one product's."""
    return outdated.groupBy("member", "product", "cycle").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("package", "version")))).alias("packages"), F.bool_or(F.col("exposure") == "runtime").alias("runtime"))


def cross_check(findings: DataFrame, pins: DataFrame, members: DataFrame, files: DataFrame) -> DataFrame:
    """Every finding with the ground that disproves it, if any, and its disposition (kept or suppressed).

    findings: id, member, package (null: of code), fixed, introduced, file, line_start. pins: member, package, version;
    members: member, those whose manifests are known; files: member, file, lines. Dependencies fall by absence or by a
    pinned version outside the range, code by a file or line that is not there; an unknown member disproves nothing.
    """
    known = members.select("member").distinct().withColumn("__known", F.lit(True))
    held = pins.groupBy("member", "package").agg(F.min("version").alias("__pin"))
    lined = files.groupBy("member", "file").agg(F.max("lines").alias("__lines"))
    rows = findings.join(known, "member", "left").join(held, ["member", "package"], "left").join(lined, ["member", "file"], "left")
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    past = ~empty("fixed") & (version_key(F.col("__pin")) >= version_key(F.col("fixed")))
    early = ~empty("introduced") & (F.col("introduced") != "0") & (version_key(F.col("__pin")) < version_key(F.col("introduced")))
    dependency = F.when(F.col("__pin").isNull(), "package-absent").when(F.coalesce(past, F.lit(False)) | F.coalesce(early, F.lit(False)), "version-outside-range")
    code = F.when(~empty("file") & (F.col("__lines").isNull() | (F.coalesce("line_start", F.lit(1)) > F.col("__lines"))), "location-unresolvable")
    ground = F.when(F.col("__known"), F.when(F.col("package").isNotNull(), dependency).otherwise(code))
    out = rows.withColumn("ground", F.coalesce(ground, F.lit(""))).drop("__known", "__pin", "__lines")
    return out.withColumn("disposition", F.when(F.col("ground") == "", "kept").otherwise("suppressed")).select(*findings.columns, "ground", "disposition")


def merge_external(native: DataFrame, external: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(native findings with the sources of all reports that they absorb, external ones that match none).

    Both: id, seq (order), ecosystem, package, range, advisory_ids, sources. An external finding goes into the first native
    one of its package that shares an advisory or has the same range; others, and those without a package, stay.
    """
    every = native.withColumn("__native", F.lit(True)).unionByName(external.withColumn("__native", F.lit(False)), allowMissingColumns=True)
    out = absorbed(every, "__native")
    return out.where("__native").select(*native.columns), out.where("not __native").select(*external.columns)


def absorbed(findings: DataFrame, native: str = "native") -> DataFrame:
    """findings, native and external ones as `merge_external` has them, without the external ones that a native one absorbs.

    A shared advisory or range is a mark, and the first native finding of a package's mark is the one that all external
    ones with it may go into: no external finding meets every native one of its package. Rows that lie by package (and
    ecosystem) are not dealt again.
    """
    place = ["ecosystem", "package"]
    none = F.array().cast("array<string>")
    marks = F.concat(F.transform(F.coalesce("advisory_ids", none), lambda a: F.concat(F.lit("id "), a)), F.when(F.coalesce("range", F.lit("")) != "", F.array(F.concat(F.lit("range "), "range"))).otherwise(none))
    marks = F.when(F.col("package").isNotNull() & F.col("ecosystem").isNotNull(), F.filter(F.array_distinct(marks), lambda m: m.isNotNull()))
    pieces = findings.select(*place, F.col(native).alias("__own"), "id", "seq", F.struct(*findings.columns).alias("__row"), F.posexplode_outer(marks).alias("__i", "__mark"))
    first = F.min(F.when(F.col("__own") & F.col("__mark").isNotNull(), F.struct("seq", "id"))).over(Window.partitionBy(*place, "__mark"))
    pieces = pieces.withColumn("__row", F.when(F.coalesce("__i", F.lit(0)) == 0, F.col("__row"))).withColumn("__first", F.when(~F.col("__own"), first)).drop("__i", "seq")
    found = pieces.groupBy(*place, "__own", "id").agg(F.collect_list("__row").alias("__rows"), F.min("__first")["id"].alias("__to"))
    gone = F.col("__to").isNotNull()
    more = F.when(gone, F.flatten(F.filter(F.transform("__rows", lambda r: r["sources"]), lambda x: x.isNotNull())))
    grouped = found.groupBy(*place, (F.col("__own") | gone).alias("__kept"), F.coalesce("__to", "id").alias("__at")).agg(
        F.flatten(F.collect_list(F.when(~gone, F.col("__rows")))).alias("__rows"), F.flatten(F.collect_set(more)).alias("__more")
    )
    rows = grouped.select(F.explode("__rows").alias("__r"), "__more")
    sources = F.when(F.size("__more") > 0, F.array_sort(F.array_union("__r.sources", "__more"))).otherwise(F.col("__r.sources"))
    return rows.select(*[sources.alias(c) if c == "sources" else F.col(f"__r.`{c}`").alias(c) for c in findings.columns])


def covered_domains(external: DataFrame, scanners: DataFrame) -> DataFrame:
    """ecosystem: those that reports (scanner, ecosystem) speak of; a report that names none covers all of its scanner
    (scanner, ecosystem). Scanners that are not listed cover nothing."""
    able = scanners.select("scanner", F.col("ecosystem").alias("__able"))
    met = external.select("scanner", "ecosystem").join(able, "scanner")
    return met.select(F.coalesce("ecosystem", "__able").alias("ecosystem")).distinct()


def displaced(audits: DataFrame, covered: DataFrame) -> DataFrame:
    """The native audits (ecosystem, ...) that no report covers."""
    return audits.join(covered.select("ecosystem").distinct(), "ecosystem", "left_anti").select(*audits.columns)


def advisory_groups(advisories: DataFrame, declared: DataFrame | None = None, lockfile_shared: bool = False) -> DataFrame:
    """One row per advisory (ecosystem, package, range): reporters, exposure, ambiguous, members, attribution.

    advisories: member, ecosystem, package, range, exposure, ambiguous. Runtime exposure wins. Under a shared lockfile the
    members are those that declare the package (declared: member, package in small letters), and none where nobody does.
    """
    grouped = advisories.groupBy("ecosystem", "package", "range").agg(
        F.array_sort(F.collect_set("member")).alias("reporters"),
        F.min_by("exposure", F.struct((F.col("exposure") != "runtime").alias("a"), "exposure")).alias("exposure"),
        F.bool_or(F.coalesce("ambiguous", F.lit(False))).alias("ambiguous"),
    )
    if not lockfile_shared:
        return grouped.withColumns({"members": F.col("reporters"), "attribution": F.lit("per-member")})
    by = declared.groupBy(F.lower("package").alias("__package")).agg(F.array_sort(F.collect_set("member")).alias("__members"))
    out = grouped.withColumn("__package", F.lower("package")).join(by, "__package", "left")
    none = F.array().cast("array<string>")
    return out.select(*grouped.columns, F.coalesce("__members", none).alias("members"), F.when(F.col("__members").isNull(), "not-derivable").otherwise("per-member").alias("attribution"))


def distinct_advisories(advisories: DataFrame) -> DataFrame:
    return advisories.dropDuplicates(["ecosystem", "package", "range", "exposure"])


def audit_outcomes(members: DataFrame, hits: DataFrame, snapshots: DataFrame) -> DataFrame:
    """member, ecosystem, outcome, advisories: advisories or clean where a snapshot could be checked, else could-not-check."""
    found = hits.groupBy("member", "ecosystem").agg(F.count(F.lit(1)).alias("advisories"))
    checked = snapshots.select("ecosystem").distinct().withColumn("__checked", F.lit(True))
    rows = members.select("member", "ecosystem").distinct().join(found, ["member", "ecosystem"], "left").join(checked, "ecosystem", "left")
    outcome = F.when(F.col("__checked").isNull(), "could-not-check").when(F.col("advisories") > 0, "advisories").otherwise("clean")
    return rows.select("member", "ecosystem", outcome.alias("outcome"), F.coalesce("advisories", F.lit(0)).alias("advisories"))


def module_of_import(text: Column, language: Column) -> Column:
    """What an import names: a quoted specifier that is no path, or the dotted name behind the keyword."""
    quoted = F.regexp_extract(text, "['\"]([^'\"]+)['\"]", 1)
    script = F.when((quoted == "") | quoted.rlike("^[./]"), F.lit(None)).otherwise(quoted)
    python = F.regexp_extract(text, r"^\s*(?:from|import)\s+([A-Za-z0-9_.]+)", 1)
    java = F.regexp_extract(text, r"^\s*import\s+(?:static\s+)?([A-Za-z0-9_.]+)", 1)
    named = F.when(language.isin("javascript", "typescript", "tsx"), script).when(language == "python", python).when(language == "go", quoted).when(language == "java", java)
    return F.when(named == "", F.lit(None)).otherwise(named)


def package_of_module(module: Column, ecosystem: Column) -> Column:
    """The package that an npm or Python module belongs to; a Go module stands for itself and its beginnings."""
    parts = F.split(module, "/")
    npm = F.when(F.startswith(module, F.lit("@")), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(parts[0])
    return F.when(ecosystem == "npm", npm).when(ecosystem == "pypi", F.lower(F.split(module, "[.]")[0])).when(ecosystem == "go", module)


def usage_evidence(packages: DataFrame, imports: DataFrame, files: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """packages (member, ecosystem, package) with n_found, n_runtime, n_reasons: places that import each, those of them
    that are no tests, and why a search is not conclusive. See `verdicts.usage_state`.

    imports: member, path, language, text; files: member, path, language, parsed, text; overrides: ecosystem, module,
    package. Imports name their package first and meet packages by equality; a Go import meets its own beginnings.
    """
    eco = F.create_map(*[F.lit(x) for pair in LANGUAGE_ECOSYSTEM.items() for x in pair])
    named = imports.withColumn("ecosystem", eco[F.col("language")]).withColumn("module", module_of_import(F.col("text"), F.col("language"))).where("module is not null and ecosystem is not null")
    named = named.withColumn("__name", package_of_module(F.col("module"), F.col("ecosystem")))
    if overrides is not None:
        first = F.when(F.col("ecosystem") == "pypi", F.split("module", "[.]")[0]).otherwise(F.col("module"))
        mapped = overrides.select("ecosystem", F.col("module").alias("__first"), F.lower("package").alias("__mapped"))
        named = named.withColumn("__first", first).join(mapped, ["ecosystem", "__first"], "left").withColumn("__name", F.coalesce("__mapped", "__name"))
    parts = F.split("__name", "/")
    begins = F.when(F.col("ecosystem") == "go", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array("__name"))
    uses = named.where("__name is not null").select("member", "ecosystem", "path", F.explode(begins).alias("__key")).distinct()
    key = F.when(F.col("ecosystem").isin("pypi", "maven"), F.lower("package")).otherwise(F.col("package"))
    places = packages.withColumn("__key", key).join(uses, ["member", "ecosystem", "__key"])
    found = places.groupBy("member", "ecosystem", "package").agg(F.countDistinct("path").alias("n_found"), F.countDistinct(F.when(~is_test_part(F.col("path")), F.col("path"))).alias("n_runtime"))
    sources = files.withColumn("ecosystem", eco[F.col("language")])
    unsure = F.lit(False)
    for name, pattern in DYNAMIC.items():
        unsure = unsure | ((F.col("ecosystem") == name) & F.coalesce(F.col("text").rlike(pattern), F.lit(False)))
    searched = sources.groupBy("member", "ecosystem").agg(F.count_if(F.coalesce("parsed", F.lit(False))).alias("__parsed"), F.count_if(unsure).alias("__dynamic"))
    out = packages.join(found, ["member", "ecosystem", "package"], "left").join(searched, ["member", "ecosystem"], "left")
    unmapped = (F.col("ecosystem") == "maven") if overrides is None else F.lit(False)
    reasons = F.when(F.coalesce("__parsed", F.lit(0)) == 0, 1).otherwise(0) + F.coalesce("__dynamic", F.lit(0)) + unmapped.cast("int")
    return out.select(*packages.columns, F.coalesce("n_found", F.lit(0)).alias("n_found"), F.coalesce("n_runtime", F.lit(0)).alias("n_runtime"), reasons.alias("n_reasons"))
