"""Source trees as tables of files: what is scanned, in which language and class, and whether it changed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.scalars import glob_regex, suffix_of

# Languages by suffix, those with a grammar first, then those that are seen as whole files only.
LANGUAGES = {
    "python": ".py", "java": ".java", "javascript": ".js .jsx .mjs .cjs", "typescript": ".ts", "tsx": ".tsx", "go": ".go", "sql": ".sql", "graphql": ".graphql .graphqls", "terraform": ".tf",
    "html": ".html .htm .vue .jsp .jspx .djhtml .j2 .jinja .jinja2 .njk .tmpl .gohtml .gotmpl .hbs .mustache .erb",
}
OTHER_LANGUAGES = {
    "ruby": ".rb", "php": ".php", "csharp": ".cs", "rust": ".rs", "kotlin": ".kt .kts", "swift": ".swift", "scala": ".scala", "c": ".c .h", "cpp": ".cc .cpp .hpp", "objc": ".m", "perl": ".pl",
    "shell": ".sh .bash", "powershell": ".ps1", "lua": ".lua", "dart": ".dart", "elixir": ".ex .exs", "erlang": ".erl", "groovy": ".groovy", "r": ".r",
}
# More suffixes that are scanned; folders that never are, beside those that begin with a dot.
DATA_SUFFIXES = ".yaml .yml .json .properties .env .xml .toml"
SKIPPED = ("node_modules", "__pycache__", "venv", "dist", "build", "target", "vendor", "site-packages", "bower_components")
TEMPLATES = ".html .htm .jsx .tsx .vue .j2 .jinja .jinja2 .djhtml .jsp .jspx .tag .tmpl .gohtml .gotmpl"
# Names of files by class; classes that are scanned wherever they lie; marks of repositories and frameworks.
CLASSES = {
    "ai-agent-config": ".clinerules .cursorrules .roorules .windsurfrules AGENTS.md CLAUDE.md GEMINI.md copilot-instructions.md",
    "ai-mcp-config": ".mcp.json claude_desktop_config.json mcp.json",
    "client-cache-config": "ngsw-config.json service-worker.js sw.js workbox-config.js manifest.webmanifest",
    "datastore-rules": "database.rules.json firestore.rules storage.rules",
    "dependency-manifest": (
        "package.json package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml requirements.txt pyproject.toml setup.py setup.cfg poetry.lock uv.lock pylock.toml Pipfile.lock pom.xml "
        "build.gradle build.gradle.kts gradle.lockfile go.mod go.sum"
    ),
    "deploy-config": "firebase.json vercel.json netlify.toml angular.json Dockerfile docker-compose.yml docker-compose.yaml app.yaml serverless.yml nginx.conf web.config",
    "prompt-artifact": "agent.prompt system.prompt system_prompt.md system_prompt.txt",
}
ANYWHERE = ("ai-agent-config", "ai-mcp-config", "prompt-artifact")
REPOSITORY_MARKS = ("pyproject.toml", "package.json", "pom.xml", "go.mod", "requirements.txt", ".git")
FRAMEWORK_FILES = {"requirements.txt": "python-pip", "pyproject.toml": "python-project", "package.json": "node", "pom.xml": "maven", "build.gradle": "gradle", "go.mod": "go-modules", "Dockerfile": "docker"}
FRAMEWORK_WORDS = {
    "flask": "flask", "fastapi": "fastapi", "django": "django", "express": "express", "nestjs": "nestjs", "springframework": "spring", "gin-gonic": "gin", "echo": "echo", "psycopg2": "postgresql",
    "sqlalchemy": "sqlalchemy", "pymongo": "mongodb", "boto3": "aws", "stripe": "stripe", "requests": "http-client", "axios": "http-client",
}
TEST_GLOBS = (
    "*/src/test/*", "src/test/*", "*/src/it/*", "tests/*", "*/tests/*", "test_*.py", "*/test_*.py", "*_test.py", "conftest.py", "*/conftest.py", "*.test.*", "*.spec.*", "__tests__/*", "*/__tests__/*", "*_test.go",
)


def _by_word(groups: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for name, words in groups.items() for word in words.split() for x in (word, name)]
    return F.create_map(*pairs)[key]


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language_of(path: Column) -> Column:
    """The language of a suffix, whether or not there is a grammar for it; null for others."""
    return F.coalesce(_by_word(LANGUAGES, suffix_of(path)), _by_word(OTHER_LANGUAGES, suffix_of(path)))


def is_parsed(path: Column) -> Column:
    return _by_word(LANGUAGES, suffix_of(path)).isNotNull()


def file_class(path: Column) -> Column:
    """The class of a name, else template by suffix, else source by language; null for others."""
    return F.coalesce(_by_word(CLASSES, name_of(path)), F.when(suffix_of(path).isin(*TEMPLATES.split()), "template"), F.when(language_of(path).isNotNull(), "source"))


def config_marks(path: Column) -> Column:
    """The marks that a configuration file brings along by its class."""
    kind = _by_word(CLASSES, name_of(path))
    return F.array_compact(F.array(F.when(kind.isin("deploy-config", "datastore-rules"), "trust_boundary"), F.when(kind.isin(*ANYWHERE), "ai_config")))


def is_test_code(path: Column) -> Column:
    """By the conventions of the stacks, without case; the wide test (the narrow one is `scalars.is_test_part`)."""
    out = F.lit(False)
    for g in TEST_GLOBS:
        out = out | F.lower(path).rlike(glob_regex(g))
    return out


def is_scanned(path: Column) -> Column:
    """By suffix, outside of skipped and hidden folders and hidden names; files that govern a model's behaviour anywhere."""
    anywhere = F.coalesce(_by_word(CLASSES, name_of(path)).isin(*ANYWHERE), F.lit(False))
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    hidden = F.exists(folders, lambda p: F.startswith(p, F.lit(".")) | p.isin(*SKIPPED)) | F.startswith(name_of(path), F.lit("."))
    known = suffix_of(path).isin(*" ".join([*LANGUAGES.values(), *OTHER_LANGUAGES.values(), DATA_SUFFIXES]).split())
    return anywhere | (known & ~hidden)


def _listing(spark: SparkSession, root: str) -> list[str]:
    """Paths below root that Spark's own listing hides: names with a dot in front. One call a folder, on the driver."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    system = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, files = [], system.listFiles(base, True)
    while files.hasNext():
        path = files.next().getPath()
        if path.getName().startswith((".", "_")):
            found.append(path.toString())
    return found


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """uri, content of files that Spark's own reader passes over."""
    for batch in batches:
        rows = []
        for uri in batch["uri"]:
            place, name = fs.FileSystem.from_uri(uri)
            with place.open_input_file(name) as f:
                rows.append((uri, f.read()))
        yield pd.DataFrame(rows, columns=["uri", "content"])


def source_files(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """files(repo, path, language, file_class, parsed, text) of the trees at roots {repository: folder}, of any file system.

    Bytes that are no UTF-8 are replaced, never dropped. Hidden files that count anywhere are listed by themselves, as
    Spark's listing leaves them out.
    """
    every = None
    for repo, root in sorted(roots.items()):
        top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        top = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(top).toString().rstrip("/")
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(top).select(F.col("path").alias("uri"), "content")
        hidden = [u for u in _listing(spark, top) if u.rpartition("/")[2] in " ".join(CLASSES[c] for c in ANYWHERE).split()]
        if hidden:
            listed = spark.createDataFrame([(u,) for u in hidden], "uri string").repartition(max(1, len(hidden) // 100))
            raw = raw.unionByName(listed.mapInPandas(_contents, "uri string, content binary"))
        # file:/a and file:///a are one place
        plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
        path = F.substring(plain(F.col("uri")), F.length(plain(F.lit(top))) + 2, F.lit(1 << 30))
        part = raw.select(F.lit(repo).alias("repo"), path.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
        every = part if every is None else every.unionByName(part)
    if every is None:
        raise ValueError("no trees")
    path = F.col("path")
    return every.where(is_scanned(path) | _by_word(CLASSES, name_of(path)).isNotNull()).select("repo", "path", language_of(path).alias("language"), file_class(path).alias("file_class"), is_parsed(path).alias("parsed"), "text")


def members(declared: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, those declared without any file): declared ones (repo) win; without any, every repository with files."""
    have = files.select("repo").distinct()
    if declared.isEmpty():
        return have, declared
    return declared.join(have, "repo", "left_semi"), declared.join(have, "repo", "left_anti")


def snapshot(files: DataFrame) -> DataFrame:
    """key (repo:path), digest: the first 16 characters of the text's SHA-256."""
    return files.select(F.concat_ws(":", "repo", "path").alias("key"), F.substring(F.sha2("text", 256), 1, 16).alias("digest"))


def manifest(files: DataFrame) -> DataFrame:
    """One row a repository: languages, frameworks, files, modules with their numbers of files, loc, unparsed paths."""
    from sievework.functions.scalars import module_of

    word = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(w)), f) for w, f in FRAMEWORK_WORDS.items()]))
    named = F.create_map(*[F.lit(x) for p in FRAMEWORK_FILES.items() for x in p])[name_of(F.col("path"))]
    rows = files.withColumns({"__f": F.array_compact(F.array_append(word, named)), "__m": module_of(F.col("path")), "__loc": F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1})
    modules = rows.groupBy("repo", "__m").agg(F.count(F.lit(1)).alias("n")).groupBy("repo").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__m", "n")))).alias("modules"))
    out = rows.groupBy("repo").agg(
        F.array_sort(F.collect_set("language")).alias("languages"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("__f")))).alias("frameworks"),
        F.count(F.lit(1)).alias("files"),
        F.sum("__loc").alias("loc"),
        F.array_sort(F.collect_list(F.when(~F.col("parsed") & (F.col("file_class") == "source"), F.col("path")))).alias("unparsed"),
    )
    return out.join(modules, "repo")
