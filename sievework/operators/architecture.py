"""What a member or segment is: shapes from signals, domains to analyse, tools that apply, hosts that are its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SERVER, BROWSER, CLI, LIBRARY, UNDETERMINED = "server-request-issuer", "browser-client", "cli", "library", "undetermined"
# Dependencies that tell a server from a browser client, files of a static build, and command entries.
SERVER_PACKAGES = (
    "flask django fastapi starlette tornado bottle pyramid aiohttp express koa hapi @nestjs/core next nuxt fastify spring-boot-starter-web spring-webmvc javax.servlet jakarta.servlet "
    "github.com/gin-gonic/gin github.com/labstack/echo net/http requests httpx urllib3 axios node-fetch got"
)
BROWSER_PACKAGES = "@angular/platform-browser @angular/core react-dom vue svelte preact ember-source backbone jquery"
STATIC_FILES = "index.html firebase.json vercel.json netlify.toml"
COMMAND = r"(?:console_scripts|\[project\.scripts\]|argparse|click\.command|cobra\.Command|\"bin\"\s*:)"
COMMAND_FILES = "pyproject.toml setup.py package.json main.go"
LOCAL = ("localhost", "127.0.0.1", "0.0.0.0", "::1")
# Domains that a segment is analysed for: always, by words of its name, by marks, by classes of its files.
ALWAYS = "injection authorization secrets"
BY_NAME = {
    "auth": "authentication authorization session-management", "login": "authentication session-management", "user": "authorization pii", "admin": "authorization", "payment": "authorization data-protection api-security",
    "billing": "authorization data-protection", "upload": "file-handling path-traversal", "file": "file-handling path-traversal", "report": "injection authorization", "config": "secrets infrastructure",
    "settings": "secrets infrastructure", "order": "authorization injection", "crypto": "encryption", "session": "session-management", "api": "api-security rate-limiting",
}
BY_MARK = {
    "user_controlled_input": "injection api-security", "security_sink": "injection deserialization", "trust_boundary": "authentication authorization api-security", "authentication_required": "authentication session-management",
    "authorization_required": "authorization", "unattached_security_guard": "authentication authorization", "sensitive_data": "data-protection secrets pii encryption", "external_system": "ssrf api-security pii", "template_sink": "injection",
    "control_bypass": "injection", "fixed_prefix_sink": "api-security", "llm_invocation": "llm-security", "llm_prompt_sink": "llm-security", "tool_declaration": "llm-security", "external_content_source": "llm-security", "llm_undetermined": "llm-security",
}
BY_CLASS = {
    "template": "injection", "dependency-manifest": "dependencies", "deploy-config": "infrastructure data-protection", "datastore-rules": "authorization infrastructure", "client-cache-config": "infrastructure data-protection",
    "ai-agent-config": "llm-security", "ai-mcp-config": "llm-security", "prompt-artifact": "llm-security",
}


def _words(text: str) -> Column:
    return F.array(*map(F.lit, text.split()))


def member_shapes(members: DataFrame, dependencies: DataFrame, files: DataFrame, entry_points: DataFrame) -> DataFrame:
    """member, shape: one for each member, by what its manifests, files and entry points say.

    dependencies: member, package; files: member, path (at the top), text; entry_points: member, kind. A browser build
    without an entry point outweighs a client library; then servers, commands, and libraries, which have a manifest alone.
    """
    named = dependencies.groupBy("member").agg(F.bool_or(F.lower("package").isin(*SERVER_PACKAGES.split())).alias("server"), F.bool_or(F.lower("package").isin(*BROWSER_PACKAGES.split())).alias("browser"), F.lit(True).alias("manifest"))
    laid = files.groupBy("member").agg(F.bool_or(F.col("path").isin(*STATIC_FILES.split())).alias("static"), F.bool_or(F.col("path").isin(*COMMAND_FILES.split()) & F.col("text").rlike(COMMAND)).alias("command"))
    points = entry_points.groupBy("member").agg(F.bool_or(F.col("kind").isin("http", "rpc", "consumer")).alias("answers"), F.bool_or(F.col("kind") == "cli").alias("cli"))
    rows = members.select("member").distinct().join(named, "member", "left").join(laid, "member", "left").join(points, "member", "left").na.fill(False)
    client = (F.col("browser") | F.col("static")) & ~F.col("answers")
    shape = F.when(client, BROWSER).when(F.col("server") | F.col("answers"), SERVER).when(F.col("cli") | F.col("command"), CLI).when(F.col("manifest"), LIBRARY).otherwise(UNDETERMINED)
    return rows.select("member", shape.alias("shape"))


def shapes_over(reachable: DataFrame, shapes: DataFrame) -> DataFrame:
    """origin, shapes: those of all members that an origin reaches; a member without a profile is undetermined."""
    met = reachable.join(shapes, "member", "left")
    return met.groupBy("origin").agg(F.array_sort(F.collect_set(F.coalesce("shape", F.lit(UNDETERMINED)))).alias("shapes"))


def segment_shape(member_shape: Column, classes: Column, marks: Column, entry_points: Column) -> Column:
    """A segment's own shape where it differs from its member's: delivered to browsers, and answering nothing itself."""
    known = ~F.coalesce(member_shape, F.lit(UNDETERMINED)).isin(BROWSER, UNDETERMINED)
    client = F.arrays_overlap(classes, _words("template client-cache-config"))
    answers = F.array_contains(marks, "trust_boundary") | (entry_points > 0)
    return F.when(known & client & ~answers, BROWSER)


def origin_shapes(findings: DataFrame, files: DataFrame, segments: DataFrame, edges: DataFrame, shapes: DataFrame) -> DataFrame:
    """id, shape: the shape of the segment that a finding lies in, where the segment has one of its own and no edge of it
    leads to code of another shape; null where the member's holds.

    findings: id, repo, file; files: repo, path, segment; segments: segment, shape (null: its member's); edges between
    files: repo, path, to_repo, to_path; shapes: member, shape.
    """
    held = files.groupBy("repo", "path").agg(F.max("segment").alias("segment")).join(segments, "segment", "left")
    full = held.join(shapes.select(F.col("member").alias("repo"), F.col("shape").alias("__member")), "repo", "left")
    there = full.select(F.col("repo").alias("to_repo"), F.col("path").alias("to_path"), F.col("segment").alias("to_segment"), F.coalesce("shape", "__member").alias("to_shape"))
    leaving = edges.join(held.select("repo", "path", "segment", "shape"), ["repo", "path"]).join(there, ["to_repo", "to_path"])
    mixed = leaving.where("segment <> to_segment and shape is not null and to_shape <> shape").select("segment").distinct()
    own = held.where("shape is not null").join(mixed, "segment", "left_anti").select("repo", F.col("path").alias("file"), "shape")
    return findings.select("id", "repo", "file").join(own, ["repo", "file"], "left").select("id", "shape")


def domains(name: Column, marks: Column, classes: Column) -> Column:
    """The sorted domains that a segment is analysed for."""
    none = F.array().cast("array<string>")
    parts = [_words(ALWAYS), *[F.when(F.contains(F.lower(name), F.lit(w)), _words(d)).otherwise(none) for w, d in BY_NAME.items()]]
    parts += [F.when(F.array_contains(marks, m), _words(d)).otherwise(none) for m, d in BY_MARK.items()]
    parts += [F.when(F.array_contains(classes, c), _words(d)).otherwise(none) for c, d in BY_CLASS.items()]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def host_verdicts(hosts: DataFrame, identifiers: DataFrame) -> DataFrame:
    """hosts (host) with verdict: internal if local, a known identifier (name), or one by its first label; else external,
    also where nothing is known."""
    names = identifiers.select(F.lower("name").alias("__name")).distinct()
    tagged = names.withColumn("__full", F.lit(True))
    labels = names.select(F.col("__name").alias("__label")).withColumn("__first", F.lit(True))
    rows = hosts.withColumn("__name", F.lower("host")).withColumn("__label", F.split(F.lower("host"), "[.]")[0])
    met = rows.join(tagged, "__name", "left").join(labels, "__label", "left")
    mine = F.col("__name").isin(*LOCAL) | F.coalesce("__full", F.lit(False)) | F.coalesce("__first", F.lit(False))
    return met.select(*hosts.columns, F.when(mine, "internal").otherwise("external").alias("verdict"))


def frameworks_present(texts: DataFrame, frameworks: DataFrame) -> DataFrame:
    """member, framework: frameworks of which a marker (framework, marker) occurs in the member's manifests and imports
    (member, text). The markers are a pack, broadcast; each text is tested once."""
    packed = frameworks.groupBy("framework").agg(F.collect_set("marker").alias("m"))
    return texts.join(F.broadcast(packed), F.exists("m", lambda x: F.contains("text", x))).select("member", "framework").distinct()


def applicable_tools(tools: DataFrame, ecosystems: DataFrame) -> DataFrame:
    """The tools (tool, applies_to) for ecosystems at hand (ecosystem), and those for any, in order of their names."""
    here = ecosystems.agg(F.collect_set("ecosystem").alias("here"))
    return tools.crossJoin(F.broadcast(here)).where(F.arrays_overlap("applies_to", "here") | F.array_contains("applies_to", "any")).select(*tools.columns).orderBy("tool")  # here: one row


def first_roots(found: DataFrame) -> DataFrame:
    """tool, member, origin: of each tool the first member, by name, that has it, project before system; missing is none."""
    rank = F.when(F.col("origin") == "project", 0).when(F.col("origin") == "system", 1)
    return found.where(rank.isNotNull()).groupBy("tool").agg(F.min(F.struct(rank.alias("r"), "member", "origin")).alias("b")).select("tool", "b.member", "b.origin")


def segments_touching(segments: DataFrame, integrations: DataFrame, repo: str) -> DataFrame:
    """The segments (segment, repo) of repositories that an integration joins with this one."""
    partners = integrations.where(F.col("from_repo") == repo).select(F.col("to_repo").alias("repo")).unionByName(integrations.where(F.col("to_repo") == repo).select(F.col("from_repo").alias("repo")))
    return segments.join(partners.where(F.col("repo") != repo).distinct(), "repo", "left_semi").select(*segments.columns)
