"""Rules over files: packs as tables, patterns with lines, legs of compound rules, manifests and agent configuration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.scalars import glob_regex, is_mutable_spec, is_test_part

# States of a leg, and the confidence of a compound rule without and with an undetermined leg.
EVIDENCED, ABSENT, PRESENT, OPEN = "evidenced", "absent-proven", "control-present", "undetermined"
SURE, UNSURE = 0.75, 0.5
MARK = "\x01"
# Shells, and keys of a server that approve, or that ask for approval.
SHELLS = ("sh", "bash", "zsh", "cmd", "cmd.exe", "powershell", "pwsh")
AUTO_APPROVE = ("autoApprove", "alwaysAllow")


def load_pack(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rules of a pack, a JSON document {version, rules: [..]} of any file system, with its version; ids must differ.

    schema: the columns of a rule. What is not JSON, has no rules or repeats an id is an error.
    """
    doc = spark.read.schema(f"version string, rules array<struct<{schema}>>, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rules = doc.select("version", "_corrupt", F.explode_outer("rules").alias("r")).cache()
    bad = rules.where("_corrupt is not null or r is null or r.id is null").limit(1).count()
    repeated = rules.groupBy("r.id").count().where("count > 1").limit(1).count()
    out = rules.select("version", "r.*")
    rules.unpersist()
    if bad or repeated:
        raise ValueError(f"{path}: " + ("a rule id repeats" if repeated else "no rules, or a rule without an id"))
    return out


def file_matches(files: DataFrame, rules: DataFrame) -> DataFrame:
    """repo, path, rule fields and line of every match of each rule's pattern in the files that its globs admit.

    rules: id, file_globs, pattern, others; a pack, small and broadcast. A match is framed by a mark and the text cut
    there, so lines come from counts of line feeds, without a row for each line; patterns may span lines.
    """
    globs = F.udf(lambda gs: "|".join(glob_regex(h) for g in gs for h in ({g.lower(), g.lower().removeprefix("**/")})), "string")
    packed = F.broadcast(rules.withColumn("__globs", globs("file_globs")))
    met = files.join(packed, F.regexp(F.lower(files["path"].cast("string")), F.col("__globs")))
    text = F.translate("text", MARK, " ")
    parts = F.split(F.regexp_replace(text, F.concat(F.lit("("), F.col("pattern"), F.lit(")")), F.lit(f"{MARK}$1{MARK}")), MARK)
    feeds = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    hits = met.where(F.regexp(text, F.col("pattern"))).withColumn("__parts", parts)
    odd = hits.withColumn("__i", F.explode(F.sequence(F.lit(1), F.size("__parts") - 1, F.lit(2))))
    line = F.aggregate(F.slice("__parts", F.lit(1), F.col("__i")), F.lit(1), lambda n, x: n + feeds(x))
    kept = [c for c in rules.columns if c not in ("file_globs", "pattern")]
    return odd.select("repo", "path", *kept, line.alias("line"))


# ---- compound rules

Leg = Callable[[DataFrame, dict], DataFrame]
_LEGS: dict[str, Leg] = {}


def leg(kind: str) -> Callable[[Leg], Leg]:
    """Registers a leg: a function of files (repo, path, text) and parameters that gives repo, state, evidence."""

    def add(f: Leg) -> Leg:
        _LEGS[kind] = f
        return f

    return add


def leg_kinds() -> tuple[str, ...]:
    return tuple(sorted(_LEGS))


def _by_repo(files: DataFrame, *columns: Column) -> DataFrame:
    return files.groupBy("repo").agg(*columns)


def _first(condition: Column) -> Column:
    """The least path for which the condition holds, as text."""
    return F.min(F.when(condition, F.col("path").cast("string")))


def _literal(text: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in text)


@leg("config-absent")
def config_absent(files: DataFrame, params: dict) -> DataFrame:
    """Control present where a file of the globs matches a pattern; proven absent only where there was a file to search."""
    searched = F.lit(False)
    for g in params["file_globs"]:
        searched = searched | F.lower(F.col("path").cast("string")).rlike(glob_regex(g.lower()))
    found = F.lit(False)
    for p in params["patterns"]:
        found = found | F.col("text").rlike(p)
    seen = _by_repo(files.select("repo", "path", searched.alias("s"), (searched & found).alias("f")), F.count_if("s").alias("n"), F.coalesce(F.bool_or("f"), F.lit(False)).alias("has"), _first(F.col("s")).alias("evidence"))
    state = F.when(F.col("n") == 0, OPEN).when(F.col("has"), PRESENT).otherwise(ABSENT)
    return seen.select("repo", state.alias("state"), F.when(state == ABSENT, F.col("evidence")).alias("evidence"))


@leg("endpoint-unauthenticated")
def endpoint_unauthenticated(files: DataFrame, params: dict) -> DataFrame:
    """Evidenced where a route is open to all; a route that is only mentioned is controlled; none leaves it open."""
    route = _literal(params["route_contains"])
    allowed = F.col("text").rlike(r"(?:antMatchers|requestMatchers)\s*\(\s*[\"'][^\"']*" + route + r"[^\"']*[\"']\s*\)\s*\.\s*permitAll\s*\(")
    named = F.contains("text", F.lit(params["route_contains"]))
    seen = _by_repo(files, _first(allowed).alias("evidence"), F.bool_or(named).alias("named"))
    return seen.select("repo", F.when(F.col("evidence").isNotNull(), EVIDENCED).when(F.col("named"), PRESENT).otherwise(OPEN).alias("state"), "evidence")


@leg("seeded-credential-pattern")
def seeded_credentials(files: DataFrame, params: dict) -> DataFrame:
    """Evidenced where a seed file creates accounts and a comment documents a password; else proven absent, also without any seed file."""
    seeds = F.lit(False)
    for g in params.get("file_globs") or ["**/*.sql", "**/seed*"]:
        seeds = seeds | F.lower(F.col("path").cast("string")).rlike(glob_regex(g.lower()))
    both = seeds & F.col("text").rlike(r"(?i)(?:--|#|/\*).{0,80}password") & F.col("text").rlike(r"(?i)INSERT\s+INTO\s+\w*(?:user|account|member)\w*")
    return _by_repo(files, _first(both).alias("evidence")).select("repo", F.when(F.col("evidence").isNotNull(), EVIDENCED).otherwise(ABSENT).alias("state"), "evidence")


@leg("public-auth-entrypoint")
def public_entry(files: DataFrame, params: dict) -> DataFrame:
    """Evidenced where a handler of the route carries no authentication hint; else open."""
    word = params.get("route_contains", "login")
    route = _literal(word)
    handler = r"(?i)(?:@\w*Mapping\s*\([^)]*" + route + r"|def \w*" + route + r"\w*\s*\(|public\s+\w+\s+\w*" + route + r"\w*\s*\()"
    hints = r"(?i)@PreAuthorize|@Secured|@RolesAllowed|@login_required|require_auth|IsAuthenticated|authenticated\(\)"
    bare = F.contains(F.lower("text"), F.lit(word)) & F.col("path").cast("string").rlike(r"\.(?:java|py|ts|js|go)$") & F.col("text").rlike(handler) & ~F.col("text").rlike(hints)
    return _by_repo(files, _first(bare).alias("evidence")).select("repo", F.when(F.col("evidence").isNotNull(), EVIDENCED).otherwise(OPEN).alias("state"), "evidence")


def schema_references(files: DataFrame) -> DataFrame:
    """repo, path, src, dst: the types that each type of a schema text refers to, in its fields."""
    schemas = files.where(F.col("path").cast("string").rlike(r"\.graphqls?$"))
    blocks = schemas.select("repo", "path", F.explode(F.regexp_extract_all("text", F.lit(r"(?s)((?:type|input|interface)\s+\w+[^{]*\{[^}]*\})"), 1)).alias("b"))
    names = F.regexp_extract_all(F.regexp_extract("b", r"(?s)\{(.*)\}", 1), F.lit(r"\w+\s*(?:\([^)]*\))?\s*:\s*\[?\s*(\w+)"), 1)
    refs = blocks.select("repo", "path", F.regexp_extract("b", r"(?:type|input|interface)\s+(\w+)", 1).alias("src"), F.explode(names).alias("dst"))
    known = refs.select("repo", "path", F.col("src").alias("dst")).distinct()
    return refs.distinct().join(known, ["repo", "path", "dst"], "left_semi").select("repo", "path", "src", "dst")


@leg("graphql-schema-cycle")
def schema_cycle(files: DataFrame, params: dict) -> DataFrame:
    """Evidenced where types of a schema refer to one another in a circle; a schema without one is a control."""
    from sievework.operators.flows import cycles

    node = lambda c: F.concat_ws("\n", "repo", F.col("path").cast("string"), c)
    found = cycles(schema_references(files).select(node("src").alias("src"), node("dst").alias("dst")))
    first = F.split(F.element_at("path", 1), "\n")
    circles = found.select(first[0].alias("__repo"), first[1].alias("evidence")).groupBy("__repo").agg(F.min("evidence").alias("evidence"))
    schemas = _by_repo(files, F.coalesce(F.bool_or(F.col("path").cast("string").rlike(r"\.graphqls?$")), F.lit(False)).alias("any"))
    met = schemas.join(circles, F.col("repo").cast("string") == F.col("__repo"), "left")
    return met.select("repo", F.when(F.col("evidence").isNotNull(), EVIDENCED).when(F.col("any"), PRESENT).otherwise(OPEN).alias("state"), "evidence")


def compound(states: DataFrame) -> DataFrame:
    """repo, rule, confidence, legs and evidence of the rules that stand: a control retracts one, an undetermined leg leaves
    it in doubt and is named. states: repo, rule, leg, state, evidence."""
    legs = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "leg", "state"))), ",")
    by = states.groupBy("repo", "rule").agg(
        F.bool_or(F.col("state") == PRESENT).alias("__control"),
        F.when(F.bool_or(F.col("state") == OPEN), UNSURE).otherwise(SURE).alias("confidence"),
        legs.alias("legs"),
        F.array_sort(F.collect_list("evidence")).alias("evidence"),
        F.array_sort(F.collect_list(F.when(F.col("state") == OPEN, F.col("leg")))).alias("undetermined"),
    )
    return by.where("not __control").drop("__control")


def evaluate_compound(files: DataFrame, rules: list[dict]) -> DataFrame:
    """`compound` over rules {id, legs: [{kind, params}]}; an unknown kind of leg is an error."""
    states = None
    for rule in rules:
        for one in rule["legs"]:
            if one["kind"] not in _LEGS:
                raise ValueError(f"{rule['id']}: unknown leg {one['kind']}")
            part = _LEGS[one["kind"]](files, one.get("params") or {}).select("repo", F.lit(rule["id"]).alias("rule"), F.lit(one["kind"]).alias("leg"), "state", "evidence")
            states = part if states is None else states.unionByName(part)
    if states is None:
        raise ValueError("no rules")
    return compound(states)


# ---- supply chain, agents, identities


def supply_chain(dependencies: DataFrame, rules: DataFrame, locked: DataFrame, mapped: DataFrame) -> DataFrame:
    """repo, path, line, name, rule: dependencies (repo, path, ecosystem, name, spec, line) that a rule speaks against.

    rules: id, kind, ecosystems, pattern, names (map of ecosystem to names); a pack, broadcast. locked: repo, ecosystem
    with a lockfile; mapped: repo, scope that a private registry serves. A lockfile pins a mutable spec; an internal name
    needs both guards; a suspicious name is one in any case.
    """
    lock = locked.select("repo", "ecosystem").distinct().withColumn("__lock", F.lit(True))
    scope = mapped.select("repo", F.col("scope").alias("__scope")).distinct().withColumn("__mapped", F.lit(True))
    rows = dependencies.withColumn("__scope", F.split("name", "/")[0]).join(lock, ["repo", "ecosystem"], "left").join(scope, ["repo", "__scope"], "left")
    met = rows.join(F.broadcast(rules), F.array_contains("ecosystems", F.col("ecosystem")))
    guarded = F.coalesce("__lock", F.lit(False))
    private = guarded & F.coalesce("__mapped", F.lit(False)) & (F.col("ecosystem") == "npm") & F.startswith("name", F.lit("@"))
    listed = F.exists(F.coalesce(F.col("names")[F.col("ecosystem")], F.array().cast("array<string>")), lambda n: F.lower(n) == F.lower("name"))
    hit = (
        F.when(F.col("kind") == "mutable-reference", is_mutable_spec(F.col("spec"), F.col("ecosystem")) & ~guarded)
        .when(F.col("kind") == "internal-namespace-unprotected", F.regexp("name", F.concat(F.lit("^(?:"), F.col("pattern"), F.lit(")"))) & ~private)
        .otherwise(listed)
    )
    return met.where(hit).select("repo", "path", "line", "name", F.col("id").alias("rule"))


def agent_grants(files: DataFrame) -> DataFrame:
    """repo, path, server, grant: servers of an agent configuration that run any shell command, or approve every tool,
    without asking. files: repo, path, text (redacted before); what is no JSON grants nothing."""
    keys = " ".join(f", {k} array<string>" for k in AUTO_APPROVE)
    server = f"struct<command string, args array<string>, approval string, requireApproval string{keys}>"
    server = server.replace(" string", ":string").replace(" array<string>", ":array<string>")
    doc = F.from_json("text", f"mcpServers map<string,{server}>, servers map<string,{server}>", {"mode": "PERMISSIVE"})
    rows = files.withColumn("__doc", doc).select("repo", "path", F.explode(F.coalesce("__doc.mcpServers", "__doc.servers")).alias("server", "__s"))
    command = F.element_at(F.split("__s.command", r"[/\\]"), -1)
    gated = F.col("__s.approval").isNotNull() | F.col("__s.requireApproval").isNotNull()
    shell = command.isin(*SHELLS) & F.coalesce(F.array_contains("__s.args", "-c"), F.lit(False))
    every = F.lit(False)
    for k in AUTO_APPROVE:
        every = every | F.coalesce(F.array_contains(f"__s.{k}", "*"), F.lit(False))
    grants = F.array_compact(F.array(F.when(shell & ~gated, "shell-exec"), F.when(every & ~gated, "tool-auto-approve")))
    return rows.select("repo", "path", "server", F.explode(grants).alias("grant"))


def identity_archetypes(functions: DataFrame, rules: DataFrame) -> DataFrame:
    """repo, path, symbol, line_start, rule, channel: functions (repo, path, symbol, line_start, body) that read an identity
    and act on it while nothing in them checks a credential. rules: id, file_globs, identity_read, dispatch, requires_absent;
    a pack, broadcast. Tests are left out; channel is the header or cookie that is read."""
    globs = F.udf(lambda gs: "|".join(glob_regex(h) for g in gs for h in {g.lower(), g.lower().removeprefix("**/")}), "string")
    packed = F.broadcast(rules.withColumn("__globs", globs("file_globs")))
    met = functions.where(~is_test_part(F.col("path"))).join(packed, F.regexp(F.lower(functions["path"]), F.col("__globs")))
    checked = F.exists("requires_absent", lambda p: F.regexp("body", p))
    hits = met.where(F.regexp("body", F.col("identity_read")) & F.regexp("body", F.col("dispatch")) & ~checked)
    read = F.regexp_substr("body", F.col("identity_read"))
    channel = F.coalesce(F.nullif(F.regexp_extract(read, "['\"]([A-Za-z0-9_-]+)['\"]", 1), F.lit("")), F.regexp_extract(F.concat(read, F.lit(")")), r"\.(\w+)\s*[,)\]}]", 1))
    return hits.select("repo", "path", "symbol", "line_start", F.col("id").alias("rule"), channel.alias("channel"))


def integration_evidence(rules: DataFrame, manifests: DataFrame, sources: DataFrame) -> DataFrame:
    """repo, rule, integration: found where a manifest names one of the rule's packages or a source one of its imports,
    no-integration-found where none does, undetermined for rules without markers. rules: id, packages, imports; broadcast."""
    packed = F.broadcast(rules.select("id", F.coalesce("packages", F.array().cast("array<string>")).alias("p"), F.coalesce("imports", F.array().cast("array<string>")).alias("i")))
    # a pack is small and each text is tested once against its markers: no text meets another
    hit = lambda df, c: df.join(packed, F.exists(c, lambda m: F.contains("text", m))).select("repo", "id")
    found = hit(manifests, "p").unionByName(hit(sources, "i")).distinct().withColumn("__hit", F.lit(True))
    repos = manifests.select("repo").unionByName(sources.select("repo")).distinct()
    rows = repos.join(packed, F.lit(True)).join(found, ["repo", "id"], "left")
    state = F.when(F.size("p") + F.size("i") == 0, "undetermined").when(F.col("__hit"), "found").otherwise("no-integration-found")
    return rows.select("repo", F.col("id").alias("rule"), state.alias("integration"))
