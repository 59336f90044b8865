"""What a model answers, as findings: parsing, normalising, citations, candidate controls, reproductions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions.scalars import band, clamped, normal_cwe, percent_encoded

EVIDENCE = "array<struct<repo:string,file:string,reason:string,symbol:string,segment_id:string>>"
RAW = (
    "cwe string, severity_score double, confidence double, location struct<repo:string,file:string,symbol:string,line_start:int,line_end:int>, description string, evidence " + EVIDENCE + ", attack_scenario string, impact string, "
    "recommendation string, detection string, code_context string, tool_ref string, flow_category string, flow_ref string, flow_narrative string, regulatory_refs array<struct<regime:string,obligation:string,basis:string>>"
)
# Categories of flow findings, default confidence, controls that a packet offers, and marks of controls.
FLOW_CATEGORIES = ("flow-gap", "regulatory-violation")
DEFAULT_CONFIDENCE, MOST_CONTROLS = 0.5, 12
CONTROL_MARKS = ("authentication_required", "authorization_required", "boundary_labeled", "security_sink", "trust_boundary", "unattached_security_guard")
# Harmless probes by weakness, and the classes that need none.
CANARY = "SIEVEWORK-CANARY-1"
PROBES = {
    "CWE-89": f"' OR '{CANARY}'='{CANARY}", "CWE-78": f"; echo {CANARY}", "CWE-77": f"; echo {CANARY}", "CWE-79": f'<span data-canary="{CANARY}">{CANARY}</span>', "CWE-22": f"../{CANARY}",
    "CWE-918": f"http://127.0.0.1:9/{CANARY}", "CWE-502": f"canary-marker:{CANARY}", "CWE-639": f"{CANARY}-other-tenant-id",
}
SECRET_CLASSES = ("CWE-798", "CWE-259", "CWE-256", "CWE-522", "CWE-532")
ACCESS_CLASSES = ("CWE-862", "CWE-863", "CWE-285", "CWE-284", "CWE-306", "CWE-287")
WHOLE_VALUE = ("CWE-918",)


def parse(answers: DataFrame) -> DataFrame:
    """answers (key, content) with `findings`, an array of RAW, and `malformed`: JSON in a fenced block or alone, an object
    with findings, one finding, or a list. An empty answer has none; prose, or findings that are no list, is malformed."""
    fenced = F.regexp_extract("content", r"(?s)```(?:json)?\s*(.*?)```", 1)
    text = F.trim(F.when(fenced != "", fenced).otherwise(F.coalesce("content", F.lit(""))))
    rows = answers.withColumn("__t", F.regexp_replace(text, r"^\s+|\s+$", ""))
    listed = F.from_json("__t", f"array<struct<{_typed(RAW)}>>")
    inner = F.get_json_object("__t", "$.findings")
    single = F.array(F.from_json("__t", RAW))
    is_list, is_object = F.startswith("__t", F.lit("[")), F.startswith("__t", F.lit("{"))
    valid = F.try_parse_json("__t").isNotNull()
    found = F.when(is_list, listed).when(is_object & inner.isNotNull(), F.from_json(inner, f"array<struct<{_typed(RAW)}>>")).when(is_object & F.get_json_object("__t", "$.cwe").isNotNull(), single)
    bad = (F.col("__t") != "") & (~valid | ~(is_list | is_object) | (is_object & inner.isNotNull() & ~F.startswith(F.trim(inner), F.lit("["))))
    none = F.expr(f"cast(array() as array<struct<{_typed(RAW)}>>)")
    return rows.select(*answers.columns, F.when(bad, none).otherwise(F.coalesce(F.filter(found, lambda f: f.isNotNull()), none)).alias("findings"), bad.alias("malformed"))


def _typed(ddl: str) -> str:
    """name type, .. as name:type, .. for a struct."""
    out, depth = "", 0
    for part in ddl.split(", "):
        if not depth:
            name, _, kind = part.partition(" ")
            part = f"{name}:{kind}"
        depth += part.count("<") - part.count(">")
        out += ("," if out else "") + part
    return out


def normalize(raw: DataFrame, known: DataFrame, default_repo: Column, segment: Column) -> tuple[DataFrame, DataFrame]:
    """(findings, rejected with reason) of RAW rows: the weakness must be known (cwe, default_severity, name), evidence must
    name a file and a reason, the three parts of a flow finding come together, and a violation names its obligation."""
    rows = raw.withColumn("cwe", normal_cwe(F.coalesce("cwe", F.lit("")))).join(F.broadcast(known.select("cwe", "default_severity", F.col("name").alias("__name"))), "cwe", "left")
    repo = F.coalesce(F.nullif("location.repo", F.lit("")), default_repo)
    file = F.coalesce("location.file", F.lit(""))
    item = lambda e: F.struct(F.coalesce(F.nullif(e["repo"], F.lit("")), repo).alias("repo"), F.coalesce(F.nullif(e["file"], F.lit("")), file).alias("file"), F.trim(F.coalesce(e["reason"], F.lit(""))).alias("reason"), e["symbol"].alias("symbol"), F.coalesce(e["segment_id"], segment).alias("segment_id"))
    empty = F.expr(f"cast(array() as {EVIDENCE})")
    evidence = F.filter(F.transform(F.coalesce("evidence", empty), item), lambda e: (e["file"] != "") & (e["reason"] != ""))
    rows = rows.withColumn("evidence", evidence)
    flow = [F.coalesce(c, F.lit("")) != "" for c in ("flow_category", "flow_ref", "flow_narrative")]
    some, every = flow[0] | flow[1] | flow[2], flow[0] & flow[1] & flow[2]
    reason = (
        F.when(F.col("__name").isNull(), F.concat(F.lit("unknown weakness "), "cwe"))
        .when(F.size("evidence") == 0, "finding has no usable evidence")
        .when(some & ~every, "flow finding requires flow_category, flow_ref and flow_narrative together")
        .when(some & ~F.col("flow_category").isin(*FLOW_CATEGORIES), F.concat(F.lit("unknown flow_category "), "flow_category"))
        .when((F.col("flow_category") == "regulatory-violation") & (F.coalesce(F.size("regulatory_refs"), F.lit(0)) <= 0), "regulatory-violation findings must name regime and obligation")
    )
    rows = rows.withColumn("reason", reason)
    score = clamped(F.round(F.coalesce("severity_score", "default_severity"), 1), 0.0, 10.0)
    start = F.coalesce(F.when(F.col("location.line_start") != 0, F.col("location.line_start")), F.lit(1))
    text = lambda c, default: F.coalesce(F.nullif(F.trim(c), F.lit("")), default)
    name = F.col("__name")
    good = rows.where("reason is null").select(
        *[c for c in raw.columns if c not in RAW_NAMES], "cwe", score.alias("severity"), clamped(F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE)), 0.0, 1.0).alias("confidence"), repo.alias("repo"), file.alias("file"), F.nullif("location.symbol", F.lit("")).alias("symbol"), start.alias("line_start"),
        F.greatest(start, F.coalesce(F.when(F.col("location.line_end") != 0, F.col("location.line_end")), start)).alias("line_end"), text("description", name).alias("description"), "evidence",
        text("attack_scenario", F.concat(F.lit("An attacker exploits "), name, F.lit(" via the exposed entry point."))).alias("attack_scenario"), text("impact", F.lit("Security impact on the application.")).alias("impact"),
        text("recommendation", F.concat(F.lit("Remediate "), name, F.lit(" at the reported location."))).alias("recommendation"), F.when(F.col("detection").isin("format", "heuristic"), F.col("detection")).alias("detection"),
        F.when(F.col("code_context").isin("production", "test"), F.col("code_context")).alias("code_context"), "tool_ref", F.nullif("flow_ref", F.lit("")).alias("flow_ref"), segment.alias("segment_id"),
    )
    good = good.withColumn("band", band(F.col("severity")))
    return good, rows.where("reason is not null").select(*[c for c in raw.columns if c not in RAW_NAMES], "cwe", file.alias("file"), "reason")


RAW_NAMES = tuple(part.split(":")[0] for part in _typed(RAW).split(",") if ":" in part and part.split(":")[0].isidentifier())


def verify_citations(citations: DataFrame, members: DataFrame, files: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, holds, failures of what answers cite (id, repo, file, line_start, line_end, pattern, symbol): the file exists, the
    lines are there and hold the pattern word for word, the symbol is in the code model. All citations of an id must hold.

    files: repo, path, text; nodes: id. Only cited files are cut into lines.
    """
    known = members.select("repo").distinct().withColumn("__member", F.lit(True))
    cited = citations.select("repo", "file").distinct()
    texts = files.withColumnRenamed("path", "file").join(cited, ["repo", "file"], "left_semi").select("repo", "file", F.split("text", "\n").alias("__lines"))
    there = nodes.select(F.col("id").alias("__symbol")).distinct().withColumn("__node", F.lit(True))
    place = F.concat("repo", F.lit(":"), "file", F.lit("#"), "symbol")
    rows = citations.join(known, "repo", "left").join(texts, ["repo", "file"], "left").withColumn("__symbol", place).join(there, "__symbol", "left")
    window = F.array_join(F.slice("__lines", F.greatest("line_start", F.lit(1)), F.greatest(F.col("line_end") - F.col("line_start") + 1, F.lit(1))), "\n")
    outside = (F.col("line_start") < 1) | (F.col("line_start") > F.size("__lines"))
    said = F.col("__lines").isNotNull()
    failures = F.array_compact(
        F.array(
            F.when(F.col("__member").isNull(), "no workspace member").when((F.coalesce("file", F.lit("")) != "") & ~said, "no such file").when(said & outside, "lines beyond the file").when(said & (F.col("line_end") < F.col("line_start")), "line range is inverted").when(said & ~F.contains(window, F.coalesce("pattern", F.lit(""))), "pattern not at the cited lines"),
            F.when((F.coalesce("symbol", F.lit("")) != "") & F.col("__node").isNull(), "symbol not in the code model"),
        )
    )
    by = rows.withColumn("__f", failures).groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("__f")))).alias("failures"))
    return by.select("id", (F.size("failures") == 0).alias("holds"), "failures")


def candidate_controls(findings: DataFrame, nodes: DataFrame, steps: DataFrame, integrations: DataFrame, most: int = MOST_CONTROLS) -> DataFrame:
    """id, rank, repo, file, reason: controls that a packet offers for each finding, the first `most` by source and order,
    each file once: marked files, the finding's own traced path, integrations, its unassessed control.

    findings: id, repo, file, control, control_state; nodes: repo, path, type, annotations; steps: id, seq, repo, file;
    integrations: repo, endpoint. What holds for every finding is cut to `most` before it meets them.
    """
    shared = F.array_intersect(F.coalesce("annotations", F.array().cast("array<string>")), F.array(*map(F.lit, CONTROL_MARKS)))
    marked = nodes.where("type = 'file'").withColumn("__m", F.array_sort(shared)).where("size(__m) > 0")
    marked = marked.groupBy("repo", "path").agg(F.min(F.concat(F.lit("graph annotation: "), F.array_join("__m", ", "))).alias("reason")).orderBy("repo", "path").limit(most)
    typed = integrations.select("repo", F.col("endpoint").alias("path"), F.lit("typed integration point at a trust boundary").alias("reason")).distinct().orderBy("repo", "path").limit(most)
    general = marked.withColumn("source", F.lit(0)).unionByName(typed.withColumn("source", F.lit(2))).select("source", F.concat_ws(":", "repo", "path").alias("order"), "repo", F.col("path").alias("file"), "reason")
    every = findings.select("id").crossJoin(F.broadcast(general))  # at most 2 * most rows
    own = steps.select("id", F.lit(1).alias("source"), F.lpad(F.col("seq").cast("string"), 9, "0").alias("order"), "repo", "file", F.lit("on the finding's traced verification path").alias("reason"))
    open_ = findings.where("control_state = 'unassessed' and coalesce(control, '') <> ''").select("id", F.lit(3).alias("source"), F.lit("").alias("order"), "repo", "file", F.concat(F.lit("shipped control '"), "control", F.lit("' could not be established")).alias("reason"))
    rows = every.unionByName(own).unionByName(open_).where("coalesce(file, '') <> ''")
    once = rows.groupBy("id", "repo", "file").agg(F.min(F.struct("source", "order", "reason")).alias("b"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("b.source", "b.order"))
    return once.withColumn("rank", rank).where(F.col("rank") <= most).select("id", "rank", "repo", "file", "b.reason")


def reproductions(findings: DataFrame) -> DataFrame:
    """findings with mode, trigger, trigger_reason, trail: how to see a finding in a local copy, without harm.

    findings: cwe, status, route (of its entry point, METHOD path), fixed_prefix, path (of its verification). Observed only
    where verified; a probe that needs a whole value is none at a fixed prefix; a trail is a traced path or nothing.
    """
    probe = F.coalesce(*[F.when(F.col("cwe") == c, p) for c, p in PROBES.items()], F.lit(CANARY))
    feasible = ~(F.coalesce("fixed_prefix", F.lit(False)) & F.col("cwe").isin(*WHOLE_VALUE))
    method = F.split(F.regexp_extract("route", r"^([A-Z|]+)\s+(\S+)", 1), r"\|")[0]
    target = F.regexp_extract("route", r"^([A-Z|]+)\s+(\S+)", 2)
    filled = lambda value: F.regexp_replace(target, r"<[^>]+>|\{[^}]+\}|:[A-Za-z_]\w*", F.replace(percent_encoded(value), F.lit("$"), F.lit("%24")))
    sent = lambda value: F.concat(method, F.lit(" "), filled(value))
    has_route = F.coalesce("route", F.lit("")).rlike(r"^[A-Z|]+\s+\S+")
    trigger = (
        F.when(F.col("cwe").isin(*SECRET_CLASSES), "inspect the assignment in a local checkout")
        .when(F.col("cwe").isin(*ACCESS_CLASSES), F.concat(F.lit("send as a low-privilege session: "), F.when(has_route, sent(F.lit(CANARY))).otherwise("GET /<resource>")))
        .when(has_route, F.concat(F.lit("send: "), sent(probe), F.lit(" with "), probe))
        .otherwise(F.concat(F.lit("invoke directly with "), probe))
    )
    return findings.withColumns(
        {
            "mode": F.when(F.coalesce("status", F.lit("")) == "verified", "observed").otherwise("hypothesis"),
            "trigger": F.when(feasible, trigger),
            "trigger_reason": F.when(~feasible, "no achievable probe: the value follows a fixed prefix that the caller does not control"),
            "trail": F.when(F.coalesce(F.size("path"), F.lit(0)) > 0, F.col("path")),
        }
    )
