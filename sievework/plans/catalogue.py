"""Queries by name: operators bound to the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.scalars import identifier_shape, token_estimate
from sievework.operators import findings as fo
from sievework.operators import extract, flows, joins, ranges, reporting, text, verdicts
from sievework.plans.registry import QUERIES, SQL, query
from sievework.sources.tables import files, findings, table
from sievework.streaming import windows


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from sievework.plans import model  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from sievework.plans import model  # noqa: F401

    return dict(SQL)


# ---- texts

_LINES = "lines AS (SELECT source AS repo, doc_id AS path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)"
_RULES = "rules(label, cwe, severity, confidence, p) AS (VALUES " + ", ".join(f"('{a}', '{b}', CAST({c} AS DOUBLE), CAST({d} AS DOUBLE), '{e}')" for a, b, c, d, e in text.RULES) + ")"
_HITS = f"{_LINES}, {_RULES}, hits AS (SELECT repo, path, line_no, label, cwe, severity, confidence, len(regexp_extract_all(line, p)) AS matches FROM lines, rules WHERE regexp_matches(line, p))"
_BAND = "CASE WHEN severity >= 9 THEN 'Critical' WHEN severity >= 7 THEN 'High' WHEN severity >= 4 THEN 'Medium' WHEN severity >= 0.1 THEN 'Low' ELSE 'None' END"


def _document_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule hits as findings; a label of quality 1 verifies, a missing one leaves the verdict open."""
    hits = text.rule_hits(text.lines(files(spark, sf_dir)))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), (F.col("quality") == 1).alias("v"))
    found = hits.join(labels, "path", "left").withColumn("verified", F.coalesce("v", F.lit(False)))
    code = F.concat("label", F.lit(":"), F.col("path").cast("string"), F.lit(":"), F.col("line_no").cast("string"))
    return found.select(code.alias("id"), "cwe", "repo", F.col("path").alias("file"), F.col("line_no").alias("line"), "severity", "confidence", "verified")


@query(f"""
WITH {_HITS},
f AS (SELECT label || ':' || path || ':' || line_no AS id, cwe, repo, path AS file, line_no AS line, severity, confidence, coalesce(quality = 1, false) AS verified FROM hits LEFT JOIN labels ON doc_id = path),
d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY cwe, repo, file, line ORDER BY confidence DESC, id) = 1),
r AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY cwe, repo, file ORDER BY confidence DESC, id) = 1),
c AS (SELECT round(min(severity) FILTER (verified) - 0.1, 1) AS ceiling FROM r),
o AS (SELECT r.*, ceiling, NOT verified AND (coalesce(severity > ceiling, false) OR confidence > 0.5) AS o FROM r, c),
k AS (SELECT id, cwe, repo, file, line, verified, CASE WHEN o THEN least(severity, coalesce(ceiling, severity)) ELSE severity END AS severity, CASE WHEN o THEN least(confidence, 0.5) ELSE confidence END AS confidence FROM o),
b AS (SELECT *, {_BAND} AS band FROM k)
SELECT id, cwe, repo, file, line, severity, confidence, verified, band, row_number() OVER (PARTITION BY band ORDER BY verified DESC, severity DESC, confidence DESC, id) AS rank
FROM b WHERE band <> 'None' AND (verified OR confidence >= 0.4)
""")
def q_ranked_findings(spark, sf_dir):
    hits = flows.stored(_document_findings(spark, sf_dir))  # texts are read once, whatever follows
    unique = flows.stored(fo.best_by(hits, ["cwe", "repo", "file", "line"]).drop("merged"))
    kept = verdicts.calibrated(fo.best_by(unique, ["cwe", "repo", "file"]).drop("merged").withColumns({"gap": F.lit(""), "control": F.lit(""), "usage": F.lit("")}))
    out = fo.ranked(fo.admitted(kept, "Low", 0.4))
    return out.select("id", "cwe", "repo", "file", "line", "severity", "confidence", "verified", "band", "rank")


@query("SELECT source AS repo, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages, count(*) AS files, CAST(sum(len(text) - len(replace(text, chr(10), '')) + 1) AS BIGINT) AS loc FROM documents GROUP BY source")
def q_manifest_rollup(spark, sf_dir):
    return text.manifest(files(spark, sf_dir))


@query("""
WITH s AS (SELECT doc_id AS path, string_split(text, chr(10)) AS l FROM documents)
SELECT path, list_aggregate(list_transform(l, lambda x, i: lpad(CAST(i AS VARCHAR), CAST(len(CAST(len(l) AS VARCHAR)) AS INTEGER), ' ') || '| ' || x), 'string_agg', chr(10)) AS numbered FROM s
""")
def q_lines_numbered(spark, sf_dir):
    return text.numbered(files(spark, sf_dir))


def _re2(pattern: str) -> str:
    """A pattern for an engine without lookaround: what stands beside a word is matched with it."""
    return pattern.replace("(?<![A-Za-z])", "(?:^|[^A-Za-z])").replace("(?![A-Za-z])", "(?:[^A-Za-z]|$)").replace("'", "''")


def _says(pattern: str) -> str:
    return f"regexp_matches(text, '{_re2(pattern)}')"


_ROUTED = " OR ".join(_says(p) for p, *_ in extract.ROUTES)
_HOSTS = "list_filter(regexp_extract_all(text, '(?i)https?://([a-z0-9.-]+)', 1), lambda h: NOT starts_with(lower(h), 'localhost') AND NOT starts_with(h, '127.0.0.1'))"


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS path, concat_ws(',', CASE WHEN {_says(extract.AUTHENTICATION)} THEN 'authentication_required' END, CASE WHEN {_says(extract.AUTHORIZATION)} THEN 'authorization_required' END, CASE WHEN len({_HOSTS}) > 0 THEN 'external_system' END,
  CASE WHEN {_says(extract.EXECUTE)} OR {_says(extract.SINK)} THEN 'security_sink' END, CASE WHEN {_says(extract.SENSITIVE)} THEN 'sensitive_data' END, CASE WHEN {_ROUTED} THEN 'trust_boundary' END, CASE WHEN {_says(extract.USER_INPUT)} OR {_ROUTED} THEN 'user_controlled_input' END) AS marks FROM documents""")
def q_file_annotations(spark, sf_dir):
    rows = files(spark, sf_dir).withColumn("path", F.col("path").cast("string"))
    return extract.file_annotations(rows).select("path", F.array_join("annotations", ",").alias("marks"))


@query("WITH c(category, signal) AS (VALUES " + ", ".join(f"('{n}', '{s}')" for n, ss in text.CATEGORIES for s in ss) + ") SELECT doc_id AS path, coalesce(string_agg(DISTINCT category, ',' ORDER BY category), '') AS categories FROM documents LEFT JOIN c ON contains(lower(text), signal) GROUP BY doc_id")
def q_data_categories(spark, sf_dir):
    signals = spark.createDataFrame([(n, s) for n, ss in text.CATEGORIES for s in ss], "category string, signal string")
    return extract.data_categories(files(spark, sf_dir), signals).select("path", F.array_join("categories", ",").alias("categories"))


@query("SELECT source AS repo, count(*) AS files, CAST(sum(CASE WHEN len(text) = 0 THEN 0 ELSE floor(len(text) / 3.5) + 1 END) AS BIGINT) AS tokens FROM documents GROUP BY source")
def q_token_estimate(spark, sf_dir):
    return text.token_totals(files(spark, sf_dir))


@query(f"WITH {_HITS} SELECT repo, path, line_no, label, cwe, severity, confidence, matches FROM hits")
def q_rule_hits(spark, sf_dir):
    return text.rule_hits(text.lines(files(spark, sf_dir)))


@query("SELECT DISTINCT path, candidate, round(list_entropy(string_split(candidate, '')), 6) AS bits, round(list_entropy(string_split(candidate, '')), 6) >= 4.0 AS secret FROM (SELECT doc_id AS path, unnest(regexp_extract_all(text, '[A-Za-z0-9+/=_-]{24,}')) AS candidate FROM documents)")
def q_entropy_candidates(spark, sf_dir):
    return text.entropy_candidates(files(spark, sf_dir))


@query("""
WITH w AS (SELECT unnest(regexp_extract_all(text, '[^ \n]+')) AS w FROM documents), p AS (SELECT w, list_filter(string_split(w, '/'), lambda x: x <> '') AS parts FROM w)
SELECT shape, count(*) AS words FROM (
  SELECT CASE WHEN contains(w, '/') AND len(parts) > 0 AND len(list_filter(parts, lambda x: NOT (regexp_matches(x, '^[A-Za-z0-9][A-Za-z0-9._-]*$') AND NOT regexp_matches(x, '[A-Z]{4,}') AND (len(x) < 4 OR regexp_matches(x, '[a-z]'))))) = 0 THEN 'filesystem-path'
    WHEN regexp_matches(w, '[A-Z]{4,}') AND NOT regexp_matches(w, '^[A-Za-z][A-Za-z0-9]*(?:[_-][A-Za-z][A-Za-z0-9]*){2,}$') THEN 'none'
    WHEN regexp_matches(w, '^[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+){2,}$') THEN 'PascalCase' WHEN regexp_matches(w, '^[a-z][a-z0-9]+(?:[A-Z][a-z0-9]+){2,}$') THEN 'camelCase'
    WHEN regexp_matches(w, '^[A-Za-z][A-Za-z0-9]*(?:[_-][A-Za-z][A-Za-z0-9]*){2,}$') THEN CASE WHEN contains(w, '-') THEN 'kebab-case' ELSE 'snake_case' END
    WHEN regexp_matches(w, '^[@A-Za-z][A-Za-z0-9_.-]*(?:[./][A-Za-z0-9_.-]+)+$') THEN 'module-path' ELSE 'none' END AS shape FROM p) GROUP BY shape
""")
def q_identifier_shape(spark, sf_dir):
    words = files(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit("([^ \n]+)"), 1)).alias("w"))
    return words.groupBy(F.coalesce(identifier_shape(F.col("w")), F.lit("none")).alias("shape")).agg(F.count(F.lit(1)).alias("words"))


@query("SELECT source AS repo, count(*) FILTER (lang = 'en') AS searched, CASE WHEN coalesce(bool_or(lang = 'en' AND regexp_matches(text, 'License')), false) THEN 'evidenced' WHEN count(*) FILTER (lang = 'en') = 0 THEN 'undetermined' ELSE 'absent-proven' END AS state FROM documents GROUP BY source")
def q_absence_proof(spark, sf_dir):
    return text.absence(files(spark, sf_dir), "License", "en")


@query("SELECT item_id, count(doc_id) AS files, count(doc_id) > 0 AS found FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY item_id")
def q_must_find(spark, sf_dir):
    return text.must_find(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("wanted")), files(spark, sf_dir))


# ---- findings

_F = "f AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag || l_linestatus AS cwe, l_suppkey AS repo, l_partkey AS file, l_linenumber AS line, round(least(10.0, l_quantity / 5), 1) AS severity, round(1 - l_discount * 5, 2) AS confidence, l_tax >= 0.04 AS verified FROM lineitem)"
_CAL = f"""{_F}, c AS (SELECT round(min(severity) FILTER (verified) - 0.1, 1) AS ceiling FROM f),
o AS (SELECT f.*, ceiling, NOT verified AND (coalesce(severity > ceiling, false) OR confidence > 0.5) AS o FROM f, c),
k0 AS (SELECT id, cwe, repo, file, line, verified, round(CASE WHEN o THEN least(severity, coalesce(ceiling, severity)) ELSE severity END, 1) AS severity, round(CASE WHEN o THEN least(confidence, 0.5) ELSE confidence END, 2) AS confidence FROM o),
k AS (SELECT *, {_BAND} AS band FROM k0)"""


def _calibrated(spark, sf_dir) -> DataFrame:
    return verdicts.calibrated(findings(spark, sf_dir).withColumns({"gap": F.lit(""), "control": F.lit(""), "usage": F.lit("")}))


@query(f"WITH {_F} SELECT cwe, count(*) AS findings, count(DISTINCT repo) AS repos, min(id) AS anchor_id FROM f GROUP BY cwe HAVING count(*) > 1")
def q_systemic_groups(spark, sf_dir):
    return fo.systemic(findings(spark, sf_dir))


@query(f"WITH {_CAL} SELECT band, count(*) AS findings, count(*) FILTER (verified) AS verified, count(*) FILTER (confidence >= 0.8) AS confident FROM k WHERE severity >= 4 AND (verified OR confidence >= 0.5) GROUP BY band")
def q_report_bands(spark, sf_dir):
    return fo.executive_counts(fo.admitted(_calibrated(spark, sf_dir)))


@query(f"WITH {_CAL} SELECT cwe, count(*) AS findings, array_to_string(list_filter(['Critical', 'High', 'Medium', 'Low', 'None'], lambda b: list_contains(list(band), b)), ',') AS bands FROM k GROUP BY cwe ORDER BY findings DESC, cwe LIMIT 8")
def q_recommendations_top8(spark, sf_dir):
    return reporting.recommendations(_calibrated(spark, sf_dir))


@query("WITH f AS (SELECT o_orderkey AS id, c_nationkey AS repo, o_totalprice AS total FROM orders JOIN customer ON c_custkey = o_custkey) SELECT id, repo FROM f WHERE repo = 1 OR id IN (SELECT l_orderkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = 1)")
def q_repo_view(spark, sf_dir):
    """Orders are findings in the customer's nation, their lines the evidence, in the supplier's."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("repo"))
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("id"), F.col("s_nationkey").alias("repo"))
    return reporting.repo_view(orders, line, 1)


# ---- joins

@query("""
WITH a(p_brand, introduced, fixed) AS (SELECT p_brand, CAST(min(p_size) + 2 AS INTEGER), CAST(max(p_size) - 2 AS INTEGER) FROM part GROUP BY p_brand)
SELECT p_partkey AS component, p_brand AS package, p_size AS version, introduced, fixed FROM part JOIN a USING (p_brand) WHERE p_size >= introduced AND p_size < fixed
""")
def q_version_range_join(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    advisories = part.groupBy(F.col("p_brand").alias("package")).agg((F.min("p_size") + 2).alias("introduced"), (F.max("p_size") - 2).alias("fixed"))
    components = part.select(F.col("p_partkey").alias("component"), F.col("p_brand").alias("package"), F.col("p_size").alias("version"))
    return joins.affected(components, advisories).select("component", "package", "version", "introduced", "fixed")


@query("""
WITH a AS (SELECT doc_id, sha256(text) AS x FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS y FROM documents WHERE doc_id % 11 <> 0)
SELECT * FROM (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' WHEN x <> y THEN 'modified' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id) WHERE change IS NOT NULL
""")
def q_change_set(spark, sf_dir):
    """Two versions of the documents: one without every 7th, one without every 11th and with every 5th changed."""
    docs = table(spark, sf_dir, "documents")
    before = docs.where("doc_id % 7 <> 0").select("doc_id", F.sha2("text", 256).alias("digest"))
    after = docs.where("doc_id % 11 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("digest"))
    return joins.changes(before, after, "doc_id", "digest")


# ---- graph

_LINKS = "l AS (SELECT DISTINCT s.s_nationkey AS src, c.c_nationkey AS dst FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN customer c ON c.c_custkey = o.o_custkey)"


@query(f"WITH RECURSIVE {_LINKS}, r(origin, member) AS (SELECT n_nationkey, n_nationkey FROM nation UNION SELECT origin, dst FROM r JOIN l ON l.src = member) SELECT origin, member FROM r")
def q_reachable_members(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    links = (
        lineitem.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst"))
    )
    return flows.closure(flows.stored(links.distinct()), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node")))


@query("SELECT c_custkey AS node FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def q_unattached_guard(spark, sf_dir):
    used = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(used, "c_custkey", "left_anti").select(F.col("c_custkey").alias("node"))


# ---- budgets

@query("SELECT source AS repo, doc_id AS path, t AS tokens FROM (SELECT source, doc_id, t, sum(t) OVER (PARTITION BY source ORDER BY t, doc_id DESC ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT source, doc_id, CAST(CASE WHEN len(text) = 0 THEN 0 ELSE floor(len(text) / 3.5) + 1 END AS BIGINT) AS t FROM documents)) WHERE run <= 12000")
def q_trim_to_budget(spark, sf_dir):
    """Drops whole files, largest first and the least path first on ties, until a repository fits 12,000 tokens."""
    sized = files(spark, sf_dir).select("repo", "path", token_estimate(F.col("text")).alias("tokens"))
    return ranges.cumulative(sized, ["repo"], [F.col("tokens"), F.desc("path")], F.col("tokens"), "run").where("run <= 12000").drop("run")


@query("SELECT source AS repo, lang AS module, count(*) AS files, CAST(sum(CASE WHEN len(text) = 0 THEN 0 ELSE floor(len(text) / 3.5) + 1 END) AS BIGINT) AS tokens, bool_or(contains(text, 'token')) AS sensitive FROM documents GROUP BY ALL")
def q_segments(spark, sf_dir):
    rows = files(spark, sf_dir)
    return rows.groupBy("repo", F.col("language").alias("module")).agg(F.count(F.lit(1)).alias("files"), F.sum(token_estimate(F.col("text"))).alias("tokens"), F.bool_or(F.contains("text", F.lit("token"))).alias("sensitive"))


# ---- pages and verdicts

@query("SELECT page_id, host FROM (SELECT DISTINCT page_id, lower(unnest(regexp_extract_all(url || ' ' || html, 'https?://([A-Za-z0-9.-]+)', 1))) AS host FROM pages) WHERE host <> 'localhost'")
def q_outbound_hosts(spark, sf_dir):
    hosts = F.array_distinct(F.transform(F.regexp_extract_all(F.concat_ws(" ", "url", "html"), F.lit("https?://([A-Za-z0-9.-]+)"), 1), F.lower))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(hosts).alias("host")).where("host <> 'localhost'")


@query("WITH m(marker) AS (VALUES ('<script'), ('<!--'), ('class=\"ad\"'), ('[innerHTML]'), ('v-html')) SELECT page_id, marker, len(string_split(html, marker)) - 1 AS hits FROM pages, m WHERE contains(html, marker)")
def q_template_sinks(spark, sf_dir):
    markers = ("<script", "<!--", 'class="ad"', "[innerHTML]", "v-html")
    times = lambda m: ((F.length("html") - F.length(F.replace("html", F.lit(m), F.lit("")))) / len(m)).cast("long")
    rows = F.array(*[F.struct(F.lit(m).alias("marker"), times(m).alias("hits")) for m in markers])
    return table(spark, sf_dir, "pages").select("page_id", F.inline(rows)).where("hits > 0")


@query("SELECT page_id, 'GET ' || regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)?', 1) AS route FROM pages")
def q_endpoint_routes(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("GET "), F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)?", 1)).alias("route"))


# ---- events

@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS tier, count(*) AS events, round(sum(value), 4) AS value, grouping(event_type) * 2 + grouping(tier) AS level FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS tier FROM events) GROUP BY GROUPING SETS ((event_type), (tier), ())".replace("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS tier, count", "SELECT event_type, tier, count"))
def q_usage_grouping_sets(spark, sf_dir):
    return windows.usage_rollup(table(spark, sf_dir, "events"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def q_usage_windows(spark, sf_dir):
    return windows.usage_windows(table(spark, sf_dir, "events"))


@query("SELECT * FROM (SELECT user_id, event_id, epoch_us(lead(ts) OVER w) // 1000000 - epoch_us(ts) // 1000000 AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE gap > 86400")
def q_heartbeat_gaps(spark, sf_dir):
    return windows.silences(table(spark, sf_dir, "events"), 86400)
