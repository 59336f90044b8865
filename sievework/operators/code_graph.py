"""The code graph: nodes, edges by name resolution, guards that nothing attaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.scalars import node_id

# Edge types that a trace may follow; marks of sources, sinks, operations and validations.
TRAVERSABLE = ("calls", "handler", "reads", "writes", "publishes", "consumes", "renders")
SOURCE_MARKS = ("user_controlled_input", "external_content_source")
SINK_MARKS = ("security_sink", "llm_prompt_sink", "llm_invocation")
OPERATION_MARKS = ("user_controlled_input", "security_sink", "sensitive_data", "authentication_required")
VALIDATIONS = ("authorization_required", "authentication_required", "boundary_labeled")
INTERESTING = ("user_controlled_input", "security_sink", "trust_boundary", "sensitive_data")
TESTISH = r"(?:__tests__|/tests?/|\.test\.|\.spec\.|_test\.)"
UNATTACHED = "unattached_security_guard"
EDGE = ("src", "dst", "type", "cross_repo", "resolution")
# Callers and symbols of one name that meet in one cell, on each side.
CELL = 2048


def _edges(df: DataFrame, src: str, dst: str, kind: str, cross=None, resolution: str | None = None) -> DataFrame:
    return df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("type"), (F.lit(False) if cross is None else cross).alias("cross_repo"), F.lit(resolution).cast("string").alias("resolution")).distinct()


def upsert_nodes(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """One node per id: the first row's fields, and the union of all rows' annotations, sorted.

    rows: id, annotations, seq and any other fields. The fields of a node come from one row, whole.
    """
    fields = [c for c in rows.columns if c not in ("id", "annotations", seq)]
    marks = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("annotations", F.array().cast("array<string>"))))))
    merged = rows.groupBy("id").agg(F.min_by(F.struct(*fields), F.col(seq)).alias("f"), marks.alias("annotations"))
    return merged.select("id", *[F.col(f"f.`{c}`").alias(c) for c in fields], "annotations")


def has_mark(*marks: str):
    return F.arrays_overlap(F.coalesce("annotations", F.array().cast("array<string>")), F.array(*map(F.lit, marks)))


def sources(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.col("type") == "endpoint") | has_mark(*SOURCE_MARKS))


def sinks(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.col("type") == "datastore") | has_mark(*SINK_MARKS))


def traversable(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("type").isin(*TRAVERSABLE))


def interesting_files(nodes: DataFrame) -> DataFrame:
    """Files with a mark that calls for a look, or that could not be parsed."""
    return nodes.where((F.col("type") == "file") & (has_mark(*INTERESTING) | ~F.coalesce("parsed", F.lit(True))))


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges `calls` by name: the last part of the callee is a symbol of any repository.

    calls: repo, path, caller, callee; symbols: repo, path, name, id. A caller that is no symbol gives way to its file; a
    node does not call itself. Edges are as many as calls times symbols of a name, so they are distinct as they are made
    and never exchanged: what may repeat one (repositories of a caller, symbols that share an id) is folded before.
    Callers and symbols of a name meet in cells of about CELL by CELL, so a common name is many tasks.
    """
    from sievework.operators.flows import stored  # flows needs the marks above

    callers = symbols.select("repo", "path", F.col("name").alias("caller"), F.col("id").alias("__caller")).distinct()
    wanted = calls.select("repo", "path", "caller", F.element_at(F.split("callee", "[.]"), -1).alias("name")).distinct().join(callers, ["repo", "path", "caller"], "left")
    wanted = wanted.select(F.coalesce("__caller", node_id(F.col("repo"), F.col("path"))).alias("src"), F.struct(F.col("repo").alias("of")).alias("__repo"), "name")
    asked = stored(wanted.groupBy("name", "src").agg(F.collect_set("__repo").alias("__repos")))
    places = stored(symbols.where("name is not null").groupBy(F.col("id").alias("dst")).agg(F.collect_set(F.struct("name", F.col("repo").alias("of"))).alias("__places")))
    made = _meet(asked, places.where(F.size("__places") == 1).select("dst", F.col("__places")[0]["name"].alias("name"), F.col("__places")[0]["of"].alias("__of")))
    shared = places.where(F.size("__places") > 1).select("dst", F.inline("__places")).withColumnRenamed("of", "__of")
    met = made.unionByName(_meet(asked, shared).distinct())
    return met.select("src", "dst", F.lit("calls").alias("type"), "cross_repo", F.lit("name-based").alias("resolution"))


def _meet(asked: DataFrame, targets: DataFrame) -> DataFrame:
    """src, dst, cross_repo of callers (name, src, __repos) and symbols (name, dst, __of) of one name."""
    count = lambda df, c: df.groupBy("name").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias(c))
    grid = count(asked, "__a").join(count(targets, "__b"), "name")
    cells = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(grid, "name").select("name", "src", "__repos", F.pmod(F.xxhash64("src"), F.col("__a")).cast("int").alias("__i"), cells("__b").alias("__j"))
    right = targets.join(grid, "name").select("name", "dst", "__of", F.pmod(F.xxhash64("dst"), F.col("__b")).cast("int").alias("__j"), cells("__a").alias("__i"))
    met = left.join(right, ["name", "__i", "__j"]).where("src <> dst")
    crossed = F.array_distinct(F.transform("__repos", lambda r: r["of"] != F.col("__of")))
    return met.select("src", "dst", F.explode(crossed).alias("cross_repo"))


def resolve_wiring(wiring: DataFrame, symbols: DataFrame, endpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved) of registrations (repo, path, route, target, line) of guards by name within the repository.

    The registering file calls the guard, and the file's endpoints (the one of the route, where there is one) have it as
    a handler. unresolved: file, line, name, reason. endpoints: id, repo, path, route.
    """
    facts = wiring.select("repo", "path", "route", "target", "line").distinct()
    targets = symbols.select("repo", F.col("name").alias("target"), F.col("id").alias("dst")).distinct()
    met = facts.join(targets, ["repo", "target"]).withColumn("file", node_id(F.col("repo"), F.col("path")))
    points = endpoints.select("repo", "path", F.col("route").alias("__route"), F.col("id").alias("__endpoint"))
    handled = met.join(points, ["repo", "path"]).where(F.col("route").isNull() | (F.col("route") == F.col("__route")))
    edges = _edges(met, "file", "dst", "calls", resolution="name-based").unionByName(_edges(handled, "__endpoint", "dst", "handler", resolution="name-based"))
    missing = facts.join(targets, ["repo", "target"], "left_anti")
    return edges, missing.select(F.col("path").alias("file"), "line", F.col("target").alias("name"), F.lit("no in-repo symbol with this name").alias("reason")).distinct()


def bind_templates(bindings: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges `renders` from symbols to the template sinks (repo, sink, name) that show them, names compared without case."""
    names = symbols.select("repo", F.lower("name").alias("__name"), F.col("id").alias("src")).distinct()
    met = bindings.select("repo", "sink", F.lower("name").alias("__name")).distinct().join(names, ["repo", "__name"]).where("src <> sink")
    return _edges(met, "src", "sink", "renders", resolution="name-based")


def handler_edges(endpoints: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges `handler` from endpoints (id, repo, path, symbol) to their symbols that are nodes."""
    wanted = endpoints.select("id", node_id(F.col("repo"), F.col("path"), F.col("symbol")).alias("dst"))
    return _edges(wanted.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi"), "id", "dst", "handler")


def data_access(accesses: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(datastore nodes, edges) of accesses (repo, path, symbol, operation, detail): reads, else writes.

    A store that is executed on carries the mark of a sink, whatever else accesses it.
    """
    rows = accesses.withColumn("store", node_id(F.col("repo"), F.lit("<datastore>"), F.coalesce("detail", "operation")))
    stores = rows.groupBy("store").agg(F.min("repo").alias("repo"), F.max("detail").alias("symbol"), F.bool_or(F.col("operation") == "execute").alias("sink"))
    marks = F.when(F.col("sink"), F.array(F.lit("security_sink"))).otherwise(F.array().cast("array<string>"))
    made = stores.select(F.col("store").alias("id"), "repo", F.lit("datastore").alias("type"), F.lit("<datastore>").alias("path"), "symbol", marks.alias("annotations"))
    met = rows.withColumn("src", node_id(F.col("repo"), F.col("path"), F.col("symbol"))).join(nodes.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    kind = F.when(F.col("operation") == "read", "reads").otherwise("writes")
    edges = met.select("src", F.col("store").alias("dst"), kind.alias("type"), F.lit(False).alias("cross_repo"), F.lit(None).cast("string").alias("resolution")).distinct()
    return made, edges


def unattached_guards(nodes: DataFrame, edges: DataFrame, names: str) -> DataFrame:
    """The function nodes whose name begins like a guard's (a pattern) and that no other production file refers to.

    Containment is no reference, and neither are tests or the guard's own file.
    """
    guards = nodes.where((F.col("type") == "function") & F.coalesce("symbol", F.lit("")).rlike(f"^(?:{names})"))
    path = F.split(F.regexp_replace("src", "^[^:]*:", ""), "#")[0]
    inbound = edges.where("type <> 'contains'").select(F.col("dst").alias("id"), path.alias("__from")).where(~F.col("__from").rlike(TESTISH))
    met = guards.join(inbound, "id").where(F.col("__from") != F.col("path")).select("id").distinct()
    return guards.join(met, "id", "left_anti")


def with_unattached(nodes: DataFrame, edges: DataFrame, names: str) -> DataFrame:
    """nodes, with the mark on unattached guards."""
    found = unattached_guards(nodes, edges, names).select("id", F.lit(True).alias("__open"))
    marks = F.coalesce("annotations", F.array().cast("array<string>"))
    marked = F.when(F.col("__open"), F.array_sort(F.array_union(marks, F.array(F.lit(UNATTACHED))))).otherwise(F.col("annotations"))
    return nodes.join(found, "id", "left").withColumn("annotations", marked).drop("__open").select(*nodes.columns)


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids one hop from the given ones over calls and handlers, in either direction."""
    hops = edges.where(F.col("type").isin("calls", "handler")).select("src", "dst")
    own = nodes.select(F.col("id").alias("src")).distinct()
    both = hops.unionByName(hops.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.join(own, "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(own.withColumnRenamed("src", "id"), "id", "left_anti")


def call_summary(edges: DataFrame, most: int = 40) -> DataFrame:
    """The first arrows `a -> b` between callers and callees, sorted."""
    return edges.where("type = 'calls'").select(F.concat_ws(" -> ", "src", "dst").alias("arrow")).distinct().orderBy("arrow").limit(most)


def role_digest(edges: DataFrame, nodes: DataFrame, most: int = 12, files: int = 40) -> DataFrame:
    """file, callers (the first `most`, then +n more), guards: who refers to each file, of the first files by name."""
    at = nodes.select("id", F.concat_ws(":", "repo", "path").alias("file"), F.coalesce("annotations", F.array().cast("array<string>")).alias("marks"))
    calls = edges.where(F.col("type").isin("calls", "handler"))
    met = calls.join(at.select(F.col("id").alias("src"), F.col("file").alias("caller")), "src").join(at.select(F.col("id").alias("dst"), "file"), "dst").where("caller <> file")
    callers = met.groupBy("file").agg(F.array_sort(F.collect_set("caller")).alias("c"))
    shown = F.when(F.size("c") > most, F.concat(F.slice("c", 1, most), F.array(F.concat(F.lit("+"), (F.size("c") - most).cast("string"), F.lit(" more"))))).otherwise(F.col("c"))
    guards = at.where(F.arrays_overlap("marks", F.array(*map(F.lit, VALIDATIONS[:2])))).groupBy("file").agg(F.array_sort(F.collect_set("id")).alias("guards"))
    return callers.join(guards, "file", "full").select("file", shown.alias("callers"), "guards").orderBy("file").limit(files)


def guard_matrix(endpoints: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """file, guards: for each file with routes the guards that handle them, or the one word none."""
    guards = nodes.where(has_mark(*VALIDATIONS[:2])).select(F.col("id").alias("dst"), "symbol")
    met = endpoints.select(F.col("id").alias("src"), F.col("path").alias("file")).join(edges.where("type = 'handler'"), "src", "left").join(guards, "dst", "left")
    names = F.array_sort(F.collect_set("symbol"))
    return met.groupBy("file").agg(F.when(F.size(names) > 0, F.array_join(names, ",")).otherwise("none").alias("guards"))
