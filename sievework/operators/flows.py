"""Flows from sources to sinks over the code graph, their attributes, and cycles of references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.operators.code_graph import OPERATION_MARKS, VALIDATIONS, has_mark

#: Nodes of a path from which it is not carried on; flows that stay of each source.
MOST_NODES, PER_SOURCE = 12, 8


def checkpoints(spark: SparkSession) -> None:
    """Makes checkpoint() go to the folder that spark.checkpoint.dir names; a local master may do without one (tests)."""
    if spark.sparkContext.getCheckpointDir():
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        found = f"file://{tempfile.mkdtemp(prefix='sievework-')}"
    spark.sparkContext.setCheckpointDir(found)


def stored(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint: its rows, their order in partitions included, are fixed for what reads them twice."""
    checkpoints(df.sparkSession)
    return df.checkpoint()


def _least(flows: DataFrame, per_source: int) -> DataFrame:
    """The per_source least (sink, path) of each source: tasks keep as many of theirs before anything is exchanged."""
    order = Window.partitionBy("source").orderBy("sink", "path")
    return flows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= per_source).drop("__n")


def bounded_flows(edges: DataFrame, sources: DataFrame, sinks: DataFrame, most_nodes: int = MOST_NODES, per_source: int = PER_SOURCE) -> DataFrame:
    """source, sink, path (array of nodes): flows found breadth first, with one visited set a source.

    A node that is no sink is expanded once, along the path that found it first (parents in the order they were found,
    targets ascending); among paths of one length that is the least, node by node. A sink ends a path, is never visited,
    and may end several. A path of more than most_nodes nodes is not carried on. The per_source least (sink, path) of a
    source stay; edges that repeat count once. Rounds are joins of the frontier with edges; visited nodes go by an
    anti-join, and each round cuts lineage by one checkpoint(), after flows beyond the bound are gone.
    """
    checkpoints(edges.sparkSession)
    ends = sinks.select(F.col("node").alias("dst"), F.lit(True).alias("ends")).distinct()
    steps = stored(edges.select("src", "dst").distinct().join(ends, "dst", "left").select("src", "dst", F.coalesce("ends", F.lit(False)).alias("ends")))
    start = sources.select(F.col("node").alias("source")).distinct()
    frontier = start.select("source", F.col("source").alias("at"), F.array("source").alias("path"))
    seen, flows = frontier.select("source", "at"), None
    for _ in range(most_nodes):
        met = frontier.join(steps, frontier["at"] == steps["src"]).select("source", F.col("dst").alias("at"), F.array_append("path", F.col("dst")).alias("path"), "ends")
        fresh = met.join(seen, ["source", "at"], "left_anti")
        ended = _least(fresh.where("ends").select("source", F.col("at").alias("sink"), "path"), per_source).select("source", F.col("sink").alias("at"), "path", F.lit(True).alias("ends"))
        opened = fresh.where("not ends").groupBy("source", "at").agg(F.min("path").alias("path")).withColumn("ends", F.lit(False))
        round_ = stored(opened.unionByName(ended))
        found = round_.where("ends").select("source", F.col("at").alias("sink"), "path")
        flows = found if flows is None else flows.unionByName(found)
        frontier = round_.where("not ends").drop("ends")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.select("source", "at"))
    return _least(flows, per_source)


def flow_attributes(flows: DataFrame, nodes: DataFrame) -> DataFrame:
    """flows with n_nodes, validations (sorted `mark at label`), transforms (labels inside, in order) and crosses_repo.

    nodes: id, repo, path, symbol, type, route, annotations. A node that is not listed is its own label.
    """
    label = F.when(F.col("type") == "endpoint", F.concat(F.coalesce("route", F.lit("endpoint")), F.lit(" ("), "repo", F.lit(")"))).otherwise(F.col("id"))
    known = nodes.select(F.col("id").alias("node"), label.alias("label"), F.col("repo").alias("at"), "symbol", F.coalesce("annotations", F.array().cast("array<string>")).alias("marks"))
    keyed = flows.withColumn("__flow", F.struct("source", "sink", "path"))
    steps = keyed.select("__flow", F.posexplode("path").alias("i", "node")).join(known, "node", "left").withColumn("label", F.coalesce("label", "node"))
    marks = F.filter(F.array(*[F.when(F.array_contains("marks", m), F.concat(F.lit(f"{m} at "), "label")) for m in VALIDATIONS]), lambda x: x.isNotNull())
    inside = (F.col("node") != F.col("__flow.source")) & (F.col("node") != F.col("__flow.sink")) & (F.coalesce("symbol", F.lit("")) != "")
    found = steps.groupBy("__flow").agg(
        F.count(F.lit(1)).cast("int").alias("n_nodes"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(marks, F.array().cast("array<string>")))))).alias("validations"),
        F.transform(F.array_sort(F.collect_list(F.when(inside, F.struct("i", "label")))), lambda x: x["label"]).alias("transforms"),
        (F.countDistinct("at") > 1).alias("crosses_repo"),
    )
    return found.select("__flow.*", "n_nodes", "validations", "transforms", "crosses_repo")


def flow_for_locations(findings: DataFrame, flows: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, flow_seq of the flow for each finding (id, repo, file, symbol): the last one that has the place at or just
    before its end, else the first one that has it at all. flows: flow_seq, path; findings without any are left out."""
    places = nodes.select(F.col("id").alias("node"), "repo", F.col("path").alias("file"), F.col("symbol").alias("__symbol"))
    steps = flows.select("flow_seq", F.size("path").alias("n"), F.posexplode("path").alias("i", "node")).join(places, "node")
    met = findings.select("id", "repo", "file", "symbol").join(steps, ["repo", "file"])
    met = met.where((F.coalesce("symbol", F.lit("")) == "") | F.col("__symbol").isNull() | (F.col("symbol") == F.col("__symbol")))
    at = met.groupBy("id", "flow_seq").agg(F.max(F.col("i") >= F.col("n") - 2).alias("near"))
    best = at.groupBy("id").agg(F.max(F.when(F.col("near"), F.col("flow_seq"))).alias("last"), F.min("flow_seq").alias("first"))
    return best.select("id", F.coalesce("last", "first").alias("flow_seq"))


def flows_for_segment(flows: DataFrame, nodes: DataFrame, segment_files: DataFrame) -> DataFrame:
    """The flows (source, sink, path) that touch a file (repo, path) of the segment."""
    inside = nodes.join(segment_files, ["repo", "path"], "left_semi").select(F.col("id").alias("node"))
    touched = flows.select("source", "sink", "path", F.explode("path").alias("node")).join(inside, "node", "left_semi")
    return touched.select("source", "sink", "path").distinct()


def reachability(nodes: DataFrame, flows: DataFrame, by: str | None = None, groups: DataFrame | None = None) -> DataFrame:
    """endpoints, operations, flows, and whether reachability is unconfirmed: both are there, and no flow.

    One row, or one for each of `groups` where nodes and flows have the column `by`.
    """
    key = [by] if by else []
    counts = nodes.groupBy(*key).agg(
        F.count_if(F.col("type") == "endpoint").alias("endpoints"),
        F.count_if((F.col("type") != "endpoint") & ((F.col("type") == "datastore") | has_mark(*OPERATION_MARKS))).alias("operations"),
    )
    traced = flows.groupBy(*key).agg(F.count(F.lit(1)).alias("flows"))
    if by:
        both = groups.select(by).distinct().join(counts, by, "left").join(traced, by, "left")
    else:
        both = counts.crossJoin(F.broadcast(traced))  # one row each
    both = both.na.fill(0, ["endpoints", "operations", "flows"])
    return both.withColumn("unconfirmed", (F.col("endpoints") > 0) & (F.col("operations") > 0) & (F.col("flows") == 0))


def cycles(refs: DataFrame, most: int = 12) -> DataFrame:
    """path of each elementary cycle of references (src, dst) of two nodes or more, from its least node on.

    Paths grow from their least node through greater ones only, and those that cannot return are gone at once: a path goes
    on only over nodes that reach its start by nodes not less than it. most: nodes of a cycle; longer ones raise an error.
    """
    checkpoints(refs.sparkSession)
    links = refs.where("src <> dst").select("src", "dst").distinct()
    paths = links.where("src < dst").select(F.col("src").alias("start"), F.array("src", "dst").alias("path"), F.col("dst").alias("at"))
    found = None
    for n in range(2, most + 2):
        paths = paths.checkpoint()
        if paths.isEmpty():
            break
        if n > most:
            raise ValueError(f"a path of more than {most} nodes may still close; give a larger bound")
        back = paths.join(links, (paths["at"] == links["src"]) & (paths["start"] == links["dst"]), "left_semi").select("path")
        found = back if found is None else found.unionByName(back)
        on = paths.join(links, paths["at"] == links["src"]).where((F.col("dst") > F.col("start")) & ~F.array_contains("path", F.col("dst")))
        paths = on.select("start", F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("at"))
    return found if found is not None else links.select(F.array("src").alias("path")).limit(0)


def closure(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """origin, member: every node with all that directed edges reach from it, itself included; rounds until nothing is new."""
    checkpoints(edges.sparkSession)
    reached = frontier = nodes.select(F.col("node").alias("origin"), F.col("node").alias("member")).distinct()
    links = edges.select("src", "dst").distinct()
    while True:
        step = frontier.join(links, frontier["member"] == links["src"]).select("origin", F.col("dst").alias("member")).distinct()
        frontier = step.join(reached, ["origin", "member"], "left_anti").checkpoint()
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)
