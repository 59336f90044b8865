"""Business flows: journeys from an entry point or a calling file, step by step, across declared integrations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.scalars import node_id, short_hash
from sievework.operators.flows import stored

#: Fixed value: steps of a journey. It bounds what is kept of a node's neighbours too: as many again may be known already.
MOST_STEPS = 12

_STEP = "struct<node:string,operation:string,annotations:array<string>,leg:string,target_repo:string>"
_TARGET = "struct<node:string,operation:string,annotations:array<string>,store:boolean>"
_HOP = f"struct<member:string,type:string,targets:array<{_TARGET}>>"
#: A step on a data store, and one into another member that no integration declares.
UNDECLARED, UNRECONSTRUCTABLE, NO_ACTOR = "integration-undeclared", "budget-unreconstructable", "actor-undetermined"


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def _known(steps: Column, node: Column) -> Column:
    return F.exists(steps, lambda s: s["node"] == node)


def _walk(acc: Column, targets: Column, leg: Column, repo: Column) -> Column:
    """acc (steps, queue) with those targets, in order, that are new, while there is room."""

    def add(acc: Column, t: Column) -> Column:
        new = (F.size(acc["steps"]) < MOST_STEPS) & ~_known(acc["steps"], t["node"])
        step = F.struct(t["node"].alias("node"), t["operation"].alias("operation"), t["annotations"].alias("annotations"), leg.alias("leg"), repo.alias("target_repo"))
        steps = F.when(new, F.array_append(acc["steps"], step)).otherwise(acc["steps"])
        queue = F.when(new & ~t["store"], F.array_append(acc["queue"], t["node"])).otherwise(acc["queue"])
        return F.struct(steps.alias("steps"), queue.alias("queue"))

    return F.aggregate(targets, acc, add)


def host_members(hosts: DataFrame, members: DataFrame) -> DataFrame:
    """id, host, member: the member that a host (id, repo, host) names, in full or as its first part before a dot; the full
    name first, then the least. A host's own beginnings are looked up by equality."""
    labels = F.split(F.lower("host"), "[.]")
    begins = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, F.lit(1), i), "."))
    named = members.select(F.col("repo").alias("member")).distinct()
    met = hosts.withColumn("member", F.explode(begins)).join(named, "member").where("member <> repo")
    best = met.groupBy("id", "repo", "host").agg(F.min(F.struct((F.col("member") != F.lower("host")).alias("a"), "member"))["member"].alias("member"))
    return best


def business_flows(nodes: DataFrame, edges: DataFrame, members: DataFrame, integrations: DataFrame, workspace: str = "workspace") -> DataFrame:
    """flow_id, root, name, actor, determination, steps, gap_reasons, partial: one row for each endpoint and each file that
    calls out.

    nodes: id, repo, path, type, route, annotations, outbound_hosts; edges: src, dst, type, those that a trace may follow;
    members: repo; integrations: from_repo, to_repo, type, endpoints. Breadth first, MOST_STEPS steps: within a repository
    along edges, into another member only over its host and a declared integration; an undeclared one leaves a gap. Data
    stores end a way. Each round takes the next node of every journey and joins it with its neighbours, of which a bounded
    list is kept; a journey is one row throughout, and rounds cut lineage by a checkpoint.
    """
    marks = F.coalesce("annotations", _none("string"))
    kept = nodes.select("id", "repo", "path", "type", "route", marks.alias("annotations"), F.coalesce("outbound_hosts", _none("string")).alias("hosts"))
    inner = F.filter(F.array_sort(F.array_distinct("annotations")), lambda a: a != "trust_boundary")
    calls_out = kept.where("type = 'file' and size(hosts) > 0").select("id", "repo", F.explode("hosts").alias("host"))
    # what a node is as a step
    writers = edges.where(F.col("type").isin("reads", "writes")).select(F.col("src").alias("id")).distinct().withColumn("__touches", F.lit(True))
    calling = kept.where("type = 'file' and size(hosts) > 0").select("repo", "path").distinct().withColumn("__calls", F.lit(True))
    typed = kept.join(writers, "id", "left").join(calling, ["repo", "path"], "left")
    store = F.col("type") == "datastore"
    operation = F.when(F.col("type") == "endpoint", "entry").when(store | F.coalesce("__touches", F.lit(False)), "mutation").when(F.coalesce("__calls", F.lit(False)), "external-call").otherwise("transition")
    own = F.struct(F.col("id").alias("node"), operation.alias("operation"), F.array_sort(F.array_distinct("annotations")).alias("annotations"), store.alias("store"))
    steps = typed.select(F.col("id").alias("dst"), F.col("repo").alias("__repo"), own.alias("t"))
    around = edges.select("src", "dst", "type").join(kept.select(F.col("id").alias("src"), "repo"), "src").join(steps, "dst").where(F.col("repo") == F.col("__repo"))
    first = F.slice(F.array_sort(F.collect_set("t")), 1, 2 * MOST_STEPS)
    near = around.groupBy("src").agg(first.alias("near")).select(F.col("src").alias("at"), "near")
    # where a file's hosts lead
    links = integrations.select(F.col("from_repo").alias("repo"), F.col("to_repo").alias("member"), F.col("type").alias("link"), F.coalesce("endpoints", _none("string")).alias("channels"))
    entry = F.struct(F.col("id").alias("node"), F.lit("entry").alias("operation"), inner.alias("annotations"), F.lit(False).alias("store"))
    points = kept.where("type = 'endpoint'").select(F.col("repo").alias("member"), "route", entry.alias("t"))
    joined = host_members(calls_out, members).join(links, ["repo", "member"], "left").join(points, "member", "left")
    listed = F.exists("channels", lambda c: F.contains(c, F.col("route")))
    hops = joined.groupBy("id", "repo", "member", "link").agg(F.min("host").alias("host"), F.array_sort(F.collect_set(F.when(listed, F.col("t")))).alias("named"), F.slice(F.array_sort(F.collect_set("t")), 1, 2 * MOST_STEPS).alias("every"))
    hop = F.struct("host", "member", F.col("link").alias("type"), F.when(F.size("named") > 0, F.slice("named", 1, 2 * MOST_STEPS)).otherwise(F.col("every")).alias("targets"))
    leads = hops.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(hop)), lambda h: F.struct(h["member"].alias("member"), h["type"].alias("type"), h["targets"].alias("targets"))).alias("hops")).withColumnRenamed("id", "__file")
    place = kept.select(F.col("id").alias("at"), F.col("repo").alias("at_repo"), node_id(F.col("repo"), F.col("path")).alias("__file"))
    around = stored(place.join(near, "at", "left").join(leads, "__file", "left").select("at", "at_repo", F.coalesce("near", _none(_TARGET)).alias("near"), F.coalesce("hops", _none(_HOP)).alias("hops")))
    # journeys
    is_entry = F.col("type") == "endpoint"
    root = F.struct(F.col("id").alias("node"), F.when(is_entry, "entry").otherwise("external-call").alias("operation"), F.when(is_entry, inner).otherwise(F.array_sort(F.array_distinct("annotations"))).alias("annotations"), F.lit(None).cast("string").alias("leg"), F.lit(None).cast("string").alias("target_repo"))
    begun = kept.where(is_entry | ((F.col("type") == "file") & (F.size("hosts") > 0)))
    state = begun.select(F.col("id").alias("root"), F.coalesce("route", "path").alias("name"), F.col("annotations").alias("__marks"), F.array(root).cast(f"array<{_STEP}>").alias("steps"), F.array("id").alias("queue"), _none("string").alias("gaps"), _none("string").alias("hopped"))
    columns = ["root", "name", "__marks", "steps", "queue", "gaps", "hopped"]
    finished = None
    for _ in range(MOST_STEPS + 1):
        state = stored(state)
        open_ = (F.size("queue") > 0) & (F.size("steps") < MOST_STEPS)
        done = state.where(~open_)
        finished = done if finished is None else finished.unionByName(done)
        state = state.where(open_)
        if state.isEmpty():
            break
        rows = state.withColumn("at", F.element_at("queue", 1)).withColumn("queue", F.slice("queue", 2, 1 << 20)).join(around, "at", "left")
        fresh = F.filter(F.coalesce("hops", _none(_HOP)), lambda h: ~F.array_contains("hopped", F.concat_ws(">", "at_repo", h["member"])))
        rows = rows.withColumn("hops", fresh)
        missing = F.exists("hops", lambda h: h["type"].isNull())
        start = F.struct("steps", "queue")
        led = F.aggregate(F.filter("hops", lambda h: h["type"].isNotNull()), start, lambda acc, h: _walk(acc, h["targets"], h["type"], h["member"]))
        rows = rows.withColumn("__a", led)
        rows = rows.withColumn("__a", _walk(F.col("__a"), F.coalesce("near", _none(_TARGET)), F.lit(None).cast("string"), F.lit(None).cast("string")))
        state = rows.select("root", "name", "__marks", F.col("__a.steps").alias("steps"), F.col("__a.queue").alias("queue"), F.when(missing, F.array_append("gaps", F.lit(UNDECLARED))).otherwise(F.col("gaps")).alias("gaps"), F.array_union("hopped", F.transform("hops", lambda h: F.concat_ws(">", "at_repo", h["member"]))).alias("hopped"))
        state = state.select(*columns)
    second = F.get("steps", F.lit(1))["annotations"]
    said = F.array_union("__marks", F.coalesce(second, _none("string")))
    role, known = F.array_contains(said, "authorization_required"), F.array_contains(said, "authentication_required")
    determination = F.when(role, "undetermined").when(known, "declared").otherwise("inferred")
    over = (F.size("queue") > 0) & (F.size("steps") >= MOST_STEPS)
    gaps = F.array_sort(F.array_distinct(F.concat("gaps", F.array_compact(F.array(F.when(over, UNRECONSTRUCTABLE), F.when(role, NO_ACTOR))))))
    out = finished.withColumns({"actor": F.when(role, "role").when(known, "authenticated").otherwise("anonymous"), "determination": determination, "gap_reasons": gaps})
    digest = short_hash(F.col("root"), F.array_join(F.transform("steps", lambda s: s["node"]), "\n"))
    return out.select(F.concat(F.lit(f"flow:{workspace}:"), digest).alias("flow_id"), "root", "name", "actor", "determination", "steps", "gap_reasons", (F.size("gap_reasons") > 0).alias("partial"))


def related_flows(journeys: DataFrame, flows: DataFrame) -> DataFrame:
    """flow_id, related: traced flows (source, sink, path) that share a node with a journey."""
    steps = journeys.select("flow_id", F.explode(F.transform("steps", lambda s: s["node"])).alias("node"))
    touched = flows.select(F.concat_ws("->", "source", "sink").alias("flow"), F.explode("path").alias("node"))
    return steps.join(touched, "node").groupBy("flow_id").agg(F.array_sort(F.collect_set("flow")).alias("related"))


# ---- flows into models

MODEL_PAIRS = (
    ("sensitive-context", ("sensitive_data", "llm_prompt_sink"), ()),
    ("indirect", ("external_content_source", "llm_invocation"), ("boundary_labeled",)),
    ("output-handling", ("llm_invocation", "security_sink"), ("llm_prompt_sink",)),
    ("direct", ("user_controlled_input", "llm_prompt_sink"), ()),
)


def model_exposures(nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """sink, category, source: what reaches a model or leaves it: by a traced flow (source, sink, path) from a source of the
    category's kind, or within one symbol that bears both marks and no exempting one. One row a sink and category; flows
    come first, the least source of them.
    """
    marks = F.coalesce("annotations", _none("string"))
    held = nodes.select("id", "type", marks.alias("marks"))
    has = lambda c, m: F.array_contains(c, m)
    met = flows.select("source", F.element_at("path", 1).alias("a"), F.element_at("path", -1).alias("z"))
    met = met.join(held.select(F.col("id").alias("a"), F.col("marks").alias("from")), "a").join(held.select(F.col("id").alias("z"), F.col("marks").alias("to")), "z")
    found = None
    for category, (first, last), _ in MODEL_PAIRS:
        plain = ~has("to", "llm_prompt_sink") & ~has("to", "llm_invocation") if category == "output-handling" else F.lit(True)
        part = met.where(has("from", first) & has("to", last) & plain).select(F.col("z").alias("sink"), F.lit(category).alias("category"), F.col("a").alias("source"), F.lit(0).alias("order"))
        found = part if found is None else found.unionByName(part)
    for category, both, spared in MODEL_PAIRS:
        test = F.col("type").isin("function", "class")
        for m in both:
            test = test & has("marks", m)
        for m in spared:
            test = test & ~has("marks", m)
        found = found.unionByName(held.where(test).select(F.col("id").alias("sink"), F.lit(category).alias("category"), F.col("id").alias("source"), F.lit(1).alias("order")))
    return found.groupBy("sink", "category").agg(F.min(F.struct("order", "source"))["source"].alias("source"))


def capabilities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, tools: names of declared tools that a node calls directly."""
    tools = nodes.where(F.array_contains(F.coalesce("annotations", _none("string")), "tool_declaration")).select(F.col("id").alias("dst"), F.coalesce("symbol", "path").alias("tool"))
    return edges.join(tools, "dst").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("tool")).alias("tools"))
