"""What fits: parts of segments, chunks of requests, candidates, excerpts and views of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from sievework.operators import ranges
from sievework.operators.flows import stored

# The usable share of a budget, entry points that a part lists, and the sizes of an excerpt.
USABLE, MOST_ENTRIES = 0.7, 40
CONTEXT_LINES, MOST_LINES, MOST_LENGTH = 3, 40, 200
HEADER_LINES = 12
# Requests of a model that one task looks at.
BLOCK = 16_384


def greedy_groups(sizes: Column, limit: Column, most: Column | None = None) -> Column:
    """For an array of sizes, in order, the number from 0 of the group of each: a group is closed when the next size would
    exceed the limit, or when it has `most` members; a size beyond the limit is a group of its own."""
    start = F.struct(F.lit(0).alias("group"), F.lit(0).cast("long").alias("held"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, size: Column) -> Column:
        full = acc["held"] + size > limit
        closed = (acc["n"] > 0) & (full if most is None else full | (acc["n"] >= most))
        group = acc["group"] + closed.cast("int")
        held = F.when(closed, size).otherwise(acc["held"] + size).cast("long")
        return F.struct(group.alias("group"), held.alias("held"), F.when(closed, 1).otherwise(acc["n"] + 1).alias("n"), F.array_append(acc["out"], group).alias("out"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def split_segments(files: DataFrame, budget: int) -> DataFrame:
    """segment, part (from 1; 0: not split), path, tokens: segments beyond USABLE of the budget, in parts of whole files.

    files: segment, path, tokens, is_test. Production files come before tests, then by path. Only segments that are too
    large and have several files become an array in one task; a segment is a folder's files, bounded by the source tree.
    """
    usable = max(1, int(budget * USABLE))
    sized = files.groupBy("segment").agg(F.sum("tokens").alias("total"), F.count(F.lit(1)).alias("n"))
    rows = files.join(sized, "segment")
    small = rows.where((F.col("total") <= usable) | (F.col("n") <= 1)).select("segment", F.lit(0).alias("part"), "path", "tokens")
    large = rows.where((F.col("total") > usable) & (F.col("n") > 1))
    ordered = large.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("is_test", "path", "tokens"))).alias("f"))
    grouped = ordered.withColumn("g", greedy_groups(F.transform("f", lambda x: x["tokens"]), F.lit(usable)))
    parts = grouped.select("segment", F.inline(F.arrays_zip("f", "g"))).select("segment", (F.col("g") + 1).alias("part"), "f.path", "f.tokens")
    return small.unionByName(parts)


def listed_entries(entries: Column, segment: Column) -> Column:
    """The first MOST_ENTRIES entry points, and how many more there are."""
    more = F.concat(F.lit("+"), (F.size(entries) - MOST_ENTRIES).cast("string"), F.lit(" more (full enumeration in segments/"), segment, F.lit(".json)"))
    return F.when(F.size(entries) > MOST_ENTRIES, F.array_append(F.slice(entries, 1, MOST_ENTRIES), more)).otherwise(entries)


def batch_chunks(requests: DataFrame, most_items: int, most_bytes: int) -> DataFrame:
    """requests (model, seq, size, ...) with `chunk`, from 0 within a model: greedy, in order, no request is dropped.

    Where a chunk ends follows from where it starts. So requests go in blocks of BLOCK, and each block, with the next few
    rows, says for each of the most_items places where its first chunk may start how many start in it, and where the first
    of the next block does. These tables, one a block, are followed in order by a task a model; then each block numbers its
    rows. No task holds a model, and no step is a square of its requests. A null size leaves its chunk without a limit of
    bytes, as a sum with it has no value.
    """
    block = max(BLOCK, most_items)
    ranked = ranges.ranked(requests.withColumn("__model", F.to_json(F.struct("model"))), ["__model"], [F.asc_nulls_last("seq")], "__rank")
    at = F.col("__rank") - 1
    rows = stored(ranked.withColumns({"__block": F.floor(at / block), "__at": (at % block).cast("int")}).drop("__rank"))
    sizes = rows.select("__model", "__block", "__at", F.col("size").cast("long").alias("__size"))
    ahead = sizes.where((F.col("__block") > 0) & (F.col("__at") < most_items - 1)).withColumns({"__block": F.col("__block") - 1, "__at": F.col("__at") + block})

    def arrow(**columns):
        import pyarrow as pa

        return pa.table(columns)

    def nexts(t) -> list[int]:
        """For a block's rows, by __at, where the chunk that starts at each is followed by the next."""
        import numpy as np

        size = t.sort_by("__at")["__size"].combine_chunks()
        n, place = len(size), np.arange(len(size))
        total = np.concatenate([[0], np.cumsum(size.fill_null(0).to_numpy(zero_copy_only=False))])
        null = np.where(np.asarray(size.is_null()), place, n + most_items)
        null = np.minimum.accumulate(null[::-1])[::-1]  # the first null from each row on
        full = np.maximum(np.searchsorted(total, total[:-1] + most_bytes, side="right") - 1, place + 1)
        return np.minimum(np.where((full >= null) | (full >= n), place + most_items, full), place + most_items).tolist()

    # The functions stay in here: a worker gets them whole, without this package.
    def ways(t):
        after, last = nexts(t), min(block, t.num_rows)
        count, end = [0] * last + [0] * (most_items + 1), [0] * last + list(range(most_items + 1))
        for i in range(last - 1, -1, -1):
            to = min(after[i], last + most_items)
            count[i], end[i] = count[to] + 1, end[to]
        return arrow(__model=t["__model"][:1], __block=t["__block"][:1], starts=[count[:most_items]], ends=[end[:most_items]])

    def followed(t):
        t, entry, before, entries, befores = t.sort_by("__block"), 0, 0, [], []
        for starts, ends in zip(t["starts"], t["ends"]):
            entries.append(entry)
            befores.append(before)
            before, entry = before + starts[entry].as_py(), ends[entry].as_py()
        return arrow(__model=t["__model"], __block=t["__block"], __entry=entries, __before=befores)

    def numbered(t):
        import numpy as np

        t = t.sort_by("__at")
        i, chunk, after = t["__entry"][0].as_py(), np.zeros(t.num_rows, "int64"), nexts(t)
        while i < t.num_rows:
            chunk[i] = 1
            i = after[i]
        return t.select(names).append_column("chunk", arrow(c=np.cumsum(chunk) + (t["__before"][0].as_py() - 1))["c"].cast("int32"))

    names = requests.columns
    tables = sizes.unionByName(ahead).groupBy("__model", "__block").applyInArrow(ways, "__model string, __block long, starts array<long>, ends array<long>")
    entered = tables.groupBy("__model").applyInArrow(followed, "__model string, __block long, __entry long, __before long")
    sized = rows.withColumn("__size", F.col("size").cast("long")).join(entered, ["__model", "__block"])
    return sized.groupBy("__model", "__block").applyInArrow(numbered, StructType([*requests.schema.fields, StructField("chunk", IntegerType())]))


def fitting(rows: DataFrame, keys: list[str], size: str, order: list, budget: Column | int) -> DataFrame:
    """Rows that stay when the last in `order` go, one by one, until the sum of each key's sizes fits the budget.

    A running sum in that order decides: a row stays if all up to it fit.
    """
    run = F.sum(size).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    return rows.withColumn("__run", run).where(F.col("__run") <= limit).drop("__run")


def excerpt_window(start: Column, end: Column, total: Column, context: int = CONTEXT_LINES, most: int = MOST_LINES) -> dict[str, Column]:
    """cited_start, cited_end, window_start, window_end, truncated: the cited lines with context around them.

    Beyond `most` lines the context shrinks first, evenly as far as there is any; cited lines all stay.
    """
    a, z = F.least(start, total), F.least(F.greatest(start, end), total)
    before, after = a - F.greatest(F.lit(1), a - context), F.least(total, z + context) - z
    room = most - (z - a + 1)
    over = before + after + z - a + 1 > most
    lead = F.least(before, F.floor(room / 2).cast("int"))
    tail = F.least(after, room - lead)
    lead = F.least(before, room - tail)
    shrunk = lambda full, cut: F.when(~over, full).when(room >= 0, cut).otherwise(0)
    return {"cited_start": a, "cited_end": z, "window_start": a - shrunk(before, lead), "window_end": z + shrunk(after, tail), "truncated": over}


def excerpts(findings: DataFrame, files: DataFrame, members: DataFrame, redacted=None) -> DataFrame:
    """findings with the window around what they cite: status, reason, window, lines (number, text, cited, truncated).

    findings: id, repo, file, line_start, line_end; files: repo, path, text; members: repo. `redacted` is a column function
    (`redaction.redacted`) that windows go through before they are shown; one with a blocked value is unavailable.
    """
    known = members.select("repo").distinct().withColumn("__member", F.lit(True))
    texts = files.select("repo", F.col("path").alias("file"), F.split("text", "\n").alias("__lines"), (F.length("text") == 0).alias("__empty"))
    rows = findings.join(known, "repo", "left").join(texts, ["repo", "file"], "left")
    start = F.coalesce(F.when(F.col("line_start") > 0, F.col("line_start")), F.lit(1))
    window = excerpt_window(start, F.coalesce("line_end", start), F.size("__lines"))
    rows = rows.withColumns({f"__{k}": v for k, v in window.items()})
    shown = F.slice("__lines", F.col("__window_start"), F.col("__window_end") - F.col("__window_start") + 1)
    rows = rows.withColumn("__text", F.when(F.col("__lines").isNotNull() & ~F.col("__empty"), F.array_join(shown, "\n")))
    if redacted is not None:
        rows = rows.withColumn("__r", redacted(F.col("__text"))).withColumns({"__blocked": F.col("__r.blocked") > 0, "__text": F.when(F.col("__text").isNotNull(), F.col("__r.text"))})
    else:
        rows = rows.withColumn("__blocked", F.lit(False))
    out = F.split("__text", "\n")
    number = F.col("__window_start")
    line = lambda x, i: F.struct((number + i).cast("int").alias("number"), F.substring(x, 1, MOST_LENGTH).alias("text"), (number + i).between(F.col("__cited_start"), F.col("__cited_end")).alias("cited"), (F.length(x) > MOST_LENGTH).alias("truncated"))
    reason = (
        F.when(F.col("__member").isNull(), F.concat(F.lit("repository '"), F.col("repo").cast("string"), F.lit("' is not a workspace member on disk")))
        .when(F.col("__lines").isNull(), "source file not found at report time")
        .when(F.col("__empty"), "source file is empty")
        .when(F.col("__blocked"), "the excerpt holds a value that could not be confirmed as a non-credential")
        .when(F.size(out) != F.size(shown), "excerpt lines could not be aligned after redaction")
    )
    rows = rows.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return rows.select(
        *findings.columns, F.when(ok, "ok").otherwise("unavailable").alias("status"), "reason",
        F.when(ok, F.col("__window_start")).alias("window_start"), F.when(ok, F.col("__window_end")).alias("window_end"),
        F.when(ok, F.col("__truncated") | F.exists(out, lambda x: F.length(x) > MOST_LENGTH)).alias("truncated"), F.when(ok, F.transform(out, line)).alias("lines"),
    )


def sliced_view(files: DataFrame, ranges: DataFrame, header: int = HEADER_LINES) -> DataFrame:
    """repo, path, line_no, line, skipped: the first lines of each file and the ranges (repo, path, a, z) of interest, with
    the number of lines left out before each."""
    rows = files.select("repo", "path", F.posexplode(F.split("text", "\n")).alias("p", "line")).withColumn("line_no", (F.col("p") + 1).cast("int")).drop("p")
    wanted = rows.where(F.col("line_no") <= header).select("repo", "path", "line_no")
    spans = ranges.select("repo", "path", F.explode(F.sequence("a", "z")).alias("line_no")).select("repo", "path", F.col("line_no").cast("int"))
    kept = rows.join(wanted.unionByName(spans).distinct(), ["repo", "path", "line_no"], "left_semi")
    before = F.lag("line_no", 1, 0).over(Window.partitionBy("repo", "path").orderBy("line_no"))
    return kept.select("repo", "path", "line_no", "line", (F.col("line_no") - before - 1).alias("skipped"))
