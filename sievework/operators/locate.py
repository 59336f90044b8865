"""Where findings are: locations against the code model, enclosing and following symbols, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ELSEWHERE = "symbol found elsewhere in the repository; reported path corrected"
RESOLVED = ("tier", "r_file", "r_start", "r_end", "symbol_confirmed", "alternatives_existed", "chosen_by", "rejected_reason")


def _candidates(nodes: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """For each key the node of the least id that has a line, and how many there are."""
    least = F.min(F.struct("id", "path", F.col("line_start").alias("start"), F.greatest("line_start", F.coalesce("line_end", "line_start")).alias("end")))
    found = nodes.where("symbol is not null and symbol <> '' and coalesce(line_start, 0) > 0")
    return found.groupBy(*keys).agg(least.alias(f"{prefix}_best"), F.count(F.lit(1)).alias(f"{prefix}_n"))


def resolve_locations(findings: DataFrame, nodes: DataFrame, lines: DataFrame | None = None, analyzed: DataFrame | None = None) -> DataFrame:
    """The findings with RESOLVED: a cascade from the named symbol down to the file, or the reason for a rejection.

    findings: id, repo, file, symbol, line_start, line_end; nodes: id, repo, path, symbol, line_start, line_end; lines:
    repo, path, lines (0: unreadable; a file that is not listed is not checked); analyzed: repo, path, outside of which
    nothing is confirmed. Each tier is one equi join with an aggregate of the nodes, so no finding meets all nodes of a
    file. Every finding stays, rejected ones with their reason.
    """
    start = F.coalesce(F.when(F.col("line_start") > 0, F.col("line_start")), F.lit(1))
    out = findings.withColumn("__start", start).withColumn("__end", F.coalesce(F.when(F.col("line_end") > 0, F.col("line_end")), F.col("__start")))
    renamed = lambda df, *pairs: df.select(*[F.col(a).alias(b) for a, b in pairs], *[c for c in df.columns if c not in {a for a, _ in pairs}])
    here = renamed(_candidates(nodes, ["repo", "path", "symbol"], "here"), ("path", "file"))
    there = _candidates(nodes, ["repo", "symbol"], "there")
    known = nodes.select("repo", F.col("path").alias("file")).distinct().withColumn("__known", F.lit(True))
    out = out.join(here, ["repo", "file", "symbol"], "left").join(there, ["repo", "symbol"], "left").join(known, ["repo", "file"], "left")
    if lines is not None:
        out = out.join(lines.select("repo", F.col("path").alias("file"), F.col("lines").alias("__lines")), ["repo", "file"], "left")
    else:
        out = out.withColumn("__lines", F.lit(None).cast("int"))
    if analyzed is not None:
        seen = analyzed.select("repo", F.col("path").alias("file")).distinct().withColumn("__seen", F.lit(True))
        out = out.join(seen, ["repo", "file"], "left")
    else:
        out = out.withColumn("__seen", F.lit(True))
    quoted = F.concat(F.lit("'"), F.col("file"), F.lit("'"))
    by_symbol, elsewhere = F.col("here_n").isNotNull(), F.col("here_n").isNull() & F.col("there_n").isNotNull()
    reason = (
        F.when(F.coalesce("file", F.lit("")) == "", "the finding names no file")
        .when(F.col("__seen").isNull(), F.concat(quoted, F.lit(" was not among the files analyzed for this segment, so the reported location could not be confirmed")))
        .when(F.col("__known").isNull(), F.concat(quoted, F.lit(" is not present in the code model for repository '"), F.col("repo").cast("string"), F.lit("'")))
        .when(~by_symbol & ~elsewhere & (F.col("__lines") == 0), F.concat(quoted, F.lit(" could not be read at the scanned revision, so the reported location could not be verified")))
    )
    out = out.withColumn("rejected_reason", reason)
    kept, past = F.col("rejected_reason").isNull(), F.col("__start") > F.col("__lines")
    best = lambda field: F.when(by_symbol, F.col(f"here_best.{field}")).otherwise(F.col(f"there_best.{field}"))
    symbolic = by_symbol | elsewhere
    last = F.greatest("__start", "__end")
    n = F.coalesce("here_n", "there_n")
    chosen = (
        F.when(by_symbol & (n > 1), "lowest node id among same-file definitions")
        .when(elsewhere & (n > 1), F.concat(F.lit(ELSEWHERE + "; lowest node id among "), n.cast("string"), F.lit(" definitions")))
        .when(elsewhere, ELSEWHERE)
        .when(~symbolic & past, F.concat(F.lit("reported line "), F.col("__start").cast("string"), F.lit(" exceeds the file's "), F.col("__lines").cast("string"), F.lit(" lines; clamped")))
    )
    file_end = F.when(past, F.col("__lines")).otherwise(F.coalesce(F.least(last, F.col("__lines")), last))
    return out.select(
        *findings.columns,
        F.when(~kept, "rejected").when(symbolic, "symbol").otherwise("file").alias("tier"),
        F.when(kept, F.when(symbolic, best("path")).otherwise(F.col("file"))).alias("r_file"),
        F.when(kept, F.when(symbolic, best("start")).otherwise(F.when(past, F.col("__lines")).otherwise(F.col("__start")))).alias("r_start"),
        F.when(kept, F.when(symbolic, best("end")).otherwise(file_end)).alias("r_end"),
        (kept & symbolic).alias("symbol_confirmed"),
        (kept & symbolic & (n > 1)).alias("alternatives_existed"),
        F.when(kept, chosen).alias("chosen_by"),
        "rejected_reason",
    )


def resolution_tiers(resolved: DataFrame) -> DataFrame:
    """One row: how many findings were located by symbol, by file, and not at all."""
    return resolved.agg(*[F.count_if(F.col("tier") == t).alias(t) for t in ("symbol", "file", "rejected")])


def enclosing(points: DataFrame, symbols: DataFrame, keys: list[str]) -> DataFrame:
    """points with `symbol`: the innermost symbol around `line`, functions before others; null outside of all.

    symbols: keys, name, kind, line_start, line_end. The join is by file, and only there by interval.
    """
    held = symbols.select(*keys, F.col("name").alias("__name"), (F.col("kind") != "function").alias("__other"), F.col("line_start").alias("__a"), F.col("line_end").alias("__z"))
    inside = (F.col("line") >= F.col("__a")) & (F.col("line") <= F.col("__z"))
    rows = points.withColumn("__point", F.struct(*points.columns))
    met = rows.join(held, keys).where(inside)
    best = met.groupBy("__point").agg(F.min(F.struct("__other", (F.col("__z") - F.col("__a")).alias("span"), "__name")).alias("best"))
    found = best.select("__point.*", F.col("best.__name").alias("symbol"))
    same = [points[c].eqNullSafe(found[c]) for c in points.columns]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return points.distinct().join(found, on, "left").select(*[points[c] for c in points.columns], found["symbol"])


def following_symbol(points: DataFrame, symbols: DataFrame, keys: list[str]) -> DataFrame:
    """points with `symbol`: the nearest function that starts at or below `line`, else the innermost around it.

    One sort of points and starts by file and line, no range join; only points that no function follows look around.
    """
    starts = symbols.where("kind = 'function'").select(*keys, F.col("line_start").alias("line"), F.col("name").alias("__name"))
    both = points.withColumn("__name", F.lit(None).cast("string")).withColumn("__mine", F.lit(True)).unionByName(starts.withColumn("__mine", F.lit(False)), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(F.desc("line"), F.col("__mine"), F.desc("__name")).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("symbol", F.last("__name", ignorenulls=True).over(order)).where("__mine").select(*points.columns, "symbol")
    rest = enclosing(met.where("symbol is null").select(*points.columns), symbols, keys)
    return met.where("symbol is not null").unionByName(rest)


def lines_in_symbols(texts: DataFrame, symbols: DataFrame, keys: list[str], pattern: Column | str) -> DataFrame:
    """Lines that match a pattern, with the symbol around them; a null symbol marks the file."""
    rows = texts.select(*keys, F.posexplode(F.split("text", "\n")).alias("p", "code")).withColumn("line", (F.col("p") + 1).cast("int"))
    hits = rows.where(F.col("code").rlike(pattern) if isinstance(pattern, str) else pattern).select(*keys, "line")
    return enclosing(hits, symbols, keys)
