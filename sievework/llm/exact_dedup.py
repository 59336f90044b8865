"""Exact duplicate removal: 128-bit content hash, one keeper a group, bytes compared inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.common import lookup_join, store


def _first_16_of_sha256(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", key=_first_16_of_sha256) -> DataFrame:
    """One verdict per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are first grouped by (128-bit key, text): the key equality is hashed, the text equality is the
    comparison of bytes, and map-side combining leaves one row a task of any number of copies. Only groups of two
    or more, and keys under which different texts met, are stored; `lookup_join` brings them back to the rows.
    Rows under a key with a collision take a second join by key and text.

    Null text counts as empty. Empty texts are equal to one another. Extra columns are ignored. A null id is below
    every other: it is kept only in a group without ids. Rows that repeat id and text all count in group_size, and
    share their verdict. An empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep}")
    pick = F.min if keep == "smallest" else F.max
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("k", key(F.col("text")))
    texts = rows.groupBy("k", "text").agg(F.count(F.lit(1)).alias("n"), pick("doc_id").alias("keep_id"))
    groups = store(
        texts.groupBy("k").agg(F.count(F.lit(1)).alias("variants"), F.sum("n").alias("n"), pick("keep_id").alias("keep_id")).where("n > 1"),
        "dedup-groups",
    )
    sized = rows.select("doc_id", "k", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    out = lookup_join(sized, groups, "k", "n", docs.count())
    verdict = [
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("n", F.lit(1)).alias("group_size"),
        F.coalesce("keep_id", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    ]
    collided = groups.where("variants > 1")
    if collided.isEmpty():
        return out.select(*verdict)
    clash = collided.select("k")
    apart = rows.join(clash, "k", "left_semi")
    exact = apart.groupBy("k", "text").agg(F.count(F.lit(1)).alias("n"), pick("doc_id").alias("keep_id"))
    settled = apart.join(exact, ["k", "text"]).withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
    return out.where(F.coalesce("variants", F.lit(1)) == 1).select(*verdict).unionByName(settled.select(*verdict))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", key=_first_16_of_sha256) -> DataFrame:
    """The rows of docs that `exact_dedup` keeps, by the same grouping: key, then bytes, combined before the shuffle.

    The keeper's columns travel through the aggregation, so texts are shuffled once and joined with nothing. Rows that
    repeat id and text become one, the least or greatest of their other columns, as far as these have an order. A null id
    is kept only in a group without ids, and null counts as an empty text but stays null. Columns may have any name. An
    empty table gives an empty result.
    """
    names = docs.columns
    at = {c: f"c{i}" for i, c in enumerate(names)}
    smallest = keep == "smallest"
    rows = docs.toDF(*at.values())
    own_id, own_text = F.col(at[id_col]), F.col(at[text_col])
    known = own_id.isNull() if smallest else own_id.isNotNull()
    others = [at[c] for c in names if c not in (id_col, text_col)]
    unordered = [c for c in others if _has_no_order(rows.schema[c].dataType)]
    order = F.struct(known.alias("known"), own_id.alias("id"), own_text.isNull().alias("none"), *[c for c in others if c not in unordered])
    text = F.coalesce(own_text, F.lit(""))
    rows = rows.select(text.alias("text"), order.alias("order"), F.struct(*unordered).alias("more") if unordered else F.lit(None).alias("more")).withColumn("k", key(F.col("text")))
    if unordered:
        pick = F.min_by if smallest else F.max_by
        kept = rows.groupBy("k", "text").agg(pick(F.struct("order", "more"), F.col("order")).alias("row")).select("text", "row.order", "row.more")
    else:
        kept = rows.groupBy("k", "text").agg((F.min if smallest else F.max)("order").alias("order"))
    value = {id_col: F.col("order.id"), text_col: F.when(~F.col("order.none"), F.col("text"))}
    return kept.select(*[value.get(c, F.col(f"{'more' if at[c] in unordered else 'order'}.{at[c]}")).alias(c) for c in names])


def _has_no_order(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_no_order(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_no_order(f.dataType) for f in kind)
    return isinstance(kind, (T.MapType, T.VariantType))
