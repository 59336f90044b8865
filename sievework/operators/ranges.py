"""Ranks and running sums by ranges of rows, so that no key is one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.operators.flows import stored


def cumulative(df: DataFrame, keys: list[str], order: list, value: Column, name: str) -> DataFrame:
    """df with the sum of `value` over the rows of the same keys up to each, in `order`, which must be total.

    Rows are dealt by ranges of keys and order, and stored; each range sums up its own, and the ranges' sums, a row a range
    and key, give each what came before. A key of a third of all rows is as many ranges as its size asks for.
    """
    dealt = stored(df.withColumn("__v", value).repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))
    inside = F.sum("__v").over(Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sums = dealt.groupBy("__part", *keys).agg(F.sum("__v").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("__part", *keys, before.alias("__before"))
    out = dealt.withColumn("__run", inside).join(offsets, ["__part", *keys])
    return out.withColumn(name, F.col("__before") + F.col("__run")).select(*df.columns, name)


def ranked(df: DataFrame, keys: list[str], order: list, name: str = "rank") -> DataFrame:
    """df with each row's number, from 1, among those of its keys in `order`."""
    return cumulative(df, keys, order, F.lit(1).cast("long"), name)
