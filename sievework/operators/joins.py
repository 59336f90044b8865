"""Range and full outer joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def affected(components: DataFrame, advisories: DataFrame) -> DataFrame:
    """Components (package, version) in an advisory's range [introduced, fixed) of the same package."""
    inside = (F.col("version") >= F.col("introduced")) & (F.col("version") < F.col("fixed"))
    return components.join(advisories, "package").where(inside)


def changes(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """key, change: added, removed or modified, by a full outer join on the key."""
    a, b = before.select(key, F.col(digest).alias("x")), after.select(key, F.col(digest).alias("y"))
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") != F.col("y"), "modified")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change is not null")
