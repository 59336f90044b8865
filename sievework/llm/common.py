"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers that a join may broadcast: counted before, 32 MB at the most. Beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Narrow rows that a stored file aims at.
FILE_ROWS = 100_000


#: Rows of whole texts that Spark's reader and Arrow hold at once, where the session has Spark's own numbers, which are made
#: for narrow rows: thousands of texts are tens of MB a task, in one piece each.
LONG_ROWS = {"spark.sql.parquet.columnarReaderBatchSize": ("4096", "256"), "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; the session is set to batches for long rows, unless it has numbers of its own."""
    for key, (usual, ours) in LONG_ROWS.items():
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, ours)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset a local master gets a temporary folder (tests); on a cluster that would lose data, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        found = f"file://{tempfile.mkdtemp(prefix='sievework-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/sievework/{name}-{uuid.uuid4().hex}"
    where, system = _folder(spark, path)
    system.deleteOnExit(where)
    return path


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut, and a lost executor loses nothing of it."""
    return Scratch(df.sparkSession).store(df, name)


class Scratch:
    """Tables that an operator stores on its way; `close` removes all that no later step reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def store(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """rows: how many there are at most, where that is known and what makes them is light: few of them are few files."""
        path, schema = scratch_path(self.spark, name), df.schema
        (df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))).write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if found := self.paths.pop(id(t), None):
                where, system = _folder(self.spark, found[0])
                system.delete(where, True)

    def close(self, *keep: DataFrame) -> None:
        kept = {id(t) for t in keep}
        self.drop(*[t for k, (_, t) in list(self.paths.items()) if k not in kept])


def utf8(text: Column) -> Column:
    """Bytes of a text, null as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def crc_of_id(doc_id: Column) -> Column:
    """Unsigned crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def slices(batches: Iterator[pa.RecordBatch], most: int = 2 << 20, column: str = "text", rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """Cuts and joins Arrow batches so that a slice holds about `most` bytes of `column`, however long single rows are and
    however many batches it takes, and `rows` rows at most."""
    held: list[pa.RecordBatch] = []
    size = n = 0
    for batch in batches:
        start = 0
        for i, length in enumerate(pc.binary_length(batch.column(column)).fill_null(0).to_pylist()):
            if n and (size + length > most or n >= rows):
                yield pa.concat_batches([*held, batch.slice(start, i - start)])
                held, size, n, start = [], 0, 0, i
            size, n = size + length, n + 1
        held.append(batch.slice(start))
    if n:
        yield pa.concat_batches(held)


_CODEC = pa.Codec("zstd", 1)


def squeeze(numbers: np.ndarray, sorted_: bool = False) -> bytes:
    """Numbers as byte planes, those of their differences where they ascend, compressed: leading zeros cost next to nothing."""
    if not len(numbers):
        return b""
    if sorted_:
        numbers = np.diff(numbers, prepend=numbers.dtype.type(0))
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T)
    return len(numbers).to_bytes(8, "little") + _CODEC.compress(planes.tobytes(), asbytes=True)


def unsqueeze(data: bytes, kind, sorted_: bool = False) -> np.ndarray:
    """The inverse of `squeeze`; kind: the numbers' type."""
    kind = np.dtype(kind)
    if not data:
        return np.empty(0, kind)
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(_CODEC.decompress(data[8:], n * kind.itemsize, asbytes=True), np.uint8).reshape(kind.itemsize, n)
    out = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(out, dtype=kind) if sorted_ else out


def joined(parts: list, kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """df marked for a broadcast if its counted rows allow it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def lookup_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, most: int = 1024) -> DataFrame:
    """Left join of many rows to one row per binary key, with no task that gets a hot key.

    `right` has the columns key, weight (rows of left that carry the key, as far as it is listed) and others.
    Keys that hold 1/`most` of `total` rows or more can be `most` at the most, so these are broadcast; the rows
    that found theirs go to the shuffle join under a key of their own that matches nothing.
    """
    others = [c for c in right.columns if c != key]
    hot = right.where(F.col(weight) * most >= F.lit(total)).select(F.col(key).alias("__hot"), F.struct(*others).alias("__found"))
    cold = right.where(F.col(weight) * most < F.lit(total)).select(F.col(key).alias("__cold"), F.struct(*others).alias("__other"))
    met = left.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    alone = F.concat(F.col(key), F.lit(b"\x00"), F.unhex(F.hex(F.xxhash64(*left.columns))))
    met = met.withColumn("__seek", F.when(F.col("__hot").isNull(), F.col(key)).otherwise(alone))
    joined = met.join(cold, F.col("__seek") == F.col("__cold"), "left")
    found = F.coalesce(F.col("__found"), F.col("__other"))
    return joined.select(*left.columns, *[found[c].alias(c) for c in others])
