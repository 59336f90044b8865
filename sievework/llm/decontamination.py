"""Benchmark decontamination: Wu-Manber search of all benchmark windows in whole documents."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import Scratch, slices, utf8

#: Windows of the benchmark that one search holds, about 200 MB in the driver and in each worker; more is searched block after block.
BLOCK_WINDOWS = 250_000
#: Words in a block of the shift tables.
BLOCK_WORDS = 2

FOUND = ("n_words", "hits", "items")

#: ASCII letters and digits and every byte of a non-ASCII character stay, letters in lower case; others separate.
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_KEEP).split()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order; those that meet or overlap are one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


class WuManber:
    """All windows of `window` consecutive words of each item; a shorter item is one window.

    Symbols are words. Windows of one length m share a shift table: a block of B words that ends at distance d from a
    window's end allows no window to end within the next d words but at that distance, so a block that no window holds
    lets the search jump m - B + 1 words. Where the shift is 0 the block, the suffix, selects a bucket of windows, which
    a hash of the first words narrows and a comparison word by word confirms.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, w in items:
            for i in range(max(1, len(w) - window + 1) if w else 0):
                self.owners[tuple(w[i : i + window])].add(item)
        by_length: dict[int, list[tuple[bytes, ...]]] = defaultdict(list)
        for pattern in self.owners:
            by_length[len(pattern)].append(pattern)
        self.tables = []
        for m, patterns in sorted(by_length.items()):
            b = min(BLOCK_WORDS, m)
            shift: dict[tuple[bytes, ...], int] = {}
            buckets: dict[tuple[bytes, ...], dict[bytes, list[tuple[bytes, ...]]]] = {}
            for p in patterns:
                for end in range(b, m + 1):
                    block = p[end - b : end]
                    if shift.get(block, m) > m - end:
                        shift[block] = m - end
                buckets.setdefault(p[m - b :], {}).setdefault(p[0], []).append(p)
            self.tables.append((m, b, shift, buckets))

    def search(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(merged spans of words inside any occurrence, end exclusive; items with occurring windows)"""
        found, items = [], set()
        for m, b, shift, buckets in self.tables:
            end, n, get, most = m, len(w), shift.get, m - b + 1
            while end <= n:
                jump = get(tuple(w[end - b : end]), most)
                if jump:
                    end += jump
                    continue
                for p in buckets[tuple(w[end - b : end])].get(w[end - m], ()):
                    if tuple(w[end - m : end]) == p:
                        found.append((end - m, end))
                        items |= self.owners[p]
                        break
                end += 1
        return merged(found), items


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 13, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The columns of docs, n_words, hits (spans of words inside occurrences: start, end) and items (ids as sorted strings).

    The benchmark is a query set: it is read in blocks of at most about block_windows windows. Each block is searched in
    all documents, which carry the spans and items of the blocks before and are stored in between; nothing is shuffled,
    and equal rows stay as many. Columns of docs named like a result are replaced. Null or empty texts have no words and
    no hits; items without words never occur; repeated items are one; a null item id is the string "null". Texts of any
    length are searched whole. Empty tables give empty results or rows without hits.
    """
    spark = docs.sparkSession
    item = F.coalesce(F.col(item_col).cast("string"), F.lit("null"))
    queries = benchmark.select(item.alias("item"), utf8(F.col(item_text)).alias("text")).distinct()
    names = [c for c in docs.columns if c not in FOUND]
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.select(*names).dtypes)
    found = f"{fields}, n_words long, hits array<struct<start:long,end:long>>, items array<string>"

    def searched(rows: DataFrame, block: list[tuple[str, list[bytes]]], again: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(WuManber(block, window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, column=text_col):
                counts, hits, items = [], [], []
                before = batch.column("hits").to_pylist() if again else [()] * batch.num_rows
                known = batch.column("items").to_pylist() if again else [()] * batch.num_rows
                for text, old, had in zip(batch.column(text_col), before, known, strict=True):
                    w = words((text.as_py() or "").encode())
                    spans, owners = shared.value.search(w)
                    counts.append(len(w))
                    hits.append([{"start": a, "end": b} for a, b in merged([*spans, *((s["start"], s["end"]) for s in old)])])
                    items.append(sorted({*owners, *had}))
                kept = [batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.string()))], [*names, *FOUND])

        return rows.mapInArrow(run, found)

    rows, scratch, again = docs.select(*names), Scratch(spark), False
    block: list[tuple[str, list[bytes]]] = []
    held = 0
    for row in queries.toLocalIterator():
        w = words(bytes(row["text"]))
        windows = max(1, len(w) - window + 1)
        if w and block and held + windows > block_windows:
            before, rows = rows, scratch.store(searched(rows, block, again), "searched")
            scratch.drop(before)
            block, held, again = [], 0, True
        if w:
            held += windows
            block.append((row["item"], w))
    return searched(rows, block, again)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated, with the columns of docs, whatever their names."""
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    found = contamination(find_benchmark(docs.toDF(*at.values()), benchmark, text_col=at[text_col]))
    return found.where(~F.col("contaminated")).select(*[F.col(c).alias(name) for name, c in at.items()])


def contamination(found: DataFrame) -> DataFrame:
    """The verdict from spans and items: contaminated if a twentieth of the words or more lie inside occurrences."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
