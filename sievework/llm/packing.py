"""Best-two-fit packing of tokenized documents into sequences of bounded length."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.common import store, utf8
from sievework.llm.tokenization import encoder

PIECES = "doc_id {id}, piece int, start long, length int, ids binary, task int, nth long"


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each text with its end id and cuts only what is longer than `capacity`.

    One row per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), and its number `nth` among
    the pieces of that length in its task. Null text counts as empty (one piece: the end id); ids may be null or repeat.
    """
    id_type = dict(docs.dtypes)[id_col]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, seen = encoder(tokenizer_path), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            step = 256
            for at in range(0, batch.num_rows, step):
                rows, piece, start, length, data, nth = [], [], [], [], [], []
                for i in range(at, min(batch.num_rows, at + step)):
                    whole = enc.encode_document(texts[i].as_py())
                    n = len(whole) // 4
                    for k, first in enumerate(range(0, n, capacity)):
                        size = min(capacity, n - first)
                        rows.append(i), piece.append(k), start.append(first), length.append(size), data.append(whole[4 * first : 4 * (first + size)]), nth.append(seen[size])
                        seen[size] += 1
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(data, pa.binary()), pa.array([task] * len(rows), pa.int32()), pa.array(nth, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids", "task", "nth"],
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), utf8(F.col(text_col)).alias("text"))
    return rows.mapInArrow(cut, PIECES.format(id=id_type))


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packs pieces known by their lengths only: [(number of equal bins, [(length, copies a bin)])].

    A bin is filled greedily, longest piece that fits first. Then its smallest piece goes back if two unpacked ones fit
    the gap that it leaves more tightly, as often as that helps. Bins that come out alike are made at once, so the
    work depends on the number of distinct lengths and not on the number of pieces.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    bins: list[tuple[int, list[tuple[int, int]]]] = []
    while left.any():
        present = np.flatnonzero(left)
        gap, used = capacity, {}
        while gap:
            i = int(np.searchsorted(present, gap, "right")) - 1
            while i >= 0 and left[present[i]] - used.get(int(present[i]), 0) <= 0:
                i -= 1
            if i < 0:
                break
            length = int(present[i])
            copies = int(min(gap // length, left[length] - used.get(length, 0)))
            used[length] = used.get(length, 0) + copies
            gap -= copies * length
        while gap and len(used) + max(used.values()) > 2:
            smallest = min(used)
            room = gap + smallest
            free = left[present].copy()
            for length, n in used.items():
                free[np.searchsorted(present, length)] -= n
            have = present[(free > 0) & (present < room)]
            single = set(present[(free == 1)].tolist())
            if not len(have):
                break
            other = np.searchsorted(have, room - have, "right") - 1
            sums = np.where(other >= 0, have + have[np.maximum(other, 0)], 0)
            for j in np.flatnonzero(other >= 0):  # a length of which one is left can't pair with itself
                if have[j] == have[other[j]] and int(have[j]) in single:
                    sums[j] = have[j] + have[other[j] - 1] if other[j] else 0
                    other[j] -= 1
            j = int(np.argmax(sums))
            if sums[j] <= smallest:
                break
            a, b = int(have[j]), int(have[other[j]])
            used[smallest] -= 1
            if not used[smallest]:
                del used[smallest]
            for x in (a, b):
                used[x] = used.get(x, 0) + 1
            gap = room - a - b
        times = min(int(left[length]) // n for length, n in used.items())
        for length, n in used.items():
            left[length] -= times * n
        bins.append((times, sorted(used.items(), reverse=True)))
    return bins


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to stored pieces (`tokenized_pieces`); the plan is global, whatever the partitions.

    Only counts by length, at most `capacity` numbers, reach the driver, and only the plan goes back: for each length
    the ranges of pieces that each kind of bin takes, whose number depends on `capacity` alone. A piece's number among
    all of its length is its number in its task plus the counts of the tasks before, a sum over tasks and not rows.
    """
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = by_task.select("length", "task", before.alias("first"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranges: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)  # length: (first piece, first bin, copies a bin, offset)
    taken: dict[int, int] = defaultdict(int)
    sequence = 0
    for times, content in best_two_fit(counts, capacity):
        offset = 0
        for length, copies in content:
            ranges[length].append((taken[length], sequence, copies, offset))
            taken[length] += times * copies
            offset += copies * length
        sequence += times
    arrays = {length: np.array(r, np.int64) for length, r in ranges.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            number = batch.column("nth").to_numpy() + batch.column("first").to_numpy()
            seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            order = np.argsort(lengths, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
                length = int(lengths[part[0]])
                table = arrays[length]
                row = table[np.searchsorted(table[:, 0], number[part], "right") - 1]
                inside = number[part] - row[:, 0]
                seq[part] = row[:, 1] + inside // row[:, 2]
                off[part] = row[:, 3] + inside % row[:, 2] * length
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seq), pa.array(off)], [*keep, "sequence_id", "offset"])

    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    numbered = pieces.join(firsts, ["length", "task"])
    fields = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in keep)
    return numbered.select(*keep, "first").mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, **columns) -> tuple[DataFrame, DataFrame]:
    """(pieces with their ids, placement): the pieces are stored, and the placement of each carries no ids.

    placement: doc_id, piece, start, length, ids_crc32, task, nth (with the length, these two name a piece, whatever ids
    repeat or are null), sequence_id, offset. See `sequences` for the packed ids. Equal rows are placed as often as they
    occur; pieces of one length are interchangeable, and ties in the plan go to the longer piece. Texts of any length are
    cut into pieces; other columns are not read. An empty table gives empty results.
    """
    pieces = store(tokenized_pieces(docs, tokenizer_path, capacity, **columns), "pieces")
    slim = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "task", "nth")
    return pieces, pack(slim, capacity)


def sequences(pieces: DataFrame, placement: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids (concatenated, little-endian), and the ends of the documents in them."""
    both = placement.join(pieces.select("task", "length", "nth", "ids"), ["task", "length", "nth"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return both.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"),
        F.transform("parts", lambda p: p["offset"] + p["length"]).alias("ends"),
    )


def crc_of_ids(ids: bytes) -> int:
    return zlib.crc32(ids)
