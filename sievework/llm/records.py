"""Length-delimited binary records of token ids with masked checksums and an offset index for shuffled reads.

A data file is a run of frames:

    payload length, unsigned 64-bit | masked crc32 of these 8 bytes, unsigned 32-bit | payload | masked crc32 of payload

all little-endian. A payload is one document: flags (1: the id is null; 2: ids are 4 bytes wide, else 2), its id (signed
64-bit), the number of token ids (unsigned 32-bit), then the token ids. The index file beside it holds, for each frame
in order, its offset and the number of token ids before it in the file, both unsigned 64-bit, so that a reader can
visit frames in any order without a scan of the data.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import scratch_path, slices, utf8
from sievework.llm.tokenization import encoder

FLAG_NULL, FLAG_WIDE = 1, 2
RECORD = "doc_id long, start long, n_tokens long, ids binary"
HEAD, PAYLOAD, INDEX = struct.Struct("<QI"), struct.Struct("<BqI"), struct.Struct("<QQ")


def masked_crc(data: bytes) -> int:
    """crc32, rotated right by 15 bits plus a constant, so that checksums of data that holds checksums stay apart."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes) -> bytes:
    """ids: little-endian unsigned 32-bit."""
    wide = np.frombuffer(ids, "<u4")
    flags = FLAG_NULL * (doc_id is None) | FLAG_WIDE * bool(len(wide) and wide.max() > 0xFFFF)
    payload = PAYLOAD.pack(flags, doc_id or 0, len(wide)) + (ids if flags & FLAG_WIDE else wide.astype("<u2").tobytes())
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked_crc(length)) + payload + struct.pack("<I", masked_crc(payload))


def unframe(data: bytes, at: int = 0) -> tuple[int | None, bytes, int]:
    """(doc_id, ids as 32-bit, offset of the next frame); ValueError where lengths or checksums don't hold."""
    n, check = HEAD.unpack_from(data, at)
    if masked_crc(data[at : at + 8]) != check:
        raise ValueError(f"length at {at}: wrong checksum")
    payload = data[at + HEAD.size : at + HEAD.size + n]
    if len(payload) < n or masked_crc(payload) != struct.unpack_from("<I", data, at + HEAD.size + n)[0]:
        raise ValueError(f"record at {at}: wrong checksum")
    flags, doc_id, count = PAYLOAD.unpack_from(payload)
    ids = payload[PAYLOAD.size :]
    ids = ids if flags & FLAG_WIDE else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
    if len(ids) != 4 * count:
        raise ValueError(f"record at {at}: {len(ids) // 4} ids, not {count}")
    return (None if flags & FLAG_NULL else doc_id), ids, at + HEAD.size + n + 4


def read_frame(file, offset: int) -> tuple[int | None, bytes]:
    """(doc_id, ids) of the frame at an offset."""
    file.seek(offset)
    head = file.read(HEAD.size)
    doc_id, ids, _ = unframe(head + file.read(HEAD.unpack(head)[0] + 4))
    return doc_id, ids


def index_entry(offset: int, tokens: int) -> bytes:
    return INDEX.pack(offset, tokens)


def read_index(file, first: int, n: int) -> list[tuple[int, int]]:
    """Up to n entries from number `first` on."""
    file.seek(first * INDEX.size)
    return list(INDEX.iter_unpack(file.read(n * INDEX.size)))


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def write_records(docs: DataFrame, tokenizer_path: str, folder: str, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int]]:
    """Encodes whole texts, each with its end id, and writes them in ascending id order; gives the manifest.

    Rows are dealt by ranges of the id and sorted there, so files in manifest order hold all ids ascending (nulls
    first, repeated ids by a hash of the text, then the text). Each task writes a data and an index file under a name of its own, and only the names
    of tasks that succeeded come back, so a task that runs twice leaves an orphan and no duplicate. manifest: (path of
    the data file, documents, token ids) of each file in order, a row a file.

    Ids are integers; ranges are cut by id and a hash of the text, so that not even null or repeated ids gather in one
    task. Null texts are empty, equal rows are written as often as they occur, and texts of any length are one record.
    Other columns are not read. An empty table gives an empty manifest.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text_col)).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(partitions, "doc_id", "tie") if partitions else rows.repartitionByRange("doc_id", "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, task = encoder(tokenizer_path), TaskContext.get().partitionId()
        place, base = _open(folder)
        name = f"{base}/part-{task:06d}-{uuid.uuid4().hex}"
        data = index = None
        at = count = tokens = 0
        try:
            for batch in slices(batches):
                if data is None:
                    place.create_dir(base, recursive=True)
                    data, index = place.open_output_stream(f"{name}.rec"), place.open_output_stream(f"{name}.idx")
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = enc.encode_document(text)
                    record = frame(doc_id, ids)
                    data.write(record)
                    index.write(index_entry(at, tokens))
                    at, count, tokens = at + len(record), count + 1, tokens + len(ids) // 4
        finally:
            for f in (data, index):
                if f is not None:
                    f.close()
        if count:
            yield pa.RecordBatch.from_pydict({"task": [task], "path": [f"{folder}/{name.rpartition('/')[2]}.rec"], "docs": [count], "tokens": [tokens]})

    made = dealt.sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text").mapInArrow(write, "task long, path string, docs long, tokens long")
    return [(r["path"], r["docs"], r["tokens"]) for r in sorted(made.collect(), key=lambda r: r["task"])]


def read_records(spark, manifest: list[tuple[str, int, int]], chunk: int = 2000) -> DataFrame:
    """Reads all records of a manifest back through the index: doc_id, start, n_tokens, ids (32-bit little-endian).

    start counts the ids of all documents before. Files are cut into runs of `chunk` frames that tasks read on their own.
    """
    runs = sum(-(-count // chunk) for _, count, _ in manifest)
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(chunk).cast("long")))
    listed = _listed(spark, manifest).withColumn("first", first).select("path", "first", F.least(F.lit(chunk), F.col("count") - F.col("first")).alias("n"), "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, n, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place, name = _open(path)
                with place.open_input_file(f"{name[:-4]}.idx") as f:
                    entries = read_index(f, first, n + 1)
                with place.open_input_file(name) as f:
                    f.seek(entries[0][0])
                    data = f.read(entries[n][0] - entries[0][0]) if len(entries) > n else f.read()
                out = []
                for offset, tokens in entries[:n]:
                    doc_id, ids, _ = unframe(data, offset - entries[0][0])
                    out.append((doc_id, start + tokens, len(ids) // 4, ids))
                    if len(out) == 250:
                        yield _batch(out)
                        out = []
                if out:
                    yield _batch(out)

    return listed.repartition(max(1, len(manifest), min(runs, 10_000))).mapInArrow(read, RECORD)


def _listed(spark, manifest: list[tuple[str, int, int]]) -> DataFrame:
    """path, count, start (token ids before the file) of each file."""
    rows, before = [], 0
    for path, count, tokens in manifest:
        rows.append((path, count, before))
        before += tokens
    return spark.createDataFrame(rows, "path string, count long, start long")


def read_shuffled(spark, manifest: list[tuple[str, int, int]], seed: int = 0, tasks: int | None = None) -> DataFrame:
    """All records as `read_records` gives them, in a random order that the seed names.

    Frames, not runs of them, are dealt to tasks and ordered there by a keyed hash of file and frame, and the index says
    where each lies: a task seeks from frame to frame, and no data are exchanged.
    """
    frames = _listed(spark, manifest).withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
    order = F.xxhash64(F.lit(seed), "path", "frame")
    dealt = frames.select("path", "frame", "start", order.alias("order")).repartition(tasks or max(1, len(manifest)), "order").sortWithinPartitions("order", "path", "frame")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[str, tuple] = {}
        for batch in batches:
            out = []
            for path, number, start in zip(*(batch.column(c).to_pylist() for c in ("path", "frame", "start")), strict=True):
                if path not in files:
                    if len(files) >= 64:
                        for f in files.pop(next(iter(files))):
                            f.close()
                    place, name = _open(path)
                    files[path] = place.open_input_file(f"{name[:-4]}.idx"), place.open_input_file(name)
                index, data = files[path]
                ((offset, tokens),) = read_index(index, number, 1)
                doc_id, ids = read_frame(data, offset)
                out.append((doc_id, start + tokens, len(ids) // 4, ids))
                if len(out) == 250:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return dealt.mapInArrow(read, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c, d = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def records_folder(spark) -> str:
    return scratch_path(spark, "records")
