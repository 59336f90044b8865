"""The thin queries over the driver's smallest tables, their contract columns against plain Python."""

import hashlib
import re
import struct
import zlib

import duckdb
import pytest
from sievework.llm import queries as q
from sievework.llm import secrets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return {i: t or "" for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()}


def rows(spark, f):
    return [r.asDict(recursive=True) for r in f(spark, SF).collect()]


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(q.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(r) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in names) for r in rows(spark, q.queries()[name])), key=repr) == want


def test_op3_folds(spark, texts):
    got = {r["doc_id"]: r for r in rows(spark, q.op3_deleted_interpolation)}
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0) and r["n_tokens"] == len(texts[i].encode().split()) + 1 and r["score"] < 0


def test_op4_rows_law(spark, texts):
    got = rows(spark, q.op4_hypergeometric_shards)
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    held = [sorted(r["slot"] for r in got if r["shard"] == s) for s in range(24)]
    assert all(s == list(range(len(s))) for s in held) and max(map(len, held)) - min(map(len, held)) <= 1 and sum(map(len, held)) == len(got)


def test_op6_base(spark, texts):
    kinds = (("assign", secrets.ASSIGN, lambda m: len(m[2]) >= 12), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 16))
    for r in rows(spark, q.op6_secret_scan):
        found = [(m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, texts[r["doc_id"]]) if ok(m)]
        base = ",".join(f"{name}:{a}:{z}" for a, _, name, z in sorted(found))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and [r[f"n_{n}"] for n, _, _ in kinds] == [sum(x[2] == n for x in found) for n, _, _ in kinds]
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))


@pytest.mark.parametrize(("f", "folds", "held"), [(q.op5_toxicity, 5, 0), (q.op7_quality, 3, 1)])
def test_classifiers(spark, texts, f, folds, held):
    got = {r["doc_id"]: r for r in rows(spark, f)}
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % folds == held) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)


def test_op9_and_op10_tokens(spark, texts):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(q.tokenizer_path())
    ids = {i: [*encoder.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    crc = lambda x: zlib.crc32(struct.pack(f"<{len(x)}I", *x))
    pieces = sorted((i, k, 4096 * k, len(ids[i][4096 * k :][:4096]), crc(ids[i][4096 * k :][:4096])) for i in ids for k in range(-(-len(ids[i]) // 4096)))
    placed = rows(spark, q.op9_best_two_fit)
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in placed) == pieces
    ends = {}
    for r in sorted(placed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096
    want, at = [], 0
    for i in sorted(ids):
        want.append((i, at, len(ids[i]), crc(ids[i])))
        at += len(ids[i])
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows(spark, q.op10_token_records)) == want
