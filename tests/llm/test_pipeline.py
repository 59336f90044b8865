"""The whole pipeline on a small fixture with planted cases, stage by stage against plain Python."""

import random
import re

import corpus_pipeline
import pytest
from sievework.llm.quality import score_quality
from sievework.llm.queries import tokenizer_path
from sievework.llm.tokenization import ChunkEncoder

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, hits int, contaminated string, n_words long"
rng = random.Random(11)
WORDS = ["".join(rng.choice("aeioulnrstmdc") for _ in range(rng.randint(2, 9))) for _ in range(900)]


def prose(n):
    out = []
    for i in range(n):
        w = rng.choice(WORDS)
        out.append((w.capitalize() if i % 12 == 0 else w) + ("." if i % 12 == 11 else ""))
    return " ".join(out)


def junk():
    return " ".join(rng.choice(["!!!", "$$$", "CLICK", "http://x", "###", "1234", "BUY!!"]) for _ in range(60))


BENCHMARK = [(i, prose(30)) for i in range(4)] + [(9, None), (10, "")]


def fixture():
    """(rows, ids of planted junk, of clean documents that must stay)"""
    rows, bad, clean = {}, set(), set()
    for i in range(0, 300, 2):
        rows[i] = prose(rng.choice([40, 90, 200]))
        rows[i + 1] = junk()
        bad.add(i + 1)
    clean = {i for i in rows if i % 2 == 0}
    base = prose(120)
    rows |= {1000: base, 1001: base, 1002: base}  # copies
    for k in range(3):  # near copies, chained
        words = rows[1002 + k].split()
        words[10 + 30 * k] = f"other{k}"
        rows[1003 + k] = " ".join(words)
    rows[1100] = prose(60) + " " + BENCHMARK[0][1] + " " + prose(60)  # contaminated
    rows[1101] = prose(900) + " " + " ".join(BENCHMARK[1][1].split()[:13]) + " " + prose(900)  # below a twentieth
    rows[1102] = prose(9000)  # several sequences
    return rows, bad, clean | {1101, 1102}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, _, _ = FIXTURE
    where = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", "s", len(t), 1, "x", 2) for i, t in rows.items()], DOCUMENTS).repartition(3).write.parquet(f"{where}/documents.parquet")
    labels = [(i, int(i % 2 == 0), 0) for i in range(300)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where)


FIXTURE = fixture()


def shingles(text, size=5):
    w = text.lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def expected(rows, kept_by_quality):
    """ids after each stage"""
    one = {i for i in rows if i in kept_by_quality}
    two = {max(i for i in one if rows[i] == t) for t in {rows[i] for i in one}}
    sets = {i: shingles(rows[i]) for i in two}
    root = {i: i for i in two}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(two)
    for n, a in enumerate(order):
        for b in order[:n]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    three = {i for i in two if find(i) == i}
    split = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    windows = {tuple(w[i : i + 13]) for _, t in BENCHMARK for w in [split(t)] for i in range(max(1, len(w) - 12)) if w}
    four = set()
    for i in three:
        w, hit = split(rows[i]), set()
        for k in range(len(w) - 12):
            if tuple(w[k : k + 13]) in windows:
                hit |= set(range(k, k + 13))
        if not (hit and 20 * len(hit) >= len(w)):
            four.add(i)
    return one, two, three, four


def test_each_stage_and_the_whole(spark, folder):
    rows, bad, clean = FIXTURE
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = {r["doc_id"] for r in score_quality(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1").collect()}
    want = expected(rows, good)
    assert not bad & want[0] and clean <= want[0] and clean <= want[3]
    assert want[0] - want[1] == {1000, 1001} and want[1] - want[2] == {1003, 1004, 1005} and want[2] - want[3] == {1100}
    left = docs
    for (name, stage), ids in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        left = stage(spark, left, folder)
        assert left.columns == docs.columns, name
        assert {r["doc_id"] for r in left.collect()} == ids, name
    kept = {repr(r) for r in left.collect()}
    assert kept <= {repr(r) for r in docs.collect()}
    enc = ChunkEncoder(tokenizer_path())
    placed = corpus_pipeline.run(spark, folder).collect()
    tokens = {i: len(enc.encode_document(rows[i].encode())) // 4 for i in want[3]}
    assert {r["doc_id"] for r in placed} == want[3]
    assert {i: sum(r["length"] for r in placed if r["doc_id"] == i) for i in tokens} == tokens
    ends = {}
    for r in sorted(placed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096 and len(ends) <= -(-sum(tokens.values()) // 4096) + 1


def test_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
