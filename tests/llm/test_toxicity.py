"""Toxicity against plain TF-IDF cosines and votes over the whole path; the index against all products."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from sievework.llm import toxicity as tx

SCHEMA = "doc_id long, text string, y int, vector string, score double, toxic int"
rng = random.Random(9)
TREES = "alder birch cedar dogwood elder fir ginkgo hazel ivy juniper kapok larch maple thingummies oaks".split()


def text(i):
    return f"{'vile stuff' if i % 4 == 1 else 'kind words'} {' '.join(rng.choice(TREES) for _ in range(rng.choice([3, 12, 40])))} common"


TEXTS = [text(i) for i in range(160)]
ROWS = [(i, t, 1, "v", 0.5, 1) for i, t in enumerate(TEXTS)]
ROWS += [(500, "vile unseen", 1, "", 0.1, 0), (501, None, *[None] * 4), (502, "", *[None] * 4), (503, "123 !!", *[None] * 4), (504, "vile vile fir Elder " * 3000, *[None] * 4), (None, "vile fir", *[None] * 4), (None, "vile fir", *[None] * 4)]
ROWS += [ROWS[3], ROWS[3], (6, "a second text of six", 1, "v", 0.5, 1)]
LABELS = [(i, i % 4 == 1) for i in range(160)] + [(None, True), (7, None), (9, True)]


def terms(t):
    out = Counter()
    for w in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split():
        out[w] += 1
        if len(w) > tx.PREFIX:
            out[w[: tx.PREFIX] + "*"] += 1
    return out


def plain():
    """Of each distinct text (cosines with all examples, best first; score)."""
    learns = {i: y for i, y in LABELS if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5}
    least = {}
    for i, t, *_ in ROWS:
        if i in learns:
            least[i] = min(least.get(i, t), t)
    bags = {i: terms(t) for i, t in least.items()}
    words = {w for b in bags.values() for w in b}
    known = lambda t: {w: n for w, n in terms(t).items() if w in words}
    df = Counter(w for _, t, *_ in ROWS for w in known(t))
    toxic = sum(learns[i] for i in bags)
    has = {w: (sum(w in b for b in bags.values()), sum(w in b for i, b in bags.items() if learns[i])) for w in words}
    strength = {w: float(tx.strength(np.array([h]), np.array([k]), len(bags), toxic)[0]) for w, (h, k) in has.items()}

    def unit(bag):
        v = {w: (1 + math.log(n)) * math.log(1 + len(ROWS) / df[w]) * strength[w] for w, n in bag.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {w: x / norm for w, x in v.items()}

    vectors = {i: unit(b) for i, b in bags.items()}
    out = {}
    for t in {t for _, t, *_ in ROWS}:
        q = unit(known(t))
        out[t] = sorted(((sum(x * vectors[i].get(w, 0) for w, x in q.items()), learns[i]) for i in bags), reverse=True) if q else []
    return out


def test_whole_path_against_plain_cosines(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, None if y is None else int(y)) for i, y in LABELS], "doc_id long, toxic int")
    got = tx.score_toxicity(docs, labels).collect()
    want = plain()
    assert sorted([r["doc_id"] for r in got], key=repr) == sorted([r[0] for r in ROWS], key=repr)
    by = {}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
        by.setdefault(r["doc_id"], []).append(r)
    for i, t, *_ in ROWS:
        if len(by[i]) == 1:
            cosines = [e["cosine"] for e in by[i][0]["evidence"]]
            best = sorted({round(c, 9) for c, _ in want[t]}, reverse=True)
            assert len(cosines) == min(3, len(best)) and all(any(abs(c - b) < 1e-6 for b in best[:6]) for c in cosines), i
            assert not cosines or abs(cosines[0] - best[0]) < 1e-6
    truth = {i: i % 4 == 1 for i in range(160)}
    assert np.mean([all(r["predicted"] == y for r in by[i]) for i, y in truth.items() if len(by[i]) == 1]) > 0.98
    assert by[500][0]["predicted"] == by[504][0]["predicted"] == 1 and by[501][0]["score"] == by[502][0]["score"] == by[503][0]["score"]
    assert len({round(r["score"], 12) for r in got}) > 60


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame(ROWS[:5], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in tx.score_toxicity(docs, none).collect()} == {0}
    assert {r["predicted"] for r in tx.score_toxicity(docs, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")).collect()} == {0}
    assert tx.score_toxicity(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_is_exact(seed):
    r = np.random.default_rng(seed)
    strong = np.arange(60) % 12 == 0
    rows = []
    for _ in range(900):
        term = np.unique(r.choice(60, r.integers(1, 9), p=np.where(strong, 0.2, 1) / np.where(strong, 0.2, 1).sum()))
        w = (r.random(len(term)) + 0.1) * np.where(strong[term], 20, 1)
        rows.append((term, w / np.linalg.norm(w)))
    index = tx.BlockMaxIndex([[i] for i in range(900)], np.stack([np.ones(900), np.arange(900) % 3 == 0], 1), rows, strong, (1.0, 2.0))
    dense = np.zeros((900, 60))
    order = {ids[0]: at for at, ids in enumerate(index.ids)}
    for i, (t, w) in enumerate(rows):
        dense[order[i], t] = w
    picked = list(range(0, 900, 30))
    for but in (None, [order[i] for i in picked]):
        for i, (near, sims) in zip(picked, index.nearest_of([rows[i] for i in picked], but=but), strict=True):
            every = dense @ dense[order[i]]
            if but:
                every[order[i]] = -1
            ranked = np.lexsort((np.arange(900), -every))
            n = int(np.searchsorted(np.cumsum(index.examples[ranked]), tx.NEIGHBOURS)) + 1
            assert np.allclose(sims, every[ranked[:n]]) and np.allclose(every[near], sims)


def test_strength_and_calibration():
    power = tx.strength(np.array([100, 1, 1000, 50]), np.array([100, 1, 100, 5]), 2000, 200)
    assert power[0] > 1 and np.allclose(power[1:], tx.FLOOR)
    r = np.random.default_rng(0)
    truth = r.random(4000)
    label = (r.random(4000) < truth).astype(int)
    slope, shift = tx.fit_sigmoid(1 / (1 + np.exp(-(2 * tx._odds(truth) + 1))), label, np.ones(4000))
    assert abs(slope - 0.5) < 0.05 and abs(shift + 0.5) < 0.1
    number, count = np.array([0, 3, 70000]), np.array([1, 300, 2])
    assert [x.tolist() for x in tx.unpack(tx.pack(number, count))] == [number.tolist(), count.tolist()]
    assert [len(x) for x in tx.unpack(tx.pack(number[:0], count[:0]))] == [0, 0]
