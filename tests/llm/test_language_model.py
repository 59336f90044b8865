"""The language model against a plain interpolation, over repeated rows and ids, nulls, empty and long texts."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from sievework.llm import language_model as lm

SCHEMA = "doc_id long, text string, fold string, score double, about binary"
rng = random.Random(7)


def sentence(n):
    return " ".join(rng.choice(["a", "b", "C", "dd", "ee", f"w{rng.randrange(30)}", f"x{rng.randrange(300)}"]) for _ in range(n))


ROWS = [(i, sentence(rng.choice([3, 20, 80])), "f", 0.0, None) for i in range(120)]
ROWS += [(200, None, None, None, None), (201, "", None, None, None), (202, " \n\t ", None, None, None), (203, sentence(4000), None, None, None), (204, "é ü\x01  a", None, None, None)]
ROWS += [ROWS[0], ROWS[0], (3, "another text of three", None, None, None), (None, "a b", None, None, None), (None, "a b", None, None, None), (None, None, None, None, None)]


def split(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def remainder(doc_id, folds):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds


def plain(rows, folds=10):
    """(words, bigrams) of training texts and of deleted ones, and the cells on the grid."""
    counts = [({}, {}), ({}, {})]
    for doc_id, text, *_ in rows:
        if (r := remainder(doc_id, folds)) != 0:
            w = split(text)
            words, pairs = counts[r == 1]
            for before, word in zip([None, *w[:-1]], w, strict=True):
                words[word] = words.get(word, 0) + 1
                pairs[before, word] = pairs.get((before, word), 0) + 1
    return counts


def expected(rows, folds=10):
    (kept, kept_pairs), (less, less_pairs) = plain(rows, folds)
    n_kept = sum(kept.values())
    words = {w: kept.get(w, 0) + less.get(w, 0) for w in {*kept, *less}}
    pairs = {p: kept_pairs.get(p, 0) + less_pairs.get(p, 0) for p in {*kept_pairs, *less_pairs}}
    n, floor = sum(words.values()), 1 / (len(words) + 1)
    cells = {}
    step = lambda x: 0 if x == 0 else 1 + round(lm.FINE * abs(math.log2(x)))
    bucket = lambda c: 0 if c == 0 else 1 + int(math.log2(c))
    for (v, w), m in less_pairs.items():
        seen = kept.get(v, 0)
        cell = (bucket(seen), step(kept_pairs.get((v, w), 0) / max(seen, 1)), step(kept.get(w, 0)))
        cells[cell] = cells.get(cell, 0) + m
    weights = lm.expectation_maximisation(np.array([(*c, m) for c, m in sorted(cells.items())]), n_kept, floor)
    out = []
    for doc_id, text, *_ in rows:
        w = split(text)
        score = 0.0
        for v, x in zip([None, *w[:-1]], w, strict=True):
            a, b, c = weights[bucket(words.get(v, 0))]
            score += math.log10(a * pairs.get((v, x), 0) / max(words.get(v, 0), 1) + b * words.get(x, 0) / max(n, 1) + c * floor)
        base = sum(math.log10((words.get(x, 0) + 0.1) / (n + 0.1 * (len(words) + 1))) for x in w)
        out.append((doc_id, remainder(doc_id, folds) == 0, len(w), sum(x in words for x in w), n, base, score))
    return out


def key(row):
    return repr((*row[:5], round(row[5], 6)))


@pytest.mark.parametrize(("home", "part"), [(12 << 20, 16 << 20), (700, 900)])
def test_same_as_plain_interpolation(spark, monkeypatch, home, part):
    monkeypatch.setattr(lm, "HOME_BYTES", home)
    monkeypatch.setattr(lm, "PART_BYTES", part)
    got = sorted([tuple(r) for r in lm.score_documents(spark.createDataFrame(ROWS, SCHEMA).repartition(3)).collect()], key=key)
    want = sorted(expected(ROWS), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and np.allclose(g[5:], w[5:], rtol=1e-9, atol=1e-9)


def test_probabilities_add_up():
    weights = lm.expectation_maximisation(np.array([(3, 1 + 8, 1 + 40, 90), (3, 0, 1 + 20, 10)]), 1000, 1e-4)
    assert np.allclose(weights.sum(1), 1) and weights[3][0] > 0.5 and weights[0][0] == 0
    assert lm.expectation_maximisation(np.empty((0, 4)), 0, 1.0).shape == (lm.MOST_BUCKETS + 1, 3)


def test_edges(spark):
    assert lm.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = lm.score_documents(spark.createDataFrame([(None, "a b")], "doc_id string, text string")).collect()
    assert [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in alone] == [(None, True, 3, 0, 0)] and math.isfinite(alone[0]["score"])
