"""The n-gram join and components against brute force, over every way that sizes can send them."""

import random
import re

import numpy as np
import pytest

from sievework.llm import ngram_join as nj
from sievework.llm.common import squeeze, unsqueeze
from sievework.llm.components import components

SCHEMA = "doc_id long, text string, component_id string, sign string, k string, rep int"


def classes(nodes, pairs):
    root = {i: i for i in nodes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in nodes}


def linked(a, b, num, den):
    return bool(a) and bool(b) and den * len(a & b) >= num * len(a | b)


def expected(rows, size, num, den):
    sets = []
    for doc_id, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((doc_id, {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()))
    known = [x for x in sets if x[0] is not None]
    found = classes({i for i, _ in known}, [(a, b) for n, (a, x) in enumerate(known) for b, y in known[:n] if a != b and linked(x, y, num, den)])
    return sorted([(i, len(s), found.get(i)) for i, s in sets], key=repr)


def corpus(seed):
    """Clusters of chained edits, passages that many texts share, copies, repeated ids and rows, nulls, empty and long texts."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(4000)}"
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(14):
        text = [word() for _ in range(r.choice([6, 30, 90]))]
        for _ in range(r.choice([1, 2, 9])):
            rows.append(" ".join(text))
            text = list(text)
            for _ in range(r.choice([0, 1, 2])):
                text[r.randrange(len(text))] = word()
    rows += [" ".join([*passage, *[word() for _ in range(r.choice([0, 1, 3, 8, 60]))]]) for _ in range(25)]
    rows += [None, "", " \n", "one", "One", "two words", "x " * 3000, " ".join(word() for _ in range(5000))]
    out = [(i * 3, t) for i, t in enumerate(rows)]
    out += [out[0], out[0], (None, rows[1]), (None, rows[1]), (None, None), (9, rows[40]), (9, ""), (12, rows[50])]
    r.shuffle(out)
    return [(i, t, "c", "s", "k", 1) for i, t in out]


WAYS = [{}, {"HOME_BYTES": 2000, "PART_BYTES": 3000, "ENTRY_BYTES": 500, "COMMON": 4, "UNIT": 200}, {"HOME_BYTES": 9000, "COMMON": 3, "EXACT": 2, "MOST": 300, "UNIT": 100}]


@pytest.mark.parametrize("way", range(len(WAYS)))
@pytest.mark.parametrize(("size", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_same_as_brute_force(spark, monkeypatch, way, size, num, den):
    for name, value in WAYS[way].items():
        monkeypatch.setattr(nj, name, value)
    rows = corpus(way)
    got = nj.ngram_join(spark.createDataFrame(rows, SCHEMA).repartition(3), size, num, den)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted([tuple(r) for r in got.collect()], key=repr) == expected(rows, size, num, den)


def test_empty(spark):
    assert nj.ngram_join(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in nj.ngram_join(spark.createDataFrame([(1, None, "", "", "", 1)], SCHEMA)).collect()] == [(1, 0, 1)]


def random_sets(seed, n=260):
    r = np.random.default_rng(seed)
    bases = [np.unique(r.integers(0, 1 << 62, 60).astype(np.uint64)) for _ in range(3)]
    sets = []
    for _ in range(n):
        base = bases[r.integers(3)]
        keep = r.random(len(base)) > r.choice([0.0, 0.05, 0.12, 0.3])
        sets.append(np.unique(np.concatenate([base[keep], r.integers(0, 1 << 62, r.integers(0, 12)).astype(np.uint64)])))
    return [*sets, np.empty(0, np.uint64), sets[0]]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_exact_links_and_stars(seed):
    sets = random_sets(seed)
    plain = [set(s.tolist()) for s in sets]
    want = {(a, b) for b in range(len(sets)) for a in range(b) if linked(plain[a], plain[b], 85, 100)}
    got, centre, away = nj.exact_links(sets, 85, 100, step=4)
    assert {tuple(sorted(x)) for x in got} <= want
    held = classes(range(len(sets)), got)
    assert held == classes(range(len(sets)), want)
    for i, c in enumerate(centre):
        assert held[i] == held[int(c)] and abs(away[i] - (1 - len(plain[i] & plain[c]) / max(1, len(plain[i] | plain[c])) if i != c else 0)) < 1e-9
    radius = np.array([0.1] * len(sets))
    links, near = nj.near_centres(sets, radius, 85, 100)
    assert {tuple(sorted(x)) for x in links} == want
    distance = lambda a, b: 1 - len(plain[a] & plain[b]) / max(1, len(plain[a] | plain[b]))
    assert {(b, a) for a, b, _ in near} == {(a, b) for b in range(len(sets)) for a in range(b) if (a, b) not in want and distance(a, b) <= 0.35 + 1e-9 and plain[a] | plain[b]}


def test_candidates_lose_nothing():
    sets = random_sets(5)
    plain = [set(s.tolist()) for s in sets]
    df = {}
    for s in plain:
        for g in s:
            df[g] = df.get(g, 0) + 1
    flat = []
    for i, s in enumerate(plain):
        order = sorted(s, key=lambda g: (df[g], g))[: nj.prefix_lengths(len(s), 85, 100)[0]]
        flat += [(g, i, len(s), p) for p, g in enumerate(order) if s]
    key, doc, size, place = (np.array(c) for c in zip(*flat, strict=True))
    edges = nj.candidate_edges(key.astype(np.uint64), doc, size, place, 85, 100)
    held = classes(range(len(sets)), edges.tolist())
    assert all(held[a] == held[b] for b in range(len(sets)) for a in range(b) if linked(plain[a], plain[b], 85, 100))


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000, 1000 + i) for i in range(200)] + [(5000 + i, 5001 + i) for i in range(100)] + [(7, 7), (None, 3)]
    real = [e for e in edges if None not in e and e[0] != e[1]]
    want = classes({x for e in real for x in e}, real)
    got = {}
    for node, root in components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(root, set()).add(node)
    groups = {}
    for node, root in want.items():
        groups.setdefault(root, set()).add(node)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_squeeze():
    r = np.random.default_rng(0)
    for kind in ("u1", "<u2", "<u4", "<u8"):
        x = np.sort(r.integers(0, np.iinfo(kind).max, 500, dtype=kind))
        assert (unsqueeze(squeeze(x, True), kind, True) == x).all() and (unsqueeze(squeeze(x[::-1].copy()), kind) == x[::-1]).all()
    assert not len(unsqueeze(squeeze(np.empty(0, np.uint8)), "<u4"))


def test_code_never_falls():
    code = nj.code_of(np.arange(1, 10**6))
    assert (np.diff(code.astype(int)) >= 0).all() and (code[:128] == np.arange(1, 129)).all()
