"""Training-data operators against brute force, on rows with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import packing, records, sharding, toxicity
from sievework.llm.decontamination import contamination, drop_contaminated, find_benchmark
from sievework.llm.exact_dedup import drop_duplicates, exact_dedup
from sievework.llm.queries import tokenizer_path
from sievework.llm.quality import fit_trees, keep_quality, score_quality
from sievework.llm.tokenization import ChunkEncoder

SCHEMA = "doc_id long, text string, lang string, k string, n long, shard int, none boolean, hits long, items string, n_words int, __quality double, tags map<string,int>"
rng = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(60)]


def sentence(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


BASE = [sentence(60) for _ in range(12)]
TEXTS = [None, "", " \n\t", "one", "one", "Two words", *BASE, *[b.replace(b.split()[30], "changed", 1) for b in BASE[:6]], BASE[0], BASE[0], sentence(6000), "x " * 5000, "é ü\x01  z"]
MORE = (False, 1, "items", 2, 0.5, {"a": 1})
NULLS = (None,) * 10
#: Every id once, then repeated rows, null ids, and one id with two texts.
ROWS = [(i, t, "en", "k", i, 1, *MORE) for i, t in enumerate(TEXTS)]
ROWS += [ROWS[7], ROWS[7], ROWS[1], (8, "another text", "en", "k", 1, 1, *MORE), (None, BASE[1], *NULLS), (None, BASE[1], *NULLS), (None, None, *NULLS), (None, "only here", *NULLS)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(docs, empty, keep):
    groups = {}
    for doc_id, text, *_ in ROWS:
        groups.setdefault(text or "", []).append(doc_id)
    pick = max if keep == "largest" else min
    keeper = {t: pick((i for i in g if i is not None), default=None) for t, g in groups.items()}
    want = sorted(((i, keeper[t or ""], len(groups[t or ""]), i == keeper[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in ROWS), key=repr)
    for key in (None, lambda text: F.substring(F.unhex(F.md5(F.lit("same").cast("binary"))), 1, 16)):  # every key collides
        got = exact_dedup(docs, keep=keep, **({"key": key} if key else {}))
        assert rows_of(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    kept = drop_duplicates(docs, keep=keep)
    assert kept.columns == docs.columns and rows_of(kept.withColumn("text", F.coalesce("text", F.lit(""))), "doc_id", "text") == sorted(((k, t) for t, k in keeper.items()), key=repr)
    assert {repr(r) for r in kept.collect()} <= {repr(r) for r in docs.collect()}
    plain = drop_duplicates(docs.drop("tags"), keep=keep)
    assert rows_of(plain, "doc_id", "text") == rows_of(kept, "doc_id", "text")
    assert exact_dedup(empty).count() == drop_duplicates(empty).count() == 0


def test_decontamination(spark, docs, empty):
    items = [("1", " ".join(BASE[2].split()[5:30])), ("2", "Two-words"), ("3", ""), ("4", None), ("5", "absent thing"), ("2", "Two-words")]
    bench = spark.createDataFrame(items, "item_id string, text string")

    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = {}
    for item, t in items:
        w = split(t)
        for j in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[j : j + 13]), set()).add(item)
    want = []
    for i, t, *_ in ROWS:
        w, hit, found = split(t), set(), set()
        for p, owners in windows.items():
            for j in range(len(w) - len(p) + 1):
                if tuple(w[j : j + len(p)]) == p:
                    hit |= set(range(j, j + len(p)))
                    found |= owners
        want.append((i, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    for size in (1 << 20, 3):
        got = contamination(find_benchmark(docs, bench, block_windows=size))
        assert rows_of(got, "doc_id", "n_words", "n_hit", "items", "contaminated") == sorted(want, key=repr)
    clean = drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and rows_of(clean, "doc_id") == sorted(((x[0],) for x in want if not x[4]), key=repr)
    assert {repr(r) for r in clean.collect()} <= {repr(r) for r in docs.collect()}
    assert find_benchmark(empty, bench).count() == 0 and find_benchmark(docs, bench.limit(0)).where("size(items) > 0").count() == 0


def test_sharding(docs, empty):
    rows = sharding.shuffle_into_shards(docs, 5, bucket_rows=2).collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None and r["text"]) == sorted(r[:2] for r in ROWS if r[0] is not None and r[1]) and len(rows) == len(ROWS)
    by = [sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(5)]
    assert all(s == list(range(len(s))) for s in by) and max(map(len, by)) - min(map(len, by)) <= 1
    assert sharding.shuffle_into_shards(empty, 5).count() == 0
    matrix = sharding.communication_matrix([100, 0, 37, 1], 6, 1)
    assert [sum(r) for r in matrix] == [100, 0, 37, 1] and {sum(c) for c in zip(*matrix, strict=True)} <= {23}
    draws = [sharding.hypergeometric(random.Random(i), 30, 70, 20) for i in range(4000)]
    assert abs(np.mean(draws) - 6) < 0.15 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.4


def test_encoder_is_the_library():
    from tokenizers import Tokenizer

    fresh, enc, r = Tokenizer.from_file(tokenizer_path()), ChunkEncoder(tokenizer_path()), random.Random(1)
    assert enc.short
    odd = ["<|endoftext|>", "<|EndOfText|>", " <|startoftext|> ", "It's", "DON'T", "é́", "ﬁ", "½", "İ ẞ", "中文", "\u2028", "\x85", "\xa0", "\t", "\n\n", "ÿß", "K", "a_b-c.d/e", "12,345", "'ll", "😀", "~", "ÀÉ", "x" * 50]
    for text in [t or "" for t in TEXTS] + ["".join(r.choice([*odd, " ", "word ", "Über "]) for _ in range(r.choice([1, 4, 30]))) for _ in range(600)]:
        ids = fresh.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids) + 1}I", enc.encode_document(text.encode()))) == [*ids, 1], text


def test_records(spark, docs, empty):
    enc = ChunkEncoder(tokenizer_path())
    for parts in (3, 40):
        manifest = records.write_records(docs, tokenizer_path(), records.records_folder(spark), partitions=parts)
        got = sorted(records.read_records(spark, manifest, chunk=2).collect(), key=lambda r: r["start"])
        at, seen = 0, []
        for r in got:
            assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
            at += r["n_tokens"]
            seen.append((r["doc_id"], bytes(r["ids"])))
        assert [i is not None for i, _ in seen] == sorted(i is not None for i, _ in seen) and [i for i, _ in seen if i is not None] == sorted(r[0] for r in ROWS if r[0] is not None)
        assert sorted(seen, key=repr) == sorted(((i, enc.encode_document((t or "").encode())) for i, t, *_ in ROWS), key=repr)
    one, other = (records.read_shuffled(spark, manifest, seed, tasks=2) for seed in (1, 2))
    assert rows_of(one, "doc_id", "start", "n_tokens", "ids") == rows_of(other, "doc_id", "start", "n_tokens", "ids") == sorted((tuple(r) for r in got), key=repr)
    assert len({tuple(r["start"] for r in x.collect()) for x in (one, other)}) == 2
    nothing = records.write_records(empty, tokenizer_path(), records.records_folder(spark))
    assert records.read_records(spark, nothing).count() == records.read_shuffled(spark, nothing).count() == 0
    data = bytearray(records.frame(7, struct.pack("<3I", 1, 70000, 3)))
    assert records.unframe(bytes(data))[:2] == (7, struct.pack("<3I", 1, 70000, 3))
    data[20] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        records.unframe(bytes(data))


def naive_best_two_fit(lengths, capacity):
    """One piece at a time: fill greedily, then put two pieces that fit more tightly in place of the smallest, while that helps."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        held = []
        for x in list(left):
            if x <= capacity - sum(held):
                held.append(x)
                left.remove(x)
        while len(held) > 1 and sum(held) < capacity:
            smallest = min(held)
            room = capacity - sum(held) + smallest
            pairs = [(left[i] + left[j], i, j) for i in range(len(left)) for j in range(i + 1, len(left)) if smallest < left[i] + left[j] <= room]
            if not pairs:
                break
            _, i, j = max(pairs, key=lambda p: p[0])
            held.remove(smallest)
            held += [left[i], left[j]]
            for x in (left[j], left[i]):
                left.remove(x)
            left = sorted([*left, smallest], reverse=True)
        bins.append(held)
    return bins


def test_best_two_fit_against_naive():
    r = random.Random(4)
    for _ in range(150):
        capacity = r.choice([10, 37, 100])
        lengths = [r.randint(1, capacity) if r.random() < 0.6 else r.randint(1, max(1, capacity // 4)) for _ in range(r.choice([1, 5, 40, 120]))]
        counts = {}
        for x in lengths:
            counts[x] = counts.get(x, 0) + 1
        made = packing.best_two_fit(counts, capacity)
        placed = sorted(x for times, content in made for x, copies in content for _ in range(times * copies))
        assert placed == sorted(lengths) and all(sum(x * n for x, n in content) <= capacity for _, content in made)
        naive, least = len(naive_best_two_fit(lengths, capacity)), -(-sum(lengths) // capacity)
        assert least <= sum(times for times, _ in made) <= naive + max(1, naive // 20)


def test_packing(docs, empty):
    pieces, placed = packing.pack_documents(docs, tokenizer_path(), 512)
    enc = ChunkEncoder(tokenizer_path())
    want = []
    for doc_id, text, *_ in ROWS:
        ids = enc.encode_document((text or "").encode())
        want += [(doc_id, k, 512 * k, len(ids[2048 * k : 2048 * (k + 1)]) // 4, zlib.crc32(ids[2048 * k : 2048 * (k + 1)])) for k in range(-(-len(ids) // 2048))]
    rows = placed.collect()
    assert rows_of(placed, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=repr)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["ids_crc32"]))
    for parts in by.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(by) <= -(-sum(r["length"] for r in rows) // 512) + 1
    joined = packing.sequences(pieces, placed).collect()
    assert len(joined) == len(by)
    for r in joined:
        ends = [0, *r["ends"]]
        cut = [zlib.crc32(bytes(r["ids"])[4 * a : 4 * z]) for a, z in zip(ends[:-1], ends[1:], strict=True)]
        assert len(r["ids"]) == 4 * ends[-1] and cut == [crc for _, _, crc in sorted(by[r["sequence_id"]])]
    assert packing.pack_documents(empty, tokenizer_path())[1].count() == 0
    # 6 + 3 leaves 1; 2 + 2 in place of 3 fills a bin of 10
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10) == [(1, [(6, 1), (2, 2)]), (1, [(3, 1)])]


def test_classifiers(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(400)] + [(None, 1, 1), (3, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
    bad = lambda i: "!!! ### " * 20 + "awful " + sentence(10)
    many = spark.createDataFrame([(i, bad(i) if i % 2 else sentence(30)) for i in range(400)] + [(900, None), (901, ""), (None, "x"), (902, "a " * 20000)], "doc_id long, text string")
    truth = {i: i % 2 for i in range(400)}
    good = {r["doc_id"]: r for r in score_quality(many, labels).collect()}
    assert len(good) == 404 and np.mean([good[i]["predicted"] == 1 - t for i, t in truth.items()]) > 0.97
    assert {r["doc_id"] for r in keep_quality(many, labels).collect()} == {i for i, r in good.items() if r["predicted"]}
    found = {r["doc_id"]: r for r in toxicity.score_toxicity(many, labels).collect()}
    assert len(found) == 404 and np.mean([found[i]["predicted"] == t for i, t in truth.items()]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in [*good.values(), *found.values()])
    none = labels.limit(0)
    assert score_quality(docs, none).count() == toxicity.score_toxicity(docs, none).count() == len(ROWS)
    assert score_quality(empty, labels).count() == toxicity.score_toxicity(empty, labels).count() == 0
    assert fit_trees(np.zeros((0, 28)), np.zeros(0)).predict(np.zeros((2, 28))).tolist() == [0.5, 0.5]
