"""LM scoring: bigram and unigram estimates mixed by deleted interpolation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import Scratch, crc_of_id, joined, slices, squeeze, unsqueeze, utf8
from sievework.llm.hashing import END, chained, hash_words

#: Bytes of text in a home, the unit of work; and of text for each part of the n-gram keys.
HOME_BYTES, PART_BYTES = 10 << 20, 16 << 20
HELD_OUT, DELETED, TRAINING = 2, 1, 0
#: The contexts' frequencies are told apart by powers of two up to this one.
MOST_BUCKETS = 40
#: Grid of the held-out estimates, for the expectation-maximisation alone: steps per power of two (an estimate is 4.5 % off
#: at the most), and the number of steps. It bounds what the driver gets, however large the corpus.
FINE = 8
STEPS = FINE * MOST_BUCKETS + 2
LEAST_WEIGHT = 1e-6


def bucket_of(count: np.ndarray) -> np.ndarray:
    """0: never seen, else 1 + the power of two."""
    return np.where(count > 0, 1 + np.floor(np.log2(np.maximum(count, 1))).astype(np.int64), 0).clip(0, MOST_BUCKETS)


def grid(x: np.ndarray) -> np.ndarray:
    """0: nothing, else 1 + the steps from 1 to x, or from x to 1 where x is a share."""
    return np.where(x > 0, 1 + np.round(FINE * np.abs(np.log2(np.maximum(x, 1e-300)))).astype(np.int64).clip(0, STEPS - 2), 0)


def expectation_maximisation(cells: np.ndarray, n_kept: int, floor: float, rounds: int = 60) -> np.ndarray:
    """Weights (bigram, unigram, uniform) for each bucket from rows (bucket, step of the bigram's share, step of the
    word's count among n_kept, number) of deleted tokens.

    A bucket without tokens gets the weights of all buckets together; no weight but the bigram's is below LEAST_WEIGHT.
    """
    weights = np.zeros((MOST_BUCKETS + 1, 3))
    data = np.asarray(cells, np.float64).reshape(-1, 4)
    value = lambda step, sign: np.where(step > 0, 2.0 ** (sign * (step - 1) / FINE), 0.0)

    def fit(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
        p = np.stack([value(rows[:, 1], -1), value(rows[:, 2], 1) / max(n_kept, 1), np.full(len(rows), floor)], 1)
        w = start
        for _ in range(rounds):
            share = p * w
            share /= share.sum(1, keepdims=True)
            w = (share * rows[:, 3:]).sum(0) / rows[:, 3].sum()
            w = np.maximum(w, LEAST_WEIGHT)
            w /= w.sum()
        return w

    start = np.full(3, 1 / 3)
    common = fit(data, start) if len(data) else start
    for b in range(MOST_BUCKETS + 1):
        rows = data[data[:, 0] == b]
        weights[b] = fit(rows, common) if len(rows) else common
    weights[0] = [0, *(weights[0][1:] / weights[0][1:].sum())]
    return weights


def tokens(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, frequent ones first; the place of each token's word; number of tokens of each text); the end is a token.

    Small numbers for frequent words: the places are what travels most.
    """
    found = [np.append(hash_words(t), END) for t in texts]
    words, place, n = np.unique(joined(found, np.uint64), return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    return words[order], rank[place], np.array([len(t) for t in found], np.int64)


def pairs_of(place: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word of each distinct bigram; each token's bigram). The end of a text, its last token, is the context of its first."""
    place = place.astype(np.int64)
    before = np.empty_like(place)
    before[1:] = place[:-1]
    before[np.cumsum(sizes) - sizes] = place[-1:]
    pairs, of = np.unique(before * width + place, return_inverse=True)
    return pairs // width, pairs % width, of


def keys_of(words: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Odd keys of the words, then keys of the bigrams, whose last byte is 0: it would cost a byte for each on the way."""
    return np.concatenate([words | np.uint64(1), chained([words[context], words[word]]) & ~np.uint64(255)])


def _packed(*batches: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    for b in batches:
        with pa.ipc.new_stream(out, b.schema) as writer:
            writer.write_batch(b)
    return out.getvalue().to_pybytes()


OFFERED = "group long, home long, part int, keys binary, train binary, less binary, about binary"
COUNTED = "home long, part int, keys binary, train binary, less binary, about binary, types long"
MET = "about binary, places binary, n_words long, word_counts binary, pair_counts binary, cells binary, cell_counts binary, types long, tokens long, kept long"


def count_ngrams(rows: DataFrame, n_bytes: int) -> DataFrame:
    """One row for each home, a slice of the rows (doc_id, text, fold), with all that its scores need, as MET has it.

    A home says of each part of the n-gram keys which it has and how often; parts add up and send totals back. Texts are
    read once: the sequence of a home's words, as numbers, passes by to where the home's totals meet.
    """
    bits = max(1, (math.ceil(n_bytes / PART_BYTES) - 1).bit_length())
    parts = 1 << bits

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, batch in enumerate(slices(batches, HOME_BYTES)):
            home = TaskContext.get().partitionId() << 32 | at
            words, place, sizes = tokens([t.as_py() for t in batch.column("text")])
            context, word, of = pairs_of(place, sizes, len(words))
            keys = keys_of(words, context, word)
            fold = np.repeat(batch.column("fold").to_numpy(), sizes)
            count = lambda f: np.concatenate([np.bincount(place[fold == f], minlength=len(words)), np.bincount(of[fold == f], minlength=len(word))]).astype("<u8")  # noqa: B023, E731
            train, less = count(TRAINING), count(DELETED)
            order = np.argsort(keys, kind="stable")
            keys, train, less = keys[order], train[order], less[order]
            cuts = np.searchsorted(keys >> np.uint64(64 - bits), np.arange(parts + 1, dtype=np.uint64))
            out = [(p, home, p, squeeze(keys[a:z], True), squeeze(train[a:z]), squeeze(less[a:z]), None) for p, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < z]
            about = _packed(pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fold"), pa.array(sizes)], ["doc_id", "fold", "size"]))
            # a group of its own: this row only passes by
            out.append((parts + (home * 0x9E3779B97F4A7C15 >> 3) % (1 << 60), home, -1, squeeze(words), squeeze(place), b"", about))
            columns = zip(*out, strict=True)
            kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["group", "home", "part", "keys", "train", "less", "about"])

    def add(key, table):
        part = table.column("part")
        if part[0].as_py() < 0:
            passing = table.select(["home", "part", "keys", "train", "less", "about"])
            return passing.append_column("types", pa.array([0] * len(passing), pa.int64()))
        own = [unsqueeze(x.as_py(), np.uint64, True) for x in table.column("keys")]
        train, less = (np.concatenate([unsqueeze(x.as_py(), "<u8") for x in table.column(c)]) for c in ("train", "less"))
        keys = np.concatenate(own)
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        group = np.empty(len(keys), np.int64)
        group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
        train, less = np.add.reduceat(train[order], first), np.add.reduceat(less[order], first)
        # each word that training texts have counts as a type where it stands first
        types = np.zeros(len(keys), np.int64)
        types[order[first[((train + less) > 0) & ((ordered[first] & np.uint64(1)) == 1)]]] = 1
        ends = np.cumsum([len(k) for k in own])
        cut = [(z - len(k), z) for k, z in zip(own, ends, strict=True)]
        nothing = [b""] * len(own)
        return pa.table({"home": table.column("home"), "part": part, "keys": pa.array(nothing, pa.binary()), "train": pa.array([squeeze(train[group[a:z]]) for a, z in cut], pa.binary()), "less": pa.array([squeeze(less[group[a:z]]) for a, z in cut], pa.binary()), "about": pa.array(nothing, pa.binary()), "types": pa.array([int(types[a:z].sum()) for a, z in cut], pa.int64())})

    def meet(key, table):
        part = table.column("part").to_numpy()
        own = int(np.flatnonzero(part < 0)[0])
        text = lambda c: table.column(c)[own].as_py()
        told = pa.ipc.open_stream(text("about")).read_all()
        fold, sizes = (told.column(c).to_numpy() for c in ("fold", "size"))
        words, place = unsqueeze(text("keys"), np.uint64), unsqueeze(text("train"), np.uint32)
        context, word, of = pairs_of(place, sizes, len(words))
        order = np.argsort(keys_of(words, context, word), kind="stable")
        at = [i for i in np.argsort(part, kind="stable").tolist() if part[i] >= 0]
        total = []
        for c in ("train", "less"):
            found = np.empty(len(order), np.int64)
            found[order] = joined([unsqueeze(table.column(c)[i].as_py(), "<u8") for i in at], np.uint64)
            total.append(found)
        kept, less = total
        # deleted tokens of this home, by bigram, meet the counts of the training texts
        deleted = np.bincount(of[np.repeat(fold == DELETED, sizes)], minlength=len(word))
        some = np.flatnonzero(deleted)
        seen, pair = kept[context[some]], kept[len(words) :][some]
        cell = (bucket_of(seen) * STEPS + grid(pair / np.maximum(seen, 1))) * STEPS + grid(kept[word[some]])
        cells, where = np.unique(cell, return_inverse=True)
        cell_counts = np.bincount(where, weights=deleted[some], minlength=len(cells)).astype(np.int64)
        both = (kept + less).astype("<u8")
        learns = int(sizes[fold != HELD_OUT].sum())
        row = [text("about"), text("train"), len(words), squeeze(both[: len(words)]), squeeze(both[len(words) :]), cells.astype("<i8").tobytes(), cell_counts.astype("<i8").tobytes(), sum(table.column("types").to_pylist()), learns, int(sizes[fold == TRAINING].sum())]
        kinds = [pa.binary(), pa.binary(), pa.int64(), *[pa.binary()] * 4, *[pa.int64()] * 3]
        names = [c.split()[0] for c in MET.split(", ")]
        return pa.table({c: pa.array([x], k) for c, x, k in zip(names, row, kinds, strict=True)})

    counted = rows.mapInArrow(offer, OFFERED).groupBy("group").applyInArrow(add, COUNTED)
    return counted.groupBy("home").applyInArrow(meet, MET)


def learned(met: DataFrame, types: int, n_kept: int) -> np.ndarray:
    """The mixture weights from what the homes' deleted tokens met."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cells, n in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_py(), "<i8")) for x in (cells, n)], ["cell", "n"])

    cells = met.select("cells", "cell_counts").mapInArrow(unpack, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell, n = (cells.column(c).to_numpy() for c in ("cell", "n"))
    return expectation_maximisation(np.stack([cell // STEPS**2, cell // STEPS % STEPS, cell % STEPS, n], 1), n_kept, 1 / (types + 1))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held_out: int = 0, deleted: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: log10 probabilities of whole texts.

    Learns from the documents whose crc32(id) mod `folds` is not `held_out`; those with the remainder `deleted` are the
    ones on which the mixture weights are learned, and count again in the final estimates.

    1. Slices of the table, homes, meet the totals of their n-grams (`count_ngrams`). A frequent n-gram is one entry a
       home, so no part of the keys is hot, and neither a repeated id nor a null one gathers rows in a task.
    2. Deleted tokens, on a grid of (context bucket, bigram share, word count) that bounds its size, go to the driver for
       the expectation-maximisation.
    3. Homes score their documents from their stored totals: p(w | v) = a c(vw) / c(v) + b c(w) / N + c / (V + 1), with
       weights a, b, c by the bucket of c(v); estimates and scores are not rounded.

    Nothing grows with the corpus on the driver or in a task. Words are held as 63-bit hashes: two in 10^9 share one with a
    chance of 5 in 100. Bigrams are held as 56-bit hashes: 7 pairs in 10^9 share a count, which moves `score` alone. Null texts are empty: one token, the end. A null id counts as the empty text in the crc32, so
    it is held out. Ids may be of any type and may repeat; equal rows score alike, each with its row. A text is never cut:
    the longest one bounds a home from below. Other columns are not read. Without training documents every probability is
    that of the uniform part; an empty table gives an empty result.
    """
    rest = crc_of_id(F.col(id_col)) % folds
    fold = F.when(rest == held_out, HELD_OUT).when(rest == deleted, DELETED).otherwise(TRAINING)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), utf8(F.col(text_col)).alias("text"), fold.alias("fold"))
    size = rows.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 1
    scratch = Scratch(docs.sparkSession)
    met = scratch.store(count_ngrams(rows, size), "ngram-totals")
    types, n_tokens, n_kept = (x or 0 for x in met.agg(F.sum("types"), F.sum("tokens"), F.sum("kept")).first())
    weights, floor = learned(met, types, n_kept), 1 / (types + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for about, places, width, words, pairs in zip(*batch.columns, strict=True):
                told = pa.ipc.open_stream(about.as_py()).read_all()
                sizes = told.column("size").to_numpy()
                place, word, pair = unsqueeze(places.as_py(), np.uint32), unsqueeze(words.as_py(), "<u8"), unsqueeze(pairs.as_py(), "<u8")
                context, last, of = pairs_of(place, sizes, width.as_py())
                seen = word[context]
                w = weights[bucket_of(seen)]
                p = w[:, 0] * pair / np.maximum(seen, 1) + w[:, 1] * word[last] / max(n_tokens, 1) + w[:, 2] * floor
                base = np.log10((word + 0.1) / (n_tokens + 0.1 * (types + 1)))
                doc, n = np.repeat(np.arange(len(sizes)), sizes), len(sizes)
                add = lambda x: np.bincount(doc, weights=x, minlength=n)  # noqa: B023, E731
                held = pa.array(told.column("fold").to_numpy() == HELD_OUT)
                out = [told.column("doc_id").combine_chunks(), held, pa.array(sizes), pa.array(add(word[place] > 0).astype(np.int64)), pa.array(np.full(n, n_tokens, np.int64)), pa.array(add(base[place])), pa.array(add(np.log10(p)[of]))]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    scoring = met.select("about", "places", "n_words", "word_counts", "pair_counts")
    return scoring.mapInArrow(score, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
