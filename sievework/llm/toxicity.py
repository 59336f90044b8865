"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, over all terms of the examples."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.common import Scratch, crc_of_id, slices, utf8

#: Labelled examples in the index at most, of label 1 and of label 0, taken by a hash of the id. Documented bounds.
MOST_TOXIC, MOST_OTHERS = 1_200, 2_400
#: A longer word also counts as its beginning of so many characters.
PREFIX = 5
NEIGHBOURS, BLOCK = 9, 64
#: Weight of the rate of label 1 in general, beside the votes.
PRIOR_VOTES = 0.5
#: A term's weight is its TF-IDF times FLOOR, plus what the labels tell apart beyond SURE standard errors of the log odds.
FLOOR, SURE = 0.03, 3.0
#: Terms in more than a DENSE-th of the entries are columns of a matrix, MOST_DENSE at most; the others are inverted lists.
DENSE, MOST_DENSE = 16, 512
#: Texts scored at once; room for rounding of 32-bit sums; blocks that are scored one by one, as a share of all; the norm
#: of a text's other terms from which its blocks are not told apart.
TOGETHER, SLACK, FEW, LOOSE = 64, 1e-5, 4, 0.3
#: Words whose terms a worker remembers.
MOST_WORDS = 60_000

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(raw: bytes) -> list[str]:
    """The word in lower case and, marked by *, the beginning of a longer one."""
    word = raw.decode("utf-8", "ignore").lower()
    return [word, word[:PREFIX] + "*"] if len(word) > PREFIX else [word]


def counted(text: bytes | None) -> Counter:
    """Runs of letters, A to Z in lower case, with their numbers."""
    return Counter((text or b"").translate(_LETTERS).split())


class _Known(dict):
    """Numbers of the known terms of each word; a bounded number of words is remembered."""

    def __init__(self, number: dict[str, int]):
        self.number = number

    def __missing__(self, raw: bytes) -> tuple[int, ...]:
        found = tuple(self.number[t] for t in terms_of(raw) if t in self.number)
        if len(self) < MOST_WORDS:
            self[raw] = found
        return found


class Vocabulary:
    """Numbers of the known terms; vectors of texts."""

    def __init__(self, words: list[str]):
        self.number = {t: i for i, t in enumerate(words)}
        self.known = _Known(self.number)

    def __getstate__(self):
        return list(self.number)

    def __setstate__(self, words):
        self.__init__(words)

    def vector(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """(ascending numbers of known terms, their counts)"""
        words = counted(text)
        found = list(map(self.known.__getitem__, words))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        at = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
        n = np.repeat(np.fromiter(words.values(), np.int64, len(words)), sizes)
        number, where = np.unique(at, return_inverse=True)
        return number, np.bincount(where, n, len(number)).astype(np.int64)


def pack(number: np.ndarray, count: np.ndarray) -> bytes:
    """Ascending term numbers and their counts, as byte planes of the numbers' differences and of the counts."""
    out = []
    for x in (np.diff(number, prepend=0), count):
        planes = x.astype("<u4").view(np.uint8).reshape(-1, 4).T
        out.append(planes[: (int(x.max(initial=0)).bit_length() + 7) // 8 or 1])
    return bytes([len(out[0]), len(out[1])]) + out[0].tobytes() + out[1].tobytes()


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    if len(packed) == 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first, n = packed[0], (len(packed) - 2) // (packed[0] + packed[1])
    planes, out = np.frombuffer(packed, np.uint8, offset=2).reshape(-1, n), []
    for some in (planes[:first], planes[first:]):
        wide = np.zeros((n, 4), np.uint8)
        wide[:, : len(some)] = some.T
        out.append(wide.view("<u4").ravel().astype(np.int64))
    return np.cumsum(out[0]), out[1]


def strength(has: np.ndarray, toxic: np.ndarray, n: int, n_toxic: int) -> np.ndarray:
    """FLOOR and, for each term, how far its log odds between the labels lie beyond SURE standard errors.

    has, toxic: examples, and examples of label 1, that have the term; n, n_toxic: all of them.
    """
    a, b = toxic + 0.5, has - toxic + 0.5
    c, d = n_toxic - toxic + 0.5, n - n_toxic - (has - toxic) + 0.5
    odds, error = np.log(a / c) - np.log(b / d), np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return FLOOR + np.maximum(0, np.abs(odds) - SURE * error)


class BlockMaxIndex:
    """Unit vectors of entries as inverted lists, with block maxima that bound the cosines of BLOCK entries at once.

    Examples with equal vectors are one entry: its ids, and how many examples of label 0 and of label 1 it stands for.
    Strong terms, those above FLOOR, have the largest weight in each block; all others together have the largest norm.
    By Cauchy's inequality both bound a block's cosines, so a text with strong terms needs few blocks, and others all.
    """

    def __init__(self, ids: list[list], counts: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], strong: np.ndarray, weight_of: tuple[float, float]):
        loose = np.array([np.sqrt((w[~strong[t]] ** 2).sum()) for t, w in rows])
        order = np.lexsort((np.arange(len(rows)), -loose))
        self.ids = [ids[i] for i in order]
        self.counts = counts[order].astype(np.float64).reshape(-1, 2)
        self.examples = self.counts.sum(1)
        self.of_label = self.counts * np.array(weight_of)
        rows = [rows[i] for i in order]
        self.width, self.strong = len(strong), strong
        self.term = np.concatenate([t for t, _ in rows]).astype(np.int32) if rows else np.empty(0, np.int32)
        self.weight = np.concatenate([w for _, w in rows]) if rows else np.empty(0)
        self.start = np.concatenate([[0], np.cumsum([len(t) for t, _ in rows])]).astype(np.int64)
        n = len(rows)
        of = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.start))
        self.blocks = -(-n // BLOCK)
        self.most_loose = np.maximum.reduceat(loose[order], np.arange(0, n, BLOCK)) if n else np.empty(0)
        self.place = np.cumsum(strong) - 1  # of a strong term
        self.most = np.zeros((int(strong.sum()), self.blocks))
        hard = strong[self.term]
        np.maximum.at(self.most, (self.place[self.term[hard]], of[hard] // BLOCK), self.weight[hard])
        has = np.bincount(self.term, minlength=self.width)
        often = np.argsort(-has, kind="stable")[:MOST_DENSE]
        often = often[has[often] * DENSE > n]
        self.column = np.full(self.width, -1, np.int32)
        self.column[often] = np.arange(len(often))
        at = self.column[self.term]
        self.matrix = np.zeros((n, len(often)), np.float32)
        self.matrix[of[at >= 0], at[at >= 0]] = self.weight[at >= 0]
        rest = np.flatnonzero(at < 0)
        rest = rest[np.argsort(self.term[rest], kind="stable")]
        self.row, self.part = of[rest], self.weight[rest].astype(np.float32)
        self.list = np.concatenate([[0], np.cumsum(np.where(self.column < 0, has, 0))])
        self.query = np.zeros(self.width)

    @staticmethod
    def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())

    def _cosines(self, rows: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        size = self.start[rows + 1] - self.start[rows]
        at = self._ranges(self.start[rows], size)
        self.query[term] = weight
        out = np.add.reduceat(self.query[self.term[at]] * self.weight[at], np.cumsum(size) - size)
        self.query[term] = 0
        return out

    def _kth(self, rows: np.ndarray, score: np.ndarray, k: int) -> float:
        """A cosine that entries with k examples in all reach."""
        order = np.argsort(-score)
        held = np.cumsum(self.examples[rows[order]])
        i = int(np.searchsorted(held, k))
        return float(score[order[i]]) if i < len(order) else -np.inf

    def _nearest(self, rows: np.ndarray, sims: np.ndarray, k: int, but: int) -> tuple[np.ndarray, np.ndarray]:
        if but >= 0:
            rows, sims = rows[rows != but], sims[rows != but]
        order = np.lexsort((rows, -sims))
        order = order[: int(np.searchsorted(np.cumsum(self.examples[rows[order]]), k)) + 1]
        return rows[order], sims[order]

    def nearest_of(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, but: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector (entries, cosines) of the nearest entries, as many as hold k examples, the first entry first on ties.

        Exact: every term of every entry that can be among them counts. but: an entry for each vector that is none for it.
        """
        but = but or [-1] * len(vectors)
        out: list = [None] * len(vectors)
        every = []
        for i, (term, weight) in enumerate(vectors):
            if not len(term) or not self.ids:
                out[i] = (np.empty(0, np.int64), np.empty(0))
                continue
            hard = self.strong[term]
            loose = np.sqrt((weight[~hard] ** 2).sum())
            if loose > LOOSE and self.blocks > FEW:
                every.append(i)  # no bound is below what other terms alone can reach
                continue
            bound = weight[hard] @ self.most[self.place[term[hard]]] + loose * self.most_loose + SLACK
            order = np.argsort(-bound, kind="stable")
            n, need = len(self.ids), k + (0 if but[i] < 0 else int(self.examples[but[i]]))
            first = np.arange(order[0] * BLOCK, min(n, (order[0] + 1) * BLOCK))
            least = self._kth(first, self._cosines(first, term, weight), need)
            some = order[bound[order] >= least]
            if len(some) * FEW <= self.blocks or self.blocks <= FEW:
                some = np.sort(some)
                rows = self._ranges(some * BLOCK, np.minimum(n, (some + 1) * BLOCK) - some * BLOCK)
                out[i] = self._nearest(rows, self._cosines(rows, term, weight), k, but[i])
            else:
                every.append(i)
        often = np.zeros((len(every), self.matrix.shape[1] if self.ids else 0), np.float32)
        for j, i in enumerate(every):
            at = self.column[vectors[i][0]]
            often[j, at[at >= 0]] = vectors[i][1][at >= 0]
        for i, sums in zip(every, often @ self.matrix.T if every else (), strict=True):
            term, weight = vectors[i]
            rare = self.column[term] < 0
            size = self.list[term[rare] + 1] - self.list[term[rare]]
            at = self._ranges(self.list[term[rare]], size)
            score = sums + np.bincount(self.row[at], np.repeat(weight[rare].astype(np.float32), size) * self.part[at], len(sums))
            need = k + (0 if but[i] < 0 else int(self.examples[but[i]]))
            last = np.partition(score, -need)[-need] if len(score) > need else -np.inf
            rows = np.flatnonzero(score >= last - SLACK)
            out[i] = self._nearest(rows, self._cosines(rows, term, weight), k, but[i])
        return out

    def vote(self, rows: np.ndarray, sims: np.ndarray, k: int = NEIGHBOURS) -> float:
        """Share of label 1 among the k nearest examples, weighted by nearness and by what an example of its label stands for."""
        prior = (self.of_label[:, 1].sum() + 0.5) / (self.of_label.sum() + 1)
        before = np.cumsum(self.examples[rows]) - self.examples[rows]
        near = np.minimum(self.examples[rows], k - before) / self.examples[rows] / (1.05 - np.minimum(sims, 1.0))
        zero, one = near @ self.of_label[rows] if len(rows) else (0.0, 0.0)
        return float((one + PRIOR_VOTES * prior) / (zero + one + PRIOR_VOTES))


def fit_sigmoid(votes: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(slope, shift) of the log odds of a vote that give calibrated ones: Platt's fit, with his softened targets."""
    if not len(votes) or label.min() == label.max():
        return 1.0, 0.0
    ones, zeros = weight[label == 1].sum(), weight[label == 0].sum()
    target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack([_odds(votes), np.ones(len(votes))], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ beta)))
        slope = x.T @ (weight * (target - p)) - 1e-3 * (beta - [1.0, 0.0])
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), slope)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else (1.0, 0.0)


def _odds(votes: np.ndarray) -> np.ndarray:
    v = np.clip(votes, 1e-6, 1 - 1e-6)
    return np.log(v / (1 - v))


def unit(term: np.ndarray, count: np.ndarray, weight_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    weight = (1 + np.log(count)) * weight_of[term]
    return term, weight / max(1e-12, float(np.sqrt(weight @ weight)))


class Model:
    """What workers get: examples as packed vectors, and the weights of terms. Each worker makes its index once; it is not sent."""

    def __init__(self, entries: list[tuple[list, int, int]], vectors: list[bytes], idf: np.ndarray, totals: tuple[int, int]):
        """entries: (ids, examples of label 0, of label 1); totals: labelled documents of label 0 and 1 that could have been chosen."""
        self.ids = [ids[:3] for ids, _, _ in entries]
        self.counts = np.array([x[1:] for x in entries], np.int64).reshape(-1, 2)
        self.sizes, self.packed = [len(v) for v in vectors], zlib.compress(b"".join(vectors), 1)
        n, width = self.counts.sum(0), len(idf)
        self.label_weights = tuple(float(t / m) if m else 0.0 for t, m in zip(totals, n, strict=True))
        has, toxic = np.zeros(width), np.zeros(width)
        for v, (zero, one) in zip(vectors, self.counts, strict=True):
            at = unpack(v)[0]
            has[at] += zero + one
            toxic[at] += one
        power = strength(has, toxic, int(n.sum()), int(n[1])) if n.min(initial=1) else np.full(width, FLOOR)
        self.strong, self.weights = power > FLOOR, idf * power
        self.sigmoid, self.made = (1.0, 0.0), None

    def __getstate__(self):
        return self.__dict__ | {"made": None}

    def at(self, vector: bytes) -> tuple[np.ndarray, np.ndarray]:
        return unit(*unpack(vector), self.weights)

    def vectors(self) -> list[tuple[np.ndarray, np.ndarray]]:
        every, ends = zlib.decompress(self.packed), np.cumsum(self.sizes)
        return [self.at(every[z - n : z]) for n, z in zip(self.sizes, ends, strict=True)]

    def index(self) -> BlockMaxIndex:
        if self.made is None:
            self.made = BlockMaxIndex(self.ids, self.counts, self.vectors(), self.strong, self.label_weights)
        return self.made

    def calibrate(self) -> None:
        """Fits the sigmoid on the examples, each judged by the others: entries vote on one another, never on themselves."""
        index = self.index()
        rows = [(index.term[a:z].astype(np.int64), index.weight[a:z]) for a, z in zip(index.start[:-1], index.start[1:], strict=True)]
        votes = []
        for at in range(0, len(rows), TOGETHER):
            but = list(range(at, min(len(rows), at + TOGETHER)))
            votes += [index.vote(*x) for x in index.nearest_of(rows[at : at + TOGETHER], but=but)]
        weight = index.of_label.ravel()
        self.sigmoid = fit_sigmoid(np.repeat(votes, 2)[weight > 0], np.tile([0, 1], len(votes))[weight > 0], weight[weight > 0])

    def scores(self, votes: np.ndarray) -> np.ndarray:
        slope, shift = self.sigmoid
        return 1 / (1 + np.exp(-(slope * _odds(votes) + shift)))


def vocabulary(examples: DataFrame) -> list[str]:
    """All terms of the examples, those of most examples first, ties by term. examples: text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                held.update({t for raw in counted(text) for t in terms_of(raw)})
            if len(held) > 300_000:
                yield pa.RecordBatch.from_pydict({"term": list(held), "n": list(held.values())})
                held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["term", "n"])

    counts = examples.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return counts.toArrow().sort_by([("n", "descending"), ("term", "ascending")]).column("term").to_pylist()


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text", most_toxic: int = MOST_TOXIC, most_others: int = MOST_OTHERS) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5) and evidence (ids, label shares and cosines of the nearest examples).

    1. Examples: at most most_toxic labelled documents of label 1 and most_others of label 0, by a hash of the id. Labels
       of documents whose crc32(id) mod `folds` is `held_out` are never used. Votes weigh each label by what it stands for.
    2. Terms: every word of the examples, and the beginnings of longer ones. A weight is (1 + log tf) * idf * strength: idf
       from all documents; `strength` from the labels of the examples, which no term loses but for a common factor.
    3. Every whole text meets all examples by the exact cosine of these vectors (`BlockMaxIndex`); the nearest vote by
       nearness, and a sigmoid fitted on the examples, each judged by the others, calibrates the vote.

    Words that no example has meet nothing. Null and empty texts, and others without a known term, have the calibrated
    rate of label 1. Null labels are none; of several labels of one id the largest counts; a null id has none. Ids may be
    of any type and repeat; equal texts score alike. Texts of any length are read whole. Ties go to the entry with more
    weight in common terms, then to the least ids; a score of exactly 0.5 predicts 1. Other columns are not read. Without
    examples no score reaches 0.5; an empty table stays empty.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    learns = (crc_of_id(F.col(id_col)) % folds != held_out) & F.col("toxic").isin(0, 1)
    known = labels.where(learns & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    rows = docs.select(F.col(id_col).alias("doc_id"), utf8(F.col(text_col)).alias("text"))
    ranked = known.withColumn("h", F.xxhash64("doc_id"))
    taken = [ranked.where(F.col("y") == y).orderBy("h", "doc_id").limit(most) for y, most in ((1, most_toxic), (0, most_others))]
    chosen = scratch.store(taken[0].unionByName(taken[1]).select("doc_id", "y"), "chosen")  # most_toxic + most_others rows at most
    by_label = dict(known.groupBy("y").count().collect())
    # a repeated id is one example; of its texts the least counts
    texts = rows.join(F.broadcast(chosen), "doc_id").withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where("nth = 1")
    examples = scratch.store(texts.select("doc_id", "y", "text"), "examples")
    words = vocabulary(examples)
    numbered = spark.sparkContext.broadcast(Vocabulary(words))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [pack(*numbered.value.vector(t.as_py())) for t in batch.column("text")]
            kept = [batch.column(c) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.binary())], [*(c for c in batch.schema.names if c != "text"), "vector"])

    width = len(words)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(width, np.int64)
        for batch in batches:
            for v in batch.column(0):
                seen[unpack(v.as_py())[0]] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["term", "n"])

    vectors = scratch.store(rows.mapInArrow(run, f"doc_id {id_type}, vector binary"), "vectors")
    total = vectors.count()
    found = vectors.select("vector").mapInArrow(present, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.ones(width)
    df[found.column("term").to_numpy()] = found.column("n").to_numpy()
    held = examples.mapInArrow(run, f"doc_id {id_type}, y int, vector binary").toArrow()
    same: dict[bytes, dict] = {}
    for doc_id, y, vector in zip(*(held.column(c).to_pylist() for c in ("doc_id", "y", "vector")), strict=True):
        if len(vector) > 2:
            same.setdefault(vector, {})[doc_id] = y
    ordered = sorted(((sorted(of), len(of) - sum(of.values()), sum(of.values())), v) for v, of in same.items())
    model = Model([of for of, _ in ordered], [v for _, v in ordered], np.log(1 + total / df), (by_label.get(0, 0), by_label.get(1, 0)))
    model.calibrate()
    scratch.close(vectors)
    sent, none = spark.sparkContext.broadcast(model), not ordered

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = sent.value, {}
        index = model.index()
        for batch in batches:
            for first in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(first, TOGETHER)
                some = part.column(1).to_pylist()
                if len(known) > 2_000:
                    known.clear()
                new = [v for v in dict.fromkeys(some) if v not in known]
                for v, (near, sims) in zip(new, index.nearest_of([model.at(v) for v in new]), strict=True):
                    known[v] = (0.0 if none else index.vote(near, sims), near[:3], sims[:3])
                found = [known[v] for v in some]
                value = model.scores(np.array([vote for vote, _, _ in found], np.float64))
                near, sims = (np.concatenate([x[i] for x in found]) for i in (1, 2))
                ends = np.concatenate([[0], np.cumsum([len(x[1]) for x in found])]).astype(np.int32)
                shares = index.counts[near, 1] / index.examples[near] if len(near) else np.empty(0)
                told = pa.StructArray.from_arrays([pa.array([index.ids[i][0] for i in near], part.schema.field(0).type), pa.array(shares), pa.array(sims)], ["id", "label", "cosine"])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(value), pa.array((value >= 0.5).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), told)], ["doc_id", "score", "predicted", "evidence"])

    scored = vectors.mapInArrow(score, f"doc_id {id_type}, score double, predicted int, evidence array<struct<id:{id_type},label:double,cosine:double>>")
    return scored.select("doc_id", (crc_of_id(F.col("doc_id")) % folds == held_out).alias("held_out"), "score", "predicted", "evidence")
