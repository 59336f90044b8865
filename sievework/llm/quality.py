"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import crc_of_id, slices, utf8

#: Labelled rows that the trees are fitted on at most, taken by a hash of the id. The documented bound.
MAX_EXAMPLES = 30_000
BINS = 64

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 sentence mark, 6 symbol, 7 byte of a non-ASCII character
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 7 if _b >= 128 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _SPACE[_b] else 5 if _c in ".,;:?'\"()-" else 6 if 33 <= _b < 127 else 0
FEATURES = (
    "log_bytes", "log_words", "mean_word", "distinct_words", "top_word", "repeats_next", "upper_words", "lower", "upper", "digits", "space", "marks", "symbols",
    "non_ascii", "control", "ends_symbol", "ends_mark", "starts_symbol", "bars", "bangs", "log_lines", "distinct_lines", "mean_line", "longest_line", "long_words", "single_letters", "commas", "stops",
)


def statistics(text: bytes | None) -> list[float]:
    """FEATURES of a whole text; all 0 where there is none."""
    data = np.frombuffer(text or b"", np.uint8)
    n = len(data)
    if not n:
        return [0.0] * len(FEATURES)
    w = text.split()
    m = max(1, len(w))
    bytes_of = np.bincount(data, minlength=256)
    kinds = np.bincount(_KIND, weights=bytes_of, minlength=8) / n
    space = _SPACE[data]
    ends = np.bincount(_KIND[np.append(data[:-1][space[1:] & ~space[:-1]], data[-1:])], minlength=8) / m
    starts = np.bincount(_KIND[np.append(data[:1], data[1:][space[:-1] & ~space[1:]])], minlength=8) / m
    seen = Counter(w)
    lines = text.split(b"\n")
    size = np.fromiter(map(len, w), np.int64, len(w))
    return [
        float(np.log1p(n)), float(np.log1p(len(w))), n / m, len(seen) / m, max(seen.values(), default=0) / m, sum(map(operator.eq, w, w[1:])) / m, sum(map(bytes.isupper, w)) / m,
        kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7], kinds[0], ends[6], ends[5], starts[6], bytes_of[124] / m, bytes_of[33] / m,
        float(np.log1p(len(lines))), len(set(lines)) / len(lines), n / len(lines), max(map(len, lines)) / n, float((size > 20).mean()) if len(w) else 0.0, float((size == 1).mean()) if len(w) else 0.0, bytes_of[44] / m, bytes_of[46] / m,
    ]


@dataclass
class Trees:
    """Complete binary trees flattened into arrays: node i has the children 2i+1 and 2i+2; leaves[t, i] is a value."""

    feature: np.ndarray
    threshold: np.ndarray
    leaves: np.ndarray
    start: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row; all rows walk a tree at once."""
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        depth = int(np.log2(self.leaves.shape[1])) if len(self.leaves) else 0
        for t in range(len(self.leaves)):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.threshold[t, node])
            total += self.leaves[t, node - (self.leaves.shape[1] - 1)]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, l2: float = 1.0) -> Trees:
    """Boosts trees on the logistic loss; splits come from histograms of gradients over quantile bins.

    Without examples, or with one label only, there are no trees and the start is the (smoothed) rate of label 1.
    """
    n, width = x.shape if x.ndim == 2 else (0, len(FEATURES))
    start = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))) if n else 0.0
    inner, leaves = 2**depth - 1, 2**depth
    if not n or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), start)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(width)], 1)
    place = binned + np.arange(width) * BINS
    total = np.full(n, start)
    made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        gradient, hessian = y - p, p * (1 - p)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, here = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (width * BINS) + place).ravel()
            sums = [np.bincount(cell, weights=np.repeat(v, width), minlength=here * width * BINS).reshape(here, width, BINS).cumsum(2) for v in (gradient, hessian)]
            g, h = sums
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + l2) + (all_g - g) ** 2 / (all_h - h + l2) - all_g**2 / (all_h + l2)
            gain[(h < 1) | (all_h - h < 1)] = 0
            best = gain.reshape(here, -1).argmax(1)
            for k in range(here):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-9 and b < len(edges[f]):
                    feature[first + k], threshold[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, weights=gradient, minlength=leaves) / (np.bincount(leaf, weights=hessian, minlength=leaves) + l2)
        total += value[leaf]
        made.append((feature, threshold, value))
    return Trees(*(np.stack(a) for a in zip(*made, strict=True)), start)


def fit_quality(docs: DataFrame, labels: DataFrame, learns: Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_examples: int = MAX_EXAMPLES) -> Trees:
    """Trees from the labelled rows that `learns` admits, at most max_examples by a hash of the id; null labels are none.

    Of several labels of one id the largest counts. Statistics are computed for the chosen documents only.
    """
    known = labels.where(F.col(label).isin(0, 1) & learns & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)  # at most max_examples rows of two numbers
    rows = docs.select(F.col(id_col).alias("doc_id"), utf8(F.col(text_col)).alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([statistics(t.as_py()) for t in batch.column("text")], pa.list_(pa.float64())), batch.column("y")], ["features", "y"])

    found = sorted((tuple(r[0]), r[1]) for r in rows.mapInArrow(run, "features array<double>, y int").collect())
    return fit_trees(np.array([r[0] for r in found], np.float64), np.array([r[1] for r in found], np.float64))


def with_quality(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """The columns of docs (none of them `__quality`) and `__quality`, the probability of label 1 of the whole text (null: empty)."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=text_col):
            x = [statistics((t.as_py() or "").encode()) for t in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(trees.predict(np.array(x, np.float64)))], [*names, "__quality"])

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, f"{fields}, `__quality` double")


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (probability of label 1) and predicted (score >= 0.5) of every whole text.

    Labels of documents whose crc32(id) mod `folds` is `held_out` are never used. The model is a few thousand numbers,
    and one pass computes statistics and scores; nothing is shuffled. Empty and null texts are scored by statistics of
    0; a null id has no label; repeated rows are scored alike; without labels, or with one label only, every score is
    the smoothed rate of label 1. Texts of any length are read whole; a score of exactly 0.5 predicts 1; other columns are
    not read. An empty table gives an empty result.
    """
    trees = fit_quality(docs, labels, crc_of_id(F.col(id_col)) % folds != held_out, id_col=id_col, text_col=text_col)
    scored = with_quality(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), trees)
    return scored.select("doc_id", (crc_of_id(F.col("doc_id")) % folds == held_out).alias("held_out"), F.col("__quality").alias("score"), (F.col("__quality") >= 0.5).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, least: float = 0.5) -> DataFrame:
    """The rows of docs whose score is `least` or more, with the columns of docs, whatever their names.

    Null and empty texts, null ids, repeated rows and empty tables are as in `score_quality`.
    """
    trees = fit_quality(docs, labels, crc_of_id(F.col("doc_id")) % folds != held_out)
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    scored = with_quality(docs.toDF(*at.values()), trees, text_col=at["text"])
    return scored.where(F.col("__quality") >= least).select(*[F.col(c).alias(name) for name, c in at.items()])
