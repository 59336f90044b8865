"""N-gram Jaccard join: exact links between documents by a blocked sparse product of documents and n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import Scratch, joined, lookup_join, slices, small_side, squeeze, unsqueeze, utf8
from sievework.llm.components import components
from sievework.llm.hashing import hash_words, shingles

#: Bytes of text that are counted together, of n-grams in a part, and of prefix entries in a part.
HOME_BYTES, PART_BYTES, ENTRY_BYTES = 4 << 20, 8 << 20, 8 << 20
#: N-grams that a unit of the exact end aims at, and that it holds at the most.
UNIT, MOST = 1 << 19, 1 << 22
#: Frequencies are told apart up to EXACT documents, by quarters of a power of two beyond; common n-grams meet at nodes.
EXACT, COMMON = 128, 256


def required(a, b, num: int, den: int):
    """Least overlap of sets of a and b n-grams that are linked."""
    return -(-num * (a + b) // (num + den))


def prefix_lengths(n, num: int, den: int) -> tuple:
    """How many of the rarest n-grams of a set of n the larger set of a linked pair, and the smaller one, needs to offer."""
    return n - -(-num * n // den) + 1, n - -(-2 * num * n // (num + den)) + 1


def _sets(texts, size: int) -> list[np.ndarray]:
    return [shingles(hash_words(t), size) for t in texts]


def sign_of(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def code_of(df: np.ndarray) -> np.ndarray:
    """A byte that never falls as the document frequency grows."""
    beyond = EXACT + np.floor(4 * np.log2(np.maximum(df, EXACT) / EXACT))
    return np.where(df < EXACT, df, beyond).clip(0, 255).astype(np.uint8)


def size_class(n: int, num: int, den: int) -> int:
    return int(math.log(n) / math.log(den / num) + 1e-9)


def hash_of(gram: int, kind: int) -> int:
    """A node for an n-gram and a size class."""
    return xxhash.xxh64_intdigest(gram.to_bytes(8, "little") + kind.to_bytes(4, "little", signed=True)) - (1 << 63)


def part_bits(n_bytes: int, of: int) -> int:
    return max(1, math.ceil(n_bytes / of) - 1).bit_length()


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first places, lengths) of equal neighbours."""
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)
    return first, np.diff(np.append(first, len(ordered)))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of edges as many (two columns) as join the same nodes."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := root.setdefault(i, i)) != i:
            root[i] = i = root[up]
        return i

    out = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((i, j))
    return np.array(out, np.int64).reshape(-1, 2)


def _table(names: list[str], kinds: list, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


_LONG, _INT, _BYTES = pa.int64(), pa.int32(), pa.binary()
OFFERED = "group long, home long, part int, keys binary, docs binary, many binary, counts binary, about binary"
COUNTED = "home long, part int, keys binary, docs binary, codes binary, many binary, about binary"
DESCRIBED = "doc_id long, n_shingles long, sign binary, prefix binary"


def prefixes_by_frequency(rows: DataFrame, n_bytes: int, size: int, num: int, den: int) -> DataFrame:
    """For each row (doc_id, text): doc_id, n_shingles, sign (128 bits of the set) and prefix, as `pack_prefix` has it.

    The prefix are the rarest n-grams of a set, in an order that all sets share: by how many sets have them, then by hash.
    N-grams that no other set has are left out of it, as they meet nothing; sets without others have a null prefix, and of
    equal sets that were counted together only one has it.

    One slice of texts, a home, says of each part of the n-grams which it has: distinct sets once, an n-gram once with its
    number of sets, so neither copies nor a passage of many documents make a part hot. Parts add up, and send back what
    other sets have too, with a byte for the frequency. Which sets of the home share an n-gram goes on to the home without
    a detour through the parts. A part names some bits of an n-gram and 32 more bits go to it; n-grams that agree in those
    count as one, in every set alike, which can add candidates and lose none.
    """
    bits = part_bits(n_bytes, PART_BYTES)
    parts = 1 << bits

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, batch in enumerate(slices(batches, HOME_BYTES)):
            home = TaskContext.get().partitionId() << 32 | at
            number: dict[bytes, int] = {}
            sets, of = [], []
            for grams in _sets((t.as_py() for t in batch.column("text")), size):
                mine = number.setdefault(sign_of(grams), len(number))
                if mine == len(sets):
                    sets.append(grams)
                of.append(mine)
            sizes = np.array([len(s) for s in sets])
            keys, doc = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
            key = (keys & np.uint64(parts - 1)) << np.uint64(32) | (keys >> np.uint64(bits)) & np.uint64(0xFFFFFFFF)
            order = np.argsort(key, kind="stable")
            key, doc = key[order], doc[order]
            first, n = _runs(key)
            once, more = first[n == 1], first[n > 1]
            often = n[n > 1]
            cut = [np.searchsorted(key[x] >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64)) for x in (once, more)]
            short = (key & np.uint64(0xFFFFFFFF)).astype("<u4")
            out = []
            for p in range(parts):
                (a, z), (b, y) = cut[0][p : p + 2], cut[1][p : p + 2]
                if a < z or b < y:
                    out.append((p, home, p, squeeze(short[once[a:z]], True), squeeze(doc[once[a:z]]), squeeze(short[more[b:y]], True), squeeze(often[b:y].astype("<u4")), None))
            ids = batch.column("doc_id")
            told = pa.BufferOutputStream()
            about = pa.RecordBatch.from_arrays([ids, pa.array(of, _INT)], ["doc_id", "set"])
            signs = pa.RecordBatch.from_arrays([pa.array(list(number), _BYTES), pa.array(sizes, _LONG)], ["sign", "n"])
            for x in (about, signs):
                with pa.ipc.new_stream(told, x.schema) as writer:
                    writer.write_batch(x)
            # a group of its own: this row only passes by
            inside = _ranges(more, often)
            out.append((parts + (home * 0x9E3779B97F4A7C15 >> 3) % (1 << 60), home, -1, b"", squeeze(doc[inside]), squeeze(key[more], True), squeeze(often.astype("<u4")), told.getvalue().to_pybytes()))
            yield _table(["group", "home", "part", "keys", "docs", "many", "counts", "about"], [_LONG, _LONG, _INT, *[_BYTES] * 5], out)

    def count(key, table):
        names = ["home", "part", "keys", "docs", "codes", "many", "about"]
        homes, part = table.column("home").to_pylist(), table.column("part").to_pylist()
        if part[0] < 0:
            return pa.table({c: table.column({"codes": "counts"}.get(c, c)) for c in names})
        single = [unsqueeze(x.as_py(), "<u4", True) for x in table.column("keys")]
        many = [unsqueeze(x.as_py(), "<u4", True) for x in table.column("many")]
        every = np.concatenate([*single, *many])
        weight = np.concatenate([np.ones(sum(map(len, single)), np.int64), *[unsqueeze(x.as_py(), "<u4") for x in table.column("counts")]])
        order = np.argsort(every, kind="stable")
        first, n = _runs(every[order])
        df = np.empty(len(every), np.int64)
        df[order] = np.repeat(np.add.reduceat(weight[order], first), n) if len(first) else 0
        code = code_of(df)
        out, a, b = [], 0, sum(map(len, single))
        for home, s, m, docs in zip(homes, single, many, table.column("docs"), strict=True):
            mine = code[a : a + len(s)]
            again = mine > 1
            if again.any() or len(m):
                out.append((home, part[0], squeeze(s[again], True), squeeze(unsqueeze(docs.as_py(), "<u2")[again]), squeeze(mine[again]), squeeze(code[b : b + len(m)]), None))
            a, b = a + len(s), b + len(m)
        return pa.Table.from_batches([_table(names, [_LONG, _INT, *[_BYTES] * 5], out)])

    def gather(key, table):
        part = table.column("part").to_numpy()
        own = int(np.flatnonzero(part < 0)[0])
        told = pa.BufferReader(table.column("about")[own].as_py())
        about, signs = (pa.ipc.open_stream(told).read_all() for _ in range(2))
        at = np.argsort(part, kind="stable")
        at = at[part[at] >= 0].tolist()
        n = signs.column("n").to_numpy()
        # what single sets of the home have, and what several of them have, part by part
        keys = [unsqueeze(table.column("keys")[i].as_py(), "<u4", True).astype(np.uint64) << np.uint64(bits) | np.uint64(part[i]) for i in at]
        docs = [unsqueeze(table.column("docs")[i].as_py(), "<u2") for i in at]
        codes = [unsqueeze(table.column("codes")[i].as_py(), np.uint8) for i in at]
        shared = unsqueeze(table.column("many")[own].as_py(), np.uint64, True)
        often = unsqueeze(table.column("codes")[own].as_py(), "<u4")
        of_shared = joined([unsqueeze(table.column("many")[i].as_py(), np.uint8) for i in at], np.uint8)
        keys.append(np.repeat((shared & np.uint64(0xFFFFFFFF)) << np.uint64(bits) | shared >> np.uint64(32), often))
        docs.append(unsqueeze(table.column("docs")[own].as_py(), "<u2"))
        codes.append(np.repeat(of_shared, often))
        keys, docs, codes = joined(keys, np.uint64), joined(docs, np.uint16).astype(np.int64), joined(codes, np.uint8)
        order = np.lexsort((keys, codes, docs))
        keys, docs, codes = keys[order], docs[order], codes[order]
        held = np.bincount(docs, minlength=len(n))
        alone = n - held
        place = np.arange(len(docs)) - np.repeat(np.cumsum(held) - held, held) + alone[docs]
        keep = place < prefix_lengths(n, num, den)[0][docs]
        keys, docs, codes, place = keys[keep], docs[keep], codes[keep], place[keep]
        cuts = np.searchsorted(docs, np.arange(len(n) + 1))
        prefix = [pack_prefix(keys[a:z], place[a:z], codes[a:z]) if a < z else None for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        number = about.column("set").to_numpy()
        ids = about.column("doc_id")
        known = np.flatnonzero(~ids.is_null().to_numpy())  # a null id speaks for no set
        first = np.zeros(len(number), bool)
        first[known[np.unique(number[known], return_index=True)[1]]] = True
        out = [ids.combine_chunks(), pa.array(n[number], _LONG), signs.column("sign").combine_chunks().take(pa.array(number)), pa.array([prefix[s] if f else None for s, f in zip(number, first, strict=True)], _BYTES)]
        return pa.Table.from_arrays(out, ["doc_id", "n_shingles", "sign", "prefix"])

    counted = rows.mapInArrow(offer, OFFERED).groupBy("group").applyInArrow(count, COUNTED)
    return counted.groupBy("home").applyInArrow(gather, DESCRIBED)


def pack_prefix(keys: np.ndarray, places: np.ndarray, codes: np.ndarray) -> bytes:
    return b"".join([keys.astype("<u8").tobytes(), places.astype("<i4").tobytes(), codes.astype(np.uint8).tobytes()])


def unpack_prefix(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data) // 13
    return np.frombuffer(data, "<u8", n), np.frombuffer(data, "<i4", n, 8 * n), np.frombuffer(data, np.uint8, n, 12 * n)


def candidate_edges(keys: np.ndarray, docs: np.ndarray, sizes: np.ndarray, places: np.ndarray, num: int, den: int) -> np.ndarray:
    """Edges (two columns of documents) that join all pairs which can be linked and share an entry of their prefixes.

    Entries of one n-gram are a block of the product. A pair stands only if the sizes allow a link, the smaller set has
    the n-gram in its shorter prefix, and what comes after it can still reach the overlap that the sizes require. Of a
    block's pairs a spanning forest is enough. Blocks of more than COMMON entries chain documents by size instead.
    """
    order = np.lexsort((docs, sizes, keys))
    keys, docs, sizes, places = keys[order], docs[order], sizes[order], places[order]
    first, runs = _runs(keys)
    shorter = prefix_lengths(sizes, num, den)[1]

    def stands(small, large):
        after = np.minimum(sizes[small] - places[small], sizes[large] - places[large])
        return (den * sizes[small] >= num * sizes[large]) & (places[small] < shorter[small]) & (after >= required(sizes[small], sizes[large], num, den))

    two = first[runs == 2]
    # of equal sizes either one may be the smaller
    either = stands(two, two + 1) | ((sizes[two] == sizes[two + 1]) & stands(two + 1, two))
    out = [np.stack([docs[two[either]], docs[two[either] + 1]], 1)]
    for at, n in zip(first[runs > 2], runs[runs > 2], strict=True):
        here = np.arange(at, at + n)
        if n > COMMON:
            near = den * sizes[here[:-1]] >= num * sizes[here[1:]]
            out.append(np.stack([docs[here[:-1][near]], docs[here[1:][near]]], 1))
            continue
        a, b = np.triu_indices(n, 1)
        a, b = a + at, b + at
        ok = stands(a, b) | ((sizes[a] == sizes[b]) & stands(b, a))
        if ok.any():
            out.append(forest(docs[a[ok]], docs[b[ok]]))
    edges = np.concatenate(out)
    edges = edges[edges[:, 0] != edges[:, 1]]
    return forest(edges[:, 0], edges[:, 1])


class Incidence:
    """Sets as rows of numbered n-grams, the rarest of the unit first."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        grams, number, n = np.unique(joined(sets, np.uint64), return_inverse=True, return_counts=True)
        order = np.argsort(n, kind="stable")
        rank = np.empty(len(grams), np.int32)
        rank[order] = np.arange(len(grams), dtype=np.int32)
        self.often = n[order]
        starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.rows = [np.sort(rank[number[a:z]]) for a, z in zip(starts[:-1], starts[1:], strict=True)]
        self.mark = np.zeros(len(grams), bool)

    def overlaps(self, some: list[int]) -> np.ndarray:
        """With the marked row."""
        sizes = self.sizes[some]
        return np.add.reduceat(self.mark[np.concatenate([self.rows[j] for j in some])].astype(np.int64), np.cumsum(sizes) - sizes)


def exact_links(sets: list[np.ndarray], num: int, den: int, step: int = 64) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """(a spanning forest of the links among the sets, as pairs of places; each set's centre; its distance from it).

    Sets come in ascending size, and each looks up the indexed prefixes of smaller ones. Linked sets stand in the index by
    stars: a centre, and what it knows of their Jaccard distances from it. A star that the set is joined with already is
    passed over, so a group of near copies costs one product a set; of others the centre's product comes first, and by the
    triangle inequality only members that it leaves near enough are multiplied too, `step` at a time.
    """
    inc = Incidence(sets)
    sizes, rows, often = inc.sizes, inc.rows, inc.often
    apart = 1 - num / den + 1e-9
    root, centre, away = list(range(len(sets))), np.arange(len(sets)), np.zeros(len(sets))
    radius = np.zeros(len(sets))
    index: dict[int, dict[int, list[int]]] = {}
    out = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    def products(i: int, some: list[int]) -> tuple[np.ndarray, np.ndarray]:
        overlap = inc.overlaps(some)
        union = sizes[some] + sizes[i] - overlap
        return den * overlap >= num * union, 1 - overlap / union

    for i in np.lexsort((np.arange(len(sets)), sizes)).tolist():
        if not sizes[i]:
            continue
        longer, shorter = prefix_lengths(int(sizes[i]), num, den)
        inc.mark[rows[i]] = True
        known: dict[int, float] = {}
        tried: set[int] = set()

        def join(j: int) -> None:
            out.append((i, j))  # noqa: B023
            root[find(j)] = find(i)  # noqa: B023

        for g in rows[i][:longer].tolist():
            for c, members in index.get(g, {}).items():
                if find(c) == find(i):
                    continue
                if c not in known:
                    linked, d = products(i, [c])
                    known[c] = float(d[0])
                    if linked[0]:
                        join(c)
                        continue
                if known[c] - radius[c] > apart:
                    continue
                left = [m for m in members if m not in tried and m != c and den * sizes[m] >= num * sizes[i] and abs(known[c] - away[m]) <= apart]
                while left:
                    part, left = left[:step], left[step:]
                    tried.update(part)
                    linked, _ = products(i, part)
                    if linked.any():
                        join(part[int(np.argmax(linked))])
                        break
        inc.mark[rows[i]] = False
        mine = [(d, c) for c, d in known.items() if find(c) == find(i) and d <= 2 * apart]
        if mine:
            away[i], centre[i] = min(mine)
            radius[centre[i]] = max(radius[centre[i]], away[i])
        for g in rows[i][:shorter].tolist():
            if often[g] > 1:
                index.setdefault(g, {}).setdefault(int(centre[i]), []).append(i)
    return out, centre, away


def near_centres(sets: list[np.ndarray], radius: np.ndarray, num: int, den: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, float]]]:
    """(linked pairs, pairs that are not but whose stars may hold links, with their distance) of centres: the sparse product of all rows."""
    inc = Incidence(sets)
    sizes = inc.sizes
    doc = np.repeat(np.arange(len(sets)), sizes)
    gram = joined(inc.rows, np.int32)
    order = np.argsort(gram, kind="stable")
    start = np.concatenate([[0], np.cumsum(inc.often)])
    column = doc[order]
    apart, links, near = 1 - num / den + 1e-9, [], []
    for i, row in enumerate(inc.rows):
        overlap = np.bincount(column[_ranges(start[row], inc.often[row])], minlength=len(sets))[:i]
        union = sizes[:i] + sizes[i] - overlap
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.where(union > 0, 1 - overlap / np.maximum(union, 1), 1.0)
        linked = (union > 0) & (den * overlap >= num * union)
        links += [(i, int(j)) for j in np.flatnonzero(linked)]
        near += [(i, int(j), float(d[j])) for j in np.flatnonzero(~linked & (d <= apart + radius[:i] + radius[i]))]
    return links, near


FOUND = "kind int, a long, b long, a_sign binary, b_sign binary, d double"
LINK, STAR, NEAR = 0, 1, 2


def settle_units(rows: DataFrame, dealt: DataFrame, n_dealt: int, size: int, num: int, den: int, centres: bool = False) -> DataFrame:
    """What the units of `dealt` (rep, sign, unit, stars: boolean, radius: double) find, as rows of FOUND.

    A unit's texts are read again; of a document's rows only those whose set has the sign count.
    """

    def settle(key, table):
        wanted, texts = table.column("sign").to_pylist(), table.column("text")
        sets, ids, signs, radius = [], [], [], []
        known: dict[tuple, int] = {}
        for i, grams in enumerate(_sets((t.as_py() for t in texts), size)):
            sign = sign_of(grams)
            rep = table.column("rep")[i].as_py()
            if sign == wanted[i] and (rep, sign) not in known:
                known[rep, sign] = len(ids)
                sets.append(grams), ids.append(rep), signs.append(sign), radius.append(table.column("radius")[i].as_py())
        put = lambda kind, a, b, d: (kind, ids[a], ids[b], signs[a], signs[b], d)
        if centres:
            links, near = near_centres(sets, np.array(radius, np.float64), num, den)
            out = [put(LINK, a, b, None) for a, b in links] + [put(NEAR, a, b, d) for a, b, d in near]
        else:
            links, centre, away = exact_links(sets, num, den)
            out = [put(LINK, a, b, None) for a, b in links]
            if table.column("stars")[0].as_py():
                out += [put(STAR, a, int(c), float(d)) for a, (c, d) in enumerate(zip(centre, away, strict=True))]
        return pa.Table.from_batches([_table(["kind", "a", "b", "a_sign", "b_sign", "d"], [_INT, _LONG, _LONG, _BYTES, _BYTES, pa.float64()], out)])

    texts = rows.join(small_side(dealt.withColumnRenamed("rep", "doc_id"), n_dealt), "doc_id")
    return texts.select(F.col("doc_id").alias("rep"), "text", "sign", "unit", "stars", "radius").groupBy("unit").applyInArrow(settle, FOUND)


def settle_large(rows: DataFrame, large: DataFrame, scratch: Scratch, size: int, num: int, den: int) -> DataFrame:
    """Links (a, b) within components of more than MOST n-grams; large: rep, sign, n, root, total (n-grams of the component).

    1. Members are dealt into cells at random; each is settled exactly and covered by stars (a centre, and members whose
       distance from it is known), so that a group of near copies is a star or a few in each cell.
    2. The centres, far fewer, meet in pairs of blocks: links of centres, and pairs of stars that the triangle inequality
       lets hold a link.
    3. Of those that the links so far do not join, the members that are far enough out in their star are compared.
    """
    unit = lambda *c: F.xxhash64(*c)
    cells = F.ceil(2 * F.col("total") / MOST)
    dealt = large.select("rep", "sign", "root", "n", unit("root", F.pmod(F.xxhash64("sign"), cells)).alias("unit"), F.lit(True).alias("stars"), F.lit(0.0).alias("radius"))
    first = scratch.store(settle_units(rows, dealt.drop("root", "n"), large.count(), size, num, den), "cells")
    stars = first.where(F.col("kind") == STAR).select(F.col("a").alias("rep"), F.col("a_sign").alias("sign"), F.col("b").alias("centre"), F.col("b_sign").alias("c_sign"), "d")
    stars = scratch.store(stars.join(large.select("rep", "sign", "n", "root"), ["rep", "sign"]), "stars")
    centres = stars.groupBy("root", "centre", "c_sign").agg(F.max("d").alias("radius"))
    centres = centres.join(large.select(F.col("rep").alias("centre"), F.col("sign").alias("c_sign"), "n", "root"), ["root", "centre", "c_sign"])
    cuts = centres.groupBy("root").agg(F.ceil(2 * F.sum("n") / MOST).alias("cuts"))
    dealt = centres.join(cuts, "root").withColumn("block", F.pmod(F.xxhash64("c_sign"), F.col("cuts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    dealt = dealt.select(F.col("centre").alias("rep"), F.col("c_sign").alias("sign"), unit("root", F.least("block", "other"), F.greatest("block", "other")).alias("unit"), F.lit(False).alias("stars"), "radius")
    dealt = scratch.store(dealt, "centres")
    second = scratch.store(settle_units(rows, dealt, dealt.count(), size, num, den, centres=True), "centre-links")
    links = lambda df: df.where(F.col("kind") == LINK).select("a", "b")
    inside = stars.where("centre <> rep").select(F.col("rep").alias("a"), F.col("centre").alias("b"))
    labels = components(links(first).unionByName(links(second)).unionByName(inside))
    near = second.where(F.col("kind") == NEAR).dropDuplicates(["a", "a_sign", "b", "b_sign"])
    near = near.join(labels.select(F.col("node").alias("a"), F.col("root").alias("x")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("root").alias("y")), "b", "left")
    near = near.where(F.coalesce("x", "a") != F.coalesce("y", "b"))
    reach = centres.select("centre", "c_sign", "radius")
    near = near.join(reach.select(F.col("centre").alias("a"), F.col("c_sign").alias("a_sign"), F.col("radius").alias("ra")), ["a", "a_sign"])
    near = scratch.store(near.join(reach.select(F.col("centre").alias("b"), F.col("c_sign").alias("b_sign"), F.col("radius").alias("rb")), ["b", "b_sign"]), "near")
    pair, apart = unit("a", "a_sign", "b", "b_sign").alias("unit"), 1 - num / den + 1e-9
    sides = near.select(F.col("a").alias("centre"), F.col("a_sign").alias("c_sign"), pair, (F.col("d") - apart - F.col("rb")).alias("least"))
    sides = sides.unionByName(near.select(F.col("b").alias("centre"), F.col("b_sign").alias("c_sign"), pair, (F.col("d") - apart - F.col("ra")).alias("least")))
    dealt = stars.withColumnRenamed("d", "out").join(sides, ["centre", "c_sign"]).where(F.col("out") >= F.col("least"))
    dealt = scratch.store(dealt.select("rep", "sign", "unit", F.lit(False).alias("stars"), F.lit(0.0).alias("radius")), "outer")
    third = settle_units(rows, dealt, dealt.count(), size, num, den)
    return scratch.store(links(first).unionByName(links(second)).unionByName(links(third)).where("a <> b"), "large-links")


def ngram_join(docs: DataFrame, size: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles (size of the set of `size`-word n-grams), component_id (least id that links reach).

    Two documents link if den * |intersection| >= num * |union|. No link is lost, and no pair is written out:

    1. Each set gets a 128-bit signature and its prefix: its rarest n-grams, of which linked sets must share one
       (`prefixes_by_frequency`). Documents of one set are one class from here on (least id stands for it).
    2. Prefix entries meet by n-gram, packed in parts, and give edges that hold all candidate pairs together
       (`candidate_edges`). Common n-grams meet at a node for the n-gram and size class, by a forest of each batch, so that
       no task holds a common n-gram's documents.
    3. Components of these edges are dealt into units of about UNIT n-grams, and MOST at the most. The texts of their
       members, a small share, are read again, and `exact_links` settles each unit. Larger components go through
       `settle_large`.
    4. Components of the links name every document, by its signature.

    Sets are held as 64-bit hashes: two n-grams of a pair share one by chance in about 1 of 10^13 pairs. Ids are integers.
    Null ids keep a null component_id and link with nothing. Texts without words have no n-grams and link with nothing.
    Repeated ids are one document with the links of all its rows; equal rows stay as many. An empty table gives an empty
    result. Other columns are not read, whatever their names. Texts may be of any length: one is never cut.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text_col)).alias("text"))
    total, n_bytes = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    described = scratch.store(prefixes_by_frequency(rows, n_bytes or 1, size, num, den), "described")
    sets = described.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.store(sets.groupBy("sign").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n")), "classes", rows=total)
    prefixed = sets.where("prefix is not null").groupBy("sign").agg(F.first("prefix").alias("prefix")).join(classes, "sign").select("rep", "sign", "n", "prefix")
    prefixed = scratch.store(prefixed, "prefixed", rows=total)
    n_entries = prefixed.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    bits = part_bits(2 * n_entries, ENTRY_BYTES)
    limit = int(code_of(np.array([COMMON]))[0])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20, "prefix"):
            reps, sizes = batch.column("rep").to_numpy(), batch.column("n").to_numpy()
            prefix = [unpack_prefix(p.as_py()) for p in batch.column("prefix")]
            held = np.array([len(k) for k, _, _ in prefix])
            key, place, code = (np.concatenate(x) for x in zip(*prefix, strict=True))
            doc, n = np.repeat(reps, held), np.repeat(sizes, held)
            rare = code < limit
            part = key & np.uint64((1 << bits) - 1)
            order = np.flatnonzero(rare)[np.argsort(part[rare], kind="stable")]
            cuts = np.searchsorted(part[order], np.arange((1 << bits) + 1, dtype=np.uint64))
            out = [(p, key[x].tobytes(), doc[x].astype("<i8").tobytes(), n[x].astype("<i4").tobytes(), place[x].tobytes()) for p, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < z for x in [order[a:z]]]
            out = [(*row, None) for row in out]
            nodes = [(d, hash_of(int(g), size_class(int(m), num, den) - less)) for d, g, m in zip(doc[~rare].tolist(), key[~rare].tolist(), n[~rare].tolist(), strict=True) for less in (0, 1)]
            if nodes:
                pairs = forest(*np.array(nodes, np.int64).T)
                out.append((-1, *[None] * 4, [{"a": a, "b": b} for a, b in pairs.tolist()]))
            yield _table(["part", "keys", "docs", "sizes", "places", "edges"], [_INT, *[_BYTES] * 4, pa.list_(pa.struct([("a", _LONG), ("b", _LONG)]))], out)

    packed = prefixed.mapInArrow(entries, "part int, keys binary, docs binary, sizes binary, places binary, edges array<struct<a:long,b:long>>")
    read = lambda table, column, kind: np.frombuffer(b"".join(x.as_py() for x in table.column(column)), kind).astype(kind[1:])

    def meet(key, table):
        edges = candidate_edges(read(table, "keys", "<u8"), read(table, "docs", "<i8"), read(table, "sizes", "<i4").astype(np.int64), read(table, "places", "<i4").astype(np.int64), num, den)
        return pa.table({"a": pa.array(edges[:, 0], _LONG), "b": pa.array(edges[:, 1], _LONG)})

    met = packed.where("part >= 0").drop("edges").groupBy("part").applyInArrow(meet, "a long, b long")
    met = met.unionByName(packed.where("part < 0").select(F.inline("edges")))
    found = components(met)
    members = scratch.store(prefixed.select("rep", "sign", "n").join(found.withColumnRenamed("node", "rep"), "rep"), "members", rows=total)
    sized = members.groupBy("root").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("m")).where("m > 1")
    members = scratch.store(members.join(sized, "root"), "members-sized", rows=total)
    n_members, n_grams = members.agg(F.count(F.lit(1)), F.sum("n")).first()
    units = max(1, math.ceil((n_grams or 0) / UNIT))
    dealt = members.where(F.col("total") <= MOST).select("rep", "sign", F.pmod(F.xxhash64("root"), F.lit(units)).alias("unit"), F.lit(False).alias("stars"), F.lit(0.0).alias("radius"))
    links = settle_units(rows, dealt, n_members, size, num, den).select("a", "b")
    large = members.where(F.col("total") > MOST)
    if not large.isEmpty():
        links = links.unionByName(settle_large(rows, large, scratch, size, num, den))
    # rows of one id join what each of them is linked with
    several = described.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64("sign")).alias("x"), F.max(F.xxhash64("sign")).alias("y")).where("x <> y").select("doc_id")
    several = scratch.store(several, "several", rows=total)
    many = not several.isEmpty()
    if many:
        theirs = described.join(several, "doc_id").join(classes.select("sign", "rep"), "sign", "left")
        links = links.unionByName(theirs.where("rep is not null and rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    joins = components(links)
    least = joins.groupBy("root").agg(F.min("node").alias("component_id"))
    named = scratch.store(joins.join(least, "root").select(F.col("node").alias("rep"), "component_id"), "named", rows=total)
    names = classes.join(named, "rep", "left").select("sign", "copies", F.coalesce("component_id", "rep").alias("component_id"), (F.coalesce("component_id", "rep") != F.col("rep")).alias("moved"))
    names = scratch.store(names.where("copies > 1 or moved").select("sign", "copies", "component_id"), "names", rows=total)
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    out = lookup_join(described.where(linked).select("doc_id", "n_shingles", "sign"), names, "sign", "copies", total)
    out = out.unionByName(described.where(~linked).select("doc_id", "n_shingles", "sign", F.lit(None).cast("long").alias("copies"), F.lit(None).cast("long").alias("component_id")))
    if many:  # a row without n-grams has what the id's other rows have
        out = out.join(several.join(named.withColumnRenamed("rep", "doc_id").withColumnRenamed("component_id", "of_id"), "doc_id"), "doc_id", "left")
        out = out.withColumn("component_id", F.coalesce("of_id", "component_id"))
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = scratch.store(out, "joined", rows=total)
    scratch.close(out)
    return out
