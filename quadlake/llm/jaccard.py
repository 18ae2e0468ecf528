"""Jaccard join of word n-gram sets with Bayesian candidate pruning.

Documents with the same set of shingles are one class. Candidates are the pairs of classes
that share a MinHash band. They compare their MinHash values some at a time; after n values of
which m agree, the posterior of the similarity (uniform prior) is Beta(m + 1, n - m + 1), and
a pair is dropped as soon as the probability of reaching the threshold falls below a
tolerance. What is left is verified exactly on the sets of 64-bit shingle hashes.

Classes connected by bands make a group. Its pairs are looked for in one of two ways, by which
compares fewer: where the group is dense, among all its members at once, so that each class's
shingles travel once; where it is a chain of small bands, band by band, and a pair is judged
in the first band that it shares. Both find the same links. Units of work that are too many or
too long are split into blocks, and pairs of blocks are compared by separate tasks that return
counts and spanning links, never pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, freed, mixed, pieces, row_id, signed, slices, stored, texts, uses, word_keys
from .components import connected, roots

BANDS, ROWS, STEP = 26, 5, 16
VALUES = BANDS * ROWS
#: Pairs compared at a time, bytes of shingles in a block, and the cost of a unit of work in pairs.
PAIRS, BLOCK_BYTES, UNIT = 200_000, 8_000_000, 256
_RANDOM = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, (2, VALUES), dtype=np.uint64)
FACTORS, TERMS = _RANDOM[0] | np.uint64(1), _RANDOM[1]
_WORD = [np.uint64(pow(0xD1342543DE82EF95, k, 1 << 64)) for k in range(16)]


def shingles(batch: list[str], words: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams.

    Words are what ASCII white space separates, in lower case. A text of fewer words than n
    has one shingle of all its words; one without words has none.
    """
    raw = [x.lower().encode() for x in batch]
    joined = b"\n".join(raw)
    data = np.frombuffer(joined, np.uint8)
    gap = np.empty(len(data) + 2, bool)
    gap[0] = gap[-1] = True
    np.logical_or(data == 32, (data >= 9) & (data <= 13), out=gap[1:-1])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[0::2], edge[1::2]
    word = word_keys(joined, start, end - start)[0]
    upto = np.searchsorted(start, np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)).tolist()
    n = max(0, len(word) - words + 1)
    grams = np.zeros(n, np.uint64)
    for k in range(words):
        grams += word[k : k + n] * _WORD[k]
    grams = mixed(grams)
    out = []
    for a, b in zip([0, *upto], upto, strict=False):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            total = (word[a:b] * np.array(_WORD[: b - a])).sum(keepdims=True)
            out.append(mixed(total ^ np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """VALUES MinHash values of each non-empty set."""
    out = np.empty((len(sets), VALUES), np.uint32)
    for a, b in slices(sets, len, 40_000):
        flat = np.concatenate(sets[a:b])
        sizes = np.fromiter(map(len, sets[a:b]), np.int64, b - a)
        starts = np.cumsum(sizes) - sizes
        for k in range(VALUES):
            out[a:b, k] = np.minimum.reduceat(flat * FACTORS[k] + TERMS[k] >> np.uint64(32), starts)
    return out


def least_agreeing(threshold: float, tolerance: float) -> dict[int, int]:
    """After n values: the fewest agreeing ones at which the threshold stays probable enough.

    With a uniform prior, P(J >= t | m of n agree) = P(Binomial(n + 1, t) <= m).
    """
    out = {}
    for n in [*range(STEP, VALUES, STEP), VALUES]:
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


class Verifier:
    """Finds the linked pairs between two blocks of classes."""

    def __init__(self, threshold: tuple[int, int] = (4, 5), tolerance: float = 1e-7):
        self.top, self.bottom = threshold
        self.enough = least_agreeing(self.top / self.bottom, tolerance)

    def pairs(self, values: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, same: bool, band: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows (i, j) of verified pairs that share a band; with `same`, left is right and each pair is taken once.

        With a band's number, only the pairs whose first shared band it is.
        """
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        out = [self._part(values, sets, sizes, left[a : a + step], right, left[a:] if same else None, band) for step in [max(1, PAIRS // max(1, len(right)))] for a in range(0, len(left), step)]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (left[:0], left[:0])

    def _part(self, values, sets, sizes, left, right, after, band):
        """pairs() for some of the left rows; with `after`, the rows from the first of them on stand for right."""
        if after is None:
            i, j = (x.ravel() for x in np.indices((len(left), len(right))))
            i, j = left[i], right[j]
        else:
            i, j = (x.ravel() for x in np.indices((len(left), len(after))))
            i, j = i[i < j], j[i < j]
            i, j = left[i], after[j]
        fits = np.minimum(sizes[i], sizes[j]) * self.bottom >= np.maximum(sizes[i], sizes[j]) * self.top
        i, j = i[fits], j[fits]
        agree, done = np.zeros(len(i), np.int64), 0
        for n, enough in self.enough.items():
            if not len(i):
                return i, j
            agree += (values[i, done:n] == values[j, done:n]).sum(1)
            done, keep = n, agree >= enough
            i, j, agree = i[keep], j[keep], agree[keep]
        shared = (values[i] == values[j]).reshape(len(i), BANDS, ROWS).all(2)
        own = shared.any(1) if band < 0 else shared[:, band] & ~shared[:, :band].any(1)
        i, j = i[own], j[own]
        out = [self._exact(sets, sizes, i[a:b], j[a:b]) for a, b in slices((sizes[i] + sizes[j]).tolist(), int, 4_000_000)]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (i, j)

    def _exact(self, sets, sizes, i, j):
        used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
        if not len(used):
            return i, j
        flat = np.concatenate([sets[k] for k in used.tolist()])
        _, number = np.unique(flat, return_inverse=True)
        n = sizes[used]
        starts = np.cumsum(n) - n
        pi, pj = place[: len(i)], place[len(i) :]
        order = np.argsort(pi, kind="stable")
        i, j, pi, pj = i[order], j[order], pi[order], pj[order]
        mark = np.zeros(int(number.max(initial=0)) + 1, np.int64)
        common = np.empty(len(i), np.int64)
        edges = np.flatnonzero(np.diff(pi, prepend=-1, append=-1)).tolist()
        for a, b in zip(edges, edges[1:], strict=False):
            own = number[starts[pi[a]] : starts[pi[a]] + n[pi[a]]]
            mark[own] = 1
            other = pj[a:b]
            size = n[other]
            at = np.cumsum(size) - size
            take = np.repeat(starts[other] - at, size) + np.arange(int(size.sum()))
            common[a:b] = np.add.reduceat(mark[number[take]], at)
            mark[own] = 0
        keep = common * self.bottom >= self.top * (sizes[i] + sizes[j] - common)
        return i[keep], j[keep]


def _signatures(batches, words: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        names, whole = batch.column(0), texts(batch.column(1))
        ids = names.to_pylist()
        for a, b in slices(whole, len, 500_000):
            sets = shingles(whole[a:b], words)
            full = [k for k, s in enumerate(sets) if len(s)]
            values = [b""] * len(sets)
            if full:
                for k, row in zip(full, minhashes([sets[k] for k in full]), strict=True):
                    values[k] = row.tobytes()
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else f"{doc}".encode() for s, doc in zip(sets, ids[a:b], strict=True)]
            yield pa.record_batch([names.slice(a, b - a), pa.array(keys, pa.binary()), pa.array(list(map(len, sets)), pa.int64()), pa.array(values, pa.binary()), batch.column(2).slice(a, b - a)], ["doc_id", "key", "n", "sig", "unnamed"])


def _bands(batches) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
        values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
        hashes = np.zeros(values.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
        for r in range(ROWS):
            hashes = mixed(hashes ^ values[:, :, r])
        yield pa.record_batch([pa.array(signed(hashes.ravel())), pa.array(np.tile(np.arange(BANDS), len(ids))), pa.array(np.repeat(ids, BANDS))], ["band", "place", "class_id"])


def _with_shingles(batches, words: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        whole = texts(batch.column("text"))
        for a, b in slices(whole, len, 500_000):
            part = batch.slice(a, b - a)
            yield pa.record_batch([*(part.column(c) for c in ("comp", "class_id", "members", "sig")), pa.array([s.tobytes() for s in shingles(whole[a:b], words)], pa.binary())], ["comp", "class_id", "members", "sig", "grams"])


def _verified(batches, verifier: Verifier) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit and blocks; yields links and a spanning link of each class in them."""
    key, rows = None, []

    def finish():
        ids = np.array([r[1] for r in rows], np.int64)
        order = np.argsort(ids)
        ids = ids[order]
        pick = [rows[k] for k in order.tolist()]
        members = np.array([r[2] for r in pick], np.int64)
        values = np.frombuffer(b"".join([r[3] for r in pick]), np.uint32).reshape(len(pick), VALUES)
        sets = [np.frombuffer(r[4], np.uint64) for r in pick]
        block = np.array([r[5] for r in pick])
        same = key[2] == key[3]
        left = np.flatnonzero(block == key[2])
        i, j = verifier.pairs(values, sets, left, left if same else np.flatnonzero(block == key[3]), same, key[1])
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, i, members[j])
        np.add.at(links, j, members[i])
        some = np.flatnonzero(links)
        return ids[some], links[some], ids[roots(len(ids), i, j)[some]]

    done: list[tuple] = []
    for batch in pieces(batches):
        columns = [batch.column(c).to_pylist() for c in ("unit", "place", "bi", "bj", "class_id", "members", "sig", "grams", "block")]
        for unit, place, bi, bj, *row in zip(*columns, strict=True):
            if (unit, place, bi, bj) != key:
                if rows:
                    done.append(finish())
                key, rows = (unit, place, bi, bj), []
            rows.append((unit, *row))
        if len(done) > 1000:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*done, strict=True)], ["class_id", "links", "root"])
            done = []
    if rows:
        done.append(finish())
    if done:
        yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*done, strict=True)], ["class_id", "links", "root"])


def jaccard_join(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (4, 5), tolerance: float = 1e-7, block: int = 128) -> DataFrame:
    """For every document: its class, how many others it is linked to, its component, and whether it stays.

    Columns doc_id, class_id (smallest doc_id with the same shingles), n_links (documents with
    similarity of at least the threshold, copies included), component_id (smallest doc_id
    reached by links), kept (doc_id is component_id). Null, empty and blank texts have no
    shingles: they are linked to nothing and are kept. Shorter texts than n words have one
    shingle. doc_id identifies a text; repeated rows count as documents of their own. Rows
    without a doc_id take part under a number made from their text, which is larger than usual
    ids; their doc_id stays null. An empty table gives an empty one; columns other than doc_id
    and text are not read.
    """
    source = docs.select(row_id().alias("doc_id"), F.col("doc_id").isNull().alias("unnamed"), F.col("text").cast("string").alias("text"))
    signed_ = stored(source.select("doc_id", "text", "unnamed").mapInArrow(freed(lambda it: _signatures(it, words)), "doc_id long, key binary, n long, sig binary, unnamed boolean"), "signatures")
    classes = stored(signed_.groupBy("key").agg(F.min(F.struct("doc_id", "n", "sig")).alias("x"), F.count("*").alias("members")).select("key", F.col("x.doc_id").alias("class_id"), F.col("x.n").alias("n"), F.col("x.sig").alias("sig"), "members"), "classes")
    bands = classes.where("n > 0").select("class_id", "sig").mapInArrow(freed(_bands), "band long, place long, class_id long")
    buckets = stored(bands.groupBy("band").agg(F.min("class_id").alias("rep"), F.count("*").alias("c")).where("c > 1"), "buckets")
    joined = connected(bands.join(buckets, "band").where("class_id <> rep").select(F.col("class_id").alias("a"), F.col("rep").alias("b")))
    groups = stored(joined, "groups")
    discard(joined)
    few = classes.select("class_id", "members", "n", "sig").join(groups.select(F.col("id").alias("class_id"), F.col("component").alias("comp")), "class_id")
    members = stored(source.select("doc_id", "text").join(few, F.col("doc_id") == F.col("class_id")).select("comp", "class_id", "members", "sig", "text").dropDuplicates(["class_id"]).mapInArrow(freed(lambda it: _with_shingles(it, words)), "comp long, class_id long, members long, sig binary, grams binary"), "members")
    size = F.col("c").cast("double")
    by_band = buckets.join(groups.select(F.col("id").alias("rep"), F.col("component").alias("comp")), "rep").groupBy("comp").agg(F.sum(size * size + UNIT).alias("by_band"))
    whole = groups.groupBy(F.col("component").alias("comp")).agg(F.count("*").cast("double").alias("whole"))
    sparse = stored(whole.join(by_band, "comp").where("by_band < whole * whole").select("comp"), "sparse")
    dense = members.join(sparse, "comp", "left_anti").withColumnRenamed("comp", "unit").withColumn("place", F.lit(-1).cast("long"))
    in_bands = few.join(sparse, "comp", "left_semi").select("class_id", "sig").mapInArrow(freed(_bands), "band long, place long, class_id long").join(buckets.select("band"), "band")
    banded = in_bands.withColumnRenamed("band", "unit").join(members.drop("comp"), "class_id")
    units = dense.unionByName(banded)
    weights = groups.select(F.col("id").alias("class_id"), F.col("component").alias("comp")).join(classes.select("class_id", "n"), "class_id")
    sizes = stored(
        weights.join(sparse, "comp", "left_anti").select(F.col("comp").alias("unit"), F.lit(-1).cast("long").alias("place"), "n")
        .unionByName(in_bands.join(classes.select("class_id", "n"), "class_id").select(F.col("band").alias("unit"), "place", "n"))
        .groupBy("unit", "place").agg(F.count("*").alias("size"), F.sum(F.col("n") * 8).alias("bytes")), "sizes")
    several = sizes.where("size > 1")
    wide = F.least(F.lit(2048), F.greatest(F.lit(block), F.col("size") / 16))
    blocks = several.select("unit", "place", F.greatest(F.ceil(F.col("size") / wide), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    placed = units.join(blocks, ["unit", "place"]).withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("unit", "place", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "class_id", "members", "sig", "grams", "block")
    verifier = Verifier(threshold, tolerance)
    found = stored(paired.repartition("unit", "place", "bi", "bj").sortWithinPartitions("unit", "place", "bi", "bj").mapInArrow(freed(lambda it: _verified(it, verifier)), "class_id long, links long, root long"), "found")
    discard(members, groups, buckets, sparse, sizes)
    component = connected(found.select(F.col("class_id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    facts = stored(classes.select("key", "class_id", "n", "members").join(links, "class_id", "left").join(component.select(F.col("id").alias("class_id"), "component"), "class_id", "left"), "facts")
    discard(classes, found, component)
    joined = signed_.select("doc_id", "key", "unnamed").join(facts, "key")
    result = joined.select("doc_id", "unnamed", "class_id", F.when(F.col("n") > 0, F.coalesce("links", F.lit(0)) + F.col("members") - 1).otherwise(0).cast("long").alias("n_links"), F.coalesce("component", "class_id").alias("component_id"))
    result = result.select(F.when(~F.col("unnamed"), F.col("doc_id")).alias("doc_id"), "class_id", "n_links", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    return uses(result, signed_, facts)
