"""Embedding near-duplicates by hierarchical navigable small-world graphs, one per shard.

Nodes are ordered by level, so a layer is a prefix of the nodes. Nodes are inserted in
batches and searched for in batches: one numpy step expands the best unexpanded node of the
beam of every query of a batch. Every shard is asked for every vector: a task gets one shard's
graph once and a slice of the vectors. A beam whose worst entry still is a link is too narrow
for its query and is widened for it; a sample of each slice is compared with brute force, and
all beams are widened until the audit passes. Queries whose widest beam is full, and slices
whose audit never passes, are compared with the whole shard.

A pair counts for both of its ends, whichever search found it: each vector's found links are
summed up by count and by hash from either side, and vectors whose sums differ are compared
with all shards once more by brute force.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, freed, mixed, stored
from .components import connected, roots

LINKS, BUILD_BEAM, BEAM, WIDEST = 12, 40, 40, 640
#: An audit compares queries until it has seen so many with links, or so many at all.
ENOUGH, AUDIT, RECALL = 100, 1024, 0.98


def _beam(queries: np.ndarray, vectors: np.ndarray, links: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The best `width` nodes found for each query and their similarities, best first (-1: none)."""
    n = len(queries)
    ids = np.full((n, width), -1, np.int64)
    sims = np.full((n, width), -np.inf, np.float32)
    open_ = np.zeros((n, width), bool)
    seen = np.zeros((n, len(links)), bool)
    k = min(width, entries.shape[1])
    first = entries[:, :k]
    ids[:, :k] = first
    sims[:, :k] = np.where(first >= 0, np.einsum("nkd,nd->nk", vectors[first], queries), -np.inf)
    open_[:, :k] = first >= 0
    np.put_along_axis(seen, np.maximum(first, 0), True, 1)
    live = np.arange(n)
    while len(live):
        score = np.where(open_[live], sims[live], -np.inf)
        at = score.argmax(1)
        some = open_[live, at]
        live, at = live[some], at[some]
        if not len(live):
            break
        open_[live, at] = False
        near = links[ids[live, at]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        seen[live[:, None], np.where(fresh, near, ids[live, at][:, None])] = True
        new = np.where(fresh, np.einsum("nkd,nd->nk", vectors[near], queries[live]), -np.inf).astype(np.float32)
        all_sims = np.concatenate([sims[live], new], 1)
        top = np.argpartition(-all_sims, width - 1, 1)[:, :width]
        sims[live] = np.take_along_axis(all_sims, top, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, near, -1)], 1), top, 1)
        open_[live] = np.take_along_axis(np.concatenate([open_[live], fresh], 1), top, 1)
    order = np.argsort(-sims, 1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _diverse(vectors: np.ndarray, candidates: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` of each row's candidates (best first): those nearer to the row than to any taken one, then others."""
    n, width = candidates.shape
    taken = np.full((n, most), -1, np.int64)
    count = np.zeros(n, np.int64)
    used = np.zeros((n, width), bool)
    for strict in (True, False):
        for k in range(width):
            c = candidates[:, k]
            ok = (c >= 0) & (count < most) & ~used[:, k]
            if not ok.any():
                continue
            rows = np.flatnonzero(ok)
            if strict:
                others = taken[rows]
                near = np.where(others >= 0, np.einsum("nkd,nd->nk", vectors[others], vectors[c[rows]]), -np.inf).max(1)
                rows = rows[near < sims[rows, k]]
            taken[rows, count[rows]] = c[rows]
            count[rows] += 1
            used[rows, k] = True
    return taken


class Graph:
    """A small-world graph over unit vectors."""

    def __init__(self, ids: np.ndarray, members: np.ndarray, raw: np.ndarray):
        rng = np.random.default_rng(len(ids))
        level = np.floor(-np.log(rng.random(len(ids))) / np.log(LINKS)).astype(int)
        order = np.lexsort((rng.permutation(len(ids)), -level))
        self.ids, self.members, self.raw = ids[order], members[order], raw[order]
        self.vectors = unit(self.raw)
        self.layers: list[np.ndarray] = []
        for at in range(level.max(initial=0), -1, -1):
            self.layers.insert(0, self._layer(int((level >= at).sum())))

    def _layer(self, n: int) -> np.ndarray:
        links = np.full((n, 2 * LINKS), -1, np.int64)
        done, v = 0, self.vectors
        while done < n:
            size = min(n - done, max(256, min(done, 1024)))
            fresh = np.arange(done, done + size)
            own = v[fresh] @ v[fresh].T
            np.fill_diagonal(own, -np.inf)
            k = min(BUILD_BEAM, size)
            near = np.argpartition(-own, k - 1, 1)[:, :k]
            ids, sims = near + done, np.take_along_axis(own, near, 1)
            if done:
                found, got = _beam(v[fresh], v, links[:done], self._entries(v[fresh], done), BUILD_BEAM)
                ids, sims = np.concatenate([found, ids], 1), np.concatenate([got, sims], 1)
            ids = np.where(np.isfinite(sims), ids, -1)
            best = np.argsort(-sims, 1, kind="stable")[:, :BUILD_BEAM]
            ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
            chosen = _diverse(v, ids, sims, LINKS)
            links[fresh, :LINKS] = chosen
            self._back(links, fresh, chosen)
            done += size
        return links

    def _entries(self, queries: np.ndarray, below: int) -> np.ndarray:
        """Where to enter the layer under those built so far."""
        entry = np.zeros((len(queries), 1), np.int64)
        for layer in self.layers[::-1]:
            entry = _beam(queries, self.vectors, layer, entry, 8)[0][:, :1]
        return np.where(entry < below, entry, 0)

    def _back(self, links: np.ndarray, fresh: np.ndarray, chosen: np.ndarray) -> None:
        to, whence = chosen.ravel(), np.repeat(fresh, chosen.shape[1])
        whence, to = whence[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, whence = to[order], whence[order]
        node, first, count = np.unique(to, return_index=True, return_counts=True)
        width = min(int(count.max(initial=0)), 64)
        slot = first[:, None] + np.arange(width)
        more = np.where(np.arange(width) < count[:, None], whence[np.minimum(slot, len(whence) - 1)], -1) if len(node) else np.empty((0, 0), np.int64)
        for a in range(0, len(node), 1024):
            part = node[a : a + 1024]
            both = np.concatenate([links[part], more[a : a + 1024]], 1)
            twice = np.zeros_like(both, bool)
            s = np.sort(both, 1)
            if (s[:, 1:] == s[:, :-1]).any():
                for k in range(1, both.shape[1]):
                    twice[:, k] = (both[:, :k] == both[:, k : k + 1]).any(1)
            both = np.where(twice, -1, both)
            sims = np.where(both >= 0, np.einsum("nkd,nd->nk", self.vectors[both], self.vectors[part]), -np.inf)
            best = np.argsort(-sims, 1, kind="stable")
            links[part] = _diverse(self.vectors, np.take_along_axis(both, best, 1), np.take_along_axis(sims, best, 1), links.shape[1])

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.zeros((len(queries), 1), np.int64)
        for layer in self.layers[:0:-1]:
            entry = _beam(queries, self.vectors, layer, entry, 8)[0][:, :1]
        return _beam(queries, self.vectors, self.layers[0], entry, min(width, max(1, len(self.ids))))

    def scan(self, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (query, node) of at least that similarity, by brute force."""
        step = max(1, 8_000_000 // max(1, len(self.ids)))
        found = [np.nonzero(queries[a : a + step] @ self.vectors.T >= least) for a in range(0, len(queries), step)]
        none = np.empty(0, np.int64)
        return np.concatenate([none, *(r + k * step for k, (r, _) in enumerate(found))]), np.concatenate([none, *(c for _, c in found)])

    def near(self, queries: np.ndarray, least: float, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) of at least that similarity; widens the beams of queries that they fill."""
        rows, nodes = [], []
        left = np.arange(len(queries))
        while len(left) and width <= WIDEST:
            full = []
            step = max(1, 200_000 // width)
            for a in range(0, len(left), step):
                part = left[a : a + step]
                ids, sims = self.search(queries[part], width)
                hit = (sims >= least) & (ids >= 0)
                filled = hit[:, -1] & (ids.shape[1] < len(self.ids))
                r, c = np.nonzero(hit & ~filled[:, None])
                rows.append(part[r])
                nodes.append(ids[r, c])
                full.append(part[filled])
            left, width = np.concatenate(full), 4 * width
        if len(left):
            r, c = self.scan(queries[left], least)
            rows.append(left[r])
            nodes.append(c)
        none = np.empty(0, np.int64)
        return np.concatenate([none, *rows]), np.concatenate([none, *nodes])

    def audited(self, queries: np.ndarray, least: float, width: int, recall: float) -> tuple[int, int, int]:
        """The width of beams with that recall for a sample of the queries (0: only brute force has it).

        Recall is the mean share of its links that a query with links finds; then, in thousandths,
        the queries with links and the sum of their shares.
        """
        sample = np.random.default_rng(len(queries)).permutation(len(queries))[:AUDIT]
        links = np.zeros(len(sample), np.int64)
        some = 0
        while some < len(sample) and np.count_nonzero(links) < ENOUGH:
            links[some : some + 64] = np.bincount(self.scan(queries[sample[some : some + 64]], least)[0], minlength=len(sample[some : some + 64]))
            some += 64
        asked = np.flatnonzero(links)
        true = 1000 * len(asked)
        while width <= WIDEST and len(asked):
            got = np.bincount(self.near(queries[sample[asked]], least, width)[0], minlength=len(asked))
            share = int((1000 * np.minimum(got, links[asked]) // links[asked]).sum())
            if share >= recall * true or width >= len(self.ids):
                return width, true, share
            width *= 2
        return 0 if len(asked) else width, true, true

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, members=self.members, raw=self.raw, **{f"layer{i}": x.astype(np.int32) for i, x in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Graph:
        self, x = cls.__new__(cls), np.load(io.BytesIO(data))
        self.ids, self.members, self.raw = x["ids"], x["members"], x["raw"]
        self.vectors = unit(self.raw)
        self.layers = [x[f"layer{i}"].astype(np.int64) for i in range(sum(k.startswith("layer") for k in x))]
        return self


def unit(raw: np.ndarray) -> np.ndarray:
    v = raw.astype(np.float64)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows, in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a * b).sum(1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))


def _values(column: pa.Array) -> np.ndarray:
    """Lists of equal length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _build(batches) -> Iterator[pa.RecordBatch]:
    """One graph of the rows of each dimension and shard, sorted by them."""
    key, parts = None, []

    def graph():
        ids, members, raw = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.record_batch([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([Graph(ids, members, raw).packed()], pa.binary())], ["dim", "shard", "graph"])

    for batch in batches:
        for own, part in _by_key(batch, 2):
            if own != key:
                if parts:
                    yield graph()
                key, parts = own, []
            parts.append((part.column(2).to_numpy(zero_copy_only=False), part.column(3).to_numpy(zero_copy_only=False), _values(part.column(4))))
    if parts:
        yield graph()


def _by_key(batch: pa.RecordBatch, columns: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The rows of a batch in runs of equal first columns."""
    keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(columns)], 1)
    edges = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))) if len(keys) else []
    for a, b in zip(edges, [*edges[1:], len(keys)], strict=True):
        yield tuple(keys[a].tolist()), batch.slice(a, b - a)


def _search(batches, least: float, exact: bool, beam: int, recall: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by dimension, shard and slice, each with the shard's graph first."""
    key, graph, ids, raw = None, None, [], []

    def finish():
        if graph is None or not ids:
            return
        opened = Graph.unpacked(graph)
        yield from _linked(opened, np.concatenate(ids), np.concatenate(raw), least, exact, beam, recall)

    for batch in batches:
        for own, part in _by_key(batch, 3):
            if own != key:
                yield from finish()
                key, graph, ids, raw = own, None, [], []
            at = 0
            if graph is None:
                graph, at = part.column("graph")[0].as_py(), 1
            if part.num_rows > at:
                part = part.slice(at)
                ids.append(part.column("class_id").to_numpy(zero_copy_only=False).astype(np.int64))
                raw.append(_values(part.column("v")))
    yield from finish()


LINKED = "class_id long, links long, found long, found_hash long, met long, met_hash long, root long, true long, audited long"


def _linked(graph: Graph, ids: np.ndarray, raw: np.ndarray, least: float, exact: bool, beam: int, recall: float) -> Iterator[pa.RecordBatch]:
    """What a slice's search says of its vectors (links found) and of the shard's (found by others); an audit's counts."""
    names = [x.split()[0] for x in LINKED.split(", ")]
    queries, low = unit(raw), least - 1e-5
    width, true, got = (0, 0, 0) if exact else graph.audited(queries, low, beam, recall)
    yield pa.record_batch([pa.array([x], pa.int64()) for x in (None, 0, 0, 0, 0, 0, None, true, got)], names)
    step = 512
    for a in range(0, len(ids), step):
        part = queries[a : a + step]
        q, v = graph.near(part, low, width) if width else graph.scan(part, low)
        q = q + a
        keep = [((ids[q[b:c]] != graph.ids[v[b:c]]) & (cosines(raw[q[b:c]], graph.raw[v[b:c]]) >= least)) for b, c in ((b, b + 100_000) for b in range(0, len(q), 100_000))]
        keep = np.concatenate(keep) if keep else np.empty(0, bool)
        q, v = q[keep], v[keep]
        if not len(q):
            continue
        x, y = ids[q], graph.ids[v]
        both = mixed(np.minimum(x, y).view(np.uint64)) + np.maximum(x, y).view(np.uint64)
        code = (mixed(both) >> np.uint64(34)).astype(np.int64)
        classes, place = np.unique(np.concatenate([x, y]), return_inverse=True)
        i, j, n = place[: len(x)], place[len(x) :], len(classes)

        def total(at, values=None):
            return np.bincount(at, values, n).astype(np.int64)

        out = [classes, total(i, graph.members[v]), total(i), total(i, code), total(j), total(j, code), classes[roots(n, i, j)]]
        yield pa.record_batch([*(pa.array(c, pa.int64()) for c in out), pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, np.int64))], names)


def near_duplicates(vectors: DataFrame, least: float = 0.95, shard_size: int = 50_000, shards: int = 8, slice_size: int = 20_000, beam: int = BEAM, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For every vector: its links, the smallest id of its component, and whether it stays.

    Columns vec_id, n_links, component_id, kept, and audited_recall (of all slices' samples
    against brute force, before verification; null where they held no links). Links have a
    cosine of at least `least` in double precision. Vectors that are null, zero or hold null or
    non-finite components are linked to nothing and are kept, as are vectors of different
    lengths among each other. Equal vectors are one class, searched once, and count as links of
    each other; repeated rows count as vectors of their own. An empty table gives an empty one;
    other columns are not read.
    """
    held = vectors.schema[vector_col].dataType
    kind = "array<float>" if getattr(held, "elementType", None) is not None and held.elementType.simpleString() == "float" else "array<double>"
    source = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast(kind).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = source.where(F.col("v").isNotNull() & finite & F.col("vec_id").isNotNull())
    classes = stored(good.groupBy("v").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("members")), "classes")
    total = classes.count()
    n_shards, n_slices = max(shards, -(-total // shard_size)), max(1, -(-total // slice_size))
    dim = F.size("v").cast("long").alias("dim")
    shard = F.pmod(F.xxhash64("class_id"), F.lit(n_shards)).alias("shard")
    graphs = stored(classes.select(dim, shard, "class_id", "members", "v").repartition("dim", "shard").sortWithinPartitions("dim", "shard", "class_id").mapInArrow(freed(_build), "dim long, shard long, graph binary"), "graphs")

    def asked(queries: DataFrame, slices: int, exact: bool) -> DataFrame:
        """The links of those vectors: each shard's graph goes to every slice, each vector to every shard."""

        def numbers(n: int):
            return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

        part = F.pmod(F.xxhash64("class_id", F.lit(1)), F.lit(slices)).alias("slice")
        rows = queries.select(dim, numbers(n_shards).alias("shard"), part, "class_id", "v", F.lit(None).cast("binary").alias("graph"))
        opened = graphs.select("dim", "shard", numbers(slices).alias("slice"), F.lit(None).cast("long").alias("class_id"), F.lit(None).cast(kind).alias("v"), "graph")
        dealt = rows.unionByName(opened).repartition(n_shards * slices, "dim", "shard", "slice").sortWithinPartitions("dim", "shard", "slice", F.col("class_id").asc_nulls_first())
        return stored(dealt.mapInArrow(freed(lambda it: _search(it, least, exact, beam, recall)), LINKED), "links")

    found = asked(classes, n_slices, False)
    audit = found.agg(F.sum("true").alias("true"), F.sum("audited").alias("audited")).first()
    sums = found.where("class_id IS NOT NULL").groupBy("class_id").agg(*[F.sum(c).alias(c) for c in ("links", "found", "found_hash", "met", "met_hash")])
    sums = stored(sums.select("class_id", "links", F.expr("found <> met OR found_hash <> met_hash").alias("uneven")), "sums")
    links, edges = sums.select("class_id", "links"), found
    uneven = sums.where("uneven").count()
    if uneven:
        again = asked(classes.join(sums.where("uneven").select("class_id"), "class_id", "left_semi"), max(1, -(-uneven // slice_size)), True)
        exact = again.groupBy("class_id").agg(F.sum("links").alias("links"))
        links = links.join(sums.where("uneven").select("class_id"), "class_id", "left_anti").union(exact.join(sums.where("uneven").select("class_id"), "class_id", "left_semi"))
        edges = found.unionByName(again)
    component = connected(edges.select(F.col("class_id").alias("a"), F.col("root").alias("b")))
    facts = stored(classes.join(links, "class_id", "left").join(component.select(F.col("id").alias("class_id"), "component"), "class_id", "left"), "facts")
    discard(classes, graphs, found, sums, component, *([again] if uneven else []))
    measured = F.lit(min(1.0, audit.audited / audit.true) if audit.true else None).cast("double").alias("audited_recall")
    joined = source.join(facts, "v", "left")
    result = joined.select("vec_id", F.coalesce(F.coalesce("links", F.lit(0)) + F.col("members") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "class_id", "vec_id").alias("component_id"))
    return result.select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"), measured)
