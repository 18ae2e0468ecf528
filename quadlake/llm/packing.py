"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens (documents in partition order). A window takes from each
queue its share of tokens; what rounding leaves over or short is a queue's deficit and is
carried to the next window. A cycle of windows takes a whole number of tokens from each
queue, so after it all deficits are zero and the schedule repeats: where any token of any
queue goes has a closed form. Partitions only need to know how many tokens of each queue
stand in the partitions before them; that, with the schedule, is all they carry over.
When a queue runs dry, the others share its part in proportion: a new schedule begins.

Such a schedule's tables grow with the square of the number of queues. With very many, the
places come from virtual time instead: at time v a queue has given weight * v tokens until it
runs dry, window k ends when all have given k windows of tokens, and whole numbers of tokens
follow by rounding each queue alone. That needs two numbers a queue and no tables.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import freed, pieces, stored, texts

END = 2
CYCLE = 32


@dataclass
class Segment:
    """Windows under one schedule. A cycle takes quantum[q] tokens of queue q, of them
    taken[q][i] before its i-th window, where they begin at lead[q][i]."""

    first: int
    windows: int
    base: list[int]
    quantum: list[int]
    taken: list[list[int]]
    lead: list[list[int]]

    @property
    def cycle(self) -> int:
        return len(self.taken[0]) - 1


def _shares(weights: list[float], total: int) -> list[int]:
    """Whole numbers in proportion to the weights, adding up to total; positive weights get 1 at least."""
    active = [i for i, w in enumerate(weights) if w > 0]
    spare, out, scale = total - len(active), [0] * len(weights), sum(weights)
    exact = {i: weights[i] / scale * spare for i in active}
    for i in active:
        out[i] = 1 + int(exact[i])
    for i in sorted(active, key=lambda i: (int(exact[i]) - exact[i], i))[: total - sum(out)]:
        out[i] += 1
    return out


def _rounds(quantum: list[int], window: int, cycle: int) -> list[list[int]]:
    """Deficit round-robin over one cycle: how much of each queue is taken before each window."""
    n = len(quantum)
    deficit, taken = [0] * n, [[0] for _ in quantum]
    for _ in range(cycle):
        deficit = [d + q for d, q in zip(deficit, quantum, strict=True)]  # in 1/cycle tokens
        take = [max(0, d // cycle) for d in deficit]  # below zero: a queue that was ahead
        short = window - sum(take)
        behind = sorted(range(n), key=lambda i: (take[i] * cycle - deficit[i], i))
        for i in behind[: max(0, short)]:
            take[i] += 1
        for i in [i for i in reversed(behind) if take[i]] if short < 0 else []:
            give = min(take[i], -short, 1)
            take[i], short = take[i] - give, short + give
        deficit = [d - t * cycle for d, t in zip(deficit, take, strict=True)]
        for i in range(n):
            taken[i].append(taken[i][-1] + take[i])
    return taken


def _leads(taken: list[list[int]]) -> list[list[int]]:
    at, out = [0] * (len(taken[0]) - 1), []
    for row in taken:
        out.append(list(at))
        at = [a + y - x for a, x, y in zip(at, row, row[1:], strict=False)]
    return out


def schedule(totals: list[int], weights: list[float], window: int, cycle: int = CYCLE) -> list[Segment]:
    """Segments that use up all queues; there are at most about two for each queue."""
    left, served, first, out = list(totals), [0] * len(totals), 0, []
    while any(left):
        live = [w if n else 0 for w, n in zip(weights, left, strict=True)]
        if not any(live):
            live = [float(n > 0) for n in left]
        queues = [i for i, w in enumerate(live) if w > 0]
        if not queues:
            break
        quantum = _shares(live, window * cycle)
        taken = _rounds(quantum, window, cycle)
        cycles = min(left[i] // quantum[i] for i in queues)
        rest = [left[i] - cycles * quantum[i] for i in range(len(left))]
        more = min(bisect_right(taken[i], rest[i]) - 1 for i in queues)
        windows = cycles * cycle + min(more, cycle - 1)
        if windows:
            out.append(Segment(first, windows, list(served), quantum, taken, _leads(taken)))
            for i in queues:
                got = cycles * quantum[i] + taken[i][min(more, cycle - 1)]
                left[i] -= got
                served[i] += got
            first += windows
        # One window that some queue cannot fill: the others give more.
        take = [min(left[i], taken[i][1]) for i in range(len(left))]
        while (short := min(window, sum(left)) - sum(take)) > 0:
            open_ = [live[i] if left[i] > take[i] else 0 for i in range(len(left))]
            if not any(open_):
                open_ = [float(left[i] > take[i]) for i in range(len(left))]
            n = sum(x > 0 for x in open_)
            extra = _shares(open_, short) if short >= n else [1 if i in {j for j, x in enumerate(open_) if x > 0 and sum(y > 0 for y in open_[:j]) < short} else 0 for i in range(len(left))]
            take = [min(left[i], take[i] + extra[i]) for i in range(len(left))]
        if sum(take):
            taken = [[0, t] for t in take]
            out.append(Segment(first, 1, list(served), take, taken, _leads(taken)))
            left = [a - b for a, b in zip(left, take, strict=True)]
            served = [a + b for a, b in zip(served, take, strict=True)]
            first += 1
    return out


class Places:
    """Where tokens [a, b) of a queue go: runs of (from, length, sequence, offset)."""

    def __init__(self, segments: list[Segment], window: int, length: int):
        self.segments, self.window, self.length = segments, window, length
        self.bases = [[s.base[q] for s in segments] for q in range(len(segments[0].base))] if segments else []

    def of(self, queue: int, a: int, b: int):
        bases, p = self.bases[queue], a
        k = bisect_right(bases, p) - 1
        while p < b:
            while k + 1 < len(bases) and bases[k + 1] <= p:
                k += 1
            s = self.segments[k]
            limit = min(b, bases[k + 1]) if k + 1 < len(bases) else b
            quantum, taken, lead = s.quantum[queue], s.taken[queue], s.lead[queue]
            while p < limit:
                cycle, r = divmod(p - s.base[queue], quantum)
                i = bisect_right(taken, r) - 1
                stop = min(limit, p + taken[i + 1] - r)
                at = (s.first + cycle * s.cycle + i) * self.window + lead[i] + r - taken[i]
                while p < stop:
                    sequence, offset = divmod(at, self.length)
                    n = min(stop - p, self.length - offset)
                    yield p, n, sequence, offset
                    p, at = p + n, at + n


class VirtualPlaces:
    """Like Places, for any number of queues; a block of about a window holds each queue's share within one token.

    A queue's tokens before block k are its exact share of k windows, rounded at a phase of its
    own, so that blocks differ little from whole windows. Queues without a weight come after
    all others, with equal shares.
    """

    def __init__(self, totals: list[int], weights: list[float], window: int, length: int):
        self.window, self.length = window, length
        self.totals, self.weights = np.array(totals, np.int64), np.array(weights, np.float64)
        self.phase = np.arange(1, len(totals) + 1) * 0.6180339887498949 % 1
        late = (self.weights <= 0) & (self.totals > 0)
        self.blocks = -(-int(self.totals.sum()) // window)
        self.rate = np.where(self.weights > 0, self.weights, 1.0)
        ends = self.totals / self.rate
        self.start = np.where(late, ends[~late].max(initial=0.0), 0.0)
        times, at = np.unique(np.concatenate([self.start, self.start + ends]), return_inverse=True)
        speed = np.bincount(at[: len(ends)], self.rate, len(times)) - np.bincount(at[len(ends) :], self.rate, len(times))
        served = np.concatenate([[0.0], np.cumsum(np.maximum(np.cumsum(speed), 0)[:-1] * np.diff(times))])
        self.times, self.served = times, np.maximum.accumulate(served)
        self.known: dict[int, tuple] = {}
        self.most = max(4, 2_000_000 // max(1, len(totals)))

    def _taken(self, k: int, queue=slice(None)):
        """Tokens of the queues before block k."""
        if k <= 0:
            return self.totals[queue] * 0
        if k >= self.blocks:
            return self.totals[queue]
        v = np.interp(float(k) * self.window, self.served, self.times)
        given = np.maximum(v - self.start[queue], 0) * self.rate[queue]
        return np.minimum(self.totals[queue], np.floor(given + self.phase[queue]).astype(np.int64))

    def _block(self, k: int) -> tuple:
        """What each queue has given before block k, has given after it, and where its part begins."""
        if k not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            a, b = self._taken(k), self._taken(k + 1)
            self.known[k] = (a, b, int(a.sum()) + np.cumsum(b - a) - (b - a))
        return self.known[k]

    def _holding(self, queue: int, p: int) -> int:
        """The block with token p of a queue."""
        v = self.start[queue] + (p + 1 - self.phase[queue]) / self.rate[queue]
        k = min(max(int(np.interp(v, self.times, self.served) / self.window), 0), self.blocks - 1)
        while self._taken(k, queue) > p:
            k -= 1
        while self._taken(k + 1, queue) <= p:
            k += 1
        return k

    def of(self, queue: int, a: int, b: int):
        p = a
        while p < b:
            before, after, begins = self._block(self._holding(queue, p))
            stop = min(b, int(after[queue]))
            at = int(begins[queue]) + p - int(before[queue])
            while p < stop:
                sequence, offset = divmod(at, self.length)
                n = min(stop - p, self.length - offset)
                yield p, n, sequence, offset
                p, at = p + n, at + n


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """Every document's ids, its queue, and the tokens of that queue before it in its partition; stored."""

    def run(batches):
        enc, part, before = encoder(path, "<u2", False), TaskContext.get().partitionId(), {}
        for batch in pieces(batches):
            names, sources, whole = batch.column(0), batch.column(1).to_pylist(), texts(batch.column(2))
            for a, done in enc.encode_texts(whole):
                ids = [i + END.to_bytes(2, "little") for i, _ in done]
                n = [len(i) // 2 for i in ids]
                at = []
                for q, k in zip(sources[a : a + len(n)], n, strict=True):
                    at.append(before.get(q, 0))
                    before[q] = at[-1] + k
                yield pa.record_batch([names.slice(a, len(n)), pa.array(sources[a : a + len(n)], pa.string()), pa.array([part] * len(n), pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "queue", "part", "at", "n", "ids"])

    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("queue"), "text")
    return stored(rows.mapInArrow(freed(run), "doc_id long, queue string, part long, at long, n long, ids binary"), "tokens")


def pack(docs: DataFrame, path: str, length: int = 4096, window_sequences: int = 8, weights: dict[str, float] | None = None, max_queues: int = 1024) -> DataFrame:
    """Pieces of documents in sequences of `length` tokens, mixed by source.

    Every window of `window_sequences` sequences holds the sources in proportion to `weights`
    (default: the corpus's own proportions; sources without a weight come last). Only the last
    sequence may be shorter than `length`. A null source is the queue ''. With over max_queues
    sources the shares are kept by virtual time, where a window's ends may be off by some
    tokens; every source stays a queue. Totals of all sources are held by the driver and, as
    numbers, by the workers. Null and empty texts consist of the end id alone;
    repeated rows are packed once each; an empty table gives an empty one; other columns are
    not read.
    """
    spark, window = docs.sparkSession, length * window_sequences
    tokens = tokenized(docs, path)
    sums = stored(tokens.groupBy("part", "queue").agg(F.sum("n").alias("n")), "sums")
    totals = {r.queue: r.n for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    queues = sorted(totals)
    sizes = [totals[q] for q in queues]
    wanted = [float(totals[q]) if weights is None else float(weights.get(q, 0)) for q in queues]
    segments = schedule(sizes, wanted, window) if len(queues) <= max_queues else None
    before = sums.select("part", "queue", (F.sum("n").over(Window.partitionBy("queue").orderBy("part")) - F.col("n")).alias("base"))
    if sums.count() <= 200_000:
        before = F.broadcast(before)
    number = {q: i for i, q in enumerate(queues)}
    plan = spark.sparkContext.broadcast((segments, number, (sizes, wanted) if segments is None else None))

    def run(batches):
        segments, number, shares = plan.value
        places = Places(segments, window, length) if shares is None else VirtualPlaces(*shares, window, length)
        for batch in pieces(batches):
            rows = []
            for doc, queue, base, n, ids in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                packed = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                for p, k, sequence, offset in places.of(number[queue], base, base + n):
                    start = p - base
                    rows.append((doc, start, k, zlib.crc32(packed[4 * start : 4 * (start + k)]), n, sequence, offset, queue))
            if rows:
                *numbers, names = zip(*rows, strict=True)
                yield pa.record_batch([*(pa.array(x, pa.int64()) for x in numbers), pa.array(names, pa.string())], FIELDS)

    placed = tokens.join(before, ["part", "queue"]).select("doc_id", "queue", (F.col("base") + F.col("at")).alias("base"), "n", "ids")
    return placed.mapInArrow(freed(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string")


FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"]
