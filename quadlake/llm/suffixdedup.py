"""Exact substring deduplication with enhanced suffix arrays over content-anchored contexts.

Every window of `width` bytes has an anchor: its gram (a quarter of the width) of least hash,
the leftmost if tied. Equal windows have equal anchors at equal places, so only occurrences of
one anchor need be compared. The windows that share one occurrence are a run; its bytes are a
context. Equal contexts are one class, and a class seen twice is repeated as a whole. The
contexts of an anchor are sorted by what follows the anchor's start (a suffix array of the
anchored suffixes, with common-prefix lengths); a stack scan yields the common-prefix interval
tree from the leaves up. An interval's members are kept sorted by what stands to their left,
smaller sets joining larger ones, so that every member knows the longest left extension that it
shares with any other: where the lefts are diverse, that is where the repeat ends. Together
these are all windows that any two members share.

An anchor with more than MOST different contexts (a passage in a third of all documents) is
split: windows that reach at least half way to the left share a longer anchor, and all others
reach at least half way to the right and share another one. Each half's contexts are trimmed to
the bytes its windows can reach; those that become equal are repeated over the whole half, one
of them stays to be compared with the others, and halves that still are too large are split
again. So no task holds more than MOST contexts, and the halves shrink to a single window.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, freed, pieces, PrefixHash, row_id, signed, slices, texts, written

#: Bytes of a string that is removed where it repeats; bytes of the strings that passages consist
#: of, and words of a passage: what white space separates.
WIDTH, PASSAGE, WORDS = 400, 200, 51
MOST = 4096


def sliding_least(keys: np.ndarray, span: int) -> np.ndarray:
    """The minimum of every `span` neighbours, from prefix and suffix minima of blocks."""
    n = len(keys) - span + 1
    size = -len(keys) % span
    blocks = np.append(keys, np.full(size, np.iinfo(keys.dtype).max, keys.dtype)).reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[span - 1 : span - 1 + n])


def runs(data: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in texts data[begin:end]: text, first window, windows,
    anchor's place after the first window, hash of the anchor, hash of the context."""
    none, gram = np.empty(0, np.int64), width // 4
    n = np.maximum(end - begin - width + 1, 0)
    whose = np.repeat(np.arange(len(n)), n)
    if not len(whose):
        return none, none, none, none, none, none
    grams = PrefixHash(data).windows(gram)
    low = np.uint64((1 << 24) - 1)
    least = sliding_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), width - gram + 1)
    window = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(len(whose))
    at = (least[window] & low).astype(np.int64)
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (whose[1:] != whose[:-1])))
    count = np.diff(np.append(first, len(window)))
    start, raw, hashed = window[first], data.tobytes(), xxhash.xxh3_64_intdigest
    contexts = np.fromiter((hashed(raw[a:b]) for a, b in zip(start.tolist(), (start + count + width - 1).tolist(), strict=True)), np.uint64, len(start))
    return whose[first], start - begin[whose[first]], count, at[first] - start, signed(grams[at[first]]), signed(contexts)


def _run_rows(batches, width: int) -> Iterator[pa.RecordBatch]:
    """The runs of each text (columns id, text), or of its spans if a third column has them."""
    step = 4_000_000
    for batch in pieces(batches):
        names, whole = batch.column(0), [x.encode() for x in texts(batch.column(1))]
        ids = names.to_numpy(zero_copy_only=False)
        within = batch.column(2).to_pylist() if batch.num_columns > 2 else None
        for a, b in slices(whole, len, 500_000):
            parts, begin = [], []
            for k in range(a, b):
                own = [(0, len(whole[k]))] if within is None else _merged(np.frombuffer(b"".join(within[k]), np.int64).reshape(-1, 2)).tolist()
                for lo, hi in own:
                    for at in range(lo, max(lo + 1, hi - width + 1), step):
                        if hi - at >= width:
                            parts.append(whole[k][at : min(hi, at + step + width - 1)])
                            begin.append((k, at))
            for i, j in slices(parts, len, 500_000):
                size = np.fromiter(map(len, parts[i:j]), np.int64, j - i)
                ends = np.cumsum(size)
                whose, start, n, place, m, u = runs(np.frombuffer(b"".join(parts[i:j]), np.uint8), ends - size, ends, width)
                if not len(whose):
                    continue
                doc, shift = np.array(begin[i:j], np.int64).T
                start, whose = start + shift[whose], doc[whose]
                order = np.lexsort((start, n, u, m, whose))  # equal contexts of a text make one row
                whose, start, n, place, m, u = (x[order] for x in (whose, start, n, place, m, u))
                same = (whose[1:] == whose[:-1]) & (m[1:] == m[:-1]) & (u[1:] == u[:-1]) & (n[1:] == n[:-1])
                first = np.flatnonzero(np.append(True, ~same))
                starts = pa.ListArray.from_arrays(pa.array(np.append(first, len(start)), pa.int32()), pa.array(start, pa.int64()))
                yield pa.record_batch([pa.array(ids[whose[first]], pa.int64()), pa.array(m[first]), pa.array(u[first]), pa.array(n[first]), pa.array(place[first]), starts], ["doc_id", "m", "u", "n", "place", "starts"])


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def shared_extensions(contexts: list[bytes], places: list[int]) -> Iterator[tuple[int, int, int]]:
    """The common-prefix interval tree, leaves first: (prefix length, member, left extension).

    A member's left extension in an interval is the longest that it shares with any other
    member; it is given where it is longer than in all intervals inside, which have longer
    prefixes. places[i] is where the anchor, from which prefixes count, starts in contexts[i].
    """
    right = [c[p:] for c, p in zip(contexts, places, strict=True)]
    left = [c[:p][::-1] for c, p in zip(contexts, places, strict=True)]
    by_left = sorted(range(len(left)), key=left.__getitem__)
    rank = [0] * len(left)
    for i, k in enumerate(by_left):
        rank[k] = i
    best = [-1] * len(left)

    def joined(a: list[int], b: list[int], length: int) -> Iterator[tuple[int, int, int]]:
        """Puts the smaller set of ranks into the larger one, which `kept` then holds."""
        nonlocal kept
        small, kept = (a, b) if len(a) < len(b) else (b, a)
        for x in small:
            at = bisect_left(kept, x)
            beside = ([kept[at - 1]] if at else []) + ([kept[at]] if at < len(kept) else [])
            kept.insert(at, x)
            for y in beside:
                i, j = by_left[x], by_left[y]
                extension = common(left[i], left[j])
                for k in (i, j):
                    if extension > best[k]:
                        best[k] = extension
                        yield length, k, extension

    order = sorted(range(len(right)), key=right.__getitem__)
    stack: list[tuple[int, list[int]]] = []
    for i, k in enumerate(order):
        lcp = common(right[k], right[order[i + 1]]) if i + 1 < len(order) else 0
        kept = [rank[k]]
        while stack and stack[-1][0] >= max(lcp, 1):
            length, members = stack.pop()
            yield from joined(members, kept, length)
            if length == lcp:
                break
        if lcp:
            stack.append((lcp, kept))


def repeated_windows(contexts: list[bytes], places: list[int], counts: list[int], width: int = WIDTH) -> list[list[tuple[int, int]]]:
    """For each context, ranges [a, b) that cover just its windows that stand in another one too."""
    found: list[list[tuple[int, int]]] = [[] for _ in contexts]
    for length, k, extension in shared_extensions(contexts, places):
        a, b = max(0, places[k] - extension), min(counts[k] - 1, places[k] - width + length)
        if a <= b:
            found[k].append((a, b + 1))
    return found


FOUND = "m long, u long, n long, ranges binary"


def _by_suffix(batches, width: int) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by key, m, u and n; ranges of repeated windows for those that are not whole repeats.

    A context's windows are those numbered from `first`, if it is a part of a class's context.
    """
    key, rows, done = None, [], []

    def finish():
        found = repeated_windows([r[6] for r in rows], [r[5] for r in rows], [len(r[6]) - width + 1 for r in rows], width)
        done.extend((*r[:3], (np.array(f, "<u4") + r[4]).astype("<u4").tobytes()) for r, f in zip(rows, found, strict=True) if f and r[3] == 1)

    def out():
        return pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["m", "u", "n", "ranges"])

    for batch in pieces(batches):
        for k, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "m", "u", "n", "c", "first", "place", "context")), strict=True):
            if k != key:
                if len(rows) > 1:
                    finish()
                key, rows = k, []
            if not rows or rows[-1][:3] != row[:3]:  # repeated rows of a document bring a context twice
                rows.append(row)
        if len(done) > 2000:
            yield out()
            done = []
    if len(rows) > 1:
        finish()
    if done:
        yield out()


def _halves(batches, width: int) -> Iterator[pa.RecordBatch]:
    """Each context's part in the two halves of its group's left extensions lo to hi."""
    for batch in pieces(batches):
        rows = []
        for key, m, u, n, first, place, lo, hi, context in zip(*(batch.column(c).to_pylist() for c in ("key", "m", "u", "n", "first", "place", "lo", "hi", "context")), strict=True):
            middle = (lo + hi) // 2
            for a, b in ((lo, middle), (middle + 1, hi)):
                # windows of left extension a to b: all have the a bytes before the anchor and width - b from it
                if a <= b and place >= a and len(context) - place >= width - b:
                    cut = max(0, place - b)
                    part = context[cut : place + width - a]
                    gram = context[place - a : place + width - b]
                    rows.append((signed64(xxhash.xxh3_64_intdigest(gram, seed=(key ^ a) & (1 << 64) - 1)), m, u, n, first + cut, place - cut, a, b, xxhash.xxh3_128_digest(part), part))
        if rows:
            yield pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 8, pa.binary(), pa.binary()), strict=True)], ["key", "m", "u", "n", "first", "place", "lo", "hi", "digest", "context"])


def signed64(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _split(many: DataFrame, width: int) -> list[DataFrame]:
    """Repeated windows of the contexts of anchors that are too large for one task, as stored tables."""
    found, part = [], "key long, m long, u long, n long, first long, place long, lo long, hi long, digest binary, context binary"
    work = many.select("key", "m", "u", "n", F.lit(0).cast("long").alias("first"), "place", F.lit(0).cast("long").alias("lo"), F.lit(width - width // 4).cast("long").alias("hi"), "context")
    before: list[DataFrame] = [many]
    while True:
        parts = written(work, "parts", lambda it: _halves(it, width), part)
        discard(*before)
        columns = [c for c in parts.columns if c not in ("key", "digest")]
        equal = written(parts.groupBy("key", "digest").agg(F.count("*").alias("c"), F.min(F.struct(*columns)).alias("one")), "equal")
        groups = equal.groupBy("key").agg(F.count("*").alias("size"))
        # windows number first to first + len(context) - width are repeated wherever two parts are equal
        whole = parts.select("key", "digest", "m", "u", "n", "first", F.length("context").alias("size")).join(equal.where("c > 1").select("key", "digest"), ["key", "digest"])
        found.append(written(whole.select("m", "u", "n", "first", "size"), "whole", lambda it: _whole_ranges(it, width), FOUND))
        rows = equal.join(groups.where("size > 1"), "key").select("key", "c", "size", "one.*")
        small = rows.where(F.col("size") <= MOST).select("key", "m", "u", "n", "c", "first", "place", "context")
        found.append(written(small.repartition("key").sortWithinPartitions("key", "m", "u", "n"), "suffixes", lambda it: _by_suffix(it, width), FOUND))
        work = written(rows.where(F.col("size") > MOST).drop("c", "size"), "work")
        discard(parts, equal)
        before = [work]
        if work.isEmpty():
            discard(work)
            return found


def _whole_ranges(batches, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("first", "size"))
        ranges = np.stack([first, first + size - width + 1], 1).astype("<u4")
        yield pa.record_batch([*(batch.column(c) for c in ("m", "u", "n")), pa.array([x.tobytes() for x in ranges], pa.binary())], ["m", "u", "n", "ranges"])


def _contexts(batches, width: int) -> Iterator[pa.RecordBatch]:
    names = ["key", "m", "u", "n", "c", "first", "place", "contexts", "context"]
    for batch in pieces(batches):
        for text, needs in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            raw = text.encode()
            for a in range(0, len(needs), 5000):
                rows = [(x["m"], x["m"], x["u"], x["n"], x["c"], 0, x["place"], x["contexts"], raw[x["start"] : x["start"] + x["n"] + width - 1]) for x in needs[a : a + 5000]]
                yield pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 8, pa.binary()), strict=True)], names)


def _spans(batches, width: int) -> Iterator[pa.RecordBatch]:
    """Byte ranges to remove, packed by row of runs."""
    for batch in pieces(batches):
        out = []
        for starts, n, ranges in zip(*(batch.column(c).to_pylist() for c in ("starts", "n", "ranges")), strict=True):
            own = np.array([[0, n]], np.int64) if ranges is None else np.frombuffer(ranges, "<u4").reshape(-1, 2).astype(np.int64)
            spans = np.array(starts, np.int64)[:, None, None] + own
            spans[:, :, 1] += width - 1
            out.append(_merged(spans.reshape(-1, 2)).tobytes())
        yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "spans"])


def _merged(spans: np.ndarray) -> np.ndarray:
    """Sorted ranges, joined where they touch."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], 1)


def _long(width: int):
    """Packed spans with at least one of that length."""

    def run(batches):
        for batch in pieces(batches):
            kept = [i for i, x in enumerate(batch.column(1).to_pylist()) if (np.diff(_merged(np.frombuffer(b"".join(x), np.int64).reshape(-1, 2))) >= width).any()]
            yield batch.take(pa.array(kept, pa.int64()))

    return run


def repeated_spans(docs: DataFrame, width: int = WIDTH, within: DataFrame | None = None) -> DataFrame:
    """(doc_id as row_id() gives it, spans) of the documents with strings of `width` bytes that
    stand anywhere else too: packed byte ranges, a list of binaries; a stored table.

    `within` may be the spans of a smaller width: repeats of this width can only lie in those.
    """
    source = docs.select(row_id().alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = source
    if within is not None:
        read = source.join(within.mapInArrow(freed(_long(width)), within.schema), "doc_id")
    rows = written(read, "runs", lambda it: _run_rows(it, width), "doc_id long, m long, u long, n long, place long, starts array<long>")
    classes = written(rows.groupBy("m", "u", "n").agg(F.sum(F.size("starts")).alias("c"), F.min("place").alias("place"), F.min(F.struct("doc_id", F.col("starts")[0].alias("start"))).alias("at")), "classes")
    anchors = written(classes.groupBy("m").agg(F.count("*").alias("contexts"), F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("single")).where("contexts > 1 AND single > 0").select("m", "contexts"), "anchors")
    wanted = classes.join(anchors, "m").groupBy("at.doc_id").agg(F.collect_list(F.struct("m", "u", "n", "c", "place", "contexts", F.col("at.start").alias("start"))).alias("needs"))
    asked, cut, context = source.join(wanted, "doc_id").select("text", "needs"), lambda it: _contexts(it, width), "key long, m long, u long, n long, c long, first long, place long, contexts long, context binary"
    often = (anchors.agg(F.max("contexts")).first()[0] or 0) > MOST
    # kept if often, since both ways read it
    shared = written(asked, "contexts", cut, context) if often else asked.mapInArrow(freed(cut), context)
    usual = shared.where(F.col("contexts") <= MOST).drop("contexts")
    found = [written(usual.repartition("key").sortWithinPartitions("key", "m", "u", "n"), "suffixes", lambda it: _by_suffix(it, width), FOUND)]
    if often:
        many = written(shared.where(F.col("contexts") > MOST).dropDuplicates(["m", "u", "n"]), "many")
        discard(shared)
        found += _split(many, width)
    whole = classes.where("c > 1").select("m", "u", "n", F.lit(None).cast("binary").alias("ranges"))
    single = classes.where("c = 1").select("m", "u", "n")
    for i, x in enumerate(found):
        whole = whole.unionByName(x if i == 0 else x.join(single, ["m", "u", "n"], "left_semi"))
    spans = rows.join(whole, ["m", "u", "n"]).select("doc_id", "n", "starts", "ranges").mapInArrow(freed(lambda it: _spans(it, width)), "doc_id long, spans binary")
    out = written(spans.groupBy("doc_id").agg(F.collect_list("spans").alias("spans")), "spans")
    discard(rows, classes, anchors, *found)
    return out


def _removed(raw: bytes, spans: list[bytes] | None, words: int = 0) -> tuple[bytes, np.ndarray]:
    """What stays of the bytes, and the ranges that go: those of so many words, or of WIDTH bytes."""
    own = _merged(np.frombuffer(b"".join(spans), np.int64).reshape(-1, 2)) if spans else np.empty((0, 2), np.int64)
    if words:
        own = own[[b - a >= WIDTH or len(raw[a:b].split()) >= words for a, b in own.tolist()]]
    edges = [0, *own.ravel().tolist(), len(raw)]
    return b"".join([raw[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True)]), own


def substring_digests(docs: DataFrame, width: int = WIDTH, passage: int = PASSAGE, words: int = WORDS) -> DataFrame:
    """What removing every byte of a repeated string of `width` bytes leaves of each document.

    Columns doc_id, n_bytes, n_removed, n_spans, kept_sha256; and passage_bytes, n_passages of the
    passages that without_repeats() would remove, whether they go here or not (passage is at most
    width). Null and empty texts and texts under `passage` bytes lose
    nothing; repeated rows are repeats of each other; doc_id identifies a text, and rows without
    one are told apart by their text; an empty table gives an empty one; columns other than
    doc_id and text are not read. Texts of any length are read in steps of 4,000,000 bytes. A stored
    table, so that who writes it on reads a few small files.
    """

    def run(batches):
        for batch in pieces(batches):
            out = []
            for text, fine, coarse in zip(texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                raw = text.encode()
                kept, own = _removed(raw, fine)
                rest, passages = _removed(raw, coarse, words)
                out.append((len(raw), len(raw) - len(kept), len(own), hashlib.sha256(kept).hexdigest(), len(raw) - len(rest), len(passages)))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.record_batch([batch.column(0), *(pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), types, strict=True))], DIGESTS)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_id().alias("id"), F.col("text").cast("string").alias("text"))
    coarse = repeated_spans(docs, passage)
    fine = repeated_spans(docs, width, coarse) if passage < width else coarse
    spans = coarse.select(F.col("doc_id").alias("id"), F.col("spans").alias("coarse")).join(fine.select(F.col("doc_id").alias("id"), F.col("spans").alias("fine")), "id", "left")
    joined = source.join(spans, "id", "left").select("doc_id", "text", "fine", "coarse")
    out = written(joined, "digests", run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, passage_bytes long, n_passages long")
    discard(coarse, fine)
    return out


DIGESTS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "passage_bytes", "n_passages"]


def without_repeats(docs: DataFrame, width: int = PASSAGE, words: int = WORDS) -> DataFrame:
    """The documents without repeated passages in `text`; all other columns as they were.

    A passage is a maximal run of bytes covered by strings of `width` bytes that stand anywhere
    else too, same document included, if it holds at least `words` words or WIDTH bytes; so short
    quotations stay, and long ones in scripts without spaces go. Bytes of a character that is cut through go too. A null text stays null, an empty one empty,
    an empty table empty; texts of any length are read whole; and other columns may have any names.
    """

    def run(batches):
        for batch in pieces(batches):
            row = batch.column(0)
            kept = [None if text is None else _removed(text.encode(), spans, words)[0].decode(errors="ignore") for text, spans in zip(row.field("text").to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.record_batch([pa.array(kept, pa.string()) if c == "text" else row.field(c) for c in names], names)

    names = docs.columns
    spans = repeated_spans(docs, width).select(F.col("doc_id").alias("id"), "spans")
    joined = docs.select(F.struct("*").alias("row"), row_id().alias("id")).join(spans, "id", "left").select("row", "spans")
    return joined.mapInArrow(freed(run), docs.schema)
