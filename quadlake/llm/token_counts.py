"""Token counts by byte-pair merging over a linked list with a heap of adjacent pairs.

The heap holds rank and place of every adjacent pair; the lowest rank is popped, stale
entries are skipped, and a merge links its symbol to its new neighbours. A word's count is
its initial symbols less its merges; no ids are written out.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import Vocabulary
from .common import freed, pieces, texts

#: The split pattern of the byte-level vocabulary.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _merge(v: Vocabulary, symbol: list[int]) -> int:
    """Merges in place (a merged-away symbol becomes -1); how many merges were made."""
    n = len(symbol)
    rank, product = v.rank.get, v.products
    heap = [r << 32 | i for i in range(n - 1) if (r := rank(symbol[i] << 16 | symbol[i + 1])) is not None]
    if not heap:
        return 0
    heapify(heap)
    after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
    while heap:
        top = heappop(heap)
        i, r = top & 0xFFFFFFFF, top >> 32
        j = after[i]
        if symbol[i] < 0 or j >= n or rank(symbol[i] << 16 | symbol[j]) != r:
            continue
        symbol[i], symbol[j], k = product[r], -1, after[j]
        after[i] = k
        merges += 1
        if k < n:
            before[k] = i
            if (x := rank(symbol[i] << 16 | symbol[k])) is not None:
                heappush(heap, x << 32 | i)
        h = before[i]
        if h >= 0 and (x := rank(symbol[h] << 16 | symbol[i])) is not None:
            heappush(heap, x << 32 | h)
    return merges


def merge_heap(v: Vocabulary, symbol: list[int]) -> list[int]:
    """The symbols that remain."""
    _prepared(v)
    _merge(v, symbol)
    return [s for s in symbol if s >= 0]


def _prepared(v: Vocabulary) -> Vocabulary:
    if not hasattr(v, "products"):
        v.products = v.product.tolist()
    return v


class Counter:
    def __init__(self, path: str, pattern: str = BYTE_PATTERN, keep: int = 600_000):
        self.v, self.keep = _prepared(Vocabulary(path)), keep
        self.first = self.v.first.tolist()
        self.split = regex.compile(pattern).findall
        self.runs = regex.compile(r" \s").search
        self.cut = regex.compile(r" (?=\S)").split
        self.special = regex.compile("|".join(map(regex.escape, self.v.added)))
        self.counts: dict[str, int] = {}

    def word(self, word: str) -> int:
        first = self.first
        symbol = [first[b] for b in word.encode("utf-8", "surrogatepass")]
        return len(symbol) - _merge(self.v, symbol) if len(symbol) > 1 else len(symbol)

    def chunks(self, text: str) -> list[str]:
        """Splits before each space that a visible character follows; the pattern always splits there."""
        if not text:
            return []
        first, *rest = self.cut(text) if self.runs(text) else text.split(" ")
        return [first, *[" " + x for x in rest]]

    def count(self, text: str) -> int:
        if "<|" in text and (found := self.special.findall(text)):
            return len(found) + sum(self.count_plain(x) for x in self.special.split(text))
        return self.count_plain(text)

    def count_plain(self, text: str) -> int:
        known, chunks = self.counts, self.chunks(text)
        try:
            return sum(map(known.__getitem__, chunks))
        except KeyError:
            pass
        new = set(chunks).difference(known)
        if len(known) + len(new) > self.keep:
            known.clear()
            new = set(chunks)
        for chunk in new:
            known[chunk] = sum([self.word(w) for w in self.split(chunk)])
        return sum(map(known.__getitem__, chunks))


_made: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every text, and whether the tokens exceed the limit.

    Null and empty texts count 0 of both; each repeated row gives a row; an empty table gives
    an empty table; other columns are not read.
    """

    def run(batches):
        if path not in _made:
            _made[path] = Counter(path)
        count = _made[path].count
        for batch in pieces(batches):
            whole = texts(batch.column(1))
            n = [count(x) for x in whole]
            yield pa.record_batch(
                [batch.column(0), pa.array([len(x.encode()) for x in whole], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(freed(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
