"""BPE encoding and decoding with a contiguous array of parts and ranks per short word.

A word is a row of symbols and, beside it, the ranks of its adjacent pairs. A round scans
the ranks for the leftmost minimum, writes the merged symbol, deletes the boundary behind
it and refreshes the two ranks next to it. Rows of many words are kept in one matrix, so
that numpy does a round for thousands of words at a time. Words of over SHORT symbols use
the heap of token_counts instead, whose cost does not grow with the square of the length.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import freed, pieces, slices, texts, word_keys

SHORT = 32
NONE = np.int32(1 << 30)
#: How the vocabulary files write bytes as letters. Printable bytes stand for
#: themselves, the others follow from code point 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTER = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PLAIN)}


class Vocabulary:
    """The symbols and merges of a tokenizer file (its path is a parameter)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids = ids = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in ids.items()} | {i: s for s, i in self.added.items()}
        self.first = np.array([ids.get(LETTER[b], -1) for b in range(256)], np.int32)
        self.last = np.array([ids.get(LETTER[b] + self.suffix, -1) for b in range(256)], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {}
        for rank, (a, b) in enumerate(merges):
            self.rank.setdefault(ids[a] << 16 | ids[b], rank)
        self.product = np.array([ids[a + b] for a, b in merges], np.int32)
        self._open_table()

    def _open_table(self) -> None:
        """An open-addressing table of pair ranks that numpy can probe for many pairs at once."""
        self.bits = max(10, int(len(self.rank) * 16).bit_length())
        self.keys = np.full((1 << self.bits) + 64, -1, np.int64)
        self.ranks = np.full((1 << self.bits) + 64, NONE, np.int32)
        self.probes = 1
        keys = np.fromiter(self.rank, np.int64, len(self.rank))
        for slot, key in zip(self._slot(keys).tolist(), keys.tolist(), strict=True):
            at = slot
            while self.keys[at] != -1:
                at += 1
            self.keys[at], self.ranks[at] = key, self.rank[key]
            self.probes = max(self.probes, at - slot + 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 16 | right
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.ranks[slot], NONE)
        for step in range(1, self.probes):
            out = np.where(self.keys[slot + step] == keys, self.ranks[slot + step], out)
        return out

    def symbols(self, word: bytes) -> list[int]:
        out = self.first[np.frombuffer(word, np.uint8)].tolist()
        if self.suffix and out:
            out[-1] = int(self.last[word[-1]])
        return out


def merge_short(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of words of equal or similar length: a matrix, and how many of each row count."""
    n, lengths = len(words), np.fromiter(map(len, words), np.int64, len(words))
    width = int(lengths.max())
    flat = np.frombuffer(b"".join(words), np.uint8)
    inside = np.arange(width) < lengths[:, None]
    ids = np.zeros((n, width), np.int32)
    ids[inside] = v.first[flat]
    if v.suffix:
        ids[np.arange(n), lengths - 1] = v.last[flat[np.cumsum(lengths) - 1]]
    done, done_n = np.zeros((n, width), np.int32), lengths.copy()
    ranks = np.full((n, width), NONE, np.int32)
    if width > 1:
        ranks[:, :-1] = np.where(inside[:, 1:], v.pair_ranks(ids[:, :-1], ids[:, 1:]), NONE)
    row, count = np.arange(n), lengths.copy()
    while len(row):
        at = ranks.argmin(1)
        best = ranks[np.arange(len(row)), at]
        ends = best == NONE
        if ends.any():
            done[row[ends], : ids.shape[1]], done_n[row[ends]] = ids[ends], count[ends]
            go = ~ends
            row, count, ids, ranks, at, best = row[go], count[go], ids[go], ranks[go], at[go], best[go]
            if not len(row):
                break
        k = np.arange(len(row))
        ids[k, at] = v.product[best]
        column = np.arange(ids.shape[1] - 1)
        keep = column + (column > at[:, None])  # the boundary behind `at` goes
        ids, ranks, count = np.take_along_axis(ids, keep, 1), np.take_along_axis(ranks, keep, 1), count - 1
        right = at + 1 < count
        ranks[k, at] = NONE
        if right.any():
            r = k[right]
            ranks[r, at[right]] = v.pair_ranks(ids[r, at[right]], ids[r, at[right] + 1])
        left = at > 0
        if left.any():
            r = k[left]
            ranks[r, at[left] - 1] = v.pair_ranks(ids[r, at[left] - 1], ids[r, at[left]])
    return done, done_n


class Table:
    """An open-addressing table from 64-bit hashes to row numbers, probed with numpy."""

    def __init__(self, bits: int):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.checks = np.zeros(1 << self.bits, np.uint32)
        self.rows = np.full(1 << self.bits, -1, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Row numbers; -1 for keys that are not in the table."""
        out, slot, left, last = np.full(len(keys), -1, np.int32), self._slot(keys), np.arange(len(keys)), (1 << self.bits) - 1
        while len(left):
            at = slot[left] & last
            row = self.rows[at]
            hit = (row >= 0) & (self.keys[at] == keys[left]) & (self.checks[at] == checks[left])
            out[left[hit]] = row[hit]
            left = left[(row >= 0) & ~hit]
            slot[left] += 1
        return out

    def add(self, keys: np.ndarray, checks: np.ndarray, rows: np.ndarray) -> None:
        """Adds distinct keys that are not in the table."""
        slot, left, last = self._slot(keys), np.arange(len(keys)), (1 << self.bits) - 1
        while len(left):
            at = slot[left] & last
            free = self.rows[at] < 0
            mine, there = left[free], at[free]
            self.rows[there] = rows[mine]
            won = self.rows[there] == rows[mine]
            self.keys[there[won]], self.checks[there[won]] = keys[mine[won]], checks[mine[won]]
            left = np.concatenate([left[~free], mine[~won]])
            slot[left] += 1


class Pool:
    """Variable-length items in one growing array."""

    def __init__(self, dtype):
        self.data, self.used = np.empty(1 << 16, dtype), 0

    def add(self, items: np.ndarray) -> int:
        if self.used + len(items) > len(self.data):
            self.data = np.resize(self.data, 2 * (self.used + len(items)))
        at = self.used
        self.data[at : at + len(items)] = items
        self.used += len(items)
        return at

    def gather(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        shift = start - (np.cumsum(length) - length)
        return self.data[np.repeat(shift, length) + np.arange(int(length.sum()))]


class Encoder:
    """Ids of whole texts for vocabularies that drop white space and mark word ends.

    Words never cross white space, so texts are split there; each distinct chunk is encoded
    once and kept (up to `keep` chunks, then the store begins anew).
    """

    def __init__(self, path: str, pattern: str, keep: int = 400_000, dtype: str = "<u4", decode: bool = True):
        self.v, self.path, self.keep, self.dtype, self.decoding = Vocabulary(path), path, keep, dtype, decode
        self.space = regex.compile("[\t-\r ]")
        self.words_or_end = regex.compile(pattern + r"|\n").findall
        #: Letters whose class no Unicode version changed; the library itself splits chunks with others.
        self.rare = regex.compile("[^\x00-\x7f\u00a1-\u024f\u0400-\u0481\u4e00-\u9fa5\uac00-\ud7a3\u2010-\u2027]")
        self.bytes_of = {letter: bytes([b]) for b, letter in LETTER.items()}
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.v.added)) + ")")
        self.added = {x.encode(): i for x, i in self.v.added.items()}
        self.names = {i: x.encode() for i, x in self.v.strings.items()}
        self.table = Table(max(12, int(2.5 * keep).bit_length()))
        self._begin()

    def _begin(self) -> None:
        self.table.clear()
        self.n, self.ids, self.spelt = 0, Pool(self.dtype), Pool(np.uint8)
        self.places = np.zeros((1 << 12, 4), np.int64)  # ids: start, length; spelling: start, length

    def library_pieces(self, chunk: str) -> list[bytes]:
        if not hasattr(self, "library"):
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
        return [b"".join([self.bytes_of[c] for c in w]) for w, _ in found]

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the words in one array, and where each word's ids start and how many they are."""
        from .token_counts import merge_heap

        start, length, flat, used = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(sizes > SHORT).tolist():
            flat.append(np.array(merge_heap(self.v, self.v.symbols(words[i])), np.int32))
            start[i], length[i], used = used, len(flat[-1]), used + len(flat[-1])
        for k in range(1, SHORT // 4 + 1):
            group = np.flatnonzero((sizes > 4 * k - 4) & (sizes <= 4 * k))
            for a in range(0, len(group), 8192):
                part = group[a : a + 8192]
                ids, n = merge_short(self.v, [words[i] for i in part.tolist()])
                flat.append(ids[np.arange(ids.shape[1]) < n[:, None]])
                start[part], length[part] = used + np.cumsum(n) - n, n
                used += len(flat[-1])
        return (np.concatenate(flat) if flat else np.empty(0, np.int32)), start, length

    def learn(self, chunks: list[bytes], keys: np.ndarray, checks: np.ndarray) -> None:
        """Encodes chunks not met before and stores ids and spellings."""
        whole = b"\n".join(chunks).decode()
        if whole.isascii():
            found = self.words_or_end(whole.lower())
        elif not self.rare.search(whole):
            found = self.words_or_end(unicodedata.normalize("NFC", whole).lower())
        else:
            found = []
            for c in whole.split("\n"):
                found += self.library_pieces(c) if self.rare.search(c) else self.words_or_end(unicodedata.normalize("NFC", c).lower())
                found.append("\n")
            found.pop()
        number = {w: i for i, w in enumerate(dict.fromkeys(found))}
        words = [b"" if w == "\n" else w if isinstance(w, bytes) else w.encode() for w in number]
        flat, start, length = self._encoded(words)
        which = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
        n = length[which]
        ids = flat[np.repeat(start[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        stops = np.append(np.flatnonzero(which == number.get("\n", -1)), len(which))
        total = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=total[1:])
        ends = total[stops]
        n = np.diff(ends, prepend=0)
        for i in [i for i, c in enumerate(chunks) if c in self.added]:
            ids = np.concatenate([ids[: ends[i] - n[i]], [self.added[chunks[i]]], ids[ends[i] :]]).astype(np.int32)
            n[i] = 1
            ends = np.cumsum(n)
        size, at = np.zeros(len(n), np.int64), 0
        if self.decoding:
            said = [self.names[i] for i in ids.tolist()]
            spelt = [b" ".join(said[i:j]) + b" " if j > i else b"" for i, j in zip((ends - n).tolist(), ends.tolist(), strict=True)]
            size = np.fromiter(map(len, spelt), np.int64, len(spelt))
            at = self.spelt.add(np.frombuffer(b"".join(spelt), np.uint8))
        at_ids = self.ids.add(ids.astype(self.dtype))
        rows = np.arange(self.n, self.n + len(n), dtype=np.int32)
        if self.n + len(n) > len(self.places):
            self.places = np.resize(self.places, (2 * (self.n + len(n)), 4))
        self.places[self.n : self.n + len(n)] = np.stack([at_ids + ends - n, n, at + np.cumsum(size) - size, size], 1)
        self.n += len(n)
        self.table.add(keys, checks, rows)

    def encode_texts(self, whole: list[str], most: int = 1_000_000) -> Iterator[tuple[int, list[tuple[bytes, bytes]]]]:
        """encode() in slices of bounded size, with the place of each slice's first text.

        A text above the bound is cut at white space, which no token crosses.
        """
        for a, b in slices(whole, len, most):
            if b == a + 1 and len(whole[a]) > most:
                parts, at, text = [], 0, whole[a]
                while at < len(text):
                    space = self.space.search(text, min(len(text), at + most))
                    end = space.end() if space else len(text)
                    parts += self.encode([text[at:end]])
                    at = end
                yield a, [(b"".join([i for i, _ in parts]), b" ".join([s for _, s in parts if s]))]
            else:
                yield a, list(self.encode(whole[a:b]))

    def encode(self, batch: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """For each text: ids as packed integers, and the decoded text as UTF-8."""
        raw = [(self.special.sub(r" \1 ", x) if "<|" in x else x).encode() for x in batch]
        joined = b"\n".join(raw)
        data = np.frombuffer(joined, np.uint8)
        gap = np.empty(len(data) + 2, bool)
        gap[0] = gap[-1] = True
        np.logical_or(data == 32, (data >= 9) & (data <= 13), out=gap[1:-1])
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        start, end = edge[0::2], edge[1::2]
        size = end - start
        keys, checks = word_keys(joined, start, size)
        row = self.table.find(keys, checks)
        new = np.flatnonzero(row < 0)
        if len(new):
            _, first = np.unique(keys[new], return_index=True)
            if self.n + len(first) > self.keep:
                self._begin()
                _, new = np.unique(keys, return_index=True)
            else:
                new = new[first]
            self.learn([joined[a:b] for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)], keys[new], checks[new])
            row = self.table.find(keys, checks)
        place = self.places[row]
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
        upto = np.searchsorted(start, ends)  # chunks before each text's end

        def bounds(length: np.ndarray) -> list[int]:
            total = np.zeros(len(length) + 1, np.int64)
            np.cumsum(length, out=total[1:])
            return [0, *total[upto].tolist()]

        width = np.dtype(self.dtype).itemsize
        packed, at = self.ids.gather(place[:, 0], place[:, 1]).tobytes(), bounds(place[:, 1])
        if not self.decoding:
            yield from ((packed[a * width : b * width], b"") for a, b in zip(at, at[1:], strict=False))
            return
        spelt, on = self.spelt.gather(place[:, 2], place[:, 3]).tobytes(), bounds(place[:, 3])
        for a, b, c, d in zip(at, at[1:], on, on[1:], strict=False):
            yield packed[a * width : b * width], spelt[c : max(c, d - 1)]


#: The split pattern of the vocabulary with word ends.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_made: dict[tuple, Encoder] = {}


def encoder(path: str, dtype: str = "<u4", decode: bool = True) -> Encoder:
    """One encoder for each Python worker, with what it has learnt so far."""
    key = (path, dtype, decode)
    if key not in _made:
        _made[key] = Encoder(path, WORD_PATTERN, dtype=dtype, decode=decode)
    return _made[key]


def _encodings(batches, path: str) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in pieces(batches):
        names, whole = batch.column(0), texts(batch.column(1))
        for a, out in enc.encode_texts(whole):
            yield pa.record_batch(
                [names.slice(a, len(out)), pa.array([len(i) // 4 for i, _ in out], pa.int64()), pa.array([i for i, _ in out], pa.binary()), pa.array([s for _, s in out], pa.binary())],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's ids (as packed 32-bit integers) and its decoded text.

    Null and empty texts have no ids and decode to an empty text; a text over 1,000,000
    characters is cut at white space, which no token crosses; repeated rows each give a row; an
    empty table gives an empty table; columns other than the two named are not read.
    """
    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(freed(lambda it: _encodings(it, path)), "doc_id long, n_tokens long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """encode_documents with digests of its ids and texts, made where those are made."""

    def run(batches):
        for batch in _encodings(batches, path):
            hashed = [pa.array([hashlib.sha256(x).hexdigest() for x in batch.column(c).to_pylist()], pa.string()) for c in ("ids", "decoded")]
            yield pa.record_batch([batch.column(0), batch.column(1), *hashed], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(freed(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
