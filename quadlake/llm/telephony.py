"""Telephony audio columns: mu-law, A-law and ADPCM stored in WAVE files, decoded to PCM.

mu-law and A-law bytes expand through 256-entry tables built from their rule. IMA ADPCM
blocks all decode at once: step k of every block is one numpy operation, so the sequential
loop is as long as one block, whatever the number of blocks.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import freed, pieces, slices, texts

RATE = 8000
UNIT = 192
#: Format tags of WAVE files.
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 17, "pcm": 1}
#: Fixed values of IMA ADPCM: step sizes, and how each code moves the step index.
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def _mulaw() -> np.ndarray:
    x = ~np.arange(256, dtype=np.int32) & 255
    size = (((x & 15) << 3) + 132 << (x >> 4 & 7)) - 132
    return np.where(x & 128, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    x = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = x >> 4 & 7, (x & 15) << 4
    size = np.where(exponent == 0, mantissa + 8, mantissa + 0x108 << np.maximum(exponent - 1, 0))
    return np.where(x & 128, size, -size).astype(np.int16)


MULAW, ALAW = _mulaw(), _alaw()
TABLES = {"mulaw": MULAW, "alaw": ALAW}


def padded(text: bytes) -> bytes:
    """The bytes, filled with spaces to the next positive multiple of UNIT."""
    return text + b" " * (-len(text) % UNIT if text else UNIT)


def to_wave(samples: bytes, kind: str, rate: int = RATE) -> bytes:
    """A mono WAVE file of 8-bit companded samples, ADPCM blocks of UNIT bytes, or 16-bit PCM."""
    if kind == "pcm":
        head = struct.pack("<HHIIHH", 1, 1, rate, 2 * rate, 2, 16)
    elif kind == "adpcm":
        per_block = 2 * (UNIT - 4) + 1
        head = struct.pack("<HHIIHHHH", 17, 1, rate, rate * UNIT // per_block, UNIT, 4, 2, per_block)
    else:
        head = struct.pack("<HHIIHHH", TAGS[kind], 1, rate, rate, 1, 8, 0)
    body = b"fmt " + struct.pack("<I", len(head)) + head
    if kind != "pcm":
        n = len(samples) // UNIT * (2 * (UNIT - 4) + 1) if kind == "adpcm" else len(samples)
        body += b"fact" + struct.pack("<II", 4, n)
    body += b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def from_wave(data: bytes) -> tuple[str, int, bytes]:
    """Kind, rate and stored samples of a WAVE file; other chunks are passed over."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    kind, rate, at = "", 0, 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", data, at + 8)
            kind = {v: k for k, v in TAGS.items()}[tag]
        elif name == b"data":
            return kind, rate, data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of IMA ADPCM blocks: uint8 (blocks, bytes) to int16 (blocks, 2 * bytes - 7).

    A header's step index beyond the table counts as the last one.
    """
    b = blocks.astype(np.int32)
    value = (b[:, 0] | b[:, 1] << 8).astype(np.uint16).view(np.int16).astype(np.int32)[: len(b)]
    index = np.minimum(b[:, 2], 88)
    codes = np.empty((2 * (b.shape[1] - 4), len(b)), np.int32)
    codes[0::2], codes[1::2] = (b[:, 4:] & 15).T, (b[:, 4:] >> 4).T
    out = np.empty((len(codes) + 1, len(b)), np.int16)
    out[0] = value
    for k, code in enumerate(codes, 1):
        step = STEPS[index]
        change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + MOVES[code], 0, 88)
        out[k] = value
    return out.T


def resampled(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample, then the mean of it and the next, rounded down (the last repeats)."""
    x = pcm.astype(np.int32)
    out = np.empty(2 * len(x), np.int16)
    out[0::2] = x
    out[1:-1:2] = (x[:-1] + x[1:]) >> 1
    out[-1:] = x[-1:]
    return out


def levels(pcm: np.ndarray) -> str:
    """Peak, mean size and zero crossings of PCM samples."""
    x = pcm.astype(np.int32)
    size = np.abs(x)
    negative = x < 0
    return f"{int(size.max(initial=0))},{int(size.sum()) // max(len(x), 1)},{int(np.count_nonzero(negative[1:] != negative[:-1]))}"


def _summaries(payloads: list[bytes], pcm: list[bytes]) -> list[str]:
    """Features of stored samples, read as mu-law, as A-law and as ADPCM blocks, and of the PCM files."""
    blocks = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT)
    counts = [len(p) // UNIT for p in payloads]
    crcs: list[int] = [0] * len(payloads)
    owner = np.repeat(np.arange(len(payloads)), counts)
    for a in range(0, len(blocks), 16384):
        decoded, whose = decode_adpcm(blocks[a : a + 16384]), owner[a : a + 16384]
        edges = np.flatnonzero(np.diff(whose, prepend=-1, append=-1)).tolist()
        for i, j in zip(edges, edges[1:], strict=False):
            crcs[whose[i]] = zlib.crc32(np.ascontiguousarray(decoded[i:j]), crcs[whose[i]])
    out = []
    for p, crc, wide in zip(payloads, crcs, map(zlib.crc32, pcm), strict=True):
        raw = np.frombuffer(p, np.uint8)
        out.append(f"mulaw={levels(MULAW[raw])};alaw={levels(ALAW[raw])};adpcm={crc:08x};pcm16k={wide:08x}")
    return out


def _stored(batches, kind: str) -> Iterator[pa.RecordBatch]:
    """Texts as media and PCM columns, some megabytes at a time."""
    for batch in pieces(batches):
        names, whole = batch.column(0), [x.encode() for x in texts(batch.column(1))]
        for a, b in slices(whole, len, 2_000_000):
            files = [to_wave(padded(x), kind) for x in whole[a:b]]
            sizes = pa.array(list(map(len, whole[a:b])), pa.int64())
            yield pa.record_batch([names.slice(a, b - a), sizes, pa.array(files, pa.binary()), pa.array(list(map(to_pcm, files)), pa.binary())], ["doc_id", "n_bytes", "media", "pcm"])


def store_texts(docs: DataFrame, kind: str = "mulaw") -> DataFrame:
    """Texts stored losslessly as companded samples, and the same as resampled PCM.

    Columns doc_id, n_bytes (of the text), media (a WAVE file whose samples are the text's UTF-8
    filled up with spaces to a multiple of 192, of 192 at least) and pcm (a WAVE file of 16-bit
    PCM at twice the rate). Null and empty texts give 192 spaces, equal texts equal values,
    repeated rows a row each, an empty table an empty one; other columns are not read.
    """
    return docs.select("doc_id", "text").mapInArrow(freed(lambda it: _stored(it, kind)), "doc_id long, n_bytes long, media binary, pcm binary")


def media_digests(docs: DataFrame, kind: str = "mulaw") -> DataFrame:
    """What reading the media and PCM columns of store_texts() back gives, made where they are made.

    The feature holds levels of the samples read as mu-law and as A-law, and checksums of them
    read as ADPCM blocks and of the stored PCM. Odd rows are those of store_texts().
    """

    def run(batches):
        for batch in _stored(batches, kind):
            files, pcm = batch.column("media").to_pylist(), batch.column("pcm").to_pylist()
            back = [from_wave(x)[2] for x in files]
            rows = [(len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(f), hashlib.sha256(f).hexdigest(), s) for p, f, s in zip(back, files, _summaries(back, pcm), strict=True)]
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], FIELDS)

    return docs.select("doc_id", "text").mapInArrow(freed(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


FIELDS = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def to_pcm(data: bytes) -> bytes | None:
    """A WAVE file of PCM at twice the rate of a mu-law, A-law, ADPCM or PCM one; null for what is none of these.

    Bytes after the last whole sample or block are left out; a file without samples gives one without.
    """
    try:
        kind, rate, raw = from_wave(data)
    except (ValueError, KeyError, struct.error):
        return None
    x = np.frombuffer(raw, np.uint8)
    if kind == "adpcm":
        pcm = decode_adpcm(x[: len(x) // UNIT * UNIT].reshape(-1, UNIT)).reshape(-1)
    elif kind == "pcm":
        pcm = x[: len(x) // 2 * 2].view(np.int16)
    else:
        pcm = TABLES[kind][x]
    return to_wave(resampled(pcm).tobytes(), "pcm", 2 * rate)


def decode_audio(media: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """WAVE files (mu-law, A-law, ADPCM or PCM) to PCM at twice their rate, stored as WAVE.

    Null, empty and malformed media give null; repeated rows a row each, an empty table an empty
    one; other columns are not read.
    """

    def run(batches):
        for batch in pieces(batches, 64):
            yield pa.record_batch([batch.column(0), pa.array([None if x is None else to_pcm(x) for x in batch.column(1).to_pylist()], pa.binary())], ["id", "pcm"])

    return media.selectExpr(f"CAST(`{id_col}` AS long) AS id", f"`{media_col}` AS media").mapInArrow(freed(run), "id long, pcm binary")
