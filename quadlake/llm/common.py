"""Helpers shared by the corpus operators: shared storage, Arrow batches, hashing."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only a local master, where all share one disk, may go without the setting.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.gettempdir() + "/checkpoints"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def written(df: DataFrame, label: str, run=None, schema=None) -> DataFrame:
    """As stored(): df, or what run makes of its Arrow batches, in files that the Python workers write.

    Where the shared folder is a mounted one, Spark's own writer starts three processes (chmod) for
    each file, and each shares the JVM's memory until it runs, which counts it twice. Only the files
    that tasks returned, one for each partition with rows, get their names; elsewhere Spark writes.
    """
    spark = df.sparkSession
    whole = df if run is None else df.mapInArrow(freed(run), schema)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        return stored(whole, label)
    folder, fields = where.toUri().getPath(), whole.schema
    arrow = to_arrow_schema(fields)
    os.makedirs(folder)

    def write(batches):
        task = TaskContext.get()
        name, writer, held, size = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.parquet", None, [], 0

        def flush():
            nonlocal writer, held, size
            writer = writer or pq.ParquetWriter(f"{folder}/_{name}", arrow, compression="zstd", use_dictionary=False)
            writer.write_table(pa.Table.from_batches(held).cast(arrow))
            held, size = [], 0

        for batch in batches if run is None else run(batches):
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size > 16_000_000:
                flush()
        if held:
            flush()
        if writer:
            writer.close()
            yield pa.record_batch([pa.array([name])], ["file"])

    for row in df.mapInArrow(freed(write), "file string").collect():
        os.rename(f"{folder}/_{row.file}", f"{folder}/{row.file}")
    forgotten(spark)
    back = spark.read.schema(fields).parquet(path)
    back._stored_at = path
    return back


def uses(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """df, which reads those stored tables: discard(df) deletes them."""
    df._uses = tables
    return df


def discard(*tables: DataFrame) -> None:
    """Deletes what stored() or written() wrote for them, when nothing reads it any more, and lets Spark drop shuffle files that nothing refers to."""
    spark = None
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_stored_at", None)
        if path:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        discard(*getattr(df, "_uses", ()))
    if spark is not None:
        forgotten(spark)


def forgotten(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files that nothing refers to."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_id() -> Column:
    """doc_id; for rows without one, a number over 2^62 made from the text, so that they take part like others."""
    low = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1))
    return F.coalesce(F.col("doc_id").cast("long"), low.bitwiseOR(F.lit(1 << 62)))


def texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings of an Arrow column; null becomes empty."""
    return [x or "" for x in column.to_pylist()]


def pieces(batches, rows: int = 1000):
    """The batches in parts of at most so many rows, which bounds what a worker holds as Python objects."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def freed(run):
    """A function for mapInArrow that gives memory back to the system when a task ends: workers live on between tasks."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return whole


def slices(rows: list, size_of, most: int):
    """Index ranges [a, b) whose sizes add up to at most `most` (one larger item makes a range alone)."""
    a = total = 0
    for b, row in enumerate(rows):
        n = size_of(row)
        if b > a and total + n > most:
            yield a, b
            a, total = b, 0
        total += n
    if len(rows) > a:
        yield a, len(rows)


_ODD = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ODD, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], have = 1, 1
    while have < n:
        step = np.uint64(pow(base, have, 1 << 64))
        more = min(have, n - have)
        out[have : have + more] = out[:more] * step
        have += more
    return out


class PrefixHash:
    """64-bit polynomial hashes of any substring of a byte array, from one prefix sum.

    The hash of a substring depends on its bytes alone, not on where it stands. Different
    long strings can be built that have one hash, so it proposes and never decides.
    """

    BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    _up = _powers(_ODD, 1 << 10)
    _down = _powers(_INVERSE, 1 << 10)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(PrefixHash._up) <= n:
            size = 1 << int(n).bit_length()
            PrefixHash._up, PrefixHash._down = _powers(_ODD, size), _powers(_INVERSE, size)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.BYTES[data] * self._up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self._down[start])

    def windows(self, width: int) -> np.ndarray:
        """The hash of every window of that width."""
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[: max(n, 0)]) * self._down[: max(n, 0)]) if n > 0 else np.empty(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer, so that every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def word_keys(data: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys and 32-bit checks of the non-empty strings at `start`, `size` bytes long.

    Up to 15 bytes they are made from all bytes at once, two words a string; equal keys of
    strings as long, up to 8 bytes, mean equal strings. Others go through a 128-bit hash.
    """
    whole = np.frombuffer(data + bytes(16), np.uint8)
    word = np.ndarray((len(data) + 8,), "<u8", whole, strides=(1,))
    n = size.astype(np.uint64)
    eight = np.uint64(8)
    low = word[start] & (np.uint64(2**64 - 1) >> ((eight - np.minimum(n, eight)) * eight))
    more = np.minimum(np.maximum(n, eight) - eight, np.uint64(7)) * eight
    high = word[np.minimum(start + 8, len(data))] & ((np.uint64(1) << more) - np.uint64(1))
    high |= n << np.uint64(56)
    keys = mixed(mixed(low) + mixed(high))
    checks = (mixed(low ^ high * np.uint64(_ODD)) >> np.uint64(32)).astype(np.uint32)
    far = np.flatnonzero(size > 15)
    if len(far):
        hashed = xxhash.xxh3_128_digest
        both = np.frombuffer(b"".join([hashed(data[a:b]) for a, b in zip(start[far].tolist(), (start[far] + size[far]).tolist(), strict=True)]), np.uint64)
        keys[far], checks[far] = both[0::2], (both[1::2] >> np.uint64(32)).astype(np.uint32)
    return keys, checks
