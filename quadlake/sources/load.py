"""Bulk load into a store of ids, in stages that are stored: a load that was stopped goes on where it was."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ids import IdStore
from .store import ORDERS, QuadStore, arranged


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; made, in place of a half-written one, where it is not finished."""
    if not finished(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def load_ids(spark: SparkSession, statements: str, folder: str, orders: tuple[str, ...] = ORDERS) -> IdStore:
    """N-Triples or N-Quads files as a store of ids, kept in a folder that all executors share.

    Stages: quads, dictionary, encoded, and one table a sort order. Finished ones are not made
    again, even when the statements have changed since: a new load takes a new folder.
    """
    store = QuadStore(spark, stage(spark, f"{folder}/quads", lambda: QuadStore.load(spark, statements).quads))
    dictionary = stage(spark, f"{folder}/dictionary", store.numbered)
    encoded = stage(spark, f"{folder}/encoded", lambda: store.encoded(dictionary))
    return IdStore(spark, {x: stage(spark, f"{folder}/{x}", lambda x=x: arranged(encoded, x)) for x in orders}, dictionary)
