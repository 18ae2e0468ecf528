"""Incremental loading: new N-Triples or N-Quads files become quads of a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.ntriples import parse_lines
from ..sources.store import QuadStore


def load_stream(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Appends the statements of files that appear in `folder` to the quads at `table`, each quad once.

    A batch that is repeated after a failure adds nothing, since its quads are there already.
    """

    def add(batch: DataFrame, _: int) -> None:
        try:
            spark.read.parquet(table)
            there = True
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            there = False
        new = parse_lines(batch)
        if there:
            QuadStore.open(spark, table).append(new, table)
        else:
            QuadStore.of(new).save(table)

    lines = spark.readStream.text(folder)
    return lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
