"""Queries and patterns from files, folders and standard input, run and timed.

    python -m quadlake.runner TABLES [-f FILE | -d FOLDER | -] [-p PATTERNS] [-o FORMAT OUT] [-t TIMES] [-s SECONDS]

TABLES is a folder of Parquet tables, seen through the standard mapping, or one of stored quads.
"""

from __future__ import annotations

import argparse
import csv
import sys
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor, TimeoutError, wait
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import sparql
from .sources.mapping import standard_mapping
from .sources.ntriples import parse_pattern
from .sources.results import FORMATS, write_results
from .sources.store import QuadStore


def queries_of_lines(lines: Iterable[str]) -> list[tuple[str, str]]:
    """One query a line; blank lines and comments are passed over. (name, text), named by line."""
    return [(f"line{i}", x.strip()) for i, x in enumerate(lines, 1) if x.strip() and not x.lstrip().startswith("#")]


def queries_of_file(path: str) -> list[tuple[str, str]]:
    return queries_of_lines(Path(path).read_text(encoding="utf-8").splitlines())


def queries_of_folder(path: str) -> list[tuple[str, str]]:
    """One query a file, sorted by name."""
    return [(x.name, x.read_text(encoding="utf-8")) for x in sorted(Path(path).iterdir()) if x.is_file()]


def patterns_of_file(path: str) -> list[list[str | None]]:
    """Quad patterns, one a line: three or four terms in N-Triples syntax, ? for any."""
    return [parse_pattern(x) for _, x in queries_of_file(path)]


def matches(store: QuadStore, patterns: list[list[str | None]]) -> DataFrame:
    """The quads of each pattern: pattern (its number from 0), s, p, o, g."""
    found = [store.match(*p).select(F.lit(i).alias("pattern"), "s", "p", "o", "g") for i, p in enumerate(patterns)]
    out = found[0] if found else store.quads.limit(0).select(F.lit(0).alias("pattern"), "s", "p", "o", "g")
    for x in found[1:]:
        out = out.union(x)
    return out


class Running:
    """A query that runs in a thread of its own, its jobs under one tag."""

    def __init__(self, source, text: str, action: Callable[[DataFrame], object] = DataFrame.collect):
        self.context, self.tag = source.spark.sparkContext, f"query-{uuid.uuid4().hex}"
        pool = ThreadPoolExecutor(1)
        self.future = pool.submit(self._run, source, text, action)
        pool.shutdown(wait=False)

    def _run(self, source, text, action):
        self.context.addJobTag(self.tag)
        return action(sparql(source, text))

    def cancel(self) -> None:
        """Ends the query's jobs, also those that it starts after the first is ended."""
        while not self.future.done():
            self.context.cancelJobsWithTag(self.tag)
            wait([self.future], 0.1)

    def result(self, seconds: float | None = None):
        """What the action gave; a query that takes longer is cancelled, with a TimeoutError."""
        if wait([self.future], seconds).not_done:
            self.cancel()
            raise TimeoutError(f"the query took over {seconds} seconds")
        return self.future.result()


def timed(source, queries: list[tuple[str, str]], runs: int = 1, warm: int = 0) -> list[tuple[str, int, int, int]]:
    """Runs the mix of queries, `warm` times unmeasured: (name, run, microseconds, rows)."""
    out = []
    for run in range(-warm, runs):
        for name, text in queries:
            began = time.perf_counter_ns()
            rows = sparql(source, text).count()
            if run >= 0:
                out.append((name, run, (time.perf_counter_ns() - began) // 1000, rows))
    return out


def write_times(times: list[tuple[str, int, int, int]], path: str) -> None:
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([("query", "run", "microseconds", "rows"), *times])


def opened(spark: SparkSession, path: str):
    """The mapped tables of a folder, or its stored quads."""
    return standard_mapping(spark, path) if (Path(path) / "region.parquet").exists() else QuadStore.open(spark, path)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quadlake")
    parser.add_argument("tables")
    parser.add_argument("-f", "--file")
    parser.add_argument("-d", "--folder")
    parser.add_argument("-p", "--patterns")
    parser.add_argument("-o", "--output", nargs=2, metavar=("FORMAT", "OUT"), help="formats: " + ", ".join(FORMATS))
    parser.add_argument("-t", "--times")
    parser.add_argument("-s", "--seconds", type=float, help="a shown query that takes longer is cancelled")
    asked = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    source = opened(spark, asked.tables)
    if asked.patterns:
        matches(source, patterns_of_file(asked.patterns)).show(truncate=False)
        return 0
    if asked.file:
        queries = queries_of_file(asked.file)
    else:
        queries = queries_of_folder(asked.folder) if asked.folder else queries_of_lines(sys.stdin)
    if asked.times:
        write_times(timed(source, queries), asked.times)
    elif asked.output:
        for name, text in queries:
            write_results(source, text, f"{asked.output[1]}/{name}", asked.output[0])
    else:
        for _, text in queries:
            Running(source, text, lambda df: df.show(truncate=False)).result(asked.seconds)
    return 0


if __name__ == "__main__":
    sys.exit(main())
