"""Logs of micro-batches that are merged level by level, so reads follow the keys, not the batches.

A log has one folder ``batch_id=N`` per micro-batch. A run of level ``l`` holds
what ``fanout ** l`` batches in a row say after merging: one row per key. Its place
follows from its first batch alone, and a run counts once Spark has marked it
complete, so neither a replayed batch nor a lost driver leaves half a run behind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FANOUT = 8  # batches per run, and runs per run of the next level

# rows of several batches, with their batch_id, to one row per key, with the newest
Merge = Callable[[DataFrame], DataFrame]


def newest(*keys: str) -> Merge:
    """Keep the row of the newest batch per key."""

    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in keys]
        last = F.max_by(F.struct(*rest), "batch_id").alias("last")
        return rows.groupBy(*keys).agg(last).select(*keys, "last.*")

    return merge


def summed(value: str, *keys: str) -> Merge:
    """Add up a number per key."""

    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(
            F.sum(value).alias(value), F.max("batch_id").alias("batch_id")
        )

    return merge


def batch_folder(log: str, batch_id: int) -> str:
    """One directory per micro-batch: replaying a batch overwrites its own output."""
    return f"{log}/batch_id={batch_id}"


def run_folder(log: str, level: int, first: int) -> str:
    # Spark's readers skip folders with a leading underscore when they read the log
    return f"{log}/_runs/{level}-{first}"


def _store(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, folder: str) -> bool:
    store, path = _store(spark, folder)
    return store.exists(path)


def _complete(spark: SparkSession, folder: str) -> bool:
    return exists(spark, f"{folder}/_SUCCESS")


def _names(spark: SparkSession, folder: str) -> list[str]:
    store, path = _store(spark, folder)
    if not store.exists(path):
        return []
    return [status.getPath().getName() for status in store.listStatus(path)]


def contents(spark: SparkSession, log: str) -> tuple[set[int], set[tuple[int, int]]]:
    """Stored batches, and complete runs as ``(level, first batch)``."""
    head = "batch_id="
    batches = {int(n[len(head) :]) for n in _names(spark, log) if n.startswith(head)}
    runs = [tuple(map(int, n.split("-"))) for n in _names(spark, f"{log}/_runs")]
    complete = lambda folder: _complete(spark, folder)
    return (
        {n for n in batches if complete(batch_folder(log, n))},
        {(level, first) for level, first in runs if complete(run_folder(log, level, first))},
    )


def cover(
    batches: Iterable[int], runs: Iterable[tuple[int, int]], fanout: int = FANOUT
) -> list[tuple[int, int]]:
    """Disjoint ``(level, first batch)`` that say all; level 0 is a batch itself.

    The widest run wins. At most ``fanout - 1`` runs of a level are needed where
    all runs were made.
    """
    chosen: list[tuple[int, int]] = []
    end = 0  # batches below are said
    widest_first = sorted(
        [(first, -level) for level, first in runs] + [(n, 0) for n in batches]
    )
    for first, level in widest_first:
        if first >= end:
            chosen.append((-level, first))
            end = first + fanout ** (-level)
    return chosen


def _read(spark: SparkSession, log: str, parts: list[tuple[int, int]]) -> DataFrame:
    """Rows of the given batches and runs, with ``batch_id`` as a long."""
    batches = [batch_folder(log, first) for level, first in parts if level == 0]
    runs = [run_folder(log, level, first) for level, first in parts if level > 0]
    found = []
    if batches:
        rows = spark.read.option("basePath", log).parquet(*batches)
        found.append(rows.withColumn("batch_id", F.col("batch_id").cast("long")))
    if runs:
        found.append(spark.read.parquet(*runs))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def read_log(spark: SparkSession, log: str, merge: Merge, fanout: int = FANOUT) -> DataFrame:
    """One row per key over all stored batches.

    Opens few runs per level instead of every batch. A log without any batch
    raises, as its columns are unknown.
    """
    parts = cover(*contents(spark, log), fanout)
    if not parts:
        raise FileNotFoundError(f"no batch is stored in {log}")
    return merge(_read(spark, log, parts))


def read_before(
    spark: SparkSession, log: str, batch_id: int, merge: Merge, fanout: int = FANOUT
) -> DataFrame | None:
    """One row per key over the batches before one, which may be replayed; None without any."""
    batches, runs = contents(spark, log)
    parts = cover(
        [n for n in batches if n < batch_id],
        [(level, first) for level, first in runs if first + fanout**level <= batch_id],
        fanout,
    )
    return merge(_read(spark, log, parts)).drop("batch_id") if parts else None


def compact(
    spark: SparkSession, log: str, batch_id: int, merge: Merge, fanout: int = FANOUT
) -> None:
    """Make the runs that end right before ``batch_id``, lowest level first.

    Called while a batch is stored: all earlier batches are final then, the batch
    itself may still be replayed and enters no run. A run that is there already is
    left alone. A missing batch counts as empty. A key is rewritten once per level.
    """
    level, width = 1, fanout
    while batch_id and batch_id % width == 0:
        first = batch_id - width
        target = run_folder(log, level, first)
        if not _complete(spark, target):
            batches, runs = contents(spark, log)
            inside = lambda start: first <= start < batch_id
            parts = cover(
                filter(inside, batches),
                [(at, start) for at, start in runs if inside(start) and at < level],
                fanout,
            )
            if parts:
                merge(_read(spark, log, parts)).write.mode("overwrite").parquet(target)
        level, width = level + 1, width * fanout


def drop_covered(spark: SparkSession, log: str, fanout: int = FANOUT) -> list[str]:
    """Delete batches and runs that a complete wider run says as well; returns their folders.

    Readers that started before may still hold those files: call it when none runs.
    """
    batches, runs = contents(spark, log)
    needed = set(cover(batches, runs, fanout))
    spare = [batch_folder(log, n) for n in sorted(batches) if (0, n) not in needed]
    spare += [run_folder(log, *run) for run in sorted(runs) if run not in needed]
    for folder in spare:
        store, path = _store(spark, folder)
        store.delete(path, True)
    return spare
