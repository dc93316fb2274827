"""Joins that stay spread out when one key holds a large share of the rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 0.001
HOT_FLOOR = 10_000
ROWS_PER_SALT = 5_000


def widen_scan(scan: DataFrame, key: str) -> DataFrame:
    """Spread a file scan with fewer splits than cores over all cores.

    For text work on a few large files. A table of many files is left as it is,
    so large data is never shuffled for this. Meant for plain scans, whose split
    count is known without running anything.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, key)


@dataclass(frozen=True)
class KeyCounts:
    """Rows of a table and of its most frequent key, per key column."""

    total: int
    largest: dict[str, int]

    def has_hot(self, key: str) -> bool:
        return self.largest[key] > max(self.total * HOT_SHARE, HOT_FLOOR)


def key_counts(df: DataFrame, *keys: str) -> KeyCounts:
    """One counting pass; brings one row per key column to the driver.

    Lets a caller leave out the branches for hot keys when there are none.
    """
    cells = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("value")) for k in keys])
        ).alias("c")
    )
    rows = (
        cells.groupBy("c.name", "c.value")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("name")
        .agg(F.max("n").alias("largest"), F.sum("n").alias("total"))
        .collect()
    )
    largest = {k: 0 for k in keys} | {r["name"]: r["largest"] for r in rows}
    return KeyCounts(max((r["total"] for r in rows), default=0), largest)


def hot_keys(
    df: DataFrame, key: str, share: float = HOT_SHARE, floor: int = HOT_FLOOR
) -> DataFrame:
    """``(key, rows_of_key)`` of keys with more than ``share`` of the rows: at most ``1/share``."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows_of_key"))
    total = counts.agg(F.sum("rows_of_key")).scalar()
    return counts.where(
        (F.col("rows_of_key") > total * F.lit(share)) & (F.col("rows_of_key") > floor)
    ).select(key, "rows_of_key")


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    hot: DataFrame | None,
    spread: list[str],
    how: str = "inner",
) -> DataFrame:
    """Equi-join on ``key`` where rows of hot keys are split over many tasks.

    ``hot`` comes from :func:`hot_keys` (at most ``1/share`` rows, hence the
    broadcast); a hot key gets a salt for every ``ROWS_PER_SALT`` of its rows. Left
    rows of a hot key take a salt from the ``spread`` columns; right rows are
    repeated once per salt. Other keys use salt 0. ``hot`` is None when the caller
    knows there is no hot key. The shuffles are the join's own, so adaptive
    execution may still split what is left of the skew.
    """
    if hot is None:
        return left.join(right, key, how)
    flags = F.broadcast(
        hot.select(key, F.ceil(F.col("rows_of_key") / ROWS_PER_SALT).cast("int").alias("_salts"))
    )
    salts = F.coalesce("_salts", F.lit(1))
    lhs = left.join(flags, key, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*spread), salts).cast("int")
    ).drop("_salts")
    rhs = right.join(flags, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), salts - 1))
    ).drop("_salts")
    return lhs.join(rhs, [key, "_salt"], how).drop("_salt")
