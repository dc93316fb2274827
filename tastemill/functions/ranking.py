"""Ranking, paging, distributed numbering and exact quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions.columns import rank_score
from tastemill.session import materialise


def top_n(
    df: DataFrame,
    n: int,
    by: str | Sequence[str] = "user_id",
    score: str = "score",
    tie: str = "movie_id",
    rank: str = "rank",
) -> DataFrame:
    """The ``n`` best rows per group: score descending, ties by id.

    ``row_number() <= n`` is planned with a group limit before the shuffle, so
    every map task sends at most ``n`` rows per group.
    """
    keys = [by] if isinstance(by, str) else list(by)
    w = Window.partitionBy(*keys).orderBy(rank_score(score).desc(), F.col(tie))
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def latest_per(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str = "rn"
) -> DataFrame:
    """First ``n`` rows per group under an explicit total order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of a total order (planned as a top-k, not a full sort)."""
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def page_per(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], limit: int, offset: int = 0
) -> DataFrame:
    """The same page for every group at once."""
    return latest_per(df, by, order, offset + limit, "row_no").where(F.col("row_no") > offset)


def dense_index(ids: DataFrame, column: str, index: str = "idx") -> DataFrame:
    """Number the distinct values of a column 0..n-1 in sorted order.

    A range-partitioned sort, stored once; the rows of the ranges before are
    added to the place inside the range. No task sees more than its range, and
    the table of offsets has one row per range.
    """
    ordered = materialise(
        ids.select(column)
        .where(F.col(column).isNotNull())
        .distinct()
        .repartitionByRange(column)
        .sortWithinPartitions(column)
        .select(column, F.monotonically_increasing_id().alias("_place"))
    )
    # the id holds the range in its upper bits and the place below
    part, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    ranges = ordered.groupBy(part.alias("_range")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(
        "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    return ordered.withColumn("_range", part).join(F.broadcast(offsets), "_range").select(
        column, (place + F.col("_before")).alias(index)
    )


def unpivot_columns(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """``(name, v)`` rows of the given columns."""
    cells = [F.struct(F.lit(c).alias("name"), F.col(c).cast(kind).alias("v")) for c in columns]
    return df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.name", "cell.v")


# Bits of a key that one round of the radix histogram looks at.
DIGIT = 16
# A range of at most so many distinct values is ordered; larger ones are split on.
ORDERED = 20_000


def ordered_key(v: Column) -> Column:
    """64-bit integers in the order of the doubles; infinities are the ends.

    The bits of a positive double are in order as they are, those of a negative
    one in reverse.
    """
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), v).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))


def _ranges(
    counts: DataFrame, probs: Sequence[float], totals: DataFrame, shift: int, within: DataFrame | None
) -> DataFrame:
    """Ranges of keys with equal upper bits that hold a wanted rank.

    Rows ``(name, range, before, size, asked)``: rank of the first value, distinct
    values, and the wanted ranks. A digit has ``2 ** DIGIT`` ranges, so the windows
    over them are bounded, whatever the data.
    """
    rows = counts.withColumn("range", F.shiftright("key", shift))
    if within is None:
        rows = rows.withColumn("base", F.lit(0).cast("long")).withColumn("outer", F.lit(0).cast("long"))
    else:
        known = within.select("name", F.col("range").alias("outer"), F.col("before").alias("base"))
        rows = rows.withColumn("outer", F.shiftright("key", shift + DIGIT)).join(
            F.broadcast(known), ["name", "outer"]
        )
    per_outer = Window.partitionBy("name", "outer").orderBy("range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    asked = F.transform(
        F.array(*[F.lit(float(p)) for p in probs]),
        lambda p: F.struct(p.alias("prob"), ((F.col("total") - 1) * p).alias("at")),
    )
    return (
        rows.groupBy("name", "outer", "base", "range")
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("size"))
        .withColumn("before", F.col("base") + F.coalesce(F.sum("n").over(per_outer), F.lit(0)))
        .join(F.broadcast(totals), "name")
        .withColumn(
            "asked",
            F.filter(
                asked,
                lambda a: (F.ceil(a["at"]) >= F.col("before"))
                & (F.floor(a["at"]) < F.col("before") + F.col("n")),
            ),
        )
        .where(F.size("asked") > 0)
        .select("name", "range", "before", "size", "asked")
    )


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], ordered: int = ORDERED
) -> DataFrame:
    """Exact linearly interpolated quantiles as rows ``(name, prob, value)``.

    Values are counted first (map-side combine, so a value held by a third of
    the rows is one row afterwards). A radix histogram over order-preserving keys
    then finds the ranges that hold a wanted rank, 16 bits at a time, and goes on
    inside them until they hold at most ``ordered`` distinct values; only those
    are ordered. It ends after four rounds at the latest, when a range is one
    value, so values that lie close together are told apart like any others. The
    broadcast tables have at most two ranges per column and probability. Nulls
    and NaN are left out.
    """
    counts = materialise(
        unpivot_columns(df, columns, "double")
        .where(F.col("v").isNotNull() & ~F.isnan("v"))
        .groupBy("name", "v")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("key", ordered_key(F.col("v")))
    )
    totals = counts.groupBy("name").agg(F.sum("n").alias("total"))
    ranges = None
    for shift in range(64 - DIGIT, -1, -DIGIT):
        ranges = materialise(_ranges(counts, probs, totals, shift, ranges))
        largest = ranges.agg(F.max("size")).first()[0]
        if largest is None or largest <= ordered:
            break
    inside = Window.partitionBy("name", "range").orderBy("v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = (
        counts.withColumn("range", F.shiftright("key", shift))
        .join(F.broadcast(ranges), ["name", "range"])
        .withColumn("to", F.sum("n").over(inside) + F.col("before"))
        .select("name", "v", (F.col("to") - F.col("n")).alias("from"), "to", F.inline("asked"))
    )
    held = lambda rank: (rank >= F.col("from")) & (rank < F.col("to"))
    low, part = F.floor("at"), F.col("at") - F.floor("at")
    weight = F.when(held(low), 1 - part).otherwise(0.0) + F.when(
        held(low + 1), part
    ).otherwise(0.0)
    return (
        placed.withColumn("weight", weight).where("weight > 0")
        .groupBy("name", "prob")
        .agg(F.sum(F.col("v") * F.col("weight")).alias("value"))
    )


def with_row(df: DataFrame, one: DataFrame, name: str) -> DataFrame:
    """Attach the single value of a one-row table as a column (a scalar subquery)."""
    return df.withColumn(name, one.scalar())


def one_row(long: DataFrame, label: Column, names: Sequence[str], value: str) -> DataFrame:
    """Turn ``(label, value)`` rows into one row with a struct ``picked``.

    The scalar subquery over it is planned once, however many fields are read.
    """
    fields = [F.max(F.when(label == n, F.col(value))).alias(n) for n in names]
    return long.agg(*fields).select(F.struct(*names).alias("picked"))
