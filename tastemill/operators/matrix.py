"""Ratings as a sparse long table and the universes around it."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions.columns import clip
from tastemill.functions.ranking import dense_index, with_row
from tastemill.session import materialise

# of unrated candidates: movies of a block, and parts of the users that meet it apart
ITEM_BLOCK = 16_384
USER_PARTS = 16


def rating_matrix(interactions: DataFrame) -> DataFrame:
    """Mean clipped rating per (user, movie); rows without a rating do not count."""
    return (
        interactions.where(F.col("rating").isNotNull())
        .groupBy("user_id", "movie_id")
        .agg(F.avg(clip("rating")).alias("rating"))
    )


def rated_cells(interactions: DataFrame) -> DataFrame:
    """Cells above zero; zero means not rated."""
    return rating_matrix(interactions).where(F.col("rating") > 0)


def matrix_view(matrix: DataFrame, movies: Sequence[str]) -> DataFrame:
    """A wide view for chosen movies, 0 where there is no rating."""
    wide = matrix.where(F.col("movie_id").isin(*movies)).groupBy("user_id").pivot(
        "movie_id", list(movies)
    )
    return wide.agg(F.first("rating")).fillna(0.0)


def universe(column: str, *tables: DataFrame) -> DataFrame:
    """Distinct ids over several tables."""
    out = tables[0].select(column)
    for t in tables[1:]:
        out = out.unionByName(t.select(column))
    return out.where(F.col(column).isNotNull()).distinct()


def universe_completion(cells: DataFrame, users: DataFrame, movies: DataFrame) -> DataFrame:
    """``(kind, id)`` of users and movies that have no cell."""
    idle_users = users.select("user_id").join(cells.select("user_id"), "user_id", "left_anti")
    idle_movies = movies.select("movie_id").join(cells.select("movie_id"), "movie_id", "left_anti")
    return (
        idle_users.distinct()
        .select(F.lit("user").alias("kind"), F.col("user_id").alias("id"))
        .unionByName(
            idle_movies.distinct().select(
                F.lit("movie").alias("kind"), F.col("movie_id").alias("id")
            )
        )
    )


def global_mean(cells: DataFrame) -> DataFrame:
    return cells.agg(F.avg("rating").alias("global_mean"), F.count(F.lit(1)).alias("cells"))


def user_means(cells: DataFrame, n_items: Column) -> DataFrame:
    """Mean over the whole item universe: unrated items count as zero."""
    return cells.groupBy("user_id").agg(
        (F.sum("rating") / n_items.cast("double")).alias("user_mean")
    )


def item_count(items: DataFrame) -> Column:
    return items.agg(F.count(F.lit(1))).scalar()


def free_ranges(targets: DataFrame, taken: DataFrame, n_items: DataFrame) -> DataFrame:
    """``(user_id, first, last, before)``: runs of item numbers a user has not taken.

    ``taken`` is ``(user_id, idx)`` without repeats; ``before`` counts the free
    items in earlier runs. Work is linear in ``taken``.
    """
    ends = with_row(targets.select("user_id"), n_items, "idx").select(
        "user_id", F.col("idx").cast("bigint").alias("idx")
    )
    rows = taken.join(targets, "user_id", "left_semi").select(
        "user_id", F.col("idx").cast("bigint").alias("idx")
    )
    w = Window.partitionBy("user_id").orderBy("idx")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.unionByName(ends)
        .withColumn("first", F.coalesce(F.lag("idx").over(w), F.lit(-1)) + 1)
        .withColumn("last", F.col("idx") - 1)
        .withColumn("free", F.col("idx") - F.col("first"))
        .withColumn("before", F.coalesce(F.sum("free").over(earlier), F.lit(0)))
        .where(F.col("free") > 0)
        .select("user_id", "first", "last", "before")
    )


def unrated_candidates(
    targets: DataFrame, items: DataFrame, cells: DataFrame, block: int = ITEM_BLOCK
) -> DataFrame:
    """Every (user, movie) a target user has not rated.

    Movies are numbered and cut into blocks. The gaps between a user's rated numbers, cut at the
    blocks, meet the block's list of movies and are expanded there: what is shuffled grows with
    the gaps and the blocks, no row of the result is.
    """
    index = materialise(dense_index(items, "movie_id"))
    taken = cells.join(index, "movie_id").select("user_id", "idx")
    size = index.agg(F.count(F.lit(1)))
    gaps = free_ranges(targets.select("user_id").distinct(), taken, size)
    block_of = lambda c: F.expr(f"{c} div {block}")
    start = F.col("block") * block
    runs = gaps.select(
        "user_id", "first", "last", F.explode(F.sequence(block_of("first"), block_of("last"))).alias("block")
    ).select(
        "user_id", "block", F.pmod(F.xxhash64("user_id"), F.lit(USER_PARTS)).cast("int").alias("part"),
        (F.greatest("first", start) - start + 1).cast("int").alias("at"),
        (F.least("last", start + block - 1) - start + 1).cast("int").alias("to"),
    )
    lists = (
        index.groupBy(block_of("idx").alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("idx", "movie_id"))).alias("c"))
        .select("block", F.col("c.movie_id").alias("movies"), F.explode(F.sequence(F.lit(0), F.lit(USER_PARTS - 1))).alias("part"))
    )
    tasks = USER_PARTS * max(1, math.ceil(index.count() / block))
    dealt = runs.repartition(min(tasks, 4000), "block", "part")
    free = F.slice("movies", F.col("at"), F.col("to") - F.col("at") + 1)
    return dealt.join(lists, ["block", "part"]).select("user_id", F.explode(free).alias("movie_id"))
