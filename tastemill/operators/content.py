"""Content similarity and recommendations from catalogue features."""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.functions.products import grid_top_k
from tastemill.functions.ranking import dense_index, latest_per
from tastemill.operators.features import (
    feature_vectors,
    long_features,
    unit_features,
    weighted_features,
)
from tastemill.operators.mf import dot, unit_vectors
from tastemill.session import materialise

HISTORY = 50
# of all pairs: movies of a tile, features multiplied at once
PAIR_TILE_ROWS = 1000
PAIR_SLOTS = 4096


def content_units(movies: DataFrame, weights: Mapping[str, float] | str = "declared") -> DataFrame:
    """Weighted features of unit length, long: ``(movie_id, feature, value)``.

    Materialised, as everything after it reads the table several times.
    """
    return materialise(unit_features(weighted_features(long_features(movies), weights)))


def content_similarity(
    units: DataFrame, tile_rows: int = PAIR_TILE_ROWS, at_once: int = PAIR_SLOTS
) -> DataFrame:
    """``(id_a, id_b, sim)`` of all movies that share a feature.

    Nearly every two movies share one (a language, a scaled number), so the result grows with
    the square of the catalogue. Movies travel in tiles with all their features and every two
    tiles meet once, where a pair's whole sum is formed: no pair is shuffled.
    """
    slots = dense_index(units, "feature", "slot")
    movies = materialise(
        units.join(slots, "feature")
        .groupBy(F.col("movie_id").alias("id"))
        .agg(F.collect_list(F.struct(F.col("slot").cast("int").alias("slot"), "value")).alias("c"))
        .select("id", F.col("c.slot").alias("slots"), F.col("c.value").alias("xs"))
    )
    tiles = max(1, math.ceil(movies.count() / tile_rows))
    dealt = movies.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    )
    met = dealt.select(
        F.least("own", "other").alias("ta"), F.greatest("own", "other").alias("tb"),
        F.signum(F.col("own") - F.col("other")).cast("int").alias("side"), "id", "slots", "xs",
    )
    return met.groupBy("ta", "tb").applyInArrow(
        lambda block: tile_pairs(block, at_once), "id_a string, id_b string, sim double"
    )


def tile_pairs(block: pa.Table, at_once: int) -> pa.Table:
    """Products of the movies of two tiles (or of one with itself) that share a feature."""
    rows = block.sort_by("id")
    ids, side = rows["id"].to_numpy(), rows["side"].to_numpy()
    flat = lambda c: rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(ids)), pc.list_value_length(rows["slots"].combine_chunks()))
    used, slot = np.unique(flat("slots"), return_inverse=True)
    value = flat("xs")
    lhs, rhs = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
    dots = np.zeros((len(lhs), len(rhs)))
    shared = np.zeros(dots.shape, bool)
    for low in range(0, len(used), at_once):
        here = (slot >= low) & (slot < low + at_once)
        at = (row[here], slot[here] - low)
        part = np.zeros((len(ids), min(at_once, len(used) - low)))
        held = np.zeros(part.shape, np.float32)
        np.add.at(part, at, value[here])
        held[at] = 1
        dots += part[lhs] @ part[rhs].T
        shared |= held[lhs] @ held[rhs].T > 0
    i, j = np.nonzero(shared)
    x, y, sim = lhs[i], rhs[j], dots[i, j]
    if side.any():  # rows are in id order, whichever tile they are from
        x, y = np.minimum(x, y), np.maximum(x, y)
    once = x < y
    names = pa.array(ids, pa.string())
    return pa.table(
        {"id_a": names.take(pa.array(x[once])), "id_b": names.take(pa.array(y[once])), "sim": sim[once]}
    )


def vectors_of(units: DataFrame) -> DataFrame:
    """``(id, vec)`` for the top-k products, which store it."""
    return feature_vectors(units).select(F.col("movie_id").alias("id"), "vec")


def similar_movies(vectors: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most similar movies of every movie; exact."""
    return grid_top_k(vectors, vectors, n).select(
        F.col("id").alias("movie_id"), F.col("other_id").alias("similar_id"), "score", "rank"
    )


def embedding_similarity(vectors: DataFrame, n: int = 10) -> DataFrame:
    """The same on supplied vectors ``(movie_id, vector)``."""
    ready = unit_vectors(vectors.select(F.col("movie_id").alias("id"), F.col("vector").alias("vec")))
    return similar_movies(ready, n)


def latest_ratings(interactions: DataFrame, history: int = HISTORY) -> DataFrame:
    """Ratings among each user's last interactions, one per movie: the oldest counts."""
    order = [F.col("timestamp").desc_nulls_last(), F.col("interaction_id")]
    recent = latest_per(interactions, ["user_id"], order, history)
    return (
        recent.where(F.col("rating").isNotNull() & (F.col("rating") != 0))
        .groupBy("user_id", "movie_id")
        .agg(F.max_by("rating", "rn").alias("rating"))
    )


def user_profiles(units: DataFrame, ratings: DataFrame) -> DataFrame:
    """Mean of the rated movies' unit vectors weighted by rating: ``(user_id, feature, value)``.

    The score of a movie is linear in this profile, so no movie-to-movie
    similarities are needed. Unknown movies count in the divisor only.
    """
    counts = ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("rated"))
    sums = (
        ratings.join(units, "movie_id")
        .groupBy("user_id", "feature")
        .agg(F.sum(F.col("rating") * F.col("value")).alias("total"))
    )
    return sums.join(counts, "user_id").select(
        "user_id", "feature", (F.col("total") / F.col("rated")).alias("value")
    )


def _both_vectors(units: DataFrame, ratings: DataFrame) -> tuple[DataFrame, DataFrame]:
    vocabulary = dense_index(units, "feature", "idx")
    movies = feature_vectors(units, vocabulary).select(F.col("movie_id").alias("id"), "vec")
    profiles = user_profiles(units, ratings).withColumnRenamed("user_id", "movie_id")
    users = feature_vectors(
        profiles, vocabulary, ids=ratings.select(F.col("user_id").alias("movie_id")).distinct()
    ).select(F.col("movie_id").alias("id"), "vec")
    return users, movies


def content_recommend(
    units: DataFrame, ratings: DataFrame, n: int = 10, targets: DataFrame | None = None
) -> DataFrame:
    """Top ``n`` movies a user has not rated, by similarity to the rated ones."""
    if targets is not None:
        ratings = ratings.join(targets.select("user_id").distinct(), "user_id", "left_semi")
    users, movies = _both_vectors(units, ratings)
    rated = ratings.select(F.col("user_id").alias("id"), F.col("movie_id").alias("other_id"))
    best = grid_top_k(users, movies, n, exclude=rated)
    return best.where(F.col("score") >= 0).select(
        F.col("id").alias("user_id"), F.col("other_id").alias("movie_id"), "score", "rank"
    )


def content_predict(units: DataFrame, ratings: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same score for given (user, movie) pairs; unknown ones score 0."""
    users, movies = _both_vectors(units, ratings)
    p = users.select(F.col("id").alias("user_id"), F.col("vec").alias("p"))
    q = movies.select(F.col("id").alias("movie_id"), F.col("vec").alias("q"))
    score: Column = F.coalesce(dot("p", "q"), F.lit(0.0))
    return (
        pairs.select("user_id", "movie_id")
        .join(p, "user_id", "left")
        .join(q, "movie_id", "left")
        .select("user_id", "movie_id", score.alias("score"))
    )
