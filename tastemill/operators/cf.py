"""Neighbourhood recommenders over the sparse rating table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions.columns import clip, rank_score
from tastemill.functions.products import dot_products
from tastemill.functions.ranking import dense_index, top_n, with_row
from tastemill.functions.skew import KeyCounts, hot_keys, key_counts, salted_join
from tastemill.operators import neighbour_tiles as nt
from tastemill.operators import pair_tiles
from tastemill.operators.matrix import item_count, user_means
from tastemill.session import materialise

# Fixed values --------------------------------------------------------------
NEIGHBOURS = 5
TOP_N = 10
MAX_BATCH_USERS = 100
MAX_BATCH_ITEMS = 20
# ---------------------------------------------------------------------------

# keys with more rows than this are multiplied in blocks instead of joined
DEGREE_LIMIT = 1000


def _hot(cells: DataFrame, key: str, counts: KeyCounts, name: str | None = None):
    """Hot keys under the name used in the join, or None when there are none."""
    if not counts.has_hot(key):
        return None
    return hot_keys(cells, key).withColumnRenamed(key, name or key)


def unit_cells(cells: DataFrame, row: str) -> DataFrame:
    """Cells divided by the length of their row, so dot products are cosines.

    Scaling the cells costs one join per cell instead of two per pair.
    """
    norms = cells.groupBy(row).agg(F.sqrt(F.sum(F.col("rating") * F.col("rating"))).alias("norm"))
    return cells.join(norms, row).select(
        "user_id", "movie_id", (F.col("rating") / F.col("norm")).alias("rating")
    )


def cosine(
    cells: DataFrame,
    row: str,
    key: str,
    targets: DataFrame | None = None,
    degree_limit: int = DEGREE_LIMIT,
    counts: KeyCounts | None = None,
) -> DataFrame:
    """``(id_a, id_b, sim)``: every two rows that share a key.

    Unordered pairs (``id_a < id_b``) without ``targets``. With ``targets`` the
    filter sits below the pairing: only target rows appear as ``id_a``.
    Without ``targets`` and keys above ``degree_limit``, pairs form in tiles.
    """
    counts = counts or key_counts(cells, key)
    how = {"row": row, "key": key, "degree_limit": degree_limit, "largest": counts.largest[key]}
    units = unit_cells(cells, row)
    if targets is None and counts.largest[key] <= degree_limit:
        dots = pair_tiles.row_dots(units, row, key)
    elif targets is None:
        dots = dot_products(units, **how)
    else:
        chosen = units.join(targets.select(row).distinct(), row, "left_semi")
        dots = dot_products(chosen, units, **how)
    return dots.withColumnRenamed("dot", "sim")


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each unordered pair in both directions."""
    return pairs.unionByName(
        pairs.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), "sim")
    )


def user_similarity_cosine(cells: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    return cosine(cells, "user_id", "movie_id", targets)


def item_similarity_cosine(cells: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    return cosine(cells, "movie_id", "user_id", targets)


def _moments(cells: DataFrame, n_items: Column) -> DataFrame:
    n = n_items.cast("double")
    total, squares = F.sum("rating"), F.sum(F.col("rating") * F.col("rating"))
    return cells.groupBy("user_id").agg(
        total.alias("total"), (n * squares - total * total).alias("spread")
    )


def pearson(dots: DataFrame, cells: DataFrame, n_items: Column) -> DataFrame:
    """Correlation of zero-filled rows from ``(id_a, id_b, dot)``; no spread gives NULL."""
    m = _moments(cells, n_items)
    a = m.select(F.col("user_id").alias("id_a"), F.col("total").alias("ta"), F.col("spread").alias("sa"))
    b = m.select(F.col("user_id").alias("id_b"), F.col("total").alias("tb"), F.col("spread").alias("sb"))
    top = n_items.cast("double") * F.col("dot") - F.col("ta") * F.col("tb")
    return (
        dots.join(a, "id_a")
        .join(b, "id_b")
        .select(
            "id_a", "id_b",
            F.try_divide(top, F.sqrt(F.col("sa") * F.col("sb"))).alias("sim"),
        )
    )


def user_similarity_pearson(
    cells: DataFrame, n_items: Column, pairs: DataFrame | None = None
) -> DataFrame:
    """Pearson similarity of users over the item universe.

    Without ``pairs``: users that share an item. With ``pairs`` (``id_a``,
    ``id_b``): exactly those, where sharing nothing still correlates.
    """
    largest = key_counts(cells, "movie_id").largest["movie_id"]
    if pairs is None and largest <= DEGREE_LIMIT:
        return _tiled_pearson(cells, n_items)
    dots = dot_products(
        cells, row="user_id", key="movie_id", degree_limit=DEGREE_LIMIT, largest=largest
    )
    if pairs is not None:
        full = dots.unionByName(
            dots.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), "dot")
        )
        dots = pairs.join(full, ["id_a", "id_b"], "left").fillna(0.0, ["dot"])
    return pearson(dots, cells, n_items)


def _tiled_pearson(cells: DataFrame, n_items: Column) -> DataFrame:
    """The same, with what a user adds to the formula carried to its pairs: no join follows them."""
    root = F.when(F.col("spread") > 0, F.sqrt("spread"))
    scaled = cells.join(_moments(cells, n_items), "user_id").select(
        "user_id", "movie_id",
        F.coalesce(F.col("rating") / root, "rating").alias("rating"),
        (F.col("total") / root).alias("own"),
    )
    dots = pair_tiles.row_dots(scaled, "user_id", "movie_id", carry="own")
    sim = n_items.cast("double") * F.col("dot") - F.col("own_a") * F.col("own_b")
    return dots.select("id_a", "id_b", F.when(~F.isnan(sim), sim).alias("sim"))


def with_similarity(met: DataFrame, sims: DataFrame, one: str, other: str) -> DataFrame:
    """Look up the similarity of two columns in a table of unordered pairs.

    The pair is put in order on the fly, so the pair table is neither doubled
    nor shuffled in both directions.
    """
    return met.withColumns(
        {"id_a": F.least(one, other), "id_b": F.greatest(one, other)}
    ).join(sims, ["id_a", "id_b"]).drop("id_a", "id_b")


def k_nearest_rated(neighbours: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """The ``k`` most similar usable neighbours per (user, movie).

    ``neighbours`` is ``(user_id, movie_id, neighbour, sim, ...)``.
    """
    w = Window.partitionBy("user_id", "movie_id").orderBy(rank_score("sim").desc(), "neighbour")
    return neighbours.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _weighted(nearest: DataFrame, value: str) -> DataFrame:
    return nearest.groupBy("user_id", "movie_id").agg(
        F.try_divide(
            F.sum(F.col("sim") * F.col(value)), F.sum(F.abs("sim"))
        ).alias("estimate")
    )


def _known(pairs: DataFrame, cells: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs with flags whether the user and the movie are known at all."""
    users = cells.select("user_id").distinct().withColumn("user_known", F.lit(True))
    listed = items.select("movie_id").distinct().withColumn("movie_known", F.lit(True))
    return pairs.join(users, "user_id", "left").join(listed, "movie_id", "left")


def _user_estimates(neighbours: DataFrame, k: int) -> DataFrame:
    return _weighted(k_nearest_rated(neighbours, k), "deviation")


def _deviations(cells: DataFrame, means: DataFrame) -> DataFrame:
    return cells.join(means, "user_id").select(
        F.col("user_id").alias("neighbour"),
        "movie_id",
        (F.col("rating") - F.col("user_mean")).alias("deviation"),
    )


def _similar(
    cells: DataFrame, row: str, key: str, targets: DataFrame | None, counts: KeyCounts
) -> DataFrame:
    sims = cosine(cells, row, key, targets, counts=counts)
    return both_ways(sims) if targets is None else sims


def _named(sims: DataFrame) -> DataFrame:
    return sims.select(F.col("id_a").alias("user_id"), F.col("id_b").alias("neighbour"), "sim")


def user_cf_predict(
    cells: DataFrame,
    pairs: DataFrame,
    items: DataFrame,
    k: int = NEIGHBOURS,
    metric: str = "cosine",
    targets: DataFrame | None = None,
) -> DataFrame:
    """Predicted rating for each (user, movie) of ``pairs``.

    User mean plus the similarity-weighted deviation of the ``k`` nearest users
    who rated the movie, clipped to 0..5. No such user: the user mean. Unknown
    user or movie: 0. ``targets`` may list the users of ``pairs`` when they are
    few, to keep the similarities to them in the joins.
    """
    pairs = pairs.select("user_id", "movie_id").distinct()
    n_items = item_count(items)
    counts = key_counts(cells, "movie_id")
    means = user_means(cells, n_items)
    if metric == "cosine" and counts.largest["movie_id"] <= DEGREE_LIMIT:
        pairs = materialise(pairs)
        estimates = pair_tiles.nearest_estimates(cells, pairs, "user_id", "movie_id", k, n_items)
    else:
        estimates = _user_pair_estimates(cells, pairs, n_items, means, counts, k, metric, targets)
    score = (
        F.when(F.col("user_known").isNull() | F.col("movie_known").isNull(), F.lit(0.0))
        .when(F.col("estimate").isNull(), F.col("user_mean"))
        .otherwise(clip(F.col("user_mean") + F.col("estimate")))
    )
    return (
        _known(pairs, cells, items)
        .join(means, "user_id", "left")
        .join(estimates, ["user_id", "movie_id"], "left")
        .select("user_id", "movie_id", score.alias("score"))
    )


def _user_pair_estimates(
    cells: DataFrame,
    pairs: DataFrame,
    n_items: Column,
    means: DataFrame,
    counts: KeyCounts,
    k: int,
    metric: str,
    targets: DataFrame | None,
) -> DataFrame:
    """``(user_id, movie_id, estimate)`` of ``pairs`` by joins."""
    raters = _deviations(cells, means)
    met = salted_join(
        raters, pairs, "movie_id", _hot(cells, "movie_id", counts), ["neighbour"]
    ).where(F.col("neighbour") != F.col("user_id"))
    if metric == "cosine" and targets is None:
        sims = cosine(cells, "user_id", "movie_id", counts=counts)
        alike = with_similarity(met, sims, "user_id", "neighbour")
    elif metric == "cosine":
        sims = cosine(cells, "user_id", "movie_id", targets, counts=counts)
        alike = met.join(_named(sims), ["user_id", "neighbour"])
    elif metric == "pearson":
        wanted = met.select(
            F.col("user_id").alias("id_a"), F.col("neighbour").alias("id_b")
        ).distinct()
        sims = user_similarity_pearson(cells, n_items, wanted).where(F.col("sim").isNotNull())
        alike = met.join(_named(sims), ["user_id", "neighbour"])
    else:
        raise ValueError(f"unknown similarity metric: {metric}")
    return _user_estimates(alike, k)


def _recommend(
    method: str,
    joined: Callable[..., DataFrame],
    cells: DataFrame,
    items: DataFrame,
    n: int,
    k: int,
    targets: DataFrame | None,
) -> DataFrame:
    """Users in tiles; those who alone meet too many rows for a tile go through ``joined``.

    Where few movies are rated, the item-based method deals out their similarities instead.
    """
    data = nt.coded(cells, items)
    asked = data.users if targets is None else data.users.join(
        targets.select("user_id").distinct(), "user_id", "left_semi"
    )

    def best(scored: DataFrame) -> DataFrame:
        return (
            top_n(scored, n, by="u", tie="m")
            .join(data.users, "u")
            .join(data.movies, "m")
            .select("user_id", "movie_id", "score", "rank")
        )

    rated = data.cells.select("m").distinct().limit(nt.FEW_MOVIES + 1).count()
    if method == "item" and rated <= nt.FEW_MOVIES:
        return best(nt.few_movies_scores(data, asked, n, k))
    work = nt.user_work(data.cells).join(asked, "u")
    if method == "user":
        work = nt.nearest_work(work, data.cells, k)
    work = materialise(work)
    light = work.where(F.col("work") <= nt.USER_WORK)
    tiles, count = nt.user_tiles(
        data.cells, light, cells.sparkSession.sparkContext.defaultParallelism
    )
    recs = best(nt.tile_scores(data, tiles, count, method, n, k))
    heavy = work.where(F.col("work") > nt.USER_WORK).select("user_id")
    if heavy.isEmpty():
        return recs
    return recs.unionByName(joined(cells, items, n, k, heavy))


def user_cf_recommend(
    cells: DataFrame,
    items: DataFrame,
    n: int = TOP_N,
    k: int = NEIGHBOURS,
    targets: DataFrame | None = None,
) -> DataFrame:
    """Top ``n`` unrated movies per user: ``(user_id, movie_id, score, rank)``.

    Movies no neighbour rated all score the user mean, so only the first ``n``
    of them per user can matter.
    """
    return _recommend("user", _user_cf_joined, cells, items, n, k, targets)


def _user_cf_joined(
    cells: DataFrame,
    items: DataFrame,
    n: int = TOP_N,
    k: int = NEIGHBOURS,
    targets: DataFrame | None = None,
) -> DataFrame:
    """The same rows by joins.

    The movies that score the mean are read off the gaps between the movies
    that have a score, in the same pass that ranks those.
    """
    index = dense_index(items, "movie_id")
    n_items = index.agg(F.count(F.lit(1)))
    means = user_means(cells, n_items.scalar())
    counts = key_counts(cells, "movie_id", "user_id")
    sims = _similar(cells, "user_id", "movie_id", targets, counts).select(
        F.col("id_a").alias("user_id"), F.col("id_b").alias("neighbour"), "sim"
    )
    met = salted_join(
        sims, _deviations(cells, means), "neighbour",
        _hot(cells, "user_id", counts, "neighbour"), ["user_id"],
    )
    estimates = _user_estimates(met, k)
    asked = cells if targets is None else cells.join(
        targets.select("user_id").distinct(), "user_id", "left_semi"
    )
    users = asked.select("user_id").distinct().join(means, "user_id")
    rated = asked.select("user_id", "movie_id", F.lit(True).alias("rated"))
    taken = (
        estimates.join(rated, ["user_id", "movie_id"], "full")
        .join(users, "user_id")
        .join(index, "movie_id")
        .select(
            "user_id", "idx", "user_mean",
            F.when(F.col("rated").isNull(), clip(F.col("user_mean") + F.col("estimate"))).alias(
                "score"
            ),
        )
    )
    ends = with_row(users, n_items, "idx").select(
        "user_id", "idx", "user_mean", F.lit(None).cast("double").alias("score")
    )
    rows = taken.unionByName(ends)
    by_item = Window.partitionBy("user_id").orderBy("idx")
    earlier = by_item.rowsBetween(Window.unboundedPreceding, -1)
    by_score = Window.partitionBy("user_id").orderBy(rank_score("score").desc_nulls_last(), "idx")
    ranked = (
        rows.withColumn("first", F.coalesce(F.lag("idx").over(by_item), F.lit(-1)) + 1)
        .withColumn("free", F.col("idx") - F.col("first"))
        .withColumn("before", F.coalesce(F.sum("free").over(earlier), F.lit(0)))
        .withColumn("place", F.row_number().over(by_score))
    )
    room = F.least(F.col("free"), F.lit(n) - F.col("before"))
    fill = F.when(
        (room > 0) & (F.col("user_mean") > 0),
        F.sequence(F.col("first"), F.col("first") + room - 1),
    )
    own = F.when(
        (F.col("place") <= n) & (F.col("score") > 0),
        F.array(F.struct("idx", "score")),
    )
    none = F.array().cast("array<struct<idx:bigint,score:double>>")
    picks = F.concat(
        F.coalesce(own, none),
        F.coalesce(
            F.transform(
                fill, lambda i: F.struct(i.alias("idx"), F.col("user_mean").alias("score"))
            ),
            none,
        ),
    )
    chosen = ranked.select("user_id", F.inline(picks))
    return top_n(chosen, n, tie="idx").join(index, "idx").select(
        "user_id", "movie_id", "score", "rank"
    )


def item_cf_predict(
    cells: DataFrame,
    pairs: DataFrame,
    items: DataFrame,
    k: int = NEIGHBOURS,
) -> DataFrame:
    """Weighted mean of the user's ratings of the ``k`` most similar movies; none: 0."""
    pairs = pairs.select("user_id", "movie_id").distinct()
    counts = key_counts(cells, "user_id")
    if counts.largest["user_id"] <= DEGREE_LIMIT:
        pairs = materialise(pairs)
        # the movies that are alike are those the user rated: a user is a movie's key
        estimates = pair_tiles.nearest_estimates(cells, pairs, "movie_id", "user_id", k)
    else:
        estimates = _item_pair_estimates(cells, pairs, counts, k)
    score = clip(F.coalesce("estimate", F.lit(0.0)))
    return pairs.join(estimates, ["user_id", "movie_id"], "left").select(
        "user_id", "movie_id", score.alias("score")
    )


def _item_pair_estimates(
    cells: DataFrame, pairs: DataFrame, counts: KeyCounts, k: int
) -> DataFrame:
    """``(user_id, movie_id, estimate)`` of ``pairs`` by joins."""
    own = cells.select("user_id", F.col("movie_id").alias("neighbour"), "rating")
    met = salted_join(
        own, pairs, "user_id", _hot(cells, "user_id", counts), ["neighbour"]
    ).where(F.col("neighbour") != F.col("movie_id"))
    sims = cosine(cells, "movie_id", "user_id", counts=counts)
    alike = with_similarity(met, sims, "movie_id", "neighbour")
    return _weighted(k_nearest_rated(alike, k), "rating")


def item_cf_recommend(
    cells: DataFrame,
    items: DataFrame,
    n: int = TOP_N,
    k: int = NEIGHBOURS,
    targets: DataFrame | None = None,
) -> DataFrame:
    """Top ``n`` unrated movies per user from the movies most similar to rated ones."""
    return _recommend("item", _item_cf_joined, cells, items, n, k, targets)


def _item_cf_joined(
    cells: DataFrame,
    items: DataFrame,
    n: int = TOP_N,
    k: int = NEIGHBOURS,
    targets: DataFrame | None = None,
) -> DataFrame:
    """The same rows by joins."""
    asked = cells if targets is None else cells.join(
        targets.select("user_id").distinct(), "user_id", "left_semi"
    )
    # only movies the asked users rated are needed on one side
    anchors = None if targets is None else asked.select("movie_id").distinct()
    counts = key_counts(cells, "user_id", "movie_id")
    sims = _similar(cells, "movie_id", "user_id", anchors, counts).select(
        F.col("id_a").alias("neighbour"), F.col("id_b").alias("movie_id"), "sim"
    )
    own = asked.select("user_id", F.col("movie_id").alias("neighbour"), "rating")
    met = salted_join(
        own, sims, "neighbour",
        _hot(cells, "movie_id", counts, "neighbour"), ["user_id"],
    )
    estimates = _weighted(k_nearest_rated(met, k), "rating").select(
        "user_id", "movie_id", clip("estimate").alias("score")
    )
    fresh = estimates.where(F.col("score") > 0).join(
        asked.select("user_id", "movie_id"), ["user_id", "movie_id"], "left_anti"
    )
    return top_n(fresh, n)


def check_batch(targets: DataFrame, n: int) -> None:
    """Limits of one batch request."""
    if not 1 <= n <= MAX_BATCH_ITEMS:
        raise ValueError(f"between 1 and {MAX_BATCH_ITEMS} recommendations per user")
    if len(targets.select("user_id").distinct().limit(MAX_BATCH_USERS + 1).take(
        MAX_BATCH_USERS + 1
    )) > MAX_BATCH_USERS:
        raise ValueError(f"at most {MAX_BATCH_USERS} users per batch")


def batch_recommend(
    recommend: Callable[[DataFrame, int], DataFrame], targets: DataFrame, n: int = TOP_N
) -> DataFrame:
    """Run a recommender for a checked batch of users."""
    check_batch(targets, n)
    return recommend(targets, n)
