"""Catalogue, history, popularity and recommendation-log questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions.columns import DEFAULT_PERIOD_DAYS, PERIOD_DAYS
from tastemill.functions.ranking import page, page_per
from tastemill.operators.quality import check_search_bounds

FAVOURITE_GENRES = 3


def _moment(df: DataFrame, column: str, as_of: str) -> Column:
    """``as_of`` in the timestamp type of a column."""
    return F.lit(as_of).cast(df.schema[column].dataType)


def _days(n: int) -> Column:
    return F.make_dt_interval(days=F.lit(n))


def search_movies(
    movies: DataFrame,
    query: str | None = None,
    genres: Sequence[str] | None = None,
    year_min: int | None = None,
    year_max: int | None = None,
    rating_min: float | None = None,
    limit: int = 20,
    offset: int = 0,
) -> DataFrame:
    """Movies that satisfy every given filter, best rated first, with the total."""
    check_search_bounds(year_min, year_max, rating_min, limit, offset)
    found = movies
    if query:
        needle = F.lit(query.lower())
        found = found.where(
            F.contains(F.lower("title"), needle) | F.contains(F.lower("description"), needle)
        )
    if genres:
        wanted = F.array(*[F.lit(g) for g in genres])
        found = found.where(F.arrays_overlap("genres", wanted))
    if year_min is not None:
        found = found.where(F.col("release_year") >= year_min)
    if year_max is not None:
        found = found.where(F.col("release_year") <= year_max)
    if rating_min is not None:
        found = found.where(F.col("imdb_rating") >= rating_min)
    total = found.agg(F.count(F.lit(1))).scalar()
    order = [F.col("imdb_rating").desc_nulls_last(), F.col("movie_id")]
    return page(found, order, limit, offset).withColumn("total", total)


def lookup_movies(movies: DataFrame, ids: DataFrame) -> DataFrame:
    """Catalogue rows of a set of ids."""
    return movies.join(ids.select("movie_id").distinct(), "movie_id", "left_semi")


def user_statistics(interactions: DataFrame, movies: DataFrame | None = None) -> DataFrame:
    """Counts and average rating per user; with a catalogue also favourite genres.

    The two distinct counts are taken from one (user, movie) aggregation, so the
    rows shuffle once with map-side combine. A user with a third of all rows is
    already spread over movies in the first step.
    """
    rated = F.col("rating").isNotNull()
    per_movie = interactions.groupBy("user_id", "movie_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("rating").alias("rating_sum"),
        F.count("rating").alias("rating_n"),
        F.max(rated).alias("was_rated"),
        F.max(F.coalesce(F.col("interaction_type") == "watch", F.lit(False))).alias("was_watched"),
    )
    stats = per_movie.groupBy("user_id").agg(
        F.sum("n").alias("interaction_count"),
        F.coalesce(F.try_divide(F.sum("rating_sum"), F.sum("rating_n")), F.lit(0.0)).alias(
            "average_rating"
        ),
        F.count_if(F.col("was_rated") & F.col("movie_id").isNotNull()).alias("rated_movies"),
        F.count_if(F.col("was_watched") & F.col("movie_id").isNotNull()).alias("watched_movies"),
    )
    if movies is None:
        return stats
    favourites = favourite_genres(per_movie.select("user_id", "movie_id", "n"), movies)
    return stats.join(favourites, "user_id", "left").withColumn(
        "favorite_genres",
        F.coalesce("favorite_genres", F.array().cast("array<string>")),
    )


def favourite_genres(
    user_movies: DataFrame, movies: DataFrame, top: int = FAVOURITE_GENRES
) -> DataFrame:
    """Most frequent genres per user; ``user_movies`` carries counts ``n``."""
    counts = (
        user_movies.join(movies.select("movie_id", "genres"), "movie_id")
        .select("user_id", "n", F.explode("genres").alias("genre"))
        .groupBy("user_id", "genre")
        .agg(F.sum("n").alias("uses"))
    )
    w = Window.partitionBy("user_id").orderBy(F.col("uses").desc(), "genre")
    return (
        counts.withColumn("nth", F.row_number().over(w))
        .where(F.col("nth") <= top)
        .groupBy("user_id")
        .agg(F.sort_array(F.collect_list(F.struct("nth", "genre"))).alias("g"))
        .select("user_id", F.col("g.genre").alias("favorite_genres"))
    )


def user_profiles(
    users: DataFrame, interactions: DataFrame, ids: DataFrame | None = None
) -> DataFrame:
    """Users with preferences and statistics; users without interactions get zeros."""
    if ids is not None:
        wanted = ids.select("user_id").distinct()
        users = users.join(wanted, "user_id", "left_semi")
        interactions = interactions.join(wanted, "user_id", "left_semi")
    stats = user_statistics(interactions)
    counts = [c for c in stats.columns if c not in ("user_id", "average_rating")]
    return users.join(stats, "user_id", "left").fillna(0, counts).fillna(0.0, ["average_rating"])


def popular_movies(
    interactions: DataFrame,
    movies: DataFrame,
    as_of: str,
    period: str = "month",
    limit: int = 20,
) -> DataFrame:
    """Most used movies of a period; ``all_time`` also lists unused movies.

    Interactions are counted per movie before the join, so the catalogue is
    joined with one row per movie.
    """
    days = PERIOD_DAYS.get(period, DEFAULT_PERIOD_DAYS)
    if days is not None:
        since = _moment(interactions, "timestamp", as_of) - _days(days)
        interactions = interactions.where(F.col("timestamp") >= since)
    counts = interactions.groupBy("movie_id").agg(F.count(F.lit(1)).alias("interaction_count"))
    how = "left" if days is None else "inner"
    joined = movies.join(counts, "movie_id", how).fillna(0, ["interaction_count"])
    return page(
        joined,
        [
            F.col("interaction_count").desc(),
            F.col("imdb_rating").desc_nulls_last(),
            F.col("movie_id"),
        ],
        limit,
    )


def genre_counts(movies: DataFrame) -> DataFrame:
    return (
        movies.select(F.explode("genres").alias("genre"))
        .groupBy("genre")
        .agg(F.count(F.lit(1)).alias("movie_count"))
        .orderBy(F.col("movie_count").desc(), "genre")
    )


def _newest(column: str, tie: str) -> list[Column]:
    return [F.col(column).desc_nulls_last(), F.col(tie)]


def user_history(
    interactions: DataFrame,
    movies: DataFrame,
    users: DataFrame | None = None,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """A page of each user's interactions, newest first, with movie titles.

    The page is cut before the catalogue is joined.
    """
    if users is not None:
        interactions = interactions.join(
            users.select("user_id").distinct(), "user_id", "left_semi"
        )
    rows = page_per(
        interactions, ["user_id"], _newest("timestamp", "interaction_id"), limit, offset
    )
    titles = movies.select("movie_id", F.col("title").alias("movie_title"))
    return rows.join(titles, "movie_id", "left")


def movie_history(
    interactions: DataFrame,
    users: DataFrame,
    movies: DataFrame | None = None,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """A page of each movie's interactions, newest first, with user preferences."""
    if movies is not None:
        interactions = interactions.join(
            movies.select("movie_id").distinct(), "movie_id", "left_semi"
        )
    rows = page_per(
        interactions, ["movie_id"], _newest("timestamp", "interaction_id"), limit, offset
    )
    prefs = users.select("user_id", F.col("preferences").alias("user_preferences"))
    return rows.join(prefs, "user_id", "left")


def recent_interactions(
    interactions: DataFrame,
    movies: DataFrame,
    users: DataFrame,
    as_of: str,
    hours: int = 24,
    limit: int = 100,
) -> DataFrame:
    """Newest interactions of the last hours with title and preferences."""
    since = _moment(interactions, "timestamp", as_of) - F.make_dt_interval(hours=F.lit(hours))
    rows = page(
        interactions.where(F.col("timestamp") >= since),
        _newest("timestamp", "interaction_id"),
        limit,
    )
    return rows.join(
        movies.select("movie_id", F.col("title").alias("movie_title")), "movie_id", "left"
    ).join(users.select("user_id", F.col("preferences").alias("user_preferences")), "user_id", "left")


def enrich_recommendations(recs: DataFrame, movies: DataFrame) -> DataFrame:
    """Recommendations with catalogue columns; unknown movies drop out."""
    wanted = ["movie_id", "title", "genres", "poster_url", "release_year"]
    return recs.join(movies.select(*[c for c in wanted if c in movies.columns]), "movie_id")


def user_recommendation_log(
    log: DataFrame, movies: DataFrame, users: DataFrame | None = None, limit: int = 20
) -> DataFrame:
    """Each user's newest logged recommendations with titles."""
    if users is not None:
        log = log.join(users.select("user_id").distinct(), "user_id", "left_semi")
    rows = page_per(log, ["user_id"], _newest("generated_at", "recommendation_id"), limit)
    titles = movies.select("movie_id", F.col("title").alias("movie_title"))
    return rows.join(titles, "movie_id", "left")


def _since_midnight(log: DataFrame, as_of: str, days: int) -> DataFrame:
    kind = log.schema["generated_at"].dataType
    since = F.date_sub(F.lit(as_of).cast("timestamp_ntz").cast("date"), days).cast(kind)
    return log.where(F.col("generated_at") >= since)


def _ctr_columns() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_recommendations"),
        F.count("served_at").alias("served_recommendations"),
        F.count_if(F.col("clicked")).alias("clicked_recommendations"),
    ]


def _with_ctr(counts: DataFrame) -> DataFrame:
    rate = F.try_divide("clicked_recommendations", "served_recommendations")
    return counts.withColumn("click_through_rate", F.coalesce(rate, F.lit(0.0)))


def recommendation_stats(log: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Totals and click-through rate since midnight ``days`` ago, one row."""
    return _with_ctr(_since_midnight(log, as_of, days).agg(*_ctr_columns()))


def algorithm_ctr(log: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """The same figures per algorithm."""
    return _with_ctr(_since_midnight(log, as_of, days).groupBy("algorithm").agg(*_ctr_columns()))


def popular_algorithms(log: DataFrame, as_of: str, days: int = 7, limit: int = 5) -> DataFrame:
    counts = (
        _since_midnight(log, as_of, days)
        .groupBy("algorithm")
        .agg(F.count(F.lit(1)).alias("recommendation_count"))
    )
    return page(counts, [F.col("recommendation_count").desc(), F.col("algorithm")], limit)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table_name, row_count)`` of the given tables."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in tables.items()
    ]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out
