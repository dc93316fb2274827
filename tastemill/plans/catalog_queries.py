"""Catalogue, history, popularity and recommendation-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tastemill.operators import catalog
from tastemill.plans.registry import query
from tastemill.plans.shared import MOMENT, moment, r6
from tastemill.sources.views import AS_OF_EVENTS, AS_OF_LOG, Views


@query(
    "popular_movies",
    f"""
    SELECT m.movie_id, m.title, m.release_year, round(m.imdb_rating, 6) AS imdb_rating,
           c.n AS interaction_count
    FROM v_movies m JOIN (
        SELECT movie_id, count(*) AS n FROM v_events
        WHERE "timestamp" >= TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL 30 DAY GROUP BY movie_id
    ) c ON m.movie_id = c.movie_id
    ORDER BY c.n DESC, m.imdb_rating DESC, m.movie_id LIMIT 20""",
)
def popular_movies(v: Views):
    out = catalog.popular_movies(v.events(), v.movies(), AS_OF_EVENTS, "month", 20)
    return out.select(
        "movie_id", "title", "release_year", r6("imdb_rating"), "interaction_count"
    )


@query(
    "popular_movies_all_time",
    """
    SELECT m.movie_id, m.title, round(m.imdb_rating, 6) AS imdb_rating,
           count(e.interaction_id) AS interaction_count
    FROM v_movies m LEFT JOIN v_events e ON m.movie_id = e.movie_id
    GROUP BY m.movie_id, m.title, m.imdb_rating
    ORDER BY interaction_count DESC, m.imdb_rating DESC, m.movie_id LIMIT 150""",
)
def popular_movies_all_time(v: Views):
    out = catalog.popular_movies(v.events(), v.movies(), AS_OF_EVENTS, "all_time", 150)
    return out.select("movie_id", "title", r6("imdb_rating"), "interaction_count")


@query(
    "search_movies",
    """
    SELECT movie_id, title, release_year, round(imdb_rating, 6) AS imdb_rating,
           count(*) OVER () AS total
    FROM v_movies
    WHERE (contains(lower(title), 'ring') OR contains(lower(description), 'ring'))
      AND list_has_any(genres, ['red', 'hot', 'small']) AND release_year >= 1955
      AND release_year <= 1995 AND imdb_rating >= 1.0
    ORDER BY v_movies.imdb_rating DESC, movie_id LIMIT 20 OFFSET 5""",
)
def search_movies(v: Views):
    out = catalog.search_movies(
        v.movies(), "RING", ["red", "hot", "small"], 1955, 1995, 1.0, limit=20, offset=5
    )
    return out.select("movie_id", "title", "release_year", r6("imdb_rating"), "total")


@query(
    "lookup_movies",
    """
    SELECT movie_id, title, array_to_string(genres, ', ') AS genres, release_year, language
    FROM v_movies WHERE movie_id IN (SELECT movie_id FROM v_events)""",
)
def lookup_movies(v: Views):
    out = catalog.lookup_movies(v.movies(), v.events().select("movie_id"))
    return out.select(
        "movie_id", "title", F.array_join("genres", ", ").alias("genres"), "release_year", "language"
    )


STATS_SQL = """
    SELECT user_id, count(*) AS interaction_count, coalesce(avg(rating), 0.0) AS average_rating,
           count(DISTINCT CASE WHEN rating IS NOT NULL THEN movie_id END) AS rated_movies,
           count(DISTINCT CASE WHEN interaction_type = 'watch' THEN movie_id END) AS watched_movies
    FROM v_events GROUP BY user_id"""


@query(
    "user_profiles",
    f"""
    WITH s AS ({STATS_SQL})
    SELECT u.user_id, u.segment, u.nation, coalesce(interaction_count, 0) AS interaction_count,
           round(coalesce(average_rating, 0.0), 6) AS average_rating,
           coalesce(rated_movies, 0) AS rated_movies, coalesce(watched_movies, 0) AS watched_movies
    FROM v_users u LEFT JOIN s ON u.user_id = s.user_id""",
)
def user_profiles(v: Views):
    out = catalog.user_profiles(v.users(), v.events())
    return out.select(
        "user_id",
        F.col("preferences")["segment"].alias("segment"),
        F.col("preferences")["nation"].alias("nation"),
        "interaction_count",
        r6("average_rating"),
        "rated_movies",
        "watched_movies",
    )


@query(
    "user_statistics",
    f"""
    WITH s AS ({STATS_SQL}),
    g AS (
        SELECT user_id, genre, count(*) AS uses
        FROM (SELECT e.user_id, unnest(m.genres) AS genre
              FROM v_events e JOIN v_movies m ON e.movie_id = m.movie_id)
        GROUP BY user_id, genre),
    t AS (
        SELECT user_id, genre, row_number() OVER (PARTITION BY user_id ORDER BY uses DESC, genre) rn
        FROM g),
    f AS (
        SELECT user_id, string_agg(genre, ', ' ORDER BY rn) AS favorite_genres
        FROM t WHERE rn <= 3 GROUP BY user_id)
    SELECT s.user_id, interaction_count, round(average_rating, 6) AS average_rating, rated_movies,
           watched_movies, coalesce(favorite_genres, '') AS favorite_genres
    FROM s LEFT JOIN f ON s.user_id = f.user_id""",
)
def user_statistics(v: Views):
    out = catalog.user_statistics(v.events(), v.movies())
    return out.select(
        "user_id",
        "interaction_count",
        r6("average_rating"),
        "rated_movies",
        "watched_movies",
        F.array_join("favorite_genres", ", ").alias("favorite_genres"),
    )


@query(
    "user_history",
    f"""
    SELECT user_id, row_no, interaction_id, e.movie_id, movie_title, interaction_type, rating,
           strftime("timestamp", '{MOMENT}') AS "timestamp"
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id
                     ORDER BY "timestamp" DESC, interaction_id) AS row_no FROM v_events) e
    LEFT JOIN (SELECT movie_id, title AS movie_title FROM v_movies) m ON e.movie_id = m.movie_id
    WHERE row_no > 5 AND row_no <= 55""",
)
def user_history(v: Views):
    out = catalog.user_history(v.events(), v.movies(), limit=50, offset=5)
    return out.select(
        "user_id", F.col("row_no").cast("bigint"), "interaction_id", "movie_id", "movie_title",
        "interaction_type", "rating", moment("timestamp"),
    )


@query(
    "movie_history",
    f"""
    SELECT e.movie_id, row_no, interaction_id, e.user_id, segment, nation, interaction_type,
           strftime("timestamp", '{MOMENT}') AS "timestamp"
    FROM (SELECT *, row_number() OVER (PARTITION BY movie_id
                     ORDER BY "timestamp" DESC, interaction_id) AS row_no FROM v_events) e
    LEFT JOIN v_users u ON e.user_id = u.user_id
    WHERE row_no <= 50""",
)
def movie_history(v: Views):
    out = catalog.movie_history(v.events(), v.users())
    return out.select(
        "movie_id", F.col("row_no").cast("bigint"), "interaction_id", "user_id",
        F.col("user_preferences")["segment"].alias("segment"),
        F.col("user_preferences")["nation"].alias("nation"),
        "interaction_type", moment("timestamp"),
    )


@query(
    "recent_interactions",
    f"""
    SELECT interaction_id, e.user_id, e.movie_id, title AS movie_title, segment,
           strftime("timestamp", '{MOMENT}') AS "timestamp"
    FROM v_events e LEFT JOIN v_movies m ON e.movie_id = m.movie_id
         LEFT JOIN v_users u ON e.user_id = u.user_id
    WHERE "timestamp" >= TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL 24 HOUR
    ORDER BY e."timestamp" DESC, interaction_id LIMIT 100""",
)
def recent_interactions(v: Views):
    out = catalog.recent_interactions(v.events(), v.movies(), v.users(), AS_OF_EVENTS)
    return out.select(
        "interaction_id", "user_id", "movie_id", "movie_title",
        F.col("user_preferences")["segment"].alias("segment"), moment("timestamp"),
    )


@query(
    "enrich_recommendations",
    """
    SELECT recommendation_id, r.user_id, r.movie_id, title,
           array_to_string(genres, ', ') AS genres, release_year, score
    FROM v_recs r JOIN v_movies m ON r.movie_id = m.movie_id""",
)
def enrich_recommendations(v: Views):
    out = catalog.enrich_recommendations(v.recs(), v.movies())
    return out.select(
        "recommendation_id", "user_id", "movie_id", "title",
        F.array_join("genres", ", ").alias("genres"), "release_year", "score",
    )


@query(
    "user_recommendation_log",
    f"""
    SELECT user_id, row_no, recommendation_id, r.movie_id, title AS movie_title, algorithm,
           score, strftime(generated_at, '{MOMENT}') AS generated_at
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id
                     ORDER BY generated_at DESC, recommendation_id) AS row_no FROM v_recs) r
    LEFT JOIN v_movies m ON r.movie_id = m.movie_id
    WHERE row_no <= 20""",
)
def user_recommendation_log(v: Views):
    out = catalog.user_recommendation_log(v.recs(), v.movies())
    return out.select(
        "user_id", F.col("row_no").cast("bigint"), "recommendation_id", "movie_id", "movie_title",
        "algorithm", "score", moment("generated_at"),
    )


@query(
    "genre_counts",
    """
    SELECT genre, count(*) AS movie_count FROM (SELECT unnest(genres) AS genre FROM v_movies)
    GROUP BY genre""",
)
def genre_counts(v: Views):
    return catalog.genre_counts(v.movies())


RECENT_RECS = f"generated_at >= CAST(TIMESTAMP '{AS_OF_LOG}' AS DATE) - INTERVAL 365 DAY"
CTR_SQL = """count(*) AS total_recommendations, count(served_at) AS served_recommendations,
           count(*) FILTER (WHERE clicked) AS clicked_recommendations,
           round(coalesce(count(*) FILTER (WHERE clicked)::DOUBLE
                 / nullif(count(served_at), 0), 0.0), 6) AS click_through_rate"""


@query("recommendation_stats", f"SELECT {CTR_SQL} FROM v_recs WHERE {RECENT_RECS}")
def recommendation_stats(v: Views):
    out = catalog.recommendation_stats(v.recs(), AS_OF_LOG, 365)
    return out.withColumn("click_through_rate", r6("click_through_rate"))


@query(
    "algorithm_ctr",
    f"SELECT algorithm, {CTR_SQL} FROM v_recs WHERE {RECENT_RECS} GROUP BY algorithm",
)
def algorithm_ctr(v: Views):
    out = catalog.algorithm_ctr(v.recs(), AS_OF_LOG, 365)
    return out.withColumn("click_through_rate", r6("click_through_rate"))


@query(
    "popular_algorithms",
    f"""
    SELECT algorithm, count(*) AS recommendation_count FROM v_recs WHERE {RECENT_RECS}
    GROUP BY algorithm ORDER BY recommendation_count DESC, algorithm LIMIT 5""",
)
def popular_algorithms(v: Views):
    return catalog.popular_algorithms(v.recs(), AS_OF_LOG, 365)


@query(
    "table_counts",
    """
    SELECT 'movies' AS table_name, count(*) AS row_count FROM v_movies
    UNION ALL SELECT 'users', count(*) FROM v_users
    UNION ALL SELECT 'interactions', count(*) FROM v_events
    UNION ALL SELECT 'recommendations', count(*) FROM v_recs""",
)
def table_counts(v: Views):
    return catalog.table_counts(
        {
            "movies": v.movies(),
            "users": v.users(),
            "interactions": v.events(),
            "recommendations": v.recs(),
        }
    )
