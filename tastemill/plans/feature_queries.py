"""Feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tastemill.functions.stopwords import ENGLISH
from tastemill.operators import features
from tastemill.plans.cleaning_queries import clean_sql
from tastemill.plans.registry import query
from tastemill.plans.shared import r6
from tastemill.sources.views import Views

STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH)
WORDS = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]{{2,}}')"

TENDENCY_SQL = """CASE WHEN avg_rating < 2.5 THEN 'harsh' WHEN avg_rating < 3.5 THEN 'average'
                ELSE 'generous' END"""

USER_BASE_SQL = """
    SELECT user_id, count(rating) AS interaction_count, avg(rating) AS avg_rating,
           stddev_samp(rating) AS rating_std, min(rating) AS min_rating, max(rating) AS max_rating,
           count(DISTINCT movie_id) AS unique_movies_rated
    FROM {view} GROUP BY user_id"""

ACTIVITY_SQL = """
    q AS (SELECT quantile_cont(interaction_count, [0, 0.25, 0.5, 0.75, 1]) AS e,
                 count(DISTINCT interaction_count) AS n FROM u)
    SELECT u.*, CASE WHEN q.n < 4 OR len(list_distinct(q.e)) < 5 OR interaction_count <= q.e[2]
                     THEN 'low' WHEN interaction_count <= q.e[3] THEN 'medium'
                     WHEN interaction_count <= q.e[4] THEN 'high' ELSE 'very_high' END
                AS activity_level FROM u, q"""


@query(
    "user_features",
    f"""
    WITH u AS ({USER_BASE_SQL.format(view="v_ratings")}), a AS (WITH {ACTIVITY_SQL.strip()})
    SELECT user_id, interaction_count, round(avg_rating, 6) AS avg_rating,
           round(rating_std, 6) AS rating_std, min_rating, max_rating, unique_movies_rated,
           activity_level, {TENDENCY_SQL} AS rating_tendency FROM a""",
)
def user_features(v: Views):
    out = features.user_features(v.ratings())
    return out.withColumns({"avg_rating": r6("avg_rating"), "rating_std": r6("rating_std")})


@query(
    "activity_level",
    f"""
    WITH u AS (SELECT movie_id, count(*) AS interaction_count FROM v_events GROUP BY movie_id),
    a AS (WITH {ACTIVITY_SQL.strip()})
    SELECT movie_id, interaction_count, activity_level FROM a""",
)
def activity_level(v: Views):
    counts = v.events().groupBy("movie_id").agg(F.count(F.lit(1)).alias("interaction_count"))
    return features.activity_level(counts)


@query(
    "rating_tendency",
    f"""
    WITH u AS (SELECT user_id, avg(rating) AS avg_rating FROM v_events GROUP BY user_id)
    SELECT user_id, {TENDENCY_SQL} AS rating_tendency FROM u""",
)
def rating_tendency(v: Views):
    means = v.events().groupBy("user_id").agg(F.avg("rating").alias("avg_rating"))
    return means.select("user_id", features.rating_tendency().alias("rating_tendency"))


MOVIE_STATS_SQL = """
    SELECT movie_id, count(rating) AS rating_count, avg(rating) AS avg_rating,
           stddev_samp(rating) AS rating_std, count(DISTINCT user_id) AS unique_users
    FROM {view} GROUP BY movie_id"""


@query(
    "movie_stats",
    f"""
    WITH s AS ({MOVIE_STATS_SQL.format(view="v_ratings")})
    SELECT movie_id, rating_count, round(avg_rating, 6) AS avg_rating,
           round(rating_std, 6) AS rating_std, unique_users FROM s""",
)
def movie_stats(v: Views):
    out = features.movie_stats(v.ratings())
    return out.withColumns({"avg_rating": r6("avg_rating"), "rating_std": r6("rating_std")})


JOINED_SQL = f"""
    s AS ({MOVIE_STATS_SQL.format(view="v_events")}),
    j AS (SELECT m.*, coalesce(rating_count, 0) AS rating_count, avg_rating, rating_std,
                 coalesce(unique_users, 0) AS unique_users,
                 coalesce(rating_count, 0) * 0.7::DOUBLE + coalesce(unique_users, 0) * 0.3::DOUBLE
                     AS popularity_score
          FROM v_movies m LEFT JOIN s ON m.movie_id = s.movie_id)"""


@query(
    "movie_features_join",
    f"""
    WITH {JOINED_SQL}
    SELECT movie_id, title, rating_count, round(avg_rating, 6) AS avg_rating,
           round(rating_std, 6) AS rating_std, unique_users FROM j""",
)
def movie_features_join(v: Views):
    out = features.movie_features_join(v.movies(), v.events())
    return out.select(
        "movie_id", "title", "rating_count", r6("avg_rating"), r6("rating_std"), "unique_users"
    )


@query(
    "popularity_score",
    f"WITH {JOINED_SQL} SELECT movie_id, round(popularity_score, 6) AS popularity_score FROM j",
)
def popularity_score(v: Views):
    out = features.movie_features_join(v.movies(), v.events())
    return out.select("movie_id", r6("popularity_score"))


ENCODED_SQL = """
    eg AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS code
           FROM (SELECT DISTINCT array_to_string(genres, ', ') AS x FROM v_movies)),
    el AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS code
           FROM (SELECT DISTINCT coalesce(language, 'Unknown') AS x FROM v_movies)),
    ec AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS code
           FROM (SELECT DISTINCT coalesce(country, 'Unknown') AS x FROM v_movies))"""


@query(
    "label_encode",
    f"""
    WITH {ENCODED_SQL}
    SELECT movie_id, eg.code AS genres_encoded, el.code AS language_encoded,
           ec.code AS country_encoded
    FROM v_movies m JOIN eg ON array_to_string(m.genres, ', ') = eg.x
    JOIN el ON coalesce(m.language, 'Unknown') = el.x
    JOIN ec ON coalesce(m.country, 'Unknown') = ec.x""",
)
def label_encode(v: Views):
    out = features.label_encode(v.movies(), ["genres", "language", "country"])
    return out.select("movie_id", "genres_encoded", "language_encoded", "country_encoded")


def _norm(c: str, view: str) -> str:
    lo, hi = f"(SELECT min({c}) FROM {view})", f"(SELECT max({c}) FROM {view})"
    return (
        f"round(CASE WHEN {c} IS NOT NULL THEN coalesce(({c} - {lo})::DOUBLE"
        f" / nullif(({hi} - {lo})::DOUBLE, 0), 0.0) END, 6) AS {c}_normalized"
    )


@query(
    "min_max_normalize",
    f"""SELECT movie_id, {_norm("duration_minutes", "v_docs")}, {_norm("imdb_rating", "v_docs")}
    FROM v_docs""",
)
def min_max_normalize(v: Views):
    out = features.min_max_normalize(v.docs(), ["duration_minutes", "imdb_rating"])
    return out.select("movie_id", r6("duration_minutes_normalized"), r6("imdb_rating_normalized"))


SCALED_SQL = """
    SELECT movie_id,
           (dur - avg(dur) OVER ()) / coalesce(nullif(stddev_pop(dur) OVER (), 0), 1.0)
               AS duration_minutes_scaled,
           (imdb - avg(imdb) OVER ()) / coalesce(nullif(stddev_pop(imdb) OVER (), 0), 1.0)
               AS imdb_rating_scaled
    FROM (SELECT movie_id,
                 coalesce(duration_minutes, (SELECT median(duration_minutes) FROM v_docs)) AS dur,
                 coalesce(imdb_rating, (SELECT median(imdb_rating) FROM v_docs)) AS imdb
          FROM v_docs)"""


@query(
    "standard_scale",
    f"""
    WITH s AS ({SCALED_SQL})
    SELECT movie_id, round(duration_minutes_scaled, 6) AS duration_minutes_scaled,
           round(imdb_rating_scaled, 6) AS imdb_rating_scaled FROM s""",
)
def standard_scale(v: Views):
    out = features.standard_scale(v.docs(), ["duration_minutes", "imdb_rating"])
    return out.select("movie_id", r6("duration_minutes_scaled"), r6("imdb_rating_scaled"))


def tfidf_sql(name: str, view: str, text: str, size: int, bigram: bool) -> str:
    """CTEs ending in ``<name> (movie_id, term, value)``."""
    kept = f"list_filter({WORDS.format(c=text)}, lambda w: w NOT IN ({STOP_SQL}))"
    if bigram:
        pairs = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
        terms = f"list_concat(w, {pairs})"
    else:
        terms = "w"
    return f"""
    {name}_w AS (SELECT movie_id, {kept} AS w FROM {view}),
    {name}_t AS (SELECT movie_id, unnest({terms}) AS term FROM {name}_w),
    {name}_v AS (SELECT term FROM {name}_t GROUP BY term ORDER BY count(*) DESC, term
                 LIMIT {size}),
    {name}_c AS (SELECT movie_id, term, count(*) AS tf FROM {name}_t
                 WHERE term IN (SELECT term FROM {name}_v) GROUP BY movie_id, term),
    {name}_i AS (SELECT term, ln(((SELECT count(*) FROM {view}) + 1)::DOUBLE
                                 / (count(*) + 1)::DOUBLE) + 1 AS idf
                 FROM {name}_c GROUP BY term),
    {name}_r AS (SELECT movie_id, c.term, tf * idf AS raw
                 FROM {name}_c c JOIN {name}_i i ON c.term = i.term),
    {name} AS (SELECT movie_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY movie_id))
                   AS "value" FROM {name}_r)"""


@query(
    "tfidf_unigram",
    f"""
    WITH {tfidf_sql("x", "v_docs", "description", 100, False)}
    SELECT movie_id, term, round("value", 6) AS "value" FROM x""",
)
def tfidf_unigram(v: Views):
    out = features.tfidf(v.docs(), "description")
    return out.withColumn("value", r6("value"))


@query(
    "tfidf_bigram",
    f"""
    WITH {tfidf_sql("x", "v_docs", clean_sql("description"), 50, True)}
    SELECT movie_id, term, round("value", 6) AS "value" FROM x""",
)
def tfidf_bigram(v: Views):
    from tastemill.functions.columns import clean_text

    docs = v.docs().select("movie_id", clean_text("description").alias("text"))
    out = features.tfidf(docs, "text", max_features=50, bigram=True)
    return out.withColumn("value", r6("value"))


@query(
    "genre_multi_hot",
    """
    SELECT movie_id, unnest(list_distinct(genres)) AS genre, 1.0::DOUBLE AS "value"
    FROM v_movies""",
)
def genre_multi_hot(v: Views):
    return features.genre_multi_hot(v.movies())


@query(
    "genre_wide",
    """
    SELECT movie_id, CAST(list_contains(genres, 'red') AS DOUBLE) AS genre_red,
           CAST(list_contains(genres, 'ring') AS DOUBLE) AS genre_ring,
           CAST(list_contains(genres, 'small') AS DOUBLE) AS genre_small FROM v_movies""",
)
def genre_wide(v: Views):
    return features.genre_wide(v.movies(), ["red", "ring", "small"])


@query(
    "categorical_one_hot",
    """
    WITH t AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS code
               FROM (SELECT DISTINCT title AS x FROM v_movies))
    SELECT movie_id, 'country_' || country AS feature, 1.0::DOUBLE AS "value" FROM v_movies
    UNION ALL
    SELECT movie_id, 'title_encoded', CAST(code AS DOUBLE)
    FROM v_movies m JOIN t ON m.title = t.x""",
)
def categorical_one_hot(v: Views):
    movies = v.movies()
    return features.categorical_one_hot(movies, "country").unionByName(
        features.categorical_one_hot(movies, "title")
    )


def _one_hot_sql(c: str) -> str:
    return f"""
    SELECT movie_id, '{c}' AS grp,
           CASE WHEN n <= 50 THEN '{c}_' || {c} ELSE '{c}_encoded' END AS feature,
           CASE WHEN n <= 50 THEN 1.0::DOUBLE ELSE code::DOUBLE END AS "value"
    FROM v_docs JOIN (SELECT x, row_number() OVER (ORDER BY x) - 1 AS code, count(*) OVER () AS n
                      FROM (SELECT DISTINCT {c} AS x FROM v_docs)) ON {c} = x"""


# long features of v_docs: genres, description terms, language, country, two numbers
LONG_SQL = f"""
    {tfidf_sql("bi", "v_docs", clean_sql("description"), 50, True)},
    sc AS ({SCALED_SQL}),
    long AS (
        SELECT movie_id, 'genres' AS grp,
               'genre_' || unnest(list_distinct(genres)) AS feature, 1.0::DOUBLE AS "value"
        FROM v_docs
        UNION ALL SELECT movie_id, 'description', 'description_' || term, "value" FROM bi
        UNION ALL {_one_hot_sql("language")}
        UNION ALL {_one_hot_sql("country")}
        UNION ALL SELECT movie_id, 'duration', 'duration_minutes_scaled', duration_minutes_scaled
        FROM sc
        UNION ALL SELECT movie_id, 'rating', 'imdb_rating_scaled', imdb_rating_scaled FROM sc),
    weighted AS (
        SELECT movie_id, feature, "value" * CASE grp WHEN 'genres' THEN 0.4::DOUBLE
               WHEN 'description' THEN 0.3::DOUBLE WHEN 'rating' THEN 0.05::DOUBLE
               ELSE 1.0::DOUBLE END AS "value" FROM long),
    unit AS (
        SELECT movie_id, feature,
               "value" / sqrt(sum("value" * "value") OVER (PARTITION BY movie_id)) AS "value"
        FROM weighted WHERE "value" <> 0)"""


@query(
    "weighted_features",
    f"""
    WITH {LONG_SQL}
    SELECT movie_id, feature, round("value", 6) AS "value" FROM weighted""",
)
def weighted_features(v: Views):
    out = features.weighted_features(features.long_features(v.docs()))
    return out.select("movie_id", "feature", r6("value"))


@query(
    "feature_vectors",
    f"""
    WITH {LONG_SQL}, f AS (SELECT DISTINCT feature FROM weighted),
    g AS (SELECT m.movie_id, f.feature, coalesce(w."value", 0.0) AS "value"
          FROM v_docs m CROSS JOIN f
          LEFT JOIN weighted w ON m.movie_id = w.movie_id AND f.feature = w.feature)
    SELECT movie_id, count(*) AS dimensions,
           string_agg(CAST(CAST(round("value" * 1000) AS BIGINT) AS VARCHAR), ','
                      ORDER BY feature) AS cells
    FROM g GROUP BY movie_id""",
)
def feature_vectors(v: Views):
    weighted = features.weighted_features(features.long_features(v.docs()))
    out = features.feature_vectors(weighted.select("movie_id", "feature", "value"))
    thousandths = F.transform(
        "vec", lambda x: F.round(x * F.lit(1000.0)).cast("bigint").cast("string")
    )
    return out.select(
        "movie_id",
        F.size("vec").cast("bigint").alias("dimensions"),
        F.array_join(thousandths, ",").alias("cells"),
    )


@query(
    "movie_features",
    f"""
    WITH {JOINED_SQL}, {ENCODED_SQL}
    SELECT movie_id, rating_count, unique_users, round(popularity_score, 6) AS popularity_score,
           eg.code AS genres_encoded, el.code AS language_encoded, ec.code AS country_encoded,
           {_norm("release_year", "v_movies")}, {_norm("duration_minutes", "v_movies")},
           {_norm("imdb_rating", "v_movies")}
    FROM j JOIN eg ON array_to_string(j.genres, ', ') = eg.x
    JOIN el ON coalesce(j.language, 'Unknown') = el.x
    JOIN ec ON coalesce(j.country, 'Unknown') = ec.x""",
)
def movie_features(v: Views):
    out = features.movie_features(v.movies(), v.events())
    return out.select(
        "movie_id", "rating_count", "unique_users", r6("popularity_score"), "genres_encoded",
        "language_encoded", "country_encoded", r6("release_year_normalized"),
        r6("duration_minutes_normalized"), r6("imdb_rating_normalized"),
    )


@query(
    "json_fields",
    """
    SELECT event_id, json_extract_string(props, '$.k') AS k,
           CASE event_id % 3 WHEN 0 THEN event_type || ',b' ELSE '' END AS tags
    FROM events""",
)
def json_fields(v: Views):
    third = F.col("event_id") % 3
    rows = v.table("events").select(
        "event_id",
        "props",
        F.when(third == 0, F.to_json(F.array("event_type", F.lit("b"))))
        .when(third == 1, F.lit("not json"))
        .alias("tags"),
    )
    out = features.json_fields(rows, lists=["tags"], maps=["props"])
    return out.select(
        "event_id", F.col("props")["k"].alias("k"), F.array_join("tags", ",").alias("tags")
    )
