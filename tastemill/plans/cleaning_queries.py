"""Cleaning and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tastemill.functions.columns import clean_text as clean_text_column
from tastemill.functions.columns import coerce_double, movie_id_from_filename
from tastemill.functions.columns import parse_genres as parse_genres_column
from tastemill.functions.skew import widen_scan
from tastemill.operators import clean, quality
from tastemill.plans.registry import query
from tastemill.plans.shared import MOMENT, moment, r6
from tastemill.sources.views import AS_OF_LOG, Views

CLEAN_TEXT_SQL = (
    r"trim(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_\s\p{{Z}}.,!?]', '', 'g'),"
    r" '[\s\p{{Z}}]+', ' ', 'g'))"
)


def clean_sql(column: str) -> str:
    return CLEAN_TEXT_SQL.format(c=column)


# Event ids with file-name decorations of every kind the rule knows.
FILENAME_SQL = """CASE event_id % 5
    WHEN 0 THEN 'tt' || lpad(CAST(event_id AS VARCHAR), 7, '0') || '.jpg'
    WHEN 1 THEN 'poster-' || CAST(event_id AS VARCHAR) || '.v2.png'
    WHEN 2 THEN 'a.' || CAST(event_id AS VARCHAR) || '.jpg'
    WHEN 3 THEN 'clip' || CAST(user_id AS VARCHAR)
    ELSE event_type || '-tt' || lpad(CAST(event_id AS VARCHAR), 8, '0') END"""


@query(
    "extract_movie_id_from_filename",
    rf"""
    WITH f AS (SELECT event_id, {FILENAME_SQL} AS filename FROM events)
    SELECT event_id, filename, coalesce(
        nullif(regexp_extract(filename, '(tt\d{{7,8}})', 1), ''),
        nullif(regexp_extract(split_part(filename, '.', 1), '(\d{{3,}})', 1), '')) AS movie_id
    FROM f""",
)
def extract_movie_id(v: Views):
    names = v.table("events").select("event_id", F.expr(FILENAME_SQL.replace("VARCHAR", "STRING")).alias("filename"))
    return names.withColumn("movie_id", movie_id_from_filename("filename"))


@query(
    "clean_metadata",
    f"""
    SELECT movie_id, trim(title) AS title, lower(trim(title)) AS title_clean,
           array_to_string(genres, ', ') AS genres, len(genres) AS genre_count,
           array_to_string(genres, ' ') AS all_genres,
           coalesce({clean_sql("description")}, '') AS description_clean,
           CAST(release_year AS DOUBLE) AS release_year,
           CAST(duration_minutes AS DOUBLE) AS duration_minutes,
           round(imdb_rating, 6) AS imdb_rating
    FROM (SELECT *, row_number() OVER (PARTITION BY movie_id ORDER BY source) AS nth
          FROM (SELECT 1 AS source, * FROM v_movies
                UNION ALL SELECT 2, movie_id, ' ' || title, ['other'], release_year, 0.0,
                       duration_minutes, language, country, description FROM v_movies))
    WHERE nth = 1""",
)
def clean_metadata(v: Views):
    movies = v.movies().withColumn("source", F.lit(1))
    copies = movies.withColumns(
        {
            "source": F.lit(2),
            "title": F.concat(F.lit(" "), "title"),
            "genres": F.array(F.lit("other")),
            "imdb_rating": F.lit(0.0),
        }
    )
    out = clean.clean_metadata(movies.unionByName(copies), order=["source"])
    return out.select(
        "movie_id", "title", "title_clean", F.array_join("genres", ", ").alias("genres"),
        F.col("genre_count").cast("bigint"), "all_genres", "description_clean",
        "release_year", "duration_minutes", r6("imdb_rating"),
    )


@query(
    "clean_interactions",
    f"""
    WITH dirty AS (
        SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS user_id,
               CAST(l_partkey AS VARCHAR) AS movie_id,
               CASE WHEN l_returnflag = 'R' THEN 'x' || l_linestatus
                    ELSE CAST(l_quantity / 8.0::DOUBLE - 1 AS VARCHAR) END AS rating,
               CASE WHEN l_linestatus = 'O' THEN NULL ELSE o_orderdate END AS "timestamp"
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT DISTINCT user_id, movie_id,
           CASE WHEN try_cast(rating AS DOUBLE) IS NOT NULL
                THEN least(5.0::DOUBLE, greatest(0.0::DOUBLE, try_cast(rating AS DOUBLE))) END
               AS rating,
           strftime(coalesce("timestamp", TIMESTAMP '{AS_OF_LOG}'), '{MOMENT}') AS "timestamp"
    FROM dirty WHERE user_id IS NOT NULL AND movie_id IS NOT NULL""",
)
def clean_interactions(v: Views):
    orders = v.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = v.table("lineitem")
    quantity = F.col("l_quantity").cast("double") / F.lit(8.0) - F.lit(1)
    dirty = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.when(F.col("l_linenumber") != 7, F.col("o_custkey")).alias("user_id"),
        F.col("l_partkey").alias("movie_id"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("x"), "l_linestatus"))
        .otherwise(quantity.cast("string"))
        .alias("rating"),
        F.when(F.col("l_linestatus") != "O", F.col("o_orderdate")).alias("timestamp"),
    )
    out = clean.clean_interactions(dirty, AS_OF_LOG)
    return out.select("user_id", "movie_id", "rating", moment("timestamp"))


GENRE_TEXT_SQL = "'[' || replace(p_name, ' ', ', ''') || ''', ' || p_type || ']'"


@query(
    "parse_genres",
    f"""
    SELECT CAST(p_partkey AS VARCHAR) AS movie_id, array_to_string(list_transform(
        string_split(regexp_replace({GENRE_TEXT_SQL}, '^[\\[\\]]+|[\\[\\]]+$', '', 'g'), ','),
        lambda g: regexp_replace(trim(g), '^[''"]+|[''"]+$', '', 'g')), '|') AS genres
    FROM part""",
)
def parse_genres(v: Views):
    text = F.expr("concat('[', replace(p_name, ' ', ', \\''), '\\', ', p_type, ']')")
    return v.table("part").select(
        F.col("p_partkey").cast("string").alias("movie_id"),
        F.array_join(parse_genres_column(text), "|").alias("genres"),
    )


@query("clean_text", f"SELECT doc_id, {clean_sql('text')} AS text_clean FROM documents")
def clean_text(v: Views):
    docs = widen_scan(v.table("documents"), "doc_id")
    return docs.select("doc_id", clean_text_column("text").alias("text_clean"))


@query(
    "coerce_numeric",
    """
    SELECT event_id, try_cast(CASE WHEN event_type = 'error' THEN event_type
                              ELSE CAST("value" AS VARCHAR) END AS DOUBLE) AS number
    FROM events""",
)
def coerce_numeric(v: Views):
    text = F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(
        F.col("value").cast("string")
    )
    return v.table("events").select("event_id", coerce_double(text).alias("number"))


@query(
    "fill_missing",
    """
    WITH d AS (SELECT movie_id, CASE WHEN imdb_rating = 1 THEN language END AS language, country,
                      duration_minutes, imdb_rating FROM v_docs),
    m AS (SELECT median(imdb_rating) AS med, median(duration_minutes) AS dur FROM d),
    l AS (SELECT language AS v FROM d WHERE language IS NOT NULL
          GROUP BY language ORDER BY count(*) DESC, language LIMIT 1)
    SELECT movie_id, coalesce(language, (SELECT v FROM l), 'Unknown') AS language, country,
           coalesce(duration_minutes, (SELECT dur FROM m)) AS duration_minutes,
           coalesce(imdb_rating, (SELECT med FROM m)) AS imdb_rating
    FROM d""",
)
def fill_missing(v: Views):
    docs = v.docs().select(
        "movie_id",
        F.when(F.col("imdb_rating") == 1, F.col("language")).alias("language"),
        "country", "duration_minutes", "imdb_rating",
    )
    return clean.fill_missing(
        docs, numeric=["duration_minutes", "imdb_rating"], text=["language", "country"]
    )


@query(
    "join_list_to_string",
    """
    SELECT movie_id, array_to_string(genres, ', ') AS genres_text,
           array_to_string(genres, ' ') AS all_genres FROM v_movies""",
)
def join_list_to_string(v: Views):
    return v.movies().select(
        "movie_id",
        clean.join_list("genres").alias("genres_text"),
        clean.join_list("genres", " ").alias("all_genres"),
    )


# v_events with every rule broken somewhere
BROKEN_EVENTS_SQL = """
    SELECT interaction_id, CASE WHEN metadata LIKE '%13%' THEN '' ELSE user_id END AS user_id,
           CASE WHEN metadata LIKE '%77%' THEN NULL ELSE movie_id END AS movie_id,
           CASE WHEN metadata LIKE '%5%' AND interaction_type = 'save' THEN 'like'
                ELSE interaction_type END AS interaction_type,
           CASE WHEN metadata LIKE '%31%' THEN NULL ELSE rating END AS rating,
           duration - 2.0::DOUBLE AS duration
    FROM v_events"""


def broken_events(v: Views):
    has = lambda text: F.contains("metadata", F.lit(text))
    return v.events().select(
        "interaction_id",
        F.when(has("13"), "").otherwise(F.col("user_id")).alias("user_id"),
        F.when(~has("77"), F.col("movie_id")).alias("movie_id"),
        F.when(has("5") & (F.col("interaction_type") == "save"), "like")
        .otherwise(F.col("interaction_type"))
        .alias("interaction_type"),
        F.when(~has("31"), F.col("rating")).alias("rating"),
        (F.col("duration") - F.lit(2.0).cast("double")).alias("duration"),
    )


@query(
    "interaction_rules",
    f"""
    WITH b AS ({BROKEN_EVENTS_SQL})
    SELECT interaction_id, concat_ws(',',
        CASE WHEN user_id IS NULL OR user_id = '' THEN 'user_id_missing' END,
        CASE WHEN movie_id IS NULL OR movie_id = '' THEN 'movie_id_missing' END,
        CASE WHEN interaction_type NOT IN ('rating', 'watch', 'click', 'save', 'share')
             THEN 'type_unknown' END,
        CASE WHEN rating < 0 OR rating > 5 THEN 'rating_out_of_range' END,
        CASE WHEN interaction_type = 'rating' AND rating IS NULL THEN 'rating_required' END,
        CASE WHEN duration < 0 THEN 'duration_negative' END) AS violations
    FROM b""",
)
def interaction_rules(v: Views):
    out = quality.interaction_rules(broken_events(v))
    return out.select("interaction_id", F.array_join("violations", ",").alias("violations"))


@query(
    "movie_schema_rules",
    """
    WITH b AS (SELECT movie_id, CASE WHEN language = 'LARGE' THEN NULL ELSE title END AS title,
                      CASE WHEN release_year < 1960 THEN [] ELSE genres END AS genres,
                      imdb_rating * 2.0::DOUBLE AS imdb_rating,
                      duration_minutes - 70 AS duration_minutes FROM v_movies)
    SELECT movie_id, concat_ws(',',
        CASE WHEN movie_id IS NULL OR movie_id = '' THEN 'movie_id_missing' END,
        CASE WHEN title IS NULL OR title = '' THEN 'title_missing' END,
        CASE WHEN len(genres) = 0 THEN 'genres_missing' END,
        CASE WHEN imdb_rating < 0 OR imdb_rating > 10 THEN 'imdb_rating_out_of_range' END,
        CASE WHEN duration_minutes < 0 THEN 'duration_negative' END) AS violations
    FROM b""",
)
def movie_schema_rules(v: Views):
    movies = v.movies().select(
        "movie_id",
        F.when(F.col("language") != "LARGE", F.col("title")).alias("title"),
        F.when(F.col("release_year") < 1960, F.array().cast("array<string>"))
        .otherwise(F.col("genres"))
        .alias("genres"),
        (F.col("imdb_rating") * F.lit(2.0).cast("double")).alias("imdb_rating"),
        (F.col("duration_minutes") - 70).alias("duration_minutes"),
    )
    out = quality.movie_schema_rules(movies)
    return out.select("movie_id", F.array_join("violations", ",").alias("violations"))


@query(
    "validate_metadata",
    """
    SELECT p_partkey AS position, unnest(list_filter([
        CASE WHEN p_size % 7 = 0 THEN 'missing_title' END,
        CASE WHEN p_size % 5 = 0 THEN 'missing_genres' END,
        CASE WHEN p_size % 5 <> 0 AND p_size % 3 = 0 THEN 'genres_not_a_list' END],
        lambda x: x IS NOT NULL)) AS rule
    FROM part""",
)
def validate_metadata(v: Views):
    size = F.col("p_size")
    genres = F.when(
        size % 5 != 0,
        F.when(size % 3 == 0, F.to_json(F.struct(F.col("p_name").alias("genres")))).otherwise(
            F.to_json(F.struct(F.split("p_name", " ").alias("genres")))
        ),
    )
    title = F.when(size % 7 != 0, F.to_json(F.struct(F.col("p_name").alias("title"))))
    movie = F.to_json(F.struct(F.col("p_partkey").cast("string").alias("movie_id")))
    inner = F.transform(
        F.array_compact(F.array(movie, title, genres)),
        lambda j: F.substr(j, F.lit(2), F.length(j) - 2),
    )
    records = v.table("part").select(
        F.col("p_partkey").alias("position"),
        F.concat(F.lit("{"), F.array_join(inner, ","), F.lit("}")).alias("doc"),
    )
    return quality.validate_metadata(records)


TEXT_ROWS_SQL = """
    SELECT l_orderkey * 10 + l_linenumber AS row_no,
           CASE WHEN l_linenumber = 7 THEN '' ELSE CAST(l_suppkey AS VARCHAR) END AS user_id,
           CASE WHEN l_linenumber = 6 AND l_returnflag = 'R' THEN NULL
                ELSE CAST(l_partkey AS VARCHAR) END AS movie_id,
           CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'n/a'
                WHEN l_returnflag = 'A' THEN ''
                ELSE CAST(l_quantity / 8.0::DOUBLE AS VARCHAR) END AS rating
    FROM lineitem"""

VIOLATIONS_SQL = """
    SELECT row_no, 'user_id_missing' AS rule, '' AS "value" FROM t
        WHERE user_id IS NULL OR user_id = ''
    UNION ALL SELECT row_no, 'movie_id_missing', '' FROM t WHERE movie_id IS NULL OR movie_id = ''
    UNION ALL SELECT row_no, 'rating_not_a_number', rating FROM t
        WHERE rating <> '' AND try_cast(rating AS DOUBLE) IS NULL
    UNION ALL SELECT row_no, 'rating_out_of_range', rating FROM t
        WHERE try_cast(rating AS DOUBLE) < 0 OR try_cast(rating AS DOUBLE) > 5"""


def text_rows(v: Views):
    line, flag = F.col("l_linenumber"), F.col("l_returnflag")
    return v.table("lineitem").select(
        (F.col("l_orderkey") * 10 + line).alias("row_no"),
        F.when(line == 7, "").otherwise(F.col("l_suppkey").cast("string")).alias("user_id"),
        F.when(~((line == 6) & (flag == "R")), F.col("l_partkey").cast("string")).alias("movie_id"),
        F.when((flag == "A") & (F.col("l_linestatus") == "F"), "n/a")
        .when(flag == "A", "")
        .otherwise((F.col("l_quantity").cast("double") / F.lit(8.0)).cast("string"))
        .alias("rating"),
    )


@query("validate_interactions", f"WITH t AS ({TEXT_ROWS_SQL}) {VIOLATIONS_SQL}")
def validate_interactions(v: Views):
    return quality.validate_interactions(text_rows(v))


@query(
    "violation_summary",
    f"""
    WITH t AS ({TEXT_ROWS_SQL}), x AS ({VIOLATIONS_SQL}),
    n AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY row_no) AS nth,
                 count(*) OVER (PARTITION BY rule) AS total FROM x)
    SELECT rule, nth, row_no, "value", total, greatest(total - 5, 0) AS more,
           'failure' AS result FROM n WHERE nth <= 5""",
)
def violation_summary(v: Views):
    found = quality.validate_interactions(text_rows(v))
    out = quality.violation_summary(found, ["row_no"], by="rule")
    return out.withColumn("nth", F.col("nth").cast("bigint"))


@query(
    "interaction_profile",
    """
    SELECT count(*) AS row_count, count(DISTINCT user_id) AS user_count,
           count(DISTINCT movie_id) AS movie_count, min(rating) AS rating_min,
           max(rating) AS rating_max, round(avg(rating), 6) AS rating_avg FROM v_ratings""",
)
def interaction_profile(v: Views):
    return quality.interaction_profile(v.ratings()).withColumn("rating_avg", r6("rating_avg"))


@query(
    "genre_profile",
    """
    SELECT genre, count(*) AS movie_count, count(*) OVER () AS total_unique
    FROM (SELECT unnest(genres) AS genre FROM v_movies)
    GROUP BY genre ORDER BY movie_count DESC, genre LIMIT 10""",
)
def genre_profile(v: Views):
    return quality.genre_profile(v.movies())


@query(
    "row_fingerprint",
    """
    SELECT c_custkey, md5(concat_ws('|', CAST(c_custkey AS VARCHAR), c_name,
                                    CAST(c_nationkey AS VARCHAR), c_mktsegment)) AS checksum
    FROM customer""",
)
def row_fingerprint(v: Views):
    columns = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
    return quality.row_fingerprint(v.table("customer"), columns).select("c_custkey", "checksum")


@query(
    "validation_report",
    f"""
    WITH t AS ({TEXT_ROWS_SQL}), x AS ({VIOLATIONS_SQL}),
    n AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY row_no) AS nth FROM x),
    c AS (SELECT rule, count(*) AS total FROM x GROUP BY rule)
    SELECT CASE WHEN (SELECT count(*) FROM c) > 0 THEN 'failure' ELSE 'success' END
               AS validation_result,
           '{AS_OF_LOG}' AS "timestamp",
           (SELECT count(*) FROM n WHERE nth <= 5) AS error_count,
           (SELECT string_agg(rule || ': ... and ' || (total - 5) || ' more', ';' ORDER BY rule)
            FROM c WHERE total > 5) AS warnings""",
)
def validation_report(v: Views):
    found = quality.validate_interactions(text_rows(v))
    report = quality.validation_report(found, ["row_no"], AS_OF_LOG, by="rule")
    return report.select(
        "validation_result", "timestamp",
        F.size("errors").cast("bigint").alias("error_count"),
        F.array_join("warnings", ";").alias("warnings"),
    )
