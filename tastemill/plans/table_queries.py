"""Sources, table maintenance and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tastemill.operators import clean, maintenance, matrix, mf
from tastemill.plans.neighbour_queries import SHOWN, item_recommend_sql
from tastemill.plans.registry import query
from tastemill.plans.shared import MOMENT, moment, r6
from tastemill.session import scratch_folder
from tastemill.sources import files, tables
from tastemill.sources.views import AS_OF_EVENTS, Views
from tastemill.streaming import jobs
from tastemill.streaming.log import read_log


@query(
    "scan_interactions_csv",
    f"""
    SELECT interaction_id, user_id, movie_id, interaction_type, rating, duration,
           strftime("timestamp", '{MOMENT}') AS "timestamp", metadata FROM v_events""",
)
def scan_interactions_csv(v: Views):
    path = scratch_folder(v.spark, "csv")
    rows = v.events().withColumn(
        "timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )
    rows.write.option("header", True).option("escape", '"').csv(path)
    return files.scan_interactions_csv(v.spark, path).withColumn("timestamp", moment("timestamp"))


@query(
    "scan_metadata_json",
    """
    SELECT movie_id, title, array_to_string(genres, '|') AS genres,
           CAST(release_year AS DOUBLE) AS release_year, round(imdb_rating, 6) AS imdb_rating,
           country, description FROM v_movies""",
)
def scan_metadata_json(v: Views):
    path = scratch_folder(v.spark, "json")
    v.movies().write.json(path)
    out = clean.clean_metadata(
        files.scan_metadata_json(v.spark, path, lines=True), ["position"], fill=False
    )
    # list-valued genres arrive as JSON text, hence the quotes parse_genres strips
    return out.select(
        "movie_id", "title", F.array_join("genres", "|").alias("genres"), "release_year",
        r6("imdb_rating"), "country", "description",
    )


@query(
    "write_read_table",
    f"""
    SELECT recommendation_id, user_id, movie_id, algorithm, score,
           strftime(generated_at, '{MOMENT}') AS generated_at FROM v_recs""",
)
def write_read_table(v: Views):
    path = scratch_folder(v.spark, "tables")
    tables.write_table({"recommendations": v.recs()}, path, partition_by={
        "recommendations": ["algorithm"]})
    found = tables.read_table(v.spark, path, ["recommendations", "absent"])
    return found["recommendations"].select(
        "recommendation_id", "user_id", "movie_id", "algorithm", "score", moment("generated_at")
    )


@query(
    "write_recommendations_json",
    f"WITH {item_recommend_sql('r', 10)} SELECT {SHOWN} FROM r",
)
def write_recommendations_json(v: Views):
    from tastemill.operators import cf
    from tastemill.plans.neighbour_queries import event_cells, event_items

    path = scratch_folder(v.spark, "recommendations")
    recs = cf.item_cf_recommend(event_cells(v), event_items(v))
    tables.write_recommendations_json(recs, path, AS_OF_EVENTS)
    docs = tables.load_recommendations(v.spark, path)
    return docs.select("user_id", F.inline("recommendations")).select(
        "user_id", "movie_id", r6("score"), F.col("rank").cast("bigint")
    )


@query(
    "append_interactions",
    f"""
    SELECT user_id, movie_id, interaction_type, rating,
           strftime(coalesce(CASE WHEN CAST(interaction_id AS BIGINT) % 4 <> 0 THEN "timestamp" END,
                             TIMESTAMP '{AS_OF_EVENTS}'), '{MOMENT}') AS "timestamp",
           json_extract_string(metadata, '$.k') AS k
    FROM v_events UNION ALL
    SELECT user_id, movie_id, interaction_type, rating,
           strftime("timestamp", '{MOMENT}'), json_extract_string(metadata, '$.k') FROM v_events""",
)
def append_interactions(v: Views):
    path = scratch_folder(v.spark, "interactions")
    some = F.col("interaction_id").cast("bigint") % 4 != 0
    untimed = v.events().withColumn("timestamp", F.when(some, F.col("timestamp")))
    maintenance.append_interactions(untimed, path, AS_OF_EVENTS)
    maintenance.append_interactions(v.events(), path, AS_OF_EVENTS)
    return v.spark.read.parquet(path).select(
        "user_id", "movie_id", "interaction_type", "rating", moment("timestamp"),
        F.col("metadata")["k"].alias("k"),
    )


@query(
    "append_recommendations",
    f"""
    SELECT user_id, movie_id, 'catalogue' AS algorithm, max(score) AS score,
           strftime(TIMESTAMP '{AS_OF_EVENTS}', '{MOMENT}') AS generated_at, false AS clicked
    FROM v_recs GROUP BY user_id, movie_id""",
)
def append_recommendations(v: Views):
    path = scratch_folder(v.spark, "log")
    recs = v.recs().groupBy("user_id", "movie_id").agg(F.max("score").alias("score"))
    maintenance.append_recommendations(recs, path, "catalogue", AS_OF_EVENTS)
    return v.spark.read.parquet(path).select(
        "user_id", "movie_id", "algorithm", "score", moment("generated_at"), "clicked"
    )


@query(
    "save_factors",
    """
    SELECT count(DISTINCT user_id) AS users, count(DISTINCT movie_id) AS movies, 50 AS factors,
           count(*) AS cells, true AS better_than_offsets, true AS in_range
    FROM v_ecells""",
)
def save_factors(v: Views):
    """Saved and loaded again, the model predicts its cells better than the offsets alone."""
    known = matrix.rated_cells(v.events())
    path = scratch_folder(v.spark, "factors")
    tables.save_factors(mf.mf_fit(known), path, AS_OF_EVENTS)
    model = tables.load_factors(v.spark, path)
    pairs = known.select("user_id", "movie_id")
    scores = mf.mf_predict(model, pairs)
    fit, offsets = mf.rmse(scores, known), mf.rmse(mf.bias_predict(known, pairs), known)
    sizes = model.items.agg(
        F.count(F.lit(1)).alias("movies"), F.max(F.size("features")).alias("factors")
    )
    return sizes.select(
        model.users.agg(F.count(F.lit(1))).scalar().alias("users"),
        "movies",
        "factors",
        fit.select("cells").scalar().alias("cells"),
        (fit.select("rmse").scalar() < offsets.select("rmse").scalar()).alias("better_than_offsets"),
        scores.agg(F.every(F.col("score").between(0, 5))).scalar().alias("in_range"),
    )


@query(
    "upsert_movies",
    """
    WITH b AS (
        SELECT movie_id, 'first ' || title AS title, release_year, 1 AS seq FROM v_movies
        WHERE release_year % 3 = 0
        UNION ALL SELECT movie_id, 'last ' || title, release_year, 2 FROM v_movies
        WHERE release_year % 6 = 0
        UNION ALL SELECT 'new' || movie_id, title, release_year, 1 FROM v_movies
        WHERE release_year % 5 = 0),
    l AS (SELECT movie_id, title, release_year FROM b
          QUALIFY row_number() OVER (PARTITION BY movie_id ORDER BY seq DESC) = 1)
    SELECT movie_id, title, release_year FROM l
    UNION ALL SELECT movie_id, title, release_year FROM v_movies
    WHERE movie_id NOT IN (SELECT movie_id FROM l)""",
)
def upsert_movies(v: Views):
    base = v.movies().select("movie_id", "title", "release_year")
    year = F.col("release_year")
    first = base.where(year % 3 == 0).select(
        "movie_id", F.concat(F.lit("first "), "title").alias("title"), "release_year",
        F.lit(1).alias("seq"),
    )
    last = base.where(year % 6 == 0).select(
        "movie_id", F.concat(F.lit("last "), "title").alias("title"), "release_year",
        F.lit(2).alias("seq"),
    )
    new = base.where(year % 5 == 0).select(
        F.concat(F.lit("new"), "movie_id").alias("movie_id"), "title", "release_year",
        F.lit(1).alias("seq"),
    )
    return maintenance.upsert_movies(base, first.unionByName(last).unionByName(new), ["seq"])


@query(
    "upsert_users",
    """
    WITH l AS (SELECT user_id, max(interaction_type) AS segment FROM v_events GROUP BY user_id)
    SELECT user_id, segment FROM l
    UNION ALL SELECT user_id, segment FROM v_users WHERE user_id NOT IN (SELECT user_id FROM l)""",
)
def upsert_users(v: Views):
    base = v.users().select("user_id", F.col("preferences")["segment"].alias("segment"))
    batch = v.events().select(
        "user_id", F.col("interaction_type").alias("segment"),
    ).distinct()
    return maintenance.upsert_users(base, batch, ["segment"])


@query(
    "merge_preferences",
    """
    WITH c AS (SELECT user_id, max(movie_id) AS liked, min(interaction_type) AS seg
               FROM v_events GROUP BY user_id
               UNION ALL SELECT 'x' || user_id, max(movie_id), min(interaction_type)
               FROM v_events GROUP BY user_id)
    SELECT coalesce(u.user_id, c.user_id) AS user_id, coalesce(c.seg, u.segment) AS segment,
           u.nation, c.liked
    FROM v_users u FULL JOIN c ON u.user_id = c.user_id""",
)
def merge_preferences(v: Views):
    known = v.events().groupBy("user_id").agg(
        F.max("movie_id").alias("liked"), F.min("interaction_type").alias("seg")
    )
    strangers = known.withColumn("user_id", F.concat(F.lit("x"), "user_id"))
    changes = known.unionByName(strangers).select(
        "user_id",
        F.create_map(F.lit("liked"), "liked", F.lit("segment"), "seg").alias("preferences"),
    )
    prefs = F.col("preferences")
    return maintenance.merge_preferences(v.users(), changes).select(
        "user_id", prefs["segment"].alias("segment"), prefs["nation"].alias("nation"),
        prefs["liked"].alias("liked"),
    )


@query(
    "delete_users_cascade",
    """
    WITH g AS (SELECT DISTINCT user_id FROM v_events WHERE interaction_type = 'save')
    SELECT 'users' AS table_name, user_id, count(*) AS rows_left FROM v_users
    WHERE user_id NOT IN (SELECT user_id FROM g) GROUP BY user_id
    UNION ALL SELECT 'interactions', user_id, count(*) FROM v_ratings
    WHERE user_id NOT IN (SELECT user_id FROM g) GROUP BY user_id
    UNION ALL SELECT 'recommendations', user_id, count(*) FROM v_recs
    WHERE user_id NOT IN (SELECT user_id FROM g) GROUP BY user_id""",
)
def delete_users_cascade(v: Views):
    gone = v.events().where(F.col("interaction_type") == "save").select("user_id")
    left = maintenance.delete_users_cascade(v.users(), v.ratings(), v.recs(), gone)
    parts = [
        df.groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("rows_left"))
        .select(F.lit(name).alias("table_name"), "user_id", "rows_left")
        for name, df in left.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "apply_feedback",
    f"""
    WITH f AS (SELECT CAST(event_id AS VARCHAR) AS recommendation_id, min(ts) AS served_at,
                      bool_or(event_type = 'click') AS clicked FROM events GROUP BY 1)
    SELECT r.recommendation_id, strftime(coalesce(f.served_at, r.served_at), '{MOMENT}')
               AS served_at,
           coalesce(r.clicked, false) OR coalesce(f.clicked, false) AS clicked
    FROM v_recs r LEFT JOIN f ON r.recommendation_id = f.recommendation_id""",
)
def apply_feedback(v: Views):
    feedback = v.table("events").select(
        F.col("event_id").cast("string").alias("recommendation_id"),
        F.col("ts").alias("served_at"),
        (F.col("event_type") == "click").alias("clicked"),
    )
    out = maintenance.apply_feedback(v.recs(), feedback)
    return out.select("recommendation_id", moment("served_at"), "clicked")


# streams ---------------------------------------------------------------------


STREAM_SLICES = 3
MERGED_BATCHES = 2  # so that the few batches here make a run


def event_stream(v: Views, in_order: bool = False):
    """The events table as a file stream of several micro-batches, shaped like ``v_events``.

    The slices take turns through the ids, so every batch after the first brings
    rows far older than those before; ``in_order`` slices by time instead.
    """
    path = scratch_folder(v.spark, "feed")
    events = v.table("events")
    slices = [F.col("event_id") % STREAM_SLICES == k for k in range(STREAM_SLICES)]
    if in_order:
        thirds = [F.percentile_approx("ts", k / STREAM_SLICES) for k in range(1, STREAM_SLICES)]
        low, high = events.agg(*thirds).first()
        slices = [F.col("ts") < low, (F.col("ts") >= low) & (F.col("ts") < high), F.col("ts") >= high]
    for part in slices:
        events.where(part).write.mode("append").parquet(path)
    files = len(v.spark.read.schema(events.schema).parquet(path).inputFiles())
    source = (
        v.spark.readStream.schema(events.schema)
        .option("maxFilesPerTrigger", -(-files // STREAM_SLICES))
        .parquet(path)
    )
    shaped = Views(v.spark, v.folder)
    shaped._tables["events"] = source
    return shaped.events().withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def finished(stream) -> None:
    stream.awaitTermination()


@query(
    "stream_interactions",
    f"""
    SELECT interaction_id, user_id, movie_id, interaction_type, rating, duration,
           strftime("timestamp", '{MOMENT}') AS "timestamp",
           coalesce(rating < 0 OR rating > 5, false) OR coalesce(duration < 0, false) AS broken
    FROM v_events""",
)
def stream_interactions(v: Views):
    path = scratch_folder(v.spark, "stream")
    good, bad = f"{path}/good", f"{path}/quarantine"
    finished(jobs.stream_interactions(event_stream(v), good, bad, f"{path}/checkpoint"))
    names = [
        "interaction_id", "user_id", "movie_id", "interaction_type", "rating", "duration",
    ]
    ok = v.spark.read.parquet(good).select(*names, moment("timestamp"), F.lit(False).alias("broken"))
    broken = v.spark.read.parquet(bad).select(
        *names, moment("timestamp"), F.lit(True).alias("broken")
    )
    return ok.unionByName(broken)


@query(
    "stream_user_statistics",
    """
    SELECT user_id, count(*) AS interaction_count,
           round(coalesce(avg(rating), 0.0), 6) AS average_rating,
           count(DISTINCT CASE WHEN rating IS NOT NULL THEN movie_id END) AS rated_movies,
           count(DISTINCT CASE WHEN interaction_type = 'watch' THEN movie_id END)
               AS watched_movies
    FROM v_events GROUP BY user_id""",
)
def stream_user_statistics(v: Views):
    path = scratch_folder(v.spark, "stream")
    finished(jobs.stream_user_statistics(
        event_stream(v), f"{path}/log", f"{path}/checkpoint", fanout=MERGED_BATCHES))
    out = jobs.statistics_from_log(read_log(v.spark, f"{path}/log", jobs.NEWEST_COUNTS, MERGED_BATCHES))
    return out.withColumn("average_rating", r6("average_rating"))


PROFILE_SQL = """
    WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id
                             ORDER BY "timestamp", interaction_id) AS k FROM v_events),
    s AS (SELECT *, sum(CASE WHEN rating IS NOT NULL AND k > 1 THEN ln((k - 1)::DOUBLE / k)
                        ELSE 0.0 END) OVER (PARTITION BY user_id ORDER BY k) AS l FROM p)
    SELECT user_id, count(*) AS interaction_count,
           round(coalesce(sum(rating / k * exp(-l)) * exp(min(l)), 0.0), 6) AS avg_rating
    FROM s GROUP BY user_id"""


@query("user_profile_running", PROFILE_SQL)
def user_profile_running(v: Views):
    return jobs.user_profile_running(v.events()).withColumn("avg_rating", r6("avg_rating"))


@query("stream_user_profile", PROFILE_SQL)
def stream_user_profile(v: Views):
    path = scratch_folder(v.spark, "stream")
    finished(jobs.stream_user_profile(
        event_stream(v, in_order=True), f"{path}/log", f"{path}/checkpoint", fanout=MERGED_BATCHES))
    out = jobs.newest_profiles(read_log(v.spark, f"{path}/log", jobs.NEWEST_PROFILE, MERGED_BATCHES))
    return out.withColumn("avg_rating", r6("avg_rating"))


RATE_SQL = f"""
    SELECT client, strftime(date_trunc('hour', "timestamp"), '{MOMENT}') AS window_start,
           count(*) AS requests, greatest(count(*) - 2, 0) AS rejected
    FROM v_requests GROUP BY client, date_trunc('hour', "timestamp")"""


@query("windowed_rate", RATE_SQL)
def windowed_rate(v: Views):
    path = scratch_folder(v.spark, "stream")
    requests = event_stream(v).select(
        F.col("interaction_id").alias("request_id"), F.col("user_id").alias("client"), "timestamp"
    )
    finished(jobs.stream_windowed_rate(
        requests, f"{path}/log", f"{path}/checkpoint", "1 hour", fanout=MERGED_BATCHES))
    out = jobs.over_limit(read_log(v.spark, f"{path}/log", jobs.SUMMED_REQUESTS, MERGED_BATCHES), 2)
    return out.withColumn("window_start", moment("window_start"))


@query(
    "windowed_rate_limit",
    """
    SELECT request_id, client, nth FROM (
        SELECT request_id, client, row_number() OVER (
            PARTITION BY client, date_trunc('hour', "timestamp")
            ORDER BY "timestamp", request_id) AS nth FROM v_requests)
    WHERE nth > 2""",
)
def windowed_rate_limit(v: Views):
    out = jobs.windowed_rate_limit(v.requests(), 2, "1 hour")
    return out.select("request_id", "client", F.col("nth").cast("bigint"))
