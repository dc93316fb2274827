"""Streaming twins of the online behaviours."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tastemill.operators.quality import interaction_rules, split_valid
from tastemill.streaming.log import (
    FANOUT,
    Merge,
    batch_folder,
    compact,
    exists,
    newest,
    read_before,
    summed,
)

# Fixed values --------------------------------------------------------------
RATE_LIMIT, RATE_WINDOW = 100, "60 seconds"
# ---------------------------------------------------------------------------


# how rows of several batches become one per key
NEWEST_COUNTS = newest("user_id", "movie_id")
NEWEST_PROFILE = newest("user_id")
SUMMED_REQUESTS = summed("requests", "client", "window_start")


def _stored_before(
    spark: SparkSession, folder: str, batch_id: int, days: list[str]
) -> DataFrame | None:
    """``(interaction_id, day)`` that other micro-batches have written for these days.

    Only the folders of the days are read, however long the history is; None if
    nothing is stored yet.
    """
    if not exists(spark, folder):
        return None
    stored = spark.read.schema("interaction_id string, day string, batch_id long").parquet(folder)
    return stored.where(F.col("day").isin(days) & (F.col("batch_id") != batch_id)).drop("batch_id")


def _logged(log: str, merge: Merge, fanout: int):
    """Store a micro-batch in a log and merge the batches before it."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_folder(log, batch_id))
        compact(batch.sparkSession, log, batch_id, merge, fanout)

    return store


def stream_interactions(
    events: DataFrame, good: str, quarantine: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Check arriving interactions and store good and broken rows apart.

    Every row ends up in one place: rows that break a rule or have no id in
    quarantine, rows whose id was stored before for the same day are repeats, all
    others, however late, are stored. Good rows are kept by day, so a batch only
    looks into the days it brings; their list is one short text per calendar day.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        ruled = interaction_rules(batch)
        no_id = F.when(F.col("interaction_id").isNull(), F.array(F.lit("interaction_id_missing")))
        checked = ruled.withColumn(
            "violations",
            F.concat("violations", F.coalesce(no_id, F.array().cast("array<string>"))),
        ).persist()
        ok, broken = split_valid(checked)
        day = F.date_format("timestamp", "yyyy-MM-dd")
        fresh = ok.withColumn("day", F.coalesce(day, F.lit("none"))).dropDuplicates(
            ["interaction_id", "day"]
        )
        days = [r["day"] for r in fresh.select("day").distinct().collect()]
        known = _stored_before(batch.sparkSession, good, batch_id, days)
        if known is not None:
            fresh = fresh.join(known, ["interaction_id", "day"], "left_anti")
        fresh.write.mode("overwrite").partitionBy("day").parquet(batch_folder(good, batch_id))
        broken.write.mode("overwrite").parquet(batch_folder(quarantine, batch_id))
        checked.unpersist()

    return _start(events.writeStream.foreachBatch(store), checkpoint, once)


def stream_user_statistics(
    events: DataFrame, log: str, checkpoint: str, once: bool = True, fanout: int = FANOUT
) -> StreamingQuery:
    """Keep counts per (user, movie) and log the changed rows of each micro-batch.

    Distinct counts stay exact: state holds one small row per pair, not a set
    per user, so a very active user is spread over many state rows. The log is
    merged as it grows; :func:`tastemill.streaming.log.read_log` with
    ``NEWEST_COUNTS`` reads one row per pair.
    """
    watched = F.coalesce(F.col("interaction_type") == "watch", F.lit(False))
    per_pair = events.groupBy("user_id", "movie_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("rating").alias("rating_sum"),
        F.count("rating").alias("rating_n"),
        F.max(watched).alias("was_watched"),
    )

    store = _logged(log, NEWEST_COUNTS, fanout)
    writer = per_pair.writeStream.outputMode("update").foreachBatch(store)
    return _start(writer, checkpoint, once)


def statistics_from_log(log: DataFrame) -> DataFrame:
    """User statistics from the newest logged row of each (user, movie)."""
    fields = ("n", "rating_sum", "rating_n", "was_watched")
    newest = log.groupBy("user_id", "movie_id").agg(
        F.max_by(F.struct(*fields), "batch_id").alias("last")
    ).select("user_id", "movie_id", "last.*")
    return newest.groupBy("user_id").agg(
        F.sum("n").alias("interaction_count"),
        F.coalesce(F.try_divide(F.sum("rating_sum"), F.sum("rating_n")), F.lit(0.0)).alias(
            "average_rating"
        ),
        F.count_if(F.col("rating_n") > 0).alias("rated_movies"),
        F.count_if(F.col("was_watched")).alias("watched_movies"),
    )


PROFILE_SCHEMA = "user_id string, interaction_count bigint, avg_rating double"
PROFILE_STATE = "interaction_count bigint, avg_rating double"


def fold_profile(count: int, average: float, ratings: Iterator[float | None]) -> tuple[int, float]:
    """Running average that divides by all interactions but moves on rated ones only."""
    for rating in ratings:
        count += 1
        if rating is not None and rating == rating:
            average = (average * (count - 1) + rating) / count
    return count, average


def _profile_updater(idle_days: int):
    def update(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, average = state.get if state.exists else (0, 0.0)
        # (time, id, rating) of this micro-batch only; order matters for the average
        rows = pd.concat([b[["timestamp", "interaction_id", "rating"]] for b in batches])
        rows = rows.sort_values(["timestamp", "interaction_id"])
        count, average = fold_profile(count, average, rows["rating"].tolist())
        state.update((count, average))
        state.setTimeoutDuration(idle_days * 24 * 3600 * 1000)
        yield pd.DataFrame(
            {"user_id": [key[0]], "interaction_count": [count], "avg_rating": [average]}
        )

    return update


def profiles_after(batch: DataFrame, before: DataFrame | None) -> DataFrame:
    """``(user_id, interaction_count, avg_rating)`` of a batch's users, who go on from ``before``.

    :func:`fold_profile` in built-in expressions, over a user's rows in order of time and id,
    missing ones last.
    """
    row = F.struct(
        F.col("timestamp").isNull(), "timestamp", F.col("interaction_id").isNull(), "interaction_id",
        F.nanvl(F.col("rating").cast("double"), F.lit(None).cast("double")).alias("rating"),
    )
    users = batch.groupBy("user_id").agg(F.sort_array(F.collect_list(row))["rating"].alias("ratings"))
    count, average = F.lit(0).cast("bigint"), F.lit(0.0)
    if before is not None:
        known = before.select(
            F.col("user_id").alias("known"), F.col("interaction_count").alias("n"), F.col("avg_rating").alias("mean")
        )
        users = users.join(known, F.col("user_id").eqNullSafe(F.col("known")), "left")
        count, average = F.coalesce("n", count), F.coalesce("mean", average)

    def moved(at: Column, rating: Column) -> Column:
        n = at["n"] + 1
        mean = F.when(rating.isNull(), at["mean"]).otherwise((at["mean"] * at["n"] + rating) / n)
        return F.struct(n.alias("n"), mean.alias("mean"))

    last = F.aggregate("ratings", F.struct(count.alias("n"), average.alias("mean")), moved)
    return users.select("user_id", last.alias("last")).select(
        "user_id", F.col("last.n").alias("interaction_count"), F.col("last.mean").alias("avg_rating")
    )


def stream_user_profile(
    events: DataFrame, log: str, checkpoint: str, once: bool = True,
    idle_days: int | None = None, fanout: int = FANOUT,
) -> StreamingQuery:
    """Sequential running profile per user, two numbers of state each.

    A user's rows of one micro-batch are ordered in memory, so bound the batch at
    the source (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``). By default the log is the
    state: a batch goes on from what the batches before it say, without Python. With
    ``idle_days`` a user idle for longer starts anew, which takes the state store and its timers.
    """
    store = _logged(log, NEWEST_PROFILE, fanout)
    if idle_days is None:

        def follow(batch: DataFrame, batch_id: int) -> None:
            before = read_before(batch.sparkSession, log, batch_id, NEWEST_PROFILE, fanout)
            store(profiles_after(batch, before), batch_id)

        return _start(events.writeStream.foreachBatch(follow), checkpoint, once)
    profiles = events.groupBy("user_id").applyInPandasWithState(
        _profile_updater(idle_days), PROFILE_SCHEMA, PROFILE_STATE, "update",
        GroupStateTimeout.ProcessingTimeTimeout,
    )
    return _start(profiles.writeStream.outputMode("update").foreachBatch(store), checkpoint, once)


def newest_profiles(log: DataFrame) -> DataFrame:
    newest = log.groupBy("user_id").agg(
        F.max_by(F.struct("interaction_count", "avg_rating"), "batch_id").alias("last")
    )
    return newest.select("user_id", "last.*")


def user_profile_running(interactions: DataFrame) -> DataFrame:
    """The same profile in one batch, without Python.

    A rated interaction at place k keeps (k-1)/k of the average and adds r/k, so
    each rating ends up multiplied by the later (m-1)/m; those products are
    differences of a running sum of logarithms.
    """
    w = Window.partitionBy("user_id").orderBy("timestamp", "interaction_id")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.col("place")
    rated = F.col("rating").isNotNull()
    shrink = F.when(rated & (place > 1), F.log((place - 1) / place)).otherwise(F.lit(0.0))
    rows = interactions.withColumn("place", F.row_number().over(w)).withColumn(
        "shrunk", F.sum(shrink).over(upto)
    )
    # exp(final - shrunk) over all rows of a user: factor the final value out
    return (
        rows.groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("interaction_count"),
            F.sum(F.when(rated, F.col("rating") / place * F.exp(-F.col("shrunk")))).alias("sum"),
            F.min("shrunk").alias("final"),
        )
        .select(
            "user_id", "interaction_count",
            F.coalesce(F.col("sum") * F.exp("final"), F.lit(0.0)).alias("avg_rating"),
        )
    )


def window_counts(requests: DataFrame, window: str = RATE_WINDOW) -> DataFrame:
    """Requests per client and fixed window."""
    timed = requests.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return (
        timed.groupBy("client", F.window("timestamp", window).alias("w"))
        .agg(F.count(F.lit(1)).alias("requests"))
        .select("client", F.col("w.start").alias("window_start"), "requests")
    )


def over_limit(counts: DataFrame, limit: int = RATE_LIMIT) -> DataFrame:
    """Sum counts per client and window; the part above the limit is rejected."""
    return (
        counts.groupBy("client", "window_start")
        .agg(F.sum("requests").alias("requests"))
        .withColumn("rejected", F.greatest(F.col("requests") - limit, F.lit(0)))
    )


def windowed_rate(
    requests: DataFrame, limit: int = RATE_LIMIT, window: str = RATE_WINDOW
) -> DataFrame:
    """Requests per client and fixed window with the number over the limit."""
    return over_limit(window_counts(requests, window), limit)


def windowed_rate_limit(
    requests: DataFrame, limit: int = RATE_LIMIT, window: str = RATE_WINDOW
) -> DataFrame:
    """Which requests a fixed-window limiter would have turned away."""
    start: Column = F.window(F.col("timestamp").cast("timestamp"), window)["start"]
    timed = requests.withColumn("window_start", start)
    w = Window.partitionBy("client", "window_start").orderBy("timestamp", "request_id")
    return timed.withColumn("nth", F.row_number().over(w)).where(F.col("nth") > limit)


def stream_windowed_rate(
    requests: DataFrame, log: str, checkpoint: str, window: str = RATE_WINDOW,
    once: bool = True, fanout: int = FANOUT,
) -> StreamingQuery:
    """Log the counts of each micro-batch; :func:`over_limit` sums the log.

    Batches count on their own, so there is no state to bound and a request is
    counted however late it comes. The log is merged as it grows; read it with
    ``SUMMED_REQUESTS``.
    """
    keep = _logged(log, SUMMED_REQUESTS, fanout)

    def store(batch: DataFrame, batch_id: int) -> None:
        keep(window_counts(batch, window), batch_id)

    return _start(requests.writeStream.foreachBatch(store), checkpoint, once)


def _start(writer, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
