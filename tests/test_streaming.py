import pytest
from pyspark.sql import functions as F

from tastemill.operators import catalog
from tastemill.streaming import jobs, log

SCHEMA = (
    "interaction_id string, user_id string, movie_id string, interaction_type string,"
    " rating double, duration double, timestamp timestamp"
)


@pytest.fixture
def feed(spark, tmp_path):
    """Events in three files, read one file per micro-batch."""
    data = [
        (str(i), f"u{i % 4}", f"m{i % 7}", ["rating", "watch", "click"][i % 3],
         float(i % 7) if i % 3 == 0 else None, None, i)
        for i in range(120)
    ]
    events = spark.createDataFrame(
        data, SCHEMA.replace("timestamp timestamp", "minute int")
    ).withColumn("timestamp", F.timestamp_seconds(F.col("minute") * 20 + 1_600_000_000)).drop("minute")
    folder = str(tmp_path / "in")
    for part in range(3):
        events.where(F.floor(F.col("interaction_id").cast("int") / 40) == part).coalesce(1).write.mode(
            "append"
        ).parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return events, stream, str(tmp_path)


def test_interactions_are_split_and_replayed_once(spark, feed):
    events, stream, folder = feed
    for _ in range(2):  # the second run finds nothing new
        jobs.stream_interactions(
            stream, f"{folder}/good", f"{folder}/bad", f"{folder}/c"
        ).awaitTermination()
    good, bad = spark.read.parquet(f"{folder}/good"), spark.read.parquet(f"{folder}/bad")
    assert good.count() + bad.count() == 120
    assert bad.count() == events.where("rating > 5").count() > 0


def test_late_rows_and_rows_without_id_are_kept(spark, tmp_path):
    row = lambda i, day, rating=3.0: (i, "u", "m", "rating", rating, None, day * 86_400)
    files = [
        [row("a", 40), row("b", 40), row(None, 40), row(None, 41)],
        [row("a", 40), row("c", 1), row("d", 2, 9.0), row(None, 1)],  # a repeat, and long past
        [row("c", 1), row("e", 39), row("e", 39), row("f", 0), ("g", "u", "m", "rating", 1.0, None, None)],
    ]
    folder = str(tmp_path / "in")
    for rows in files:
        spark.createDataFrame(rows, SCHEMA.replace("timestamp timestamp", "s long")).withColumn(
            "timestamp", F.timestamp_seconds("s")
        ).drop("s").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    jobs.stream_interactions(stream, f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/c").awaitTermination()
    good = [r.interaction_id for r in spark.read.parquet(f"{tmp_path}/good").collect()]
    bad = [(r.interaction_id, tuple(r.violations)) for r in spark.read.parquet(f"{tmp_path}/bad").collect()]
    assert sorted(good) == ["a", "b", "c", "e", "f", "g"]
    assert sorted(bad, key=str) == [("d", ("rating_out_of_range",))] + [(None, ("interaction_id_missing",))] * 3
    repeats = 3  # a, c, e
    assert len(good) + len(bad) + repeats == sum(map(len, files))


def test_statistics_equal_batch(spark, feed):
    events, stream, folder = feed
    jobs.stream_user_statistics(stream, f"{folder}/log", f"{folder}/c").awaitTermination()
    log = spark.read.parquet(f"{folder}/log")
    assert log.select("batch_id").distinct().count() == 3
    got = {tuple(r) for r in jobs.statistics_from_log(log).collect()}
    assert got == {tuple(r) for r in catalog.user_statistics(events).collect()}


def test_profiles_equal_sequential_fold(spark, feed):
    events, stream, folder = feed
    jobs.stream_user_profile(stream, f"{folder}/log", f"{folder}/c").awaitTermination()
    newest = jobs.newest_profiles(spark.read.parquet(f"{folder}/log")).collect()
    streamed = {r.user_id: (r.interaction_count, pytest.approx(r.avg_rating)) for r in newest}
    # the batch twin orders ids as text within one time; times are unique here
    batch = {r.user_id: (r.interaction_count, r.avg_rating) for r in jobs.user_profile_running(events).collect()}
    assert batch == streamed
    for user in ("u0", "u1"):
        ratings = [r.rating for r in events.where(F.col("user_id") == user).orderBy("timestamp").collect()]
        assert batch[user] == (30, pytest.approx(jobs.fold_profile(0, 0.0, ratings)[1]))


def test_profiles_go_on_from_the_log(spark, feed):
    """No Python state per user; batches, a missing id or time, and a NaN rating fold as before."""
    events, stream, folder = feed
    query = jobs.stream_user_profile(stream, f"{folder}/log", f"{folder}/c", fanout=2)
    query.awaitTermination()
    assert query.lastProgress["stateOperators"] == []
    read = log.read_before(spark, f"{folder}/log", 2, jobs.NEWEST_PROFILE, 2)
    assert sum(r.interaction_count for r in read.collect()) < events.count()  # a replay goes on from the batches before
    assert log.read_before(spark, f"{folder}/log", 0, jobs.NEWEST_PROFILE, 2) is None
    rows = [
        ("u", "2", 20, 1.5), ("u", "1", 20, 4.0), ("u", None, 20, 3.0), ("u", "0", None, 2.0),
        ("u", "9", 5, float("nan")), ("u", "8", 6, None), (None, "7", 1, 2.0), ("new", "6", 1, None),
    ]
    batch = spark.createDataFrame(rows, "user_id string, interaction_id string, s long, rating double").withColumn(
        "timestamp", F.timestamp_seconds("s"))
    before = spark.createDataFrame([("u", 2, 3.0), (None, 1, 4.0)], jobs.PROFILE_SCHEMA)
    got = {r.user_id: (r.interaction_count, r.avg_rating) for r in jobs.profiles_after(batch, before).collect()}
    assert got == {
        "u": jobs.fold_profile(2, 3.0, [None, None, 4.0, 1.5, 3.0, 2.0]),
        None: jobs.fold_profile(1, 4.0, [2.0]), "new": (1, 0.0),
    }


def test_fold_moves_on_rated_only():
    assert jobs.fold_profile(0, 0.0, [4.0, None, 1.0]) == (3, (4.0 * 2 + 1.0) / 3)


def test_rates(spark, feed):
    events, stream, folder = feed
    as_requests = lambda df: df.select(
        F.col("interaction_id").alias("request_id"), F.col("user_id").alias("client"), "timestamp"
    )
    late_first = spark.read.parquet(f"{folder}/in").orderBy(F.desc("timestamp"))
    late_first.coalesce(1).write.parquet(f"{folder}/late")
    for name in ("in", "late"):
        source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}")
        jobs.stream_windowed_rate(
            as_requests(source), f"{folder}/log-{name}", f"{folder}/c-{name}", "5 minutes"
        ).awaitTermination()
        got = {tuple(r) for r in jobs.over_limit(spark.read.parquet(f"{folder}/log-{name}"), 3).collect()}
        assert got == {tuple(r) for r in jobs.windowed_rate(as_requests(events), 3, "5 minutes").collect()}
    batch = jobs.windowed_rate(as_requests(events), 3, "5 minutes")
    over = jobs.windowed_rate_limit(as_requests(events), 3, "5 minutes").count()
    assert over == sum(r.rejected for r in batch.collect()) > 0
