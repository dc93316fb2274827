"""Levelled logs of micro-batches: cover, replay, cleaning up, and what a batch reads."""

import random

import pytest
from pyspark.sql import functions as F

from tastemill.operators import catalog
from tastemill.streaming import jobs, log


@pytest.mark.parametrize("fanout", [2, 3, 8])
def test_cover_says_each_batch_once(fanout):
    for stored in (0, 1, 7, 64, 200):
        runs = {
            (level, end - fanout**level)
            for level in range(1, 9)
            for end in range(fanout**level, stored + 1, fanout**level)
        }
        parts = log.cover(range(stored + 1), runs, fanout)
        said = [n for level, first in parts for n in range(first, first + fanout**level)]
        assert said == list(range(stored + 1))
        for level in range(1, 9):
            assert sum(at == level for at, _ in parts) < fanout
        assert sum(at == 0 for at, _ in parts) <= fanout


def put(spark, folder, batch_id, rows):
    frame = spark.createDataFrame(rows, "client string, window_start int, requests long")
    jobs._logged(folder, jobs.SUMMED_REQUESTS, 2)(frame, batch_id)


def totals(spark, folder):
    rows = log.read_log(spark, folder, jobs.SUMMED_REQUESTS, 2).collect()
    return {(r.client, r.window_start): r.requests for r in rows}


def test_replays_lost_runs_and_cleaning_change_nothing(spark, tmp_path):
    folder, rng, want, batches = str(tmp_path / "log"), random.Random(3), {}, []
    for n in range(9):
        rows = [(rng.choice([None, "a", "b"]), rng.randrange(2), rng.randrange(1, 9)) for _ in range(6)]
        rows = [] if n == 4 else [(*k, sum(r[2] for r in rows if r[:2] == k)) for k in {r[:2] for r in rows}]
        batches.append(rows)
        for c, w, k in rows:
            want[c, w] = want.get((c, w), 0) + k
        put(spark, folder, n, rows)
    stored, runs = log.contents(spark, folder)
    assert stored == set(range(9))
    assert runs == {(1, 0), (1, 2), (1, 4), (1, 6), (2, 0), (2, 4), (3, 0)}
    assert log.cover(stored, runs, 2) == [(3, 0), (0, 8)]
    assert totals(spark, folder) == want
    put(spark, folder, 8, batches[8])  # the newest batch comes again
    assert totals(spark, folder) == want
    # a run without its mark, as a lost driver leaves it, does not count and is made again
    store, mark = log._store(spark, f"{log.run_folder(folder, 3, 0)}/_SUCCESS")
    store.delete(mark, False)
    assert (3, 0) not in log.contents(spark, folder)[1]
    assert totals(spark, folder) == want
    put(spark, folder, 8, batches[8])
    assert (3, 0) in log.contents(spark, folder)[1]
    assert len(log.drop_covered(spark, folder, 2)) == 8 + 6
    assert log.contents(spark, folder) == ({8}, {(3, 0)})
    assert totals(spark, folder) == want
    put(spark, folder, 8, batches[8])  # nothing is made from what is gone
    assert totals(spark, folder) == want


def test_empty_log_raises(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        log.read_log(spark, str(tmp_path / "none"), jobs.NEWEST_PROFILE)


SCHEMA = (
    "interaction_id string, user_id string, movie_id string, interaction_type string,"
    " rating double, duration double, timestamp timestamp"
)


def feed(spark, tmp_path, parts):
    """One file per micro-batch and a stream over them."""
    folder = str(tmp_path / "in")
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA.replace("timestamp timestamp", "s long")).withColumn(
            "timestamp", F.timestamp_seconds("s")
        ).drop("s").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    return spark.read.schema(SCHEMA).parquet(folder), stream


def test_statistics_from_runs_and_restart(spark, tmp_path):
    row = lambda i: (str(i), f"u{i % 3}", f"m{i % 5}", ["rating", "watch"][i % 2],
                     float(i % 6) if i % 2 == 0 else None, None, i)
    events, stream = feed(spark, tmp_path, [[row(i) for i in range(5 * k, 5 * k + 5)] for k in range(3)])
    where = (f"{tmp_path}/log", f"{tmp_path}/c")
    jobs.stream_user_statistics(stream, *where, fanout=2).awaitTermination()
    events, stream = feed(spark, tmp_path, [[row(i) for i in range(15 + k, 20, 2)] for k in range(2)])
    jobs.stream_user_statistics(stream, *where, fanout=2).awaitTermination()  # goes on from its checkpoint
    assert log.contents(spark, where[0])[1] == {(1, 0), (1, 2), (2, 0)}
    got = jobs.statistics_from_log(log.read_log(spark, where[0], jobs.NEWEST_COUNTS, 2))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in catalog.user_statistics(events).collect()}


def test_a_batch_reads_only_the_days_it_brings(spark, tmp_path):
    row = lambda i, day: (str(i), "u", "m", "rating", 3.0, None, day * 86_400)
    _, stream = feed(spark, tmp_path, [[row(i, i) for i in range(30)], [row(3, 3), row(99, 3)]])
    good = f"{tmp_path}/good"
    jobs.stream_interactions(stream, good, f"{tmp_path}/bad", f"{tmp_path}/c").awaitTermination()
    ids = [r.interaction_id for r in spark.read.parquet(good).collect()]
    assert sorted(ids) == sorted([*map(str, range(30)), "99"])
    seen = jobs._stored_before(spark, good, 7, ["1970-01-04"])
    assert {r.interaction_id for r in seen.collect()} == {"3", "99"}
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "1970-01-04" in plan.split("PartitionFilters")[1]
    assert jobs._stored_before(spark, f"{tmp_path}/none", 0, []) is None
