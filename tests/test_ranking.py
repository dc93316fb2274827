import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemill.functions import ranking, skew


@pytest.mark.parametrize("seed, ordered", [(1, 20_000), (2, 4)])
def test_exact_quantiles_match_linear_interpolation(spark, seed, ordered):
    rng = np.random.default_rng(seed)
    data = {
        "a": np.round(rng.normal(0, 50, 301), 2),
        "b": np.repeat([3.0, 4.0], [300, 1]),
        "c": rng.integers(-5, 5, 301).astype(float),
    }
    df = spark.createDataFrame(list(zip(*[map(float, v) for v in data.values()])), list(data))
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {
        (r["name"], r["prob"]): r["value"]
        for r in ranking.exact_quantiles(df, list(data), probs, ordered).collect()
    }
    for name, xs in data.items():
        for p in probs:
            assert got[name, p] == pytest.approx(np.percentile(xs, p * 100)), (name, p)


def test_keys_are_in_the_order_of_the_doubles(spark):
    tiny = 5e-324
    values = [float("-inf"), -1e308, -1.5, -1.0, -tiny, 0.0, tiny, 1.0, 1.0 + 2**-52, 1e308, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", ranking.ordered_key(F.col("v")).alias("key")
    )
    assert [r["v"] for r in df.orderBy("key").collect()] == values


@pytest.mark.parametrize(
    "values",
    [
        1.7e9 + np.arange(3000) / 7,  # one day's seconds
        1e-9 * (1 + np.arange(3000) / 1e6),  # tiny fractions
        np.concatenate([np.full(40, -np.inf), np.linspace(-1, 1, 2999), np.full(21, np.inf)]),
        np.concatenate([np.full(2000, 3.25), np.arange(1000.0)]),  # a value of two thirds of the rows
    ],
)
def test_quantiles_of_values_that_lie_close_together(spark, values):
    """The radix histogram goes on until a range is small; nothing larger is ordered."""
    df = spark.createDataFrame([(float(v),) for v in np.random.default_rng(1).permutation(values)], "x double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r["prob"]: r["value"] for r in ranking.exact_quantiles(df, ["x"], probs, ordered=16).collect()}
    ordered = np.sort(values)
    for p in probs:
        at = (len(values) - 1) * p
        low, part = int(np.floor(at)), at - np.floor(at)
        want = ordered[low] if part == 0 else (1 - part) * ordered[low] + part * ordered[low + 1]
        assert got[p] == want or got[p] == pytest.approx(want, rel=1e-15)


def test_no_range_above_the_stated_size_is_left(spark):
    values = [1.0 + i * 2.0**-52 for i in range(500)]  # equal in all but the last bits
    counts = spark.createDataFrame([("x", v, 1) for v in values], "name string, v double, n long")
    counts = counts.withColumn("key", ranking.ordered_key(F.col("v")))
    totals = counts.groupBy("name").agg(F.sum("n").alias("total"))
    ranges, sizes = None, []
    for shift in (48, 32, 16, 0):
        ranges = ranking._ranges(counts, [0.5], totals, shift, ranges)
        sizes.append(max(r["size"] for r in ranges.collect()))
    assert sizes == [500, 500, 500, 1]


def test_quantiles_ignore_null_and_single_value(spark):
    df = spark.createDataFrame([(None,), (2.0,)], "x double")
    assert ranking.exact_quantiles(df, ["x"], [0.5]).collect()[0]["value"] == 2.0


def test_dense_index_is_sorted_and_dense(spark):
    df = spark.createDataFrame([(x,) for x in ["b", "a", "10", "9", "a", None]], "v string")
    got = {r["v"]: r["idx"] for r in ranking.dense_index(df.repartition(3), "v").collect()}
    assert got == {"10": 0, "9": 1, "a": 2, "b": 3}


def test_top_n_ties_by_id(spark, rows):
    df = spark.createDataFrame(
        [("u", "b", 1.0), ("u", "a", 1.0 + 1e-12), ("u", "c", 2.0)],
        "user_id string, movie_id string, score double",
    )
    assert rows(ranking.top_n(df, 2), "movie_id", "rank") == [("a", 2), ("c", 1)]


def test_pages(spark, rows):
    df = spark.range(10)
    assert rows(ranking.page(df, [F.col("id").desc()], 2, 3)) == [(5,), (6,)]
    per = ranking.page_per(df.withColumn("g", F.col("id") % 2), ["g"], [F.col("id")], 1, 1)
    assert rows(per, "id") == [(2,), (3,)]
    with pytest.raises(ValueError):
        ranking.page(df, [F.col("id")], -1)


def test_salted_join_equals_join(spark, rows):
    left = spark.createDataFrame([("h" if i % 3 else f"k{i}", i) for i in range(60)], "k string, a int")
    right = spark.createDataFrame([("h", 1), ("h", 2), ("k3", 3), ("k9", 4)], "k string, b int")
    hot = skew.hot_keys(left, "k", share=0.1, floor=0)
    assert rows(hot) == [("h", 40)]
    salted = skew.salted_join(left, right, "k", hot, ["a"])
    assert rows(salted, "k", "a", "b") == rows(left.join(right, "k"), "k", "a", "b")


def test_key_counts(spark):
    df = spark.createDataFrame([("u", "a"), ("u", "b"), ("v", "b")], "user_id string, movie_id string")
    counts = skew.key_counts(df, "user_id", "movie_id")
    assert counts.total == 3 and counts.largest == {"user_id": 2, "movie_id": 2}
    assert not counts.has_hot("user_id")


def test_numbers_of_sorted_values(spark):
    values = [("b",), (None,), ("é",), ("a",), ("b",)] + [(f"x{i:04d}",) for i in range(500)]
    got = ranking.dense_index(spark.createDataFrame(values, "k string"), "k").collect()
    want = sorted({v for v, in values if v is not None}, key=lambda v: v.encode())
    assert {r.k: r.idx for r in got} == {k: i for i, k in enumerate(want)}


def test_adaptive_execution_splits_a_skewed_join(spark):
    keys = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "0",
    }
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        left = spark.range(0, 60_000, 1, 8).select(
            F.when(F.col("id") % 3 > 0, F.lit("h")).otherwise(F.concat(F.lit("k"), F.col("id") % 97)).alias("k"),
            F.col("id").alias("a"),
        )
        right = spark.range(0, 98, 1, 2).select(
            F.when(F.col("id") == 97, F.lit("h")).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"),
            F.col("id").alias("b"),
        )
        out = skew.salted_join(left, right, "k", None, ["a"])
        assert len(out.collect()) == 60_000
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
