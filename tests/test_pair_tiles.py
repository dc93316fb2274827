"""Pairs and predictions in tiles, against the joins and in their plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemill.functions import products
from tastemill.operators import cf, matrix, similarity_join
from tastemill.operators import neighbour_tiles as nt
from tastemill.operators import pair_tiles


def cells_of(spark):
    """Two components, a user alone, ids whose order is not that of their numbers."""
    rng = np.random.default_rng(5)
    rows = [("alone", "m500", 2.0), ("é", "m1", 5.0), ("flat", "m2", 1.0)]
    for base, users, movies in ((0, 24, 14), (100, 5, 7)):
        for u in range(users):
            for m in rng.choice(movies, 4, replace=False):
                rows.append((f"u{base + u}", f"m{base + m}", float(rng.integers(1, 41)) / 8))
    return spark.createDataFrame(rows, "user_id string, movie_id string, rating double")


def rows_of(df):
    return {tuple(round(c, 7) if isinstance(c, float) else c for c in r) for r in df.collect()}


@pytest.fixture(params=["whole", "cut", "busy"])
def sizes(request, monkeypatch):
    """In one piece, with components cut up, and with busy rows left to the joins."""
    monkeypatch.setattr(pair_tiles, "BLOCK_WORK", 60)
    if request.param == "cut":
        monkeypatch.setattr(nt, "RESIDENT_CELLS", 8)
    if request.param == "busy":
        monkeypatch.setattr(pair_tiles, "ROW_WORK", 26)


def above_the_pairs(df):
    """The operators after the tiles; a pair table that is shuffled shows as an exchange."""
    return df._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]


def test_dots_equal_the_join(spark, sizes):
    cells = cells_of(spark)
    for row, key in (("user_id", "movie_id"), ("movie_id", "user_id")):
        want = products.dot_products(cells, None, row, key)
        assert rows_of(pair_tiles.row_dots(cells, row, key)) == rows_of(want)
        large = pair_tiles.row_dots(cells, row, key, least=6.0)
        assert rows_of(large) == rows_of(want.where("dot >= 6.0"))


@pytest.mark.parametrize("block", [5, 1_500_000])
def test_whole_rows_meet_in_few_tiles(spark, monkeypatch, block):
    """A row got the list of each of its keys; now a cell is sent once per tile, whoever it is met by."""
    assert pair_tiles._grid_tiles(36_000_000, 12) == 9 and pair_tiles._grid_tiles(216_000_000, 12) == 14
    monkeypatch.setattr(pair_tiles, "BLOCK_WORK", block)
    monkeypatch.setattr(pair_tiles, "TILE_CELLS", 30)
    again = cells_of(spark).where("user_id in ('u1', 'u2')")  # rows that hold keys twice
    cells = cells_of(spark).unionByName(again).withColumn("own", F.length("user_id") + F.lit(0.5))
    for least in (None, 6.0):
        got = pair_tiles.row_dots(cells, "user_id", "movie_id", least=least, carry="own")
        want = products.dot_products(cells).where(F.lit(least is None) | (F.col("dot") >= (least or 0)))
        want = want.select("*", (F.length("id_a") + 0.5).alias("a"), (F.length("id_b") + 0.5).alias("b"))
        assert rows_of(got) == rows_of(want) and got.count() == want.count()


def test_pearson_equals_the_join(spark, monkeypatch):
    """A user that rates all two movies of a universe alike has no spread, hence no correlation."""
    small = spark.createDataFrame(
        [("a", "m1", 1.0), ("a", "m2", 1.0), ("b", "m1", 2.0), ("b", "m2", 1.0), ("c", "m2", 4.0)],
        "user_id string, movie_id string, rating double",
    )
    for cells, n in ((cells_of(spark), 30), (small, 2)):
        got = rows_of(cf.user_similarity_pearson(cells, F.lit(n)))
        with monkeypatch.context() as m:
            m.setattr(cf, "DEGREE_LIMIT", 0)
            assert got == rows_of(cf.user_similarity_pearson(cells, F.lit(n)))


def test_predictions_equal_the_joins(spark, sizes, monkeypatch):
    cells = cells_of(spark)
    items = matrix.universe("movie_id", cells)
    # every user asks for movies of its own component and of the other
    pairs = cells.select("user_id").distinct().crossJoin(items).unionByName(
        spark.createDataFrame([("nobody", "m1"), ("u1", "none")], "user_id string, movie_id string")
    )
    for predict in (cf.user_cf_predict, cf.item_cf_predict):
        got = rows_of(predict(cells, pairs, items))
        with monkeypatch.context() as m:
            m.setattr(cf, "DEGREE_LIMIT", 0)
            assert got == rows_of(predict(cells, pairs, items))


@pytest.mark.parametrize("predict", [cf.user_cf_predict, cf.item_cf_predict])
def test_predictions_of_many_tiles_keep_the_nearest(spark, monkeypatch, predict):
    """Rows pass the asking ones a few at a time; ties at the fifth place go by id, as in the joins."""
    rows = [(f"u{u}", f"m{m}", 1.0 + (u * m) % 2) for u in range(14) for m in range(9) if (u + m) % 3]
    rows += [("u3", None, 4.0), ("u4", None, 2.0), (None, "m2", 3.0)]  # count for lengths and means alone
    cells = spark.createDataFrame(rows, "user_id string, movie_id string, rating double")
    items = matrix.universe("movie_id", cells)
    for name, value in {"LEAST_CELLS": 1, "KEPT_ROWS": 90, "WAITING": 10, "BLOCK_WORK": 60}.items():
        monkeypatch.setattr(pair_tiles, name, value)
    got = rows_of(predict(cells, cells, items))
    monkeypatch.setattr(cf, "DEGREE_LIMIT", 0)
    assert got == rows_of(predict(cells, cells, items))


def test_no_pair_is_shuffled(spark):
    cells = cells_of(spark)
    for df in (
        cf.user_similarity_cosine(cells),
        cf.item_similarity_cosine(cells),
        cf.user_similarity_pearson(cells, F.lit(30)),
    ):
        above = above_the_pairs(df)
        assert "Join" not in above and "Aggregate" not in above


@pytest.mark.parametrize("predict", [cf.user_cf_predict, cf.item_cf_predict])
def test_predictions_form_no_neighbour_rows_in_a_join(spark, predict):
    cells = cells_of(spark)
    plan = predict(cells, cells, matrix.universe("movie_id", cells))
    assert "Window" not in plan._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("row,key", [("user_id", "movie_id"), ("movie_id", "user_id")])
def test_a_threshold_joins_no_candidates(spark, monkeypatch, row, key):
    def refuse(*_):
        raise AssertionError("the pairs went through the index")

    monkeypatch.setattr(similarity_join, "candidate_pairs", refuse)
    pairs = similarity_join.similar_above(cells_of(spark), row, key, 0.5)
    assert pairs.where("sim < 0.5").isEmpty() and not pairs.isEmpty()


def test_no_cells(spark):
    cells = cells_of(spark).where("false")
    assert cf.user_similarity_cosine(cells).isEmpty()
    assert cf.item_cf_predict(cells, cells, matrix.universe("movie_id", cells)).isEmpty()
