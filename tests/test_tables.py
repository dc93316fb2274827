import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemill.operators import catalog, maintenance, mf
from tastemill.plans import workflows
from tastemill.sources import files, tables


def test_write_read_and_skip(spark, tmp_path, rows):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    tables.write_table({"t": df}, str(tmp_path))
    tables.write_table({"t": df.where("n = 1")}, str(tmp_path))
    found = tables.read_table(spark, str(tmp_path), ["t", "absent"])
    assert set(found) == {"t"} and rows(found["t"]) == [("a", 1)]
    tables.write_table({"c": df}, str(tmp_path), "csv")
    assert rows(tables.read_table(spark, str(tmp_path), ["c"], "csv")["c"]) == [("a", "1"), ("b", "2")]
    with pytest.raises(ValueError):
        tables.write_table({"t": df}, str(tmp_path), "pickle")


def test_jdbc_options():
    got = tables.jdbc_options("jdbc:x", "My Table", "id", 0, 100, 8)
    assert got["dbtable"] == "my_table" and got["numPartitions"] == "8"
    with pytest.raises(ValueError):
        tables.jdbc_options("jdbc:x", "t", "id")


def test_recommendation_documents(spark, tmp_path):
    recs = spark.createDataFrame(
        [("u", "m1", 2.0, 2), ("u", "m2", 3.0, 1), ("v", "m1", 1.0, 1)],
        "user_id string, movie_id string, score double, rank int",
    )
    folder = str(tmp_path / "r")
    tables.write_recommendations_json(recs, folder, "2020-01-01")
    doc = tables.load_recommendations(spark, folder, "u").collect()
    assert len(doc) == 1 and doc[0].generated_at == "2020-01-01"
    assert [(e["rank"], e["movie_id"]) for e in doc[0].recommendations] == [(1, "m2"), (2, "m1")]
    assert tables.load_recommendations(spark, folder).count() == 2


def test_appends_are_idempotent_by_id(spark, tmp_path):
    new = spark.createDataFrame(
        [("u", "m", "watch", None, '{"a": "1"}'), ("u", "n", "click", "2020-02-02 00:00:00", None)],
        "user_id string, movie_id string, interaction_type string, timestamp string, metadata string",
    ).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    folder = str(tmp_path / "i")
    for _ in range(2):
        maintenance.append_interactions(new, folder, "2020-01-01 00:00:00")
    stored = spark.read.parquet(folder)
    assert stored.count() == 4 and stored.select("interaction_id").distinct().count() == 2
    assert {str(r.day) for r in stored.collect()} == {"2020-01-01", "2020-02-02"}
    assert {tuple(sorted((r.metadata or {}).items())) for r in stored.collect()} == {(), (("a", "1"),)}


def test_merge_preferences(spark):
    users = spark.createDataFrame([("a", {"x": "1", "y": "2"}), ("b", None)], "user_id string, preferences map<string,string>")
    changes = spark.createDataFrame([("a", {"y": "9", "z": "3"}), ("c", {"q": "1"})], "user_id string, preferences map<string,string>")
    got = {r.user_id: r.preferences for r in maintenance.merge_preferences(users, changes).collect()}
    assert got == {"a": {"x": "1", "y": "9", "z": "3"}, "b": {}, "c": {"q": "1"}}


def test_feedback_repeats(spark):
    log = spark.createDataFrame([("r", None, False), ("s", None, None)], "recommendation_id string, served_at timestamp, clicked boolean")
    fb = spark.createDataFrame(
        [("r", "2020-01-02", True), ("r", "2020-01-01", False)], "recommendation_id string, served_at string, clicked boolean"
    ).withColumn("served_at", F.col("served_at").cast("timestamp"))
    got = {r.recommendation_id: r for r in maintenance.apply_feedback(log, fb).collect()}
    assert str(got["r"].served_at) == "2020-01-01 00:00:00" and got["r"].clicked
    assert got["s"].served_at is None and got["s"].clicked is False


def test_period_edges(spark):
    events = spark.createDataFrame(
        [("1", "a", "2020-01-31 00:00:00"), ("2", "b", "2020-01-01 00:00:00"), ("3", "c", "2019-12-31 23:59:59")],
        "interaction_id string, movie_id string, timestamp string",
    ).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    movies = spark.createDataFrame([(x, None) for x in "abcd"], "movie_id string, imdb_rating double")
    ids = lambda p: [r.movie_id for r in catalog.popular_movies(events, movies, "2020-01-31 00:00:00", p).collect()]
    assert ids("day") == ["a"]
    assert ids("month") == ids("no such period") == ["a", "b"]
    assert ids("all_time") == ["a", "b", "c", "d"]


def low_rank(spark):
    rng = np.random.default_rng(0)
    u, v = rng.random((30, 2)) * 1.5, rng.random((25, 2)) * 1.5
    m = np.clip(u @ v.T + 0.5, 0.1, 5)
    data = [(f"u{i}", f"m{j}", float(m[i, j])) for i in range(30) for j in range(25) if rng.random() < 0.7]
    return spark.createDataFrame(data, "user_id string, movie_id string, rating double")


def test_factorisation(spark, tmp_path):
    cells = low_rank(spark)
    pairs = cells.select("user_id", "movie_id")
    model = mf.mf_fit(cells, factors=4, iterations=8)
    fitted = mf.rmse(mf.mf_predict(model, pairs), cells).collect()[0].rmse
    plain = mf.rmse(mf.bias_predict(cells, pairs), cells).collect()[0].rmse
    assert fitted < plain
    again = mf.mf_fit(cells, factors=4, iterations=8)
    one = {tuple(r) for r in mf.mf_predict(model, pairs).collect()}
    # single-precision factors: equal up to summation order
    repeat = {(r[0], r[1]): r[2] for r in mf.mf_predict(again, pairs).collect()}
    assert repeat == {(u, m): pytest.approx(score, abs=1e-3) for u, m, score in one}
    recs = mf.mf_recommend(model, cells, 3)
    assert recs.join(cells, ["user_id", "movie_id"]).count() == 0
    scores = {(r.user_id, r.movie_id): r.score for r in mf.mf_predict(model, recs.select("user_id", "movie_id")).collect()}
    for r in recs.collect():
        assert r.score == pytest.approx(scores[r.user_id, r.movie_id])
    stranger = spark.createDataFrame([("x", "m1")], "user_id string, movie_id string")
    assert mf.mf_predict(model, stranger).collect()[0].score == 0.0
    similar = mf.mf_similar_items(model, 2).collect()
    assert all(r.movie_id != r.similar_id for r in similar)
    tables.save_factors(model, str(tmp_path), "2020-01-01")
    loaded = tables.load_factors(spark, str(tmp_path))
    known = {(u, m): pytest.approx(score) for u, m, score in one}
    assert known == {(r[0], r[1]): r[2] for r in mf.mf_predict(loaded, pairs).collect()}
    about = spark.read.json(f"{tmp_path}/about").collect()[0]
    assert (about.users, about["items"], about.factors) == (30, 25, 4)


def test_workflow_end_to_end(spark, tmp_path):
    movies = [
        {"movie_id": f"tt{i}", "title": f"Film {i}", "genres": [["Drama", "War"][i % 2]],
         "description": f"story number {i % 3} about things", "release_year": 1990 + i,
         "imdb_rating": 5 + i / 10}
        for i in range(6)
    ]
    lines = ["user_id,movie_id,rating,timestamp"] + [
        f"u{u},tt{m},{(u * 3 + m) % 5 + 1},2020-01-0{m + 1}T00:00:00"
        for u in range(4) for m in range(6) if (u + m) % 3
    ]
    package = tmp_path / "package"
    package.mkdir()
    (package / "metadata.json").write_text(json.dumps({"movies": movies}))
    (package / "data.csv").write_text("\n".join(lines))
    store = str(tmp_path / "store")
    workflows.load_data(spark, str(package), store, "2020-02-01 00:00:00")
    workflows.train(spark, store, "2020-02-01", factors=3, iterations=3)
    users = spark.createDataFrame([("u0",), ("u1",)], "user_id string")
    for algorithm in ("hybrid", "user_based", "item_based", "content", "matrix_factorization"):
        recs = workflows.recommend(spark, store, users, algorithm, 2, "2020-02-02 00:00:00").collect()
        assert {r.user_id for r in recs} == {"u0", "u1"} and all(r.title for r in recs)
    assert spark.read.parquet(f"{store}/recommendations").count() > 0


def test_partial_packages(spark, tmp_path):
    (tmp_path / "data.csv").write_text("user_id,movie_id,rating\nu1,m1,4\n")
    store = str(tmp_path / "store")
    workflows.load_data(spark, str(tmp_path), store, "2020-02-01 00:00:00")
    found = tables.read_table(spark, store, ["movies", *workflows.DERIVED])
    assert set(found) == {"interactions"} and found["interactions"].count() == 1
    only = tmp_path / "only"
    only.mkdir()
    (only / "metadata.json").write_text(json.dumps(
        {"movies": [{"movie_id": "m1", "title": "A", "genres": ["War"]}]}))
    workflows.load_data(spark, str(only), f"{store}2", "2020-02-01 00:00:00")
    found = tables.read_table(spark, f"{store}2", workflows.DERIVED)
    assert set(found) == {"movies"} and found["movies"].count() == 1
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="metadata or interactions"):
        workflows.load_data(spark, str(tmp_path / "none"), store, "2020-02-01 00:00:00")


def test_csv_with_doubled_quotes_and_line_breaks(spark, tmp_path):
    text = (
        "user_id,movie_id,rating,timestamp,metadata\n"
        'u1,m1,4,2024-01-01T00:00:00,"{""k"": 1, ""z"": 2}"\n'
        'u2,m2,3,2024-01-02T00:00:00,"two\nlines"\n'
    )
    (tmp_path / "a.csv").write_text(text)
    got = files.scan_interactions_csv(spark, str(tmp_path / "a.csv"), multiline=True).orderBy("user_id").collect()
    assert [r.metadata for r in got] == ['{"k": 1, "z": 2}', "two\nlines"]
    assert all(r.timestamp is not None for r in got)


def test_csv_files_with_other_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("user_id,movie_id,rating\nu1,m1,4\n")
    (tmp_path / "b.csv").write_text("movie_id,user_id,rating\nm2,u2,4\n")
    with pytest.raises(Exception, match="header"):
        files.scan_interactions_csv(spark, str(tmp_path)).collect()


def test_hashed_ids_tell_missing_values_apart(spark):
    rows = spark.createDataFrame([(None, "a"), ("a", None), ("", "a")], "x string, y string")
    ids = rows.select(maintenance.natural_key("x", "y").alias("id")).collect()
    assert len({r.id for r in ids}) == 3
