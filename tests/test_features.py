import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemill.operators import content, features
from tastemill.operators.mf import dot


def levels(spark, counts):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(counts)], "i int, interaction_count long")
    return [r.activity_level for r in features.activity_level(df).orderBy("i").collect()]


def test_activity_level(spark):
    assert levels(spark, [1, 2, 3, 4]) == ["low", "medium", "high", "very_high"]
    assert levels(spark, [1, 2, 3, 3]) == ["low"] * 4  # three distinct counts
    assert levels(spark, [1, 1, 1, 1, 1, 2, 3, 4]) == ["low"] * 8  # equal edges
    assert levels(spark, [10, 1, 2, 3, 4]) == ["very_high", "low", "low", "medium", "high"]


def test_user_features(spark):
    df = spark.createDataFrame(
        [("a", "m", 2.0), ("a", "n", 4.0), ("b", "m", None), ("c", "m", 2.4), ("c", "m", 2.4)],
        "user_id string, movie_id string, rating double",
    )
    got = {r.user_id: r for r in features.user_features(df).collect()}
    assert got["a"].interaction_count == 2 and got["a"].rating_std == pytest.approx(math.sqrt(2))
    assert got["b"].interaction_count == 0 and got["b"].rating_tendency == "generous"
    assert got["c"].rating_tendency == "harsh" and got["c"].unique_movies_rated == 1
    assert got["a"].rating_tendency == "average"


def test_scalers(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 5.0), ("b", 2.0, 5.0), ("c", None, 5.0), ("d", 6.0, 5.0)],
        "movie_id string, x double, k double",
    )
    norm = {r.movie_id: r for r in features.min_max_normalize(df, ["x", "k"]).collect()}
    assert norm["b"].x_normalized == pytest.approx(0.2) and norm["c"].x_normalized is None
    assert norm["a"].k_normalized == 0.0
    scaled = {r.movie_id: r for r in features.standard_scale(df, ["x", "k"]).collect()}
    filled = np.array([1, 2, 2, 6.0])
    want = (filled - filled.mean()) / filled.std()
    assert [scaled[m].x_scaled for m in "abcd"] == pytest.approx(list(want))
    assert scaled["c"].x == 2.0 and scaled["a"].k_scaled == 0.0


def test_label_encode_and_one_hot(spark, rows):
    df = spark.createDataFrame([("1", "b"), ("2", None), ("3", "a")], "movie_id string, language string")
    assert rows(features.label_encode(df, ["language"]), "movie_id", "language_encoded") == [
        ("1", 2), ("2", 0), ("3", 1),
    ]
    assert rows(features.categorical_one_hot(df, "language")) == [
        ("1", "language_b", 1.0), ("2", "language_Unknown", 1.0), ("3", "language_a", 1.0),
    ]
    assert rows(features.categorical_one_hot(df, "language", 2)) == [
        ("1", "language_encoded", 2.0), ("2", "language_encoded", 0.0),
        ("3", "language_encoded", 1.0),
    ]


def test_first_value_of_lists(spark):
    df = spark.createDataFrame([(["A. Kane ", "B"], "['X', 'Y']"), ([], None)], "a array<string>, t string")
    got = df.select(features.first_value(df, "a"), features.first_value(df, "t")).collect()
    assert [tuple(r) for r in got] == [("A. Kane", "X"), ("Unknown", "Unknown")]


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame(
        [("1", "red red fox"), ("2", "red dog"), ("3", "the")], "movie_id string, text string"
    )
    got = {(r.movie_id, r.term): r.value for r in features.tfidf(df, "text").collect()}
    red, fox = math.log(4 / 3) + 1, math.log(4 / 2) + 1
    norm = math.sqrt((2 * red) ** 2 + fox**2)
    assert got["1", "red"] == pytest.approx(2 * red / norm)
    assert got["1", "fox"] == pytest.approx(fox / norm)
    assert {m for m, _ in got} == {"1", "2"}  # only stop words in 3
    two = features.tfidf(df, "text", bigram=True, max_features=2)
    assert {r.term for r in two.collect()} == {"red", "dog"}


def test_weights(spark):
    df = spark.createDataFrame(
        [("m", "genres", "g", 1.0), ("m", "directors", "d", 1.0), ("m", "title", "t", 1.0)],
        "movie_id string, grp string, feature string, value double",
    )
    value = lambda w: {r.feature: r.value for r in features.weighted_features(df, w).collect()}
    assert value("declared") == {"g": 0.4, "d": 0.1, "t": 1.0}
    assert value("as_coded") == {"g": 1.0, "d": 0.1, "t": 1.0}
    assert value({"title": 2.0}) == {"g": 1.0, "d": 1.0, "t": 2.0}
    with pytest.raises(ValueError):
        features.weighted_features(df, "other")


def test_profile_score_equals_mean_of_similarities(spark):
    rng = np.random.default_rng(3)
    m = rng.random((8, 5))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    units = spark.createDataFrame(
        [(f"m{i}", f"f{j}", float(m[i, j])) for i in range(8) for j in range(5)],
        "movie_id string, feature string, value double",
    )
    ratings = spark.createDataFrame(
        [("u", "m1", 4.0), ("u", "m3", 1.5), ("u", "gone", 5.0), ("v", "gone", 2.0)],
        "user_id string, movie_id string, rating double",
    )
    want = (m @ m[1] * 4 + m @ m[3] * 1.5) / 3
    recs = content.content_recommend(units, ratings, 20).collect()
    got = {r.movie_id: r.score for r in recs if r.user_id == "u"}
    assert set(got) == {f"m{i}" for i in (0, 2, 4, 5, 6, 7)}
    for k, s in got.items():
        assert s == pytest.approx(want[int(k[1:])])
    # only unknown movies rated: everything scores zero, in id order
    assert [r.movie_id for r in sorted(recs, key=lambda r: r["rank"]) if r.user_id == "v"][0] == "m0"
    pairs = spark.createDataFrame([("u", "m0"), ("x", "m0")], "user_id string, movie_id string")
    scores = {r.user_id: r.score for r in content.content_predict(units, ratings, pairs).collect()}
    assert scores["u"] == pytest.approx(want[0]) and scores["x"] == 0.0


def test_latest_ratings_take_the_oldest_of_the_recent(spark, rows):
    data = [("u", "m", float(i), f"2020-01-{i:02d}", str(i)) for i in range(1, 6)]
    data += [("u", "n", 0.0, "2020-02-01", "8"), ("u", "o", None, "2020-02-02", "9")]
    df = spark.createDataFrame(
        data, "user_id string, movie_id string, rating double, timestamp string, interaction_id string"
    )
    assert rows(content.latest_ratings(df, 5)) == [("u", "m", 3.0)]


def test_dot(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert df.select(dot("a", "b")).collect()[0][0] == 11.0


@pytest.mark.parametrize("ties", [10, 1])
def test_pairs_of_rare_words_are_not_formed(spark, monkeypatch, ties):
    monkeypatch.setattr(features, "TIES", ties)
    rng = np.random.default_rng(12)
    names = [f"w{i:02d}" for i in range(40)]
    share = 1 / np.arange(1, 41)
    texts = [list(rng.choice(names, n, p=share / share.sum())) for n in rng.integers(0, 60, 40)]
    texts += [["w38", "w39"] * 20, ["w00"], [], ["solo", "solo"]]
    df = spark.createDataFrame(
        [(str(i), " ".join(t)) for i, t in enumerate(texts)], "movie_id string, text string"
    )
    for size in (1, 7, 30, 5000):
        counts = {}
        for t in texts:
            for term in [*t, *(f"{a} {b}" for a, b in zip(t, t[1:]))]:
                counts[term] = counts.get(term, 0) + 1
        want = sorted(counts, key=lambda x: (-counts[x], x))[:size]
        got = {r.term for r in features.tfidf(df, "text", max_features=size, bigram=True).collect()}
        assert got == set(want)
    ids = df.select("movie_id", F.split("text", " ").alias("_words")).where("text <> ''")
    terms, chosen = features._chosen_terms(ids, "movie_id", 7, True)
    formed = {r.term for r in terms.select("term").distinct().collect() if " " in r.term}
    assert ties == 1 or len(formed) <= 7 * 8
    assert len(chosen) == 7


@pytest.mark.parametrize("tile,slots", [(1000, 4096), (4, 2)])
def test_content_pairs_are_summed_where_tiles_meet(spark, tile, slots):
    cells = [(f"m{i}", f"f{j}", float(1 + i - j)) for i in range(12) for j in range(6) if (i * 7 + j) % 3 == 0]
    cells += [("m0", "x", 1.0), ("m1", "x", 2.0), ("lone", "y", 1.0)]
    units = spark.createDataFrame(cells, "movie_id string, feature string, value double")
    want = {}
    for a, f, x in cells:
        for b, g, y in cells:
            if f == g and a < b:
                want[a, b] = want.get((a, b), 0.0) + x * y
    out = content.content_similarity(units, tile, slots)
    got = [(r.id_a, r.id_b, r.sim) for r in out.collect()]
    assert len(got) == len(want) and 0.0 in want.values()  # a sum of zero is a pair as well
    for a, b, s in got:
        assert s == pytest.approx(want[a, b], abs=1e-9)
    assert "hashpartitioning(id_a" not in out._jdf.queryExecution().executedPlan().toString()
