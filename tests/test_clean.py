from pyspark.sql import functions as F

from tastemill.operators import clean

AS_OF = "2020-01-01 00:00:00"


def test_clean_interactions(spark, rows):
    dirty = spark.createDataFrame(
        [
            ("u1", "m1", "7", "2019-05-01T10:00:00"),
            ("u1", "m1", "7", "2019-05-01T10:00:00"),
            ("u1", "m2", "-2", "rubbish"),
            ("u2", "m2", None, None),
            ("u2", "m3", "x", "2019-05-01T10:00:00"),
            (None, "m3", "3", None),
            ("u3", None, "3", None),
        ],
        "user_id string, movie_id string, rating string, timestamp string",
    )
    got = rows(
        clean.clean_interactions(dirty, AS_OF).withColumn("timestamp", F.col("timestamp").cast("string"))
    )
    assert got == [
        ("u1", "m1", 5.0, "2019-05-01 10:00:00"),
        ("u1", "m2", 0.0, AS_OF),
        ("u2", "m2", None, AS_OF),
        ("u2", "m3", None, "2019-05-01 10:00:00"),
    ]


def test_clean_metadata(spark):
    raw = spark.createDataFrame(
        [
            (0, 1, " First ", "A, B", "Café—noir!", "1999", None, "fr"),
            (1, 1, "Second", "C", "", "2001", None, "fr"),
            (2, 2, "Other", "[A, B]", None, "x", "90", "en"),
            (3, 3, "Third", None, "a  b", "2003", "110", None),
            (4, 4, "Fourth", "D", "c", None, "100", "en"),
        ],
        "n int, movie_id int, title string, genres string, description string,"
        " release_year string, duration_minutes string, language string",
    )
    got = {r.movie_id: r for r in clean.clean_metadata(raw, ["n"]).collect()}
    assert set(got) == {"1", "2", "3", "4"}
    assert got["1"].title == "First" and got["1"].title_clean == "first"
    assert got["1"].genres == ["A", "B"] == got["2"].genres
    assert got["1"].all_genres == "A B" and got["1"].genre_count == 2
    assert got["3"].genres == [] and got["3"].genre_count == 0
    assert got["1"].description_clean == "cafénoir!" and got["2"].description_clean == ""
    assert got["2"].release_year == 2001.0 and got["4"].release_year == 2001.0
    assert got["1"].duration_minutes == 100.0
    assert got["3"].language == "en"  # two against one


def test_fill_missing_ties_and_nothing_known(spark):
    df = spark.createDataFrame([("b", None), ("a", None), (None, None)], "x string, y string")
    got = clean.fill_missing(df).collect()
    assert sorted(r.x for r in got) == ["a", "a", "b"]
    assert {r.y for r in got} == {"Unknown"}


def test_genres_given_as_list(spark):
    df = spark.createDataFrame([([" a ", "b"],), (None,)], "genres array<string>")
    got = [r[0] for r in df.select(clean.genres_as_array(df)).collect()]
    assert got == [["a", "b"], []]


def test_missing_titles_take_the_most_frequent(spark, rows):
    movies = spark.createDataFrame(
        [("1", "Up"), ("2", "Up"), ("3", None), ("4", "Heat")], "movie_id string, title string"
    )
    out = clean.clean_metadata(movies)
    assert rows(out, "movie_id", "title", "title_clean")[2] == ("3", "Up", "up")
