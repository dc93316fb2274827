from pyspark.sql import functions as F

from tastemill.functions import columns as c


def values(spark, texts, expr, kind="string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, t {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def test_clean_text_keeps_letters_of_any_script(spark):
    got = values(spark, ["  Éa—b  (C)\t d!? ", "x_1 #2, y.", None], c.clean_text)
    assert got == ["éab c d!?", "x_1 2, y.", None]


def test_parse_genres(spark):
    got = values(spark, ["Drama, War", "[Drama, 'War']", '["A","B"]', "", None], c.parse_genres)
    assert got == [["Drama", "War"], ["Drama", "War"], ["A", "B"], [""], []]


def test_movie_id_from_filename(spark):
    names = ["tt1234567.jpg", "movie-poster-tt12345678.PNG", "00123.mp4", "ab12.jpg", "a.123.jpg"]
    got = values(spark, names, c.movie_id_from_filename)
    assert got == ["tt1234567", "tt12345678", "00123", None, None]


def test_file_extension(spark):
    got = values(spark, ["a.JPG", "a.tar.gz", ".hidden", "plain"], c.file_extension)
    assert got == [".jpg", ".gz", "", ""]


def test_clip_guards_null(spark):
    got = values(spark, [7.0, -2.0, None, 3.5], c.clip, "double")
    assert got == [5.0, 0.0, None, 3.5]


def test_coerce(spark):
    assert values(spark, ["1.5", "x", None], c.coerce_double) == [1.5, None, None]
    assert values(spark, ["1999.0", "x"], c.coerce_int) == [1999, None]


def test_bigrams(spark):
    got = values(spark, ["one two three", "one"], lambda t: c.bigrams(c.tokens(t)))
    assert got == [["one two", "two three"], []]
