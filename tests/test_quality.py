import json

import pytest

from tastemill.operators import quality
from tastemill.sources import files


def package(tmp_path, movies=None, csv=None, assets=()):
    if movies is not None:
        (tmp_path / "metadata.json").write_text(json.dumps(movies))
    if csv is not None:
        (tmp_path / "data.csv").write_text(csv)
    for name in assets:
        target = tmp_path / "assets" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(b"x" * len(name))
    return str(tmp_path)


MOVIES = {"movies": [
    {"movie_id": "tt1", "title": "A", "genres": ["Drama", "War"], "imdb_rating": 8.1},
    {"movie_id": "tt2", "title": "B", "genres": "Drama", "release_year": 1999},
    {"title": "C"},
]}


def test_package(spark, tmp_path, rows):
    folder = package(
        tmp_path, MOVIES, "user_id,movie_id,rating\nu1,tt1,4.5\nu2,tt1,x\n",
        ["a/tt1234567.JPG", "a/b.mp4", "readme"],
    )
    found = files.scan_package(spark, folder)
    assert set(found) == {"metadata", "interactions", "assets"}
    assert rows(found["metadata"], "position", "movie_id") == [(0, "tt1"), (1, "tt2"), (2, None)]
    assert rows(found["interactions"]) == [("u1", "tt1", 4.5), ("u2", "tt1", None)]
    assert rows(found["assets"], "relative_path", "extension", "directory", "movie_id") == [
        ("a/b.mp4", ".mp4", "a", None),
        ("a/tt1234567.JPG", ".jpg", "a", "tt1234567"),
        ("readme", "", "", None),
    ]
    profile = {r.directory: r for r in quality.asset_profile(found["assets"]).collect()}
    assert (profile["a"].images, profile["a"].videos, profile[""].other) == (1, 1, 1)
    assert profile["a"].files == ["b.mp4", "tt1234567.JPG"]
    prints = {r.path.rsplit("/", 1)[1]: r for r in quality.file_fingerprint(
        files.package_files(spark, folder)).collect()}
    assert set(prints) == {"metadata.json", "data.csv"} and prints["data.csv"].valid
    assert len(prints["data.csv"].checksum) == 32
    broken = quality.validate_metadata(
        files.metadata_records(spark, f"{folder}/metadata.json")
    )
    assert rows(broken) == [
        (1, "genres_not_a_list"), (2, "missing_genres"), (2, "missing_movie_id"),
    ]


def test_partial_and_broken_packages(spark, tmp_path):
    folder = package(tmp_path, None, "user_id,rating\nu1,3\n")
    with pytest.raises(ValueError, match="movie_id"):
        files.scan_package(spark, folder)
    (tmp_path / "other").mkdir()
    assert files.scan_package(spark, str(tmp_path / "other")) == {}
    empty = package(tmp_path / "other", {"movies": []})
    with pytest.raises(ValueError):
        files.scan_metadata_json(spark, f"{empty}/metadata.json")


def test_document_problem(spark):
    docs = ["{", "{}", '{"movies": 3}', '{"movies": []}', '{"movies": [{}]}']
    df = spark.createDataFrame(list(enumerate(docs)), "i int, d string")
    got = [r[0] for r in df.orderBy("i").select(quality.document_problem(df.d)).collect()]
    assert got == ["invalid_json", "movies_missing", "movies_not_a_list", "movies_empty", None]


def test_interaction_violations_summary_and_report(spark, rows):
    data = [(i, "u", "m", r) for i, r in enumerate(["abc", "-1", "5.1", "", None, "5", "0"], 1)]
    data += [(10 + i, "", None, "1") for i in range(7)]
    df = spark.createDataFrame(data, "row_no int, user_id string, movie_id string, rating string")
    found = quality.validate_interactions(df)
    assert rows(found.where("row_no < 10")) == [
        (1, "rating_not_a_number", "abc"),
        (2, "rating_out_of_range", "-1"),
        (3, "rating_out_of_range", "5.1"),
    ]
    one = found.selectExpr("'data.csv' AS source", "*")
    summary = quality.violation_summary(one, ["row_no", "rule"]).collect()
    assert len(summary) == 5 and {r.more for r in summary} == {17 - 5}
    report = quality.validation_report(one, ["row_no", "rule"], "2020").collect()[0]
    assert report.validation_result == "failure" and len(report.errors) == 5
    assert report.warnings == ["data.csv: ... and 12 more"]
    clean = quality.validation_report(one.limit(0), ["row_no"], "2020").collect()[0]
    assert clean.validation_result == "success" and clean.errors == []


def test_rules_and_bounds(spark):
    df = spark.createDataFrame(
        [("u", "m", "rating", None, None), ("u", "m", "like", 6.0, -1.0), ("u", "m", "watch", None, 3.0)],
        "user_id string, movie_id string, interaction_type string, rating double, duration double",
    )
    got = [r.violations for r in quality.interaction_rules(df).collect()]
    assert got == [
        ["rating_required"],
        ["type_unknown", "rating_out_of_range", "duration_negative"],
        [],
    ]
    good, bad = quality.split_valid(quality.interaction_rules(df))
    assert (good.count(), bad.count()) == (1, 2)
    for wrong in ({"year_min": 1800}, {"rating_min": 6}, {"limit": 101}, {"offset": -1}):
        with pytest.raises(ValueError):
            quality.check_search_bounds(**wrong)
