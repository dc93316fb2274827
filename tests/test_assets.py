import hashlib

import pytest

from tastemill.operators import quality
from tastemill.sources import assets, files


def tree(spark, folder, rows):
    assets.write_assets(spark.createDataFrame(rows, "content binary, relative_path string, x int"), folder)


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_written_scanned_and_digested(spark, tmp_path, rows, scheme):
    folder = f"{scheme}{tmp_path}/tree"
    long = bytes(range(256)) * 10_000  # several chunks
    tree(spark, folder, [(b"abc", "a/b/tt1234567.jpg", 1), (None, "a/empty", 2), (long, "z.MP4", 3)])
    found = files.scan_assets(spark, folder)
    assert rows(found, "relative_path", "directory", "size_bytes", "extension", "movie_id") == [
        ("a/b/tt1234567.jpg", "a/b", 3, ".jpg", "tt1234567"),
        ("a/empty", "a", 0, "", None),
        ("z.MP4", "", len(long), ".mp4", None),
    ]
    prints = {r.path.rsplit("/", 1)[1]: r for r in assets.digest_files(found).collect()}
    assert prints["z.MP4"].checksum == hashlib.md5(long).hexdigest()
    assert (prints["z.MP4"].size_bytes, prints["z.MP4"].valid) == (len(long), True)
    assert (prints["empty"].error, prints["empty"].valid) == ("File is empty", False)
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    # Spark's own source leaves empty files out
    assert rows(quality.file_fingerprint(whole), "size_bytes", "checksum", "error", "valid") == rows(
        assets.digest_files(found).where("valid"), "size_bytes", "checksum", "error", "valid"
    )


def test_written_twice_gives_the_same_files(spark, tmp_path, rows):
    folder = str(tmp_path / "tree")
    for _ in range(2):
        tree(spark, folder, [(b"abc", "a/x", 1), (b"de", "b/x", 1)])
    assert rows(files.scan_assets(spark, folder), "relative_path", "size_bytes") == [
        ("a/x", 3), ("b/x", 2)
    ]
    assert [p.name for p in tmp_path.rglob("*") if p.is_file() and not p.name.endswith(".crc")] == [
        "x", "x"
    ]


def test_absent_files_and_paths(spark, tmp_path):
    listing = spark.createDataFrame([(f"{tmp_path}/none",), (None,)], "full_path string")
    assert {(r.error, r.checksum, r.valid) for r in assets.digest_files(listing).collect()} == {
        ("File not found", None, False)
    }
    assert assets.digest_files(listing.limit(0)).count() == 0
    with pytest.raises(Exception, match="needs a path"):
        tree(spark, str(tmp_path / "t"), [(b"x", None, 1)])


def test_listing_leaves_out_hidden_names_and_refuses_missing_folders(spark, tmp_path):
    (tmp_path / "deep/er/est").mkdir(parents=True)
    (tmp_path / "_meta").mkdir()
    for name in ("a", ".b", "_meta/c", "deep/er/est/d", "deep/_e"):
        (tmp_path / name).write_text("x")
    found = assets.list_files(spark, str(tmp_path)).collect()
    assert {r.full_path.removeprefix(f"{tmp_path}/") for r in found} == {"a", "deep/er/est/d"}
    (tmp_path / "none").mkdir()
    assert assets.list_files(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(FileNotFoundError):
        assets.list_files(spark, str(tmp_path / "missing"))


def test_package_fingerprints(spark, tmp_path):
    (tmp_path / "data.csv").write_text("")
    prints = {r.path.rsplit("/", 1)[1]: r.error for r in files.package_fingerprints(
        spark, str(tmp_path)).collect()}
    assert prints == {"data.csv": "File is empty", "metadata.json": "File not found"}
