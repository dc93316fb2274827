"""Queries over package folders and asset trees written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tastemill.operators import quality
from tastemill.plans.registry import query
from tastemill.plans.shared import r6
from tastemill.session import scratch_folder
from tastemill.sources import assets, files
from tastemill.sources.views import Views

MOVIES_PER_DOCUMENT = 1000

# every page becomes one asset file below its host's folder
ASSET_SQL = r"""
    f AS (SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS directory,
                 CASE page_id % 4
                     WHEN 0 THEN 'tt' || lpad(CAST(page_id AS VARCHAR),
                                              CAST(greatest(7, length(CAST(page_id AS VARCHAR))) AS INT), '0')
                                 || '.jpg'
                     WHEN 1 THEN page_id || '.PNG'
                     WHEN 2 THEN 'clip_' || page_id || '.v2.mp4'
                     ELSE 'page_' || page_id END AS filename,
                 strlen(coalesce(html, '')) AS size_bytes, md5(coalesce(html, '')) AS checksum
          FROM pages)"""


def asset_rows(v: Views):
    """``(relative_path, content)``, one file per page; page ids are unique."""
    number = F.col("page_id").cast("string")
    name = (
        F.when(
            F.col("page_id") % 4 == 0,
            F.concat(F.lit("tt"), F.lpad(number, F.greatest(F.lit(7), F.length(number)), F.lit("0")),
                     F.lit(".jpg")),
        )
        .when(F.col("page_id") % 4 == 1, F.concat(number, F.lit(".PNG")))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit("clip_"), number, F.lit(".v2.mp4")))
        .otherwise(F.concat(F.lit("page_"), number))
    )
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    return v.table("pages").select(
        F.concat_ws("/", host, name).alias("relative_path"),
        F.col("html").cast("binary").alias("content"),
    )


def written(v: Views) -> str:
    """Folder of the asset tree of all pages."""
    path = scratch_folder(v.spark, "assets")
    assets.write_assets(asset_rows(v), path)
    return path


@query(
    "scan_assets",
    rf"""
    WITH {ASSET_SQL}
    SELECT directory || '/' || filename AS relative_path, directory, filename, size_bytes,
           CASE WHEN contains(filename, '.')
                THEN lower('.' || split_part(filename, '.', -1)) ELSE '' END AS extension,
           coalesce(nullif(regexp_extract(filename, '(tt\d{{7,8}})', 1), ''),
                    nullif(regexp_extract(split_part(filename, '.', 1), '(\d{{3,}})', 1), ''))
               AS movie_id
    FROM f""",
)
def scan_assets(v: Views):
    return files.scan_assets(v.spark, written(v)).select(
        "relative_path", "directory", "filename", "size_bytes", "extension", "movie_id"
    )


@query(
    "asset_profile",
    f"""
    WITH {ASSET_SQL},
    n AS (SELECT *, row_number() OVER (PARTITION BY directory ORDER BY filename) AS nth FROM f)
    SELECT directory, count(*) AS file_count,
           count(*) FILTER (WHERE lower(filename) LIKE '%.jpg' OR lower(filename) LIKE '%.png')
               AS images,
           count(*) FILTER (WHERE filename LIKE '%.mp4') AS videos,
           count(*) FILTER (WHERE filename NOT LIKE '%.%') AS other,
           string_agg(filename, ',' ORDER BY filename) FILTER (WHERE nth <= 10) AS files
    FROM n GROUP BY directory""",
)
def asset_profile(v: Views):
    return quality.asset_profile(files.scan_assets(v.spark, written(v))).withColumn("files", F.array_join("files", ","))


FINGERPRINT_SQL = f"""
    WITH {ASSET_SQL}
    SELECT filename, size_bytes, checksum, CASE WHEN size_bytes = 0 THEN 'File is empty' END
               AS error, size_bytes > 0 AS valid
    FROM f"""


def _by_name(prints):
    return prints.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), "size_bytes", "checksum",
        "error", "valid",
    )


@query("file_fingerprint", FINGERPRINT_SQL)
def file_fingerprint(v: Views):
    contents = v.spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return _by_name(quality.file_fingerprint(contents.load(written(v))))


@query("digest_files", FINGERPRINT_SQL)
def digest_files(v: Views):
    path = written(v)
    return _by_name(assets.digest_files(files.scan_assets(v.spark, path), root=path))


@query(
    "scan_package",
    f"""
    WITH {ASSET_SQL}
    SELECT 'metadata' AS part, movie_id, count(*) AS row_count,
           round(sum(imdb_rating), 6) AS total
    FROM v_movies GROUP BY movie_id
    UNION ALL
    SELECT 'interactions', movie_id, count(*), round(sum(rating), 6) FROM v_events
    GROUP BY movie_id
    UNION ALL
    SELECT 'assets', directory, count(*), sum(size_bytes)::DOUBLE FROM f GROUP BY directory""",
)
def scan_package(v: Views):
    """A package of documents of at most 1,000 movies, interactions and assets, read back."""
    folder = scratch_folder(v.spark, "package")
    movies = v.movies().drop("description").withColumn("genres", F.array_join("genres", ","))
    by_document = F.floor(F.col("movie_id").cast("bigint") / MOVIES_PER_DOCUMENT)
    movies.groupBy(by_document.alias("document")).agg(
        F.collect_list(F.struct(*movies.columns)).alias("movies")
    ).select("movies").write.option("maxRecordsPerFile", 1).json(
        f"{folder}/{files.METADATA_FILE}"
    )
    v.events().select("user_id", "movie_id", "rating", "interaction_type").write.option(
        "header", True
    ).csv(f"{folder}/{files.INTERACTIONS_FILE}")
    assets.write_assets(asset_rows(v), f"{folder}/{files.ASSETS_FOLDER}")
    found = files.scan_package(v.spark, folder)
    measured = {
        "metadata": ("movie_id", F.col("imdb_rating").try_cast("double")),
        "interactions": ("movie_id", F.col("rating")),
        "assets": ("directory", F.col("size_bytes").cast("double")),
    }
    parts = [
        found[name]
        .select(F.lit(name).alias("part"), F.col(key).alias("movie_id"), value.alias("value"))
        .groupBy("part", "movie_id")
        .agg(F.count(F.lit(1)).alias("row_count"), r6(F.sum("value"), "total"))
        for name, (key, value) in measured.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
