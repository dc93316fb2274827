"""Readers for package folders: interactions CSV, metadata JSON, asset listings."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastemill.functions.columns import coerce_double, file_extension, movie_id_from_filename
from tastemill.operators.quality import missing_headers
from tastemill.sources.assets import digest_files, list_files, opened

METADATA_FILE, INTERACTIONS_FILE, ASSETS_FOLDER = "metadata.json", "data.csv", "assets"

MOVIE_SCHEMA = T.StructType(
    [
        T.StructField("movie_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("genres", T.StringType()),
        T.StructField("release_year", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("directors", T.ArrayType(T.StringType())),
        T.StructField("actors", T.ArrayType(T.StringType())),
        T.StructField("imdb_rating", T.StringType()),
        T.StructField("duration_minutes", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("poster_url", T.StringType()),
        T.StructField("trailer_url", T.StringType()),
    ]
)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark can read a path at all (any file system)."""
    try:
        spark.read.format("text").load(path)
        return True
    except AnalysisException:
        return False


# quotes inside quoted fields are doubled; headers must agree with the schema
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "enforceSchema": "false"}


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    return spark.read.options(**CSV_OPTIONS).csv(path).columns


def scan_interactions_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Interactions with a header row; all columns are read as text, then typed.

    Values that do not parse become NULL. Raises when a required column is
    missing, and when reading a file whose header differs from the first one's.
    ``multiline`` admits line breaks inside quoted fields; a file is then one task.
    """
    names = csv_columns(spark, path)
    absent = missing_headers(names)
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.schema(schema).options(**CSV_OPTIONS, multiLine=multiline).csv(path)
    typed = {"rating": coerce_double("rating")}
    if "duration" in names:
        typed["duration"] = coerce_double("duration")
    if "timestamp" in names:
        typed["timestamp"] = F.try_to_timestamp(F.col("timestamp"))
    return rows.withColumns(typed)


def scan_metadata_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per movie with its 0-based ``position``.

    A document with a ``movies`` array, or one movie object per line
    (``lines=True``), which Spark can split over tasks. ``genres`` keeps its JSON
    text, as a list or plain text are both seen in practice; see ``parse_genres``.
    """
    if lines:
        movies = spark.read.schema(MOVIE_SCHEMA).json(path)
        return movies.withColumn("position", F.monotonically_increasing_id())
    document = T.StructType([T.StructField("movies", T.ArrayType(MOVIE_SCHEMA))])
    docs = spark.read.schema(document).option("multiLine", True).json(path)
    movies = docs.select(F.posexplode("movies").alias("position", "m")).select("position", "m.*")
    if movies.isEmpty():
        raise ValueError("the metadata holds no movies")
    return movies


def metadata_records(spark: SparkSession, path: str) -> DataFrame:
    """``(position, doc)``: each movie as JSON text, for validation."""
    whole = spark.read.option("wholetext", True).text(path)
    movies = F.from_json(F.get_json_object("value", "$.movies"), "array<string>")
    return whole.select(F.posexplode(movies).alias("position", "doc"))


def scan_assets(spark: SparkSession, folder: str) -> DataFrame:
    """Recursive file listing, empty files included; contents are never read."""
    listing = list_files(spark, folder)
    path = F.regexp_replace("full_path", "^/*", "/")
    root = "/" + opened(folder)[1].strip("/") + "/"
    relative = F.when(
        F.startswith(path, F.lit(root)), F.substr(path, F.lit(len(root) + 1))
    ).otherwise(path)
    name = F.element_at(F.split("full_path", "/"), -1)
    listed = listing.select(
        "full_path",
        relative.alias("relative_path"),
        name.alias("filename"),
        "size_bytes",
        "modificationTime",
    )
    parent = F.regexp_extract("relative_path", "^(.*)/[^/]*$", 1)
    return listed.withColumns(
        {
            "extension": file_extension("filename"),
            "directory": parent,
            "movie_id": movie_id_from_filename("filename"),
        }
    )


def package_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Size, MD5 and problem of the two required files, also when empty or missing."""
    wanted = [(f"{folder}/{name}",) for name in (METADATA_FILE, INTERACTIONS_FILE)]
    return digest_files(spark.createDataFrame(wanted, "full_path string"))


def scan_package(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Whichever of metadata, interactions and assets a folder has."""
    found: dict[str, DataFrame] = {}
    if _exists(spark, f"{folder}/{METADATA_FILE}"):
        found["metadata"] = scan_metadata_json(spark, f"{folder}/{METADATA_FILE}")
    if _exists(spark, f"{folder}/{INTERACTIONS_FILE}"):
        found["interactions"] = scan_interactions_csv(spark, f"{folder}/{INTERACTIONS_FILE}")
    if _exists(spark, f"{folder}/{ASSETS_FOLDER}"):
        found["assets"] = scan_assets(spark, f"{folder}/{ASSETS_FOLDER}")
    return found


def package_files(spark: SparkSession, folder: str) -> DataFrame:
    """The two required files with content, for fingerprints."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"{{{METADATA_FILE},{INTERACTIONS_FILE}}}")
        .load(folder)
    )
