"""Data-quality rules: one violation row per record and broken rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions.columns import (
    IMAGE_EXTENSIONS,
    INTERACTION_TYPES,
    RATING_MAX,
    RATING_MIN,
    VIDEO_EXTENSIONS,
    file_extension,
)

REQUIRED_MOVIE_FIELDS = ("movie_id", "title", "genres")
REQUIRED_HEADERS = ("user_id", "movie_id", "rating")
SHOWN_VIOLATIONS = 5
TOP_GENRES = 10
SHOWN_FILES = 10


def _rules(*pairs: tuple[Column, str]) -> Column:
    """Codes of the broken rules; a NULL condition counts as not broken."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(code)) for bad, code in pairs]))


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) == "")


def interaction_rules(df: DataFrame) -> DataFrame:
    """Adds ``violations``: type, rating and duration rules of one interaction."""
    rating, kind = F.col("rating"), F.col("interaction_type")
    return df.withColumn(
        "violations",
        _rules(
            (_blank("user_id"), "user_id_missing"),
            (_blank("movie_id"), "movie_id_missing"),
            (kind.isNull() | ~kind.isin(*INTERACTION_TYPES), "type_unknown"),
            ((rating < RATING_MIN) | (rating > RATING_MAX), "rating_out_of_range"),
            ((kind == "rating") & rating.isNull(), "rating_required"),
            (F.col("duration") < 0, "duration_negative"),
        ),
    )


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without violations, rows to set aside)."""
    good = checked.where(F.size("violations") == 0).drop("violations")
    return good, checked.where(F.size("violations") > 0)


def movie_schema_rules(df: DataFrame) -> DataFrame:
    """Adds ``violations``: required fields and value ranges of one movie."""
    return df.withColumn(
        "violations",
        _rules(
            (_blank("movie_id"), "movie_id_missing"),
            (_blank("title"), "title_missing"),
            (F.col("genres").isNull() | (F.size("genres") == 0), "genres_missing"),
            (
                (F.col("imdb_rating") < 0) | (F.col("imdb_rating") > 10),
                "imdb_rating_out_of_range",
            ),
            (F.col("duration_minutes") < 0, "duration_negative"),
        ),
    )


def check_search_bounds(
    year_min: int | None = None,
    year_max: int | None = None,
    rating_min: float | None = None,
    limit: int = 20,
    offset: int = 0,
) -> None:
    """Argument ranges of a catalogue search."""
    for year in (year_min, year_max):
        if year is not None and not 1900 <= year <= 2100:
            raise ValueError("years lie between 1900 and 2100")
    if rating_min is not None and not RATING_MIN <= rating_min <= RATING_MAX:
        raise ValueError("rating_min lies between 0 and 5")
    if not 1 <= limit <= 100:
        raise ValueError("limit lies between 1 and 100")
    if offset < 0:
        raise ValueError("offset must not be negative")


def validate_metadata(records: DataFrame, document: str = "doc", position: str = "position"):
    """Violations ``(position, rule)`` of catalogue records given as JSON objects.

    A field is missing when the object does not have it. ``genres`` must be a
    list when present.
    """
    doc = F.col(document)
    keys = F.json_object_keys(doc)
    genres = F.ltrim(F.get_json_object(doc, "$.genres"))
    present = F.array_contains(keys, "genres")
    missing = [
        (~F.coalesce(F.array_contains(keys, f), F.lit(False)), f"missing_{f}")
        for f in REQUIRED_MOVIE_FIELDS
    ]
    not_list = (present & (genres.isNull() | ~genres.startswith("[")), "genres_not_a_list")
    return records.select(
        F.col(position), F.explode(_rules(*missing, not_list)).alias("rule")
    )


def document_problem(document: Column) -> Column:
    """Why a whole metadata document cannot be used, or NULL."""
    movies = F.get_json_object(document, "$.movies")
    return (
        F.when(F.json_object_keys(document).isNull(), "invalid_json")
        .when(~F.array_contains(F.json_object_keys(document), "movies"), "movies_missing")
        .when(movies.isNull() | ~F.ltrim(movies).startswith("["), "movies_not_a_list")
        .when(F.json_array_length(movies) == 0, "movies_empty")
    )


def missing_headers(columns: Sequence[str]) -> list[str]:
    return [h for h in REQUIRED_HEADERS if h not in columns]


def validate_interactions(rows: DataFrame, row_no: str = "row_no") -> DataFrame:
    """Violations ``(row_no, rule, value)`` of interaction rows read as text."""
    text = F.col("rating").cast("string")
    given = text.isNotNull() & (text != "")
    number = text.try_cast("double")
    rule = F.array_compact(
        F.array(
            *[
                F.when(bad, F.struct(F.lit(code).alias("rule"), value.alias("value")))
                for bad, code, value in (
                    (_blank("user_id"), "user_id_missing", F.lit("")),
                    (_blank("movie_id"), "movie_id_missing", F.lit("")),
                    (given & number.isNull(), "rating_not_a_number", text),
                    (
                        given & ((number < RATING_MIN) | (number > RATING_MAX)),
                        "rating_out_of_range",
                        text,
                    ),
                )
            ]
        )
    )
    return rows.select(F.col(row_no), F.explode(rule).alias("v")).select(
        row_no, "v.rule", "v.value"
    )


def violation_summary(
    violations: DataFrame, order: Sequence[str], by: str = "source", shown: int = SHOWN_VIOLATIONS
) -> DataFrame:
    """First violations per source plus how many more there are."""
    w = Window.partitionBy(by).orderBy(*order)
    first = violations.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= shown)
    totals = violations.groupBy(by).agg(F.count(F.lit(1)).alias("total"))
    return first.join(totals, by).select(
        by,
        "nth",
        *[c for c in violations.columns if c != by],
        "total",
        F.greatest(F.col("total") - shown, F.lit(0)).alias("more"),
        F.lit("failure").alias("result"),
    )


def interaction_profile(df: DataFrame) -> DataFrame:
    """Row, user and movie counts and the rating range, one row."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.countDistinct("user_id").alias("user_count"),
        F.countDistinct("movie_id").alias("movie_count"),
        F.min("rating").alias("rating_min"),
        F.max("rating").alias("rating_max"),
        F.avg("rating").alias("rating_avg"),
    )


def genre_profile(movies: DataFrame, top: int = TOP_GENRES) -> DataFrame:
    """Most used genres with the number of distinct ones."""
    counts = (
        movies.select(F.explode("genres").alias("genre"))
        .groupBy("genre")
        .agg(F.count(F.lit(1)).alias("movie_count"))
    )
    unique = counts.agg(F.count(F.lit(1))).scalar()
    return (
        counts.withColumn("total_unique", unique)
        .orderBy(F.col("movie_count").desc(), "genre")
        .limit(top)
    )


def asset_profile(assets: DataFrame, shown: int = SHOWN_FILES) -> DataFrame:
    """Per directory: file count, images / videos / other and the first names.

    Names are ranked in a window, so a directory of any size never becomes one
    collected list.
    """
    ext = file_extension("filename")
    kinds = assets.withColumn(
        "kind",
        F.when(ext.isin(*IMAGE_EXTENSIONS), "image")
        .when(ext.isin(*VIDEO_EXTENSIONS), "video")
        .otherwise("other"),
    )
    counts = kinds.groupBy("directory").agg(
        F.count(F.lit(1)).alias("file_count"),
        F.count_if(F.col("kind") == "image").alias("images"),
        F.count_if(F.col("kind") == "video").alias("videos"),
        F.count_if(F.col("kind") == "other").alias("other"),
    )
    w = Window.partitionBy("directory").orderBy("filename")
    names = (
        kinds.withColumn("nth", F.row_number().over(w))
        .where(F.col("nth") <= shown)
        .groupBy("directory")
        .agg(F.sort_array(F.collect_list("filename")).alias("files"))
    )
    return counts.join(names, "directory")


def file_fingerprint(files: DataFrame) -> DataFrame:
    """Size, MD5 and usability of files read with the ``binaryFile`` source."""
    size = F.length("content").cast("bigint")
    return files.select(
        "path",
        size.alias("size_bytes"),
        F.md5("content").alias("checksum"),
        F.when(size == 0, "File is empty").alias("error"),
        (size > 0).alias("valid"),
    )


def row_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """MD5 over the text of the chosen columns, NULL as an empty text."""
    names = list(columns or df.columns)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]
    return df.withColumn("checksum", F.md5(F.concat_ws("|", *parts)))


def validation_report(
    violations: DataFrame, order: Sequence[str], as_of: str, by: str = "source"
) -> DataFrame:
    """One row: result, shown errors and warnings, ready to be written as JSON."""
    summary = violation_summary(violations, order, by)
    detail = F.struct(*[c for c in summary.columns if c not in ("total", "more", "result")])
    per_source = summary.groupBy(by).agg(
        F.sort_array(F.collect_list(F.struct("nth", detail.alias("item")))).alias("items"),
        F.max("more").alias("more"),
    )
    return per_source.agg(
        F.when(F.count(F.lit(1)) > 0, "failure").otherwise("success").alias("validation_result"),
        F.lit(as_of).alias("timestamp"),
        F.flatten(
            F.sort_array(F.collect_list(F.transform("items", lambda x: F.to_json(x["item"]))))
        ).alias("errors"),
        F.sort_array(
            F.collect_list(
                F.when(
                    F.col("more") > 0,
                    F.concat(F.col(by), F.lit(": ... and "), F.col("more"), F.lit(" more")),
                )
            )
        ).alias("warnings"),
    )


def write_report(report: DataFrame, folder: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(folder)
