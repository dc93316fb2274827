"""Cleaning of catalogue metadata and interactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastemill.functions.columns import (
    as_column,
    clean_text,
    clip,
    coerce_double,
    parse_genres,
)
from tastemill.functions.ranking import exact_quantiles, one_row, unpivot_columns, with_row

TEXT_COLUMNS = ("description", "plot", "overview")
NUMERIC_COLUMNS = ("release_year", "duration_minutes", "imdb_rating")
UNKNOWN = "Unknown"


def genres_as_array(df: DataFrame, column: str = "genres") -> Column:
    """Genres as a trimmed array, whether stored as an array or as text."""
    if isinstance(df.schema[column].dataType, T.ArrayType):
        return F.coalesce(
            F.transform(column, lambda g: F.trim(g.cast("string"))),
            F.array().cast("array<string>"),
        )
    return parse_genres(column)


def join_list(c: Column | str, separator: str = ", ") -> Column:
    """A list as text; NULL elements are left out."""
    return F.array_join(as_column(c), separator)


def first_per_key(df: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """Keep the first row per key under an explicit order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def most_frequent(df: DataFrame, columns: Sequence[str], only: Column | None = None) -> DataFrame:
    """``(name, value)``: the most frequent value per column, smallest on ties.

    All columns are counted in one pass with map-side combine. ``only`` may name
    the columns to look at as an array, decided by the data.
    """
    cells = unpivot_columns(df, columns, "string").where(F.col("v").isNotNull())
    if only is not None:
        cells = cells.where(F.array_contains(only, F.col("name")))
    counts = cells.groupBy("name", F.col("v").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("name").orderBy(F.col("n").desc(), "value")
    return counts.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("name", "value")


def fill_missing(
    df: DataFrame,
    numeric: Sequence[str] | None = None,
    text: Sequence[str] | None = None,
) -> DataFrame:
    """NULL numbers become the column median, NULL texts the most frequent value.

    Texts are only counted for columns that have a NULL at all, so long text
    columns without gaps are never shuffled.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    if numeric is None:
        numeric = [n for n, t in fields.items() if isinstance(t, T.NumericType)]
    if text is None:
        text = [n for n, t in fields.items() if isinstance(t, T.StringType)]
    filled: dict[str, Column] = {}
    out = df
    if numeric:
        medians = exact_quantiles(df, numeric, [0.5])
        out = with_row(out, one_row(medians, F.col("name"), numeric, "value"), "_median")
        filled |= {n: F.coalesce(F.col(n).cast("double"), F.col("_median")[n]) for n in numeric}
    if text:
        gaps = df.agg(
            F.array_compact(
                F.array(*[F.when(F.max(F.col(n).isNull()), F.lit(n)) for n in text])
            ).alias("gaps")
        ).scalar()
        modes = most_frequent(df, text, only=gaps)
        out = with_row(out, one_row(modes, F.col("name"), text, "value"), "_mode")
        filled |= {n: F.coalesce(F.col(n), F.col("_mode")[n], F.lit(UNKNOWN)) for n in text}
    return out.withColumns(filled).drop("_median", "_mode")


def clean_metadata(
    df: DataFrame, order: Sequence[str | Column] | None = None, fill: bool = True
) -> DataFrame:
    """Typed, deduplicated catalogue with derived text columns.

    ``order`` says which row of a repeated ``movie_id`` came first.
    """
    have = set(df.columns)
    out: dict[str, Column] = {}
    if "movie_id" in have:
        df = df.withColumn("movie_id", F.col("movie_id").cast("string"))
        if order is not None:
            df = first_per_key(df, "movie_id", order)
        else:
            # no order known: any of the repeated rows may stay
            df = df.dropDuplicates(["movie_id"])
    if "title" in have:
        out["title"] = F.trim(F.col("title").cast("string"))
        out["title_clean"] = F.lower(out["title"])
    if "genres" in have:
        out["genres"] = genres_as_array(df)
    for name in TEXT_COLUMNS:
        if name in have:
            out[f"{name}_clean"] = F.coalesce(clean_text(name), F.lit(""))
    for name in NUMERIC_COLUMNS:
        if name in have:
            out[name] = coerce_double(name)
    df = df.withColumns(out)
    if fill:
        # titles can be missing, other derived texts cannot
        gapless = {"movie_id", *out} - {*NUMERIC_COLUMNS, "title", "title_clean"}
        kinds = {f.name: f.dataType for f in df.schema.fields}
        df = fill_missing(
            df,
            text=[n for n, t in kinds.items() if isinstance(t, T.StringType) and n not in gapless],
        )
    if "genres" in have:
        df = df.withColumns(
            {"genre_count": F.size("genres"), "all_genres": F.array_join("genres", " ")}
        )
    return df


def clean_interactions(df: DataFrame, as_of: str) -> DataFrame:
    """Typed ids, clipped ratings, parsed timestamps, no exact copies, no NULL ids."""
    have = {f.name: f.dataType for f in df.schema.fields}
    out: dict[str, Column] = {}
    for name in ("user_id", "movie_id"):
        if name in have:
            out[name] = F.col(name).cast("string")
    if "rating" in have:
        out["rating"] = clip(coerce_double("rating"))
    if "timestamp" in have:
        kind = have["timestamp"]
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            parsed, target = F.col("timestamp"), kind
        else:
            parsed, target = F.try_to_timestamp(F.col("timestamp")), T.TimestampType()
        out["timestamp"] = F.coalesce(parsed, F.lit(as_of).cast(target))
    ids = [name for name in ("user_id", "movie_id") if name in have]
    cleaned = df.withColumns(out).dropna(subset=ids)
    # map columns cannot be compared; rows are compared on everything else
    keys = [
        f.name for f in cleaned.schema.fields if not isinstance(f.dataType, T.MapType)
    ]
    return cleaned.dropDuplicates(keys)
