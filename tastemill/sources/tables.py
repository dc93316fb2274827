"""Saved tables: files, JDBC options, recommendation JSON, trained factors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.operators.mf import Factors

FORMATS = ("parquet", "csv", "orc", "json")
PARTITION_DIGITS = 256


def _checked(fmt: str) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format: {fmt}")
    return fmt


def write_table(
    tables: Mapping[str, DataFrame],
    folder: str,
    fmt: str = "parquet",
    partition_by: Mapping[str, Sequence[str]] | None = None,
) -> None:
    """Replace each named table under ``folder``."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite").format(_checked(fmt))
        if fmt == "csv":
            writer = writer.option("header", True)
        if partition_by and name in partition_by:
            writer = writer.partitionBy(*partition_by[name])
        writer.save(f"{folder}/{name}")


def read_table(
    spark: SparkSession, folder: str, names: Sequence[str], fmt: str = "parquet"
) -> dict[str, DataFrame]:
    """Named tables that exist; absent ones are skipped."""
    found: dict[str, DataFrame] = {}
    for name in names:
        reader = spark.read.format(_checked(fmt))
        if fmt == "csv":
            reader = reader.option("header", True)
        try:
            found[name] = reader.load(f"{folder}/{name}")
        except AnalysisException:
            continue
    return found


def sql_name(name: str) -> str:
    """Table name in an SQL store."""
    return name.replace(" ", "_").lower()


def jdbc_options(
    url: str,
    table: str,
    split_column: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    partitions: int | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Options of a JDBC read, split into ranges when bounds are given."""
    options = {"url": url, "dbtable": sql_name(table), "fetchsize": str(fetch_size)}
    split = (split_column, lower, upper, partitions)
    if any(x is not None for x in split):
        if any(x is None for x in split):
            raise ValueError("a split read needs column, lower, upper and partitions")
        options |= {
            "partitionColumn": split_column,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(partitions),
        }
    return options


def jdbc_source(spark: SparkSession, url: str, table: str, **split) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **split)).load()


def jdbc_sink(df: DataFrame, url: str, table: str, batch_size: int = 10_000) -> None:
    """Replace a table in an SQL store."""
    options = {"url": url, "dbtable": sql_name(table), "batchsize": str(batch_size)}
    df.write.format("jdbc").options(**options).mode("overwrite").save()


def user_bucket(user: str = "user_id", buckets: int = PARTITION_DIGITS) -> Column:
    """Directory a user's documents live in; a fixed number, whatever the users."""
    return F.pmod(F.xxhash64(F.col(user)), F.lit(buckets)).cast("int")


def write_recommendations_json(recs: DataFrame, folder: str, generated_at: str) -> None:
    """One JSON document per user with the ranked list.

    Lists are top-n rows, so bounded per user. Documents are kept in a fixed
    number of directories by user hash, not in one directory per user.
    """
    entries = F.sort_array(F.collect_list(F.struct("rank", "movie_id", "score")))
    docs = recs.groupBy("user_id").agg(entries.alias("recommendations")).select(
        "user_id", "recommendations", F.lit(generated_at).alias("generated_at"),
        user_bucket().alias("bucket"),
    )
    docs.repartition("bucket").write.mode("overwrite").partitionBy("bucket").json(folder)


RECOMMENDATION_SCHEMA = (
    "user_id string, recommendations array<struct<rank:int,movie_id:string,score:double>>,"
    " generated_at string, bucket int"
)


def load_recommendations(
    spark: SparkSession, folder: str, user_id: str | None = None
) -> DataFrame:
    """Saved documents; for one user only that user's directory is read."""
    docs = spark.read.schema(RECOMMENDATION_SCHEMA).json(folder)
    if user_id is not None:
        row = spark.range(1).select(F.lit(user_id).alias("user_id")).select(user_bucket())
        docs = docs.where((F.col("bucket") == row.first()[0]) & (F.col("user_id") == user_id))
    return docs.drop("bucket")


def save_factors(
    model: Factors, folder: str, trained_at: str, metadata: Mapping[str, str] | None = None
) -> None:
    """Factor tables as parquet plus a one-row JSON description."""
    model.users.write.mode("overwrite").parquet(f"{folder}/users")
    model.items.write.mode("overwrite").parquet(f"{folder}/items")
    model.mean.write.mode("overwrite").parquet(f"{folder}/mean")
    spark = model.users.sparkSession
    users, items = (spark.read.parquet(f"{folder}/{t}") for t in ("users", "items"))
    about = users.agg(
        F.count(F.lit(1)).alias("users"), F.max(F.size("features")).alias("factors")
    ).select(
        F.lit("matrix_factorization").alias("model_type"),
        F.lit("als_with_biases").alias("algorithm"),
        F.lit(trained_at).alias("trained_at"),
        "users",
        items.agg(F.count(F.lit(1))).scalar().alias("items"),
        "factors",
        *[F.lit(value).alias(key) for key, value in (metadata or {}).items()],
    )
    about.coalesce(1).write.mode("overwrite").json(f"{folder}/about")


def load_factors(spark: SparkSession, folder: str) -> Factors:
    return Factors(
        *(spark.read.parquet(f"{folder}/{t}") for t in ("users", "items", "mean"))
    )
