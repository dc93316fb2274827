"""The driver's tables presented as catalogue, interaction and log views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.functions.skew import widen_scan

AS_OF_LOG = "2001-08-02 00:00:00"
AS_OF_EVENTS = "2024-01-31 00:00:00"


class Views:
    """Lazy views over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """A parquet table; its schema is read once."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    def ratings(self) -> DataFrame:
        """One row per order line: who rated what, when (rating 0.125 to 6.25)."""
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
        return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
            F.col("o_custkey").cast("string").alias("user_id"),
            F.col("l_partkey").cast("string").alias("movie_id"),
            (F.col("l_quantity").cast("double") / F.lit(8.0)).alias("rating"),
            F.col("o_orderdate").alias("timestamp"),
            F.lit("rating").alias("interaction_type"),
        )

    def events(self) -> DataFrame:
        kind = F.col("event_type")
        return self.table("events").select(
            F.col("event_id").cast("string").alias("interaction_id"),
            F.col("user_id").cast("string").alias("user_id"),
            F.regexp_extract("props", "([0-9]+)", 1).alias("movie_id"),
            F.when(kind == "purchase", "rating")
            .when(kind == "view", "watch")
            .when(kind == "click", "click")
            .when(kind == "signup", "save")
            .otherwise("share")
            .alias("interaction_type"),
            F.when(
                kind == "purchase", F.floor("value").cast("double") / F.lit(8.0).cast("double")
            ).alias("rating"),
            F.when(kind == "view", F.col("value")).alias("duration"),
            F.col("ts").alias("timestamp"),
            F.col("props").alias("metadata"),
        )

    def movies(self) -> DataFrame:
        docs = self.table("documents").select(
            F.col("doc_id").alias("doc_key"), F.col("text").alias("description")
        )
        part = self.table("part")
        return part.join(docs, part.p_partkey == docs.doc_key, "left").select(
            F.col("p_partkey").cast("string").alias("movie_id"),
            F.col("p_name").alias("title"),
            F.split("p_name", " ").alias("genres"),
            (F.lit(1950) + F.col("p_size")).cast("int").alias("release_year"),
            ((F.col("p_retailprice") - F.lit(900.0).cast("double")) / F.lit(10.0).cast("double"))
            .alias("imdb_rating"),
            (F.lit(60) + F.lit(2) * F.col("p_size")).cast("int").alias("duration_minutes"),
            F.col("p_type").alias("language"),
            F.col("p_brand").alias("country"),
            "description",
        )

    def users(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").cast("string").alias("user_id"),
            F.create_map(
                F.lit("segment"), F.col("c_mktsegment"),
                F.lit("nation"), F.col("c_nationkey").cast("string"),
            ).alias("preferences"),
        )

    def recs(self) -> DataFrame:
        status = F.col("o_orderstatus")
        movies = self.table("part").agg(F.count(F.lit(1))).scalar()
        return self.table("orders").select(
            F.col("o_orderkey").cast("string").alias("recommendation_id"),
            F.col("o_custkey").cast("string").alias("user_id"),
            F.pmod(F.col("o_orderkey"), movies).cast("string").alias("movie_id"),
            F.col("o_orderpriority").alias("algorithm"),
            (F.col("o_totalprice") / F.lit(100000.0).cast("double")).alias("score"),
            F.col("o_orderdate").alias("generated_at"),
            F.when(
                status.isin("F", "O"), F.col("o_orderdate") + F.expr("INTERVAL '1' DAY")
            ).alias("served_at"),
            (status == "F").alias("clicked"),
        )

    def docs(self) -> DataFrame:
        docs = widen_scan(self.table("documents"), "doc_id")
        labels = self.table("labels").select("doc_id", "quality")
        return docs.join(labels, "doc_id", "left").select(
            F.col("doc_id").cast("string").alias("movie_id"),
            F.col("text").alias("description"),
            F.array("lang", "source").alias("genres"),
            F.col("lang").alias("language"),
            F.col("source").alias("country"),
            F.col("n_chars").cast("double").alias("duration_minutes"),
            F.col("quality").cast("double").alias("imdb_rating"),
        )

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").cast("string").alias("movie_id"),
            F.col("embedding").cast("array<double>").alias("vector"),
            F.col("label").cast("string").alias("genre"),
        )

    def requests(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").cast("string").alias("request_id"),
            F.col("user_id").cast("string").alias("client"),
            F.col("ts").alias("timestamp"),
        )
