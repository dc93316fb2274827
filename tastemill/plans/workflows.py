"""The three batch workflows: load a package, train, recommend."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.operators import (
    catalog,
    cf,
    clean,
    content,
    features,
    hybrid,
    maintenance,
    matrix,
    mf,
)
from tastemill.sources import files, tables

DERIVED = ("movies", "interactions", "user_features", "movie_features", "interaction_matrix")


def load_data(spark: SparkSession, package: str, warehouse: str, as_of: str) -> None:
    """Package folder to cleaned and derived tables.

    A package may lack either part: what it has is cleaned and stored, and the
    tables that need both are derived only when both are there.
    """
    found = files.scan_package(spark, package)
    cleaned = {}
    if "metadata" in found:
        cleaned["movies"] = clean.clean_metadata(found["metadata"], ["position"]).drop("position")
    if "interactions" in found:
        cleaned["interactions"] = clean.clean_interactions(found["interactions"], as_of)
    if not cleaned:
        raise ValueError("a package needs metadata or interactions")
    tables.write_table(cleaned, warehouse)
    if len(cleaned) < 2:
        return
    # derived tables start from the written ones, not from the raw files again
    stored = tables.read_table(spark, warehouse, ["movies", "interactions"])
    movies, interactions = stored["movies"], stored["interactions"]
    tables.write_table(
        {
            "user_features": features.user_features(interactions),
            "movie_features": features.movie_features(movies, interactions),
            "interaction_matrix": matrix.rating_matrix(interactions),
        },
        warehouse,
    )


def train(spark: SparkSession, warehouse: str, trained_at: str, **als) -> None:
    """Content vectors and factors from the stored tables.

    Neighbourhood models keep no table: similarities of the asked users come from
    the ratings, where storing those of all pairs would be quadratic.
    """
    stored = tables.read_table(spark, warehouse, DERIVED)
    cells = stored["interaction_matrix"].where(F.col("rating") > 0)
    units = content.content_units(stored["movies"])
    tables.write_table({"content_units": units}, warehouse)
    tables.save_factors(mf.mf_fit(cells, **als), f"{warehouse}/factors", trained_at)


def sources(spark: SparkSession, warehouse: str) -> Mapping[str, object]:
    """Recommenders over the stored tables, by name."""
    stored = tables.read_table(spark, warehouse, [*DERIVED, "content_units"])
    cells = stored["interaction_matrix"].where(F.col("rating") > 0)
    items = matrix.universe("movie_id", stored["interaction_matrix"], stored["movies"])
    model = tables.load_factors(spark, f"{warehouse}/factors")
    history = stored["interactions"]
    if "interaction_id" not in history.columns:
        natural = [c for c in ("user_id", "movie_id", "timestamp") if c in history.columns]
        history = history.withColumn("interaction_id", maintenance.natural_key(*natural))
    if "timestamp" not in history.columns:
        history = history.withColumn("timestamp", F.lit(None).cast("timestamp"))
    ratings = content.latest_ratings(history)
    return {
        "user_based": lambda users, n: cf.user_cf_recommend(cells, items, n, targets=users),
        "item_based": lambda users, n: cf.item_cf_recommend(cells, items, n, targets=users),
        "matrix_factorization": lambda users, n: mf.mf_recommend(model, cells, n, targets=users),
        "content": lambda users, n: content.content_recommend(
            stored["content_units"], ratings, n, targets=users
        ),
    }


def recommend(
    spark: SparkSession,
    warehouse: str,
    users: DataFrame,
    algorithm: str = "hybrid",
    n: int = 10,
    generated_at: str | None = None,
) -> DataFrame:
    """Enriched recommendations for all given users in one job; logged when dated."""
    recs = hybrid.recommend(algorithm, sources(spark, warehouse), users, n)
    if generated_at is not None:
        maintenance.append_recommendations(
            recs, f"{warehouse}/recommendations", algorithm, generated_at
        )
    movies = tables.read_table(spark, warehouse, ["movies"])["movies"]
    return catalog.enrich_recommendations(recs, movies)
