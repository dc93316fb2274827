"""Table maintenance: upserts, merges, erasure, appends, feedback.

Every function returns the new table; writing it is the caller's choice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_in_batch(batch: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """Last row per key of a batch under its own order."""
    w = Window.partitionBy(key).orderBy(*[F.desc(o) if isinstance(o, str) else o for o in order])
    return batch.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def upsert(base: DataFrame, batch: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Batch rows replace base rows with the same key; the last batch row counts."""
    fresh = latest_in_batch(batch, key, order).select(*base.columns)
    return base.join(fresh.select(key), key, "left_anti").select(*base.columns).unionByName(fresh)


def upsert_movies(base: DataFrame, batch: DataFrame, order: Sequence[str]) -> DataFrame:
    return upsert(base, batch, "movie_id", order)


def upsert_users(base: DataFrame, batch: DataFrame, order: Sequence[str]) -> DataFrame:
    return upsert(base, batch, "user_id", order)


def merge_preferences(users: DataFrame, changes: DataFrame) -> DataFrame:
    """New keys win, other keys stay, unknown users are created.

    One row per user on both sides. Old entries with a new key are dropped
    before the maps are joined, as joining maps with equal keys fails.
    """
    empty = F.create_map().cast("map<string,string>")
    new = changes.select("user_id", F.col("preferences").alias("new"))
    kept = F.map_filter(
        F.coalesce("preferences", empty),
        lambda k, _: ~F.array_contains(F.map_keys(F.coalesce("new", empty)), k),
    )
    return users.join(new, "user_id", "full").withColumn(
        "preferences", F.map_concat(kept, F.coalesce("new", empty))
    ).drop("new")


def delete_users_cascade(
    users: DataFrame, interactions: DataFrame, recommendations: DataFrame, ids: DataFrame
) -> dict[str, DataFrame]:
    """The three tables without any row of the given users."""
    gone = ids.select("user_id").distinct()
    return {
        "users": users.join(gone, "user_id", "left_anti"),
        "interactions": interactions.join(gone, "user_id", "left_anti"),
        "recommendations": recommendations.join(gone, "user_id", "left_anti"),
    }


def natural_key(*columns: str) -> Column:
    """Hash of the columns as text; which of them are NULL is part of it."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in columns]
    return F.xxhash64(*parts).cast("string")


def prepare_interactions(rows: DataFrame, as_of: str) -> DataFrame:
    """Defaults and a content-hash id: the same row always gets the same id."""
    have = {f.name: f.dataType for f in rows.schema.fields}
    empty = F.create_map().cast("map<string,string>")
    if "timestamp" in have:
        when = F.coalesce("timestamp", F.lit(as_of).cast(have["timestamp"]))
    else:
        when = F.lit(as_of).cast("timestamp")
    if "metadata" not in have:
        extra = empty
    elif have["metadata"].typeName() == "string":
        extra = F.coalesce(F.from_json("metadata", "map<string,string>"), empty)
    else:
        extra = F.coalesce("metadata", empty)
    out = rows.withColumns({"timestamp": when, "metadata": extra})
    natural = ["user_id", "movie_id", "interaction_type", "timestamp"]
    return out.withColumn("interaction_id", natural_key(*natural))


def append_interactions(rows: DataFrame, folder: str, as_of: str) -> None:
    """Append prepared rows, one directory per day."""
    ready = prepare_interactions(rows, as_of).withColumn("day", F.to_date("timestamp"))
    ready.write.mode("append").partitionBy("day").parquet(folder)


def prepare_recommendations(recs: DataFrame, algorithm: str, generated_at: str) -> DataFrame:
    """Log rows of a recommendation run."""
    rows = recs.select(
        "user_id", "movie_id", F.lit(algorithm).alias("algorithm"), "score",
        F.lit(generated_at).cast("timestamp").alias("generated_at"),
        F.lit(None).cast("timestamp").alias("served_at"),
        F.lit(False).alias("clicked"),
    )
    natural = ["user_id", "movie_id", "algorithm", "generated_at"]
    return rows.withColumn("recommendation_id", natural_key(*natural))


def append_recommendations(
    recs: DataFrame, folder: str, algorithm: str, generated_at: str
) -> None:
    ready = prepare_recommendations(recs, algorithm, generated_at)
    ready.withColumn("day", F.to_date("generated_at")).write.mode("append").partitionBy(
        "day"
    ).parquet(folder)


def apply_feedback(log: DataFrame, feedback: DataFrame) -> DataFrame:
    """Mark recommendations served and clicked.

    ``feedback (recommendation_id, served_at, clicked)`` may repeat ids; it is
    reduced to one row per id before the join.
    """
    per_id = feedback.groupBy("recommendation_id").agg(
        F.min("served_at").alias("new_served"), F.bool_or("clicked").alias("new_clicked")
    )
    return (
        log.join(per_id, "recommendation_id", "left")
        .withColumns(
            {
                "served_at": F.coalesce("new_served", "served_at"),
                "clicked": F.coalesce(F.col("clicked"), F.lit(False))
                | F.coalesce(F.col("new_clicked"), F.lit(False)),
            }
        )
        .drop("new_served", "new_clicked")
    )
