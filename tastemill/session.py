"""Session defaults and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    parts = shuffle_partitions or (int(cpus) if str(cpus).isdigit() else 8)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tastemill")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # joins that multiply small inputs keep all cores busy
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
        # hash joins where every partition's measured size is small enough
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "256MB")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Only when the session names none (local tests) is a temporary folder set.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tastemill-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a shared folder")


def materialise(df: DataFrame) -> DataFrame:
    """Write once into the shared checkpoint folder and read from there on.

    For tables that several branches of a plan read: the branches neither
    recompute them nor depend on executors that held them, and the planner sees
    their real size. The plan runs once, where an eager checkpoint runs it twice.
    """
    path = scratch_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, on the same shared storage."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
