"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = 8, app: str = "footfall", **extra: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {
        **SETTINGS, "spark.sql.shuffle.partitions": str(cores), "spark.driver.memory": "8g", **extra,
    }.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    root = tempfile.mkdtemp(prefix="footfall-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared scratch root."""
    return f"{scratch_root(spark)}/footfall/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df to the shared scratch folder, or to a ``path`` where it stays, and reads it back: cuts lineage and survives
    lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, name) if path is None else path
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def together(*jobs: Callable) -> list:
    """The results of jobs that do not need each other, submitted at once: many are too small to fill a cluster. All have ended
    when one that failed raises."""
    with ThreadPoolExecutor(max_workers=8) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]
