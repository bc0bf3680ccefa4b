"""Session settings and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Semantics the library relies on: UTC clock, JSON objects with a repeated key
# keep the last value, and runtime re-planning of skewed or small joins.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Scoring is compute-heavy per byte: let small shuffles keep more tasks.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the session settings the operators rely on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def spread(df: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """The table over at least as many partitions as there are cores.

    A file with a single row group is one task, whatever is computed from it.
    Only inputs with fewer splits than cores are redistributed; larger ones, and
    so every table at scale, pass unchanged. ``rows_per_task`` asks for more
    partitions, by the number of rows: for rows whose work is far heavier than
    their bytes tell.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if rows_per_task is not None:
        tasks = max(tasks, -(-df.count() // rows_per_task))
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder visible to every executor, as the cluster names it.

    ``spark.checkpoint.dir`` wins. Only where it is unset (local tests) a
    temporary folder is created, one per application.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="boxtrail-")
    return _local_folders[app]


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A fresh, unused path below the shared folder."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet on shared storage and read it back.

    Used where several branches reuse one expensive intermediate: the table
    survives the loss of executors and cuts the lineage.
    """
    spark = df.sparkSession
    path = new_shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
