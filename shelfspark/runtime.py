"""Shared working folder, written intermediate tables and size checks."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def work_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session that
    names none gets a fresh temporary folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY)
    configured = configured or sc.getCheckpointDir()
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a shared folder")
    folder = tempfile.mkdtemp(prefix="run-")
    sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; no two calls share one."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write once to the shared folder and read back.

    Later passes read the same rows, also after executors are lost, with
    columns pruned and real sizes for the planner. The folder outlives the
    session: cleaning it up is the operator's choice.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def block_count(rows: int, block_rows: int) -> int:
    """Number of blocks so that each holds about ``block_rows`` rows."""
    return max(1, math.ceil(rows / block_rows))


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the scan has fewer tasks than cores, as with one small file.

    Larger inputs already have more tasks than that and are returned as they are,
    so the extra shuffle is only ever paid on little data.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def one_thread_per_task(spark: SparkSession) -> None:
    """Keep numpy's matrix library to one thread in Python workers: Spark already runs one task per core."""
    env = spark.sparkContext.environment
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        env.setdefault(name, "1")
