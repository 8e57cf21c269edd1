"""Session defaults for tests and local runs. A cluster brings its own settings."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", shuffle_partitions: int = 8, app: str = "tickerloom") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """Shared folder for written tables and stream checkpoints.

    The cluster names it in spark.checkpoint.dir; only where that is unset
    (tests, local runs) a temporary folder is made. Off local mode that would be another
    disk on every node, so it is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all nodes share (master {master})")
        named = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: computed once, survives lost executors."""
    spark, schema = df.sparkSession, df.schema
    path = f"{work_dir(spark).rstrip('/')}/tickerloom/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=partition_by)
    return spark.read.schema(schema).parquet(path)


TASK_ROWS = 500_000


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df (about `rows` rows) dealt by `by` into tasks of about TASK_ROWS rows, so that a task's sort doesn't grow with the input.

    Where spark.sql.shuffle.partitions suffices for that, df stays as it is and Spark may merge its partitions.
    """
    n = -(-rows // TASK_ROWS)
    return df.repartition(n, *by) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: computed once, survives lost executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(f"{work_dir(df.sparkSession).rstrip('/')}/tickerloom/checkpoints")
    return df.checkpoint()
