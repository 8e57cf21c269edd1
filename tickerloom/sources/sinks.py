"""Snapshot and portfolio-state sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_snapshot(snapshot: DataFrame, root: str, run_ts: str) -> None:
    """Appends one history partition per run, then replaces `latest` from it.

    The history partition is written first, so a failed run never leaves `latest`
    without its source; rerunning the same run_ts replaces only its own partition.
    """
    stamped = snapshot.withColumn("run_ts", F.lit(run_ts))
    (stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_ts")
     .parquet(f"{root}/history"))
    spark = snapshot.sparkSession
    done = spark.read.parquet(f"{root}/history").where(F.col("run_ts") == run_ts).drop("run_ts")
    done.write.mode("overwrite").parquet(f"{root}/latest")


def write_run(spark: SparkSession, root: str, run_ts: str, snapshot: DataFrame, run_row: DataFrame) -> None:
    """A whole run: its row of totals, market and macro state, then the snapshot; rerunning a run_ts replaces both."""
    run_row.coalesce(1).write.mode("overwrite").parquet(f"{root}/runs/run_ts={run_ts}")
    write_snapshot(snapshot, root, run_ts)


def runs(spark: SparkSession, root: str) -> DataFrame:
    """One row a run, with run_ts as text."""
    r = spark.read.parquet(f"{root}/runs")
    return r.withColumn("run_ts", F.col("run_ts").cast("string"))


def previous_snapshot(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/latest")


def write_bars(bars: DataFrame, path: str) -> None:
    """Bars partitioned by year and clustered by symbol, so history filters prune partitions and row groups."""
    (bars.withColumn("year", F.year("ts")).repartitionByRange("year", "symbol").sortWithinPartitions("symbol", "ts")
     .write.mode("overwrite").partitionBy("year").parquet(path))


def write_state(table: DataFrame, root: str, name: str, version: str) -> None:
    """One immutable version per revision date; readers pick the version they want."""
    table.write.mode("overwrite").parquet(f"{root}/{name}/version={version}")


def read_state(spark: SparkSession, root: str, name: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}/version={version}")
