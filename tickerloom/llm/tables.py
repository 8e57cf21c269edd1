"""Written tables between the steps of an operator, in the folder all executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.session import work_dir


CREATED: list[str] = []  # paths of the tables written in this application, in order


def folder(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; nothing is created yet."""
    return f"{work_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> tuple[DataFrame, str]:
    """Writes df as Parquet and reads it back: lineage ends here, lost executors cost only what they held.

    The collections let Spark's cleaner drop shuffle files of plans nobody holds any more.
    """
    spark, path = df.sparkSession, folder(df.sparkSession, name)
    schema = df.schema
    CREATED.append(path)
    df.write.parquet(path, partitionBy=partition_by)
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path), path


def release(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(spark: SparkSession, *paths: str) -> None:
    """Removes written tables whose readers are done."""
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pieces(docs: DataFrame, megabytes: int) -> int:
    """Number of shuffle pieces that keep each near so many MB of text."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (megabytes << 20)), 1)
