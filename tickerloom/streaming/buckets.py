"""A keyed table under upserts: buckets rewritten copy-on-write, a pointer that names the version of each bucket.

A merge rewrites only the buckets that its batch touches, into a folder of its own, then writes the pointer; readers go by
the newest pointer, so they see whole merges only. Folders that no pointer names any more are removed. A batch number
that the pointer already has changes nothing, so a batch repeated after a failure is harmless, and one that failed halfway
overwrites its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Buckets:
    def __init__(self, root: str, key: str = "symbol", order: str = "ts", buckets: int = 16):
        self.root, self.key, self.order, self.n = root, key, order, buckets

    def _fs(self, spark: SparkSession):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, spark: SparkSession, folder: str) -> list[str]:
        fs, root = self._fs(spark)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, folder)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _delete(self, spark: SparkSession, folder: str) -> None:
        fs, root = self._fs(spark)
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, folder), True)

    def pointer(self, spark: SparkSession) -> tuple[int, dict[int, int]]:
        """Number of the newest finished merge (-1: none), and the merge that wrote each bucket."""
        done = [int(x.split("=")[1]) for x in self._names(spark, "pointer") if x.startswith("merge=") and "_SUCCESS" in self._names(spark, f"pointer/{x}")]
        if not done:
            return -1, {}
        rows = spark.read.schema("bucket int, version long").parquet(f"{self.root}/pointer/merge={max(done)}").collect()  # one row a bucket
        return max(done), {r.bucket: r.version for r in rows}

    def _load(self, spark: SparkSession, versions: dict[int, int], schema: StructType) -> DataFrame | None:
        paths = [f"{self.root}/data/version={v}/bucket={b}" for b, v in sorted(versions.items())]
        return spark.read.schema(schema).parquet(*paths) if paths else None

    def read(self, spark: SparkSession, schema: StructType) -> DataFrame:
        found = self._load(spark, self.pointer(spark)[1], schema)
        return spark.createDataFrame([], schema) if found is None else found

    def merge(self, batch: DataFrame, number: int) -> None:
        """The row with the greatest `order` stays of each key, old or new; files may arrive in any order."""
        spark, schema = batch.sparkSession, batch.schema
        last, versions = self.pointer(spark)
        if number <= last:
            return
        at = F.pmod(F.hash(self.key), F.lit(self.n))
        touched = [r.bucket for r in batch.select(at.alias("bucket")).distinct().collect()]  # at most n numbers
        if not touched:
            return
        old = self._load(spark, {b: v for b, v in versions.items() if b in touched}, schema)
        rows = batch if old is None else batch.unionByName(old)
        others = [c for c in schema.names if c != self.key]
        newest = rows.groupBy(self.key).agg(F.max_by(F.struct(*others), self.order).alias("r")).select(self.key, "r.*").select(*schema.names)
        newest.withColumn("bucket", at).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/version={number}")
        now = versions | {b: number for b in touched}
        pointer = spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1)
        pointer.write.mode("overwrite").parquet(f"{self.root}/pointer/merge={number}")
        for b in set(touched) & set(versions):
            self._delete(spark, f"data/version={versions[b]}/bucket={b}")
        for v in {versions[b] for b in touched if b in versions} - set(now.values()):
            self._delete(spark, f"data/version={v}")
        for name in self._names(spark, "pointer"):
            if name != f"merge={number}":
                self._delete(spark, f"pointer/{name}")
