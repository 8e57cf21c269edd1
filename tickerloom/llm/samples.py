"""Bounded samples of training rows, chosen by a hash of their id so that every run takes the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id"):
    """Rows that no model learns from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fitting(rows: DataFrame, label: str, max_bytes: int) -> DataFrame:
    """Those rows (with `size`) that a sample may take: at most max_bytes, or a label's shortest where all of it are longer."""
    shortest = rows.groupBy(label).agg(F.greatest(F.min("size"), F.lit(max_bytes)).alias("most"))
    return rows.join(shortest, label).where("size <= most").drop("size")


def chosen(rows: DataFrame, label: str, per_label: int) -> DataFrame:
    """doc_id, label and other columns (the same for all rows of a label) of at most per_label ids for each label, in the order of the ids' md5."""
    order = (F.md5(F.col("doc_id").cast("string")), F.col("doc_id"))
    ids = rows.distinct()
    # first the best of each of 64 shares of a label, so that no task sorts a whole label
    shares = ids.withColumn("_s", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    few = shares.withColumn("_p", F.row_number().over(Window.partitionBy(label, "_s").orderBy(*order))).where(F.col("_p") <= per_label)
    return few.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(*order))).where(F.col("_r") <= per_label).drop("_s", "_p", "_r")


def texts(docs: DataFrame, ids: DataFrame) -> list:
    """For each chosen id (and label, where docs has it) one text of at most `most` bytes: a list bounded by ids and bytes.

    Of the rows of an id the text with the smallest md5 is taken, ties by the text, on the executors.
    """
    found = docs.join(F.broadcast(ids), [c for c in ids.columns if c in docs.columns]).where(F.octet_length("text") <= F.col("most"))
    keys = list(dict.fromkeys(["doc_id", *ids.columns]))
    return found.groupBy(*keys).agg(F.min(F.struct(F.md5(F.col("text").cast("binary")), "text"))["text"].alias("text")).collect()
