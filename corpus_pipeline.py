"""Documents to a training mix: quality rules, near duplicates, repeated passages, benchmark leaks, source weights.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes every stage as
Parquet in the shared folder and reads it again as the next one's docs. A stage therefore starts by removing the tables
that its predecessor's operator left, so the shared folder never holds those of two stages.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm import mixing, phrases, rules, setjoin, tables, tiling
from tickerloom.llm.tables import documents, drop, written

_left: list[str] = []


def _stage(apply: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(apply)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, *_left)
        _left.clear()
        start = len(tables.CREATED)
        out = apply(spark, docs, sf_dir)
        _left.extend(tables.CREATED[start:])
        return out

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or an adaptive one go."""
    return rules.judged(docs).where("kept").select("_row.*")


def _one_each(docs: DataFrame) -> DataFrame:
    """One row for each doc_id and text. Only rows of ids that repeat are shuffled; without such ids docs come back as they are."""
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_id"))
    if repeated.isEmpty():
        return docs
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    once = docs.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(repeated, same, "left_anti").unionByName(once)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 the document with the smallest doc_id stays; rows without doc_id stay.

    Of rows with equal doc_id (or none) and equal text one stays, before all else.
    """
    docs = _one_each(docs)
    groups = setjoin.near_duplicates(docs, shingle=5, percent=80, links=False)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 50 words that start in a document of smaller doc_id are cut; documents that had words and have none left go."""
    cut = phrases.remove_repeats(docs).where("dedup.n_removed = 0 or dedup.n_removed < dedup.n_words")
    changed = F.col("dedup.n_removed") > 0
    columns = [F.when(changed, F.length("_row.text")).otherwise(F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(f"_row.`{c}`")
               for c in docs.columns]
    return cut.select(*columns)


@_stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    leaked = tiling.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


@_stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated or thinned to their target weights, in global random order."""
    return mixing.mixed(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("decontamination", decontaminated), ("source_mix", source_mix)]

#: greedy string tiling has no SQL form; tests hold the pipeline against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = documents(spark, sf_dir), None
    for name, stage in STAGES:
        docs, new = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if path:
            drop(spark, path)
        path = new
    return docs
