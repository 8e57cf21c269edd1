"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm import compression, language, merkle, mixing, periods, phrases, rules, setjoin, suffixes, tiling, tries, urlfilter, warc
from tickerloom.llm.tables import documents


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return phrases.remove_repeats(docs, with_text=False).select("_row.doc_id", "dedup.*")


def op2_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return compression.scored(docs, compression.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.archived(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "timestamp")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.near_duplicates(documents(spark, sf_dir), shingle=3, percent=90)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return language.predicted(docs, language.learn(docs))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(documents(spark, sf_dir), carry=["doc_id"]).select("_row.doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "base_failed", "kept")


def op10_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir), with_bytes=False).drop("kept")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return tries.deduplicated(docs, carry=["doc_id"]).select("_row.doc_id", "owner.*")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows = merkle.manifest(documents(spark, sf_dir), fields=["doc_id", "source", "lang", "n_chars", "text"], group="source", id="doc_id",
                           changed={"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}, when=even & F.col("text").contains("\n"), with_proofs=False)
    return rows.withColumnRenamed("id", "doc_id").drop("proof")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with the repeats that the query asks for: from word a on, the p words from a over and over."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = periods.periodic_runs(docs, least=6, exponent=4, carry=["doc_id"], with_text=False, rewrite=planted).select("_row.doc_id", "runs.*")
    longest = F.array_min(F.transform("found", lambda r: F.struct((-r.length).alias("length"), r.start.alias("start"), r.period.alias("period"))))
    listed = F.array_join(F.transform("found", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    best = found.withColumn("best", longest)
    return best.select("doc_id", F.size("found").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.length")).alias("length"), F.col("best.period").alias("period"),
                       F.floor(-1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256")


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_compression_quality, op3_decontamination, op4_warc, op5_mixing, op6_ngram_jaccard,
                                   op7_url_filter, op8_language_id, op9_quality_rules, op10_suffix_levels,
                                   op11_exact_dedup, op12_merkle_manifest, op13_periodic_runs)}
