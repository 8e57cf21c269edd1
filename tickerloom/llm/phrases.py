"""Substring dedup by repeated-phrase automata.

A word is a run of non-space characters. Every window of `span` words holds one phrase of
`phrase` words that its own content picks (the smallest hash), so equal windows pick equal
phrases. Phrases found in two documents or more are confirmed by one aggregation, compiled
into one Aho-Corasick automaton for each bucket of documents that holds them, and every
document streams through its bucket's automaton, which locates the confirmed phrases.
Only windows whose phrase was located can recur; an aggregation over their hashes finds
the smallest doc_id of each, and words of windows that start in a smaller doc_id go.

A bucket's automaton is bounded by the bucket's own text, whatever the corpus size. Hot phrases
are aggregated before each shuffle and reach a bucket once. Documents with the same text
as one of smaller doc_id are all repeats; they send no windows.

Defined results: null or empty text has no words; a null doc_id is never smaller or larger
than another, so such a row stays whole and removes nothing; repeated rows of one doc_id
don't remove each other; an empty table gives an empty table. Extra columns of any name pass through inside _row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tickerloom.llm.hashing import BASES, Rolling, WordHashes, distinct_sorted, signed, window_minima
from tickerloom.llm.tables import pieces, release, written

COPY, PHRASE, DOCUMENT = 0, 1, 2


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").split() if text else []  # bytes.split() cuts at exactly 0x20 and 0x09-0x0D


def _picked(span: int, phrase: int):
    """Task function: the phrases that the windows of each document pick."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rolling = WordHashes(), Rolling()
        for batch in batches:
            texts, docs, buckets = [], [], []
            for text, doc, bucket in zip(batch["text"].to_pylist(), batch["doc_id"].to_pylist(), batch["bucket"].to_pylist(), strict=True):
                words = _words(text)
                if len(words) < span:
                    continue
                grams = rolling.windows(rolling.prefix(hashes.array(words)), phrase)
                found = {b" ".join(words[p:p + phrase]) for p in distinct_sorted(window_minima(grams, span - phrase + 1))}
                texts += found
                docs += [doc] * len(found)
                buckets += [bucket] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(docs, pa.int64()), pa.array(buckets, pa.int32())], ["phrase", "doc_id", "bucket"])

    return run


def _automaton(phrases: list[bytes]):
    a = ahocorasick.Automaton()
    for p in phrases:
        key = f" {p.decode()} "
        a.add_word(key, len(key))
    a.make_automaton()
    return a


def located(automaton, words: list[bytes]) -> np.ndarray:
    """Word positions at which a phrase of the automaton starts."""
    text = f" {b' '.join(words).decode()} "
    ends = [end - size + 1 for end, size in automaton.iter(text)]
    if not ends:
        return np.empty(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
    return np.searchsorted(gaps, ends)


def _stream(span: int, phrase: int, with_text: bool, rest_type: pa.DataType):
    """Task function over one bucket after another: copies, then phrases, then documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, one, two = WordHashes(), Rolling(BASES[0]), Rolling(BASES[1])
        bucket, copies, phrases, automaton = None, set(), [], None
        for batch in batches:
            out = {k: [] for k in ("step", "rid", "doc_id", "n_words", "n_removed", "sha", "text")}
            rows, w1, w2, at = [], [], [], []  # rows: index into the batch, for the rest
            cols = [batch[c].to_pylist() for c in ("bucket", "kind", "rid", "doc_id", "phrase", "text")]
            for i, (b, kind, rid, doc, key, text) in enumerate(zip(*cols, strict=True)):
                if b != bucket:
                    bucket, copies, phrases, automaton = b, set(), [], None
                if kind == COPY:
                    copies.add((rid, doc))
                    continue
                if kind == PHRASE:
                    phrases.append(key)
                    continue
                if automaton is None:
                    automaton, phrases = _automaton(phrases), []
                words, starts, removed = _words(text), np.empty(0, np.int64), 0
                n = len(words)
                if n >= span and (rid, doc) in copies:
                    removed = n
                elif n >= span and len(automaton) and len(hits := located(automaton, words)):
                    h = hashes.array(words)
                    sums = one.prefix(h)
                    marked = np.zeros(n, bool)
                    marked[hits] = True
                    starts = np.flatnonzero(marked[window_minima(one.windows(sums, phrase), span - phrase + 1)])
                rows.append(i)
                out["rid"].append(rid)
                out["doc_id"].append(doc)
                out["n_words"].append(n)
                if len(starts):
                    out["step"].append("open")
                    out["n_removed"].append(None)
                    out["sha"].append(None)
                    out["text"].append(text)
                    w1.append(one.windows(sums, span)[starts])
                    w2.append((two.windows(two.prefix(h), span)[starts] >> np.uint64(32)).astype(np.uint32))
                    at.append((len(out["rid"]) - 1, starts))
                else:
                    kept = [] if removed else words
                    out["step"].append("done")
                    out["n_removed"].append(removed)
                    out["sha"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
                    out["text"].append(("" if removed else text) if with_text else None)
            if rows:
                rest = batch["rest"].take(pa.array(rows, pa.int64()))
                yield _record(out, rest, rest_type)
            if w1:
                yield _windows(out, w1, w2, at, rest_type)

    return run


def _record(out: dict, rest: pa.Array, rest_type: pa.DataType) -> pa.RecordBatch:
    n = len(out["rid"])
    return pa.RecordBatch.from_arrays(
        [pa.array(out["step"], pa.string()), pa.array(out["rid"], pa.int64()), pa.array(out["doc_id"], pa.int64()), pa.array(out["n_words"], pa.int64()),
         pa.array(out["n_removed"], pa.int64()), pa.array(out["sha"], pa.string()), pa.array(out["text"], pa.string()), rest,
         pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())],
        ["step", "rid", "doc_id", "n_words", "n_removed", "sha", "text", "rest", "w1", "w2", "pos"])


def _windows(out: dict, w1: list, w2: list, at: list, rest_type: pa.DataType) -> pa.RecordBatch:
    sizes = [len(s) for _, s in at]
    n = sum(sizes)
    rid = np.repeat(np.array([out["rid"][i] for i, _ in at], np.int64), sizes)
    which = np.repeat(np.arange(len(at)), sizes)
    doc = pa.array([out["doc_id"][i] for i, _ in at], pa.int64()).take(pa.array(which))
    return pa.RecordBatch.from_arrays(
        [pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int8)), pa.array(["window"])).cast(pa.string()), pa.array(rid), doc, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
         pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, rest_type), pa.array(signed(np.concatenate(w1))),
         pa.array(np.concatenate(w2).view(np.int32)), pa.array(np.concatenate([s for _, s in at]).astype(np.int32))],
        ["step", "rid", "doc_id", "n_words", "n_removed", "sha", "text", "rest", "w1", "w2", "pos"])


def _cut(span: int, with_text: bool):
    """Task function: words of removed windows leave the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas, texts = [], [], []
            for text, starts in zip(batch["text"].to_pylist(), batch["starts"], strict=True):
                words = _words(text)
                keep = np.ones(len(words), bool)
                if starts.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    s = np.unique(starts.values.to_numpy())
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + span, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                gone = len(words) - int(keep.sum())
                left = b" ".join([w for w, k in zip(words, keep, strict=True) if k])
                removed.append(gone)
                shas.append(hashlib.sha256(left).hexdigest())
                texts.append((left.decode() if gone else text) if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["n_words"], pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string()), batch["rest"]],
                ["doc_id", "n_words", "n_removed", "sha", "text", "rest"])

    return run


def remove_repeats(docs: DataFrame, span: int = 50, phrase: int = 10, with_text: bool = True) -> DataFrame:
    """_row: struct of all columns of docs, text without its repeated passages (unchanged where nothing repeats); and
    dedup: struct of n_words, n_removed, kept_sha256. with_text=False leaves text null and saves its space."""
    if not 0 < phrase <= span:
        raise ValueError("a phrase must fit the span")
    spark = docs.sparkSession
    extra = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*[F.col(f"`{c}`") for c in extra]) if extra else F.struct(F.lit(None).cast("int").alias("none"))
    n = pieces(docs, 16)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("rest"))
    base = base.withColumn("rid", F.xxhash64("doc_id", "text")).withColumn("bucket", F.pmod("rid", F.lit(n)).cast("int"))

    found = base.select("doc_id", "text", "bucket").mapInArrow(_picked(span, phrase), "phrase binary, doc_id long, bucket int")
    confirmed = (found.groupBy("phrase").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.collect_set("bucket").alias("buckets"))
                 .where("lo < hi").select("phrase", F.explode("buckets").alias("bucket")))
    text_key = base.where("text is not null").select("doc_id", "rid", "bucket", F.md5("text").alias("same"))
    firsts = text_key.groupBy("same").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    copies = text_key.join(firsts, "same").where("doc_id > lo").select("bucket", "rid", "doc_id")

    rest_type = base.schema["rest"].dataType
    line = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("rid", T.LongType()),
                         T.StructField("doc_id", T.LongType()), T.StructField("phrase", T.BinaryType()), T.StructField("text", T.StringType()),
                         T.StructField("rest", rest_type)])

    def lines(df: DataFrame, kind: int) -> DataFrame:
        have = set(df.columns)
        return df.select(*[(F.lit(kind) if f.name == "kind" else F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in line])

    routed = (lines(copies, COPY).unionAll(lines(confirmed, PHRASE)).unionAll(lines(base, DOCUMENT))
              .repartition(n, "bucket").sortWithinPartitions("bucket", "kind"))
    arrow_rest = to_arrow_type(rest_type)
    flat = T.StructType([T.StructField("step", T.StringType()), T.StructField("rid", T.LongType()), T.StructField("doc_id", T.LongType()),
                         T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("sha", T.StringType()),
                         T.StructField("text", T.StringType()), T.StructField("rest", rest_type), T.StructField("w1", T.LongType()),
                         T.StructField("w2", T.IntegerType()), T.StructField("pos", T.IntegerType())])
    streamed, _ = written(routed.mapInArrow(_stream(span, phrase, with_text, arrow_rest), flat), "phrases", ["step"])
    del routed, found, confirmed, copies
    release(spark)

    windows = streamed.where("step = 'window'").select("w1", "w2", "doc_id", "rid", "pos")
    first = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("w1", "w2", "lo")
    repeats = windows.join(first, ["w1", "w2"]).where("doc_id > lo").groupBy("rid", "doc_id").agg(F.collect_list("pos").alias("starts"))
    opened = streamed.where("step = 'open'").select("rid", "doc_id", "n_words", "text", "rest")
    cut = opened.join(repeats, (opened.rid == repeats.rid) & (opened.doc_id == repeats.doc_id), "left").select(opened.doc_id, "n_words", "text", "rest", "starts")
    result_type = T.StructType([f for f in flat.fields if f.name in ("doc_id", "n_words", "n_removed", "sha", "text", "rest")])
    result = cut.mapInArrow(_cut(span, with_text), result_type).unionByName(streamed.where("step = 'done'").select(*result_type.names))
    names = [F.col(c) if c in ("doc_id", "text") else F.col("rest")[c].alias(c) for c in docs.columns]
    return result.select(F.struct(*names).alias("_row"), F.struct("n_words", "n_removed", F.col("sha").alias("kept_sha256")).alias("dedup"))

