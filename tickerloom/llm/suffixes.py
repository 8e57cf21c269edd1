"""Removal of long repeated byte strings with a logarithmic family of hashed minimizer indexes, in place of suffix arrays.

Hashes decide throughout; bytes are never compared.

Every string of `length` bytes picks one suffix inside itself (the `GRAM` bytes with the smallest hash), so
equal strings pick equal suffixes at equal offsets. The picked suffixes of a batch of documents, sorted by
their first 8 bytes and a hash of GRAM bytes, are its index (called array here; it is not in suffix order). A new batch is merge-scanned against the arrays of all levels:
suffixes whose first GRAM bytes occur twice are long-match candidates. Then arrays of equal level merge, so n
batches leave at most log2(n) arrays and each suffix is rewritten log2(n) times at most.

A candidate's block is the text of all strings that picked it. Blocks equal to another are repeated
throughout. Where one suffix has several different blocks, their strings are compared at equal offsets inside a task
of bounded size; suffixes with more blocks than `crowd` are compared by an aggregation over string hashes instead, so
no suffix has to fit a task. All positions of all texts take part.

Defined results: null or empty text has no bytes; texts shorter than `length` stay whole; repeated rows are other
places of the same string, so both lose it; doc_id may be null or repeat; an empty table gives an empty
table. What is kept may end inside a character; it is returned as bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.hashing import Rolling, mix, signed, window_minima
from tickerloom.llm.tables import drop, release, written

GRAM = 32
SEGMENT = 1 << 22  # string starts handled at once, so a very long text needs no more memory than that
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "replace") if text else b""


def picked(data: bytes, length: int, rolling: Rolling) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, finger, block, at, lo, hi) arrays: the suffixes picked by the strings that start at lo..hi."""
    raw = np.frombuffer(data, np.uint8)
    for base in range(0, max(0, len(raw) - length + 1), SEGMENT):
        part = raw[base:base + SEGMENT + length - 1]
        sums = rolling.prefix(_BYTE[part])
        grams = rolling.windows(sums, GRAM)
        at = window_minima(grams, length - GRAM + 1)
        lo = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        hi = np.r_[lo[1:], len(at)] - 1
        at = at[lo]
        lead = np.zeros(len(at), np.uint64)
        for j in range(8):
            lead = (lead << np.uint64(8)) | part[at + j].astype(np.uint64)
        block = mix(rolling.spans(sums, lo, hi + length) + (hi - lo).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + (at - lo).astype(np.uint64) * np.uint64(0x165667B19E3779F9))
        yield signed(lead ^ np.uint64(1 << 63)), signed(grams[at]), signed(block), at + base, lo + base, hi + base


def _suffixes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            rids, parts = [], []
            for rid, text in zip(batch["rid"].to_pylist(), batch["text"].to_pylist(), strict=True):
                for x in picked(_bytes(text), length, rolling):
                    parts.append(x)
                    rids.append(rid)
            if parts:
                cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
                rid = np.repeat(np.array(rids, np.int64), [len(x[0]) for x in parts])
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols[:3]), pa.array(rid), *(pa.array(c.astype(np.int32)) for c in cols[3:])],
                                                 ["key", "finger", "block", "rid", "at", "lo", "hi"])

    return run


class SuffixLevels:
    """Sorted arrays (key, finger, n) of the batches so far, of geometrically growing size."""

    def __init__(self, docs: DataFrame):
        self.spark, self.levels = docs.sparkSession, {}

    def _sorted(self, rows: DataFrame) -> tuple[DataFrame, str]:
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return written(rows.repartitionByRange(n, "key", "finger").sortWithinPartitions("key", "finger"), "suffix-level")

    def add(self, batch: DataFrame) -> tuple[DataFrame, str]:
        """Suffixes (key, finger) of the batch that occur in it twice or in an older batch; then the levels merge."""
        array, path = self._sorted(batch.groupBy("key", "finger").agg(F.count("*").alias("n")))
        found = array.where("n > 1").select("key", "finger")
        for level, _ in self.levels.values():
            found = found.unionAll(array.join(level, ["key", "finger"], "left_semi").select("key", "finger"))
        hits = written(found.distinct(), "suffix-hits")
        rank, merging, old = 0, array, [path]
        while rank in self.levels:
            level, level_path = self.levels.pop(rank)
            merging, rank = merging.unionAll(level), rank + 1
            old.append(level_path)
        if rank:
            self.levels[rank] = self._sorted(merging.groupBy("key", "finger").agg(F.sum("n").alias("n")))
            drop(self.spark, *old)
        else:
            self.levels[0] = (array, path)
        return hits

    def close(self) -> None:
        drop(self.spark, *(path for _, path in self.levels.values()))


_FETCHED = ["step", "doc_id", "rid", "n_bytes", "n_removed", "n_spans", "sha", "text", "spans", "key", "finger", "at", "lo", "hi", "copies", "part"]
_FETCHED_TYPE = ("step string, doc_id long, rid long, n_bytes long, n_removed long, n_spans long, sha string, text string, spans array<struct<lo:int,hi:int>>, "
                 "key long, finger long, at int, lo int, hi int, copies long, part binary")
_SPANS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _fetch(length: int):
    """Task function: documents without candidates are done; the others stay open and send the blocks to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, rid, text, marks in zip(*(batch[c].to_pylist() for c in ("doc_id", "rid", "text", "marks")), strict=True):
                data = _bytes(text)
                if not marks:
                    rows.append(("done", doc, rid, len(data), 0, 0, hashlib.sha256(data).hexdigest(), None, None, None, None, None, None, None, None, None))
                    continue
                spans = [{"lo": m["lo"], "hi": m["hi"]} for m in marks if m["copies"] > 1]
                rows.append(("open", doc, rid, len(data), None, None, None, text, spans, None, None, None, None, None, None, None))
                rows += [("block", None, rid, None, None, None, None, None, None, m["key"], m["finger"], m["at"], m["lo"], m["hi"], m["copies"], data[m["lo"]:m["hi"] + length])
                         for m in marks if m["compare"]]
            kinds = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.string(), _SPANS, pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], _FETCHED)

    return run


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), starts[np.r_[cut, len(starts) - 1]].tolist(), strict=True))


def _compare(length: int):
    """Task function over blocks sorted by suffix: starts of strings that another block of the suffix has at the same offset."""

    def group(rows: list[tuple], rolling: Rolling) -> list[tuple[int, int, int]]:
        if len(rows) < 2:
            return []
        hashes = [rolling.windows(rolling.prefix(_BYTE[np.frombuffer(r[7], np.uint8)]), length) for r in rows]
        start = np.concatenate([np.arange(r[4], r[5] + 1) for r in rows])
        _, inverse, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        twice = n[inverse] > 1
        out, edges = [], np.r_[0, np.cumsum([len(x) for x in hashes])]
        for i, r in enumerate(rows):
            if r[6] == 1:  # a block with copies is repeated throughout
                s = slice(edges[i], edges[i + 1])
                out += [(r[2], a, b) for a, b in _runs(start[s][twice[s]])]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, held, key = Rolling(), [], None
        for batch in batches:
            out = []
            for row in zip(*(batch[c].to_pylist() for c in ("key", "finger", "rid", "at", "lo", "hi", "copies", "part")), strict=True):
                if row[:2] != key:
                    out += group(held, rolling)
                    held, key = [], row[:2]
                held.append(row)
            yield _span_batch(out)
        yield _span_batch(group(held, rolling))

    return run


def _span_batch(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32())], ["rid", "lo", "hi"])


def _strings(length: int):
    """Task function: one row for each string of a crowded suffix's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Rolling(), Rolling(0xD6E8FEB86659FD93)
        for batch in batches:
            for rid, lo, hi, copies, part in zip(*(batch[c].to_pylist() for c in ("rid", "lo", "hi", "copies", "part")), strict=True):
                values = _BYTE[np.frombuffer(part, np.uint8)]
                n = hi - lo + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(one.windows(one.prefix(values), length))), pa.array(signed(two.windows(two.prefix(values), length))), pa.array(np.full(n, rid)),
                     pa.array(np.arange(lo, hi + 1, dtype=np.int32)), pa.array(np.full(n, copies))], ["w1", "w2", "rid", "lo", "copies"])

    return run


def _cut(length: int, with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, runs, shas, left = [], [], [], []
            for text, whole, found in zip(*(batch[c].to_pylist() for c in ("text", "spans", "found")), strict=True):
                data = np.frombuffer(_bytes(text), np.uint8)
                edge = np.zeros(len(data) + 1, np.int64)
                for s in (*(whole or ()), *(found or ())):
                    edge[s["lo"]] += 1
                    edge[s["hi"] + length] -= 1
                out = np.cumsum(edge[:-1]) > 0
                kept = data[~out].tobytes()
                gone.append(int(out.sum()))
                runs.append(int((out & ~np.r_[False, out[:-1]]).sum()) if len(out) else 0)
                shas.append(hashlib.sha256(kept).hexdigest())
                left.append(kept if with_bytes else None)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(shas, pa.string()), pa.array(left, pa.binary())],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 400, batches: int = 4, crowd: int = 4096, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes; of changed documents only, null where nothing repeats or with_bytes is False)."""
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
    entries, entries_path = written(base.mapInArrow(_suffixes(length), "key long, finger long, block long, rid long, at int, lo int, hi int"), "suffixes")
    levels, hits, hit_paths = SuffixLevels(docs), None, []
    for b in range(batches):
        found, path = levels.add(entries.where(F.pmod(F.xxhash64("rid"), F.lit(batches)) == b).select("key", "finger"))
        hits = found if hits is None else hits.unionAll(found)
        hit_paths.append(path)
    levels.close()
    marked, marked_path = written(entries.join(hits.distinct(), ["key", "finger"], "left_semi"), "suffix-marked")
    drop(spark, entries_path, *hit_paths)

    place = ["rid", "at", "lo", "hi"]
    blocks = marked.groupBy("key", "finger", "block").agg(F.count("*").alias("copies"), F.min(F.struct(*place)).alias("rep"))
    several = blocks.groupBy("key", "finger").agg(F.count("*").alias("kinds"))
    kinds, kinds_path = written(blocks.join(several, ["key", "finger"]), "suffix-blocks")
    joined = marked.join(kinds, ["key", "finger", "block"])
    is_rep = F.struct(*place) == F.col("rep")
    marks = joined.where("copies > 1 or kinds > 1").select(
        "rid", F.struct("key", "finger", "at", "lo", "hi", "copies", (is_rep & (F.col("kinds") > 1)).alias("compare")).alias("m")).groupBy("rid").agg(F.collect_set("m").alias("marks"))
    fetched, _ = written(base.join(marks, "rid", "left").select("doc_id", "rid", "text", "marks").mapInArrow(_fetch(length), _FETCHED_TYPE), "suffix-fetched", ["step"])
    drop(spark, marked_path)

    sent = fetched.where("step = 'block'").select("key", "finger", "rid", "at", "lo", "hi", "copies", "part").dropDuplicates(["key", "finger", "rid", "lo"])
    crowded = kinds.where(F.col("kinds") > crowd).select("key", "finger").distinct()
    small = sent.join(crowded, ["key", "finger"], "left_anti").repartition("key", "finger").sortWithinPartitions("key", "finger")
    spans = small.mapInArrow(_compare(length), "rid long, lo int, hi int")
    if not crowded.isEmpty():
        strings = sent.join(crowded, ["key", "finger"], "left_semi").mapInArrow(_strings(length), "w1 long, w2 long, rid long, lo int, copies long")
        twice = strings.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
        spans = spans.unionAll(strings.where("copies = 1").join(twice, ["w1", "w2"], "left_semi").select("rid", "lo", F.col("lo").alias("hi")))
    found = spans.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))
    opened = fetched.where("step = 'open'").join(found, "rid", "left").select("doc_id", "n_bytes", "text", "spans", "found")
    cut = opened.mapInArrow(_cut(length, with_bytes), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    release(spark)
    done = fetched.where("step = 'done'").select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("sha").alias("kept_sha256"), F.lit(None).cast("binary").alias("kept"))
    return cut.unionByName(done)

