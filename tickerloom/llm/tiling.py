"""Benchmark decontamination by greedy string tiling.

Words are lower-cased runs of non-space characters. Every sequence of `seed` words of a benchmark item
is a seed; a document that shares a seed with an item is compared with it. Comparing repeats a
Karp-Rabin pass: all unmarked word windows of a length are hashed, equal ones extended, and the longest
matches marked as tiles that don't overlap; then the length is halved, down to the seed. As tiles may lie in any
order, passages whose sentences were moved about still cover the item. An item is leaked in a document
whose tiles cover at least `coverage` of the item's words.

The benchmark is the stated query set: it goes to the tasks in blocks of at most `block_bytes` of text,
so what is broadcast has a fixed bound, and every document meets every block.

Defined results: null, empty or blank texts and items match nothing; an item shorter than a seed must occur
whole; repeated rows are reported once for each row; a null doc_id or item_id is carried as it is.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.hashing import Rolling, WordHashes

RESULT = "doc_id long, item_id long, item_words int, covered int, tiles int, longest int, coverage double, spans array<struct<start:int,length:int>>"


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []


def tile(pattern: np.ndarray, text: np.ndarray, least: int, rolling: Rolling) -> list[tuple[int, int, int]]:
    """Tiles (pattern start, text start, length): greedily the longest matches of at least `least` words that don't overlap."""
    free_p, free_t, tiles = np.ones(len(pattern), bool), np.ones(len(text), bool), []
    width = max(least, len(pattern))
    sums_p, sums_t = rolling.prefix(pattern), rolling.prefix(text)
    while True:
        while True:
            found = _longest(pattern, text, free_p, free_t, sums_p, sums_t, width, rolling)
            if not found:
                break
            size, p, t = found
            tiles.append((p, t, size))
            free_p[p:p + size] = False
            free_t[t:t + size] = False
        if width == least:
            return tiles
        width = max(least, width // 2)


def _longest(pattern, text, free_p, free_t, sums_p, sums_t, width, rolling) -> tuple[int, int, int] | None:
    """The longest match of unmarked words of at least `width`; the first in pattern and text on ties."""
    if len(pattern) < width or len(text) < width:
        return None
    open_p = np.flatnonzero(np.convolve(free_p, np.ones(width, int), "valid") == width)
    open_t = np.flatnonzero(np.convolve(free_t, np.ones(width, int), "valid") == width)
    if not len(open_p) or not len(open_t):
        return None
    hash_p, hash_t = rolling.windows(sums_p, width)[open_p], rolling.windows(sums_t, width)[open_t]
    at = defaultdict(list)
    for t in np.flatnonzero(np.isin(hash_t, hash_p)):
        at[int(hash_t[t])].append(int(open_t[t]))
    best = None
    for h, p in zip(hash_p.tolist(), open_p.tolist(), strict=True):
        for t in at.get(h, ()):
            size = width
            while p + size < len(pattern) and t + size < len(text) and free_p[p + size] and free_t[t + size] and pattern[p + size] == text[t + size]:
                size += 1
            if best is None or size > best[0]:
                best = (size, p, t)
    return best


def _scan(items: list[tuple], seed: int, coverage: float):
    """Task function: leaks of one block of items in each document. items: (item_id, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rolling = WordHashes(), Rolling()
        patterns = [hashes.array(w) for _, w in items]
        where: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))  # by seed length, then hash
        for i, h in enumerate(patterns):
            width = min(seed, len(h))
            for p, g in enumerate(rolling.windows(rolling.prefix(h), width).tolist()):
                where[width][g].append((i, p))
        seeds = {width: np.sort(np.array(list(v), np.uint64)) for width, v in where.items()}
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = _words(text)
                if not words:
                    continue
                h = hashes.array(words)
                sums, touched = rolling.prefix(h), defaultdict(set)
                for width, known in seeds.items():
                    grams = rolling.windows(sums, width)
                    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                    for g in np.unique(grams[known[at] == grams]).tolist():
                        for i, p in where[width][g]:
                            touched[i].update(range(p, p + width))
                for i, may in touched.items():
                    n = len(patterns[i])
                    if len(may) < coverage * n:
                        continue
                    tiles = tile(patterns[i], h, min(seed, n), rolling)
                    covered = sum(t[2] for t in tiles)
                    if covered >= coverage * n:
                        spans = [{"start": t, "length": s} for _, t, s in sorted(tiles, key=lambda x: x[1])]
                        out.append((doc, items[i][0], n, covered, len(tiles), max(t[2] for t in tiles), covered / n, spans))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], kind) for c, kind in enumerate(kinds)],
                                             ["doc_id", "item_id", "item_words", "covered", "tiles", "longest", "coverage", "spans"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, seed: int = 5, coverage: float = 0.5, block_bytes: int = 8 << 20) -> DataFrame:
    """One row for each document and benchmark item that it leaks, with the tiles' word spans in the document."""
    if not 0 < coverage <= 1 or seed < 1:
        raise ValueError("coverage must be in (0, 1], seed at least 1")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    base, found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), None
    for b in range(max(1, blocks)):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks))) == b).collect()
        block = [(r.item_id, w) for r in sorted(rows, key=lambda r: (r.item_id is None, r.item_id or 0, r.text)) if (w := _words(r.text))]
        part = base.mapInArrow(_scan(block, seed, coverage), RESULT)
        found = part if found is None else found.unionAll(part)
    return found
