"""Periodic runs of words: Lyndon arrays from the grouping phase of a suffix sorter, roots extended to runs.

A run is a stretch of words with smallest period q and length >= max(`least`, `exponent` * q) that no neighbouring word
extends. Baier's first phase sorts suffixes into groups by their longest Lyndon prefix: groups are taken from the greatest
down, and each suffix left of one that was taken gets that one's prefix appended, which splits its group. The lengths of
the prefixes are the Lyndon array. Every run has a Lyndon root under the order of the words or under its reverse, and a
root is the longest Lyndon prefix where it starts; so both arrays give all roots, and each root is extended to both sides
by longest common extensions (LCE; binary search over prefix hashes, then compared word by word). LCE reading and grouping
see only stretches whose word windows occur again in the document, since every run lies inside one such stretch.

Defined results: a null or empty text has no words and no runs; rows stand for themselves, so repeated rows, equal or null
ids get a row each; extra columns are carried along in `_row`; an empty table gives an empty table. A document is read
whole by one task, so its words must fit one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tickerloom.llm.hashing import Rolling, mix

RUNS = T.ArrayType(T.StructType().add("start", "long").add("length", "long").add("period", "long"))
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def lyndon_lengths(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place; ranks are 0..k-1, all used."""
    n, top = len(ranks), max(ranks, default=-1) + 1
    members: list[list[int]] = [[] for _ in range(top)]
    group = [-1, *ranks]  # places count from 1; place 0 stands before the text
    for i, r in enumerate(ranks, 1):
        members[r].append(i)
    size, below, above = [1] * top, list(range(-1, top - 1)), list(range(1, top + 1))
    nearest = list(range(n + 1))  # the next place to the left (itself included) that was not taken yet, shortened as it is used
    lengths = [0] * n
    g = top - 1
    while g >= 0:
        taken, width = [i for i in members[g] if group[i] == g], size[g]
        for i in taken:
            nearest[i] = i - 1
            lengths[i - 1] = width
        times: dict[int, int] = {}
        for i in taken:
            j = i - 1
            while nearest[j] != j:
                nearest[j] = j = nearest[nearest[j]]
            if j:
                times[j] = times.get(j, 0) + 1
        split: dict[tuple[int, int], list[int]] = {}
        for j, k in times.items():
            split.setdefault((group[j], k), []).append(j)
        for h, k in sorted(split, reverse=True) if len(split) > 1 else split:  # more repeats stand higher
            new = len(size)
            for j in split[h, k]:
                group[j] = new
            members.append(split[h, k])
            size.append(size[h] + k * width)
            up = above[h]
            below.append(h)
            above.append(up)
            above[h] = new
            if up < len(below):
                below[up] = new
        members[g] = []
        g = below[g]
    return lengths


def _same(a: np.ndarray, b: np.ndarray) -> int:
    differ = np.flatnonzero(a != b)
    return int(differ[0]) if len(differ) else len(a)


class Runs:
    """Finds the runs of sequences of whole numbers."""

    def __init__(self, least: int, exponent: int):
        if least < 2 or exponent < 2:
            raise ValueError("least and exponent must be at least 2")
        self.least, self.exponent, self.rolling = least, exponent, Rolling()
        # the longest word window of which each one inside a run occurs again in it
        self.window = min(max(least, exponent * q) - 2 * q + 1 for q in range(1, least + 1))

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Parts that hold every run: maximal covers of word windows that occur twice."""
        if len(ids) < self.least:
            return []
        grams = self.rolling.windows(self.rolling.prefix(mix(ids.astype(np.uint64) + np.uint64(1))), self.window)
        order = np.argsort(grams, kind="stable")
        equal = grams[order][1:] == grams[order][:-1]
        if not equal.any():
            return []
        twice = np.zeros(len(grams), bool)
        twice[order[1:][equal]] = twice[order[:-1][equal]] = True
        at = np.flatnonzero(twice)
        cut = np.flatnonzero(np.diff(at) > 1)
        lo, hi = at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]] + self.window
        return [(a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if b - a >= self.least]

    def _lce(self, sums: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
        """Words that agree from i and j on, forward or (step -1) backward, `most` at most."""
        lo, hi = np.zeros_like(most), most.copy()
        while (open_ := lo < hi).any():
            mid = np.where(open_, (lo + hi + 1) // 2, lo)
            a, b = (i, j) if step > 0 else (i - mid, j - mid)
            agree = self.rolling.spans(sums, a, a + mid) == self.rolling.spans(sums, b, b + mid)
            lo, hi = np.where(agree, mid, lo), np.where(open_ & ~agree, mid - 1, hi)
        return lo

    def _in(self, ids: np.ndarray) -> set[tuple[int, int, int]]:
        n = len(ids)
        _, ranks = np.unique(ids, return_inverse=True)
        top = int(ranks.max())
        sums = self.rolling.prefix(mix(ranks.astype(np.uint64) + np.uint64(1)))
        found = set()
        for order in (ranks, top - ranks):
            period = np.array(lyndon_lengths(order.tolist()), np.int64)
            i = np.flatnonzero((np.arange(n) + period < n) & (period * self.exponent <= n))
            if self.exponent > 2:  # such a run has a root that another copy of the root follows
                i = i[ids[i] == ids[i + period[i]]]
            p = period[i]
            right = self._lce(sums, i, i + p, n - i - p, 1)
            left = self._lce(sums, i, i + p, i, -1)
            long_ = left + right + p >= np.maximum(self.least, self.exponent * p)
            for start, end, q in set(zip((i - left)[long_].tolist(), (i + p + right)[long_].tolist(), p[long_].tolist(), strict=True)):
                if not np.array_equal(ids[start:end - q], ids[start + q:end]):  # equal hashes of different words
                    root = int(i[long_ & (i - left == start) & (p == q)][0])
                    start = root - _same(ids[:root][::-1], ids[q:root + q][::-1])
                    end = root + q + _same(ids[root:n - q], ids[root + q:])
                    if end - start < max(self.least, self.exponent * q):
                        continue
                found.add((start, end - start, q))
        return found

    def __call__(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, length, period) by start, then period."""
        out = [(a + s, length, q) for a, b in self.stretches(ids) for s, length, q in self._in(ids[a:b])]
        return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return [w for w, gone in zip(words, (np.cumsum(edge[:-1]) > 0).tolist(), strict=True) if not gone]


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4, carry: list[str] | None = None, with_text: bool = True,
                  rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """_row (struct of the columns in carry; all by default) and runs: struct of n_words, found (runs by start, then period),
    collapsed (kept words joined by one space; null if with_text is False) and collapsed_sha256.

    rewrite, if given, gets doc_id and words of each text and returns the words to search.
    """
    finder = Runs(least, exponent)
    carried = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)])
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), carried.alias("_row"))
    row_type = source.schema["_row"].dataType
    arrow_row = to_arrow_type(row_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, all_runs, texts, shas = [], [], [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                words = text.split() if text else []
                if rewrite:
                    words = rewrite(doc_id, words)
                names: dict[bytes, int] = {}
                runs = finder(np.array([names.setdefault(w, len(names)) for w in words], np.int64)) if len(words) >= least else []
                left = b" ".join(collapsed(words, runs))
                n_words.append(len(words))
                all_runs.append([{"start": s, "length": k, "period": q} for s, k, q in runs])
                texts.append(left.decode("utf-8", "replace") if with_text else None)
                shas.append(hashlib.sha256(left).hexdigest())
            out = pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(all_runs, _RUNS), pa.array(texts, pa.string()), pa.array(shas, pa.string())],
                                             ["n_words", "found", "collapsed", "collapsed_sha256"])
            yield pa.RecordBatch.from_arrays([batch["_row"].cast(arrow_row), out], ["_row", "runs"])

    found = T.StructType().add("n_words", "long").add("found", RUNS).add("collapsed", "string").add("collapsed_sha256", "string")
    return source.mapInArrow(run, T.StructType([source.schema["_row"], T.StructField("runs", found)]))
