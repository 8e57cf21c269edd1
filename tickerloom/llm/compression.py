"""Quality classifier from compressed sizes.

Two zstandard dictionaries are built, from texts labelled good and bad. A text that compresses better with the
good one resembles good texts: its normalised difference (bad size - good size) / plain size, with the plain
ratio as second measure, is turned into a probability by a logistic calibration on labelled rows that the
dictionaries have not seen, at the labels' own rate.

The sample is bounded: per_label rows of each label, max_bytes of text each (of a label that has only longer texts, the shortest); half builds dictionaries, half
calibrates. Scoring reads nothing but the text.

Defined results: null text counts as empty; an empty text gets the score of the calibrated zero measures; without both
labels to learn from, every score is the share of label 1 (0.5 if there is none). Repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.samples import chosen, fitting, held_out, texts

LEVEL = 3


class Sizes:
    """Compressed sizes of a text without and with the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.with_dict = []
        for content in (good, bad):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=LEVEL)
            self.with_dict.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d))

    def measures(self, text: str | None) -> tuple[float, float, float]:
        data = (text or "").encode("utf-8", "replace")
        if not data:
            return 0.0, 0.0, 0.0
        plain = len(self.plain.compress(data))
        good, bad = (len(c.compress(data)) for c in self.with_dict)
        return (bad - good) / plain, plain / len(data), (bad - good) / (bad + good)


def _features(m: np.ndarray) -> np.ndarray:
    d, ratio, e = m.T
    dense = np.minimum(ratio, 1.0)
    return np.stack([np.ones(len(m)), d, dense, e, np.maximum(0, 0.35 - dense), np.maximum(0, d), np.maximum(0, -d)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 40, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _dictionary(samples: list[str], size: int) -> bytes:
    data = [s.encode("utf-8", "replace") for s in samples if s]
    try:
        return zstandard.train_dictionary(size, data, k=64, d=8).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their text is the dictionary
        return b"\n".join(data)[-size:] or b"\n"


def learn(docs: DataFrame, labels: DataFrame, per_label: int = 1500, max_bytes: int = 65536, dictionary_bytes: int = 65536) -> dict:
    """Dictionaries and calibration; rows that samples.held_out names are never read."""
    rows = labels.where(~held_out() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"), F.min("quality").alias("low")).where("label = low").drop("low")
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    rate = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    sizes = docs.select("doc_id", F.octet_length("text").alias("size")).where("size > 0").join(rows, "doc_id")
    found = texts(docs.select("doc_id", "text").where("text <> ''"), chosen(fitting(sizes, "label", max_bytes), "label", per_label))
    sample = {c: [r.text for r in sorted((r for r in found if r.label == c), key=lambda r: (str(r.doc_id), r.text))] for c in (0, 1)}
    if not sample[0] or not sample[1]:
        return {"constant": float(rate)}
    build = {c: v[::2] for c, v in sample.items()}
    check = {c: v[1::2] or v for c, v in sample.items()}
    good, bad = _dictionary(build[1], dictionary_bytes), _dictionary(build[0], dictionary_bytes)
    sizes = Sizes(good, bad)
    m = np.array([sizes.measures(t) for c in (0, 1) for t in check[c]])
    y = np.repeat([0.0, 1.0], [len(check[0]), len(check[1])])
    weight = np.where(y == 1, rate / len(check[1]), (1 - rate) / len(check[0])) * len(y)
    return {"good": good, "bad": bad, "weights": _logistic(_features(m), y, weight).tolist()}


def _score(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = None if "constant" in model else Sizes(model["good"], model["bad"])
        for batch in batches:
            if sizes is None:
                score = np.full(batch.num_rows, model["constant"])
            else:
                m = np.array([sizes.measures(t) for t in batch["text"].to_pylist()]).reshape(-1, 3)
                score = 1 / (1 + np.exp(-np.clip(_features(m) @ np.array(model["weights"]), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score)], ["doc_id", "score"])

    return run


def scored(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = base.mapInArrow(_score(model), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
