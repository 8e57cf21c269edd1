"""Language identification with averaged hashed subword embeddings and a linear softmax.

A lower-cased text is the average of the embeddings of its hashed character 1-, 2- and 3-grams; a linear layer and a
softmax give the languages' probabilities. Embeddings and layer are trained by stochastic gradient descent in numpy on a bounded
sample; a part of the sample that training never sees sets the temperature of the softmax and the score
under which a prediction is rejected (accepted = false), so that accepted ones err as rarely as asked.

The sample: at most per_lang rows of each language (fewer where languages are so many that it would pass max_rows), max_bytes of text
each; of a language that has only longer texts, the shortest. The model has BUCKETS x DIM numbers and a column for each language. Whole texts are read for training and prediction.

Defined results: null text and texts without a letter are `und` with score 0 and not accepted; with nothing to learn
from, every text is `und`. Repeated rows are predicted alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.samples import chosen, fitting, held_out, texts

BUCKETS, DIM = 1 << 15, 8
LETTER = regex.compile(r"\p{L}")
PIECE = 1 << 20  # characters handled at once


def subwords(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of the character 1-, 2- and 3-grams, in pieces that overlap so that no gram is lost."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    for at in range(0, len(points), PIECE):
        c = points[at:at + PIECE + 2]
        one = c[:PIECE] * np.uint64(0x9E3779B97F4A7C15)
        two = (c[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[1:] * np.uint64(0x165667B19E3779F9))[:PIECE]
        three = (c[:-2] * np.uint64(0xD6E8FEB86659FD93) + c[1:-1] * np.uint64(0xA0761D6478BD642F) + c[2:] * np.uint64(0xE7037ED1A0B428DB))[:PIECE]
        yield ((np.concatenate([one, two, three]) ^ (np.concatenate([one, two, three]) >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49)).astype(np.int64)


def _average(text: str, table: np.ndarray) -> np.ndarray:
    total, n = np.zeros(table.shape[1]), 0
    for idx in subwords(text):
        total += table[idx].sum(0)
        n += len(idx)
    return total / max(1, n)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(sample: list[tuple[str, str]], epochs: int = 6, batch: int = 32, rate: float = 2.0, seed: int = 7, max_error: float = 0.01) -> dict | None:
    """Model from (text, lang) pairs."""
    sample = [(t, y) for t, y in sample if t and LETTER.search(t)]
    langs = sorted({y for _, y in sample})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    bags = []
    for t, _ in sample:
        values, counts = np.unique(np.concatenate(list(subwords(t))), return_counts=True)
        bags.append((values, (counts / counts.sum()).astype(np.float32)))
    y = np.array([langs.index(lang) for _, lang in sample])
    order = rng.permutation(len(sample))
    cut = len(sample) - len(sample) // 5
    fit, check = order[:cut], order[cut:] if len(sample) >= 10 else order
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    top, bias = rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in range(0, len(fit), batch):
            rows = fit[at:at + batch]
            hidden = np.stack([w @ emb[v] for v, w in (bags[i] for i in rows)])
            err = _softmax(hidden @ top + bias)
            err[np.arange(len(rows)), y[rows]] -= 1
            err /= len(rows)
            back = err @ top.T
            top -= step * hidden.T @ err
            bias -= step * err.sum(0)
            for k, i in enumerate(rows):
                v, w = bags[i]
                emb[v] -= (20 * step) * w[:, None] * back[k]
        rng.shuffle(fit)
    logits = np.stack([(w @ emb[v]) @ top + bias for v, w in (bags[i] for i in check)])
    truth = y[check]
    heats = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(_softmax(logits / h)[np.arange(len(truth)), truth], 1e-12)).mean() for h in heats]
    heat = float(heats[int(np.argmin(loss))])
    p = _softmax(logits / heat)
    best, right = p.max(1), p.argmax(1) == truth
    by = np.argsort(-best)
    errors = np.cumsum(~right[by]) / np.arange(1, len(by) + 1)
    fine = np.flatnonzero(errors <= max_error)
    return {"langs": langs, "table": ((emb @ top) / heat).astype(np.float32), "bias": (bias / heat).astype(np.float32), "reject": float(best[by[fine[-1]]]) if len(fine) else 1.0}


def learn(docs: DataFrame, per_lang: int = 500, max_rows: int = 100_000, max_bytes: int = 65536) -> dict | None:
    """Model from the text and lang of documents that samples.held_out doesn't name; every language with a letter in a text is learned."""
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    rows = fitting(usable.select("doc_id", "lang", F.octet_length("text").alias("size")), "lang", max_bytes)
    langs = usable.select("lang").distinct().count()
    found = texts(usable, chosen(rows, "lang", max(1, min(per_lang, max_rows // max(1, langs)))))
    return train([(r.text, r.lang) for r in sorted(found, key=lambda r: (r.lang, str(r.doc_id), r.text))])


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            langs, scores, accepted = [], [], []
            for text in batch["text"].to_pylist():
                if m is None or not text or not LETTER.search(text):
                    langs.append("und")
                    scores.append(0.0)
                    accepted.append(False)
                    continue
                p = _softmax(_average(text, m["table"]) + m["bias"])
                k = int(p.argmax())
                langs.append(m["langs"][k])
                scores.append(min(1.0, float(p[k])))
                accepted.append(bool(p[k] >= m["reject"]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())],
                                             ["doc_id", "lang_pred", "score", "accepted"])

    return run


def predicted(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows and as many columns as learned languages
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = base.mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double, accepted boolean")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")
