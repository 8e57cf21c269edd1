"""Jaccard self-join of word n-gram sets with set-relation skipping.

Two documents link when 100 * |intersection| >= percent * |union| of their distinct shingles.
Equal sets collapse into one class first. Shingles are ordered rarest first by a count sketch of
fixed size over the whole corpus (the order only steers the work, any order is correct), and
each class indexes the prefix in which every partner must share a shingle. Index lists are cut
into blocks by size and position; a block whose size, position or parity-bitmap bound rules
its pairs out is skipped. Round one asks each list's best connected set (leader) about the
others; whoever links to it takes over its answers, being in one component. Round two tests
only pairs that still lie in different components, in all blocks, so no component is lost.
Linked sets are then in one component, so all links are made inside components: each pair of classes of a component is
compared once, on whole texts, in tasks over pairs of bounded parts of the component. They send on only counts for each class,
which is weighed by its number of documents; linked_pairs() gives the links themselves.

n_links of a row: how many other (document, set) pairs link with its set, equal sets of other documents included. Where each
doc_id has one text this is the number of linked documents.

Defined results: null, empty and blank texts have an empty set and link with nothing; fewer
words than a shingle count as one shingle; rows that share a doc_id are one document with
several texts; a row without doc_id gets its own n_shingles and a null component and number of links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.components import components
from tickerloom.llm.hashing import Rolling, WordHashes, mix, signed
from tickerloom.llm.tables import drop, release, written

SLOTS, BLOCK = 1 << 21, 1 << 12  # the count sketch: 2^21 counters whatever the corpus size, sent in blocks
BITS = 1024  # of a parity bitmap
MEMBERS = 2000  # of a block of an index list
PART, PART_SHINGLES = 500, 2_000_000  # classes and shingles of a part of a component


def shingles(text: str | None, size: int, hashes: WordHashes, rolling: Rolling) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text, A-Z lower-cased."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    width = min(size, len(words))
    return np.unique(rolling.windows(rolling.prefix(hashes.array(words)), width) + np.uint64(size - width))


def _parity(s: np.ndarray) -> bytes:
    return np.packbits((np.bincount((s >> np.uint64(7)).astype(np.int64) & (BITS - 1), minlength=BITS) & 1).astype(np.uint8)).tobytes()


def _describe(size: int):
    """Task function: size and fingerprint of each document's set, and the task's share of the count sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rolling, counts = WordHashes(), Rolling(), np.zeros(SLOTS, np.int32)
        for batch in batches:
            ns, f1, f2 = [], [], []
            for text in batch["text"].to_pylist():
                s = shingles(text, size, hashes, rolling)
                for column, value in zip((ns, f1, f2), _fingerprint(s), strict=True):
                    column.append(value)
                np.add.at(counts, (s & np.uint64(SLOTS - 1)).astype(np.int64), 1)
            k = len(ns)
            yield pa.RecordBatch.from_arrays([pa.array(["set"] * k, pa.string()), batch["doc_id"], pa.array(ns, pa.int32()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()),
                                              pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], _DESCRIBED)
        at = np.flatnonzero(counts)
        cuts = np.searchsorted(at, np.arange(0, SLOTS + 1, BLOCK))
        full = [b for b in range(SLOTS // BLOCK) if cuts[b + 1] > cuts[b]]
        k = len(full)
        places = [(at[cuts[b]:cuts[b + 1]] - b * BLOCK).astype(np.int16).tobytes() for b in full]
        values = [counts[at[cuts[b]:cuts[b + 1]]].tobytes() for b in full]
        yield pa.RecordBatch.from_arrays([pa.array(["sketch"] * k, pa.string()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()),
                                          pa.array(full, pa.int32()), pa.array(places, pa.binary()), pa.array(values, pa.binary())], _DESCRIBED)

    return run


_DESCRIBED = ["step", "doc_id", "n", "f1", "f2", "block", "places", "counts"]


def _merge_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, places, counts in zip(batch["block"].to_pylist(), batch["places"].to_pylist(), batch["counts"].to_pylist(), strict=True):
            total.setdefault(b, np.zeros(BLOCK, np.int64))[np.frombuffer(places, np.int16)] += np.frombuffer(counts, np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.astype("<u4").tobytes() for v in total.values()], pa.binary())], ["block", "counts"])


def _prefixes(size: int, percent: int, order):
    """Task function: the rarest shingles of each set, in which any partner shares at least one; equal sets of a task go once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rolling, rank, seen = WordHashes(), Rolling(), order.value, set()
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                s = shingles(text, size, hashes, rolling)
                n = len(s)
                if not n or doc is None:
                    continue
                f = int(s.sum(dtype=np.uint64).view(np.int64))
                if f in seen:
                    continue
                if len(seen) >= 500_000:
                    seen.clear()
                seen.add(f)
                k = n - (percent * n + 99) // 100 + 1
                counts = rank[(s & np.uint64(SLOTS - 1)).astype(np.int64)]
                first = s[np.lexsort((s, counts))[:k]]
                out.append((first, doc, n, f))
            if not out:
                continue
            sizes = [len(o[0]) for o in out]
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(np.concatenate([o[0] for o in out]))), *(pa.array(np.repeat(np.array([o[c] for o in out], kind), sizes)) for c, kind in ((1, np.int64), (2, np.int32), (3, np.int64))),
                 pa.array(np.concatenate([np.arange(x, dtype=np.int32) for x in sizes]))], ["token", "doc_id", "n", "f1", "p"])

    return run


def _bitmaps(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rolling = WordHashes(), Rolling()
        for batch in batches:
            bits = [_parity(shingles(t, size, hashes, rolling)) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(bits, pa.binary())], ["doc_id", "bits"])

    return run


def _passing(n: np.ndarray, p: np.ndarray, bits: np.ndarray, percent: int, rows: slice) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of rows x all no bound rules out, and their parity distance."""
    nx, ny = n[rows, None], n[None, :]
    total = nx + ny
    may = 100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)
    may &= (100 + percent) * np.minimum((n - p)[rows, None], (n - p)[None, :]) >= percent * total
    far = np.full(may.shape, 1 << 30, np.int64)
    x, y = np.nonzero(may)
    for at in range(0, len(x), 100_000):
        a, b = x[at:at + 100_000], y[at:at + 100_000]
        far[a, b] = np.bitwise_count(bits[rows][a] ^ bits[b]).sum(1, dtype=np.int64)
    return may & ((100 + percent) * far <= (100 - percent) * total), far


def _pairs(percent: int, every: bool):
    """Task function over blocks of index lists: candidate pairs. every=False: the leader's, and the nearest of those it can't answer for;
    every=True: all between different components."""

    def block(doc, n, p, bits, comp) -> list[tuple[np.ndarray, np.ndarray]]:
        m, found = len(doc), []
        if m < 2 or (comp == comp[0]).all():
            return found
        step = max(1, 500_000 // m)
        if every:
            for at in range(0, m, step):
                rows = slice(at, min(m, at + step))
                ok, _ = _passing(n, p, bits, percent, rows)
                x, y = np.nonzero(ok & (comp[rows, None] != comp[None, :]) & (doc[rows, None] < doc[None, :]))
                found.append((doc[x + at], doc[y]))
            return found
        degree, near = np.zeros(m, np.int64), np.full(m, -1)
        for at in range(0, m, step):
            rows = slice(at, min(m, at + step))
            ok, far = _passing(n, p, bits, percent, rows)
            ok &= doc[rows, None] != doc[None, :]
            degree[rows] = ok.sum(1)
            near[rows] = np.where(ok.any(1), np.where(ok, far, 1 << 40).argmin(1), -1)
        lead = int(degree.argmax())
        if degree[lead]:
            ok, _ = _passing(n, p, bits, percent, slice(lead, lead + 1))
            ok = ok[0] & (doc != doc[lead])
            with_lead = np.flatnonzero(ok)
            rest = np.flatnonzero(~ok & (near >= 0))
            found += [(doc[with_lead], np.full(len(with_lead), doc[lead])), (doc[rest], doc[near[rest]])]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for last, cols in _with_end(_columns(b) for b in batches):
            held = cols if held is None else tuple(np.concatenate(x) for x in zip(held, cols, strict=True))
            key = held[0]
            if not len(key):
                continue
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            ends = np.r_[starts[1:], len(key)]
            whole = len(starts) if last else len(starts) - 1
            found = [x for a, b in zip(starts[:whole], ends[:whole], strict=True) if b - a > 1 for x in block(*(c[a:b] for c in held[1:]))]
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                lo, hi = np.minimum(a, b), np.maximum(a, b)
                both = np.unique(np.stack([lo, hi], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])
            held = tuple(c[starts[whole]:] for c in held) if whole < len(starts) else None

    return run


def _columns(batch: pa.RecordBatch) -> tuple:
    bits = np.frombuffer(b"".join(batch["bits"].to_pylist()), np.uint64).reshape(-1, BITS // 64)
    return (batch["key"].to_numpy(), batch["doc_id"].to_numpy(), batch["n"].to_numpy().astype(np.int64), batch["p"].to_numpy().astype(np.int64), bits, batch["comp"].to_numpy())


def _with_end(items):
    items = iter(items)
    held = next(items, None)
    for x in items:
        yield False, held
        held = x
    if held is not None:
        yield True, held


def _verify(size: int, percent: int):
    """Task function: the pairs of texts that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rolling, kept = WordHashes(), Rolling(), (None, None)
        for batch in batches:
            a, b = batch["a"].to_pylist(), batch["b"].to_pylist()
            ok = []
            for left, right in zip(batch["text_a"].to_pylist(), batch["text_b"].to_pylist(), strict=True):
                if left != kept[0]:
                    kept = (left, shingles(left, size, hashes, rolling))
                y = shingles(right, size, hashes, rolling)
                common = len(np.intersect1d(kept[1], y, assume_unique=True))
                ok.append(common > 0 and 100 * common >= percent * (len(kept[1]) + len(y) - common))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, k in zip(a, ok, strict=True) if k], pa.int64()), pa.array([x for x, k in zip(b, ok, strict=True) if k], pa.int64())], ["u", "v"])

    return run


def _sparse(total: np.ndarray, order: np.ndarray, starts: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> None:
    """Adds, for each shingle that starts a run of `rows` in `order`, one to every pair of its rows."""
    m = len(total)
    for c in np.unique(counts):
        at = starts[counts == c]
        step = max(1, 2_000_000 // int(c * c))
        for k in range(0, len(at), step):
            r = rows[order[at[k:k + step, None] + np.arange(c)]]
            total += np.bincount((r[:, :, None] * m + r[:, None, :]).ravel(), minlength=m * m).reshape(m, m)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets of distinct hashes. Shingles that few sets have, or few lack, cost the square of those few."""
    m = len(sets)
    rows = np.repeat(np.arange(m), [len(s) for s in sets])
    _, token, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(token, kind="stable")
    starts = np.cumsum(counts) - counts
    few = m // 20
    total = np.full((m, m), int((counts == m).sum()), np.int64)
    rare = (counts > 1) & (counts <= few)
    _sparse(total, order, starts[rare], counts[rare], rows)
    others = np.flatnonzero((counts > max(1, few)) & (counts < m))
    step = max(64, 8_000_000 // m)
    for at in range(0, len(others), step):
        cols = others[at:at + step]
        has = np.zeros((len(cols), m), bool)
        has[np.repeat(np.arange(len(cols)), counts[cols]), rows[order[np.concatenate([np.arange(a, a + c) for a, c in zip(starts[cols], counts[cols], strict=True)])]]] = True
        most = counts[cols] >= m - few
        if most.any():
            col, row = np.nonzero(~has[most])
            lacks = np.bincount(row, minlength=m)
            total += int(most.sum()) - lacks[:, None] - lacks[None, :]
            lost = np.bincount(col)
            lost = lost[lost > 0]
            _sparse(total, np.arange(len(row)), np.cumsum(lost) - lost, lost, row)
        dense = has[~most].astype(np.float32)  # sums of at most `step` ones are exact
        total += (dense.T @ dense).astype(np.int64)
    np.fill_diagonal(total, [len(s) for s in sets])
    return total


def _named(size: int):
    """Task function: size and fingerprint of each text's set beside the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rolling = WordHashes(), Rolling()
        for batch in batches:
            keys = [_fingerprint(shingles(t, size, hashes, rolling)) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([k[c] for k in keys], kind) for c, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))), batch["text"]], ["n", "f1", "f2", "text"])

    return run


def _fingerprint(s: np.ndarray) -> tuple[int, int, int]:
    if not len(s):
        return 0, 0, 0
    return len(s), int(s.sum(dtype=np.uint64).view(np.int64)), int(mix(s + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).view(np.int64))


def _links(size: int, percent: int, pairs: bool):
    """Task function over pairs of parts of components, sorted by them: the linked pairs of classes, or each class's linked documents."""

    def block(key: tuple, members: dict, hashes: WordHashes, rolling: Rolling):
        _, low, high = key
        if len(members) < 2:
            return None
        names = list(members)
        part, copies, rep = (np.array([members[k][c] for k in names], np.int64) for c in range(3))
        sets = [shingles(members[k][3], size, hashes, rolling) for k in names]
        n = np.array([len(s) for s in sets], np.int64)
        common = intersections(sets)
        ok = (common > 0) & (100 * common >= percent * (n[:, None] + n[None, :] - common))
        np.fill_diagonal(ok, False)
        if low != high:
            ok &= part[:, None] != part[None, :]
        if pairs:
            x, y = np.nonzero(np.triu(ok))
            return np.minimum(rep[x], rep[y]), np.maximum(rep[x], rep[y])
        found = ok @ copies
        at = np.flatnonzero(found)
        return (*(np.array([names[i][c] for i in at], np.int64) for c in range(3)), found[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rolling, key, members = WordHashes(), Rolling(), None, {}
        columns = ["a", "b"] if pairs else ["n", "f1", "f2", "linked"]

        def out(blocks):
            blocks = [b for b in blocks if b is not None and len(b[0])]
            if blocks:
                arrays = [np.concatenate(c) for c in zip(*blocks, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32) if c == "n" else x) for c, x in zip(columns, arrays, strict=True)], columns)

        for batch in batches:
            blocks = []
            for comp, low, high, part, n, f1, f2, copies, rep, text in zip(*(batch[c].to_pylist() for c in _PART), strict=True):
                if (comp, low, high) != key:
                    if key:
                        blocks.append(block(key, members, hashes, rolling))
                    key, members = (comp, low, high), {}
                members[n, f1, f2] = (part, copies, rep, text)  # equal sets come once
            yield from out(blocks)
        if key:
            yield from out([block(key, members, hashes, rolling)])

    return run


_PART = ["comp", "low", "high", "part", "n", "f1", "f2", "copies", "rep", "text"]


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included), n_links for every row of docs.

    links=False is for who needs the components only: no n_links, and links inside a component are not all tested.
    """
    return _joined(docs, shingle, percent, "counts" if links else None)


def linked_pairs(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """a, b: the links between different sets, each set given by its smallest doc_id (two sets of one document may share it), a <= b.

    Documents with equal sets link too and are not listed. As many rows as there are links: the square of a group's size.
    """
    return _joined(docs, shingle, percent, "pairs")


def _joined(docs: DataFrame, shingle: int, percent: int, links: str | None) -> DataFrame:
    if not 0 < percent <= 100:
        raise ValueError("percent must be in (0, 100]")
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described, _ = written(base.mapInArrow(_describe(shingle), "step string, doc_id long, n int, f1 long, f2 long, block int, places binary, counts binary"), "sets", ["step"])
    sketch = (described.where("step = 'sketch'").select("block", "places", "counts").repartition(8, "block")
              .mapInArrow(_merge_sketch, "block int, counts binary"))
    rank = np.zeros(SLOTS, np.uint32)
    for row in sketch.collect():  # SLOTS counters, however large the corpus
        rank[row.block * BLOCK:(row.block + 1) * BLOCK] = np.frombuffer(row.counts, np.uint32)
    order = spark.sparkContext.broadcast(rank)

    sets = described.where("step = 'set'").select("doc_id", "n", "f1", "f2")
    classes = (sets.where("n > 0 and doc_id is not null").distinct().groupBy("n", "f1", "f2")
               .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    if links:
        classes, classes_path = written(classes, "classes")

    entries = (base.mapInArrow(_prefixes(shingle, percent, order), "token long, doc_id long, n int, f1 long, p int").repartition("token")
               .groupBy("token", "f1").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("p").alias("p")))
    by_size = Window.partitionBy("token").orderBy("n")
    fits = (100 * F.lag("n").over(by_size) >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.lead("n").over(by_size))
    near = entries.withColumn("near", F.coalesce(fits, F.lit(False))).where("near").drop("near")  # others have no partner of a fitting size in this list
    lists, lists_path = written(near.withColumn("members", F.count("*").over(Window.partitionBy("token"))).select("token", "doc_id", "n", "p", "members"), "lists")
    order.unpersist()
    suspects = lists.select("doc_id").distinct()
    texts, texts_path = written(base.join(suspects, "doc_id", "left_semi").distinct(), "suspects")
    bits = texts.mapInArrow(_bitmaps(shingle), "doc_id long, bits binary")
    indexed, indexed_path = written(lists.join(bits, "doc_id"), "index")
    drop(spark, lists_path)

    def verified(candidates: DataFrame) -> DataFrame:
        with_b = candidates.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        full = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        return full.select("a", "b", "text_a", "text_b").mapInArrow(_verify(shingle, percent), "u long, v long")

    def candidates(rows: DataFrame, every: bool) -> DataFrame:
        keyed = rows.repartition("key").sortWithinPartitions("key", "n", "p").select("key", "doc_id", "n", "p", "bits", "comp")
        return keyed.mapInArrow(_pairs(percent, every), "a long, b long").where("a <> b").distinct()

    blocks = F.ceil(F.col("members") / F.lit(MEMBERS)).cast("int")
    part = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    one = indexed.withColumn("comp", F.col("doc_id")).withColumn("key", F.when(blocks == 1, F.col("token")).otherwise(F.xxhash64("token", part)))
    # rows that share a doc_id are linked by it; equal sets by their class
    some, some_path = written(verified(candidates(one, False)), "links")
    first = components(some)
    tied = indexed.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component")
    mixed = tied.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("token")
    open_lists = (tied.join(mixed, "token", "left_semi").withColumn("part", part)
                  .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
                  .withColumn("key", F.when(blocks == 1, F.col("token")).otherwise(F.xxhash64("token", F.least("part", "other"), F.greatest("part", "other")))))
    more, more_path = written(verified(candidates(open_lists, True)), "links")
    drop(spark, indexed_path)

    same = sets.where("doc_id is not null and n > 0").join(classes, ["n", "f1", "f2"]).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    final = components(some.unionAll(more).unionAll(same))
    drop(spark, some_path, more_path)
    release(spark)
    rows = sets.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    columns = ["doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")]
    if not links:
        drop(spark, texts_path)
        return rows.select(*columns)

    owned = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    sizes = owned.groupBy("comp").agg(F.count("*").alias("m"), F.sum("n").alias("all")).where("m > 1")
    parts = F.ceil(F.greatest(F.col("m") / F.lit(PART), F.col("all") / F.lit(PART_SHINGLES))).cast("int")
    members = owned.join(sizes, "comp").select("*", parts.alias("parts")).withColumn("part", F.pmod(F.xxhash64("n", "f1", "f2"), F.col("parts")).cast("int"))
    whole = (texts.mapInArrow(_named(shingle), "n int, f1 long, f2 long, text string").join(members, ["n", "f1", "f2"])
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("comp", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "n", "f1", "f2", "copies", "rep", "text")
             .repartition("comp", "low", "high").sortWithinPartitions("comp", "low", "high"))
    made, _ = written(whole.mapInArrow(_links(shingle, percent, links == "pairs"), "a long, b long" if links == "pairs" else "n int, f1 long, f2 long, linked long"), "links")
    drop(spark, texts_path)
    if links == "pairs":
        return made
    linked = classes.join(made.groupBy("n", "f1", "f2").agg(F.sum("linked").alias("linked")), ["n", "f1", "f2"], "left")
    counts, _ = written(linked.select("n", "f1", "f2", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")), "counts")
    drop(spark, classes_path)
    return rows.join(counts, ["n", "f1", "f2"], "left").select(
        *columns, F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).alias("n_links"))
