"""Exact dedup by Patricia tries: each set of equal texts gets the row that owns it.

Texts are normalised (white space of `BLANK` deleted) and dealt by a hash of their length and content. Each task inserts
whole byte strings into a compressed radix trie; a terminal holds the number of rows, and of the row to stay its code
points and doc_id. Map tasks do the same over what they read, so a text that very many rows share leaves each of them
once. A trie over `memory` bytes gives up its largest subtree: the terminals there go on to the next shuffle as partial
sums and may arise again later, so memory is bounded, and nothing lies on an executor's own disk. Partial owners meet by
SHA-256 and length, and rows find their owner in a join on small columns that Spark may split where one text is hot.

Of equal texts the row with the most code points in the original text stays, then the one with the smallest doc_id (null
after all others). Defined results: null counts as empty, and all texts without other characters than white space are
equal; rows that agree in doc_id, code points and text are one document and share its verdict; an empty table gives an
empty table; extra columns are carried along in `_row`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.llm.tables import written

BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
NODE = 400  # bytes that a node takes besides its label
SLICE = 256  # rows handed on at once


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Node:
    __slots__ = ("label", "children", "owner")

    def __init__(self, label: bytes, owner: tuple | None = None):
        self.label, self.children, self.owner = label, {}, owner


def better(a: tuple, b: tuple) -> tuple:
    """(n, points, doc_id) of both sets together."""
    pick = min((-a[1], a[2] is None, a[2] or 0), (-b[1], b[2] is None, b[2] or 0))
    return a[0] + b[0], -pick[0], None if pick[1] else pick[2]


class Patricia:
    """Compressed radix trie over byte strings with an owner at each terminal."""

    def __init__(self):
        self.root, self.sizes = Node(b""), {}  # bytes by subtree, that is by first byte

    def add(self, key: bytes, owner: tuple) -> None:
        node, at, n = self.root, 0, len(key)
        grown = 0
        while at < n:
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                grown += n - at + NODE
                node, at = child, n
            elif key.startswith(child.label, at):
                node, at = child, at + len(child.label)
            else:
                k = _shared(child.label, key[at:at + len(child.label)])
                fork = node.children[key[at]] = Node(child.label[:k])
                child.label = child.label[k:]
                fork.children[child.label[0]] = child
                grown += NODE
                node, at = fork, at + k
        node.owner = better(node.owner, owner) if node.owner else owner
        if grown:
            self.sizes[key[0]] = self.sizes.get(key[0], 0) + grown

    def bytes(self) -> int:
        return sum(self.sizes.values())

    def _terminals(self, node: Node, prefix: bytes) -> Iterator[tuple[bytes, tuple]]:
        todo = [(node, prefix)]
        while todo:
            node, prefix = todo.pop()
            if node.owner:
                yield prefix, node.owner
            todo += [(child, prefix + child.label) for child in node.children.values()]

    def spill(self) -> Iterator[tuple[bytes, tuple]]:
        """Takes the largest subtree out."""
        first = max(self.sizes, key=self.sizes.get)
        del self.sizes[first]
        child = self.root.children.pop(first)
        return self._terminals(child, child.label)

    def drain(self) -> Iterator[tuple[bytes, tuple]]:
        return self._terminals(self.root, b"")


def _grown(rows: Iterator[tuple[bytes, tuple]], memory: int) -> Iterator[tuple[bytes, tuple]]:
    """All rows through one trie; terminals leave when their subtree spills, or at the end."""
    trie = Patricia()
    for key, owner in rows:
        trie.add(key, owner)
        while trie.bytes() > memory:
            yield from trie.spill()
    yield from trie.drain()


def _slices(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[0])
        if len(held) >= SLICE or size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


_TEXT = ["key", "length", "content", "n", "points", "doc_id"]
_OWNER = ["sha", "length", "n", "points", "doc_id"]


def _normalised(batch: pa.RecordBatch) -> list[bytes]:
    return [text.translate(None, BLANK) if text else b"" for text in batch["text"].cast(pa.binary()).to_pylist()]


def _read(memory: int):
    """Task function over documents: the distinct normalised texts among them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, tuple]]:
        for batch in batches:
            points = pc.fill_null(pc.utf8_length(batch["text"]), 0).to_pylist()
            yield from zip(_normalised(batch), zip([1] * len(points), points, batch["doc_id"].to_pylist(), strict=True), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = ((key, len(key), xxhash.xxh3_64_intdigest(key) - (1 << 63), *owner) for key, owner in _grown(rows(batches), memory))
        yield from _slices(out, _TEXT, [pa.binary(), *[pa.int64()] * 5])

    return run


def _own(memory: int):
    """Task function over distinct texts of map tasks: their owners."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, tuple]]:
        for batch in batches:
            yield from zip(batch["key"].to_pylist(), zip(*(batch[c].to_pylist() for c in ("n", "points", "doc_id")), strict=True), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = ((hashlib.sha256(key).digest(), len(key), *owner) for key, owner in _grown(rows(batches), memory))
        yield from _slices(out, _OWNER, [pa.binary(), *[pa.int64()] * 4])

    return run


def owners(docs: DataFrame, memory: int = 128 << 20) -> DataFrame:
    """sha (of the normalised text), length (its bytes), n (rows), points and doc_id of the row that stays: one row for each distinct text."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = base.mapInArrow(_read(memory), "key binary, length long, content long, n long, points long, doc_id long")
    dealt = texts.repartition("length", "content")
    parts = dealt.mapInArrow(_own(memory), "sha binary, length long, n long, points long, doc_id long")
    best = F.min(F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("none"), "doc_id"))
    whole = parts.groupBy("sha", "length").agg(F.sum("n").alias("n"), best.alias("best"))
    return whole.select("sha", "length", "n", (-F.col("best.points")).alias("points"), F.col("best.doc_id").alias("doc_id"))


def deduplicated(docs: DataFrame, carry: list[str] | None = None, memory: int = 128 << 20) -> DataFrame:
    """_row (struct of the columns in carry; all by default) and owner: struct of keep_id, group_size, kept, text_sha256."""
    carried = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)])
    base = docs.select(carried.alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _normalised(batch)
            yield pa.RecordBatch.from_arrays([batch["_row"], batch["doc_id"], pc.fill_null(pc.utf8_length(batch["text"]), 0).cast(pa.int64()),
                                              pa.array([len(k) for k in keys], pa.int64()), pa.array([hashlib.sha256(k).digest() for k in keys], pa.binary())],
                                             ["_row", "doc_id", "points", "length", "sha"])

    schema = T.StructType(base.schema.fields[:2]).add("points", "long", False).add("length", "long", False).add("sha", "binary", False)
    rows = base.mapInArrow(digests, schema)
    # groups of several rows only, written so that the join reads them from an exchange of its own and can split a hot text
    several, _ = written(owners(docs, memory).where("n > 1"), "owners")
    shared = several.select(F.col("sha").alias("_sha"), F.col("length").alias("_length"), "n", F.col("points").alias("most"), F.col("doc_id").alias("keep_id"))
    found = rows.join(shared, (F.col("sha") == F.col("_sha")) & (F.col("length") == F.col("_length")), "left")
    alone = F.col("n").isNull()
    stays = F.when(alone, F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("most")))
    return found.select("_row", F.struct(F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                                         stays.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")).alias("owner"))
