"""Merkle manifest of a dataset: a tree over the rows of each group, one over the groups' roots, and a proof for each row.

H is SHA-256 (lowercase hex) of concatenated text, digests as hex. A leaf is H of the fields, each as byte count, colon,
value, and `-` where null. Per group leaves ascend by id (null first; ties by digest); every `fanout` consecutive nodes
become their H until one node is left, the group's root. The groups' roots, ordered by group (null first, UTF-8 bytewise),
are the leaves of the top tree in the same way.

Digests of the rows are written once, small rows from then on. A range sort and sums over its partitions number the
leaves, blocks of fanout^LEVELS nodes climb LEVELS levels in one task each, and all nodes are written by coordinate
(tree, level, idx). Proofs come as octopus multiproofs: the rows of a group are dealt in leaf partitions of `part`
consecutive leaves; for each the minimal union of coordinates that its own leaves can't derive is computed, fetched in one
join, and laid beside the leaves; the task derives the shared interiors and expands each leaf's proof from them. A group
that holds most rows is many blocks and leaf partitions.

Defined results: null ids come first; repeated rows are leaves of their own, in any order among equal ones (which changes
no digest of the tree); an empty table gives an empty table; further columns of docs are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.tables import drop, written

LEVELS = 7  # levels that one task climbs
TOP = "t"  # the tree over the groups; a group's tree is `s` with its name, or `n`
_NODE = "tree string, level int, idx long, n long, hash binary"  # n: nodes of the tree at that level


def H(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def digest(fields: list[Column]) -> Column:
    """H of the fields, as 32 bytes."""
    parts = []
    for c in fields:
        value = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def _numbered(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, list[str]]:
    """rows (with `tree`) with idx, their place in the order within the tree, and n, its size; written paths to drop.

    A range sort deals a large tree to many tasks; what goes before each of them is summed over one row a task and tree.
    """
    spark = rows.sparkSession
    keys = ["tree", *order]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    placed, path = written(ranged, f"{name}-sorted")
    task = F.shiftright("_id", 33)
    runs = placed.groupBy(task.alias("_task"), "tree").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    tree = Window.partitionBy("tree")
    before = F.sum("_n").over(tree.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("_task", "tree", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(tree).alias("n"))
    found = placed.withColumn("_task", task).join(runs, ["_task", "tree"])
    return found.withColumn("idx", F.col("_before") + F.col("_id") - F.col("_first")).drop("_task", "_first", "_before", "_id"), [path]


def _climb(base: int, fanout: int):
    """Task function over nodes of one level sorted by (tree, block, idx): all nodes of the next LEVELS levels above whole blocks."""
    block = fanout ** LEVELS

    def climbed(tree: str, at: int, n: int, nodes: list[str], out: list[tuple]) -> None:
        idx = at * block
        for level in range(base + 1, base + LEVELS + 1):
            if n == 1:
                return
            nodes = [H("".join(nodes[i:i + fanout])) for i in range(0, len(nodes), fanout)]
            idx, n = idx // fanout, -(-n // fanout)
            out += [(tree, level, idx + i, n, bytes.fromhex(x)) for i, x in enumerate(nodes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, held = None, 0, []
        out: list[tuple] = []
        for batch in batches:
            for tree, at, size, x in zip(*(batch[c].to_pylist() for c in ("tree", "block", "n", "hash")), strict=True):
                if (tree, at) != key:
                    if held:
                        climbed(*key, n, held, out)
                    key, n, held = (tree, at), size, []
                held.append(x.hex())
            yield _nodes(out)
            out = []
        if held:
            climbed(*key, n, held, out)
        yield _nodes(out)

    return run


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["tree", "level", "idx", "n", "hash"])


def height(n: int, fanout: int) -> int:
    """Levels above the leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def _built(leaves: DataFrame, fanout: int) -> list[DataFrame]:
    """All nodes above leaves (tree, idx, n, hash), in written tables."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    level, rows, out = 0, leaves, []
    while most > 1:
        block = F.floor(F.col("idx") / fanout ** LEVELS).alias("block")
        dealt = rows.where("n > 1").select("tree", block, "idx", "n", "hash").repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")
        nodes, _ = written(dealt.drop("idx").mapInArrow(_climb(level, fanout), _NODE), "merkle-nodes")
        out.append(nodes)
        most, level = -(-most // fanout ** LEVELS), level + LEVELS
        rows = nodes.where(F.col("level") == level)
    return out


def missing(known: np.ndarray, n: int, fanout: int) -> list[tuple[int, int]]:
    """(level, idx) of the fewest nodes that, with the known leaves (sorted) of a tree of n leaves, give its root."""
    out, level = [], 0
    while n > 1:
        runs = np.unique(known // fanout)
        members = (runs[:, None] * fanout + np.arange(fanout)).ravel()
        members = members[members < n]
        out += [(level, int(i)) for i in np.setdiff1d(members, known, assume_unique=True)]
        known, n, level = runs, -(-n // fanout), level + 1
    return out


def _wanted(part: int, fanout: int):
    """Task function over leaf partitions: the coordinates that each has to fetch, the top root among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, q, n, place, groups in zip(*(batch[c].to_pylist() for c in ("tree", "q", "n", "place", "groups")), strict=True):
                own = missing(np.arange(q * part, min(n, (q + 1) * part)), n, fanout)
                top = missing(np.array([place]), groups, fanout) + [(height(groups, fanout), 0)]
                rows = [(tree, *c) for c in own] + [(TOP, *c) for c in top]
                yield pa.RecordBatch.from_arrays([pa.array([tree] * len(rows), pa.string()), pa.array([q] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.string()),
                                                  pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()),
                                                  pa.array([n] * len(rows), pa.int64()), pa.array([place] * len(rows), pa.int64()), pa.array([groups] * len(rows), pa.int64())],
                                                 ["own", "q", "tree", "level", "idx", "n", "place", "groups"])

    return run


class _Paths:
    """Siblings of known nodes up to a tree's root: (left text, right text) by coordinate, and parents' digests."""

    def __init__(self, known: dict[int, str], fetched: dict[tuple[int, int], str], n: int, fanout: int):
        self.levels: list[dict[int, tuple[str, str]]] = []
        self.fanout, level = fanout, 0
        while n > 1:
            sides, up = {}, {}
            for r in dict.fromkeys(i // fanout for i in known):
                nodes = [known[i] if i in known else fetched[level, i] for i in range(r * fanout, min(n, (r + 1) * fanout))]
                for k in range(len(nodes)):
                    sides[r * fanout + k] = "".join(nodes[:k]), "".join(nodes[k + 1:])
                up[r] = H("".join(nodes))
            self.levels.append(sides)
            known, n, level = up, -(-n // fanout), level + 1
        self.root = next(iter(known.values()))

    def of(self, idx: int) -> list[tuple[str, str]]:
        out = []
        for sides in self.levels:
            out.append(sides[idx])
            idx //= self.fanout
        return out


_PROOF = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def _expanded(part: int, fanout: int, with_proofs: bool):
    """Task function over fetched nodes and leaves sorted by (own, q, kind, idx)."""

    def proven(own: str, sizes: tuple, fetched: dict, leaves: list[tuple]) -> pa.RecordBatch:
        n, place, groups = sizes
        local = _Paths({r[0]: r[2] for r in leaves}, {k[1:]: v for k, v in fetched.items() if k[0] == own}, n, fanout)
        at_top = {k[1:]: v for k, v in fetched.items() if k[0] == TOP}
        root = at_top[height(groups, fanout), 0]
        top = _Paths({place: local.root}, at_top, groups, fanout).of(place)
        proofs, shas, folded = [], [], []
        for idx, _, leaf, changed in leaves:
            path = local.of(idx) + top
            shas.append(H("".join(a + b for a, b in path)))
            x = changed or leaf
            for a, b in path:
                x = H(a + x + b)
            folded.append(x)
            proofs.append([{"before": a, "after": b} for a, b in path] if with_proofs else None)
        size = len(leaves)
        return pa.RecordBatch.from_arrays(
            [pa.array([r[1] for r in leaves], pa.int64()), pa.array([r[2] for r in leaves], pa.string()), pa.array([local.root] * size, pa.string()), pa.array([root] * size, pa.string()),
             pa.array(shas, pa.string()), pa.array(folded, pa.string()), pa.array([x == root for x in folded], pa.bool_()), pa.array(proofs, _PROOF)],
            ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sizes, fetched, leaves = None, None, {}, []
        columns = ("own", "q", "tree", "level", "idx", "hash", "id", "changed", "n", "place", "groups")
        for batch in batches:
            for own, q, tree, level, idx, x, id_, changed, *given in zip(*(batch[c].to_pylist() for c in columns), strict=True):
                if (own, q) != key:
                    if leaves:
                        yield proven(key[0], sizes, fetched, leaves)
                    key, fetched, leaves = (own, q), {}, []
                if tree is None:
                    leaves.append((idx, id_, x.hex(), changed.hex() if changed else None))
                else:
                    fetched[tree, level, idx], sizes = x.hex(), given
        if leaves:
            yield proven(key[0], sizes, fetched, leaves)

    return run


def manifest(docs: DataFrame, fields: list[str], group: str, id: str, changed: dict[str, Column] | None = None, when: Column | None = None, fanout: int = 3,
             part: int = 3 ** 7, with_proofs: bool = True) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256 (H of all siblings), proof (per level the text before and after the own digest;
    null if with_proofs is False), folded_root and verified.

    changed and when name columns to replace, and the rows to do it in, for the leaf that is folded with the row's own
    proof: verified says whether that still gives the root. Without them the original leaf is folded.
    """
    leaf = digest([F.col(f"`{c}`") for c in fields])
    other = digest([(changed or {}).get(c, F.col(f"`{c}`")) for c in fields])
    tree = F.coalesce(F.concat(F.lit("s"), F.col(f"`{group}`").cast("string")), F.lit("n"))
    rows = docs.select(tree.alias("tree"), F.col(f"`{id}`").cast("long").alias("id"), leaf.alias("hash"),
                       F.when(when if when is not None else F.lit(False), other).alias("changed"), F.monotonically_increasing_id().alias("tie"))
    leaves, leaves_path = written(rows, "merkle-leaves")
    numbered, old = _numbered(leaves, ["id", "hash", "tie"], "merkle")
    placed, _ = written(numbered.drop("tie"), "merkle-placed")
    drop(docs.sparkSession, leaves_path, *old)

    nodes = _built(placed, fanout)
    roots = placed.where("n = 1").select("tree", "hash")
    for t in nodes:
        roots = roots.unionAll(t.where("n = 1").select("tree", "hash"))
    in_top, old = _numbered(roots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("member"), "hash"), ["member"], "merkle-top")
    top, _ = written(in_top, "merkle-top")
    drop(docs.sparkSession, *old)

    sizes = placed.where("idx = 0").select("tree", "n")
    groups = sizes.join(top.select(F.col("member").alias("tree"), F.col("idx").alias("place"), F.col("n").alias("groups")), "tree")
    parts = groups.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / part))))
    wanted = parts.select("tree", "q", "n", "place", "groups").mapInArrow(_wanted(part, fanout), "own string, q long, tree string, level int, idx long, n long, place long, groups long")
    coordinates = ["tree", "level", "idx", "hash"]
    stored = placed.withColumn("level", F.lit(0)).select(*coordinates).unionAll(top.withColumn("level", F.lit(0)).select(*coordinates))
    for t in (*nodes, *_built(top, fanout)):
        stored = stored.unionAll(t.select(*coordinates))
    empty = lambda kind, name: F.lit(None).cast(kind).alias(name)
    fetched = wanted.join(stored, ["tree", "level", "idx"]).select("own", "q", "tree", "level", "idx", "hash", empty("long", "id"), empty("binary", "changed"), "n", "place", "groups")
    own = placed.select(F.col("tree").alias("own"), F.floor(F.col("idx") / part).alias("q"), empty("string", "tree"), empty("int", "level"), "idx", "hash", "id", "changed",
                        empty("long", "n"), empty("long", "place"), empty("long", "groups"))
    dealt = fetched.unionAll(own).repartition("own", "q").sortWithinPartitions("own", "q", F.col("tree").isNull(), "idx")
    return dealt.mapInArrow(_expanded(part, fanout, with_proofs), "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, "
                                                                  "proof array<struct<before:string,after:string>>")
