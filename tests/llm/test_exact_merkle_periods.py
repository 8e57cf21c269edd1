"""Trie owners, Merkle manifests and periodic runs against plain versions, and on nulls, long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.llm import merkle, periods, queries, tries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, owner int, runs string, `a.b` int, tree int, idx string, n int, sha string, found int"
RNG = random.Random(2)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "r", 2, 3, "i", 4, "s", 5) for r in rows], SCHEMA).repartition(4)


def some_rows():
    long_ = " ".join(RNG.choice("abcd") for _ in range(30000))
    texts = ["a b", "ab", "a\tb\n", "a  b  ", "", None, " \n\x0b\x0c\r", "é b", "éb", "éb", "x" * 5000, "x" * 4999 + "y", long_, long_.replace(" ", "\n"), " ab", "abc", "a bc"]
    rows = [(i, t, ["en", "de", None][i % 3], ["hot", "hot", "ü", None, "a", ""][i % 6], len(t or "")) for i, t in enumerate(texts)]
    rows += [(30 + i, "la la " * (i % 7) + "end", "en", "hot", 5) for i in range(120)]
    rows += [(3, "a  b  ", "en", "hot", 6), (3, "a  b  ", "en", "hot", 6), (None, "ab", None, None, None), (None, None, None, "a", None)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return some_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


# ---- exact dedup
def plain_owners(rows):
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), d is None, d or 0))
    out = []
    for d, t, *_ in rows:
        g = groups[norm(t)]
        best = min(g)
        keep = None if best[1] else best[2]
        out.append((d, keep, len(g), len(g) == 1 or (d == keep and len(t or "") == -best[0]), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("memory", [128 << 20, 3000])
def test_owners_equal_plain_grouping(docs, rows, memory):
    got = tries.deduplicated(docs, memory=memory)
    assert got.select("_row.*").columns == docs.columns
    assert sorted((tuple(r) for r in got.select("_row.doc_id", "owner.*").collect()), key=str) == plain_owners(rows)


def test_trie_spills_its_largest_subtree_and_keeps_every_row():
    rng = random.Random(3)
    keys = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 9))).encode() for _ in range(3000)] + [b"\x00" * 9, b"\xff", b""]
    seen, passed = {}, 0
    for key, (n, points, doc) in tries._grown(((k, (1, len(k), i)) for i, k in enumerate(keys)), 20_000):
        seen[key] = tries.better(seen[key], (n, points, doc)) if key in seen else (n, points, doc)
        passed += 1
    assert seen == {k: (keys.count(k), len(k), keys.index(k)) for k in set(keys)} and passed > len(seen)
    trie = tries.Patricia()
    for k in (b"romane", b"romanus", b"rom", b"x"):
        trie.add(k, (1, 0, 0))
    size = trie.bytes()
    assert {k for k, _ in trie.spill()} == {b"romane", b"romanus", b"rom"} and trie.bytes() < size and {k for k, _ in trie.drain()} == {b"x"}


def test_texts_of_one_length_and_hash_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(tries.xxhash, "xxh3_64_intdigest", lambda key: 7)  # in this process only: the trie itself must tell them apart
    got = dict(tries._grown(((k, (1, 1, i)) for i, k in enumerate([b"aa", b"ab", b"aa"])), 1 << 20))
    assert got == {b"aa": (2, 1, 0), b"ab": (1, 1, 1)}


# ---- Merkle manifest
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(r, text):
    d, _, lang, source, n = r
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, text)))


def plain_tree(nodes):
    """root, and for each leaf its path of (before, after)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + 3] for i in range(0, len(nodes), 3)]
        for k, i in enumerate(at):
            run = runs[i // 3]
            paths[k].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1:])))
        at, nodes = [i // 3 for i in at], [H("".join(r)) for r in runs]
    return nodes[0], paths


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf_of(r, r[1]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    root, top = plain_tree([trees[g][0] for g in order])
    out = []
    for g, up in zip(order, top):
        for (_, _, leaf, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1]):
            x = leaf_of(r, r[1].replace("\n", "")) if r[1] and (r[0] or 0) % 2 == 0 else leaf
            for a, b in path + up:
                x = H(a + x + b)
            out.append((r[0], leaf, trees[g][0], root, H("".join(a + b for a, b in path + up)), x, x == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("part,levels", [(3 ** 7, 7), (10, 2), (1, 1)])
def test_manifest_equals_plain_trees(docs, rows, part, levels, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    even = F.coalesce(F.col("doc_id"), F.lit(0)) % 2 == 0
    got = merkle.manifest(docs, FIELDS, "source", "doc_id", {"text": F.replace("text", F.lit("\n"), F.lit(""))}, even & F.col("text").isNotNull(), part=part)
    have = sorted((tuple(r)[:7] for r in got.collect()), key=str)
    assert have == plain_manifest(rows) and {r[6] for r in have} == {True, False}


def test_proofs_prove_and_multiproofs_are_minimal(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 2}", 1) for i in range(50)]
    r = merkle.manifest(frame(spark, rows), FIELDS, "source", "doc_id", part=7).collect()
    assert len(r) == 50 and all(x.verified for x in r)
    for x in r:
        y = x.leaf
        for step in x.proof:
            y = H(step.before + y + step.after)
        assert y == x.root
    for n, known in ((10, [0, 1, 2]), (27, [5, 6]), (1, [0]), (28, [27]), (50, range(7, 14))):
        known = np.array(list(known))
        need = merkle.missing(known, n, 3)
        have, want = {(0, int(i)) for i in known}, set(need)
        for level in range(merkle.height(n, 3)):  # all that is derivable without fetching is not fetched
            size = -(-n // 3 ** level)
            for run in {i // 3 for lv, i in have if lv == level}:
                members = {(level, i) for i in range(run * 3, min(size, run * 3 + 3))}
                assert members - have <= want
                want -= members - have
                have.add((level + 1, run))
        assert not want and (merkle.height(n, 3), 0) in have


# ---- periodic runs
def plain_runs(w, least, exponent):
    out, n = set(), len(w)
    for q in range(1, n):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q) and not any((i, j + q - i, p) in out for p in range(1, q)):
                out.add((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_lyndon(s):
    best = lambda i: max(j for j in range(i + 1, len(s) + 1) if all(s[i:j] < s[k:j] for k in range(i + 1, j)))
    return [best(i) - i for i in range(len(s))]


def test_grouping_gives_lyndon_arrays():
    for n in range(1, 8):
        for s in itertools.product(range(3), repeat=n):
            _, ranks = np.unique(s, return_inverse=True)
            assert periods.lyndon_lengths(ranks.tolist()) == plain_lyndon(list(s))
    assert periods.lyndon_lengths([]) == []


@pytest.mark.parametrize("least,exponent", [(6, 4), (2, 2), (5, 3), (9, 2)])
def test_runs_equal_plain_search(least, exponent):
    find, rng = periods.Runs(least, exponent), random.Random(least)
    for _ in range(400):
        w = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 60))]
        for _ in range(2):
            a, p, m = rng.randrange(len(w) + 1), rng.randint(1, 7), rng.randint(0, 40)
            part = [rng.randrange(3) for _ in range(p)]
            w[a:a] = [part[i % p] for i in range(m)]
        assert find(np.array(w, np.int64)) == plain_runs(w, least, exponent)


def test_equal_hashes_do_not_make_runs(monkeypatch):
    find = periods.Runs(6, 4)
    w = np.array([1, 2] * 5 + [1, 3] + [5, 6, 5, 6], np.int64)
    monkeypatch.setattr(find.rolling, "spans", lambda sums, a, b: np.zeros(len(a), np.uint64))  # everything seems equal
    assert find(w) == plain_runs(w.tolist(), 6, 4)


def test_documents_get_their_runs(spark, docs, rows):
    got = periods.periodic_runs(docs)
    assert got.select("_row.*").columns == docs.columns
    have = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.found], r.collapsed) for r in got.select("_row.doc_id", "runs.*").collect()), key=str)
    want = []
    for d, t, *_ in rows:
        w = (t or "").encode().split()
        if len(w) > 5000:  # the plain search takes too long; random letters hold short runs only
            runs = [x for x in periods.Runs(6, 4)(np.unique(w, return_inverse=True)[1])]
            assert all(w[s + i] == w[s + i + q] for s, k, q in runs for i in range(k - q)) and runs
        else:
            runs = plain_runs(w, 6, 4)
        gone = {i for s, k, q in runs for i in range(s + q, s + k)}
        want.append((d, len(w), runs, b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    assert have == sorted(want, key=str)


def test_planted_repeats():
    for d in range(400):
        w = [str(i).encode() for i in range(d % 50)]
        h = __import__("zlib").crc32(str(d).encode())
        got = queries.planted(d, w)
        if h % 10 or not w:
            assert got == w
        else:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            assert got == [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    assert queries.planted(None, [b"a"]) == [b"a"]


@pytest.mark.parametrize("op", ["tries", "merkle", "periods"])
def test_empty_tables(spark, op):
    none = spark.createDataFrame([], SCHEMA)
    out = {"tries": lambda: tries.deduplicated(none), "merkle": lambda: merkle.manifest(none, FIELDS, "source", "doc_id"), "periods": lambda: periods.periodic_runs(none)}[op]()
    assert out.count() == 0


def test_no_words_and_wrong_parameters(spark):
    r = periods.periodic_runs(frame(spark, [(1, " ", None, None, None), (2, None, None, None, None)])).select("runs.*").collect()
    assert [(x.n_words, x.found, x.collapsed) for x in r] == [(0, [], "")] * 2
    for bad in ((1, 4), (6, 1)):
        with pytest.raises(ValueError):
            periods.Runs(*bad)
