"""Plain single-process versions of the operators, for small fixtures only."""

from __future__ import annotations

import collections
import hashlib
import math


def words(text):
    return (text or "").encode().split()


def shingles(text, size):
    w = [x.lower() for x in words(text)]
    if not w:
        return set()
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))}


def components(docs, size, percent):
    """docs: {doc_id: text} -> {doc_id: component}"""
    sets = {d: shingles(t, size) for d, t in docs.items()}
    comp = {d: d for d in docs}
    ids = sorted(docs)

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {d: find(d) for d in docs}


def cut_words(docs, span):
    """docs: {doc_id: text} -> {doc_id: (n_words, kept words)}"""
    first = {}
    for d in sorted(docs):
        w = words(docs[d])
        for i in range(len(w) - span + 1):
            first.setdefault(tuple(w[i:i + span]), d)
    out = {}
    for d, t in docs.items():
        w = words(t)
        gone = set()
        for i in range(len(w) - span + 1):
            if first[tuple(w[i:i + span])] < d:
                gone.update(range(i, i + span))
        out[d] = (len(w), [x for i, x in enumerate(w) if i not in gone])
    return out


def cut_bytes(rows, length):
    """rows: [(doc_id, text)] -> [(n_bytes, n_removed, n_spans, sha of kept)]"""
    seen = collections.Counter()
    data = [(t or "").encode() for _, t, *_ in rows]
    for b in data:
        seen.update(b[i:i + length] for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def tiles(pattern, text, least):
    """Greedy string tiling by comparing every pair of positions."""
    free_p, free_t, total, n = [True] * len(pattern), [True] * len(text), 0, 0
    while True:
        best = (0, 0, 0)
        for p in range(len(pattern)):
            for t in range(len(text)):
                k = 0
                while p + k < len(pattern) and t + k < len(text) and free_p[p + k] and free_t[t + k] and pattern[p + k] == text[t + k]:
                    k += 1
                if k > best[0]:
                    best = (k, p, t)
        k, p, t = best
        if k < least:
            return total, n
        free_p[p:p + k] = [False] * k
        free_t[t:t + k] = [False] * k
        total, n = total + k, n + 1


def leaked(text, item, seed=5, coverage=0.5):
    p, t = [x.lower() for x in words(item)], [x.lower() for x in words(text)]
    return bool(p) and bool(t) and tiles(p, t, min(seed, len(p)))[0] >= coverage * len(p)


def measures(text):
    text = text or ""
    w = words(text)
    n = len(w)
    grams = [tuple(w[i:i + 5]) for i in range(n - 4)]
    often = {g for g, k in collections.Counter(grams).items() if k > 1}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return {"n_words": n, "word_chars": sum(len(x.decode()) for x in w), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_lines": len(lines),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len({j for i, g in enumerate(grams) if g in often for j in range(i, i + 5)}),
            "n_capitals": sum("A" <= c <= "Z" for c in text)}


def base_failed(m):
    return m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]


def rules_keep(rows):
    """rows: [(doc_id, text, lang, source)] -> set of kept positions"""
    tests = {"symbols": ("n_symbols", "n_words", 10, 30), "dup_lines": ("n_dup_lines", "n_lines", 25, 60), "repeats": ("n_repeat_words", "n_words", 10, 20),
             "shouting": ("n_capitals", "n_words", 20, 90)}
    ms = [measures(r[1]) for r in rows]
    cell = lambda m, k: min(500, m[tests[k][0]] * 1000 // max(1, m[tests[k][1]]) // 10)
    good = [i for i, m in enumerate(ms) if not base_failed(m)]
    kept = set()
    for i in good:
        groups = ([j for j in good if rows[j][2:] == rows[i][2:]], [j for j in good if rows[j][2] == rows[i][2]], good)
        ok = True
        for k in tests:
            *_, floor, limit = tests[k]
            for wide, g in zip((1, 2, 2), (good, *reversed(groups[:2])), strict=True):
                v = sorted(cell(ms[j], k) for j in g)
                mid, high = v[math.ceil(len(v) * 0.5) - 1], v[math.ceil(len(v) * 0.9) - 1]
                if g is good and wide == 1 or len(g) >= 200:
                    limit = min(max(mid + 8 * (high - mid), floor), wide * limit)
            ok &= cell(ms[i], k) <= limit
        if ok:
            kept.add(i)
    return kept


def poisson(mean, u):
    p = c = math.exp(-mean)
    k = 0
    while c <= u and k < mean + 12 * math.sqrt(mean) + 20:
        k += 1
        p = p * mean / k
        c += p
    return k


def counts(rows, temperature=0.7, seed=20240229):
    """rows: [(doc_id, text, source)] -> repetitions of each"""
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(t or "")
    weight = {s: n ** temperature if n else 0.0 for s, n in size.items()}
    total, mass = sum(size.values()), sum(weight.values())
    mean = {s: round(total * weight[s] / mass / n, 9) if n else 1.0 for s, n in size.items()}
    unit = lambda d: int(hashlib.md5(f"{seed}|{'null' if d is None else d}|0".encode()).hexdigest()[:13], 16) / (1 << 52)
    return [poisson(mean[s], unit(d)) for d, _, s in rows]
