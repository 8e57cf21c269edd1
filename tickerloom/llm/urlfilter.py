"""URL filter: allow and block rules, and for all other urls a logistic regression on hashed character n-grams.

A rule is `host/path`: it fits its host and all subdomains if the url's path starts with the rule's path; the longest
fitting rule wins (the first in alphabet on equal length). The regression learns from a small labelled url
table (url, block) by gradient descent whose gradients are DataFrame aggregates, and judges the urls that no rule fits.
Without a given table, a bounded number of distinct urls is labelled by the words of their host: block if one is in
BLOCK_WORDS.

All DataFrame functions. The driver holds FEATURES weights and the rules, whatever the number of urls; scoring
is one projection without a shuffle.

Defined results: urls of the labelled table with null label are left out; a null url or one without `://` has an empty host and path, which no rule fits; the regression
judges it like any other. Without labelled rows of both kinds the verdict is that of the only kind, else allow.
Repeated rows are judged alike; page_id may be null or repeat.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.tables import drop, written

FEATURES = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

#: host words of sites that training text should not come from
BLOCK_WORDS = ["ads", "adult", "bet", "bets", "betting", "casino", "casinos", "clickbait", "escort", "gambling", "jackpot", "loans", "lottery", "malware", "phishing", "pharma",
               "pills", "poker", "porn", "roulette", "scam", "sex", "slots", "spam", "tracker", "viagra", "warez", "xxx"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def winner(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The rule that wins, as struct (size, verdict, rule); null if none fits."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        on_host = (host == name) | host.endswith(f".{name}") if name else F.lit(True)
        fits.append(F.when(on_host & path.startswith(f"/{rest}"), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def _grams(text: Column, mark: str, sizes: tuple[int, ...]) -> Column:
    whole = F.concat(F.lit("^"), text, F.lit("$"))
    parts = [F.when(F.length(whole) >= n, F.transform(F.sequence(F.lit(1), F.length(whole) - n + 1), lambda i, n=n: F.pmod(F.xxhash64(F.lit(mark), F.substr(whole, i, F.lit(n))), F.lit(FEATURES)).cast("int")))
             .otherwise(F.array().cast("array<int>")) for n in sizes]
    return F.concat(*parts)


def features(host: Column, path: Column, sizes: tuple[int, ...] = (3, 4)) -> Column:
    """Distinct hashed n-grams of host and path; hashes of the two never mix their n-grams."""
    return F.array_distinct(F.concat(_grams(host, "h", sizes), _grams(path, "p", sizes)))


def _margin(grams: Column, weights: list[float], bias: float) -> Column:
    w = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    total = F.aggregate(grams, F.lit(0.0), lambda a, g: a + F.element_at(w, g + 1))
    return F.lit(bias) + total / F.sqrt(F.greatest(F.size(grams), F.lit(1)).cast("double"))


def train(labelled: DataFrame, steps: int = 30, rate: float = 1.0, ridge: float = 1e-4) -> tuple[list[float], float]:
    """Weights and bias from rows (grams, y): gradient descent with a step size for each weight (root of the summed squares)."""
    rows, path = written(labelled.select("grams", F.col("y").cast("double").alias("y")).coalesce(1), "url-sample")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if n == 0 or ones in (0, n):
        drop(rows.sparkSession, path)
        return [0.0] * FEATURES, -20.0 if ones == 0 else 20.0
    weights, seen = [0.0] * FEATURES, [1e-8] * FEATURES
    bias, seen_bias = 0.0, 1e-8
    share = F.when(F.col("y") == 1, 0.5 / ones).otherwise(0.5 / (n - ones))  # both kinds weigh the same
    for _ in range(steps):
        p = 1 / (1 + F.exp(-_margin(F.col("grams"), weights, bias)))
        pull = rows.select("grams", (share * (p - F.col("y"))).alias("e"), (1 / F.sqrt(F.greatest(F.size("grams"), F.lit(1)).cast("double"))).alias("x"))
        each = pull.select(F.explode("grams").alias("g"), (F.col("e") * F.col("x")).alias("d")).groupBy("g").agg(F.sum("d").alias("d"))
        grads = each.unionAll(pull.select(F.lit(-1).alias("g"), F.col("e").alias("d")).groupBy("g").agg(F.sum("d").alias("d"))).collect()  # FEATURES + 1 rows at most
        for r in grads:
            if r.g < 0:
                seen_bias += r.d * r.d
                bias -= rate * r.d / math.sqrt(seen_bias)
            else:
                d = r.d + ridge * weights[r.g]
                seen[r.g] += d * d
                weights[r.g] -= rate * d / math.sqrt(seen[r.g])
    drop(rows.sparkSession, path)
    return weights, bias


def word_labels(rows: DataFrame) -> DataFrame:
    """host, path, block for the distinct pairs of rows, by the words of the host."""
    words = F.split(F.col("host"), r"[.\-_:@]")
    return rows.where("host <> ''").select("host", "path").distinct().withColumn("block", F.arrays_overlap(words, F.array(*[F.lit(w) for w in BLOCK_WORDS])).cast("int"))


def sample(labelled: DataFrame, per_label: int = 1000) -> DataFrame:
    """The small labelled table as training rows: at most per_label of each label, by hash; a quarter of all urls stays out for tests."""
    pairs = labelled.where(~_kept_out()).withColumn("_o", F.md5(F.concat_ws("|", "host", "path")))
    kinds = [pairs.where(F.col("block") == v).orderBy("_o", "host", "path").limit(per_label) for v in (0, 1)]
    return kinds[0].unionAll(kinds[1]).select(features(F.col("host"), F.col("path")).alias("grams"), F.col("block").alias("y"))


def _kept_out() -> Column:
    return F.pmod(F.crc32(F.concat_ws("|", "host", "path").cast("binary")), F.lit(4)) == 2


def ruled(pages: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """page_id, host, path, and the winning rule with its verdict."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    return rows.withColumn("_w", winner(F.col("host"), F.col("path"), RULES if rules is None else rules)).select("page_id", "host", "path", F.col("_w.rule").alias("rule"), F.col("_w.verdict").alias("verdict"))


def judged(pages: DataFrame, rules: list[tuple[str, str]] | None = None, labelled: DataFrame | None = None, per_label: int = 1000) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score (the regression's probability of block, of every url)."""
    rows = ruled(pages, rules)
    if labelled is None:
        known = word_labels(rows)
    else:
        host, path = host_and_path(F.col("url"))
        known = labelled.where("block is not null").select(host.alias("host"), path.alias("path"), F.col("block").cast("int").alias("block")).distinct()
    weights, bias = train(sample(known, per_label))
    score = 1 / (1 + F.exp(-_margin(features(F.col("host"), F.col("path")), weights, bias)))
    scored = rows.withColumn("block_score", score)
    return scored.withColumn("verdict", F.coalesce("verdict", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")))
