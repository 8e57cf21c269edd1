"""Rolling mentions from hourly counts, point-in-time quotes, white space in headlines, even rank bins, unlimited search."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from tickerloom.operators import fundamentals, lookups, macro, news
from tickerloom.streaming import bars


def test_rolling_mentions_equal_sliding_windows(spark):
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.choice("ABC"), start + dt.timedelta(minutes=rng.randrange(5 * 1440))) for _ in range(400)]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp")
    until = start + dt.timedelta(days=4, minutes=17)
    hourly = bars.mention_counts(ticks)
    got = bars.rolling_mentions(hourly, spark.createDataFrame([(until,)], "until timestamp"))
    want = ticks.groupBy("symbol", F.window("ts", "24 hours", "1 hour").alias("w")).count().where(F.col("w.end") <= F.lit(until))
    assert {tuple(r) for r in got.select("symbol", "start", "mentions").collect()} == {tuple(r) for r in want.select("symbol", "w.start", "count").collect()}
    assert bars.rolling_mentions(hourly, spark.createDataFrame([], "until timestamp")).count() == 0


def test_context_reads_no_later_quotes(spark):
    day = dt.date(2024, 3, 1)
    quotes = spark.createDataFrame([("vix", day + dt.timedelta(days=i), 10.0 + i) for i in range(40)], "series string, d date, close double")
    for back in (0, 5, 25):
        seen = macro.context(quotes, day + dt.timedelta(days=39 - back)).first()
        cut = macro.context(quotes.where(F.col("d") <= F.lit(day + dt.timedelta(days=39 - back))), day + dt.timedelta(days=39 - back)).first()
        assert seen == cut
    assert macro.context(quotes, day).first()["vix"] == 10.0


def test_tokens_split_on_any_white_space(spark):
    titles = spark.createDataFrame([("Profit beats, record.\u0085win\x1closs",)], "title string")
    assert titles.select(news.tokens("title")).first()[0] == ["profit", "beats", "record", "win", "loss"]


def test_magic_formula_equals_plain_ranks(spark):
    rng = random.Random(6)
    rows = [(f"S{i}", i, float(rng.randrange(-5, 40)), float(rng.choice([0, 50, 100, 200])), rng.choice([None, 0.1, 0.2, rng.random()])) for i in range(300)]
    df = spark.createDataFrame(rows, "symbol string, ord int, ebitda double, enterprise_value double, roa double")
    got = {r.symbol: r.magic_score for r in fundamentals.magic_formula(df).collect()}
    ey = sorted((-(r[2] / r[3]), r[1], r[0]) for r in rows if r[3] > 0)
    roa = sorted((-r[4], r[1], r[0]) for r in rows if r[4] is not None)
    first, second = ({s: i + 1 for i, (*_, s) in enumerate(x)} for x in (ey, roa))
    total = sorted((first[r[0]] + second[r[0]], r[1], r[0]) for r in rows if r[0] in first and r[0] in second)
    assert set(got) == {s for *_, s in total}
    assert all(abs(got[s] - 100 * (len(total) - i) / len(total)) <= 0.051 for i, (*_, s) in enumerate(total))


def test_shares_of_rank_sums_fill_the_bins(spark):
    n, bins = 1_000_000, 4096
    sums = spark.range(n).select(((F.col("id") + 1 + F.pmod(F.xxhash64("id"), F.lit(n)) + 1) / (2.0 * n)).alias("v"))
    at = F.floor((0.5 + F.atan(F.col("v") / 0.5) / 3.141592653589793) * bins)
    assert sums.groupBy(at.alias("b")).count().agg(F.max("count")).first()[0] < 8 * n / bins


def test_search_without_limit_is_sorted(spark):
    df = spark.createDataFrame([(i, f"steel {i}", [5, 9, None, 7][i % 4]) for i in range(60)], "ord int, name string, elo_score int")
    got = [(r.elo_score or 0, r.ord) for r in lookups.search(df, "STEEL", ["name"], limit=None).collect()]
    assert len(got) == 60 and got == sorted(got, key=lambda x: (-x[0], x[1]))
