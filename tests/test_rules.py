"""Hand-computed rule checks on thresholds, NULLs and branch order."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tickerloom.functions.core import band, clamp, let, num, rnd, weighted_mean
from tickerloom.operators import fundamentals, holders, lookups, macro, news, outlook, rating, refresh, scores


def row(spark, **cols):
    out = spark.range(1)
    for k, v in cols.items():
        out = out.withColumn(k, F.lit(v) if not isinstance(v, tuple) else F.lit(v[0]).cast(v[1]))
    return out


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_helpers(spark):
    assert value(spark, band(F.lit(10.0), [(10, 1), (20, 2)], 3)) == 1
    assert value(spark, band(F.lit(20.01), [(10, 1), (20, 2)], 3)) == 3
    assert value(spark, band(F.lit(None).cast("double"), [(10, 1)], 3)) is None
    assert value(spark, clamp(F.lit(None).cast("double"), 0, 1)) is None
    assert value(spark, weighted_mean([(F.lit(None).cast("double"), 1.0)])) is None
    assert value(spark, weighted_mean([(F.lit(10.0), 3.0), (F.lit(None).cast("double"), 1.0), (F.lit(20.0), 1.0)])) == 12.5
    assert value(spark, rnd(F.lit(0.5), 0)) == 0.0 and value(spark, rnd(F.lit(1.5), 0)) == 2.0
    assert value(spark, let(F.lit(3.0), lambda v: v * v)) == 9.0


def test_suffix_lookups(spark):
    d = spark.createDataFrame([("vod.l",), ("AAPL",), ("BRK.B",), ("BTC-USD",), ("TSM",), ("SAP.DE",), ("0050.TWO",)], "symbol string")
    cur = {r[0]: r[1] for r in d.select("symbol", lookups.currency_of("symbol")).collect()}
    assert cur == {"vod.l": "GBp", "AAPL": "USD", "BRK.B": "USD", "BTC-USD": "USD", "TSM": "USD", "SAP.DE": "EUR", "0050.TWO": "TWD"}
    land = {r["symbol"]: (r["country"], r["cc"]) for r in lookups.with_country(d).collect()}
    assert land["BTC-USD"] == ("Krypto", None) and land["TSM"] == ("Taiwan", "tw") and land["BRK.B"] == ("USA", "us")


def test_fx(spark):
    c = spark.createDataFrame([("USD",), ("GBp",), ("JPY",), ("XXX",), ("EUR",)], "currency string")
    q = spark.createDataFrame([("GBP", 1.25, None), ("JPY", None, 160.0), ("EUR", 0.0, 0.8)], "currency string, direct double, inverse double")
    got = {r[0]: r[1] for r in lookups.fx_rates(c, q).collect()}
    assert got == {"USD": 1.0, "GBp": 0.0125, "JPY": 0.00625, "XXX": None, "EUR": 1.25}
    rows = spark.createDataFrame([("A", "JPY", 1000.0), ("B", "XXX", 3.14159)], "symbol string, currency string, price double")
    out = {r["symbol"]: (r["price"], r["fx_usd"], r["fx_missing"]) for r in lookups.fx_convert(rows, lookups.fx_rates(c, q)).collect()}
    assert out == {"A": (6.25, 0.00625, False), "B": (3.14159, 1.0, True)}


def test_statement_labels(spark):
    rows = [("A", "income", "Net Income Common Stockholders", 0, 5.0), ("A", "income", "Net Income Continuous Operations", 0, 9.0),
            ("A", "balance", "Total Assets", 0, 100.0), ("B", "income", "Net Income", 0, float("nan")),
            ("B", "income", "Net Income Common Stockholders", 0, 7.0), ("A", "cashflow", "Net Income", 0, 1.0)]
    s = spark.createDataFrame(rows, "symbol string, stmt string, item string, period_rank int, amount double")
    got = {r["symbol"]: r for r in fundamentals.statements_wide(s).collect()}
    assert got["A"]["ni_0"] == 5.0 and got["A"]["ta_0"] == 100.0 and got["A"]["ni_1"] is None
    assert got["B"]["ni_0"] is None  # a present label with a missing value does not fall through
    p = fundamentals.piotroski(fundamentals.statements_wide(s)).where("symbol = 'A'").first()
    assert p["piotroski"] is None and p["piotroski_n"] == 1


def test_trend_template_and_stage(spark):
    r = row(spark, price=110.0, sma50=105.0, sma150=100.0, sma200=95.0, sma200_1m_ago=(None, "double"), sma150_1m_ago=99.0,
            pct_above_low52=30.0, pct_from_high52=-25.0, rs_rating=(69, "int"))
    x = scores.weinstein(scores.minervini(r)).first()
    assert x["minervini_score"] == 86 and len(x["minervini_met"]) == 6 and len(x["minervini_failed"]) == 1
    assert x["weinstein_stage"] == 2
    flat = scores.weinstein(row(spark, price=100.0, sma150=100.0, sma150_1m_ago=(None, "double"))).first()
    assert flat["weinstein_stage"] == 3


def test_daytrade_ties_go_long(spark):
    r = row(spark, price=100.0, rvol=(None, "double"), high20=99.0, low20=(None, "double"), macd_hist=0.1, macd_hist_prev=0.2,
            rsi=70.0, atr_pct=1.0, daily_return=0.0)
    x = scores.daytrade(r).first()
    assert (x["daytrade_score"], x["daytrade_direction"]) == (32.0, "LONG")
    assert len(x["daytrade_reasons"]) == 2


@pytest.mark.parametrize("levels,want", [
    ([100.0, 99.0, 97.0, 90.0], [100.0, 97.0, 90.0]), ([], []), ([50.0, 50.001], [50.0])])
def test_supports_merge(spark, levels, want):
    names = list(rating.SUPPORT_LEVELS)
    cols = {n: (levels[i] if i < len(levels) else None, "double") for i, n in enumerate(names)}
    assert rating.supports(row(spark, price=101.0, **cols)).first()["supports"] == want


def test_volume_signal(spark):
    got = [rating.volume_signal(row(spark, rvol=v, daily_return_pct=d)).first()["volume_pts"]
           for v, d in ((1.79, 5.0), (1.8, 1.0), (4.0, 2.0), (2.2, -1.0), (3.0, 0.5))]
    assert got == [0, 5, 12, -7, 0]


def test_projection_without_volatility_is_null(spark):
    base = dict(price=100.0, investment_score=70.0, daytrade_score=50.0, daytrade_direction="LONG", analyst_upside_pct=(None, "double"))
    none = outlook.projections(row(spark, vol_daily=(None, "double"), atr_pct=(None, "double"), **base)).first()
    assert none["projection_long"] is None and none["exp_return_12m"] is None
    some = outlook.projections(row(spark, vol_daily=0.02, atr_pct=(None, "double"), **base)).first()
    assert some["exp_return_12m"] == 8.1 and [p["days"] for p in some["projection_long"]] == [21, 126, 252, 504]
    assert some["projection_short"][0]["confidence_pct"] == 70


def test_news_tokens_and_limits(spark):
    rows = [("A", i, t, "l", "") for i, t in enumerate(["Profit, profit. PROFIT", "Shares fall", "win win", "", "gain", "loss", "surge"])]
    h = spark.createDataFrame(rows, "symbol string, pos long, title string, link string, published string")
    r = news.news_sentiment(h, per_symbol=6).first()
    assert (r["news_score"], r["news_n"], r["news_sentiment"]) == (56, 5, "neutral")
    r = news.news_sentiment(h).first()  # every headline counts
    assert (r["news_score"], r["news_n"], r["news_sentiment"]) == (62, 6, "positiv")
    assert len(r["news"]) == 3


def test_hype(spark):
    board = spark.createDataFrame([("A", 1, 45, 9, 30, 40), ("B", 200, 3, 0, 0, None)],
                                  "ticker string, rank int, mentions int, upvotes int, mentions_24h_ago int, rank_24h_ago int")
    got = {r["symbol"]: r for r in news.hype_signal(spark.createDataFrame([("a",), ("B",), ("C",)], "symbol string"), board).collect()}
    assert got["a"]["hype_surging"] and got["a"]["hype_score"] == 99.0 and got["a"]["hype_change_pct"] == 50.0
    assert got["B"]["hype_score"] == 5.0 and got["B"]["hype_change_pct"] is None and not got["B"]["hype_surging"]
    assert got["C"]["hype_rank"] is None and got["C"]["hype_surging"] is None


def test_latest_board_page_wins(spark):
    p = spark.createDataFrame([("a", 1, 5), ("A", 2, 7), ("", 1, 1)], "ticker string, page int, rank int")
    assert [(r["ticker"], r["rank"]) for r in news.latest_board(p).collect()] == [("A", 7)]


def test_policy_tone_counts_repeats(spark):
    d = spark.createDataFrame([("Hike, hike and tighten; lower later",), ("cut",), ("nothing",)], "text string")
    got = [(r["hawk_hits"], r["dove_hits"], r["tone"]) for r in macro.policy_tone(d).collect()]
    assert got == [(3, 1, "hawkish"), (0, 1, "dovish"), (0, 0, "neutral")]


def test_exposure_stances(spark):
    rows = [("A", None, 10), ("A", "Put", 5), ("A", "Call", 1), ("B", "Put", 11), ("B", None, 10), ("C", None, 3), ("D", "Call", 1)]
    got = {r["issuer"]: (r["stance"], r["gross_value"]) for r in holders.exposure(
        spark.createDataFrame(rows, "issuer string, put_call string, value long")).collect()}
    assert got == {"A": ("MIXED", 16), "B": ("SHORT_BET", 21), "C": ("LONG", 3), "D": ("LONG", 1)}


def test_refresh_operators(spark):
    u = spark.createDataFrame([("A", 0), ("B", 1), ("C", 2), ("D", 3)], "symbol string, ord long")
    c = spark.createDataFrame([("A", "2024-01-09T00:00:00"), ("B", "oops"), ("C", "2024-01-01T00:00:00")], "symbol string, fetched_at string")
    s = refresh.stale_keys(u, c, "2024-01-10 00:00:00", "7 days")
    assert {r["symbol"]: r["stale_reason"] for r in s.collect()} == {"B": "unreadable", "C": "old", "D": "missing"}
    q = refresh.refresh_queue(s, spark.createDataFrame([("B", 5.0), ("C", 5.0), ("D", 9.0)], "symbol string, investment_score double"), 2)
    assert [r["symbol"] for r in q.collect()] == ["D", "B"]
    new = spark.createDataFrame([("B", "2024-01-10T00:00:00"), ("E", "x")], "symbol string, fetched_at string")
    once = refresh.upsert(c, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, refresh.upsert(once, new).collect()))
    assert {r["symbol"]: r["fetched_at"] for r in once.collect()}["B"].startswith("2024-01-10")
    rows = spark.createDataFrame([("A", 1), ("B", 2)], "symbol string, news_score int")
    prev = spark.createDataFrame([("A", None, "x")], "symbol string, news_score int, intraday_note string")
    got = {r["symbol"]: (r["news_score"], r["intraday_note"]) for r in refresh.carry_forward(rows, prev).collect()}
    assert got == {"A": (None, "x"), "B": (2, None)}
