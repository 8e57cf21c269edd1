"""Prefix scans, stored summaries, keyed stream state, bucketed upserts, input order, term counts, run output."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_indicators import LENGTHS, loop_sar, loop_trend, make_bars
from tickerloom.functions import scans
from tickerloom.operators import backtest, indicators, lookups, macro
from tickerloom.sources import landing, sinks
from tickerloom.streaming import jobs
from tickerloom.streaming.buckets import Buckets
from tickerloom.streaming.indicators import five_day_returns, running_indicators

DAY = dt.timedelta(days=1)
NAMES = ["macd", "macd_signal", "macd_hist", "rsi", "atr", "ema9", "ema21", "adx", "plus_di", "minus_di"]


def long_bars(n=700, missing=()):
    rng = np.random.default_rng(3)
    close = 100 + np.cumsum(rng.normal(0, 1, n)).clip(-60)
    f = pd.DataFrame({"symbol": "L", "ts": [dt.date(2015, 1, 1) + i * DAY for i in range(n)], "open": close, "high": close + 1, "low": close - 1, "close": close, "volume": 5.0})
    f.loc[list(missing), "close"] = np.nan
    return f


def test_scan_carries_every_block(spark):
    rng = random.Random(1)
    rows = [("S", i, rng.random()) for i in range(3 * scans.BLOCK + 17)] + [("T", i, 1.0) for i in range(5)]
    df = scans.in_order(spark.createDataFrame(rows, "symbol string, ts int, x double"))
    decay = F.when(F.col("ts") % 7 == 0, F.lit(1.0)).otherwise(F.lit(0.9))
    out = scans.affine_scan(df, {"slow": (F.col("x"), 0.999), "one": (F.col("x"), 1.0), "fast": (F.col("x"), 0.5), "varying": (F.col("x"), decay)})
    got = {(r.symbol, r.ts): r for r in out.collect()}
    state = {}
    for s, i, x in rows:
        y = state.get(s, [0.0] * 4)
        y = state[s] = [a * v + x for a, v in zip((0.999, 1.0, 0.5, 1.0 if i % 7 == 0 else 0.9), y)]
        r = got[s, i]
        assert np.allclose([r.slow, r.one, r.fast, r.varying], y, rtol=1e-11)
    for bad in (0.05, 0.0, 1.5):
        with pytest.raises(ValueError):
            scans.affine_scan(df, {"y": (F.col("x"), bad)})


@pytest.mark.parametrize("missing", [(), (3, 4, 5, 300, 301, 650, 699)])
def test_means_equal_pandas_with_missing_values(spark, missing):
    f = long_bars(missing=missing)
    b = indicators.smoothed_features(indicators._from_the_end(indicators.clean_bars(spark.createDataFrame(f)))).orderBy("ts").toPandas()
    assert np.allclose(b.ema21, f.close.ewm(span=21, adjust=False).mean(), rtol=1e-10)
    line = f.close.ewm(span=12, adjust=False).mean() - f.close.ewm(span=26, adjust=False).mean()
    assert np.allclose(b.macd_signal, line.ewm(span=9, adjust=False).mean(), atol=1e-9)
    up = f.close.diff().clip(lower=0).ewm(alpha=1 / 14).mean()
    assert np.allclose(b.gain.astype(float), up, rtol=1e-9, atol=1e-12, equal_nan=True)


def test_summaries_go_on_where_they_stopped(spark):
    f = make_bars()
    f["i"] = f.groupby("symbol").cumcount()
    late = {"A": 299, "D": 100, "UP": 40, "GAP": 77, "FLAT": 79}
    old = f[[i < late.get(s, 10**9) for s, i in zip(f.symbol, f.i)]].drop(columns="i")
    clean = lambda x: indicators.clean_bars(spark.createDataFrame(x))
    whole = clean(f.drop(columns="i"))
    kept = indicators.advanced(indicators.summaries(clean(old[old.symbol != "E"])), whole)  # E is new
    got = indicators.from_summaries(kept).toPandas().set_index("symbol").sort_index()
    want = indicators.folded_features(whole).toPandas().set_index("symbol").sort_index()
    assert list(got.index) == list(want.index) and len(got) >= 8
    for c in ("macd", "macd_signal", "macd_hist", "rsi", "atr", "ema9", "ema21", "adx", "plus_di", "minus_di"):
        pd.testing.assert_series_equal(got[c].astype(float), want[c].astype(float), check_names=False, rtol=1e-8, atol=1e-10)
    again = indicators.advanced(kept, whole)  # bars it has seen change nothing
    assert {r.symbol: r.state for r in again.collect()} == {r.symbol: r.state for r in kept.collect()}


def test_features_take_one_scan_and_one_exchange(spark, tmp_path):
    indicators.clean_bars(spark.createDataFrame(make_bars())).write.parquet(str(tmp_path / "b"))
    plan = indicators.latest_features(spark.read.parquet(str(tmp_path / "b")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 1 and "Python" not in plan


def test_one_bar_a_day_and_return_look_back(spark):
    f = long_bars(120)
    twice = pd.concat([f, f.iloc[[60]].assign(close=1.0, volume=4.0)])
    a, b = (indicators.latest_features(indicators.clean_bars(spark.createDataFrame(x))).drop("ts").first() for x in (f, twice))
    assert a == b
    gaps = long_bars(700, missing=range(300, 690, 2))
    r = indicators.latest_features(indicators.clean_bars(spark.createDataFrame(gaps))).first()
    lr = np.log(gaps.close / gaps.close.shift(1)).dropna()
    assert abs(r.vol_daily - lr.iloc[-60:].std()) < 1e-12 and abs(r.vol_annual_pct - lr.iloc[-252:].std() * 252 ** 0.5 * 100) < 1e-9


def test_flag_series_goes_on_between_chunks(spark):
    f = long_bars(2 * scans.BLOCK + 40)
    s = indicators.path_flag_series(indicators.clean_bars(spark.createDataFrame(f)))
    assert "Python" not in s._jdf.queryExecution().executedPlan().toString()
    got = s.orderBy("ts").toPandas()
    assert len(got) == len(f)
    for n in (2, 200, scans.BLOCK, scans.BLOCK + 1, 2 * scans.BLOCK + 1, len(f)):
        part = f.iloc[:n].reset_index(drop=True)
        assert got.psar_bull[n - 1] == loop_sar(part.high.tolist(), part.low.tolist(), part.close.tolist())
        assert got.supertrend_up[n - 1] == loop_trend(part)


def _stream(spark, frames, folder, per_trigger=1):
    for i, f in enumerate(frames):
        spark.createDataFrame(f).coalesce(1).write.parquet(f"{folder}/p{i}")
    return spark.readStream.schema(spark.createDataFrame(frames[0]).schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{folder}/*")


def test_running_state_drops_late_bars_takes_missing_prices_and_expires(spark, tmp_path):
    f = make_bars()
    a, gap, old = f[f.symbol == "A"], f[f.symbol == "GAP"], f[f.symbol == "C"]
    late = a.iloc[[10]].assign(close=1.0)
    back = old.assign(ts=[t + 800 * DAY for t in old.ts])  # C is silent for longer than the state waits
    frames = [pd.concat([a[:150], gap[:60], old]), pd.concat([a[150:], late, gap[60:]]), back]
    out = jobs.run_to_table(running_indicators(_stream(spark, frames, str(tmp_path / "in")), idle_days=400, delay="0 days"), "state").toPandas()
    last = out.sort_values("ts").groupby("symbol").last()
    clean = lambda x: indicators.folded_features(indicators.clean_bars(spark.createDataFrame(x))).toPandas().set_index("symbol")
    want = clean(pd.concat([gap, old]))
    for c in NAMES:
        for s in ("GAP", "C"):
            if not pd.isna(want.loc[s, c]):
                assert abs(last.loc[s, c] - want.loc[s, c]) < 1e-9 * max(1, abs(want.loc[s, c])), (s, c)
    assert (out.symbol == "A").sum() == len(a) and (out.symbol == "C").sum() == 2 * len(old)
    first = out[(out.symbol == "C")].sort_values("ts").iloc[len(old)]
    assert pd.isna(first.rsi) and first.macd == 0  # it started anew


def test_five_day_returns_across_batches(spark, tmp_path):
    f = long_bars(40, missing=(7, 8))
    out = jobs.run_to_table(five_day_returns(_stream(spark, [f[:3], f[3:12], f[12:]], str(tmp_path / "in"))), "five").orderBy("ts").toPandas()
    c = f.dropna(subset="close").close.reset_index(drop=True)
    assert np.allclose(out.ret_5d.astype(float), (c / c.shift(5) - 1) * 100, equal_nan=True) and len(out) == 38


def test_buckets_rewrite_what_a_batch_touches(spark, tmp_path):
    t = Buckets(str(tmp_path / "t"), buckets=8)
    schema = "symbol string, ts int, x int"
    df = lambda rows: spark.createDataFrame(rows, schema)
    t.merge(df([(f"S{i}", 1, i) for i in range(40)]), 0)
    before = t.pointer(spark)[1]
    t.merge(df([("S1", 2, 100), ("S2", 0, 200), ("NEW", 1, 7)]), 1)
    after = t.pointer(spark)[1]
    hit = {r.b for r in df([("S1", 0, 0), ("S2", 0, 0), ("NEW", 0, 0)]).select(F.pmod(F.hash("symbol"), F.lit(8)).alias("b")).collect()}
    assert {b for b in after if before.get(b) != after[b]} == hit and len(hit) < 8
    folders = {p.parent.name + p.name for p in (tmp_path / "t" / "data").glob("version=*/bucket=*")}
    assert folders == {f"version={v}bucket={b}" for b, v in after.items()}  # nothing old is left
    read = lambda: {r.symbol: (r.ts, r.x) for r in t.read(spark, df([]).schema).collect()}
    now = read()
    assert len(now) == 41 and now["S1"] == (2, 100) and now["S2"] == (1, 2)
    t.merge(df([("S1", 9, 9)]), 1)  # the same batch again
    assert read() == now and t.pointer(spark)[1] == after


def test_input_order_does_not_depend_on_splits(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"u{k}.csv").write_text("symbol,name,exchange\n" + "".join(f"S{k}_{i},Name {'x' * (i % 9)},X\n" for i in range(3000)))
    got = []
    for size in ("128m", "8k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            u = landing.universe(spark, str(tmp_path))
            got.append(({r.symbol: r.ord for r in u.collect()}, u.rdd.getNumPartitions()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got[0][0] == got[1][0] == {f"S{k}_{i}": 3000 * k + i for k in range(2) for i in range(3000)}


def test_term_counts_equal_plain_counts(spark):
    hawk, dove = ["raise", "rai", "aa", "high", "r", "t. x"], ["highly", "high", "ease", "a"]
    texts = ["raised highly aaa raise rai high. t. x t.yx", "", "r" * 50, "increase decrease aaaa", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for t, r in zip(texts, macro.policy_tone(df, "text", hawk, dove).collect()):
        assert (r.hawk_hits, r.dove_hits) == ((None, None) if t is None else (sum(t.count(w) for w in hawk), sum(t.count(w) for w in dove)))


def test_latest_statement(spark):
    d = dt.date(2024, 3, 1)
    feed = spark.createDataFrame([(0, "Press release", "hike hike", d), (1, "<b>FOMC</b> statement ", "cut cut", d - DAY), (2, "Monetary Policy note", "hike", d - DAY), (3, "FOMC later", "x", d + DAY)],
                                 "pos int, title string, body string, published date")
    r = macro.latest_statement(feed, d).first()
    assert (r.fomc_tone, r.fomc_headline, r.fomc_date) == ("dovish", "FOMC statement", d - DAY)
    one = spark.range(1)
    none = macro.with_statement(one, macro.latest_statement(feed, d - 9 * DAY)).collect()
    assert len(none) == 1 and none[0].fomc_tone is None


def test_runs_and_whole_row_filter(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([(0, "A", 1.0, ["Gold"]), (1, "B", None, None), (2, "GOLDEN", 3.0, [])], "ord int, symbol string, elo_score double, themes array<string>")
    for _ in range(2):
        sinks.write_run(spark, root, "2024-01-01T09", rows, spark.createDataFrame([(3, "ok")], "analyzed int, market string"))
    sinks.write_run(spark, root, "2024-01-02T09", rows.limit(1), spark.createDataFrame([(1, "ok")], "analyzed int, market string"))
    assert sorted((r.run_ts, r.analyzed) for r in sinks.runs(spark, root).collect()) == [("2024-01-01T09", 3), ("2024-01-02T09", 1)]
    assert sinks.previous_snapshot(spark, root).count() == 1
    assert [r.symbol for r in lookups.table_filter(rows, "gold").collect()] == ["GOLDEN", "A"]
    assert [r.symbol for r in lookups.table_filter(rows, "none").collect()] == ["B"]


def test_panel_takes_the_newest_bar_up_to_each_date(spark):
    rng = np.random.default_rng(5)
    days = [dt.date(2015, 1, 1) + i * DAY for i in range(1000)]
    rows = []
    for s in range(3):
        for i, d in enumerate(days):
            if not (s == 1 and 400 <= i < 500):  # three months without bars
                rows.append((f"S{s}", d, *[float(100 + rng.normal())] * 4, 1.0))
    bars = spark.createDataFrame(rows, "symbol string, ts date, open double, high double, low double, close double, volume double")
    s = {(r.symbol, r.ts): r for r in backtest.score_series(backtest.eligible(bars)).collect()}
    got = {(r.symbol, r.rebalance): r.longterm_score for r in backtest.scored_panel(bars, horizons=(21,)).where("horizon = 21").collect()}
    assert not got  # fewer names than three a bucket
    old, backtest.BUCKETS = backtest.BUCKETS, 1
    try:
        got = {(r.symbol, r.rebalance): r.longterm_score for r in backtest.scored_panel(bars, horizons=(21,)).collect()}
    finally:
        backtest.BUCKETS = old
    for (sym, day), score in got.items():
        newest = max(d for x, d in s if x == sym and d <= day)
        assert score == s[sym, newest].longterm_score
    assert {d for x, d in got if x == "S1"} >= {d for x, d in got if x == "S0" and dt.date(2016, 3, 1) < d < dt.date(2016, 5, 1)}


def test_lengths_are_what_these_tests_assume():
    assert LENGTHS["A"] == 300 and LENGTHS["GAP"] == 120
