"""Folds and windows against independent pandas / loop implementations."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickerloom.operators import backtest, indicators

LENGTHS = {"A": 300, "B": 29, "C": 35, "D": 150, "E": 172, "F": 222, "UP": 60, "GAP": 120, "FLAT": 80}


def make_bars() -> pd.DataFrame:
    rng = np.random.default_rng(7)
    frames = []
    for sym, n in LENGTHS.items():
        step = np.abs(rng.normal(0, 1, n)) if sym == "UP" else rng.normal(0, 1.2, n)
        close = 100 + np.cumsum(step)
        close = np.maximum(close, 5.0)
        high, low = close + rng.uniform(0, 2, n), close - rng.uniform(0, 2, n)
        if sym == "FLAT":
            high, low, close = np.full(n, 50.0), np.full(n, 50.0), np.full(n, 50.0)
        vol = rng.integers(0, 50, n).astype(float)
        ts = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)]
        f = pd.DataFrame({"symbol": sym, "ts": ts, "open": close, "high": high, "low": low, "close": close, "volume": vol})
        if sym == "GAP":
            f.loc[[40, 41, 77], ["open", "high", "low", "close"]] = np.nan
        frames.append(f)
    return pd.concat(frames, ignore_index=True)


@pytest.fixture(scope="module")
def frame():
    return make_bars()


@pytest.fixture(scope="module")
def bars(spark, frame):
    return indicators.clean_bars(spark.createDataFrame(frame)).cache()


@pytest.fixture(scope="module")
def folded(bars):
    return indicators.folded_features(bars).toPandas().set_index("symbol")


def true_range(f):
    pc = f["close"].shift(1)
    return pd.concat([f.high - f.low, (f.high - pc).abs(), (f.low - pc).abs()], axis=1).max(axis=1)


def close_to(a, b):
    if a is None or (isinstance(a, float) and math.isnan(a)):
        return b is None or (isinstance(b, float) and math.isnan(b))
    return b is not None and abs(a - b) < 1e-6 * max(1.0, abs(b))


def test_minimum_history(folded):
    assert "B" not in folded.index and "C" in folded.index
    assert pd.isna(folded.loc["C", "ema9"]) and not pd.isna(folded.loc["C", "macd"])


@pytest.mark.parametrize("sym", ["A", "D", "UP", "GAP"])
def test_smoothed_indicators(frame, folded, sym):
    f = frame[frame.symbol == sym].reset_index(drop=True)
    c, row = f["close"], folded.loc[sym]
    line = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    sig = line.ewm(span=9, adjust=False).mean()
    assert close_to(row["macd"], line.iloc[-1]) and close_to(row["macd_signal"], sig.iloc[-1])
    assert close_to(row["macd_hist_prev"], (line - sig).iloc[-2])
    d = c.diff()
    up = d.clip(lower=0).ewm(alpha=1 / 14, min_periods=14).mean().iloc[-1]
    down = (-d.clip(upper=0)).ewm(alpha=1 / 14, min_periods=14).mean().iloc[-1]
    assert close_to(row["rsi"], None if down == 0 else 100 - 100 / (1 + up / down))
    assert close_to(row["atr"], true_range(f).ewm(alpha=1 / 14, min_periods=14).mean().iloc[-1])
    assert close_to(row["ema21"], c.ewm(span=21, adjust=False).mean().iloc[-1])


def test_rsi_is_null_without_losses(folded):
    assert pd.isna(folded.loc["UP", "rsi"])


@pytest.mark.parametrize("sym", ["A", "D", "E", "GAP"])
def test_directional_movement(frame, folded, sym):
    f = frame[frame.symbol == sym].reset_index(drop=True)
    rma = lambda s: s.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    up, dn = f.high.diff(), -f.low.diff()
    plus = pd.Series(np.where((up > dn) & (up > 0), up, 0.0))
    minus = pd.Series(np.where((dn > up) & (dn > 0), dn, 0.0))
    tr = rma(true_range(f))
    pdi, mdi = 100 * rma(plus) / tr, 100 * rma(minus) / tr
    dx = 100 * (pdi - mdi).abs() / (pdi + mdi).replace(0, np.nan)
    row = folded.loc[sym]
    assert close_to(row["plus_di"], pdi.iloc[-1]) and close_to(row["minus_di"], mdi.iloc[-1])
    assert close_to(row["adx"], rma(dx).iloc[-1])


def loop_sar(h, l, c):
    ps, ep, af, bull = l[0], h[0], 0.02, True
    for i in range(1, len(c)):
        cand = ps + af * (ep - ps)
        if bull and l[i] < cand:
            bull, ps, ep, af = False, ep, l[i], 0.02
        elif not bull and h[i] > cand:
            bull, ps, ep, af = True, ep, h[i], 0.02
        else:
            ps = cand
            if bull and h[i] > ep:
                ep, af = h[i], min(af + 0.02, 0.2)
            elif not bull and l[i] < ep:
                ep, af = l[i], min(af + 0.02, 0.2)
    return c[-1] > ps


def loop_trend(f):
    atr = true_range(f).ewm(alpha=0.1, adjust=False, min_periods=10).mean()
    mid = (f.high + f.low) / 2
    ub, lb, c, up = (mid + 3 * atr).tolist(), (mid - 3 * atr).tolist(), f.close.tolist(), True
    fu, fl = ub[0], lb[0]
    for i in range(1, len(c)):
        nu = min(ub[i], fu) if c[i - 1] <= fu else ub[i]
        nl = max(lb[i], fl) if c[i - 1] >= fl else lb[i]
        up = True if c[i] > fu else False if c[i] < fl else up
        fu, fl = nu, nl
    return up


@pytest.mark.parametrize("sym", ["A", "D", "E", "F", "UP"])
def test_path_dependent_flags(frame, folded, sym):
    f = frame[frame.symbol == sym].reset_index(drop=True)
    assert folded.loc[sym, "psar_bull"] == loop_sar(f.high.tolist(), f.low.tolist(), f.close.tolist())
    assert folded.loc[sym, "supertrend_up"] == loop_trend(f)


def test_path_flag_series_ends_at_the_folds(bars, folded):
    s = indicators.path_flag_series(bars.where("symbol in ('A', 'D', 'E', 'F', 'UP')"))
    last = s.groupBy("symbol").agg(F.max_by(F.struct("supertrend_up", "psar_bull"), "ts").alias("r")).collect()
    assert len(last) == 5 and s.count() == sum(LENGTHS[x] for x in ("A", "D", "E", "F", "UP"))
    for x in last:
        assert x["r"]["psar_bull"] == folded.loc[x["symbol"], "psar_bull"]
        assert x["r"]["supertrend_up"] == folded.loc[x["symbol"], "supertrend_up"]


def test_latest_shape_equals_series_shape(bars):
    latest = indicators.rounded(indicators.latest_window_features(bars))
    newest = bars.groupBy("symbol").agg(F.max("ts").alias("ts"))
    series = indicators.rounded(indicators.window_features(bars).join(newest, ["symbol", "ts"]))
    a = latest.toPandas().set_index("symbol").sort_index()
    b = series.toPandas().set_index("symbol").loc[a.index]
    for c in a.columns:
        if c == "ts" or (c in ("vol_daily", "vol_annual_pct")):
            continue
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        assert same.all(), c


def test_history_thresholds(bars):
    f = indicators.latest_window_features(bars).toPandas().set_index("symbol")
    assert not pd.isna(f.loc["D", "sma150"]) and pd.isna(f.loc["D", "sma150_1m_ago"])
    assert not pd.isna(f.loc["E", "sma150_1m_ago"]) and pd.isna(f.loc["E", "sma200"])
    assert not pd.isna(f.loc["F", "sma200_1m_ago"])
    assert pd.isna(f.loc["FLAT", "bb_pctb"]) and pd.isna(f.loc["FLAT", "stoch_k"])


def test_aroon_counts_from_the_oldest_extreme(spark):
    rows = [("S", dt.date(2021, 1, 1) + dt.timedelta(days=i), 1.0, 10.0 + i, 9.0 + i, 9.5 + i, 1.0) for i in range(45)]
    b = indicators.clean_bars(spark.createDataFrame(rows, "symbol string, ts date, open double, high double, low double, close double, volume double"))
    r = indicators.latest_window_features(b).select("aroon_up", "aroon_down").first()
    assert (r["aroon_up"], r["aroon_down"]) == (0.0, 100.0)
    w = indicators.window_features(b, classic_aroon=True).orderBy(F.desc("ts")).first()
    assert (w["aroon_up"], w["aroon_down"]) == (100.0, 0.0)


def test_score_series_matches_point_in_time_score(spark, frame):
    from tickerloom.operators.scores import longterm
    f = frame[frame.symbol == "A"]
    b = indicators.clean_bars(spark.createDataFrame(f)).cache()
    series = {r["ts"]: r["longterm_score"] for r in backtest.score_series(b).collect()}
    for cut in (221, 260, 300):
        part = indicators.clean_bars(spark.createDataFrame(f.iloc[:cut]))
        want = longterm(indicators.latest_features(part)).first()
        assert series[want["ts"]] == want["longterm_score"]
