"""The score series sorts its bars once by time and once by block, whatever it reads from them."""

from __future__ import annotations

import re

import pandas as pd

from tickerloom.operators import backtest


def test_score_series_sorts_twice_and_takes_the_yearly_high(spark, tmp_path):
    days = pd.date_range("1999-01-04", periods=700).date
    close = [100.0 + (i * 37 % 101) - i / 10 for i in range(700)]
    spark.createDataFrame(pd.DataFrame({"symbol": "A", "ts": days, "close": close})).write.parquet(str(tmp_path / "b"))
    bars = spark.read.parquet(str(tmp_path / "b"))
    plan = backtest.score_series(backtest.eligible(bars))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bSort \[", plan)) == 2 and len(re.findall(r"\bExchange ", plan)) == 1
    backtest.longterm_score, kept = lambda: backtest.C("pct_from_high52"), backtest.longterm_score
    try:
        got = [r[0] for r in backtest.score_series(bars).orderBy("ts").select("longterm_score").collect()]
    finally:
        backtest.longterm_score = kept
    want = (pd.Series(close) / pd.Series(close).rolling(252, min_periods=1).max() - 1) * 100
    assert max(abs(a - b) for a, b in zip(got, want)) < 1e-9
