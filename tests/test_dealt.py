"""A task's share of the bars doesn't grow with the table, and bars that serve no rebalance date never meet the dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tickerloom import session
from tickerloom.operators import backtest


def make_bars(spark, path):
    day = dt.date(1999, 1, 4)
    rows = [(f"S{k}", day + dt.timedelta(days=i * (1 + k % 2) + (80 if i > 500 else 0)), 50.0 + (i * (7 + k)) % 23) for k in range(20) for i in range(600)]
    spark.createDataFrame(rows, "symbol string, ts date, close double").write.parquet(path)
    return spark.read.parquet(path)


def test_tasks_follow_the_rows_and_scores_stay(spark, tmp_path, monkeypatch):
    bars = make_bars(spark, str(tmp_path / "b"))
    few = session.dealt(bars, 12_000, "symbol")
    assert few is bars  # the session's partitions suffice
    monkeypatch.setattr(session, "TASK_ROWS", 1_000)
    many = session.dealt(bars, 12_000, "symbol")
    plan = backtest.score_series(backtest.eligible(many))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(symbol" in plan and ", 12), REPARTITION_BY_NUM" in plan and plan.count("Exchange ") == 1
    one, two = (sorted(map(tuple, backtest.score_series(backtest.eligible(b)).collect())) for b in (bars, many))
    assert one == two and len(one) == 12_000
    one, two = (sorted(map(tuple, f.collect())) for f in (backtest.scored_panel(bars), backtest.scored_panel(bars, by_symbol_=many)))
    assert one == two and one


def test_only_the_last_bar_before_a_month_change_meets_the_dates(spark, tmp_path, monkeypatch):
    bars = make_bars(spark, str(tmp_path / "b"))
    plans = []
    monkeypatch.setattr(backtest, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    got = {(r["symbol"], r["rebalance"]): r["longterm_score"] for r in backtest.scored_panel(bars).where("horizon = 21").collect()}
    assert any("Filter" in line and "trunc(_next" in line for line in plans[0].splitlines())
    scores = backtest.score_series(backtest.eligible(bars)).collect()
    dates = [r[0] for r in bars.groupBy(F.trunc("ts", "month")).agg(F.max("ts").alias("d")).select("d").collect()]
    want = {}
    for sym in {r["symbol"] for r in scores}:
        own = sorted((r["ts"], r["rn"], r["longterm_score"]) for r in scores if r["symbol"] == sym)
        for d in dates:
            past = [x for x in own if x[0] <= d]
            if past and past[-1][1] + 1 >= backtest.MIN_HIST and len(own) - past[-1][1] - 1 >= 21:
                want[sym, d] = past[-1][2]
    names = {d: sum(k[1] == d for k in want) for d in dates}
    assert got and got == {k: v for k, v in want.items() if names[k[1]] >= backtest.BUCKETS * 3}
