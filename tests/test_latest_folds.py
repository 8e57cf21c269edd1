"""The newest bar's recursive features come from folds of narrow bars; they equal the scans, also over missing prices."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from tickerloom.operators import indicators


def test_latest_features_equal_scans_and_windows_stay_narrow(spark):
    rng = random.Random(3)
    rows, days = [], 620
    for sym, gaps in (("full", 0.0), ("gappy", 0.2), ("late", 0.05), ("bare", 1.0), ("short", 0.1)):
        price = 50.0
        for i in range(45 if sym == "short" else days):
            price *= math.exp(rng.uniform(-0.03, 0.03))
            high, low = price * (1 + rng.random() / 50), price * (1 - rng.random() / 50)
            miss = lambda x: None if rng.random() < gaps else x
            rows.append((sym, i, price, miss(high), miss(low), None if sym == "late" and i < 20 else miss(price), float(rng.randint(1, 99))))
    bars = (spark.createDataFrame(rows, "symbol string, i int, open double, high double, low double, close double, volume double")
            .withColumn("ts", F.date_add(F.lit("1999-01-01").cast("date"), F.col("i"))).drop("i"))
    latest = indicators.latest_features(bars)
    got, want, finite = ({r["symbol"]: r.asDict() for r in f.collect()} for f in (latest, indicators.folded_features(bars), indicators.latest_window_features(bars)))
    assert set(got) == set(want) == set(finite) == {"full", "gappy", "late", "short"}
    for sym, r in want.items():
        for k, v in {**finite[sym], **r}.items():
            x = got[sym][k]
            assert (x is None) == (v is None) and (x == v if not isinstance(v, float) else math.isclose(x, v, rel_tol=1e-9, abs_tol=1e-9)), (sym, k, x, v)
    plan = indicators.latest_features(bars)._jdf.queryExecution().executedPlan().toString()
    collecting = [line for line in plan.splitlines() if "ObjectHashAggregate" in line]
    assert all("collect_list" in line and "max(" not in line for line in collecting)  # the wide aggregate collects nothing
    assert plan.count("Window [") <= 4
