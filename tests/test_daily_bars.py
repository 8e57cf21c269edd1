"""Daily bars take one sort a day's lines and hold no hash table of all days."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickerloom.sources import fixtures as fx


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = random.Random(5), tmp_path_factory.mktemp("lines")
    rows = [(o, k, rng.randrange(50), rng.choice([1, 2, 3, None]), datetime(2001, 1, 1) + timedelta(days=rng.randrange(20)), rng.randrange(11) / 100,
             float(rng.randrange(1, 50))) for o in range(400) for k in range(1, 4)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate timestamp, l_discount double, l_quantity double"
                          ).repartition(3).write.parquet(str(path / "lineitem.parquet"))
    return str(path), rows


def test_bars_equal_a_plain_walk(spark, folder):
    path, rows = folder
    got = {(r.symbol, r.ts): r for r in fx.bars(spark, path).withColumns({c: F.round(c, 9) for c in ("open", "high", "low", "close")}).collect()}
    days: dict = {}
    for o, k, _, s, at, discount, qty in sorted(rows, key=lambda r: r[:3]):
        days.setdefault((f"S{s}" if s else None, at.date()), []).append((round(discount * 100) - 5, qty))
    price, level, close = lambda x: 100 * 2.718281828459045 ** (x / 200), {}, {}
    for (s, day) in sorted(days, key=lambda x: (x[0] or "", x[1])):
        walk = [level.get(s, 0)]
        for step, _ in days[s, day]:
            walk.append(walk[-1] + step)
        prev, level[s] = close.get(s), walk[-1]
        close[s] = price(walk[-1])
        want = (prev or close[s], max([price(max(walk[1:])), *([prev] if prev else [])]), min([price(min(walk[1:])), *([prev] if prev else [])]), close[s])
        r = got.pop((s, day))
        assert (r.open, r.high, r.low, r.close) == pytest.approx(want, abs=1e-8) and r.volume == sum(q for _, q in days[s, day])
    assert not got


def test_bars_hold_no_hash_table(spark, folder):
    plan = fx.bars(spark, folder[0])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and plan.count("Exchange hashpartitioning") == 2
