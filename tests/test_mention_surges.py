"""Hours far from any surge are dropped before they are spread over 24 windows each, and nothing else changes."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tickerloom.streaming import bars as sb


def test_only_hours_near_surges_are_spread(spark):
    rng, t0 = random.Random(4), datetime(2024, 1, 1)
    hours = {(f"Q{k}", t0 + timedelta(hours=rng.randrange(2000))): 1 for k in range(100) for _ in range(40)}  # quiet symbols
    for k in range(12):  # bursts of 8 to 12 mentions, alone or beside other hours, up to the edges of both windows
        start = t0 + timedelta(hours=50 + rng.randrange(100))
        hours |= {(f"B{k}", start + timedelta(hours=h)): rng.randrange(1, 4) for h in (0, 7, 23, -1, -24, -25, -47, 24, 47) if rng.random() < 0.8}
        hours[f"B{k}", start + timedelta(hours=12)] = 8 + k % 5
    hourly = spark.createDataFrame([(s, h, n) for (s, h), n in hours.items()], "symbol string, hour timestamp, mentions long")
    until = spark.range(1).select(F.lit(t0 + timedelta(hours=3000)).alias("until"))
    surges = lambda x: {tuple(r) for r in sb.mention_surges(sb.rolling_mentions(x, until)).collect()}
    near = sb.near_surges(hourly)
    assert surges(near) == surges(hourly) and len(surges(hourly)) > 50
    assert near.columns == hourly.columns and near.count() < 0.1 * hourly.count()
