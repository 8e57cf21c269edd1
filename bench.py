"""Headline timings: one JSON line with seconds per query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Stage tables (stage_*) are timed as their own entries; the other queries read them,
as the daily run does. Every query is executed in full (noop sink). `queries` has the
first (cold) run of each, `warm` a second one, `exchanges` the shuffles of its final plan.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tickerloom.plans.queries import QUERIES  # noqa: E402
from tickerloom.plans.stages import Stages  # noqa: E402
from tickerloom.session import local_session  # noqa: E402

STAGES = ("bars", "fundamentals", "features", "scored", "rows", "macro", "snapshot")
HEADLINE = ("ind_sma", "ind_macd", "ind_rsi", "ind_adx", "ind_supertrend", "ind_cci", "score_longterm", "magic_formula",
            "piotroski", "news_sentiment", "market_sentiment", "policy_tone", "intraday_pattern", "macro_context",
            "minervini", "entry_score", "trade_plan", "theme_leaderboard", "score_series", "forward_returns",
            "backtest_scores", "backtest_summary", "portfolio_trades", "equity_vs_benchmark", "stream_bars30")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    stages = Stages(spark, sf_dir)
    for name in STAGES:
        t = time.time()
        getattr(stages, name)()
        times[f"stage_{name}"] = round(time.time() - t, 3)
    warm, exchanges = {}, {}
    for name in HEADLINE:
        for seconds in (times, warm):
            t = time.time()
            frame = QUERIES[name](spark, sf_dir)
            frame.write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - t, 3)
        exchanges[name] = len(re.findall(r"\bExchange ", frame._jdf.queryExecution().executedPlan().toString()))
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "warm": warm, "exchanges": exchanges,
                      "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
