"""Point-in-time backtest of the long-term score: quintiles, rank correlation, hit rate.

Scores, returns to later closes and the span of days for which a bar is the newest one come from windows over one
exchange by symbol; a rebalance date then takes the bar whose span holds it. No date loop re-slices history, and no join
by date looks it up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickerloom.functions import scans
from tickerloom.functions.core import div, num, rnd
from tickerloom.functions.ranks import exact_rank
from tickerloom.functions.windows import by_symbol
from tickerloom.operators.scores import longterm_score
from tickerloom.session import cut_lineage

C = F.col
HORIZONS = (21, 63, 126, 252)
MIN_HIST, BUCKETS = 220, 5
YEAR, SPAN = 252, 16


def rebalance_dates(bars: DataFrame) -> DataFrame:
    """Last bar date of each month over all symbols."""
    return bars.groupBy(F.trunc("ts", "month").alias("month")).agg(F.max("ts").alias("rebalance"))


def _eligible_calendar(bars: DataFrame, least: int) -> DataFrame:
    """One row: the rebalance dates (array) of the symbols with more than `least` closes, from months, not from bars."""
    months = bars.where("close is not null").groupBy("symbol", F.trunc("ts", "month").alias("month")).agg(F.max("ts").alias("ts"), F.count("*").alias("n"))
    enough = months.withColumn("_n", F.sum("n").over(Window.partitionBy("symbol"))).where(C("_n") > least)
    return rebalance_dates(enough).agg(F.sort_array(F.collect_list("rebalance")).alias("_dates"))


def eligible(bars: DataFrame, min_hist: int = MIN_HIST, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Bars of the symbols whose history exceeds min_hist + the longest horizon."""
    every = by_symbol().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in time order, so the scores need no other sort
    return (bars.where("close is not null").withColumn("_n", F.count("*").over(every))
            .where(C("_n") > min_hist + max(horizons)).drop("_n"))


def score_series(bars: DataFrame, ahead: dict[str, Column] | None = None) -> DataFrame:
    """symbol, ts, rn (0-based), close and longterm_score at every bar, from that bar's own past only.

    `ahead` names further columns over the same windows (symbol in time order), such as closes to come.
    """
    w = scans.symbol_window()
    c = C("close")
    ahead = ahead or {}
    b = scans.in_order(bars.select("symbol", "ts", "close")).withColumns({"_pc": F.lag("close").over(w), **ahead})
    a12, a26, a9, r = 2 / 13, 2 / 27, 2 / 10, 1 / 14
    first = C("rn") == 0
    seed = lambda x, a: F.when(first, x).otherwise(x * num(a))
    diff = c - C("_pc")
    b = scans.affine_scan(b, {
        "_e12": (seed(c, a12), 1 - a12), "_e26": (seed(c, a26), 1 - a26),
        "_gain": (F.greatest(diff, num(0)), 1 - r), "_loss": (F.greatest(-diff, num(0)), 1 - r)})
    # greatest() skips NULL: the first bar adds 0 to both sums, and the shared weights cancel in gain / loss
    b = b.withColumn("macd", C("_e12") - C("_e26"))
    b = scans.affine_scan(b, {"macd_signal": (seed(C("macd"), a9), 1 - a9)})
    n = C("rn") + 1
    rsi = F.when(n > 14, num(100) - div(num(100), num(1) + div("_gain", F.nullif(C("_loss"), num(0)))))
    # long frames cost O(frame) per row, so means come from running sums and the yearly high from highs of SPAN bars, all
    # over the sort that the scans left
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumns({"_cum": F.sum("close").over(so_far), "_high": F.max("close").over(w.rowsBetween(1 - SPAN, 0))})
    mean = lambda m: F.when(n >= m, (C("_cum") - F.lag("_cum", m, 0.0).over(w)) / num(m))
    # spans may overlap; greatest() skips those before the first bar
    high = F.greatest("_high", *[F.lag("_high", k).over(w) for k in [*range(SPAN, YEAR - SPAN, SPAN), YEAR - SPAN]])
    f = b.select(
        "symbol", "ts", "rn", "close", *ahead, c.alias("price"), "macd", "macd_signal", rsi.alias("rsi"),
        mean(50).alias("sma50"), mean(200).alias("sma200"),
        ((div(c, high) - num(1)) * num(100)).alias("pct_from_high52"),
        F.when(n > 61, (div(c, F.lag("close", 60).over(w)) - num(1)) * num(100)).alias("ret_60d"))
    return f.select("symbol", "ts", "rn", "close", *ahead, longterm_score().alias("longterm_score"))


def forward_returns(bars: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """symbol, ts, n_future and fwd_<h> = return in percent to the close h bars ahead (9 dp)."""
    return bars.select("symbol", "ts", "close", *[e.alias(k) for k, e in _ahead(by_symbol(), horizons).items()])


def _ahead(w: WindowSpec, horizons: Sequence[int]) -> dict[str, Column]:
    fwd = {f"fwd_{h}": rnd((div(F.lead("close", h).over(w), F.nullif(C("close"), num(0))) - num(1)) * num(100), 9)
           for h in horizons}
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return {"n_future": F.count("*").over(every) - F.row_number().over(w), **fwd}


def scored_panel(bars: DataFrame, min_hist: int = MIN_HIST, horizons: Sequence[int] = HORIZONS, by_symbol_: DataFrame | None = None) -> DataFrame:
    """One row per (rebalance date, symbol, horizon): score and forward return.

    A bar is the newest of its symbol from its own day to the day before the next bar, so it serves the rebalance
    dates in between: months without bars take the bar before them, and no grid of symbols and months is built.
    `by_symbol_` are the same bars as they should be dealt to the scoring tasks, by symbol.
    """
    least = min_hist + max(horizons)
    calendar = _eligible_calendar(bars, least)
    w = scans.symbol_window()
    s = score_series(eligible(bars if by_symbol_ is None else by_symbol_, min_hist, horizons), {**_ahead(w, horizons), "_next": F.lead("ts").over(w)})
    # a month's date is not before any of its bars, so a bar followed by one of the same month serves none: most bars never meet the dates
    last_of_month = C("_next").isNull() | (F.trunc("_next", "month") != F.trunc("ts", "month"))
    served = F.filter("_dates", lambda d: (d >= C("ts")) & (C("_next").isNull() | (d < C("_next"))))
    # one row of dates, one a month: a broadcast bounded by the calendar; the row itself needs min_hist bars of history
    # and the shortest horizon ahead
    rows = s.where((C("rn") + 1 >= min_hist) & (C("n_future") >= min(horizons)) & last_of_month).crossJoin(calendar)
    rows = rows.select("symbol", F.explode(served).alias("rebalance"), "longterm_score", *[f"fwd_{h}" for h in horizons])
    long = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), C(f"fwd_{h}").alias("fwd_ret"))
                               for h in horizons])).alias("x")
    # one row per symbol and month from here on; written once because it is read twice below
    rows = cut_lineage(rows)
    names = rows.groupBy("rebalance").agg(F.count("*").alias("_names")).where(C("_names") >= BUCKETS * 3)
    rows = rows.join(names, "rebalance", "left_semi")
    return (rows.select("symbol", "rebalance", "longterm_score", long)
            .select("symbol", "rebalance", "longterm_score", "x.*").where("fwd_ret is not null"))


def ranked_panel(panel: DataFrame, order: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Adds the ordinal score and return ranks, group size n and bucket per (rebalance, horizon).

    Score ties follow `order(symbol, ord)`; return ties follow the score rank.
    """
    by = ["rebalance", "horizon"]
    p = panel.join(order.select("symbol", "ord"), "symbol")
    p = exact_rank(p, "longterm_score", "ord", "score_rank", by=by, total="n", scale=50.0)
    p = p.where(C("n") >= buckets * 3)
    p = exact_rank(p, "fwd_ret", "score_rank", "ret_rank", by=by)
    bucket = F.least(F.lit(buckets - 1), F.floor((C("score_rank") - 1) * buckets / C("n")).cast("int"))
    return p.select("symbol", "rebalance", "horizon", "longterm_score", "fwd_ret", "score_rank", "ret_rank", "n",
                    bucket.cast("int").alias("bucket"))


def bucket_returns(ranked: DataFrame) -> DataFrame:
    """Mean forward return per (rebalance, horizon, bucket), 3 dp."""
    return ranked.groupBy("rebalance", "horizon", "bucket").agg(
        F.count("*").alias("names"), rnd(F.avg("fwd_ret"), 3).alias("avg_fwd_ret"))


def rank_correlation(ranked: DataFrame) -> DataFrame:
    """Spearman correlation per (rebalance, horizon), 4 dp."""
    return ranked.groupBy("rebalance", "horizon").agg(
        F.count("*").alias("names"),
        rnd(F.corr(C("score_rank").cast("double"), C("ret_rank").cast("double")), 4).alias("ic"))


def summary(ranked: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Per horizon: mean IC, pooled bucket means, mean top-minus-bottom spread and hit rate."""
    per = ranked.groupBy("rebalance", "horizon").agg(
        rnd(F.corr(C("score_rank").cast("double"), C("ret_rank").cast("double")), 4).alias("ic"),
        (rnd(F.avg(F.when(C("bucket") == buckets - 1, C("fwd_ret"))), 3)
         - rnd(F.avg(F.when(C("bucket") == 0, C("fwd_ret"))), 3)).alias("spread"))
    dates = per.groupBy("horizon").agg(
        F.count("*").alias("n_dates"), rnd(F.avg("ic"), 3).alias("avg_ic"),
        rnd(F.avg("spread"), 3).alias("top_minus_bottom_pct"),
        rnd(div(F.count(F.when(C("spread") > 0, 1)), F.count("spread")) * num(100), 1).alias("hit_rate_pct"))
    pooled = ranked.groupBy("horizon").agg(*[
        rnd(F.avg(F.when(C("bucket") == b, C("fwd_ret"))), 3).alias(f"bucket_{b}_pct") for b in range(buckets)])
    return dates.join(pooled, "horizon")
