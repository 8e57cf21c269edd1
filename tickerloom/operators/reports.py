"""Rankings and report queries over the snapshot and the portfolio tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.core import clamp, div, num, rint, rnd, txt, yes
from tickerloom.functions.ranks import exact_rank

C = F.col


def rs_rating(rows: DataFrame) -> DataFrame:
    """rs_rating: ordinal rank of ret_60d in percent of the ranked symbols."""
    r = exact_rank(rows, "ret_60d", "ord", "_i", total="_nrs")
    return r.withColumn("rs_rating", rint(div("_i", "_nrs") * num(100))).drop("_i", "_nrs")


def _top(rows: DataFrame, key: Column, n: int | None) -> DataFrame:
    ordered = rows.orderBy(key.desc(), "ord")
    return ordered.limit(n) if n else ordered


def top_daytrade(rows: DataFrame, n: int = 10) -> DataFrame:
    return _top(rows, C("daytrade_score"), n)


def long_opportunity() -> Column:
    return F.coalesce(C("investment_score"), num(0)) + F.coalesce(clamp("exp_return_12m", -30, 50) * num(0.6), num(0))


def top_longterm(rows: DataFrame, n: int = 10) -> DataFrame:
    return _top(rows, long_opportunity(), n)


def top_fundamental(rows: DataFrame, n: int = 10) -> DataFrame:
    return _top(rows.where("fundamental_score is not null"), C("fundamental_score"), n)


def holdings_by_weight(rows: DataFrame) -> DataFrame:
    return _top(rows.where("holder_stance is not null"), F.coalesce(C("holder_weight_pct"), num(0)), None)


def top_hype(rows: DataFrame, n: int = 10) -> DataFrame:
    return _top(rows.where("hype_rank <> 0"), F.coalesce(C("hype_score"), num(0)), n)


def tag_leaderboard(rows: DataFrame, tag_column: str, per_tag: int | None = 60) -> DataFrame:
    """tag, tag_count, place, symbol, elo_score: the best symbols of every tag.

    A tag may hold a large part of the universe: counts are partial aggregates and
    the per-tag places come from a group limit applied before the shuffle.
    """
    t = rows.select("symbol", "ord", "elo_score", F.explode(tag_column).alias("tag"))
    counts = t.groupBy("tag").agg(F.count("*").alias("tag_count"))
    key = F.coalesce(C("elo_score"), F.lit(0))
    if per_tag is None:
        ranked = exact_rank(t.withColumn("_k", key.cast("double")), "_k", "ord", "place", by=["tag"],
                            descending=True, scale=50.0).drop("_k")
    else:
        best = Window.partitionBy("tag").orderBy(key.desc(), "ord")
        ranked = t.withColumn("place", F.row_number().over(best)).where(C("place") <= per_tag)
    return ranked.join(counts, "tag").select("tag", "tag_count", C("place").cast("int").alias("place"), "symbol",
                                             "elo_score")


def entry_opportunity() -> Column:
    bonus = F.when(C("downside_risk") == "gering", num(12)).when(C("downside_risk") == "hoch", num(-18)).otherwise(num(0))
    return rnd(F.coalesce(C("entry_score"), F.lit(0)) * num(0.6) + F.coalesce(C("elo_score"), F.lit(0)) * num(0.3)
               + bonus - num(14) * F.size("risk_warnings"), 1)


def daily_conviction() -> Column:
    bonus = F.when(C("downside_risk") == "gering", num(10)).when(C("downside_risk") == "hoch", num(-25)).otherwise(num(0))
    return rnd(F.coalesce(C("elo_score"), F.lit(0)) * num(0.4) + F.coalesce(C("entry_score"), F.lit(0)) * num(0.35)
               + F.coalesce(F.nullif(C("conviction"), F.lit(0)), F.lit(50)) * num(0.15) + bonus
               + F.when(C("bottoming_n").isNotNull(), num(-8)).otherwise(num(0)), 1)


def best_entries(rows: DataFrame, n: int = 40) -> DataFrame:
    """Names with good timing now, no warning and limited downside, best opportunity first."""
    r = rows.withColumn("entry_opportunity", entry_opportunity())
    return _top(r.where((C("entry_score") >= 58) & (C("elo_score") >= 45) & ~yes(C("downside_risk") == "hoch")
                        & (F.size("risk_warnings") == 0)), C("entry_opportunity"), n)


def daily_top3(rows: DataFrame, n: int = 3) -> DataFrame:
    """The cleanest actionable buy setups (no funds, no coins)."""
    r = rows.withColumn("daily_conviction", daily_conviction())
    return _top(r.where(~F.coalesce(F.array_contains("themes", "ETF"), F.lit(False)) & ~C("listing").endswith("-USD")
                        & C("knife_warn").isNull() & (F.size("risk_warnings") == 0) & (C("entry_score") >= 55)
                        & (C("elo_score") >= 55) & ~yes(C("downside_risk") == "hoch")
                        & (C("trade_plan_long.entry_when") == "now")), C("daily_conviction"), n)


def verdicts(rows: DataFrame) -> DataFrame:
    """Direction verdicts, balance-sheet zone, flags and the three scenarios."""
    base = F.coalesce(C("exp_return_12m"), F.coalesce(F.nullif(C("investment_score"), num(0)), num(50)) - num(50))
    tone, dd, z = C("phase_tone"), C("daytrade_direction"), C("altman_z")
    swing = yes(C("atr_pct") >= 5) | yes(C("beta") >= 1.8)
    # fixed output texts
    return rows.select(
        "symbol",
        F.when(tone == "up", F.lit("up")).when(tone == "down", F.lit("down")).when(tone == "soon", F.lit("side"))
        .when(base >= 3, F.lit("up")).when(base <= -3, F.lit("down")).otherwise(F.lit("side")).alias("invest_direction"),
        F.when(dd == "LONG", F.lit("up")).when(dd == "SHORT", F.lit("down")).otherwise(F.lit("side"))
        .alias("trade_direction"),
        F.when(z > 2.99, F.lit("sicher")).when(z >= 1.81, F.lit("Graubereich")).when(z < 1.81, F.lit("kritisch!"))
        .alias("altman_zone"),
        yes(C("exp_return_12m") < 7).alias("below_market_12m"), swing.alias("high_volatility"),
        F.when(swing, F.concat(F.lit("⚠️ Sehr schwankungsstark"),
                               F.coalesce(F.concat(F.lit(" · ±"), txt("atr_pct", 0), F.lit("%/Tag")), F.lit(""))))
        .alias("volatility_badge"),
        F.concat(txt("exp_return_12m", 0, True), F.lit("%")).alias("scenario_median"),
        F.concat(F.lit("+"), txt("trade_plan_long.potential_pct", 0), F.lit("%")).alias("scenario_chance"),
        F.concat(F.lit("−"), txt("trade_plan_long.risk_pct", 0), F.lit("%")).alias("scenario_risk"))


def equity_vs_benchmark(curve: DataFrame, as_of: date, days: int | None, start_capital: float = 10000.0,
                        benchmarks: Sequence[str] = ("bench_sp500", "bench_ndx", "bench_world")) -> DataFrame:
    """One row: depot and benchmark returns over the range and the mean excess.

    Benchmarks are rebased to the start capital at their first value. First values
    are min_by aggregates, so the curve is never sorted in one task.
    """
    first_known = curve.agg(*[F.min_by(b, F.when(C(b).isNotNull(), C("date"))).alias(f"_f_{b}") for b in benchmarks])
    cut = F.date_sub(F.lit(as_of.isoformat()).cast("date"), days) if days else None
    part = curve.where(C("date") >= cut) if days else curve
    rebased = part.crossJoin(first_known).select("date", "equity", *[
        (div(b, f"_f_{b}") * num(start_capital)).alias(b) for b in benchmarks])
    edge = rebased.agg(F.count("*").alias("points"), *[
        e for c in ("equity", *benchmarks) for e in (F.min_by(c, "date").alias(f"a_{c}"), F.max_by(c, "date").alias(f"z_{c}"))])
    move = {c: F.when((C(f"a_{c}") != 0) & (C("points") >= 2), (div(f"z_{c}", f"a_{c}") - num(1)) * num(100))
            for c in ("equity", *benchmarks)}
    diffs = [move["equity"] - move[b] for b in benchmarks]
    n = sum((d.isNotNull().cast("int") for d in diffs), F.lit(0))
    total = sum((F.coalesce(d, num(0)) for d in diffs), num(0))
    return edge.select("points", rnd(move["equity"], 4).alias("depot_pct"),
                       *[rnd(move[b], 4).alias(f"{b}_pct") for b in benchmarks],
                       rnd(div(total, n), 4).alias("excess_pct"))


def trade_stats(log: DataFrame) -> DataFrame:
    """Closed-trade statistics; a 0 % trade counts as a loss."""
    s = log.where("action = 'SELL'")
    r = C("pnl_pct")
    return s.agg(
        F.count("*").alias("n_trades"), rnd(div(F.count(F.when(r > 0, 1)), F.count(r)) * num(100), 2).alias("hit_rate_pct"),
        rnd(F.avg(r), 4).alias("avg_return_pct"), rnd(F.avg("held_days"), 4).alias("avg_held_days"),
        rnd(F.coalesce(F.avg(F.when(r > 0, r)), num(0)), 4).alias("avg_win_pct"),
        rnd(F.coalesce(F.avg(F.when(r <= 0, r)), num(0)), 4).alias("avg_loss_pct"))


def open_positions(marked: DataFrame, as_of: date) -> DataFrame:
    today = F.lit(as_of.isoformat()).cast("date")
    return marked.select("symbol", "name", "entry_date", F.datediff(today, "entry_date").alias("days_held"),
                         "entry_price", "last_price", "pnl_pct", "stake", "value", "pnl").orderBy(F.desc("pnl"), "symbol")
