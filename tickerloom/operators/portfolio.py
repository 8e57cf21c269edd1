"""Daily portfolio revision as a set-based merge: state tables in, state tables out.

`account` has one row and `positions` at most `k` rows, so both are small by design;
the candidate side is the whole scored universe.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.core import div, int_txt, num, rnd, txt, yes

C = F.col


@dataclass(frozen=True)
class Rules:
    """Fixed values of the revision rules."""

    k: int = 10
    hysteresis: int = 6
    hard_stop: float = -22.0
    trail_arm: float = 12.0
    trail_giveback: float = 10.0
    sell_score: int = 50
    hold_score: int = 60
    buy_score: int = 60
    max_per_sector: int = 3
    pool: int = 50
    min_stake: float = 50.0


def mark(positions: DataFrame, rows: DataFrame) -> DataFrame:
    """Marks positions to the current price: running peak, value and pnl. Symbols without a price keep their marks."""
    old = lambda c: C(c) if c in positions.columns else F.lit(None).cast("double")
    p = rows.select("symbol", C("price").alias("_cur"))
    j = positions.join(p, "symbol", "left")
    cur = F.when((C("_cur") != 0) & (C("entry_price") != 0), C("_cur"))
    value = rnd(div(C("stake") * cur, "entry_price"), 2)
    peak = F.coalesce(F.nullif(C("peak_price"), num(0)), C("entry_price"))
    return j.select(
        "symbol", "name", "entry_price", "entry_date", "stake", "score_at_entry",
        F.when(cur.isNotNull(), rnd(F.greatest(peak, cur), 4)).otherwise(C("peak_price")).alias("peak_price"),
        F.coalesce(rnd(cur, 4), old("last_price")).alias("last_price"),
        F.coalesce(value, old("value")).alias("value"),
        F.coalesce(rnd(value - C("stake"), 2), old("pnl")).alias("pnl"),
        F.coalesce(rnd((div(cur, "entry_price") - num(1)) * num(100), 2), old("pnl_pct")).alias("pnl_pct"))


def _best(rows: DataFrame, n: int) -> DataFrame:
    """The n best symbols by score with their position 1..n (n is a small constant)."""
    top = rows.where("elo_score is not null").orderBy(F.desc("elo_score"), "ord").limit(n)
    return top.withColumn("_pos", F.row_number().over(Window.orderBy(F.desc("elo_score"), "ord")))


def sells(marked: DataFrame, rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Positions to close with the first matching rule as sell_code / reason."""
    held = _best(rows, rules.k + rules.hysteresis).select("symbol", F.lit(True).alias("_in_top"))
    r = rows.select("symbol", C("price").alias("_cur"), C("elo_score").alias("_score"), "phase_code")
    j = marked.join(r, "symbol", "left").join(held, "symbol", "left").where(C("_cur") != 0)
    entry, cur = C("entry_price"), C("_cur")
    peak = F.coalesce(F.nullif(C("peak_price"), num(0)), entry)
    ret, give = (div(cur, entry) - num(1)) * num(100), (div(cur, peak) - num(1)) * num(100)
    gain = (div(peak, entry) - num(1)) * num(100)
    score = F.coalesce("_score", F.lit(0))
    code = (F.when(ret <= rules.hard_stop, F.lit("hard_stop"))
            .when((gain >= rules.trail_arm) & (give <= -rules.trail_giveback), F.lit("trailing_stop"))
            .when(C("phase_code") == "down", F.lit("downtrend"))
            .when(score < rules.sell_score, F.lit("score"))
            .when(C("_in_top").isNull() & (score < rules.hold_score), F.lit("dropped")))
    r0, g0 = txt(ret, 0, True), txt(give, 0)
    # fixed output texts
    reason = (F.when(C("sell_code") == "hard_stop", F.concat(F.lit("Not-Stop ("), r0, F.lit("%)")))
              .when(C("sell_code") == "trailing_stop", F.concat(
                  F.lit("Trailing-Stop – Gewinn gesichert ("), r0, F.lit("%, vom Hoch "), g0, F.lit("%)")))
              .when(C("sell_code") == "downtrend", F.concat(
                  F.lit("Trend gedreht (Abwärtstrend) → raus ("), r0, F.lit("%)")))
              .when(C("sell_code") == "score", F.concat(
                  F.lit("Rating auf "), int_txt(score), F.lit(" gefallen → These weg ("), r0, F.lit("%)")))
              .otherwise(F.concat(F.lit("aus den Top-Tipps gefallen ("), r0, F.lit("%)"))))
    change = F.when(C("score_at_entry") != C("_score"), F.concat(
        F.lit(" · Rating "), int_txt("score_at_entry"), F.lit("→"), int_txt("_score")))
    value = div(C("stake") * cur, entry)
    return j.withColumn("sell_code", code).where("sell_code is not null").select(
        "symbol", "name", "sell_code", rnd(cur, 4).alias("price"), "stake", value.alias("raw_value"),
        (value - C("stake")).alias("raw_pnl"), rnd(value, 2).alias("value"), rnd(value - C("stake"), 2).alias("pnl"),
        rnd(ret, 2).alias("pnl_pct"), C("score_at_entry").alias("score_entry"), C("_score").alias("score_exit"),
        "entry_date", F.concat(reason, F.coalesce(change, F.lit(""))).alias("reason"))


def buys(marked: DataFrame, sold: DataFrame, rows: DataFrame, account: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """New positions for the free slots.

    Taking candidates best first while a sector has room equals: rank within the
    sector up to its free places, then rank overall up to the free slots, then the
    cash test, because a skipped name uses neither slot nor cash.
    """
    kept = marked.join(sold.select("symbol"), "symbol", "left_anti")
    sector = F.coalesce(F.nullif(C("sector"), F.lit("")), F.lit("?"))
    known = rows.select("symbol", sector.alias("sector"))
    held = (kept.join(known, "symbol", "left").groupBy(F.coalesce("sector", F.lit("?")).alias("sector"))
            .agg(F.count("*").alias("_held")))
    book = (account.crossJoin(kept.agg(F.coalesce(F.sum("value"), num(0)).alias("_inv"), F.count("*").alias("_open")))
            .crossJoin(sold.agg(F.coalesce(F.sum("raw_value"), num(0)).alias("_freed")))
            .select((C("cash") + C("_freed")).alias("_cash"), (F.lit(rules.k) - C("_open")).alias("_slots"),
                    ((C("cash") + C("_freed") + C("_inv")) / num(rules.k)).alias("_stake")))
    cand = (_best(rows, rules.pool).withColumn("sector", sector)
            .where((C("price") != 0) & (C("elo_score") >= rules.buy_score)
                   & ~yes(C("phase_code") == "down") & ~yes(C("holder_stance") == "SHORT_BET"))
            .join(kept.select("symbol"), "symbol", "left_anti")
            .join(held, "sector", "left"))
    room = F.lit(rules.max_per_sector) - F.coalesce("_held", F.lit(0))
    cand = (cand.withColumn("_in", F.row_number().over(Window.partitionBy("sector").orderBy("_pos")))
            .where((C("sector") == "?") | (C("_in") <= room)).crossJoin(book))
    # at most `pool` rows are left here
    cand = cand.withColumn("_i", F.row_number().over(Window.orderBy("_pos")))
    stake = F.least(C("_stake"), C("_cash") - (C("_i") - 1) * C("_stake"))
    return (cand.withColumn("_s", stake).where((C("_i") <= C("_slots")) & (C("_s") >= rules.min_stake))
            .select("symbol", "name", "sector", rnd("price", 4).alias("entry_price"), rnd("_s", 2).alias("stake"),
                    C("_s").alias("raw_stake"), C("elo_score").alias("score_at_entry"), C("_i").alias("buy_rank")))


def of_day(df: DataFrame, account: DataFrame) -> DataFrame:
    """Rows of df, none when the account already traded today: a second revision of a day changes nothing."""
    open_day = account.where(~yes(C("last_trade_date") == C("today"))).select(F.lit(1).alias("_day"))  # one row or none
    return df.crossJoin(open_day).drop("_day")


def trades(sold: DataFrame, bought: DataFrame, account: DataFrame) -> DataFrame:
    """Trade log rows of the day; none when the account already traded on that date."""
    day = account.where(~yes(C("last_trade_date") == C("today"))).select(C("today").alias("date"))
    s = sold.crossJoin(day).select(
        "date", F.lit("SELL").alias("action"), "symbol", "name", "price", rnd("stake", 2).alias("stake"), "value",
        "pnl", "pnl_pct", C("score_entry"), C("score_exit"), F.datediff("date", "entry_date").alias("held_days"),
        "reason")
    b = bought.crossJoin(day).select(
        "date", F.lit("BUY").alias("action"), "symbol", "name", C("entry_price").alias("price"), "stake",
        C("stake").alias("value"), num(0).alias("pnl"), num(0).alias("pnl_pct"),
        F.lit(None).cast("int").alias("score_entry"), F.lit(None).cast("int").alias("score_exit"),
        F.lit(None).cast("int").alias("held_days"),
        F.concat(F.lit("Top-Tipp gekauft (Score "), int_txt("score_at_entry"), F.lit(")")).alias("reason"))
    return s.unionByName(b)


def next_positions(marked: DataFrame, sold: DataFrame, bought: DataFrame, account: DataFrame) -> DataFrame:
    """Open positions after the revision."""
    sold, bought = of_day(sold, account), of_day(bought, account)
    kept = marked.join(sold.select("symbol"), "symbol", "left_anti")
    new = bought.crossJoin(account.select("today")).select(
        "symbol", "name", "entry_price", C("today").alias("entry_date"), "stake", "score_at_entry",
        C("entry_price").alias("peak_price"), C("entry_price").alias("last_price"), C("stake").alias("value"),
        num(0).alias("pnl"), num(0).alias("pnl_pct"))
    return kept.unionByName(new)


def snapshot(after: DataFrame, sold: DataFrame, bought: DataFrame, account: DataFrame,
             macro: DataFrame) -> DataFrame:
    """One equity_curve row for the day, with the benchmark levels."""
    sold, bought = of_day(sold, account), of_day(bought, account)
    total = lambda df, c, n: df.agg(F.coalesce(F.sum(c), num(0)).alias(n))
    b = (account.crossJoin(total(sold, "raw_value", "_in")).crossJoin(total(bought, "raw_stake", "_out"))
         .crossJoin(after.agg(F.coalesce(F.sum("value"), num(0)).alias("_inv"), F.count("*").alias("n_positions")))
         .crossJoin(macro.select("spx", "ndx", "world")))
    cash = C("cash") + C("_in") - C("_out")
    return b.select(C("today").alias("date"), rnd(cash + C("_inv"), 2).alias("equity"), rnd(cash, 2).alias("cash"),
                    rnd("_inv", 2).alias("invested"), C("n_positions").cast("int").alias("n_positions"),
                    rnd("spx", 2).alias("bench_sp500"), rnd("ndx", 2).alias("bench_ndx"),
                    rnd("world", 2).alias("bench_world"))


def totals(curve_row: DataFrame, sold: DataFrame, log: DataFrame, account: DataFrame) -> DataFrame:
    """Total return, realised pnl and counts after the revision."""
    sold = of_day(sold, account)
    n = log.agg(F.count("*").alias("n_trades"))
    pnl = sold.agg(F.coalesce(F.sum("raw_pnl"), num(0)).alias("_pnl"))
    return (curve_row.crossJoin(account.select("start_capital", "realized_pnl")).crossJoin(pnl).crossJoin(n)
            .select("equity", "cash", "invested",
                    rnd((div("equity", "start_capital") - num(1)) * num(100), 2).alias("total_return_pct"),
                    rnd(C("realized_pnl") + C("_pnl"), 2).alias("realized_pnl"), "n_positions", "n_trades"))


def next_account(sold: DataFrame, bought: DataFrame, account: DataFrame) -> DataFrame:
    """The account that the next day's revision reads; unchanged by a second revision of a day."""
    s, b = of_day(sold, account), of_day(bought, account)
    cash = b.agg(F.coalesce(F.sum("raw_stake"), num(0)).alias("_out"))
    got = s.agg(F.coalesce(F.sum("raw_value"), num(0)).alias("_in"), F.coalesce(F.sum("raw_pnl"), num(0)).alias("_pnl"))
    return account.crossJoin(got).crossJoin(cash).select(
        "start_capital", rnd(C("cash") + C("_in") - C("_out"), 2).alias("cash"),
        rnd(C("realized_pnl") + C("_pnl"), 2).alias("realized_pnl"), C("today").alias("last_trade_date"))
