"""Time-of-day tendencies from 30-minute bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.core import div, num, present, rnd, txt

C = F.col
MIN_DAYS = 8


def patterns(bars30: DataFrame) -> DataFrame:
    """Per symbol: mean first-hour, last-hour and overnight move in percent, and intraday_note.

    A day holds at most 48 half-hour bars, so the per-day array is bounded.
    """
    day = bars30.groupBy("symbol", F.to_date("ts").alias("day")).agg(
        F.sort_array(F.collect_list(F.struct("ts", "open", "close"))).alias("b"))
    last = Window.partitionBy("symbol").orderBy("day")
    d = day.select(
        "symbol", "day", F.size("b").alias("n"), F.get("b", 0)["open"].alias("d_open"),
        F.get("b", 1)["close"].alias("first_hour"), F.element_at("b", -1)["close"].alias("d_close"),
        F.when(F.size("b") >= 4, F.get("b", F.size("b") - 3)["close"]).alias("pre_close"))
    d = d.withColumn("prev", F.lag("d_close").over(last))
    nz = lambda c: F.nullif(C(c), num(0))
    move = lambda a, b: F.when(C("n") >= 4, (div(a, nz(b)) - num(1)) * num(100))
    g = d.groupBy("symbol").agg(
        F.sum("n").alias("n_bars"), F.count(move("first_hour", "d_open")).cast("int").alias("n_days"),
        rnd(F.avg(move("first_hour", "d_open")), 2).alias("open_ret_pct"),
        rnd(F.avg(move("d_close", "pre_close")), 2).alias("close_ret_pct"),
        rnd(F.avg(move("d_open", "prev")), 2).alias("gap_pct"))
    g = g.where((C("n_bars") >= 4 * MIN_DAYS) & (C("n_days") >= MIN_DAYS))
    o, c, gap = C("open_ret_pct"), C("close_ret_pct"), C("gap_pct")
    # fixed output texts
    bits = F.slice(present([
        F.when(o <= -0.25, F.concat(F.lit("neigt nach Handelsstart zum Abverkauf (Ø "), txt(o, 1),
                                    F.lit("% 1. Std.) – oft besser 1–2 h nach Open")))
        .when(o >= 0.25, F.concat(F.lit("läuft nach Handelsstart meist an (Ø +"), txt(o, 1), F.lit("% 1. Std.)"))),
        F.when(c >= 0.25, F.concat(F.lit("zieht oft zum Schluss an (Ø +"), txt(c, 1), F.lit("%)")))
        .when(c <= -0.25, F.concat(F.lit("schwächelt oft zum Schluss (Ø "), txt(c, 1), F.lit("%)"))),
        F.when(gap >= 0.4, F.concat(F.lit("öffnet meist mit Gap up (Ø +"), txt(gap, 1),
                                    F.lit("%) – vorbörslich oft schon teuer")))
        .when(gap <= -0.4, F.concat(F.lit("öffnet oft schwächer (Gap Ø "), txt(gap, 1), F.lit("%)")))]), 1, 2)
    g = g.withColumn("_b", bits)
    note = F.when(F.size("_b") > 0, F.concat(F.array_join("_b", " · "), F.lit(" (Muster aus "),
                                             C("n_days").cast("string"), F.lit(" Tagen, keine Garantie)")))
    return g.select("symbol", "open_ret_pct", "close_ret_pct", "gap_pct", "n_days", note.alias("intraday_note"))
