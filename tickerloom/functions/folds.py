"""Recursions that depend on their path, as native folds over an array of bars, and one step of a smoothing.

A fold is a start state, a step and what it shows of a state, so that it can stop after any bar and go on from
the state. A symbol has at most one bar per trading day, so the array is bounded by the calendar (about 25,000
entries per century); flags() takes it chunk by chunk. Each fold is its own column, so only those a query asks
for are evaluated.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickerloom.functions.core import div, let, null, num


@dataclass(frozen=True)
class Fold:
    start: Column
    step: Callable[[Column, Column], Column]
    show: Callable[[Column], Column]

    def over(self, bars: Column) -> Column:
        return F.aggregate(bars, self.start, self.step, self.show)


def flags(bars: Column, folds: dict[str, Fold], carried: Column) -> Column:
    """struct<state, shown>: the folds' states after a chunk of bars that starts from `carried` (or NULL), and what they
    show at every bar of it."""
    start = F.struct(*[f.start.alias(k) for k, f in folds.items()])
    nothing = F.struct(*[f.show(f.start).alias(k) for k, f in folds.items()])

    def step(acc: Column, b: Column) -> Column:
        state = F.struct(*[f.step(acc["state"][k], b).alias(k) for k, f in folds.items()])
        return let(state, lambda s: F.struct(s.alias("state"), F.concat(
            acc["shown"], F.array(F.struct(*[f.show(s[k]).alias(k) for k, f in folds.items()]))).alias("shown")))

    return F.aggregate(bars, F.struct(F.coalesce(carried, start).alias("state"), F.slice(F.array(nothing), 1, 0).alias("shown")), step)


def ewm_start() -> Column:
    return F.struct(null().alias("avg"), num(1).alias("w"), F.lit(0).alias("n"))


def ewm_step(s: Column, x: Column, alpha: float, adjust: bool) -> Column:
    """One step of an exponentially weighted mean whose weights also decay over missing values."""
    decayed = s["w"] * num(1 - alpha)
    gain = num(1.0 if adjust else alpha)
    avg = (F.when(x.isNull(), s["avg"]).when(s["avg"].isNull(), x)
           .otherwise((decayed * s["avg"] + gain * x) / (decayed + gain)))
    w = (F.when(s["avg"].isNull(), num(1)).when(x.isNull(), decayed)
         .otherwise(decayed + num(1) if adjust else num(1)))
    return F.struct(avg.alias("avg"), w.alias("w"),
                    (s["n"] + F.when(x.isNull(), 0).otherwise(1)).alias("n"))


def ready(s: Column, min_periods: int) -> Column:
    return F.when(s["n"] >= min_periods, s["avg"])


def _true_range(b: Column, prev_close: Column) -> Column:
    return F.greatest(b["high"] - b["low"], F.abs(b["high"] - prev_close), F.abs(b["low"] - prev_close))


def supertrend_fold(period: int = 10, mult: float = 3.0) -> Fold:
    """TRUE while the close holds above the trailing band; comparisons with a missing band are false."""
    start = F.struct(ewm_start().alias("tr"), null().alias("fu"), null().alias("fl"),
                     F.lit(True).alias("up"), null().alias("pc"), F.lit(0).alias("i"))

    def step(s: Column, b: Column) -> Column:
        smooth = let(_true_range(b, s["pc"]), lambda tr: ewm_step(s["tr"], tr, 1.0 / period, False))
        middle = (b["high"] + b["low"]) / num(2)

        def moved(e: Column) -> Column:
            u, l = middle + num(mult) * ready(e, period), middle - num(mult) * ready(e, period)
            return F.struct(
                e.alias("tr"),
                F.when(s["pc"] <= s["fu"], F.least(u, s["fu"])).otherwise(u).alias("fu"),
                F.when(s["pc"] >= s["fl"], F.greatest(l, s["fl"])).otherwise(l).alias("fl"),
                F.when(b["close"] > s["fu"], F.lit(True)).when(b["close"] < s["fl"], F.lit(False))
                .otherwise(s["up"]).alias("up"),
                b["close"].alias("pc"), (s["i"] + 1).alias("i"))

        return let(smooth, moved)

    return Fold(start, step, lambda s: F.when(s["i"] > 1, s["up"]))


def supertrend(bars: Column) -> Column:
    return supertrend_fold().over(bars)


def psar_start() -> Column:
    return F.struct(null().alias("ps"), null().alias("ep"), num(0.02).alias("af"), F.lit(True).alias("bull"),
                    null().alias("c"))


def sar_fold(first: float = 0.02, cap: float = 0.2) -> Fold:
    """TRUE when the last close is above the stop-and-reverse level (no two-bar clamp)."""

    def step(s: Column, b: Column) -> Column:
        cand = s["ps"] + s["af"] * (s["ep"] - s["ps"])
        faster = F.least(s["af"] + num(first), num(cap))

        def state(ps: Column, ep: Column, af: Column, bull: Column) -> Column:
            return F.struct(ps.alias("ps"), ep.alias("ep"), af.alias("af"), bull.alias("bull"), b["close"].alias("c"))

        def held(ext: Column, extreme: Column) -> Column:
            return state(cand, F.when(ext, extreme).otherwise(s["ep"]), F.when(ext, faster).otherwise(s["af"]), s["bull"])

        # a comparison with a missing value is no flip; each branch builds its own state, so a test is evaluated once
        begin = state(b["low"], b["high"], num(first), F.lit(True))
        rising = F.when(b["low"] < cand, state(s["ep"], b["low"], num(first), F.lit(False))).otherwise(held(b["high"] > s["ep"], b["high"]))
        falling = F.when(b["high"] > cand, state(s["ep"], b["high"], num(first), F.lit(True))).otherwise(held(b["low"] < s["ep"], b["low"]))
        return F.when(s["ps"].isNull(), begin).when(s["bull"], rising).otherwise(falling)

    return Fold(psar_start(), step, lambda s: s["c"] > s["ps"])


def parabolic_sar(bars: Column) -> Column:
    return sar_fold().over(bars)
