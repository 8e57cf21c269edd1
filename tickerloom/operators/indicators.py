"""Technical indicators per symbol.

`window_features` adds the finite-window indicators to every bar it is given (series
shape), `smoothed_features` the recursive ones, as prefix scans of affine maps.
`latest_features` is the snapshot shape of both: one scan and one exchange by symbol, then one aggregate.
`tail_features` has the finite windows alone and cuts the newest TAIL rows of a symbol before the shuffle.
`summaries` keeps what the recursions need of a history, `advanced` takes it over newer bars.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions import folds, scans
from tickerloom.functions.core import div, finite, let, num, rnd
from tickerloom.functions.windows import by_symbol, rolling, trailing
from tickerloom.session import stored

YEAR = 252
TAIL = 280  # longest look-back of the finite windows is 252 rows; 222 for the month-old SMA200
MIN_BASIC, MIN_ADVANCED = 30, 40

# Cloud labels and retracement labels.
ABOVE_CLOUD, IN_CLOUD, BELOW_CLOUD = "über Wolke", "in Wolke", "unter Wolke"
FIB_LABELS = ("0%", "23.6%", "38.2%", "50%", "61.8%", "100%")

BASIC = ("price", "prev_close", "daily_return", "sma20", "sma50", "sma200", "bb_pctb", "bb_bandwidth", "vol",
         "vol_avg20", "rvol", "high20", "low20", "high52", "low52", "pct_from_high52", "ret_5d", "ret_20d",
         "ret_60d", "vol_daily", "sma150", "sma150_1m_ago", "sma200_1m_ago", "pct_above_low52")
ADVANCED = ("stoch_k", "stoch_d", "williams_r", "cci", "roc10", "obv_rising", "mfi", "cmf", "aroon_up",
            "aroon_down", "ichimoku", "tenkan_above_kijun", "vol_annual_pct", "pivot", "pivot_r1", "pivot_s1",
            "range_pos_pct", "fib_nearest")
FOLDED = ("macd", "macd_signal", "macd_hist", "macd_hist_prev", "rsi", "atr", "ema9", "ema21", "ema9_above_21",
          "adx", "plus_di", "minus_di", "supertrend_up", "psar_bull", "keltner_pos", "max_drawdown_pct")


def clean_bars(bars: DataFrame) -> DataFrame:
    """Typed bars without NaN, infinities and rows that hold no value at all."""
    ohlcv = ["open", "high", "low", "close", "volume"]
    return bars.select("symbol", "ts", *[finite(F.col(c).cast("double")).alias(c) for c in ohlcv]).na.drop(
        how="all", subset=ohlcv)


def one_a_day(bars: DataFrame) -> DataFrame:
    """Of bars with equal symbol and ts the one with the largest volume stays (ties by close, high, low, open).

    The sort by symbol and time that every window needs serves this as well.
    """
    w = Window.partitionBy("symbol").orderBy("ts", "volume", "close", "high", "low", "open")
    return bars.withColumn("_next", F.lead("ts").over(w)).where("_next is null or _next <> ts").drop("_next")


def _aroon(extreme: Column, series: Column, n: int = 25, classic: bool = False) -> Column:
    """(n - bars from the window start to the first extreme) / n * 100; `classic` counts from the newest bar."""
    span = trailing(n + 1)
    first = F.array_position(F.collect_list(series).over(span), extreme.over(span)).cast("double") - num(1)
    score = first if classic else num(n) - first
    return F.when(F.count(series).over(span) == n + 1, score / num(n) * num(100))


def window_features(bars: DataFrame, classic_aroon: bool = False) -> DataFrame:
    """All finite-window indicators, one row per bar. One exchange and one sort by symbol serve every window."""
    w = by_symbol()
    c, h, l, v = (F.col(x) for x in ("close", "high", "low", "volume"))
    n = F.col("_n")
    tp = (h + l + c) / num(3)
    b = bars.withColumns({
        "_n": F.row_number().over(w),
        "prev_close": F.lag("close", 1).over(w),
        "_ph": F.lag("high", 1).over(w), "_pl": F.lag("low", 1).over(w), "_pv": F.lag("volume", 1).over(w),
        "_tp": tp,
    })
    b = b.withColumns({
        "_lr": F.ln(div("close", F.nullif(F.col("prev_close"), num(0)))),
        "_ptp": (F.col("_ph") + F.col("_pl") + F.col("prev_close")) / num(3),
        "_ll14": rolling(F.min(l), l, 14), "_hh14": rolling(F.max(h), h, 14),
        "_sma_tp": rolling(F.avg("_tp"), F.col("_tp"), 20),
        "sma20": rolling(F.avg(c), c, 20), "sma50": rolling(F.avg(c), c, 50),
        "sma150": rolling(F.avg(c), c, 150), "sma200": rolling(F.avg(c), c, 200),
        "_sd20": rolling(F.stddev_samp(c), c, 20),
        "vol_avg20": rolling(F.avg(v), v, 20),
        "high20": F.when(F.count(c).over(w.rowsBetween(-20, -1)) == 20, F.max(c).over(w.rowsBetween(-20, -1))),
        "low20": F.when(F.count(c).over(w.rowsBetween(-20, -1)) == 20, F.min(c).over(w.rowsBetween(-20, -1))),
        "high52": F.max(c).over(trailing(YEAR)), "low52": F.min(c).over(trailing(YEAR)),
        "_h52": F.max(h).over(trailing(YEAR)), "_l52": F.min(l).over(trailing(YEAR)),
        "_signed": F.coalesce(F.signum(c - F.col("prev_close")), num(0)) * v,
        "_mfm": div((c - l) - (h - c), F.nullif(h - l, num(0))),
        "_tenkan": (rolling(F.max(h), h, 9) + rolling(F.min(l), l, 9)) / num(2),
        "_kijun": (rolling(F.max(h), h, 26) + rolling(F.min(l), l, 26)) / num(2),
        "_span_b": (rolling(F.max(h), h, 52) + rolling(F.min(l), l, 52)) / num(2),
        "aroon_up": _aroon(F.max(h), h, classic=classic_aroon),
        "aroon_down": _aroon(F.min(l), l, classic=classic_aroon),
    })
    k = num(100) * div(c - F.col("_ll14"), F.nullif(F.col("_hh14") - F.col("_ll14"), num(0)))
    mf = F.col("_tp") * v
    b = b.withColumns({
        "stoch_k": k,
        "_dev": F.abs(F.col("_tp") - F.col("_sma_tp")),
        "_up": F.when(F.col("_tp") > F.col("_ptp"), mf).otherwise(num(0)),
        "_dn": F.when(F.col("_tp") < F.col("_ptp"), mf).otherwise(num(0)),
        "_mv": F.col("_mfm") * v,
    })
    width = F.col("_upper") - F.col("_lower")
    back = lambda m: (div(c, F.lag(c, m).over(w)) - num(1)) * num(100)
    lrs = F.col("_lr")
    span_a = (F.col("_tenkan") + F.col("_kijun")) / num(2)
    b = b.withColumns({
        "_upper": F.col("sma20") + num(2) * F.col("_sd20"), "_lower": F.col("sma20") - num(2) * F.col("_sd20"),
        "_mad": rolling(F.avg("_dev"), F.col("_dev"), 20),
        "_pos": rolling(F.sum("_up"), F.col("_up"), 14), "_neg": rolling(F.sum("_dn"), F.col("_dn"), 14),
        "_top": F.greatest(span_a, F.col("_span_b")), "_bot": F.least(span_a, F.col("_span_b")),
        "_cloud": span_a.isNotNull() & F.col("_span_b").isNotNull(),
        "_lrn": F.count(lrs).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    })
    # returns are numbered without gaps, so a look-back of n returns skips missing closes
    returns = lambda m: Window.partitionBy("symbol").orderBy("_lrn").rangeBetween(1 - m, 0)
    rng = F.nullif(F.col("_h52") - F.col("_l52"), num(0))
    levels = F.array(*[
        F.struct(F.abs(level - c).alias("d"), F.lit(i).alias("i"), F.lit(label).alias("label"))
        for i, (label, level) in enumerate(zip(FIB_LABELS, (
            F.col("_l52"), F.col("_h52") - num(0.236) * rng, F.col("_h52") - num(0.382) * rng,
            (F.col("_h52") + F.col("_l52")) / num(2), F.col("_h52") - num(0.618) * rng, F.col("_h52"))))
    ])
    pivot = (h + l + c) / num(3)
    basic = {
        "price": c, "prev_close": F.col("prev_close"), "daily_return": div("close", "prev_close") - num(1),
        "sma20": F.col("sma20"), "sma50": F.col("sma50"), "sma200": F.col("sma200"),
        "bb_pctb": div(c - F.col("_lower"), width), "bb_bandwidth": num(100) * div(width, "sma20"),
        "vol": v, "vol_avg20": F.col("vol_avg20"), "rvol": div(v, "vol_avg20"),
        "high20": F.col("high20"), "low20": F.col("low20"), "high52": F.col("high52"), "low52": F.col("low52"),
        "pct_from_high52": (div(c, "high52") - num(1)) * num(100),
        "ret_5d": F.when(n > 6, back(5)), "ret_20d": F.when(n > 21, back(20)), "ret_60d": F.when(n > 61, back(60)),
        "vol_daily": F.when(F.col("_lrn") >= 20, F.stddev_samp(lrs).over(returns(60))),
        "sma150": F.col("sma150"),
        "sma150_1m_ago": F.when(n >= 172, F.lag("sma150", 21).over(w)),
        "sma200_1m_ago": F.when(n >= 222, F.lag("sma200", 21).over(w)),
        "pct_above_low52": (div(c, "low52") - num(1)) * num(100),
    }
    advanced = {
        "stoch_k": F.col("stoch_k"), "stoch_d": rolling(F.avg("stoch_k"), F.col("stoch_k"), 3),
        "williams_r": num(-100) * div(F.col("_hh14") - c, F.col("_hh14") - F.col("_ll14")),
        "cci": div(F.col("_tp") - F.col("_sma_tp"), num(0.015) * F.col("_mad")),
        "roc10": F.when(n > 11, back(10)),
        "obv_rising": F.when(n > 21, F.sum("_signed").over(trailing(20)) > 0),
        "mfi": num(100) - div(num(100), num(1) + div("_pos", F.nullif(F.col("_neg"), num(0)))),
        "cmf": div(rolling(F.sum("_mv"), F.col("_mv"), 20), rolling(F.sum(v), v, 20)),
        "aroon_up": F.col("aroon_up"), "aroon_down": F.col("aroon_down"),
        "ichimoku": F.when(F.col("_cloud"), F.when(c > F.col("_top"), F.lit(ABOVE_CLOUD))
                           .when(c < F.col("_bot"), F.lit(BELOW_CLOUD)).otherwise(F.lit(IN_CLOUD))),
        "tenkan_above_kijun": F.coalesce(F.col("_tenkan") > F.col("_kijun"), F.lit(False)),
        "vol_annual_pct": F.when(F.col("_lrn") >= 30, F.stddev_samp(lrs).over(returns(YEAR))
                                 * F.sqrt(num(YEAR)) * num(100)),
        "pivot": pivot, "pivot_r1": num(2) * pivot - l, "pivot_s1": num(2) * pivot - h,
        "range_pos_pct": rnd(div(c - F.col("_l52"), rng) * num(100), 1),
        "fib_nearest": F.when(rng.isNotNull(), F.array_min(levels)["label"]),
    }
    return b.select("symbol", "ts", n.alias("n_bars"), *[e.alias(k) for k, e in basic.items()],
                    *[F.when(n >= MIN_ADVANCED, e).alias(k) for k, e in advanced.items()])


def tail_features(bars: DataFrame) -> DataFrame:
    """Finite-window indicators of the newest bar per symbol, without the volatilities (those count returns, not rows).

    The newest TAIL rows are numbered from the end (rr = 1 is the newest), so that the cut is a group limit before the shuffle.
    """
    newest = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    b = (bars.withColumn("_rr", F.row_number().over(newest)).where(F.col("_rr") <= TAIL)
         .withColumns({f"_p{x[0]}": F.lead(x, 1).over(newest) for x in ("close", "high", "low")}))
    b = b.withColumns({"_lk": F.lit(None).cast("long"), "_lr": F.lit(None).cast("double")})
    g, chosen = _finite(b)
    return _enough(g.agg).select("symbol", *chosen).drop("vol_daily", "vol_annual_pct")


def _from_the_end(bars: DataFrame) -> DataFrame:
    """Bars in order with the bar before (_pc, _ph, _pl), place from the end (_rr), log return and its place from the end (_lk)."""
    b = scans.in_order(one_a_day(bars))
    w, every = scans.symbol_window(), Window.partitionBy("symbol")
    b = b.withColumns({f"_p{x[0]}": F.lag(x, 1).over(w) for x in ("close", "high", "low")})
    b = b.withColumn("_lr", F.ln(div("close", F.nullif(F.col("_pc"), num(0)))))
    b = b.withColumns({"_rr": F.count("*").over(every) - F.col("rn"), "_lc": F.count("_lr").over(w.rowsBetween(Window.unboundedPreceding, 0)),
                       "_all": F.count("_lr").over(every)})
    return b.withColumn("_lk", F.when(F.col("_lr").isNotNull(), F.col("_all") - F.col("_lc") + 1)).drop("_lc", "_all")


def _blend(old: Column, x: Column, alpha: float, gap: Column | None = None) -> Column:
    """A mean one value later, `gap` bars after its last one (always 1 if not given)."""
    kept = num(1 - alpha) * old + num(alpha) * x
    if gap is None:
        return kept
    decayed = F.pow(num(1 - alpha), gap)
    return F.when(gap == 1, kept).otherwise((decayed * old + num(alpha) * x) / (decayed + num(alpha)))


def _of_closes(path: Column) -> Column:
    """Fold of the closes: the EMAs, MACD with signal and histogram, the worst drawdown and the number of closes.

    `gap` is the distance of the next bar to the last close, 0 before the first. Each case builds its own state.
    """
    start = F.struct(F.lit(0).alias("gap"), F.lit(0).alias("n"), *[F.lit(None).cast("double").alias(k) for k in (*EMA, "signal", "hist", "before", "peak", "worst")])

    def step(s: Column, b: Column) -> Column:
        c = b["close"]

        def state(gap: Column, n: Column, emas: dict[str, Column], signal: Column, peak: Column, worst: Column) -> Column:
            return F.struct(gap.alias("gap"), n.alias("n"), *[e.alias(k) for k, e in emas.items()], signal.alias("signal"), (emas["ema12"] - emas["ema26"] - signal).alias("hist"),
                            s["hist"].alias("before"), peak.alias("peak"), worst.alias("worst"))

        def later(emas: dict[str, Column], gap: Column, n: Column, peak: Column, worst: Column) -> Column:
            return state(gap, n, emas, _blend(s["signal"], emas["ema12"] - emas["ema26"], SIGNAL), peak, worst)

        same = {k: s[k] for k in EMA}
        peak = F.greatest(s["peak"], c)
        seen = lambda gap: later({k: _blend(s[k], c, a, gap) for k, a in EMA.items()}, F.lit(1), s["n"] + 1, peak, F.least(s["worst"], div(c, peak) - num(1)))
        return (F.when(c.isNull() & (s["gap"] == 0), s)
                .when(c.isNull(), later(same, s["gap"] + 1, s["n"], s["peak"], s["worst"]))
                .when(s["gap"] == 0, state(F.lit(1), F.lit(1), {k: c for k in EMA}, num(0), c, div(c, c) - num(1)))
                .when(s["gap"] == 1, seen(None)).otherwise(seen(s["gap"])))

    return F.aggregate(path, start, step)


def _of_moves(path: Column) -> Column:
    """Fold of the moves from bar to bar: sums and weights of gains, losses and ranges, Wilder's means, and the mean of DX."""

    def move(b: Column, i: Column) -> Column:
        p = F.get(path, i - 1)
        diff, up, down = b["close"] - p["close"], b["high"] - p["high"], p["low"] - b["low"]
        return F.struct(F.greatest(diff, num(0)).alias("gain"), F.greatest(-diff, num(0)).alias("loss"), diff.isNotNull().alias("moved"),
                        F.greatest(b["high"] - b["low"], F.abs(b["high"] - p["close"]), F.abs(b["low"] - p["close"])).alias("range"),
                        F.when((up > down) & (up > 0), up).otherwise(num(0)).alias("up"), F.when((down > up) & (down > 0), down).otherwise(num(0)).alias("down"))

    empty = lambda *names: [F.lit(None).cast("double").alias(k) for k in names]
    zeros = lambda *names: [num(0).alias(k) for k in names]
    counts = lambda *names: [F.lit(0).alias(k) for k in names]
    start = F.struct(*zeros("gain", "loss", "moved_w", "range", "range_w"), *empty("wilder", "plus", "minus", "dx"), *counts("moved_n", "range_n", "gap", "n", "dx_gap", "dx_n"))

    def step(s: Column, m: Column) -> Column:
        q, ranged = num(1 - WILDER), m["range"].isNotNull()
        moved = lambda k, x: (s[k] * q + F.when(m["moved"], x).otherwise(num(0))).alias(k)
        directed = lambda k, x: F.when(s["n"] == 0, x).otherwise(_blend(s[k], x, WILDER)).alias(k)
        first = F.struct(
            moved("gain", m["gain"]), moved("loss", m["loss"]), moved("moved_w", num(1)), (s["range"] * q + F.coalesce(m["range"], num(0))).alias("range"),
            (s["range_w"] * q + F.when(ranged, num(1)).otherwise(num(0))).alias("range_w"),
            F.when(~ranged, s["wilder"]).when(s["gap"] == 0, m["range"]).otherwise(_blend(s["wilder"], m["range"], WILDER, s["gap"])).alias("wilder"),
            directed("plus", m["up"]), directed("minus", m["down"]),
            (s["moved_n"] + m["moved"].cast("int")).alias("moved_n"), (s["range_n"] + ranged.cast("int")).alias("range_n"),
            F.when(ranged, F.lit(1)).when(s["gap"] > 0, s["gap"] + 1).otherwise(F.lit(0)).alias("gap"), (s["n"] + 1).alias("n"))

        def second(e: Column) -> Column:
            def with_dx(dx: Column) -> Column:
                there = dx.isNotNull()
                mean = F.when(~there, s["dx"]).when(s["dx_gap"] == 0, dx).otherwise(_blend(s["dx"], dx, WILDER, s["dx_gap"]))
                return F.struct(*[e[k].alias(k) for k in ("gain", "loss", "moved_w", "range", "range_w", "wilder", "plus", "minus")], mean.alias("dx"),
                                *[e[k].alias(k) for k in ("moved_n", "range_n", "gap", "n")],
                                F.when(there, F.lit(1)).when(s["dx_gap"] > 0, s["dx_gap"] + 1).otherwise(F.lit(0)).alias("dx_gap"), (s["dx_n"] + there.cast("int")).alias("dx_n"))

            return let(let(_directions(e), lambda d: div(num(100) * F.abs(d["plus_di"] - d["minus_di"]), F.nullif(d["plus_di"] + d["minus_di"], num(0)))), with_dx)

        return let(first, second)

    return F.aggregate(F.transform(path, move), start, step)


def _directions(e: Column) -> Column:
    enough = (e["n"] >= PERIOD) & (e["range_n"] >= PERIOD)
    return F.struct(*[F.when(enough, num(100) * div(e[k], e["wilder"])).alias(f"{k}_di") for k in ("plus", "minus")])


def _newest(path: Column) -> Column:
    """Every recursive feature of the newest bar of `path` (names as _recursive reads them)."""

    def read(c: Column, m: Column) -> Column:
        ready = lambda n, e: F.when(m[n] >= PERIOD, e)
        gain, loss = (ready("moved_n", m[k] / m["moved_w"]) for k in ("gain", "loss"))
        values = {"macd": c["ema12"] - c["ema26"], "macd_signal": c["signal"], "macd_hist": c["hist"], "macd_hist_prev": c["before"],
                  "rsi": num(100) - div(num(100), num(1) + div(gain, F.nullif(loss, num(0)))), "atr": ready("range_n", m["range"] / m["range_w"]),
                  **{k: c[k] for k in ("ema9", "ema21", "ema20")}, "adx": ready("dx_n", m["dx"]), **{k: _directions(m)[k] for k in ("plus_di", "minus_di")},
                  "wilder": ready("range_n", m["wilder"]), "close": F.element_at(path, -1)["close"], "worst": c["worst"],
                  "trend": folds.supertrend(path), "sar": folds.parabolic_sar(path), "closes": c["n"]}
        return F.struct(*[e.alias(k) for k, e in values.items()])

    return let(_of_closes(path), lambda c: let(_of_moves(path), lambda m: read(c, m)))


def _packed(bars: DataFrame) -> DataFrame:
    """One row a symbol with enough bars: its bars as one array in time order (_path, a symbol's calendar), the recursive
    features (_rec), the CCI, and what the finite windows read: the newest prices (arrays), 20 moves and all log returns."""
    day = F.struct("ts", "high", "low", "close", "volume")
    packed = one_a_day(bars).groupBy("symbol").agg(F.sort_array(F.collect_list(day)).alias("_path"), F.count("close").alias("_some"))
    packed = packed.where((F.size("_path") >= MIN_BASIC) & (F.col("_some") > 0))  # before the folds: a test of what they give would run them twice
    recent = F.slice("_path", F.greatest(F.size("_path") - (TAIL - 1), F.lit(1)), TAIL)
    typical = F.transform(F.reverse(F.slice("_path", F.greatest(F.size("_path") - 38, F.lit(1)), 39)), lambda x: (x["high"] + x["low"] + x["close"]) / num(3))
    closes, pairs = F.col("_path")["close"], F.size("_path") - 1
    returns = F.zip_with(F.slice(closes, 2, pairs), F.slice(closes, 1, pairs), lambda c, pc: F.ln(div(c, F.nullif(pc, num(0)))))

    def move(p: Column, b: Column) -> Column:
        h, l, c, v = (b[x] for x in ("high", "low", "close", "volume"))
        tp, ptp = (h + l + c) / num(3), (p["high"] + p["low"] + p["close"]) / num(3)
        return F.struct((F.coalesce(F.signum(c - p["close"]), num(0)) * v).alias("signed"), (div((c - l) - (h - c), F.nullif(h - l, num(0))) * v).alias("mv"),
                        F.when(tp > ptp, tp * v).otherwise(num(0)).alias("up"), F.when(tp < ptp, tp * v).otherwise(num(0)).alias("dn"))

    moves = F.zip_with(F.slice("_path", -21, 20), F.slice("_path", -20, 20), move)
    return packed.select("symbol", F.element_at("_path", -1)["ts"].alias("ts"), F.size("_path").alias("_n"), _newest(F.col("_path")).alias("_rec"), let(typical, _cci).alias("_cci"),
                         *[recent[x].alias(f"_{x}s") for x in ("close", "high", "low", "volume")], moves.alias("_moves"), F.array_compact(returns).alias("_lrs"))


def _of_arrays() -> dict[str, Column]:
    """What _read reads, from the arrays of _packed. Sums run in time order, as aggregates over sorted bars do."""
    close, high, low, volume = (F.col(f"_{x}s") for x in ("close", "high", "low", "volume"))
    at = lambda x, i: F.get(x, F.size(x) - i)
    total = lambda x: F.aggregate(x, num(0), lambda a, v: a + v)

    def deviation(x: Column) -> Column:
        start = F.struct(num(0).alias("n"), num(0).alias("avg"), num(0).alias("m2"))

        def step(s: Column, v: Column) -> Column:
            n, d = s["n"] + num(1), v - s["avg"]
            return F.struct(n.alias("n"), (s["avg"] + d / n).alias("avg"), (s["m2"] + d * (d - d / n)).alias("m2"))

        return F.when(F.size(x) > 1, F.aggregate(x, start, step, lambda s: F.sqrt(s["m2"] / (s["n"] - num(1)))))

    def full(agg: Callable[[Column], Column], x: Column, first: int, n: int) -> Column:
        """Aggregate over bars first..first+n-1 from the end, NULL unless all n values are present."""
        part = F.slice(x, -(first + n - 1), n)  # empty where the history is shorter
        return F.when((F.size(part) == n) & F.forall(part, lambda v: v.isNotNull()), agg(part))

    year = lambda x: F.when(F.size(x) > YEAR, F.slice(x, -YEAR, YEAR)).otherwise(x)
    mean = lambda x, first, n: full(total, x, first, n) / num(n)
    part_of_moves = lambda k, n: F.slice(F.col("_moves")[k], -n, n)
    newest_returns = lambda n: F.when(F.size("_lrs") > n, F.slice("_lrs", -n, n)).otherwise(F.col("_lrs"))
    # the oldest of equal extremes wins
    age = lambda x, best: full(lambda part: 27 - F.array_position(part, best(part)), x, 1, 26)
    return {
        "_lrn": F.size("_lrs"),
        "price": at(close, 1), "prev_close": at(close, 2), "_h": at(high, 1), "_l": at(low, 1), "vol": at(volume, 1),
        **{f"_c{i}": at(close, i) for i in (2, 3, 6, 11, 21, 61)},
        **{f"sma{n}": mean(close, 1, n) for n in (20, 50, 150, 200)}, "_s150p": mean(close, 22, 150), "_s200p": mean(close, 22, 200),
        "_sd20": full(deviation, close, 1, 20), "vol_avg20": mean(volume, 1, 20),
        "high20": full(F.array_max, close, 2, 20), "low20": full(F.array_min, close, 2, 20),
        "high52": F.array_max(year(close)), "low52": F.array_min(year(close)), "_h52": F.array_max(year(high)), "_l52": F.array_min(year(low)),
        "vol_daily": deviation(newest_returns(60)), "_va": deviation(newest_returns(YEAR)),
        **{f"_hh{i}": full(F.array_max, high, i, 14) for i in (1, 2, 3)}, **{f"_ll{i}": full(F.array_min, low, i, 14) for i in (1, 2, 3)},
        "_obv": F.aggregate(part_of_moves("signed", 20), F.lit(None).cast("double"), lambda a, v: F.coalesce(a + v, a, v)),
        "_pos": total(part_of_moves("up", 14)), "_neg": total(part_of_moves("dn", 14)), "_mv20": total(part_of_moves("mv", 20)), "_v20": full(total, volume, 1, 20),
        "_uph": age(high, F.array_max), "_upl": age(low, F.array_min),
        **{f"_mh{n}": full(F.array_max, high, 1, n) for n in (9, 26, 52)}, **{f"_ml{n}": full(F.array_min, low, 1, n) for n in (9, 26, 52)},
    }


class _Grouped:
    """Aggregates per symbol that several feature families add to before they are computed at once."""

    def __init__(self, bars: DataFrame, aggs: dict[str, Column]):
        self.bars, self.aggs = bars, aggs

    @property
    def agg(self) -> DataFrame:
        return self.bars.groupBy("symbol").agg(*[e.alias(k) for k, e in self.aggs.items()])


def _enough(g: DataFrame) -> DataFrame:
    return g.where((F.col("_n") >= MIN_BASIC) & (F.col("_closes") > 0))


def latest_window_features(bars: DataFrame) -> DataFrame:
    """Finite-window indicators of the newest bar per symbol.

    Every window that ends at the newest bar is one conditional aggregate: a single
    aggregation instead of sliding frames over rows nobody reads.
    """
    g, chosen = _finite(_from_the_end(bars))
    return _enough(g.agg).select("symbol", *chosen)


def _cci(tps: Column) -> Column:
    """CCI from the typical prices of the newest 39 bars, newest first."""
    mean20 = lambda i: F.aggregate(F.slice(tps, i, 20), num(0), lambda a, x: a + x) / num(20)
    mad = F.aggregate(F.sequence(F.lit(1), F.lit(20)), num(0),
                      lambda a, i: a + F.abs(F.get(tps, i - 1) - mean20(i))) / num(20)
    return F.when(F.size(tps) == 39, div(F.get(tps, F.lit(0)) - mean20(F.lit(1)), num(0.015) * mad))


def _finite(b: DataFrame) -> tuple[_Grouped, list[Column]]:
    """Aggregates of numbered bars, and the finite-window features as columns over them."""
    c, h, l, v, rr = (F.col(x) for x in ("close", "high", "low", "volume", "_rr"))
    tp, ptp = (h + l + c) / num(3), (F.col("_ph") + F.col("_pl") + F.col("_pc")) / num(3)
    b = b.withColumns({
        "_tp": tp,
        "_signed": F.coalesce(F.signum(c - F.col("_pc")), num(0)) * v,
        "_mv": div((c - l) - (h - c), F.nullif(h - l, num(0))) * v,
        "_up": F.when(tp > ptp, tp * v).otherwise(num(0)),
        "_dn": F.when(tp < ptp, tp * v).otherwise(num(0)),
    })

    def span(x: str | Column, first: int, last: int) -> Column:
        return F.when(rr.between(first, last), F.col(x) if isinstance(x, str) else x)

    def full(agg, x: str, first: int, n: int) -> Column:
        """Aggregate over rr first..first+n-1, NULL unless all n values are present."""
        part = span(x, first, first + n - 1)
        return F.when(F.count(part) == n, agg(part))

    at = lambda x, i: F.max(F.when(rr == i, F.col(x)))
    # (value, age) extremes: the oldest of equal extremes wins
    oldest_high = F.max(F.when(rr <= 26, F.struct(h.alias("x"), rr.alias("age"))))["age"]
    oldest_low = -F.min(F.when(rr <= 26, F.struct(l.alias("x"), (-rr).alias("age"))))["age"]
    aggs = {
        "_n": F.count("*"), "ts": F.max("ts"), "_closes": F.count(c), "_lrn": F.count("_lr"),
        "price": at("close", 1), "prev_close": at("close", 2), "_h": at("high", 1), "_l": at("low", 1),
        "vol": at("volume", 1),
        "_c6": at("close", 6), "_c11": at("close", 11), "_c21": at("close", 21), "_c61": at("close", 61),
        "sma20": full(F.avg, "close", 1, 20), "sma50": full(F.avg, "close", 1, 50),
        "sma150": full(F.avg, "close", 1, 150), "sma200": full(F.avg, "close", 1, 200),
        "_s150p": full(F.avg, "close", 22, 150), "_s200p": full(F.avg, "close", 22, 200),
        "_sd20": full(F.stddev_samp, "close", 1, 20), "vol_avg20": full(F.avg, "volume", 1, 20),
        "high20": full(F.max, "close", 2, 20), "low20": full(F.min, "close", 2, 20),
        "high52": F.max(span("close", 1, YEAR)), "low52": F.min(span("close", 1, YEAR)),
        "_h52": F.max(span("high", 1, YEAR)), "_l52": F.min(span("low", 1, YEAR)),
        "vol_daily": F.stddev_samp(F.when(F.col("_lk") <= 60, F.col("_lr"))), "_va": F.stddev_samp(F.when(F.col("_lk") <= YEAR, F.col("_lr"))),
        **{f"_hh{i}": full(F.max, "high", i, 14) for i in (1, 2, 3)},
        **{f"_ll{i}": full(F.min, "low", i, 14) for i in (1, 2, 3)},
        "_c2": at("close", 2), "_c3": at("close", 3),
        "_tps": F.sort_array(F.collect_list(span(F.struct("_rr", "_tp"), 1, 39))),
        "_obv": F.sum(span("_signed", 1, 20)),
        "_pos": full(F.sum, "_up", 1, 14), "_neg": full(F.sum, "_dn", 1, 14),
        "_mv20": full(F.sum, "_mv", 1, 20), "_v20": full(F.sum, "volume", 1, 20),
        "_uph": F.when(F.count(span("high", 1, 26)) == 26, oldest_high),
        "_upl": F.when(F.count(span("low", 1, 26)) == 26, oldest_low),
        **{f"_mh{n}": full(F.max, "high", 1, n) for n in (9, 26, 52)},
        **{f"_ml{n}": full(F.min, "low", 1, n) for n in (9, 26, 52)},
    }
    return _Grouped(b, aggs), _read(_cci(F.transform("_tps", lambda x: x["_tp"])))


def _read(cci: Column) -> list[Column]:
    """The finite-window features from the values of _finite or _of_arrays."""
    n, p, c2 = F.col("_n"), F.col("price"), F.col
    width = num(4) * c2("_sd20")
    lower = c2("sma20") - num(2) * c2("_sd20")
    back = lambda x: (div(p, x) - num(1)) * num(100)
    basic = {
        "price": p, "prev_close": c2("prev_close"), "daily_return": div(p, "prev_close") - num(1),
        "sma20": c2("sma20"), "sma50": c2("sma50"), "sma200": c2("sma200"),
        "bb_pctb": div(p - lower, width), "bb_bandwidth": num(100) * div(width, "sma20"),
        "vol": c2("vol"), "vol_avg20": c2("vol_avg20"), "rvol": div("vol", "vol_avg20"),
        "high20": c2("high20"), "low20": c2("low20"), "high52": c2("high52"), "low52": c2("low52"),
        "pct_from_high52": back("high52"),
        "ret_5d": F.when(n > 6, back("_c6")), "ret_20d": F.when(n > 21, back("_c21")),
        "ret_60d": F.when(n > 61, back("_c61")),
        "vol_daily": F.when(c2("_lrn") >= 20, c2("vol_daily")), "sma150": c2("sma150"),
        "sma150_1m_ago": F.when(n >= 172, c2("_s150p")), "sma200_1m_ago": F.when(n >= 222, c2("_s200p")),
        "pct_above_low52": back("low52"),
    }
    k = [num(100) * div(c2(x) - c2(f"_ll{i}"), F.nullif(c2(f"_hh{i}") - c2(f"_ll{i}"), num(0)))
         for i, x in ((1, "price"), (2, "_c2"), (3, "_c3"))]
    mid = {m: (c2(f"_mh{m}") + c2(f"_ml{m}")) / num(2) for m in (9, 26, 52)}
    span_a = (mid[9] + mid[26]) / num(2)
    top, bot = F.greatest(span_a, mid[52]), F.least(span_a, mid[52])
    rng = F.nullif(c2("_h52") - c2("_l52"), num(0))
    levels = F.array(*[
        F.struct(F.abs(level - p).alias("d"), F.lit(i).alias("i"), F.lit(label).alias("label"))
        for i, (label, level) in enumerate(zip(FIB_LABELS, (
            c2("_l52"), c2("_h52") - num(0.236) * rng, c2("_h52") - num(0.382) * rng,
            (c2("_h52") + c2("_l52")) / num(2), c2("_h52") - num(0.618) * rng, c2("_h52"))))])
    pivot = (c2("_h") + c2("_l") + p) / num(3)
    advanced = {
        "stoch_k": k[0], "stoch_d": (k[0] + k[1] + k[2]) / num(3),
        "williams_r": num(-100) * div(c2("_hh1") - p, c2("_hh1") - c2("_ll1")),
        "cci": cci, "roc10": F.when(n > 11, back("_c11")), "obv_rising": F.when(n > 21, c2("_obv") > 0),
        "mfi": num(100) - div(num(100), num(1) + div("_pos", F.nullif(c2("_neg"), num(0)))),
        "cmf": div("_mv20", "_v20"),
        "aroon_up": (c2("_uph") - 1) / num(25) * num(100), "aroon_down": (c2("_upl") - 1) / num(25) * num(100),
        "ichimoku": F.when(span_a.isNotNull() & mid[52].isNotNull(), F.when(p > top, F.lit(ABOVE_CLOUD))
                           .when(p < bot, F.lit(BELOW_CLOUD)).otherwise(F.lit(IN_CLOUD))),
        "tenkan_above_kijun": F.coalesce(mid[9] > mid[26], F.lit(False)),
        "vol_annual_pct": F.when(c2("_lrn") >= 30, c2("_va") * F.sqrt(num(YEAR)) * num(100)),
        "pivot": pivot, "pivot_r1": num(2) * pivot - c2("_l"), "pivot_s1": num(2) * pivot - c2("_h"),
        "range_pos_pct": rnd(div(p - c2("_l52"), rng) * num(100), 1),
        "fib_nearest": F.when(rng.isNotNull(), F.array_min(levels)["label"]),
    }
    return [F.col("ts"), *[e.alias(x) for x, e in basic.items()], *[F.when(n >= MIN_ADVANCED, e).alias(x) for x, e in advanced.items()]]


# Smoothing constants of the recursive indicators.
EMA = {f"ema{n}": 2 / (n + 1) for n in (9, 12, 20, 21, 26)}
SIGNAL, WILDER, PERIOD = 2 / 10, 1 / 14, 14
MOVES = ("gain", "loss", "range", "wilder", "plus", "minus")


def _true_range() -> Column:
    h, l, pc = F.col("high"), F.col("low"), F.col("_pc")
    return F.greatest(h - l, F.abs(h - pc), F.abs(l - pc))


def smoothed_features(bars: DataFrame) -> DataFrame:
    """Numbered bars (_from_the_end) with every recursive indicator at every bar, and the states behind them.

    Two prefix scans: means of prices and moves first, then the MACD signal and the mean of DX, which read the first.
    """
    c, w = F.col("close"), scans.symbol_window()
    up, down, diff = F.col("high") - F.col("_ph"), F.col("_pl") - F.col("low"), c - F.col("_pc")
    b = bars.withColumns({
        "_gain": F.when(diff.isNotNull(), F.greatest(diff, num(0))), "_loss": F.when(diff.isNotNull(), F.greatest(-diff, num(0))), "_tr": _true_range(),
        "_up": F.when((up > down) & (up > 0), up).otherwise(num(0)), "_dn": F.when((down > up) & (down > 0), down).otherwise(num(0)),
        "_peak": F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    b = scans.ewm(b, {**{k: ("close", a, False) for k, a in EMA.items()}, "gain": ("_gain", WILDER, True), "loss": ("_loss", WILDER, True), "range": ("_tr", WILDER, True),
                      "wilder": ("_tr", WILDER, False), "plus": ("_up", WILDER, False), "minus": ("_dn", WILDER, False)})
    ready = lambda k: F.when(F.col(f"{k}_n") >= PERIOD, F.col(k))
    b = b.withColumns({"macd": F.col("ema12") - F.col("ema26"), "plus_di": num(100) * div(ready("plus"), ready("wilder")), "minus_di": num(100) * div(ready("minus"), ready("wilder")),
                       "rsi": num(100) - div(num(100), num(1) + div(ready("gain"), F.nullif(ready("loss"), num(0)))), "atr": ready("range"),
                       "_drawdown": div("close", "_peak") - num(1)})
    b = b.withColumn("_dx", div(num(100) * F.abs(F.col("plus_di") - F.col("minus_di")), F.nullif(F.col("plus_di") + F.col("minus_di"), num(0))))
    b = scans.ewm(b, {"macd_signal": ("macd", SIGNAL, False), "dx": ("_dx", WILDER, False)})
    b = b.withColumns({"macd_hist": F.col("macd") - F.col("macd_signal"), "adx": ready("dx")})
    return b.withColumn("macd_hist_prev", F.lag("macd_hist").over(w)).drop("_gain", "_loss", "_tr", "_up", "_dn", "_dx")


READ = ("macd", "macd_signal", "macd_hist", "macd_hist_prev", "rsi", "atr", "ema9", "ema21", "ema20", "adx", "plus_di", "minus_di")


def _recursive(b: DataFrame) -> tuple[dict[str, Column], list[Column]]:
    """Aggregates of smoothed bars, and the recursive features as columns over them.

    Supertrend and SAR depend on their path, so they alone fold the history, as an array of three prices a day.
    """
    newest = F.col("_rr") == 1
    aggs = {f"_r_{k}": F.max(F.when(newest, F.col(k))) for k in READ}
    aggs |= {"_r_wilder": F.max(F.when(newest & (F.col("wilder_n") >= PERIOD), F.col("wilder"))), "_r_close": F.max(F.when(newest, F.col("close"))),
             "_dd": F.min("_drawdown"), "_path": F.sort_array(F.collect_list(F.struct("ts", "high", "low", "close")))}
    return aggs, _chosen(lambda k: F.col(f"_r_{k}"), F.col("_dd"), folds.supertrend(F.col("_path")), folds.parabolic_sar(F.col("_path")))


def _chosen(at: Callable[[str], Column], worst: Column, trend: Column, sar: Column) -> list[Column]:
    adv = F.col("_n") >= MIN_ADVANCED
    lower, upper = at("ema20") - num(2) * at("wilder"), at("ema20") + num(2) * at("wilder")
    keltner = F.when((lower != 0) & (upper != 0), num(100) * div(at("close") - lower, upper - lower))
    advanced = {"ema9": at("ema9"), "ema21": at("ema21"), "ema9_above_21": at("ema9") > at("ema21"), "adx": at("adx"), "plus_di": at("plus_di"), "minus_di": at("minus_di"),
                "supertrend_up": trend, "psar_bull": sar, "keltner_pos": keltner, "max_drawdown_pct": worst * num(100)}
    basic = ("macd", "macd_signal", "macd_hist", "macd_hist_prev", "rsi", "atr")
    return [*[at(k).alias(k) for k in basic], *[F.when(adv, e).alias(k) for k, e in advanced.items()]]


def folded_features(bars: DataFrame) -> DataFrame:
    """Recursive indicators of the newest bar per symbol."""
    b = smoothed_features(_from_the_end(bars))
    aggs, chosen = _recursive(b)
    return _enough(_Grouped(b, {"_n": F.count("*"), "_closes": F.count("close"), **aggs}).agg).select("symbol", *chosen)


def latest_features(bars: DataFrame) -> DataFrame:
    """One raw (unrounded) feature row per symbol with at least 30 bars.

    A symbol's bars become one array: folds give the recursive features, slices of its end the finite windows. No bar is sorted
    or aggregated again.
    """
    b = _packed(bars).withColumns(_of_arrays())
    rec = F.col("_rec")
    recursive = _chosen(lambda k: rec[k], rec["worst"], rec["trend"], rec["sar"])
    return b.select("symbol", *_read(F.col("_cci")), *recursive).withColumn("atr_pct", num(100) * div("atr", "price"))


def path_flag_series(bars: DataFrame) -> DataFrame:
    """symbol, ts, supertrend_up, psar_bull at every bar.

    Both flags depend on their path, so a symbol's chunks of scans.BLOCK bars follow each other: round k folds chunk k of
    all symbols from the states that round k - 1 stored, and emits the flag at every bar. An array never holds more than a chunk.
    """
    b = scans.in_order(one_a_day(bars.select("symbol", "ts", "high", "low", "close", "volume", "open")))
    chunks = stored(b.groupBy("symbol", "_blk").agg(F.sort_array(F.collect_list(F.struct("ts", "high", "low", "close"))).alias("bars")), "chunks", ["_blk"])
    both = {"supertrend_up": folds.supertrend_fold(), "psar_bull": folds.sar_fold()}
    last = chunks.agg(F.max("_blk")).first()[0]
    rounds, states = [], None
    for k in range((last if last is not None else 0) + 1):
        rows = chunks.where(F.col("_blk") == k)
        carried = F.lit(None) if states is None else F.col("state")
        rows = rows if states is None else rows.join(states, "symbol", "left")
        done = rows.select("symbol", "bars", folds.flags(F.col("bars"), both, carried).alias("f"))
        rounds.append(stored(done.select("symbol", F.transform("bars", lambda x: x["ts"]).alias("ts"), "f.*"), "flags"))
        states = rounds[-1].select("symbol", "state")
    out = functools.reduce(DataFrame.unionAll, [r.select("symbol", "ts", "shown") for r in rounds])
    return out.select("symbol", F.explode(F.arrays_zip("ts", "shown")).alias("x")).select("symbol", "x.ts", "x.shown.*")


MEANS = (*EMA, *MOVES, "macd_signal", "dx")


def summaries(bars: DataFrame) -> DataFrame:
    """symbol, ts and `state`: what the recursive indicators need to go on after the newest bar, a few dozen numbers a symbol."""
    b = smoothed_features(_from_the_end(bars)).where("_rr = 1")
    mean = lambda k: F.struct(F.col(k).alias("avg"), F.col(f"{k}_w").alias("w"), F.col(f"{k}_n").alias("n")).alias(k)
    return b.select("symbol", "ts", F.struct(*[mean(k) for k in MEANS], *[F.col(x).alias(f"last_{x}") for x in ("close", "high", "low")],
                                             (F.col("rn") + 1).alias("bars"), F.col("macd_hist").alias("hist")).alias("state"))


def _step(s: Column, b: Column) -> Column:
    """One bar more: the state after it."""
    diff, up, down = b["close"] - s["last_close"], b["high"] - s["last_high"], s["last_low"] - b["low"]
    tr = F.greatest(b["high"] - b["low"], F.abs(b["high"] - s["last_close"]), F.abs(b["low"] - s["last_close"]))
    x = {**{k: (b["close"], a, False) for k, a in EMA.items()},
         "gain": (F.when(diff.isNotNull(), F.greatest(diff, num(0))), WILDER, True), "loss": (F.when(diff.isNotNull(), F.greatest(-diff, num(0))), WILDER, True),
         "range": (tr, WILDER, True), "wilder": (tr, WILDER, False),
         "plus": (F.when((up > down) & (up > 0), up).otherwise(num(0)), WILDER, False), "minus": (F.when((down > up) & (down > 0), down).otherwise(num(0)), WILDER, False)}
    first = F.struct(*[folds.ewm_step(s[k], v, a, adjust).alias(k) for k, (v, a, adjust) in x.items()])

    def second(e: Column) -> Column:
        di = lambda k: num(100) * div(folds.ready(e[k], PERIOD), folds.ready(e["wilder"], PERIOD))
        dx = div(num(100) * F.abs(di("plus") - di("minus")), F.nullif(di("plus") + di("minus"), num(0)))
        line = e["ema12"]["avg"] - e["ema26"]["avg"]
        signal = folds.ewm_step(s["macd_signal"], line, SIGNAL, False)
        return F.struct(*[e[k].alias(k) for k in (*EMA, *MOVES)], signal.alias("macd_signal"), folds.ewm_step(s["dx"], dx, WILDER, False).alias("dx"),
                        *[b[c].alias(f"last_{c}") for c in ("close", "high", "low")], (s["bars"] + 1).alias("bars"), (line - signal["avg"]).alias("hist"))

    return let(first, second)


def advanced(kept: DataFrame, newer: DataFrame) -> DataFrame:
    """summaries() as they are after newer bars: of symbols in `kept` only bars after their ts are read; new symbols start there.

    The array holds a symbol's new bars only (one a day that was missed).
    """
    known = kept.select(F.col("symbol").alias("_s"), F.col("ts").alias("_since"))
    fresh = one_a_day(newer).join(known, F.col("symbol") == F.col("_s"), "left").where("_since is null or ts > _since")
    new = fresh.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("ts", "high", "low", "close"))).alias("_new"))
    empty = F.struct(*[folds.ewm_start().alias(k) for k in MEANS], *[F.lit(None).cast("double").alias(f"last_{x}") for x in ("close", "high", "low")],
                     F.lit(0).alias("bars"), F.lit(None).cast("double").alias("hist"))
    both = kept.join(new, "symbol", "full_outer")
    state = F.aggregate(F.coalesce("_new", F.array().cast(new.schema["_new"].dataType)), F.coalesce(F.col("state"), empty), _step)
    return both.select("symbol", F.coalesce(F.element_at("_new", -1)["ts"], "ts").alias("ts"), state.alias("state"))


def from_summaries(kept: DataFrame) -> DataFrame:
    """MACD, RSI, ATR, EMA and ADX of the newest bar, from summaries."""
    s = F.col("state")
    di = lambda k: num(100) * div(folds.ready(s[k], PERIOD), folds.ready(s["wilder"], PERIOD))
    adv = s["bars"] >= MIN_ADVANCED
    return kept.where(s["bars"] >= MIN_BASIC).select(
        "symbol", "ts", (s["ema12"]["avg"] - s["ema26"]["avg"]).alias("macd"), s["macd_signal"]["avg"].alias("macd_signal"), s["hist"].alias("macd_hist"),
        (num(100) - div(num(100), num(1) + div(folds.ready(s["gain"], PERIOD), F.nullif(folds.ready(s["loss"], PERIOD), num(0))))).alias("rsi"),
        folds.ready(s["range"], PERIOD).alias("atr"),
        *[F.when(adv, e).alias(k) for k, e in {"ema9": s["ema9"]["avg"], "ema21": s["ema21"]["avg"], "adx": folds.ready(s["dx"], PERIOD), "plus_di": di("plus"), "minus_di": di("minus")}.items()])


def rounded(features: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """4-dp rounding of every DOUBLE column; later stages see only rounded values."""
    return features.select(*[
        rnd(finite(c), 4).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in features.dtypes])
