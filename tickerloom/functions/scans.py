"""Recursions over (symbol, ts) as prefix scans of affine maps, in windows.

A bar turns the state y of a smoothing into a*y + b. Such maps compose associatively, so a stretch of bars is one map
(A, B), and a history is as many maps as it has stretches: here blocks of BLOCK bars, whose maps travel along the symbol
(one pair of doubles for each full block) and are folded into the state that a later block starts from. Within a block y
is a running sum. No bar ever sits in an array, and every block before counts, whatever the decay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.core import num

BLOCK = 256
LEAST = 1e-30  # smallest decay of one bar; what was before such a bar no longer shows in a double


def in_order(df: DataFrame) -> DataFrame:
    """Adds `rn`, the 0-based place of a bar in its symbol's history, and `_blk`, the block it lies in."""
    by_time = Window.partitionBy("symbol").orderBy("ts")
    return df.withColumn("rn", F.row_number().over(by_time) - 1).withColumn("_blk", F.floor(F.col("rn") / BLOCK))


def symbol_window():
    """Window over a symbol's bars in time order whose sort the block windows share."""
    return Window.partitionBy("symbol").orderBy("_blk", "ts")


def affine_scan(df: DataFrame, maps: dict[str, tuple[Column, float | Column]]) -> DataFrame:
    """Adds y_t = a_t * y_(t-1) + b_t per symbol for each name -> (b, a), starting from y = 0. NULL in b counts as 0.

    `df` comes from in_order(). A constant a must keep a**-BLOCK within doubles; a varying one counts as at least LEAST.
    """
    for name, (_, a) in maps.items():
        if not isinstance(a, Column) and not (0 < a <= 1 and -BLOCK * math.log(a) < 600):
            raise ValueError(f"{name}: decay {a} is outside what blocks of {BLOCK} bars can carry")
    run = Window.partitionBy("symbol", "_blk").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    pos = (F.col("rn") % BLOCK).cast("double")
    varying = {k: a for k, (_, a) in maps.items() if isinstance(a, Column)}
    df = df.withColumns({f"_b_{k}": F.coalesce(b, num(0)) for k, (b, _) in maps.items()})
    df = df.withColumns({f"_s_{k}": F.sum(F.ln(F.greatest(a, num(LEAST)))).over(run) for k, a in varying.items()})
    log = {k: F.col(f"_s_{k}") if k in varying else (pos + 1) * num(math.log(a)) for k, (_, a) in maps.items()}
    df = df.withColumns({f"_y_{k}": F.exp(log[k]) * F.sum(F.col(f"_b_{k}") * F.exp(-log[k])).over(run) for k in maps})
    whole = F.struct(*[F.struct(F.exp(log[k]).alias("A"), F.col(f"_y_{k}").alias("B")).alias(k) for k in maps])
    before = symbol_window().rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_maps", F.collect_list(F.when(F.col("rn") % BLOCK == BLOCK - 1, whole)).over(before))
    start = lambda k: F.aggregate("_maps", num(0), lambda y, m: m[k]["A"] * y + m[k]["B"])
    df = df.withColumns({k: F.col(f"_y_{k}") + F.exp(log[k]) * start(k) for k in maps})
    return df.drop("_maps", *[f"_{p}_{k}" for k in maps for p in "bsy"])


def ewm(df: DataFrame, means: dict[str, tuple[str, float, bool]]) -> DataFrame:
    """Adds exponentially weighted means: name -> (column, alpha, adjust), with <name>_w, the weight that the mean carries
    into the next bar before decay, and <name>_n, the values seen.

    Missing values leave the mean as it is and let the weights decay, also where a value comes after a gap.
    """
    w = symbol_window()
    up_to, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    sources = dict.fromkeys(x for x, _, _ in means.values())
    df = df.withColumns({**{f"_n_{x}": F.count(x).over(up_to) for x in sources},
                         **{f"_at_{x}": F.last(F.when(F.col(x).isNotNull(), F.col("rn")), ignorenulls=True).over(up_to) for x in sources},
                         **{f"_gap_{x}": F.col("rn") - F.last(F.when(F.col(x).isNotNull(), F.col("rn")), ignorenulls=True).over(before) for x in sources}})
    maps: dict[str, tuple[Column, float | Column]] = {}
    for name, (x, alpha, adjust) in means.items():
        q, seen = 1 - alpha, F.col(x).isNotNull()
        if adjust:
            maps[f"_sum_{name}"] = F.col(x), q
            maps[f"_wgt_{name}"] = seen.cast("double"), q
        else:
            old = F.pow(num(q), F.col(f"_gap_{x}"))
            keep = F.when(seen & F.col(f"_gap_{x}").isNotNull(), F.when(F.col(f"_gap_{x}") == 1, num(q)).otherwise(old / (old + num(alpha))))
            df = df.withColumn(f"_keep_{name}", keep)
            kept = F.col(f"_keep_{name}")
            maps[f"_avg_{name}"] = F.when(seen, F.when(kept.isNull(), F.col(x)).otherwise((num(1) - kept) * F.col(x))), F.coalesce(kept, num(1))
    df = affine_scan(df, maps)
    out = {}
    for name, (x, alpha, adjust) in means.items():
        any_ = F.col(f"_n_{x}") > 0
        out[name] = F.when(any_, F.col(f"_sum_{name}") / F.col(f"_wgt_{name}") if adjust else F.col(f"_avg_{name}"))
        out[f"{name}_w"] = F.when(any_, F.col(f"_wgt_{name}") if adjust else F.pow(num(1 - alpha), F.col("rn") - F.col(f"_at_{x}"))).otherwise(num(1))
        out[f"{name}_n"] = F.col(f"_n_{x}").cast("int")
    df = df.withColumns(out)
    return df.drop(*maps, *[f"_{p}_{x}" for x in sources for p in ("n", "at", "gap")], *[f"_keep_{k}" for k in means])
