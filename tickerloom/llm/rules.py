"""Quality rules with thresholds from mergeable quantile sketches per language and source.

All DataFrame functions. Each document gets integer measures; a fixed base rule rejects texts that are
too short or mostly repeat themselves. Every other measure is compared with a threshold that
adapts to the documents around it: its values go into a histogram sketch on a fixed grid (counts
per cell, so sketches of tasks, days and sources merge by addition, and the grid bounds their size).
Sketches merge from (lang, source) to lang to all. A group takes its own quantiles when it has
at least `least` documents, else those of its language, else those of all. The threshold is
the median plus `spread` times the distance from the median to the upper quantile, so it tightens where documents are
alike and loosens where a group's prose is that way by nature. It stays above a floor (what single clean
documents reach) and below `slack` times the threshold of the next wider group (for all documents below a fixed top), so a
source full of junk does not pardon itself.

Defined results: null or empty text has no words and fails the base rule; null lang or source
is a group of its own; documents that fail the base rule don't enter the sketches.
Repeated rows are judged alike. An empty table gives an empty table. Extra columns of any name pass through inside _row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.tables import written

SPACE = r"[\x20\x09-\x0D]+"
#: measure: (numerator, denominator, floor, top); all in thousandths, grid cell 10, the last cell holds all from 5000 up
MEASURES = {"symbols": ("n_symbols", "n_words", 100, 300), "dup_lines": ("n_dup_lines", "n_lines", 250, 600), "repeats": ("n_repeat_words", "n_words", 100, 200),
            "shouting": ("n_capitals", "n_words", 200, 900)}
CELL, CELLS = 10, 500


def _covered(starts: Column, width: int) -> Column:
    """Number of positions covered by windows of the given width that begin at the sorted starts."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("at"))
    return F.aggregate(starts, zero, lambda a, x: F.struct((a["n"] + F.least(F.lit(width), x - a["at"])).alias("n"), x.alias("at")))["n"]


def _repeated_starts(hashes: Column) -> Column:
    """Sorted positions whose value occurs twice or more. The sorted array is bound once, as the item of a one-item array."""
    pairs = F.array(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("i")))))
    same = F.transform(pairs, lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])))
    return F.sort_array(F.transform(same[0], lambda x: x["i"]))


def measured(docs: DataFrame, window: int = 5) -> DataFrame:
    """docs with the integer measures of each whole text, in a struct `m`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.withColumn("_words", F.filter(F.split(text, SPACE), lambda w: w != ""))
    step = step.withColumn("_n", F.size("_words"))
    grams = F.transform("_words", lambda w, i: F.xxhash64(w, *[F.get(F.col("_words"), i + j) for j in range(1, window)]))
    step = step.withColumn("_h", F.when(F.col("_n") >= window, F.slice(grams, 1, F.col("_n") - (window - 1))).otherwise(F.array().cast("array<long>")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = step.withColumn("_lines", lines)
    covered = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), _covered(_repeated_starts(F.col("_h")), window)).otherwise(0)
    m = F.struct(F.col("_n").cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
                 (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
                 (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"),
                 F.size("_lines").cast("long").alias("n_lines"),
                 (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long").alias("n_capitals"))
    return step.withColumn("m", m).drop("_words", "_n", "_h", "_lines")


def _cell(name: str) -> Column:
    top, bottom, *_ = MEASURES[name]
    return F.least(F.lit(CELLS), F.floor(F.col(f"m.{top}") * 1000 / F.greatest(F.lit(1), F.col(f"m.{bottom}")) / CELL)).cast("int")


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, measure, cell, n: one mergeable histogram sketch for each group and measure."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), _cell(k).alias("cell")) for k in MEASURES])).alias("c")
    return rows.select("lang", "source", cells).groupBy("lang", "source", "c.measure", "c.cell").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], upper: float) -> DataFrame:
    """keys, measure, n, mid, high: sketches merged over all other columns, and their cells at the median and the upper quantile."""
    merged = sketch.groupBy(*keys, "measure", "cell").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    ranked = merged.withColumn("up_to", F.sum("n").over(group.orderBy("cell"))).withColumn("all", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("up_to") * 1000 >= F.col("all") * round(q * 1000), F.col("cell")))
    return ranked.groupBy(*keys, "measure").agg(F.max("all").alias("n"), at(0.5).alias("mid"), at(upper).alias("high"))


def thresholds(sketch: DataFrame, upper: float = 0.9, spread: int = 8, slack: int = 2, least: int = 200) -> DataFrame:
    """lang, source and for each measure the threshold in cells: one row for each group of the sketches."""
    wide = {}
    for name, keys in (("own", ["lang", "source"]), ("tongue", ["lang"]), ("all", [])):
        q = quantiles(sketch, keys, upper)
        limit = F.col("mid") + spread * (F.col("high") - F.col("mid"))
        per = [F.max(F.when(F.col("measure") == k, limit)).alias(k) for k in MEASURES]
        wide[name] = q.groupBy(*keys).agg(F.max("n").alias("n"), *per).select(*keys, F.struct("n", *MEASURES).alias(f"t_{name}"))
    groups = sketch.select("lang", "source").distinct()
    found = (groups.join(wide["own"], (groups.lang.eqNullSafe(wide["own"].lang)) & (groups.source.eqNullSafe(wide["own"].source)), "left").select(groups["*"], "t_own"))
    found = found.join(wide["tongue"].withColumnRenamed("lang", "_l"), F.col("lang").eqNullSafe(F.col("_l")), "left").crossJoin(wide["all"])  # one row

    def bounded(k: str) -> Column:
        floor, top = (x // CELL for x in MEASURES[k][2:])
        at = F.least(F.greatest(F.col(f"t_all.{k}"), F.lit(floor)), F.lit(top))
        for group in ("tongue", "own"):
            at = F.when(F.col(f"t_{group}.n") >= least, F.least(F.greatest(F.col(f"t_{group}.{k}"), F.lit(floor)), slack * at)).otherwise(at)
        return at.alias(k)

    return found.select("lang", "source", *[bounded(k) for k in MEASURES])


def judged(docs: DataFrame, carry: list[str] | None = None, upper: float = 0.9, spread: int = 8, slack: int = 2, least: int = 200, min_words: int = 10,
           max_repeat: int = 20) -> DataFrame:
    """_row (struct of the columns in carry; all by default), m (measures), base_failed, kept, and `failed` (the adaptive rules that a text breaks).

    The measures are written once; sketches and verdicts read the written table.
    """
    carried = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("_row")
    source = docs.select(carried, F.col("text").cast("string").alias("text"), F.col("lang").alias("lang"), F.col("source").alias("source"))
    rows, _ = written(measured(source).select("_row", "lang", "source", "m"), "measures")
    base_failed = (F.col("m.n_words") < min_words) | (100 * F.col("m.n_repeat_words") > max_repeat * F.col("m.n_words"))
    rows = rows.withColumn("base_failed", base_failed)
    limits = thresholds(sketches(rows.where("not base_failed")), upper, spread, slack, least)
    limits = limits.select(F.col("lang").alias("_gl"), F.col("source").alias("_gs"), *[F.col(k).alias(f"_t_{k}") for k in MEASURES])
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("_gl")) & F.col("source").eqNullSafe(F.col("_gs")), "left")
    broken = F.array_compact(F.array(*[F.when(_cell(k) > F.col(f"_t_{k}"), F.lit(k)) for k in MEASURES]))
    return joined.select("_row", "m", "base_failed", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(broken).alias("failed")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed") == 0))
