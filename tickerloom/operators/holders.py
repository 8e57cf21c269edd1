"""Institutional holdings: exposure from raw report lines and the stance per symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.core import div, lookup, num, rnd

C = F.col
# Fixed output texts per stance.
STANCE_LABELS = {"LONG": "🟣 Aschenbrenner: LONG", "SHORT_BET": "🟣 Aschenbrenner: wettet DAGEGEN (Put)",
                 "MIXED": "🟣 Aschenbrenner: gemischt (Put+Call)"}
DEFAULT_LABEL = "🟣 Aschenbrenner"


def exposure(lines: DataFrame) -> DataFrame:
    """issuer, shares/call/put value, weight_pct of the report total and the stance.

    Put and call together are MIXED; otherwise more puts than shares is SHORT_BET, else LONG.
    """
    kind = F.coalesce("put_call", F.lit("Shares"))
    total = lambda k: F.coalesce(F.sum(F.when(kind == k, C("value"))), F.lit(0)).cast("long")
    g = lines.groupBy("issuer").agg(total("Shares").alias("shares_value"), total("Call").alias("call_value"),
                                    total("Put").alias("put_value"))
    g = g.withColumn("gross_value", C("shares_value") + C("call_value") + C("put_value"))
    whole = g.agg(F.sum("gross_value").alias("_total"))  # one row
    stance = (F.when((C("put_value") > 0) & (C("call_value") > 0), F.lit("MIXED"))
              .when(C("put_value") > C("shares_value"), F.lit("SHORT_BET")).otherwise(F.lit("LONG")))
    return g.crossJoin(whole).select(
        "issuer", "shares_value", "call_value", "put_value", "gross_value",
        rnd(num(100) * div("gross_value", "_total"), 2).alias("weight_pct"), stance.alias("stance"))


def stance(rows: DataFrame, holdings: DataFrame) -> DataFrame:
    """Left join of the holdings by symbol: holder_stance, holder_weight_pct, holder_label."""
    h = holdings.select(
        "symbol", C("stance").alias("holder_stance"), C("weight_pct").alias("holder_weight_pct"),
        F.coalesce(lookup(STANCE_LABELS, C("stance")), F.lit(DEFAULT_LABEL)).alias("holder_label"))
    return rows.join(h, "symbol", "left")


def explode_tags(tags: DataFrame) -> DataFrame:
    """symbol, tags[] -> symbol, pos, tag."""
    return tags.select("symbol", F.posexplode("tags").alias("pos", "tag"))
