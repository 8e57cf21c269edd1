"""Run inputs built from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.operators import fundamentals, holders
from tickerloom.plans.snapshot import Inputs
from tickerloom.sources import fixtures as fx


def curated_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holders.exposure(fx.holdings_raw(spark, sf_dir)).select(
        F.col("issuer").alias("symbol"), "stance", "weight_pct")


def inputs(spark: SparkSession, sf_dir: str, bars: DataFrame | None = None,
           funds: DataFrame | None = None) -> Inputs:
    """Run inputs; `bars` and `funds` may be tables written by an earlier stage."""
    bars = bars if bars is not None else fx.bars(spark, sf_dir)
    return Inputs(
        universe=fx.universe(spark, sf_dir), bars=bars,
        fundamentals=funds if funds is not None
        else fundamentals.project_fields(fx.raw_fundamentals(spark, sf_dir, bars)),
        statements=fx.statements(spark, sf_dir), fx_quotes=fx.fx_quotes(spark, sf_dir),
        headlines=fx.headlines(spark, sf_dir), earnings=fx.earnings_dates(spark, sf_dir),
        social=fx.social(spark, sf_dir), holdings=curated_holdings(spark, sf_dir),
        themes=fx.themes(spark, sf_dir), experts=fx.expert_sources(spark, sf_dir),
        macro_quotes=fx.macro_quotes(spark, sf_dir), bars30=fx.bars30(spark, sf_dir), as_of=fx.AS_OF,
        positive_words=fx.POS_WORDS, negative_words=fx.NEG_WORDS)
