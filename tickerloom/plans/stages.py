"""Stage tables: each pipeline stage is written once and read by the next.

Writing a stage cuts lineage at the natural table boundaries of the screen (bars,
features, joined rows, snapshot), keeps every plan short, and survives the loss of
executors. Tables live in the shared folder of the session, one set per application.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickerloom.operators import fundamentals
from tickerloom.plans import fixture_inputs
from tickerloom.plans.snapshot import Inputs, technical, with_fundamentals, with_rating, with_side_tables
from tickerloom.operators import macro
from tickerloom.session import dealt, work_dir
from tickerloom.sources import fixtures as fx


class Stages:
    """Stage tables of one input folder within one Spark application."""

    _written: dict[tuple[str, str, str], str] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        app = self.spark.sparkContext.applicationId
        key = (app, self.sf_dir, name)
        if key not in self._written:
            scale = hashlib.md5(self.sf_dir.rstrip("/").encode()).hexdigest()  # two inputs may end in the same folder name
            path = f"{work_dir(self.spark).rstrip('/')}/tickerloom/{app}/{scale}/{name}"
            build().write.mode("overwrite").parquet(path)
            self._written[key] = path
        return self.spark.read.parquet(self._written[key])

    def bars(self) -> DataFrame:
        return self.table("bars", lambda: fx.bars(self.spark, self.sf_dir))

    def bars_by_symbol(self) -> DataFrame:
        """The bars for steps that sort a symbol's history; they are counted from the table's footers."""
        b = self.bars()
        return dealt(b, b.count(), "symbol")

    def fundamentals(self) -> DataFrame:
        return self.table("fundamentals", lambda: fundamentals.project_fields(
            fx.raw_fundamentals(self.spark, self.sf_dir, self.bars())))

    def inputs(self) -> Inputs:
        return fixture_inputs.inputs(self.spark, self.sf_dir, self.bars(), self.fundamentals())

    def features(self) -> DataFrame:
        return self.table("features", lambda: technical(dataclasses.replace(self.inputs(), bars=self.bars_by_symbol())))

    def scored(self) -> DataFrame:
        """Features plus fundamentals, in USD."""
        return self.table("scored", lambda: with_fundamentals(self.features(), self.inputs()))

    def rows(self) -> DataFrame:
        """Everything the rating layer reads."""
        return self.table("rows", lambda: with_side_tables(self.scored(), self.inputs()))

    def macro(self) -> DataFrame:
        return self.table("macro", lambda: macro.context(
            fx.macro_quotes(self.spark, self.sf_dir), fx.AS_OF, fx.EVENTS))

    def snapshot(self) -> DataFrame:
        return self.table("snapshot", lambda: with_rating(self.rows(), self.macro()))
