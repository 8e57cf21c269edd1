"""Readers for the landed files. All of them take explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerloom.functions.core import finite

C = F.col
BAR_COLUMNS = ("open", "high", "low", "close", "volume")


def clean_universe(raw: DataFrame) -> DataFrame:
    """Trim, upper-case, drop blank and '#' symbols; the first row of a symbol (by `ord`) wins.

    min_by is a partial aggregate, so a symbol repeated in a large share of the rows
    is reduced before the shuffle.
    """
    strip = lambda c: F.trim(F.coalesce(C(c), F.lit("")))
    sym = F.replace(F.upper(strip("symbol")), F.lit("﻿"), F.lit(""))
    rows = raw.select(sym.alias("symbol"), strip("name").alias("name"), strip("exchange").alias("exchange"), "ord")
    rows = rows.where((C("symbol") != "") & ~C("symbol").startswith("#"))
    return rows.groupBy("symbol").agg(F.min_by(F.struct("name", "exchange", "ord"), "ord").alias("r")).select(
        "symbol", "r.*")


def universe(spark: SparkSession, path: str) -> DataFrame:
    """CSV symbol,name,exchange with header and optional BOM; `ord` is the number of its line."""
    raw = (spark.read.schema("symbol string, name string, exchange string").option("header", "true")
           .option("enforceSchema", "true").csv(path))
    return clean_universe(in_input_order(raw))


def in_input_order(rows: DataFrame) -> DataFrame:
    """Adds `ord`, the place of a row in the files it was read from (by path, then offset), however Spark splits them.

    A split's rows come in file order, so a row's place is its place in the split and what the splits before it hold:
    a prefix sum over one row a split.
    """
    split = ["_file", "_offset"]
    placed = rows.select("*", C("_metadata.file_path").alias("_file"), C("_metadata.file_block_start").alias("_offset"), F.monotonically_increasing_id().alias("_id"))
    before = F.sum("_n").over(Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1))
    splits = placed.groupBy(*split).agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0)))
    return placed.join(splits.drop("_n"), split).withColumn("ord", C("_before") + C("_id") - C("_first")).drop(*split, "_id", "_first", "_before")


def bars(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Daily bars; partitioned by year on disk, so `since` (ISO date) prunes partitions and rows."""
    b = spark.read.parquet(path)
    if since:
        b = b.where(C("ts") >= F.lit(since).cast("date"))
        if "year" in b.columns:
            b = b.where(C("year") >= int(since[:4]))
    b = b.select("symbol", "ts", *[finite(C(c).cast("double")).alias(c) for c in BAR_COLUMNS])
    return b.na.drop(how="all", subset=list(BAR_COLUMNS))


def bars_intraday(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("symbol string, ts timestamp, open double, high double, low double, close double, "
                             "volume double").parquet(path)


def tag_map(spark: SparkSession, path: str) -> DataFrame:
    """JSON object {symbol: [tags]} -> symbol, tags; an unreadable file gives no rows."""
    doc = spark.read.text(path, wholetext=True)
    m = F.from_json("value", "map<string,array<string>>")
    return doc.select(F.explode(m).alias("symbol", "tags"))


def holdings(spark: SparkSession, path: str) -> DataFrame:
    """Curated holdings JSON {..., holdings: {symbol: {name, stance, weight_pct, is_etf}}}."""
    doc = spark.read.text(path, wholetext=True)
    schema = ("struct<report_quarter:string,filed:string,holdings:map<string,"
              "struct<name:string,stance:string,weight_pct:double,is_etf:boolean>>>")
    h = doc.select(F.from_json("value", schema).alias("d")).select(
        C("d.report_quarter").alias("report_quarter"), F.explode("d.holdings").alias("symbol", "h"))
    return h.select("symbol", "h.name", "h.stance", "h.weight_pct",
                    F.coalesce("h.is_etf", F.lit(False)).alias("is_etf"), "report_quarter")


INFO_TABLE = ("`ns1:nameOfIssuer` string, `ns1:titleOfClass` string, `ns1:cusip` string, `ns1:value` bigint, "
              "`ns1:shrsOrPrnAmt` struct<`ns1:sshPrnamt`: bigint, `ns1:sshPrnamtType`: string>, `ns1:putCall` string")


def holdings_report(spark: SparkSession, path: str) -> DataFrame:
    """Raw report XML (one infoTable element per line): issuer, class, cusip, value, shares, put_call.

    File names must not start with '_' or '.', which Spark skips.
    """
    x = spark.read.format("xml").option("rowTag", "ns1:infoTable").schema(INFO_TABLE).load(path)
    return x.select(
        F.trim("`ns1:nameOfIssuer`").alias("issuer"), F.trim("`ns1:titleOfClass`").alias("class"),
        C("`ns1:cusip`").alias("cusip"), C("`ns1:value`").alias("value"),
        C("`ns1:shrsOrPrnAmt`")["ns1:sshPrnamt"].alias("shares"), C("`ns1:putCall`").alias("put_call"))


def fx_table(spark: SparkSession, path: str) -> DataFrame:
    """JSON object {currency: usd_rate, _fetched_at: text} -> currency, usd_rate, fetched_at."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return (doc.select(F.try_to_timestamp(F.try_element_at("m", F.lit("_fetched_at"))).alias("fetched_at"),
                       F.explode("m").alias("currency", "v"))
            .where(~C("currency").startswith("_"))
            .select("currency", C("v").try_cast("double").alias("usd_rate"), "fetched_at"))


def headlines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines: symbol, pos, title, link, published."""
    return spark.read.schema("symbol string, pos long, title string, link string, published string").json(path)


def social_pages(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, one board page each: page, results[]."""
    schema = ("page int, results array<struct<ticker:string,rank:int,mentions:int,upvotes:int,"
              "mentions_24h_ago:int,rank_24h_ago:int>>")
    return spark.read.schema(schema).json(path).select("page", F.inline("results"))
