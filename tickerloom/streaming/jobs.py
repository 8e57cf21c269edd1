"""Replays of finite inputs through the streaming operators, until all data is processed."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions.core import num
from tickerloom.session import work_dir
from tickerloom.streaming import bars as sb
from tickerloom.streaming.buckets import Buckets
from tickerloom.streaming.indicators import five_day_returns, running_indicators

C = F.col
ROWS_A_FILE = 1_000_000


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return e.withColumn("ts", C("ts").cast("timestamp"))


def run_to_table(stream: DataFrame, name: str, seen: dict[str, str] | None = None) -> DataFrame:
    """Appends the stream to a parquet table in the shared folder and returns it as a batch table.

    `seen`, if given, gets the event-time watermark that the query ended with.
    """
    spark = stream.sparkSession
    root = f"{work_dir(spark).rstrip('/')}/tickerloom/streams/{name}-{uuid.uuid4().hex[:8]}"
    q = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/checkpoint")
         .trigger(availableNow=True).start(f"{root}/table"))
    q.awaitTermination()
    marks = [p["eventTime"]["watermark"] for p in q.recentProgress if "watermark" in p["eventTime"]]
    if seen is not None and marks:
        seen["watermark"] = max(marks)  # ISO text in UTC
    return spark.read.schema(stream.schema).parquet(f"{root}/table")


def ticks(events: DataFrame) -> DataFrame:
    return events.select("event_id", "ts", C("event_type").alias("symbol"),
                         (num(100) + C("value") / num(10)).alias("price"), num(1).alias("volume"))


def mentions(events: DataFrame) -> DataFrame:
    return events.select("ts", F.concat(F.lit("S"), C("user_id").cast("string")).alias("symbol"))


def replay_bars30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_to_table(sb.ohlcv(ticks(events_stream(spark, sf_dir))), "bars30")


def replay_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is delivered twice; one copy survives."""
    e = events_stream(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", "value")
    again = events_stream(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", "value")
    out = run_to_table(sb.drop_duplicate_ticks(e.unionByName(again)), "dedup")
    return out.select("event_id", "user_id", "event_type", "value")


def replay_mention_surge(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen: dict[str, str] = {}
    hourly = run_to_table(sb.mention_counts(mentions(events_stream(spark, sf_dir))), "mentions", seen)
    until = F.lit(seen.get("watermark")).cast("timestamp")  # hours up to here are complete
    return sb.mention_surges(sb.rolling_mentions(sb.near_surges(hourly), spark.range(1).select(until.alias("until"))))


def replay_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_to_table(sb.attention_sessions(mentions(events_stream(spark, sf_dir))), "sessions")


def bar_stream(spark: SparkSession, bars: DataFrame) -> DataFrame:
    """Streams a bars table from a copy in the shared folder, whatever its own layout (folders by year, several roots)."""
    root = f"{work_dir(spark).rstrip('/')}/tickerloom/streams/bars-{uuid.uuid4().hex[:8]}"
    bars.write.parquet(root)
    return spark.readStream.schema(bars.schema).parquet(root)


def replay_indicators(spark: SparkSession, bars: DataFrame) -> DataFrame:
    return run_to_table(running_indicators(bar_stream(spark, bars)), "indicators")


def replay_alerts(spark: SparkSession, bars: DataFrame, profile: DataFrame) -> DataFrame:
    return run_to_table(sb.alerts(five_day_returns(bar_stream(spark, bars)), profile), "alerts")


def upsert_latest(stream: DataFrame, table: Buckets) -> None:
    """Keeps the newest bar per symbol in a bucketed table; see Buckets.merge."""
    q = (stream.writeStream.foreachBatch(table.merge).option("checkpointLocation", f"{table.root}-checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()


def replay_snapshot(spark: SparkSession, bars: DataFrame, side: DataFrame, parts: int = 4) -> DataFrame:
    """Upserts the bar stream in `parts` batches and joins the static side table.

    The stream's files hold ROWS_A_FILE bars each, in order of time, and a batch takes its share of them: what a task reads
    stays the same while the input grows.
    """
    root = f"{work_dir(spark).rstrip('/')}/tickerloom/streams/latest-{uuid.uuid4().hex[:8]}"
    share = max(1, math.ceil(bars.count() / (parts * ROWS_A_FILE)))
    bars.repartitionByRange(parts * share, "ts", "symbol").write.parquet(f"{root}-in")
    stream = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", share).parquet(f"{root}-in")
    table = Buckets(root)
    upsert_latest(stream, table)
    return table.read(spark, bars.schema).join(side, "symbol", "left")
