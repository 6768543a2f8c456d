"""Structured Streaming forms of the incremental jobs.

Each transformation is a plain DataFrame function, so the batch and the streaming
run share it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators.upsert import KEYS, clean_prices, write_upsert
from tickloom.session import path_exists


def event_bars(
    events: DataFrame, *, width: str = "1 hour", delay: str = "1 hour", key: str = "event_type"
) -> DataFrame:
    """Tumbling open/high/low/close/volume bars from trade-like events.

    First and last value are chosen by event id, not by arrival.
    """
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("_w"), F.col(key))
        .agg(
            F.min_by("value", "event_id").alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", "event_id").alias("close"),
            F.count("*").alias("volume"),
        )
        .select(key, F.col("_w.start").alias("bar_start"), "open", "high", "low", "close", "volume")
    )


def rolling_totals(
    events: DataFrame, *, width: str = "6 hours", slide: str = "3 hours", delay: str = "1 hour",
    key: str = "event_type",
) -> DataFrame:
    """Sliding totals, the streaming monitor of recent flow."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", width, slide).alias("_w"), F.col(key))
        .agg(F.sum("value").alias("total"), F.count("*").alias("n"))
        .select(key, F.col("_w.start").alias("window_start"), "total", "n")
    )


def unique_events(events: DataFrame, keys: Sequence[str], delay: str = "1 day") -> DataFrame:
    """One row per key although files or messages repeat; state ends with the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def run_available(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
    mode: str = "append",
) -> None:
    """Process what is there, batch by batch, and stop."""
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def write_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Idempotent sink: a repeated batch overwrites its own folder."""

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return handle


def latest_batches(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Update-mode output: the newest batch's row per key."""
    w = Window.partitionBy(*keys).orderBy(F.col("batch").desc())
    df = spark.read.parquet(path).withColumn("_pos", F.row_number().over(w))
    return df.where("_pos = 1").drop("_pos", "batch")


def run_deliveries(
    make: Callable[[], DataFrame], handle: Callable[[DataFrame, int], None], checkpoint: str,
    deliveries: Sequence[Callable[[], None]], mode: str = "append",
) -> None:
    """A stream that is stopped and started between deliveries.

    Each delivery puts files in the inbox; then the query starts from its checkpoint, takes what
    is new and stops. State and watermark go on where the run before left them.
    """
    for deliver in deliveries:
        deliver()
        run_available(make(), handle, checkpoint, mode)


def ingest_prices(
    stream: DataFrame, table: str, checkpoint: str, order: Sequence[str] = ()
) -> None:
    """Incremental price ingest: late corrections arrive as repeated days and replace
    the stored row, so nothing is dropped for being late. ``order`` names the columns
    by which the last of several rows of one key in a batch is told."""

    def handle(batch: DataFrame, number: int) -> None:
        clean = clean_prices(batch).withColumn("trade_year", F.year("trade_date"))
        spark = batch.sparkSession
        if not path_exists(spark, table):
            clean.limit(0).drop(*order).write.partitionBy("trade_year").parquet(table)
        write_upsert(
            spark, table, clean, KEYS["price_daily"], "trade_year", order,
            schema=clean.drop(*order).schema,
        )

    run_available(stream, handle, checkpoint)
