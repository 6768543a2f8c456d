"""Streaming jobs run over everything that is there, then read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.bridge import Tables
from tickloom.queries.registry import query
from tickloom.queries.sqlbase import sql
from tickloom.session import materialise, shared_path
from tickloom.streaming import jobs


def _folder(t: Tables, name: str) -> str:
    return shared_path(t.spark, name)


def _timed(events: DataFrame) -> DataFrame:
    """Watermarks need an instant; the files hold wall-clock times."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _wall_clock(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp_ntz"))


def event_stream(t: Tables) -> DataFrame:
    schema = t.read("events").schema
    return _timed(t.spark.readStream.schema(schema).parquet(f"{t.root}/events*.parquet"))


_BARS = """
SELECT event_type, date_trunc('hour', ts) AS bar_start, arg_min(value, event_id) AS open,
       max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close,
       count(*) AS volume FROM events GROUP BY 1, 2
"""


@query("event_bars", "T3", _BARS)
def event_bars(t: Tables) -> DataFrame:
    return _wall_clock(jobs.event_bars(_timed(t.read("events"))), "bar_start")


@query("event_bars_stream", "T3", _BARS)
def event_bars_stream(t: Tables) -> DataFrame:
    out = _folder(t, "event-bars")
    jobs.run_available(
        jobs.event_bars(event_stream(t)), jobs.write_batches(out), _folder(t, "state"), "update"
    )
    return _wall_clock(
        jobs.latest_batches(t.spark, out, ["event_type", "bar_start"]), "bar_start"
    )


@query("unique_events_stream", "T2", """
SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2
""")
def unique_events_stream(t: Tables) -> DataFrame:
    """Every event sent twice; one of each arrives."""
    out = _folder(t, "unique")
    stream = event_stream(t)
    jobs.run_available(
        jobs.unique_events(stream.union(stream), ["event_id"]), jobs.write_batches(out),
        _folder(t, "state"),
    )
    return t.spark.read.parquet(out).groupBy("user_id", "event_type").agg(
        F.count("*").alias("n")
    )


@query("rolling_event_totals", "T4", """
SELECT event_type, window_start, sum(value) AS total, count(*) AS n FROM (
  SELECT event_type, value, time_bucket(INTERVAL '3 hours', ts) - k * INTERVAL '3 hours'
         AS window_start FROM events CROSS JOIN (SELECT unnest([0, 1]) AS k))
GROUP BY 1, 2
""", "total")
def rolling_event_totals(t: Tables) -> DataFrame:
    return _wall_clock(jobs.rolling_totals(_timed(t.read("events"))), "window_start")


@query("price_ingest_stream", "T1 U1", sql("""
SELECT symbol, trade_date, source, close FROM bars2
"""))
def price_ingest_stream(t: Tables) -> DataFrame:
    """Price files of two deliveries; the second corrects what the first had wrong."""
    inbox, table = _folder(t, "inbox"), _folder(t, "price-daily")
    prices = t.bars_two_source
    wrong = prices.where(F.col("trade_date") >= "2001-01-01").withColumn("close", F.lit(1.0))
    prices.where(F.col("trade_date") < "2001-01-01").unionByName(wrong).write.parquet(f"{inbox}/1")
    state = _folder(t, "state")

    def stream(part: str) -> DataFrame:
        return t.spark.readStream.schema(prices.schema).parquet(f"{inbox}/{part}")

    jobs.ingest_prices(stream("1"), table, state)
    prices.where(F.col("trade_date") >= "2001-01-01").write.parquet(f"{inbox}/2")
    jobs.ingest_prices(stream("2"), table, _folder(t, "state"))
    return t.spark.read.parquet(table).select("symbol", "trade_date", "source", "close")


# --- late rows: four deliveries with an advancing watermark ------------------------------------

#: Delivery of an event: its week; one in 7 comes a delivery late, one in 11 of these two.
_DELIVERIES = 4


def _delivery(ts: Column, event: Column) -> Column:
    week = F.least(F.floor((F.dayofmonth(ts) - 1) / 8), F.lit(_DELIVERIES - 1))
    late = F.when(event % 77 == 0, 2).when(event % 7 == 0, 1).otherwise(0)
    return F.least(week + late, F.lit(_DELIVERIES - 1)).cast("int")


_SENT = f"""
SELECT *, least(least((day(ts) - 1) // 8, {_DELIVERIES - 1})
              + CASE WHEN event_id % 77 = 0 THEN 2 WHEN event_id % 7 = 0 THEN 1 ELSE 0 END, {_DELIVERIES - 1}) AS batch
FROM events
"""


def _marks(delay: str) -> str:
    """Watermark at each delivery: the latest time of the deliveries before it, less the delay."""
    return f"""
SELECT batch, (SELECT max(ts) FROM sent AS o WHERE o.batch < b.batch) - INTERVAL '{delay}' AS mark
FROM (SELECT DISTINCT batch FROM sent) AS b
"""


def delivered(t: Tables, name: str, transform, mode: str = "append") -> DataFrame:
    """The output rows of a stream over the four deliveries, restarted between them."""
    events, inbox, out = t.read("events"), _folder(t, "inbox"), _folder(t, name)
    sent = materialise(events.withColumn("batch", _delivery(F.col("ts"), F.col("event_id"))), "sent")

    def deliver(k: int):
        part = sent.where(F.col("batch") == k).drop("batch")
        return lambda: part.coalesce(1).write.mode("append").parquet(inbox)

    jobs.run_deliveries(
        lambda: transform(_timed(t.spark.readStream.schema(events.schema).parquet(inbox))),
        jobs.write_batches(out), _folder(t, "state"), [deliver(k) for k in range(_DELIVERIES)], mode,
    )
    return t.spark.read.parquet(out).drop("batch")


def _late_windows(keys: str, values: str, width: str, windows: str, delay: str) -> str:
    """Rows count in each window that has not ended by the watermark; windows come out once it has passed them."""
    return sql(f"""
SELECT event_type, start AS {keys}, {values}
FROM ({windows}) AS w JOIN marks USING (batch)
WHERE (mark IS NULL OR start + INTERVAL '{width}' > mark)
  AND start + INTERVAL '{width}' <= (SELECT max(ts) FROM sent) - INTERVAL '{delay}'
GROUP BY event_type, start
""", sent=_SENT, marks=_marks(delay))


@query("late_event_bars_stream", "T3", _late_windows(
    "bar_start", "arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, "
    "arg_max(value, event_id) AS close, count(*) AS volume", "1 hour",
    "SELECT *, date_trunc('hour', ts) AS start FROM sent", "10 days"))
def late_event_bars_stream(t: Tables) -> DataFrame:
    """Hourly bars; rows that are up to ten days late count, later ones do not."""
    bars = delivered(t, "late-bars", lambda s: jobs.event_bars(s, delay="10 days"))
    return _wall_clock(bars, "bar_start")


@query("late_rolling_totals_stream", "T4", _late_windows(
    "window_start", "sum(value) AS total, count(*) AS n", "6 hours",
    "SELECT s.*, time_bucket(INTERVAL '3 hours', ts) - k * INTERVAL '3 hours' AS start "
    "FROM sent AS s CROSS JOIN (SELECT unnest([0, 1]) AS k)", "10 days"), "total")
def late_rolling_totals_stream(t: Tables) -> DataFrame:
    """Sliding totals; of a late row's two windows one may be over while the other still counts."""
    totals = delivered(t, "late-totals", lambda s: jobs.rolling_totals(s, delay="10 days"))
    return _wall_clock(totals, "window_start")


@query("late_unique_events_stream", "T2", sql("""
SELECT event_type, count(*) AS n FROM (
  SELECT s.* FROM sent AS s JOIN marks USING (batch) WHERE mark IS NULL OR ts > mark) GROUP BY event_type
""", sent=_SENT, marks=_marks("10 days")))
def late_unique_events_stream(t: Tables) -> DataFrame:
    """Every event twice; one of each arrives, unless it is over ten days late."""
    rows = delivered(t, "late-unique", lambda s: jobs.unique_events(s.union(s), ["event_id"], "10 days"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))
