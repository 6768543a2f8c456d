"""Bundles of summaries (home page, data health): each table is scanned once.

A table is first reduced to a row per symbol (or run) in the shared folder; every part of a bundle
comes from those small tables. Parts come out as rows of (part, key, value).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators import ops
from tickloom.operators.windows import latest_rows
from tickloom.session import materialise


def as_rows(part: str, df: DataFrame, key: Column | None = None) -> DataFrame:
    """A small table as (part, key, value): the key is ``<row key>.<column>``, or the column alone."""
    names = [c for c in df.columns if c != "_key"]
    keyed = df.withColumn("_key", F.lit("") if key is None else F.concat(key, F.lit(".")))
    entries = F.array(
        *[
            F.struct(F.concat("_key", F.lit(c)).alias("key"), F.col(f"`{c}`").cast("string").alias("value"))
            for c in names
        ]
    )
    return keyed.select(F.lit(part).alias("part"), F.inline(entries))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def market_today(
    bars: DataFrame, scores: DataFrame, actions: DataFrame, runs: DataFrame, today: Column,
    trading_days: int = 5,
) -> DataFrame:
    """Breadth, score movers, top attention, upcoming events, stale symbols, provider health."""
    pairs = materialise(latest_rows(bars.select("symbol", "trade_date", "close"), 2), "last-bars")
    scored = materialise(_last_scores(scores), "last-scores")
    return union(
        [
            as_rows("breadth", ops.market_breadth(pairs)),
            as_rows("movers", ops.score_movers(scored).select("symbol", "score", "score_change"), F.col("symbol")),
            as_rows("attention", ops.top_attention(scored).select("symbol", "score", "signals"), F.col("symbol")),
            as_rows(
                "events",
                ops.upcoming_events(actions, today, trading_days).select("symbol", "date", "days_until"),
                F.col("symbol"),
            ),
            as_rows("stale", ops.stale_symbols(pairs, today, limit=10).select("symbol", "days_stale"), F.col("symbol")),
            as_rows("provider", ops.provider_health(runs)),
        ]
    )


def _last_scores(scores: DataFrame) -> DataFrame:
    """Each symbol's newest row, and its newest two with a score, from one window."""
    newest = Window.partitionBy("symbol").orderBy(F.desc("as_of_date"))
    scored = F.count("score").over(newest.rowsBetween(Window.unboundedPreceding, 0))
    placed = scores.withColumns({"_pos": F.row_number().over(newest), "_scored": scored})
    keep = (F.col("_pos") == 1) | (F.col("score").isNotNull() & (F.col("_scored") <= 2))
    return placed.where(keep).drop("_pos", "_scored")


def data_health(
    prices: DataFrame, scores: DataFrame, instruments: DataFrame, membership: DataFrame,
    runs: DataFrame, today: Column,
) -> DataFrame:
    """Coverage of prices, scores, instruments and membership, stale symbols, recent runs."""
    per_symbol = materialise(
        prices.groupBy("symbol", "source").agg(
            F.count("*").alias("rows"), F.min("trade_date").alias("oldest"), F.max("trade_date").alias("newest")
        ),
        "price-coverage",
    )
    covered = per_symbol.groupingSets([[], [F.col("source")]], F.col("source")).agg(
        F.sum("rows").alias("rows"), F.count_distinct("symbol").alias("distinct_symbols"),
        F.min("oldest").alias("oldest_trade_date"), F.max("newest").alias("newest_trade_date"),
    )
    days = per_symbol.withColumnRenamed("newest", "trade_date")
    exchange = F.coalesce("exchange", F.lit("total"))
    return union(
        [
            as_rows("prices", covered, F.coalesce("source", F.lit("total"))),
            as_rows("scores", ops.score_coverage(scores, today)),
            as_rows("instruments", ops.instrument_coverage(instruments).select("exchange", "instruments"), exchange),
            as_rows("membership", ops.membership_coverage(membership), F.col("index_name")),
            as_rows("stale", ops.stale_symbols(days, today).select("symbol", "days_stale"), F.col("symbol")),
            as_rows(
                "runs", ops.recent_runs(runs, today.cast("timestamp")).select("run_id", "failed_symbols"), F.col("run_id")
            ),
        ]
    )
