"""Swing pivots and support/resistance zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def swing_pivots(bars: DataFrame, window: int = 5) -> DataFrame:
    """Flags bars strictly above (below) all ``window`` neighbours on both sides."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    left, right = w.rowsBetween(-window, -1), w.rowsBetween(1, window)
    full = (F.count("*").over(left) == window) & (F.count("*").over(right) == window)
    h, l = F.col("high"), F.col("low")
    return bars.withColumns(
        {
            "swing_high": full & (h > F.max("high").over(left)) & (h > F.max("high").over(right)),
            "swing_low": full & (l < F.min("low").over(left)) & (l < F.min("low").over(right)),
        }
    )


def latest_swing_levels(bars: DataFrame, window: int = 5) -> DataFrame:
    p = swing_pivots(bars, window)
    day = F.col("trade_date")
    return p.groupBy("symbol").agg(
        F.max_by("high", F.when(F.col("swing_high"), day)).alias("last_swing_high"),
        F.max_by("low", F.when(F.col("swing_low"), day)).alias("last_swing_low"),
    )


def _clusters(prices: Column, tolerance_pct: float) -> Column:
    """Means of greedily grown clusters of an ascending price list."""
    start = F.struct(
        F.array().cast("array<double>").alias("means"),
        F.lit(0.0).alias("total"), F.lit(0).alias("n"),
    )

    def grow(acc: Column, price: Column) -> Column:
        mean = F.try_divide(acc["total"], acc["n"])
        near = (acc["n"] > 0) & (F.try_divide(F.abs(price - mean), mean) * 100 <= tolerance_pct)
        closed = F.when(acc["n"] > 0, F.concat(acc["means"], F.array(mean))).otherwise(acc["means"])
        return F.struct(
            F.when(near, acc["means"]).otherwise(closed).alias("means"),
            F.when(near, acc["total"] + price).otherwise(price).alias("total"),
            F.when(near, acc["n"] + 1).otherwise(F.lit(1)).alias("n"),
        )

    def finish(acc: Column) -> Column:
        return F.when(
            acc["n"] > 0, F.concat(acc["means"], F.array(F.try_divide(acc["total"], acc["n"])))
        ).otherwise(acc["means"])

    return F.aggregate(F.array_sort(prices), start, grow, finish)


def support_resistance(
    bars: DataFrame, *, window: int = 5, lookback: int = 252, tolerance_pct: float = 1.5,
    max_zones: int = 5,
) -> DataFrame:
    """Nearest zones on each side of the last close; a list per symbol holds at
    most ``lookback`` prices because older bars are cut first."""
    newest = Window.partitionBy("symbol").orderBy(F.col("trade_date").desc())
    recent = bars.withColumn("_pos", F.row_number().over(newest)).where(F.col("_pos") <= lookback)
    p = swing_pivots(recent, window)
    lists = p.groupBy("symbol").agg(
        F.max_by("close", "trade_date").alias("last_close"),
        F.collect_list(F.when(F.col("swing_high"), F.col("high"))).alias("_highs"),
        F.collect_list(F.when(F.col("swing_low"), F.col("low"))).alias("_lows"),
    )
    zones = lists.withColumns(
        {"_r": _clusters(F.col("_highs"), tolerance_pct), "_s": _clusters(F.col("_lows"), tolerance_pct)}
    )
    above = F.filter("_r", lambda x: x > F.col("last_close"))
    below = F.filter("_s", lambda x: x < F.col("last_close"))
    return zones.select(
        "symbol", "last_close",
        F.slice(F.sort_array(below, asc=False), 1, max_zones).alias("support"),
        F.slice(F.sort_array(above), 1, max_zones).alias("resistance"),
    )
