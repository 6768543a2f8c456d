"""Delivery, institutional-flow and result-volatility analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import settled
from tickloom.operators.technicals import true_range


def delivery_analytics(delivery: DataFrame) -> DataFrame:
    """Rolling mean, z-score and spike flag per symbol-day."""
    w = Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(-19, 0)
    pct = F.col("delivery_pct")
    enough = F.count("delivery_pct").over(w) >= 5
    mean, std = F.avg("delivery_pct").over(w), F.stddev_samp("delivery_pct").over(w)
    df = delivery.withColumns(
        {
            "delivery_pct_ma20": F.when(enough, settled(mean, 2)),
            "delivery_pct_zscore": F.when(enough, settled(F.try_divide(pct - mean, std), 2)),
        }
    )
    return df.withColumn("unusual_delivery", unusual(pct, F.col("delivery_pct_ma20")))


def unusual(pct: Column, mean: Column) -> Column:
    return F.coalesce((pct >= 40.0) & (pct > 1.5 * mean), F.lit(False))


def delivery_stats(delivery: DataFrame) -> DataFrame:
    """One row per symbol: latest, averages, trend of the last five days, spike today."""
    w = Window.partitionBy("symbol").orderBy(F.col("trade_date").desc())
    # Positions among rows with a value; the newest row may lack one.
    df = delivery.withColumns(
        {
            "_pos": F.row_number().over(w),
            "_val": F.count("delivery_pct").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    pct, pos, val = F.col("delivery_pct"), F.col("_pos"), F.col("_val")
    recent, prior = F.avg(F.when(val <= 5, pct)), F.avg(F.when(val.between(6, 10), pct))
    # The rolling mean of the newest row alone, so that no other row needs a frame.
    rolling = F.when(pos <= 20, pct)
    ma20 = F.when(F.count(rolling) >= 5, settled(F.avg(rolling), 2))
    days = F.count("delivery_pct")
    return df.groupBy("symbol").agg(
        settled(F.max(F.when((val == 1) & pct.isNotNull(), pct)), 1).alias("latest_pct"),
        settled(ma20, 1).alias("ma20_pct"),
        settled(F.avg(pct), 1).alias("avg_90d_pct"),
        F.when(days >= 10,
               F.when(recent > prior * 1.05, F.lit("rising"))
               .when(recent < prior * 0.95, F.lit("falling"))
               .otherwise(F.lit("flat"))).alias("trend"),
        unusual(F.max(F.when(pos == 1, pct)), ma20).alias("unusual_today"),
        days.alias("days_with_data"),
    )


def institutional_snapshots(flows: DataFrame, short: int = 5, long: int = 20) -> DataFrame:
    """Latest net, last-5 and last-20 sums and trend per participant.

    Only the newest ``long`` valued rows per participant matter; the position is
    cut map-side before anything is gathered.
    """
    newest = Window.partitionBy("participant").orderBy(F.col("trade_date").desc())
    valued = flows.where(F.col("net_value_cr").isNotNull())
    tail = valued.withColumn("_pos", F.row_number().over(newest)).where(F.col("_pos") <= long)
    net, pos = F.col("net_value_cr"), F.col("_pos")
    sums = tail.groupBy("participant").agg(
        F.when(F.count_if(pos <= short) >= short, F.sum(F.when(pos <= short, net))).alias(
            "rolling_5d_net_cr"
        ),
        F.when(F.count("*") >= long, F.sum(net)).alias("rolling_20d_net_cr"),
    )
    last = (
        flows.withColumn("_pos", F.row_number().over(newest))
        .where("_pos = 1")
        .select("participant", F.col("trade_date").alias("latest_date"),
                net.alias("latest_net_cr"))
    )
    s, l = F.col("rolling_5d_net_cr") / short, F.col("rolling_20d_net_cr") / long
    trend = (
        F.when(s.isNull() | l.isNull(), F.lit("unknown"))
        .when((s > 0) & (l > 0) & (s >= l * 0.5), F.lit("bullish"))
        .when((s < 0) & (l < 0) & (s <= l * 0.5), F.lit("bearish"))
        .otherwise(F.lit("neutral"))
    )
    return last.join(sums, "participant", "left").withColumn("trend", trend)


def institutional_score(snapshots: DataFrame) -> DataFrame:
    """FII/DII trend pair mapped to one 0-100 value; NULL without usable history."""
    pair = snapshots.where(F.col("participant").isin("FII", "DII"))
    counts = pair.agg(
        F.count_if(F.col("trend") == "bullish").alias("bullish"),
        F.count_if(F.col("trend") == "bearish").alias("bearish"),
        F.count_if(F.col("trend") != "unknown").alias("known"),
        F.max(F.when(F.col("participant") == "FII", F.col("trend"))).alias("fii_trend"),
        F.max(F.when(F.col("participant") == "DII", F.col("trend"))).alias("dii_trend"),
    )
    up, down = F.col("bullish"), F.col("bearish")
    score = (
        F.when(F.col("known") == 0, F.lit(None).cast("double"))
        .when(up == 2, F.lit(80.0))
        .when((up == 1) & (down == 0), F.lit(65.0))
        .when((up == 1) & (down == 1), F.lit(50.0))
        .when((down == 1) & (up == 0), F.lit(40.0))
        .when(down == 2, F.lit(25.0))
        .otherwise(F.lit(50.0))
    )
    return counts.select("fii_trend", "dii_trend", score.alias("market_score"))


def near_event(bars: DataFrame, event_dates: DataFrame, window: int = 5) -> DataFrame:
    """Bars flagged when an event lies within ±2·window calendar days.

    Events join the bars' own window as marker rows; a RANGE frame looks both
    ways, so there is no range join and nothing to broadcast.  Only events inside
    the symbol's bar range count.
    """
    reach = 2 * window
    w = Window.partitionBy("symbol").orderBy("_day")
    whole = Window.partitionBy("symbol")
    both = (
        bars.withColumn("_event", F.lit(0))
        .unionByName(
            event_dates.select(
                "symbol", F.col("event_date").alias("trade_date"), F.lit(1).alias("_event")
            ).distinct(),
            allowMissingColumns=True,
        )
        .withColumn("_day", F.datediff("trade_date", F.lit("1970-01-01").cast("date")))
    )
    bar_day = F.when(F.col("_event") == 0, F.col("_day"))
    both = both.withColumns(
        {"_first": F.min(bar_day).over(whole), "_last": F.max(bar_day).over(whole)}
    )
    usable = (F.col("_event") == 1) & F.col("_day").between(F.col("_first"), F.col("_last"))
    both = both.withColumns(
        {
            "near_event": F.coalesce(
                F.max(usable.cast("int")).over(w.rangeBetween(-reach, reach)), F.lit(0)
            ) == 1,
            "events_found": F.sum(usable.cast("int")).over(whole),
        }
    )
    return both.where("_event = 0").drop("_event", "_day", "_first", "_last")


def result_volatility(bars: DataFrame, event_dates: DataFrame, window: int = 5) -> DataFrame:
    """Mean true range inside and outside event windows per symbol."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    flagged = near_event(
        bars.withColumn("_tr", true_range(w)), event_dates, window
    )
    inside, tr = F.col("near_event"), F.col("_tr")
    usable = (F.count(F.when(inside, tr)) >= 2) & (F.count(F.when(~inside, tr)) >= 10)
    sums = flagged.groupBy("symbol").agg(
        F.when(usable, F.avg(F.when(inside, tr))).alias("_event"),
        F.when(usable, F.avg(F.when(~inside, tr))).alias("_base"),
        F.coalesce(F.max("events_found"), F.lit(0)).alias("events_found"),
    )
    ratio = F.when(F.col("_base") > 0, F.col("_event") / F.col("_base"))
    return sums.select(
        "symbol",
        settled(F.col("_event"), 2).alias("event_atr"),
        settled(F.col("_base"), 2).alias("baseline_atr"),
        settled(ratio, 2).alias("volatility_multiple"),
        "events_found",
    )
