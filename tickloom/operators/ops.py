"""State summaries: coverage, staleness, breadth, movers, attention, events, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import business_days_after
from tickloom.operators.windows import latest_rows


def price_coverage(prices: DataFrame) -> DataFrame:
    """Totals and per-source rows in one pass (``source`` NULL = total)."""
    return prices.groupingSets([[], [F.col("source")]], F.col("source")).agg(
        F.count("*").alias("rows"),
        F.count_distinct("symbol").alias("distinct_symbols"),
        F.min("trade_date").alias("oldest_trade_date"),
        F.max("trade_date").alias("newest_trade_date"),
    )


def score_coverage(scores: DataFrame, today: Column) -> DataFrame:
    recent = F.col("as_of_date") >= F.date_sub(F.col("_today"), 7)
    return scores.withColumn("_today", today).agg(
        F.count_distinct("symbol").alias("distinct_symbols"),
        F.count("*").alias("total_rows"),
        F.count_if(recent).alias("rows_last_7_days"),
        F.max("as_of_date").alias("latest_as_of_date"),
    )


def instrument_coverage(instruments: DataFrame) -> DataFrame:
    return instruments.rollup("exchange").agg(F.count("*").alias("instruments"))


def membership_coverage(history: DataFrame) -> DataFrame:
    """Per index: open members, periods, first and last start, back-fill flag."""
    counts = history.groupBy("index_name").agg(
        F.count_if(F.col("active") & F.col("to_date").isNull()).alias("active_members"),
        F.count("*").alias("total_periods"),
        F.min("from_date").alias("earliest_from_date"),
        F.max("from_date").alias("latest_from_date"),
    )
    ready = F.col("total_periods") > F.col("active_members")
    warning = F.when(
        F.col("active_members") == 0,
        F.lit("No list of members is open."),
    ).when(
        ~ready,
        F.lit("Only today's list is known: back-tests of earlier years miss who left."),
    )
    return counts.withColumns({"historical_backfill_ready": ready, "warning": warning})


def stale_symbols(
    prices: DataFrame, today: Column, days: int = 5, limit: int | None = 20
) -> DataFrame:
    last = prices.groupBy("symbol").agg(F.max("trade_date").alias("latest_trade_date"))
    age = F.datediff(F.col("_today"), F.col("latest_trade_date"))
    out = (
        last.withColumn("_today", today).withColumn("days_stale", age)
        .where(F.col("days_stale") > max(1, days)).drop("_today")
        .orderBy("latest_trade_date", "symbol")
    )
    return out if limit is None else out.limit(limit)


def market_breadth(bars: DataFrame) -> DataFrame:
    """Advances and declines from each symbol's last two dates.

    Expects one bar per symbol-day; de-duplicate sources first.
    """
    pair = latest_rows(bars.select("symbol", "trade_date", "close"), 2).groupBy("symbol").agg(
        F.max("trade_date").alias("_day"),
        F.max_by("close", "trade_date").alias("_last"),
        F.min_by("close", "trade_date").alias("_before"),
        F.count("*").alias("_n"),
    )
    two = F.col("_n") == 2
    up, down = F.count_if(two & (F.col("_last") > F.col("_before"))), F.count_if(
        two & (F.col("_last") < F.col("_before"))
    )
    counts = pair.agg(
        F.max("_day").alias("latest_trade_date"),
        F.count_if(two).alias("compared_symbols"),
        up.alias("advances"), down.alias("declines"),
        F.count_if(two & (F.col("_last") == F.col("_before"))).alias("unchanged"),
    )
    a, d = F.col("advances"), F.col("declines")
    ratio = F.when(d > 0, F.round(a / d, 2)).when(a > 0, a.cast("double"))
    return counts.withColumn("advance_decline_ratio", ratio)


def score_movers(scores: DataFrame, k: int | None = 5) -> DataFrame:
    """Change between each symbol's last two scored dates, largest first."""
    pair = latest_rows(scores.where(F.col("score").isNotNull()), 2, order="as_of_date")
    day = "as_of_date"
    both = pair.groupBy("symbol").agg(
        F.max(day).alias("latest_date"), F.min(day).alias("previous_date"),
        F.max_by("score", day).alias("_now"), F.min_by("score", day).alias("_before"),
        F.max_by("band", day).alias("band"),
        F.max_by("active_signal_count", day).alias("signals"), F.count("*").alias("_n"),
    ).where("_n = 2")
    out = both.select(
        "symbol", "latest_date", "previous_date",
        F.round("_now", 1).alias("score"), F.round("_before", 1).alias("previous_score"),
        F.round(F.col("_now") - F.col("_before"), 1).alias("score_change"), "band",
        F.coalesce("signals", F.lit(0)).alias("signals"),
    ).orderBy(F.abs("score_change").desc(), F.desc("score"), "symbol")
    return out if k is None else out.limit(k)


def top_attention(scores: DataFrame, k: int = 5) -> DataFrame:
    """Best scores of the newest date with one risk call-out."""
    newest = scores.select(F.max("as_of_date")).scalar()
    callout = F.coalesce(
        F.get("risks", F.lit(0)), F.get("missing_data", F.lit(0)), F.lit("Review chart")
    )
    return (
        scores.where(F.col("as_of_date") == newest)
        .select("symbol", "as_of_date", F.round("score", 1).alias("score"), "band",
                F.col("active_signal_count").alias("signals"), callout.alias("risk_callout"))
        .orderBy(F.desc_nulls_last("score"), F.desc("signals"), "symbol")
        .limit(k)
    )


def upcoming_events(
    actions: DataFrame, today: Column, trading_days: int = 5, limit: int = 20
) -> DataFrame:
    df = actions.withColumn("_today", today)
    last = business_days_after("_today", max(1, trading_days))
    detail = F.coalesce("detail", F.col("value").cast("string"))
    return (
        df.where((F.col("ex_date") >= F.col("_today")) & (F.col("ex_date") <= last))
        .select("symbol", F.col("ex_date").alias("date"), F.col("action_type").alias("event"),
                detail.alias("detail"), F.datediff("ex_date", "_today").alias("days_until"))
        .orderBy("date", "symbol", "event").limit(limit)
    )


def recent_runs(runs: DataFrame, now: Column, limit: int = 10) -> DataFrame:
    age = F.greatest(
        F.lit(0), F.col("_now").cast("long") - F.col("finished_at").cast("timestamp").cast("long")
    )
    return (
        runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)
        .withColumn("_now", now.cast("timestamp"))
        .withColumn("age_seconds", F.when(F.col("finished_at").isNotNull(), age)).drop("_now")
    )


def provider_health(runs: DataFrame) -> DataFrame:
    """Traffic light of the latest run; one row also without any run."""
    last = runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(1)
    state = last.agg(
        F.max("run_id").alias("run_id"), F.max(F.lower("status")).alias("status"),
        F.max("failed_symbols").alias("failed_symbols"),
    )
    status, failed = F.col("status"), F.col("failed_symbols")
    fine = (status == "completed") & (failed == 0)
    partial = status.isin("completed", "completed_with_errors")
    label = (
        F.when(F.col("run_id").isNull(), F.lit("No refresh yet"))
        .when(fine, F.lit("Healthy")).when(partial, F.lit("Partial"))
        .otherwise(F.lit("Needs attention"))
    )
    colour = (
        F.when(F.col("run_id").isNull(), F.lit("amber"))
        .when(fine, F.lit("green")).when(partial, F.lit("amber")).otherwise(F.lit("red"))
    )
    return state.select("run_id", label.alias("label"), colour.alias("color"))


def source_mix(rows: DataFrame) -> DataFrame:
    """Share of rows per source; the total is taken over the few source rows."""
    counts = rows.groupBy("source").agg(F.count("*").alias("rows"))
    total = rows.select(F.count("*")).scalar()
    return counts.withColumn("share_pct", F.col("rows") * 100.0 / total)
