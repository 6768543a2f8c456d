"""Scan-to-scan comparison, daily brief, watchlist view, scan ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import freshness
from tickloom.operators.upsert import last_per_key


def rank_scan(results: DataFrame) -> DataFrame:
    return results.orderBy(F.desc_nulls_last("composite_score"), "symbol")


def filter_scan(results: DataFrame, min_score: float, min_signals: int) -> DataFrame:
    return results.where(
        F.col("error").isNull() & (F.col("composite_score") >= min_score)
        & (F.col("active_signal_count") >= min_signals)
    )


def write_pages(universe: DataFrame, path: str, rows_per_range: int = 100_000) -> None:
    """Store a universe in ranges of its symbols, with the number of rows of each range."""
    count = universe.count()
    ranges = max(1, -(-count // rows_per_range))
    placed = universe.repartitionByRange(ranges, "symbol").withColumn("range", F.spark_partition_id())
    placed.write.partitionBy("range").parquet(f"{path}/rows")
    stored = universe.sparkSession.read.parquet(f"{path}/rows")
    stored.groupBy("range").agg(F.count("*").alias("rows")).write.parquet(f"{path}/counts")


def read_page(spark: SparkSession, path: str, start: int, size: int) -> DataFrame:
    """Rows ``start`` … ``start+size-1`` (1-based) of a stored universe in symbol order.

    The counts (one row a range) say which ranges hold the page; only their files are read
    and sorted, so the last page costs what the first does.
    """
    start, size = max(1, start), max(1, size)
    before, wanted, skip = 0, [], 0
    for r in sorted(spark.read.parquet(f"{path}/counts").collect(), key=lambda r: r.range):
        if before + r.rows >= start and before < start - 1 + size:
            skip = skip if wanted else start - 1 - before
            wanted.append(r.range)
        before += r.rows
    rows = spark.read.parquet(f"{path}/rows").where(F.col("range").isin(wanted)).drop("range")
    return rows.orderBy("symbol").offset(max(0, skip)).limit(size)


def compare_scans(latest: DataFrame, previous: DataFrame | None) -> DataFrame:
    """Latest rows with score change, signal changes and a status."""
    empty = F.array().cast("array<string>")
    if previous is None:
        return latest.withColumns(
            {
                "previous_score": F.lit(None).cast("double"),
                "score_change": F.lit(None).cast("double"),
                "signal_count_change": F.lit(None).cast("double"),
                "new_active_signals": F.array_sort("active_signals"),
                "dropped_active_signals": empty,
                "comparison_status": F.lit("new scan row"),
            }
        )
    old = previous.select(
        "symbol", F.col("composite_score").alias("previous_score"),
        F.col("active_signals").alias("_old"), F.col("active_signal_count").alias("_old_n"),
        F.lit(True).alias("_seen"),
    )
    now, before = F.coalesce("active_signals", empty), F.coalesce("_old", empty)
    change = F.round(F.col("composite_score") - F.col("previous_score"), 2)
    status = (
        F.when(F.col("_seen").isNull(), F.lit("new symbol"))
        .when(change.isNull(), F.lit("not comparable"))
        .when(change >= 5, F.lit("improved"))
        .when(change <= -5, F.lit("weakened"))
        .otherwise(F.lit("stable"))
    )
    return (
        latest.join(old, "symbol", "left")
        .withColumns(
            {
                "score_change": change,
                "signal_count_change": (
                    F.col("active_signal_count") - F.col("_old_n")
                ).cast("double"),
                "new_active_signals": F.array_sort(F.array_except(now, before)),
                "dropped_active_signals": F.array_sort(F.array_except(before, now)),
                "comparison_status": status,
            }
        )
        .drop("_old", "_old_n", "_seen")
    )


def ranked_comparison(comparison: DataFrame) -> DataFrame:
    return comparison.orderBy(
        F.desc_nulls_last("score_change"), F.desc_nulls_last("composite_score"), "symbol"
    )


def brief_totals(comparison: DataFrame, min_score: float = 60.0, step: float = 5.0) -> DataFrame:
    """Counts and averages of the daily brief, one row."""
    ok = F.col("error").isNull()
    change = F.coalesce("score_change", F.lit(0.0))
    fresh = F.col("comparison_status").isin("new symbol", "new scan row")
    return comparison.agg(
        F.count("*").alias("requested_symbols"),
        F.count_if(ok).alias("successful_symbols"),
        F.count_if(~ok).alias("failed_symbols"),
        F.round(F.avg(F.when(ok, F.col("composite_score"))), 1).alias("average_score"),
        F.round(F.max(F.when(ok, F.col("composite_score"))), 1).alias("top_score"),
        F.count_if(ok & (change >= step)).alias("improved"),
        F.count_if(ok & (change <= -step)).alias("weakened"),
        F.count_if(
            ok & fresh & (F.coalesce("composite_score", F.lit(0.0)) >= min_score)
        ).alias("new_opportunities"),
        F.count_if(ok & (F.size("new_active_signals") > 0)).alias("new_signals"),
        F.count_if(~ok | (F.size("data_quality_warnings") > 0)).alias("data_quality_actions"),
    )


def brief_list(
    comparison: DataFrame, kind: str, *, min_score: float = 60.0, step: float = 5.0,
    limit: int | None = None,
) -> DataFrame:
    """One ranked list of the brief: improved, weakened, new_opportunities, new_signals,
    data_quality; at most ``limit`` rows (10, data_quality 15, unless given)."""
    limit = limit if limit is not None else 15 if kind == "data_quality" else 10
    ok = F.col("error").isNull()
    change = F.coalesce("score_change", F.lit(0.0))
    tail = [F.desc_nulls_last("composite_score"), "symbol"]
    if kind == "improved":
        rows, first = ok & (change >= step), F.desc_nulls_last("score_change")
    elif kind == "weakened":
        rows, first = ok & (change <= -step), F.asc_nulls_last("score_change")
    elif kind == "new_opportunities":
        rows = (
            ok & F.col("comparison_status").isin("new symbol", "new scan row")
            & (F.coalesce("composite_score", F.lit(0.0)) >= min_score)
        )
        first = F.desc_nulls_last("composite_score")
    elif kind == "new_signals":
        rows, first = ok & (F.size("new_active_signals") > 0), F.desc_nulls_last("score_change")
    elif kind == "data_quality":
        text = F.array_join("data_quality_warnings", "; ")
        rows = ~ok | (text != "")
        return comparison.where(rows).orderBy(
            F.desc_nulls_last("error"), text.desc_nulls_last(), "symbol"
        ).limit(limit)
    else:
        raise ValueError(f"unknown brief list: {kind}")
    return comparison.where(rows).orderBy(first, *tail).limit(limit)


BRIEF_LISTS = ("improved", "weakened", "new_opportunities", "new_signals", "data_quality")


def ranked_brief(comparison: DataFrame) -> DataFrame:
    """All lists of the brief in one table: kind, position from 1, and what the lists show."""
    shown = None
    for kind in BRIEF_LISTS:
        rows = brief_list(comparison, kind).select(
            F.lit(kind).alias("kind"), "symbol", "composite_score", "score_change",
            F.coalesce("new_active_signals", F.array().cast("array<string>")).alias("new_active_signals"),
            F.coalesce("error", F.array_join("data_quality_warnings", "; ")).alias("note"),
            F.monotonically_increasing_id().alias("_at"),
        )
        place = Window.partitionBy("kind").orderBy("_at")
        rows = rows.withColumn("position", F.row_number().over(place)).drop("_at")
        shown = rows if shown is None else shown.unionByName(rows)
    return shown


def latest_scan_row(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Newest scan row per symbol over all runs."""
    joined = results.join(runs.select("run_id", F.col("created_at").alias("run_at")), "run_id")
    return last_per_key(joined, ["symbol"], ["run_at", "run_id"])


def watchlist_with_scores(items: DataFrame, results: DataFrame, runs: DataFrame) -> DataFrame:
    newest = latest_scan_row(results, runs).select(
        "symbol",
        F.col("composite_score").alias("latest_score"),
        F.col("band").alias("latest_band"),
        F.col("run_id").alias("latest_run_id"),
        F.col("run_at").alias("latest_run_at"),
        F.col("last_close").alias("latest_close"),
        F.col("active_signal_count").alias("latest_active_signals"),
    )
    return items.join(newest, "symbol", "left")


def scan_freshness(runs: DataFrame, now: Column, fresh: int = 24, stale: int = 72) -> DataFrame:
    """Freshness of the latest run per universe; limits in hours."""
    last = runs.groupBy("universe_name").agg(F.max("created_at").alias("latest_run_at"))
    return last.withColumn("freshness", freshness("latest_run_at", now, fresh, stale))
