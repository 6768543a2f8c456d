"""Append-only runs of a scan: one directory per universe and run, found by listing, never by reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.scans import brief_totals, compare_scans, ranked_brief
from tickloom.operators.upsert import run_summary
from tickloom.session import newest_parts

#: Columns a stored result row has besides run and universe.
RESULT = (
    "symbol", "composite_score", "band", "fundamentals", "technicals", "flows", "events_quality",
    "macro_sector", "last_close", "rsi_14", "ma_stack", "active_signal_count", "active_signals",
    "data_quality_warnings", "reasons", "risks", "missing_data", "error",
)


def _place(root: str, kind: str, universe: str, run_id: str = "") -> str:
    place = f"{root}/{kind}/universe_name={universe}"
    return f"{place}/run_id={run_id}" if run_id else place


def save_scan(
    results: DataFrame, root: str, universe: str, run_id: str, created_at: Column
) -> DataFrame:
    """Append one run: its result rows, then its run row. Returns the stored rows.

    Run ids are in order of time. A run that is there already is an error; a run counts as
    there once its run row is, so a run that was cut short is written anew.
    """
    spark = results.sparkSession
    if run_id in newest_parts(spark, _place(root, "scan_runs", universe), "run_id", 1 << 30):
        raise ValueError(f"run {run_id} of {universe} is stored already")
    rows = _place(root, "scan_results", universe, run_id)
    results.select(*RESULT).write.mode("overwrite").parquet(rows)
    stored = spark.read.parquet(rows)
    run = run_summary(stored.withColumn("run_id", F.lit(run_id))).withColumn("created_at", created_at)
    run.drop("run_id").write.mode("overwrite").parquet(_place(root, "scan_runs", universe, run_id))
    return stored


def stored_runs(spark: SparkSession, root: str) -> DataFrame:
    """All run rows with their universe and run id."""
    return spark.read.parquet(f"{root}/scan_runs")


def newest_scans(spark: SparkSession, root: str, universe: str, n: int = 2) -> list[DataFrame]:
    """The result rows of the newest complete runs, newest first; only these are read."""
    runs = newest_parts(spark, _place(root, "scan_runs", universe), "run_id", n)
    return [
        spark.read.parquet(_place(root, "scan_results", universe, run)).withColumn("run_id", F.lit(run))
        for run in runs
    ]


def compare_latest_scans(spark: SparkSession, root: str, universe: str) -> DataFrame:
    """The newest stored run of a universe against the one before it (all new without one)."""
    found = newest_scans(spark, root, universe)
    if not found:
        raise ValueError(f"no stored run of {universe}")
    return compare_scans(found[0], found[1] if len(found) > 1 else None)


def daily_brief(spark: SparkSession, root: str, universe: str) -> tuple[DataFrame, DataFrame]:
    """(totals, lists) of the newest run: one row, and the five ranked lists as (kind, position, …)."""
    compared = compare_latest_scans(spark, root, universe)
    return brief_totals(compared), ranked_brief(compared)
