"""The jobs users call: scans, nightly refresh, imports, summaries.

Each one is a plan over all symbols at once.  A failing symbol becomes a row in an
error table instead of an exception.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.adjustments import apply_split_adjustment
from tickloom.operators.continuation import (
    first_states, indicators_with_state, loaded, new_rows, overlap_start, state_of,
)
from tickloom.operators.quality import validate_ohlcv
from tickloom.operators.scoring import score_stocks
from tickloom.operators.signals import latest_with_signals
from tickloom.operators.strategies import dedupe_sources, evaluate_strategies
from tickloom.operators.technicals import add_technical_indicators, last_indicators
from tickloom.operators.upsert import (
    KEYS, append_run, clean_prices, clean_snapshots, incremental_bounds,
    keep_latest, run_summary, store_by_year,
)
from tickloom.session import freed_shuffles, materialise, newest_parts

MIN_SCAN_BARS = 30
SNAPSHOT_INDICATORS = (
    "sma_20", "sma_50", "sma_100", "sma_200", "ema_20", "ema_50", "ema_100", "ema_200", "rsi_14",
    "macd", "macd_signal", "macd_hist", "atr_14", "historical_volatility_20", "relative_volume",
)


def scan_universe(
    bars: DataFrame, universe: DataFrame, as_of: Column, facts: DataFrame | None = None,
    last_bars: DataFrame | None = None, lookback_days: int | None = None,
) -> DataFrame:
    """Validate, compute indicators and signals, score; short or broken histories are
    error rows.

    ``lookback_days``: only so many calendar days of prices before ``as_of`` are read, by a
    filter that reaches the price scan; indicators then start in that window.

    ``facts``: optional score inputs per symbol (see ``scoring.INPUTS``); without it
    the scan scores technicals alone.  ``last_bars``: indicator rows from
    :func:`last_bars_at`, when they are at hand.
    """
    if lookback_days is not None:
        bars = bars.where(F.col("trade_date").between(F.date_sub(as_of, lookback_days), as_of))
    report = validate_ohlcv(bars, as_of, universe)
    rows = last_indicators(bars) if last_bars is None else last_bars
    last = latest_with_signals(rows).select(
        "symbol", "close", "rsi_14", "ema_50", "ema_200", "relative_volume", "ma_stack_status",
        "active_signals",
    )
    base = report.join(last, "symbol", "left")
    if facts is not None:
        base = base.join(facts, "symbol", "left")
    error = F.when(F.col("rows") < MIN_SCAN_BARS, F.lit("insufficient price history")).when(
        ~F.col("ok"),
        F.concat(F.lit("data quality failure: "), F.array_join("errors", "; ")),
    )
    scored = score_stocks(base.withColumn("error", error))
    good = F.col("error").isNull()
    empty = F.array().cast("array<string>")
    kept = {
        "composite_score": "score", "band": "band", "fundamentals": "fundamentals_score",
        "technicals": "technicals_score", "flows": "flows_score",
        "events_quality": "events_quality_score", "macro_sector": "macro_sector_score",
        "last_close": "close", "rsi_14": "rsi_14", "ma_stack": "ma_stack_status",
    }
    return scored.select(
        "symbol",
        *[F.when(good, F.col(source)).alias(name) for name, source in kept.items()],
        F.when(good, F.col("active_signal_count")).otherwise(0).alias("active_signal_count"),
        F.when(good, F.col("active_signals")).otherwise(empty).alias("active_signals"),
        F.when(good, F.col("warnings")).otherwise(empty).alias("data_quality_warnings"),
        F.when(good, F.col("reasons")).otherwise(empty).alias("reasons"),
        F.when(good, F.col("risks")).otherwise(empty).alias("risks"),
        F.when(good, F.col("missing_data")).otherwise(empty).alias("missing_data"),
        "error",
    )


def last_bars_at(bars: DataFrame, days: dict[str, Column]) -> DataFrame:
    """Each symbol's indicator row as it stood on several days, a row per symbol and day.

    Adds a boolean column per name in ``days``, true in the rows of that day; filtered by
    one, only that day's rows are worked out.
    """
    def row_at(name: str, day: Column) -> DataFrame:
        dated = F.col("trade_date")
        last = last_indicators(bars.where(dated.isNull() | (dated <= day)))
        return last.where(dated.isNotNull()).withColumns({other: F.lit(other == name) for other in days})

    return reduce(lambda a, b: a.unionByName(b), [row_at(*item) for item in days.items()])


def scan_strategies(
    prices: DataFrame, universe: DataFrame, as_of: Column, min_rows: int = 220, **options
) -> tuple[DataFrame, DataFrame]:
    """(triggered strategies, errors per symbol) over stored multi-source prices."""
    clean = dedupe_sources(prices)
    report = validate_ohlcv(clean, as_of, universe)
    error = F.when(
        F.col("rows") < min_rows,
        F.concat(F.lit("insufficient persisted price history ("), F.col("rows").cast("string"),
                 F.lit(" rows)")),
    ).when(
        ~F.col("ok"), F.concat(F.lit("data quality failure: "), F.array_join("errors", "; "))
    )
    judged = report.withColumn("message", error)
    ind = add_technical_indicators(clean).where(F.col("bar_number") == F.col("bar_count"))
    noted = F.concat("warnings", F.array_compact(F.array("source_warning")))
    rows = (
        ind.withColumnRenamed("source_label", "data_source")
        .join(judged.where(F.col("message").isNull()).select("symbol", "warnings"), "symbol")
        .withColumn("data_warnings", noted).drop("warnings", "source")
        .join(universe.withColumnRenamed("name", "company_name"), "symbol", "left")
    )
    errors = judged.where(F.col("message").isNotNull()).select("symbol", "message")
    return evaluate_strategies(rows, as_of, **options), errors


def composite_inputs(
    summary: DataFrame | None = None, banking: DataFrame | None = None,
    delivery: DataFrame | None = None, volatility: DataFrame | None = None,
    market: DataFrame | None = None, symbols: DataFrame | None = None,
) -> DataFrame:
    """Score inputs per symbol from the analytics tables that are available."""
    out = symbols.select("symbol").distinct()
    if summary is not None:
        out = out.join(
            summary.withColumn("has_fundamentals", F.col("status") != "no_data")
            .drop("errors", "warnings"), "symbol", "left")
    if banking is not None:
        newest = banking.groupBy("symbol").agg(
            F.max(F.struct("fiscal_year", *[c for c in banking.columns
                                            if c not in ("symbol", "fiscal_year")])).alias("_b")
        ).select("symbol", "_b.*").drop("fiscal_year", "source_url")
        newest = newest.withColumnsRenamed(
            {"source": "banking_source", "last_updated": "banking_last_updated"}
        )
        out = out.join(newest.withColumn("has_banking", F.lit(True)), "symbol", "left")
    if delivery is not None:
        d = delivery.withColumnRenamed("trend", "delivery_trend")
        out = out.join(d.withColumn("has_delivery", F.lit(True)), "symbol", "left")
    if volatility is not None:
        v = volatility.select("symbol", "volatility_multiple")
        out = out.join(v.withColumn("has_volatility", F.lit(True)), "symbol", "left")
    if market is not None:
        one = market.select(F.struct("market_score", "fii_trend", "dii_trend")).scalar()
        out = out.withColumn("_m", one).select(
            "*", "_m.market_score", "_m.fii_trend", "_m.dii_trend",
            F.lit(True).alias("has_market_flows"),
        ).drop("_m")
    return out


@dataclass(frozen=True)
class RefreshResult:
    """Lazy outputs of a nightly refresh."""

    prices: DataFrame
    snapshots: DataFrame
    scores: DataFrame
    errors: DataFrame
    run: DataFrame


def refresh_eod(
    stored: DataFrame, incoming: DataFrame, universe: DataFrame, splits: DataFrame,
    end: Column, *, run_id: str, order: Sequence[str], overlap_days: int = 5, years: int = 5,
    facts: DataFrame | None = None, write_root: str | None = None,
) -> RefreshResult:
    """Ingest, adjust, continue the indicators and score.

    Per symbol only days from (latest − overlap) on are taken from the batch. ``order`` names
    columns of the batch (an ingest number, say) by which the last of several rows of one key
    is told. Bounds, batch and rejected symbols are stored before anything is written, so they
    do not move with the table.

    With ``write_root``, ``stored`` is its table ``price_daily`` (by ``trade_date_year``);
    prices, snapshots, scores and run are upserted or appended there and read back. If the
    root has an ``indicator_state`` (see :func:`start_indicators`), only price partitions since
    the states' days are read: indicators go on from the state, and a new state is written.
    Without one, they are computed from whole histories.
    """
    spark = stored.sparkSession
    state = newest_state(spark, write_root) if write_root else None
    known = stored if state is None else state.select("symbol", F.col("latest_date").alias("trade_date"))
    bounds = materialise(incremental_bounds(universe, known, end, overlap_days, years), "bounds")
    wanted = incoming.join(
        bounds.where(~F.col("skip")).select("symbol", "start_date", "end_date"), "symbol"
    ).where(F.col("trade_date").between(F.col("start_date"), F.col("end_date")))
    batch = materialise(wanted.drop("start_date", "end_date"), "batch")
    report = validate_ohlcv(batch, end, universe)
    bad = materialise(
        report.where(~F.col("ok")).select("symbol", F.array_join("errors", "; ").alias("error")),
        "bad",
    )
    good = clean_prices(batch.join(bad, "symbol", "left_anti"))
    if write_root is None:
        merged = keep_latest(stored, good, KEYS["price_daily"], order).drop(*order)
        frame = indicators_with_state(apply_split_adjustment(dedupe_sources(merged), splits))
    else:
        prices = f"{write_root}/price_daily"
        merged = store_by_year(spark, prices, good, KEYS["price_daily"], "trade_date", order)
        frame = (
            indicators_with_state(apply_split_adjustment(dedupe_sources(merged), splits))
            if state is None else continued_frame(spark, prices, state, splits, good)
        )
        frame = materialise(frame, "indicators")
    starts = bounds.select("symbol", "start_date")
    ind = new_rows(frame)
    rows = ind.join(starts, "symbol").where(F.col("trade_date") >= F.col("start_date")).select(
        "symbol", F.col("trade_date").alias("as_of_date"), "close", *SNAPSHOT_INDICATORS,
        "ma_stack_status", "source",
    )
    snapshots = clean_snapshots(rows, SNAPSHOT_INDICATORS)
    last = latest_with_signals(ind).where(F.col("bar_count") >= MIN_SCAN_BARS)
    if facts is not None:
        last = last.join(facts, "symbol", "left")
    scores = score_stocks(last).select(
        "symbol", F.col("trade_date").alias("as_of_date"), "score", "band", "fundamentals_score",
        "technicals_score", "flows_score", "events_quality_score", "macro_sector_score",
        "active_signal_count", "active_signals", "reasons", "risks", "missing_data", "source",
    )
    outcome = universe.select("symbol").join(bad, "symbol", "left").withColumn(
        "run_id", F.lit(run_id)
    )
    run = run_summary(outcome)
    if write_root is not None:
        snapshots = store_by_year(
            spark, f"{write_root}/technical_snapshots", snapshots, KEYS["technical_snapshots"],
            "as_of_date", (),
        )
        scores = store_by_year(
            spark, f"{write_root}/composite_scores", scores, KEYS["composite_scores"],
            "as_of_date", (),
        )
        write_state(frame, splits, write_root, run_id, overlap_days)
        append_run(run, f"{write_root}/refresh_runs")
        run = spark.read.parquet(f"{write_root}/refresh_runs")
    return RefreshResult(merged, snapshots, scores, bad, run)


def newest_state(spark: SparkSession, write_root: str) -> DataFrame | None:
    """The states that the last run left, by the largest run_id."""
    path = f"{write_root}/indicator_state"
    runs = newest_parts(spark, path, "run_id", 1)
    return spark.read.parquet(f"{path}/run_id={runs[0]}") if runs else None


def write_state(
    frame: DataFrame, splits: DataFrame, write_root: str, run_id: str, overlap_days: int = 5
) -> None:
    """Each symbol's state as of its last bar that the next run does not read again."""
    _store_states(state_of(frame, overlap_start(overlap_days), splits), write_root, run_id)


def _store_states(states: DataFrame, write_root: str, run_id: str) -> None:
    with freed_shuffles(states.sparkSession):
        states.write.mode("overwrite").parquet(f"{write_root}/indicator_state/run_id={run_id}")


def start_indicators(
    stored: DataFrame, splits: DataFrame, write_root: str, run_id: str, overlap_days: int = 5
) -> None:
    """A first state from a whole price table, after which refreshes read its newest days only."""
    adjusted = apply_split_adjustment(dedupe_sources(stored), splits)
    states = first_states(adjusted, overlap_start(overlap_days), splits)
    _store_states(states, write_root, run_id)


def continued_frame(
    spark: SparkSession, prices: str, state: DataFrame, splits: DataFrame, incoming: DataFrame
) -> DataFrame:
    """Indicator rows from the states and the price partitions since the days of those that go on.

    A symbol of the batch reads its stored prices since its state; one without new prices has what
    it needs in its state. Only a symbol whose state holds no longer (a split was entered for a day
    before it) is computed from its whole history.
    """
    valid, broken = loaded(state, splits)
    valid, broken = materialise(valid, "states"), materialise(broken, "broken")
    active = materialise(incoming.groupBy("symbol").agg(F.min("trade_date").alias("first")), "active")
    known = active.join(valid, "symbol", "left").select(F.least("first", "last_date").alias("d"))
    since = known.agg(F.min("d")).first()[0]
    table, year = spark.read.parquet(prices), "trade_date_year"
    bars = table.where(F.lit(False))
    if since is not None:
        bars = table.where((F.col(year) >= since.year) & (F.col("trade_date") >= F.lit(since)))
        bars = bars.join(active.select("symbol"), "symbol", "left_semi")
    if not broken.isEmpty():
        bars = bars.join(broken, "symbol", "left_anti").unionByName(table.join(broken, "symbol", "left_semi"))
    adjusted = apply_split_adjustment(dedupe_sources(bars.drop(year)), splits)
    quiet = valid.join(active.select("symbol"), "symbol", "left_anti").select("symbol", F.inline("recent"))
    return indicators_with_state(adjusted.unionByName(quiet, allowMissingColumns=True), valid)
