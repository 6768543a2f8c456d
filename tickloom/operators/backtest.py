"""Forward-return back-test, per-signal summary, portfolio metrics, walk-forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import safe_divide
from tickloom.operators.signals import signal_events
from tickloom.operators.windows import bars_window
from tickloom.session import materialise


def events_in_index(events: DataFrame, membership: DataFrame, index_name: str) -> DataFrame:
    """Events whose symbol was a member on the event date (point in time)."""
    m = membership.where(F.col("index_name") == index_name).select(
        "symbol", "from_date", "to_date"
    )
    inside = (
        (events["symbol"] == m["symbol"])
        & (m["from_date"] <= events["event_date"])
        & (m["to_date"].isNull() | (m["to_date"] >= events["event_date"]))
    )
    return events.join(m, inside, "left_semi")


def forward_outcomes(bars: DataFrame, holding: int) -> DataFrame:
    """For each bar: exit and extremes over the next ``holding`` bars (or as many
    as there are)."""
    ahead = Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(1, holding)
    return bars.select(
        "symbol", "trade_date",
        F.last("trade_date").over(ahead).alias("exit_date"),
        F.last("close").over(ahead).alias("exit_price"),
        F.max("high").over(ahead).alias("max_high"),
        F.min("low").over(ahead).alias("min_low"),
    )


def run_signal_backtest(events: DataFrame, bars: DataFrame, holding: int = 20) -> DataFrame:
    """One trade per event; entry at the event's close, no look-ahead.

    Events and bars are merged in one window by symbol: an event takes the bars
    strictly after its date, also when its own date is not a trading day.
    """
    ahead = Window.partitionBy("symbol").orderBy("trade_date", "_kind").rowsBetween(
        Window.unboundedPreceding, 0
    )
    outcomes = forward_outcomes(bars, holding)
    first = Window.partitionBy("symbol").orderBy("trade_date")
    # State before the first bar: the first `holding` bars themselves.
    head = bars.select(
        "symbol", "trade_date", "close", "high", "low", F.row_number().over(first).alias("_n")
    ).where(F.col("_n") <= holding)
    opening = head.groupBy("symbol").agg(
        F.max("trade_date").alias("exit_date"),
        F.max_by("close", "trade_date").alias("exit_price"),
        F.max("high").alias("max_high"),
        F.min("low").alias("min_low"),
    )
    state = F.struct("exit_date", "exit_price", "max_high", "min_low")
    points = outcomes.select(
        "symbol", "trade_date", F.lit(0).alias("_kind"), state.alias("_state")
    ).unionByName(
        opening.select(
            "symbol", F.lit("0001-01-01").cast("date").alias("trade_date"),
            F.lit(0).alias("_kind"), state.alias("_state"),
        )
    )
    asks = events.select(
        "symbol", F.col("event_date").alias("trade_date"), F.lit(1).alias("_kind"),
        "signal", F.col("close").alias("entry_price"),
    )
    merged = points.unionByName(asks, allowMissingColumns=True)
    seen = F.last("_state", ignorenulls=True).over(ahead)
    trades = merged.withColumn("_o", seen).where("_kind = 1")
    entry, usable = F.col("entry_price"), F.col("entry_price").isNotNull()

    def change(value: str) -> Column:
        return F.when(usable, safe_divide(F.col(value) - entry, entry) * 100.0)

    return trades.select(
        "symbol", "signal", F.col("trade_date").alias("entry_date"), "entry_price",
        F.when(usable, F.col("_o.exit_date")).alias("exit_date"),
        F.when(usable, F.col("_o.exit_price")).alias("exit_price"),
        change("_o.exit_price").alias("return_pct"),
        change("_o.max_high").alias("mfe_pct"),
        change("_o.min_low").alias("mae_pct"),
        F.lit(holding).alias("holding_days"),
    )


def backtest_history(indicators: DataFrame, holding: int = 20) -> DataFrame:
    """Trades of all signals of a history, from the indicator rows themselves.

    An event's bar is its own row, so what follows it is one more window of the frame that the
    indicators have: no second reading of the bars, no join, and no Exchange of its own.
    """
    ahead = bars_window(indicators).rowsBetween(1, holding)
    outcomes = {
        "exit_date": F.last("trade_date").over(ahead), "exit_price": F.last("close").over(ahead),
        "max_high": F.max("high").over(ahead), "min_low": F.min("low").over(ahead),
    }
    events = signal_events(indicators.withColumns(outcomes), *outcomes)
    entry, usable = F.col("close"), F.col("close").isNotNull()

    def change(value: str) -> Column:
        return F.when(usable, safe_divide(F.col(value) - entry, entry) * 100.0)

    return events.select(
        "symbol", "signal", F.col("event_date").alias("entry_date"), entry.alias("entry_price"),
        F.when(usable, F.col("exit_date")).alias("exit_date"),
        F.when(usable, F.col("exit_price")).alias("exit_price"),
        change("exit_price").alias("return_pct"), change("max_high").alias("mfe_pct"),
        change("min_low").alias("mae_pct"), F.lit(holding).alias("holding_days"),
    )


def summarise_signals(trades: DataFrame) -> DataFrame:
    r = F.col("return_pct")
    win, loss = r > 0, r <= 0
    won, lost = F.sum(F.when(win, r)), F.sum(F.when(loss, r))
    return trades.groupBy("signal").agg(
        F.count("return_pct").alias("total_trades"),
        F.count_if(win).alias("win_count"),
        F.count_if(loss).alias("loss_count"),
        (F.try_divide(F.count_if(win), F.count("return_pct")) * 100.0).alias("win_rate_pct"),
        F.avg("return_pct").alias("avg_return_pct"),
        F.avg(F.when(win, r)).alias("avg_win_pct"),
        F.avg(F.when(loss, r)).alias("avg_loss_pct"),
        F.try_divide(won, F.abs(lost)).alias("profit_factor"),
        F.max("return_pct").alias("best_trade_pct"),
        F.min("return_pct").alias("worst_trade_pct"),
    )


# --- equity curve ---------------------------------------------------------
# Trades lie in ranges of their order (exit day, symbol, …), as many as their number needs, so a
# day or symbol with very many trades is several ranges. A range is summed up by the logarithm of
# its factors, how many are negative and how many are zero; the few sums give each range's start,
# and then its curve. The same once more for the peak.

#: Trades in one range, about.
RANGE_TRADES = 1_000_000
_ORDER = ("day", "symbol", "signal", "entry_date")


def _before(w_order: str = "range") -> Window:
    """All earlier ranges: one row each, so one task holds them."""
    return Window.partitionBy(F.lit(0)).orderBy(w_order).rowsBetween(Window.unboundedPreceding, -1)


def equity_curve(trades: DataFrame, range_trades: int = RANGE_TRADES) -> DataFrame:
    """The compounded curve over completed trades in order of (exit date, symbol, signal, entry date).

    ``sign`` and ``log_equity`` give the product of all ``1 + return``: a loss of exactly
    100 % makes it zero from there on, a larger one turns its sign. ``drawdown`` is equity /
    highest equity so far - 1; while no equity has been above zero it is 0, or NULL for a zero.
    """
    done = materialise(
        trades.where(F.col("return_pct").isNotNull()).select(
            F.coalesce("exit_date", "entry_date").alias("day"), "symbol", "signal", "entry_date",
            (1 + F.col("return_pct") / 100).alias("factor"),
        ),
        "trades",
    )
    ranges = max(1, -(-done.count() // range_trades))
    ranged = materialise(
        done.repartitionByRange(ranges, *_ORDER).withColumn("range", F.spark_partition_id()), "ranges"
    )
    factor = F.col("factor")
    parts = {
        "log": F.when(factor != 0, F.ln(F.abs(factor))).otherwise(0.0),
        "minus": (factor < 0).cast("long"), "zero": (factor == 0).cast("long"),
    }
    inside = Window.partitionBy("range").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    bases = ranged.withColumns(parts).groupBy("range").agg(*[F.sum(c).alias(c) for c in parts])
    bases = bases.select(
        "range", *[F.coalesce(F.sum(c).over(_before()), F.lit(0)).alias(f"_{c}") for c in parts]
    )
    placed = ranged.withColumns(parts).withColumns({c: F.sum(c).over(inside) for c in parts})
    summed = placed.join(bases, "range").withColumns({c: F.col(c) + F.col(f"_{c}") for c in parts})
    sign = F.when(F.col("zero") > 0, 0).when(F.col("minus") % 2 == 1, -1).otherwise(1)
    level = F.when(F.col("zero") == 0, F.col("log"))
    curve = materialise(
        summed.select(*_ORDER, "range", sign.alias("sign"), level.alias("log_equity")), "curve"
    )
    above = F.when(F.col("sign") > 0, F.col("log_equity"))
    peaks = curve.groupBy("range").agg(F.max(above).alias("_peak")).select(
        "range", F.max("_peak").over(_before()).alias("_peak")
    )
    peak = F.greatest("_peak", F.max(above).over(inside))
    drawdown = (
        F.when(peak.isNotNull(), F.col("sign") * F.exp(F.coalesce("log_equity", F.lit(0.0)) - peak) - 1)
        .when(F.col("sign") < 0, 0.0)
    )
    return curve.join(peaks, "range").select(*_ORDER, "sign", "log_equity", drawdown.alias("drawdown"))


def max_drawdown(trades: DataFrame, range_trades: int = RANGE_TRADES) -> DataFrame:
    """Deepest fall of the curve and what is left of one unit, one row.

    ``log_return`` is NULL where nothing, or less than nothing, is left; ``growth`` holds it.
    """
    last = F.max_by(F.struct("sign", "log_equity"), F.struct(*_ORDER))
    return equity_curve(trades, range_trades).agg(
        (F.min("drawdown") * 100).alias("max_drawdown_pct"), last.alias("_last")
    ).select(
        "max_drawdown_pct",
        F.when(F.col("_last.sign") > 0, F.col("_last.log_equity")).alias("log_return"),
        (F.col("_last.sign") * F.exp(F.coalesce("_last.log_equity", F.lit(0.0)))).alias("growth"),
    )


def portfolio_metrics(trades: DataFrame) -> DataFrame:
    """One row of diagnostics over all trades."""
    done = F.col("return_pct").isNotNull()
    r = F.when(done, F.col("return_pct") / 100)
    exit_day = F.coalesce("exit_date", "entry_date")
    held = F.greatest(F.datediff(exit_day, "entry_date"), F.lit(1))
    downside = F.when(r < 0, r)
    per_symbol = trades.where(done).groupBy("symbol").count()
    spread = per_symbol.agg(
        F.count("*").alias("unique_symbols"), F.max("count").alias("_largest")
    ).select(F.struct("*")).scalar()
    curve = max_drawdown(trades).select(F.struct("*")).scalar()
    totals = trades.agg(
        F.count("*").alias("total_signals"),
        F.count("return_pct").alias("completed_trades"),
        F.avg((r > 0).cast("double")).alias("_win"),
        F.avg(r).alias("_mean"),
        F.stddev_samp(r).alias("_std"),
        F.stddev_samp(downside).alias("_down"),
        F.min(F.when(done, F.col("entry_date"))).alias("_start"),
        F.max(F.when(done, exit_day)).alias("_end"),
        F.sum(F.when(done, held)).alias("_held"),
        F.max(F.when(done, F.col("holding_days"))).alias("_holding"),
        F.avg(F.when(done, F.col("holding_days"))).alias("avg_holding_period_days"),
    ).withColumns({"_spread": spread, "_curve": curve})
    span = F.greatest(F.datediff("_end", "_start"), F.lit(1))
    growth, log_return = F.col("_curve.growth"), F.col("_curve.log_return")
    yearly = F.sqrt(252.0 / F.greatest("_holding", F.lit(1)))
    return totals.select(
        "total_signals", "completed_trades",
        (F.col("total_signals") - F.col("completed_trades")).alias("pending_trades"),
        ((growth - 1) * 100).alias("absolute_return_pct"),
        F.when(
            (span >= 30) & (growth >= 0),
            (F.coalesce(F.exp(log_return * (F.lit(365.0) / span)), F.lit(0.0)) - 1) * 100,
        ).alias("cagr_pct"),
        (F.col("_win") * 100).alias("win_rate_pct"),
        (F.col("_mean") * 100).alias("avg_return_pct"),
        F.col("_curve.max_drawdown_pct").alias("max_drawdown_pct"),
        (F.try_divide("_mean", "_std") * yearly).alias("sharpe_ratio"),
        (F.try_divide("_mean", "_down") * yearly).alias("sortino_ratio"),
        F.least(F.lit(100.0), F.col("_held") / span * 100).alias("exposure_time_pct"),
        F.col("completed_trades").alias("turnover"),
        "avg_holding_period_days",
        F.coalesce("_spread.unique_symbols", F.lit(0)).alias("unique_symbols"),
        (F.try_divide("_spread._largest", "completed_trades") * 100).alias(
            "max_symbol_concentration_pct"
        ),
    )


def walk_forward(trades: DataFrame, train_years: int = 3, validate_years: int = 1) -> DataFrame:
    """Train and next-window results per signal.

    Windows start every ``validate`` days, so the windows a trade falls in follow
    from its date by arithmetic: a short sequence per trade instead of a range join.
    """
    train, step = train_years * 365, validate_years * 365
    done = trades.where(F.col("return_pct").isNotNull()).select(
        "signal", "entry_date", "return_pct"
    )
    bounds = done.select(
        F.struct(F.min("entry_date").alias("first"), F.max("entry_date").alias("last"))
    ).scalar()
    day = F.datediff("entry_date", F.col("_b.first"))
    last_window = F.ceil((F.datediff(F.col("_b.last"), F.col("_b.first")) - train) / step) - 1

    def windows(first_day: int, length: int, is_train: bool) -> Column:
        low = F.greatest(F.ceil((day - first_day - length) / step), F.lit(0))
        high = F.least(F.floor((day - first_day) / step), last_window)
        numbers = F.when(high >= low, F.sequence(low, high))
        return F.transform(
            F.coalesce(numbers, F.array().cast("array<bigint>")),
            lambda k: F.struct(k.alias("k"), F.lit(is_train).alias("is_train")),
        )

    both = F.concat(windows(0, train, True), windows(train + 1, step, False))
    tagged = done.withColumn("_b", bounds).select(
        "signal", "return_pct", F.col("_b.first").alias("_origin"), F.inline(both)
    )
    r, is_train = F.col("return_pct"), F.col("is_train")

    def side(flag: Column, name: str) -> list[Column]:
        value = F.when(flag, r)
        return [
            F.count(value).alias(f"{name}_trades"),
            F.avg(value).alias(f"{name}_avg_return_pct"),
            (F.avg(F.when(flag, (r > 0).cast("double"))) * 100).alias(f"{name}_win_rate_pct"),
        ]

    stats = tagged.groupBy("k", "signal").agg(
        F.min("_origin").alias("_origin"), *side(is_train, "train"), *side(~is_train, "validate")
    )
    start = F.date_add("_origin", (F.col("k") * step).cast("int"))
    return stats.select(
        "signal",
        start.alias("train_start"),
        F.date_add(start, train).alias("train_end"),
        F.date_add(start, train + 1).alias("validate_start"),
        F.date_add(start, train + 1 + step).alias("validate_end"),
        "train_trades", "train_avg_return_pct", "train_win_rate_pct",
        "validate_trades", "validate_avg_return_pct", "validate_win_rate_pct",
        (F.col("validate_avg_return_pct") - F.col("train_avg_return_pct")).alias(
            "performance_drift_pct"
        ),
    )
