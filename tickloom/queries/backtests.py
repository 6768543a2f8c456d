"""Forward returns, portfolio metrics and walk-forward validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.bridge import Tables
from tickloom.operators import backtest as bt
from tickloom.operators import membership as mb
from tickloom.operators import signals as sg
from tickloom.queries.indicators import indicators
from tickloom.queries.registry import query
from tickloom.queries.sqlbase import part, sql
from tickloom.session import materialise

INDEX = "Large Turnover"


def events(t: Tables) -> DataFrame:
    return sg.signal_events(indicators(t))


def stored_trades(t: Tables) -> DataFrame:
    """Trades written once to the shared folder, for jobs that pass over them repeatedly."""
    return materialise(bt.run_signal_backtest(events(t), t.bars))


def membership_snapshots(t: Tables) -> DataFrame:
    """Each calendar quarter the suppliers above the quarter's mean turnover are members."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    quarter = F.trunc("trade_date", "quarter")
    turnover = t.lines.groupBy(quarter.alias("snapshot_date"), "symbol").agg(
        F.sum(net).alias("net")
    )
    # One row per calendar quarter, so the mean is safe to broadcast.
    mean = turnover.groupBy("snapshot_date").agg(F.avg("net").alias("mean"))
    return turnover.join(F.broadcast(mean), "snapshot_date").where(
        F.col("net") > F.col("mean")
    ).select("symbol", "snapshot_date")


def membership(t: Tables) -> DataFrame:
    return mb.periods_from_snapshots(membership_snapshots(t), INDEX, "derived")


part("snapshots", """
SELECT symbol, snapshot_date FROM (
  SELECT symbol, snapshot_date, net, avg(net) OVER (PARTITION BY snapshot_date) AS mean
  FROM (SELECT symbol, CAST(date_trunc('quarter', trade_date) AS DATE) AS snapshot_date,
               sum(net) AS net FROM lines GROUP BY 1, 2))
WHERE net > mean
""")
part("calendar", """
SELECT snapshot_date, row_number() OVER (ORDER BY snapshot_date) AS k,
       lead(snapshot_date) OVER (ORDER BY snapshot_date) AS following
FROM (SELECT DISTINCT snapshot_date FROM snapshots)
""")
# A period starts where the previous snapshot lacks the symbol.
part("periods", """
SELECT symbol, min(snapshot_date) AS from_date,
       last(following ORDER BY snapshot_date) - 1 AS to_date
FROM (SELECT s.symbol, s.snapshot_date, c.following,
             sum(CASE WHEN p.symbol IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY s.symbol
               ORDER BY c.k) AS island
      FROM snapshots AS s JOIN calendar AS c ON c.snapshot_date = s.snapshot_date
      LEFT JOIN calendar AS b ON b.k = c.k - 1
      LEFT JOIN snapshots AS p ON p.symbol = s.symbol AND p.snapshot_date = b.snapshot_date)
GROUP BY symbol, island
""")
part("trades", """
SELECT e.symbol, e.signal, e.trade_date AS entry_date, e.close AS entry_price,
       f.exit_date, f.exit_price, (f.exit_price - e.close) / e.close * 100 AS return_pct,
       (f.max_high - e.close) / e.close * 100 AS mfe_pct,
       (f.min_low - e.close) / e.close * 100 AS mae_pct
FROM events_all AS e LEFT JOIN (
  SELECT a.symbol, a.n, arg_max(b.trade_date, b.n) AS exit_date, arg_max(b.close, b.n) AS exit_price,
         max(b.high) AS max_high, min(b.low) AS min_low
  FROM num AS a JOIN num AS b ON b.symbol = a.symbol AND b.n > a.n AND b.n <= a.n + 20
  GROUP BY 1, 2) AS f ON f.symbol = e.symbol AND f.n = e.n
""")


@query("forward_outcomes", "W12 J3", sql("""
SELECT a.symbol, a.trade_date, arg_max(b.trade_date, b.n) AS exit_date,
       arg_max(b.close, b.n) AS exit_price, max(b.high) AS max_high, min(b.low) AS min_low
FROM num AS a LEFT JOIN num AS b ON b.symbol = a.symbol AND b.n > a.n AND b.n <= a.n + 20
GROUP BY 1, 2
"""))
def forward_outcomes(t: Tables) -> DataFrame:
    return bt.forward_outcomes(t.bars, 20)


@query("membership_periods", "W14", sql(
    "SELECT symbol, from_date, to_date FROM periods"))
def membership_periods(t: Tables) -> DataFrame:
    return membership(t).select("symbol", "from_date", "to_date")


@query("events_in_index", "J4", sql("""
SELECT symbol, trade_date AS event_date, signal FROM events_all AS e
WHERE EXISTS (SELECT 1 FROM periods AS p WHERE p.symbol = e.symbol AND p.from_date <= e.trade_date
              AND (p.to_date IS NULL OR p.to_date >= e.trade_date))
"""))
def events_in_index(t: Tables) -> DataFrame:
    return bt.events_in_index(events(t), membership(t), INDEX).select(
        "symbol", "event_date", "signal"
    )


@query("signal_backtest_trades", "L6 J3 W12", sql(
    "SELECT symbol, signal, entry_date, entry_price, exit_date, exit_price, return_pct, mfe_pct, "
    "mae_pct FROM trades"))
def signal_backtest_trades(t: Tables) -> DataFrame:
    return bt.run_signal_backtest(events(t), t.bars).drop("holding_days")


SUMMARY_SQL = sql("""
SELECT signal, count(return_pct) AS total_trades, count(*) FILTER (return_pct > 0) AS win_count,
       count(*) FILTER (return_pct <= 0) AS loss_count,
       count(*) FILTER (return_pct > 0) * 100.0::DOUBLE / nullif(count(return_pct), 0)
         AS win_rate_pct,
       avg(return_pct) AS avg_return_pct, avg(return_pct) FILTER (return_pct > 0) AS avg_win_pct,
       avg(return_pct) FILTER (return_pct <= 0) AS avg_loss_pct,
       sum(return_pct) FILTER (return_pct > 0)
         / nullif(abs(sum(return_pct) FILTER (return_pct <= 0)), 0) AS profit_factor,
       max(return_pct) AS best_trade_pct, min(return_pct) AS worst_trade_pct
FROM trades GROUP BY signal
""")
SUMMARY_SUMS = (
    "win_rate_pct avg_return_pct avg_win_pct avg_loss_pct profit_factor best_trade_pct worst_trade_pct"
)


@query("signal_backtest_summary", "A1 L6", SUMMARY_SQL, SUMMARY_SUMS)
def signal_backtest_summary(t: Tables) -> DataFrame:
    return bt.summarise_signals(bt.run_signal_backtest(events(t), t.bars))


part("done", """
SELECT *, ln(1 + return_pct / 100) AS step,
       row_number() OVER (ORDER BY exit_date, symbol, signal, entry_date) AS k
FROM trades WHERE return_pct IS NOT NULL
""")
part("curve", """
SELECT k, exit_date, symbol, signal, entry_date,
       sum(step) OVER (ORDER BY k) AS level FROM done
""")


@query("equity_drawdown", "W13", sql("""
SELECT min((exp(level - peak) - 1) * 100) AS max_drawdown_pct, max_by(level, k) AS log_return
FROM (SELECT k, level, max(level) OVER (ORDER BY k) AS peak FROM curve)
"""), "max_drawdown_pct log_return")
def equity_drawdown(t: Tables) -> DataFrame:
    return bt.max_drawdown(bt.run_signal_backtest(events(t), t.bars)).drop("growth")


@query("portfolio_metrics", "A2", sql("""
SELECT (SELECT count(*) FROM trades) AS total_signals, count(*) AS completed_trades,
       (SELECT count(*) FROM trades) - count(*) AS pending_trades,
       avg(CASE WHEN return_pct > 0 THEN 1.0 ELSE 0 END) * 100 AS win_rate_pct,
       avg(return_pct) AS avg_return_pct,
       avg(return_pct) / stddev_samp(return_pct) * sqrt(252 / 20.0) AS sharpe_ratio,
       avg(return_pct) / stddev_samp(return_pct) FILTER (return_pct < 0) * sqrt(252 / 20.0)
         AS sortino_ratio,
       least(100, sum(greatest(exit_date - entry_date, 1)) * 100.0::DOUBLE
         / greatest(max(exit_date) - min(entry_date), 1)) AS exposure_time_pct,
       count(DISTINCT symbol) AS unique_symbols,
       (SELECT max(c) FROM (SELECT count(*) AS c FROM done GROUP BY symbol)) * 100.0::DOUBLE
         / count(*) AS max_symbol_concentration_pct,
       (exp(sum(step) * 365 / greatest(max(exit_date) - min(entry_date), 1)) - 1) * 100 AS cagr_pct,
       (exp(sum(step)) - 1) * 100 AS absolute_return_pct,
       (SELECT min((exp(level - peak) - 1) * 100) FROM (
          SELECT level, max(level) OVER (ORDER BY k) AS peak FROM curve)) AS max_drawdown_pct,
       count(*) AS turnover, 20.0::DOUBLE AS avg_holding_period_days
FROM done
"""), "win_rate_pct absolute_return_pct max_drawdown_pct avg_holding_period_days avg_return_pct sharpe_ratio sortino_ratio exposure_time_pct "
      "max_symbol_concentration_pct cagr_pct")
def portfolio_metrics(t: Tables) -> DataFrame:
    return bt.portfolio_metrics(stored_trades(t)).select(
        "total_signals", "completed_trades", "pending_trades", "win_rate_pct", "avg_return_pct",
        "sharpe_ratio", "sortino_ratio", "exposure_time_pct", "unique_symbols",
        "max_symbol_concentration_pct", "cagr_pct", "absolute_return_pct", "max_drawdown_pct",
        "turnover", "avg_holding_period_days",
    )


part("validation_windows", """
SELECT CAST(d.first_day + CAST(365 * k AS INTEGER) AS DATE) AS train_start
FROM (SELECT min(entry_date) AS first_day, max(entry_date) AS last_day FROM done) AS d,
     (SELECT unnest(range(0, 200)) AS k) AS r
WHERE d.first_day + CAST(365 * k + 1095 AS INTEGER) < d.last_day
""")


@query("walk_forward", "A3", sql("""
SELECT signal, train_start, train_start + 1095 AS train_end, train_start + 1096 AS validate_start,
       train_start + 1461 AS validate_end,
       count(*) FILTER (entry_date <= train_start + 1095) AS train_trades,
       avg(return_pct) FILTER (entry_date <= train_start + 1095) AS train_avg_return_pct,
       avg(CASE WHEN return_pct > 0 THEN 100.0 ELSE 0 END)
         FILTER (entry_date <= train_start + 1095) AS train_win_rate_pct,
       count(*) FILTER (entry_date > train_start + 1095) AS validate_trades,
       avg(return_pct) FILTER (entry_date > train_start + 1095) AS validate_avg_return_pct,
       avg(CASE WHEN return_pct > 0 THEN 100.0 ELSE 0 END)
         FILTER (entry_date > train_start + 1095) AS validate_win_rate_pct,
       avg(return_pct) FILTER (entry_date > train_start + 1095)
         - avg(return_pct) FILTER (entry_date <= train_start + 1095) AS performance_drift_pct
FROM validation_windows JOIN done
  ON entry_date BETWEEN train_start AND train_start + 1461
GROUP BY signal, train_start
"""), "train_avg_return_pct train_win_rate_pct validate_avg_return_pct validate_win_rate_pct "
      "performance_drift_pct")
def walk_forward(t: Tables) -> DataFrame:
    return bt.walk_forward(stored_trades(t))
