from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tests.helpers import bars, ordered, plan_text
from tickloom.operators import backtest as bt
from tickloom.operators.membership import changes, periods_from_snapshots, sync_snapshot
from tickloom.operators.ranking import add_peer_ranks, average_rank_percent
from pyspark.sql import functions as F

D = dt.date


def events(spark, rows):
    return spark.createDataFrame(rows, "symbol string, signal string, event_date date, close double")


def test_trade_windows(spark):
    b = bars(spark, [10.0, 11.0, 12.0, 9.0], start=D(2020, 1, 1))
    e = events(spark, [
        ("X.NS", "s", D(2019, 12, 25), 10.0),   # before the first bar
        ("X.NS", "s", D(2020, 1, 1), 10.0),
        ("X.NS", "s", D(2020, 1, 3), 12.0),     # one bar left: still completed
        ("X.NS", "s", D(2020, 1, 4), 9.0),      # nothing after: pending
        ("X.NS", "s", D(2020, 1, 2), None),
        ("Z.NS", "s", D(2020, 1, 2), 5.0),      # no prices
    ])
    got = ordered(bt.run_signal_backtest(e, b, 2), "symbol", "entry_date")
    by = {(r.symbol, r.entry_date): r for r in got.itertuples()}
    assert by["X.NS", D(2019, 12, 25)].exit_date == D(2020, 1, 2)
    first = by["X.NS", D(2020, 1, 1)]
    assert (first.exit_date, first.exit_price) == (D(2020, 1, 3), 12.0)
    assert first.mfe_pct == pytest.approx(30.0) and first.mae_pct == pytest.approx(0.0)
    assert by["X.NS", D(2020, 1, 3)].return_pct == pytest.approx(-25.0)
    for key in ((("X.NS", D(2020, 1, 4))), ("X.NS", D(2020, 1, 2)), ("Z.NS", D(2020, 1, 2))):
        assert pd.isna(by[key].return_pct)


def random_trades(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        entry = D(2015, 1, 1) + dt.timedelta(days=int(rng.integers(0, 2200)))
        # a third of all trades leave on one day
        leave = D(2021, 12, 31) if i % 3 == 0 else entry + dt.timedelta(days=int(rng.integers(1, 40)))
        value = None if i % 17 == 0 else float(np.round(rng.normal(0.5, 6), 3))
        rows.append((f"S{int(rng.integers(0, 30))}.NS", f"sig{i % 3}", entry, leave, value, 20, i))
    df = spark.createDataFrame(rows, "symbol string, signal string, entry_date date, exit_date date, "
                               "return_pct double, holding_days int, id int")
    return df.dropDuplicates(["symbol", "signal", "entry_date", "exit_date"]).drop("id")


def test_portfolio_metrics_against_pandas(spark):
    trades = random_trades(spark).cache()
    row = bt.portfolio_metrics(trades).collect()[0]
    p = trades.toPandas()
    done = p[p.return_pct.notna()].sort_values(["exit_date", "symbol", "signal", "entry_date"])
    r = done.return_pct / 100
    equity = (1 + r).cumprod()
    assert row.completed_trades == len(done) and row.pending_trades == len(p) - len(done)
    assert row.absolute_return_pct == pytest.approx((equity.iloc[-1] - 1) * 100)
    assert row.max_drawdown_pct == pytest.approx((equity / equity.cummax() - 1).min() * 100)
    assert row.sharpe_ratio == pytest.approx(r.mean() / r.std() * (252 / 20) ** 0.5)
    assert row.sortino_ratio == pytest.approx(r.mean() / r[r < 0].std() * (252 / 20) ** 0.5)
    assert row.max_symbol_concentration_pct == pytest.approx(
        done.symbol.value_counts().iloc[0] / len(done) * 100)


def test_no_completed_trade(spark):
    trades = random_trades(spark).withColumn("return_pct", F.lit(None).cast("double"))
    row = bt.portfolio_metrics(trades).collect()[0]
    assert row.completed_trades == 0 and row.unique_symbols == 0
    assert row.cagr_pct is None and row.max_drawdown_pct is None


def test_walk_forward_against_loops(spark):
    trades = random_trades(spark).cache()
    got = {(r.signal, r.train_start): r for r in bt.walk_forward(trades).collect()}
    p = trades.toPandas().dropna(subset=["return_pct"])
    start, end, want = p.entry_date.min(), p.entry_date.max(), {}
    day = dt.timedelta(days=1)
    while start + 1095 * day < end:
        for signal in sorted(set(p.signal)):
            s = p[p.signal == signal]
            train = s[(s.entry_date >= start) & (s.entry_date <= start + 1095 * day)]
            check = s[(s.entry_date >= start + 1096 * day) & (s.entry_date <= start + 1461 * day)]
            if len(train) or len(check):
                want[signal, start] = (len(train), len(check), train.return_pct.mean())
        start += 365 * day
    assert set(got) == set(want)
    for key, (n, m, mean) in want.items():
        assert (got[key].train_trades, got[key].validate_trades) == (n, m)
        assert got[key].train_avg_return_pct == pytest.approx(mean)


def test_summary_counts_flat_trades_as_losses(spark):
    t = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("a", -2.0), ("b", None)],
                              "signal string, return_pct double")
    got = {r.signal: r for r in bt.summarise_signals(t).collect()}
    assert (got["a"].win_count, got["a"].loss_count) == (1, 2)
    assert got["a"].profit_factor == pytest.approx(0.5)
    assert got["b"].total_trades == 0 and got["b"].win_rate_pct is None


def test_rank_percent_matches_pandas_with_ties_and_a_hot_value(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([np.full(200, 3.0), rng.normal(0, 1e3, 300), [-0.0, 0.0, 1e-9, -1e-9]])
    p = pd.DataFrame({"g": rng.choice(["a", "b"], len(values), p=[0.9, 0.1]), "v": values + 0.0})
    ranks = average_rank_percent(spark.createDataFrame(p), ["g"], "v").toPandas()
    got = p.merge(ranks, on=["g", "v"])
    assert len(got) == len(p)
    want = p.assign(w=p.groupby("g").v.rank(pct=True) * 100)
    want = want.drop_duplicates(["g", "v"]).merge(ranks, on=["g", "v"])
    np.testing.assert_allclose(want.rank_pct, want.w)


def test_peer_ranks_wide(spark):
    df = spark.createDataFrame(
        [("A", "x", "i", "small", 10.0, 1.0), ("B", "x", "i", "small", 20.0, 3.0),
         ("C", "x", "j", None, None, 2.0), ("D", "y", "k", "small", 5.0, None)],
        "symbol string, sector string, industry string, market_cap_bucket string, "
        "roe_pct double, debt_to_equity double")
    got = {r.symbol: r for r in add_peer_ranks(df).collect()}
    assert got["A"].roe_pct_sector_rank == 50.0 and got["B"].roe_pct_sector_rank == 100.0
    assert got["C"].roe_pct_sector_rank is None
    assert got["D"].roe_pct_sector_rank == 100.0
    assert got["A"].debt_to_equity_sector_rank == 100.0
    assert got["B"].debt_to_equity_sector_rank == pytest.approx(100 / 3)
    assert got["C"].debt_to_equity_mkt_cap_rank is None


def test_rank_plan_has_no_window_over_a_whole_group(spark):
    df = spark.createDataFrame([("a", 1.0)], "g string, v double")
    text = plan_text(average_rank_percent(df, ["g"], "v"))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_membership_periods_and_sync(spark):
    rows = [("A", D(2020, 1, 1)), ("A", D(2020, 4, 1)), ("A", D(2020, 10, 1)), ("B", D(2020, 7, 1))]
    snaps = spark.createDataFrame(rows, "symbol string, snapshot_date date")
    got = {(r.symbol, r.from_date): r.to_date
           for r in periods_from_snapshots(snaps, "N", "s").collect()}
    assert got == {("A", D(2020, 1, 1)): D(2020, 6, 30), ("B", D(2020, 7, 1)): D(2020, 9, 30),
                   ("A", D(2020, 10, 1)): None}
    history = periods_from_snapshots(snaps, "N", "s")
    now = spark.createDataFrame([("C",)], "symbol string")
    day = F.lit("2020-12-01").cast("date")
    after = {(r.symbol, r.from_date): (r.to_date, r.active)
             for r in sync_snapshot(history, now, "N", day, "s").collect()}
    assert after["A", D(2020, 10, 1)] == (D(2020, 11, 30), False)
    assert after["C", D(2020, 12, 1)] == (None, True)
    assert len(after) == 4
    with pytest.raises(ValueError):
        sync_snapshot(history, now.limit(0), "N", day, "s")
    moved = {(r.symbol, r.change) for r in changes(snaps, now).collect()}
    assert moved == {("C", "added"), ("A", "removed"), ("B", "removed")}


def test_membership_filter_is_point_in_time(spark):
    m = spark.createDataFrame([("N", "A", D(2020, 1, 1), D(2020, 6, 30)), ("N", "B", D(2020, 3, 1), None),
                               ("M", "C", D(2020, 1, 1), None)],
                              "index_name string, symbol string, from_date date, to_date date")
    e = spark.createDataFrame([("A", D(2020, 6, 30)), ("A", D(2020, 7, 1)), ("B", D(2021, 1, 1)),
                               ("B", D(2020, 2, 1)), ("C", D(2020, 2, 1))],
                              "symbol string, event_date date")
    got = {(r.symbol, r.event_date) for r in bt.events_in_index(e, m, "N").collect()}
    assert got == {("A", D(2020, 6, 30)), ("B", D(2021, 1, 1))}
