"""Continued indicators, clustered prices, stored runs, imports, pages and the equity curve."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import bars, exchanges, ordered, plan_text
from tickloom.operators import backtest as bt
from tickloom.operators import membership as mb
from tickloom.operators import runs as rn
from tickloom.operators import scans
from tickloom.operators.adjustments import apply_split_adjustment
from tickloom.operators.continuation import indicators_with_state, loaded, new_rows, state_of
from tickloom.operators.technicals import INDICATORS, add_technical_indicators
from tickloom.operators.upsert import store_by_year
from tickloom.plans import imports
from tickloom.plans.pipelines import continued_frame, newest_state, refresh_eod, start_indicators
from tickloom.session import newest_parts
from tickloom.sources.clustered import write_clustered

D = dt.date


def walk(spark, symbol, n, seed, start=D(2018, 1, 1), gaps=False):
    rng = np.random.default_rng(seed)
    closes = (100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))).round(2).tolist()
    volumes = rng.integers(100, 5000, n).astype(float).tolist()
    df = bars(spark, closes, symbol=symbol, start=start, volumes=volumes)
    if gaps:
        missing = F.datediff("trade_date", F.lit("1970-01-01").cast("date")) % 9 == 0
        df = df.withColumn("close", F.when(~missing, F.col("close")))
    return df


@pytest.fixture(scope="module")
def prices(spark):
    """Long, short, young and gappy histories, and one that ends before the others."""
    parts = [
        walk(spark, "LONG", 700, 1), walk(spark, "GAPS", 500, 2, D(2018, 7, 1), gaps=True),
        walk(spark, "SHORT", 30, 3, D(2019, 11, 1)), walk(spark, "YOUNG", 4, 4, D(2019, 11, 27)),
        walk(spark, "ENDED", 300, 5),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("source", F.lit("kite")).where(F.col("trade_date") <= "2019-11-30").cache()


def same_rows(got, want):
    a, b = ordered(got, "symbol", "trade_date"), ordered(want, "symbol", "trade_date")
    assert len(a) == len(b) > 0
    for name in (*INDICATORS, "bar_number", "bar_count", "prior_high_252", "prior_sma_200"):
        if a[name].dtype == object:
            assert (a[name].fillna("") == b[name].fillna("")).all(), name
        else:
            np.testing.assert_allclose(a[name].astype(float), b[name].astype(float), rtol=1e-9, atol=1e-9, err_msg=name)


SPLITS = "symbol string, ex_date date, value double"


@pytest.mark.parametrize("cut", [D(2018, 1, 20), D(2018, 12, 1), D(2019, 11, 5), D(2019, 11, 29)])
def test_continued_rows_are_those_of_the_whole_history(spark, prices, cut, tmp_path):
    """Splits before the cut, between, and one that only becomes known afterwards."""
    late = spark.createDataFrame([("LONG", D(2018, 11, 1), 2.0), ("LONG", D(2019, 11, 20), 3.0), ("GAPS", D(2019, 11, 28), 1.5)], SPLITS)
    early = late.where(F.col("ex_date") < F.lit(cut))
    adjusted = apply_split_adjustment(prices.where(F.col("trade_date") <= F.lit(cut)), early)
    state_of(indicators_with_state(adjusted), F.lit(cut), early).write.parquet(f"{tmp_path}/s")
    valid, broken = loaded(spark.read.parquet(f"{tmp_path}/s"), late)
    assert broken.count() == 0
    whole = apply_split_adjustment(prices, late)
    got = new_rows(indicators_with_state(whole, valid))
    want = add_technical_indicators(whole).join(
        valid.select("symbol", "last_date"), "symbol", "left"
    ).where(F.col("last_date").isNull() | (F.col("trade_date") > F.col("last_date")))
    same_rows(got, want)


def test_a_split_before_the_state_makes_it_invalid(spark, prices, tmp_path):
    """Only that symbol is computed from its history; the rest goes on, and the plan reads new partitions."""
    root = str(tmp_path)
    none = spark.createDataFrame([], SPLITS)
    stored = store_by_year(spark, f"{root}/price_daily", prices, ("symbol", "trade_date", "source"), "trade_date", ())
    start_indicators(stored.where("trade_date <= DATE '2019-10-31'"), none, root, "one")
    state = newest_state(spark, root)
    batch = stored.where("trade_date > DATE '2019-10-31'")
    frame = continued_frame(spark, f"{root}/price_daily", state, none, batch)
    filters = [line for line in plan_text(frame).splitlines() if "PartitionFilters: [isnotnull(trade_date_year" in line]
    assert len(filters) == 1 and ">= 2019)" in filters[0]
    splits = spark.createDataFrame([("ENDED", D(2018, 3, 1), 2.0)], SPLITS)
    got = new_rows(continued_frame(spark, f"{root}/price_daily", state, splits, batch))
    want = add_technical_indicators(apply_split_adjustment(stored, splits))
    seen = ordered(got.groupBy("symbol").count(), "symbol").set_index("symbol")["count"].to_dict()
    assert seen["ENDED"] == 300 and seen["LONG"] == 30 + 6
    quiet = new_rows(frame).where("symbol = 'ENDED'")
    same_rows(quiet, add_technical_indicators(stored).where("symbol = 'ENDED' AND trade_date >= DATE '2018-10-22'"))
    same_rows(got.where("trade_date > DATE '2019-10-31' OR symbol = 'ENDED'"),
              want.where("trade_date > DATE '2019-10-31' OR symbol = 'ENDED'"))


def test_nights_go_on_from_the_state(spark, prices, tmp_path):
    """Three nights from the state give the snapshots of one night over everything."""
    universe = prices.select("symbol").distinct()
    splits = spark.createDataFrame([("LONG", D(2019, 11, 21), 2.0)], SPLITS)
    early = prices.where("trade_date <= DATE '2019-11-10'")

    def nights(root, ends, with_state):
        stored = store_by_year(spark, f"{root}/price_daily", early, ("symbol", "trade_date", "source"), "trade_date", ())
        if with_state:
            start_indicators(stored, splits.limit(0), root, "0")
        for k, end in enumerate(ends):
            new = prices.where(F.col("trade_date") <= F.lit(end)).withColumn("seq", F.lit(1))
            stored = spark.read.parquet(f"{root}/price_daily").drop("trade_date_year")
            known = splits.where(F.col("ex_date") <= F.lit(end))
            done = refresh_eod(stored, new, universe, known, F.lit(end), run_id=f"{k + 1}", order=["seq"], write_root=root)
        names = ["symbol", "as_of_date", "sma_50", "ema_200", "rsi_14", "macd_signal", "atr_14"]
        last = done.snapshots.where("as_of_date >= DATE '2019-11-25'").select(*names)
        return ordered(last, "symbol", "as_of_date"), ordered(done.prices, "symbol", "trade_date", "source")

    a, p = nights(f"{tmp_path}/a", [D(2019, 11, 15), D(2019, 11, 22), D(2019, 11, 30)], True)
    b, q = nights(f"{tmp_path}/b", [D(2019, 11, 30)], False)
    assert len(a) and "seq" not in p.columns
    pd.testing.assert_frame_equal(p, q[list(p.columns)])
    pd.testing.assert_frame_equal(a, b, rtol=1e-9, atol=1e-9)


def test_clustered_prices_need_no_exchange(spark, prices):
    table = write_clustered(prices.drop("source"), "clustered_test", buckets=4)
    ind = add_technical_indicators(table)
    assert exchanges(ind) == [] and plan_text(ind).count("FileScan") == 1
    trades = bt.backtest_history(ind, 10)
    assert exchanges(trades) == [] and plan_text(trades).count("FileScan") == 1
    from tickloom.operators.signals import signal_events

    plain = add_technical_indicators(prices.drop("source"))
    want = bt.run_signal_backtest(signal_events(plain), prices, 10)
    keys = ["symbol", "signal", "entry_date"]
    pd.testing.assert_frame_equal(ordered(trades, *keys), ordered(want, *keys)[list(trades.columns)])


# --- equity ---------------------------------------------------------------------------------------

@pytest.mark.parametrize("range_trades", [10**6, 37, 1])
@pytest.mark.parametrize("losses", [(), (-100.0,), (-150.0,), (-150.0, -120.0, -100.0)])
def test_equity_is_the_product(spark, range_trades, losses):
    rng = np.random.default_rng(7)
    n = 120
    r = rng.normal(1, 8, n).round(3)
    for k, loss in enumerate(losses):
        r[70 + 12 * k] = loss
    day = [D(2020, 1, 1) + dt.timedelta(days=int(i // 7)) for i in range(n)]
    rows = [(f"S{i % 7}", "s", D(2019, 1, 1) + dt.timedelta(days=i), day[i], float(r[i]), 20) for i in range(n)]
    trades = spark.createDataFrame(rows, "symbol string, signal string, entry_date date, exit_date date, return_pct double, holding_days int")
    p = trades.toPandas().sort_values(["exit_date", "symbol", "signal", "entry_date"])
    equity = (1 + p.return_pct / 100).cumprod()
    got = ordered(bt.equity_curve(trades, range_trades), "day", "symbol", "signal", "entry_date")
    value = got.sign * np.exp(got.log_equity.fillna(0))
    np.testing.assert_allclose(value, equity, rtol=1e-9)
    np.testing.assert_allclose(got.drawdown, equity / equity.cummax() - 1, rtol=1e-9, atol=1e-12)
    row = bt.max_drawdown(trades, range_trades).collect()[0]
    assert row.max_drawdown_pct == pytest.approx((equity / equity.cummax() - 1).min() * 100)
    assert row.growth == pytest.approx(equity.iloc[-1])
    assert (row.log_return is None) == (equity.iloc[-1] <= 0)
    metrics = bt.portfolio_metrics(trades).collect()[0]
    assert metrics.absolute_return_pct == pytest.approx((equity.iloc[-1] - 1) * 100)


# --- pages, periods, runs --------------------------------------------------------------------------

def test_pages_read_their_own_ranges(spark, tmp_path):
    names = [f"S{i:04d}" for i in range(1000)]
    df = spark.createDataFrame([(n,) for n in names], "symbol string").repartition(5)
    scans.write_pages(df, str(tmp_path), 90)
    for start, size in ((1, 25), (100, 400), (976, 25), (990, 50), (0, 3), (2000, 5)):
        got = [r.symbol for r in scans.read_page(spark, str(tmp_path), start, size).collect()]
        first = max(1, start) - 1
        assert got == names[first : first + size]
    last = plan_text(scans.read_page(spark, str(tmp_path), 976, 25))
    assert "range" in last and last.count("FileScan") == 1


def test_periods_keep_the_last_known_attribute(spark):
    rows = [("A", D(2020, 1, 1), "old"), ("A", D(2020, 2, 1), "new"), ("A", D(2020, 3, 1), None), ("B", D(2020, 1, 1), "b"),
            ("B", D(2020, 3, 1), "b2"), ("C", D(2020, 2, 1), None)]
    df = spark.createDataFrame(rows, "symbol string, snapshot_date date, name string")
    got = {(r.symbol, r.from_date): (r.to_date, r.name) for r in mb.periods_from_snapshots(df, "i", "s", ["name"]).collect()}
    assert got == {
        ("A", D(2020, 1, 1)): (None, "new"), ("B", D(2020, 1, 1)): (D(2020, 1, 31), "b"),
        ("B", D(2020, 3, 1)): (None, "b2"), ("C", D(2020, 2, 1)): (D(2020, 2, 29), None),
    }
    history = mb.periods_from_snapshots(df, "i", "s", ["name"])
    with pytest.raises(ValueError, match="replace_existing"):
        mb.replay_snapshots(history, df, "i", "s")
    assert mb.replay_snapshots(history, df, "i", "s", True, ["name"]).count() == 4


def results(spark, rows):
    df = spark.createDataFrame(rows, "symbol string, composite_score double, active_signals array<string>, error string")
    empty = F.array().cast("array<string>")
    kinds = {c: F.lit(None).cast("double") for c in ("fundamentals", "technicals", "flows", "events_quality", "macro_sector", "last_close", "rsi_14")}
    return df.withColumns({
        **kinds, "band": F.lit("x"), "ma_stack": F.lit("mixed"), "active_signal_count": F.size("active_signals"),
        "data_quality_warnings": F.when(F.col("symbol") == "C", F.array(F.lit("stale"))).otherwise(empty),
        "reasons": empty, "risks": empty, "missing_data": empty,
    })


def test_runs_are_appended_and_the_newest_two_compared(spark, tmp_path):
    root, at = str(tmp_path), F.lit("2020-01-01").cast("timestamp")
    first = results(spark, [("A", 50.0, ["x"], None), ("B", 70.0, [], None), ("E", None, [], "bad")])
    second = results(spark, [("A", 60.0, ["x", "y"], None), ("B", 64.0, [], None), ("C", 75.0, ["z"], None), ("E", None, [], "bad")])
    rn.save_scan(first, root, "u", "1", at)
    with pytest.raises(ValueError, match="no stored run"):
        rn.compare_latest_scans(spark, root, "v")
    assert {r.comparison_status for r in rn.compare_latest_scans(spark, root, "u").collect()} == {"new scan row"}
    rn.save_scan(second, root, "u", "2", at)
    with pytest.raises(ValueError, match="stored already"):
        rn.save_scan(second, root, "u", "2", at)
    rn.save_scan(first, root, "other", "9", at)
    assert newest_parts(spark, f"{root}/scan_runs/universe_name=u", "run_id", 5) == ["2", "1"]
    compared = rn.compare_latest_scans(spark, root, "u")
    read = " ".join(compared.inputFiles())
    assert "universe_name=u/run_id=1" in read and "universe_name=u/run_id=2" in read and "universe_name=other" not in read
    status = {r.symbol: r.comparison_status for r in compared.collect()}
    assert status == {"A": "improved", "B": "weakened", "C": "new symbol", "E": "not comparable"}
    totals, lists = rn.daily_brief(spark, root, "u")
    assert totals.collect()[0].failed_symbols == 1
    got: dict[str, list] = {}
    for r in lists.orderBy("kind", "position").collect():
        got.setdefault(r.kind, []).append(r.symbol)
    assert got == {"improved": ["A"], "weakened": ["B"], "new_opportunities": ["C"], "new_signals": ["A", "C"], "data_quality": ["E", "C"]}
    runs = {(r.universe_name, str(r.run_id)): r.status for r in rn.stored_runs(spark, root).collect()}
    assert runs[("u", "2")] == "completed_with_errors"


# --- imports -----------------------------------------------------------------------------------------

def statements(spark, rows):
    return spark.createDataFrame(rows, "row int, Ticker string, FY string, Quarter string, Sales string, source_url string")


def test_import_gate_and_upsert(spark, tmp_path):
    root = str(tmp_path)
    rows = [(1, "aaa", "2020", "1", "10", None), (2, "aaa", "2020", "2", "11", "http://a"), (3, "aaa", "2020", "2", "12", "http://b"),
            (4, "bbb", "2020.0", "9", "5", None), (5, "bbb", "2020", "3", "(7)", None), (6, " ", "2020", "1", "1", None)]
    options = dict(source="s", order=["row"], quarterly=True, in_crore=False)
    shown = imports.import_fundamentals(statements(spark, rows), root, **options)
    preview = {r.symbol: (r.rows, r.errors) for r in shown.preview.collect()}
    assert preview["AAA.NS"] == (3, ["duplicate_period"]) and preview["BBB.NS"] == (2, ["fiscal_quarter_out_of_range"])
    assert preview["file"] == (6, ["rows without a symbol"]) and not shown.written
    kept_out = imports.import_fundamentals(statements(spark, rows), root, dry_run=False, **options)
    assert not kept_out.written and kept_out.counts.collect()[0].skipped == 6
    done = imports.import_fundamentals(statements(spark, rows), root, dry_run=False, allow_partial=True, **options)
    assert done.written
    stored = spark.read.parquet(f"{root}/fundamentals_quarterly")
    got = {(r.symbol, r.fiscal_quarter): (r.revenue, r.source_url) for r in stored.collect() if r.symbol}
    assert got == {("AAA.NS", 1): (10.0, "http://a"), ("AAA.NS", 2): (12.0, "http://a"), ("BBB.NS", 3): (-7.0, None)}
    again = imports.import_fundamentals(statements(spark, rows[:2]), root, dry_run=False, **options)
    counts = again.counts.collect()[0]
    assert (counts.inserted, counts.updated, counts.skipped) == (0, 2, 0)
    names = [r.symbol for r in spark.read.parquet(f"{root}/stock_universe").collect()]
    assert sorted(names) == ["AAA.NS", "BBB.NS"]


def test_stored_refreshes(spark, tmp_path):
    root = str(tmp_path)
    text = '[{"category": "FII/FPI *", "date": "02-Jan-2024", "buyValue": "1,000", "sellValue": "1", "netValue": "%s"}]'
    first = spark.createDataFrame([(1, text % 5), (2, text % 6)], "at int, payload string")
    done = imports.refresh_market_flows(first, root, "at")
    assert [(r.participant, r.net_value_cr) for r in done.collect()] == [("FII", 6.0)]
    later = spark.createDataFrame([(3, text % 7), (4, text.replace("02-Jan-2024", "03-Jan-2023") % 1)], "at int, payload string")
    assert sorted(r.net_value_cr for r in imports.refresh_market_flows(later, root, "at").collect()) == [1.0, 7.0]
    kind = "exchange string, tradingsymbol string, segment string, instrument_type string, instrument_token long"
    imports.sync_instruments(spark.createDataFrame([("NSE", "A", None, "EQ", 1), ("BSE", "A", "CM", "EQ", 2)], kind), root, "1")
    stored = imports.sync_instruments(spark.createDataFrame([("NSE", "A", None, "EQ", 5), ("NSE", "B", "FO", "FUT", 6)], kind), root, "2")
    assert sorted((r.exchange, r.tradingsymbol, r.instrument_token) for r in stored.collect()) == [("BSE", "A", 2), ("NSE", "A", 5), ("NSE", "B", 6)]
    wanted = spark.createDataFrame(
        [(1, "a ", None, None, None), (2, "B", "NSE", "", None), (3, "B", "nse", "FO", "FUT"), (4, "A", "BSE", None, None), (5, "Z", None, None, None)],
        "k int, tradingsymbol string, exchange string, segment string, instrument_type string")
    found = {r.k: r.instrument_token for r in imports.lookup_tokens(wanted, stored).collect()}
    assert found == {1: 5, 2: None, 3: 6, 4: 2, 5: None}


def test_membership_jobs(spark, tmp_path):
    path, root = f"{tmp_path}/index_membership_history", str(tmp_path)
    kind = "symbol string, snapshot_date date, name string, industry string, isin string"
    days = spark.createDataFrame([("A", D(2020, 1, 1), "a", "i", "x"), ("B", D(2020, 1, 1), "b", "i", "y"), ("A", D(2020, 2, 1), None, "j", None)], kind)
    mb.periods_from_snapshots(days.limit(0), "idx", "s", ("name", "industry", "isin")).write.parquet(path)
    done = imports.import_membership_history(days, root, "idx", "s")
    assert {(r.symbol, r.active, r.name, r.industry) for r in done.collect()} == {("A", True, "a", "j"), ("B", False, "b", "i")}
    with pytest.raises(ValueError, match="replace_existing"):
        imports.import_membership_history(days, root, "idx", "s")
    today = days.where("symbol = 'B'").drop("snapshot_date")
    synced = imports.refresh_index_membership(today, root, "idx", F.lit("2020-03-01").cast("date"), "s")
    got = sorted((r.symbol, str(r.from_date), str(r.to_date), r.active) for r in synced.collect())
    assert got == [("A", "2020-01-01", "2020-02-29", False), ("B", "2020-01-01", "2020-01-31", False), ("B", "2020-03-01", "None", True)]
