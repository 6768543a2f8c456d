"""Registered queries against DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from tests.helpers import plan_text
from tickloom.queries import REGISTRY, oracle_texts

ROOT = "/root/testdata/sf0.001"
NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUICK = (
    "daily_bars ema rsi macd split_adjusted_bars mixed_source_prices swing_pivots "
    "support_resistance_zones signal_ma_stack latest_signal_scan strategy_ema_stack "
    "annual_ratios quarterly_growth multi_year_cagr piotroski_scores market_cap_as_of "
    "source_disagreements peer_percentile_ranks forward_outcomes membership_periods "
    "signal_backtest_summary equity_drawdown walk_forward price_upsert watchlist_merge "
    "audit_collapse membership_snapshot_sync universe_scan delivery_stats institutional_snapshots "
    "result_volatility flow_payloads ohlcv_validation price_coverage market_breadth "
    "event_bars_stream unique_events_stream price_ingest_stream"
).split()
CHOSEN = list(REGISTRY) if os.environ.get("TICKLOOM_ALL_QUERIES") else QUICK
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in NAMES:
        if os.path.exists(f"{ROOT}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{ROOT}/{name}.parquet'")
    return con


def key(row):
    return tuple((v is None, str(type(v)), round(v, 2) if isinstance(v, float) else v) for v in row)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, duck, name):
    df = REGISTRY[name].run(spark, ROOT)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    text = oracle_texts().get(name)
    if text is None:
        return
    result = duck.execute(text)
    header = [d[0] for d in result.description]
    assert sorted(header) == columns
    places = [header.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in places) for r in result.fetchall()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(same(x, y) for x, y in zip(a, b, strict=True)), (a, b)


def test_entry_and_contract(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_every_inventory_family_is_covered():
    covered = {i for q in REGISTRY.values() for i in q.covers}
    sizes = {"S": 16, "U": 16, "P": 41, "J": 12, "A": 28, "W": 25, "O": 10, "E": 5, "F": 8, "M": 9, "L": 13,
             "T": 4}
    absent = [f"{f}{i}" for f, n in sizes.items() for i in range(1, n + 1)
              if f"{f}{i}" not in covered]
    assert absent == []


#: What a query with the tag of a job must call.
JOBS = {
    "L1": {"add_technical_indicators", "indicators_with_state"}, "L2": {"scan_universe"}, "L3": {"scan_strategies"},
    "L4": {"refresh_eod", "continued_frame"}, "L5": {"refresh_fundamentals"},
    "L6": {"run_signal_backtest", "backtest_history"}, "L8": {"market_today"}, "L9": {"data_health"},
    "L10": {"compare_latest_scans"}, "L11": {"daily_brief"}, "L12": {"import_fundamentals"},
    "L13": {"refresh_market_flows", "sync_instruments", "refresh_index_membership", "import_membership_history"},
    "U11": {"save_scan", "append_run"}, "U13": {"replay_snapshots", "import_membership_history", "dated_snapshots"},
    "S7": {"banking_csv"}, "S11": {"delivery_files"}, "S15": {"write_snapshot", "sync_instruments"},
}


def called(function, seen=None):
    """Names that a query's function uses, through other functions of the package."""
    seen = set() if seen is None else seen
    codes = [function.__code__]
    for code in codes:
        codes += [c for c in code.co_consts if hasattr(c, "co_names")]
        for name in code.co_names:
            if name not in seen:
                seen.add(name)
                modules = [m for m in function.__globals__.values() if getattr(m, "__name__", "").startswith("tickloom")]
                found = [function.__globals__.get(name), *(getattr(m, name, None) for m in modules if hasattr(m, "__path__") or hasattr(m, "__file__"))]
                for other in found:
                    if hasattr(other, "__code__") and str(getattr(other, "__module__", "")).startswith("tickloom"):
                        called(other, seen)
    return seen


def test_tags_of_jobs_are_calls():
    wrong = [
        (name, tag) for name, q in REGISTRY.items() for tag in q.covers
        if tag in JOBS and not JOBS[tag] & called(q.build)
    ]
    assert wrong == []


@pytest.mark.parametrize("name", ["signal_backtest_trades", "split_adjusted_bars",
                                  "bars_near_events", "market_cap_as_of", "peer_percentile_ranks"])
def test_plans_stay_distributed(spark, name):
    text = plan_text(REGISTRY[name].run(spark, ROOT))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas",
                 "Exchange SinglePartition"):
        assert word not in text
