"""What a scan shows of a symbol comes from aggregates, not from frames of every row."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import START, ordered, plan_text
from tickloom.operators.continuation import first_states, indicators_with_state, overlap_start, state_of
from tickloom.operators.signals import latest_with_signals
from tickloom.operators.technicals import add_technical_indicators, last_indicators
from tickloom.plans.pipelines import last_bars_at

DDL = ("symbol string, trade_date date, open double, high double, low double, close double, "
       "volume double")


@pytest.fixture(scope="module")
def histories(spark):
    """Symbols of many lengths, each once whole and once with gaps in every column."""
    rng, rows = np.random.default_rng(3), []
    for length in (1, 2, 14, 15, 21, 35, 60, 122, 254, 1500):
        for gaps in (False, True):
            day = START
            for close in (100 * np.exp(np.cumsum(rng.normal(0, 0.03, length)))).tolist():
                day += dt.timedelta(days=int(rng.integers(1, 4)))
                values = [close, close * 1.02, close * 0.97, close, float(rng.integers(1, 9))]
                if gaps:
                    values = [None if rng.random() < 0.1 else v for v in values]
                rows.append((f"S{length}{'g' if gaps else ''}", day, *values))
    rows += [("FLAT", START + dt.timedelta(days=i), 5.0, 5.0, 5.0, 5.0, 0.0) for i in range(40)]
    rows += [("NONE", START + dt.timedelta(days=i), None, None, None, None, None) for i in range(40)]
    return spark.createDataFrame(rows, DDL).cache()


def assert_rows(got, want):
    got, want = ordered(got, "symbol"), ordered(want.select(*got.columns), "symbol")
    assert len(got) == len(want) > 0
    for name in want.columns:
        if want[name].dtype.kind == "f":
            np.testing.assert_allclose(
                got[name].astype(float), want[name], rtol=1e-9, atol=1e-9, err_msg=name)
        else:
            assert list(got[name].astype(str)) == list(want[name].astype(str)), name


def test_last_rows_equal_those_of_the_whole_frame(histories):
    want = add_technical_indicators(histories).where("bar_number = bar_count")
    got = last_indicators(histories)
    assert got.columns == want.columns
    assert_rows(got, want)


def test_rows_of_several_days_equal_those_of_shorter_histories(histories):
    days = {"now": F.lit("2030-01-01").cast("date"), "before": F.lit("2020-04-01").cast("date")}
    rows = last_bars_at(histories, days)
    for name, day in days.items():
        early = add_technical_indicators(histories.where(F.col("trade_date") <= day))
        got = rows.where(name)
        assert_rows(got.drop(*days), early.where("bar_number = bar_count"))
        assert "Union" not in plan_text(got)


def test_scans_number_rows_and_have_no_frame_for_each_indicator(histories):
    plan = plan_text(latest_with_signals(last_indicators(histories)).select("symbol", "active_signals", "rsi_14"))
    assert plan.split("Initial Plan")[0].count("Window [") <= 3
    assert "collect_list" not in plan and "Python" not in plan


@pytest.mark.parametrize("days", [5, 700])
def test_first_states_are_those_of_whole_frames(spark, histories, days):
    """Also for rows without a date, and symbols without a bar before the day."""
    none = spark.createDataFrame([("S60", None, 1.0, 2.0, 0.5, 1.5, 3.0), (None, START, 1.0, 2.0, 0.5, 1.5, 3.0)], DDL)
    bars = histories.unionByName(none)
    got = first_states(bars, overlap_start(days))
    want = state_of(indicators_with_state(bars), overlap_start(days))
    assert got.dtypes == want.dtypes
    got, want = (df.withColumns({c: F.to_json(c) for c in ("tail", "recent")}) for df in (got, want))
    assert_rows(got, want)
