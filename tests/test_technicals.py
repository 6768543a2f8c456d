from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import bars, exchanges, ordered, plan_text
from tickloom.operators.adjustments import apply_split_adjustment
from tickloom.operators.recurrences import Recurrence, number_rows, smooth, span
from tickloom.operators.signals import latest_with_signals, signal_events, signal_rows
from tickloom.operators.structure import latest_swing_levels, support_resistance, swing_pivots
from tickloom.operators.technicals import add_technical_indicators
from tickloom.operators.windows import with_history_block


def walk(n, seed=7):
    rng = np.random.default_rng(seed)
    return list(np.round(100 * np.exp(np.cumsum(rng.normal(0, 0.02, n))), 2))


def assert_same(got: pd.Series, want: pd.Series, tol=1e-9):
    got, want = got.astype(float).reset_index(drop=True), want.reset_index(drop=True)
    assert list(got.isna()) == list(want.isna())
    mask = want.notna()
    np.testing.assert_allclose(got[mask], want[mask], rtol=tol, atol=1e-9)


def test_recurrences_carry_over_blocks(spark):
    closes = walk(700)
    df = with_history_block(bars(spark, closes), block_days=60)
    out = smooth(number_rows(df), [
        span("e12", "close", 12), span("e200", "close", 200),
        Recurrence("w14", F.col("close"), 1 / 14, 14),
    ])
    got = ordered(out.select("trade_date", "e12", "e200", "w14"), "trade_date")
    s = pd.Series(closes)
    assert_same(got.e12, s.ewm(span=12, adjust=False, min_periods=12).mean())
    assert_same(got.e200, s.ewm(span=200, adjust=False, min_periods=200).mean())
    assert_same(got.w14, s.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean())


def test_long_history_never_overflows(spark):
    """30 years of daily bars: q^-n alone would exceed a double."""
    closes = walk(11_000)
    out = add_technical_indicators(bars(spark, closes, start=dt.date(1990, 1, 1)))
    got = ordered(out.select("trade_date", "macd", "macd_signal", "ema_20"), "trade_date")
    s = pd.Series(closes)
    macd = (s.ewm(span=12, adjust=False, min_periods=12).mean()
            - s.ewm(span=26, adjust=False, min_periods=26).mean())
    assert_same(got.ema_20, s.ewm(span=20, adjust=False, min_periods=20).mean())
    assert np.isfinite(got.macd_signal.dropna()).all()
    np.testing.assert_allclose(
        got.macd_signal.astype(float), macd.ewm(span=9, adjust=False, min_periods=9).mean(),
        rtol=1e-6, atol=1e-7)


@pytest.mark.parametrize("n", [1, 13, 14, 15, 19, 20, 21, 26, 33, 34, 120, 199, 200, 260])
def test_warm_up_edges(spark, n):
    closes = walk(n)
    got = ordered(add_technical_indicators(bars(spark, closes)), "trade_date")
    c = pd.Series(closes)
    h, low = c + 1, c - 1
    d = c.diff()
    gain = d.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    loss = (-d.clip(upper=0)).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    assert_same(got.rsi_14, (100 - 100 / (1 + gain / loss)).where(loss != 0, 100.0))
    tr = pd.concat([h - low, (h - c.shift()).abs(), (low - c.shift()).abs()], axis=1).max(axis=1)
    assert_same(got.atr_14, tr.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean())
    for k in (20, 50, 100, 200):
        assert_same(got[f"sma_{k}"], c.rolling(k).mean())
    assert_same(got.high_52w, h.rolling(252, min_periods=20).max())
    assert_same(got.historical_volatility_20, c.pct_change().rolling(20).std() * 252**0.5 * 100)
    assert_same(got.prior_high_120, h.shift(1).rolling(120).max())
    assert_same(got.prior_sma_200, c.rolling(200).mean().shift(1))


@pytest.mark.parametrize("gaps", [(0, 1, 5), (30,), (40, 41, 42, 100), (259,), (0, 3, 60, 61, 200, 258, 259)])
def test_missing_closes(spark, gaps):
    """Means need all values, averages keep their state over a gap, returns are padded."""
    closes = walk(260)
    df = bars(spark, closes).withColumn(
        "close", F.when(~F.datediff("trade_date", F.lit(dt.date(2020, 1, 1))).isin(list(gaps)), F.col("close")))
    got = ordered(add_technical_indicators(df), "trade_date")
    c = pd.Series(closes)
    h, low = c + 1, c - 1
    c[list(gaps)] = np.nan
    d = c.diff()
    gain = d.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    loss = (-d.clip(upper=0)).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    assert_same(got.rsi_14, (100 - 100 / (1 + gain / loss)).where(loss != 0, 100.0))
    tr = pd.concat([h - low, (h - c.shift()).abs(), (low - c.shift()).abs()], axis=1).max(axis=1)
    assert_same(got.atr_14, tr.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean())
    for k in (20, 50, 100, 200):
        assert_same(got[f"sma_{k}"], c.rolling(k).mean())
        assert_same(got[f"ema_{k}"], c.ewm(span=k, adjust=False, min_periods=k).mean())
    e12, e26 = (c.ewm(span=k, adjust=False, min_periods=k).mean() for k in (12, 26))
    assert_same(got.macd, e12 - e26)
    assert_same(got.macd_signal, (e12 - e26).ewm(span=9, adjust=False, min_periods=9).mean())
    assert_same(got.bb_upper, c.rolling(20).mean() + 2 * c.rolling(20).std())
    padded = c.ffill()
    returns = padded / padded.shift() - 1
    assert_same(got.historical_volatility_20, returns.rolling(20).std() * 252**0.5 * 100)


def test_blocks_with_too_many_rows_are_an_error(spark):
    df = bars(spark, [1.0] * 40).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(100))).alias("copy"))
    with pytest.raises(Exception, match="too many rows"):
        number_rows(df).agg(F.max("_block_row")).collect()


def test_flat_prices_give_full_rsi_and_zero_volume_gives_null(spark):
    got = ordered(add_technical_indicators(bars(spark, [10.0] * 30, volumes=[0.0] * 30)), "trade_date")
    assert got.rsi_14.iloc[-1] == 100.0
    assert pd.isna(got.relative_volume.iloc[-1])
    assert set(got.ma_stack_status) == {"mixed"}


def test_one_clustering_serves_all_indicators(spark):
    df = add_technical_indicators(bars(spark, walk(40)))
    assert len(exchanges(df)) == 1
    assert plan_text(df).count("Sort [") == 1
    assert "Python" not in plan_text(df)
    # Only what is asked for is computed.
    assert plan_text(df.select("symbol", "ema_20")).count("stddev") == 0


def active(spark, closes, **kw):
    last = latest_with_signals(add_technical_indicators(bars(spark, closes, **kw)))
    return last.collect()[0]["active_signals"]


def test_darvas_base_breakout(spark):
    closes = [100 + (i % 3) for i in range(30)] + [106]
    assert "Darvas Base Breakout" in active(spark, closes)
    assert "Darvas Base Breakout" not in active(spark, closes[-21:][:20])


def test_oversold(spark):
    closes = [100 + 0.05 * i for i in range(60)] + [102 - 2.5 * i for i in range(1, 16)] + [45]
    assert "Mean-Reversion Oversold" in active(spark, closes)


def test_breakout_with_volume_uses_partial_window(spark):
    closes = [100 + 0.1 * i for i in range(60)]
    volumes = [1000.0] * 59 + [5000.0]
    assert "Breakout With Volume" in active(spark, closes[:59] + [120], volumes=volumes)


def test_golden_and_death_cross(spark):
    down = [200 - 0.5 * i for i in range(210)]
    up = down + [down[-1] + 6 * i for i in range(1, 80)]
    events = signal_events(add_technical_indicators(bars(spark, up)))
    crosses = events.where("signal = 'Golden/Death Cross'").select("detail").collect()
    assert [r[0] for r in crosses] == ["The 50 day average has come over the 200 day one."]


def test_trade_plan_values(spark):
    closes = [100 + 0.5 * i for i in range(260)]
    row = signal_events(add_technical_indicators(bars(spark, closes))).where(
        "signal = 'MA Stack'").orderBy(F.desc("event_date")).first()
    atr = (row.trigger_price - row.stop_loss) / 2
    assert row.target_price == pytest.approx(row.trigger_price + 5 * atr, abs=0.02)
    assert row.risk_reward == 2.5
    assert row.confidence == 65.0


def test_split_adjustment(spark):
    day = dt.date(2020, 1, 1)
    b = bars(spark, [100.0, 100.0, 50.0, 50.0, 10.0])
    splits = spark.createDataFrame(
        [("X.NS", dt.date(2020, 1, 3), 2.0), ("X.NS", dt.date(2020, 1, 5), 5.0),
         ("X.NS", day, 0.0), ("X.NS", day, None), ("Y.NS", dt.date(2020, 1, 9), 9.0)],
        "symbol string, ex_date date, value double")
    got = ordered(apply_split_adjustment(b, splits), "trade_date")
    assert list(got.adjustment_factor) == [10.0, 10.0, 5.0, 5.0, 1.0]
    assert list(got.close) == [10.0, 10.0, 10.0, 10.0, 10.0]
    assert list(got.volume) == [1e6, 1e6, 5e5, 5e5, 1e5]
    assert list(got.adj_close) == list(got.close)
    assert len(got) == 5


def brute_pivots(high, low, w=5):
    up, down = [], []
    for i in range(len(high)):
        inside = w <= i < len(high) - w
        around = lambda s: s[i - w:i] + s[i + 1:i + 1 + w]
        up.append(bool(inside and all(high[i] > x for x in around(high))))
        down.append(bool(inside and all(low[i] < x for x in around(low))))
    return up, down


def test_pivots_and_zones_against_brute_force(spark):
    closes = walk(300, 3)
    b = bars(spark, closes)
    got = ordered(swing_pivots(b), "trade_date")
    high, low = list(got.high), list(got.low)
    up, down = brute_pivots(high, low)
    assert list(got.swing_high) == up and list(got.swing_low) == down
    levels = latest_swing_levels(b).collect()[0]
    assert levels.last_swing_high == [h for h, u in zip(high, up) if u][-1]
    assert levels.last_swing_low == [x for x, d in zip(low, down) if d][-1]

    high, low = high[-252:], low[-252:]
    up, down = brute_pivots(high, low)

    def clusters(prices):
        groups = []
        for p in sorted(prices):
            if groups and abs(p - np.mean(groups[-1])) / np.mean(groups[-1]) * 100 <= 1.5:
                groups[-1].append(p)
            else:
                groups.append([p])
        return [float(np.mean(g)) for g in groups]

    last = closes[-1]
    row = support_resistance(b).collect()[0]
    above = sorted(z for z in clusters([h for h, u in zip(high, up) if u]) if z > last)[:5]
    below = sorted((z for z in clusters([x for x, d in zip(low, down) if d]) if z < last), reverse=True)[:5]
    np.testing.assert_allclose(row.resistance, above)
    np.testing.assert_allclose(row.support, below)


def test_zones_of_short_history_are_empty(spark):
    row = support_resistance(bars(spark, [1.0, 2.0, 3.0])).collect()[0]
    assert row.support == [] and row.resistance == []


def test_signal_texts_are_made_only_for_who_reads_them(spark):
    """No text is formatted per bar and rule; what is read has the rules' order and texts."""
    df = add_technical_indicators(bars(spark, walk(320)))
    events = signal_events(df)
    unread = plan_text(events.select("symbol", "event_date", "signal"))
    assert "format_string" not in unread
    long = signal_rows(df, active_only=False)
    active = long.where("active").select("trade_date", "signal", "strength", "detail", "confidence")
    got = events.select(F.col("event_date").alias("trade_date"), *active.columns[1:])
    assert got.count() > 0 and got.exceptAll(active).isEmpty() and active.exceptAll(got).isEmpty()
    assert long.count() == 7 * df.count()
