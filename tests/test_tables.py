from __future__ import annotations

import datetime as dt
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.helpers import bars, ordered, plan_text
from tickloom.functions import scalars as sc
from tickloom.operators import fundamentals as fu
from tickloom.operators import quality as ql
from tickloom.operators import strategies as st
from tickloom.operators import upsert as up
from tickloom.operators.flows import institutional_snapshots, result_volatility
from tickloom.operators.scoring import score_stocks
from tickloom.operators.technicals import add_technical_indicators
from tickloom.plans.pipelines import refresh_eod, scan_universe
from tickloom.schemas import DDL, names
from tickloom.session import materialise, shared_dir
from tickloom.sources import readers

D = dt.date
def as_of():
    return F.lit("2020-12-31").cast("date")


def one(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0].v


def test_scalar_edges(spark):
    null = F.lit(None).cast("double")
    assert one(spark, sc.safe_divide(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, sc.scale(null, 0, 1)) is None
    assert one(spark, sc.mean_of([null, F.lit(4.0)])) == 4.0
    assert one(spark, sc.mean_of([null, null])) is None
    assert one(spark, sc.numeric_text(F.lit("(1,234.5)"))) == -1234.5
    assert one(spark, sc.numeric_text(F.lit("Rs. 12 Cr."))) == 12.0
    assert one(spark, sc.numeric_text(F.lit("--"))) is None
    assert one(spark, sc.normalise_symbol(F.lit(" abc "))) == "ABC.NS"
    assert one(spark, sc.normalise_symbol(F.lit("abc.bo"))) == "ABC.BO"
    assert one(spark, sc.fiscal_year(F.lit("2024-03-31").cast("date"))) == 2024
    assert one(spark, sc.fiscal_year(F.lit("2024-04-01").cast("date"))) == 2025
    assert one(spark, sc.fiscal_quarter(F.lit("2024-04-01").cast("date"))) == 1
    assert one(spark, sc.period_end(F.lit(2024), F.lit(3))) == D(2023, 12, 31)
    assert one(spark, sc.json_strings(F.lit("not json"))) == []
    assert one(spark, sc.json_strings(F.lit('["a", "b"]'))) == ["a", "b"]
    assert one(spark, sc.is_financial(F.lit("HDFCBANK.NS"), F.lit(None).cast("string"))) is True
    friday = F.lit("2024-01-05").cast("date")
    assert one(spark, sc.business_days_after(friday, 1)) == D(2024, 1, 8)


def annual(spark):
    rows = [("A", 2018, 100.0, 40.0, 10.0), ("A", 2020, 150.0, -5.0, 10.0), ("A", 2021, 300.0, 9.0, 12.0)]
    df = spark.createDataFrame(rows, "symbol string, fiscal_year int, revenue double, "
                               "net_income double, shares_outstanding double")
    return fu.with_all_amounts(df).withColumn("source", F.lit("x"))


def test_previous_row_and_previous_period_differ(spark):
    g = ordered(fu.annual_growth(annual(spark)), "fiscal_year")
    assert g.revenue_growth.iloc[1] == pytest.approx(0.5)
    c = ordered(fu.multi_year_cagr(annual(spark)), "fiscal_year")
    assert c.revenue_cagr_3y.iloc[2] == pytest.approx(3 ** (1 / 3) - 1)
    assert c.net_income_cagr_3y.iloc[2] == pytest.approx((9 / 40) ** (1 / 3) - 1)
    assert c[["revenue_cagr_3y"]].iloc[1].isna().all()


def test_piotroski_lists_what_is_missing(spark):
    p = ordered(fu.piotroski(annual(spark)), "fiscal_year")
    assert p.piotroski_f_score.iloc[0] != p.piotroski_f_score.iloc[0]
    assert p.piotroski_f_score.iloc[2] == 1.0
    assert "lower_leverage" in list(p.piotroski_missing.iloc[2])
    assert "no_share_dilution" not in list(p.piotroski_missing.iloc[2])


def test_market_cap_as_of(spark):
    prices = bars(spark, [10.0, 11.0], symbol="A", start=D(2021, 3, 20))
    a = annual(spark).withColumns({
        "period_end": F.make_date("fiscal_year", F.lit(3), F.lit(31)), "net_debt": F.lit(5.0),
        "market_cap": F.when(F.col("fiscal_year") == 2018, 7.0)})
    got = ordered(fu.reconstruct_market_cap(a, prices), "fiscal_year")
    assert got.market_cap.iloc[0] == 7.0
    assert got.market_cap.iloc[1:2].isna().all()
    assert (got.market_cap.iloc[2], got.enterprise_value.iloc[2]) == (132.0, 137.0)
    late = fu.reconstruct_market_cap(a, prices, lookback_days=5).where("fiscal_year = 2021")
    assert late.collect()[0].market_cap is None


def test_source_disagreement_uses_upper_median(spark):
    rows = [("A", 2020, s, v) for s, v in (("a", 100.0), ("b", 104.0), ("c", 90.0))]
    df = spark.createDataFrame(rows, "symbol string, fiscal_year int, source string, revenue double")
    row = fu.source_disagreements(df, ["revenue"]).collect()[0]
    assert row.relative_diff == pytest.approx(14 / 100) and row.sources == 3


def test_ohlcv_validation(spark):
    good = bars(spark, [10.0, 10.5, 10.6], symbol="A", start=D(2020, 12, 28))
    jump = bars(spark, [10.0, 20.0], symbol="B", volumes=[0.0, 5.0])
    twice = bars(spark, [10.0], symbol="C").unionByName(bars(spark, [-3.0], symbol="C"))
    gap = bars(spark, [10.0, 10.0], symbol="E").withColumn(
        "close", F.when(F.col("trade_date") == "2020-01-01", F.col("close")))
    symbols = spark.createDataFrame([(s,) for s in "ABCDE"], "symbol string")
    prices = good.unionByName(jump).unionByName(twice).unionByName(gap)
    got = {r.symbol: r for r in ql.validate_ohlcv(prices, as_of(), symbols).collect()}
    assert got["A"].ok and got["A"].warnings == []
    assert got["B"].warnings[0] == "zero_volume_rows: 1"
    assert got["B"].warnings[1].startswith("suspicious_price_moves: 1 day(s) > 40.0%")
    assert got["C"].errors == ["duplicate_index: 1 duplicates"] and got["C"].warnings == []
    assert got["D"].errors == ["dataframe_empty"]
    assert got["E"].errors == ["too_many_missing_close: 50.0% > 5.0%"]


def test_annual_and_quarterly_validation(spark):
    frame = annual(spark).withColumns({
        "sector": F.lit("Banks"), "industry": F.lit(None).cast("string"),
        "total_assets": F.lit(-1.0), "source": F.lit("sample file")})
    row = ql.validate_annual(frame.unionByName(frame.where("fiscal_year = 2018"))).collect()[0]
    assert row.errors == ["duplicate_fiscal_year", "non_positive_total_assets"]
    assert "financial_sector_rules_applied" in row.warnings
    assert row.warnings[-1] == "sample_data_source"
    q = spark.createDataFrame([("A", 2020, 5, None, 1.0), ("A", 2020, 5, None, 1.0), ("B", None, 1, 1.0, 1.0)],
                              "symbol string, fiscal_year int, fiscal_quarter int, revenue double, net_income double")
    got = {r.symbol: r for r in ql.validate_quarterly(q).collect()}
    assert got["A"].errors == ["fiscal_quarter_out_of_range", "duplicate_period"]
    assert got["A"].warnings == ["all_null_revenue"]
    assert got["B"].errors == ["missing_fiscal_period"]


def test_upsert_rules(spark):
    old = spark.createDataFrame([("A", None, 1), ("B", "x", 1)], "k string, seg string, v int")
    new = spark.createDataFrame([("A", None, 2), ("A", None, 3), ("C", "x", 9)], "k string, seg string, v int")
    got = {(r.k, r.seg): r.v for r in up.keep_latest(old, new, ["k", "seg"], ["v"]).collect()}
    assert got == {("A", None): 3, ("B", "x"): 1, ("C", "x"): 9}


def test_write_upsert_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "prices")
    rows = bars(spark, [1.0, 2.0], symbol="A", start=D(2019, 12, 31)).withColumns(
        {"source": F.lit("s"), "trade_year": F.year("trade_date")})
    rows.write.partitionBy("trade_year").parquet(path)
    files = set((tmp_path / "prices" / "trade_year=2019").iterdir())
    fresh = rows.where("trade_year = 2020").select(
        "*", F.explode(F.array(F.lit(1), F.lit(3), F.lit(2))).alias("seq"))
    fresh = fresh.withColumn("close", F.lit(5.0) + F.col("seq"))
    up.write_upsert(spark, path, fresh, up.KEYS["price_daily"], "trade_year", ["seq"])
    got = {r.trade_date: r.close for r in spark.read.parquet(path).collect()}
    assert got == {D(2019, 12, 31): 1.0, D(2020, 1, 1): 8.0}
    assert "seq" not in spark.read.parquet(path).columns
    assert set((tmp_path / "prices" / "trade_year=2019").iterdir()) == files
    plan = plan_text(up.touched_rows(spark, path, "trade_year", [2020]))
    assert "PartitionFilters: [isnotnull(trade_year" in plan and "= 2020" in plan
    held = Path(shared_dir(spark).removeprefix("file:")) / spark.sparkContext.applicationId
    assert not list(held.glob("stage-*"))


def test_nightly_refresh_on_stored_tables(spark, tmp_path):
    """Prices, snapshots, scores and the run are stored; a second run changes nothing."""
    closes = [100 + (i % 7) + i * 0.1 for i in range(60)]
    old = bars(spark, closes[:50]).unionByName(bars(spark, closes[:50], symbol="Y.NS"))
    new = bars(spark, closes).unionByName(bars(spark, [-c for c in closes], symbol="Y.NS"))
    old, new = (d.withColumn("source", F.lit("s")) for d in (old, new))
    up.store_by_year(spark, f"{tmp_path}/price_daily", old, up.KEYS["price_daily"], "trade_date", ())
    universe = spark.createDataFrame([("X.NS",), ("Y.NS",)], "symbol string")
    splits = spark.createDataFrame([], "symbol string, ex_date date, value double")

    def night(run):
        stored = spark.read.parquet(f"{tmp_path}/price_daily").drop("trade_date_year")
        done = refresh_eod(stored, new, universe, splits, F.lit(D(2020, 2, 29)), run_id=run, order=(),
                           write_root=str(tmp_path))
        parts = (done.prices, done.snapshots, done.scores)
        # The second night goes on from the first one's state: equal but for the last bits.
        rows = [[tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect()] for d in parts]
        return [sorted(map(str, r)) for r in rows], done.run.count()

    first, runs = night("one")
    assert [len(rows) for rows in first] == [110, 22, 2] and runs == 1
    again, runs = night("two")
    assert again == first and runs == 2


def test_institutional_trend_needs_history(spark):
    rows = [(D(2020, 1, 1) + dt.timedelta(days=i), "FII", 10.0) for i in range(20)]
    rows += [(D(2020, 1, 1) + dt.timedelta(days=i), "DII", -1.0) for i in range(19)]
    f = spark.createDataFrame(rows, "trade_date date, participant string, net_value_cr double")
    got = {r.participant: r for r in institutional_snapshots(f).collect()}
    assert got["FII"].trend == "bullish" and got["FII"].rolling_20d_net_cr == 200.0
    assert got["DII"].trend == "unknown" and got["DII"].rolling_5d_net_cr == -5.0


def test_result_volatility_ignores_events_outside_the_range(spark):
    b = bars(spark, [100.0] * 60)
    e = spark.createDataFrame([("X.NS", D(2020, 1, 15)), ("X.NS", D(2022, 1, 1))], "symbol string, event_date date")
    row = result_volatility(b, e).collect()[0]
    assert row.events_found == 1 and row.volatility_multiple == 1.0
    none = result_volatility(b, e.where("event_date > '2021-01-01'")).collect()[0]
    assert none.event_atr is None and none.events_found == 0


def test_bank_score(spark):
    df = spark.createDataFrame([("HDFCBANK.NS",), ("ACME.NS",)], "symbol string").withColumns({
        "piotroski_f_score": F.lit(9.0), "has_fundamentals": F.lit(True), "has_banking": F.lit(True),
        "nim_pct": F.lit(5.0), "gnpa_pct": F.lit(0.0), "nnpa_pct": F.lit(0.0), "casa_pct": F.lit(50.0),
        "capital_adequacy_pct": F.lit(22.0), "credit_growth_pct": F.lit(10.0),
        "deposit_growth_pct": F.lit(10.0), "altman_z_score": F.lit(1.0)})
    got = {r.symbol: r for r in score_stocks(df).collect()}
    bank = got["HDFCBANK.NS"]
    assert bank.fundamentals_score == pytest.approx((100 + 2 * (550 / 6)) / 3, abs=0.06)
    assert "A good interest margin of 5.00%." in bank.reasons
    assert "Low Altman Z-Score (1.00): a weak balance sheet." in got["ACME.NS"].risks
    assert "RSI" in bank.missing_data and bank.missing_data == sorted(bank.missing_data)


def test_scan_reports_short_history(spark):
    b = bars(spark, [100.0 + i for i in range(260)]).unionByName(bars(spark, [1.0], symbol="SHORT.NS"))
    symbols = spark.createDataFrame([("X.NS",), ("SHORT.NS",), ("NONE.NS",)], "symbol string")
    got = {r.symbol: r for r in scan_universe(b, symbols, F.lit("2020-09-16").cast("date")).collect()}
    assert got["X.NS"].error is None and "MA Stack" in got["X.NS"].active_signals
    assert got["SHORT.NS"].error == got["NONE.NS"].error == "insufficient price history"
    assert got["SHORT.NS"].composite_score is None


def strategy_names(spark, closes, **kw):
    df = add_technical_indicators(bars(spark, closes, **kw)).where("bar_number = bar_count").withColumns({
        "data_source": F.lit("kite"), "data_warnings": F.array().cast("array<string>"),
        "company_name": F.lit("n"), "sector": F.lit("s"), "market_cap_bucket": F.lit("b")})
    return {r.strategy: r for r in st.evaluate_strategies(df, F.col("trade_date")).collect()}


def test_strategy_breakout_needs_volume_and_small_extension(spark):
    closes = [100 + 0.3 * i for i in range(259)]
    volumes = [1e6] * 259 + [2.5e6]
    top = closes[-1] + 1
    got = strategy_names(spark, closes + [top * 1.02], volumes=volumes)
    hit = got["Breakout With Relative Volume"]
    assert hit.breakout_level == pytest.approx(top, abs=0.01) and "52-week high" in hit.why_this_appeared
    assert "52W / 120D High Breakout" in got and "EMA Stack Trend Filter" in got
    far = strategy_names(spark, closes + [top * 1.2], volumes=volumes)
    assert "Breakout With Relative Volume" not in far
    assert strategy_names(spark, closes[:139]) == {}


def test_csv_and_json_readers(spark, tmp_path):
    (tmp_path / "annual.csv").write_text(
        " symbol ,fiscal_year,revenue,source\naaa.ns,2020,10,s\nbbb.ns,oops,1,s\nccc.ns,2021.0,,s\n")
    got = {r.symbol: r for r in readers.annual_csv(spark, str(tmp_path / "annual.csv")).collect()}
    assert set(got) == {"aaa.ns", "ccc.ns"} and got["aaa.ns"].revenue == 10.0
    assert got["ccc.ns"].revenue is None and got["ccc.ns"].fiscal_year == 2021
    assert readers.annual_csv(spark, str(tmp_path / "annual.csv"), "AAA.NS").count() == 1

    (tmp_path / "bank.csv").write_text("symbol,fiscal_year,nim_pct\nB.NS,2020,3.5\n")
    bank = readers.banking_csv(spark, str(tmp_path / "bank.csv")).collect()[0]
    assert bank.nim_pct == 3.5 and bank.casa_pct is None

    (tmp_path / "uni.csv").write_text("﻿SYMBOL, SERIES\nabc,EQ\nabc,EQ\nxyz,BE\n q.bo ,eq\n")
    got = {r.symbol for r in readers.universe_csv(spark, str(tmp_path / "uni.csv")).collect()}
    assert got == {"ABC.NS", "Q.BO"}

    head = "Company Name,Industry,Symbol,Series,ISIN Code\n"
    snaps = tmp_path / "snaps"
    snaps.mkdir()
    (snaps / "idx_2020-01-31.csv").write_text(head + "A Ltd,I,a,EQ,1\nA2,I,A,EQ,2\nB,I,b,BE,3\n")
    (snaps / "idx20200229.csv").write_text(head + "C,I,c,EQ,4\n")
    (snaps / "readme.csv").write_text(head + "Z,I,z,EQ,4\n")
    got = {(r.symbol, r.snapshot_date, r.name) for r in readers.dated_snapshots(spark, str(snaps)).collect()}
    assert got == {("A.NS", D(2020, 1, 31), "A Ltd"), ("C.NS", D(2020, 2, 29), "C")}
    (tmp_path / "bad.csv").write_text("Symbol\nx\n")
    with pytest.raises(ValueError):
        readers.constituents_csv(spark, str(tmp_path / "bad.csv"))

    days = tmp_path / "days"
    days.mkdir()
    cols = "SYMBOL, SERIES, DATE1, TTL_TRD_QNTY, TURNOVER_LACS, DELIV_QTY, DELIV_PER\n"
    (days / "d1.csv").write_text(cols + 'abc, EQ, 02-Jan-2020, "1,000", 5.5, 400, 40.0\nabc, BE, 02-Jan-2020, 1,1,1,1\n')
    (days / "d2.csv").write_text(cols + "abc, EQ, 02-Jan-2020, 2000, 6, -, 55\nabc, EQ, bad, 1, 1, 1, 1\n")
    row = readers.delivery_files(spark, str(days)).collect()
    assert len(row) == 1 and row[0].delivery_pct == 55.0 and row[0].deliverable_qty is None


def test_flow_payload_categories(spark):
    text = ('{"data": [{"category": "FII/FPI Investment *", "date": "02-Jan-2020", "netValue": "-1,000.5"},'
            '{"category": "Mutual Fund", "date": "02-Jan-2020", "netValue": "1"},'
            '{"category": "DII", "date": "2020-01-03", "netValue": "2"},'
            '{"category": "DII", "date": "03/01/2020", "netValue": "3"}]}')
    df = spark.createDataFrame([(text,), ("[]",)], "payload string")
    got = {(r.participant, r.trade_date): r.net_value_cr for r in readers.flows_json(df).collect()}
    assert got == {("FII", D(2020, 1, 2)): -1000.5, ("DII", D(2020, 1, 3)): 3.0}


def test_snapshot_files_and_csv_export(spark, tmp_path):
    df = spark.createDataFrame([("A", ["x", "y"])], "symbol string, tags array<string>")
    readers.write_snapshot(df, str(tmp_path / "s"), "20200101")
    readers.write_snapshot(df.withColumn("symbol", F.lit("B")), str(tmp_path / "s"), "20200102")
    assert [r.symbol for r in readers.latest_snapshot(spark, str(tmp_path / "s")).collect()] == ["B"]
    readers.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).collect()[0].tags == "x; y"


def test_schemas_are_valid(spark):
    assert len(DDL) == 19
    for table in DDL:
        assert spark.createDataFrame([], DDL[table]).columns == names(table)
        assert set(up.KEYS.get(table, ())) <= set(names(table))


def test_stored_tables_leave_no_shuffle_files(spark):
    """Disk holds the shuffles of one step of a job, not those of all steps before it."""
    def files():
        held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(held.size()) if (name := held.apply(i).getName()).startswith("shuffle_")}

    before = files()
    rows = materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert rows.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
