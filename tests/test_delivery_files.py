"""Delivery files: one pass over the rows, names of files read once per file."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tests.helpers import plan_text
from tickloom.functions import scalars as sc
from tickloom.sources import readers

D = dt.date
HEAD = "SYMBOL, SERIES, DATE1, TTL_TRD_QNTY, DELIV_QTY, DELIV_PER, TURNOVER_LACS\n"


def test_newest_file_and_first_row_win_without_sorting_rows(spark, tmp_path):
    days = tmp_path / "a b%20"
    (days / "list=sec_20200103").mkdir(parents=True)
    (days / "sec_20200102 x%.csv").write_text(
        HEAD + 'abc, EQ, 02-Jan-2020,"1,000", (5), 40, Rs. 2\nabc, BE, 02-Jan-2020,9,9,9,9\nold, eq, -, 3,3,3,3\n')
    (days / "list=sec_20200103" / "part-0.csv").write_text(
        "TURNOVER_LACS,DELIV_PER,DELIV_QTY,TTL_TRD_QNTY,DATE1,SERIES,SYMBOL\n"
        "7,55,-,2000,2020-01-02,EQ,ABC\n8,56,1,1,02/01/2020,EQ,abc\n1,1,1,1,3-Jan-2020,EQ,new\n")
    (days / "undated.csv").write_text(HEAD + "abc, EQ, -, 1, 1, 1, 1\n")
    found = readers.delivery_files(spark, str(days))
    plan = plan_text(found)
    assert "Window" not in plan
    assert "Sort" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
    rows = {(r.symbol, r.trade_date): tuple(r)[2:] for r in found.collect()}
    assert rows == {
        ("OLD.NS", D(2020, 1, 2)): (3.0, 3.0, 3.0, 3.0),
        ("NEW.NS", D(2020, 1, 3)): (1.0, 1.0, 1.0, 1.0),
        ("ABC.NS", D(2020, 1, 2)): (2000.0, None, 55.0, 7.0),
    }
    alone = readers.delivery_files(spark, str(days / "sec_20200102 x%.csv")).where("symbol = 'ABC.NS'")
    assert tuple(alone.collect()[0]) == ("ABC.NS", D(2020, 1, 2), 1000.0, -5.0, 40.0, 2.0)


def test_shapes_of_dates_change_no_date(spark):
    texts = [
        "02-Jan-2020", "02-jan-2020", "2-Jan-2020", "02-Jan-20", "02-01-2020", "02/01/2020", "2020-01-02",
        "2020-1-2", "02-January-2020", "-", "", "32-Jan-2020", "2020-01-02 ", "2020-02-30", "+12020-01-02", None,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for formats in (readers.DAY_FIRST, readers.DAY_FORMATS, ("dd-MMM-yyyy HH", "d MMM yy")):
        tried = F.coalesce(*[F.try_to_timestamp("t", F.lit(f)).cast("date") for f in formats])
        same = sc.parse_day("t", formats).eqNullSafe(tried)
        assert [r.t for r in df.where(~same).collect()] == []


def test_bare_numbers_are_what_the_search_for_marks_gives(spark):
    texts = ["1,234.5", "12", "-1", "+1.", "--", ".", "", "1-2", "(1,2)", "5%", "₹ 7", "1e3", " 8 ", "1,2 cr", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.n for r in df.select(sc.numeric_text("t").alias("n")).collect()]
    assert got == [1234.5, 12.0, -1.0, 1.0, None, None, None, None, -12.0, 5.0, 7.0, 1000.0, 8.0, 12.0, None]
