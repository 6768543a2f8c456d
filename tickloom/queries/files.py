"""File scans: derived rows written as the files that users and exchanges send, scanned back.

The calendar part counts snapshot dates (k) over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.bridge import Tables, supplier_symbol
from tickloom.operators.membership import periods_from_snapshots
from tickloom.plans.imports import import_membership_history
from tickloom.queries.registry import query
from tickloom.queries.sqlbase import sql
from tickloom.queries.state import membership_snapshots
from tickloom.session import shared_path
from tickloom.sources import readers


def write_lists(rows: DataFrame, folder: str, *order: str) -> None:
    """One folder per value of ``list``, all in one job; the rows of a list in order."""
    write_dealt(rows.repartition("list"), folder, *order)


def write_dealt(rows: DataFrame, folder: str, *order: str) -> None:
    """The same of rows that lie in one partition with their list."""
    (
        rows.sortWithinPartitions("list", *order).drop(*[c for c in order if c.startswith("_")])
        .write.mode("append").partitionBy("list").option("header", True).csv(folder)
    )


@query("banking_csv_scan", "S7", sql("""
SELECT 'S' || s_suppkey || '.NS' AS symbol, 2000 + s_suppkey % 3 AS fiscal_year,
       round(s_acctbal / 1000, 2) AS nim_pct,
       CASE WHEN s_suppkey % 2 = 0 THEN round(s_acctbal / 500, 2) END AS gnpa_pct,
       CAST(NULL AS DOUBLE) AS casa_pct, 'user' AS source
FROM supplier WHERE s_suppkey % 5 <> 0
"""), "nim_pct gnpa_pct")
def banking_csv_scan(t: Tables) -> DataFrame:
    """Two files with columns in another order, absent ones and years that are none."""
    s = t.read("supplier")
    year = F.when(F.col("s_suppkey") % 5 == 0, F.lit("n.a.")).otherwise(
        F.concat((2000 + F.col("s_suppkey") % 3).cast("string"), F.lit(".0"))
    )
    rows = s.select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit(".NS")).alias("symbol"),
        year.alias("fiscal_year"), F.round(F.col("s_acctbal") / 1000, 2).alias("nim_pct"),
        F.round(F.col("s_acctbal") / 500, 2).alias("gnpa_pct"), F.lit("user").alias("source"),
        "s_suppkey",
    )
    folder = shared_path(t.spark, "banks")
    even = F.col("s_suppkey") % 2 == 0
    for k, (part, columns) in enumerate((
        (rows.where(even), ("gnpa_pct", "source", "symbol", "nim_pct", "fiscal_year")),
        (rows.where(~even), ("symbol", "fiscal_year", "nim_pct", "source")),
    )):
        part.select(*columns).write.option("header", True).csv(f"{folder}/{k}")
    return readers.banking_csv(t.spark, [f"{folder}/0", f"{folder}/1"]).select(
        "symbol", "fiscal_year", "nim_pct", "gnpa_pct", "casa_pct", "source"
    )


@query("universe_csv_scan", "S8 E1", sql("""
SELECT 'S' || s_suppkey || '.NS' AS symbol FROM supplier WHERE s_suppkey % 3 <> 0
"""))
def universe_csv_scan(t: Tables) -> DataFrame:
    """A listing with a byte-order mark, blanks, other series and repeated symbols."""
    s = t.read("supplier")
    name = F.concat(F.lit(" s"), F.col("s_suppkey").cast("string"), F.lit(" "))
    series = F.when(F.col("s_suppkey") % 3 == 0, F.lit("BE")).otherwise(F.lit(" eq"))
    rows = s.select(name.alias("﻿SYMBOL"), F.col("s_name").alias(" NAME"), series.alias(" SERIES"))
    path = shared_path(t.spark, "listing")
    rows.unionByName(rows).write.option("header", True).csv(path)
    return readers.universe_csv(t.spark, path)


def constituents(t: Tables) -> DataFrame:
    """A constituent list per nation."""
    s = t.read("supplier").join(t.read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(
        F.col("s_name").alias("Company Name"), F.col("n_name").alias(" Industry"),
        F.concat(F.lit(" s"), F.col("s_suppkey").cast("string")).alias("Symbol"),
        F.when(F.col("s_suppkey") % 4 == 0, F.lit("BE")).otherwise(F.lit("EQ")).alias("Series"),
        F.concat(F.lit("IN"), F.col("s_suppkey").cast("string")).alias("ISIN Code"),
        F.col("s_suppkey").alias("_key"), F.concat(F.lit("index_"), F.col("n_nationkey").cast("string")).alias("list"),
    )


@query("index_constituents_scan", "S9", sql("""
SELECT 'S' || s_suppkey || '.NS' AS symbol, s_name AS name, n_name AS industry,
       'IN' || s_suppkey AS isin, 'index_' || n_nationkey AS file_name
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 4 <> 0
"""))
def index_constituents_scan(t: Tables) -> DataFrame:
    """Constituent lists with other series and later rows that repeat a symbol."""
    rows = constituents(t).withColumn("_again", F.lit(0))
    later = rows.withColumns({"Company Name": F.lit("Later"), "_again": F.lit(1)})
    folder = shared_path(t.spark, "constituents")
    write_lists(rows.unionByName(later), folder, "_again", "_key")
    return readers.constituents_csv(t.spark, folder)


def dated_lists(t: Tables, folder: str) -> None:
    """A list per snapshot date, told by its name in two styles, and one without a date. Lists of
    an October lack names, those of a July industries."""
    s = t.read("supplier").join(t.read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        supplier_symbol("s_suppkey").alias("symbol"), "s_name", "n_name", "s_suppkey"
    )
    snaps = membership_snapshots(t).select("symbol", "snapshot_date").distinct().join(s, "symbol")
    month = F.month("snapshot_date")
    style = F.when(month.isin(1, 7), F.date_format("snapshot_date", "yyyyMMdd")).otherwise(
        F.date_format("snapshot_date", "yyyy-MM-dd")
    )
    rows = snaps.select(
        F.when(month != 10, F.col("s_name")).alias("Company Name"),
        F.when(month != 7, F.col("n_name")).alias("Industry"),
        F.regexp_replace("symbol", r"\.NS$", "").alias("Symbol"), F.lit("EQ").alias("Series"),
        F.concat(F.lit("IN"), F.col("s_suppkey").cast("string")).alias("ISIN Code"),
        F.concat(F.lit("index_"), style).alias("list"),
    )
    write_lists(rows.unionByName(rows.withColumn("list", F.lit("index_latest"))), folder, "Symbol")


@query("dated_constituents_scan", "S10 U13", sql("SELECT DISTINCT symbol, snapshot_date FROM snapshots"))
def dated_constituents_scan(t: Tables) -> DataFrame:
    folder = shared_path(t.spark, "dated")
    dated_lists(t, folder)
    return readers.dated_snapshots(t.spark, folder).select("symbol", "snapshot_date")


@query("membership_replay", "U13 L13 S10 W14", sql("""
SELECT symbol, from_date, to_date, to_date IS NULL AS active, name, industry, isin FROM (
  SELECT symbol, min(snapshot_date) AS from_date,
         (SELECT min(snapshot_date) - 1 FROM calendar WHERE snapshot_date > max(r.snapshot_date)) AS to_date,
         arg_max(s_name, snapshot_date) FILTER (month(snapshot_date) <> 10) AS name,
         arg_max(n_name, snapshot_date) FILTER (month(snapshot_date) <> 7) AS industry,
         'IN' || any_value(s_suppkey) AS isin
  FROM (SELECT s.symbol, s.snapshot_date, k - row_number() OVER (PARTITION BY s.symbol ORDER BY s.snapshot_date) AS island
        FROM (SELECT DISTINCT symbol, snapshot_date FROM snapshots) AS s
        JOIN calendar USING (snapshot_date)) AS r
  JOIN supplier ON 'S' || s_suppkey || '.NS' = symbol JOIN nation ON n_nationkey = s_nationkey
  GROUP BY symbol, island) AS p
"""))
def membership_replay(t: Tables) -> DataFrame:
    """Lists of all dates to periods with name, industry and ISIN, in place of the periods that were there."""
    folder, root = shared_path(t.spark, "dated"), shared_path(t.spark, "members")
    dated_lists(t, folder)
    found = readers.dated_snapshots(t.spark, folder)
    before = periods_from_snapshots(found.where(F.col("symbol") > "S5"), "large", "files", ("name",))
    before.write.parquet(f"{root}/index_membership_history")
    done = import_membership_history(found, root, "large", "files", replace_existing=True)
    return done.select("symbol", "from_date", "to_date", "active", "name", "industry", "isin")


@query("delivery_file_scan", "S11", sql("""
SELECT symbol, trade_date, volume AS traded_qty, round(volume * 0.4, 0) AS deliverable_qty,
       40.25::DOUBLE + volume % 13 AS delivery_pct, round(volume / 7, 2) AS turnover_lacs FROM bars
"""), "traded_qty deliverable_qty delivery_pct turnover_lacs")
def delivery_file_scan(t: Tables) -> DataFrame:
    """A file for each day: two column orders, comma numbers, other series, repeated symbols, and
    dates that cannot be read."""
    bad = F.crc32(F.col("symbol").cast("binary")) % 5 == 0
    texts = {
        "SYMBOL": F.regexp_replace("symbol", r"\.NS$", " "),
        " DATE1": F.when(bad, F.lit("-")).otherwise(F.date_format("trade_date", "dd-MMM-yyyy")),
        " TTL_TRD_QNTY": F.format_number("volume", 0),
        " DELIV_QTY": F.format_number(F.round(F.col("volume") * 0.4, 0), 0),
        " DELIV_PER": F.format_number(40.25 + F.col("volume") % 13, 2),
        " TURNOVER_LACS": F.format_number(F.round(F.col("volume") / 7, 2), 2),
        "list": F.concat(F.lit("sec_"), F.date_format("trade_date", "yyyyMMdd")),
    }
    folder = shared_path(t.spark, "delivery")
    even = F.dayofmonth("trade_date") % 2 == 0
    columns = ["SYMBOL", " SERIES", *list(texts)[1:]]
    for name, of_day, names in (("even", even, columns), ("odd", ~even, columns[::-1])):
        # Bars are dealt by day; their texts and the second series are made where they are written.
        days = t.bars.where(of_day).select("symbol", "trade_date", "volume").repartition("trade_date")
        rows = days.select(*[value.alias(c) for c, value in texts.items()])
        both = rows.withColumn(" SERIES", F.explode(F.array(F.lit(" EQ"), F.lit("BE"))))
        write_dealt(both.select(*names), f"{folder}/{name}", "SYMBOL")
    return readers.delivery_files(t.spark, [f"{folder}/even", f"{folder}/odd"])


@query("instrument_snapshot", "S15", sql("""
SELECT 'S' || s_suppkey || '.NS' AS symbol, s_name AS name FROM supplier WHERE s_suppkey % 2 = 1
"""))
def instrument_snapshot(t: Tables) -> DataFrame:
    """Two dated copies of a master list; the newer one is read."""
    rows = t.read("supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit(".NS")).alias("symbol"),
        F.col("s_name").alias("name"), "s_suppkey",
    )
    root = shared_path(t.spark, "instruments")
    readers.write_snapshot(rows.where("s_suppkey % 2 = 1").drop("s_suppkey"), root, "20240102T0900")
    readers.write_snapshot(rows.drop("s_suppkey"), root, "20240101T0900")
    return readers.latest_snapshot(t.spark, root).select("symbol", "name")
