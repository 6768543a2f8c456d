"""Upserts, membership sync, saved scans and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.bridge import Tables, supplier_symbol
from tickloom.operators import membership as mb
from tickloom.operators import scans
from tickloom.operators import upsert as up
from tickloom.operators.quality import validate_ohlcv
from tickloom.plans.imports import lookup_tokens
from tickloom.plans.pipelines import last_bars_at, scan_universe
from tickloom.queries.backtests import INDEX, membership, membership_snapshots
from tickloom.queries.registry import query
from tickloom.queries.sqlbase import part, sql
from tickloom.session import materialise, shared_path


def day(text: str) -> Column:
    return F.lit(text).cast("date")


# --- prices ---------------------------------------------------------------------

def stored_and_incoming(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Stored bars to 2000; a batch from December on, with revised closes, incomplete
    rows and days sent twice."""
    prices = t.bars_two_source
    stored = prices.where(F.col("trade_date") <= day("2000-12-31"))
    late = prices.where(F.col("trade_date") >= day("2000-12-01"))
    broken = F.when(F.col("volume") > 45, F.lit(None).cast("double")).otherwise(F.col("open"))
    quiet = F.when(F.col("volume") < 5, F.lit(None).cast("double")).otherwise(F.col("volume"))
    first = late.withColumns(
        {"close": F.col("close") * 2, "open": broken, "volume": quiet, "seq": F.lit(1)}
    )
    again = late.where(F.dayofmonth("trade_date") == 10).withColumns(
        {"close": F.col("close") * 3, "seq": F.lit(2)}
    )
    return stored, first.unionByName(again)


part("batch", """
SELECT symbol, trade_date, source, CASE WHEN volume > 45 THEN NULL ELSE open END AS open,
       close * 2 AS close, CASE WHEN volume < 5 THEN NULL ELSE volume END AS volume, 1 AS seq
FROM bars2 WHERE trade_date >= DATE '2000-12-01'
UNION ALL
SELECT symbol, trade_date, source, open, close * 3, volume, 2
FROM bars2 WHERE trade_date >= DATE '2000-12-01' AND day(trade_date) = 10
""")
part("accepted", """
SELECT symbol, trade_date, source, open, close, coalesce(volume, 0) AS volume, seq
FROM batch WHERE open IS NOT NULL
""")
part("stored", """
SELECT symbol, trade_date, source, open, close, volume, 0 AS seq
FROM bars2 WHERE trade_date <= DATE '2000-12-31'
""")


@query("price_upsert", "U1", sql("""
SELECT symbol, trade_date, source, arg_max(close, seq) AS close, arg_max(volume, seq) AS volume
FROM (SELECT * FROM stored UNION ALL SELECT * FROM accepted) GROUP BY 1, 2, 3
"""))
def price_upsert(t: Tables) -> DataFrame:
    stored, incoming = stored_and_incoming(t)
    return up.upsert_prices(stored, incoming, ["seq"]).select(
        "symbol", "trade_date", "source", "close", "volume"
    )


@query("price_upsert_counts", "U1 U14", sql("""
SELECT count(*) FILTER (NOT old AND new) AS inserted, count(*) FILTER (old AND new) AS updated,
       (SELECT count(*) FROM batch) - (SELECT count(*) FROM accepted) AS skipped
FROM (SELECT symbol, trade_date, source, bool_or(seq = 0) AS old, bool_or(seq > 0) AS new
      FROM (SELECT * FROM stored UNION ALL SELECT * FROM accepted) GROUP BY 1, 2, 3)
"""))
def price_upsert_counts(t: Tables) -> DataFrame:
    stored, incoming = stored_and_incoming(t)
    return up.change_counts(
        stored, up.clean_prices(incoming), incoming, up.KEYS["price_daily"]
    )


@query("incremental_windows", "U15", sql("""
SELECT u.symbol, coalesce(latest - 5, DATE '2001-06-30' - 1825) AS start_date,
       DATE '2001-06-30' AS end_date,
       coalesce(latest - 5, DATE '2001-06-30' - 1825) > DATE '2001-06-30' AS skip
FROM universe AS u LEFT JOIN (
  SELECT symbol, max(trade_date) AS latest FROM bars WHERE volume > 40 GROUP BY symbol) AS l
  ON l.symbol = u.symbol
"""))
def incremental_windows(t: Tables) -> DataFrame:
    stored = t.bars.where(F.col("volume") > 40)
    return up.incremental_bounds(t.universe, stored, day("2001-06-30")).select(
        "symbol", "start_date", "end_date", "skip"
    )


@query("source_failover", "U16", sql("""
SELECT symbol, trade_date, close, CASE WHEN bad THEN 'kite invalid' ELSE '' END AS fallback_reason
FROM bars2 JOIN (SELECT symbol, bool_or(source = 'kite' AND close < 60) AS bad FROM bars2
                 GROUP BY symbol) USING (symbol)
WHERE source = CASE WHEN bad THEN 'yfinance' ELSE 'kite' END
"""))
def source_failover(t: Tables) -> DataFrame:
    """Symbols whose first source has an implausible price use the second one."""
    prices = t.bars_two_source
    first = prices.where(F.col("source") == "kite")
    second = prices.where(F.col("source") == "yfinance")
    suspicious = first.withColumn(
        "close", F.when(F.col("close") < 60, -F.col("close")).otherwise(F.col("close"))
    )
    report = validate_ohlcv(suspicious, t.as_of, t.universe)
    out = up.with_failover(first, report, second, "kite invalid")
    return out.select("symbol", "trade_date", "close", "fallback_reason")


# --- other tables -----------------------------------------------------------------

@query("quarterly_upsert", "U3", sql("""
SELECT symbol, fiscal_year, fiscal_quarter, CASE WHEN fiscal_year >= 2000 THEN revenue * 2
       ELSE revenue END AS revenue FROM quarterly
"""), "revenue")
def quarterly_upsert(t: Tables) -> DataFrame:
    stored = t.quarterly.select(
        "symbol", "fiscal_year", "fiscal_quarter", "source", "revenue"
    )
    fresh = stored.where(F.col("fiscal_year") >= 2000).withColumn("revenue", F.col("revenue") * 2)
    stray = fresh.withColumn("fiscal_quarter", F.lit(7))
    out = up.keep_latest(
        stored, up.clean_quarters(fresh.unionByName(stray)), up.KEYS["fundamentals_quarterly"]
    )
    return out.select("symbol", "fiscal_year", "fiscal_quarter", "revenue")


@query("corporate_actions_upsert", "U4 S3", sql("""
SELECT symbol, ex_date, action_type, CASE WHEN value = 5 THEN 10::DOUBLE ELSE value END AS value
FROM splits
"""))
def corporate_actions_upsert(t: Tables) -> DataFrame:
    from tickloom.sources.readers import corporate_actions

    revised = t.splits.where(F.col("value") == 5).withColumn("value", F.lit(10.0))
    empty = t.splits.withColumn("value", F.lit(None).cast("double"))
    out = up.keep_latest(
        t.splits, up.clean_actions(revised.unionByName(empty)), up.KEYS["corporate_actions"]
    )
    return corporate_actions(out, action_type="split")


@query("market_flows_upsert", "U5 S4", sql("""
SELECT trade_date, participant, CASE WHEN year(trade_date) >= 1998 THEN net_value_cr * 2
       ELSE net_value_cr END AS net_value_cr FROM flows WHERE participant = 'FII'
"""), "net_value_cr", 9)
def market_flows_upsert(t: Tables) -> DataFrame:
    from tickloom.sources.readers import market_flows

    stored = t.market_flows.withColumn("source", F.lit("nse"))
    fresh = stored.where(F.year("trade_date") >= 1998).withColumns(
        {"participant": F.lower("participant"), "net_value_cr": F.col("net_value_cr") * 2}
    )
    stray = fresh.withColumn("participant", F.lit(None).cast("string"))
    out = up.keep_latest(
        stored, up.clean_flows(fresh.unionByName(stray)), up.KEYS["market_flows_daily"]
    )
    return market_flows(out, participant="fii").select("trade_date", "participant", "net_value_cr")


def instruments(t: Tables) -> DataFrame:
    """One instrument per part; some without a segment."""
    p = t.read("part")
    segment = F.when(F.col("p_size") % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit("CM"))
    return p.select(
        F.when(F.col("p_size") <= 25, F.lit("NSE")).otherwise(F.lit("BSE")).alias("exchange"),
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("tradingsymbol"),
        segment.alias("segment"), F.col("p_type").alias("instrument_type"),
        F.col("p_partkey").alias("instrument_token"), F.lit(1).alias("lot_size"),
    )


part("instruments", """
SELECT CASE WHEN p_size <= 25 THEN 'NSE' ELSE 'BSE' END AS exchange,
       'P' || p_partkey AS tradingsymbol, CASE WHEN p_size % 3 <> 0 THEN 'CM' END AS segment,
       p_type AS instrument_type, p_partkey AS instrument_token, p_size FROM part
""")


@query("instrument_upsert", "U6", sql("""
SELECT exchange, tradingsymbol, segment, CASE WHEN p_size >= 20 THEN 50 ELSE 1 END::BIGINT
       AS lot_size FROM instruments
"""))
def instrument_upsert(t: Tables) -> DataFrame:
    """Key parts that are missing on both sides match each other."""
    stored = instruments(t)
    size = t.read("part").where(F.col("p_size") >= 20).select(
        F.col("p_partkey").alias("instrument_token")
    )
    fresh = stored.join(size, "instrument_token", "left_semi").withColumn("lot_size", F.lit(50))
    return up.keep_latest(stored, fresh, up.KEYS["instrument_master"]).select(
        "exchange", "tradingsymbol", "segment", "lot_size"
    )


@query("instrument_token_lookup", "J11", sql("""
SELECT w.order_key, w.line_number, w.tradingsymbol, w.exchange, min(i.instrument_token) AS instrument_token
FROM (SELECT row_number() OVER () AS r, l_orderkey AS order_key, CAST(l_linenumber AS BIGINT) AS line_number,
             'P' || (l_partkey + CASE WHEN l_linenumber = 5 THEN 1000000000 ELSE 0 END) AS tradingsymbol,
             CASE l_returnflag WHEN 'R' THEN 'BSE' WHEN 'A' THEN 'NSE' END AS exchange,
             CASE l_linenumber WHEN 1 THEN 'CM' WHEN 2 THEN '' END AS segment FROM lineitem) AS w
LEFT JOIN (SELECT * FROM instruments
           UNION ALL SELECT exchange, tradingsymbol, 'FO', 'FUT', instrument_token + 500000000, p_size
                     FROM instruments WHERE p_size % 2 = 0) AS i
  ON i.tradingsymbol = w.tradingsymbol AND i.exchange = coalesce(w.exchange, 'NSE')
  AND (w.segment IS NULL OR i.segment IS NOT DISTINCT FROM nullif(w.segment, ''))
GROUP BY w.r, 1, 2, 3, 4
"""))
def instrument_token_lookup(t: Tables) -> DataFrame:
    """Trades look for their token: exchange and segment may be absent, some symbols are not listed,
    some are listed with a future beside the share."""
    known = instruments(t)
    even = t.read("part").where(F.col("p_size") % 2 == 0).select(F.col("p_partkey").alias("instrument_token"))
    futures = known.join(even, "instrument_token").withColumns({
        "segment": F.lit("FO"), "instrument_type": F.lit("FUT"),
        "instrument_token": F.col("instrument_token") + 500_000_000,
    })
    number, flag = F.col("l_linenumber"), F.col("l_returnflag")
    part = F.col("l_partkey") + F.when(number == 5, 1_000_000_000).otherwise(0)
    wanted = t.read("lineitem").select(
        F.col("l_orderkey").alias("order_key"), number.alias("line_number"),
        F.concat(F.lit("P"), part.cast("string")).alias("tradingsymbol"),
        F.when(flag == "R", F.lit("BSE")).when(flag == "A", F.lit("NSE")).alias("exchange"),
        F.when(number == 1, F.lit("CM")).when(number == 2, F.lit("")).alias("segment"),
        F.lit(None).cast("string").alias("instrument_type"),
    )
    return lookup_tokens(wanted, known.unionByName(futures)).select(
        "order_key", "line_number", "tradingsymbol", "exchange", "instrument_token"
    )


# --- audits and watchlist -----------------------------------------------------------

def audits(t: Tables) -> DataFrame:
    """An observation per (symbol, ship day, flag), repeated per line item."""
    return t.lines.select(
        "symbol", F.col("trade_date").alias("as_of_date"),
        F.col("l_returnflag").alias("signal_name"), F.lit("audit").alias("source"),
        "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_linenumber").alias("scan_count"), F.col("px").alias("close"),
    )


@query("audit_collapse", "U9", sql("""
SELECT symbol, trade_date AS as_of_date, l_returnflag AS signal_name,
       CAST(sum(l_linenumber) AS BIGINT) AS scan_count,
       last(px ORDER BY l_orderkey, l_linenumber, l_partkey) AS close
FROM lines GROUP BY 1, 2, 3
"""))
def audit_collapse(t: Tables) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_partkey"]
    return up.collapse_audits(audits(t), order).select(
        "symbol", "as_of_date", "signal_name", "scan_count", "close"
    )


@query("audit_upsert", "U8", sql("""
SELECT symbol, trade_date AS as_of_date, l_returnflag AS signal_name,
       CAST(max(CASE WHEN trade_date < DATE '2000-01-01' THEN 3 ELSE 0 END)
         + max(CASE WHEN trade_date >= DATE '1999-01-01' THEN 1 ELSE 0 END) AS BIGINT)
         AS scan_count,
       trade_date >= DATE '1999-01-01' AS active
FROM lines GROUP BY 1, 2, 3
"""))
def audit_upsert(t: Tables) -> DataFrame:
    one = audits(t).select("symbol", "as_of_date", "signal_name", "source").distinct()
    stored = one.where(F.col("as_of_date") < day("2000-01-01")).withColumns(
        {"active": F.lit(False), "scan_count": F.lit(3)}
    )
    fresh = one.where(F.col("as_of_date") >= day("1999-01-01")).withColumn("active", F.lit(True))
    return up.save_audits(stored, fresh).select(
        "symbol", "as_of_date", "signal_name", "scan_count", "active"
    )


@query("signal_event_export", "S16 O9", sql("""
SELECT symbol, trade_date AS event_date, l_returnflag AS signal
FROM (SELECT DISTINCT symbol, trade_date, l_returnflag FROM lines)
ORDER BY trade_date DESC, symbol, l_returnflag LIMIT 1000
"""))
def signal_event_export(t: Tables) -> DataFrame:
    from tickloom.operators.signals import signal_event_export as export

    rows = audits(t).select("symbol", "as_of_date", "signal_name", "source").distinct()
    rows = rows.withColumns(
        {
            "active": F.lit(True),
            "created_at": F.col("as_of_date").cast("timestamp"),
            "updated_at": F.lit(None).cast("timestamp"),
        }
    )
    return export(rows).select("symbol", "event_date", "signal")


def watchlist(t: Tables) -> tuple[DataFrame, DataFrame]:
    s = t.read("supplier").withColumn("symbol", supplier_symbol("s_suppkey"))
    keys = {"user_id": F.lit("local"), "watchlist_name": F.lit("research_shortlist")}
    text = F.lit(None).cast("string")
    old = s.where(F.col("s_nationkey") < 15).withColumns(keys).select(
        "user_id", "watchlist_name", "symbol",
        F.lit("all").alias("source_universe"), F.lit("1").alias("source_run_id"),
        F.lit("old reason").alias("reason"), F.lit("watch").alias("review_status"),
        F.lit("value, Quality").alias("tags"), F.lit("first note").alias("notes"),
        F.lit(False).alias("active"), F.lit("2001-01-01").cast("timestamp").alias("updated_at"),
    )
    new = s.where(F.col("s_nationkey") >= 10).withColumns(keys).select(
        "user_id", "watchlist_name", "symbol",
        text.alias("source_universe"), F.lit("2").alias("source_run_id"),
        F.when(F.col("s_acctbal") > 5000, F.lit("new reason")).alias("reason"),
        F.when(F.col("s_acctbal") > 5000, F.lit("Deep Dive")).otherwise(F.lit("??")).alias(
            "review_status"),
        F.lit("quality, momentum").alias("tags"),
        F.when(F.col("s_acctbal") > 5000, F.lit("first")).otherwise(F.lit("second note")).alias(
            "notes"),
        F.lit(True).alias("active"), F.lit("2001-02-01").cast("timestamp").alias("updated_at"),
    )
    return old, new


part("watch", """
SELECT 'S' || s_suppkey || '.NS' AS symbol, s_nationkey < 15 AS old, s_nationkey >= 10 AS new,
       s_acctbal > 5000 AS rich FROM supplier
""")
part("merged_watch", """
SELECT symbol, CASE WHEN old THEN 'all' END AS source_universe,
       CASE WHEN new THEN '2' ELSE '1' END AS source_run_id,
       CASE WHEN new AND rich THEN 'new reason' WHEN old THEN 'old reason' END AS reason,
       CASE WHEN new AND rich THEN 'deep_dive' ELSE 'watch' END AS review_status,
       CASE WHEN old AND new THEN 'value, Quality, momentum' WHEN old THEN 'value, Quality'
            ELSE 'quality, momentum' END AS tags,
       CASE WHEN NOT new THEN 'first note' WHEN old AND rich THEN 'first note'
            WHEN old THEN 'first note' || chr(10) || 'second note'
            WHEN rich THEN 'first' ELSE 'second note' END AS notes,
       new AS active FROM watch WHERE old OR new
""")


@query("watchlist_merge", "U10", sql("SELECT * FROM merged_watch"))
def watchlist_merge(t: Tables) -> DataFrame:
    return up.merge_watchlist(*watchlist(t)).drop("user_id", "watchlist_name", "updated_at")


# --- membership -----------------------------------------------------------------------

@query("membership_snapshot_sync", "U12", sql("""
SELECT coalesce(o.symbol, n.symbol) AS symbol, coalesce(o.from_date, DATE '2001-10-01') AS from_date,
       CASE WHEN n.symbol IS NULL THEN DATE '2001-09-30' END AS to_date, n.symbol IS NOT NULL AS active
FROM (SELECT DISTINCT symbol, DATE '2001-07-01' AS from_date FROM snapshots
      WHERE snapshot_date = DATE '2001-07-01') AS o
FULL JOIN (SELECT DISTINCT symbol FROM snapshots WHERE snapshot_date = DATE '2001-10-01') AS n
  ON n.symbol = o.symbol
"""))
def membership_snapshot_sync(t: Tables) -> DataFrame:
    snaps = membership_snapshots(t)
    first = snaps.where(F.col("snapshot_date") == day("2001-07-01"))
    history = mb.periods_from_snapshots(first, INDEX, "derived")
    second = snaps.where(F.col("snapshot_date") == day("2001-10-01"))
    return mb.sync_snapshot(history, second, INDEX, day("2001-10-01"), "derived").select(
        "symbol", "from_date", "to_date", "active"
    )


@query("membership_coverage", "A12", sql("""
SELECT 'Large Turnover' AS index_name, count(*) FILTER (to_date IS NULL) AS active_members,
       count(*) AS total_periods, min(from_date) AS earliest_from_date,
       max(from_date) AS latest_from_date,
       count(*) > count(*) FILTER (to_date IS NULL) AS historical_backfill_ready,
       CAST(NULL AS VARCHAR) AS warning FROM periods
"""))
def membership_coverage(t: Tables) -> DataFrame:
    from tickloom.operators.ops import membership_coverage as coverage

    return coverage(membership(t))


@query("universe_changes", "J12 E3", sql("""
SELECT symbol, 'added' AS change FROM snapshots WHERE snapshot_date = DATE '2001-07-01'
 AND symbol NOT IN (SELECT symbol FROM snapshots WHERE snapshot_date = DATE '2001-04-01')
UNION ALL
SELECT symbol, 'removed' FROM snapshots WHERE snapshot_date = DATE '2001-04-01'
 AND symbol NOT IN (SELECT symbol FROM snapshots WHERE snapshot_date = DATE '2001-07-01')
"""))
def universe_changes(t: Tables) -> DataFrame:
    snaps = membership_snapshots(t)
    before = snaps.where(F.col("snapshot_date") == day("2001-04-01"))
    return mb.changes(before, snaps.where(F.col("snapshot_date") == day("2001-07-01")))


@query("universe_union", "E4", sql("""
SELECT symbol FROM snapshots WHERE snapshot_date = DATE '2001-04-01'
UNION SELECT symbol FROM snapshots WHERE snapshot_date = DATE '2001-07-01'
"""))
def universe_union(t: Tables) -> DataFrame:
    snaps = membership_snapshots(t)
    return mb.union_symbols(
        *[snaps.where(F.col("snapshot_date") == day(d)) for d in ("2001-04-01", "2001-07-01")]
    )


@query("universe_batch", "P24", sql(
    "SELECT symbol, name FROM universe ORDER BY symbol LIMIT 25 OFFSET 25"))
def universe_batch(t: Tables) -> DataFrame:
    """Second page of 25 of the universe in symbol order."""
    path = shared_path(t.spark, "pages")
    scans.write_pages(t.universe, path)
    return scans.read_page(t.spark, path, 26, 25).select("symbol", "name")


# --- saved scans ------------------------------------------------------------------------

def scan_at(t: Tables, days_back: int, last_bars: DataFrame | None = None) -> DataFrame:
    """The scan as it ran ``days_back`` days before the last bar."""
    until = F.date_sub(t.as_of, days_back)
    bars = t.bars.where(F.col("trade_date") <= until)
    return scan_universe(bars, t.universe, until, last_bars=last_bars)


def saved_scans(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Today's scan and the one 90 days before, on stored bars."""
    t = t.with_stored_bars()
    rows = last_bars_at(t.bars, {"now": t.as_of, "before": F.date_sub(t.as_of, 90)})
    return scan_at(t, 0, rows.where("now")), scan_at(t, 90, rows.where("before"))


def _scan_part(name: str, back: int) -> str:
    return f"""
SELECT symbol, active_signal_count, active_signals, last_close, rsi_14, ma_stack, warn,
       round(35 + 0.3 * tech, 1) AS composite_score, round(tech, 1) AS technicals,
       CASE WHEN 35 + 0.3 * tech >= 80 THEN 'Strong research candidate'
            WHEN 35 + 0.3 * tech >= 60 THEN 'Watchlist candidate'
            WHEN 35 + 0.3 * tech >= 40 THEN 'Neutral / needs more evidence'
            ELSE 'High caution' END AS band
FROM (
  SELECT i.symbol, active_signal_count, active_signals, i.close AS last_close, i.rsi_14,
         i.ma_stack_status AS ma_stack, warn,
         list_avg(list_filter([least(100, 40 + 12 * active_signal_count)::DOUBLE,
           CASE WHEN rsi_14 IS NULL THEN NULL WHEN rsi_14 BETWEEN 45 AND 65 THEN 85
                WHEN rsi_14 BETWEEN 35 AND 75 THEN 65 WHEN rsi_14 < 30 OR rsi_14 > 80 THEN 35
                ELSE 50 END,
           CASE WHEN ema_50 IS NULL OR ema_200 IS NULL THEN NULL
                WHEN close > ema_50 AND ema_50 > ema_200 THEN 85 WHEN close > ema_200 THEN 65
                ELSE 35 END,
           greatest(0, least(100, (relative_volume - 0.5) / 1.5 * 100))],
           lambda x: x IS NOT NULL)) AS tech
  FROM (SELECT * FROM ind_{name} WHERE n = last_n) AS i
  JOIN (SELECT symbol, string_agg(signal, '; ' ORDER BY place) FILTER (active) AS active_signals,
               count(*) FILTER (active) AS active_signal_count FROM sig_{name}
        WHERE n = last_n GROUP BY symbol) AS s ON s.symbol = i.symbol
  JOIN (SELECT symbol, count(*) FILTER (abs(close / prior_close - 1) * 100 > 40) AS moves,
               CASE WHEN count(*) FILTER (abs(close / prior_close - 1) * 100 > 40) > 0 THEN 1
                    ELSE 0 END
               + CASE WHEN max(as_of) - {back} - max(trade_date) > 5 THEN 1 ELSE 0 END AS warn
        FROM ind_{name} CROSS JOIN today GROUP BY symbol) AS q ON q.symbol = i.symbol)
"""


for _name, _back in (("now", 0), ("before", 90)):
    part(f"ind_{_name}", f"""
SELECT *, max(n) OVER (PARTITION BY symbol) AS last_n FROM (
  SELECT ind.* FROM ind CROSS JOIN today WHERE trade_date <= as_of - {_back})
""")
    part(f"sig_{_name}", f"""
SELECT s.*, max(n) OVER (PARTITION BY symbol) AS last_n FROM (
  SELECT sig_all.* FROM sig_all CROSS JOIN today WHERE trade_date <= as_of - {_back}) AS s
""")
    part(f"scan_{_name}", _scan_part(_name, _back))


@query("universe_scan", "L2 O1 A18", sql("""
SELECT symbol, composite_score, band, technicals, active_signal_count,
       coalesce(active_signals, '') AS active_signals, last_close, rsi_14, ma_stack,
       CAST(warn AS BIGINT) AS warnings FROM scan_now
"""), "composite_score technicals rsi_14")
def universe_scan(t: Tables) -> DataFrame:
    return scans.rank_scan(scan_at(t, 0)).select(
        "symbol", "composite_score", "band", "technicals", "active_signal_count",
        "active_signals", "last_close", "rsi_14", "ma_stack",
        F.size("data_quality_warnings").alias("warnings"),
    )


@query("scan_result_filter", "P21", sql("""
SELECT symbol, composite_score, active_signal_count FROM scan_now
WHERE composite_score >= 50 AND active_signal_count >= 1
"""), "composite_score")
def scan_result_filter(t: Tables) -> DataFrame:
    return scans.filter_scan(scan_at(t, 0), 50, 1).select(
        "symbol", "composite_score", "active_signal_count"
    )


part("compared", """
SELECT a.symbol, a.composite_score, b.composite_score AS previous_score,
       round(a.composite_score - b.composite_score, 2) AS score_change,
       a.active_signal_count - b.active_signal_count AS signal_count_change,
       coalesce(array_to_string(list_sort(list_filter(string_split(a.active_signals, '; '),
         lambda x: NOT list_contains(string_split(coalesce(b.active_signals, ''), '; '), x))),
         '; '), '') AS new_active_signals,
       coalesce(array_to_string(list_sort(list_filter(string_split(b.active_signals, '; '),
         lambda x: NOT list_contains(string_split(coalesce(a.active_signals, ''), '; '), x))),
         '; '), '') AS dropped_active_signals,
       CASE WHEN b.symbol IS NULL THEN 'new symbol'
            WHEN round(a.composite_score - b.composite_score, 2) >= 5 THEN 'improved'
            WHEN round(a.composite_score - b.composite_score, 2) <= -5 THEN 'weakened'
            ELSE 'stable' END AS comparison_status, a.warn
FROM scan_now AS a LEFT JOIN scan_before AS b ON b.symbol = a.symbol
""")


@query("scan_comparison", "J8 E2 O6", sql("""
SELECT symbol, composite_score, previous_score, score_change,
       CAST(signal_count_change AS DOUBLE) AS signal_count_change, new_active_signals,
       dropped_active_signals, comparison_status FROM compared
"""), "composite_score previous_score score_change")
def scan_comparison(t: Tables) -> DataFrame:
    return scans.ranked_comparison(scans.compare_scans(*saved_scans(t))).select(
        "symbol", "composite_score", "previous_score", "score_change", "signal_count_change",
        "new_active_signals", "dropped_active_signals", "comparison_status",
    )


@query("daily_brief", "A17", sql("""
SELECT count(*) AS requested_symbols, count(*) AS successful_symbols,
       CAST(0 AS BIGINT) AS failed_symbols, round(avg(composite_score), 1) AS average_score,
       max(composite_score) AS top_score, count(*) FILTER (score_change >= 5) AS improved,
       count(*) FILTER (score_change <= -5) AS weakened,
       count(*) FILTER (comparison_status = 'new symbol' AND composite_score >= 60)
         AS new_opportunities,
       count(*) FILTER (new_active_signals <> '') AS new_signals,
       count(*) FILTER (warn > 0) AS data_quality_actions FROM compared
"""), "average_score top_score")
def daily_brief(t: Tables) -> DataFrame:
    return scans.brief_totals(scans.compare_scans(*saved_scans(t)))


@query("brief_improved", "O7", sql("""
SELECT symbol, score_change, composite_score FROM compared WHERE score_change >= 5
ORDER BY score_change DESC, composite_score DESC, symbol LIMIT 10
"""), "score_change composite_score")
def brief_improved(t: Tables) -> DataFrame:
    return scans.brief_list(scans.compare_scans(*saved_scans(t)), "improved").select(
        "symbol", "score_change", "composite_score"
    )


@query("brief_weakened", "O7", sql("""
SELECT symbol, score_change, composite_score FROM compared WHERE score_change <= -5
ORDER BY score_change, composite_score DESC, symbol LIMIT 10
"""), "score_change composite_score")
def brief_weakened(t: Tables) -> DataFrame:
    return scans.brief_list(scans.compare_scans(*saved_scans(t)), "weakened").select(
        "symbol", "score_change", "composite_score"
    )


def scan_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Result rows of two runs and the run rows."""
    now, before = saved_scans(t)
    rows = now.withColumn("run_id", F.lit("run-2")).unionByName(
        before.where(F.col("composite_score") >= 45).withColumn("run_id", F.lit("run-1"))
    )
    rows = rows.withColumn(
        "error", F.when(F.col("active_signal_count") >= 2, F.lit("left out"))
    )
    rows = materialise(rows)
    stamps = F.when(F.col("run_id") == "run-2", F.lit("2001-11-04")).otherwise("2001-08-06")
    runs = rows.groupBy("run_id").agg(F.count("*").alias("n")).withColumns(
        {"created_at": stamps.cast("timestamp"), "universe_name": F.lit("all")}
    )
    return rows, runs


@query("scan_run_summary", "U14", sql("""
SELECT run_id, count(*) AS requested_symbols, count(*) FILTER (NOT bad) AS successful_symbols,
       count(*) FILTER (bad) AS failed_symbols,
       CASE WHEN count(*) FILTER (bad) = count(*) THEN 'failed'
            WHEN bool_or(bad) THEN 'completed_with_errors' ELSE 'completed' END AS status
FROM (SELECT 'run-2' AS run_id, active_signal_count >= 2 AS bad FROM scan_now
      UNION ALL SELECT 'run-1', active_signal_count >= 2 FROM scan_before
                WHERE composite_score >= 45)
GROUP BY run_id
"""))
def scan_run_summary(t: Tables) -> DataFrame:
    rows, _ = scan_tables(t)
    return up.run_summary(rows)


@query("watchlist_with_scores", "J9", sql("""
SELECT w.symbol, review_status, s.composite_score AS latest_score, s.band AS latest_band,
       CASE WHEN s.symbol IS NOT NULL THEN 'run-2' END AS latest_run_id
FROM merged_watch AS w LEFT JOIN scan_now AS s ON s.symbol = w.symbol
"""), "latest_score")
def watchlist_with_scores(t: Tables) -> DataFrame:
    rows, runs = scan_tables(t)
    items = up.merge_watchlist(*watchlist(t))
    return scans.watchlist_with_scores(items, rows, runs).select(
        "symbol", "review_status", "latest_score", "latest_band", "latest_run_id"
    )


@query("scan_freshness", "P39", sql("""
SELECT symbol AS universe_name,
       CASE WHEN max(CASE WHEN l_quantity >= 10 THEN trade_date END) IS NULL THEN 'unknown'
            WHEN max(CASE WHEN l_quantity >= 10 THEN trade_date END) >= max(as_of) - 59 THEN 'fresh'
            WHEN max(CASE WHEN l_quantity >= 10 THEN trade_date END) >= max(as_of) - 89 THEN 'aging'
            ELSE 'stale' END AS freshness
FROM lines CROSS JOIN today WHERE l_quantity >= 10 OR l_partkey % 7 = 0 GROUP BY symbol
"""))
def scan_freshness(t: Tables) -> DataFrame:
    """One universe per symbol, its runs on days with a larger line, judged by 60 and 90 days."""
    run = F.when(F.col("l_quantity") >= 10, F.col("trade_date"))
    runs = t.lines.where((F.col("l_quantity") >= 10) | (F.col("l_partkey") % 7 == 0)).select(
        F.col("symbol").alias("universe_name"), run.cast("timestamp").alias("created_at")
    )
    return scans.scan_freshness(runs, F.date_add(t.as_of, 1), fresh=60 * 24, stale=90 * 24).select(
        "universe_name", "freshness"
    )
