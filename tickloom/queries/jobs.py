"""The jobs that users run, on stored tables: written, run, and everything read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.bridge import Tables
from tickloom.operators import backtest as bt
from tickloom.operators import runs as rn
from tickloom.operators import scans
from tickloom.operators.continuation import new_rows
from tickloom.operators.membership import periods_from_snapshots
from tickloom.operators.technicals import INDICATORS, add_technical_indicators
from tickloom.operators.upsert import store_by_year
from tickloom.plans import bundles, imports
from tickloom.plans.pipelines import (
    continued_frame, newest_state, scan_universe, start_indicators,
)
from tickloom.queries import backtests, indicators, operations, state
from tickloom.queries.registry import query
from tickloom.queries.sqlbase import PARTS, half_up, sql
from tickloom.session import shared_path
from tickloom.sources.clustered import write_clustered

# --- indicators from stored state, look-back, clustered prices -------------------------------

SETTLED = "2000-06-30"
_RAW = """
SELECT symbol, trade_date, arg_max(open, p) AS open, arg_max(high, p) AS high,
       arg_max(low, p) AS low, arg_max(close, p) AS close, arg_max(volume, p) AS volume
FROM (SELECT *, CASE source WHEN 'kite' THEN 2 ELSE 1 END AS p FROM bars2) GROUP BY 1, 2
"""
_ADJUSTED = """
SELECT symbol, trade_date, open / f AS open, high / f AS high, low / f AS low, close / f AS close,
       volume * f AS volume FROM (
  SELECT b.*, coalesce((SELECT product(value) FROM splits AS s WHERE s.symbol = b.symbol
                        AND s.ex_date > b.trade_date), 1) AS f FROM raw_bars AS b)
"""


def continued(t: Tables) -> DataFrame:
    """A state as of June 2000, when later splits were unknown; then only newer partitions are read."""
    root = shared_path(t.spark, "continued")
    prices = store_by_year(
        t.spark, f"{root}/price_daily", t.bars_two_source, ("symbol", "trade_date", "source"), "trade_date", ()
    )
    early = prices.where(F.col("trade_date") <= F.lit(SETTLED).cast("date"))
    start_indicators(early, t.splits.where(F.col("ex_date") <= SETTLED), root, "2000-06-30")
    after = prices.where(F.col("trade_date") > F.lit(SETTLED).cast("date"))
    frame = continued_frame(
        t.spark, f"{root}/price_daily", newest_state(t.spark, root), t.splits, after
    )
    return new_rows(frame).where(F.col("trade_date") > SETTLED)


@query("continued_indicators", "W25 L1 L4", sql(f"""
SELECT symbol, trade_date, close, {', '.join(INDICATORS)}, n AS bar_number
FROM ind WHERE trade_date > DATE '{SETTLED}'
""", raw_bars=_RAW, bars=_ADJUSTED), indicators._SUMS, 3)
def continued_indicators(t: Tables) -> DataFrame:
    return continued(t).select("symbol", "trade_date", "close", *INDICATORS, "bar_number")


LOOKBACK = 365
_RECENT = f"SELECT b.* FROM raw_bars AS b CROSS JOIN today WHERE trade_date >= as_of - {LOOKBACK}"


@query("bounded_universe_scan", "L2", sql("""
SELECT u.symbol, CASE WHEN rows >= 30 THEN composite_score END AS composite_score,
       CASE WHEN rows >= 30 THEN technicals END AS technicals,
       CASE WHEN rows >= 30 THEN s.active_signal_count ELSE 0 END AS active_signal_count,
       CASE WHEN rows >= 30 THEN coalesce(active_signals, '') ELSE '' END AS active_signals,
       CASE WHEN rows >= 30 THEN last_close END AS last_close,
       CASE WHEN rows >= 30 THEN s.rsi_14 END AS rsi_14,
       CASE WHEN coalesce(rows, 0) < 30 THEN 'insufficient price history' END AS error
FROM universe AS u LEFT JOIN (SELECT symbol, count(*) AS rows FROM bars GROUP BY symbol) AS r
  ON r.symbol = u.symbol LEFT JOIN scan_now AS s ON s.symbol = u.symbol
""", raw_bars=PARTS["bars"], bars=_RECENT), "composite_score technicals rsi_14")
def bounded_universe_scan(t: Tables) -> DataFrame:
    """A year of prices is read from the table by year, not all history."""
    path = shared_path(t.spark, "prices")
    bars = store_by_year(t.spark, path, t.bars, ("symbol", "trade_date"), "trade_date", ())
    done = scan_universe(bars, t.universe, t.as_of, lookback_days=LOOKBACK)
    return done.select(
        "symbol", "composite_score", "technicals", "active_signal_count", "active_signals", "last_close",
        "rsi_14", "error",
    )


def clustered(t: Tables) -> DataFrame:
    return write_clustered(t.bars, f"bars_{shared_path(t.spark, 'x').rsplit('-', 1)[-1]}", buckets=8)


@query("clustered_technical_indicators", "S1 L1", sql(
    f"SELECT symbol, trade_date, close, {', '.join(INDICATORS)} FROM ind"), indicators._SUMS, 3)
def clustered_technical_indicators(t: Tables) -> DataFrame:
    return add_technical_indicators(clustered(t)).select("symbol", "trade_date", "close", *INDICATORS)


@query("clustered_backtest_summary", "S1 L6 J3 A1", backtests.SUMMARY_SQL, backtests.SUMMARY_SUMS)
def clustered_backtest_summary(t: Tables) -> DataFrame:
    """Prices are read once; events and what follows them come from one frame."""
    return bt.summarise_signals(bt.backtest_history(add_technical_indicators(clustered(t))))


# --- equity with total losses -------------------------------------------------------------------

_LOSSES = """
SELECT *, CASE WHEN symbol = 'S5.NS' AND signal = 'MA Stack' AND entry_date >= DATE '2001-03-01' THEN -100
               WHEN symbol = 'S3.NS' AND entry_date >= DATE '2000-01-01' THEN -150
               ELSE return_pct END AS r FROM trades WHERE return_pct IS NOT NULL
"""


@query("equity_with_losses", "W13", sql("""
SELECT day, symbol, signal, entry_date, CAST(sign AS BIGINT) AS sign, log_equity,
       CASE WHEN peak IS NOT NULL THEN sign * exp(coalesce(log_equity, 0) - peak) - 1
            WHEN sign < 0 THEN 0 END AS drawdown
FROM (SELECT *, max(CASE WHEN sign > 0 THEN log_equity END) OVER (ORDER BY k) AS peak FROM (
  SELECT *, CASE WHEN zeros > 0 THEN 0 WHEN negatives % 2 = 1 THEN -1 ELSE 1 END AS sign,
         CASE WHEN zeros = 0 THEN total END AS log_equity
  FROM (SELECT *, sum(CASE WHEN f <> 0 THEN ln(abs(f)) ELSE 0 END) OVER (ORDER BY k) AS total,
               sum(CASE WHEN f < 0 THEN 1 ELSE 0 END) OVER (ORDER BY k) AS negatives,
               sum(CASE WHEN f = 0 THEN 1 ELSE 0 END) OVER (ORDER BY k) AS zeros
        FROM (SELECT coalesce(exit_date, entry_date) AS day, symbol, signal, entry_date, 1 + r / 100 AS f,
                     row_number() OVER (ORDER BY coalesce(exit_date, entry_date), symbol, signal, entry_date) AS k
              FROM losses))))
""", losses=_LOSSES), "log_equity drawdown")
def equity_with_losses(t: Tables) -> DataFrame:
    """Trades that lose more than everything turn the curve's sign, one that loses all ends it."""
    total = (F.col("symbol") == "S5.NS") & (F.col("signal") == "MA Stack") & (F.col("entry_date") >= "2001-03-01")
    more = (F.col("symbol") == "S3.NS") & (F.col("entry_date") >= "2000-01-01")
    done = backtests.stored_trades(t).where(F.col("return_pct").isNotNull())
    lossy = F.when(total, -100.0).when(more, -150.0).otherwise(F.col("return_pct"))
    return bt.equity_curve(done.withColumn("return_pct", lossy))


# --- runs of scans ------------------------------------------------------------------------------

_BEFORE = f"SELECT * FROM ({state._scan_part('before', 90)}) WHERE composite_score >= 45"
_NOTES = """
SELECT symbol, array_to_string(list_filter([
         CASE WHEN moves > 0 THEN 'suspicious_price_moves: ' || moves
              || ' day(s) > 40.0% (possible unadjusted corporate action)' END,
         CASE WHEN age > 5 THEN 'stale_data: last bar is ' || age || ' day(s) old' END],
         lambda x: x IS NOT NULL), '; ') AS note
FROM (SELECT symbol, count(*) FILTER (abs(close / prior_close - 1) * 100 > 40) AS moves,
             max(as_of) - max(trade_date) AS age FROM ind_now CROSS JOIN today GROUP BY symbol)
"""


def stored_scans(t: Tables) -> str:
    """Two runs of one universe, and one of another, in one store."""
    root = shared_path(t.spark, "scans")
    now, before = state.saved_scans(t)
    rn.save_scan(before.where(F.col("composite_score") >= 45), root, "all", "20010806", F.lit("2001-08-06").cast("timestamp"))
    newest = rn.save_scan(now, root, "all", "20011104", F.lit("2001-11-04").cast("timestamp"))
    rn.save_scan(newest.limit(0), root, "none", "20011105", F.lit("2001-11-05").cast("timestamp"))
    return root


@query("stored_scan_comparison", "U11 L10 J8 E2", sql("""
SELECT symbol, composite_score, previous_score, score_change, new_active_signals, dropped_active_signals,
       comparison_status, '20011104' AS run_id FROM compared
""", scan_before=_BEFORE), "composite_score previous_score score_change")
def stored_scan_comparison(t: Tables) -> DataFrame:
    return rn.compare_latest_scans(t.spark, stored_scans(t), "all").select(
        "symbol", "composite_score", "previous_score", "score_change", "new_active_signals",
        "dropped_active_signals", "comparison_status", "run_id",
    )


@query("stored_run_rows", "U11 U14", sql("""
SELECT 'all' AS universe_name, run_id, requested_symbols, requested_symbols AS successful_symbols,
       CAST(0 AS BIGINT) AS failed_symbols, 'completed' AS status, created_at FROM (
  SELECT '20011104' AS run_id, count(*) AS requested_symbols, TIMESTAMP '2001-11-04' AS created_at FROM scan_now
  UNION ALL SELECT '20010806', count(*), TIMESTAMP '2001-08-06' FROM scan_before)
""", scan_before=_BEFORE))
def stored_run_rows(t: Tables) -> DataFrame:
    return rn.stored_runs(t.spark, stored_scans(t)).select(
        "universe_name", F.col("run_id").cast("string").alias("run_id"), "requested_symbols",
        "successful_symbols", "failed_symbols", "status", F.col("created_at").cast("timestamp_ntz").alias("created_at"),
    )


def _listed(kind: str, rows: str, order: str, limit: int = 10) -> str:
    return f"""
SELECT '{kind}' AS kind, symbol, composite_score, score_change, new_active_signals, note,
       row_number() OVER (ORDER BY {order}) AS position
FROM compared JOIN notes USING (symbol) WHERE {rows} QUALIFY position <= {limit}
"""


_TAIL = "composite_score DESC NULLS LAST, symbol"


@query("stored_brief_lists", "L11 O7", sql("SELECT * FROM lists", lists=" UNION ALL ".join((
    _listed("improved", "score_change >= 5", f"score_change DESC NULLS LAST, {_TAIL}"),
    _listed("weakened", "score_change <= -5", f"score_change NULLS LAST, {_TAIL}"),
    _listed("new_opportunities", "comparison_status = 'new symbol' AND composite_score >= 60", _TAIL),
    _listed("new_signals", "new_active_signals <> ''", f"score_change DESC NULLS LAST, {_TAIL}"),
    _listed("data_quality", "note <> ''", "note DESC, symbol", 15),
)), notes=_NOTES, scan_before=_BEFORE), "composite_score score_change")
def stored_brief_lists(t: Tables) -> DataFrame:
    return rn.daily_brief(t.spark, stored_scans(t), "all")[1]


@query("stored_brief_totals", "L11 A17", sql("""
SELECT count(*) AS requested_symbols, count(*) AS successful_symbols,
       CAST(0 AS BIGINT) AS failed_symbols, round(avg(composite_score), 1) AS average_score,
       max(composite_score) AS top_score, count(*) FILTER (score_change >= 5) AS improved,
       count(*) FILTER (score_change <= -5) AS weakened,
       count(*) FILTER (comparison_status = 'new symbol' AND composite_score >= 60) AS new_opportunities,
       count(*) FILTER (new_active_signals <> '') AS new_signals,
       count(*) FILTER (warn > 0) AS data_quality_actions FROM compared
""", scan_before=_BEFORE), "average_score top_score")
def stored_brief_totals(t: Tables) -> DataFrame:
    return rn.daily_brief(t.spark, stored_scans(t), "all")[0]


@query("universe_last_page", "P24", sql("""
SELECT symbol, name FROM universe ORDER BY symbol DESC LIMIT 25
"""))
def universe_last_page(t: Tables) -> DataFrame:
    """The last 25 of the universe in symbol order, from the ranges that hold them."""
    path = shared_path(t.spark, "pages")
    scans.write_pages(t.universe, path)
    return scans.read_page(t.spark, path, t.universe.count() - 24, 25).select("symbol", "name")


# --- imports ------------------------------------------------------------------------------------

def sent_statements(t: Tables) -> DataFrame:
    """Quarters as a user sends them: some periods twice, some with a quarter that is none, a URL in late rows."""
    key = F.regexp_extract("symbol", r"(\d+)", 1).cast("long")
    rows = t.quarterly.select(
        F.lower(F.regexp_replace("symbol", r"\.NS$", "")).alias("Ticker"),
        F.col("fiscal_year").cast("string").alias("Year"), F.col("fiscal_quarter").cast("string").alias("Quarter"),
        F.col("revenue").cast("string").alias("Sales"), F.col("net_income").cast("string").alias("Net Profit"),
        F.when(F.col("fiscal_year") >= 1998, F.concat(F.lit("u"), F.col("fiscal_year").cast("string"))).alias("source_url"),
        (F.col("fiscal_year") * 10 + F.col("fiscal_quarter")).alias("row"), key.alias("k"),
    )
    stray = rows.where((F.col("k") % 7 == 0) & (F.col("Year") == 1999)).withColumns(
        {"Quarter": F.lit("7"), "row": F.col("row") + 100_000}
    )
    again = rows.where((F.col("k") % 11 == 0) & (F.col("Year") == 2000)).withColumns(
        {"Sales": F.lit("(5)"), "row": F.col("row") + 200_000}
    )
    return rows.unionByName(stray).unionByName(again).drop("k")


_SENT = """
SELECT symbol, fiscal_year, fiscal_quarter, revenue, net_income,
       CASE WHEN fiscal_year >= 1998 THEN 'u' || fiscal_year END AS url,
       fiscal_year * 10 + fiscal_quarter AS row, CAST(regexp_extract(symbol, '(\\d+)', 1) AS BIGINT) AS k
FROM quarterly
"""
_FRAME = """
SELECT * FROM sent
UNION ALL SELECT symbol, fiscal_year, 7, revenue, net_income, url, row + 100000, k FROM sent
          WHERE k % 7 = 0 AND fiscal_year = 1999
UNION ALL SELECT symbol, fiscal_year, fiscal_quarter, -5, net_income, url, row + 200000, k FROM sent
          WHERE k % 11 = 0 AND fiscal_year = 2000
"""


def imported(t: Tables, **options: object) -> tuple[str, imports.ImportResult]:
    """A store with some earlier rows and most symbols, and the import into it."""
    root = shared_path(t.spark, "import")
    old = t.quarterly.where(F.col("fiscal_year") <= 1996).select(
        "symbol", "fiscal_year", "fiscal_quarter", F.lit("manual").alias("source"),
        F.lit("INR").alias("currency"), F.lit(1.0).alias("revenue"), F.lit(2.0).alias("net_income"),
        F.lit("old").alias("source_url"),
    )
    imports.store(old, f"{root}/fundamentals_quarterly", ("symbol", "fiscal_year", "fiscal_quarter", "source"), "fiscal_year")
    known = t.universe.where(~F.col("symbol").rlike("[05]\\.NS$"))
    known.select("symbol", "name", F.lit("NSE").alias("exchange"), F.lit("list").alias("source")).write.parquet(
        f"{root}/stock_universe"
    )
    result = imports.import_fundamentals(
        sent_statements(t), root, source="manual", order=["row"], quarterly=True, in_crore=False, **options
    )
    return root, result


@query("statement_import_preview", "A24 L12", sql("""
SELECT symbol, CAST(sum(n) AS BIGINT) AS rows, array_to_string(list_filter([
         CASE WHEN bool_or(fiscal_quarter = 7) THEN 'fiscal_quarter_out_of_range' END,
         CASE WHEN bool_or(n > 1) THEN 'duplicate_period' END], lambda x: x IS NOT NULL), '; ') AS errors,
       CASE WHEN sum(known) = 0 THEN 'all_null_net_income' ELSE '' END AS warnings
FROM (SELECT symbol, fiscal_year, fiscal_quarter, count(*) AS n, count(net_income) AS known
      FROM frame GROUP BY 1, 2, 3) GROUP BY symbol
""", sent=_SENT, frame=_FRAME))
def statement_import_preview(t: Tables) -> DataFrame:
    return imported(t)[1].preview


@query("statement_import_table", "L12 U3", sql("""
SELECT coalesce(n.symbol, o.symbol) AS symbol, coalesce(n.fiscal_year, o.fiscal_year) AS fiscal_year,
       coalesce(n.fiscal_quarter, o.fiscal_quarter) AS fiscal_quarter,
       CASE WHEN n.symbol IS NULL THEN 1 ELSE n.revenue END AS revenue,
       CASE WHEN n.symbol IS NULL THEN 2 ELSE n.net_income END AS net_income,
       CASE WHEN n.symbol IS NULL THEN 'old' ELSE first_url END AS source_url, 'manual' AS source, 'INR' AS currency
FROM (SELECT symbol, fiscal_year, fiscal_quarter, arg_max_null(revenue, row) AS revenue,
             arg_max_null(net_income, row) AS net_income FROM frame WHERE fiscal_quarter <= 4 GROUP BY 1, 2, 3) AS n
LEFT JOIN (SELECT symbol, arg_min(url, row) AS first_url FROM frame WHERE url IS NOT NULL AND fiscal_quarter <= 4
           GROUP BY 1) AS u ON u.symbol = n.symbol
FULL JOIN (SELECT symbol, fiscal_year, fiscal_quarter FROM quarterly WHERE fiscal_year <= 1996) AS o
  ON o.symbol = n.symbol AND o.fiscal_year = n.fiscal_year AND o.fiscal_quarter = n.fiscal_quarter
""", sent=_SENT, frame=_FRAME), "revenue net_income")
def statement_import_table(t: Tables) -> DataFrame:
    root, _ = imported(t, dry_run=False, allow_partial=True)
    return t.spark.read.parquet(f"{root}/fundamentals_quarterly").select(
        "symbol", "fiscal_year", "fiscal_quarter", "revenue", "net_income", "source_url", "source", "currency"
    )


@query("statement_import_counts", "L12 U14", sql("""
SELECT (SELECT count(*) FROM (SELECT DISTINCT symbol, fiscal_year, fiscal_quarter FROM frame WHERE fiscal_quarter <= 4
        AND fiscal_year > 1996)) AS inserted,
       (SELECT count(*) FROM (SELECT DISTINCT symbol, fiscal_year, fiscal_quarter FROM frame WHERE fiscal_quarter <= 4
        AND fiscal_year <= 1996)) AS updated,
       (SELECT count(*) FROM frame WHERE fiscal_quarter > 4) AS skipped
""", sent=_SENT, frame=_FRAME))
def statement_import_counts(t: Tables) -> DataFrame:
    return imported(t, dry_run=False, allow_partial=True)[1].counts


@query("statement_import_symbols", "L12", sql("""
SELECT symbol, CASE WHEN regexp_matches(symbol, '[05]\\.NS$') THEN symbol ELSE name END AS name, 'NSE' AS exchange,
       CASE WHEN regexp_matches(symbol, '[05]\\.NS$') THEN 'manual_fundamentals_import' ELSE 'list' END AS source
FROM universe WHERE NOT regexp_matches(symbol, '[05]\\.NS$') OR symbol IN (SELECT symbol FROM quarterly)
"""))
def statement_import_symbols(t: Tables) -> DataFrame:
    root, _ = imported(t, dry_run=False, allow_partial=True)
    return t.spark.read.parquet(f"{root}/stock_universe").select("symbol", "name", "exchange", "source")


def refreshed(t: Tables) -> tuple[str, DataFrame]:
    """Statements of two sources; some symbols of the second have a negative amount and must stay out."""
    from tickloom.queries.companies import annual_with_cap

    root = shared_path(t.spark, "refresh")
    rows = annual_with_cap(t)
    low = F.col("revenue") < 20000
    second = rows.withColumns({"source": F.lit("B"), "revenue": F.when(low, -F.col("revenue")).otherwise(F.col("revenue") * 2)})
    both = rows.withColumn("source", F.lit("A")).unionByName(second)
    stored = both.where(F.col("fiscal_year") <= 1998).withColumn("revenue", F.lit(1.0))
    stored = stored.withColumn("source_url", F.lit(None).cast("string"))
    imports.store(stored, f"{root}/fundamentals_annual", ("symbol", "fiscal_year", "source"), "fiscal_year")
    return root, imports.refresh_fundamentals(both, root, sources=["A", "B"], sectors=t.universe)


@query("fundamentals_refresh_table", "L5 U3 A21", sql("""
SELECT symbol, fiscal_year, source, revenue FROM (
  SELECT symbol, fiscal_year, 'A' AS source, revenue FROM annual
  UNION ALL SELECT symbol, fiscal_year, 'B', CASE WHEN bad THEN 1 ELSE revenue * 2 END
  FROM annual JOIN (SELECT symbol, bool_or(revenue < 20000) AS bad FROM annual GROUP BY symbol) USING (symbol)
  WHERE NOT bad OR fiscal_year <= 1998)
"""), "revenue")
def fundamentals_refresh_table(t: Tables) -> DataFrame:
    root, _ = refreshed(t)
    return t.spark.read.parquet(f"{root}/fundamentals_annual").select("symbol", "fiscal_year", "source", "revenue")


@query("fundamentals_refresh_report", "L5 A21", sql("""
SELECT symbol, s.source, count(*) AS rows,
       CASE WHEN s.source = 'B' AND bool_or(revenue < 20000) THEN 'non_positive_revenue' ELSE '' END AS errors,
       CASE WHEN s.source = 'B' AND bool_or(revenue < 20000) THEN 'failed' ELSE 'stored' END AS status
FROM annual CROSS JOIN (SELECT unnest(['A', 'B']) AS source) AS s GROUP BY symbol, s.source
"""))
def fundamentals_refresh_report(t: Tables) -> DataFrame:
    return refreshed(t)[1].select("symbol", "source", "rows", "errors", "status")


# --- bundles ------------------------------------------------------------------------------------

DAY = "2000-02-01"


def _wide(part: str, table: str, key: str, columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{part}' AS part, {key} || '{c}' AS key, CAST({c} AS VARCHAR) AS value FROM {table}" for c in columns
    )


_PAIRS = f"""
SELECT symbol, max(trade_date) AS d, max(close) FILTER (back = 1) AS now, max(close) FILTER (back = 2) AS old,
       count(*) FILTER (back <= 2) = 2 AS two
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS back
      FROM bars WHERE trade_date <= DATE '{DAY}') GROUP BY symbol
"""
_BREADTH = f"""
SELECT max(d) AS latest_trade_date, count(*) FILTER (two) AS compared_symbols,
       count(*) FILTER (two AND now > old) AS advances, count(*) FILTER (two AND now < old) AS declines,
       count(*) FILTER (two AND now = old) AS unchanged,
       CASE WHEN count(*) FILTER (two AND now < old) > 0
            THEN {half_up('count(*) FILTER (two AND now > old)::DOUBLE / count(*) FILTER (two AND now < old)', 2)}
            WHEN count(*) FILTER (two AND now > old) > 0 THEN count(*) FILTER (two AND now > old)::DOUBLE END
         AS advance_decline_ratio FROM pairs
"""
_RUN_DAYS = f"""
SELECT strftime(trade_date, '%Y%m%d') AS run_id, trade_date, count(*) FILTER (l_quantity >= 50) AS failed_symbols
FROM lines GROUP BY trade_date
"""


@query("market_today_bundle", "L8 A14 O4 O5 O8 A13 A26", sql(" UNION ALL ".join((
    _wide("breadth", "breadth", "''", ("latest_trade_date", "compared_symbols", "advances", "declines", "unchanged",
                                       "advance_decline_ratio")),
    _wide("movers", "movers", "symbol || '.'", ("symbol", "score", "score_change")),
    _wide("attention", "attention", "symbol || '.'", ("symbol", "score", "signals")),
    _wide("events", "coming", "symbol || '.'", ("symbol", "date", "days_until")),
    _wide("stale", "aged", "symbol || '.'", ("symbol", "days_stale")),
    _wide("provider", "provider", "''", ("run_id", "label", "color")),
)), pairs=_PAIRS, breadth=_BREADTH, movers="""
SELECT symbol, round(composite_score, 1) AS score, round(score_change, 1) AS score_change FROM compared
ORDER BY round(abs(score_change), 1) DESC, composite_score DESC, symbol LIMIT 5
""", attention="""
SELECT symbol, round(composite_score, 1) AS score, active_signal_count AS signals FROM scan_now
ORDER BY composite_score DESC, active_signal_count DESC, symbol LIMIT 5
""", coming=f"""
SELECT symbol, ex_date AS date, ex_date - DATE '{DAY}' AS days_until FROM splits
WHERE ex_date BETWEEN DATE '{DAY}' AND DATE '{DAY}' + 42 ORDER BY ex_date, symbol, action_type LIMIT 20
""", aged=f"""
SELECT symbol, DATE '{DAY}' - d AS days_stale FROM pairs WHERE DATE '{DAY}' - d > 5 ORDER BY d, symbol LIMIT 10
""", run_days=_RUN_DAYS, provider=f"""
SELECT run_id, CASE WHEN failed_symbols = 0 THEN 'Healthy' ELSE 'Partial' END AS label,
       CASE WHEN failed_symbols = 0 THEN 'green' ELSE 'amber' END AS color
FROM run_days WHERE trade_date <= DATE '{DAY}' ORDER BY trade_date DESC LIMIT 1
"""))
def market_today_bundle(t: Tables) -> DataFrame:
    """The home page of a Tuesday in 2000."""
    t = t.with_stored_bars()
    today = F.lit(DAY).cast("date")
    actions = t.splits.withColumn("detail", F.lit(None).cast("string"))
    return bundles.market_today(
        t.bars.where(F.col("trade_date") <= DAY), operations.score_series(t), actions,
        operations.runs(t).where(F.col("started_at") <= DAY), today, trading_days=30,
    )


@query("data_health_bundle", "L9 A9 A10 A11 A12 A13 A28", sql(" UNION ALL ".join((
    _wide("prices", "covered", "coalesce(source, 'total') || '.'",
          ("source", "rows", "distinct_symbols", "oldest_trade_date", "newest_trade_date")),
    _wide("scores", "score_cover", "''", ("distinct_symbols", "total_rows", "rows_last_7_days", "latest_as_of_date")),
    _wide("instruments", "listed", "coalesce(exchange, 'total') || '.'", ("exchange", "instruments")),
    _wide("membership", "members", "index_name || '.'",
          ("index_name", "active_members", "total_periods", "earliest_from_date", "latest_from_date",
           "historical_backfill_ready", "warning")),
    _wide("stale", "aged", "symbol || '.'", ("symbol", "days_stale")),
    _wide("runs", "last_runs", "run_id || '.'", ("run_id", "failed_symbols")),
)), covered="""
SELECT source, count(*) AS rows, count(DISTINCT symbol) AS distinct_symbols, min(trade_date) AS oldest_trade_date,
       max(trade_date) AS newest_trade_date FROM bars2 GROUP BY GROUPING SETS ((), (source))
""", score_cover="""
SELECT count(DISTINCT symbol) AS distinct_symbols, count(*) AS total_rows,
       count(*) FILTER (day >= as_of - 6) AS rows_last_7_days, max(day) AS latest_as_of_date
FROM (SELECT symbol, DATE '2001-11-04' AS day FROM scan_now
      UNION ALL SELECT symbol, DATE '2001-08-06' FROM scan_before) CROSS JOIN today
""", listed="SELECT exchange, count(*) AS instruments FROM instruments GROUP BY ROLLUP (exchange)",
members="""
SELECT 'Large Turnover' AS index_name, count(*) FILTER (to_date IS NULL) AS active_members, count(*) AS total_periods,
       min(from_date) AS earliest_from_date, max(from_date) AS latest_from_date,
       count(*) > count(*) FILTER (to_date IS NULL) AS historical_backfill_ready, CAST(NULL AS VARCHAR) AS warning
FROM periods
""", aged="""
SELECT symbol, max(as_of) + 1 - max(trade_date) AS days_stale FROM bars2 CROSS JOIN today GROUP BY symbol
HAVING max(as_of) + 1 - max(trade_date) > 5 ORDER BY max(trade_date), symbol LIMIT 20
""", run_days=_RUN_DAYS, last_runs="SELECT run_id, failed_symbols FROM run_days ORDER BY trade_date DESC LIMIT 10"))
def data_health_bundle(t: Tables) -> DataFrame:
    return bundles.data_health(
        t.bars_two_source, operations.score_series(t), state.instruments(t), backtests.membership(t),
        operations.runs(t), F.date_add(t.as_of, 1),
    )


# --- stored flows, instruments and index lists ------------------------------------------------------

@query("stored_flows_refresh", "L13 U5 S13", sql("""
SELECT trade_date, participant, CASE WHEN year(trade_date) >= 1998 THEN net_value_cr * 2 ELSE net_value_cr END
  AS net_value_cr FROM flows
"""), "net_value_cr", 9)
def stored_flows_refresh(t: Tables) -> DataFrame:
    """Two deliveries of payloads; the second revises the later years, whose partitions alone are rewritten."""
    root, flows = shared_path(t.spark, "flows"), t.market_flows
    revised = flows.where(F.year("trade_date") >= 1998).withColumns(
        {c: F.col(c) * 2 for c in ("buy_value_cr", "sell_value_cr", "net_value_cr")}
    )
    for rows in (flows, revised):
        done = imports.refresh_market_flows(operations.payloads(rows), root)
    return done.select("trade_date", "participant", "net_value_cr")


@query("stored_instrument_sync", "L13 U6 S15", sql("""
SELECT exchange, tradingsymbol, segment, CASE WHEN p_size >= 20 THEN 50 ELSE 1 END::BIGINT AS lot_size FROM instruments
"""))
def stored_instrument_sync(t: Tables) -> DataFrame:
    root, known = shared_path(t.spark, "instruments"), state.instruments(t)
    size = t.read("part").where(F.col("p_size") >= 20).select(F.col("p_partkey").alias("instrument_token"))
    imports.sync_instruments(known, root, "20240101T0900")
    fresh = known.join(size, "instrument_token", "left_semi").withColumn("lot_size", F.lit(50))
    return imports.sync_instruments(fresh, root, "20240102T0900").select("exchange", "tradingsymbol", "segment", "lot_size")


@query("stored_membership_refresh", "L13 U12", sql("""
SELECT coalesce(o.symbol, n.symbol) AS symbol, coalesce(o.from_date, DATE '2001-10-01') AS from_date,
       CASE WHEN n.symbol IS NULL THEN DATE '2001-09-30' END AS to_date, n.symbol IS NOT NULL AS active
FROM (SELECT DISTINCT symbol, DATE '2001-07-01' AS from_date FROM snapshots
      WHERE snapshot_date = DATE '2001-07-01') AS o
FULL JOIN (SELECT DISTINCT symbol FROM snapshots WHERE snapshot_date = DATE '2001-10-01') AS n ON n.symbol = o.symbol
"""))
def stored_membership_refresh(t: Tables) -> DataFrame:
    root, snaps = shared_path(t.spark, "members"), backtests.membership_snapshots(t)
    empty = periods_from_snapshots(snaps.limit(0), backtests.INDEX, "derived")
    empty.write.parquet(f"{root}/index_membership_history")
    for date in ("2001-07-01", "2001-10-01"):
        today = snaps.where(F.col("snapshot_date") == F.lit(date).cast("date")).drop("snapshot_date")
        effective = F.lit(date).cast("date")
        done = imports.refresh_index_membership(today, root, backtests.INDEX, effective, "derived")
    return done.select("symbol", "from_date", "to_date", "active")
