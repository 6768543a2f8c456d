"""Bars, split adjustment, indicators and price structure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.bridge import Tables
from tickloom.operators.adjustments import apply_split_adjustment
from tickloom.operators.strategies import dedupe_sources
from tickloom.operators.structure import latest_swing_levels, support_resistance, swing_pivots
from tickloom.operators.technicals import INDICATORS, add_technical_indicators
from tickloom.queries.registry import query
from tickloom.queries.sqlbase import part, sql
from tickloom.sources import readers

PRICE = "open high low close volume"


def indicators(t: Tables) -> DataFrame:
    return add_technical_indicators(t.bars)


def _pick(*names: str):
    def build(t: Tables) -> DataFrame:
        return indicators(t).select("symbol", "trade_date", *names)

    return build


@query("daily_bars", "S1 T3", sql(
    "SELECT symbol, trade_date, open, high, low, close, volume, close AS adj_close FROM bars"))
def daily_bars(t: Tables) -> DataFrame:
    return readers.price_daily(t.bars)


@query("source_price_scan", "S1 P36", sql(
    "SELECT symbol, trade_date, open, high, low, close, volume, source, close AS adj_close "
    "FROM bars2 WHERE source = 'kite' AND trade_date >= DATE '1997-01-01'"))
def source_price_scan(t: Tables) -> DataFrame:
    return readers.price_daily(t.bars_two_source, start="1997-01-01", source="kite").select(
        "symbol", "trade_date", *PRICE.split(), "source", "adj_close"
    )


# These come straight from prices and whole volumes, so they are compared unrounded.
_PLAIN = ("relative_volume", "price_extremes")
for _name, _ids, _columns in (
    ("sma", "W1", "sma_20 sma_50 sma_100 sma_200"),
    ("ema", "W2", "ema_20 ema_50 ema_100 ema_200"),
    ("rsi", "W3", "rsi_14"),
    ("macd", "W4", "macd macd_signal macd_hist"),
    ("bollinger", "W5", "bb_mid bb_upper bb_lower"),
    ("atr", "W6", "atr_14 atr_pct"),
    ("historical_volatility", "W7", "historical_volatility_20"),
    ("relative_volume", "W8", "avg_volume_20 relative_volume"),
    ("price_extremes", "W9", "high_52w low_52w all_time_high distance_from_52w_high_pct "
     "distance_from_52w_low_pct distance_from_all_time_high_pct"),
):
    query(_name, _ids, sql(
        f"SELECT symbol, trade_date, {', '.join(_columns.split())} FROM ind"),
        "" if _name in _PLAIN else _columns, 3)(
        _pick(*_columns.split()))

query("ma_stack", "W10", sql("SELECT symbol, trade_date, ma_stack_status FROM ind"))(
    _pick("ma_stack_status"))
_SUMS = (
    "sma_20 sma_50 sma_100 sma_200 ema_20 ema_50 ema_100 ema_200 rsi_14 macd macd_signal macd_hist "
    "bb_mid bb_upper bb_lower atr_14 atr_pct historical_volatility_20"
)
query("technical_indicators", "L1", sql(
    f"SELECT symbol, trade_date, close, {', '.join(INDICATORS)} FROM ind"),
    _SUMS, 3)(_pick("close", *INDICATORS))


part("factors", """
SELECT symbol, trade_date, coalesce((SELECT product(value) FROM splits s
       WHERE s.symbol = b.symbol AND s.ex_date > b.trade_date AND s.value > 0), 1) AS f,
       open, high, low, close, volume FROM bars AS b
""")


@query("split_adjusted_bars", "J2 F8", sql(
    "SELECT symbol, trade_date, open / f AS open, high / f AS high, low / f AS low, "
    "close / f AS close, volume * f AS volume, close / f AS adj_close, f AS adjustment_factor "
    "FROM factors"))
def split_adjusted_bars(t: Tables) -> DataFrame:
    return apply_split_adjustment(t.bars, t.splits).select(
        "symbol", "trade_date", *PRICE.split(), "adj_close", "adjustment_factor"
    )


part("best_source", """
SELECT symbol, trade_date, arg_max(close, CASE source WHEN 'kite' THEN 2 ELSE 1 END) AS close,
       max(CASE source WHEN 'kite' THEN 2 ELSE 1 END) AS p FROM bars2 GROUP BY 1, 2
""")


@query("mixed_source_prices", "W16", sql("""
SELECT symbol, trade_date, close, CASE p WHEN 2 THEN 'kite' ELSE 'yfinance' END AS source,
       CASE WHEN n > 1 THEN 'mixed' ELSE one END AS source_label
FROM best_source JOIN (SELECT symbol, count(DISTINCT source) AS n, max(source) AS one FROM bars2
                       GROUP BY symbol) USING (symbol)
"""))
def mixed_source_prices(t: Tables) -> DataFrame:
    return dedupe_sources(t.bars_two_source).select(
        "symbol", "trade_date", "close", "source", "source_label"
    )


@query("last_bars_per_symbol", "O10", sql("""
SELECT symbol, trade_date, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol
  ORDER BY trade_date DESC) AS p FROM bars) WHERE p <= 30
"""))
def last_bars_per_symbol(t: Tables) -> DataFrame:
    from tickloom.operators.windows import latest_rows

    return latest_rows(t.bars, 30).select("symbol", "trade_date", "close")


def _pivots(source: str) -> str:
    return f"""
SELECT *, n > 5 AND n <= total - 5 AND high > hl AND high > hr AS swing_high,
       n > 5 AND n <= total - 5 AND low < ll AND low < lr AS swing_low
FROM (
  SELECT symbol, trade_date, high, low, close, row_number() OVER w AS n,
         count(*) OVER (PARTITION BY symbol) AS total,
         max(high) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS hl,
         max(high) OVER (w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS hr,
         min(low) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS ll,
         min(low) OVER (w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS lr
  FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY trade_date))
"""


part("pivots", _pivots("bars"))
part("recent", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS p
               FROM bars) WHERE p <= 252
""")
part("recent_pivots", _pivots("recent"))


@query("swing_pivots", "W19", sql(
    "SELECT symbol, trade_date, high, low, swing_high, swing_low FROM pivots "
    "WHERE swing_high OR swing_low"))
def pivots(t: Tables) -> DataFrame:
    return swing_pivots(t.bars).where("swing_high or swing_low").select(
        "symbol", "trade_date", "high", "low", "swing_high", "swing_low"
    )


@query("latest_swing_levels", "W20", sql("""
SELECT symbol, arg_max(high, trade_date) FILTER (swing_high) AS last_swing_high,
       arg_max(low, trade_date) FILTER (swing_low) AS last_swing_low FROM pivots GROUP BY symbol
"""))
def swing_levels(t: Tables) -> DataFrame:
    return latest_swing_levels(t.bars)


# Greedy clustering as a row-by-row walk over the sorted prices of one side.
part("levels", """
SELECT symbol, side, price, row_number() OVER (PARTITION BY symbol, side ORDER BY price) AS i FROM (
  SELECT symbol, 'r' AS side, high AS price FROM recent_pivots WHERE swing_high
  UNION ALL SELECT symbol, 's', low FROM recent_pivots WHERE swing_low)
""")
part("walk", """
SELECT symbol, side, i, 1 AS cluster, price AS total, CAST(1 AS BIGINT) AS members
FROM levels WHERE i = 1
UNION ALL
SELECT l.symbol, l.side, l.i,
       w.cluster + CASE WHEN abs(l.price - w.total / w.members) / (w.total / w.members) * 100 <= 1.5
                        THEN 0 ELSE 1 END,
       CASE WHEN abs(l.price - w.total / w.members) / (w.total / w.members) * 100 <= 1.5
            THEN w.total + l.price ELSE l.price END,
       CASE WHEN abs(l.price - w.total / w.members) / (w.total / w.members) * 100 <= 1.5
            THEN w.members + 1 ELSE 1 END
FROM walk AS w JOIN levels AS l ON l.symbol = w.symbol AND l.side = w.side AND l.i = w.i + 1
""")
part("zones", """
SELECT symbol, side, cluster, arg_max(total / members, i) AS zone FROM walk GROUP BY 1, 2, 3
""")
part("last_close", "SELECT symbol, arg_max(close, trade_date) AS last_close FROM bars GROUP BY 1")


@query("support_resistance_zones", "W21", sql("""
SELECT c.symbol, last_close,
       coalesce(array_to_string(list_transform(list(zone ORDER BY zone DESC)
         FILTER (side = 's' AND zone < last_close)[1:5], lambda x: printf('%.9f', x)), '; '), '')
         AS support,
       coalesce(array_to_string(list_transform(list(zone ORDER BY zone)
         FILTER (side = 'r' AND zone > last_close)[1:5], lambda x: printf('%.9f', x)), '; '), '')
         AS resistance
FROM last_close AS c LEFT JOIN zones AS z ON z.symbol = c.symbol GROUP BY 1, 2
"""))
def zones(t: Tables) -> DataFrame:
    return support_resistance(t.bars)


@query("indicator_refresh_window", "W25 U2 U15", sql("""
SELECT symbol, trade_date AS as_of_date, sma_20, ema_20, rsi_14 FROM ind CROSS JOIN today
WHERE trade_date >= as_of - 5 AND coalesce(sma_20, ema_20, rsi_14) IS NOT NULL
"""), "sma_20 ema_20 rsi_14")
def indicator_refresh_window(t: Tables) -> DataFrame:
    """Indicators over the full history, written only for the re-read days."""
    from tickloom.operators.upsert import clean_snapshots

    df = indicators(t).select(
        "symbol", F.col("trade_date").alias("as_of_date"), "sma_20", "ema_20", "rsi_14"
    )
    return clean_snapshots(df, ["sma_20", "ema_20", "rsi_14"], F.date_sub(t.as_of, 5))


# --- missing closes ----------------------------------------------------------------------------

part("gapbars", """
SELECT symbol, trade_date, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS n,
       CASE WHEN (trade_date - DATE '1970-01-01') % 33 <> 0 THEN close END AS c
FROM bars
""")
part("gapema", """
SELECT symbol, n, c AS y, CASE WHEN c IS NULL THEN 0 ELSE 1 END AS seen, 1.0::DOUBLE AS w
FROM gapbars WHERE n = 1
UNION ALL
SELECT b.symbol, b.n,
       CASE WHEN b.c IS NULL THEN e.y WHEN e.y IS NULL THEN b.c
            ELSE (e.w * (1 - 2.0 / 21) * e.y + 2.0 / 21 * b.c) / (e.w * (1 - 2.0 / 21) + 2.0 / 21) END,
       e.seen + CASE WHEN b.c IS NULL THEN 0 ELSE 1 END,
       CASE WHEN b.c IS NULL AND e.y IS NOT NULL THEN e.w * (1 - 2.0 / 21) ELSE 1.0 END
FROM gapema AS e JOIN gapbars AS b ON b.symbol = e.symbol AND b.n = e.n + 1
""")


@query("indicators_with_gaps", "W1 W2 W5 W7", sql("""
SELECT b.symbol, b.trade_date, b.close, sma_20, CASE WHEN e.seen >= 20 THEN e.y END AS ema_20,
       sma_20 + 2 * std20 AS bb_upper,
       CASE WHEN n_ret = 20 THEN ret_std * sqrt(252) * 100 END AS historical_volatility_20
FROM (
  SELECT symbol, trade_date, n, c AS close, CASE WHEN count(c) OVER w = 20 THEN avg(c) OVER w END AS sma_20,
         CASE WHEN count(c) OVER w = 20 THEN stddev_samp(c) OVER w END AS std20,
         count(ret) OVER w AS n_ret, stddev_samp(ret) OVER w AS ret_std
  FROM (
    SELECT *, padded / lag(padded) OVER (PARTITION BY symbol ORDER BY n) - 1 AS ret FROM (
      SELECT *, last_value(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY n) AS padded
      FROM gapbars) AS p) AS r
  WINDOW w AS (PARTITION BY symbol ORDER BY n ROWS 19 PRECEDING)) AS b
JOIN gapema AS e ON e.symbol = b.symbol AND e.n = b.n
"""), "sma_20 ema_20 bb_upper historical_volatility_20")
def indicators_with_gaps(t: Tables) -> DataFrame:
    """Indicators where about one close in 33 is missing."""
    kept = F.datediff("trade_date", F.lit("1970-01-01").cast("date")) % 33 != 0
    bars = t.bars.withColumn("close", F.when(kept, F.col("close")))
    return add_technical_indicators(bars).select(
        "symbol", "trade_date", "close", "sma_20", "ema_20", "bb_upper",
        "historical_volatility_20",
    )
