"""SQL building blocks for the oracles: named table expressions with dependencies."""

from __future__ import annotations

import re

PARTS: dict[str, str] = {}


def part(name: str, sql: str) -> None:
    PARTS[name] = sql.strip()


def sql(body: str, **override: str) -> str:
    """``body`` with every table expression it (transitively) names put in front.

    ``override`` replaces single expressions, such as the bars the rest builds on.
    """
    parts = {**PARTS, **override}
    needed: list[str] = []

    def named(text: str) -> list[str]:
        return [w for w in re.findall(r"\b(?:FROM|JOIN)\s+([a-z_0-9]+)", text) if w in parts]

    def visit(name: str, above: tuple[str, ...]) -> None:
        for other in named(parts[name]):
            if other != name and other not in above:
                visit(other, (*above, name))
        if name not in needed:
            needed.append(name)

    for name in named(body):
        visit(name, ())
    if not needed:
        return body
    loops = {n for n in needed if n in named(parts[n])}
    heads = ",\n".join(
        f"{n} AS {'' if n in loops else 'MATERIALIZED '}(\n{parts[n]}\n)" for n in needed
    )
    return f"WITH {'RECURSIVE ' if loops else ''}{heads}\n{body.strip()}"


def half_up(value: str, digits: int) -> str:
    """Rounded, halves up on the decimal text, without the noise of a sum."""
    return f"CAST(round(CAST(round({value}, 9) AS DECIMAL(38, 9)), {digits}) AS DOUBLE)"


part("lines", """
SELECT 'S' || l_suppkey || '.NS' AS symbol, CAST(l_shipdate AS DATE) AS trade_date,
       l_extendedprice / nullif(l_quantity, 0) AS px, l_extendedprice * (1 - l_discount) AS net,
       CAST(year(CAST(l_shipdate AS DATE) + INTERVAL 9 MONTH) AS BIGINT) AS fiscal_year,
       CAST(quarter(CAST(l_shipdate AS DATE) - INTERVAL 3 MONTH) AS BIGINT) AS fiscal_quarter,
       l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount,
       l_tax, l_returnflag, l_linestatus
FROM lineitem
""")

_OHLCV = """
       first(px ORDER BY l_orderkey, l_linenumber, l_partkey) AS open, max(px) AS high,
       min(px) AS low, last(px ORDER BY l_orderkey, l_linenumber, l_partkey) AS close,
       sum(l_quantity) AS volume
"""
part("bars", f"SELECT symbol, trade_date, {_OHLCV} FROM lines GROUP BY symbol, trade_date")
part("bars2", f"""
SELECT symbol, trade_date, CASE l_linestatus WHEN 'F' THEN 'kite' ELSE 'yfinance' END AS source,
       {_OHLCV} FROM lines GROUP BY symbol, trade_date, l_linestatus
""")
part("today", "SELECT max(trade_date) AS as_of FROM lines")
part("universe", """
SELECT 'S' || s_suppkey || '.NS' AS symbol, s_name AS name, r_name AS sector, n_name AS industry,
       CASE WHEN s_acctbal < 2000 THEN 'small' WHEN s_acctbal < 6000 THEN 'mid' ELSE 'large' END
         AS market_cap_bucket
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")


def _statement(keys: str) -> str:
    return f"""
SELECT symbol, {keys}, revenue, gross_profit, cost_of_revenue, gross_profit - tax AS ebit,
       gross_profit - tax + ep * 0.01 AS ebitda, gross_profit - tax - disc AS net_income,
       cash_in - tax AS operating_cash_flow, ep * -0.02 AS capital_expenditure,
       revenue + 100 * qty AS total_assets, total_liabilities, current_assets,
       current_liabilities, shares_outstanding,
       (gross_profit - tax - disc) / nullif(shares_outstanding, 0) AS eps
FROM (
  SELECT symbol, {keys}, sum(net) AS revenue,
         sum(net) FILTER (l_returnflag <> 'R') AS gross_profit,
         sum(net) FILTER (l_returnflag = 'R') AS cost_of_revenue,
         sum(l_extendedprice * l_tax) AS tax, sum(l_extendedprice * l_discount) AS disc,
         sum(l_extendedprice) AS ep, sum(net) FILTER (l_linestatus <> 'O') AS cash_in,
         sum(l_quantity) AS qty,
         sum(l_extendedprice) FILTER (l_returnflag = 'R') AS total_liabilities,
         sum(l_extendedprice) FILTER (l_linestatus = 'O') AS current_assets,
         sum(l_extendedprice) FILTER (l_returnflag = 'R' AND l_linestatus = 'O')
           AS current_liabilities,
         CAST(count(DISTINCT l_partkey) AS DOUBLE) AS shares_outstanding
  FROM lines GROUP BY symbol, {keys})
"""


part("annual_base", _statement("fiscal_year"))
part("annual", """
SELECT a.*, sum(net_income) OVER (PARTITION BY symbol ORDER BY fiscal_year
              ROWS UNBOUNDED PRECEDING) AS retained_earnings,
       make_date(fiscal_year, 3, 31) AS period_end,
       total_liabilities * 0.5 - current_assets * 0.1 AS net_debt,
       total_assets - total_liabilities AS book_value, CAST(NULL AS DOUBLE) AS free_cash_flow,
       total_liabilities * -0.05 AS interest_expense, current_assets * 0.4 AS accounts_receivable,
       current_assets * 0.3 AS inventory, current_liabilities * 0.5 AS accounts_payable,
       'derived' AS source
FROM annual_base AS a
""")
part("quarterly", _statement("fiscal_year, fiscal_quarter"))
part("annual2", """
SELECT symbol, fiscal_year, 'A' AS source, revenue, net_income, ebitda, eps,
       operating_cash_flow, total_assets FROM annual
UNION ALL
SELECT symbol, fiscal_year, 'B', revenue * (1 + 0.03 * (CAST(regexp_extract(symbol, '(\\d+)', 1)
       AS BIGINT) % 4)), net_income, ebitda, eps, operating_cash_flow, total_assets FROM annual
""")
part("splits", """
SELECT 'S' || s_suppkey || '.NS' AS symbol, DATE '1998-01-01' + CAST(s_suppkey % 1000 AS INTEGER)
       AS ex_date, 2.0::DOUBLE AS value, 'split' AS action_type FROM supplier WHERE s_suppkey % 4 = 0
UNION ALL
SELECT 'S' || s_suppkey || '.NS', DATE '2000-01-01' + CAST(s_suppkey % 1000 AS INTEGER), 5.0, 'split'
FROM supplier WHERE s_suppkey % 8 = 0
""")
part("earnings", """
SELECT DISTINCT symbol, make_date(fiscal_year, 3, 31) AS event_date FROM lines
""")
part("delivery", """
SELECT symbol, trade_date,
       100.0 * coalesce(sum(l_quantity) FILTER (l_returnflag <> 'R'), 0) / sum(l_quantity)
         AS delivery_pct
FROM lines GROUP BY symbol, trade_date
""")
part("flows", """
SELECT CAST(o_orderdate AS DATE) AS trade_date,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'FII' ELSE 'DII' END AS participant,
       coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 0) / 1e7 AS buy_value_cr,
       coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0) / 1e7 AS sell_value_cr,
       coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 0) / 1e7
         - coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0) / 1e7 AS net_value_cr
FROM orders GROUP BY 1, 2
""")

# Indicators: row-by-row recursion for the smoothed ones, plain frames for the rest.
part("num", """
SELECT symbol, trade_date, open, high, low, close, volume,
       row_number() OVER w AS n, count(*) OVER (PARTITION BY symbol) AS bar_count,
       lag(close) OVER w AS prior_close,
       greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)
""")
part("ew", """
SELECT symbol, n, close AS e12, close AS e26, close AS e20, close AS e50, close AS e100,
       close AS e200, CAST(NULL AS DOUBLE) AS gain, CAST(NULL AS DOUBLE) AS loss, tr AS atr,
       CAST(NULL AS DOUBLE) AS sig
FROM num WHERE n = 1
UNION ALL
SELECT b.symbol, b.n, e.e12 + (b.close - e.e12) * 2 / 13, e.e26 + (b.close - e.e26) * 2 / 27,
       e.e20 + (b.close - e.e20) * 2 / 21, e.e50 + (b.close - e.e50) * 2 / 51,
       e.e100 + (b.close - e.e100) * 2 / 101, e.e200 + (b.close - e.e200) * 2 / 201,
       CASE WHEN b.n = 2 THEN greatest(b.close - b.prior_close, 0)
            ELSE e.gain * 13 / 14 + greatest(b.close - b.prior_close, 0) / 14 END,
       CASE WHEN b.n = 2 THEN greatest(b.prior_close - b.close, 0)
            ELSE e.loss * 13 / 14 + greatest(b.prior_close - b.close, 0) / 14 END,
       e.atr * 13 / 14 + b.tr / 14,
       CASE WHEN b.n < 26 THEN NULL
            WHEN b.n = 26 THEN (e.e12 + (b.close - e.e12) * 2 / 13)
                               - (e.e26 + (b.close - e.e26) * 2 / 27)
            ELSE e.sig * 0.8 + 0.2 * ((e.e12 + (b.close - e.e12) * 2 / 13)
                               - (e.e26 + (b.close - e.e26) * 2 / 27)) END
FROM ew AS e JOIN num AS b ON b.symbol = e.symbol AND b.n = e.n + 1
""")
part("rolled", """
SELECT num.*,
       CASE WHEN n >= 20 THEN avg(close) OVER (w ROWS 19 PRECEDING) END AS sma_20,
       CASE WHEN n >= 50 THEN avg(close) OVER (w ROWS 49 PRECEDING) END AS sma_50,
       CASE WHEN n >= 100 THEN avg(close) OVER (w ROWS 99 PRECEDING) END AS sma_100,
       CASE WHEN n >= 200 THEN avg(close) OVER (w ROWS 199 PRECEDING) END AS sma_200,
       CASE WHEN n >= 20 THEN stddev_samp(close) OVER (w ROWS 19 PRECEDING) END AS std_20,
       CASE WHEN n >= 21 THEN stddev_samp(close / prior_close - 1) OVER (w ROWS 19 PRECEDING)
            * sqrt(252) * 100 END AS historical_volatility_20,
       CASE WHEN n >= 20 THEN avg(volume) OVER (w ROWS 19 PRECEDING) END AS avg_volume_20,
       CASE WHEN n >= 20 THEN max(high) OVER (w ROWS 251 PRECEDING) END AS high_52w,
       CASE WHEN n >= 20 THEN min(low) OVER (w ROWS 251 PRECEDING) END AS low_52w,
       max(high) OVER (w ROWS UNBOUNDED PRECEDING) AS all_time_high,
       max(high) OVER (w ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) AS prior_high,
       CASE WHEN n > 252 THEN max(high) OVER (w ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) END
         AS prior_high_252,
       CASE WHEN n > 120 THEN max(high) OVER (w ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING) END
         AS prior_high_120,
       max(high) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS prior_high_20,
       min(low) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS prior_low_20,
       avg(close * volume) OVER (w ROWS 19 PRECEDING) AS traded_value_20
FROM num WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)
""")
part("ind", """
SELECT r.*, CASE WHEN r.n >= 20 THEN e20 END AS ema_20, CASE WHEN r.n >= 50 THEN e50 END AS ema_50,
       CASE WHEN r.n >= 100 THEN e100 END AS ema_100, CASE WHEN r.n >= 200 THEN e200 END AS ema_200,
       CASE WHEN r.n < 15 THEN NULL WHEN loss = 0 THEN 100
            ELSE 100 - 100 / (1 + gain / loss) END AS rsi_14,
       CASE WHEN r.n >= 26 THEN e12 - e26 END AS macd,
       CASE WHEN r.n >= 34 THEN sig END AS macd_signal,
       CASE WHEN r.n >= 34 THEN e12 - e26 - sig END AS macd_hist,
       sma_20 AS bb_mid, sma_20 + 2 * std_20 AS bb_upper, sma_20 - 2 * std_20 AS bb_lower,
       CASE WHEN r.n >= 14 THEN atr END AS atr_14,
       CASE WHEN r.n >= 14 THEN atr / nullif(close, 0) * 100 END AS atr_pct,
       volume / nullif(avg_volume_20, 0) AS relative_volume,
       (close - high_52w) / high_52w * 100 AS distance_from_52w_high_pct,
       (close - low_52w) / low_52w * 100 AS distance_from_52w_low_pct,
       (close - all_time_high) / all_time_high * 100 AS distance_from_all_time_high_pct,
       CASE WHEN sma_20 > sma_50 AND sma_50 > sma_100 AND sma_100 > sma_200 THEN 'bullish'
            WHEN sma_20 < sma_50 AND sma_50 < sma_100 AND sma_100 < sma_200 THEN 'bearish'
            ELSE 'mixed' END AS ma_stack_status,
       lag(sma_50) OVER w AS prior_sma_50, lag(sma_200) OVER w AS prior_sma_200
FROM rolled AS r JOIN ew USING (symbol, n)
WINDOW w AS (PARTITION BY r.symbol ORDER BY r.trade_date)
""")

# Fixed order of the seven rules.
SIGNAL_CONDITIONS = {
    "200 EMA Pullback": "close > ema_200 AND abs((close - ema_200) / ema_200 * 100) <= 3 "
                        "AND rsi_14 BETWEEN 40 AND 50",
    "RSI 60 Momentum": "close > ema_50 AND rsi_14 >= 60",
    "Breakout With Volume": "close > prior_high AND relative_volume >= 2",
    "Darvas Base Breakout": "n > 20 AND (prior_high_20 - prior_low_20) / nullif(prior_low_20, 0)"
                            " * 100 <= 10 AND close > prior_high_20",
    "Mean-Reversion Oversold": "close < bb_lower AND rsi_14 < 30",
    "MA Stack": "close > ema_20 AND ema_20 > ema_50 AND ema_50 > ema_200",
    "Golden/Death Cross": "(sma_50 > sma_200 AND prior_sma_50 <= prior_sma_200) OR "
                          "(sma_50 < sma_200 AND prior_sma_50 >= prior_sma_200)",
}
SIGNAL_STRENGTH = dict(
    zip(SIGNAL_CONDITIONS,
        ("trend", "momentum", "breakout", "structure", "mean_reversion", "trend", "trend"),
        strict=True)
)
part("sig_all", "\nUNION ALL\n".join(
    f"SELECT ind.*, '{name}' AS signal, '{SIGNAL_STRENGTH[name]}' AS strength, {i} AS place, "
    f"coalesce({condition}, false) AS active FROM ind"
    for i, (name, condition) in enumerate(SIGNAL_CONDITIONS.items())
))
part("events_all", "SELECT * FROM sig_all WHERE active")
part("last_sig", """
SELECT symbol, count(*) FILTER (active) AS active_signal_count,
       coalesce(string_agg(signal, '; ' ORDER BY place) FILTER (active), '') AS active_signals
FROM sig_all WHERE n = bar_count GROUP BY symbol
""")
