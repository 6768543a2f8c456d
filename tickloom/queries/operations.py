"""Flows, events, data quality, scoring, state summaries and the nightly refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.bridge import Tables
from tickloom.functions.scalars import business_days_after, days_until
from tickloom.operators import flows as fl
from tickloom.operators import ops
from tickloom.operators import quality as ql
from tickloom.operators.scoring import research_stance, score_stocks
from tickloom.operators.signals import latest_with_signals
from tickloom.operators.technicals import last_indicators
from tickloom.operators.upsert import KEYS, keep_latest, store_by_year
from tickloom.plans.pipelines import composite_inputs, refresh_eod, start_indicators
from tickloom.queries import backtests, companies, state
from tickloom.queries.registry import query
from tickloom.queries.sqlbase import half_up, part, sql
from tickloom.session import materialise, shared_path
from tickloom.sources import readers

BANKS = ("NATION_1", "NATION_12")

# --- flows and events ---------------------------------------------------------------

part("delivered", f"""
SELECT *, CASE WHEN n20 >= 5 THEN {half_up('avg20', 2)} END AS ma20,
       CASE WHEN n20 >= 5 THEN {half_up('(delivery_pct - avg20) / nullif(std20, 0)', 2)} + 0.0 END AS z
FROM (SELECT symbol, trade_date, delivery_pct, count(*) OVER w AS n20,
             avg(delivery_pct) OVER w AS avg20, stddev_samp(delivery_pct) OVER w AS std20,
             row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS back
      FROM delivery
      WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS 19 PRECEDING))
""")


@query("delivery_analytics", "W11", sql("""
SELECT symbol, trade_date, delivery_pct, ma20 AS delivery_pct_ma20, z AS delivery_pct_zscore,
       coalesce(delivery_pct >= 40 AND delivery_pct > 1.5 * ma20, false) AS unusual_delivery
FROM delivered
"""), "delivery_pct delivery_pct_ma20 delivery_pct_zscore")
def delivery_analytics(t: Tables) -> DataFrame:
    return fl.delivery_analytics(t.delivery)


part("delivery_summary", f"""
SELECT symbol, {half_up('max(delivery_pct) FILTER (back = 1)', 1)} AS latest_pct,
       {half_up('max(ma20) FILTER (back = 1)', 1)} AS ma20_pct, {half_up('avg(delivery_pct)', 1)} AS avg_90d_pct,
       CASE WHEN count(*) < 10 THEN NULL
            WHEN avg(delivery_pct) FILTER (back <= 5)
                 > avg(delivery_pct) FILTER (back BETWEEN 6 AND 10) * 1.05 THEN 'rising'
            WHEN avg(delivery_pct) FILTER (back <= 5)
                 < avg(delivery_pct) FILTER (back BETWEEN 6 AND 10) * 0.95 THEN 'falling'
            ELSE 'flat' END AS trend,
       coalesce(bool_or(delivery_pct >= 40 AND delivery_pct > 1.5 * ma20) FILTER (back = 1), false)
         AS unusual_today, count(*) AS days_with_data
FROM delivered GROUP BY symbol
""")


@query("delivery_stats", "A6", sql("SELECT * FROM delivery_summary"),
       "latest_pct ma20_pct avg_90d_pct")
def delivery_stats(t: Tables) -> DataFrame:
    return fl.delivery_stats(t.delivery)


part("snapshot_flows", """
SELECT participant, max(trade_date) AS latest_date,
       max(net_value_cr) FILTER (back = 1) AS latest_net_cr,
       sum(net_value_cr) FILTER (back <= 5) AS rolling_5d_net_cr,
       sum(net_value_cr) FILTER (back <= 20) AS rolling_20d_net_cr
FROM (SELECT *, row_number() OVER (PARTITION BY participant ORDER BY trade_date DESC) AS back
      FROM flows) GROUP BY participant
""")
part("flow_trends", """
SELECT *, CASE WHEN rolling_5d_net_cr > 0 AND rolling_20d_net_cr > 0
                    AND rolling_5d_net_cr / 5 >= rolling_20d_net_cr / 20 * 0.5 THEN 'bullish'
               WHEN rolling_5d_net_cr < 0 AND rolling_20d_net_cr < 0
                    AND rolling_5d_net_cr / 5 <= rolling_20d_net_cr / 20 * 0.5 THEN 'bearish'
               ELSE 'neutral' END AS trend FROM snapshot_flows
""")
part("market", """
SELECT max(trend) FILTER (participant = 'FII') AS fii_trend,
       max(trend) FILTER (participant = 'DII') AS dii_trend,
       CAST(CASE WHEN count(*) FILTER (trend = 'bullish') = 2 THEN 80
            WHEN count(*) FILTER (trend = 'bullish') = 1
                 AND count(*) FILTER (trend = 'bearish') = 0 THEN 65
            WHEN count(*) FILTER (trend = 'bullish') = 1 THEN 50
            WHEN count(*) FILTER (trend = 'bearish') = 1 THEN 40
            WHEN count(*) FILTER (trend = 'bearish') = 2 THEN 25 ELSE 50 END AS DOUBLE)
         AS market_score
FROM flow_trends
""")


@query("institutional_snapshots", "A4 T4", sql("SELECT * FROM flow_trends"),
       "latest_net_cr rolling_5d_net_cr rolling_20d_net_cr", 7)
def institutional_snapshots(t: Tables) -> DataFrame:
    return fl.institutional_snapshots(t.market_flows)


@query("institutional_score", "A5", sql("SELECT * FROM market"))
def institutional_score(t: Tables) -> DataFrame:
    return fl.institutional_score(fl.institutional_snapshots(t.market_flows))


part("near", """
SELECT n.symbol, n.trade_date, tr, EXISTS (
         SELECT 1 FROM earnings AS e JOIN span AS s ON s.symbol = e.symbol
         WHERE e.symbol = n.symbol AND e.event_date BETWEEN s.first_day AND s.last_day
           AND n.trade_date BETWEEN e.event_date - 10 AND e.event_date + 10) AS near_event
FROM num AS n
""")
part("span", """
SELECT symbol, min(trade_date) AS first_day, max(trade_date) AS last_day FROM bars GROUP BY symbol
""")
part("volatility", f"""
SELECT n.symbol, CASE WHEN i >= 2 AND o >= 10 THEN {half_up('event_atr', 2)} END AS event_atr,
       CASE WHEN i >= 2 AND o >= 10 THEN {half_up('base_atr', 2)} END AS baseline_atr,
       CASE WHEN i >= 2 AND o >= 10 AND base_atr > 0 THEN {half_up('event_atr / base_atr', 2)} END
         AS volatility_multiple, events_found
FROM (SELECT symbol, count(*) FILTER (near_event) AS i, count(*) FILTER (NOT near_event) AS o,
             avg(tr) FILTER (near_event) AS event_atr, avg(tr) FILTER (NOT near_event) AS base_atr
      FROM near GROUP BY symbol) AS n
JOIN (SELECT s.symbol, count(e.symbol) AS events_found FROM span AS s LEFT JOIN earnings AS e
        ON e.symbol = s.symbol AND e.event_date BETWEEN first_day AND last_day GROUP BY s.symbol)
  AS f ON f.symbol = n.symbol
""")


@query("bars_near_events", "J5", sql(
    "SELECT symbol, trade_date, near_event FROM near"))
def bars_near_events(t: Tables) -> DataFrame:
    return fl.near_event(t.bars, t.earnings_dates).select("symbol", "trade_date", "near_event")


@query("result_volatility", "A7", sql("SELECT * FROM volatility"),
       "event_atr baseline_atr volatility_multiple")
def result_volatility(t: Tables) -> DataFrame:
    return fl.result_volatility(t.bars, t.earnings_dates)


@query("flow_payloads", "S13", sql("""
SELECT trade_date, participant, buy_value_cr, net_value_cr FROM flows
"""), "buy_value_cr net_value_cr", 9)
def flow_payloads(t: Tables) -> DataFrame:
    """Flow tables sent as one JSON text per day (a list, or wrapped) and parsed back."""
    return readers.flows_json(payloads(t.market_flows)).select(
        "trade_date", "participant", "buy_value_cr", "net_value_cr"
    )


def payloads(f: DataFrame) -> DataFrame:
    record = F.struct(
        F.when(F.col("participant") == "FII", F.lit("FII/FPI **")).otherwise(F.lit("dii *")).alias(
            "category"),
        F.date_format("trade_date", "dd-MMM-yyyy").alias("date"),
        F.format_number("buy_value_cr", 9).alias("buyValue"),
        F.format_number("sell_value_cr", 9).alias("sellValue"),
        F.format_number("net_value_cr", 9).alias("netValue"),
    )
    noise = F.array(F.struct(
        F.lit("OTHERS").alias("category"), F.lit("01-Jan-1990").alias("date"),
        F.lit("1").alias("buyValue"), F.lit("1").alias("sellValue"), F.lit("0").alias("netValue")))
    # Two participants a day, so a day's list is tiny.
    daily = f.groupBy("trade_date").agg(F.concat(noise, F.collect_list(record)).alias("r"))
    text = F.when(F.dayofmonth("trade_date") % 2 == 0, F.to_json("r")).otherwise(
        F.to_json(F.struct(F.col("r").alias("data")))
    )
    return daily.select(text.alias("payload"))


@query("bulk_and_block_deals", "S12 E1", sql("""
SELECT symbol, trade_date AS deal_date, 'C' || l_orderkey AS client_name,
       CASE WHEN l_quantity >= 40 THEN 'BLOCK' ELSE 'BULK' END AS deal_type,
       l_quantity * 1000 AS quantity, l_extendedprice AS price FROM lines
"""))
def bulk_and_block_deals(t: Tables) -> DataFrame:
    """Line items written as exchange deal rows: day-first dates, comma numbers."""
    text = t.lines.select(
        F.col("symbol").alias("Symbol"), F.date_format("trade_date", "dd-MM-yyyy").alias("Date "),
        F.concat(F.lit("C"), F.col("l_orderkey").cast("string")).alias("Client Name"),
        F.format_number(F.col("l_quantity") * 1000, 0).alias("Quantity Traded"),
        F.format_number("l_extendedprice", 2).alias("Trade Price / Wght. Avg. Price"),
        "l_quantity",
    )
    return readers.merged_deals(
        text.where("l_quantity < 40").drop("l_quantity"),
        text.where("l_quantity >= 40").drop("l_quantity"),
    ).select("symbol", "deal_date", "client_name", "deal_type", "quantity", "price")


# --- data quality ----------------------------------------------------------------------

@query("ohlcv_validation", "A20", sql("""
SELECT u.symbol, coalesce(bars, 0) AS rows,
       CASE WHEN bars IS NULL THEN 'dataframe_empty'
            WHEN negatives > 0 THEN 'negative_values_in_close; negative_values_in_adj_close'
            ELSE '' END AS errors,
       array_to_string(list_filter([
         CASE WHEN zero > 0 THEN 'zero_volume_rows: ' || zero END,
         CASE WHEN moves > 0 THEN 'suspicious_price_moves: ' || moves
              || ' day(s) > 40.0% (possible unadjusted corporate action)' END,
         CASE WHEN as_of - last_day > 5 THEN 'stale_data: last bar is ' || (as_of - last_day)
              || ' day(s) old' END], lambda x: x IS NOT NULL), '; ') AS warnings,
       coalesce(negatives, 1) = 0 AS ok
FROM universe AS u LEFT JOIN (
  SELECT symbol, count(*) AS bars, count(*) FILTER (c < 0) AS negatives,
         count(*) FILTER (volume < 2) AS zero, max(trade_date) AS last_day,
         count(*) FILTER (abs(c / pc - 1) * 100 > 40) AS moves
  FROM (SELECT symbol, trade_date, volume, c, lag(c) OVER (PARTITION BY symbol ORDER BY trade_date)
          AS pc FROM (SELECT *, CASE WHEN close < 22 THEN -close ELSE close END AS c FROM bars))
  GROUP BY symbol) AS b ON b.symbol = u.symbol CROSS JOIN today
"""))
def ohlcv_validation(t: Tables) -> DataFrame:
    """Bars with a few negated closes and volumes of one share set to zero."""
    close, volume = F.col("close"), F.col("volume")
    bars = t.bars.withColumns(
        {
            "close": F.when(close < 22, -close).otherwise(close),
            "volume": F.when(volume < 2, F.lit(0.0)).otherwise(volume),
        }
    )
    return ql.validate_ohlcv(bars, t.as_of, t.universe)


def banking(t: Tables) -> DataFrame:
    """Bank metrics for the symbols of two industries, spread by account balance."""
    s = t.read("supplier").where(F.col("s_nationkey").isin(1, 12, 13))
    base = F.abs("s_acctbal") / 1000
    return s.select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit(".NS")).alias("symbol"),
        F.lit(2001).alias("fiscal_year"), (2 + base * 0.4).alias("nim_pct"),
        F.when(base < 8, base).alias("gnpa_pct"), (base * 0.3).alias("nnpa_pct"),
        (20 + base * 4).alias("casa_pct"), (base * 30 - 60).alias("credit_growth_pct"),
        (base * 3).alias("deposit_growth_pct"), (10 + base).alias("capital_adequacy_pct"),
        F.when(base < 5, F.lit("annual report")).otherwise(F.lit("")).alias("source"),
        F.lit("").alias("source_url"), F.lit("2001-06-30").alias("last_updated"),
    )


part("bank", """
SELECT 'S' || s_suppkey || '.NS' AS symbol, b AS base, 2 + b * 0.4 AS nim,
       CASE WHEN b < 8 THEN b END AS gnpa, b * 0.3 AS nnpa, 20 + b * 4 AS casa,
       b * 30 - 60 AS credit, b * 3 AS deposit, 10 + b AS capital
FROM (SELECT s_suppkey, s_nationkey, abs(s_acctbal) / 1000 AS b FROM supplier)
WHERE s_nationkey IN (1, 12, 13)
""")


@query("banking_validation", "A23", sql("""
SELECT symbol, CAST(1 AS BIGINT) AS rows, '' AS errors, array_to_string(list_filter([
         CASE WHEN credit < -100 OR credit > 200 THEN 'growth_outlier_credit_growth_pct' END,
         CASE WHEN gnpa IS NULL THEN 'missing_banking_metrics: [''gnpa_pct'']' END,
         CASE WHEN base >= 5 THEN 'missing_source' END, 'missing_source_url'],
         lambda x: x IS NOT NULL), '; ') AS warnings, true AS ok FROM bank
"""))
def banking_validation(t: Tables) -> DataFrame:
    return ql.validate_banking(banking(t))


# --- composite score ----------------------------------------------------------------------

def delivered(t: Tables) -> DataFrame:
    return t.once("delivery_stats", lambda: fl.delivery_stats(t.delivery))


def moved(t: Tables) -> DataFrame:
    return t.once("result_volatility", lambda: fl.result_volatility(t.bars, t.earnings_dates))


def full_inputs(t: Tables) -> DataFrame:
    industry = F.when(F.col("industry").isin(*BANKS), F.lit("Private Banks")).otherwise(
        F.col("industry")
    )
    summary = companies.summary_rows(t, True).withColumn("industry", industry)
    return composite_inputs(
        summary, banking(t), delivered(t), moved(t),
        fl.institutional_score(fl.institutional_snapshots(t.market_flows)), t.universe,
    )


def composite(t: Tables) -> DataFrame:
    t = t.with_stored_bars()
    last = latest_with_signals(last_indicators(t.bars)).select(
        "symbol", "trade_date", "close", "rsi_14", "ema_50", "ema_200", "relative_volume",
        "active_signals",
    )
    return score_stocks(full_inputs(t).join(last, "symbol", "left"))


def _scale(x: str, low: float, high: float) -> str:
    return (f"CASE WHEN {x} IS NOT NULL THEN greatest(0, least(100, ({x} - {low}) / "
            f"({high} - {low}) * 100)) END")


def _mean(*parts: str) -> str:
    items = ", ".join(f"CAST({p} AS DOUBLE)" for p in parts)
    return f"list_avg(list_filter([{items}], lambda v: v IS NOT NULL))"


part("bank_points", f"""
SELECT symbol, {_mean(
    _scale('nim', 2.5, 5), '100 - ' + _scale('gnpa', 0, 8), '100 - ' + _scale('nnpa', 0, 4),
    _scale('casa', 25, 50), _scale('capital', 12, 22),
    f"greatest(0, ({_scale('credit', -5, 25)} + {_scale('deposit', -5, 25)}) / 2 "
    "- least(35, abs(credit - deposit) * 3))")} AS points FROM bank
""")
part("sector_ranks", """
SELECT symbol, max(rank_pct) FILTER (metric = 'roe_pct') AS roe,
       max(rank_pct) FILTER (metric = 'roa_pct') AS roa,
       max(rank_pct) FILTER (metric = 'revenue_growth_pct') AS growth,
       max(rank_pct) FILTER (metric = 'debt_to_equity') AS debt,
       max(rank_pct) FILTER (metric = 'piotroski_f_score') AS f_rank
FROM ranks WHERE peer_kind = 'sector' GROUP BY symbol
""")
_ALTMAN = ("CASE WHEN altman_z_score >= 3 THEN 100 WHEN altman_z_score >= 1.8 THEN 55 + "
           "(altman_z_score - 1.8) / 1.2 * 35 WHEN altman_z_score IS NOT NULL THEN "
           "greatest(0, altman_z_score / 1.8 * 45) END")
_RSI = ("CASE WHEN rsi_14 IS NULL THEN NULL WHEN rsi_14 BETWEEN 45 AND 65 THEN 85 WHEN rsi_14 "
        "BETWEEN 35 AND 75 THEN 65 WHEN rsi_14 < 30 OR rsi_14 > 80 THEN 35 ELSE 50 END")
_TREND = ("CASE WHEN ema_50 IS NULL OR ema_200 IS NULL THEN NULL WHEN close > ema_50 AND ema_50 > "
          "ema_200 THEN 85 WHEN close > ema_200 THEN 65 ELSE 35 END")
part("score_parts", f"""
SELECT s.symbol, s.industry IN ('NATION_1', 'NATION_12') AS fin, b.points AS bank,
       a.active_signal_count, altman_z_score, piotroski_f_score, r.f_rank,
       d.latest_pct, d.trend AS d_trend, d.unusual_today, v.volatility_multiple, m.fii_trend,
       m.dii_trend, i.close, i.ema_50, i.ema_200, i.rsi_14,
       CASE WHEN s.industry IN ('NATION_1', 'NATION_12')
            THEN {_mean('piotroski_f_score / 9 * 100', _scale('r.roe', 0, 100),
                        _scale('r.roa', 0, 100), _scale('r.growth', 0, 100), 'b.points',
                        'b.points')}
            ELSE {_mean('piotroski_f_score / 9 * 100', _ALTMAN, _scale('r.roe', 0, 100),
                        _scale('r.roa', 0, 100), _scale('r.growth', 0, 100), 'r.debt')} END AS f,
       {_mean('r.roe', 'r.growth', 'r.f_rank')} AS macro,
       {_mean('least(100, 40 + 12 * a.active_signal_count)', _RSI, _TREND,
              _scale('relative_volume', 0.5, 2))} AS tech,
       {_mean(_scale('d.latest_pct', 20, 65), _scale('d.ma20_pct', 20, 60),
              "CASE d.trend WHEN 'rising' THEN 75 WHEN 'falling' THEN 35 WHEN 'flat' THEN 55 END"
              )} * 0.6 + m.market_score * 0.4 AS flow,
       CASE WHEN v.volatility_multiple IS NULL THEN 50 WHEN v.volatility_multiple <= 1.1 THEN 80
            WHEN v.volatility_multiple <= 1.5 THEN 60 ELSE 35 END AS ev
FROM summary AS s LEFT JOIN sector_ranks AS r ON r.symbol = s.symbol
LEFT JOIN bank_points AS b ON b.symbol = s.symbol
LEFT JOIN delivery_summary AS d ON d.symbol = s.symbol
LEFT JOIN volatility AS v ON v.symbol = s.symbol
LEFT JOIN last_sig AS a ON a.symbol = s.symbol
LEFT JOIN (SELECT * FROM ind WHERE n = bar_count) AS i ON i.symbol = s.symbol
CROSS JOIN market AS m
""")
part("composite", """
SELECT symbol, round(round(total, 9), 1) AS score, round(round(f, 9), 1) AS fundamentals_score,
       round(round(tech, 9), 1) AS technicals_score, round(round(flow, 9), 1) AS flows_score,
       CAST(ev AS DOUBLE) AS events_quality_score, round(round(macro, 9), 1) AS macro_sector_score,
       CASE WHEN total >= 80 THEN 'Strong research candidate'
            WHEN total >= 60 THEN 'Watchlist candidate'
            WHEN total >= 40 THEN 'Neutral / needs more evidence' ELSE 'High caution' END AS band,
       active_signal_count, notes, len(notes) AS risks, incomplete
FROM (SELECT p.*, f * 0.35 + tech * 0.30 + flow * 0.17 + ev * 0.12 + macro * 0.06 AS total,
        list_slice(list_filter([
          CASE WHEN fin AND k.gnpa >= 5 THEN 'GNPA is' END,
          CASE WHEN fin AND k.nnpa >= 2 THEN 'NNPA is' END,
          CASE WHEN fin AND k.capital < 13 THEN 'Capital adequacy' END,
          CASE WHEN fin AND k.credit > k.deposit + 8 THEN 'Credit growth' END,
          CASE WHEN NOT fin AND altman_z_score < 1.8 THEN 'Low Altman' END,
          CASE WHEN active_signal_count = 0 THEN 'No prebuilt' END,
          CASE WHEN close <= ema_200 THEN 'Price is' END,
          CASE WHEN d_trend = 'falling' THEN 'Delivery trend' END,
          CASE WHEN fii_trend = 'bearish' THEN 'FII flow' END,
          CASE WHEN dii_trend = 'bearish' THEN 'DII flow' END,
          CASE WHEN volatility_multiple > 1.5 THEN 'Result-period volatility' END,
          CASE WHEN macro <= 35 THEN 'Fundamental ranks' END], lambda v: v IS NOT NULL), 1, 6) AS notes,
        coalesce((fin AND (k.symbol IS NULL OR k.base >= 5 OR k.gnpa IS NULL)) OR rsi_14 IS NULL
          OR close IS NULL OR ema_50 IS NULL OR ema_200 IS NULL OR latest_pct IS NULL
          OR volatility_multiple IS NULL OR f IS NULL OR macro IS NULL, false) AS incomplete
      FROM score_parts AS p LEFT JOIN bank AS k ON k.symbol = p.symbol)
""")


@query("composite_scores", "A18 M1 M2 M3 M4 M5 M6 M7 M8 M9 J10", sql("""
SELECT symbol, score, band, fundamentals_score, technicals_score, flows_score,
       events_quality_score, macro_sector_score, active_signal_count FROM composite
"""), "score fundamentals_score technicals_score flows_score events_quality_score "
      "macro_sector_score")
def composite_scores(t: Tables) -> DataFrame:
    return composite(t).select(
        "symbol", "score", "band", "fundamentals_score", "technicals_score", "flows_score",
        "events_quality_score", "macro_sector_score", "active_signal_count",
    )


@query("composite_risk_notes", "M9", sql("""
SELECT symbol, CAST(risks AS BIGINT) AS risks, array_to_string(notes, '; ') AS notes FROM composite
"""))
def composite_risk_notes(t: Tables) -> DataFrame:
    """All symbols, banks too: which risks are named, by the first two words of each."""
    heads = F.transform("risks", lambda r: F.substring_index(r, " ", 2))
    return composite(t).select(
        "symbol", F.size("risks").alias("risks"), F.array_join(heads, "; ").alias("notes")
    )


_GROWTH = (f"greatest(0, ({_scale('credit', -5, 25)} + {_scale('deposit', -5, 25)}) / 2 "
           "- least(35, abs(credit - deposit) * 3))")


@query("composite_explanations", "M9", sql(f"""
SELECT p.symbol, array_to_string(list_slice(list_filter([
         CASE WHEN fin THEN 'Scored as' END, CASE WHEN fin AND k.base < 5 THEN 'Bank figures' END,
         CASE WHEN fin AND nim >= 3.5 THEN 'A good' END, CASE WHEN fin AND gnpa <= 2 THEN 'Few gross' END,
         CASE WHEN fin AND nnpa <= 1 THEN 'Few net' END, CASE WHEN fin AND casa >= 35 THEN 'Cheap deposits' END,
         CASE WHEN fin AND capital >= 15 THEN 'Ample capital,' END,
         CASE WHEN fin AND credit <= deposit + 8 AND {_GROWTH} >= 70 THEN 'Loans and' END,
         CASE WHEN fin AND bank IS NULL THEN 'No bank' END, CASE WHEN piotroski_f_score >= 7 THEN 'A Piotroski' END,
         CASE WHEN p.active_signal_count > 0 THEN 'Signals: ' || string_split(active_signals, ' ')[1] END,
         CASE WHEN close > ema_50 AND ema_50 > ema_200 THEN 'Price over' END,
         CASE WHEN latest_pct >= 50 THEN 'Much of' END, CASE WHEN d_trend = 'rising' THEN 'Deliveries rise.' END,
         CASE WHEN unusual_today THEN 'Unusually much' END, CASE WHEN fii_trend = 'bullish' THEN 'Foreign institutions' END,
         CASE WHEN dii_trend = 'bullish' THEN 'Domestic institutions' END,
         CASE WHEN volatility_multiple <= 1.1 THEN 'Results hardly' END, CASE WHEN macro >= 70 THEN 'High ranks' END],
         lambda v: v IS NOT NULL), 1, 6), '; ') AS reasons,
       array_to_string(list_sort(list_filter([
         CASE WHEN fin AND k.symbol IS NULL THEN 'manual banking metrics' END,
         CASE WHEN fin AND k.base >= 5 THEN 'banking metrics source' END,
         CASE WHEN fin AND k.symbol IS NOT NULL AND gnpa IS NULL THEN 'GNPA' END,
         CASE WHEN f IS NULL THEN 'fundamental metrics' END, CASE WHEN rsi_14 IS NULL THEN 'RSI' END,
         CASE WHEN close IS NULL OR ema_50 IS NULL OR ema_200 IS NULL THEN 'moving average context' END,
         CASE WHEN latest_pct IS NULL THEN 'latest delivery percentage' END,
         CASE WHEN volatility_multiple IS NULL THEN 'result volatility multiple' END,
         CASE WHEN macro IS NULL THEN 'sector relative strength context' END], lambda v: v IS NOT NULL)), '; ') AS missing
FROM score_parts AS p LEFT JOIN bank AS k ON k.symbol = p.symbol LEFT JOIN last_sig AS a ON a.symbol = p.symbol
"""))
def composite_explanations(t: Tables) -> DataFrame:
    """What speaks for each symbol, by the first two words of each reason, and all that is missing."""
    heads = F.transform("reasons", lambda r: F.substring_index(r, " ", 2))
    return composite(t).select(
        "symbol", F.array_join(heads, "; ").alias("reasons"), F.array_join("missing_data", "; ").alias("missing")
    )


@query("composite_upsert", "U7 S5", sql("""
SELECT symbol, score, active_signal_count, CASE WHEN active_signal_count > 0 THEN 'new' ELSE 'old'
       END AS version FROM composite
"""), "score")
def composite_upsert(t: Tables) -> DataFrame:
    rows = composite(t).select(
        "symbol", F.lit("2001-11-04").cast("date").alias("as_of_date"), "score",
        "active_signals", F.size("active_signals").alias("active_signal_count"),
        F.lit("derived").alias("source"),
    )
    rows = materialise(rows)
    stored = rows.withColumn("version", F.lit("old"))
    fresh = rows.where(F.col("active_signal_count") > 0).withColumn("version", F.lit("new"))
    out = keep_latest(stored, fresh, KEYS["composite_scores"])
    return readers.composite_scores(out, source="derived").select(
        "symbol", "score", "active_signal_count", "version"
    )


@query("research_stances", "P25", sql("""
SELECT symbol, CASE WHEN score >= 75 AND active_signal_count >= 2
              THEN 'Accumulation watchlist candidate'
            WHEN score >= 60 THEN 'Watch / hold research candidate'
            WHEN score <= 40 THEN 'Reduce / avoid-risk review' ELSE 'Neutral watch' END AS stance
FROM composite
"""))
def research_stances(t: Tables) -> DataFrame:
    stance = research_stance(F.lit("High"), F.col("score"), F.col("active_signal_count"))
    return composite(t).select("symbol", stance.alias("stance"))


part("disagree", """
SELECT symbol, fiscal_year FROM annual2 GROUP BY 1, 2
HAVING max(revenue) <> 0 AND (max(revenue) - min(revenue)) / abs(max(revenue)) > 0.05
""")


part("trust_areas", """
SELECT symbol, area, status FROM (
  SELECT s.symbol, s.fin, unnest(['Price data', 'Fundamentals', 'Banking metrics', 'Signals',
           'Flows / events', 'Fundamentals cross-check', 'Composite score']) AS area,
         unnest([CASE WHEN moves > 0 OR as_of - last_day > 5 THEN 'PARTIAL' ELSE 'OK' END, 'PARTIAL',
           CASE WHEN NOT fin THEN 'N/A' WHEN b.symbol IS NULL THEN 'ACTION' ELSE 'PARTIAL' END,
           CASE WHEN s.active_signal_count > 0 THEN 'OK' ELSE 'PARTIAL' END,
           CASE WHEN v.symbol IS NULL OR e.symbol IS NULL THEN 'PARTIAL' ELSE 'OK' END,
           CASE WHEN coalesce(d.n, 0) = 0 AND coalesce(x.n, 0) >= 2 THEN 'OK' ELSE 'PARTIAL' END,
           CASE WHEN c.risks = 0 AND NOT c.incomplete THEN 'OK' ELSE 'PARTIAL' END]) AS status
  FROM score_parts AS s JOIN composite AS c ON c.symbol = s.symbol
  JOIN (SELECT symbol, count(*) FILTER (abs(close / prior_close - 1) * 100 > 40) AS moves,
               max(trade_date) AS last_day FROM num GROUP BY symbol) AS p ON p.symbol = s.symbol
  CROSS JOIN today
  LEFT JOIN volatility AS v ON v.symbol = s.symbol
  LEFT JOIN delivery_summary AS e ON e.symbol = s.symbol
  LEFT JOIN (SELECT symbol, count(DISTINCT source) AS n FROM annual2 GROUP BY symbol) AS x
    ON x.symbol = s.symbol
  LEFT JOIN bank AS b ON b.symbol = s.symbol
  LEFT JOIN (SELECT symbol, count(*) AS n FROM disagree GROUP BY symbol) AS d
    ON d.symbol = s.symbol)
""")


@query("data_trust_checklist", "A25", sql("SELECT symbol, area, status FROM trust_areas"))
def data_trust_checklist(t: Tables) -> DataFrame:
    return checklist(t).select("symbol", "area", "status")


def checklist(t: Tables) -> DataFrame:
    from tickloom.operators.fundamentals import source_disagreements

    t = t.with_stored_bars()
    t.keep("annual")
    empty = F.array().cast("array<string>")
    bars = ql.validate_ohlcv(t.bars, t.as_of).select(
        "symbol", F.col("rows").alias("price_rows"), F.col("errors").alias("price_errors"),
        F.col("warnings").alias("price_warnings"),
    )
    annual = ql.validate_annual(companies._with_sector(t)).select(
        "symbol", F.col("rows").alias("fundamental_rows"),
        F.col("errors").alias("fundamental_errors"),
        F.col("warnings").alias("fundamental_warnings"),
    )
    bank = ql.validate_banking(banking(t)).select(
        "symbol", F.col("rows").alias("_rows"), F.col("errors").alias("_errors"),
        F.col("warnings").alias("_warnings"),
    )
    differ = source_disagreements(t.annual_two_source).groupBy("symbol").agg(
        F.count("*").alias("_n")
    )
    scored = composite(t).select(
        "symbol", "active_signal_count", "missing_data", "risks",
        F.col("industry").startswith("Private").alias("banking_applicable"),
    )
    two = t.annual_two_source.groupBy("symbol").agg(F.count_distinct("source").alias("_sources"))
    has_delivery = delivered(t).select("symbol", F.lit(True).alias("_delivery"))
    has_moved = moved(t).select("symbol", F.lit(True).alias("_volatility"))
    joined = (
        scored.join(bars, "symbol").join(annual, "symbol").join(bank, "symbol", "left")
        .join(differ, "symbol", "left").join(two, "symbol", "left")
        .join(has_delivery, "symbol", "left").join(has_moved, "symbol", "left")
    )
    return ql.trust_checklist(
        joined.withColumns(
            {
                "banking_rows": F.coalesce("_rows", F.lit(0)),
                "banking_errors": F.coalesce("_errors", empty),
                "banking_warnings": F.coalesce("_warnings", empty),
                "has_delivery": F.coalesce("_delivery", F.lit(False)),
                "has_volatility": F.coalesce("_volatility", F.lit(False)),
                "sources": F.coalesce("_sources", F.lit(0)),
                "disagreements": F.coalesce("_n", F.lit(0)),
            }
        )
    )


@query("data_trust_levels", "A25", sql("""
SELECT symbol, actions, partials,
       CASE WHEN actions > 0 OR partials >= 3 THEN 'Low' WHEN partials > 0 THEN 'Medium'
            ELSE 'High' END AS trust_level
FROM (SELECT symbol, count(*) FILTER (status = 'ACTION') AS actions,
             count(*) FILTER (status = 'PARTIAL') AS partials FROM trust_areas GROUP BY symbol)
"""))
def data_trust_levels(t: Tables) -> DataFrame:
    return ql.trust_level(checklist(t))


# --- state summaries -----------------------------------------------------------------------

@query("price_coverage", "A9 A19", sql("""
SELECT source, count(*) AS rows, count(DISTINCT symbol) AS distinct_symbols,
       min(trade_date) AS oldest_trade_date, max(trade_date) AS newest_trade_date
FROM bars2 GROUP BY GROUPING SETS ((), (source))
"""))
def price_coverage(t: Tables) -> DataFrame:
    return ops.price_coverage(t.bars_two_source)


@query("score_coverage", "A10", sql("""
SELECT count(DISTINCT symbol) AS distinct_symbols, count(*) AS total_rows,
       count(*) FILTER (trade_date >= as_of - 7) AS rows_last_7_days,
       max(trade_date) AS latest_as_of_date FROM bars CROSS JOIN today
"""))
def score_coverage(t: Tables) -> DataFrame:
    return ops.score_coverage(t.bars.withColumnRenamed("trade_date", "as_of_date"), t.as_of)


@query("instrument_coverage", "A11", sql("""
SELECT exchange, count(*) AS instruments FROM instruments GROUP BY ROLLUP (exchange)
"""))
def instrument_coverage(t: Tables) -> DataFrame:
    return ops.instrument_coverage(state.instruments(t))


@query("stale_symbols", "A13", sql("""
SELECT symbol, max(trade_date) AS latest_trade_date, max(as_of) - max(trade_date) AS days_stale
FROM bars CROSS JOIN today GROUP BY symbol HAVING max(trade_date) < max(as_of) - 3
ORDER BY latest_trade_date, symbol LIMIT 20
"""))
def stale_symbols(t: Tables) -> DataFrame:
    return ops.stale_symbols(t.bars, t.as_of, 3)


@query("market_breadth", "A14 W15", sql(f"""
SELECT max(d) AS latest_trade_date, count(*) FILTER (two) AS compared_symbols,
       count(*) FILTER (two AND now > old) AS advances,
       count(*) FILTER (two AND now < old) AS declines,
       count(*) FILTER (two AND now = old) AS unchanged,
       CASE WHEN count(*) FILTER (two AND now < old) > 0
            THEN {half_up('count(*) FILTER (two AND now > old)::DOUBLE / count(*) FILTER (two AND now < old)', 2)}
            WHEN count(*) FILTER (two AND now > old) > 0
            THEN count(*) FILTER (two AND now > old)::DOUBLE END AS advance_decline_ratio
FROM (SELECT symbol, max(trade_date) AS d, max(close) FILTER (back = 1) AS now,
             max(close) FILTER (back = 2) AS old, count(*) FILTER (back <= 2) = 2 AS two
      FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS back
            FROM bars) GROUP BY symbol)
"""))
def market_breadth(t: Tables) -> DataFrame:
    return ops.market_breadth(t.bars)


def score_series(t: Tables) -> DataFrame:
    now, before = state.saved_scans(t)
    keep = ["symbol", "score", "band", "active_signal_count", "risks", "missing_data"]
    stamp = {"2001-11-04": now, "2001-08-06": before}
    parts = [
        df.withColumnRenamed("composite_score", "score").select(
            *keep, F.lit(d).cast("date").alias("as_of_date"))
        for d, df in stamp.items()
    ]
    return materialise(parts[0].unionByName(parts[1]))


@query("score_movers", "O4 W15", sql("""
SELECT symbol, composite_score AS score, previous_score, score_change FROM compared
ORDER BY round(abs(score_change), 1) DESC, composite_score DESC, symbol LIMIT 5
"""), "score previous_score score_change")
def score_movers(t: Tables) -> DataFrame:
    return ops.score_movers(score_series(t)).select(
        "symbol", "score", "previous_score", "score_change"
    )


@query("top_attention", "O5", sql("""
SELECT symbol, composite_score AS score, active_signal_count AS signals FROM scan_now
ORDER BY composite_score DESC, active_signal_count DESC, symbol LIMIT 5
"""), "score")
def top_attention(t: Tables) -> DataFrame:
    return ops.top_attention(score_series(t)).select("symbol", "score", "signals")


@query("upcoming_events", "O8 P40 P41", sql("""
SELECT symbol, ex_date AS date, action_type AS event, ex_date - DATE '1998-01-02' AS days_until
FROM splits WHERE ex_date BETWEEN DATE '1998-01-02' AND DATE '1998-02-13'
ORDER BY ex_date, symbol, action_type LIMIT 20
"""))
def upcoming_events(t: Tables) -> DataFrame:
    """Splits within 30 weekdays of Friday, 2 January 1998."""
    actions = t.splits.withColumn("detail", F.lit(None).cast("string"))
    return ops.upcoming_events(actions, F.lit("1998-01-02").cast("date"), 30).drop("detail")


@query("business_day_offsets", "P40 P41", sql("""
SELECT trade_date, CASE isodow(trade_date) WHEN 6 THEN trade_date + 6 WHEN 7 THEN trade_date + 5
       ELSE trade_date + 7 END AS after_five,
       CASE WHEN DATE '1998-06-30' >= trade_date THEN DATE '1998-06-30' - trade_date END
         AS days_to_event FROM (SELECT DISTINCT trade_date FROM bars)
"""))
def business_day_offsets(t: Tables) -> DataFrame:
    days = t.bars.select("trade_date").distinct()
    return days.select(
        "trade_date", business_days_after("trade_date", 5).alias("after_five"),
        days_until(F.lit("1998-06-30").cast("date"), "trade_date").alias("days_to_event"),
    )


@query("source_mix", "A27", sql("""
SELECT source, count(*) AS rows, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM bars2)
  AS share_pct FROM bars2 GROUP BY source
"""))
def source_mix(t: Tables) -> DataFrame:
    return ops.source_mix(t.bars_two_source)


def runs(t: Tables) -> DataFrame:
    """One refresh run per ship day; a day with large orders counts as failed symbols."""
    li = t.lines.groupBy("trade_date").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_quantity") >= 50).alias("failed_symbols")
    )
    status = F.when(F.col("failed_symbols") == 0, F.lit("completed")).otherwise(
        F.lit("completed_with_errors")
    )
    return li.select(
        F.date_format("trade_date", "yyyyMMdd").alias("run_id"), status.alias("status"),
        F.col("trade_date").cast("timestamp").alias("started_at"),
        F.col("trade_date").cast("timestamp").alias("finished_at"), "failed_symbols",
    )


@query("recent_runs", "A28 O9", sql("""
SELECT strftime(trade_date, '%Y%m%d') AS run_id, count(*) FILTER (l_quantity >= 50)
         AS failed_symbols, (max(as_of) + 1 - trade_date) * 86400 AS age_seconds
FROM lines CROSS JOIN today GROUP BY trade_date ORDER BY trade_date DESC LIMIT 10
"""))
def recent_runs(t: Tables) -> DataFrame:
    return ops.recent_runs(runs(t), F.date_add(t.as_of, 1)).select(
        "run_id", "failed_symbols", "age_seconds"
    )


@query("provider_health", "A26", sql("""
SELECT strftime(trade_date, '%Y%m%d') AS run_id,
       CASE WHEN count(*) FILTER (l_quantity >= 50) = 0 THEN 'Healthy' ELSE 'Partial' END AS label,
       CASE WHEN count(*) FILTER (l_quantity >= 50) = 0 THEN 'green' ELSE 'amber' END AS color
FROM lines GROUP BY trade_date ORDER BY trade_date DESC LIMIT 1
"""))
def provider_health(t: Tables) -> DataFrame:
    return ops.provider_health(runs(t))


# --- nightly refresh --------------------------------------------------------------------------

def nightly(t: Tables, write_root: str | None = None):
    """Stored rows to 30 June 2001, then a batch of one source, split-adjusted.

    A symbol with a price below 100 in the batch gets it negated and must fail.
    """
    prices = t.bars_two_source
    stored = prices.where(F.col("trade_date") <= "2001-06-30")
    close = F.col("close")
    batch = prices.where(F.col("source") == "kite").withColumn(
        "close", F.when(close < 100, -close).otherwise(close)
    )
    if write_root is not None:
        stored = store_by_year(
            t.spark, f"{write_root}/price_daily", stored, KEYS["price_daily"], "trade_date", ()
        )
        start_indicators(stored, t.splits.where("ex_date <= DATE '2001-06-30'"), write_root, "before")
    return refresh_eod(
        stored, batch.withColumn("ingest", F.lit(1)), t.universe, t.splits, t.as_of,
        run_id="night", order=["ingest"], write_root=write_root,
    )


part("night_bad", """
SELECT b.symbol FROM bars2 AS b JOIN (
  SELECT symbol, max(trade_date) - 5 AS since FROM bars2 WHERE trade_date <= DATE '2001-06-30'
  GROUP BY symbol) AS s ON s.symbol = b.symbol AND b.trade_date >= s.since
WHERE b.source = 'kite' AND b.close < 100 GROUP BY b.symbol
""")
part("night_rows", """
SELECT *, CASE source WHEN 'kite' THEN 2 ELSE 1 END AS p FROM bars2
WHERE trade_date <= DATE '2001-06-30'
   OR (source = 'kite' AND symbol NOT IN (SELECT symbol FROM night_bad))
""")


NIGHT_BARS = """
SELECT symbol, trade_date, open / f AS open, high / f AS high, low / f AS low, close / f AS close,
       volume * f AS volume FROM (
  SELECT k.*, coalesce((SELECT product(value) FROM splits AS s WHERE s.symbol = k.symbol
                        AND s.ex_date > k.trade_date), 1) AS f FROM (
    SELECT symbol, trade_date, arg_max(open, p) AS open, arg_max(high, p) AS high,
           arg_max(low, p) AS low, arg_max(close, p) AS close, arg_max(volume, p) AS volume
    FROM night_rows GROUP BY 1, 2) AS k)
"""
NIGHT_SCORES = sql("""
SELECT symbol, active_signal_count, round(35 + 0.3 * tech, 1) AS score FROM (
  SELECT i.symbol, s.active_signal_count,
         list_avg(list_filter([least(100, 40 + 12 * s.active_signal_count)::DOUBLE,
           CASE WHEN rsi_14 IS NULL THEN NULL WHEN rsi_14 BETWEEN 45 AND 65 THEN 85
                WHEN rsi_14 BETWEEN 35 AND 75 THEN 65 WHEN rsi_14 < 30 OR rsi_14 > 80 THEN 35
                ELSE 50 END,
           CASE WHEN ema_50 IS NULL OR ema_200 IS NULL THEN NULL
                WHEN close > ema_50 AND ema_50 > ema_200 THEN 85 WHEN close > ema_200 THEN 65
                ELSE 35 END,
           greatest(0, least(100, (relative_volume - 0.5) / 1.5 * 100))],
           lambda x: x IS NOT NULL)) AS tech
  FROM (SELECT * FROM ind WHERE n = bar_count) AS i JOIN last_sig AS s ON s.symbol = i.symbol)
""", bars=NIGHT_BARS)


@query("nightly_refresh_scores", "L4", NIGHT_SCORES, "score")
def nightly_refresh_scores(t: Tables) -> DataFrame:
    return nightly(t).scores.select("symbol", "active_signal_count", "score")


def stored_night(t: Tables):
    """The same night on stored tables: written, and everything read back."""
    root = shared_path(t.spark, "night")
    return nightly(t, root)


@query("nightly_refresh_prices", "L4 U1 T1", sql("""
SELECT symbol, trade_date, source, close, volume FROM night_rows
"""))
def nightly_refresh_prices(t: Tables) -> DataFrame:
    return stored_night(t).prices.select("symbol", "trade_date", "source", "close", "volume")


@query("nightly_refresh_snapshots", "L4 U2", sql("""
SELECT i.symbol, i.trade_date AS as_of_date, i.close, i.sma_20, i.ema_50, i.rsi_14, i.atr_14
FROM ind AS i JOIN (
  SELECT symbol, max(trade_date) - 5 AS since FROM bars2 WHERE trade_date <= DATE '2001-06-30'
  GROUP BY symbol) AS s ON s.symbol = i.symbol AND i.trade_date >= s.since
""", bars=NIGHT_BARS), "sma_20 ema_50 rsi_14 atr_14")
def nightly_refresh_snapshots(t: Tables) -> DataFrame:
    return stored_night(t).snapshots.select(
        "symbol", "as_of_date", "close", "sma_20", "ema_50", "rsi_14", "atr_14"
    )


@query("nightly_refresh_stored_scores", "L4 U7", NIGHT_SCORES, "score")
def nightly_refresh_stored_scores(t: Tables) -> DataFrame:
    return stored_night(t).scores.select("symbol", "active_signal_count", "score")


@query("nightly_refresh_run", "L4 U14", sql("""
SELECT 'night' AS run_id, count(*) AS requested_symbols,
       count(*) - count(b.symbol) AS successful_symbols, count(b.symbol) AS failed_symbols,
       CASE WHEN count(b.symbol) = count(*) THEN 'failed'
            WHEN count(b.symbol) > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status
FROM universe AS u LEFT JOIN night_bad AS b ON b.symbol = u.symbol
"""))
def nightly_refresh_run(t: Tables) -> DataFrame:
    return nightly(t).run


@query("nightly_membership_trades", "L6 J4", sql("""
SELECT signal, count(*) AS trades FROM trades AS e WHERE EXISTS (
  SELECT 1 FROM periods AS p WHERE p.symbol = e.symbol AND p.from_date <= e.entry_date
    AND (p.to_date IS NULL OR p.to_date >= e.entry_date)) GROUP BY signal
"""))
def nightly_membership_trades(t: Tables) -> DataFrame:
    from tickloom.operators.backtest import events_in_index, run_signal_backtest

    inside = events_in_index(backtests.events(t), backtests.membership(t), backtests.INDEX)
    return run_signal_backtest(inside, t.bars).groupBy("signal").agg(F.count("*").alias("trades"))
