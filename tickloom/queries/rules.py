"""Signals, trade plans, strategy rules and alerts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.bridge import Tables
from tickloom.config import DEFAULT
from tickloom.operators import signals as sg
from tickloom.operators import strategies as st
from tickloom.operators.scoring import position_size, risk_per_share
from tickloom.plans.pipelines import scan_strategies, scan_universe
from tickloom.queries import state  # noqa: F401  (its table expressions)
from tickloom.queries.indicators import indicators
from tickloom.queries.registry import query
from tickloom.queries.sqlbase import SIGNAL_CONDITIONS, part, sql
from tickloom.session import materialise

# The bridge prices trade for small amounts, so the liquidity floors are lowered
# and the ATR limits raised.
SCANNER = replace(
    DEFAULT.strategies, liquidity_pass_cr=0.02, liquidity_warn_cr=0.01, high_atr_pct=100.0,
    extreme_atr_pct=200.0,
)


def _two(value: str) -> str:
    """Two digits, halves up on the decimal text."""
    return f"CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38, 16)), 2) AS DOUBLE)"


def _signal(name: str):
    def build(t: Tables) -> DataFrame:
        return sg.signal_events(indicators(t)).where(F.col("signal") == name).select(
            "symbol", "event_date", "close", "confidence"
        )

    return build


part("planned", """
SELECT *, active AND atr_14 > 0 AS usable,
       CAST(round(CAST(CAST(close AS VARCHAR) AS DECIMAL(38, 16)), 2) AS DOUBLE) AS cents,
       least(55 + CASE WHEN rsi_14 BETWEEN 45 AND 70 THEN 10 ELSE 0 END
                + CASE WHEN relative_volume >= 1.5 THEN 10 ELSE 0 END
                + CASE WHEN close > ema_50 AND ema_50 > ema_200 THEN 10 ELSE 0 END, 90)
         AS confidence_points
FROM sig_all
""")
_CONFIDENCE = "CAST(CASE WHEN usable THEN confidence_points END AS DOUBLE) AS confidence"
for _i, (_name, _key) in enumerate(zip(SIGNAL_CONDITIONS, (
    "signal_ema_pullback", "signal_rsi_momentum", "signal_volume_breakout",
    "signal_darvas_breakout", "signal_oversold", "signal_ma_stack", "signal_sma_cross",
), strict=True)):
    query(_key, f"P{_i + 2}", sql(
        f"SELECT symbol, trade_date AS event_date, close, {_CONFIDENCE} FROM planned "
        f"WHERE active AND signal = '{_name}'"))(_signal(_name))


@query("latest_signal_scan", "P9", sql(
    "SELECT symbol, trade_date, signal, strength, active FROM sig_all "
    "WHERE n = bar_count AND bar_count >= 2"))
def latest_signal_scan(t: Tables) -> DataFrame:
    return sg.scan_latest_signals(indicators(t)).select(
        "symbol", "trade_date", "signal", "strength", "active"
    )


@query("signal_trade_plans", "P10 P11", sql(f"""
SELECT symbol, trade_date AS event_date, signal, CASE WHEN usable THEN cents END AS trigger_price,
       CASE WHEN usable THEN {_two('close - 0.5 * atr_14')} END AS entry_zone_low,
       CASE WHEN usable THEN {_two('close + 0.25 * atr_14')} END AS entry_zone_high,
       CASE WHEN usable THEN {_two('close - 2 * atr_14')} END AS stop_loss,
       CASE WHEN usable THEN {_two('close + 5 * atr_14')} END AS target_price,
       CAST(CASE WHEN usable THEN 2.5 END AS DOUBLE) AS risk_reward, {_CONFIDENCE}
FROM planned WHERE active
"""), "entry_zone_low entry_zone_high stop_loss target_price")
def signal_trade_plans(t: Tables) -> DataFrame:
    return sg.signal_events(indicators(t)).select(
        "symbol", "event_date", "signal", "trigger_price", "entry_zone_low", "entry_zone_high",
        "stop_loss", "target_price", "risk_reward", "confidence",
    )


@query("position_sizes", "P26", sql("""
SELECT symbol, trade_date AS event_date, signal,
       CASE WHEN usable AND cents - round(close - 2 * atr_14, 2) > 0
            THEN round(cents - round(close - 2 * atr_14, 2), 2) END AS risk_per_share,
       CAST(CASE WHEN usable THEN floor(1000000 * 1.0 / 100
            / nullif(round(cents - round(close - 2 * atr_14, 2), 2), 0)) END AS BIGINT)
         AS shares
FROM planned WHERE active
"""), "risk_per_share")
def position_sizes(t: Tables) -> DataFrame:
    df = sg.signal_events(indicators(t))
    risk = risk_per_share(F.col("trigger_price"), F.col("stop_loss"))
    return df.withColumn("risk_per_share", risk).select(
        "symbol", "event_date", "signal", "risk_per_share",
        position_size(F.lit(1_000_000.0), F.col("risk_per_share")).alias("shares"),
    )


@query("rsi_momentum_days", "W3 P3 A1", sql("""
SELECT symbol, count(*) FILTER (close > ema_50 AND rsi_14 >= 60) AS active_days,
       count(rsi_14) AS measured_days FROM ind GROUP BY symbol
"""))
def rsi_momentum_days(t: Tables) -> DataFrame:
    active = (F.col("close") > F.col("ema_50")) & (F.col("rsi_14") >= 60)
    return indicators(t).groupBy("symbol").agg(
        F.count_if(active).alias("active_days"), F.count("rsi_14").alias("measured_days")
    )


# --- strategies --------------------------------------------------------------

def strategy_results(t: Tables) -> DataFrame:
    """Triggered strategies of the stored scan; some symbols have one source only."""
    return scan_strategies(t.bars_two_source, t.universe, t.as_of, cfg=SCANNER)[0]


def history_rows(t: Tables) -> DataFrame:
    """Every bar seen as if it were the last one."""
    df = indicators(t).withColumn("bar_count", F.col("bar_number"))
    return df.withColumns(
        {
            "data_source": F.lit("derived"),
            "data_warnings": F.array().cast("array<string>"),
            "company_name": F.lit(None).cast("string"),
            "sector": F.lit(None).cast("string"),
            "market_cap_bucket": F.lit(None).cast("string"),
        }
    )


def historic_results(t: Tables) -> DataFrame:
    df = history_rows(t)
    return st.evaluate_strategies(df, F.col("trade_date"), cfg=SCANNER)


part("labelled", """
SELECT *, CASE WHEN n >= 253 THEN prior_high_252 ELSE prior_high_120 END AS level,
       least(abs(close - ema_20), abs(low - ema_20)) / ema_20 * 100 AS near20,
       least(abs(close - ema_50), abs(low - ema_50)) / ema_50 * 100 AS near50,
       round(traded_value_20 / 1e7, 2) AS avg_traded_value_cr,
       CASE WHEN round(traded_value_20 / 1e7, 2) >= 0.02 THEN 'Pass'
            WHEN round(traded_value_20 / 1e7, 2) >= 0.01 THEN 'Watch' ELSE 'Low' END
         AS liquidity_status
FROM ind
""")
part("trusted", """
SELECT *, CASE WHEN liquidity_status = 'Low' OR close < 20 OR coalesce(atr_pct > 200, false)
               THEN 'Do not trust signal'
               WHEN liquidity_status = 'Watch' OR coalesce(atr_pct > 100, false) THEN 'Warning'
               ELSE 'Good data' END AS data_trust FROM labelled
""")
part("confident", """
SELECT *, CASE WHEN relative_volume >= 1.5 THEN 5 ELSE 0 END
        + CASE WHEN atr_pct BETWEEN 1 AND 5 THEN 4 ELSE 0 END
        + CASE liquidity_status WHEN 'Pass' THEN 5 WHEN 'Low' THEN -8 ELSE 0 END
        + CASE data_trust WHEN 'Warning' THEN -6 WHEN 'Do not trust signal' THEN -18 ELSE 0 END
          AS adjust FROM trusted
""")
STRATEGY_CONDITIONS = {
    "EMA Stack Trend Filter": (76, "n >= 220 AND close > ema_20 AND ema_20 > ema_50 AND "
                               "ema_50 > ema_100 AND ema_100 > ema_200"),
    "RSI 60 Momentum Continuation": (72, "n >= 220 AND close > ema_50 AND ema_50 > ema_200 AND "
                                     "rsi_14 BETWEEN 60 AND 75 AND relative_volume >= 1"),
    "20/50 EMA Pullback In Uptrend": (74, "n >= 220 AND close > ema_200 AND ema_20 > ema_50 AND "
                                      "ema_50 > ema_200 AND least(near20, near50) <= 3 AND "
                                      "rsi_14 BETWEEN 40 AND 60"),
    "Breakout With Relative Volume": (78, "n >= 140 AND close > level AND (close - level) / level"
                                      " * 100 <= 6 AND relative_volume >= 2 AND close > ema_50 "
                                      "AND ema_50 > ema_200"),
    "52W / 120D High Breakout": (72, "n >= 140 AND close >= level AND (close - level) / level "
                                 "* 100 <= 4 AND relative_volume >= 1.2 AND close > ema_50 AND "
                                 "ema_50 > ema_200"),
}
part("strategy_hits", "\nUNION ALL\n".join(
    f"SELECT confident.*, '{name}' AS strategy, '{kind}' AS setup_type, "
    f"CAST(greatest(0, least({base} + adjust, 90)) AS DOUBLE) AS confidence_score "
    f"FROM confident WHERE {cond}"
    for (name, (base, cond)), kind in zip(
        STRATEGY_CONDITIONS.items(),
        ("Trend", "Momentum", "Pullback", "Breakout", "Breakout"), strict=True)
))
part("strategy_counts", "SELECT strategy, count(*) AS c FROM strategy_hits GROUP BY strategy")
for _name, _key, _id in zip(STRATEGY_CONDITIONS, (
    "strategy_ema_stack", "strategy_rsi_momentum", "strategy_ema_pullback",
    "strategy_volume_breakout", "strategy_high_breakout",
), ("P14", "P15", "P16", "P17", "P18"), strict=True):
    def _strategy(name: str = _name):
        def build(t: Tables) -> DataFrame:
            return historic_results(t).where(F.col("strategy") == name).select(
                "symbol", "signal_date", "setup_type", "confidence_score", "data_trust"
            )

        return build

    query(_key, f"{_id} P19", sql(
        f"SELECT symbol, trade_date AS signal_date, setup_type, confidence_score, data_trust "
        f"FROM strategy_hits WHERE strategy = '{_name}'"))(_strategy())


@query("liquidity_labels", "P12", sql(
    "SELECT symbol, trade_date, avg_traded_value_cr, liquidity_status FROM labelled"))
def liquidity_labels(t: Tables) -> DataFrame:
    columns = st.liquidity_columns(SCANNER)
    return history_rows(t).withColumns(columns).select(
        "symbol", "trade_date", "avg_traded_value_cr", "liquidity_status"
    )


@query("data_trust_labels", "P13", sql(
    "SELECT symbol, trade_date, data_trust FROM trusted"))
def data_trust_labels(t: Tables) -> DataFrame:
    df = history_rows(t).withColumns(st.liquidity_columns(SCANNER))
    return df.withColumns(st.trust_columns(F.col("trade_date"), SCANNER)).select(
        "symbol", "trade_date", "data_trust"
    )



@query("strategy_filtered_results", "P20 P22 P23", sql("""
SELECT symbol, trade_date AS signal_date, strategy, confidence_score,
       CASE WHEN atr_14 > 0 THEN printf('INR %.2f - %.2f', close - 0.5 * atr_14,
            close + 0.25 * atr_14) ELSE 'N/A' END AS entry_zone,
       CASE WHEN data_trust = 'Do not trust signal' OR liquidity_status = 'Low' THEN 'Do not trust'
            WHEN data_trust = 'Good data' AND liquidity_status = 'Pass' THEN 'Clean setups'
            ELSE 'Needs review' END AS bucket
FROM strategy_hits WHERE confidence_score >= 50 AND coalesce(atr_pct <= 40, true)
  AND coalesce(round(rsi_14, 2) BETWEEN 45 AND 70, true) AND avg_traded_value_cr >= 0.01
"""))
def strategy_filtered_results(t: Tables) -> DataFrame:
    df = st.filter_results(
        historic_results(t), min_confidence=50, max_atr_pct=40, rsi_range=(45, 70),
        min_traded_value_cr=0.01,
    )
    df = st.display_rows(df)
    return df.select(
        "symbol", "signal_date", "strategy", "confidence_score", "entry_zone",
        st.quality_bucket().alias("bucket"),
    )


@query("strategy_history_summary", "A15", sql("""
SELECT count(*) AS total_setups, count(DISTINCT symbol) AS unique_symbols,
       count(*) FILTER (data_trust = 'Good data') AS clean_setups,
       count(*) FILTER (data_trust = 'Warning') AS warning_setups,
       count(*) FILTER (data_trust = 'Do not trust signal') AS untrusted_setups,
       count(*) FILTER (setup_type = 'Breakout' OR strategy LIKE '%Breakout%') AS breakout_setups,
       (SELECT strategy FROM strategy_counts ORDER BY c DESC, strategy DESC LIMIT 1) AS top_strategy,
       (SELECT max(c) FROM strategy_counts) AS top_strategy_count
FROM strategy_hits
"""))
def strategy_history_summary(t: Tables) -> DataFrame:
    return st.scan_summary(historic_results(t))


@query("top_clean_strategy_hits", "O2 O3", sql("""
SELECT symbol, trade_date AS signal_date, strategy, confidence_score FROM strategy_hits
WHERE data_trust = 'Good data' AND liquidity_status = 'Pass'
ORDER BY confidence_score DESC, risk_reward_known DESC, round(relative_volume, 2) DESC, symbol,
         strategy LIMIT 5
""".replace("risk_reward_known", "CASE WHEN atr_14 > 0 THEN 1 ELSE 0 END")))
def top_clean_strategy_hits(t: Tables) -> DataFrame:
    return st.top_clean_hits(historic_results(t)).select(
        "symbol", "signal_date", "strategy", "confidence_score"
    )


# --- last-bar scan ---------------------------------------------------------

@query("persisted_strategy_scan", "L3 W16 A20", sql("""
SELECT symbol, trade_date AS signal_date, strategy, data_trust, avg_traded_value_cr,
       CAST(greatest(0, least(90, base + adjust
         + CASE data_trust WHEN 'Warning' THEN -6 ELSE -18 END - 6)) AS DOUBLE)
         AS confidence_score
FROM (
  SELECT h.* EXCLUDE (data_trust, adjust), CASE WHEN liquidity_status = 'Low' OR close < 20
              OR coalesce(atr_pct > 200, false) OR as_of - trade_date > 5
         THEN 'Do not trust signal' ELSE 'Warning' END AS data_trust,
         CASE strategy WHEN 'EMA Stack Trend Filter' THEN 76
              WHEN '20/50 EMA Pullback In Uptrend' THEN 74
              WHEN 'Breakout With Relative Volume' THEN 78 ELSE 72 END AS base,
         CASE WHEN relative_volume >= 1.5 THEN 5 ELSE 0 END
         + CASE WHEN atr_pct BETWEEN 1 AND 5 THEN 4 ELSE 0 END
         + CASE liquidity_status WHEN 'Pass' THEN 5 WHEN 'Low' THEN -8 ELSE 0 END AS adjust
  FROM strategy_hits AS h CROSS JOIN today WHERE n = bar_count AND n >= 220)
""", bars="""
SELECT symbol, trade_date, arg_max(open, p) AS open, arg_max(high, p) AS high,
       arg_max(low, p) AS low, arg_max(close, p) AS close, arg_max(volume, p) AS volume
FROM (SELECT *, CASE source WHEN 'kite' THEN 2 ELSE 1 END AS p FROM bars2) GROUP BY 1, 2
"""))
def persisted_strategy_scan(t: Tables) -> DataFrame:
    """Triggered strategies on each symbol's last de-duplicated bar."""
    return strategy_results(t).select(
        "symbol", "signal_date", "strategy", "data_trust", "avg_traded_value_cr",
        "confidence_score",
    )


_TWO = """
SELECT * FROM bars2 WHERE source = 'kite' OR CAST(regexp_extract(symbol, '(\\d+)', 1) AS BIGINT) % 3 <> 0
"""
_BEST = """
SELECT symbol, trade_date, arg_max(open, p) AS open, arg_max(high, p) AS high,
       arg_max(low, p) AS low, arg_max(close, p) AS close, arg_max(volume, p) AS volume
FROM (SELECT *, CASE source WHEN 'kite' THEN 2 ELSE 1 END AS p FROM some_sources) GROUP BY 1, 2
"""


def some_sources(t: Tables) -> DataFrame:
    """Every third symbol has bars of one source only."""
    key = F.regexp_extract("symbol", r"(\d+)", 1).cast("long")
    return t.bars_two_source.where((F.col("source") == "kite") | (key % 3 != 0))


@query("strategy_source_counts", "A16", sql("""
SELECT count(*) FILTER (one = 'kite') AS kite_rows, count(*) FILTER (symbol LIKE '%1.NS') AS fallback_rows,
       count(*) FILTER (symbol LIKE '%2.NS') AS missing_freshness
FROM strategy_hits JOIN (SELECT symbol, CASE WHEN min(source) = max(source) THEN min(source) ELSE 'mixed' END AS one
                         FROM some_sources GROUP BY symbol) USING (symbol)
WHERE n = bar_count AND n >= 150
""", some_sources=_TWO, bars=_BEST))
def strategy_source_counts(t: Tables) -> DataFrame:
    """Where the hits' prices come from; some have a fallback reason, some no freshness."""
    found, _ = scan_strategies(some_sources(t), t.universe, t.as_of, 150, cfg=SCANNER)
    symbol = F.col("symbol")
    return st.source_counts(found.withColumns({
        "provider_fallback_reason": F.when(symbol.endswith("1.NS"), F.lit("timeout")).otherwise(F.lit("")),
        "data_freshness": F.when(~symbol.endswith("2.NS"), F.col("data_freshness")),
    }))


@query("strategy_scan_errors", "L3 A20", sql("""
SELECT u.symbol, 'insufficient persisted price history (' || coalesce(rows, 0) || ' rows)' AS message
FROM universe AS u LEFT JOIN (SELECT symbol, count(*) AS rows FROM bars GROUP BY symbol) AS b ON b.symbol = u.symbol
WHERE coalesce(rows, 0) < 400
""", some_sources=_TWO, bars=_BEST))
def strategy_scan_errors(t: Tables) -> DataFrame:
    """What a stored scan that asks for 400 bars cannot judge."""
    return scan_strategies(some_sources(t), t.universe, t.as_of, 400, cfg=SCANNER)[1]


part("quality_notes", """
SELECT symbol, list_filter([
         CASE WHEN moves > 0 THEN 'suspicious_price_moves: ' || moves
              || ' day(s) > 40.0% (possible unadjusted corporate action)' END,
         CASE WHEN age > 5 THEN 'stale_data: last bar is ' || age || ' day(s) old' END],
         lambda x: x IS NOT NULL) AS notes
FROM (SELECT symbol, max(as_of) - max(trade_date) AS age,
             count(*) FILTER (abs(close / prior_close - 1) * 100 > 40) AS moves
      FROM ind CROSS JOIN today GROUP BY symbol)
""")


@query("alert_previews", "P27 E1", sql("""
SELECT symbol, 'signal_active' AS severity, symbol || ': ' || signal AS title,
       'technical_signal' AS source, symbol || ': ' || signal || ' on the last bar.' AS opening
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY place) AS k FROM events_all
      WHERE n = bar_count) WHERE k <= 3
UNION ALL
SELECT symbol, 'data_quality', symbol || ': data warnings', 'data_quality',
       symbol || ': check the data first: ' || array_to_string(notes, '; ') || '.'
FROM quality_notes WHERE len(notes) > 0
UNION ALL
SELECT symbol, 'research_candidate', symbol || ': strong score', 'composite_score',
       symbol || ' scores ' || printf('%.1f', composite_score) || ' of 100 with '
         || active_signal_count || ' active signal(s).'
FROM scan_now WHERE composite_score >= 55 AND active_signal_count > 0
"""))
def alert_previews(t: Tables) -> DataFrame:
    """All three kinds from one scan and its signals; the floor of the score is lower than usual."""
    t = t.with_stored_bars()
    rows = materialise(indicators(t).where(sg.is_last_bar()), "last-bars")
    scored = scan_universe(t.bars, t.universe, t.as_of, last_bars=rows).select(
        "symbol", "active_signals", "active_signal_count", F.col("composite_score").alias("score"),
        F.col("data_quality_warnings").alias("warnings"),
    )
    found = sg.alert_candidates(scored, sg.scan_latest_signals(rows), min_score=55)
    sentence = F.when(F.col("severity") == "data_quality", F.col("message")).otherwise(
        F.concat(F.substring_index(F.regexp_replace("message", r"\. ", ".\n"), "\n", 1))
    )
    return found.select("symbol", "severity", "title", "source", sentence.alias("opening"))


_AMOUNTS = {
    "close": "close", "entry_zone_low": "close - 0.5 * a", "entry_zone_high": "close + 0.25 * a",
    "stop_loss": "close - 2 * a", "target_price": "close + 5 * a", "rsi": "rsi_14",
    "relative_volume": "relative_volume", "atr_pct": "atr_pct", "ema_20": "ema_20", "ema_50": "ema_50",
    "ema_100": "ema_100", "ema_200": "ema_200",
    "breakout_level": "CASE WHEN setup_type = 'Breakout' THEN level END",
}


@query("strategy_rows", "P20 P13 P19", sql(f"""
SELECT h.symbol, u.name AS company_name, u.sector, strategy, setup_type, trade_date AS signal_date,
       {', '.join(f"{_two(v)} AS {k}" for k, v in _AMOUNTS.items())},
       CASE WHEN a IS NOT NULL THEN 2.5::DOUBLE END AS risk_reward, ma_stack_status AS trend_status, liquidity_status,
       strftime(trade_date, '%Y-%m-%d') AS data_freshness, confidence_score,
       CASE strategy WHEN 'EMA Stack Trend Filter' THEN 'Price is'
            WHEN 'RSI 60 Momentum Continuation' THEN 'RSI is'
            WHEN '20/50 EMA Pullback In Uptrend' THEN 'Price is'
            WHEN 'Breakout With Relative Volume' THEN 'Close broke' ELSE 'Close is' END AS why_this_appeared,
       CASE WHEN strategy = '20/50 EMA Pullback In Uptrend' THEN CASE WHEN near20 <= near50 THEN '20 EMA' ELSE '50 EMA' END
            WHEN setup_type = 'Breakout' THEN CASE WHEN n >= 253 THEN '52-week high' ELSE '120-day high' END END AS named,
       'derived' AS data_source, u.market_cap_bucket, avg_traded_value_cr, data_trust,
       CAST(CASE WHEN liquidity_status = 'Pass' THEN 0 ELSE 2 END
         + CASE WHEN close < 20 THEN 1 ELSE 0 END + CASE WHEN atr_pct > 100 THEN 1 ELSE 0 END AS BIGINT) AS warnings,
       '' AS provider_fallback_reason
FROM (SELECT *, CASE WHEN atr_14 > 0 THEN atr_14 END AS a FROM strategy_hits) AS h
JOIN universe AS u ON u.symbol = h.symbol
"""))
def strategy_rows(t: Tables) -> DataFrame:
    """All columns of a result row; sentences by how they begin and what they name, warnings by number."""
    facts = t.universe.select("symbol", F.col("name").alias("company_name"), "sector", "market_cap_bucket")
    rows = history_rows(t).drop("company_name", "sector", "market_cap_bucket").join(facts, "symbol")
    found = st.evaluate_strategies(rows, F.col("trade_date"), cfg=SCANNER)
    why = F.col("why_this_appeared")
    named = F.regexp_extract(why, r"(?:near the|the prior) (\S+ \S+)(?: while| with|,)", 1)
    return found.withColumns({
        "named": F.nullif(named, F.lit("")), "why_this_appeared": F.substring_index(why, " ", 2),
        "warnings": F.size("warnings"),
    }).drop("key_risk")
