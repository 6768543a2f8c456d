"""Schemas of the persisted tables (money as DOUBLE, lists as arrays, dates as DATE)."""

from __future__ import annotations



_AMOUNTS = (
    "revenue double, gross_profit double, ebitda double, ebit double, net_income double, "
    "eps double, book_value double, operating_cash_flow double, capital_expenditure double, "
    "free_cash_flow double, debt double, net_debt double, cash_and_equivalents double, "
    "total_assets double, total_liabilities double, current_assets double, "
    "current_liabilities double, retained_earnings double, shares_outstanding double, "
    "market_cap double, enterprise_value double"
)
_PROVENANCE = "source string, source_url string, fetched_at timestamp"

DDL: dict[str, str] = {
    "stock_universe": (
        "symbol string, name string, exchange string, isin string, sector string, "
        "industry string, market_cap double, market_cap_bucket string, active boolean, "
        "listing_date date, delisting_date date"
    ),
    "fundamentals_annual": (
        f"symbol string, fiscal_year int, period_end date, currency string, {_AMOUNTS}, "
        "interest_expense double, accounts_receivable double, inventory double, "
        f"accounts_payable double, cost_of_revenue double, {_PROVENANCE}"
    ),
    "fundamentals_quarterly": (
        "symbol string, fiscal_year int, fiscal_quarter int, period_end date, currency string, "
        "revenue double, gross_profit double, ebitda double, ebit double, net_income double, "
        "eps double, operating_cash_flow double, free_cash_flow double, total_assets double, "
        f"total_liabilities double, {_PROVENANCE}"
    ),
    "delivery_data": (
        "symbol string, trade_date date, traded_qty double, deliverable_qty double, "
        "delivery_pct double, turnover_lacs double"
    ),
    "bulk_block_deals": (
        "symbol string, deal_date date, client_name string, deal_type string, buy_sell string, "
        "quantity double, price double, source string"
    ),
    "market_flows_daily": (
        "trade_date date, participant string, buy_value_cr double, sell_value_cr double, "
        f"net_value_cr double, {_PROVENANCE}"
    ),
    "corporate_actions": (
        f"symbol string, ex_date date, action_type string, value double, detail string, {_PROVENANCE}"
    ),
    "instrument_master": (
        "exchange string, tradingsymbol string, segment string, instrument_type string, "
        "instrument_token bigint, name string, tick_size double, lot_size int, expiry date, "
        "strike double"
    ),
    "index_membership_history": (
        "index_name string, symbol string, from_date date, to_date date, active boolean, "
        "source string, source_url string, observed_at timestamp"
    ),
    "price_daily": (
        "symbol string, trade_date date, open double, high double, low double, close double, "
        f"volume double, {_PROVENANCE}"
    ),
    "technical_snapshots": (
        "symbol string, as_of_date date, close double, sma_20 double, sma_50 double, "
        "sma_100 double, sma_200 double, ema_20 double, ema_50 double, ema_100 double, "
        "ema_200 double, rsi_14 double, macd double, macd_signal double, macd_hist double, "
        "atr_14 double, historical_volatility_20 double, relative_volume double, "
        f"ma_stack_status string, {_PROVENANCE}"
    ),
    "daily_refresh_runs": (
        "run_id string, universe_name string, source string, status string, "
        "started_at timestamp, finished_at timestamp, requested_symbols bigint, "
        "successful_symbols bigint, failed_symbols bigint, price_rows_upserted bigint, "
        "technical_rows_upserted bigint, duration_seconds double"
    ),
    "composite_scores": (
        "symbol string, as_of_date date, score double, band string, fundamentals_score double, "
        "technicals_score double, flows_score double, events_quality_score double, "
        "macro_sector_score double, active_signal_count int, active_signals array<string>, "
        "reasons array<string>, risks array<string>, missing_data array<string>, source string"
    ),
    "signal_audit": (
        "symbol string, as_of_date date, signal_name string, active boolean, strength string, "
        "detail string, trigger_price double, entry_zone_low double, entry_zone_high double, "
        "stop_loss double, target_price double, risk_reward double, confidence double, "
        "close double, rsi_14 double, ema_20 double, ema_50 double, ema_200 double, "
        "relative_volume double, scan_count int, source string, created_at timestamp, "
        "updated_at timestamp"
    ),
    "universe_scan_runs": (
        "run_id string, universe_name string, requested_symbols bigint, "
        "successful_symbols bigint, failed_symbols bigint, lookback_days int, "
        "min_score_filter double, min_signals_filter int, source string, note string, "
        "created_at timestamp"
    ),
    "universe_scan_results": (
        "run_id string, symbol string, composite_score double, band string, "
        "fundamentals_score double, technicals_score double, flows_score double, "
        "events_quality_score double, macro_sector_score double, active_signal_count int, "
        "active_signals array<string>, last_close double, rsi_14 double, ma_stack string, "
        "data_quality_warnings array<string>, error string"
    ),
    "strategy_scan_runs": (
        "run_id string, universe_name string, requested_symbols bigint, scanned_symbols bigint, "
        "failed_symbols bigint, created_at timestamp, note string"
    ),
    "strategy_scan_results": (
        "run_id string, symbol string, company_name string, sector string, strategy string, "
        "setup_type string, signal_date date, close double, entry_zone_low double, "
        "entry_zone_high double, stop_loss double, target_price double, risk_reward double, "
        "rsi double, trend_status string, relative_volume double, liquidity_status string, "
        "data_freshness string, confidence_score double, why_this_appeared string, "
        "key_risk string, atr_pct double, data_source string, market_cap_bucket string, "
        "ema_20 double, ema_50 double, ema_100 double, ema_200 double, breakout_level double, "
        "avg_traded_value_cr double, data_trust string, warnings array<string>, "
        "provider_fallback_reason string"
    ),
    "research_watchlist_items": (
        "user_id string, watchlist_name string, symbol string, source_universe string, "
        "source_run_id string, reason string, review_status string, tags string, notes string, "
        "active boolean, created_at timestamp, updated_at timestamp"
    ),
}

BANKING_DDL = (
    "symbol string, fiscal_year int, nim_pct double, gnpa_pct double, nnpa_pct double, "
    "casa_pct double, credit_growth_pct double, deposit_growth_pct double, "
    "capital_adequacy_pct double, source string, source_url string, last_updated string"
)


def names(table: str) -> list[str]:
    """Column names of a persisted table."""
    return [part.strip().split(" ")[0] for part in DDL[table].split(",") if part.strip()]
