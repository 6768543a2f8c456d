"""Statements: ratios, growth, quality scores, source checks, summary and peer ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.bridge import Tables
from tickloom.functions.scalars import (
    from_crore, is_financial, market_cap_bucket, normalise_symbol, period_end, to_crore,
)
from tickloom.operators import fundamentals as fu
from tickloom.operators.quality import import_preview, validate_annual, validate_quarterly
from tickloom.operators.ranking import peer_ranks_long
from tickloom.queries.registry import query
from tickloom.queries.sqlbase import part, sql
from tickloom.session import materialise, shared_path
from tickloom.sources import readers


def annual_with_cap(t: Tables) -> DataFrame:
    """Annual rows whose market cap and EV come from the as-of close."""
    return t.once(
        "annual_with_cap", lambda: fu.reconstruct_market_cap(fu.with_all_amounts(t.annual), t.bars)
    )


# --- statements ---------------------------------------------------------------

@query("annual_statements", "S2 P28 P29", sql(
    "SELECT symbol, fiscal_year, period_end, revenue, net_income, total_assets, source "
    "FROM annual"), "revenue net_income total_assets")
def annual_statements(t: Tables) -> DataFrame:
    return readers.fundamentals(t.annual, source="derived").select(
        "symbol", "fiscal_year", "period_end", "revenue", "net_income", "total_assets", "source"
    )


@query("quarterly_statements", "S2 P28 P29", sql("""
SELECT symbol, fiscal_year, fiscal_quarter, CASE fiscal_quarter
         WHEN 1 THEN make_date(fiscal_year - 1, 6, 30) WHEN 2 THEN make_date(fiscal_year - 1, 9, 30)
         WHEN 3 THEN make_date(fiscal_year - 1, 12, 31) ELSE make_date(fiscal_year, 3, 31) END
         AS period_end, revenue, net_income FROM quarterly
"""), "revenue net_income")
def quarterly_statements(t: Tables) -> DataFrame:
    return t.quarterly.select(
        "symbol", "fiscal_year", "fiscal_quarter",
        period_end("fiscal_year", "fiscal_quarter").alias("period_end"), "revenue", "net_income",
    )


@query("statement_views", "P36", sql("""
SELECT symbol, fiscal_year, operating_cash_flow, capital_expenditure, free_cash_flow FROM annual
"""), "operating_cash_flow capital_expenditure free_cash_flow")
def statement_views(t: Tables) -> DataFrame:
    return readers.statement_view(t.annual, "cash_flow")


@query("balance_sheet_view", "P36", sql("""
SELECT symbol, fiscal_year, total_assets, total_liabilities, current_assets, current_liabilities,
       retained_earnings, book_value, total_liabilities * 0.5 AS debt, net_debt,
       current_assets * 0.1 AS cash_and_equivalents, shares_outstanding,
       shares_outstanding * 10.0 AS market_cap, CAST(NULL AS DOUBLE) AS enterprise_value FROM annual
"""), "total_assets total_liabilities current_assets current_liabilities retained_earnings book_value "
      "debt net_debt cash_and_equivalents market_cap enterprise_value")
def balance_sheet_view(t: Tables) -> DataFrame:
    full = t.annual.withColumns({
        "debt": F.col("total_liabilities") * 0.5,
        "cash_and_equivalents": F.col("current_assets") * 0.1,
        "market_cap": F.col("shares_outstanding") * 10.0,
        "enterprise_value": F.lit(None).cast("double"),
    })
    return readers.statement_view(full, "balance")


@query("income_statement_view", "P36", sql("""
SELECT symbol, fiscal_year, revenue, gross_profit, ebitda, ebit, net_income, eps FROM annual
"""), "revenue gross_profit ebitda ebit net_income eps")
def income_statement_view(t: Tables) -> DataFrame:
    return readers.statement_view(t.annual, "income")


@query("combined_statements", "J7", sql("""
SELECT coalesce(i.symbol, b.symbol, c.symbol) AS symbol,
       coalesce(i.fiscal_year, b.fiscal_year, c.fiscal_year) AS fiscal_year,
       i.revenue, b.total_assets, c.operating_cash_flow
FROM (SELECT * FROM annual WHERE fiscal_year >= 1996) AS i
FULL JOIN (SELECT * FROM annual WHERE fiscal_year <= 2000) AS b
  ON i.symbol = b.symbol AND i.fiscal_year = b.fiscal_year
FULL JOIN (SELECT * FROM annual WHERE fiscal_year <> 1998) AS c
  ON coalesce(i.symbol, b.symbol) = c.symbol
 AND coalesce(i.fiscal_year, b.fiscal_year) = c.fiscal_year
"""), "revenue total_assets operating_cash_flow")
def combined_statements(t: Tables) -> DataFrame:
    a, year = t.annual, F.col("fiscal_year")
    keys = ["symbol", "fiscal_year"]
    return fu.combine_statements(
        a.where(year >= 1996).select(*keys, "revenue"),
        a.where(year <= 2000).select(*keys, "total_assets"),
        a.where(year != 1998).select(*keys, "operating_cash_flow"),
    )


_LABELS = {
    "revenue": ("Total Revenue", "Operating Revenue"),
    "net_income": ("Net Income", "Net Income Common Stockholders"),
    "total_assets": ("Total Assets",),
}


@query("statement_rows_to_columns", "P34", sql("""
SELECT a.symbol, CAST(y.fiscal_year AS VARCHAR) AS period, b.revenue, b.net_income, b.total_assets
FROM (SELECT DISTINCT symbol FROM annual) AS a
CROSS JOIN (SELECT DISTINCT fiscal_year FROM annual) AS y
LEFT JOIN annual AS b ON b.symbol = a.symbol AND b.fiscal_year = y.fiscal_year
"""), "revenue net_income total_assets")
def statement_rows_to_columns(t: Tables) -> DataFrame:
    """Statements turned into label rows × year columns, a weaker label included, and back."""
    value = F.col("v.value")
    rows = F.array(
        F.struct(F.lit("Operating Revenue").alias("label"), (F.col("revenue") * 0.5).alias("value")),
        F.struct(F.lit(" total revenue ").alias("label"), F.col("revenue").alias("value")),
        F.struct(F.lit("Net Income").alias("label"), F.col("net_income").alias("value")),
        F.struct(F.lit("Total Assets").alias("label"), F.col("total_assets").alias("value")),
        F.struct(F.lit("Unknown Line").alias("label"), F.lit(1.0).alias("value")),
    )
    years = sorted(r[0] for r in t.annual.select("fiscal_year").distinct().collect())
    wide = (
        t.annual.select("symbol", "fiscal_year", F.explode(rows).alias("v"))
        .groupBy("symbol", F.col("v.label").alias("label"))
        .agg(*[F.max(F.when(F.col("fiscal_year") == y, value)).alias(str(y)) for y in years])
    )
    return fu.statement_to_fields(wide, [str(y) for y in years], _LABELS)


@query("derived_statement_fields", "P35 P33", sql("""
SELECT symbol, fiscal_year, debt - cash AS net_debt,
       CASE WHEN p = 1 THEN cap END AS market_cap,
       CASE WHEN p = 1 THEN cap + coalesce(debt - cash, 0) END AS enterprise_value,
       CASE WHEN p = 1 THEN cap / 1e7 END AS market_cap_crore
FROM (SELECT symbol, fiscal_year, total_liabilities AS debt, current_assets * 0.2 AS cash,
             total_assets * 2 AS cap, row_number() OVER (PARTITION BY symbol
             ORDER BY fiscal_year DESC) AS p FROM annual)
"""), "net_debt market_cap enterprise_value market_cap_crore")
def derived_statement_fields(t: Tables) -> DataFrame:
    df = t.annual.select(
        "symbol", "fiscal_year", F.col("total_liabilities").alias("debt"),
        (F.col("current_assets") * 0.2).alias("cash_and_equivalents"),
        (F.col("total_assets") * 2).alias("market_cap"),
    )
    out = fu.derived_statement_fields(df)
    return out.select(
        "symbol", "fiscal_year", "net_debt", "market_cap", "enterprise_value",
        to_crore("market_cap").alias("market_cap_crore"),
    )


@query("market_cap_buckets", "P30 P33 P1", sql("""
SELECT symbol, CASE WHEN cap >= 20000 THEN 'large' WHEN cap >= 5000 THEN 'mid' ELSE 'small' END
       AS bucket
FROM (SELECT 'S' || s_suppkey || '.NS' AS symbol, (s_acctbal * 3) AS cap FROM supplier)
"""))
def market_cap_buckets(t: Tables) -> DataFrame:
    s = t.read("supplier").withColumn("cap", from_crore(F.col("s_acctbal") * 3))
    raw = F.concat(F.lit("  s"), F.col("s_suppkey").cast("string"), F.lit(" "))
    return s.select(
        normalise_symbol(raw).alias("symbol"), market_cap_bucket("cap").alias("bucket")
    )


# --- import -------------------------------------------------------------------

@query("manual_statement_import", "P37", sql("""
SELECT symbol, fiscal_year, -revenue AS revenue, round(eps, 2) AS eps,
       round(book_value / 1e7, 6) * 1e7 AS book_value, 'manual' AS source, 'INR' AS currency FROM annual
"""), "revenue book_value")
def manual_statement_import(t: Tables) -> DataFrame:
    """Statements written the way a spreadsheet shows them, then read back."""
    crore = F.format_number(F.abs(F.col("revenue")) / 1e7, 11)
    text = t.annual.select(
        F.lower(F.regexp_replace("symbol", r"\.NS$", "")).alias("Ticker "),
        F.concat(F.col("fiscal_year").cast("string"), F.lit(".0")).alias("Financial Year"),
        F.concat(F.lit("("), crore, F.lit(")")).alias("Sales"),
        F.concat(F.lit("Rs. "), F.format_number("eps", 2)).alias("EPS (Rs)"),
        F.format_number(F.round(F.col("book_value") / 1e7, 6), 6).alias("Book Value"),
    )
    return readers.import_statements(text, source="manual").select(
        "symbol", "fiscal_year", "revenue", "eps", "book_value", "source", "currency"
    )


@query("statement_csv_round_trip", "S6 S14", sql("""
SELECT symbol, fiscal_year, period_end, revenue, shares_outstanding FROM annual
"""), "revenue")
def statement_csv_round_trip(t: Tables) -> DataFrame:
    """Annual rows exported as CSV to the shared folder and scanned back."""
    path = shared_path(t.spark, "annual")
    readers.write_csv(t.annual, path)
    return readers.annual_csv(t.spark, path).select(
        "symbol", "fiscal_year", "period_end", "revenue", "shares_outstanding"
    )


@query("holdings_summary", "P38", sql("""
SELECT symbol, s_acctbal_pct AS insider_pct, 55.5::DOUBLE AS institution_pct, 60.25::DOUBLE AS float_pct,
       'Fund A' AS top_holder, 12.0::DOUBLE AS top_holder_pct
FROM (SELECT 'S' || s_suppkey || '.NS' AS symbol,
             CASE WHEN abs(s_acctbal) / 20000 < 1 THEN abs(s_acctbal) / 20000 * 100
                  ELSE abs(s_acctbal) / 20000 END AS s_acctbal_pct FROM supplier)
"""), "insider_pct institution_pct float_pct top_holder_pct", 6)
def holdings_summary(t: Tables) -> DataFrame:
    s = t.read("supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit(".NS")).alias("symbol"),
        (F.abs("s_acctbal") / 20000).alias("insider"),
    )
    major = s.select("symbol", F.explode(F.array(
        F.struct(F.lit("% of Shares Held by All Insider").alias("category"),
                 F.col("insider").cast("string").alias("value")),
        F.struct(F.lit("% of Shares Held by Institutions").alias("category"),
                 F.lit("0.555").alias("value")),
        F.struct(F.lit("% of Float Held by Institutions").alias("category"),
                 F.lit("60.25%").alias("value")),
    )).alias("r")).select("symbol", "r.category", "r.value")
    holders = s.select("symbol", F.explode(F.array(
        F.struct(F.lit(1).alias("position"), F.lit("Fund A").alias("holder"),
                 F.lit("0.12").alias("pct_held")),
        F.struct(F.lit(2).alias("position"), F.lit("Fund B").alias("holder"),
                 F.lit("0.5").alias("pct_held")),
    )).alias("r")).select("symbol", "r.position", "r.holder", "r.pct_held")
    return readers.holdings_summary(major, holders).drop("data_available")


# --- ratios, growth and scores --------------------------------------------------

part("cap", """
SELECT a.*, close, CASE WHEN close IS NOT NULL AND shares_outstanding > 0
                        THEN shares_outstanding * close END AS market_cap,
       CASE WHEN close IS NOT NULL AND shares_outstanding > 0
            THEN shares_outstanding * close + coalesce(net_debt, 0) END AS enterprise_value
FROM annual AS a LEFT JOIN (
  SELECT a.symbol, a.fiscal_year, arg_max(b.close, b.trade_date) AS close
  FROM annual AS a JOIN bars AS b ON b.symbol = a.symbol AND b.trade_date <= a.period_end
       AND b.trade_date >= a.period_end - 14
  GROUP BY 1, 2) USING (symbol, fiscal_year)
""")


@query("market_cap_as_of", "J1", sql("""
SELECT symbol, fiscal_year, period_end, market_cap, enterprise_value - market_cap AS ev_less_cap
FROM cap
"""), "ev_less_cap")
def market_cap_as_of(t: Tables) -> DataFrame:
    return annual_with_cap(t).select(
        "symbol", "fiscal_year", "period_end", "market_cap",
        (F.col("enterprise_value") - F.col("market_cap")).alias("ev_less_cap"),
    )


part("ratio", """
SELECT cap.*, net_income / nullif(total_assets, 0) AS return_on_assets,
       net_income / nullif(book_value, 0) AS return_on_equity,
       ebit / nullif(total_assets - current_liabilities, 0) AS return_on_capital_employed,
       total_liabilities / nullif(book_value, 0) AS debt_to_equity,
       net_debt / nullif(ebitda, 0) AS net_debt_to_ebitda,
       current_assets / nullif(current_liabilities, 0) AS current_ratio,
       gross_profit / nullif(revenue, 0) AS gross_margin,
       ebitda / nullif(revenue, 0) AS ebitda_margin, net_income / nullif(revenue, 0) AS pat_margin,
       operating_cash_flow / nullif(net_income, 0) AS operating_cash_flow_to_net_income,
       operating_cash_flow - abs(capital_expenditure) AS fcf,
       (operating_cash_flow - abs(capital_expenditure)) / nullif(market_cap, 0)
         AS free_cash_flow_yield,
       book_value / nullif(shares_outstanding, 0) AS book_value_per_share,
       market_cap / nullif(book_value, 0) AS price_to_book,
       market_cap / nullif(net_income, 0) AS price_to_earnings,
       enterprise_value / nullif(ebitda, 0) AS ev_to_ebitda,
       enterprise_value / nullif(revenue, 0) AS ev_to_sales,
       revenue / nullif(total_assets, 0) AS asset_turnover
FROM cap
""")
_RATIOS = (
    "return_on_assets return_on_equity return_on_capital_employed debt_to_equity "
    "net_debt_to_ebitda current_ratio gross_margin ebitda_margin pat_margin "
    "operating_cash_flow_to_net_income free_cash_flow_yield price_to_book "
    "price_to_earnings ev_to_ebitda ev_to_sales asset_turnover"
).split()


@query("annual_ratios", "F1 F2", sql(
    f"SELECT symbol, fiscal_year, fcf AS free_cash_flow, round(eps, 2) AS eps, "
    f"round(book_value_per_share, 2) AS book_value_per_share, {', '.join(_RATIOS)} FROM ratio"),
    " ".join(["free_cash_flow", *_RATIOS]))
def annual_ratios(t: Tables) -> DataFrame:
    df = fu.basic_ratios(annual_with_cap(t))
    return df.select(
        "symbol", "fiscal_year", F.col("free_cash_flow_ratio_base").alias("free_cash_flow"),
        F.round("eps_ratio", 2).alias("eps"),
        F.round("book_value_per_share", 2).alias("book_value_per_share"), *_RATIOS,
    )


_GROWTH = {
    "revenue_growth": "revenue", "net_income_growth": "net_income", "eps_growth": "eps",
    "operating_cash_flow_growth": "operating_cash_flow", "free_cash_flow_growth": "fcf",
    "book_value_growth": "book_value",
}
part("growth", f"""
SELECT c.*, p.symbol IS NOT NULL AS has_previous,
       {', '.join(f'(c.{m} - p.{m}) / nullif(p.{m}, 0) AS {g}' for g, m in _GROWTH.items())}
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY fiscal_year) AS k FROM ratio) AS c
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY fiscal_year) AS k FROM ratio)
  AS p ON p.symbol = c.symbol AND p.k = c.k - 1
""")


@query("annual_growth", "W22", sql(
    f"SELECT symbol, fiscal_year, {', '.join(_GROWTH)} FROM growth"), " ".join(_GROWTH))
def annual_growth(t: Tables) -> DataFrame:
    return fu.annual_growth(t.annual).select("symbol", "fiscal_year", *_GROWTH)


part("quarter_growth", """
SELECT c.symbol, c.fiscal_year, c.fiscal_quarter,
""" + ",\n".join(
    f"(c.{m} - c.prev_{m}) / nullif(abs(c.prev_{m}), 0) AS {m}_qoq, "
    f"(c.{m} - y.{m}) / nullif(abs(y.{m}), 0) AS {m}_yoy"
    for m in ("revenue", "net_income", "ebitda", "eps")
) + """
FROM (SELECT *, """ + ", ".join(
    f"lag({m}) OVER (PARTITION BY symbol ORDER BY fiscal_year, fiscal_quarter) AS prev_{m}"
    for m in ("revenue", "net_income", "ebitda", "eps")
) + """ FROM quarterly) AS c
LEFT JOIN quarterly AS y ON y.symbol = c.symbol AND y.fiscal_year = c.fiscal_year - 1
 AND y.fiscal_quarter = c.fiscal_quarter
""")
_QUARTER = [f"{m}_{k}" for m in ("revenue", "net_income", "ebitda", "eps") for k in ("qoq", "yoy")]


@query("quarterly_growth", "W23 J6", sql(
    f"SELECT symbol, fiscal_year, fiscal_quarter, {', '.join(_QUARTER)} FROM quarter_growth"),
    " ".join(_QUARTER), 3)
def quarterly_growth(t: Tables) -> DataFrame:
    return fu.quarterly_growth(t.quarterly).select(
        "symbol", "fiscal_year", "fiscal_quarter", *_QUARTER
    )


_CAGR = [f"{m}_cagr_{n}y" for m in fu.CAGR_METRICS for n in fu.CAGR_YEARS]


@query("multi_year_cagr", "F3 J6", sql(
    "SELECT a.symbol, a.fiscal_year, " + ", ".join(
        f"CASE WHEN a.{m} > 0 AND y{n}.{m} > 0 THEN pow(a.{m} / y{n}.{m}, 1.0 / {n}) - 1 END "
        f"AS {m}_cagr_{n}y" for m in fu.CAGR_METRICS for n in fu.CAGR_YEARS)
    + " FROM annual AS a " + " ".join(
        f"LEFT JOIN annual AS y{n} ON y{n}.symbol = a.symbol AND y{n}.fiscal_year = "
        f"a.fiscal_year - {n}" for n in fu.CAGR_YEARS)), " ".join(_CAGR))
def multi_year_cagr(t: Tables) -> DataFrame:
    return fu.multi_year_cagr(t.annual).select("symbol", "fiscal_year", *_CAGR)


part("fscore", """
SELECT *, CASE WHEN pk THEN CAST(
    coalesce(CAST(net_income > 0 AS INT), 0) + coalesce(CAST(operating_cash_flow > 0 AS INT), 0)
  + coalesce(CAST(roa > p_roa AS INT), 0)
  + coalesce(CAST(operating_cash_flow > net_income AS INT), 0)
  + coalesce(CAST(lev < p_lev AS INT), 0) + coalesce(CAST(cr > p_cr AS INT), 0)
  + coalesce(CAST(sh <= p_sh AS INT), 0) + coalesce(CAST(gm > p_gm AS INT), 0)
  + coalesce(CAST(turn > p_turn AS INT), 0) AS DOUBLE) END AS piotroski_f_score,
  CASE WHEN pk THEN array_to_string(list_filter([
    CASE WHEN net_income IS NULL THEN 'positive_net_income' END,
    CASE WHEN operating_cash_flow IS NULL THEN 'positive_operating_cash_flow' END,
    CASE WHEN (roa > p_roa) IS NULL THEN 'return_on_assets_improved' END,
    CASE WHEN (operating_cash_flow > net_income) IS NULL THEN 'cash_flow_exceeds_net_income' END,
    CASE WHEN (lev < p_lev) IS NULL THEN 'lower_leverage' END,
    CASE WHEN (cr > p_cr) IS NULL THEN 'current_ratio_improved' END,
    CASE WHEN (sh <= p_sh) IS NULL THEN 'no_share_dilution' END,
    CASE WHEN (gm > p_gm) IS NULL THEN 'gross_margin_improved' END,
    CASE WHEN (turn > p_turn) IS NULL THEN 'asset_turnover_improved' END], lambda x: x IS NOT NULL),
    '; ') END AS piotroski_missing
FROM (
  SELECT *, coalesce(lag(true) OVER w, false) AS pk, lag(roa) OVER w AS p_roa,
         lag(lev) OVER w AS p_lev, lag(cr) OVER w AS p_cr, lag(sh) OVER w AS p_sh,
         lag(gm) OVER w AS p_gm, lag(turn) OVER w AS p_turn
  FROM (SELECT symbol, fiscal_year, net_income, operating_cash_flow,
               net_income / nullif(total_assets, 0) AS roa,
               total_liabilities / nullif(total_assets, 0) AS lev,
               current_assets / nullif(current_liabilities, 0) AS cr, shares_outstanding AS sh,
               gross_profit / nullif(revenue, 0) AS gm, revenue / nullif(total_assets, 0) AS turn
        FROM annual)
  WINDOW w AS (PARTITION BY symbol ORDER BY fiscal_year))
""")


@query("piotroski_scores", "F4", sql(
    "SELECT symbol, fiscal_year, piotroski_f_score, piotroski_missing FROM fscore"))
def piotroski_scores(t: Tables) -> DataFrame:
    return fu.piotroski(t.annual).select(
        "symbol", "fiscal_year", "piotroski_f_score", "piotroski_missing"
    )


part("zscore", """
SELECT symbol, fiscal_year, 1.2 * (current_assets - current_liabilities) / nullif(total_assets, 0)
       + 1.4 * retained_earnings / nullif(total_assets, 0) + 3.3 * ebit / nullif(total_assets, 0)
       + 0.6 * market_cap / nullif(total_liabilities, 0) + revenue / nullif(total_assets, 0)
         AS altman_z_score FROM cap
""")


@query("altman_scores", "F5", sql("SELECT * FROM zscore"), "altman_z_score")
def altman_scores(t: Tables) -> DataFrame:
    return fu.altman(annual_with_cap(t)).select("symbol", "fiscal_year", "altman_z_score")


_HEALTH = (
    "interest_coverage dso_days dio_days dpo_days ccc_days working_capital "
    "working_capital_yoy_change working_capital_3y_slope"
).split()
part("health", """
SELECT a.symbol, a.fiscal_year, a.ebit / nullif(abs(a.interest_expense), 0) AS interest_coverage,
       a.accounts_receivable / nullif(a.revenue, 0) * 365 AS dso_days,
       a.inventory / nullif(a.cost_of_revenue, 0) * 365 AS dio_days,
       a.accounts_payable / nullif(a.cost_of_revenue, 0) * 365 AS dpo_days,
       a.accounts_receivable / nullif(a.revenue, 0) * 365
         + a.inventory / nullif(a.cost_of_revenue, 0) * 365
         - a.accounts_payable / nullif(a.cost_of_revenue, 0) * 365 AS ccc_days,
       a.current_assets - a.current_liabilities AS working_capital,
       (a.current_assets - a.current_liabilities - (y1.current_assets - y1.current_liabilities))
         / nullif(y1.current_assets - y1.current_liabilities, 0) AS working_capital_yoy_change,
       (a.current_assets - a.current_liabilities - (y3.current_assets - y3.current_liabilities)) / 3
         AS working_capital_3y_slope
FROM annual AS a
LEFT JOIN annual AS y1 ON y1.symbol = a.symbol AND y1.fiscal_year = a.fiscal_year - 1
LEFT JOIN annual AS y3 ON y3.symbol = a.symbol AND y3.fiscal_year = a.fiscal_year - 3
""")


@query("extended_health", "F6 W24", sql(
    f"SELECT symbol, fiscal_year, {', '.join(_HEALTH)} FROM health"), " ".join(_HEALTH))
def extended_health(t: Tables) -> DataFrame:
    return fu.extended_health(t.annual).select("symbol", "fiscal_year", *_HEALTH)


@query("latest_health", "W24 F6", sql("""
SELECT symbol, max(fiscal_year) AS fiscal_year,
       arg_max(working_capital, fiscal_year) FILTER (working_capital IS NOT NULL)
         AS working_capital,
       (SELECT h2.working_capital_3y_slope FROM health h2 WHERE h2.symbol = h.symbol
          AND h2.working_capital IS NOT NULL ORDER BY fiscal_year DESC LIMIT 1)
         AS working_capital_3y_slope
FROM health AS h GROUP BY symbol
"""), "working_capital working_capital_3y_slope")
def latest_health(t: Tables) -> DataFrame:
    return fu.latest_health(t.annual).select(
        "symbol", "fiscal_year", "working_capital", "working_capital_3y_slope"
    )


# --- sources ------------------------------------------------------------------

@query("preferred_source_years", "W17 A19", sql("""
SELECT symbol, fiscal_year, source, revenue FROM annual2 WHERE source = 'B'
"""), "revenue")
def preferred_source_years(t: Tables) -> DataFrame:
    return fu.preferred_source(t.annual_two_source, ["symbol", "fiscal_year"], "B").select(
        "symbol", "fiscal_year", "source", "revenue"
    )


@query("source_disagreements", "A8", sql("""
SELECT symbol, fiscal_year, field, count(*) AS sources, min(value) AS low, max(value) AS high,
       (max(value) - min(value)) / abs(max(value)) AS relative_diff
FROM (SELECT symbol, fiscal_year, source, unnest(['revenue', 'net_income', 'ebitda', 'eps',
        'operating_cash_flow', 'total_assets']) AS field, unnest([revenue, net_income, ebitda, eps,
        operating_cash_flow, total_assets]) AS value FROM annual2)
WHERE value IS NOT NULL GROUP BY 1, 2, 3
HAVING count(*) >= 2 AND max(value) <> 0 AND (max(value) - min(value)) / abs(max(value)) > 0.05
"""), "low high relative_diff", 6)
def source_disagreements(t: Tables) -> DataFrame:
    """With two sources the upper median is the larger value."""
    return fu.source_disagreements(t.annual_two_source)


# --- validation ---------------------------------------------------------------

def _with_sector(t: Tables) -> DataFrame:
    return annual_with_cap(t).join(t.universe.select("symbol", "sector", "industry"), "symbol")


@query("annual_validation", "A21 P32 E5", sql("""
SELECT symbol, count(*) AS rows, '' AS errors, 'missing_score_inputs: [''' ||
       array_to_string(list_sort(list_filter([
         'cash_and_equivalents', 'debt', 'free_cash_flow',
         CASE WHEN count(gross_profit) < count(*) THEN 'gross_profit' END,
         CASE WHEN count(ebitda) < count(*) THEN 'ebitda' END,
         CASE WHEN count(ebit) < count(*) THEN 'ebit' END,
         CASE WHEN count(net_income) < count(*) THEN 'net_income' END,
         CASE WHEN count(eps) < count(*) THEN 'eps' END,
         CASE WHEN count(operating_cash_flow) < count(*) THEN 'operating_cash_flow' END,
         CASE WHEN count(book_value) < count(*) THEN 'book_value' END,
         CASE WHEN count(total_liabilities) < count(*) THEN 'total_liabilities' END,
         CASE WHEN count(net_debt) < count(*) THEN 'net_debt' END,
         CASE WHEN count(current_assets) < count(*) THEN 'current_assets' END,
         CASE WHEN count(current_liabilities) < count(*) THEN 'current_liabilities' END,
         CASE WHEN count(retained_earnings) < count(*) THEN 'retained_earnings' END,
         CASE WHEN count(market_cap) < count(*) THEN 'market_cap' END,
         CASE WHEN count(enterprise_value) < count(*) THEN 'enterprise_value' END],
         lambda x: x IS NOT NULL)), ''', ''') || ''']' AS warnings, true AS ok
FROM cap GROUP BY symbol
"""))
def annual_validation(t: Tables) -> DataFrame:
    return validate_annual(_with_sector(t))


@query("quarterly_validation", "A22", sql("""
SELECT symbol, count(*) AS rows, '' AS errors,
       CASE WHEN count(net_income) = 0 THEN 'all_null_net_income' ELSE '' END AS warnings,
       true AS ok
FROM quarterly GROUP BY symbol
"""))
def quarterly_validation(t: Tables) -> DataFrame:
    return validate_quarterly(t.quarterly)


@query("import_gate", "A24", sql("""
SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols FROM annual
WHERE symbol NOT IN (SELECT symbol FROM annual WHERE revenue < 20000)
"""))
def import_gate(t: Tables) -> DataFrame:
    """Rows of symbols with a non-positive amount stay out; the others are imported."""
    frame = _with_sector(t).withColumn(
        "revenue", F.when(F.col("revenue") < 20000, -F.col("revenue")).otherwise(F.col("revenue"))
    )
    frame = materialise(frame)
    accepted, _ = import_preview(frame, validate_annual(frame))
    return accepted.agg(
        F.count("*").alias("rows"), F.count_distinct("symbol").alias("symbols")
    )


@query("financial_sector_flags", "P31", sql("""
SELECT symbol, regexp_matches(lower(symbol || ' ' || sector || ' ' || industry),
  'bank|banks|financial|finance|nbfc|insurance|asset management|capital markets|broking')
  OR industry IN ('NATION_1', 'NATION_12') AS is_financial FROM universe
"""))
def financial_sector_flags(t: Tables) -> DataFrame:
    named = F.when(
        F.col("industry").isin("NATION_1", "NATION_12"), F.lit("Private Banks")
    ).otherwise(F.col("industry"))
    return t.universe.select("symbol", is_financial("symbol", "sector", named).alias("is_financial"))


@query("industrial_metric_visibility", "P32", sql("""
SELECT symbol, fiscal_year, CASE WHEN industry NOT IN ('NATION_1', 'NATION_12')
       THEN total_liabilities / nullif(book_value, 0) END AS debt_to_equity,
       net_income / nullif(total_assets, 0) AS return_on_assets
FROM annual JOIN universe USING (symbol)
"""), "debt_to_equity return_on_assets")
def industrial_metric_visibility(t: Tables) -> DataFrame:
    named = F.when(
        F.col("industry").isin("NATION_1", "NATION_12"), F.lit("Private Banks")
    ).otherwise(F.col("industry"))
    df = fu.basic_ratios(fu.with_all_amounts(t.annual)).join(
        t.universe.select("symbol", "sector", named.alias("industry")), "symbol"
    )
    return fu.hide_industrial_metrics(df).select(
        "symbol", "fiscal_year", "debt_to_equity", "return_on_assets"
    )


# --- summary and ranks ----------------------------------------------------------

part("summary", """
SELECT u.symbol, u.sector, u.industry, u.market_cap_bucket, g.fiscal_year, g.revenue,
       g.revenue_growth * 100 AS revenue_growth_pct,
       g.net_income_growth * 100 AS net_income_growth_pct, g.eps_growth * 100 AS eps_growth_pct,
       g.free_cash_flow_growth * 100 AS free_cash_flow_growth_pct,
       g.return_on_assets * 100 AS roa_pct, g.return_on_equity * 100 AS roe_pct,
       g.return_on_capital_employed * 100 AS roce_pct, g.debt_to_equity, g.net_debt_to_ebitda,
       g.ebitda_margin * 100 AS ebitda_margin_pct, g.pat_margin * 100 AS pat_margin_pct,
       g.free_cash_flow_yield * 100 AS free_cash_flow_yield_pct, g.price_to_book,
       g.price_to_earnings, g.ev_to_ebitda, g.ev_to_sales, f.piotroski_f_score, z.altman_z_score,
       q.revenue_qoq * 100 AS revenue_qoq_pct, q.revenue_yoy * 100 AS revenue_yoy_pct
FROM universe AS u
LEFT JOIN (SELECT * FROM growth QUALIFY row_number() OVER (PARTITION BY symbol
           ORDER BY fiscal_year DESC) = 1) AS g ON g.symbol = u.symbol
LEFT JOIN fscore AS f ON f.symbol = g.symbol AND f.fiscal_year = g.fiscal_year
LEFT JOIN zscore AS z ON z.symbol = g.symbol AND z.fiscal_year = g.fiscal_year
LEFT JOIN (SELECT * FROM quarter_growth QUALIFY row_number() OVER (PARTITION BY symbol
           ORDER BY fiscal_year DESC, fiscal_quarter DESC) = 1) AS q ON q.symbol = u.symbol
""")
_SUMMARY = (
    "revenue_growth_pct net_income_growth_pct eps_growth_pct free_cash_flow_growth_pct roa_pct "
    "roe_pct roce_pct debt_to_equity net_debt_to_ebitda ebitda_margin_pct pat_margin_pct "
    "free_cash_flow_yield_pct price_to_book price_to_earnings ev_to_ebitda ev_to_sales "
    "piotroski_f_score altman_z_score revenue_qoq_pct revenue_yoy_pct"
).split()


def summary_rows(t: Tables, ranks: bool) -> DataFrame:
    return fu.fundamentals_summary(annual_with_cap(t), t.quarterly, t.universe, ranks=ranks)


@query("fundamentals_summary", "F7 L7 J10", sql(
    f"SELECT symbol, fiscal_year, sector, industry, market_cap_bucket, {', '.join(_SUMMARY)} "
    "FROM summary"), " ".join(_SUMMARY), 3)
def fundamentals_summary(t: Tables) -> DataFrame:
    return summary_rows(t, False).select(
        "symbol", "fiscal_year", "sector", "industry", "market_cap_bucket", *_SUMMARY
    )


_HIGH = (
    "roe_pct roa_pct roce_pct revenue_growth_pct net_income_growth_pct eps_growth_pct "
    "free_cash_flow_growth_pct free_cash_flow_yield_pct piotroski_f_score altman_z_score"
).split()
_LOW = (
    "debt_to_equity net_debt_to_ebitda price_to_book price_to_earnings ev_to_ebitda ev_to_sales"
).split()
part("metric_rows", "\nUNION ALL\n".join(
    [f"SELECT symbol, sector, industry, market_cap_bucket, '{m}' AS metric, {m} AS v FROM summary"
     for m in _HIGH]
    + [f"SELECT symbol, sector, industry, market_cap_bucket, '{m}', -{m} FROM summary"
       for m in _LOW]))
part("ranks", "\nUNION ALL\n".join(
    f"""SELECT symbol, '{kind}' AS peer_kind, metric,
       (rank() OVER (PARTITION BY {column}, metric ORDER BY v) + (count(*) OVER
        (PARTITION BY {column}, metric, v) - 1) / 2.0)
       / count(*) OVER (PARTITION BY {column}, metric) * 100 AS rank_pct
FROM metric_rows WHERE v IS NOT NULL"""
    for column, kind in (
        ("sector", "sector"), ("industry", "industry"), ("market_cap_bucket", "mkt_cap"))))


@query("peer_percentile_ranks", "W18", sql(
    "SELECT symbol, peer_kind, metric, rank_pct FROM ranks"), "rank_pct")
def peer_percentile_ranks(t: Tables) -> DataFrame:
    return peer_ranks_long(materialise(summary_rows(t, False)))


@query("summary_with_ranks", "W18 L7", sql("""
SELECT s.symbol, max(rank_pct) FILTER (metric = 'roe_pct' AND peer_kind = 'sector')
         AS roe_pct_sector_rank,
       max(rank_pct) FILTER (metric = 'debt_to_equity' AND peer_kind = 'mkt_cap')
         AS debt_to_equity_mkt_cap_rank,
       max(rank_pct) FILTER (metric = 'price_to_earnings' AND peer_kind = 'industry')
         AS price_to_earnings_industry_rank
FROM summary AS s LEFT JOIN ranks AS r ON r.symbol = s.symbol GROUP BY s.symbol
"""), "roe_pct_sector_rank debt_to_equity_mkt_cap_rank price_to_earnings_industry_rank")
def summary_with_ranks(t: Tables) -> DataFrame:
    return summary_rows(t, True).select(
        "symbol", "roe_pct_sector_rank", "debt_to_equity_mkt_cap_rank",
        "price_to_earnings_industry_rank",
    )


@query("latest_period_per_symbol", "A19", sql("""
SELECT symbol, max(fiscal_year) AS fiscal_year,
       arg_max(fiscal_quarter, fiscal_year * 4 + fiscal_quarter) AS fiscal_quarter
FROM quarterly GROUP BY symbol
"""))
def latest_period_per_symbol(t: Tables) -> DataFrame:
    at = F.col("fiscal_year") * 4 + F.col("fiscal_quarter")
    return t.quarterly.groupBy("symbol").agg(
        F.max("fiscal_year").alias("fiscal_year"),
        F.max_by("fiscal_quarter", at).alias("fiscal_quarter"),
    )
