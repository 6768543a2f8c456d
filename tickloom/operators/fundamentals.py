"""Ratios, growth, quality scores, as-of market cap, source checks, summary rows.

"Previous" has two meanings and they stay apart: the previous row (``lag``) and
the same period n years back (a RANGE frame over the fiscal year, which skips
missing years correctly and needs no self-join).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import is_financial, messages, safe_divide
from tickloom.operators.ranking import add_peer_ranks
from tickloom.session import materialise

# Fixed values.
CAGR_METRICS = (
    "revenue", "ebitda", "net_income", "eps", "operating_cash_flow", "free_cash_flow", "book_value",
)
CAGR_YEARS = (3, 5, 10)
PIOTROSKI_CRITERIA = (
    "positive_net_income", "positive_operating_cash_flow", "return_on_assets_improved",
    "cash_flow_exceeds_net_income", "lower_leverage", "current_ratio_improved",
    "no_share_dilution", "gross_margin_improved", "asset_turnover_improved",
)
COMPARED_FIELDS = (
    "revenue", "net_income", "ebitda", "eps", "operating_cash_flow", "total_assets",
)
AMOUNTS = (
    "revenue", "gross_profit", "ebitda", "ebit", "net_income", "eps", "book_value",
    "operating_cash_flow", "capital_expenditure", "free_cash_flow", "debt", "net_debt",
    "cash_and_equivalents", "total_assets", "total_liabilities", "current_assets",
    "current_liabilities", "retained_earnings", "shares_outstanding", "market_cap",
    "enterprise_value", "interest_expense", "accounts_receivable", "inventory",
    "accounts_payable", "cost_of_revenue",
)


def with_all_amounts(df: DataFrame) -> DataFrame:
    """Add the amount columns a source lacks as NULL."""
    absent = [a for a in AMOUNTS if a not in df.columns]
    return df.withColumns({a: F.lit(None).cast("double") for a in absent})


def free_cash_flow() -> Column:
    return F.coalesce(
        "free_cash_flow", F.col("operating_cash_flow") - F.abs("capital_expenditure")
    )


def basic_ratios(df: DataFrame) -> DataFrame:
    """Adds the 19 annual ratios; missing or zero parts give NULL."""
    c = F.col
    equity = c("total_assets") - c("total_liabilities")
    fcf = free_cash_flow()
    return df.withColumns(
        {
            "return_on_assets": safe_divide("net_income", "total_assets"),
            "return_on_equity": safe_divide("net_income", equity),
            "return_on_capital_employed": safe_divide(
                "ebit", c("total_assets") - c("current_liabilities")
            ),
            "debt_to_equity": safe_divide("total_liabilities", equity),
            "net_debt_to_ebitda": safe_divide("net_debt", "ebitda"),
            "current_ratio": safe_divide("current_assets", "current_liabilities"),
            "gross_margin": safe_divide("gross_profit", "revenue"),
            "ebitda_margin": safe_divide("ebitda", "revenue"),
            "pat_margin": safe_divide("net_income", "revenue"),
            "operating_cash_flow_to_net_income": safe_divide("operating_cash_flow", "net_income"),
            "free_cash_flow_ratio_base": fcf,
            "free_cash_flow_yield": safe_divide(fcf, "market_cap"),
            "eps_ratio": F.coalesce("eps", safe_divide("net_income", "shares_outstanding")),
            "book_value_per_share": safe_divide(equity, "shares_outstanding"),
            "price_to_book": safe_divide("market_cap", equity),
            "price_to_earnings": safe_divide("market_cap", "net_income"),
            "ev_to_ebitda": safe_divide("enterprise_value", "ebitda"),
            "ev_to_sales": safe_divide("enterprise_value", "revenue"),
            "asset_turnover": safe_divide("revenue", "total_assets"),
        }
    )


def _by_year() -> object:
    return Window.partitionBy("symbol").orderBy("fiscal_year")


def annual_growth(df: DataFrame) -> DataFrame:
    """Growth against the previous row of the symbol."""
    w = _by_year()
    sources = {
        "revenue_growth": F.col("revenue"),
        "net_income_growth": F.col("net_income"),
        "eps_growth": F.col("eps"),
        "operating_cash_flow_growth": F.col("operating_cash_flow"),
        "free_cash_flow_growth": free_cash_flow(),
        "book_value_growth": F.col("book_value"),
    }
    return df.withColumns(
        {
            name: safe_divide(value - F.lag(value).over(w), F.lag(value).over(w))
            for name, value in sources.items()
        }
    )


def quarterly_growth(df: DataFrame) -> DataFrame:
    """QoQ against the previous row, YoY against the same quarter one year back."""
    by_quarter = Window.partitionBy("symbol").orderBy("fiscal_year", "fiscal_quarter")
    position = F.col("fiscal_year") * 4 + F.col("fiscal_quarter")
    year_ago = Window.partitionBy("symbol").orderBy("_q").rangeBetween(-4, -4)
    df = df.withColumn("_q", position)
    out = {}
    for metric in ("revenue", "net_income", "ebitda", "eps"):
        for suffix, previous in (
            ("qoq", F.lag(metric).over(by_quarter)), ("yoy", F.first(metric).over(year_ago))
        ):
            out[f"{metric}_{suffix}"] = safe_divide(F.col(metric) - previous, F.abs(previous))
    return df.withColumns(out).drop("_q")


def cagr(start: Column, end: Column, years: int) -> Column:
    return F.when((start > 0) & (end > 0), F.pow(end / start, 1.0 / years) - 1.0)


def multi_year_cagr(df: DataFrame) -> DataFrame:
    """21 columns ``{metric}_cagr_{n}y`` per symbol-year."""
    out = {}
    for metric in CAGR_METRICS:
        for n in CAGR_YEARS:
            back = _by_year().rangeBetween(-n, -n)
            out[f"{metric}_cagr_{n}y"] = cagr(F.first(metric).over(back), F.col(metric), n)
    return df.withColumns(out)


def piotroski(df: DataFrame) -> DataFrame:
    """F-score against the previous row; NULL on the first row, unknown criteria listed."""
    w = _by_year()
    c = F.col
    roa = safe_divide("net_income", "total_assets")
    leverage = safe_divide("total_liabilities", "total_assets")
    current = safe_divide("current_assets", "current_liabilities")
    margin = safe_divide("gross_profit", "revenue")
    turnover = safe_divide("revenue", "total_assets")

    def was(value: Column) -> Column:
        return F.lag(value).over(w)

    checks = dict(
        zip(
            PIOTROSKI_CRITERIA,
            [
                c("net_income") > 0,
                c("operating_cash_flow") > 0,
                roa > was(roa),
                c("operating_cash_flow") > c("net_income"),
                leverage < was(leverage),
                current > was(current),
                c("shares_outstanding") <= was(c("shares_outstanding")),
                margin > was(margin),
                turnover > was(turnover),
            ],
            strict=True,
        )
    )
    df = df.withColumns({f"_{name}": check for name, check in checks.items()})
    df = df.withColumn("_has_previous", F.lag(F.lit(True)).over(w))
    points = reduce(
        lambda a, b: a + b,
        [F.coalesce(c(f"_{name}").cast("double"), F.lit(0.0)) for name in checks],
    )
    unknown = messages(*[F.when(c(f"_{name}").isNull(), F.lit(name)) for name in checks])
    return df.withColumns(
        {
            "piotroski_f_score": F.when(c("_has_previous"), points),
            "piotroski_missing": F.when(c("_has_previous"), unknown),
        }
    ).drop("_has_previous", *[f"_{name}" for name in checks])


def altman(df: DataFrame) -> DataFrame:
    c = F.col
    working = c("current_assets") - c("current_liabilities")
    z = (
        1.2 * safe_divide(working, "total_assets")
        + 1.4 * safe_divide("retained_earnings", "total_assets")
        + 3.3 * safe_divide("ebit", "total_assets")
        + 0.6 * safe_divide("market_cap", "total_liabilities")
        + safe_divide("revenue", "total_assets")
    )
    return df.withColumn("altman_z_score", z)


def extended_health(df: DataFrame) -> DataFrame:
    """Interest coverage, cash-conversion days and working-capital trend per year."""
    c = F.col
    dso = safe_divide("accounts_receivable", "revenue") * 365.0
    dio = safe_divide("inventory", "cost_of_revenue") * 365.0
    dpo = safe_divide("accounts_payable", "cost_of_revenue") * 365.0
    back = {n: _by_year().rangeBetween(-n, -n) for n in (1, 3)}
    df = df.withColumn("working_capital", c("current_assets") - c("current_liabilities"))
    before = F.first("working_capital").over(back[1])
    three = F.first("working_capital").over(back[3])
    return df.withColumns(
        {
            "interest_coverage": safe_divide("ebit", F.abs("interest_expense")),
            "dso_days": dso,
            "dio_days": dio,
            "dpo_days": dpo,
            "ccc_days": dso + dio - dpo,
            "working_capital_yoy_change": safe_divide(c("working_capital") - before, before),
            "working_capital_3y_slope": (c("working_capital") - three) / 3.0,
        }
    )


def latest_health(df: DataFrame) -> DataFrame:
    """Latest-year ratios with the trend of the latest year that has working capital."""
    full = extended_health(df)
    trend = full.where(F.col("working_capital").isNotNull()).groupBy("symbol").agg(
        *[
            F.max_by(name, "fiscal_year").alias(name)
            for name in ("working_capital", "working_capital_yoy_change", "working_capital_3y_slope")
        ]
    )
    ratios = ("interest_coverage", "dso_days", "dio_days", "dpo_days", "ccc_days")
    last = full.groupBy("symbol").agg(
        F.max("fiscal_year").alias("fiscal_year"),
        *[F.max_by(name, "fiscal_year").alias(name) for name in ratios],
    )
    return last.join(trend, "symbol", "left")


def reconstruct_market_cap(
    annual: DataFrame, prices: DataFrame, *, overwrite: bool = False, lookback_days: int = 14
) -> DataFrame:
    """Close on or before the period end, at most ``lookback_days`` old, times shares.

    Prices and statements share one window by symbol (an as-of join without a
    range join); an existing value is kept unless ``overwrite``.
    """
    w = (
        Window.partitionBy("symbol").orderBy("_at", "_is_year")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    quote = F.struct(F.col("trade_date").alias("day"), "close")
    points = prices.where(F.col("close").isNotNull()).select(
        "symbol", F.col("trade_date").alias("_at"), F.lit(0).alias("_is_year"), quote.alias("_quote")
    )
    years = annual.withColumns({"_at": F.col("period_end"), "_is_year": F.lit(1)})
    merged = points.unionByName(years, allowMissingColumns=True)
    seen = merged.withColumn("_seen", F.last("_quote", ignorenulls=True).over(w)).where("_is_year = 1")
    fresh = F.col("_seen.day") >= F.date_sub("period_end", lookback_days)
    cap = F.when(
        fresh & (F.col("shares_outstanding") > 0), F.col("shares_outstanding") * F.col("_seen.close")
    )
    known_cap, known_ev = F.col("market_cap"), F.col("enterprise_value")
    replace = cap.isNotNull() & (F.lit(overwrite) | known_cap.isNull())
    value = cap + F.coalesce("net_debt", F.lit(0.0))
    out = seen.withColumns(
        {
            "enterprise_value": F.when(
                replace & (F.lit(overwrite) | known_ev.isNull()), value
            ).otherwise(known_ev),
            "market_cap": F.when(replace, cap).otherwise(known_cap),
        }
    )
    return out.select(*annual.columns)


def preferred_source(df: DataFrame, keys: Sequence[str], preferred: str | None = None) -> DataFrame:
    """One row per key: the preferred source, else the first by name."""
    order = [F.col("source")]
    if preferred is not None:
        order.insert(0, (F.col("source") != preferred).cast("int"))
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_pos", F.row_number().over(w)).where("_pos = 1").drop("_pos")


def combine_statements(income: DataFrame, balance: DataFrame, cash: DataFrame) -> DataFrame:
    """Full outer join of the three statements per symbol-year."""
    keys = ["symbol", "fiscal_year"]
    out = income
    for side in (balance, cash):
        shared = [c for c in side.columns if c in out.columns and c not in keys]
        renamed = side.withColumnsRenamed({c: f"_{c}" for c in shared})
        out = out.join(renamed, keys, "full")
        if shared:
            out = out.withColumns({c: F.coalesce(c, f"_{c}") for c in shared}).drop(
                *[f"_{c}" for c in shared]
            )
    return out


def statement_to_fields(
    wide: DataFrame, period_columns: Sequence[str], labels: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Wide statement (label rows × period columns) to one row per symbol-period.

    ``labels`` maps a field to its labels in order of preference (a literal map
    of a few dozen entries).
    """
    entries = [
        (label.lower(), field, place)
        for field, names in labels.items() for place, label in enumerate(names)
    ]
    mapping = F.create_map(
        *[
            item
            for label, field, place in entries
            for item in (F.lit(label), F.struct(F.lit(field).alias("field"), F.lit(place).alias("place")))
        ]
    )
    long = (
        wide.withColumn("_m", F.element_at(mapping, F.lower(F.trim("label"))))
        .where(F.col("_m").isNotNull())
        .unpivot(["symbol", "_m"], list(period_columns), "period", "value")
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
    )
    picked = long.groupBy("symbol", "period", F.col("_m.field").alias("field")).agg(
        F.min_by("value", "_m.place").alias("value")
    )
    return picked.groupBy("symbol", "period").pivot("field", list(labels)).agg(F.first("value"))


def derived_statement_fields(df: DataFrame) -> DataFrame:
    """Net debt and EV; the quoted market cap belongs to the newest period only."""
    newest = Window.partitionBy("symbol").orderBy(F.col("fiscal_year").desc())
    df = df.withColumn("_pos", F.row_number().over(newest))
    cap = F.when(F.col("_pos") == 1, F.col("market_cap"))
    net_debt = F.col("debt") - F.col("cash_and_equivalents")
    return df.withColumns(
        {
            "net_debt": net_debt,
            "enterprise_value": cap + F.coalesce(net_debt, F.lit(0.0)),
            "market_cap": cap,
        }
    ).drop("_pos")


def source_disagreements(
    df: DataFrame, fields: Sequence[str] = COMPARED_FIELDS, tolerance: float = 0.05
) -> DataFrame:
    """Fields of one symbol-year whose sources differ by more than ``tolerance``.

    Spread over the upper median; mean of absolute values when that is zero.
    """
    keys = ["symbol", "fiscal_year", "field"]
    long = df.unpivot(
        ["symbol", "fiscal_year", "source"], list(fields), "field", "value"
    ).where(F.col("value").isNotNull())
    ordered = Window.partitionBy(*keys).orderBy("value", "source")
    whole = Window.partitionBy(*keys)
    placed = long.withColumns(
        {"_pos": F.row_number().over(ordered), "_n": F.count("*").over(whole)}
    )
    stats = placed.groupBy(*keys).agg(
        F.max("_n").alias("sources"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.max(F.when(F.col("_pos") == F.floor(F.col("_n") / 2) + 1, F.col("value"))).alias("_median"),
        F.avg(F.abs("value")).alias("_mean_abs"),
    )
    base = F.when(F.col("_median") == 0, F.col("_mean_abs")).otherwise(F.abs("_median"))
    diff = F.try_divide(F.col("high") - F.col("low"), base)
    return (
        stats.where(F.col("sources") >= 2)
        .withColumn("relative_diff", diff)
        .where(F.col("relative_diff") > tolerance)
        .drop("_median", "_mean_abs")
    )


SUMMARY_PERCENT = {
    "revenue_growth_pct": "revenue_growth",
    "net_income_growth_pct": "net_income_growth",
    "eps_growth_pct": "eps_growth",
    "free_cash_flow_growth_pct": "free_cash_flow_growth",
    "roa_pct": "return_on_assets",
    "roe_pct": "return_on_equity",
    "roce_pct": "return_on_capital_employed",
    "ebitda_margin_pct": "ebitda_margin",
    "pat_margin_pct": "pat_margin",
    "free_cash_flow_yield_pct": "free_cash_flow_yield",
}
SUMMARY_PLAIN = (
    "debt_to_equity", "net_debt_to_ebitda", "price_to_book", "price_to_earnings",
    "ev_to_ebitda", "ev_to_sales", "piotroski_f_score", "altman_z_score",
)
SUMMARY_QUARTERLY = (
    "revenue_qoq", "revenue_yoy", "net_income_qoq", "net_income_yoy", "ebitda_yoy", "eps_yoy",
)


def fundamentals_summary(
    annual: DataFrame,
    quarterly: DataFrame,
    universe: DataFrame,
    reports: DataFrame | None = None,
    *,
    ranks: bool = True,
) -> DataFrame:
    """One latest-year row per universe symbol, with peer ranks.

    ``reports``: symbol, errors, warnings arrays from the annual validation.
    """
    full = altman(piotroski(annual_growth(basic_ratios(with_all_amounts(annual)))))
    newest = Window.partitionBy("symbol").orderBy(F.col("fiscal_year").desc())
    last = full.withColumn("_pos", F.row_number().over(newest)).where("_pos = 1").select(
        "symbol", "fiscal_year", "revenue",
        *[(F.col(src) * 100).alias(name) for name, src in SUMMARY_PERCENT.items()],
        *SUMMARY_PLAIN, "source",
    )
    by_quarter = Window.partitionBy("symbol").orderBy(
        F.col("fiscal_year").desc(), F.col("fiscal_quarter").desc()
    )
    quarter = (
        quarterly_growth(quarterly).withColumn("_pos", F.row_number().over(by_quarter))
        .where("_pos = 1")
        .select("symbol", *[(F.col(q) * 100).alias(f"{q}_pct") for q in SUMMARY_QUARTERLY])
    )
    peers = universe.select("symbol", "sector", "industry", "market_cap_bucket")
    out = peers.join(last, "symbol", "left").join(quarter, "symbol", "left")
    empty = F.array().cast("array<string>")
    if reports is not None:
        out = out.join(reports.select("symbol", "errors", "warnings"), "symbol", "left")
        errors, warnings = F.coalesce("errors", empty), F.coalesce("warnings", empty)
    else:
        errors = warnings = empty
    other = F.filter(warnings, lambda m: ~m.startswith("missing_score_inputs"))
    status = (
        F.when(F.col("fiscal_year").isNull(), F.lit("no_data"))
        .when(F.size(errors) > 0, F.lit("error"))
        .when(F.array_contains(warnings, "sample_data_source"), F.lit("sample"))
        .when(F.size(other) > 0, F.lit("warning"))
        .otherwise(F.lit("ok"))
    )
    text = F.when(
        F.col("fiscal_year").isNull(), F.lit("No local fundamentals rows")
    ).otherwise(F.array_join(warnings, "; "))
    out = out.withColumns(
        {"status": status, "errors": F.array_join(errors, "; "), "warnings": text}
    )
    # Ranking passes over the summary several times: one row per symbol is stored
    # first so that the statements behind it are worked through once.
    return add_peer_ranks(materialise(out)) if ranks else out


def required_columns(financial: Column) -> Column:
    """Required annual columns by sector kind."""
    common = F.array(*[F.lit(c) for c in (
        "symbol", "fiscal_year", "revenue", "net_income", "total_assets", "total_liabilities",
        "shares_outstanding", "market_cap", "source",
    )])
    extra = F.array(*[F.lit(c) for c in (
        "gross_profit", "ebit", "operating_cash_flow", "current_assets", "current_liabilities",
        "retained_earnings",
    )])
    return F.when(financial, common).otherwise(F.concat(common, extra))


FINANCIAL_INPUTS = (
    "revenue", "net_income", "eps", "book_value", "total_assets", "total_liabilities",
    "shares_outstanding", "market_cap",
)
INDUSTRIAL_INPUTS = (
    "gross_profit", "ebitda", "ebit", "operating_cash_flow", "capital_expenditure",
    "free_cash_flow", "debt", "net_debt", "cash_and_equivalents", "current_assets",
    "current_liabilities", "retained_earnings", "enterprise_value",
)
HIDDEN_FOR_FINANCIALS = (
    "altman_z_score", "cash_conversion_cycle", "working_capital", "interest_coverage",
    "debt_to_equity", "roce",
)


def hide_industrial_metrics(df: DataFrame, financial: Column | None = None) -> DataFrame:
    """NULL the metrics that mean nothing for banks and financial services."""
    flag = is_financial("symbol", "sector", "industry") if financial is None else financial
    names = {"roce": "roce_pct", "cash_conversion_cycle": "ccc_days"}
    shown = [names.get(m, m) for m in HIDDEN_FOR_FINANCIALS]
    return df.withColumns({m: F.when(~flag, F.col(m)) for m in shown if m in df.columns})
