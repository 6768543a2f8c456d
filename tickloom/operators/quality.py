"""Data-quality reports: one row per symbol with error and warning lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.config import DEFAULT, QualityThresholds
from tickloom.functions.scalars import fixed, is_financial, messages, python_list_text
from tickloom.operators.fundamentals import FINANCIAL_INPUTS, INDUSTRIAL_INPUTS, required_columns

PRICE_COLUMNS = ("open", "high", "low", "close")


def _text(value: Column) -> Column:
    return value.cast("string")


def validate_ohlcv(
    prices: DataFrame, as_of: Column, symbols: DataFrame | None = None,
    cfg: QualityThresholds = DEFAULT.quality,
) -> DataFrame:
    """Per-symbol report; ``symbols`` adds the ones without any bar.

    Raw rows are first combined per (symbol, date), map-side, so repeated rows of
    one day never travel; numeric checks are skipped once a structural error
    exists.
    """
    absent = [p for p in ("open", "high", "low", "close", "volume") if p not in prices.columns]
    if absent:
        keys = prices.select("symbol").distinct()
        names = sorted(absent)
        return keys.select(
            "symbol", F.lit(None).cast("bigint").alias("rows"),
            F.array(F.lit(f"missing_columns: {names}")).alias("errors"),
            F.array().cast("array<string>").alias("warnings"), F.lit(False).alias("ok"),
        )
    negative = {p: F.count_if(F.col(p) < 0).alias(f"_neg_{p}") for p in PRICE_COLUMNS}
    daily = prices.groupBy("symbol", "trade_date").agg(
        F.count("*").alias("_rows"),
        F.count_if(F.col("close").isNull()).alias("_no_close"),
        F.count_if(F.coalesce(F.col("volume"), F.lit(0.0)) == 0).alias("_no_volume"),
        F.max("close").alias("close"),
        *negative.values(),
    )
    w = Window.partitionBy("symbol").orderBy("trade_date")
    padded = F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    daily = daily.withColumn("_padded", padded).withColumn("_before", F.lag("_padded").over(w))
    move = F.abs(F.try_divide("_padded", "_before") - 1.0) * 100.0
    report = daily.groupBy("symbol").agg(
        F.sum("_rows").alias("rows"),
        F.sum(F.col("_rows") - 1).alias("_dups"),
        F.sum("_no_close").alias("_no_close"),
        F.sum("_no_volume").alias("_no_volume"),
        F.count_if(move > cfg.max_single_day_move_pct).alias("_moves"),
        F.max("trade_date").alias("_last"),
        *[F.sum(f"_neg_{p}").alias(f"_neg_{p}") for p in PRICE_COLUMNS],
    )
    if symbols is not None:
        report = symbols.select("symbol").distinct().join(report, "symbol", "left")
    empty = F.col("rows").isNull()
    structural = empty | (F.col("_dups") > 0)
    missing_pct = F.try_divide(F.col("_no_close") * 100.0, F.col("rows"))
    age = F.datediff(as_of, F.col("_last"))

    def numeric(condition: Column, text: Column) -> Column:
        return F.when(~structural & condition, text)

    errors = messages(
        F.when(empty, F.lit("dataframe_empty")),
        F.when(
            F.col("_dups") > 0,
            F.concat(F.lit("duplicate_index: "), _text(F.col("_dups")), F.lit(" duplicates")),
        ),
        numeric(
            missing_pct > cfg.max_missing_close_pct,
            F.concat(F.lit("too_many_missing_close: "), fixed(missing_pct, 1),
                     F.lit(f"% > {cfg.max_missing_close_pct}%")),
        ),
        *[
            numeric(F.col(f"_neg_{p}") > 0, F.lit(f"negative_values_in_{p}"))
            for p in PRICE_COLUMNS
        ],
        numeric(F.col("_neg_close") > 0, F.lit("negative_values_in_adj_close")),
    )
    warnings = messages(
        numeric(
            F.col("_no_volume") > 0,
            F.concat(F.lit("zero_volume_rows: "), _text(F.col("_no_volume"))),
        ),
        numeric(
            F.col("_moves") > 0,
            F.concat(
                F.lit("suspicious_price_moves: "), _text(F.col("_moves")),
                F.lit(f" day(s) > {cfg.max_single_day_move_pct}% "
                      "(possible unadjusted corporate action)"),
            ),
        ),
        numeric(
            age > cfg.stale_price_days,
            F.concat(F.lit("stale_data: last bar is "), _text(age), F.lit(" day(s) old")),
        ),
    )
    return report.select(
        "symbol", F.coalesce("rows", F.lit(0)).alias("rows"), errors.alias("errors"),
        warnings.alias("warnings"), (F.size(errors) == 0).alias("ok"),
    )


def _any(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def validate_annual(frame: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Annual statements per symbol; sector decides the inputs that count.

    ``frame`` carries ``sector`` and ``industry``; a column the frame lacks is
    missing for every symbol.
    """
    inputs = (*FINANCIAL_INPUTS, *INDUSTRIAL_INPUTS)
    present = [c for c in inputs if c in frame.columns]
    have_year = F.col("fiscal_year").isNotNull()
    source = F.trim(F.coalesce(F.col("source").cast("string"), F.lit("")))
    positive = ("revenue", "total_assets", "shares_outstanding")

    def number(name: str) -> Column:
        return F.col(name).cast("string").try_cast("double")

    stats = frame.groupBy("symbol").agg(
        F.count("*").alias("rows"),
        (F.count("fiscal_year") - F.count_distinct("fiscal_year")).alias("_dups"),
        _any(~have_year).alias("_no_year"),
        F.max_by("sector", F.when(F.col("sector").isNotNull(), F.col("fiscal_year"))).alias("sector"),
        F.max_by("industry", F.when(F.col("industry").isNotNull(), F.col("fiscal_year"))).alias("industry"),
        _any(source == "").alias("_no_source"),
        _any(F.lower(source).contains("sample")).alias("_sample"),
        *[_any(F.col(c).isNull()).alias(f"_null_{c}") for c in present],
        *[_any(number(c).isNull() & F.col(c).isNotNull()).alias(f"_text_{c}") for c in present],
        *[_any(number(c) <= 0).alias(f"_low_{c}") for c in positive if c in frame.columns],
    )
    if symbols is not None:
        stats = symbols.select("symbol").distinct().join(stats, "symbol", "left")
    empty = F.col("rows").isNull()
    fin = is_financial("symbol", "sector", "industry")
    absent = [c for c in ("symbol", "fiscal_year", "revenue", "net_income", "total_assets",
                          "total_liabilities", "shares_outstanding", "market_cap", "source",
                          "gross_profit", "ebit", "operating_cash_flow", "current_assets",
                          "current_liabilities", "retained_earnings") if c not in frame.columns]
    lacking = F.array_sort(
        F.array_except(
            F.array_intersect(required_columns(fin), F.array(*[F.lit(a) for a in absent])),
            F.array().cast("array<string>"),
        )
    ) if absent else F.array().cast("array<string>")
    broken = F.size(lacking) > 0

    def wanted(name: str) -> Column:
        return F.lit(True) if name in FINANCIAL_INPUTS else ~fin

    def unless_broken(condition: Column, text: Column) -> Column:
        return F.when(~empty & ~broken & condition, text)

    nulls = F.array_sort(
        messages(
            *[
                F.when(
                    wanted(c) & (F.col(f"_null_{c}") if c in present else F.lit(True)), F.lit(c)
                )
                for c in inputs
            ]
        )
    )
    errors = messages(
        F.when(~empty & broken, F.concat(F.lit("missing_columns: "), python_list_text(lacking))),
        unless_broken(F.col("_no_year"), F.lit("missing_fiscal_year")),
        unless_broken(F.col("_dups") > 0, F.lit("duplicate_fiscal_year")),
        *[
            unless_broken(wanted(c) & F.col(f"_text_{c}") & ~F.col(f"_null_{c}"),
                          F.lit(f"non_numeric_{c}"))
            for c in present
        ],
        *[
            unless_broken(F.col(f"_low_{c}"), F.lit(f"non_positive_{c}"))
            for c in positive if c in frame.columns
        ],
    )
    warnings = messages(
        F.when(empty, F.lit("fundamentals_empty")),
        unless_broken(
            F.size(nulls) > 0, F.concat(F.lit("missing_score_inputs: "), python_list_text(nulls))
        ),
        unless_broken(fin, F.lit("financial_sector_rules_applied")),
        unless_broken(F.col("_no_source"), F.lit("missing_source")),
        unless_broken(F.col("_sample"), F.lit("sample_data_source")),
    )
    return _report(stats, errors, warnings)


def validate_quarterly(frame: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    quarter = F.col("fiscal_quarter")
    periods = frame.groupBy("symbol", "fiscal_year", "fiscal_quarter").agg(
        F.count("*").alias("_n"),
        F.count("revenue").alias("_revenue"),
        F.count("net_income").alias("_net_income"),
    )
    stats = periods.groupBy("symbol").agg(
        F.sum("_n").alias("rows"),
        _any(F.col("fiscal_year").isNull() | quarter.isNull()).alias("_no_period"),
        _any((quarter < 1) | (quarter > 4)).alias("_range"),
        _any(F.col("_n") > 1).alias("_dups"),
        F.sum("_revenue").alias("_revenue"),
        F.sum("_net_income").alias("_net_income"),
    )
    if symbols is not None:
        stats = symbols.select("symbol").distinct().join(stats, "symbol", "left")
    errors = messages(
        F.when(F.col("_no_period"), F.lit("missing_fiscal_period")),
        F.when(F.col("_range"), F.lit("fiscal_quarter_out_of_range")),
        F.when(F.col("_dups"), F.lit("duplicate_period")),
    )
    warnings = messages(
        F.when(F.col("rows").isNull(), F.lit("quarterly_empty")),
        F.when(F.col("_revenue") == 0, F.lit("all_null_revenue")),
        F.when(F.col("_net_income") == 0, F.lit("all_null_net_income")),
    )
    return _report(stats, errors, warnings)


BANK_PERCENT = ("nim_pct", "gnpa_pct", "nnpa_pct", "casa_pct", "capital_adequacy_pct")
BANK_GROWTH = ("credit_growth_pct", "deposit_growth_pct")
BANK_METRICS = (
    "nim_pct", "gnpa_pct", "nnpa_pct", "casa_pct", "credit_growth_pct", "deposit_growth_pct",
    "capital_adequacy_pct",
)


def validate_banking(frame: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    def number(name: str) -> Column:
        return F.col(name).cast("string").try_cast("double")

    def blank(name: str) -> Column:
        return F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) == ""

    updated = F.col("last_updated").cast("string").try_cast("date")
    stats = frame.groupBy("symbol").agg(
        F.count("*").alias("rows"),
        _any(F.col("fiscal_year").isNull()).alias("_no_year"),
        (F.count("fiscal_year") - F.count_distinct("fiscal_year")).alias("_dups"),
        *[_any(number(c).isNull() & ~blank(c)).alias(f"_text_{c}") for c in BANK_METRICS],
        *[_any((number(c) < 0) | (number(c) > 100)).alias(f"_range_{c}") for c in BANK_PERCENT],
        *[_any((number(c) < -100) | (number(c) > 200)).alias(f"_range_{c}") for c in BANK_GROWTH],
        *[_any(F.col(c).isNull()).alias(f"_null_{c}") for c in BANK_METRICS],
        _any(blank("source")).alias("_no_source"),
        _any(blank("source_url")).alias("_no_url"),
        _any(updated.isNull()).alias("_no_date"),
    )
    if symbols is not None:
        stats = symbols.select("symbol").distinct().join(stats, "symbol", "left")
    nulls = messages(*[F.when(F.col(f"_null_{c}"), F.lit(c)) for c in BANK_METRICS])
    errors = messages(
        F.when(F.col("_no_year"), F.lit("missing_fiscal_year")),
        F.when(F.col("_dups") > 0, F.lit("duplicate_fiscal_year")),
        *[F.when(F.col(f"_text_{c}"), F.lit(f"non_numeric_{c}"))
          for c in (*BANK_PERCENT, *BANK_GROWTH)],
        *[F.when(F.col(f"_range_{c}"), F.lit(f"percentage_out_of_range_{c}"))
          for c in BANK_PERCENT],
    )
    warnings = messages(
        F.when(F.col("rows").isNull(), F.lit("banking_fundamentals_empty")),
        *[F.when(F.col(f"_range_{c}"), F.lit(f"growth_outlier_{c}")) for c in BANK_GROWTH],
        F.when(F.size(nulls) > 0,
               F.concat(F.lit("missing_banking_metrics: "), python_list_text(nulls))),
        F.when(F.col("_no_source"), F.lit("missing_source")),
        F.when(F.col("_no_url"), F.lit("missing_source_url")),
        F.when(F.col("_no_date"), F.lit("invalid_or_missing_last_updated")),
    )
    return _report(stats, errors, warnings)


def _report(stats: DataFrame, errors: Column, warnings: Column) -> DataFrame:
    return stats.select(
        "symbol", F.coalesce("rows", F.lit(0)).alias("rows"), errors.alias("errors"),
        warnings.alias("warnings"), (F.size(errors) == 0).alias("ok"),
    )


def import_preview(frame: DataFrame, report: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, one preview row): rows of symbols with errors stay out."""
    bad = report.where(~F.col("ok")).select("symbol")
    accepted = frame.join(bad, "symbol", "left_anti")
    preview = report.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.count("*").alias("symbols"),
        F.count_if(~F.col("ok")).alias("failed_symbols"),
        F.count_if(F.size("warnings") > 0).alias("warned_symbols"),
    )
    return accepted, preview


def trust_checklist(inputs: DataFrame) -> DataFrame:
    """Seven areas per symbol with OK / PARTIAL / ACTION / N/A.

    ``inputs``: symbol, price_rows, price_errors, price_warnings, fundamental_rows,
    fundamental_errors, fundamental_warnings, banking_applicable, banking_rows,
    banking_errors, banking_warnings, active_signal_count, has_delivery,
    has_volatility, sources, disagreements, missing_data, risks.
    """

    def status(errors: str, warnings: str, rows: str) -> Column:
        return (
            F.when((F.size(errors) > 0) | (F.col(rows) == 0), F.lit("ACTION"))
            .when(F.size(warnings) > 0, F.lit("PARTIAL"))
            .otherwise(F.lit("OK"))
        )

    def ok_if(condition: Column) -> Column:
        return F.when(condition, F.lit("OK")).otherwise(F.lit("PARTIAL"))

    def number(name: str, text: str) -> Column:
        return F.concat(F.col(name).cast("string"), F.lit(text))

    def issues(errors: str, warnings: str, otherwise: str) -> Column:
        shown = F.array_join(F.slice(F.concat(errors, warnings), 1, 3), "; ")
        return F.when(shown != "", shown).otherwise(F.lit(otherwise))

    applicable = F.col("banking_applicable")
    delivery, volatility = F.col("has_delivery"), F.col("has_volatility")
    both_lists = (F.size("missing_data") == 0) & (F.size("risks") == 0)
    areas = [
        ("Price data", status("price_errors", "price_warnings", "price_rows"),
         F.concat(F.format_number("price_rows", 0), F.lit(" OHLCV rows")),
         issues("price_errors", "price_warnings", "Bars are there and were checked.")),
        ("Fundamentals", status("fundamental_errors", "fundamental_warnings", "fundamental_rows"),
         number("fundamental_rows", " annual row(s)"),
         issues("fundamental_errors", "fundamental_warnings",
                "Annual statements are there.")),
        ("Banking metrics",
         F.when(~applicable, F.lit("N/A")).otherwise(
             status("banking_errors", "banking_warnings", "banking_rows")),
         F.when(~applicable, F.lit("no bank")).otherwise(
             number("banking_rows", " bank row(s)")),
         F.when(~applicable,
                F.lit("Asked of banks and financial companies only."))
         .otherwise(issues("banking_errors", "banking_warnings",
                           "Bank figures are there."))),
        ("Signals", ok_if(F.col("active_signal_count") > 0),
         number("active_signal_count", " active signal(s)"),
         F.when(F.col("active_signal_count") == 0, F.lit("No signal fires."))
         .otherwise(F.lit("All that signals need is there."))),
        ("Flows / events", ok_if(delivery & volatility),
         F.concat(F.lit("delivery: "), delivery.cast("string"),
                  F.lit("; result volatility: "), volatility.cast("string")),
         F.lit("Few deliveries and results are known.")),
        ("Fundamentals cross-check",
         ok_if((F.col("sources") >= 2) & (F.col("disagreements") == 0)),
         F.when(F.col("sources") < 2, F.lit("one source only"))
         .when(F.col("disagreements") == 0, F.lit("sources agree"))
         .otherwise(number("disagreements", " values differ")),
         F.lit("See where the sources differ.")),
        ("Composite score", ok_if(both_lists),
         F.concat(F.size("missing_data").cast("string"), F.lit(" missing input(s), "),
                  F.size("risks").cast("string"), F.lit(" risk note(s)")),
         F.when(both_lists, F.lit("The score lacks nothing."))
         .otherwise(F.array_join(F.slice("missing_data", 1, 4), ", "))),
    ]
    rows = F.array(
        *[
            F.struct(F.lit(area).alias("area"), s.alias("status"), cov.alias("coverage"),
                     check.alias("what_to_check"))
            for area, s, cov, check in areas
        ]
    )
    return inputs.select("symbol", F.inline(rows))


def trust_level(checklist: DataFrame) -> DataFrame:
    """High / Medium / Low per symbol."""
    counts = checklist.groupBy("symbol").agg(
        F.count_if(F.col("status") == "ACTION").alias("actions"),
        F.count_if(F.col("status") == "PARTIAL").alias("partials"),
    )
    level = (
        F.when((F.col("actions") > 0) | (F.col("partials") >= 3), F.lit("Low"))
        .when(F.col("partials") > 0, F.lit("Medium"))
        .otherwise(F.lit("High"))
    )
    return counts.withColumn("trust_level", level)


