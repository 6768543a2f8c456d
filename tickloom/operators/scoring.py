"""Composite 0-100 score with reasons, risks and missing inputs per symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.config import DEFAULT, ScoreWeights
from tickloom.functions.scalars import (
    fixed, holds, inverse_scale, is_financial, mean_of, messages, scale, settled,
)



def c(name: str) -> Column:
    return F.col(name)



def rounded(value: Column) -> Column:
    """One decimal."""
    return settled(value, 1)


def altman_points(z: Column) -> Column:
    return (
        F.when(z >= 3.0, F.lit(100.0))
        .when(z >= 1.8, 55.0 + (z - 1.8) / 1.2 * 35.0)
        .when(z.isNotNull(), F.greatest(F.lit(0.0), z / 1.8 * 45.0))
    )


def rsi_points(rsi: Column) -> Column:
    return (
        F.when(rsi.between(45, 65), F.lit(85.0))
        .when(((rsi >= 35) & (rsi < 45)) | ((rsi > 65) & (rsi <= 75)), F.lit(65.0))
        .when((rsi < 30) | (rsi > 80), F.lit(35.0))
        .when(rsi.isNotNull(), F.lit(50.0))
    )


def bank_growth_points(credit: Column, deposit: Column) -> Column:
    both = (scale(credit, -5.0, 25.0) + scale(deposit, -5.0, 25.0)) / 2.0
    penalty = F.least(F.lit(35.0), F.abs(credit - deposit) * 3.0)
    return F.when(both.isNotNull(), F.greatest(F.lit(0.0), both - penalty))


def banking_points() -> Column:
    return mean_of(
        [
            scale("nim_pct", 2.5, 5.0),
            inverse_scale("gnpa_pct", 0.0, 8.0),
            inverse_scale("nnpa_pct", 0.0, 4.0),
            scale("casa_pct", 25.0, 50.0),
            scale("capital_adequacy_pct", 12.0, 22.0),
            bank_growth_points(c("credit_growth_pct"), c("deposit_growth_pct")),
        ]
    )


def fundamentals_points(financial: Column, banking: Column) -> Column:
    quality = scale("piotroski_f_score", 0, 9)
    roe = scale(F.coalesce("roe_pct_sector_rank", "roe_pct"), 0, 100)
    roa = scale(F.coalesce("roa_pct_sector_rank", "roa_pct"), 0, 100)
    growth = scale(F.coalesce("revenue_growth_pct_sector_rank", "revenue_growth_pct"), 0, 100)
    debt = F.coalesce(c("debt_to_equity_sector_rank"), inverse_scale("debt_to_equity", 0, 2))
    industrial = mean_of([quality, altman_points(c("altman_z_score")), roe, roa, growth, debt])
    bank = mean_of([quality, roe, roa, growth, banking, banking])
    return F.when(financial, bank).otherwise(industrial)


def delivery_points() -> Column:
    trend = (
        F.when(c("delivery_trend") == "rising", F.lit(75.0))
        .when(c("delivery_trend") == "falling", F.lit(35.0))
        .when(c("delivery_trend") == "flat", F.lit(55.0))
    )
    return mean_of([scale("latest_pct", 20, 65), scale("ma20_pct", 20, 60), trend])


def technicals_points() -> Column:
    known = c("close").isNotNull() & c("ema_50").isNotNull() & c("ema_200").isNotNull()
    trend = F.when(
        known,
        F.when((c("close") > c("ema_50")) & (c("ema_50") > c("ema_200")), F.lit(85.0))
        .when(c("close") > c("ema_200"), F.lit(65.0))
        .otherwise(F.lit(35.0)),
    )
    signals = F.least(F.lit(100.0), 40.0 + F.col("active_signal_count") * 12.0)
    return mean_of([signals, rsi_points(c("rsi_14")), trend, scale("relative_volume", 0.5, 2.0)])


def flows_points(delivery: Column, market: Column) -> Column:
    return (
        F.when(delivery.isNull() & market.isNull(), F.lit(50.0))
        .when(market.isNull(), delivery)
        .when(delivery.isNull(), (market + 50.0) / 2.0)
        .otherwise(delivery * 0.6 + market * 0.4)
    )


def events_points() -> Column:
    multiple = c("volatility_multiple")
    return (
        F.when(multiple.isNull(), F.lit(50.0))
        .when(multiple <= 1.1, F.lit(80.0))
        .when(multiple <= 1.5, F.lit(60.0))
        .otherwise(F.lit(35.0))
    )


INPUTS = {
    "double": (
        "piotroski_f_score", "altman_z_score", "roe_pct", "roe_pct_sector_rank", "roa_pct",
        "roa_pct_sector_rank", "revenue_growth_pct", "revenue_growth_pct_sector_rank",
        "debt_to_equity", "debt_to_equity_sector_rank", "piotroski_f_score_sector_rank",
        "nim_pct", "gnpa_pct", "nnpa_pct", "casa_pct", "capital_adequacy_pct",
        "credit_growth_pct", "deposit_growth_pct", "close", "rsi_14", "ema_50", "ema_200",
        "relative_volume", "latest_pct", "ma20_pct", "volatility_multiple", "market_score",
    ),
    "string": (
        "sector", "industry", "status", "banking_source", "banking_last_updated",
        "delivery_trend", "fii_trend", "dii_trend",
    ),
    "boolean": (
        "unusual_today", "has_fundamentals", "has_banking", "has_delivery", "has_volatility",
        "has_market_flows",
    ),
    "array<string>": ("active_signals",),
}


def with_score_inputs(df: DataFrame) -> DataFrame:
    """Add absent score inputs as missing."""
    absent = {
        name: F.lit(None).cast(kind)
        for kind, names in INPUTS.items() for name in names if name not in df.columns
    }
    out = df.withColumns(absent) if absent else df
    empty = F.array().cast("array<string>")
    out = out.withColumn("active_signals", F.coalesce("active_signals", empty))
    flags = {n: F.coalesce(n, F.lit(False)) for n in INPUTS["boolean"]}
    return out.withColumns({**flags, "active_signal_count": F.size("active_signals")})


def score_stocks(inputs: DataFrame, weights: ScoreWeights = DEFAULT.weights) -> DataFrame:
    """Adds score, band, five sub-scores and the four explanation lists."""
    df = with_score_inputs(inputs)
    w = weights.normalised()
    has_f = c("has_fundamentals")
    financial = is_financial("symbol", "sector", "industry")
    df = df.withColumns(
        {
            "_fin": financial,
            "_bank": F.when(c("has_banking"), banking_points()),
            "_delivery": F.when(c("has_delivery"), delivery_points()),
            "_market": F.when(c("has_market_flows"), c("market_score")),
        }
    )
    ranks = [
        c("roe_pct_sector_rank"), c("revenue_growth_pct_sector_rank"),
        c("piotroski_f_score_sector_rank"),
    ]
    df = df.withColumns(
        {
            "_f": F.when(has_f, fundamentals_points(c("_fin"), c("_bank"))),
            "_macro": F.when(has_f, mean_of(ranks)),
            "_tech": technicals_points(),
            "_flows": flows_points(c("_delivery"), c("_market")),
            "_events": F.when(c("has_volatility"), events_points()).otherwise(F.lit(50.0)),
        }
    )
    fundamentals = F.coalesce("_f", F.lit(50.0))
    macro = F.coalesce("_macro", F.lit(50.0))
    total = (
        fundamentals * w["fundamentals"] + c("_tech") * w["technicals"]
        + c("_flows") * w["flows"] + c("_events") * w["events_quality"]
        + macro * w["macro_sector"]
    )
    band = (
        F.when(total >= weights.strong, F.lit("Strong research candidate"))
        .when(total >= weights.watchlist, F.lit("Watchlist candidate"))
        .when(total >= weights.neutral, F.lit("Neutral / needs more evidence"))
        .otherwise(F.lit("High caution"))
    )
    reasons, risks, missing = _explanations()
    return df.withColumns(
        {
            "score": rounded(total),
            "band": band,
            "fundamentals_score": rounded(fundamentals),
            "technicals_score": rounded(c("_tech")),
            "flows_score": rounded(c("_flows")),
            "events_quality_score": rounded(c("_events")),
            "macro_sector_score": rounded(macro),
            "reasons": F.slice(reasons, 1, 6),
            "risks": F.slice(risks, 1, 6),
            "missing_data": F.array_sort(F.array_distinct(missing)),
        }
    ).drop("_fin", "_bank", "_delivery", "_market", "_f", "_macro", "_tech", "_flows", "_events")


def _explanations() -> tuple[Column, Column, Column]:
    """Texts in the order the buckets are scored."""
    has_f, fin, bank = c("has_fundamentals"), c("_fin"), c("has_banking")
    scored_bank = has_f & fin
    b = scored_bank & bank
    credit, deposit = c("credit_growth_pct"), c("deposit_growth_pct")
    growth = bank_growth_points(credit, deposit)
    fast = credit > deposit + 8.0
    source, updated = F.trim("banking_source"), F.trim("banking_last_updated")
    has_source = F.coalesce(source != "", F.lit(False))
    names = F.array_join(F.slice("active_signals", 1, 3), ", ")
    usable_f = c("_f").isNotNull()
    d, v = c("has_delivery"), c("has_volatility")
    close, e50, e200 = c("close"), c("ema_50"), c("ema_200")
    multiple = c("volatility_multiple")

    def say(condition: Column, *parts: Column | str) -> Column:
        text = [F.lit(p) if isinstance(p, str) else p for p in parts]
        return F.when(holds(condition), F.concat(*text))

    reasons = messages(
        say(scored_bank, "Scored as a bank or financial company."),
        say(b & has_source, "Bank figures from ", source,
            F.when(F.coalesce(updated, F.lit("")) != "",
                   F.concat(F.lit(" of "), updated, F.lit(".")))
            .otherwise(F.lit("."))),
        say(b & (c("nim_pct") >= 3.5), "A good interest margin of ", fixed("nim_pct", 2), "%."),
        say(b & (c("gnpa_pct") <= 2.0), "Few gross bad loans, ", fixed("gnpa_pct", 2), "%."),
        say(b & (c("nnpa_pct") <= 1.0), "Few net bad loans, ", fixed("nnpa_pct", 2), "%."),
        say(b & (c("casa_pct") >= 35.0), "Cheap deposits make up ", fixed("casa_pct", 2), "%."),
        say(b & (c("capital_adequacy_pct") >= 15.0), "Ample capital, ",
            fixed("capital_adequacy_pct", 2), "%."),
        say(b & ~fast & (growth >= 70), "Loans and deposits grow alike."),
        say(scored_bank & c("_bank").isNull(),
            "No bank figures; scored by what all companies report."),
        say(usable_f & (c("piotroski_f_score") >= 7), "A Piotroski score of ",
            fixed("piotroski_f_score", 0), " of 9."),
        say(F.size("active_signals") > 0, "Signals: ", names, "."),
        say((close > e50) & (e50 > e200), "Price over its 50 and 200 day averages."),
        say(d & (c("latest_pct") >= 50), "Much of the last day was delivered, ",
            fixed("latest_pct", 1), "%."),
        say(d & (c("delivery_trend") == "rising"), "Deliveries rise."),
        say(d & c("unusual_today"), "Unusually much was delivered on the last day."),
        say(c("_market").isNotNull() & (c("fii_trend") == "bullish"),
            "Foreign institutions buy, over 5 and 20 days."),
        say(c("_market").isNotNull() & (c("dii_trend") == "bullish"),
            "Domestic institutions buy, over 5 and 20 days."),
        say(v & (multiple <= 1.1), "Results hardly move the price."),
        say(c("_macro") >= 70, "High ranks among its peers."),
    )
    risks = messages(
        say(b & (c("gnpa_pct") >= 5.0), "GNPA is high, ", fixed("gnpa_pct", 2), "%."),
        say(b & (c("nnpa_pct") >= 2.0), "NNPA is high, ", fixed("nnpa_pct", 2), "%."),
        say(b & (c("capital_adequacy_pct") < 13.0), "Capital adequacy only ",
            fixed("capital_adequacy_pct", 2), "%."),
        say(b & fast,
            "Credit growth outruns deposits; see how it is funded."),
        say(usable_f & ~fin & (c("altman_z_score") < 1.8), "Low Altman Z-Score (",
            fixed("altman_z_score", 2), "): a weak balance sheet."),
        say(F.size("active_signals") == 0, "No prebuilt signal fires."),
        say((close <= e200) & e50.isNotNull(), "Price is under its 200 day average."),
        say(d & (c("delivery_trend") == "falling"), "Delivery trend falls."),
        say(c("_market").isNotNull() & (c("fii_trend") == "bearish"),
            "FII flow is out, over 5 and 20 days."),
        say(c("_market").isNotNull() & (c("dii_trend") == "bearish"),
            "DII flow is out, over 5 and 20 days."),
        say(v & (multiple > 1.5), "Result-period volatility is ",
            fixed(multiple, 2), " times the usual."),
        say(c("_macro") <= 35, "Fundamental ranks low among its peers."),
    )
    missing = messages(
        say(~has_f, "fundamentals"),
        say(scored_bank & ~bank, "manual banking metrics"),
        say(b & ~has_source, "banking metrics source"),
        say(b & c("nim_pct").isNull(), "NIM"),
        say(b & c("gnpa_pct").isNull(), "GNPA"),
        say(b & c("nnpa_pct").isNull(), "NNPA"),
        say(b & c("casa_pct").isNull(), "CASA"),
        say(b & c("capital_adequacy_pct").isNull(), "capital adequacy"),
        say(b & growth.isNull(), "credit/deposit growth"),
        say(has_f & ~usable_f, "fundamental metrics"),
        say(usable_f & (F.lower("status") == "sample"), "verified fundamentals source"),
        say(c("rsi_14").isNull(), "RSI"),
        say(close.isNull() | e50.isNull() | e200.isNull(), "moving average context"),
        say(d & c("latest_pct").isNull(), "latest delivery percentage"),
        say(c("has_market_flows") & c("market_score").isNull(), "FII/DII trend context"),
        say(c("_delivery").isNull() & c("_market").isNull(), "delivery and institutional flow data"),
        say(~v, "event-risk data"),
        say(v & multiple.isNull(), "result volatility multiple"),
        say(~has_f, "sector context"),
        say(has_f & c("_macro").isNull(), "sector relative strength context"),
    )
    return reasons, risks, missing


def research_stance(trust_level: Column, score: Column, active: Column) -> Column:
    return (
        F.when(trust_level == "Low", F.lit("Verify first"))
        .when((score >= 75) & (active >= 2), F.lit("Accumulation watchlist candidate"))
        .when(score >= 60, F.lit("Watch / hold research candidate"))
        .when(score <= 40, F.lit("Reduce / avoid-risk review"))
        .otherwise(F.lit("Neutral watch"))
    )


def risk_per_share(trigger: Column, stop: Column) -> Column:
    risk = trigger - stop
    return F.when(risk > 0, F.round(risk, 2))


def position_size(portfolio: Column, risk: Column, risk_pct: float = 1.0) -> Column:
    return F.when(
        portfolio > 0, F.floor(F.try_divide(portfolio * risk_pct / 100, risk)).cast("long")
    )
