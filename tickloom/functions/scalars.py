"""Row-wise financial and cleaning functions as Column expressions.

Missing is NULL throughout: a ratio with a missing or zero part is NULL, and a
clamp keeps NULL instead of falling back to a bound.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.config import CRORE

# Words that mark a financial-sector company.
FINANCIAL_KEYWORDS = (
    "bank", "banks", "financial", "finance", "nbfc", "insurance",
    "asset management", "capital markets", "broking", "housing finance",
)


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def safe_divide(numerator: Column | str, denominator: Column | str) -> Column:
    return F.try_divide(col(numerator), col(denominator))


def nan_to_null(value: Column | str) -> Column:
    return F.when(~F.isnan(col(value)), col(value))


def holds(predicate: Column) -> Column:
    """Two-valued predicate: unknown counts as false."""
    return F.coalesce(predicate, F.lit(False))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def settled(value: Column, digits: int) -> Column:
    """Rounded; noise in the last bits of a sum must not decide a tie."""
    return F.round(F.round(value, 9), digits)


def scale(value: Column | str, low: float, high: float) -> Column:
    value = col(value)
    if high == low:
        return F.when(value.isNotNull(), F.lit(50.0))
    return clamp((value - low) / (high - low) * 100.0, 0.0, 100.0)


def inverse_scale(value: Column | str, low: float, high: float) -> Column:
    return 100.0 - scale(value, low, high)


def mean_of(parts: Sequence[Column]) -> Column:
    """Mean of the parts that are present; NULL when none is."""
    total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts])
    present = reduce(lambda a, b: a + b, [p.isNotNull().cast("int") for p in parts])
    return F.try_divide(total, present)


def messages(*items: Column) -> Column:
    """Array of the messages whose condition held, in the order given."""
    return F.array_compact(F.array(*items))


def fixed(value: Column | str, digits: int) -> Column:
    """Text with a fixed number of decimals."""
    return F.format_string(f"%.{digits}f", col(value).cast("double"))


def display_or_na(value: Column | str, digits: int = 2) -> Column:
    value = col(value)
    return F.when(value.isNull(), F.lit("N/A")).otherwise(fixed(value, digits))


def python_list_text(items: Column) -> Column:
    """An array of names written the way ``['a', 'b']`` is."""
    return F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']"))


def normalise_symbol(symbol: Column | str, suffix: str = ".NS") -> Column:
    cleaned = F.upper(F.trim(col(symbol)))
    return (
        F.when(cleaned == "", F.lit(None).cast("string"))
        .when(cleaned.contains("."), cleaned)
        .otherwise(F.concat(cleaned, F.lit(suffix)))
    )


def fiscal_year(day: Column | str) -> Column:
    """April-March year, named after the calendar year it ends in."""
    return F.year(F.add_months(col(day), 9))


def fiscal_quarter(day: Column | str) -> Column:
    return F.quarter(F.add_months(col(day), -3))


def period_end(year: Column | str, quarter: Column | str | None = None) -> Column:
    year = col(year)
    if quarter is None:
        return F.make_date(year, F.lit(3), F.lit(31))
    quarter = col(quarter)
    return (
        F.when(quarter == 1, F.make_date(year - 1, F.lit(6), F.lit(30)))
        .when(quarter == 2, F.make_date(year - 1, F.lit(9), F.lit(30)))
        .when(quarter == 3, F.make_date(year - 1, F.lit(12), F.lit(31)))
        .when(quarter == 4, F.make_date(year, F.lit(3), F.lit(31)))
    )


def market_cap_bucket(market_cap: Column | str) -> Column:
    crore = col(market_cap) / CRORE
    return (
        F.when(crore >= 20_000, F.lit("large"))
        .when(crore >= 5_000, F.lit("mid"))
        .when(crore.isNotNull(), F.lit("small"))
    )


def to_crore(amount: Column | str, units: Column | str | None = None) -> Column:
    value = col(amount) if units is None else col(amount) * col(units)
    return value / CRORE


def from_crore(amount: Column | str) -> Column:
    return col(amount) * CRORE


def is_financial(*texts: Column | str) -> Column:
    joined = F.lower(F.concat_ws(" ", *[F.coalesce(col(t), F.lit("")) for t in texts]))
    return joined.rlike("|".join(FINANCIAL_KEYWORDS))


def numeric_text(value: Column | str) -> Column:
    """Numbers as typed in spreadsheets: separators, currency marks, (negatives)."""
    raw = F.trim(col(value).cast("string"))
    negative = raw.rlike(r"^\(.*\)$")
    digits = F.regexp_replace(raw, r"(?i)inr|rs\.?|cr\.?|[,%()\s₹]", "")
    number = digits.try_cast("double")
    # Most are digits and separators only, and need no search for marks.
    bare = F.replace(raw, F.lit(","), F.lit("")).try_cast("double")
    return F.when(raw.rlike(r"^[-+.,0-9]*$"), bare).when(negative, -number).otherwise(number)


# What the parts of a date format match at most.
_DAY_PARTS = {"yyyy": r"[-+]?\d{4,}", "MMMM": r"\D+", "MMM": r"\D+", "MM": r"\d\d", "dd": r"\d\d"}


def parse_day(value: Column | str, formats: Sequence[str]) -> Column:
    """First of several date formats that fits. A text without the shape of a format is not
    tried with it: every failed try throws, at many times the cost of a date."""
    days = []
    for f in formats:
        parts = re.split("(yyyy|MMMM|MMM|MM|dd)", f)
        day = F.try_to_timestamp(col(value), F.lit(f)).cast("date")
        if not re.search("[A-Za-z']", "".join(parts[::2])):
            shape = "".join(_DAY_PARTS.get(part) or re.escape(part) for part in parts)
            day = F.when(col(value).rlike(f"^{shape}$"), day)
        days.append(day)
    return F.coalesce(*days)


def json_strings(value: Column | str) -> Column:
    """JSON list of strings; broken or absent JSON is an empty list."""
    return F.coalesce(
        F.from_json(col(value), "array<string>"), F.array().cast("array<string>")
    )


def business_days_after(day: Column | str, days: int) -> Column:
    """The date ``days`` weekdays after ``day``."""
    span = F.sequence(F.date_add(col(day), 1), F.date_add(col(day), 2 * days + 7))
    return F.element_at(F.filter(span, lambda d: F.weekday(d) < 5), days)


def days_until(target: Column | str, today: Column | str) -> Column:
    gap = F.datediff(col(target), col(today))
    return F.when(gap >= 0, gap)


def freshness(moment: Column | str, now: Column | str, fresh: int = 24, stale: int = 72) -> Column:
    seconds = col(now).cast("timestamp").cast("long") - col(moment).cast("timestamp").cast("long")
    return (
        F.when(seconds.isNull(), F.lit("unknown"))
        .when(seconds <= fresh * 3600, F.lit("fresh"))
        .when(seconds <= stale * 3600, F.lit("aging"))
        .otherwise(F.lit("stale"))
    )
