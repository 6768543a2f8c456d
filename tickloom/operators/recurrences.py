"""Exponential recurrences as windowed sums.

``e = a·e_before + b·x`` at each row with a value, started at the first one.  After a gap of
``d`` rows the old average weighs ``w = (1-alpha)^d``, so ``a = w/(w+alpha)`` and
``b = alpha/(w+alpha)``; without gaps that is ``1-alpha`` and ``alpha``.  Rows without a value
keep the average.  With ``L`` the running sum of ``ln a`` the average is
``exp(L)·Σ b·x·exp(-L)``.  ``exp(-L)`` would overflow on a long history, so the sum runs
inside one block of calendar days; the average and the decay at each earlier block's end
are folded into the start of the next.  Exact for any history length, JVM only, and one sort for all of it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.windows import BLOCK, bars_window, with_history_block

ROW = "bar_number"
BLOCK_ROW = "_block_row"
BLOCK_END = "_block_end"
#: 0.8 ^ -3000 is still a double; no recurrence here decays faster.
MOST_ROWS = 3000


@dataclass(frozen=True)
class Recurrence:
    """``name`` = smoothed ``value``, NULL before ``min_values`` values.

    Recurrences of one ``series`` have their values in the same rows."""

    name: str
    value: Column
    alpha: float
    min_values: int = 1
    series: str = ""


def span(name: str, column: str, periods: int, min_values: int | None = None):
    alpha = 2.0 / (periods + 1)
    return Recurrence(name, F.col(column), alpha, min_values or periods, column)


def number_rows(df: DataFrame, rows_before: Column | None = None, **extra: Column) -> DataFrame:
    """Row numbers per symbol (after ``rows_before`` earlier ones) and per block, plus
    ``extra`` window columns."""
    if BLOCK not in df.columns:
        df = with_history_block(df)
    w = bars_window(df)
    numbered = df.withColumns(
        {
            ROW: F.row_number().over(w) + (F.lit(0) if rows_before is None else rows_before),
            BLOCK_END: F.coalesce(F.lead(BLOCK).over(w) != F.col(BLOCK), F.lit(False)),
            **extra,
        }
    )
    in_block = Window.partitionBy("symbol", BLOCK).orderBy("trade_date")
    number = F.row_number().over(in_block)
    fits = F.when(number <= MOST_ROWS, number).otherwise(
        F.raise_error(F.lit("a history block has too many rows; use fewer days per block"))
    )
    return numbered.withColumn(BLOCK_ROW, fits.cast("int"))


def smooth(
    df: DataFrame, recurrences: Sequence[Recurrence], start: str | None = None, trace: bool = False
) -> DataFrame:
    """Add one column per recurrence to a frame prepared by ``number_rows``.

    ``start`` names a struct column with the state before a symbol's first row that counts
    (``value_<name>`` of each recurrence, ``seen_<series>`` and ``last_<series>``), NULL where
    there is none; the recurrences go on from it. ``trace`` keeps that state after each row
    in columns of these names.
    """
    in_block = (
        Window.partitionBy("symbol", BLOCK)
        .orderBy("trade_date")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    so_far = bars_window(df).rowsBetween(Window.unboundedPreceding, 0)
    before = bars_window(df).rowsBetween(Window.unboundedPreceding, -1)
    row = F.col(ROW)

    seen, logs, sums, local, carried, final = {}, {}, {}, {}, {}, {}
    for r in recurrences:
        key = r.series or r.name
        last = F.max(F.when(r.value.isNotNull(), row)).over(before)
        count = F.count(r.value).over(so_far)
        if start:
            last = F.coalesce(last, F.col(f"{start}.last_{key}"))
            count = count + F.coalesce(f"{start}.seen_{key}", F.lit(0))
        seen.setdefault(f"_last_{key}", last)
        seen.setdefault(f"_seen_{key}", count)
    for r in recurrences:
        last = F.col(f"_last_{r.series or r.name}")
        old = F.pow(F.lit(1.0 - r.alpha), row - last)
        decayed = r.value.isNotNull() & last.isNotNull()
        logs[f"_log_{r.name}"] = F.when(decayed, F.log(old / (old + r.alpha))).otherwise(0.0)
        logs[f"_weight_{r.name}"] = F.when(decayed, r.alpha / (old + r.alpha)).otherwise(1.0)
    for r in recurrences:
        sums[f"_sum_{r.name}"] = F.sum(f"_log_{r.name}").over(in_block)
    for r in recurrences:
        term = F.col(f"_weight_{r.name}") * r.value * F.exp(-F.col(f"_sum_{r.name}"))
        local[f"_in_{r.name}"] = F.exp(f"_sum_{r.name}") * F.sum(term).over(in_block)
    for r in recurrences:
        state = F.struct(
            F.exp(f"_sum_{r.name}").alias("decay"),
            F.coalesce(f"_in_{r.name}", F.lit(0.0)).alias("value"),
        )
        carried[f"_ends_{r.name}"] = F.collect_list(F.when(F.col(BLOCK_END), state)).over(before)
    for r in recurrences:
        ends, inside = F.col(f"_ends_{r.name}"), F.coalesce(f"_in_{r.name}", F.lit(0.0))
        first = F.coalesce(f"{start}.value_{r.name}", F.lit(0.0)) if start else F.lit(0.0)
        earlier = F.aggregate(
            ends, first, lambda acc, end: acc * end["decay"] + end["value"]
        )
        full = earlier * F.exp(f"_sum_{r.name}") + inside
        if not start:
            full = F.when(F.size(ends) == 0, inside).otherwise(full)
        key = r.series or r.name
        final[r.name] = F.when(F.col(f"_seen_{key}") >= r.min_values, full)
        if trace:
            final[f"value_{r.name}"] = full
            final[f"seen_{key}"] = F.col(f"_seen_{key}")
            final[f"last_{key}"] = F.when(r.value.isNotNull(), row).otherwise(F.col(f"_last_{key}"))
    out = df
    for step in (seen, logs, sums, local, carried, final):
        out = out.withColumns(step)
    return out.drop(*seen, *logs, *sums, *local, *carried)
