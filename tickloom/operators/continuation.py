"""Indicators that go on from a stored state instead of the whole history.

A symbol's state holds what its recurrences carry (averages, counts, the row of the last value),
its highest price, its row number and its last 252 bars, all as they stood at one bar, and the few
bars after it that there were. From it and the bars after it every indicator comes out as from the whole history: windows look back into the
stored bars, recurrences start from the stored averages.

Prices in a state are adjusted for the splits up to its own day only, so a later split just
scales it; a split that turns up for an earlier day makes it invalid, and so does a price that
changes there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.recurrences import ROW
from tickloom.operators.technicals import STATE, STATE_PRICES, TAIL, indicator_frame, last_states

PRICES = ("open", "high", "low", "close")
BAR = ("trade_date", *PRICES, "volume")


def overlap_start(overlap_days: int = 5) -> Column:
    """A symbol's first day that the next run reads again."""
    return F.date_sub(F.max("trade_date").over(Window.partitionBy("symbol")), overlap_days)


def indicators_with_state(bars: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """The frame of all indicators with the columns a state is made from.

    ``bars``: one row per symbol and day; with ``state``, those after each symbol's
    ``last_date`` (earlier ones are left out here; symbols without a state start anew).
    Each state itself is one row of the frame, with ``is_new`` false, its last day and number and
    its last bars as ``tail``; :func:`new_rows` drops them.
    """
    if state is None:
        return indicator_frame(bars.withColumn("is_new", F.lit(True)), trace=True)
    before = F.struct((F.col("rows") - F.size("tail")).alias("rows_before"), "highest", "close_before")
    marked = state.select("symbol", "last_date", before.alias("_state"), F.explode("tail").alias("_bar"))
    old = marked.select(
        "symbol", *[F.col(f"_bar.{c}").alias(c) for c in BAR], "_state", "last_date",
        F.lit(False).alias("is_new"),
    )
    both = bars.withColumn("is_new", F.lit(True)).unionByName(old, allowMissingColumns=True)
    whole = Window.partitionBy("symbol")
    # Clustered by symbol like the indicators' own windows: one Exchange serves them all.
    known = both.withColumns(
        {
            "_state": F.max_by("_state", F.when(~F.col("is_new"), F.col("trade_date"))).over(whole),
            "_until": F.max("last_date").over(whole),
        }
    )
    after = known.where(~F.col("is_new") | F.col("_until").isNull() | (F.col("trade_date") > F.col("_until")))
    whole_states = state.select("symbol", F.struct(*STATE).alias("_state"))
    new = indicator_frame(after.drop("_until", "last_date"), "_state", trace=True, states=whole_states)
    stands = state.where(F.size("tail") > 0).select(
        "symbol", F.col("last_date").alias("trade_date"), F.col("rows").alias(ROW), *STATE, "tail",
        F.lit(False).alias("is_new"),
    )
    return new.unionByName(stands, allowMissingColumns=True)


def new_rows(frame: DataFrame) -> DataFrame:
    return frame.where("is_new").drop("is_new", "tail", *STATE)


def state_of(frame: DataFrame, before: Column, splits: DataFrame | None = None) -> DataFrame:
    """One row per symbol: the state at its last bar before the day ``before``.

    A symbol without such a bar has an empty state of the day before its first one, so the
    states also tell which symbols there are, their last days (``latest_date``) and the bars
    since (``recent``, few: those that the next run reads again).
    ``splits``: those that the frame's prices are adjusted for.
    """
    whole = Window.partitionBy("symbol")
    settled = F.col("trade_date") < F.col("_before")
    known = _with_source(frame)
    if "tail" not in known.columns:
        known = known.withColumn("tail", F.lit(None).cast(_TAIL_TYPE))
    marked = known.withColumn("_before", before).withColumns(
        {"_rows": F.max(F.when(settled, F.col(ROW))).over(whole)}
    ).where((F.col(ROW) > F.col("_rows") - TAIL) | F.col("_rows").isNull())
    carried = F.struct(F.col(ROW).alias("rows"), F.col("trade_date").alias("last_date"), *STATE)
    found = marked.groupBy("symbol").agg(
        F.max_by(carried, F.when(settled, F.col(ROW))).alias("_s"),
        F.coalesce(F.max("tail"), F.array().cast(_TAIL_TYPE)).alias("_earlier"),
        F.array_sort(F.collect_list(F.when(settled & F.col("is_new"), F.struct(*BAR)))).alias("_later"),
        F.array_sort(F.collect_list(F.when(~settled & F.col("is_new"), F.struct(*BAR, "source")))).alias("recent"),
        F.min("trade_date").alias("first_date"), F.max("trade_date").alias("latest_date"),
    ).withColumn("tail", F.concat("_earlier", "_later"))
    first = F.greatest(F.size("tail") - (TAIL - 1), F.lit(1))
    states = found.select(
        "symbol", "_s.rows", "_s.last_date", *[f"_s.{c}" for c in STATE],
        F.slice("tail", first, TAIL).alias("tail"), "recent", "first_date", "latest_date",
    )
    return _stored(states, splits)


def first_states(bars: DataFrame, before: Column, splits: DataFrame | None = None) -> DataFrame:
    """The same as ``state_of(indicators_with_state(bars), before, splits)`` from an aggregate per
    symbol: no indicator of an earlier bar is worked out."""
    return _stored(last_states(_with_source(bars), before), splits)


#: Bars of a state.
_TAIL_TYPE = f"array<struct<trade_date:date,{','.join(f'{c}:double' for c in BAR[1:])}>>"


def _with_source(rows: DataFrame) -> DataFrame:
    return rows if "source" in rows.columns else rows.withColumn("source", F.lit(None).cast("string"))


def _stored(states: DataFrame, splits: DataFrame | None) -> DataFrame:
    """An empty state is that of the day before the first one; prices as of the state's own day."""
    states = states.select(
        "symbol", F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce("last_date", F.date_sub("first_date", 1)).alias("last_date"), "latest_date",
        *STATE, "tail", "recent",
    )
    return states if splits is None else _scaled(states, splits, loading=False)


def loaded(state: DataFrame, splits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(states in today's prices, symbols whose state no longer holds)."""
    scaled = _scaled(state, splits, loading=True)
    holds = F.col("known_splits") == F.col("_known_splits")
    return scaled.where(holds).drop("_known_splits"), scaled.where(~holds).select("symbol")


def _scaled(states: DataFrame, splits: DataFrame, loading: bool) -> DataFrame:
    """Prices between the scale of the state's own day and that of today.

    ``known_splits`` tells which splits up to its day a state has in it. The states, which
    may come from whole histories, are worked out once: splits meet them as a list per symbol.
    """
    mark = F.struct("ex_date", F.col("value").cast("double").alias("_v"))
    marks = splits.where(F.col("value") > 0).groupBy("symbol").agg(F.array_sort(F.collect_list(mark)).alias("_marks"))
    day, known = F.col("last_date"), F.col("_marks")
    product = F.aggregate(F.filter(known, lambda m: m["ex_date"] > day), F.lit(1.0), lambda acc, m: acc * m["_v"])
    earlier = F.coalesce(F.filter(known, lambda m: ~(m["ex_date"] > day)), F.array())
    found = states.where(F.col("symbol").isNotNull()).join(marks, "symbol", "left").withColumns(
        {"_factor": F.coalesce(product, F.lit(1.0)), "_known_splits": F.to_json(earlier)}
    ).drop("_marks")
    factor = F.lit(1.0) / F.col("_factor") if loading else F.col("_factor")

    def bar(b: Column, *more: str) -> Column:
        prices = [(b[c] * factor).alias(c) for c in PRICES]
        rest = [b[c].alias(c) for c in more]
        return F.struct(b["trade_date"].alias("trade_date"), *prices, (b["volume"] / factor).alias("volume"), *rest)

    changed = {c: F.col(c) * factor for c in STATE_PRICES} | {
        "tail": F.transform("tail", lambda b: bar(b)),
        "recent": F.transform("recent", lambda b: bar(b, "source")),
    }
    out = found.withColumns(changed).drop("_factor")
    return out if loading else out.withColumnRenamed("_known_splits", "known_splits")
