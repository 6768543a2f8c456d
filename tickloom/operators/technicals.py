"""Technical indicators for all symbols in one job.

Long frames are built from short ones: a 200-row mean is the sum of 10-row sums
taken at lags 0, 10, 20 …; a 252-row extreme is the extreme of thirteen 20-row
extremes.  A row then costs about 100 frame updates instead of more than 1,000.

A mean or deviation over k rows needs k values, an extreme over 252 rows needs 20; so
values are counted, by differences of a running count.  Missing closes are padded before returns are taken.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tickloom.functions.scalars import safe_divide
from tickloom.operators.recurrences import (
    BLOCK_END,
    BLOCK_ROW,
    ROW,
    Recurrence,
    number_rows,
    smooth,
)
from tickloom.operators.windows import BLOCK, bars_window, with_history_block

INDICATORS = (
    "sma_20", "sma_50", "sma_100", "sma_200", "ema_20", "ema_50", "ema_100", "ema_200",
    "rsi_14", "macd", "macd_signal", "macd_hist", "bb_mid", "bb_upper", "bb_lower",
    "atr_14", "atr_pct", "historical_volatility_20", "avg_volume_20", "relative_volume",
    "high_52w", "low_52w", "all_time_high", "distance_from_52w_high_pct",
    "distance_from_52w_low_pct", "distance_from_all_time_high_pct", "ma_stack_status",
)


#: Averages of the close and their periods.
CLOSE_AVERAGES = {
    "_ema12": 12, "_ema26": 26, "ema_20": 20, "ema_50": 50, "ema_100": 100, "ema_200": 200,
}
#: Bars that the longest window looks back on, the present one not counted.
TAIL = 252
#: What goes on from bar to bar: amounts in prices, and counts.
STATE_PRICES = (
    *(f"value_{name}" for name in (*CLOSE_AVERAGES, "_gain", "_loss", "atr_14", "macd_signal")),
    "highest", "close_before",
)
STATE_COUNTS = tuple(
    f"{kind}_{series}" for series in ("close", "change", "atr_14", "macd") for kind in ("seen", "last")
)
STATE = (*STATE_PRICES, *STATE_COUNTS)


def _lagged_sum(short: str, step: int, count: int, w: WindowSpec) -> Column:
    parts = [F.lag(short, step * i).over(w) if i else F.col(short) for i in range(count)]
    return reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p in parts])


def _values(running: str, rows: int, w: WindowSpec) -> Column:
    """How many values the last rows have, from a running count of them."""
    return F.col(running) - F.coalesce(F.lag(running, rows).over(w), F.lit(0))


def _lagged_extreme(fn, short: str, step: int, rows: int, w: WindowSpec) -> Column:
    lags = [i * step for i in range(rows // step)]
    if rows % step:
        lags.append(rows - step)
    return fn(*[F.lag(short, i).over(w) if i else F.col(short) for i in lags])


def true_range(w: WindowSpec) -> Column:
    previous = F.lag("close").over(w)
    return F.greatest(
        F.col("high") - F.col("low"),
        F.abs(F.col("high") - previous),
        F.abs(F.col("low") - previous),
    )


def _percent_from(reference: str) -> Column:
    return safe_divide(F.col("close") - F.col(reference), reference) * 100.0


def add_technical_indicators(bars: DataFrame) -> DataFrame:
    """Bars plus the indicator columns, the previous-bar columns used by the
    rules (``prior_*``) and ``bar_number``/``bar_count``.

    Columns nobody reads are pruned together with their windows.
    """
    return indicator_frame(bars)


def averages() -> list[Recurrence]:
    """The averages of the close, its changes and the true range."""
    change = F.col("close") - F.col("prior_close")
    wilder = 1.0 / 14
    return [
        *[Recurrence(name, F.col("close"), 2.0 / (n + 1), n, "close") for name, n in CLOSE_AVERAGES.items()],
        Recurrence("_gain", F.when(change > 0, change).when(change <= 0, 0.0), wilder, 14, "change"),
        Recurrence("_loss", F.when(change < 0, -change).when(change >= 0, 0.0), wilder, 14, "change"),
        Recurrence("atr_14", F.col("_tr"), wilder, 14),
    ]


def indicator_frame(
    bars: DataFrame, start: str | None = None, trace: bool = False, states: DataFrame | None = None
) -> DataFrame:
    """The indicators of whole histories, or of rows that follow a stored state.

    With ``start``, the bars have that struct column (the same in all rows of a symbol, NULL
    without a state, see ``operators.continuation``) with what windows take up of a state, and a
    column ``is_new``: other rows are the last bars before the state, which windows need and
    recurrences have seen. They end there; new rows meet their whole state, a column of the same
    name in ``states``, and go on from it. ``trace`` adds the columns from which a state is made.
    """
    row = F.col(ROW)
    df = with_history_block(bars) if BLOCK not in bars.columns else bars
    base = df.columns
    w = bars_window(df)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = F.coalesce(f"{start}.rows_before", F.lit(0)) if start else F.lit(0)

    def frame(rows: int) -> WindowSpec:
        return w.rowsBetween(1 - rows, 0)

    def since(value: Column, field: str, fn=F.coalesce) -> Column:
        """A running value that takes up what the state holds."""
        return fn(value, F.col(f"{start}.{field}")) if start else value

    running = w.rowsBetween(Window.unboundedPreceding, 0)
    df = number_rows(
        df,
        earlier if start else None,
        prior_close=F.lag("close").over(w),
        bar_count=F.count("*").over(whole) + earlier if start else F.count("*").over(whole),
        _tr=true_range(w),
        _sum10=F.sum("close").over(frame(10)),
        _seen_closes=F.count("close").over(running),
        _seen_highs=F.count("high").over(running),
        _seen_lows=F.count("low").over(running),
        _seen_volumes=F.count("volume").over(running),
        _std20=F.stddev_samp("close").over(frame(20)),
        _vol20=F.avg("volume").over(frame(20)),
        _padded=since(F.last("close", ignorenulls=True).over(running), "close_before"),
        _highest=since(F.max("high").over(running), "highest", F.greatest),
        _max20=F.max("high").over(frame(20)),
        _min20=F.min("low").over(frame(20)),
        traded_value_20=F.avg(F.col("close") * F.col("volume")).over(frame(20)),
    )
    if trace:
        df = df.withColumn("close_before", since(F.lag("_padded", TAIL).over(w), "close_before"))
    df = df.withColumns(
        {
            "all_time_high": F.when(F.col("high").isNotNull(), F.col("_highest")),
            "_return": safe_divide(F.col("_padded"), since(F.lag("_padded").over(w), "close_before")) - 1.0,
            **{f"_sum{k}": _lagged_sum("_sum10", 10, k // 10, w) for k in (20, 50, 100)},
            **{f"_n{k}": _values("_seen_closes", k, w) for k in (20, 50, 100, 200)},
            "_high252": _values("_seen_highs", 252, w),
            "_low252": _values("_seen_lows", 252, w),
            "_volumes20": _values("_seen_volumes", 20, w),
            "_max252": _lagged_extreme(F.greatest, "_max20", 20, 252, w),
            "_min252": _lagged_extreme(F.least, "_min20", 20, 252, w),
            "_max120": _lagged_extreme(F.greatest, "_max20", 20, 120, w),
            "prior_high_20": F.lag("_max20").over(w),
            "prior_low_20": F.lag("_min20").over(w),
        }
    )
    df = df.withColumns(
        {
            "_sum200": _lagged_sum("_sum100", 100, 2, w),
            "_seen_returns": F.count("_return").over(running),
            "_ret_std20": F.stddev_samp("_return").over(frame(20)),
            "prior_high": F.lag("_max252").over(w),
            "_prior120": F.lag("_max120").over(w),
            "_prior50": F.lag(F.when(F.col("_n50") == 50, F.col("_sum50"))).over(w),
            "_prior200": F.lag(F.when(F.col("_n100") == 100, F.col("_sum100"))).over(w)
            + F.lag(F.when(F.col("_n100") == 100, F.col("_sum100")), 101).over(w),
        }
    )
    df = df.select(
        *base, ROW, "bar_count", "prior_close", BLOCK_ROW, BLOCK_END, "_tr", "all_time_high",
        "prior_high", "prior_high_20", "prior_low_20", "traded_value_20",
        *[
            F.when(F.col(f"_n{k}") == k, F.col(f"_sum{k}") / k).alias(f"sma_{k}")
            for k in (20, 50, 100, 200)
        ],
        F.when(F.col("_n20") == 20, F.col("_std20")).alias("_std20"),
        F.when(
            _values("_seen_returns", 20, w) == 20, F.col("_ret_std20") * (252.0**0.5) * 100.0
        ).alias("historical_volatility_20"),
        F.when(F.col("_volumes20") == 20, F.col("_vol20")).alias("avg_volume_20"),
        F.when(F.col("_high252") >= 20, F.col("_max252")).alias("high_52w"),
        F.when(F.col("_low252") >= 20, F.col("_min252")).alias("low_52w"),
        F.when(row > 120, F.col("_prior120")).alias("prior_high_120"),
        F.when(row > 252, F.col("prior_high")).alias("prior_high_252"),
        (F.col("_prior50") / 50).alias("prior_sma_50"),
        (F.col("_prior200") / 200).alias("prior_sma_200"),
        *([F.col("_highest").alias("highest"), "close_before"] if trace else []),
    )

    if start:
        own = states.select(F.col("symbol").alias("_of"), start)
        df = df.where("is_new").drop(start).join(own, F.col("symbol").eqNullSafe(F.col("_of")), "left").drop("_of")
        base = [c for c in base if c != start]
    df = smooth(df, averages(), start, trace)
    df = df.withColumn("macd", F.col("_ema12") - F.col("_ema26"))
    df = smooth(df, [Recurrence("macd_signal", F.col("macd"), 0.2, 9, "macd")], start, trace)

    df = _derived(df)
    return df.select(*_kept(base), *(STATE if trace else []))


def _kept(base: Sequence[str]) -> list[str]:
    return [
        *base, ROW, "bar_count",
        *INDICATORS, "prior_close", "prior_high", "prior_high_120", "prior_high_252",
        "prior_high_20", "prior_low_20", "prior_sma_50", "prior_sma_200", "traded_value_20",
    ]


def last_indicators(bars: DataFrame) -> DataFrame:
    """The rows of :func:`add_technical_indicators` for the last bar of each symbol.

    Windows only number the rows, look one row back and sum up decays; what the last row shows
    is then one aggregate per symbol over rows counted from its end, so no row has frames of
    its own. An average is the sum of all values, each by its weight times the decay since.
    """
    df = with_history_block(bars) if BLOCK not in bars.columns else bars
    base = df.columns
    w = bars_window(df)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    row = F.col(ROW)

    df = df.withColumns(
        {
            ROW: F.row_number().over(w),
            "bar_count": F.count("*").over(whole),
            "prior_close": F.lag("close").over(w),
            "_tr": true_range(w),
            "_padded": F.last("close", ignorenulls=True).over(running),
        }
    )
    df, averaged = _decayed(
        df, w, _return=safe_divide(F.col("_padded"), F.lag("_padded").over(w)) - 1.0
    )

    back = F.col("bar_count") - row

    def within(rows: int, value: Column | str, skip: int = 0) -> Column:
        """The value in so many rows up to the last one, or to one ``skip`` rows before it."""
        value = F.col(value) if isinstance(value, str) else value
        return F.when(back.between(skip, rows + skip - 1), value)

    def at_end(name: str) -> Column:
        return F.max(F.when(back == 0, F.col(name)))

    def full(rows: int, fn: Callable[[Column], Column], name: str) -> Column:
        value = within(rows, name)
        return F.when(F.count(value) == rows, fn(value))

    def mean(rows: int, skip: int = 0) -> Column:
        value = within(rows, "close", skip)
        return F.when(F.count(value) == rows, F.sum(value) / rows)

    def average(r: Recurrence) -> Column:
        return F.when(F.count(r.value) >= r.min_values, F.sum(averaged[r.name])).alias(r.name)

    count = F.max("bar_count")
    prior_high = F.max(within(252, "high", 1))
    out = df.groupBy("symbol").agg(
        *[at_end(name).alias(name) for name in (*base, ROW, "prior_close") if name != "symbol"],
        count.alias("bar_count"),
        *[mean(k).alias(f"sma_{k}") for k in (20, 50, 100, 200)],
        *[average(r) for r in averages()],
        full(20, F.stddev_samp, "close").alias("_std20"),
        (full(20, F.stddev_samp, "_return") * (252.0**0.5) * 100.0).alias("historical_volatility_20"),
        full(20, F.avg, "volume").alias("avg_volume_20"),
        F.when(F.count(within(252, "high")) >= 20, F.max(within(252, "high"))).alias("high_52w"),
        F.when(F.count(within(252, "low")) >= 20, F.min(within(252, "low"))).alias("low_52w"),
        F.when(F.max(F.when(back == 0, F.col("high"))).isNotNull(), F.max("high")).alias("all_time_high"),
        prior_high.alias("prior_high"),
        F.when(count > 120, F.max(within(120, "high", 1))).alias("prior_high_120"),
        F.when(count > 252, prior_high).alias("prior_high_252"),
        F.max(within(20, "high", 1)).alias("prior_high_20"),
        F.min(within(20, "low", 1)).alias("prior_low_20"),
        mean(50, 1).alias("prior_sma_50"),
        ((mean(100, 1) + mean(100, 101)) / 2).alias("prior_sma_200"),
        F.avg(within(20, F.col("close") * F.col("volume"))).alias("traded_value_20"),
        F.collect_list(_close_at(F.lit(True))).alias("_closes"),
    )
    out = out.withColumns(
        {"macd": F.col("_ema12") - F.col("_ema26"), "_signal": _last_macd_signal("_closes")}
    ).withColumn("macd_signal", F.when(F.col("_signal.n") >= 9, F.col("_signal.signal")))
    return _derived(out).select(*_kept(base))


def _decayed(
    df: DataFrame, w: WindowSpec, until: Column | None = None, **extra: Column
) -> tuple[DataFrame, dict[str, Column]]:
    """What each value adds to its average at the symbol's last row, or at the row numbered
    ``until``: the value by its weight and by the decay since. Two windows serve all averages.
    """
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    row = F.col(ROW)

    def last_valued(value: Column) -> Column:
        return F.max(F.when(value.isNotNull(), row)).over(before)

    # Averages of one series with one speed share their decays.
    decays: dict[tuple[str, float], Recurrence] = {}
    for r in averages():
        decays.setdefault((r.series or r.name, r.alpha), r)
    lasts = {f"_last_{r.series or r.name}": last_valued(r.value) for r in averages()}
    df = df.withColumns({**extra, **lasts})
    logs, sums = {}, {}
    for r in decays.values():
        last = F.col(f"_last_{r.series or r.name}")
        old = F.pow(F.lit(1.0 - r.alpha), row - last)
        decayed = r.value.isNotNull() & last.isNotNull()
        counted = decayed if until is None else decayed & (row <= until)
        logs[f"_log_{r.name}"] = F.when(counted, F.log(old / (old + r.alpha))).otherwise(0.0)
        logs[f"_weight_{r.name}"] = F.when(decayed, r.alpha / (old + r.alpha)).otherwise(1.0)
        log = f"_log_{r.name}"
        sums[f"_since_{r.name}"] = F.sum(log).over(whole) - F.sum(log).over(running)
    found = {}
    for r in averages():
        key = decays[r.series or r.name, r.alpha].name
        value = F.col(f"_weight_{key}") * r.value * F.exp(f"_since_{key}")
        found[r.name] = value if until is None else F.when((row <= until) & F.col("trade_date").isNotNull(), value)
    return df.withColumns(logs).withColumns(sums), found


def last_states(bars: DataFrame, before: Column) -> DataFrame:
    """Per symbol what recurrences hold at its last bar before the day ``before``: columns ``rows``
    (that bar's number), ``last_date`` and STATE, all NULL without such a bar; ``tail``, its last
    252 bars then; ``recent``, the bars since; the first and the latest day.

    Like :func:`last_indicators`, from one aggregate per symbol instead of frames of every row.
    As in frames, rows without a date come first and are counted, but averages start after them.
    """
    w = Window.partitionBy("symbol").orderBy("trade_date")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    row, last = F.col(ROW), F.col("_rows")
    settled, inside = F.col("trade_date") < F.col("_before"), row <= last
    bar = ("trade_date", "open", "high", "low", "close", "volume")
    df = bars.withColumns(
        {
            "_before": before,
            ROW: F.row_number().over(w),
            "prior_close": F.lag("close").over(w),
            "_tr": true_range(w),
            "_padded": F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    df = df.withColumn("_rows", F.max(F.when(settled, row)).over(whole))
    df, averaged = _decayed(df, w, last)
    series = {r.series or r.name: F.when(inside, r.value) for r in averages()}
    out = df.groupBy("symbol").agg(
        F.max("_rows").alias("rows"),
        F.max(F.when(row == last, F.col("trade_date"))).alias("last_date"),
        *[F.coalesce(F.sum(value), F.lit(0.0)).alias(f"value_{name}") for name, value in averaged.items()],
        *[F.count(value).alias(f"seen_{name}") for name, value in series.items()],
        *[F.max(F.when(value.isNotNull(), row)).alias(f"last_{name}") for name, value in series.items()],
        F.max(F.when(inside, F.col("high"))).alias("highest"),
        F.max(F.when(row == last - TAIL, F.col("_padded"))).alias("close_before"),
        F.collect_list(F.when(inside, _close_at(F.col("trade_date").isNotNull()))).alias("_closes"),
        F.array_sort(F.collect_list(F.when(settled & (row > last - TAIL), F.struct(*bar)))).alias("tail"),
        F.array_sort(F.collect_list(F.when(~settled, F.struct(*bar, "source")))).alias("recent"),
        F.min("trade_date").alias("first_date"), F.max("trade_date").alias("latest_date"),
    ).withColumn("_signal", _last_macd_signal("_closes"))
    n = F.col("_signal.n")
    out = out.withColumns(
        {
            "value_macd_signal": F.col("_signal.signal"), "seen_macd": n.cast("long"),
            "last_macd": F.when(n > 0, F.col("rows")),
        }
    )
    held = [F.when(F.col("rows").isNotNull(), F.col(c)).alias(c) for c in STATE]
    return out.select("symbol", "rows", "last_date", *held, "tail", "recent", "first_date", "latest_date")


def _close_at(taken: Column) -> Column:
    """A row's close; where it is not ``taken``, it is counted as a value of zero."""
    return F.struct(F.col(ROW).alias("row"), F.col("close").alias("close"), taken.alias("taken"))


def _last_macd_signal(closes: str) -> Column:
    """An average of averages, which no single sum gives: folded over a symbol's closes, to a
    struct with the number ``n`` of values and the average ``signal`` of them."""
    start = F.struct(
        F.lit(0).alias("seen"), F.lit(0).alias("last"), F.lit(0.0).alias("fast"), F.lit(0.0).alias("slow"),
        F.lit(0).alias("n"), F.lit(0.0).alias("signal"),
    )

    def step(acc: Column, bar: Column) -> Column:
        known = bar["close"].isNotNull()

        def average(name: str, periods: int) -> Column:
            alpha = 2.0 / (periods + 1)
            old = F.pow(F.lit(1.0 - alpha), bar["row"] - acc["last"])
            mixed = (old * acc[name] + alpha * bar["close"]) / (old + alpha)
            first = F.when(~bar["taken"], 0.0).when(acc["seen"] == 0, bar["close"])
            return F.when(~known, acc[name]).otherwise(F.coalesce(first, mixed))

        fast, slow = average("fast", 12), average("slow", 26)
        seen = acc["seen"] + known.cast("int")
        signal = F.when(acc["n"] == 0, fast - slow).otherwise(0.8 * acc["signal"] + 0.2 * (fast - slow))
        return F.struct(
            seen.alias("seen"), F.when(known, bar["row"]).otherwise(acc["last"]).alias("last"),
            fast.alias("fast"), slow.alias("slow"),
            F.when(seen >= 26, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
            F.when(seen >= 26, signal).otherwise(acc["signal"]).alias("signal"),
        )

    return F.aggregate(F.array_sort(closes), start, step)


def _derived(df: DataFrame) -> DataFrame:
    """What follows from averages, sums and extremes of the same row."""
    rs = safe_divide("_gain", "_loss")
    df = df.withColumns(
        {
            "rsi_14": F.when(F.col("_loss") == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + rs)),
            "macd_hist": F.col("macd") - F.col("macd_signal"),
            "bb_mid": F.col("sma_20"),
            "atr_pct": safe_divide("atr_14", "close") * 100.0,
        }
    )
    return df.withColumns(
        {
            "bb_upper": F.col("bb_mid") + 2 * F.col("_std20"),
            "bb_lower": F.col("bb_mid") - 2 * F.col("_std20"),
            "relative_volume": safe_divide("volume", "avg_volume_20"),
            "distance_from_52w_high_pct": _percent_from("high_52w"),
            "distance_from_52w_low_pct": _percent_from("low_52w"),
            "distance_from_all_time_high_pct": _percent_from("all_time_high"),
            "ma_stack_status": _stack_status(),
        }
    )


def _stack_status() -> Column:
    pairs = [("sma_20", "sma_50"), ("sma_50", "sma_100"), ("sma_100", "sma_200")]
    up = reduce(lambda a, b: a & b, [F.col(a) > F.col(b) for a, b in pairs])
    down = reduce(lambda a, b: a & b, [F.col(a) < F.col(b) for a, b in pairs])
    return F.when(up, F.lit("bullish")).when(down, F.lit("bearish")).otherwise(F.lit("mixed"))

