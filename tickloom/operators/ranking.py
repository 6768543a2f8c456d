"""Exact peer percentile ranks without a task per peer group.

A peer group may be a third of the universe, so a group is never sorted in one
place.  Equal values are counted first; the distinct values are spread over
buckets by a monotone function of the value; a bucket's offset is the running
count of the buckets below it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ranked metrics, and the ones where a low value is good.
HIGH_IS_BETTER = (
    "roe_pct", "roa_pct", "roce_pct", "revenue_growth_pct", "net_income_growth_pct",
    "eps_growth_pct", "free_cash_flow_growth_pct", "free_cash_flow_yield_pct",
    "piotroski_f_score", "altman_z_score",
)
LOW_IS_BETTER = (
    "debt_to_equity", "net_debt_to_ebitda", "price_to_book", "price_to_earnings",
    "ev_to_ebitda", "ev_to_sales",
)
PEER_GROUPS = {"sector": "sector", "industry": "industry", "market_cap_bucket": "mkt_cap"}


def value_bucket(value: Column, per_e_fold: int = 256) -> Column:
    """Monotone step function, about 0.4 % of the value wide on either side of zero."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value) * 1e6) * per_e_fold).cast("long")


def average_rank_percent(long: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct (keys, value) with ``rank_pct`` = average-tie rank / count × 100."""
    keys = list(keys)
    counted = (
        long.groupBy(*keys, value).agg(F.count("*").alias("_ties"))
        .withColumn("_bucket", value_bucket(F.col(value)))
    )
    in_group = Window.partitionBy(*keys)
    offsets = (
        counted.groupBy(*keys, "_bucket").agg(F.sum("_ties").alias("_in_bucket"))
        .withColumns(
            {
                "_below": F.coalesce(
                    F.sum("_in_bucket").over(
                        in_group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
                    ),
                    F.lit(0),
                ),
                "_all": F.sum("_in_bucket").over(in_group),
            }
        )
        .drop("_in_bucket")
    )
    before = (
        Window.partitionBy(*keys, "_bucket").orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = counted.withColumn("_before", F.coalesce(F.sum("_ties").over(before), F.lit(0)))
    rank = F.col("_below") + F.col("_before") + (F.col("_ties") + 1) / 2
    return placed.join(offsets, [*keys, "_bucket"]).select(
        *keys, value, (rank / F.col("_all") * 100).alias("rank_pct")
    )


def peer_ranks_long(
    summary: DataFrame,
    groups: Mapping[str, str] = PEER_GROUPS,
    high: Sequence[str] = HIGH_IS_BETTER,
    low: Sequence[str] = LOW_IS_BETTER,
) -> DataFrame:
    """(symbol, peer_kind, metric, rank_pct) for every metric that has a value.

    A low-is-better metric is ranked by its negative.
    """
    metrics = [
        F.struct(F.lit(m).alias("metric"), (F.col(m) if m in high else -F.col(m)).alias("value"))
        for m in (*high, *low) if m in summary.columns
    ]
    kinds = [
        F.struct(F.lit(suffix).alias("peer_kind"), F.col(column).alias("peer"))
        for column, suffix in groups.items() if column in summary.columns
    ]
    long = (
        summary.select("symbol", F.explode(F.array(*metrics)).alias("m"), F.array(*kinds).alias("k"))
        .where(F.col("m.value").isNotNull())
        .select("symbol", "m.metric", (F.col("m.value") + 0.0).alias("value"),
                F.explode("k").alias("k"))
        .select("symbol", "metric", "value", "k.peer_kind", "k.peer")
        .where(F.col("peer").isNotNull())
    )
    keys = ["peer_kind", "peer", "metric"]
    ranks = average_rank_percent(long, keys, "value")
    # Many rows may share one value; the ranked side is unique per key, so AQE
    # can split a hot key's rows over tasks.
    return long.join(ranks, [*keys, "value"]).select("symbol", "peer_kind", "metric", "rank_pct")


def add_peer_ranks(
    summary: DataFrame,
    groups: Mapping[str, str] = PEER_GROUPS,
    high: Sequence[str] = HIGH_IS_BETTER,
    low: Sequence[str] = LOW_IS_BETTER,
) -> DataFrame:
    """Wide form: ``{metric}_{peer_kind}_rank`` columns next to the summary."""
    long = peer_ranks_long(summary, groups, high, low)
    wide = long.groupBy("symbol").agg(
        *[
            F.max(
                F.when((F.col("metric") == m) & (F.col("peer_kind") == suffix), F.col("rank_pct"))
            ).alias(f"{m}_{suffix}_rank")
            for suffix in groups.values() for m in (*high, *low)
        ]
    )
    return summary.join(wide, "symbol", "left")
