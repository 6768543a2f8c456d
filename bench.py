"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tickloom.queries import REGISTRY
from tickloom.session import local_session

#: Seconds of timed runs after which a query is not repeated.
ENOUGH = 6
HEADLINE = (
    "daily_bars",
    "ema",
    "technical_indicators",
    "split_adjusted_bars",
    "mixed_source_prices",
    "signal_trade_plans",
    "strategy_history_summary",
    "signal_backtest_summary",
    "portfolio_metrics",
    "walk_forward",
    "membership_periods",
    "price_upsert",
    "annual_ratios",
    "multi_year_cagr",
    "source_disagreements",
    "peer_percentile_ranks",
    "delivery_analytics",
    "result_volatility",
    "ohlcv_validation",
    "market_breadth",
    "support_resistance_zones",
    "universe_scan",
    "scan_comparison",
    "composite_scores",
)


def seconds(spark, name: str, root: str, repeats: int) -> tuple[float, float]:
    """Medians of the timed runs after one untimed run: all of it, and planning alone.

    A query whose runs have taken long enough is not run again.
    """
    taken, planned = [], []
    for number in range(repeats + 1):
        start = time.perf_counter()
        df = REGISTRY[name].run(spark, root)
        df._jdf.queryExecution().executedPlan()
        planning = time.perf_counter() - start
        df.write.format("noop").mode("overwrite").save()
        if number:
            taken.append(time.perf_counter() - start)
            planned.append(planning)
        if sum(taken) > ENOUGH:
            break
    return statistics.median(taken), statistics.median(planned)


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session("tickloom-bench", cpus)
    timings = {name: seconds(spark, name, root, repeats) for name in wanted}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(t for t, _ in timings.values()), 3),
                "unit": "sec",
                "queries": {name: round(t, 3) for name, (t, _) in timings.items()},
                "before_execution": {name: round(p, 3) for name, (_, p) in timings.items()},
                "sf": root.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
