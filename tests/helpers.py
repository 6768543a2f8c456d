"""Small frames and conversions for the tests."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

START = dt.date(2020, 1, 1)


def bars(spark: SparkSession, closes, *, symbol="X.NS", highs=None, lows=None, volumes=None,
         start=START, step=1) -> DataFrame:
    n = len(closes)
    highs = highs or [c + 1 for c in closes]
    lows = lows or [c - 1 for c in closes]
    volumes = volumes or [100_000.0] * n
    rows = [
        (symbol, start + dt.timedelta(days=i * step), float(closes[i]), float(highs[i]),
         float(lows[i]), float(closes[i]), float(volumes[i]))
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows, "symbol string, trade_date date, open double, high double, low double, "
        "close double, volume double")


def ordered(df: DataFrame, *keys: str) -> pd.DataFrame:
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)


def exchanges(df: DataFrame) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip() for line in plan.splitlines() if "Exchange" in line]


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
