"""The one window clustering shared by every per-symbol operator.

Bars are unique per (symbol, trade_date), so a symbol's window never holds more
rows than there are trading days, however many raw records fed it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

BLOCK = "history_block"
BLOCK_DAYS = 1000


def with_history_block(df: DataFrame, block_days: int = BLOCK_DAYS) -> DataFrame:
    """Number fixed spans of calendar days; a function of the date alone.

    Ordering by (block, date) equals ordering by date, so a window over
    (symbol) and a window over (symbol, block) use one and the same sort.
    """
    days = F.datediff(F.col("trade_date"), F.lit("1970-01-01").cast("date"))
    return df.withColumn(BLOCK, F.floor(days / block_days).cast("int"))


def bars_window(df: DataFrame, descending: bool = False) -> WindowSpec:
    order = [BLOCK, "trade_date"] if BLOCK in df.columns else ["trade_date"]
    keys = [F.col(c).desc() if descending else F.col(c) for c in order]
    return Window.partitionBy("symbol").orderBy(*keys)


def latest_rows(df: DataFrame, n: int = 1, keys=("symbol",), order="trade_date") -> DataFrame:
    """The last ``n`` rows per key; Spark cuts each map task's groups to n first."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_pos", F.row_number().over(w)).where(F.col("_pos") <= n).drop("_pos")
