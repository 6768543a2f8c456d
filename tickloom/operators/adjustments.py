"""Split adjustment: each bar divided by the product of all later split ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")


def apply_split_adjustment(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """Bars and splits meet in one window by symbol, so nothing is broadcast and
    the factor is a running product from the newest day backwards."""
    day = F.datediff("trade_date", F.lit("1970-01-01").cast("date"))
    markers = splits.where(F.col("value") > 0).select(
        "symbol", F.col("ex_date").alias("trade_date"), F.col("value").cast("double").alias("_ratio")
    )
    both = (
        bars.withColumns({"_ratio": F.lit(None).cast("double"), "_is_bar": F.lit(True)})
        .unionByName(markers.withColumn("_is_bar", F.lit(False)), allowMissingColumns=True)
        .withColumn("_day", -day)
    )
    later = (
        Window.partitionBy("symbol").orderBy("_day").rangeBetween(Window.unboundedPreceding, -1)
    )
    factored = both.withColumn("adjustment_factor", F.coalesce(F.product("_ratio").over(later), F.lit(1.0)))
    factor = F.col("adjustment_factor")
    adjusted = factored.where("_is_bar").drop("_ratio", "_is_bar", "_day")
    adjusted = adjusted.withColumns({p: F.col(p) / factor for p in PRICES})
    return adjusted.withColumns({"volume": F.col("volume") * factor, "adj_close": F.col("close")})
