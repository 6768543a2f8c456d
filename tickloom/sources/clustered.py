"""A price table clustered by symbol: bucketed and sorted, so that windows by symbol need no Exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.session import shared_path

#: Bars in one bucket, about.
BUCKET_BARS = 2_000_000


def write_clustered(
    bars: DataFrame, name: str, path: str | None = None, buckets: int | None = None
) -> DataFrame:
    """Store bars as table ``name`` in buckets of the symbol, one sorted file each; read back.

    The one Exchange is that of the write. Every later job over the table whose windows,
    groups or joins are by symbol goes without; the catalogue keeps the layout.
    """
    spark = bars.sparkSession
    n = buckets or max(1, -(-bars.count() // BUCKET_BARS))
    (
        bars.repartition(n, "symbol").sortWithinPartitions("symbol", "trade_date")
        .write.bucketBy(n, "symbol").sortBy("symbol", "trade_date")
        .option("path", path or shared_path(spark, name)).mode("overwrite").saveAsTable(name)
    )
    return read_clustered(spark, name)


def read_clustered(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
