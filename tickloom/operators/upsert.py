"""Keep-latest upserts without MERGE: union, rank per key, overwrite partitions.

Ranking keeps one row per key; Spark cuts every map task's rows per key to one
before the shuffle, so a key repeated millions of times costs one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.session import delete_path, freed_shuffles, materialise, path_exists, shared_path

# Natural keys of the persisted tables.
KEYS: dict[str, tuple[str, ...]] = {
    "stock_universe": ("symbol",),
    "price_daily": ("symbol", "trade_date", "source"),
    "technical_snapshots": ("symbol", "as_of_date", "source"),
    "fundamentals_annual": ("symbol", "fiscal_year", "source"),
    "fundamentals_quarterly": ("symbol", "fiscal_year", "fiscal_quarter", "source"),
    "corporate_actions": ("symbol", "ex_date", "action_type"),
    "market_flows_daily": ("trade_date", "participant", "source"),
    "instrument_master": ("exchange", "tradingsymbol", "segment", "instrument_type"),
    "composite_scores": ("symbol", "as_of_date", "source"),
    "signal_audit": ("symbol", "as_of_date", "signal_name", "source"),
    "delivery_data": ("symbol", "trade_date"),
    "bulk_block_deals": ("symbol", "deal_date", "client_name", "deal_type", "quantity"),
    "index_membership_history": ("index_name", "symbol", "from_date", "source"),
    "research_watchlist_items": ("user_id", "watchlist_name", "symbol"),
}


def last_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    newest = [F.col(o).desc() if isinstance(o, str) else o for o in order] or [F.col(keys[0])]
    w = Window.partitionBy(*keys).orderBy(*newest)
    return rows.withColumn("_pos", F.row_number().over(w)).where("_pos = 1").drop("_pos")


def keep_latest(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = ()
) -> DataFrame:
    """Incoming rows replace existing ones with the same key (NULL keys compare equal);
    among incoming duplicates the last by ``order`` (an ingest number, say) wins.
    Rows that ``order`` leaves level are told apart by their values, never by chance."""
    both = existing.withColumn("_batch", F.lit(0)).unionByName(
        incoming.withColumn("_batch", F.lit(1)), allowMissingColumns=True
    )
    return last_per_key(both, keys, ["_batch", *order, *by_values(both, keys)]).drop("_batch")


def by_values(rows: DataFrame, keys: Sequence[str]) -> list[Column]:
    """A last resort among rows of one key: the larger values, column by column."""
    kinds = [(n, t) for n, t in rows.dtypes if n not in (*keys, "_batch")]
    return [F.col(f"`{n}`").desc() for n, t in kinds if not t.startswith(("map", "variant"))]


def change_counts(
    existing: DataFrame, accepted: DataFrame, received: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """inserted / updated / skipped of one batch, in one pass over keys and flags."""
    flags = (
        existing.select(*keys, F.lit(1).alias("_old"), F.lit(0).alias("_new"))
        .unionByName(accepted.select(*keys, F.lit(0).alias("_old"), F.lit(1).alias("_new")))
        .groupBy(*keys).agg(F.max("_old").alias("_old"), F.sum("_new").alias("_new"))
    )
    total = received.select(F.count("*")).scalar()
    return flags.agg(
        F.count_if((F.col("_old") == 0) & (F.col("_new") > 0)).alias("inserted"),
        F.count_if((F.col("_old") == 1) & (F.col("_new") > 0)).alias("updated"),
        F.coalesce(F.sum("_new"), F.lit(0)).alias("_accepted"),
    ).select("inserted", "updated", (total - F.col("_accepted")).alias("skipped"))


def clean_prices(incoming: DataFrame) -> DataFrame:
    """Bars need all four prices; missing volume is zero."""
    ok = F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull()
    return incoming.where(ok & F.col("close").isNotNull()).withColumn(
        "volume", F.coalesce("volume", F.lit(0.0))
    )


def upsert_prices(existing: DataFrame, incoming: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    return keep_latest(existing, clean_prices(incoming), KEYS["price_daily"], order)


def clean_snapshots(
    incoming: DataFrame, indicators: Sequence[str], only_after: Column | None = None
) -> DataFrame:
    """Rows with at least one indicator, from ``only_after`` on."""
    df = incoming.where(F.coalesce(*[F.col(i).cast("string") for i in indicators]).isNotNull())
    return df if only_after is None else df.where(F.col("as_of_date") >= only_after)


def clean_quarters(incoming: DataFrame) -> DataFrame:
    return incoming.where(F.col("fiscal_quarter").between(1, 4) & F.col("fiscal_year").isNotNull())


def clean_actions(incoming: DataFrame) -> DataFrame:
    return incoming.where(F.col("ex_date").isNotNull() & F.col("value").isNotNull())


def clean_flows(incoming: DataFrame) -> DataFrame:
    return incoming.where(
        F.col("trade_date").isNotNull() & F.col("participant").isNotNull()
    ).withColumn("participant", F.upper(F.trim("participant")))


def collapse_audits(
    audits: DataFrame, order: Sequence[str | Column] = ("id",)
) -> DataFrame:
    """Last row per observation; its ``scan_count`` is the sum over the repeats.

    The sum is a map-side combined aggregate joined to the kept row, so a heavily
    repeated observation is never gathered.
    """
    keys = KEYS["signal_audit"]
    counts = audits.groupBy(*keys).agg(
        F.sum(F.coalesce("scan_count", F.lit(1))).alias("_scans")
    )
    kept = last_per_key(audits, keys, order)
    return kept.join(counts, list(keys)).withColumn("scan_count", F.col("_scans")).drop("_scans")


def save_audits(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """New observations start at one scan, repeats add to the count and refresh values."""
    batch = existing.withColumn("_batch", F.lit(0)).unionByName(
        incoming.withColumns({"scan_count": F.lit(1), "_batch": F.lit(1)}), allowMissingColumns=True
    )
    order = ["_batch", *by_values(batch, KEYS["signal_audit"])]
    return collapse_audits(batch, order).drop("_batch")


def merge_watchlist(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Per-column merge: keep the old value when the new one is empty; tags are an
    ordered case-insensitive union of at most 240 characters; notes are appended
    unless already contained."""
    keys = list(KEYS["research_watchlist_items"])
    new = last_per_key(incoming, keys, ["updated_at"])
    old = existing.withColumnsRenamed({c: f"_{c}" for c in existing.columns if c not in keys})
    both = old.join(new.withColumn("_new", F.lit(True)), keys, "full")
    fresh = F.coalesce("_new", F.lit(False))

    def text(value: Column | str) -> Column:
        return F.trim(F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit("")))

    def newest(name: str) -> Column:
        return F.coalesce(F.when(text(F.col(name).cast("string")) != "", F.col(name)), f"_{name}")

    status = F.lower(text("review_status"))
    status = F.replace(status, F.lit(" "), F.lit("_"))
    status = F.when(status.isin("watch", "deep_dive", "avoid", "done"), status).otherwise("watch")

    tags = F.filter(
        F.transform(F.split(F.concat_ws(",", text("_tags"), text("tags")), ","), lambda t: F.trim(t)),
        lambda t: t != "",
    )

    def add_tag(seen: Column, tag: Column) -> Column:
        known = F.exists(seen, lambda s: F.lower(s) == F.lower(tag))
        return F.when(known, seen).otherwise(F.concat(seen, F.array(tag)))

    merged_tags = F.substring(
        F.array_join(F.aggregate(tags, F.array().cast("array<string>"), add_tag), ", "), 1, 240
    )
    old_notes, new_notes = text("_notes"), text("notes")
    notes = (
        F.when(new_notes == "", old_notes)
        .when(old_notes == "", new_notes)
        .when(old_notes.contains(new_notes), old_notes)
        .otherwise(F.concat(old_notes, F.lit("\n"), new_notes))
    )
    return both.select(
        *keys,
        newest("source_universe").alias("source_universe"),
        newest("source_run_id").alias("source_run_id"),
        newest("reason").alias("reason"),
        F.when(fresh, status).otherwise(F.col("_review_status")).alias("review_status"),
        F.when(fresh, merged_tags).otherwise(F.col("_tags")).alias("tags"),
        F.when(fresh, notes).otherwise(F.col("_notes")).alias("notes"),
        F.when(fresh, F.lit(True)).otherwise(F.col("_active")).alias("active"),
        F.coalesce("updated_at", "_updated_at").alias("updated_at"),
    )


def incremental_bounds(
    symbols: DataFrame, stored: DataFrame, end: Column, overlap_days: int = 5, years: int = 5
) -> DataFrame:
    """First day to fetch per symbol: latest − overlap, else ``years`` back."""
    latest = stored.groupBy("symbol").agg(F.max("trade_date").alias("latest_date"))
    start = F.coalesce(
        F.date_sub("latest_date", overlap_days), F.date_sub(end, 365 * years)
    )
    return (
        symbols.select("symbol").distinct().join(latest, "symbol", "left")
        .withColumns({"start_date": start, "end_date": end})
        .withColumn("skip", F.col("start_date") > F.col("end_date"))
    )


def with_failover(
    primary: DataFrame, primary_report: DataFrame, fallback: DataFrame, reason: str
) -> DataFrame:
    """Primary rows of valid symbols; fallback rows, with a reason, of all others."""
    valid = primary_report.where("ok").select("symbol")
    kept = primary.join(valid, "symbol", "left_semi").withColumn("fallback_reason", F.lit(""))
    rest = fallback.join(valid, "symbol", "left_anti").withColumn("fallback_reason", F.lit(reason))
    return kept.unionByName(rest, allowMissingColumns=True)


def run_status(success: Column, failed: Column) -> Column:
    return (
        F.when((success == 0) & (failed > 0), F.lit("failed"))
        .when(failed > 0, F.lit("completed_with_errors"))
        .otherwise(F.lit("completed"))
    )


def run_summary(results: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """One row per run from its result rows (``error`` NULL = success)."""
    counts = results.groupBy(*keys).agg(
        F.count("*").alias("requested_symbols"),
        F.count_if(F.col("error").isNull()).alias("successful_symbols"),
        F.count_if(F.col("error").isNotNull()).alias("failed_symbols"),
    )
    return counts.withColumn(
        "status", run_status(F.col("successful_symbols"), F.col("failed_symbols"))
    )


def append_run(results: DataFrame, path: str) -> None:
    """Append-only runs, one directory per run."""
    results.write.mode("append").partitionBy("run_id").parquet(path)


def write_upsert(
    spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str], partition: str,
    order: Sequence[str | Column], schema: StructType | None = None,
) -> DataFrame:
    """Upsert ``incoming`` into a partitioned parquet table; returns the stored batch.

    The batch is stored once. Its partition values (bounded by the calendar) become a
    literal filter, so only partitions it touches are scanned; ``order`` says which of
    several rows of one key is the last; columns of it that are not stored stay out. Merged rows are staged in the shared folder,
    since a table must not be overwritten while it is being read, and the stage goes
    once the table is written. A retry after a lost executor sees whole data.
    """
    batch = materialise(incoming, "batch")
    values = [r[0] for r in batch.select(partition).distinct().collect()]
    if not values:
        return batch
    current = touched_rows(spark, path, partition, values, schema)
    extra = [c for c in order if isinstance(c, str) and c not in current.columns]
    merged = keep_latest(current, batch, keys, order).drop(*extra)
    stage = shared_path(spark, "stage")
    with freed_shuffles(spark):
        merged.write.parquet(stage)
    (
        spark.read.schema(merged.schema).parquet(stage)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition).parquet(path)
    )
    delete_path(spark, stage)
    spark.catalog.refreshByPath(path)
    return batch


def touched_rows(
    spark: SparkSession, path: str, partition: str, values: Sequence[object],
    schema: StructType | None = None,
) -> DataFrame:
    """The stored rows of the partitions a batch touches, by a partition filter."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    wanted = F.col(partition).isin([v for v in values if v is not None])
    if None in values:
        wanted = wanted | F.col(partition).isNull()
    return reader.parquet(path).where(wanted)


def store_by_year(
    spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str], day: str,
    order: Sequence[str | Column],
) -> DataFrame:
    """Upsert rows into a table that is partitioned by the year of ``day``; the table
    is made if it is not there. Returns the whole table, read back."""
    year = f"{day}_year"
    batch = rows.withColumn(year, F.year(day))
    if path_exists(spark, path):
        write_upsert(spark, path, batch, keys, year, order)
    else:
        empty = batch.limit(0)
        extra = [c for c in order if isinstance(c, str)]
        merged = keep_latest(empty, batch, keys, order).drop(*extra)
        with freed_shuffles(spark):
            merged.write.partitionBy(year).parquet(path)
    return spark.read.parquet(path).drop(year)
