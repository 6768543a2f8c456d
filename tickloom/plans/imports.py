"""Jobs that bring data in: statements from users and sources, flows, instruments, index lists.

Each validates, stores what passes by an upsert that rewrites only the partitions it touches,
and returns what it did as tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators.membership import replay_snapshots, sync_snapshot
from tickloom.operators.quality import validate_annual, validate_quarterly
from tickloom.operators.upsert import KEYS, change_counts, clean_flows, clean_quarters, write_upsert
from tickloom.session import materialise, path_exists
from tickloom.sources.readers import flows_json, import_statements, write_snapshot


@dataclass(frozen=True)
class ImportResult:
    """``preview``: rows, errors and warnings per symbol (and of the ``file``); ``counts``:
    inserted, updated and skipped rows; ``written``: whether anything was stored."""

    preview: DataFrame
    counts: DataFrame
    written: bool


def table_name(quarterly: bool) -> str:
    return "fundamentals_quarterly" if quarterly else "fundamentals_annual"


def store(rows: DataFrame, path: str, keys: Sequence[str], partition: str, order: Sequence[str] = ()) -> None:
    """Upsert into a partitioned table, made if it is not there."""
    kept = rows.drop(*order)
    if not path_exists(rows.sparkSession, path):
        kept.limit(0).write.partitionBy(partition).parquet(path)
    write_upsert(rows.sparkSession, path, rows, keys, partition, order, schema=kept.schema)


def first_url(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """All rows of a symbol carry the first known ``source_url`` of it, in file order."""
    if "source_url" not in rows.columns:
        return rows.withColumn("source_url", F.lit(None).cast("string"))
    known = F.when(F.col("source_url").isNotNull(), F.struct(*order, "source_url"))
    first = F.min(known).over(Window.partitionBy("symbol", "source"))
    return rows.withColumn("source_url", first["source_url"])


def preview_statements(frame: DataFrame, quarterly: bool, sectors: DataFrame | None = None) -> DataFrame:
    """symbol, rows, errors, warnings of every symbol, and of the file as a whole if it has faults."""
    named = frame.where(F.trim(F.coalesce("symbol", F.lit(""))) != "")
    if quarterly:
        absent = [c for c in ("revenue", "net_income") if c not in named.columns]
        report = validate_quarterly(named.withColumns({c: F.lit(None).cast("double") for c in absent}))
    else:
        facts = {c: F.lit(None).cast("string") for c in ("sector", "industry") if c not in named.columns}
        if sectors is not None:
            named = named.drop("sector", "industry").join(sectors.select("symbol", "sector", "industry"), "symbol", "left")
            facts = {}
        report = validate_annual(named.withColumns(facts))
    blank = F.trim(F.coalesce("symbol", F.lit(""))) == ""
    file = frame.agg(F.count("*").alias("rows"), F.count_if(blank).alias("_blank")).select(
        F.lit("file").alias("symbol"), "rows",
        F.when(F.col("rows") == 0, F.array(F.lit("no rows in the file")))
        .when(F.col("_blank") > 0, F.array(F.lit("rows without a symbol"))).alias("errors"),
        F.array().cast("array<string>").alias("warnings"),
    ).where(F.col("errors").isNotNull())
    return report.select("symbol", "rows", "errors", "warnings").unionByName(file)


def import_fundamentals(
    raw: DataFrame, root: str, *, source: str, order: Sequence[str], quarterly: bool = False,
    in_crore: bool = True, allow_partial: bool = False, dry_run: bool = True,
    sectors: DataFrame | None = None,
) -> ImportResult:
    """A user's statements: normalised, checked, and stored unless something is wrong.

    Errors of any symbol keep the whole file out, unless ``allow_partial``; ``dry_run`` only
    shows the preview. ``order`` names columns of ``raw`` that give the order of its rows: the
    last of several rows of a period stays, the first known source URL of a symbol holds for
    all of it. Symbols that ``stock_universe`` lacks are added to it.
    """
    spark = raw.sparkSession
    frame = import_statements(raw, source=source, quarterly=quarterly, in_crore=in_crore)
    frame = materialise(frame, "import")
    preview = materialise(preview_statements(frame, quarterly, sectors), "preview")
    faulty = not preview.where(F.size("errors") > 0).isEmpty()
    if dry_run or (faulty and not allow_partial):
        skipped = F.count("*") if faulty and not allow_partial else F.lit(0).cast("bigint")
        counts = frame.agg(
            F.lit(0).cast("bigint").alias("inserted"), F.lit(0).cast("bigint").alias("updated"),
            skipped.alias("skipped"),
        )
        return ImportResult(preview, counts, False)
    kind = table_name(quarterly)
    path, keys = f"{root}/{kind}", KEYS[kind]
    rows = frame.where(F.col("symbol").isNotNull() & F.col("fiscal_year").isNotNull())
    rows = materialise(first_url(clean_quarters(rows) if quarterly else rows, order), "accepted")
    old = spark.read.parquet(path).select(*keys) if path_exists(spark, path) else rows.select(*keys).limit(0)
    counts = materialise(change_counts(old, rows, frame, keys), "counts")
    store(rows, path, keys, "fiscal_year", order)
    register_symbols(spark, rows, root, "manual_fundamentals_import")
    return ImportResult(preview, counts, True)


def register_symbols(spark: SparkSession, rows: DataFrame, root: str, source: str) -> None:
    """Symbols that the universe table lacks are appended with their symbol as name."""
    path = f"{root}/stock_universe"
    new = rows.select("symbol").distinct()
    if path_exists(spark, path):
        new = new.join(spark.read.parquet(path).select("symbol"), "symbol", "left_anti")
    added = materialise(
        new.select("symbol", F.col("symbol").alias("name"), F.lit("NSE").alias("exchange"), F.lit(source).alias("source")),
        "symbols",
    )
    if not added.isEmpty():
        added.write.mode("append").parquet(path)


def refresh_fundamentals(
    incoming: DataFrame, root: str, *, sources: Sequence[str], order: Sequence[str] = (),
    quarterly: bool = False, sectors: DataFrame | None = None,
) -> DataFrame:
    """Statements of several sources: each (symbol, source) that passes is stored, one with errors
    keeps what was stored. Returns symbol, source, rows, errors, warnings, status."""
    kind = table_name(quarterly)
    batch = materialise(incoming, "statements")
    reports = None
    for source in sources:
        own = preview_statements(batch.where(F.col("source") == source), quarterly, sectors)
        own = own.withColumn("source", F.lit(source))
        reports = own if reports is None else reports.unionByName(own)
    status = F.when(F.size("errors") > 0, F.lit("failed")).otherwise(F.lit("stored"))
    report = materialise(reports.withColumn("status", status), "report")
    bad = report.where("status = 'failed'").select("symbol", "source")
    rows = batch.join(bad, ["symbol", "source"], "left_anti").where(F.col("fiscal_year").isNotNull())
    rows = clean_quarters(rows) if quarterly else rows
    store(first_url(rows, order), f"{root}/{kind}", KEYS[kind], "fiscal_year", order)
    return report


def refresh_market_flows(payloads: DataFrame, root: str, order: str | None = None) -> DataFrame:
    """Flow payloads into the stored flows (by year); the stored table, read back."""
    spark, path = payloads.sparkSession, f"{root}/market_flows_daily"
    rows = clean_flows(flows_json(payloads, order=order)).withColumn("trade_date_year", F.year("trade_date"))
    store(rows, path, KEYS["market_flows_daily"], "trade_date_year")
    return spark.read.parquet(path).drop("trade_date_year")


def sync_instruments(master: DataFrame, root: str, stamp: str) -> DataFrame:
    """A provider's instrument list: one dated copy, and an upsert by exchange; read back."""
    spark, path = master.sparkSession, f"{root}/instrument_master"
    write_snapshot(master, f"{root}/instrument_snapshots", stamp)
    copy = spark.read.parquet(f"{root}/instrument_snapshots/snapshot_ts={stamp}")
    store(copy, path, KEYS["instrument_master"], "exchange")
    return spark.read.schema(copy.schema).parquet(path)


def refresh_index_membership(
    snapshot: DataFrame, root: str, index_name: str, effective: Column, source: str
) -> DataFrame:
    """Today's constituents against the stored history: periods open and close; read back."""
    spark, path = snapshot.sparkSession, f"{root}/index_membership_history"
    done = sync_snapshot(spark.read.parquet(path), snapshot, index_name, effective, source)
    return _replaced(done, path)


def import_membership_history(
    snapshots: DataFrame, root: str, index_name: str, source: str, *,
    replace_existing: bool = False, attributes: Sequence[str] = ("name", "industry", "isin"),
) -> DataFrame:
    """Dated constituent lists replayed into the stored history, periods with their attributes."""
    path = f"{root}/index_membership_history"
    history = snapshots.sparkSession.read.parquet(path)
    done = replay_snapshots(history, snapshots, index_name, source, replace_existing, attributes)
    return _replaced(done, path)


def _replaced(rows: DataFrame, path: str) -> DataFrame:
    """The whole of a small table written anew, after its rows are safe in the shared folder."""
    spark = rows.sparkSession
    materialise(rows, "history").write.mode("overwrite").parquet(path)
    spark.catalog.refreshByPath(path)
    return spark.read.schema(rows.schema).parquet(path)


def lookup_tokens(wanted: DataFrame, instruments: DataFrame) -> DataFrame:
    """The token of each wanted (tradingsymbol, exchange, segment, instrument_type), NULL where none fits.

    The exchange defaults to NSE. A segment or type that is NULL may be any, an empty one must be
    absent; of several that fit, those with an absent segment and type come first, then the
    smallest token. Rows keep all columns of ``wanted``.
    """
    asked = wanted.withColumns(
        {
            "_symbol": F.upper(F.trim("tradingsymbol")),
            "_exchange": F.upper(F.coalesce("exchange", F.lit("NSE"))),
            "_row": F.monotonically_increasing_id(),
        }
    )
    asked = materialise(asked, "wanted")
    known = instruments.select(
        F.col("tradingsymbol").alias("_symbol"), F.col("exchange").alias("_exchange"),
        F.col("segment").alias("_segment"), F.col("instrument_type").alias("_type"), "instrument_token",
    )

    def fits(want: str, have: str) -> Column:
        return F.col(want).isNull() | F.nullif(F.col(want), F.lit("")).eqNullSafe(F.col(have))

    best = F.min(
        F.struct(F.col("_segment").isNotNull().alias("s"), F.col("_type").isNotNull().alias("t"), "instrument_token")
    )
    found = (
        asked.join(known, ["_symbol", "_exchange"])
        .where(fits("segment", "_segment") & fits("instrument_type", "_type"))
        .groupBy("_row").agg(best.alias("_best"))
        .select("_row", F.col("_best.instrument_token").alias("instrument_token"))
    )
    return asked.join(found, "_row", "left").drop("_row", "_symbol", "_exchange")
