"""Index membership: snapshot sync (type-2 history) and replay of dated snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.upsert import by_values, last_per_key

_PERIOD = ("symbol", "index_name", "from_date", "to_date", "active", "source")


def sync_snapshot(
    history: DataFrame, snapshot: DataFrame, index_name: str, effective: Column, source: str
) -> DataFrame:
    """New symbols open a period, absent ones close the day before, the rest stay.

    All columns of the history stay; those that the snapshot also has (name, industry,
    isin and the like) are refreshed. An empty snapshot is an error: the whole index
    would close.
    """
    if snapshot.isEmpty():
        raise ValueError("an index snapshot must not be empty")
    mine = (F.col("index_name") == index_name) & (F.col("source") == source)
    is_open = mine & F.col("to_date").isNull()
    # Open rows of this index never share a symbol, so the join adds no rows.
    carried = [c for c in snapshot.columns if c in history.columns and c not in _PERIOD]
    present = last_per_key(snapshot, ["symbol"], by_values(snapshot, ["symbol"])).select(
        "symbol", F.lit(True).alias("_in"), *[F.col(c).alias(f"_new_{c}") for c in carried]
    )
    both = history.where(is_open).join(present, "symbol", "full")
    values = {
        "index_name": F.coalesce("index_name", F.lit(index_name)),
        "from_date": F.coalesce("from_date", effective),
        "to_date": F.when(F.col("_in").isNull(), F.date_sub(effective, 1)),
        "active": F.col("_in").isNotNull(),
        "source": F.coalesce("source", F.lit(source)),
        **{c: F.coalesce(f"_new_{c}", c) for c in carried},
    }
    merged = both.select(*[values.get(c, F.col(c)).alias(c) for c in history.columns])
    rest = history.where(~F.coalesce(is_open, F.lit(False)))
    return rest.unionByName(merged)


def periods_from_snapshots(
    snapshots: DataFrame, index_name: str, source: str, attributes: Sequence[str] = ()
) -> DataFrame:
    """All periods of a snapshot history in one pass (gaps and islands).

    ``snapshots``: symbol, snapshot_date and ``attributes`` (name, industry and the like), of
    which a period keeps the last one known in it.  The list of snapshot dates is bounded by
    the calendar; the rows are windowed by symbol.
    """
    rows = snapshots.groupBy("symbol", "snapshot_date").agg(
        F.lit(True).alias("_in"), *[F.max(a).alias(a) for a in attributes]
    )
    dates = rows.select("snapshot_date").distinct()
    timeline = Window.partitionBy(F.lit(0)).orderBy("snapshot_date")
    dates = dates.select(
        "snapshot_date",
        F.row_number().over(timeline).alias("_n"),
        F.lead("snapshot_date").over(timeline).alias("_next"),
    )
    w = Window.partitionBy("symbol").orderBy("snapshot_date")
    placed = rows.join(F.broadcast(dates), "snapshot_date").withColumn(
        "_island", F.col("_n") - F.row_number().over(w)
    )
    return placed.groupBy("symbol", "_island").agg(
        F.min("snapshot_date").alias("from_date"),
        F.date_sub(F.max_by("_next", "snapshot_date"), 1).alias("to_date"),
        *[
            F.max_by(a, F.when(F.col(a).isNotNull(), F.col("snapshot_date"))).alias(a)
            for a in attributes
        ],
    ).select(
        F.lit(index_name).alias("index_name"), "symbol", "from_date", "to_date",
        F.col("to_date").isNull().alias("active"), F.lit(source).alias("source"), *attributes,
    )


def replay_snapshots(
    history: DataFrame, snapshots: DataFrame, index_name: str, source: str,
    replace_existing: bool = False, attributes: Sequence[str] = (),
) -> DataFrame:
    """Periods rebuilt from dated snapshots; an existing overlap needs ``replace_existing``."""
    fresh = periods_from_snapshots(snapshots, index_name, source, attributes)
    mine = (F.col("index_name") == index_name) & (F.col("source") == source)
    if not replace_existing and not history.where(mine).isEmpty():
        raise ValueError("history exists already; pass replace_existing to rebuild it")
    others = history.where(~F.coalesce(mine, F.lit(False)))
    return others.unionByName(fresh, allowMissingColumns=True)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Symbols added and removed between two lists."""
    a, b = before.select("symbol").distinct(), after.select("symbol").distinct()
    added = b.join(a, "symbol", "left_anti").withColumn("change", F.lit("added"))
    removed = a.join(b, "symbol", "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def union_symbols(*frames: DataFrame) -> DataFrame:
    out = frames[0].select("symbol")
    for frame in frames[1:]:
        out = out.unionByName(frame.select("symbol"))
    return out.distinct()
