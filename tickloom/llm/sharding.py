"""Contiguous shards of near equal bytes by global prefix sums.

Documents are laid out by group (equal texts) in the order of a hash of the text. Totals per
partition of that order give every partition's start in the global prefix sum, running sums
inside a partition give every group's start, and cuts at equal targets make the shards. A group
lies in one shard: those with a noticeable part of a shard's bytes (of which there can be only
few) are placed first, each where least lies, and the rest is cut at what each shard still lacks.
Only groups larger than a shard's share (fewer than shards) are spread, row by row.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import Scratch

#: Units over this part of a shard's bytes are placed by hand; the driver holds fewer than shards / HEAVY.
HEAVY = 0.002
#: Groups (or rows) that one partition of the layout holds, about.
TOGETHER = 50_000


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1; null: 1), text_crc32 and grp (a hash of the text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("grp"),
    )


def place_heavy(groups: list[tuple[int, int]], shards: int) -> tuple[dict[int, int], list[int]]:
    """Largest first, each into the shard with least: shard per group, bytes per shard."""
    heap = [(0, s) for s in range(shards)]
    placed, load = {}, [0] * shards
    for group, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        held, shard = heapq.heappop(heap)
        placed[group], load[shard] = shard, held + size
        heapq.heappush(heap, (held + size, shard))
    return placed, load


def lacking(load: list[int], rest: int) -> list[float]:
    """What each shard gets of `rest` so that all end level, or as level as can be."""
    level, order = 0.0, sorted(load)
    for n in range(len(order), 0, -1):
        level = (rest + sum(order[:n])) / n
        if level >= order[n - 1]:
            break
    return [max(0.0, level - held) for held in load]


def _partition(key: str, n: int):
    """The partition, of n, in the order of a hash key."""
    return F.floor((F.col(key).cast("double") / 2.0**64 + 0.5) * n).cast("int")


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot (gapless from 0) and grown_shard (null).

    A null text counts as an empty one. Rows with a null doc_id and repeated rows are placed like
    others. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    rows = scratch.stored("rows", sized(docs))
    groups = rows.groupBy("grp").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    share = total / shards
    spread = [r.grp for r in groups.where((F.col("bytes") > share) & (F.col("n") > 1)).collect()]

    # a unit lies in one shard: a group, or a row of a group that is spread
    unit = F.when(F.col("grp").isin(spread), F.xxhash64("grp", "doc_id")).otherwise(F.col("grp"))
    rows = rows.withColumn("unit", unit)
    units = scratch.stored("units", rows.groupBy("unit").agg(F.sum("size").alias("bytes")))
    n_units, heavy = units.count(), units.where(F.col("bytes") > HEAVY * share).collect()
    placed, load = place_heavy([(r.unit, r.bytes) for r in heavy], shards)
    by_hand = spark.createDataFrame([(g, s) for g, s in placed.items()], "unit long, hand int")
    units = units.where(F.col("bytes") <= HEAVY * share)
    parts = max(1, n_units // TOGETHER)
    units = units.withColumn("part", _partition("unit", parts))
    totals = {r.part: r.n for r in units.groupBy("part").agg(F.sum("bytes").alias("n")).collect()}
    before, at = [], 0
    for part in sorted(totals):
        before.append((part, at))
        at += totals[part]
    cuts, edge = [], 0.0
    for lack in lacking(load, at):
        edge += lack
        cuts.append(edge)
    running = Window.partitionBy("part").orderBy("unit").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("start") + F.sum("bytes").over(running) - F.col("bytes") / 2
    found = F.lit(0)
    for cut in cuts[:-1]:
        found = found + (F.col("middle") > cut).cast("int")
    starts = spark.createDataFrame(before, "part int, start long")
    laid = (
        units.join(F.broadcast(starts), "part").withColumn("middle", middle)
        .select("unit", found.alias("laid"))
    )
    known = rows.join(F.broadcast(by_hand), "unit", "left")
    out = known.where("hand is not null").select("doc_id", "size", "text_crc32", F.col("hand").alias("shard")).unionByName(
        known.where("hand is null").drop("hand").join(laid, "unit")
        .select("doc_id", "size", "text_crc32", F.col("laid").alias("shard"))
    )
    return _slots(scratch.stored("sharded", out), scratch)


def _slots(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """A gapless number per shard: running numbers in parts of a shard, after the parts before."""
    counts = {r.shard: r.n for r in rows.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    spark = rows.sparkSession
    split = spark.createDataFrame([(s, -(-n // TOGETHER)) for s, n in counts.items()], "shard int, parts int")
    dealt = rows.join(F.broadcast(split), "shard").withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("parts"))
    )
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
        .select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skip"))
    )
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")
    return (
        dealt.withColumn("within", F.row_number().over(inside) - 1).join(firsts, ["shard", "part"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("skip") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
