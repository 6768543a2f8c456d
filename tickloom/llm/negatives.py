"""Hard negatives: exact integer scores by Strassen's multiplication, kept in mergeable heaps.

Anchors and candidates lie in blocks. A task multiplies tiles of one block of anchors with one
block of candidates, halving both factors of each product in every direction and taking seven
products of halves for eight (odd sides are padded with zeros). All is int64 and wraps as int64
does, so the order of additions does not matter and a score is exact modulo 2**64.

Two passes. The first multiplies rows of one label and keeps the best positives of each anchor in
a heap; heaps of tiles merge, first in the task, then across blocks. The second multiplies anchors
with all rows and keeps, for each anchor and positive, a heap of the best scores in the window
that the positive's score sets.

Every anchor meets every candidate: a stated query set against all rows, in blocks. A candidate is
copied once per block of anchors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import Scratch

#: Rows of a block of anchors and of a block of candidates, and anchors in one tile.
ANCHORS, CANDIDATES, TILE = 2048, 16_384, 128
#: Bytes of scores in a tile, about; wide blocks are cut.
TILE_BYTES = 8 << 20
#: Products with a side of at most this are multiplied directly.
LEAF = 16


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b for int64 by Strassen's seven products; sides are padded to even ones with zeros."""
    m, k, n = *a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return a @ np.asfortranarray(b)
    a = np.pad(a, ((0, m & 1), (0, k & 1)))
    b = np.pad(b, ((0, k & 1), (0, n & 1)))
    i, j, h = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :h], b[:j, h:], b[j:, :h], b[j:, h:]
    out = np.empty((2 * i, 2 * h), np.int64)
    c11, c12, c21, c22 = out[:i, :h], out[:i, h:], out[i:, :h], out[i:, h:]
    p = product(a11 + a22, b11 + b22)
    c11[:], c22[:] = p, p
    p = product(a21 + a22, b11)
    c21[:] = p
    c22 -= p
    p = product(a11, b12 - b22)
    c12[:] = p
    c22 += p
    p = product(a22, b21 - b11)
    c11 += p
    c21 += p
    p = product(a11 + a12, b22)
    c11 -= p
    c12 += p
    c22 += product(a21 - a11, b11 + b12)
    c11 += product(a12 - a22, b21 + b22)
    return out[:m, :n]


class Heaps:
    """For each of some rows the k best (score, id): higher scores first, then smaller ids.

    Heaps over the same rows merge, in any order, to the heap of all they have seen.
    """

    def __init__(self, rows: int, k: int):
        self.k = k
        self.score = np.empty((rows, 0), np.int64)
        self.ids = np.empty((rows, 0), np.int64)
        self.full = np.empty((rows, 0), bool)

    def add(self, score: np.ndarray, ids: np.ndarray, full: np.ndarray) -> None:
        """More entries of each row; those that are not `full` do not count."""
        score = np.hstack([self.score, score])
        ids, full = np.hstack([self.ids, ids]), np.hstack([self.full, full])
        order = np.lexsort((ids, ~score, ~full), axis=1)[:, : self.k]
        self.score, self.ids, self.full = (np.take_along_axis(x, order, 1) for x in (score, ids, full))

    def merge(self, other: Heaps) -> None:
        self.add(other.score, other.ids, other.full)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, id and score of all entries."""
        row, place = np.nonzero(self.full)
        return row, self.ids[row, place], self.score[row, place]


def highest(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the k highest allowed scores of each row, ties to the smaller column, and which of the k exist."""
    k = min(k, score.shape[1])
    least = np.iinfo(np.int64).min
    held = np.where(allowed, score, least)
    edge = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k]
    above = allowed & (held > edge[:, None])
    ties = allowed & (held == edge[:, None])
    room = k - above.sum(1)
    spare = ties.sum(1) > room
    if spare.any():
        part = ties[spare]
        ties[spare] = part & (np.cumsum(part, axis=1, dtype=np.int32) <= room[spare][:, None])
    chosen = above | ties
    row, column = np.nonzero(chosen)
    count = chosen.sum(1)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    columns, full = np.zeros((len(score), k), np.int64), np.zeros((len(score), k), bool)
    columns[row, place], full[row, place] = column, True
    return columns, full


def kept(score: np.ndarray, allowed: np.ndarray, ids: np.ndarray, heaps: Heaps) -> None:
    """The tile's best go to the heaps; columns are in ascending order of ids."""
    columns, full = highest(score, allowed, heaps.k)
    heaps.add(np.take_along_axis(score, columns, 1), ids[columns], full)


def score_window(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score with 30 * positive <= 100 * score <= 90 * positive, without overflow."""
    tens, rest = positive // 10, positive % 10
    return 3 * tens + -(-3 * rest // 10), 9 * tens + 9 * rest // 10


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and q (integers) of the rows that take part, one per vec_id.

    Rows without a vec_id, label or vector, or with a null or non-finite component, take no part.
    Of rows that share a vec_id the one with the smallest (label, vector) does. Where 7 divides
    vec_id the label moves on by one in 0 to 9. A component x is floor(256 * x), at the ends of
    int64 where it would be beyond.
    """
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v")
    ).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    once = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    next_label = ((F.col("r.label").cast("decimal(20,0)") + 1) % 10).cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, next_label).otherwise(F.col("r.label"))
    whole = F.transform("r.v", lambda x: F.floor(x * F.lit(256.0)).cast("bigint"))
    return once.select("vec_id", moved.alias("label"), whole.alias("q"))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones padded with zeros to `width`."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.empty(0, np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


class Side:
    """Rows of one side of a product by id, or by label, then id."""

    def __init__(self, table: pa.Table, width: int, by_label: bool):
        labels = table["label"].to_numpy() if by_label else np.zeros(len(table), np.int64)
        self.order = order = np.lexsort((table["vec_id"].to_numpy(), labels))
        self.ids, self.labels = table["vec_id"].to_numpy()[order], table["label"].to_numpy()[order]
        self.q = matrix(table["q"], width)[order]

    def of_label(self, label: int) -> slice:
        return slice(int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right")))


def tiles(a: np.ndarray, b: np.ndarray):
    """(rows, columns, scores) of all pairs, a bounded tile at a time."""
    wide = max(LEAF, TILE_BYTES // (8 * TILE))
    for low in range(0, len(a), TILE):
        for left in range(0, len(b), wide):
            rows, columns = slice(low, low + TILE), slice(left, left + wide)
            yield rows, columns, product(a[rows], np.ascontiguousarray(b[columns].T))


def _width(table: pa.Table) -> int:
    sizes = [np.diff(c.offsets.to_numpy()).max(initial=0) for c in table["q"].chunks if len(c)]
    return int(max(sizes, default=0))


def _met(rows: DataFrame, asked: DataFrame, columns: list[str], n: int, anchors: int) -> DataFrame:
    """Both sides, each row in every pair of blocks that needs it, ready to be grouped by (block, part)."""
    blocks, parts = max(1, -(-n // CANDIDATES)), max(1, -(-anchors // ANCHORS))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    part = F.pmod(F.xxhash64(F.col("vec_id") + 1), F.lit(parts))
    everywhere = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    empty = [F.lit(None).cast("array<bigint>").alias(c) for c in columns]
    data = rows.select(block.alias("block"), everywhere(parts).alias("part"), F.lit(False).alias("asks"), "vec_id", "label", "q", *empty)
    asks = asked.select(everywhere(blocks).alias("block"), part.alias("part"), F.lit(True).alias("asks"), "vec_id", "label", "q", *columns)
    return data.unionByName(asks)


def _sides(table: pa.Table, by_label: bool) -> tuple[pa.Table, Side, Side]:
    asked, width = table.filter(table["asks"]), _width(table)
    return asked, Side(asked, width, by_label), Side(table.filter(pc.invert(table["asks"])), width, by_label)


def _table(schema: list[str], columns: list[list[np.ndarray]]) -> pa.Table:
    whole = [np.concatenate(c) if c else np.empty(0, np.int64) for c in columns]
    return pa.table([pa.array(c.astype(np.int64)) for c in whole], schema)


def positives(rows: DataFrame, asked: DataFrame, n: int, anchors: int, k: int) -> DataFrame:
    """vec_id and its positives (arrays p and p_score, best first): the k best other rows of its label."""

    def run(table: pa.Table) -> pa.Table:
        _, left, right = _sides(table, True)
        out: list[list[np.ndarray]] = [[], [], []]
        for label in np.unique(left.labels).tolist():
            mine, theirs = left.of_label(label), right.of_label(label)
            ids, others = left.ids[mine], right.ids[theirs]
            heaps = {}
            for here, there, score in tiles(left.q[mine], right.q[theirs]):
                heap = heaps.setdefault(here.start, Heaps(len(score), k))
                kept(score, others[there] != ids[here][:, None], others[there], heap)
            for start, heap in heaps.items():
                row, found, score = heap.entries()
                for column, values in zip(out, (ids[start + row], found, score), strict=True):
                    column.append(values)
        return _table(["vec_id", "p", "p_score"], out)

    found = _met(rows, asked, [], n, anchors).groupBy("block", "part").applyInArrow(run, "vec_id long, p long, p_score long")
    best = Window.partitionBy("vec_id").orderBy(F.desc("p_score"), "p")
    top = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    lists = top.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("place", "p", "p_score"))).alias("t"))
    return lists.select("vec_id", F.col("t.p").alias("p"), F.col("t.p_score").alias("p_score"))


def negatives(rows: DataFrame, asked: DataFrame, n: int, anchors: int, k: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores, given the anchors' positives."""

    def run(table: pa.Table) -> pa.Table:
        asked, left, right = _sides(table, False)
        sizes = asked["p"].combine_chunks().value_lengths().fill_null(0).to_numpy(zero_copy_only=False)[left.order]
        most = int(sizes.max(initial=0))
        p = matrix(asked["p"], most)[left.order] if most else np.zeros((len(left.ids), 0), np.int64)
        p_score = matrix(asked["p_score"], most)[left.order] if most else p
        heaps: dict[tuple[int, int], Heaps] = {}
        for here, there, score in tiles(left.q, right.q):
            other = right.labels[there] != left.labels[here][:, None]
            for j in range(most):
                low, high = (x[:, None] for x in score_window(p_score[here, j]))
                heap = heaps.setdefault((here.start, j), Heaps(len(score), k))
                allowed = other & (score >= low) & (score <= high) & (sizes[here] > j)[:, None]
                kept(score, allowed, right.ids[there], heap)
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for (start, j), heap in heaps.items():
            row, found, score = heap.entries()
            values = (left.ids[start + row], p[start + row, j], found, p_score[start + row, j], score)
            for column, part in zip(out, values, strict=True):
                column.append(part)
        return _table(["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"], out)

    kind = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    found = _met(rows, asked, ["p", "p_score"], n, anchors).groupBy("block", "part").applyInArrow(run, kind)
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def mine(vectors: DataFrame, every: int, positive: int = 5, negative: int = 10) -> DataFrame:
    """The hardest negatives of each vec_id that `every` divides, for each of its positives.

    Columns anchor_id, positive_id, rank, negative_id, positive_score, negative_score; see usable()
    for rows with nulls and repeated ids. Shorter vectors count as padded with zeros, empty ones
    score 0. A positive with a score below 0 has an empty window. Anchors without positives or
    negatives give no row, nor does an empty table. Ties go to the smaller vec_id. Other columns
    go, whatever their names. Scores wrap as 64-bit integers.
    """
    scratch = Scratch(vectors.sparkSession, "negatives")
    rows = scratch.stored("vectors", usable(vectors))
    anchor = F.col("vec_id") % every == 0
    counts = rows.agg(F.count("*").alias("n"), F.count_if(anchor).alias("asked")).first()
    asked = rows.where(anchor)
    near = scratch.stored("positives", positives(rows, asked, counts.n, counts.asked, positive))
    return negatives(rows, asked.join(near, "vec_id"), counts.n, counts.asked, negative)


SQL = """
WITH rows AS (
  SELECT vec_id, min(struct_pack(label := label::BIGINT, v := embedding::DOUBLE[])) AS r FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (r.label + 1) % 10 ELSE r.label END AS label,
    list_transform(r.v, lambda x: CAST(floor(256 * x) AS BIGINT)) AS q
  FROM rows),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM whole a JOIN whole b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
