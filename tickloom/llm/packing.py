"""Best-fit packing of token pieces into sequences by bin completion.

Only lengths matter for which pieces share a sequence, and there are at most `capacity` of them.
So Spark counts pieces per length, the driver plans on that histogram, and every piece finds its
place by its rank among the pieces of its length.

The plan is a branch-and-bound search. Around the largest remaining length, fillings of the rest
are enumerated (maximal ones, fullest first); a branch is cut once its waste leaves no solution
with fewer sequences than the best known, which at first is the best-fit one. Searches over ever
fuller fillings come first, then ones over all fillings that none dominates.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import Scratch, buffer_of, plain, slices
from tickloom.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rows that are ranked together in one task.
RANKED_TOGETHER = 1_000
#: Steps of one enumeration of fillings; the search is made with each, and the best plan stays.
#: (Short ones leave small pieces for later, long ones waste least at once.)
FILL_STEPS = (20, 50, 100, 200, 500, 2_000)
#: The same for searches that also try fillings as full as others, or less.
WIDE_STEPS = (30, 200)
#: Steps of each search, besides one for each sequence on the way down.
SEARCH_STEPS = 3_000


def cut_pieces(docs: DataFrame, file: str, mark: str, end: int, capacity: int) -> DataFrame:
    """A row per piece. Documents over `capacity` ids are cut; the first piece may be shorter.

    A null or empty text is the end id alone. Repeated rows are packed each on its own.
    """

    def cut(batches):
        ids_of = encoder(file, mark)
        for batch in slices(batches, "text"):
            ids, bounds = ids_of.encode(*buffer_of(batch.column("text")), end)
            data = memoryview(ids.astype("<u4").tobytes())
            out: list[list] = [[], [], [], [], []]
            for doc, low, high in zip(batch.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                first = (high - low - 1) % capacity + 1
                edges = [low, *range(low + first, high + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    for column, value in zip(out, (doc, k, a - low, b - a, zlib.crc32(data[4 * a : 4 * b])), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return plain(docs, doc_id="long", text="string").mapInArrow(cut, PIECES)


# --- the plan: a list of (filling, times), a filling being lengths in descending order ---


def fillings(sizes: list[int], left: dict[int, int], room: int, steps: int) -> Iterator[tuple[int, ...]]:
    """Maximal fillings of `room`, each with the largest length first, better ones later.

    The first is the best-fit one; each later one is fuller than all before. Stops at a full one
    or after `steps`.
    """
    best, taken, used = -1, [], Counter()

    def go(rest: int, top: int) -> Iterator[tuple[int, ...]]:
        nonlocal best, steps
        i = bisect_right(sizes, min(rest, top)) - 1
        closed = True
        while i >= 0 and steps > 0:
            size = sizes[i]
            if rest < size or left[size] <= used[size]:
                i -= 1
                continue
            closed = False
            steps -= 1
            taken.append(size)
            used[size] += 1
            yield from go(rest - size, size)
            used[size] -= 1
            taken.pop()
            if best == room:
                return
            i -= 1
            if i >= 0 and size * (rest // size) < rest and room - rest + _most(sizes, i, left, used, rest) <= best:
                return
        if closed and room - rest > best:
            best = room - rest
            yield tuple(taken)

    yield from go(room, room)


def _most(sizes: list[int], i: int, left: dict[int, int], used: Counter, rest: int) -> int:
    """No filling of `rest` by the lengths up to place i holds more than this."""
    total = 0
    for j in range(i, -1, -1):
        total += sizes[j] * (left[sizes[j]] - used[sizes[j]])
        if total >= rest:
            return rest
    return total


def undominated(sizes: list[int], left: dict[int, int], room: int, steps: int) -> list[tuple[int, ...]]:
    """Maximal fillings of `room` found in so many steps, but for dominated ones, fullest last."""
    found, taken, used = {}, [], Counter()

    def go(rest: int, top: int) -> None:
        nonlocal steps
        i = bisect_right(sizes, rest) - 1
        while i >= 0 and left[sizes[i]] <= used[sizes[i]]:
            i -= 1
        if i < 0:
            found[tuple(taken)] = None
            return
        for k in range(bisect_right(sizes, min(rest, top)) - 1, -1, -1):
            size = sizes[k]
            if steps <= 0:
                return
            if left[size] > used[size]:
                steps -= 1
                taken.append(size)
                used[size] += 1
                go(rest - size, size)
                used[size] -= 1
                taken.pop()

    go(room, room)
    out = sorted(reversed(found), key=sum)
    return [f for k, f in enumerate(out) if not any(_dominates(g, f) for g in out[k + 1 :])]


def _dominates(one: tuple[int, ...], other: tuple[int, ...]) -> bool:
    """Whether the other's pieces (descending), each put where it fits best, lie in places of the one's."""
    rooms = sorted(one)
    for size in other:
        k = bisect_left(rooms, size)
        if k == len(rooms):
            return False
        insort(rooms, rooms.pop(k) - size)
    return True


def _times(filling: tuple[int, ...], left: dict[int, int]) -> int:
    return min(left[size] // n for size, n in Counter(filling).items())


class Shelf:
    """The lengths that remain, ascending, and how many of each."""

    def __init__(self, counts: dict[int, int]):
        self.left = {s: n for s, n in counts.items() if n}
        self.sizes = sorted(self.left)

    def take(self, filling: tuple[int, ...], times: int) -> None:
        for size in filling:
            self.left[size] -= times
        if any(not self.left[s] for s in filling):
            self.sizes = [s for s in self.sizes if self.left[s]]

    def put(self, filling: tuple[int, ...], times: int) -> None:
        if any(not self.left[s] for s in filling):
            back = {s for s in filling if not self.left[s]}
            self.sizes = sorted({*self.sizes, *back})
        for size in filling:
            self.left[size] += times

    def choices(self, capacity: int, steps: int, wide: bool = False) -> list[tuple[tuple[int, ...], int]]:
        """Sequences around the largest length, the fullest first, and how often each can be had."""
        largest = self.sizes[-1]
        self.left[largest] -= 1
        room = capacity - largest
        rests = undominated(self.sizes, self.left, room, steps) if wide else []
        found = [(largest, *f) for f in rests or fillings(self.sizes, self.left, room, steps)]
        self.left[largest] += 1
        out = []
        for filling in reversed(found):
            times = _times(filling, self.left)
            out += [(filling, times)] + ([(filling, 1)] if times > 1 else [])
        return out


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: by total length, and by pieces of which no two fit together."""
    by_total = -(-sum(s * n for s, n in counts.items()) // capacity)
    return max(by_total, sum(n for s, n in counts.items() if 2 * s > capacity))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Always the largest length that still fits."""
    shelf, out = Shelf(counts), []
    while shelf.sizes:
        largest = shelf.sizes[-1]
        shelf.left[largest] -= 1
        rest = next(fillings(shelf.sizes, shelf.left, capacity - largest, capacity), ())
        shelf.left[largest] += 1
        out.append(((largest, *rest), _times((largest, *rest), shelf.left)))
        shelf.take(*out[-1])
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fillings and how often each is used; together they use up `counts`."""
    best, need = best_fit(counts, capacity), lower_bound(counts, capacity)
    for fill_steps, wide in [*((n, False) for n in FILL_STEPS), *((n, True) for n in WIDE_STEPS)]:
        if sum(n for _, n in best) > need:
            best = _search(counts, capacity, best, need, fill_steps, wide)
    return best


def _search(counts: dict[int, int], capacity: int, best: list, need: int, fill_steps: int, wide: bool) -> list:
    """A plan with fewer sequences than `best`, if the search comes upon one."""
    total, fewest = sum(s * n for s, n in counts.items()), sum(n for _, n in best)
    search_steps = SEARCH_STEPS
    shelf, path, waste = Shelf(counts), [], 0
    levels = [iter(shelf.choices(capacity, fill_steps, wide))] if shelf.sizes else []
    while levels and fewest > need and search_steps > 0:
        choice = next(levels[-1], None)
        search_steps -= choice is None
        if choice is None:
            levels.pop()
            if path:
                filling, times = path.pop()
                shelf.put(filling, times)
                waste -= (capacity - sum(filling)) * times
            continue
        filling, times = choice
        more = (capacity - sum(filling)) * times
        if waste + more > (fewest - 1) * capacity - total:
            continue
        shelf.take(filling, times)
        path.append(choice)
        waste += more
        if shelf.sizes:
            levels.append(iter(shelf.choices(capacity, fill_steps, wide)))
        else:
            best, fewest = list(path), sum(n for _, n in path)
            levels.append(iter(()))
    return best


def places(best: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, ranks, first sequence, pieces per sequence, offset)."""
    out, rank, sequence = [], Counter(), 0
    for filling, times in best:
        offset = 0
        for size, n in sorted(Counter(filling).items(), reverse=True):
            out.append((size, rank[size], n * times, sequence, n, offset))
            rank[size] += n * times
            offset += size * n
        sequence += times
    return out


def pack(docs: DataFrame, file: str, mark: str, end: int = 2, capacity: int = 1024) -> DataFrame:
    """Every piece with its sequence and its place there.

    The histogram and the plan have at most `capacity` lengths (each use of a filling takes it
    as often as it can be had, so lengths run out one after another); only they reach the driver
    or are broadcast. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    rows = scratch.stored("pieces", cut_pieces(docs, file, mark, end, capacity))
    counts = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    spot = spark.createDataFrame(
        places(plan(counts, capacity)),
        "length long, first_rank long, ranks long, first_sequence long, each long, base long",
    )
    split = spark.createDataFrame(
        [(s, -(-n // RANKED_TOGETHER)) for s, n in counts.items()], "length long, buckets long"
    )
    dealt = rows.join(F.broadcast(split), "length").withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.col("buckets"))
    )
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
        .withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .select("length", "bucket", "skip")
    )
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        dealt.withColumn("within", F.row_number().over(inside) - 1)
        .join(firsts, ["length", "bucket"])
        .withColumn("rank", F.col("skip") + F.col("within"))
    )
    step = F.col("rank") - F.col("first_rank")
    found = ranked.join(F.broadcast(spot), "length").where((step >= 0) & (step < F.col("ranks")))
    return found.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + step % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )
