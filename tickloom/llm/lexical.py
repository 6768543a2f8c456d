"""Ranked lexical search over bit-sliced Bloom signatures, exact in its results.

The index has blocks of documents of like size. A block has a row of bits per hash value (a slice,
one bit per document). A document sets the slices of the keys (term, 0), (term, 1), ... up to the
logarithm of the term's occurrences there, so ANDing a key's slices shows a superset of the
documents that hold the term at least 1, 2, 4, ... times. Sums of the item's term weights over
these slices, times what each doubling of occurrences can add at the document's length, are upper
bounds of the scores. The documents with the best bounds are scored exactly, which gives the score
to beat; then all others whose bound reaches it are, from the block's exact counts. No document
that could be among the best is left out; ties are kept.

A block's vocabulary with its document counts lies in columns of its own, so the statistics of the
terms (N, L, df) come from these alone. Items are searched in batches of bounded size; each batch
is broadcast to the tasks, which read the blocks one after another and keep k results an item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import Scratch, buffer_of, plain, slices
from tickloom.llm.words import byte_class, mixed, spans, word_hashes

#: Documents, and different (document, term) pairs, of a block at most (one longer text stands alone).
DOCUMENTS, PAIRS = 8192, 1 << 19
#: Slices that a key sets, and slices per key of the block's average document.
HASHES, SPARSE = 3, 5
#: Bytes of items in a batch, about (one longer item stands alone), and best bounds that are scored first.
ITEM_BYTES, FIRST = 1 << 20, 32
#: Terms whose bits are unpacked at once, and bytes of a row group of the index: readers hold a whole one.
AT_ONCE, GROUP_BYTES = 64, 32 << 20

#: Terms are runs of [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F].
OUTSIDE = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
TERMS = byte_class(OUTSIDE)
#: A to Z count as a to z.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[ord("A") : ord("Z") + 1] += 32

INDEX = (
    "n_docs int, n_slices long, levels int, docs binary, lengths binary, slices binary, "
    "terms binary, held binary, starts binary, term binary, times binary"
)
FOUND = "item_id long, doc_id long, score long"
WEIGHT, SCORE = 1000, 1_000_000_000


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each term of each text, lower-cased, and the terms per text."""
    data, bounds = buffer_of(texts)
    data = FOLDED[data]
    starts, ends, counts = spans(data, bounds, TERMS)
    return word_hashes(data, starts, ends), counts


def level_of(times: np.ndarray) -> np.ndarray:
    """The whole part of the logarithm to base 2."""
    return np.frexp(times.astype(np.float64))[1] - 1


def slices_of(terms: np.ndarray, level: np.ndarray, n_slices: int) -> np.ndarray:
    """The slices of each key (term, level): one row per hash."""
    key = mixed(terms ^ mixed(level.astype(np.uint64) + np.uint64(1)))
    step = mixed(key + np.uint64(1)) | np.uint64(1)
    return np.stack([(key + np.uint64(i) * step >> np.uint64(20)) % np.uint64(n_slices) for i in range(HASHES)]).astype(np.int64)


class Block:
    """Some documents: ids, lengths, exact counts, and their bit slices."""

    def __init__(self, docs: np.ndarray, lengths: np.ndarray, starts: np.ndarray, hashes: np.ndarray, times: np.ndarray):
        """`docs` has int64 pairs (known, id); each document has the pairs from its start on, terms ascending."""
        self.docs, self.lengths, self.starts, self.times = docs, lengths, starts, times
        self.terms, self.term = np.unique(hashes, return_inverse=True)
        self.held = np.bincount(self.term, minlength=len(self.terms))
        levels = level_of(times)
        self.levels = int(levels.max(initial=0)) + 1
        n = len(docs)
        keys = int(levels.sum()) + len(levels)
        self.n_slices = max(64, HASHES * SPARSE * keys // max(1, n))
        self.slices = np.zeros((self.n_slices, -(-n // 8)), np.uint8)
        doc = np.repeat(np.arange(n), np.diff(starts))
        for level in range(self.levels):
            some = levels >= level
            at, bit = doc[some] // 8, (128 >> doc[some] % 8).astype(np.uint8)
            for row in slices_of(hashes[some], np.full(int(some.sum()), level), self.n_slices):
                np.bitwise_or.at(self.slices, (row, at), bit)

    def row(self) -> dict:
        return {
            "n_docs": len(self.docs), "n_slices": self.n_slices, "levels": self.levels,
            "docs": self.docs.astype("<i8").tobytes(), "lengths": self.lengths.astype("<i8").tobytes(),
            "slices": self.slices.tobytes(), "terms": self.terms.astype("<u8").tobytes(),
            "held": self.held.astype("<i4").tobytes(), "starts": self.starts.astype("<i8").tobytes(),
            "term": self.term.astype("<i4").tobytes(), "times": self.times.astype("<i4").tobytes(),
        }

    @classmethod
    def of(cls, row: dict) -> Block:
        self = cls.__new__(cls)
        self.n_slices, self.levels = row["n_slices"], row["levels"]
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.docs, self.lengths = read("docs", "<i8").reshape(-1, 2), read("lengths", "<i8")
        self.slices = read("slices", np.uint8).reshape(self.n_slices, -1)
        self.terms, self.starts = read("terms", "<u8"), read("starts", "<i8")
        self.times = read("times", "<i4").astype(np.int64)
        doc = np.repeat(np.arange(len(self.docs)), np.diff(self.starts))
        self.places = doc * max(1, len(self.terms)) + read("term", "<i4")
        return self

    def bounds(self, terms: np.ndarray, weights: np.ndarray, part: np.ndarray) -> np.ndarray:
        """An upper bound of each document's score; `part` is each document's m."""
        out = np.zeros(len(self.docs), np.int64)
        before = np.zeros(len(self.docs), np.int64)
        for level in range(self.levels):
            total = np.zeros(len(self.docs))
            rows = slices_of(terms, np.full(len(terms), level), self.n_slices)
            bits = self.slices[rows[0]]
            for row in rows[1:]:
                bits = bits & self.slices[row]
            some = bits.any(1)
            if not some.any():
                break
            bits, weight = bits[some], weights[some].astype(np.float64)
            for low in range(0, len(bits), AT_ONCE):
                shown = np.unpackbits(bits[low : low + AT_ONCE], axis=1, count=len(self.docs))
                total += weight[low : low + AT_ONCE] @ shown.astype(np.float64)
            most = saturated(np.minimum(np.int64(2 << level) - 1, self.lengths), part)
            out += total.astype(np.int64) * np.maximum(most - before, 0)
            before = np.maximum(most, before)
        return out

    def scores(self, chosen: np.ndarray, terms: np.ndarray, weights: np.ndarray, part: np.ndarray) -> np.ndarray:
        """The exact scores of the chosen documents."""
        place = np.searchsorted(self.terms, terms)
        known = place < len(self.terms)
        known[known] = self.terms[place[known]] == terms[known]
        out = np.zeros(len(chosen), np.int64)
        if not known.any():
            return out
        wanted = chosen[:, None] * len(self.terms) + place[known]
        at = np.minimum(np.searchsorted(self.places, wanted), len(self.places) - 1)
        times = np.where(self.places[at] == wanted, self.times[at], 0)
        return (weights[known] * saturated(times, part[chosen][:, None])).sum(1)


def saturated(times: np.ndarray, part: np.ndarray) -> np.ndarray:
    return SCORE * times // np.maximum(1, WEIGHT * times + 12 * part)


def index(docs: DataFrame) -> DataFrame:
    """The blocks of all rows of doc_id and text, one row each.

    A task collects documents by the logarithm (base 4) of their different terms. Texts without terms
    (null, empty, of symbols) are in no block: they have no score and no part in the statistics.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: dict[int, list] = {}
        pairs: dict[int, int] = {}
        for batch in batches:
            for part in slices([batch], "text"):
                hashes, counts = terms_of(part.column("text"))
                known = part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                ids = part.column("doc_id").fill_null(0).to_numpy()
                ends = np.cumsum(counts)
                for i in np.flatnonzero(counts).tolist():
                    terms, times = np.unique(hashes[ends[i] - counts[i] : ends[i]], return_counts=True)
                    size = len(terms).bit_length() // 2
                    if len(pending.get(size, ())) >= DOCUMENTS or pairs.get(size, 0) + len(terms) > PAIRS and pending.get(size):
                        yield _closed(pending.pop(size))
                        pairs[size] = 0
                    pending.setdefault(size, []).append(((int(known[i]), int(ids[i])), int(counts[i]), terms, times))
                    pairs[size] = pairs.get(size, 0) + len(terms)
        for held in pending.values():
            yield _closed(held)

    return plain(docs, doc_id="long", text="string").mapInArrow(run, INDEX)


def _closed(held: list) -> pa.RecordBatch:
    starts = np.append(0, np.cumsum([len(d[2]) for d in held]))
    hashes, times = (np.concatenate([d[i] for d in held]) for i in (2, 3))
    block = Block(np.array([d[0] for d in held], np.int64), np.array([d[1] for d in held], np.int64), starts, hashes, times)
    row = block.row()
    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 8]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], list(row))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: _value(batch.column(name)[i]) for name in batch.schema.names}


def _value(scalar: pa.Scalar) -> memoryview | int:
    return scalar.as_buffer() if pa.types.is_binary(scalar.type) else scalar.as_py()


def held_by(blocks: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """In how many documents each of the terms is, for those in any; the terms are bounded by a batch of items."""
    shared = blocks.sparkSession.sparkContext.broadcast(np.sort(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        total = np.zeros(len(wanted), np.int64)
        for row in _read(batches):
            own, held = np.frombuffer(row["terms"], "<u8"), np.frombuffer(row["held"], "<i4")
            at = np.searchsorted(own, wanted)
            here = at < len(own)
            here[here] = own[at[here]] == wanted[here]
            total[here] += held[at[here]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[some].view(np.int64)), pa.array(total[some])], ["term", "held"])

    found = blocks.select("terms", "held").mapInArrow(run, "term long, held long").groupBy("term").agg(F.sum("held").alias("held"))
    out = {r.term & (1 << 64) - 1: r.held for r in found.collect()}
    shared.unpersist()
    return out


class Best:
    """The best (score, doc) of one item in a task: higher scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.doc = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.append(self.score, score), np.append(self.doc, doc)
        order = np.lexsort((doc, -score))[: self.k]
        self.score, self.doc = score[order], doc[order]

    def to_beat(self) -> int:
        """Bounds below this are out; a score of 0 is never in."""
        return int(self.score[-1]) if len(self.score) == self.k else 1


def search_block(block: Block, terms: np.ndarray, weights: np.ndarray, part: np.ndarray, best: Best) -> int:
    """Adds the block's documents that are among the best; how many were scored."""
    bound = np.where(block.docs[:, 0] == 1, block.bounds(terms, weights, part), 0)

    def score(chosen: np.ndarray) -> int:
        found = block.scores(chosen, terms, weights, part)
        good = found > 0
        best.add(found[good], block.docs[chosen[good], 1])
        return len(chosen)

    near = np.flatnonzero(bound >= best.to_beat())
    if len(near) <= best.k + FIRST:
        return score(near)
    order = np.argpartition(-bound[near], best.k + FIRST)
    first, rest = near[order[: best.k + FIRST]], near[order[best.k + FIRST :]]
    return score(first) + score(rest[bound[rest] >= best.to_beat()])


def weight_of(n: int, held: int) -> int:
    return int(np.floor(1000 * np.log((2 * n + 2) / (2 * held + 1))))


def searched(blocks: DataFrame, items: list[tuple[int, np.ndarray, np.ndarray]], n: int, length: int, k: int) -> DataFrame:
    """item_id, doc_id, score: the k best of each task for a batch of items (id, terms, weights times repeats)."""
    shared = blocks.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Best(k) for _ in shared.value]
        for row in _read(batches):
            block = Block.of(row)
            part = 75 + np.array([25 * x * n // length for x in block.lengths.tolist()], np.int64)
            for (_, terms, weights), best in zip(shared.value, found, strict=True):
                search_block(block, terms, weights, part, best)
        for (item, _, _), best in zip(shared.value, found, strict=True):
            if len(best.score):
                ids = np.full(len(best.score), item, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, best.doc, best.score)], ["item_id", "doc_id", "score"])

    return blocks.mapInArrow(run, FOUND)


def batched(items: DataFrame) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    """Items of item_id and text in batches of some ITEM_BYTES: id, different terms, their repeats."""
    rows, held = [], 0
    for row in items.toLocalIterator():
        rows.append(row)
        held += len(row.text)
        if held >= ITEM_BYTES:
            yield _terms_of_items(rows)
            rows, held = [], 0
    if rows:
        yield _terms_of_items(rows)


def _terms_of_items(rows: list) -> list[tuple[int, np.ndarray, np.ndarray]]:
    hashes, counts = terms_of(pa.array([r.text for r in rows], pa.string()))
    ends = np.cumsum(counts)
    return [(r.item_id, *np.unique(hashes[e - c : e], return_counts=True)) for r, e, c in zip(rows, ends.tolist(), counts.tolist(), strict=True)]


def rank(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, scores above 0, ties to the smaller doc_id.

    `docs` has doc_id and text, `items` item_id and text; other columns go, whatever their names.
    Null, empty and termless texts score nothing, and such items have no rows. Documents without
    a doc_id count in the statistics and are not returned; each row is a document of its own, so
    a repeated doc_id may be returned repeatedly. Items without an id have no rows; the rows of an
    item_id that comes with several texts are ranked together, the best score of a document each.
    An empty table of either kind gives an empty result. Terms are known by 64-bit hashes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    blocks = scratch.stored("blocks", index(docs), **{"parquet.block.size": GROUP_BYTES})
    lengths = blocks.select("n_docs", F.col("lengths")).mapInArrow(_totals, "n long, l long").agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    n, length = lengths.n or 0, lengths.l or 0
    asked = plain(items, item_id="long", text="string").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    found = spark.createDataFrame([], FOUND)
    for number, batch in enumerate(batched(asked) if n else ()):
        held = held_by(blocks, np.unique(np.concatenate([t for _, t, _ in batch])))
        weighed = [
            (item, terms, repeats * np.array([weight_of(n, held.get(t, 0)) for t in terms.tolist()], np.int64))
            for item, terms, repeats in batch
        ]
        found = found.unionByName(scratch.stored(f"found-{number}", searched(blocks, weighed, n, length, k)))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("item_id", "rank", "doc_id", "score")
    )


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = length = 0
    for row in _read(batches):
        n += row["n_docs"]
        length += int(np.frombuffer(row["lengths"], "<i8").sum())
    yield pa.RecordBatch.from_pydict({"n": [n], "l": [length]})


_TERMS = """unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term"""

SQL = f"""
WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
words AS (SELECT r, {_TERMS} FROM numbered),
counted AS (SELECT r, term, count(*) AS tf FROM words GROUP BY r, term),
sizes AS (SELECT r, doc_id, n FROM (SELECT r, sum(tf)::BIGINT AS n FROM counted GROUP BY r) JOIN numbered USING (r)),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM sizes),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counted, whole GROUP BY term),
asked AS (
  SELECT item_id, term, count(*) AS c FROM (SELECT item_id, {_TERMS} FROM benchmark) GROUP BY item_id, term),
scored AS (
  SELECT item_id, r, doc_id,
    CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN counted USING (term) JOIN sizes USING (r), whole
  GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""
