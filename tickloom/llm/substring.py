"""Removal of passages that occur more than once, by Rabin-Karp hashes of every word window.

Every window of 35 words is hashed and counted. A task hashes the texts of a batch, keeps each
hash once with the place of its first window (places that repeat inside the batch are known at
once), and sends the hashes in one packed row per counting group. So a passage that fills a
third of the corpus still counts once per batch, and no group grows with it. A counting group
finds the hashes that came from two batches or more and returns their places; the places of a
batch are merged into maximal intervals, and the intervals meet their documents.

A group is a range of hashes. Groups grow in number with the texts, batches do not grow, so beyond
1,024 groups the rows of a batch go to 1,024 coarse ranges first; a task then takes a coarse range
as a stream, some millions of windows at a time, and deals these into the groups inside it. So a
batch never makes more than 1,024 rows, and rows stay long however many groups there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tickloom.llm.common import buffer_of, slices, text_bytes
from tickloom.llm.words import SPACED, mixed, spans, window_hashes, windows_inside, word_hashes

WINDOW = 35
#: Bytes of text per counting group, about; a group's hashes are held in one task.
GROUP_BYTES = 8 << 20
#: Rows that a batch makes at most, and windows that are dealt anew at once.
COARSE, DEALT = 1024, 1 << 21

#: Windows of one batch (`batch`, `gaps`), or of several (`owners`, `places`: one per window).
PACKED = "grp long, batch long, hashes binary, gaps binary, owners binary, places binary, directory binary, known binary"
KINDS = (pa.int64(), pa.int64(), *[pa.binary()] * 6)
PLACES = "batch long, places binary, directory binary, known binary"
SPANS = "doc_id long, hash long, n_words long, first array<int>, last array<int>"


def _pack_gaps(places: np.ndarray) -> bytes:
    """Increasing places as differences, byte plane by byte plane (the high ones compress away)."""
    gaps = np.diff(places, prepend=0).astype("<u4")
    return gaps.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack_gaps(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


def _directory(batch: pa.RecordBatch, counts: np.ndarray) -> bytes:
    table = pa.table({"doc_id": batch.column("doc_id"), "hash": batch.column("hash"), "n_words": pa.array(counts, pa.int64())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def group_of(hashes: np.ndarray, groups: int) -> np.ndarray:
    """The range of each hash, of as many equal ones as there are groups (below 2**31)."""
    return ((hashes >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


def home_of(batch: int, groups: int) -> int:
    """The group whose row carries what a batch's intervals need."""
    return int(group_of(mixed(np.array([batch], np.uint64)), groups)[0])


def _rows(rows: list[dict]) -> pa.RecordBatch:
    names = [c.split()[0] for c in PACKED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, KINDS, strict=True)], names)


def _windows(docs: DataFrame, width: int, groups: int) -> DataFrame:
    """Packed rows: each batch's different window hashes, split by group.

    A batch is named by its partition and number, so that one computed again keeps its name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(slices(batches, "text")):
            data, bounds = buffer_of(batch.column("text"))
            starts, ends, counts = spans(data, bounds, SPACED)
            hashes = window_hashes(word_hashes(data, starts, ends), width)
            places = np.flatnonzero(windows_inside(counts, width)[: len(hashes)])
            hashes = hashes[places]
            order = np.argsort(hashes, kind="stable")
            ranked = hashes[order]
            new = np.ones(len(ranked), bool)
            new[1:] = ranked[1:] != ranked[:-1]
            again = ~new
            again[:-1] |= ~new[1:]
            known = np.sort(places[order[again]])
            once = np.sort(order[new])
            hashes, places = hashes[once], places[once]
            group = group_of(hashes, groups)
            order = np.argsort(group, kind="stable")
            edges = np.searchsorted(group[order], np.arange(groups + 1))
            key = part << 32 | number
            home = home_of(key, groups)
            rows = []
            for g in np.flatnonzero((np.diff(edges) > 0) | (np.arange(groups) == home)).tolist():
                own = order[edges[g] : edges[g + 1]]
                rows.append({"grp": g, "batch": key, "hashes": hashes[own].tobytes(), "gaps": _pack_gaps(places[own])})
                if g == home:
                    rows[-1] |= {"directory": _directory(batch, counts), "known": _pack_gaps(known)}
            yield _rows(rows)

    return docs.mapInArrow(run, PACKED)


def _content(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, batch and place of each window of a packed row."""
    hashes = np.frombuffer(row["hashes"], np.uint64)
    if row["owners"] is not None:
        return hashes, np.frombuffer(row["owners"], np.int64), np.frombuffer(row["places"], "<u4").astype(np.int64)
    return hashes, np.full(len(hashes), row["batch"], np.int64), _unpack_gaps(row["gaps"])


def _finer(groups: int):
    """Rows of coarse ranges dealt into the groups inside them, a bounded number of windows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def dealt() -> pa.RecordBatch:
            hashes, owners, places = (np.concatenate(x) for x in zip(*held, strict=True))
            group = group_of(hashes, groups)
            order = np.lexsort((places, owners, group))
            found, first = np.unique(group[order], return_index=True)
            cuts = np.append(first, len(order))
            return _rows([
                {
                    "grp": g, "hashes": hashes[own].tobytes(), "owners": owners[own].tobytes(),
                    "places": places[own].astype("<u4").tobytes(),
                }
                for g, a, b in zip(found.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)
                for own in [order[a:b]]
            ])

        for batch in batches:
            for row in batch.to_pylist():
                if row["directory"] is not None:
                    empty = {"hashes": b"", "gaps": b""}
                    yield _rows([row | empty | {"grp": home_of(row["batch"], groups)}])
                content = _content(row)
                held.append(content)
                n += len(content[0])
                if n >= DEALT:
                    yield dealt()
                    held, n = [], 0
        if n:
            yield dealt()

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Of one group: per batch, the places whose hash also came from another batch."""
    rows = table.to_pylist()
    flat, owners, places = (np.concatenate(x) for x in zip(*map(_content, rows), strict=True))
    order = np.argsort(flat)
    ranked = flat[order]
    same = np.zeros(len(flat), bool)
    if len(flat) > 1:
        equal = ranked[1:] == ranked[:-1]
        same[order[1:][equal]] = True
        same[order[:-1][equal]] = True
    owners, places = owners[same], places[same]
    order = np.lexsort((places, owners))
    owners, places = owners[order], places[order]
    found, first = np.unique(owners, return_index=True)
    cuts = np.append(first, len(owners))
    home = [r for r in rows if r["directory"] is not None]
    packed = [_pack_gaps(places[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return pa.table({
        "batch": pa.array([*found.tolist(), *(r["batch"] for r in home)], pa.int64()),
        "places": pa.array([*packed, *[None] * len(home)], pa.binary()),
        "directory": pa.array([*[None] * len(packed), *(r["directory"] for r in home)], pa.binary()),
        "known": pa.array([*[None] * len(packed), *(r["known"] for r in home)], pa.binary()),
    })


def _intervals(width: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one batch: per document, the maximal intervals of words to remove."""
        (home,) = [i for i, x in enumerate(table["directory"].to_pylist()) if x is not None]
        directory = pa.ipc.open_stream(table["directory"][home].as_py()).read_all()
        counts = directory["n_words"].to_numpy()
        edges = np.append(0, np.cumsum(counts))
        parts = [x for x in (*table["places"].to_pylist(), table["known"][home].as_py()) if x]
        starts = np.unique(np.concatenate([np.empty(0, np.int64), *map(_unpack_gaps, parts)]))
        first, last = merged(starts, width, edges)
        doc = np.searchsorted(edges, first, "right") - 1
        cuts = np.searchsorted(doc, np.arange(len(counts) + 1))
        kind = pa.list_(pa.int32())
        shift = edges[doc]
        return pa.table({
            "doc_id": directory["doc_id"], "hash": directory["hash"], "n_words": directory["n_words"],
            "first": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(first - shift, pa.int32())).cast(kind),
            "last": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(last - shift, pa.int32())).cast(kind),
        })

    return run


def merged(starts: np.ndarray, width: int, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows at increasing starts as intervals [first, last) that neither touch nor overlap.

    Windows of different texts (between `edges`) stay apart.
    """
    if not len(starts):
        return starts, starts
    doc = np.searchsorted(edges, starts, "right")
    apart = (np.diff(starts) > width) | (np.diff(doc) > 0)
    return starts[np.append(True, apart)], starts[np.append(apart, True)] + width


def repeated_spans(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """Per different (doc_id, text): number of words and the intervals of repeated windows.

    `docs` has doc_id, text and hash, and must be a table or file scan, whose rows come in the
    same order whenever they are read.
    """
    groups = max(1, -(-text_bytes(docs) // GROUP_BYTES))
    rows = _windows(docs, width, min(groups, COARSE))
    if groups > COARSE:
        rows = rows.repartition(COARSE, "grp").mapInArrow(_finer(groups), PACKED)
    places = rows.groupBy("grp").applyInArrow(_repeated, PLACES)
    found = places.groupBy("batch").applyInArrow(_intervals(width), SPANS)
    return found.dropDuplicates(["doc_id", "hash"])


def kept_words(texts: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
    """The words outside the intervals, joined by one space."""
    out = []
    for text, a, b in zip(texts.to_pylist(), first.to_pylist(), last.to_pylist(), strict=True):
        words, at, parts = (text or "").encode().split(), 0, []
        for low, high in zip(a or (), b or (), strict=True):
            parts += words[at:low]
            at = high
        out.append(b" ".join(parts + words[at:]).decode())
    return pa.array(out, pa.string())


ADDED = ("n_words", "n_removed", "kept_text")


def remove_repeated(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of `docs` with n_words, n_removed and kept_text, which take the place of own ones.

    A word goes if a window that covers it also starts anywhere else in the table, in the same
    text too. Kept words are joined by one space. Null and empty texts have no words. Repeated
    rows count as occurrences of one another. Texts shorter than a window keep every word; very
    long ones stand alone in a batch. An empty table gives an empty result.
    """
    text = F.col("text").cast("string")
    key, hashed = F.col("doc_id").cast("long"), F.xxhash64(text)
    found = repeated_spans(docs.select(key.alias("doc_id"), text.alias("text"), hashed.alias("hash")), width)
    found = found.select(F.col("doc_id").alias("_d"), F.col("hash").alias("_h"), F.col("n_words").alias("_n"), "first", "last")
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ADDED))
    rows = docs.select(own.alias("row"), key.alias("_k"), text.alias("_text"), hashed.alias("_hash"))
    joined = rows.join(found, F.col("_k").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_h")), "left")
    removed = F.aggregate(
        F.zip_with("first", "last", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y
    )
    return joined.select(
        "row.*", F.coalesce("_n", F.lit(0)).alias("n_words"), F.coalesce(removed, F.lit(0)).alias("n_removed"),
        F.arrow_udf(kept_words, StringType())("_text", "first", "last").alias("kept_text"),
    )
