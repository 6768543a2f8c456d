"""SimHash near-duplicates through fuzzy hashing with the binary Golay code.

The code's 4,096 words of 23 bits lie so that every 23-bit value is within 3 bits of exactly one.
A value's keys are the code words within 4 bits: one if the nearest is within 2, else six. If two
values differ in one bit, the word nearest to the first is among the keys of the second.

A fingerprint of 64 bits has four blocks of 16. With 3 bits different at most, one block is
intact; of the two halves of the other 48 bits one has one different bit at most. So each
fingerprint asks with (block, intact value, half, its nearest word), eight keys, and is posted
under (block, intact value, half, each of its keys). Asked and posted keys are joined, and the
distance is verified in the join.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import Scratch, plain, slices
from tickloom.llm.components import components

SHINGLE, SEED, BITS_APART = 3, 42, 3
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the code.
GENERATOR = 0b101011100011
LENGTH, CHECKS = 23, 11


def fingerprint(text: str | None) -> int:
    """64 bits; a bit is set if it is in over half of the shingles' hashes. No words: zero."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        parts = zip(*(words[i:] for i in range(SHINGLE)), strict=False)
        hashes = [xxhash.xxh64_intdigest(b" ".join(p), SEED) for p in parts]
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], ">u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches):
        for batch in slices(batches, "text"):
            found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return plain(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, fp long")


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error of 3 bits at most, and the errors of 4 bits (-1: none)."""
    syndrome = np.array([_remainder(1 << i) for i in range(LENGTH)], np.int64)
    nearest, others = np.zeros(1 << CHECKS, np.int64), np.full((1 << CHECKS, 5), -1, np.int64)
    found = np.zeros(1 << CHECKS, np.int64)
    weight = np.zeros(1 << CHECKS, np.int64)
    errors = [(0, 0, 0)]
    for bits in range(1, 5):
        errors = [(e | 1 << i, s ^ int(syndrome[i]), i + 1) for e, s, low in errors for i in range(low, LENGTH)]
        for e, s, _ in errors:
            if bits < 4:
                nearest[s], weight[s] = e, bits
            elif weight[s] == 3:
                others[s, found[s]] = e
                found[s] += 1
    return nearest, others


def _remainder(value: int) -> int:
    for i in range(LENGTH - 1, CHECKS - 1, -1):
        if value >> i & 1:
            value ^= GENERATOR << (i - CHECKS)
    return value


@cache
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    low = np.array([_remainder(v) for v in range(1 << 12)], np.int64)
    high = np.array([_remainder(v << 12) for v in range(1 << 11)], np.int64)
    return low, high


def code_words(values: np.ndarray) -> np.ndarray:
    """A row per 23-bit value: the index of the nearest code word, then five more or -1."""
    low, high = _syndromes()
    nearest, others = golay()
    s = low[values & 0xFFF] ^ high[values >> 12]
    more = others[s]
    words = np.concatenate([(values ^ nearest[s])[:, None], np.where(more < 0, -1, values[:, None] ^ more)], axis=1)
    return words >> CHECKS  # a code word is known by its first 12 bits; -1 stays


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per fingerprint: 8 keys to ask with, and 8 x 6 keys to post under (-1: none)."""
    f = fp.view(np.uint64)
    asked, posted = [], []
    for block in range(4):
        intact = ((f >> np.uint64(16 * block)) & np.uint64(0xFFFF)).astype(np.int64)
        below = f & np.uint64((1 << 16 * block) - 1)
        above = (f >> np.uint64(16 * block + 16)) if block < 3 else np.zeros_like(f)
        rest = below | above << np.uint64(16 * block)
        for half in range(2):
            part = ((rest >> np.uint64(24 * half)) & np.uint64(0x7FFFFF)).astype(np.int64)
            words = code_words(part)
            head = ((block * 2 + half) << 28) | intact << 12
            asked.append(head | words[:, 0])
            posted.append(np.where(words < 0, -1, head[:, None] | words))
    return np.stack(asked, 1), np.concatenate(posted, 1)


def _keyed(fps: DataFrame, post: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 20_000):
                fp = batch.column("fp").slice(start, 20_000).to_numpy()
                key = keys(fp)[int(post)]
                kept = key >= 0
                names = ["key", "v" if post else "u"]
                yield pa.RecordBatch.from_arrays([pa.array(key[kept]), pa.array(np.repeat(fp, kept.sum(1)))], names)

    return fps.mapInArrow(run, f"key long, {'v' if post else 'u'} long")


def links(fps: DataFrame, apart: int = BITS_APART) -> DataFrame:
    """Pairs (a, b), a < b, of different fingerprints with `apart` (3 at most) or fewer bits apart.

    `fps` has distinct values. No set of 64-bit values that are pairwise within 3 bits has more
    than 128 members, so links do not grow with the square of a group. Spark sizes both sides of
    the join by the fingerprints, not by the keys made of them (some 50 times as many rows): it
    must never broadcast one.
    """
    if not 0 <= apart <= 3:
        raise ValueError("the keys find pairs with at most 3 different bits")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v")))
    return (
        _keyed(fps, False).join(_keyed(fps, True).hint("merge"), "key")
        .where((F.col("u") != F.col("v")) & (near <= apart))
        .select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, apart: int = BITS_APART) -> DataFrame:
    """Per row: doc_id, fingerprint (hex) and component_id, the smallest doc_id it reaches.

    Texts without words (null, empty) share fingerprint zero and are linked like any other.
    Rows with a null doc_id take part; they are never a component's id unless all its rows have
    none (then null). Repeated rows give repeated rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.stored("fingerprints", fingerprints(docs))
    values = scratch.stored("values", rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    pairs = scratch.stored("pairs", links(values.select("fp"), apart))
    root = components(pairs, scratch)
    placed = values.join(root, values.fp == root.a, "left").select(
        "fp", "least", F.coalesce("b", "fp").alias("root")
    )
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.stored("named", placed.join(ids, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, apart: int = BITS_APART) -> DataFrame:
    """The rows of `docs`, one of each component: that with the smallest doc_id.

    Rows that repeat a doc_id are one document, of which the row with the smallest hash of its
    text stays, whatever is computed again. Rows without a doc_id stay, since no decision can name
    them. An empty table gives an empty result.
    """
    found = near_duplicates(docs.where("doc_id is not null"), apart)
    chosen = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    named = docs.where("doc_id is not null").select(
        F.col("doc_id").alias("id"), F.sha2(F.col("text").cast("string"), 256).alias("key"), row.alias("row")
    )
    first = Window.partitionBy("id").orderBy("key")
    kept = named.join(chosen.withColumnRenamed("doc_id", "id"), "id", "left_semi")
    kept = kept.withColumn("place", F.row_number().over(first)).where("place = 1").select("row.*")
    return kept.union(docs.where("doc_id is null"))
