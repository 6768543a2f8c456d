"""Quality rules as a ledger of bits.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit per
failed rule. A policy is a named, versioned mask: a document is kept if it fails none of the
mask's rules. What a rule costs under a policy follows from counts per bit pattern alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tickloom.llm.common import buffer_of, slices
from tickloom.llm.words import SPACED, byte_class, spans, window_hashes, windows_inside, word_hashes

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
LINES = byte_class(b"\n")

#: Rules in the order of their bits: name and the condition (in SQL) under which it fails.
RULES: tuple[tuple[str, str], ...] = (
    ("short", "n_words < 50"),
    ("repetitive", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 12 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << i for i, (rule, _) in enumerate(RULES) if rule in self.rules)


BASE = Policy("base", 1, ("short", "repetitive"))
WEB = Policy("web", 1, tuple(rule for rule, _ in RULES))


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """True entries between each two bounds."""
    out = np.zeros(len(bounds) - 1, np.int64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(flags, bounds[full], dtype=np.int64)
    return out


def _recurring(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per entry: whether its (text, hash) occurs twice or more, and whether as a later one."""
    key = hashes + text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(key, kind="stable")
    equal = key[order][1:] == key[order][:-1]
    again, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    again[order[1:][equal]] = again[order[:-1][equal]] = True
    later[order[1:][equal]] = True
    return again, later


def measured(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The measurements of a batch, in the order of MEASURES."""
    data, bounds = buffer_of(batch.column("text"))
    starts, ends, counts = spans(data, bounds, SPACED)
    points = SPACED[data] & ((data & 0xC0) != 0x80)
    first, last, lines = spans(data, bounds, LINES)
    worded = np.searchsorted(starts, first) < np.searchsorted(starts, last)
    text_of_line = np.repeat(np.arange(len(lines)), lines)[worded]
    _, later = _recurring(text_of_line, word_hashes(data, first[worded], last[worded]))
    shingles = window_hashes(word_hashes(data, starts, ends), 3)
    place = np.flatnonzero(windows_inside(counts, 3)[: len(shingles)])
    again, _ = _recurring(np.repeat(np.arange(len(counts)), counts)[place], shingles[place])
    covered = np.zeros(len(starts) + 2, bool)
    for step in range(3):
        covered[place[again] + step] = True
    n = len(counts)
    return [
        counts, _per_text(points, bounds), _per_text(SYMBOLS[data], bounds),
        np.bincount(text_of_line, minlength=n), np.bincount(text_of_line[later], minlength=n),
        _per_text(covered[: len(starts)], np.append(0, np.cumsum(counts))),
    ]


def _measures(texts: pa.Array) -> pa.Array:
    parts = [measured(b) for b in slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text")]
    values = [np.concatenate([np.empty(0, np.int64), *column]) for column in zip(*parts, strict=True)]
    values = values or [np.empty(0, np.int64) for _ in MEASURES]
    return pa.StructArray.from_arrays([pa.array(v.astype(np.int64)) for v in values], list(MEASURES))


def _with_bits(rows: DataFrame) -> DataFrame:
    bits = [F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, fails) in enumerate(RULES)]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return rows.withColumn("fail_bits", total.cast("long"))


def _measured_rows(docs: DataFrame, name: str, column: Column) -> DataFrame:
    kind = StructType([StructField(m, LongType()) for m in MEASURES])
    values = F.arrow_udf(_measures, kind)(F.col("text").cast("string"))
    return _with_bits(docs.select(column.alias(name), values.alias("_m")).select(name, "_m.*"))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and fail_bits of every row.

    A null text has no words, lines or symbols, as an empty one. Repeated rows are each judged.
    """
    return _measured_rows(docs, "doc_id", F.col("doc_id").cast("long"))


def kept_rows(docs: DataFrame, policy: Policy) -> DataFrame:
    """The rows of `docs`, with their own columns, that pass the policy."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return judged(_measured_rows(docs, "_row", row), policy).where("kept").select("_row.*")


def judged(rows: DataFrame, policy: Policy, column: str = "kept") -> DataFrame:
    """The ledger with a boolean column: no rule of the policy failed."""
    return rows.withColumn(column, F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(rows: DataFrame, *policies: Policy) -> DataFrame:
    """Per policy and rule: rows, kept, failed, and how many more stay without the rule.

    Rows are first counted per bit pattern, of which there are at most 2 ** len(RULES).
    """
    cases = [
        F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(rule).alias("rule"),
                 F.lit(p.mask).alias("mask"), F.lit(1 << i).alias("bit"))
        for p in policies for i, (rule, _) in enumerate(RULES) if rule in p.rules
    ]
    counts = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    each = counts.select("fail_bits", "n", F.explode(F.array(*cases)).alias("c")).select("fail_bits", "n", "c.*")
    failed = F.col("fail_bits").bitwiseAND(F.col("mask"))

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    return each.groupBy("policy", "version", "rule").agg(
        F.sum("n").alias("n_rows"), total(failed == 0).alias("n_kept"),
        total(failed.bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(failed == F.col("bit")).alias("n_only"),
    )


WORDS_SQL = r"[^\x20\x09-\x0D]+"
#: The query op1 in SQL.
SQL = rf"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{WORDS_SQL}') AS ws
  FROM documents),
lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM base)
  WHERE regexp_matches(line, '{WORDS_SQL}') GROUP BY r),
wins AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM base WHERE len(ws) > 2)),
again AS (SELECT r, i FROM wins QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
covered AS (
  SELECT r, count(DISTINCT i + s) AS n_repeat_words
  FROM again, (VALUES (0), (1), (2)) AS steps(s) GROUP BY r),
m AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM base LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)),
bits AS (
  SELECT *, {" + ".join(f"(CASE WHEN {fails} THEN {1 << i} ELSE 0 END)" for i, (_, fails) in enumerate(RULES))} AS b
  FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_lines::BIGINT AS n_lines, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       b::BIGINT AS fail_bits, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, b = 0 AS kept
FROM bits
"""
