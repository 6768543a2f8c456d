"""Documents for the tests: hard cases, and the smallest given table."""

from __future__ import annotations

import random

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

ROOT = "/root/testdata/sf0.001"
#: Names that operators use themselves.
CLASHING = (
    "n_words long, hash long, length long, key long, rank int, fp long, row string, first int, last int, "
    "kept boolean, bucket int, batch string, shard int, _row int, `a.b` int"
)
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


def given(name: str = "documents") -> list[dict]:
    return pq.read_table(f"{ROOT}/{name}.parquet").to_pylist()


def hard_texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=60))
    base = " ".join(rng.choices(words, k=900))
    out: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Two Words"), (6, "a b c a b c a b c"),
        (7, "same line here\nsame line here\n\nsame line here\nother"), (8, passage), (9, f"x {passage}\n{passage} y"),
        (10, " ".join(rng.choices(words, k=200)) + " " + passage), (11, base), (12, base), (13, base.replace("w1 ", "q1 ", 1)),
        (14, " ".join(rng.choices(words, k=6000))), (15, "z" * 70_000), (16, "é ñ 日本語 #*$%&|<>    x"),
        (17, "tail space "), (18, "Released under the MIT License. CC BY-NC 4.0"), (19, "p q " * 300),
        (None, None), (None, base), (20, "repeated row"), (20, "repeated row"), (-3, "below zero <|endoftext|>"),
    ]
    return out


def documents(spark: SparkSession, given_too: bool = True) -> DataFrame:
    rows = [(i, t) for i, t in hard_texts()]
    if given_too:
        rows += [(100 + r["doc_id"], r["text"]) for r in given()]
    filler = [None if k % 2 else 7 for k in range(15)]
    filler[4] = filler[6] = filler[9] = filler[11] = None
    wide = [(i, t, None, "s", None, *filler) for i, t in rows]
    return spark.createDataFrame(wide, SCHEMA).repartition(3)


def table(spark: SparkSession, tmp_path, df: DataFrame) -> DataFrame:
    path = f"file://{tmp_path}/table"
    df.write.parquet(path)
    return spark.read.parquet(path)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
