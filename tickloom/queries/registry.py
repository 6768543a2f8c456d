"""Registry of queries.

Results built from floating sums are rounded on both sides, since sums may be
taken in any order; plain arithmetic is compared as it is; whole numbers come out as BIGINT and lists as joined text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.bridge import Tables


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None
    rounded: tuple[str, ...]
    digits: int

    def run(self, spark: SparkSession, root: str) -> DataFrame:
        return tidy(self.build(Tables(spark, root)), self.rounded, self.digits)

    def oracle(self) -> str:
        if not self.rounded:
            return self.sql
        rounded = ", ".join(f"round({c}, {self.digits}) + 0.0 AS {c}" for c in self.rounded)
        return f"SELECT * REPLACE ({rounded}) FROM ({self.sql}) AS result"


REGISTRY: dict[str, Query] = {}


def query(
    name: str, covers: str, sql: str | None = None, rounded: str = "", digits: int = 6
) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(
            name, tuple(covers.split()), build, sql, tuple(rounded.split()), digits
        )
        return build

    return register


def tidy(df: DataFrame, rounded: tuple[str, ...], digits: int) -> DataFrame:
    out = []
    for name, kind in df.dtypes:
        value = F.col(f"`{name}`")
        if name in rounded:
            value = F.round(value.cast("double"), digits) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            value = value.cast("bigint")
        elif kind == "array<string>":
            value = F.array_join(value, "; ")
        elif kind == "array<double>":
            texts = F.transform(value, lambda x: F.format_string("%.9f", x))
            value = F.array_join(texts, "; ")
        out.append(value.alias(name))
    return df.select(*out)


def query_functions() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in REGISTRY.items()}


def oracle_texts() -> dict[str, str]:
    return {name: q.oracle() for name, q in REGISTRY.items() if q.sql is not None}
