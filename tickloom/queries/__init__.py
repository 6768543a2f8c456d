"""Registered queries: a Spark job and, where SQL can say it, an independent SQL text."""

from tickloom.queries.registry import REGISTRY, oracle_texts, query_functions  # noqa: F401
from tickloom.queries import (  # noqa: F401,E402
    backtests,
    companies,
    files,
    indicators,
    jobs,
    operations,
    rules,
    state,
    streams,
)
