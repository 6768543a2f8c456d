from __future__ import annotations

import pytest

from tests.llm import cases
from tickloom.llm.common import ship


@pytest.fixture(scope="session")
def session(spark):
    ship(spark)
    return spark


@pytest.fixture(scope="session")
def docs(session, tmp_path_factory):
    return cases.table(session, tmp_path_factory.mktemp("docs"), cases.documents(session))


@pytest.fixture(scope="session")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def nothing(session):
    return cases.empty(session)
