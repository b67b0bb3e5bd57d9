import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from ledgerloom.plans.session import local_session

    session = local_session(4, "tests", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    })
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def make_words(spark):
    """Words from {(doc, page): [(x0, y0, text), ...]} in extraction order."""
    from ledgerloom.schemas import words_schema

    def make(pages):
        rows = [
            (doc, page, i, float(x), float(y), float(x) + 5.0 * len(text), float(y) + 9.0, text, 0, int(y), i)
            for (doc, page), items in pages.items()
            for i, (x, y, text) in enumerate(items)
        ]
        return spark.createDataFrame(rows, words_schema())

    return make
