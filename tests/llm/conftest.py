import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session", autouse=True)
def _workers_import_the_package(spark):
    from ledgerloom.llm.shipping import ship

    ship(spark)
