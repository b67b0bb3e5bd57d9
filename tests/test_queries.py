import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402
from ledgerloom.plans import catalog, oracle  # noqa: E402
from ledgerloom.sources import tables  # noqa: E402
from ledgerloom.sources.scratch import new_path  # noqa: E402
from tools.check_queries import TABLES, canonical  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(oracle.ORACLE)
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in res.description]
    assert sorted(columns) == sorted(df.columns)
    want = canonical(columns, res.fetchall())
    assert got == want and got


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_result_json_files_hold_the_page_warnings(spark, sf, con, monkeypatch):
    paths = []
    monkeypatch.setattr(catalog, "new_path", lambda s, name: paths.append(new_path(s, name)) or paths[-1])
    catalog.result_json(spark, sf)
    written = tables.read_results(spark, paths[-1], catalog.LONG)
    got = {(r.doc_id, m) for r in written.collect() for m in r.warnings if " on page " in m}
    want = {(d, m) for d, _, m in con.execute(f"SELECT doc_id, page, message FROM ({oracle.ORACLE['page_warnings']})").fetchall()}
    assert got == want and got
