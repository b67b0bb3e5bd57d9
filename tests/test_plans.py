"""The plans must keep the shape they were designed for."""

import re

import pytest

from ledgerloom.operators import layout, ledger as L
from ledgerloom.plans import catalog, statement
from ledgerloom.sources import rendered as R
from ledgerloom.sources import tables
from ledgerloom.sources.scratch import new_path
from pyspark.sql import types as T


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return re.findall(r"Exchange \w+", plan_of(df))


@pytest.fixture(scope="module")
def stored_words(spark, sf):
    path = new_path(spark, "words")
    R.words(spark, sf).write.parquet(path)
    return tables.read_words(spark, path, doc_type=T.LongType())


def test_words_are_shuffled_once(stored_words):
    """Lines, regions, rows, numbering and totals all use the one exchange on the document."""
    totals = L.totals(statement.transactions(stored_words))
    assert exchanges(totals) == ["Exchange hashpartitioning"]


def test_scan_reads_only_what_is_used(stored_words):
    schema = re.search(r"ReadSchema: struct<(.*?)>", plan_of(statement.transactions(stored_words))).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"doc_id", "page", "ord", "x0", "y0", "text"}


def test_area_filter_reaches_the_scan(stored_words):
    area = layout.inspect_area(stored_words, 2, (240.0, 350.0))
    plan = area._sc._jvm.PythonSQLUtils.explainString(area._jdf.queryExecution(), "formatted")
    pushed = re.search(r"PushedFilters: (.*)", plan).group(1)
    assert "EqualTo(page,2)" in pushed and "GreaterThanOrEqual(y0,240.0)" in pushed


def test_continuity_moves_the_rows_once(spark, sf):
    """Rows go to their block; the other exchanges carry one row per block, which bridges gaps between blocks."""
    path = new_path(spark, "ledger")
    R.ledger(spark, sf).drop("okey").write.parquet(path)
    ledger = tables.read_ledger(spark, path, doc_type=T.LongType())
    lines = plan_of(L.balance_continuity(ledger)).splitlines()
    below = [lines[i + 1] for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert len([x for x in below if "max_by" not in x]) == 1 and len(below) == 3
    assert "PushedFilters: [IsNotNull(withdrawal), GreaterThan(withdrawal,100.00)]" in plan_of(L.large_withdrawals(ledger))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - {"result_json", "export_formats", "stream_intake"}))
def test_no_python_and_no_cross_product_in_any_plan(spark, sf, name):
    plan = plan_of(catalog.QUERIES[name](spark, sf))
    for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition"):
        if word == "SinglePartition" and name == "column_profile":
            continue  # one row of counts per task is all that meets there
        assert word not in plan, word


def test_page_warnings_put_words_in_lines_once_and_read_no_amounts(spark, sf, stored_words):
    """Both kinds of warnings start from stored pages; amounts are not read for them."""
    told = statement.page_warnings(R.documents(spark, sf), stored_words)
    assert "collect_list" not in plan_of(told)
    pages = statement.page_tables(stored_words)
    assert "decimal" not in plan_of(pages)
    rows = statement.page_rows(stored_words).groupBy("doc_id", "page").agg({"has_table": "first"})
    assert sorted(map(tuple, pages.collect())) == sorted(map(tuple, rows.collect()))


def test_known_counts_keep_layout_lines_on_one_exchange(spark, sf, stored_words):
    lines = layout.transaction_lines(stored_words, sizes=R.word_counts(spark, sf))
    cells = layout.position_cells(layout.word_roles(lines))
    assert exchanges(cells) == ["Exchange hashpartitioning"]
    plain = layout.transaction_lines(stored_words)
    assert sorted(map(str, lines.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_counts_given_render_the_same_words(spark, sf):
    counts = R.word_counts(spark, sf)
    assert "explode(_words" in plan_of(R.words(spark, sf, counts))
    assert R.words(spark, sf, counts).exceptAll(R.words(spark, sf)).isEmpty()
