import json
from decimal import Decimal

import pytest

from ledgerloom import schemas as S
from ledgerloom.operators import guard
from ledgerloom.plans import statement
from ledgerloom.sources import rendered as R
from ledgerloom.sources import tables
from ledgerloom.sources.scratch import new_path
from pyspark.sql import types as T

ROW = {"date": "01/01/2022", "description": "x", "withdrawal": 1.5, "deposit": None, "balance": 2.0, "page": 2}


def test_result_reader_prefers_filled_data(spark, tmp_path):
    cases = {
        "data": {"data": [ROW]}, "transactions": {"transactions": [ROW]},
        "empty-data": {"data": [], "transactions": [ROW, ROW]}, "neither": {},
    }
    for name, body in cases.items():
        (tmp_path / f"{name}.json").write_text(json.dumps({"success": True, "confidence": 1.0, "warnings": [], **body}, indent=2))
    results = tables.read_results(spark, str(tmp_path), multi_line=True)
    sizes = {r.doc_id: len(r.rows) for r in results.collect()}
    assert sizes == {"data.json": 1, "transactions.json": 1, "empty-data.json": 2, "neither.json": 0}
    row = tables.result_rows(results).filter("doc_id = 'data.json'").first()
    assert (row.txn_seq, row.withdrawal, row.deposit, str(row.txn_date)) == (1, Decimal("1.50"), None, "2022-01-01")


@pytest.mark.parametrize("pages_per_part", [1, 2, 1000])
@pytest.mark.parametrize("key", ["transactions", "data"])
def test_result_records_round_trip(spark, sf, monkeypatch, pages_per_part, key):
    monkeypatch.setattr(guard, "PAGES_PER_PART", pages_per_part)
    words = R.words(spark, sf)
    ledger = statement.transactions(words)
    docs = R.documents(spark, sf)
    records = tables.result_records(ledger, statement.document_results(docs, words), key, statement.page_warnings(docs, words))
    assert records.filter("size(warnings) > n_warnings").isEmpty() and records.select("doc_id", "part").distinct().count() == records.count()
    if pages_per_part == 1000:
        assert records.filter("size(warnings) <> n_warnings").isEmpty()
    path = new_path(spark, "results")
    tables.write_results(records, path)
    back = tables.result_rows(tables.read_results(spark, path, T.LongType()))
    columns = [f.name for f in S.transactions_schema()]
    assert sorted(map(str, back.select(columns).collect())) == sorted(map(str, ledger.select(columns).collect()))


def test_written_record_looks_as_documented(spark, make_words):
    words = make_words({("a", 1): [(45, 200, "CURRENCY:"), (45.4, 252, "01/01/2022"), (113, 252, "Käse"), (512, 252, "1,000.00")]})
    docs = spark.createDataFrame([("a", 1)], "doc_id string, n_pages int")
    path = new_path(spark, "one")
    tables.write_results(tables.result_records(statement.transactions(words), statement.document_results(docs, words)), path)
    record = json.loads(spark.read.text(path).first().value)
    assert record["success"] is True and record["transaction_count"] == 1 and record["abort_reason"] is None
    assert record["transactions"] == [
        {"date": "01/01/2022", "description": "Käse", "withdrawal": None, "deposit": None, "balance": 1000.0, "page": 1}
    ]


@pytest.mark.parametrize("fmt", ["csv", "parquet", "json", "orc"])
def test_export_round_trip(spark, sf, fmt):
    ledger = R.ledger(spark, sf).drop("okey")
    path = new_path(spark, fmt)
    tables.write_ledger(ledger, path, fmt)
    back = tables.read_ledger(spark, path, fmt, T.LongType())
    assert sorted(map(str, back.select(ledger.columns).collect())) == sorted(map(str, ledger.collect()))


def test_partitioned_export(spark, sf):
    path = new_path(spark, "parts")
    tables.write_ledger(R.ledger(spark, sf).drop("okey"), path, partition_by=["page"])
    only = tables.read_ledger(spark, path, doc_type=T.LongType()).filter("page = 3")
    assert "PartitionFilters: [isnotnull(page" in only._jdf.queryExecution().executedPlan().toString()
    assert only.count() > 0


def test_words_reader_checks_and_prunes(spark, sf, make_words):
    path = new_path(spark, "words")
    make_words({("a", 1): [(1, 2, "x")]}).write.parquet(path)
    words = tables.read_words(spark, path)
    assert tables.pages_of(words).collect() == [("a", 1)]
    with pytest.raises(S.SchemaMismatch):
        statement.transactions(words.drop("text"), sizes=words.groupBy("doc_id").count().withColumnRenamed("count", "n"))


def test_unreadable_records_and_files_fail_their_documents(spark, tmp_path, make_words):
    from ledgerloom.operators import audit, guard
    from ledgerloom.plans import statement

    folder = tmp_path / "words"
    folder.mkdir()
    good = make_words({(d, 1): [(45.4, 100, "Account Summary of a good document with more than fifty characters")] for d in ("a", "b", "c")})
    lines = {r.doc_id: r.asDict() for r in good.collect()}
    import json

    (folder / "one.json").write_text(json.dumps(lines["a"]) + "\n" + json.dumps(lines["b"]) + "\n" + '{"doc_id": "b", "page": 1, "ord": [broken\n')
    (folder / "two.json").write_text("{{{{ nothing of it\n")
    words, damage = tables.read_words_checked(spark, str(folder))
    assert sorted(r.doc_id for r in words.collect()) == ["a", "b"]
    told = sorted((r.file.split("/")[-1], r.doc_id or "", r.reason) for r in damage.collect())
    assert told == [("one.json", "b", "unreadable record"), ("two.json", "", "unreadable record")]
    files = spark.createDataFrame([("c", "two.json"), ("a", "one.json"), ("b", "one.json")], "doc_id string, file string")
    aborts = audit.aborted(damage=tables.damaged_documents(damage, files))
    documents = spark.createDataFrame([(d, 1) for d in "abc"], "doc_id string, n_pages int")
    got = {r.doc_id: (r.success, r.abort_reason) for r in statement.document_results(documents, words, aborts).collect()}
    assert got == {"a": (True, None), "b": (False, "1 unreadable records"), "c": (False, "1 unreadable records")}

    stored_ = tmp_path / "parquet"
    good.filter("doc_id = 'a'").coalesce(1).write.parquet(str(stored_))
    (stored_ / "part-torn.parquet").write_bytes(b"PAR1 and then nothing")
    words, damage = tables.read_words_checked(spark, str(stored_), "parquet")
    assert words.count() == 1
    assert [(r.file.split("/")[-1], r.doc_id, r.reason) for r in damage.collect()] == [("part-torn.parquet", None, "unreadable file")]
    torn = tables.damaged_documents(damage, spark.createDataFrame([("z", "part-torn.parquet")], "doc_id string, file string"))
    assert [tuple(r) for r in torn.collect()] == [("z", "unreadable file")]
    assert guard.damaged(words).count() == 0
