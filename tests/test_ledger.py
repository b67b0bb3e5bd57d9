import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerloom.operators import audit, ledger as L
from ledgerloom.sources import rendered as R
from ledgerloom.sources.tables import ledger_from_rows


def dec(v):
    return None if v is None else Decimal(v)


GOLDEN = [  # date, withdrawal, deposit, balance
    ("01/01/2022", "20.00", None, "7980.00"), ("01/01/2022", "4.40", "20.00", "7975.60"),
    ("02/01/2022", "5.00", None, "7970.60"), ("02/12/2022", "2.20", None, "7968.40"),
    ("02/01/2022", None, "125.00", "8093.40"),
]


@pytest.fixture(scope="module")
def golden(spark):
    rows = [
        ("g", 2, i, d, dt.datetime.strptime(d, "%d/%m/%Y").date(), f"Card payment {i}", dec(w), dec(p), dec(b))
        for i, (d, w, p, b) in enumerate(GOLDEN, 1)
    ]
    return ledger_from_rows(spark, rows)


def test_continuity_on_golden_rows(golden):
    got = L.balance_continuity(golden).orderBy("txn_seq").collect()
    assert [r.status for r in got] == ["FIRST", "BREAK", "OK", "OK", "OK"]
    assert got[1].expected == Decimal("7995.60") and got[1].difference == Decimal("-20.00")
    found = L.discrepancies(golden).collect()
    assert [(r["index"], r.date, r.actual) for r in found] == [(1, "01/01/2022", Decimal("7975.60"))]


def test_one_cent_passes_two_cents_fail_missing_is_unverifiable(spark):
    rows = [("x", 1, i, "01/01/2022", None, "t", dec("1.00"), None, dec(b)) for i, b in
            enumerate(["100.00", "99.01", "98.03", None, "90.00"], 1)]
    got = L.balance_continuity(ledger_from_rows(spark, rows)).orderBy("txn_seq").collect()
    assert [r.status for r in got] == ["FIRST", "OK", "BREAK", "UNVERIFIABLE", "UNVERIFIABLE"]


def test_rules_on_golden_rows(golden):
    assert [r.one_side for r in audit.field_rules(golden).orderBy("txn_seq").collect()] == [True, False, True, True, True]
    assert [r.goes_back for r in L.date_order(golden).orderBy("txn_seq").collect()] == [False] * 4 + [True]


def test_summary(golden):
    r = L.summary(golden).first()
    assert (r.n_transactions, r.n_withdrawals, r.n_deposits) == (5, 4, 2)
    assert (r.total_withdrawals, r.total_deposits, r.net_change) == (Decimal("31.60"), Decimal("145.00"), Decimal("113.40"))
    assert (r.opening_balance, r.closing_balance, r.actual_change) == (Decimal("8000.00"), Decimal("8093.40"), Decimal("93.40"))
    assert (r.first_balance, r.calculated_change) == (Decimal("7980.00"), Decimal("113.40"))


def test_summary_skips_forward_and_missing_balances(spark):
    rows = [("x", 1, 1, "d", None, "Balance Brought Forward", None, None, dec("5.00")), ("x", 1, 2, "d", None, "a", None, None, dec("0.00")),
            ("x", 1, 3, "d", None, "b", None, None, None), ("x", 1, 4, "d", None, "c", None, None, dec("7.00"))]
    r = L.summary(ledger_from_rows(spark, rows)).first()
    assert r.first_non_forward_balance == Decimal("7.00") and r.total_deposits == 0


@pytest.mark.parametrize("block", [1, 2, 3, 7, 65_536])
def test_blocks_do_not_change_ordered_results(spark, sf, block):
    ledger = R.ledger(spark, sf)
    w = W.partitionBy("doc_id").orderBy("txn_seq")
    plain = ledger.select("doc_id", "txn_seq", F.lag("balance").over(w).alias("p"))
    got = L.balance_continuity(ledger, block=block).select("doc_id", "txn_seq", F.col("previous_balance").alias("p"))
    assert sorted(map(str, plain.collect())) == sorted(map(str, got.collect()))
    move = F.coalesce("deposit", F.lit(0)) - F.coalesce("withdrawal", F.lit(0))
    first = F.first("balance").over(w)
    known = F.when(first.isNotNull(), first + F.sum(F.when(F.col("txn_seq") > 1, move).otherwise(0)).over(w))
    plain = ledger.select("doc_id", "txn_seq", known.cast("decimal(28,2)").alias("r"))
    got = L.rebuild_balance(ledger, block).select("doc_id", "txn_seq", F.col("running_balance").cast("decimal(28,2)").alias("r"))
    assert sorted(map(str, plain.collect())) == sorted(map(str, got.collect()))


def test_duplicates_treat_nulls_as_equal(golden):
    again = golden.withColumn("txn_seq", F.col("txn_seq") + 5)
    found = L.duplicates(golden.unionByName(again))
    assert found.count() == 5 and {r.copies for r in found.collect()} == {2}
    assert sorted(r.txn_seq for r in L.drop_repeats(golden.unionByName(again)).collect()) == [1, 2, 3, 4, 5]


def test_filters(golden):
    assert L.deposits(golden).count() == 2
    assert L.large_withdrawals(golden, 4.4).count() == 2
    assert L.keyword_search(golden, "CARD .* 3").count() == 1
    assert L.keyword_search(golden, "card .* 3", literal=True).count() == 0
    assert L.on_page(golden, 2).count() == 5 and L.head(golden, 3).count() == 3
    shown = L.display_rows(golden.withColumn("deposit", F.lit(0).cast("decimal(18,2)")), 1).first()
    assert shown.deposit is None and shown.description_more == ""


def test_column_profile(golden):
    got = {r.column_name: (r.data_type, r.n_rows, r.n_present) for r in L.column_profile(golden).collect()}
    assert got["deposit"] == ("decimal(18,2)", 5, 2) and got["doc_id"] == ("string", 5, 5)


def test_daily_summary(golden):
    got = {str(r.txn_date): (r.withdrawal, r.deposit) for r in L.daily_summary(golden).collect()}
    assert got["2022-01-02"] == (Decimal("5.00"), Decimal("125.00"))


def test_golden_compare_and_closing(spark, golden):
    want = golden.withColumn("description", F.lit("Card.*1")).withColumn(
        "balance", F.when(F.col("txn_seq") == 2, F.lit("1.00").cast("decimal(18,2)")).otherwise(F.col("balance")))
    got = audit.golden_compare(golden, want).orderBy("txn_seq").collect()
    assert [r.withdrawal_ok and r.deposit_ok for r in got] == [True] * 5
    assert [r.balance_ok for r in got] == [True, False, True, True, True]
    assert [r.description_ok for r in got] == [True] + [False] * 4
    schema = "doc_id string, opening decimal(18,2), closing decimal(18,2)"
    ok = audit.closing_check(golden, spark.createDataFrame([("g", dec("8000.00"), dec("8093.40"))], schema)).first()
    assert (ok.status, ok.expected_change) == ("OK", Decimal("93.40"))
    assert audit.closing_check(golden, spark.createDataFrame([("g", dec("8000.00"), dec("8093.39"))], schema)).first().status == "MISMATCH"


def test_corrections(spark, golden):
    fixes = spark.createDataFrame(
        [("g", 1, "withdrawal", "21.00", 1), ("g", 1, "withdrawal", "22.00", 3), ("g", 1, "withdrawal", "20.00", 2),
         ("g", 2, "deposit", None, 1), ("g", 3, "balance", "7970.60", 1), ("g", 4, "date_raw", "02/01/2022", 1)],
        "doc_id string, txn_seq long, field string, value string, version int")
    got = {r.txn_seq: r for r in audit.apply_corrections(golden, fixes).collect()}
    assert got[1].withdrawal == Decimal("22.00") and got[2].deposit is None and str(got[4].txn_date) == "2022-01-02"
    changed = {(r.txn_seq, r.field): (r.old_value, r.new_value, r.version) for r in audit.correction_audit(golden, fixes).collect()}
    assert changed == {
        (1, "withdrawal"): ("20.00", "22.00", 3), (2, "deposit"): ("20.00", None, 1),
        (4, "date_raw"): ("02/12/2022", "02/01/2022", 1),
    }


def test_page_anomalies(spark, make_words):
    same = [(1, 1, "x"), (2, 2, "y")]
    words = make_words({("a", 1): same, ("a", 3): same, ("a", 5): [(1, 1, "z")], ("b", 1): same})
    docs = spark.createDataFrame([("a", 4), ("b", 1)], "doc_id string, n_pages int")
    got = {(r.doc_id, r.page, r.anomaly, r.copies) for r in audit.page_anomalies(docs, words).collect()}
    assert got == {("a", 2, "missing", 0), ("a", 4, "missing", 0), ("a", 5, "surplus", 1), ("a", 1, "repeated", 2)}


def test_decisions(spark):
    results = spark.createDataFrame([("a", True, 1.0), ("b", True, 1.0), ("c", True, 0.7), ("d", True, 0.35), ("e", False, 0.0)],
                                    "doc_id string, success boolean, confidence double")
    results = results.unionByName(spark.createDataFrame([("f", True, 1.0), ("g", True, 1.0)], results.schema))
    faults = spark.createDataFrame([("b", 2, 0, 0), ("a", 0, 0, 0), ("f", 0, 1, 0), ("g", 0, 0, 1)],
                                   "doc_id string, n_breaks long, n_unverifiable long, n_one_side long")
    got = {r.doc_id: r.decision for r in audit.decisions(results, faults).collect()}
    assert got == {"a": "approve", "b": "review", "c": "review", "d": "reject", "e": "review", "f": "review", "g": "review"}


def test_expected_rows_and_documents_without_match_stay(spark, golden):
    want = golden.unionByName(golden.withColumn("doc_id", F.lit("absent"))).withColumn("withdrawal", F.lit(None).cast("decimal(18,2)"))
    missing = audit.golden_compare(golden, want).filter("NOT found").collect()
    assert len(missing) == 5 and not any(r.withdrawal_ok or r.deposit_ok or r.balance_ok for r in missing)
    schema = "doc_id string, opening decimal(18,2), closing decimal(18,2)"
    got = audit.closing_check(golden, spark.createDataFrame([("absent", dec("1.00"), dec("2.00"))], schema)).first()
    assert (got.status, got.expected_change) == ("MISSING", Decimal("1.00"))


def test_unreadable_corrections_change_nothing_and_are_listed(spark, golden):
    fixes = spark.createDataFrame(
        [("g", 1, "withdrawal", "21.00", 1), ("g", 1, "withdrawal", "12,34x", 2), ("g", 2, "payee", "x", 1), ("g", 99, "balance", "1.00", 1),
         ("g", 3, "description", "one", 4), ("g", 3, "description", "two", 4)],
        "doc_id string, txn_seq long, field string, value string, version int")
    got = {r.txn_seq: r for r in audit.apply_corrections(golden, fixes).collect()}
    assert got[1].withdrawal == Decimal("21.00") and got[3].description == "two"
    listed = {(r.txn_seq, r.value): r.outcome for r in audit.correction_history(golden, fixes).collect()}
    assert listed == {(1, "21.00"): "applied", (1, "12,34x"): "rejected", (2, "x"): "rejected", (99, "1.00"): "orphaned",
                      (3, "one"): "superseded", (3, "two"): "applied"}


@pytest.mark.parametrize("block", [1, 3, 65_536])
def test_ordered_checks_bridge_gaps(spark, block):
    rows = [("x", 1, n, "d", None, "a", None, dec("1.00"), dec(f"{n}.00")) for n in (2, 4, 5, 9)]
    ledger = ledger_from_rows(spark, rows)
    checked = L.balance_continuity(ledger, block=block).orderBy("txn_seq").collect()
    assert [r.status for r in checked] == ["FIRST", "BREAK", "OK", "BREAK"]
    assert [int(r.running_balance) for r in L.rebuild_balance(ledger, block).orderBy("txn_seq").collect()] == [2, 3, 4, 5]
