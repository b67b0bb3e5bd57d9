"""Options of the extraction, sides of one-column layouts and earlier states of corrected ledgers."""

from decimal import Decimal

from ledgerloom.operators import audit, guard, layout, ledger as L
from ledgerloom.plans import statement
from ledgerloom.sources import rendered as R
from ledgerloom.sources.scratch import stored
from pyspark.sql import functions as F


def rows(df, *more):
    return sorted(map(str, df.select("doc_id", "txn_seq", "description", "withdrawal", "deposit", "balance", *more).collect()))


def test_carried_pages_in_one_pass_with_results(spark, sf):
    words = stored(R.words(spark, sf).filter("doc_id < 60"), "words")
    documents = R.documents(spark, sf).filter("doc_id < 60")
    want = rows(statement.transactions(words, carry_pages=True))
    assert want != rows(statement.transactions(words))
    plain = sorted(map(str, statement.page_warnings(documents, words).collect()))
    for floor in (10**9, 100):  # ordinary documents, and all as large ones
        ledger, found = statement.extract(words, carry_pages=True, floor=floor)
        assert rows(ledger) == want
        assert sorted(map(str, guard.page_warnings(documents, found).collect())) == plain


def test_a_page_of_carried_lines_only_is_still_there(make_words, spark):
    words = make_words({("d", 1): [(45.4, 30, "01/02/2022"), (113.0, 30, "Shop"), (374.0, 30, "5.00")], ("d", 2): [(45.4, 20, "CURRENCY:"), (113.0, 40, "more")]})
    documents = spark.createDataFrame([("d", 2)], "doc_id string, n_pages int")
    ledger, found = statement.extract(words, carry_pages=True)
    assert [(r.description, r.withdrawal) for r in ledger.collect()] == [("Shop more", Decimal("5.00"))]
    assert guard.page_warnings(documents, found).count() == 0
    assert statement.document_results(documents, words, carry_pages=True).first().transaction_count == 1


def test_fragments_are_merged_before_extraction(make_words, spark):
    line = [(45.4, 30, "01/02/2022"), (113.0, 30, "Grocery"), (374.0, 30, "1,234.50"), (513.0, 30, "9,000.00")]
    whole = make_words({("d", 1): [(45.4, 10, "CURRENCY:"), *line]})
    cut = make_words({("d", 1): [(45.4, 10, "CURRENCY:"), *[w for x, y, t in line for w in ((x, y, t[:4]), (x + 20.5, y, t[4:]))]]})
    want = rows(statement.transactions(whole))
    assert rows(statement.transactions(cut)) != want
    assert rows(statement.transactions(cut, merge_gap=1.0)) == want and rows(statement.extract(cut, merge_gap=1.0)[0]) == want


def test_a_layout_with_one_amount_column(make_words):
    """Sides come from key words, then from the balance; without either the amount is on none."""
    told = [("ATM cash", "20.00", "980.00"), ("Shop", "30.00", "950.00"), ("Refund", "5.00", "955.00"), ("INCOMING rent", "45.00", "1,000.00"), ("Odd", "1.00", None), ("Odd", "2.00", "997.00"), ("Nothing", "0.00", "997.00")]
    words = []
    for i, (text, amount, balance) in enumerate(told):
        y = 30 + 24 * i
        words += [(45.4, y, f"0{i + 1}/01/2022"), (113.0, y, text.split()[0]), *[(163.0, y, t) for t in text.split()[1:]], (300.0, y, amount), *[(420.0, y, b) for b in [balance] if b]]
    words = make_words({("d", 1): words})
    bounds = layout.column_bounds(layout.word_roles(layout.transaction_lines(words)))
    ledger = statement.transactions(words, layout.single_amount_profile(bounds))
    got = [(str(r.withdrawal), str(r.deposit), str(r.unplaced), r.side_source) for r in L.infer_sides(ledger, bounds).orderBy("txn_seq").collect()]
    assert got == [
        ("20.00", "None", "None", "keyword"), ("30.00", "None", "None", "balance"), ("None", "5.00", "None", "balance"), ("None", "45.00", "None", "keyword"),
        ("None", "None", "1.00", "none"), ("None", "None", "2.00", "none"), ("None", "None", "None", None),
    ]
    assert rows(L.infer_sides(ledger, bounds.limit(0))) == rows(ledger)


def test_ledgers_at_every_version_are_what_replay_gives(spark, sf):
    ledger = stored(R.ledger(spark, sf).filter("doc_id < 40"), "ledger")
    entries = [(1, "withdrawal", "1.00"), (2, "withdrawal", None), (3, "withdrawal", "x"), (4, "withdrawal", "4.00"), (2, "description", "B"), (2, "description", "A"), (3, "payee", "Q")]
    fixes = ledger.filter("txn_seq % 3 = 1").select("doc_id", "txn_seq", F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.lit(f).alias("field"), F.lit(x).cast("string").alias("value")) for v, f, x in entries])).alias("c")).select("doc_id", "txn_seq", "c.*")
    asked = ledger.select("doc_id", F.explode(F.array(*[F.lit(v) for v in range(5)])).alias("as_of")).distinct()
    at = stored(audit.ledger_as_of(ledger, fixes, asked), "states")
    for v in range(5):
        assert rows(at.filter(F.col("as_of") == v)) == rows(audit.apply_corrections(ledger, fixes.filter(F.col("version") <= v)))
    spans = stored(audit.correction_intervals(ledger, fixes), "spans")
    held = spans.filter("field = 'withdrawal'").groupBy("from_version", "to_version", F.when(F.col("from_version").isNotNull(), F.col("value")).alias("value")).count().collect()
    assert sorted((r.from_version or 0, r.to_version or 9, r.value or "") for r in held) == [(0, 1, ""), (1, 2, "1.00"), (2, 4, ""), (4, 9, "4.00")]
