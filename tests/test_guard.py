import math

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import audit, guard
from ledgerloom.plans import statement

LONG = "This statement lists every single movement of the account"
CUR, DATE = (45, 200, "CURRENCY:"), (45, 252, "01/01/2022")


def text(y, s):
    return [(45 + 40 * i, y, t) for i, t in enumerate(s.split(" "))]


@pytest.fixture(scope="module")
def results(spark, make_words):
    words = make_words({
        ("good", 1): text(50, "Account Summary") + text(60, LONG) + [CUR, DATE],
        ("short", 1): text(50, "Account Summary") + [CUR, DATE],
        ("plain", 1): text(50, "Nothing special") + text(60, LONG) + [CUR, DATE],
        ("both", 1): text(50, "Hi") + [CUR, DATE],
        ("split-header", 1): text(50, "Transaction") + text(60, "Details " + LONG) + [CUR, DATE],
        ("lower", 1): text(50, "account summary " + LONG) + [CUR, DATE],
        ("pages", 1): text(50, "Transaction Details " + LONG),
        ("pages", 3): [CUR, DATE, (45, 270, "01/01/2022"), (113, 270, "Balance"), (160, 270, "Brought"), (220, 270, "Forward")],
    })
    names = ["good", "short", "plain", "both", "split-header", "lower"]
    docs = spark.createDataFrame([*[(n, 1) for n in names], ("pages", 4), ("empty", 0), ("no-words", 1)], "doc_id string, n_pages int")
    return {r.doc_id: r for r in statement.document_results(docs, words).collect()}


def test_confidence(results):
    got = {d: round(r.confidence, 6) for d, r in results.items()}
    assert got == {
        "good": 1.0, "short": 0.5, "plain": 0.7, "both": 0.35, "split-header": 0.7, "lower": 0.7,
        "pages": 1.0, "empty": 0.0, "no-words": 0.35,
    }


def test_warnings_in_order(results):
    assert results["both"].warnings == [
        "Insufficient text content - possible OCR needed", "Expected headers not found",
    ]
    assert results["pages"].warnings == [] and results["pages"].n_warnings == 3
    assert (results["both"].n_warnings, results["empty"].n_warnings, results["no-words"].n_warnings) == (2, 1, 3)
    assert results["good"].warnings == [] and results["good"].n_warnings == 0


def test_outcome(results):
    empty = results["empty"]
    assert (empty.success, empty.warnings, empty.abort_reason) == (False, ["Empty document"], "Document integrity check failed")
    assert results["pages"].success and results["pages"].transaction_count == 1  # the forward row does not count


def test_aborts_override(spark, make_words):
    words = make_words({("a", 1): text(50, "Account Summary " + LONG) + [CUR, DATE]})
    docs = spark.createDataFrame([("a", 1)], "doc_id string, n_pages int")
    aborts = spark.createDataFrame([("a", "Multiple conflicting totals")], "doc_id string, abort_reason string")
    r = statement.document_results(docs, words, aborts).first()
    assert (r.success, r.confidence, r.transaction_count, r.abort_reason) == (False, 0.0, 0, "Multiple conflicting totals")


def test_reasons_to_abort(spark):
    totals = spark.createDataFrame([("a", True), ("b", False)], "doc_id string, conflict boolean")
    anomalies = spark.createDataFrame([("c", 7, "missing"), ("c", 3, "surplus"), ("a", 2, "missing")], "doc_id string, page int, anomaly string")
    got = {r.doc_id: r.abort_reason for r in audit.aborted(totals, anomalies).collect()}
    assert got == {"a": "Multiple conflicting totals", "c": "Failed to extract transactions from page 3"}
    assert {r.doc_id for r in audit.aborted(anomalies=anomalies).collect()} == {"a", "c"}


def test_long_documents_have_one_result_row(spark, make_words):
    words = make_words({("long", 1): text(50, "Account Summary " + LONG), **{("long", p): [CUR, DATE] for p in (2, 3, 5)}})
    docs = spark.createDataFrame([("long", 1_500)], "doc_id string, n_pages int")
    got = statement.document_results(docs, words).collect()
    assert [(r.warnings, r.n_warnings, r.transaction_count) for r in got] == [([], 1_497, 3)]
    told = statement.page_warnings(docs, words).orderBy("page").collect()
    assert len(told) == 1_497 and told[0].message == "Could not find transaction table on page 1"
    assert (told[1].page, told[1].message) == (4, "No text found on page 4")
    assert len(audit.decisions(statement.document_results(docs, words), spark.createDataFrame([], "doc_id string, n_breaks long, n_unverifiable long, n_one_side long")).collect()) == 1


def test_rejected_words_leave_in_both_branches(spark, make_words):
    good = make_words({("a", 1): [CUR, DATE, (512, 252, "1.00")], ("b", 1): [CUR, DATE]})
    fields = good.schema
    nan = float("nan")
    bad = spark.createDataFrame([
        ("a", None, 9, 1.0, 1.0, 1.0, 1.0, "x", 0, 0, 0), ("a", 1, 9, 1.0, nan, 1.0, 1.0, "x", 0, 0, 0),
        ("a", 1, 9, None, 1.0, 1.0, 1.0, "x", 0, 0, 0), (None, 1, 9, 1.0, 1.0, 1.0, 1.0, "x", 0, 0, 0),
    ], fields)
    words = good.unionByName(bad)
    assert sorted(r.reason for r in guard.rejected_words(words).collect()) == ["no document", "no page", "no position", "no position"]
    plain, large, clean = (sorted(map(str, statement.transactions(w, floor=f).collect())) for w, f in ((words, 10**9), (words, 1), (good, 10**9)))
    assert plain == large == clean and clean
    failed = audit.aborted(rejected=guard.rejected_words(words)).collect()
    assert [tuple(r) for r in failed] == [("a", "3 malformed words")]


def test_page_text_breaks_lines(make_words):
    words = make_words({("t", 1): text(50, "Account Summary") + text(60, "next line")})
    assert guard.page_text(words).first().page_text == "Account Summary\nnext line"


def test_guard_texts_strips_and_survives_null(spark):
    df = spark.createDataFrame([(1, " " * 60 + "Account Summary"), (2, None), (3, "Transaction Details" + "x" * 50)], "doc_id int, text string")
    got = {r.doc_id: r.confidence for r in guard.guard_texts(df).collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {1: 0.5, 2: 0.35, 3: 1.0}


def test_entropy(spark):
    df = spark.createDataFrame([(1, "aabb"), (2, ""), (3, None), (4, "aaaa"), (5, "abc"), (6, "ab"), (6, "cd")], "doc_id int, text string")
    got = {r.doc_id: r.entropy for r in guard.text_entropy(df).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: round(math.log2(3), 6), 6: 2.0}


def test_route_and_templates(spark):
    results = spark.createDataFrame([("a", True, 1.0), ("b", True, 0.7), ("c", False, 0.0)], "doc_id string, success boolean, confidence double")
    assert {r.doc_id: r.route for r in guard.route(results).collect()} == {"a": "deterministic", "b": "fallback", "c": "fallback"}
    bounds = spark.createDataFrame(
        [("a", 3, 364.3, 440.1, None, 502.6), ("b", 3, 363.0, 441.0, None, 503.0), ("c", 1, None, None, None, 502.6)],
        "doc_id string, n_clusters int, withdrawal_x double, deposit_x double, amount_x double, balance_x double",
    )
    prints = guard.fingerprints(bounds)
    by = {r.doc_id: r.fingerprint for r in prints.collect()}
    assert by["a"] == by["b"] != by["c"]
    known = prints.filter(F.col("doc_id") == "a").select("fingerprint", F.lit("T").alias("template"))
    assert {r.doc_id: r.template for r in guard.match_templates(prints, known).collect()} == {"a": "T", "b": "T", "c": None}


def test_results_look_at_the_words_once_beside_the_pages(spark, make_words):
    """Flags of the first page and damage come from one look, and are those of two."""
    from ledgerloom.operators import guard
    from pyspark.sql import functions as F

    long = "Consolidated statement of all deposits and payments"
    words = make_words({
        ("a", 1): [(10, 10, "Account"), (60, 10, "Summary"), (10, 30, long)], ("a", 2): [(10, 10, "x"), (10, 30, "y")],
        ("b", 1): [(10, 10, "short")], ("b", 2): [(10, 10, "Account"), (60, 10, "Summary"), (10, 30, long)],
        ("c", 2): [(10, 10, long)], ("d", 1): [(10, 10, long)], ("e", 2): [(10, 10, "z")],
    })
    spoilt = words.withColumn("y0", F.when(F.col("doc_id").isin("b", "d", "e") & (F.col("page") == F.when(F.col("doc_id") == "d", 1).otherwise(2)), F.lit(float("nan"))).otherwise(F.col("y0")))
    spoilt = spoilt.unionByName(spoilt.filter("doc_id = 'a'").withColumn("doc_id", F.lit(None).cast("string")))
    spoilt = spoilt.withColumn("text", F.when(~((F.col("doc_id") == "a") & (F.col("text") == "y")) | F.col("doc_id").isNull(), F.col("text")))
    want = guard.first_page_flags(spoilt).join(guard.damaged(spoilt), "doc_id", "full").filter("doc_id is not null")
    key = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    assert key(guard.first_page_and_damage(spoilt)) == key(want)
    documents = spark.createDataFrame([(c, 2) for c in "abcde"], "doc_id string, n_pages int")
    pages = spark.createDataFrame([("a", 1, False, False)], "doc_id string, page int, has_table boolean, is_txn boolean")
    plan = guard.document_results(documents, spoilt, pages)._jdf.queryExecution().analyzed().toString()
    assert plan.count("collect_list") == 1 and "malformed words" in plan
    leaves = spoilt._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert guard.document_results(documents, spoilt, pages)._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= leaves + 3
