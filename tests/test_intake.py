import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.plans import statement
from ledgerloom.sources import rendered as R
from ledgerloom.sources.scratch import new_path, stored
from ledgerloom.streaming import intake

LONG = T.LongType()


@pytest.fixture(autouse=True)
def _few_buckets(monkeypatch):
    monkeypatch.setattr(intake, "BUCKETS", 6)


def rows(df):
    return sorted(map(str, df.select("doc_id", "txn_seq", "description", "balance").collect()))


def deliver(words, source):
    words.repartition(4, "doc_id").write.mode("append").parquet(source)


def test_deliveries_repeats_and_corrections(spark, sf):
    source, store = new_path(spark, "delivered"), new_path(spark, "store")
    words = R.words(spark, sf)
    want = statement.transactions(words)
    assert intake.current_ledger(spark, store, LONG).count() == 0

    deliver(words.filter("doc_id < 100"), source)
    intake.run_available(spark, source, store, LONG)
    assert rows(intake.current_ledger(spark, store, LONG)) == rows(want.filter("doc_id < 100"))

    # The same documents again, with new ones: nothing is counted twice.
    deliver(words.filter("doc_id < 120"), source)
    intake.run_available(spark, source, store, LONG)
    assert rows(intake.current_ledger(spark, store, LONG)) == rows(want.filter("doc_id < 120"))
    seen = intake.deliveries(spark, store, LONG)
    assert seen.count() == seen.select("doc_id").distinct().count()

    # A changed document replaces its earlier rows.
    changed = words.filter("doc_id = 5").withColumn("text", F.regexp_replace("text", "^(ATM|GIRO|PAYNOW|SALARY)$", "CHANGED"))
    deliver(changed, source)
    intake.run_available(spark, source, store, LONG)
    current = intake.current_ledger(spark, store, LONG)
    assert rows(current.filter("doc_id = 5")) == rows(statement.transactions(changed))
    assert rows(current.filter("doc_id <> 5")) == rows(want.filter("doc_id < 120 and doc_id <> 5"))


def test_repeated_batch_overwrites_itself(spark, sf):
    store = new_path(spark, "store")
    words = R.words(spark, sf).filter("doc_id < 30")
    for _ in range(2):
        intake.take_batch(words, 0, store, LONG)
    assert rows(intake.current_ledger(spark, store, LONG)) == rows(statement.transactions(words))


def test_parts_of_documents_meet_in_any_order(spark, sf):
    """Pages of a document come in three batches, one page twice and one page wrong at first."""
    store = new_path(spark, "store")
    words = stored(R.words(spark, sf).filter("doc_id < 40"), "words")
    want = rows(statement.transactions(words))
    spoilt = words.filter("page = 2").withColumn("text", F.concat("text", F.lit("!")))
    intake.take_batch(words.filter("page > 2").unionByName(spoilt), 0, store, LONG)
    assert rows(intake.current_ledger(spark, store, LONG)) != want
    intake.take_batch(words.filter("page = 1 or page = 3"), 1, store, LONG)
    for _ in range(2):  # a repeated batch gives the same
        intake.take_batch(words.filter("page = 2"), 2, store, LONG)
        assert rows(intake.current_ledger(spark, store, LONG)) == want


def test_documents_wait_until_complete(spark, sf):
    store = new_path(spark, "store")
    words = stored(R.words(spark, sf).filter("doc_id < 40"), "words")
    expected = words.groupBy("doc_id").agg(F.count_distinct("page").alias("n_pages"))
    intake.take_batch(words.filter("page > 1 and doc_id % 2 = 0 or doc_id % 2 = 1"), 0, store, LONG, expected=expected)
    want = statement.transactions(words)
    assert rows(intake.current_ledger(spark, store, LONG)) == rows(want.filter("doc_id % 2 = 1"))
    held = {r.doc_id: r.n_pages - r.n_seen for r in intake.waiting(spark, store, expected, LONG).collect()}
    assert held and set(held.values()) == {1} and all(d % 2 == 0 for d in held)
    intake.take_batch(words.filter("page = 1 and doc_id % 2 = 0"), 1, store, LONG, expected=expected)
    assert rows(intake.current_ledger(spark, store, LONG)) == rows(want) and intake.waiting(spark, store, expected, LONG).count() == 0


def test_state_is_compacted_and_a_batch_reads_its_buckets(spark, sf, monkeypatch):
    monkeypatch.setattr(intake, "COMPACT_EVERY", 2)
    store = new_path(spark, "store")
    words = stored(R.words(spark, sf).filter("doc_id < 20"), "words")
    for n, part in enumerate(("page = 1", "page = 2", "page = 3", "page > 3 or page = 2")):
        intake.take_batch(words.filter(part), n, store, LONG)
    assert intake._numbers(spark, f"{store}/state", "upto") == [1, 3]
    assert rows(intake.current_ledger(spark, store, LONG)) == rows(statement.transactions(words))
    one = intake.pages_before(spark, store, LONG, 4, [5])
    assert "bucket" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("PushedFilters")[0]
    every = intake.pages_before(spark, store, LONG, 4)
    assert every.count() == words.select("doc_id", "page").distinct().count()
    # Looking back from an earlier batch, a later state is not seen.
    assert intake.pages_before(spark, store, LONG, 1).select("page").distinct().collect() == [(1,)]


def test_a_batch_without_repeated_pages_joins_no_words(spark, sf, monkeypatch):
    """Without unchanged pages and expected counts, words reach extraction without meeting a list of pages or documents."""
    plans, found = [], statement.transactions
    monkeypatch.setattr(statement, "transactions", lambda words, **o: (plans.append(words._jdf.queryExecution().executedPlan().toString()), found(words, **o))[1])
    words, store = R.words(spark, sf).filter("doc_id < 20"), new_path(spark, "store")
    intake.take_batch(words, 0, store, LONG)
    assert "Join" not in plans[0]
    assert rows(intake.current_ledger(spark, store, LONG)) == rows(found(words))
