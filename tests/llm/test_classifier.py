import numpy as np
from ledgerloom.llm import classifier
from ledgerloom.sources.scratch import stored
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_isolation(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    stats = stored(classifier.described(docs.withColumn("stats", F.lit("clash"))), "statistics")
    rows = classifier.scored(stats, classifier.fit(stats, labels)).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.95
    # Labels of held-out rows change nothing.
    wrong = labels.withColumn("quality", F.when(classifier.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = classifier.scored(stats, classifier.fit(stats, wrong)).join(labels, "doc_id").where("held_out").collect()
    assert {r.doc_id: round(r.score, 9) for r in rows} == {r.doc_id: round(r.score, 9) for r in again}


def test_isotonic_against_the_definition():
    rng = np.random.default_rng(0)
    y, w = rng.random(12), rng.integers(1, 5, 12).astype(float)
    got = classifier.isotonic(y, w)
    # max over starts of min over ends of the weighted means: the known closed form
    mean = lambda a, b: np.average(y[a : b + 1], weights=w[a : b + 1])
    want = [max(min(mean(a, b) for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
    assert np.allclose(got, want) and (np.diff(got) >= 0).all()


def test_fold_is_crc32(spark):
    import zlib

    got = spark.range(50).select("id", classifier.fold(F.col("id")).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)


def test_nulls_long_texts_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, None), (None, "text"), (2, ""), (3, "word " * 60_000), (3, "word")], "doc_id long, text string")
    stats = stored(classifier.described(docs), "statistics")
    none = spark.createDataFrame([], "doc_id long, quality int")
    for labels, score in ((none, 0.5), (spark.createDataFrame([(1, 1), (2, None), (None, 0)], none.schema), None)):
        rows = classifier.scored(stats, classifier.fit(stats, labels)).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows) and not any(r.held_out for r in rows if r.doc_id is None)
        if score is not None:
            assert all(abs(r.score - score) < 0.01 for r in rows)
    assert classifier.scored(stats.limit(0), classifier.fit(stats.limit(0), none)).count() == 0
