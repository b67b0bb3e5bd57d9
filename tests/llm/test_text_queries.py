"""Registered queries against their SQL; the others and the pipeline against plain Python."""

import zlib
from collections import Counter

import brute
import corpus_pipeline
import duckdb
import numpy as np
import pytest
import sentencepiece
from ledgerloom.llm import oracle, queries
from ledgerloom.sources.scratch import stored
from tools.check_queries import canonical

TEXT_TABLES = ("documents", "embeddings", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TEXT_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(oracle.ORACLE[name])
    columns = [c[0] for c in res.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == canonical(columns, res.fetchall()) and got


def test_near_duplicate_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op3_near_duplicates"](spark, sf).collect()}
    assert got == brute.components(docs)


def test_every_operator_has_a_query_over_all_rows(spark, sf):
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op5_fourier_quality", "op6_piece_encoding", "op9_temperature_mix", "op10_token_store", "op13_gray_simhash"):
        assert queries.QUERIES[name](spark, sf).count() == n


def test_pipeline_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {d: q["clean"] for d, q in ((d, brute.quality(t)) for d, t in texts.items()) if q["kept"]}
    steps = [want := want, want := brute.line_cleaned(want, corpus_pipeline.COPIED)]
    want = {d: want[d] for d, (_, c) in brute.components(want, corpus_pipeline.SHINGLE).items() if c == d}
    at = docs
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:3], (*steps, want), strict=True):
        at = stored(stage(spark, at, sf), "stage")
        assert at.columns == docs.columns
        assert {r.doc_id: (r.text, r.n_chars) for r in at.collect()} == {d: (t, len(t)) for d, t in expected.items()}, name
    mixed = stored(corpus_pipeline.STAGES[3][1](spark, at, sf), "stage")
    copies = Counter(r.doc_id for r in mixed.collect())
    assert set(copies) == set(want) and max(copies.values()) <= 2 and len(want) < sum(copies.values()) < 1.3 * len(want)
    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    rows = corpus_pipeline.STAGES[4][1](spark, mixed, sf).collect()
    assert Counter(r.doc_id for r in rows) == copies
    for r in rows:
        assert r.ids == library.encode(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.round_trip


def test_pipeline_on_an_empty_table(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
