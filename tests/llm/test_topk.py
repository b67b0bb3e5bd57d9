import random

import pytest
from ledgerloom.llm import topk
from pyspark.sql import functions as F


def brute(rows, asking, k):
    out = {}
    for q, v in asking.items():
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)[:k]
        out[q] = [(i, -s) for s, i in found]
    return out


@pytest.mark.parametrize(("pivots", "block", "queries"), [(4, 7, 3), (1, 1_000, 256), (64, 16, 8)])
def test_search_against_brute_force(spark, pivots, block, queries):
    rnd = random.Random(pivots)
    rows = [(i, [float(rnd.randrange(-9, 10)) for _ in range(5)]) for i in range(180)]
    rows += [(1_000 + i, rows[3][1]) for i in range(60)] + [(2_000, []), (2_001, [3.0]), (50, rows[3][1])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    asking = df.where("id % 10 = 0").groupBy("id").agg(F.min("v").alias("v"))
    got = {}
    for r in topk.search(df, asking, 4, pivots, block, queries).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    pad = [(i, v + [0.0] * (5 - len(v))) for i, v in rows]
    want = brute(pad, {q: min(v for i, v in rows if i == q) + [0.0] * 5 for q in {i for i, _ in rows if i % 10 == 0}}, 4)
    assert got == want


def test_whole_numbers_nulls_and_non_finite_values(spark):
    rows = [(1, [0.5, -0.001]), (2, [None, 1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (1, [0.5, -0.001])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1))
    assert [tuple(r) for r in topk.prepared(df, "vec_id", "embedding", 256).collect()] == [(1, [128.0, -1.0])]


def test_few_rows_large_values_and_empty(spark):
    big = 2.0**29
    df = spark.createDataFrame([(1, [big, 1.0]), (2, [big, 3.0])], "id long, v array<double>")
    got = topk.search(df, df.where("id = 1"), 5).collect()
    assert [tuple(r) for r in got] == [(1, 1, 2, 2**58 + 3)]
    assert topk.search(df.limit(0), df.limit(0), 5).count() == 0


@pytest.mark.parametrize("large", [1.0, 3_000.0, 2.0**26])
def test_small_cells_copies_and_large_values(spark, monkeypatch, large):
    """Many cells, parts and blocks, more blocks than are held, ties in a group of copies, products of each type beside each other."""
    for name, value in (("CELL", 16), ("HELD", 2), ("PART_CELLS", 2), ("TASKS", 1)):
        monkeypatch.setattr(topk, name, value)
    rnd = random.Random(int(large))
    rows = [(i, [float(rnd.randrange(-9, 10)) * (large if i % 7 == 0 else 1.0) for _ in range(4)]) for i in range(150)]
    rows += [(1_000 - i, rows[70][1]) for i in range(90)] + [(2_000, rows[3][1]), (2_000, rows[4][1])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    asking = df.where("id % 5 = 0").groupBy("id").agg(F.min("v").alias("v"))
    got = {}
    for r in topk.search(df, asking, 6, 8, 5, 7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute(rows, {q: min(v for i, v in rows if i == q) for q in {i for i, _ in rows if i % 5 == 0}}, 6)


def test_neither_vectors_nor_queries_are_shuffled_for_each_other(spark):
    """Only results move: with joins by key every annulus was sent once for each block of queries."""
    rows = [(i, [float(i % 7), float(i % 11)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = topk.search(df, df.where("id % 9 = 0"), 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(moved) == 1 and "hashpartitioning(query_id" in moved[0] and "Join" not in plan
