"""A third of all rows under one key: the spread paths must give the ordinary results."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerloom.functions import ordered
from ledgerloom.functions.ordered import prefix_scan, split_by_size
from ledgerloom.operators import geometry as G, ledger as L
from ledgerloom.plans import statement
from ledgerloom.schemas import TABLE_END_MARKERS
from ledgerloom.sources import rendered as R


@pytest.fixture(scope="module")
def skewed_dir(spark, sf, tmp_path_factory):
    """The given tables with a third of all orders moved to one customer."""
    out = str(tmp_path_factory.mktemp("skewed"))
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    hot = F.when(F.col("o_orderkey") % 3 == 0, F.lit(1).cast("bigint")).otherwise(F.col("o_custkey"))
    orders.withColumn("o_custkey", hot).write.parquet(f"{out}/orders.parquet")
    spark.read.parquet(f"{sf}/customer.parquet").write.parquet(f"{out}/customer.parquet")
    return out


def same(a, b):
    columns = sorted(a.columns)
    assert sorted(b.columns) == columns
    left, right = (sorted(map(str, df.select(columns).collect())) for df in (a, b))
    assert left == right and left


def test_only_the_hot_key_is_split_off(spark, skewed_dir):
    orders = spark.read.parquet(f"{skewed_dir}/orders.parquet")
    ordinary, large, _ = split_by_size(orders, "o_custkey", share=0.1, floor=100)
    assert {r[0] for r in large.select("o_custkey").distinct().collect()} == {1}
    assert ordinary.count() + large.count() == orders.count()
    assert split_by_size(orders, "o_custkey").large is None


def test_the_limit_does_not_grow_and_long_key_lists_are_joined(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") % 10).alias("k"))
    assert split_by_size(df, "k", floor=99).large.count() == 1000 and split_by_size(df, "k", floor=100).large is None
    monkeypatch.setattr(ordered, "BROADCAST_KEYS", 3)
    ordinary, large, _ = split_by_size(df.unionByName(spark.createDataFrame([(77,)], "k long")), "k", floor=99)
    assert large.count() == 1000 and ordinary.count() == 1


def test_rows_without_key_stay(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (None,), (None,), (2,)], "k int")
    ordinary, large, _ = split_by_size(df, "k", share=0.0, floor=1)
    assert large.count() == 3 and sorted(str(r[0]) for r in ordinary.collect()) == ["2", "None", "None"]


def test_learned_profiles(spark, skewed_dir):
    words = R.words(spark, skewed_dir)
    profile = spark.createDataFrame(
        [(i, 364.0, 440.0, 1000.0) for i in (1, 2, 3)], "doc_id long, withdrawal_x double, deposit_x double, balance_x double")
    a = statement.transactions(words, profile=profile, floor=10**9)
    same(a, statement.transactions(words, profile=profile, share=0.1, floor=100))
    assert a.filter("doc_id = 1 and balance is not null and not reclassified").count() == 0


def test_one_pass_extraction(spark, skewed_dir):
    words = R.words(spark, skewed_dir)
    want = statement.transactions(words, floor=10**9)
    for sizes in ({"floor": 10**9}, {"share": 0.1, "floor": 100}):
        same(want, statement.extract(words, **sizes)[0])


def test_ledger(spark, skewed_dir):
    plain = R.ledger(spark, skewed_dir, floor=10**9)
    same(plain, R.ledger(spark, skewed_dir, share=0.1, floor=100))
    assert plain.filter("doc_id = 1").count() > plain.count() / 4


def test_extraction(spark, skewed_dir):
    words = R.words(spark, skewed_dir)
    same(statement.transactions(words, floor=10**9), statement.transactions(words, share=0.1, floor=100))


def test_results(spark, skewed_dir):
    words, docs = R.words(spark, skewed_dir), R.documents(spark, skewed_dir)
    same(statement.document_results(docs, words, floor=10**9), statement.document_results(docs, words, share=0.1, floor=100))


def test_carried_pages(spark, skewed_dir):
    words = R.words(spark, skewed_dir)
    same(
        statement.transactions(words, carry_pages=True, floor=10**9),
        statement.transactions(words, carry_pages=True, share=0.1, floor=100),
    )


def test_one_overfull_page(make_words):
    rnd = random.Random(11)
    items = [(rnd.randrange(600), rnd.randrange(4000) * 0.25, f"w{i}") for i in range(3000)]
    words = make_words({("hot", 1): items, **{(f"d{n}", 1): items[:5] for n in range(20)}})
    typed = G.type_words(words)
    columns = ["doc_id", "page", "line_y", "line_text"]
    same(G.greedy_lines(typed).select(columns), G.greedy_lines(typed, spread=True).select(columns))


def overfull(make_words, n=1_500):
    """One page of several bands: rows with following lines, currency lines and an end marker far down, y values also above the page."""
    rnd = random.Random(5)
    items, y = [], -40.0
    for i in range(n):
        y += rnd.choice([0.5, 4.0, 9.0, 30.0])
        kind = rnd.random()
        if i == 30:
            items += [(300, y, "CURRENCY:"), (330, y, "INR")]
        elif i == n - 200:
            items += [(50, y, TABLE_END_MARKERS[0])]
        elif kind < 0.4:
            items += [(45, y, f"{i % 27 + 1:02d}/01/2024"), (120, y, f"w{i}"), (374, y, f"{i}.00"), (512, y, "5,000.00")]
        else:
            items.append((120, y, f"more{i}"))
    return make_words({("hot", 1): items, ("hot", 2): items[:90], ("hot", 3): [(50, 10, "none")], ("cold", 1): items[:60]})


def test_rows_of_an_overfull_page(make_words):
    words = overfull(make_words)
    for carry in (False, True):
        plain, spread = (statement.segmented_lines(words, spread=s, carry_pages=carry) for s in (False, True))
        columns = ["doc_id", "page", "line_y", "line_text", "has_table", "in_table", "opens", "row_in_page"]
        same(plain.select(columns).withColumn("row_in_page", F.col("row_in_page").cast("long")),
             spread.select(columns).withColumn("row_in_page", F.col("row_in_page").cast("long")))
        assert spread.agg(F.max("row_in_page")).first()[0] > 300


def test_no_task_orders_a_page(make_words):
    """On the large path every window has a band or block of the page among its keys, or runs over one row per band."""
    words = overfull(make_words, 400)
    for df in (statement.segmented_lines(words, spread=True), G.key_lines_spread(words)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert windows and all("_band" in w or "_block" in w for w in windows)


def test_ordered_checks(spark, skewed_dir):
    ledger = R.ledger(spark, skewed_dir)
    same(L.balance_continuity(ledger), L.balance_continuity(ledger, block=16))
    same(L.rebuild_balance(ledger), L.rebuild_balance(ledger, block=16))


def test_prefix_scan_depths(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("aab"), rnd.choice([None, 0, 1, 2, 3]), rnd.randrange(50), i, rnd.randrange(-9, 9)) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, day int, num int, id int, v int").withColumn("b", F.floor(F.col("num") / 10))
    w = W.partitionBy("k").orderBy("day", "b", "num", "id").rowsBetween(W.unboundedPreceding, 0)
    plain = df.select("*", F.sum("v").over(w).alias("s"), F.count(F.lit(1)).over(w).alias("n"))
    values = {"s": F.col("v"), "n": F.lit(1).cast("bigint")}
    for levels in (["day", "b", "num", "id"],):
        same(plain, prefix_scan(df, "k", levels, values))


def test_running_totals_of_rows_without_a_key(spark):
    """A null key is one key whatever the block size."""
    rows = spark.createDataFrame([(k, i, 1) for k in (None, "a") for i in range(1, 7)], "k string, i long, v int")
    for block in (1, 2, 4, 100):
        got = ordered.running_total(rows, "k", "i", {"t": F.col("v")}, block)
        assert sorted((r.k or "", r.i, r.t) for r in got.collect()) == sorted((k or "", i, i) for k in (None, "a") for i in range(1, 7))


def test_tasks_get_so_many_rows_at_any_size(spark, monkeypatch):
    """Ordinary rows are hashed into partitions that follow their number, not the settings of the session."""
    from ledgerloom.functions import ordered

    monkeypatch.setattr(ordered, "TASK_ROWS", 1000)
    df = spark.range(40_000).selectExpr("id % 4000 as k", "id")
    part = ordered.split_by_size(df, "k", hash_ordinary=True).ordinary
    assert part.rdd.getNumPartitions() == 40 and part.count() == 40_000
    assert max(len(p) for p in part.select("id").rdd.glom().collect()) < 2000
    assert ordered.hashed(df, 3000, "k").rdd.getNumPartitions() <= 4


def test_rendered_words_do_not_move_again(spark, sf, monkeypatch):
    """Rendered words are hashed as their extraction wants them: it adds no exchange, and its partitions follow their number."""
    import re

    from ledgerloom.functions import ordered
    from ledgerloom.plans import catalog
    from ledgerloom.sources import rendered as R

    def moves(df):
        return re.findall(r"Exchange hashpartitioning\(doc_id#\d+L?, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())

    want = sorted(map(str, catalog.parse_roundtrip(spark, sf).collect()))
    monkeypatch.setattr(ordered, "TASK_ROWS", 2000)
    n = R.word_counts(spark, sf).agg({"n": "sum"}).first()[0]
    assert moves(catalog.parse_roundtrip(spark, sf)) == moves(R.words(spark, sf)) == [str(-(-n // 2000))] * 2
    assert sorted(map(str, catalog.parse_roundtrip(spark, sf).collect())) == want
