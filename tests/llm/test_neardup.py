import random

import brute
import numpy as np
import pytest
from ledgerloom.llm import neardup
from ledgerloom.llm.components import components
from pyspark.sql import functions as F


def as_sets(texts, k=4):
    raw = [t.encode() for t in texts]
    return neardup.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64), k)


def docs_():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("aeioulnrst") for _ in range(rnd.randrange(1, 6)))
    out, n = {}, 0
    for _ in range(12):
        base = [word() for _ in range(rnd.choice([3, 4, 30, 80]))]
        for _ in range(rnd.randrange(1, 9)):  # a chain: neighbours are close, ends need not be
            if len(base) > 4 and rnd.random() < 0.8:
                base[rnd.randrange(len(base))] = word()
            out[n] = rnd.choice([" ", "\n", "\t "]).join(base).upper() if rnd.random() < 0.5 else " ".join(base)
            n += 1
    return {**out, n: None, n + 1: "", n + 2: " \n ", n + 3: "É é", n + 4: "é É", n + 5: "w " * 40_000, n + 6: "w " * 39_999}


@pytest.mark.parametrize("members", [128, 3])
def test_components_against_brute_force(spark, monkeypatch, members):
    monkeypatch.setattr(neardup, "MEMBERS", members)
    df = spark.createDataFrame(list(docs_().items()), "doc_id long, text string").withColumn("node", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.groups(df).collect()}
    assert got == brute.components(docs_())


def test_open_groups_find_what_centres_miss(spark):
    """All members in one group, none linked before: the comparison alone must find every link."""
    texts = {d: t for d, t in docs_().items() if t and len(t.split()) > 4 and len(t) < 10_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    drawn = neardup.sketches(df)
    nodes = drawn.select(F.col("doc_id").alias("node"), "n", F.col("doc_id").alias("component"), "regs", F.expr("transform(bands, x -> 1L)").alias("bands"))
    sets = neardup._sets(df, nodes, 4)
    rest = nodes.join(sets, "node").withColumns({"value": F.lit(7), "band": F.lit(0), "size": F.lit(len(texts))})
    found = neardup._within_open(rest, 80, 0.62).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).collect()
    sets_ = {d: brute.shingles(t, 4) for d, t in texts.items()}
    want = {(a, b) for a in texts for b in texts if b < a and 100 * len(sets_[a] & sets_[b]) >= 80 * len(sets_[a] | sets_[b])}
    assert {tuple(r) for r in found} == want and want


def test_null_ids_repeated_rows_and_empty(spark):
    text = "one two three four five six"
    df = spark.createDataFrame([(None, text), (3, text), (3, text), (2, text)], "doc_id long, text string").withColumn("n", F.lit(0))
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in neardup.groups(df).collect())
    assert got == [(-1, None, True), (2, 2, True), (3, 2, False), (3, 2, False)]
    assert sorted(r.doc_id or -1 for r in neardup.deduplicated(df).collect()) == [-1, 2] and neardup.deduplicated(df).columns == df.columns
    assert neardup.groups(df.limit(0)).count() == 0


def test_sketches_merge_and_estimate():
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(4_000)]
    for share in (0.3, 0.6, 0.8, 0.95):
        n = 1_500
        both = int(2 * n * share / (1 + share))
        rnd.shuffle(words)
        # one-word shingles: the similarity is known exactly
        a, b = words[:n], words[n - both : 2 * n - both]
        sa, sb, union = as_sets([" ".join(a), " ".join(b), " ".join({*a, *b})], 1)
        ra, rb, ru = (neardup.registers([s])[0] for s in (sa, sb, union))
        assert (neardup.merged(ra, rb) == ru).all()
        j = len(np.intersect1d(sa, sb)) / len(union)
        est = neardup.likelihood(np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]), np.array([(ra == rb).sum()]), np.array([len(sa)]), np.array([len(sb)]))[0]
        assert abs(est - j) < 0.13 < neardup.MARGIN


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{200 + i: 100 for i in range(30)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_texts_under_one_id_stay_or_go_by_themselves(spark):
    text, other = (" ".join(f"{w}{i}" for i in range(30)) for w in ("a", "b"))
    rows = [(1, text), (2, text), (2, other), (4, other + " more"), (5, "short text of five words"), (5, "short text of five words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in neardup.deduplicated(df).collect()]
    assert sorted(t[:1] for _, t in got) == ["a", "b", "s"] and (1, text) in got


def test_two_texts_under_one_id_keep_the_links_of_both(spark):
    x, y = (" ".join(f"{w}{i}" for i in range(30)) for w in ("x", "y"))
    for low in (0, 2**63 - 10):
        rows = [(low + 1, x), (low + 1, y), (low + 2, x + " more"), (low + 3, y + " more"), (low + 4, "alone in the world of texts"), (None, x)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in neardup.groups(df).collect())
        own = [(low + 1, low + 1, True)] * 2 + [(low + 2, low + 1, False), (low + 3, low + 1, False), (low + 4, low + 4, True)]
        assert got == sorted([(0, 0, True), *own])


def test_one_stranger_costs_one_pass_over_a_large_component(spark):
    n = 5_000
    members = spark.range(n + 3).select(F.lit(7).alias("value"), "id", F.col("id").alias("node"), F.when(F.col("id") < n, 0).otherwise(F.col("id")).cast("long").alias("component"))
    parts, meetings = neardup._blocks(members.drop("id"))
    per = {(r.own, r.component): r.n_blocks for r in parts.collect()}
    blocks = round(n / neardup.MEMBERS)
    assert per == {(True, 0): blocks, **{(False, n + i): 1 for i in range(3)}}
    met = meetings.collect()
    assert sum(r.block.own for r in met) == blocks  # every block of the large component is sent once
    assert sum(not r.block.own for r in met) == blocks + 1  # the strangers to each of them, and to each other


def test_clashing_names_stay(spark):
    text = "one two three four five six"
    df = spark.createDataFrame([(1, text, "a", 1), (2, text, "b", 2)], "doc_id long, text string, __id string, __row int")
    assert [tuple(r) for r in neardup.deduplicated(df).collect()] == [(1, text, "a", 1)]
