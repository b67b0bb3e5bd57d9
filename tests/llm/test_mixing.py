import math
from collections import Counter, defaultdict

import pytest
from ledgerloom.llm import mixing
from ledgerloom.sources.scratch import stored
from pyspark.sql import functions as F


def docs(spark):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 3 == 0 else f"s{i % 20}", "x") for i in range(900)]
    return spark.createDataFrame([*rows, (9_000, None, "big", "x"), (9_001, "a b", None, "x"), (9_002, "", "s1", "x")], "doc_id long, text string, source string, copies string")


def shares(rows):
    t = Counter()
    for r in rows:
        t[r.source] += r.n_tokens * r.copies
    return t


def test_words(spark):
    df = spark.createDataFrame([("",), (None,), (" a  b\n",), ("a b\tc",)], "t string")
    assert [r[0] for r in df.select(mixing.word_count(F.col("t"))).collect()] == [0, 0, 2, 2]


@pytest.mark.parametrize("entropy", [0.9, 0.97])
def test_target_entropy_and_budget(spark, entropy):
    rows = mixing.decisions(docs(spark), budget_share=1.5, entropy=entropy).collect()
    assert len(rows) == 903
    t = shares(rows)
    total = sum(t.values())
    h = -sum(v / total * math.log(v / total) for v in t.values() if v) / math.log(len(t))
    assert abs(h - entropy) < 0.02
    want = 1.5 * sum(r.n_tokens for r in rows)
    assert abs(total - want) < 0.02 * want


def test_repetition_limit_drops_nothing(spark):
    df = docs(spark)
    copies = Counter(r.doc_id for r in mixing.mixed(df, repetition=1.5).collect())
    assert set(copies) == {r.doc_id for r in df.collect()} and set(copies.values()) == {1, 2}
    rows = [r for r in mixing.decisions(df, repetition=1.5).collect()]
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    assert all(x.epochs <= 1.5 + 1e-6 for x in rows) and all(x.copies == 1 for x in by["big"])
    # A source's tokens meet its budget but for what does not fit the last document.
    for source, rs in by.items():
        t = sum(r.n_tokens for r in rs)
        got = sum(r.n_tokens * r.copies for r in rs)
        assert got <= rs[0].epochs * t + 1e-6 and got >= rs[0].epochs * t - 8, source


def test_small_blocks_keep_the_budget(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 20)
    rows = mixing.decisions(docs(spark), budget_share=0.5, repetition=1.0).collect()
    total = sum(r.n_tokens for r in rows)
    assert 0.45 * total < sum(shares(rows).values()) <= 0.5 * total + 1


def test_same_answer_again_columns_repeats_and_empty(spark):
    df = docs(spark)
    one, two = (sorted(map(str, mixing.decisions(df.repartition(n), budget_share=0.7, entropy=0.95).collect())) for n in (1, 5))
    assert one == two
    twice = df.where("doc_id < 4").unionByName(df.where("doc_id < 4"))
    out = mixing.mixed(twice, repetition=1.0)
    assert out.columns == df.columns and out.count() == 8
    assert mixing.mixed(df.limit(0), repetition=2.0).count() == 0
    unit = stored(mixing.units(df.where("doc_id = 9000")), "units")
    assert [r.copies for r in mixing.plan(unit, repetition=2.0).collect()] == [1]


def by_hand(rows, budget, seed=0):
    """{(doc_id, source, text): copies}, from weights by plain search over the exponent of a source's share."""
    t = Counter()
    for _, text, source in rows:
        t[source] += len((text or "").split())
    some = {s: n for s, n in t.items() if n}
    total = sum(some.values())

    def weights(a):
        raw = {s: (n / total) ** a for s, n in some.items()}
        return {s: w / sum(raw.values()) for s, w in raw.items()}

    return t, lambda a: {s: weights(a)[s] * budget / some[s] for s in some}


@pytest.mark.parametrize("sent", [100_000, 0])
def test_copies_against_brute_force(spark, monkeypatch, sent):
    """Whole epochs for all; what is left of a source's budget goes to a prefix of its permutation that no further unit fits."""
    monkeypatch.setattr(mixing, "SENT", sent)
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 30)
    df = docs(spark)
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    budget = 1.3 * sum(len((x or "").split()) for _, x, _ in rows)
    t, epochs_at = by_hand(rows, budget)
    grid = [i / 2_000 for i in range(2_001)]
    a = next(x for x in grid if max(epochs_at(x).values()) <= 2.0)
    want = epochs_at(a)
    got = mixing.mixed(df, budget=budget, repetition=2.0, order="mix_order").collect()
    copies = Counter((r.doc_id, r.text, r.source) for r in got)
    for source, epochs in want.items():
        units = [r for r in rows if r[2] == source]
        n = [copies[u] for u in units]
        words = [len((u[1] or "").split()) for u in units]
        assert all(c in (int(epochs - 0.01), int(epochs + 0.01), int(epochs + 0.01) + 1) for c in n)
        used = sum(c * w for c, w in zip(n, words, strict=True))
        assert epochs * t[source] * 0.98 - 7 <= used <= epochs * t[source] * 1.02
        # Units without words get the whole epochs only.
        assert all(c <= int(epochs + 0.01) for c, w in zip(n, words, strict=True) if not w)
        # Those taken once more come first in the source's permutation, but for units that did not fit the end of the budget.
        first = sorted((min(r.mix_order for r in got if (r.doc_id, r.text, r.source) == u), c) for u, c, w in zip(units, n, words, strict=True) if w and c)
        top = [c for _, c in first]
        if len(set(top)) == 2 and min(n) > 0:
            last = max(i for i, c in enumerate(top) if c == max(top))
            assert top[: last + 1].count(min(top)) <= 30, source
    assert len({r.mix_order for r in got}) == len(got) and got[0].__fields__[:-1] == df.columns


def test_the_mix_moves_no_text(spark):
    plan = mixing.mixed(docs(spark), repetition=1.5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
