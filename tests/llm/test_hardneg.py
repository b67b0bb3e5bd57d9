import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from ledgerloom.llm import hardneg, queries
from pyspark.sql import functions as F

ROWS = "vec_id long, label int, embedding array<float>"


def brute(rows, asks=lambda i: i % 100 == 0):
    """All result rows of (id, label, integer vector) rows."""
    rows = list({(i, lab, tuple(v)) for i, lab, v in rows})
    out = []
    for anchor in {i for i, _, _ in rows if asks(i)}:
        label, v = min((lab, x) for i, lab, x in rows if i == anchor)
        scored = sorted((-sum(a * b for a, b in zip(v, x)), i, lab) for i, lab, x in rows if i != anchor)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            window = [(n, t) for t, n, lab in scored if lab != label and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(anchor, p, rank + 1, n, -s, -t) for rank, (n, t) in enumerate(window[:5])]
    return sorted(out)


def whole(rows):
    for i, lab, v in rows:
        if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            yield i, ((lab + 1) % 10 if i % 7 == 0 else lab), [math.floor(256 * float(np.float32(x))) for x in v]


def mined(spark, rows, tmp_path):
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(tuple(r) for r in queries.op11_hard_negatives(spark, str(tmp_path)).collect())


@given(st.integers(1, 90), st.integers(1, 90), st.integers(1, 90), st.integers(0, 2**32))
@settings(max_examples=40, deadline=None)
def test_strassen_is_exact(m, k, n, seed):
    draw = np.random.default_rng(seed)
    a, b = draw.integers(-(2**28), 2**28, (m, k)), draw.integers(-(2**28), 2**28, (k, n))
    leaf, hardneg.LEAF = hardneg.LEAF, 4
    try:
        assert (hardneg.strassen(a, b) == (a.astype(object) @ b.astype(object))).all()
    finally:
        hardneg.LEAF = leaf


def test_heaps_merge_in_any_order():
    draw = np.random.default_rng(3)
    slot, score, ids = draw.integers(0, 4, 300), draw.integers(-3, 3, 300), draw.permutation(300)
    score[:2] = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    want = defaultdict(list)
    for x in sorted(zip(slot, -score.astype(object), ids)):
        want[x[0]].append(x)
    for parts in (1, 7):
        h = hardneg.Heaps(5)
        for p in np.array_split(draw.permutation(300), parts):
            h.add(slot[p], score[p], ids[p])
        assert [(a, -int(b), c) for a, b, c in zip(h.slot, h.score, h.id)] == [x for k in sorted(want) for x in want[k][:5]]


def test_whole_table(spark, sf):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op11_hard_negatives(spark, sf).collect())
    assert got == brute(whole(rows)) and got


def test_odd_rows(spark, tmp_path):
    draw = np.random.default_rng(1)
    rows = [(int(i), int(draw.integers(0, 3)), [float(x) for x in draw.integers(-2, 4, 6) / 8]) for i in range(230)]
    rows += rows[:40]  # repeated rows
    rows += [(100, 1, [0.5] * 6), (13, 2, [0.25, 0.5, 0.25, 0.1, 0.0, 0.3])]  # an id with two vectors, ties
    rows += [(300, 1, None), (301, None, [1.0] * 6), (None, 1, [1.0] * 6), (302, 1, [float("nan")] + [1.0] * 5), (303, 2, [float("inf")] * 6), (304, 1, [None] + [1.0] * 5)]
    assert mined(spark, rows, tmp_path / "a") == brute(whole(rows))
    assert mined(spark, [], tmp_path / "b") == []
    assert mined(spark, [(100, 1, [1.0])], tmp_path / "c") == []


@pytest.mark.parametrize("tile", [16])
def test_many_tiles_and_one_hot_label(spark, monkeypatch, tile):
    for name in ("ANCHORS", "CANDIDATES"):
        monkeypatch.setattr(hardneg, name, tile)
    monkeypatch.setattr(hardneg, "CELL", 2)
    draw = np.random.default_rng(2)
    rows = [(i, 0 if i % 3 else i % 5, [int(x) for x in draw.integers(-9, 10, 5)]) for i in range(300)]
    frame = spark.createDataFrame([(i, lab, [float(x) for x in v], 7, 8) for i, lab, v in rows], "vec_id long, label int, embedding array<double>, a int, g int")
    made = hardneg.prepared(frame, F.col("vec_id"), F.col("label"), F.col("embedding"), 1)
    got = hardneg.mined(made, F.col("id") % 6 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, lambda i: i % 6 == 0)
