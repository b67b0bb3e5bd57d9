import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from ledgerloom.llm import queries, simhash
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fps, ids=None, bound=3):
    """Smallest id reachable of every position; positions with one id are one."""
    ids = ids or list(range(len(fps)))
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bound or ids[i] == ids[j]:
                label[root(i)] = root(j)
    least = {}
    for i in range(len(fps)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [least[root(i)] for i in range(len(fps))]


def signed(x):
    return x - 2**64 if x >> 63 else x


def near_and_far(draw, n, centres=6):
    """Fingerprints in clouds around few centres, some between them, some anywhere."""
    seeds = [draw.getrandbits(64) for _ in range(centres)] + [0, 2**64 - 1]
    out = {0}
    while len(out) < n:
        x = draw.choice(seeds) if draw.random() < 0.8 else draw.getrandbits(64)
        for _ in range(draw.randrange(7)):
            x ^= 1 << draw.randrange(64)
        out.add(x)
    return sorted(out)


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    fps = [fingerprint(t) for _, t in docs]
    want = {d: (f"{f:016x}", c) for (d, _), f, c in zip(docs, fps, roots(fps, [d for d, _ in docs]), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op13_gray_simhash(spark, sf).collect()} == want


@given(st.text(alphabet="aB \t\né　İ\x0b.", max_size=60))
@settings(max_examples=150, deadline=None)
def test_fingerprints(text):
    assert simhash.majority(simhash.shingle_hashes(text)) == fingerprint(text)


def test_a_very_long_text(monkeypatch):
    text = " ".join(f"w{i % 701}" for i in range(3_000))
    monkeypatch.setattr(simhash, "HASHES", 128)
    assert simhash.majority(simhash.shingle_hashes(text)) == fingerprint(text)


def test_gray_rank_orders_neighbours(spark):
    draw = random.Random(5)
    ranks = sorted({draw.getrandbits(64) for _ in range(200)} | {0, 1, 2**63, 2**64 - 1})
    codes = [(i, signed(r ^ r >> 1)) for i, r in enumerate(ranks)]
    draw.shuffle(codes)
    frame = spark.createDataFrame(codes, "i long, fp long").orderBy(simhash.gray_rank(F.col("fp")))
    assert [r.i for r in frame.collect()] == list(range(len(ranks)))


@pytest.mark.parametrize("seed", range(4))
def test_links_inside_and_between_blocks(seed):
    draw = random.Random(seed)
    fps = near_and_far(draw, 700, centres=1 + 4 * seed)
    rank = {f: f ^ f >> 1 for f in fps}
    arr = np.array(sorted(fps, key=rank.get), np.uint64)
    p, q = arr[:300], arr[300:]
    sets = simhash.Sets(np.arange(len(arr)))
    links = simhash.linked(simhash.Tree(p), simhash.Tree(p), sets, 0)
    inner = simhash.Sets(np.arange(len(q)))
    links += [(a + 300, b + 300) for a, b in simhash.linked(simhash.Tree(q), simhash.Tree(q), inner, 0)]
    both = simhash.Sets(np.concatenate([sets.top[:300], inner.top + 300]))
    links += simhash.linked(simhash.Tree(p), simhash.Tree(q), both, 300)
    assert all((int(arr[a]) ^ int(arr[b])).bit_count() <= 3 for a, b in links) and len(links) < len(arr)
    want = roots([int(x) for x in arr])
    assert both.top.tolist() == want


@pytest.mark.parametrize("block", [16, 4_096])
def test_components_over_many_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "FAN", 4)
    draw = random.Random(block)
    fps = near_and_far(draw, 500)
    ids = draw.sample(range(10_000), len(fps))
    frame = spark.createDataFrame([(i, signed(f)) for i, f in zip(ids, fps)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, k: docs)
    assert {r.doc_id: r.component_id for r in simhash.groups(frame, block=block).collect()} == dict(zip(ids, roots(fps, ids)))


def test_odd_rows(spark):
    copy = "one two three four five six seven eight"
    rows = [(5, copy), (3, copy.upper()), (None, copy), (7, None), (8, ""), (9, " \n\t"), (3, "quite another text with words of its own"), (10, "quite another text with words of its own"), (10, copy + " nine"), (5, copy)]
    got = [tuple(r) for r in simhash.groups(spark.createDataFrame(rows, DOCS).withColumns({"fp": F.lit("x"), "node": F.lit(1)})).collect()]
    known = [(d, fingerprint(t)) for d, t in rows if d is not None]
    want = [(d, signed(f), c) for (d, f), c in zip(known, roots([f for _, f in known], [d for d, _ in known]))]
    assert sorted(x for x in got if x[0] is not None) == sorted(want)
    assert [x for x in got if x[0] is None] == [(None, signed(fingerprint(copy)), None)]
    assert simhash.groups(spark.createDataFrame([], DOCS)).collect() == []
