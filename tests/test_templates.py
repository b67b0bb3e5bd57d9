import random

import pytest
from ledgerloom.operators import layout, templates
from ledgerloom.plans import catalog, statement
from ledgerloom.sources import rendered as R

BOUNDS = "doc_id long, n_clusters int, withdrawal_x double, deposit_x double, amount_x double, balance_x double"
KNOWN = BOUNDS.replace("doc_id long", "template string")


def test_a_cell_edge_divides_nothing(spark):
    """364.99 and 365.01 lie in two cells and are one layout; so do vectors across several edges at once."""
    known = spark.createDataFrame([("a", 3, 364.99, 440.01, None, 499.99), ("b", 2, None, None, 364.99, 500.0)], KNOWN)
    docs = [
        (1, 3, 365.01, 439.99, None, 500.01), (2, 3, 369.99, 445.01, None, 504.99), (3, 3, 370.0, 440.01, None, 499.99),
        (4, 2, None, None, 360.0, 504.9), (5, 2, None, None, 359.9, 500.0), (6, 1, None, None, None, 500.0),
    ]
    got = {r.doc_id: r.template for r in templates.match(spark.createDataFrame(docs, BOUNDS), known).collect()}
    assert got == {1: "a", 2: "a", 3: None, 4: "b", 5: None, 6: None}


@pytest.mark.parametrize("seed", range(3))
def test_match_against_all_distances(spark, seed):
    draw = random.Random(seed)
    vector = lambda: (3, *(round(draw.choice((0, 40, 90)) + draw.uniform(-12, 12), 2) for _ in range(2)), None, round(draw.uniform(-20, 20), 1))
    known = [(f"t{i:02}", *vector()) for i in range(25)]
    known.append(("t0", *known[3][1:]))  # a tie: the smallest name
    docs = [(i, *vector()) for i in range(150)]
    far = lambda a, b: max(abs(x - y) for x, y in zip(a, b) if x is not None)
    want = {}
    for d in docs:
        near = sorted((far(d[2:], k[2:]), k[0]) for k in known)
        want[d[0]] = near[0][1] if near[0][0] <= 5 else None
    got = templates.match(spark.createDataFrame(docs, BOUNDS), spark.createDataFrame(known, KNOWN))
    assert {r.doc_id: r.template for r in got.collect()} == want and got.count() == len(docs)


def test_many_templates_of_one_layout(spark, monkeypatch):
    """Equal templates meet a document once, and many different ones by fine cells; results are those of all distances."""
    copies = [(f"c{i:04}", 3, 364.0, 440.0, None, 503.0) for i in range(3000)]
    near = [(f"n{i:04}", 3, 364.0 + i * 0.01, 440.0, None, 503.0) for i in range(700)] + [(None, 2, None, None, 90.0, 99.0), ("x", 2, None, None, 90.0, 99.0)]
    docs = [(i, 3, 364.0 + i * 0.0173, 440.0 + i % 3, None, 503.0) for i in range(900)] + [(i, 3, 364.0, 440.0, None, 503.0) for i in range(1000, 3000)]
    docs += [(5000, 2, None, None, 91.0, 99.0), (None, 3, 380.0, 440.0, None, 503.0), (None, 3, 380.0, 440.0, None, 503.0)]
    known, met, look = spark.createDataFrame(copies + near, KNOWN), [], templates._nearest
    monkeypatch.setattr(templates, "_nearest", lambda v, t, tolerance: met.append((v.count(), t.count())) or look(v, t, tolerance))
    found = templates.match(spark.createDataFrame(docs, BOUNDS), known)
    got = sorted(((r.doc_id, r.template, r.distance) for r in found.collect()), key=str)
    want = []
    for d in docs:
        best = min((round(max(abs(x - y) for x, y in zip(d[2:], k[2:]) if x is not None), 6), k[0] or "") for k in copies[:1] + near if k[1] == d[1])
        want.append((d[0], best[1] or None, best[0]) if best[0] <= 5 else (d[0], None, None))
    assert got == sorted(want, key=str)
    # Different vectors only, and those settled in fine cells do not look around wider.
    assert met[0] == (902, 701) and len(met) > 1 and met[-1][0] < 902


def test_learned_layouts_keep_their_distance(spark):
    """Averages in neighbouring cells become one layout; a chain keeps its ends."""
    around = lambda x, n, at: [(at + i, 3, x, x + 80, None, x + 160) for i in range(n)]
    docs = around(364.9, 5, 0) + around(370.1 - 5, 3, 10) + around(374.0, 2, 20) + around(369.2, 4, 30) + around(600.0, 1, 40)
    found = templates.learn(spark.createDataFrame(docs, BOUNDS))
    assert sorted(r.withdrawal_x for r in found.collect()) == pytest.approx([364.98, 374.0], abs=5)
    edges = sorted(r.withdrawal_x for r in found.collect())
    assert all(b - a > 5 for a, b in zip(edges, edges[1:]))
    assert templates.learn(spark.createDataFrame([], BOUNDS)).count() == 0


def test_partial_documents_adopt_and_pool(spark):
    known = spark.createDataFrame([("a", 3, 364.0, 440.0, None, 503.0, 9), ("b", 3, 324.0, 400.0, None, 463.0, 5), ("c", 3, 364.0, 410.0, None, 560.0, 2)], KNOWN + ", n_docs long")
    clusters = [(1, 1, 513.2), (2, 1, 372.0), (2, 2, 471.0), (3, 1, 334.0), (3, 2, 472.0), (4, 1, 374.0), (4, 2, 570.0), (5, 1, 100.0), (6, 1, 373.0)]
    got = {r.doc_id: r.template for r in templates.adopt(spark.createDataFrame(clusters, "doc_id long, cluster int, mean_x double"), known).collect()}
    assert got == {1: "a", 3: "b", 4: "c", 6: "a"}  # 2 shows columns of two layouts, 5 of none; 6 of two: most documents
    cells = [(1, "amount", 7, 374.0, 374.0, 748.0, 2), (2, "amount", 9, 450.0, 450.0, 900.0, 2), (2, "amount", 10, 513.0, 513.0, 1026.0, 2), (9, "amount", 1, 60.0, 60.0, 60.0, 1), (1, "date", 0, 45.0, 45.0, 45.0, 1)]
    cells = spark.createDataFrame(cells, "doc_id long, role string, cell long, min_x double, max_x double, sum_x double, n long")
    labels = spark.createDataFrame([(1, "a"), (2, "a"), (9, "b")], "doc_id long, template string")
    pools = templates.pooled(cells, labels)
    assert [tuple(r) for r in pools.collect()] == [("a", 364.0, 440.0, 503.0, 2, 2, 2)]
    own = spark.createDataFrame([(2, 3, 300.0, 400.0, None, 500.0)], BOUNDS)
    assert {tuple(r) for r in templates.profiles(own, labels, pools).collect()} == {(2, 300.0, 400.0, 500.0, "document"), (1, 364.0, 440.0, 503.0, "template")}


def test_a_default_profile_misreads_shifted_statements(spark, sf):
    """What the query of learned columns would show without the profile."""
    rows = lambda df: sorted(map(str, df.select("doc_id", "txn_seq", "description", "withdrawal", "deposit", "balance").collect()))
    shifted = R.shifted_words(spark, sf)
    assert rows(catalog.learned_columns(spark, sf)) != rows(catalog._show_rows(statement.transactions(shifted)))
    assert rows(catalog.learned_columns(spark, sf)) == rows(catalog._show_rows(statement.transactions(R.words(spark, sf))))


def test_cells_see_what_positions_show(spark, make_words):
    """Clusters over cells against gaps between all sorted positions."""
    draw = random.Random(7)
    xs = {f"d{i}": sorted({round(draw.uniform(0, 900) / step) * step for _ in range(14)}) for i, step in enumerate((0.25, 12.5, 24.5, 49.0, 50.0, 25.0))}
    words = make_words({(d, 1): [(20.0, 30, "01/01/2022"), *[(300.0 + x, 30, "1.00") for x in own]] for d, own in xs.items()})
    at = layout.cluster_stats(layout.amount_positions(layout.word_roles(layout.transaction_lines(words))))
    got = {}
    for r in at.collect():
        got.setdefault(r.doc_id, {})[r.cluster] = (r.min_x, r.max_x, r.n, round(r.mean_x, 9))
    for d, own in xs.items():
        runs = [[300.0 + own[0]]]
        for x in own[1:]:
            runs.append([300.0 + x]) if 300.0 + x - runs[-1][-1] >= 50 else runs[-1].append(300.0 + x)
        assert got[d] == {i + 1: (r[0], r[-1], len(r), round(sum(r) / len(r), 9)) for i, r in enumerate(runs)}


def test_one_look_at_the_words(spark, sf):
    """Words are exchanged once for the column edges; what is exchanged and ordered after that are cells."""
    plan = layout.column_bounds(layout.word_roles(layout.transaction_lines(R.words(spark, sf))))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("RepartitionByExpression") == 1 and "_jump" in text
