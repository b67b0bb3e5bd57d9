import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import layout


def line(y, *items):
    return [(45.4, y, "01/01/2022"), (113.0, y, "Card"), (160.0, y, "12"), *items]


@pytest.fixture(scope="module")
def roles(make_words):
    words = make_words({
        ("three", 1): line(30, (374.0, 30, "1.00"), (512.0, 30, "9.00")) + line(60, (450.0, 60, "2.00"), (513.0, 60, "8.00"))
        + [(374.0, 90, "7.00")],
        ("two", 1): line(30, (374.0, 30, "1.00"), (512.0, 30, "9.00")),
        ("one", 1): line(30, (512.0, 30, "9.00")),
        ("chain", 1): line(30, (300.0, 30, "1.00"), (349.0, 30, "2.00"), (398.0, 30, "3.00"), (448.0, 30, "4.00")),
        ("four", 1): line(30, (200.0, 30, "1.00"), (300.0, 30, "2.00"), (400.0, 30, "3.00"), (500.0, 30, "-4.00"), (550.0, 30, "4.00")),
        ("no-text", 1): [(45.4, 30, "01/01/2022"), (512.0, 30, "9.00")],
        ("many", 1): [w for i in range(8) for w in line(30 + 30 * i, (512.0, 30 + 30 * i, f"{i}.00"))],
    })
    return layout.word_roles(layout.transaction_lines(words))


def test_roles(roles):
    got = {(r.role, r.text) for r in roles.filter("doc_id in ('four', 'three')").collect()}
    assert {("date", "01/01/2022"), ("description", "Card"), ("other", "12"), ("amount", "9.00"), ("description", "-4.00")} <= got
    # Amounts on lines without a date are not seen by the diagnostics.
    assert roles.filter("doc_id = 'three' and text = '7.00'").count() == 0


def test_clusters_follow_gaps_between_neighbours(roles):
    at = layout.amount_positions(roles)
    got = {(r.doc_id, r.cluster): (r.n, r.min_x, r.max_x, r.mean_x) for r in layout.cluster_stats(at).collect()}
    assert got[("three", 3)] == (2, 512.0, 513.0, 512.5)
    assert got[("chain", 1)] == (3, 300.0, 398.0, 349.0)  # 49 apart each: one cluster
    assert got[("chain", 2)] == (1, 448.0, 448.0, 448.0)  # exactly 50 starts a new one
    samples = {r.doc_id: [str(a) for a in r.sample_amounts] for r in layout.cluster_samples(roles, at).filter("cluster = 1").collect()}
    assert samples["many"] == ["0.00", "1.00", "2.00", "3.00", "4.00"]


def test_bounds(roles):
    got = {r.doc_id: r for r in layout.column_bounds(roles).collect()}
    three, two, one, four = got["three"], got["two"], got["one"], got["four"]
    assert (three.n_clusters, three.date_right_x, three.description_x) == (3, 55.4, 103.0)
    assert (three.withdrawal_x, three.deposit_x, three.balance_x) == (364.0, 440.0, 502.5)
    assert (two.withdrawal_x, two.amount_x, two.balance_x, two.description_right_x) == (None, 364.0, 502.0, 364.0)
    assert (one.amount_x, one.balance_x) == (None, 502.0)
    assert (four.n_clusters, four.withdrawal_x, four.deposit_x, four.balance_x) == (4, 190.0, 290.0, 390.0)
    assert "no-text" not in got  # all three roles are needed
    assert {r.doc_id for r in layout.profile_from_bounds(layout.column_bounds(roles)).collect()} == {"three", "four"}


def test_stats_trace_and_sampling(make_words, roles):
    stats = {r.role: (r.n, r.min_x, r.max_x, r.mean_x) for r in layout.position_stats(roles).filter("doc_id = 'three'").collect()}
    assert stats["date"] == (2, 45.4, 45.4, 45.4) and stats["amount"] == (4, 374.0, 513.0, 462.25)
    words = make_words({("d", p): (line(30) if p % 2 else [(1, 1, "x")]) for p in range(1, 7)})
    sampled = layout.transaction_lines(words, max_pages=2).select("page").distinct().orderBy("page").collect()
    assert [r.page for r in sampled] == [1, 3]
    traced = layout.trace(layout.transaction_lines(words)).first()
    assert traced.full_text == "01/01/2022 Card 12" and len(traced.positions) == 3


def test_area_limits_belong_to_the_area(make_words):
    words = make_words({("a", 2): [(1, 239.9, "no"), (1, 240.0, "lo"), (1, 350.0, "hi"), (1, 350.1, "no")], ("a", 1): [(1, 300.0, "no")]})
    got = layout.inspect_area(words, 2, (240.0, 350.0)).orderBy("line_y").select(F.col("line_text")).collect()
    assert [r[0] for r in got] == ["lo", "hi"]
