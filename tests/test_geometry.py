import random

from pyspark.sql import functions as F

from ledgerloom.operators import geometry as G


def lines_of(df):
    return {
        (r.doc_id, r.page, r.line_y): [w.text for w in r.words] for r in df.select("doc_id", "page", "line_y", "words").collect()
    }


def both(words):
    typed = G.type_words(words)
    return lines_of(G.greedy_lines(typed)), lines_of(G.greedy_lines(typed, spread=True))


def test_line_cases(make_words):
    words = make_words({
        ("near", 1): [(10, 100.0, "a"), (20, 102.9, "b")],
        ("apart", 1): [(10, 100.0, "a"), (20, 103.0, "b")],
        ("order", 1): [(10, 100.0, "a"), (20, 104.0, "b"), (30, 102.0, "c")],
        ("tie", 1): [(10, 50.0, "second"), (5, 50.0, "first"), (10, 50.0, "third")],
        ("late", 1): [(10, 102.0, "a"), (20, 99.5, "b"), (30, 104.9, "c"), (40, 97.0, "d")],
    })
    for got in both(words):
        assert got == {
            ("near", 1, 100.0): ["a", "b"],
            ("apart", 1, 100.0): ["a"], ("apart", 1, 103.0): ["b"],
            ("order", 1, 100.0): ["a", "c"], ("order", 1, 104.0): ["b"],
            ("tie", 1, 50.0): ["first", "second", "third"],
            # 99.5 and 104.9 are within 3 of 102, 97.0 is not and opens its own line
            ("late", 1, 102.0): ["a", "b", "c"], ("late", 1, 97.0): ["d"],
        }


def brute_force(points):
    """First near key in creation order, by definition."""
    keys, at = [], []
    for y in points:
        hit = next((k for k in keys if abs(k - y) < 3), None)
        if hit is None:
            keys.append(y)
            hit = y
        at.append(hit)
    return at


def test_random_pages_against_brute_force(make_words):
    rnd = random.Random(5)
    pages, want = {}, {}
    for n in range(80):
        step = rnd.choice([0.25, 0.7, 1.0])
        ys = [round(rnd.randrange(0, rnd.choice([40, 200])) * step, 4) for _ in range(rnd.randrange(1, 60))]
        pages[(f"d{n}", 1)] = [(rnd.randrange(0, 500), y, f"w{i}") for i, y in enumerate(ys)]
        for i, key in enumerate(brute_force(ys)):
            want.setdefault((f"d{n}", 1, key), set()).add(f"w{i}")
    for got in both(make_words(pages)):
        assert {k: set(v) for k, v in got.items()} == want


def test_grid_rounds_half_to_even(make_words):
    words = make_words({("g", 1): [(1, 1.5, "a"), (2, 4.5, "b"), (3, 7.5, "c"), (4, 7.6, "d")]})
    assert lines_of(G.grid_lines(words)) == {
        ("g", 1, 0.0): ["a"], ("g", 1, 6.0): ["b", "c"], ("g", 1, 9.0): ["d"],
    }


def test_partition_layout_does_not_matter(make_words):
    rnd = random.Random(3)
    words = make_words({(f"d{n}", 1): [(rnd.randrange(500), rnd.randrange(100), f"w{i}") for i in range(40)] for n in range(5)})
    assert both(words)[0] == both(words.orderBy(F.rand(seed=1)).repartition(7))[0]


def test_flip_origin_and_line_numbers(make_words):
    words = make_words({("f", 1): [(1, 100.0, "low"), (1, 700.0, "high")]})
    flipped = G.flip_origin(words, F.lit(842.0))
    assert {r.text: (r.y0, r.y1) for r in flipped.collect()} == {"low": (733.0, 742.0), "high": (133.0, 142.0)}
    numbered = G.number_lines(G.grid_lines(words)).orderBy("line_y").select("line_text", "line_idx").collect()
    assert [tuple(r) for r in numbered] == [("low", 0), ("high", 1)]


def test_merge_spans(make_words):
    words = make_words({("m", 1): [(10, 5, "Sta"), (25.5, 5, "tement"), (80, 5, "x")]})
    got = G.merge_spans(G.key_grid(words)).orderBy("x0").select("text", "n_parts").collect()
    assert [tuple(r) for r in got] == [("Statement", 2), ("x", 1)]


def test_profile_table_is_used_per_document(spark, make_words):
    words = make_words({("a", 1): [(200, 5, "1.00")], ("b", 1): [(200, 5, "1.00")]})
    profile = spark.createDataFrame([("a", 100.0, 300.0, 400.0)], "doc_id string, withdrawal_x double, deposit_x double, balance_x double")
    got = {r.doc_id: r.col for r in G.type_words(words, profile).collect()}
    assert got == {"a": 1, "b": None}
