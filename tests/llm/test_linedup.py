import random

import brute
from ledgerloom.llm import linedup
from pyspark.sql import functions as F


def docs_():
    rnd = random.Random(4)
    base = ["".join(rnd.choice("ab cdé") for _ in range(n)) for n in (20, 21, 22, 30, 31, 60, 61, 120) for _ in range(3)] + ["x" * 20, "x" * 21, "x" * 22]
    out = {}
    for d in range(90):
        lines = []
        for _ in range(rnd.randrange(5)):
            x = rnd.choice(base)
            i = rnd.randrange(len(x) + 1)
            lines.append(rnd.choice([x, x, x[:i] + "q" + x[i:], x[:i] + x[i + 1 :], x[:i] + "z" + x[i + 1 :], " " + x + "\t", "short"]))
        out[d] = "\n".join(lines)
    return {**out, 90: None, 91: "", 92: "y" * 3_000 + "\n" + "y" * 2_999}


def test_removed_against_brute_force(spark):
    df = spark.createDataFrame(list(docs_().items()), "doc_id long, text string").withColumn("line", F.lit("clash"))
    got = {(r.doc, r.no): (r.kept_doc, r.kept_no) for r in linedup.removed(df).collect()}
    want = brute.removed_lines(docs_())
    assert got == want and len(want) > 40


def test_cleaned_texts_columns_and_lengths(spark):
    df = spark.createDataFrame([(d, t, len(t or ""), "s") for d, t in docs_().items()], "doc_id long, text string, n_chars int, no string")
    rows = linedup.cleaned(df)
    assert rows.dtypes == df.dtypes
    got = {r.doc_id: (r.text, r.n_chars) for r in rows.collect()}
    assert got == {d: (t, len(t or "")) for d, t in brute.line_cleaned(docs_()).items()}


def test_repeated_rows_null_ids_and_empty(spark):
    line = "a line that is long enough to count"
    df = spark.createDataFrame([(1, line), (1, line), (None, line), (2, line + "\nother words")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in linedup.cleaned(df).collect())
    assert got == [(1, line), (1, line), (2, "other words")]
    assert linedup.removed(df.limit(0)).count() == 0 and linedup.cleaned(df.limit(0)).count() == 0


def test_rows_without_id_and_texts_under_one_id_lose_their_own_lines_only(spark):
    told = [f"line number {i} that is long enough to count {w}" for i, w in enumerate(("alpha", "beta", "gamma", "delta", "epsilon"))]
    a, b, c, d, e = told
    rows = [(1, a), (None, f"{a}\nrest one"), (None, b), (None, f"{c}\nrest two"), (None, f"{c}\nrest three"), (2, f"{a}\nrest four"), (2, d), (None, e), (None, e)]
    got = [(r.doc_id, r.text) for r in linedup.cleaned(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert {(i, t) for i, t in got if i} == {(1, a), (2, "rest four"), (2, d)}
    unnamed = sorted(t for i, t in got if i is None)
    # Of two equal lines in different rows one goes; of two equal rows one row goes.
    one_of = [sorted(["rest one", b, e, *pair]) for pair in ((f"{c}\nrest two", "rest three"), ("rest two", f"{c}\nrest three"))]
    assert unnamed in one_of


def test_short_lines_chains_and_wordless_lines(spark):
    """Equal lines go at any length; of a chain of edits the line that stays is named."""
    base = "a chain of lines that differ a little"
    docs = {1: f"menu home\n \t\n{base}", 2: f"menu home\n{base}x\n\n", 3: f"menu homes\n{base}xy", 4: f"x\n{base}xyz", 5: "x\nmenu homes", 2**63 - 1: "x"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {(r.doc, r.no): (r.kept_doc, r.kept_no) for r in linedup.removed(df).collect()}
    assert got == brute.removed_lines(docs) and got[4, 1] == (1, 2) and got[2, 0] == (1, 0) and (3, 0) not in got and got[5, 0] == (4, 0)
    with_null = linedup.removed(df.unionByName(spark.createDataFrame([(None, "x\nalone")], df.schema))).where("doc IS NULL").collect()
    assert [(r.doc, r.no, r.kept_doc) for r in with_null] == [(None, 0, 4)]


def test_copies_go_as_a_whole(spark):
    docs = {i: f"{'first line of a longer text ' * 3}\n{'second line of it ' * 4}\nand the end {i}" for i in range(3)} | {9: "quite new"}
    df = spark.createDataFrame([(d, t, 1, 2, 3, 4) for d, t in docs.items()], "doc_id long, text string, doc int, row int, gone int, kept_text int")
    for copied, left in ((0.8, [0, 9]), (1.0, [0, 1, 2, 9])):
        rows = linedup.cleaned(df, copied)
        assert rows.columns == df.columns and {r.doc_id: r.text for r in rows.collect()} == brute.line_cleaned(docs, copied) and sorted(r.doc_id for r in rows.collect()) == left
