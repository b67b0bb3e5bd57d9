import hashlib
import random

from ledgerloom.llm import chat
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["</turn>", "### ", "</part>", "\\", "<\\/turn>", "##\\# ", "a", "\n", ": ", "é", "", "<\\c>", "#", "\\\\", "</turn>\n"]


def back(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("formatted", F.lit("clash"))
    made = chat.format_chats(df, **kw)
    return {r.conv_id: r for r in chat.read_chats(made).join(made.select("conv_id", "mask"), "conv_id").collect()}


def test_random_texts_and_roles_come_back(spark):
    rnd = random.Random(3)
    text = lambda: "".join(rnd.choice(NASTY) for _ in range(rnd.randrange(6)))
    rows = [(c, t, rnd.choice(["user", "assistant", "a: b", "<\\c>"]), text()) for c in range(60) for t in range(rnd.randrange(1, 9))]
    for block in (512, 2):
        got = back(spark, rows, turn_block=block)
        for c in range(60):
            want = [(r, x) for k, _, r, x in rows if k == c]
            assert [tuple(t) for t in got[c].turns] == want
            assert got[c].loss_texts == [x for r, x in want if r == "assistant"]


def test_mask_runs_cover_the_text_and_point_at_assistant_texts(spark):
    got = back(spark, [(1, 0, "user", "q"), (1, 1, "assistant", "one"), (1, 2, "assistant", "two </part>"), (1, 3, "user", "z")])[1]
    assert got.formatted == "### user: q</turn>\n### assistant: one</part>two <\\/part></turn>\n### user: z</turn>\n"
    at, seen = 0, []
    for run in got.mask:
        at += run.skip
        if run.loss:
            seen.append(got.formatted[at : at + run.take])
        at += run.take
    assert seen == ["one", "two <\\/part>"] and got.formatted[at:] == "</turn>\n"


def test_nulls_ties_repeats_and_empty(spark):
    got = back(spark, [(1, None, None, None), (1, 0, "b", "x"), (1, 0, "a", "y"), (1, 0, "a", "y")])[1]
    assert [tuple(t) for t in got.turns] == [("", ""), ("a", "y"), ("a", "y"), ("b", "x")]
    assert chat.read_chats(chat.format_chats(spark.createDataFrame([], SCHEMA))).count() == 0
    odd = chat.format_chats(spark.createDataFrame([(None, 1, "u", "t")], SCHEMA))
    assert hashlib.sha256(odd.first().formatted.encode()).hexdigest() and odd.first().conv_id is None
