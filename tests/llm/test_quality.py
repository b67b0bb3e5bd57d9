import random

import brute
from ledgerloom.llm import quality
from pyspark.sql import functions as F


def texts():
    rnd = random.Random(9)
    words = ["alpha", "beta", "gamma,", "delta.", "AB!!", "x###", "|", "y$$$", "ünï"]
    out = [None, "", " \n\t", "one", "a b c d e f g h " * 30, "Click here\n" + "clean words here now " * 9, "a | b | c | d | e\n" + " ".join(map(str, range(60)))]
    for _ in range(150):
        out.append("\n".join(" ".join(rnd.choice(words) for _ in range(rnd.randrange(12))) for _ in range(rnd.randrange(12))))
    return [*out, " ".join(f"w{i}" for i in range(5_000)) + " w1 w2 w3 w4 w5 w6 w7 w8 end"]


def test_measures_against_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").withColumn("__words", F.lit(1))
    got = {r.doc_id: r.asDict() for r in quality.judged(docs).collect()}
    for i, t in enumerate(texts()):
        want = brute.quality(t)
        assert {k: got[i][k] for k in want} == want, (i, t and t[:80])
    assert got[len(texts()) - 1]["n_repeat_words"] == 16


def test_cleaned_keeps_columns_repeated_rows_and_lengths(spark):
    good = "every line of this text is quite ordinary and has words. " * 1 + "It goes on with some more words until there are enough of them, say twenty five."
    docs = spark.createDataFrame([(1, good + "\nmenu | home | about | contact", 5, "k"), (2, "short", 5, None), (None, good, 7, "k"), (None, good, 7, "k")], "doc_id long, text string, n_chars int, clean string")
    rows = quality.cleaned(docs)
    assert rows.columns == docs.columns and rows.dtypes == docs.dtypes
    assert sorted((r.doc_id or 0, r.text, r.n_chars, r.clean) for r in rows.collect()) == [(0, good, len(good), "k")] * 2 + [(1, good, len(good), "k")]
    assert quality.cleaned(docs.limit(0)).count() == 0


def test_lines_of_marks_menus_and_furniture_of_four_languages_go(spark):
    bad = ["# $ % & * # $ % & *", "Home|About|Login|Contact|Help", "----- ..... ????? -----", "Alle Rechte vorbehalten. Datenschutz Impressum",
           "Tous droits réservés. Politique de confidentialité", "Aviso legal · Política de privacidad", "Inicio • Contacto • Ayuda • Mapa del sitio", "«!?», ...; (--)"]
    good = ["", "An ordinary line, with marks (some of them) - and no more; is it?", "x = a[i] + b(j) | c", "3.14, 2.71, 1.41", "No. 5!", "a|b or c|d is a logical form of several words in it", "...",
            "Das Impressum der Zeitung nennt ihre Herausgeber und den Ort, an dem sie gedruckt wird, nach altem Brauch."]
    lines = spark.createDataFrame([(x,) for x in bad + good], "line string")
    got = {r.line: r.bad for r in lines.select("line", quality.bad_line(F.col("line")).alias("bad")).collect()}
    assert got == {**dict.fromkeys(bad, True), **dict.fromkeys(good, False)}
