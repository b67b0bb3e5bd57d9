"""Line-first quality rules: drop bad lines, then judge what is left of a document.

Words are runs of characters other than the six ASCII blanks. Every line of a document is tested by itself; the
lines that fail a rule are removed, and a document is rejected when it fails a whole-text rule or loses more than
``max_lost`` of the characters in its words.

Line rules (a line fails if one holds):

* punctuation: of at least ``rule_words`` words, more than ``max_marked`` carry a run of two or more symbols or
  exclamation marks (``word###``, ``WORD!!``); or at least ``least_marks`` of the characters in its words, and more than
  ``max_marks`` of them, are marks of any kind (``# $ % &``, ``----- ..... -----``);
* navigation: at least ``min_bars`` separators that stand alone, and at most ``max_between`` other words for each; or as many bars, bullets
  or guillemets anywhere (``Home|About|Contact``) and at most ``max_items`` words for each;
* boilerplate: at most ``boiler_words`` words and one of the fixed phrases in it, which are in the languages of the texts.

Whole-text rules: fewer than ``min_words`` words; more than ``max_repeat`` of 100 words inside an 8-word window
that occurs twice or more in the text.

Defined results: null text counts as empty, an empty text has no words and is rejected; repeated rows are judged
each by itself; other columns, null or clashing by name, are not read; an empty table gives an empty result.
Everything happens inside the row: no exchange, and memory in proportion to the longest text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Phrases of page furniture, lower case.
PHRASES = (
    "all rights reserved", "privacy policy", "cookie policy", "terms of use", "terms of service", "terms and conditions",
    "accept cookies", "use cookies", "enable javascript", "javascript is disabled", "click here", "read more",
    "sign up", "log in", "share this", "subscribe to", "follow us", "back to top", "skip to content", "powered by",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "cookies akzeptieren", "zum inhalt springen", "nach oben",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "accepter les cookies", "aller au contenu", "haut de page",
    "todos los derechos reservados", "política de privacidad", "aviso legal", "aceptar cookies", "saltar al contenido", "volver arriba",
)
#: Marks other than letters, digits and blanks, those of ASCII and the commonest others.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»•·–—…¿¡"
BARS = "|»•·"
WINDOW = 8


@dataclass(frozen=True)
class Limits:
    min_words: int = 20
    max_repeat: int = 30
    rule_words: int = 4
    max_marked: float = 0.3
    min_bars: int = 3
    max_between: float = 3.0
    max_items: float = 2.0
    least_marks: int = 5
    max_marks: float = 0.6
    boiler_words: int = 12
    max_lost: float = 0.3


def words(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")


def _word_chars(text: Column) -> Column:
    return F.length(F.translate(text, WORD_BLANKS, ""))


def bad_line(line: Column, limits: Limits = Limits()) -> Column:
    """Whether a line fails; counts come from what a replacement takes away, so no words are built."""
    n_words = F.size(F.regexp_extract_all(line, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)))
    n_marked = F.size(F.regexp_extract_all(line, F.lit("[#*$%&|<>!]{2,}"), F.lit(0)))
    n_bars = F.size(F.regexp_extract_all(line, F.lit("(?:^|[\\x20\\x09])[|>»•·](?=[\\x20\\x09]|$)"), F.lit(0)))
    low = F.lower(line)
    chars = _word_chars(line)
    marks = F.length(line) - F.length(F.translate(line, MARKS, ""))
    bars = F.length(line) - F.length(F.translate(line, BARS, ""))
    items = F.size(F.regexp_extract_all(line, F.lit(f"[^\\x20\\x09-\\x0D{BARS}]+"), F.lit(0)))
    phrase = F.lit(False)
    for p in PHRASES:
        phrase = phrase | F.contains(low, F.lit(p))
    return (
        (line.rlike("[#*$%&|<>!]{2,}") & (n_words >= limits.rule_words) & (n_marked > limits.max_marked * n_words))
        | (line.rlike("[|>»•·]") & (n_bars >= limits.min_bars) & (n_words - n_bars <= limits.max_between * n_bars))
        | ((marks >= limits.least_marks) & (marks > limits.max_marks * chars))
        | ((bars >= limits.min_bars) & (items <= limits.max_items * bars))
        | ((F.length(line) <= 40 * limits.boiler_words) & phrase & (n_words <= limits.boiler_words))
    )


def _window_hashes(w: Column, n: Column) -> Column:
    """A 64-bit hash of every window of eight words, by its first word."""
    last = n - WINDOW
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    return F.when(n >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>"))


def judged(docs: DataFrame, limits: Limits = Limits(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the measures of every text, ``base_failed``, ``clean`` (the text without failed lines), ``kept``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], text.alias("__text"))
    split = base.withColumns({
        "__words": words(F.col("__text")), "__lines": F.split("__text", "\n", -1),
    })
    first = split.withColumns({
        "__n": F.size("__words"),
        "__full": F.filter("__lines", lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
        "__good": F.filter("__lines", lambda x: ~bad_line(x, limits)),
    })
    hashed = first.withColumn("__hashes", _window_hashes(F.col("__words"), F.col("__n"))).drop("__words")
    # Only a text that holds some window twice pays for the ordering of its windows.
    pairs = hashed.withColumn(
        "__ranked",
        F.when(
            F.size(F.array_distinct("__hashes")) < F.size("__hashes"),
            F.array_sort(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("p")))),
        ),
    )
    ranked = F.col("__ranked")
    again = pairs.withColumn(
        "__starts",
        F.sort_array(F.transform(
            F.filter(ranked, lambda r, i: F.coalesce(F.get(ranked, i - 1)["h"] == r["h"], F.lit(False)) | F.coalesce(F.get(ranked, i + 1)["h"] == r["h"], F.lit(False))),
            lambda r: r["p"],
        )),
    )
    starts = F.col("__starts")
    repeated = F.coalesce(
        F.aggregate(
            F.transform(starts, lambda p, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get(starts, i - 1)))),
            F.lit(0), lambda a, x: a + x,
        ),
        F.lit(0),
    )
    measured = again.select(
        *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)],
        F.col("__n").cast("long").alias("n_words"),
        _word_chars(F.col("__text")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__full") - F.size(F.array_distinct("__full"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        (F.size("__lines") - F.size("__good")).cast("long").alias("n_bad_lines"),
        F.array_join("__good", "\n").alias("clean"),
    )
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat * F.col("n_words"))
    lost = F.col("word_chars") - _word_chars(F.col("clean"))
    return (
        measured.withColumn("base_failed", failed)
        .withColumn("lost_chars", lost.cast("long"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= limits.max_lost * F.col("word_chars")))
    )


def cleaned(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents that pass, with all their columns, the failed lines taken out of ``text`` and ``n_chars`` to match."""
    marked = judged(docs.withColumn("__row", F.struct(*[docs[c] for c in docs.columns])), limits, keep=("__row",))
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    # A filter is moved below projections by writing their expressions into it, here every array of the measures many
    # times over. A column that may not be computed twice, and that the filter uses, keeps it where it is.
    marked = marked.withColumn("__row_no", F.monotonically_increasing_id()).where(F.col("kept") & (F.col("__row_no") >= 0))
    return marked.select(*[
        (new[c] if c in new else F.col("__row")[c]).alias(c) for c in docs.columns
    ])
