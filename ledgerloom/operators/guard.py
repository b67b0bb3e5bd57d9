"""Document guard: text checks, confidence, warnings, the result record, fingerprints, routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import tokens as K

# Page numbers of a document that are compared, or written into one JSON record, at once.
PAGES_PER_PART = 1_000


def page_text(words: DataFrame) -> DataFrame:
    """Each page as one string: words by blank, printed lines by line break."""
    lines = words.groupBy("doc_id", "page", "block_no", "line_no").agg(
        F.min("ord").alias("_at"),
        F.array_join(F.sort_array(F.collect_list(F.struct("ord", "text")))["text"], " ").alias("_line"),
    )
    return lines.groupBy("doc_id", "page").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("_at", "_line")))["_line"], "\n").alias("page_text")
    )


def text_flags(text: Column, headers: Sequence[str] = S.EXPECTED_HEADERS) -> tuple[Column, Column]:
    """(too short, no expected header) for a text that is whole in its row."""
    return F.char_length(K.strip(text)) < S.MIN_TEXT_CHARS, ~K.contains_any(text, headers)


def first_page_flags(words: DataFrame, headers: Sequence[str] = S.EXPECTED_HEADERS) -> DataFrame:
    """``short`` and ``no_header`` per document from the words of page 1.

    Only single printed lines are built: a header never spans two, and the length of the page
    text is the sum of its lines plus one break between each two.
    """
    lines = (
        words.filter(F.col("page") == 1)
        .groupBy("doc_id", "block_no", "line_no")
        .agg(F.array_join(F.sort_array(F.collect_list(F.struct("ord", "text")))["text"], " ").alias("_line"))
    )
    per_doc = lines.groupBy("doc_id").agg(
        (F.sum(F.char_length("_line")) + F.count(F.lit(1)) - 1).alias("_chars"),
        F.bool_or(K.contains_any("_line", headers)).alias("_has_header"),
    )
    return per_doc.select(
        "doc_id",
        (F.col("_chars") < S.MIN_TEXT_CHARS).alias("short"),
        (~F.col("_has_header")).alias("no_header"),
    )


def first_page_and_damage(words: DataFrame, headers: Sequence[str] = S.EXPECTED_HEADERS) -> DataFrame:
    """:func:`first_page_flags` and the ``abort_reason`` of :func:`damaged` from one look at the words; null where there is none."""
    first = F.coalesce(F.col("page") == 1, F.lit(False))
    kept = words.select("doc_id", "block_no", "line_no", "ord", "text", first.alias("_first"), malformed(words).isNotNull().alias("_bad"))
    lines = kept.filter(F.col("doc_id").isNotNull() & (F.col("_first") | F.col("_bad"))).groupBy("doc_id", "block_no", "line_no").agg(
        F.bool_or("_first").alias("_shown"), F.count_if("_bad").alias("_lost"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("_first"), F.struct("ord", "text"))))["text"], " ").alias("_line"),
    )
    line = F.when(F.col("_shown"), F.col("_line"))
    per_doc = lines.groupBy("doc_id").agg(
        (F.sum(F.char_length(line)) + F.count_if("_shown") - 1).alias("_chars"),
        F.bool_or(K.contains_any(line, headers)).alias("_has_header"), F.sum("_lost").alias("_lost"),
    )
    return per_doc.select(
        "doc_id", (F.col("_chars") < S.MIN_TEXT_CHARS).alias("short"), (~F.col("_has_header")).alias("no_header"),
        F.when(F.col("_lost") > 0, F.format_string(S.ABORT_WORDS, F.col("_lost"))).alias("_damage"),
    )


def confidence(short: Column, no_header: Column) -> Column:
    """Product of the penalties that apply."""
    return F.when(short, F.lit(S.SHORT_TEXT_PENALTY)).otherwise(F.lit(1.0)) * F.when(
        no_header, F.lit(S.HEADER_PENALTY)
    ).otherwise(F.lit(1.0))


def guard_warnings(short: Column, no_header: Column) -> Column:
    return F.array_compact(
        F.array(F.when(short, F.lit(S.WARN_SHORT)), F.when(no_header, F.lit(S.WARN_HEADERS)))
    )


def guard_texts(texts: DataFrame, text: str = "text", headers=S.EXPECTED_HEADERS) -> DataFrame:
    """The guard on documents whose first-page text is already one column."""
    short, no_header = text_flags(F.coalesce(F.col(text), F.lit("")), headers)
    return texts.withColumns(
        {
            "success": F.lit(True),
            "confidence": confidence(short, no_header),
            "warnings": guard_warnings(short, no_header),
        }
    )


def part_of_page(page: str = "page") -> Column:
    return F.floor((F.col(page) - 1) / PAGES_PER_PART).cast("bigint")


def _page_states(page_rows: DataFrame) -> DataFrame:
    return page_rows.groupBy("doc_id", "page").agg(
        F.first("has_table").alias("has_table"), F.count_if("is_txn").alias("_txns")
    )


def page_warnings(documents: DataFrame, page_rows: DataFrame) -> DataFrame:
    """doc_id, page, message: pages without any text and pages without a table, one row each.

    ``page_rows``: doc_id, page, has_table in any number of rows per page. It is read twice and should be a written table."""
    none = F.array().cast("array<int>")
    pages = documents.select(
        "doc_id", F.explode(F.when(F.col("n_pages") > 0, F.sequence(F.lit(1), F.col("n_pages").cast("int"))).otherwise(none)).alias("page")
    )
    seen = page_rows.groupBy("doc_id", "page").agg(F.first("has_table").alias("has_table"))
    seen = seen.select("doc_id", F.col("page").cast("int").alias("page"), "has_table")
    no_text = pages.join(seen, ["doc_id", "page"], "left_anti").select(
        "doc_id", "page", F.format_string(S.WARN_NO_TEXT, F.col("page")).alias("message")
    )
    no_table = seen.filter(~F.col("has_table")).join(documents.select("doc_id"), "doc_id", "left_semi").select(
        "doc_id", "page", F.format_string(S.WARN_NO_TABLE, F.col("page")).alias("message")
    )
    return no_text.unionByName(no_table)


def document_results(documents: DataFrame, words: DataFrame, page_rows: DataFrame,
                     aborts: DataFrame | None = None) -> DataFrame:
    """Exactly one result row per document, however long it is.

    ``documents``: doc_id, n_pages. ``page_rows``: all rows of all pages with ``has_table`` and
    ``is_txn``. ``aborts``: optional doc_id, abort_reason of documents rejected by the audit. Documents that lost
    malformed words fail whatever the audit says: their ledger may lack rows.
    ``warnings`` holds those of the document; those of its pages are counted in ``n_warnings``
    and listed by :func:`page_warnings`.
    """
    pages = _page_states(page_rows).join(documents.select("doc_id", "n_pages"), "doc_id")
    inside = F.col("page").between(1, F.col("n_pages"))
    counts = pages.groupBy("doc_id").agg(
        F.count_if(inside).alias("_seen"), F.count_if(~F.col("has_table")).alias("_no_table"), F.sum("_txns").alias("_txns"),
    )
    out = documents.select("doc_id", "n_pages").join(counts, "doc_id", "left").join(first_page_and_damage(words), "doc_id", "left")
    # A first page without any word is both short and without headers.
    short, no_header = F.coalesce("short", F.lit(True)), F.coalesce("no_header", F.lit(True))
    empty = F.col("n_pages") <= 0
    abort = F.coalesce(F.when(empty, F.lit(S.ABORT_INTEGRITY)), F.col("_damage"))
    if aborts is not None:
        out = out.join(aborts.withColumnRenamed("abort_reason", "_abort"), "doc_id", "left")
        abort = F.coalesce(abort, F.col("_abort"))
    own = F.when(empty, F.array(F.lit(S.WARN_EMPTY))).otherwise(guard_warnings(short, no_header))
    of_pages = F.col("n_pages") - F.coalesce("_seen", F.lit(0)) + F.coalesce("_no_table", F.lit(0))
    return out.select(
        "doc_id",
        abort.isNull().alias("success"),
        F.when(abort.isNotNull(), F.lit(0.0)).otherwise(confidence(short, no_header)).alias("confidence"),
        own.alias("warnings"),
        (F.size(own) + F.when(empty, F.lit(0)).otherwise(of_pages)).cast("bigint").alias("n_warnings"),
        abort.alias("abort_reason"),
        F.when(abort.isNotNull(), F.lit(0)).otherwise(F.coalesce("_txns", F.lit(0))).cast("bigint").alias("transaction_count"),
    )


def malformed(words: DataFrame) -> Column:
    """Why a word has no place in a document, or null: a missing key, or a coordinate that is none."""
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    return (
        F.when(F.col("doc_id").isNull(), "no document").when(F.col("page").isNull(), "no page")
        .when(bad("x0") | bad("y0"), "no position").when(F.col("text").isNull(), "no text")
    )


def rejected_words(words: DataFrame) -> DataFrame:
    """The words that every extraction leaves out, whatever the size of their document, with ``reason``."""
    return words.withColumn("reason", malformed(words)).filter(F.col("reason").isNotNull())


def damaged(words: DataFrame) -> DataFrame:
    """doc_id, abort_reason of documents that lose malformed words."""
    lost = rejected_words(words).filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    return lost.select("doc_id", F.format_string(S.ABORT_WORDS, F.col("_n")).alias("abort_reason"))


def text_entropy(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shannon entropy of the characters of each document, in bits; 0 without characters.

    A document may have any number of rows (one text, or one per word). Characters are counted
    inside the scan's own stage, so only one row per document and distinct character is exchanged.
    """
    chars = texts.select(key, F.explode_outer(F.split(text, "")).alias("_ch"))
    counts = chars.groupBy(key, "_ch").agg(F.count(F.lit(1)).alias("_n"))
    real = F.coalesce(F.col("_ch") != "", F.lit(False))
    # H = log2(N) - sum(n * log2(n)) / N needs no second look at the total N.
    per = counts.groupBy(key).agg(
        F.coalesce(F.sum(F.when(real, F.col("_n"))), F.lit(0)).alias("n_chars"),
        F.sum(F.when(real, F.col("_n") * F.log2("_n"))).alias("_s"),
    )
    bits = F.log2("n_chars") - F.col("_s") / F.col("n_chars")
    return per.select(
        key, "n_chars", F.when(F.col("n_chars") > 0, F.round(bits, 6)).otherwise(F.lit(0.0)).alias("entropy")
    )


def fingerprints(bounds: DataFrame, bucket: float = 5.0) -> DataFrame:
    """A layout key per document: its column positions, rounded to buckets, hashed."""
    edges = ["n_clusters", "withdrawal_x", "deposit_x", "amount_x", "balance_x"]
    spell = lambda c: F.coalesce(
        F.floor(F.col(c) / (1 if c == "n_clusters" else bucket)).cast("string"), F.lit("-")
    )
    return bounds.select("doc_id", F.sha2(F.concat_ws("|", *[spell(c) for c in edges]), 256).alias("fingerprint"))


def match_templates(prints: DataFrame, templates: DataFrame) -> DataFrame:
    """Attach ``template`` by fingerprint; unknown layouts keep null. One layout may be that of
    most documents: adaptive execution splits it, as both sides of the join are plain rows."""
    return prints.join(templates.select("fingerprint", "template"), "fingerprint", "left")


def route(results: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Extraction path per document: aborted or doubtful ones go to the fallback."""
    doubt = (~F.col("success")) | (F.col("confidence") < threshold)
    return results.withColumn("route", F.when(doubt, "fallback").otherwise("deterministic"))
