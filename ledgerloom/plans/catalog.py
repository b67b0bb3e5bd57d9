"""Registered queries: every operator over whole tables, as callables (spark, sf_dir) -> DataFrame.

The oracle for each is in :mod:`ledgerloom.plans.oracle`. At this edge money becomes DOUBLE,
dates become text and lists are joined, so that results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import tokens as K
from ..operators import audit, geometry, guard, layout, ledger as L, rows, templates
from ..sources import rendered as R
from ..sources import tables
from ..sources.scratch import new_path, stored
from ..streaming import intake
from . import statement

LONG = T.LongType()


def _money(*names: str):
    return [F.col(n).cast("double").alias(n) for n in names]


def _long(*names: str):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def _joined(name: str):
    return F.array_join(name, "; ").alias(name)


def _counts(spark: SparkSession, d: str) -> DataFrame:
    """Words per document, stored: each sizing job would look through all orders again."""
    return stored(R.word_counts(spark, d), "word-counts")


def _parsed(spark: SparkSession, d: str, **options) -> DataFrame:
    counts = _counts(spark, d)
    return statement.transactions(R.words(spark, d, counts), sizes=counts, **options)


def _results(spark: SparkSession, d: str, aborts: DataFrame | None = None) -> DataFrame:
    return statement.document_results(
        R.documents(spark, d), R.words(spark, d), aborts, sizes=R.word_counts(spark, d)
    )


def _extracted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ledger, results, page warnings) from one pass over the words."""
    words, documents = R.words(spark, d), R.documents(spark, d)
    ledger, page_rows = statement.extract(words, sizes=R.word_counts(spark, d))
    return ledger, guard.document_results(documents, words, page_rows), guard.page_warnings(documents, page_rows)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return geometry.greedy_lines(geometry.type_words(R.words(spark, d)))


def _show_rows(ledger: DataFrame, *more: str) -> DataFrame:
    return ledger.select(
        "doc_id", *_long("page", "txn_seq"), "date_raw", F.col("txn_date").cast("string").alias("txn_date"),
        "description", *_money("withdrawal", "deposit", "balance"), *more,
    )


def _show_results(results: DataFrame, *more: str) -> DataFrame:
    return results.select(
        "doc_id", "success", F.round("confidence", 6).alias("confidence"), _joined("warnings"),
        "n_warnings", "abort_reason", "transaction_count", *more,
    )


# --- extraction ------------------------------------------------------------
def statement_totals(spark, d):
    """Flagship: positioned words to totals per document, one shuffle of the words."""
    return L.totals(_parsed(spark, d)).select(
        "doc_id", "n_transactions", *_money("total_withdrawals", "total_deposits", "net_change")
    )


def parse_roundtrip(spark, d):
    return _show_rows(_parsed(spark, d), "reclassified", "negative")


def carry_pages(spark, d):
    return _show_rows(_parsed(spark, d, carry_pages=True))


def learned_columns(spark, d):
    """Statements of shifted layouts: column edges learned from a document's own words, or from those of its layout."""
    counts = _counts(spark, d)
    words = R.shifted_words(spark, d, counts=counts)
    profile = templates.learned_profiles(layout.word_roles(layout.transaction_lines(words, sizes=counts)))
    return _show_rows(statement.transactions(words, stored(profile.drop("source"), "profiles"), sizes=counts))


def column_sources(spark, d):
    """Where each document's column edges come from."""
    counts = _counts(spark, d)
    lines = layout.transaction_lines(R.shifted_words(spark, d, counts=counts), sizes=counts)
    found = templates.learned_profiles(layout.word_roles(lines))
    return found.select("doc_id", "source", *[F.round(c, 6).alias(c) for c in ("withdrawal_x", "deposit_x", "balance_x")])


def page_list(spark, d):
    return R.words(spark, d).groupBy("doc_id", F.col("page").cast("bigint").alias("page")).agg(
        F.count(F.lit(1)).alias("n_words")
    )


def page_text(spark, d):
    first = R.words(spark, d).filter(F.col("page") == 1)
    return guard.page_text(first).select("doc_id", "page_text")


def lines_greedy(spark, d):
    out = geometry.number_lines(geometry.greedy_lines(geometry.type_words(R.words(spark, d))))
    n_amounts = F.size(F.filter("words", lambda w: w["amount"].isNotNull())).cast("bigint")
    return out.select(
        "doc_id", *_long("page", "line_idx"), "line_y", "line_text", n_amounts.alias("n_amounts")
    )


def lines_grid(spark, d):
    return geometry.grid_lines(R.words(spark, d)).select("doc_id", *_long("page"), "line_y", "line_text")


def normalise_xy(spark, d):
    return geometry.flip_origin(R.words(spark, d), F.lit(842.0)).select("doc_id", *_long("page", "ord"), "y0", "y1")


def span_merge(spark, d):
    """Each word longer than three characters arrives as two fragments half a point apart."""
    long = F.char_length("text") > 3
    pieces = F.when(
        long,
        F.array(
            F.struct(F.lit(0).alias("n"), F.substring("text", 1, 2).alias("text"), F.col("x0").alias("x0")),
            F.struct(
                F.lit(1).alias("n"), F.substr("text", F.lit(3)).alias("text"), (F.col("x0") + 10.5).alias("x0")
            ),
        ),
    ).otherwise(F.array(F.struct(F.lit(0).alias("n"), F.col("text").alias("text"), F.col("x0").alias("x0"))))
    words = geometry.key_grid(R.words(spark, d)).withColumn("p", F.explode(pieces)).select(
        "doc_id", "page", "line_y", (F.col("ord") * 2 + F.col("p.n")).alias("ord"), "p.x0",
        "y0", (F.col("p.x0") + 5.0 * F.char_length("p.text")).alias("x1"), "y1", "p.text",
    )
    return geometry.merge_spans(words).select(
        "doc_id", *_long("page", "span"), "line_y", "x0", "text", *_long("n_parts")
    )


def _spelling(kind, plain):
    """One amount in one of the ways statements spell it; the last two are no amounts."""
    return (
        F.when(kind == 0, plain).when(kind == 1, F.concat(F.lit("-"), plain))
        .when(kind == 2, F.concat(F.lit("("), plain, F.lit(")"))).when(kind == 3, F.concat(F.lit("SGD"), plain))
        .when(kind == 4, F.concat(plain, F.lit("%"))).when(kind == 5, F.concat(F.lit("12/"), plain))
        .when(kind == 6, F.concat(plain, F.lit("0"))).otherwise(F.concat(F.lit("1."), plain))
    )


def amount_tokens(spark, d):
    """Amounts among the tokens of all texts and of all order amounts in their spellings."""
    docs = R.table(spark, d, "documents").select(F.explode(F.split("text", r"\s+")).alias("token"))
    plain = F.expr(R.amount_text("cast(round(o_totalprice * 100) as bigint)"))
    spelt = _spelling(F.col("o_orderkey") % 8, plain)
    tokens = docs.unionByName(R.table(spark, d, "orders").select(F.explode(F.array(spelt)).alias("token")))
    found = tokens.filter(F.col("token").contains(".")).withColumn("value", K.amount("token"))
    return found.filter(F.col("value").isNotNull()).groupBy("token").agg(
        F.first("value").cast("double").alias("value"),
        F.bool_or(K.looks_negative("token")).alias("negative"),
        F.count(F.lit(1)).alias("n"),
    )


def text_rows(spark, d):
    amounts = [F.expr(R.amount_text(c)) for c in ("w_cents", "d_cents", "b_cents")]
    flat = R.ledger_cents(spark, d).select(
        "doc_id", "txn_seq", F.concat_ws(" ", "date_raw", "title", *amounts).alias("text")
    )
    return rows.parse_flat_text(flat).select(
        "doc_id", "txn_seq", "date_raw", F.col("txn_date").cast("string").alias("txn_date"), "description",
        *_money("withdrawal", "deposit", "balance"),
    )


def large_amount_repair(spark, d):
    return rows.repair_large(R.ledger(spark, d)).select(
        "doc_id", "txn_seq", *_money("withdrawal", "deposit", "balance"), "reclassified"
    )


# --- guard and results -----------------------------------------------------
def doc_guard(spark, d):
    return guard.guard_texts(R.table(spark, d, "documents")).select(
        "doc_id", "success", F.round("confidence", 6).alias("confidence"), _joined("warnings")
    )


def _spoilt(words: DataFrame) -> DataFrame:
    """Some words of some documents without a position, a page, a text or a document."""
    k, at = F.col("doc_id") % 37, F.col("ord")
    return words.withColumns({
        "y0": F.when((k == 1) & (at == 3), F.lit(float("nan"))).otherwise(F.col("y0")),
        "page": F.when((k == 2) & (at == 4), F.lit(None)).otherwise(F.col("page")),
        "text": F.when((k == 3) & (at == 5), F.lit(None)).otherwise(F.col("text")),
        "doc_id": F.when((k == 4) & (at == 2), F.lit(None)).otherwise(F.col("doc_id")),
    })


def doc_results(spark, d):
    """Results of statements some of which lost words."""
    words = _spoilt(R.words(spark, d))
    return _show_results(statement.document_results(R.documents(spark, d), words, sizes=R.word_counts(spark, d)))


def aborted_results(spark, d):
    """Results with documents that print conflicting totals aborted."""
    aborts = audit.aborted(totals=audit.document_totals(_lines(spark, d)))
    return _show_results(_results(spark, d, aborts))


def page_warnings(spark, d):
    counts = _counts(spark, d)
    told = statement.page_warnings(R.documents(spark, d), R.words(spark, d, counts), sizes=counts)
    return told.select("doc_id", *_long("page"), "message")


def rejected_words(spark, d):
    """Words spoilt by key are left out of every extraction and fail their documents; words without a document fail none."""
    spoilt = _spoilt(R.words(spark, d))
    bad = guard.rejected_words(spoilt).groupBy("doc_id", "reason").agg(F.count(F.lit(1)).alias("n_words"))
    failed = audit.aborted(rejected=guard.rejected_words(spoilt)).select("doc_id", "abort_reason")
    return bad.join(failed, "doc_id", "left").select("doc_id", "reason", "n_words", "abort_reason")


def route(spark, d):
    return guard.route(_results(spark, d)).select(
        "doc_id", F.round("confidence", 6).alias("confidence"), "route"
    )


def statement_report(spark, d):
    """Result and all figures of each document in one row."""
    ledger, results, _ = _extracted(spark, d)
    return results.join(L.summary(ledger), "doc_id", "left").select(
        "doc_id", "success", "transaction_count", "n_warnings",
        *_money("total_withdrawals", "total_deposits", "net_change", "first_balance", "closing_balance",
                "calculated_change", "opening_balance", "actual_change"),
    )


def entropy(spark, d):
    return guard.text_entropy(R.table(spark, d, "documents")).select("doc_id", "entropy")


def word_entropy(spark, d):
    return guard.text_entropy(R.words(spark, d))


def fingerprint(spark, d):
    """Documents per layout; layouts seen at least twice are known templates."""
    bounds = layout.column_bounds(layout.word_roles(_transaction_lines(spark, d)))
    prints = guard.fingerprints(bounds)
    known = prints.groupBy("fingerprint").count().filter("count > 1").select(
        "fingerprint", F.concat(F.lit("layout-"), F.substring("fingerprint", 1, 8)).alias("template")
    )
    return guard.match_templates(prints, known).groupBy("template").agg(F.count(F.lit(1)).alias("n_docs"))


def template_match(spark, d):
    """Every fortieth document's layout is known; all layouts, moved by their key, are matched within the tolerance."""
    bounds = layout.column_bounds(_roles(spark, d))
    moved = F.col("doc_id") % 23 * 0.47 - F.col("doc_id") % 3 * 8.13
    shifted = stored(bounds.select("doc_id", "n_clusters", *[(F.col(c) + moved).alias(c) for c in templates.EDGES]), "moved-layouts")
    known = shifted.filter(F.col("doc_id") % 40 == 7).select(F.col("doc_id").alias("template"), "n_clusters", *templates.EDGES)
    return templates.match(shifted, known).select("doc_id", "template", F.round("distance", 6).alias("distance"))


# --- layout ----------------------------------------------------------------
def _transaction_lines(spark, d):
    counts = _counts(spark, d)
    return layout.transaction_lines(R.words(spark, d, counts), sizes=counts)


def _roles(spark, d):
    return layout.word_roles(_transaction_lines(spark, d))


def transaction_trace(spark, d):
    lines = layout.trace(_transaction_lines(spark, d))
    return lines.select(
        "doc_id", *_long("page"), "line_y", "full_text", F.size("positions").cast("bigint").alias("n_words")
    )


def word_roles(spark, d):
    return _roles(spark, d).select("doc_id", *_long("page", "ord"), "line_y", "x0", "text", "role", *_money("amount"))


def position_stats(spark, d):
    return layout.position_stats(_roles(spark, d)).withColumn("mean_x", F.round("mean_x", 6))


def amount_clusters(spark, d):
    return layout.clusters(_roles(spark, d)).select(
        "doc_id", *_long("cluster", "n"), "min_x", "max_x", F.round("mean_x", 6).alias("mean_x"),
        F.array_join(F.col("sample_amounts").cast("array<string>"), "; ").alias("sample_amounts"),
    )


def _bounds(found: DataFrame) -> DataFrame:
    edges = [c for c in found.columns if c not in ("doc_id", "n_clusters")]
    return found.select("doc_id", *_long("n_clusters"), *[F.round(c, 6).alias(c) for c in edges])


def column_bounds(spark, d):
    return _bounds(layout.column_bounds(_roles(spark, d)))


def sampled_bounds(spark, d):
    """Bounds from the first transaction page of each document only."""
    return _bounds(layout.column_bounds(_roles(spark, d), max_pages=1))


def inspect_area(spark, d):
    return layout.inspect_area(R.words(spark, d), 2, (240.0, 350.0)).select(
        "doc_id", *_long("page"), "line_y", "line_text"
    )


# --- ledger ----------------------------------------------------------------
def deposits(spark, d):
    return L.deposits(R.ledger(spark, d)).select("doc_id", "date_raw", "description", *_money("deposit", "balance"))


def large_withdrawals(spark, d):
    return L.large_withdrawals(R.ledger(spark, d)).select(
        "doc_id", "date_raw", "description", *_money("withdrawal", "balance")
    )


def keyword_search(spark, d):
    return L.keyword_search(R.ledger(spark, d), "paynow").select(
        "doc_id", "date_raw", "description", *_money("withdrawal", "deposit", "balance")
    )


def page_rows(spark, d):
    return _show_rows(L.on_page(R.ledger(spark, d), 2))


def head_n(spark, d):
    return L.display_rows(R.ledger(spark, d), 10).select(
        "doc_id", *_long("txn_seq", "page"), "date_raw", "description", "description_more", "description_short",
        *_money("withdrawal", "deposit", "balance"),
    )


def ledger_stats(spark, d):
    out = L.summary(R.ledger(spark, d))
    counts = ("n_transactions", "n_withdrawals", "n_deposits")
    return out.select("doc_id", *counts, *_money(*[c for c in out.columns if c not in ("doc_id", *counts)]))


def inferred_sides(spark, d):
    """Every second document as one that prints withdrawals and deposits in one column."""
    one = F.col("doc_id") % 2 == 0
    printed = R.ledger(spark, d).withColumns({
        "withdrawal": F.when(one, F.coalesce("withdrawal", "deposit")).otherwise(F.col("withdrawal")),
        "deposit": F.when(~one, F.col("deposit")),
    })
    return L.infer_sides(printed, printed.filter(one)).select(
        "doc_id", "txn_seq", *_money("withdrawal", "deposit", "unplaced"), "side_source"
    )


def daily_summary(spark, d):
    return L.daily_summary(R.ledger(spark, d)).select(
        F.col("txn_date").cast("string").alias("txn_date"), *_money("withdrawal", "deposit")
    )


def column_profile(spark, d):
    return L.column_profile(R.ledger(spark, d).drop("okey"))


def balance_continuity(spark, d):
    return L.balance_continuity(R.ledger(spark, d)).select(
        "doc_id", "txn_seq", *_money("expected", "balance", "difference"), "status"
    )


def discrepancies(spark, d):
    return L.discrepancies(R.ledger(spark, d)).select(
        "doc_id", "index", "date", *_money("expected", "actual", "difference")
    )


def filtered_checks(spark, d):
    """Ordered checks on a ledger from which rows were taken out."""
    rest = L.drop_repeats(_rescanned(spark, d)).filter(F.col("okey") % 7 != 0)
    checked = L.rebuild_balance(L.date_order(L.balance_continuity(rest)))
    return checked.select("doc_id", "txn_seq", "status", *_money("difference", "running_balance"), "goes_back")


def running_balance(spark, d):
    return L.rebuild_balance(R.ledger(spark, d)).select("doc_id", "txn_seq", *_money("running_balance"))


def date_order(spark, d):
    moved = R.ledger(spark, d).withColumn(
        "txn_date", F.when(F.col("okey") % 61 == 0, F.date_sub("txn_date", 400)).otherwise(F.col("txn_date"))
    )
    return L.date_order(moved).select(
        "doc_id", "txn_seq", F.col("txn_date").cast("string").alias("txn_date"), "goes_back"
    )


def _rescanned(spark, d):
    once, place = R.ledger(spark, d), lambda *add: F.array(*[F.col("txn_seq") + F.lit(n).cast("bigint") for n in add])
    return once.withColumn("txn_seq", F.explode(F.when(F.col("okey") % 79 == 0, place(0, 1_000_000_000)).otherwise(place(0))))


def duplicates(spark, d):
    return L.duplicates(_rescanned(spark, d)).select(
        "doc_id", "date_raw", "description", *_money("withdrawal", "deposit", "balance"), "copies", "first_seq"
    )


def first_occurrences(spark, d):
    return L.drop_repeats(_rescanned(spark, d)).select("doc_id", "txn_seq", "description", *_money("balance"))


# --- audit -----------------------------------------------------------------
def golden_compare(spark, d):
    counts = _counts(spark, d)
    golden = R.ledger_cents(spark, d, sizes=R.order_counts(counts)).select(
        "doc_id", "txn_seq",
        R.cents_to_money_expr(F.col("w_cents") + F.when(F.col("okey") % 29 == 0, 100).otherwise(0)).alias("withdrawal"),
        R.cents_to_money("d_cents").alias("deposit"),
        R.cents_to_money("b_cents").alias("balance"),
        F.when(F.col("okey") % 31 == 0, F.lit("NO SUCH TEXT"))
        .otherwise(F.concat(F.substring_index("title", " ", 1), F.lit(".*"))).alias("description"),
    )
    return audit.golden_compare(statement.transactions(R.words(spark, d, counts), sizes=counts), golden).select(
        "doc_id", "txn_seq", "withdrawal_ok", "deposit_ok", "balance_ok", "description_ok", "found"
    )


def closing_check(spark, d):
    expected = R.ledger_cents(spark, d).groupBy("doc_id").agg(
        F.max_by("run_cents", "txn_seq").alias("_closing")
    ).select(
        "doc_id", F.lit(R.OPENING_CENTS / 100).cast(S.MONEY).alias("opening"),
        R.cents_to_money("_closing").alias("closing"),
    )
    return audit.closing_check(R.ledger(spark, d), expected).select(
        "doc_id", *_money("last_balance", "closing", "expected_change"), "status"
    )


def field_rules(spark, d):
    raw = F.when(F.col("okey") % 73 == 0, F.lit(None)).when(F.col("okey") % 71 == 0, "99/99/9999")
    spoilt = R.ledger(spark, d).withColumn("date_raw", raw.otherwise(F.col("date_raw")))
    return audit.field_rules(spoilt).select("doc_id", "txn_seq", _joined("missing_fields"), "date_valid", "one_side")


def currencies(spark, d):
    return audit.currencies(geometry.grid_lines(R.words(spark, d)))


def conflicting_totals(spark, d):
    return audit.document_totals(_lines(spark, d)).select(
        "doc_id", "n_totals", *_money("least", "greatest"), "conflict"
    )


def page_anomalies(spark, d):
    """Page 2 of some documents is delivered a second time as page 90."""
    words = R.words(spark, d)
    twice = words.filter((F.col("page") == 2) & (F.col("doc_id") % 17 == 0)).withColumn("page", F.lit(90))
    found = audit.page_anomalies(R.documents(spark, d), words.unionByName(twice))
    return found.select("doc_id", *_long("page"), "anomaly", "copies")


def decisions(spark, d):
    ledger, results, _ = _extracted(spark, d)
    faults = audit.arithmetic(L.balance_continuity(ledger))
    return audit.decisions(results, faults).select(
        "doc_id", F.round("confidence", 6).alias("confidence"), "n_breaks", "n_unverifiable", "n_one_side", "decision"
    )


def _corrections(ledger: DataFrame) -> DataFrame:
    entry = lambda when, field, value, version: F.when(
        when,
        F.struct(F.lit(field).alias("field"), F.lit(value).cast("string").alias("value"), F.lit(version).alias("version")),
    )
    nth = lambda n: F.col("okey") % n == 0
    entries = F.array_compact(
        F.array(
            entry(nth(41), "withdrawal", "12.34", 1), entry(nth(82), "withdrawal", "56.78", 2),
            entry(nth(43), "description", "CORRECTED", 1), entry(nth(47), "balance", None, 1),
            entry(nth(123), "withdrawal", "12,34x", 3), entry(nth(53), "payee", "X", 1),
        )
    )
    return ledger.select("doc_id", "txn_seq", F.explode(entries).alias("c")).select("doc_id", "txn_seq", "c.*")


def corrections(spark, d):
    ledger = R.ledger(spark, d)
    return audit.apply_corrections(ledger, _corrections(ledger)).select(
        "doc_id", "txn_seq", "description", *_money("withdrawal", "deposit", "balance")
    )


def correction_audit(spark, d):
    ledger = R.ledger(spark, d)
    return audit.correction_audit(ledger, _corrections(ledger)).select(
        "doc_id", "txn_seq", "field", "old_value", "new_value", *_long("version")
    )


def correction_history(spark, d):
    ledger = R.ledger(spark, d)
    return audit.correction_history(ledger.filter(F.col("okey") % 19 != 0), _corrections(ledger)).select(
        "doc_id", "txn_seq", "field", "value", *_long("version"), "outcome"
    )


def ledger_as_of(spark, d):
    """Every ledger as extracted and as of the first and second version of its corrections."""
    ledger = R.ledger(spark, d)
    asked = ledger.select("doc_id", F.explode(F.array(*[F.lit(v) for v in range(3)])).alias("as_of")).distinct()
    return audit.ledger_as_of(ledger, _corrections(ledger), asked).select(
        "doc_id", "txn_seq", *_long("as_of"), "description", *_money("withdrawal", "deposit", "balance")
    )


def correction_intervals(spark, d):
    ledger = R.ledger(spark, d)
    return audit.correction_intervals(ledger, _corrections(ledger)).select(
        "doc_id", "txn_seq", "field", "value", *_long("from_version", "to_version")
    )


# --- sources, sinks, streaming --------------------------------------------
def result_json(spark, d):
    path = new_path(spark, "results")
    ledger, results, told = _extracted(spark, d)
    tables.write_results(tables.result_records(ledger, results, page_warnings=told), path)
    return _show_rows(tables.result_rows(tables.read_results(spark, path, LONG)))


def export_formats(spark, d):
    ledger = R.ledger(spark, d).drop("okey")
    out = None
    for fmt in ("csv", "parquet"):
        path = new_path(spark, f"ledger-{fmt}")
        tables.write_ledger(ledger, path, fmt)
        back = _show_rows(tables.read_ledger(spark, path, fmt, LONG)).withColumn("format", F.lit(fmt))
        out = back if out is None else out.unionByName(back)
    return out


def stream_intake(spark, d):
    """Words taken in as a stream and read back as the current ledger. Two documents of three come in two batches: first their
    later pages, then the others, with some pages once more and some of their pages spoilt at first."""
    source, store = new_path(spark, "delivered"), new_path(spark, "intake")
    words = R.words(spark, d, _counts(spark, d))
    late = (F.col("doc_id") % 3 != 0) & (F.col("page") <= F.col("doc_id") % 3 + 1)
    wrong = (F.col("doc_id") % 7 == 0) & (F.col("page") == 2)
    first = words.filter(~late).withColumn("text", F.when(wrong, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    for part in (first, words.filter(late | wrong | (F.col("doc_id") % 5 == 0))):
        part.write.mode("append").parquet(source)
        intake.run_available(spark, source, store, LONG)
    return _show_rows(intake.current_ledger(spark, store, LONG))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        statement_totals, parse_roundtrip, carry_pages, learned_columns, page_list, page_text, lines_greedy,
        lines_grid, normalise_xy, span_merge, amount_tokens, text_rows, large_amount_repair, doc_guard,
        doc_results, aborted_results, page_warnings, rejected_words, route, statement_report, entropy, word_entropy, fingerprint,
        template_match, column_sources,
        transaction_trace, word_roles, position_stats, amount_clusters, column_bounds, sampled_bounds,
        inspect_area, deposits, large_withdrawals, keyword_search, page_rows, head_n, ledger_stats,
        daily_summary, column_profile, balance_continuity, discrepancies, running_balance, filtered_checks, date_order,
        duplicates, first_occurrences, golden_compare, closing_check, field_rules, currencies,
        conflicting_totals, page_anomalies, decisions, corrections, correction_audit, correction_history, result_json,
        export_formats, stream_intake, inferred_sides, ledger_as_of, correction_intervals,
    )
}
