"""Filters, totals and ordered checks over transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import tokens as K
from ..functions.ordered import BLOCK, running_total, with_previous

DUPLICATE_KEY = ("doc_id", "date_raw", "description", "withdrawal", "deposit", "balance")


# --- filters ---------------------------------------------------------------
def deposits(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("deposit").isNotNull())


def large_withdrawals(ledger: DataFrame, limit=100) -> DataFrame:
    return ledger.filter(F.col("withdrawal") > limit)


def keyword_search(ledger: DataFrame, keyword: str, literal: bool = False) -> DataFrame:
    return ledger.filter(K.keyword_match("description", keyword, literal))


def on_page(ledger: DataFrame, page: int) -> DataFrame:
    return ledger.filter(F.col("page") == page)


def head(ledger: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of every document: a plain filter, as positions are stored."""
    return ledger.filter(F.col("txn_seq") <= n)


def display_rows(ledger: DataFrame, n: int = 10) -> DataFrame:
    """What the printed report shows of the first rows: clipped text, only amounts that count."""
    shown = lambda c: F.when(K.present(c), F.col(c)).alias(c)
    return head(ledger, n).select(
        "doc_id", "txn_seq", "date_raw", "page",
        K.clip("description", 1, 80).alias("description"),
        K.clip("description", 81, 80).alias("description_more"),
        K.clip("description", 1, 60).alias("description_short"),
        *[shown(c) for c in ("withdrawal", "deposit", "balance")],
    )


# --- totals ----------------------------------------------------------------
def _sum(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0).cast(S.MONEY_TOTAL))


def totals(ledger: DataFrame) -> DataFrame:
    w, d = _sum("withdrawal"), _sum("deposit")
    return ledger.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_transactions"),
        w.alias("total_withdrawals"), d.alias("total_deposits"), (d - w).alias("net_change"),
    )


def summary(ledger: DataFrame) -> DataFrame:
    """All figures of the per-document report in one aggregation, combined before the shuffle."""
    w, d = _sum("withdrawal"), _sum("deposit")
    row = F.struct(
        F.col("balance").alias("b"),
        (F.col("balance") + K.zero_if_null("withdrawal") - K.zero_if_null("deposit")).alias("before"),
    )
    countable = K.present("balance") & ~F.coalesce(
        F.col("description").contains(S.FORWARD_MARKERS[0]), F.lit(False)
    )
    out = ledger.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_transactions"),
        F.count("withdrawal").alias("n_withdrawals"),
        F.count("deposit").alias("n_deposits"),
        w.alias("total_withdrawals"),
        d.alias("total_deposits"),
        F.min_by(row, "txn_seq").alias("_first"),
        F.max_by(row, "txn_seq").alias("_last"),
        F.min_by("balance", F.when(countable, F.col("txn_seq"))).alias("first_non_forward_balance"),
    )
    first, last = F.col("_first.b"), F.col("_last.b")
    return out.select(
        "doc_id", "n_transactions", "n_withdrawals", "n_deposits", "total_withdrawals", "total_deposits",
        (F.col("total_deposits") - F.col("total_withdrawals")).alias("net_change"),
        F.col("_first.before").alias("opening_balance"),
        last.alias("closing_balance"),
        (last - F.col("_first.before")).alias("actual_change"),
        first.alias("first_balance"),
        (last - first).alias("calculated_change"),
        "first_non_forward_balance",
    )


def daily_summary(ledger: DataFrame, *keys: str) -> DataFrame:
    """Both sides summed per day, over all documents or per ``keys``."""
    return ledger.groupBy(*keys, "txn_date").agg(
        _sum("withdrawal").alias("withdrawal"), _sum("deposit").alias("deposit")
    )


def column_profile(ledger: DataFrame) -> DataFrame:
    """One row per column: type, row count, non-null count. One pass over the table."""
    counted = ledger.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(f"_n{i}") for i, c in enumerate(ledger.columns)]
    )
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("data_type"), F.col(f"_n{i}").alias("n_present"))
            for i, (c, t) in enumerate(ledger.dtypes)
        ]
    )
    return counted.select("_rows", F.explode(entries).alias("e")).select(
        "e.column_name", "e.data_type", F.col("_rows").alias("n_rows"), "e.n_present"
    )


# --- ordered checks --------------------------------------------------------
def balance_continuity(ledger: DataFrame, tolerance: str = S.BALANCE_TOLERANCE, block: int = BLOCK) -> DataFrame:
    """Compare each balance with the one before it plus the row's own movement.

    ``status``: FIRST, OK, BREAK, or UNVERIFIABLE when a balance is missing on either side. The row before is the
    one with the next lower ``txn_seq``, so a filtered ledger is checked as it stands.
    """
    out = with_previous(ledger, "doc_id", "txn_seq", {"previous_balance": "balance", "_before": "txn_seq"}, block)
    expected = F.col("previous_balance") - K.zero_if_null("withdrawal") + K.zero_if_null("deposit")
    out = out.withColumn("expected", expected).withColumn("difference", F.col("balance") - F.col("expected"))
    return out.withColumn(
        "status",
        F.when(F.col("_before").isNull(), "FIRST")
        .when(F.col("difference").isNull(), "UNVERIFIABLE")
        .when(F.abs("difference") > F.lit(tolerance).cast("decimal(18,2)"), "BREAK")
        .otherwise("OK"),
    ).drop("_before")


def discrepancies(ledger: DataFrame, tolerance: str = S.BALANCE_TOLERANCE) -> DataFrame:
    """Only the breaks, with their place counted from 0."""
    found = balance_continuity(ledger, tolerance).filter(F.col("status") == "BREAK")
    return found.select(
        "doc_id", (F.col("txn_seq") - 1).alias("index"), F.col("date_raw").alias("date"),
        "expected", F.col("balance").alias("actual"), "difference",
    )


def rebuild_balance(ledger: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add ``running_balance``: opening balance of the document plus all movements so far.

    The first row's balance is opening plus its own movement, so it enters the running sum as
    that row's step and no second pass over the document is needed. A document whose first
    balance is missing has no opening balance: its running balance is null.
    """
    move = K.zero_if_null("deposit") - K.zero_if_null("withdrawal")
    ledger = with_previous(ledger, "doc_id", "txn_seq", {"_before": "txn_seq"}, block)
    first = F.col("_before").isNull()
    step = F.when(first, F.col("balance")).otherwise(move).cast(S.MONEY)
    unknown = (first & F.col("balance").isNull()).cast("int")
    out = running_total(ledger, "doc_id", "txn_seq", {"_sum": step, "_unknown": unknown}, block)
    return out.withColumn("running_balance", F.when(F.col("_unknown") == 0, F.col("_sum"))).drop("_sum", "_unknown", "_before")


def date_order(ledger: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add ``goes_back``: the date is before the date of the previous row."""
    out = with_previous(ledger, "doc_id", "txn_seq", {"previous_date": "txn_date"}, block)
    return out.withColumn(
        "goes_back", F.coalesce(F.col("txn_date") < F.col("previous_date"), F.lit(False))
    )


def duplicates(ledger: DataFrame, keys=DUPLICATE_KEY) -> DataFrame:
    """Groups of equal transactions: how often, and the first place. Nulls are equal."""
    return ledger.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("copies"), F.min("txn_seq").alias("first_seq")
    ).filter(F.col("copies") > 1)


def drop_repeats(ledger: DataFrame, keys=DUPLICATE_KEY) -> DataFrame:
    """Keep the first of equal transactions. One aggregation: copies are combined before the
    shuffle, so any number of them in one group costs no more than one per task."""
    rest = [c for c in ledger.columns if c not in keys]
    kept = ledger.groupBy(*keys).agg(F.min_by(F.struct(*rest), "txn_seq").alias("_r"))
    return kept.select(*[F.col(f"_r.{c}").alias(c) if c in rest else F.col(c) for c in ledger.columns])


def infer_sides(ledger: DataFrame, single: DataFrame, withdrawal_words=S.WITHDRAWAL_KEYWORDS, deposit_words=S.DEPOSIT_KEYWORDS) -> DataFrame:
    """Sides of amounts in documents whose layout has one amount column for both, ``single`` (doc_id); others stay as they are.

    Words of the description decide first, then the step from the balance before: a falling one is a withdrawal. ``side_source`` tells
    which (keyword, balance or none). An amount that neither decides is on no side and stands in ``unplaced``; a zero is on none."""
    marks = single.select("doc_id").distinct().withColumn("_single", F.lit(True))
    rows = with_previous(ledger.join(marks, "doc_id", "left"), "doc_id", "txn_seq", {"_before": "balance"})
    upper, step, amount = F.upper("description"), F.col("balance") - F.col("_before"), F.coalesce("withdrawal", "deposit")
    is_out = F.coalesce(K.contains_any(upper, withdrawal_words), F.lit(False))
    is_in = ~is_out & F.coalesce(K.contains_any(upper, deposit_words), F.lit(False))
    out = F.when(is_out, True).when(is_in, False).when(step < 0, True).when(step > 0, False)
    source = F.when(is_out | is_in, "keyword").when(step != 0, "balance").otherwise("none")
    single_, there = F.coalesce("_single", F.lit(False)), K.present(amount)
    return rows.withColumns({
        "withdrawal": F.when(single_, F.when(there & out, amount)).otherwise(F.col("withdrawal")),
        "deposit": F.when(single_, F.when(there & ~out, amount)).otherwise(F.col("deposit")),
        "unplaced": F.when(single_ & there & out.isNull(), amount),
        "side_source": F.when(single_ & there, source),
    }).drop("_single", "_before")
