"""Comparison with known values, validation rules, decisions and corrections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import schemas as S
from ..functions import tokens as K
from .guard import PAGES_PER_PART, part_of_page

CENT = S.BALANCE_TOLERANCE
CORRECTABLE = ("date_raw", "description", "withdrawal", "deposit", "balance")


def golden_compare(ledger: DataFrame, golden: DataFrame, first: int = 5) -> DataFrame:
    """Compare the first rows of each document with known ones, by position.

    Both sides are exact (missing equals missing), the balance within a cent with missing as 0.
    The description pattern is reported too, though it does not decide anything. Expected rows that the
    ledger does not have stay, with ``found`` false and every check failed.
    """
    want = golden.filter(F.col("txn_seq") <= first).select(
        "doc_id", "txn_seq",
        *[F.col(c).alias(f"expected_{c}") for c in ("withdrawal", "deposit", "balance")],
        F.col("description").alias("expected_pattern"),
    )
    got = ledger.filter(F.col("txn_seq") <= first).withColumn("found", F.lit(True))
    found = F.coalesce("found", F.lit(False))
    close = F.abs(K.zero_if_null("balance") - K.zero_if_null("expected_balance"))
    return want.join(got, ["doc_id", "txn_seq"], "left").withColumns(
        {
            "withdrawal_ok": found & F.col("withdrawal").eqNullSafe(F.col("expected_withdrawal")),
            "deposit_ok": found & F.col("deposit").eqNullSafe(F.col("expected_deposit")),
            "balance_ok": found & (close < F.lit(CENT).cast(S.MONEY)),
            "description_ok": F.coalesce(F.expr("description rlike expected_pattern"), F.lit(False)),
            "found": found,
        }
    )


def closing_check(ledger: DataFrame, expected: DataFrame) -> DataFrame:
    """Last balance against the expected closing one. ``expected``: doc_id, opening, closing.

    Documents without any row are MISSING."""
    last = ledger.groupBy("doc_id").agg(F.max_by("balance", "txn_seq").alias("last_balance"), F.count(F.lit(1)).alias("_n"))
    ok = F.abs(F.col("last_balance") - F.col("closing")) < F.lit(CENT).cast(S.MONEY)
    return last.join(expected, "doc_id", "right").withColumns(
        {
            "expected_change": F.col("closing") - F.col("opening"),
            "status": F.when(F.col("_n").isNull(), "MISSING").when(ok, "OK").when(ok.isNull(), "UNVERIFIABLE").otherwise("MISMATCH"),
        }
    ).drop("_n")


def field_rules(ledger: DataFrame) -> DataFrame:
    """Per row: mandatory fields that are missing, typed date, and one-side-only arithmetic."""
    needed = {"date_raw": "date", "description": "description", "balance": "balance"}
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(n)) for c, n in needed.items()]))
    w, d = F.col("withdrawal").isNotNull(), F.col("deposit").isNotNull()
    return ledger.withColumns(
        {
            "missing_fields": missing,
            "date_valid": K.parse_date("date_raw").isNotNull(),
            "one_side": w != d,
        }
    )


def currencies(lines: DataFrame) -> DataFrame:
    """The currency named by the currency lines of each document; more than one is a fault."""
    named = lines.filter(F.upper("line_text").contains(S.CURRENCY_MARKER)).select(
        "doc_id",
        K.strip(F.regexp_extract(F.upper("line_text"), r"CURRENCY:\s*(.*)", 1)).alias("currency"),
    )
    distinct = named.groupBy("doc_id", "currency").count()
    return distinct.groupBy("doc_id").agg(
        F.min("currency").alias("currency"), F.count(F.lit(1)).alias("n_currencies")
    )


def document_totals(lines: DataFrame, marker: str = S.TABLE_END_MARKERS[1]) -> DataFrame:
    """Distinct totals printed in each document; more than one is a conflict that aborts it."""
    total = F.try_element_at(F.filter("words", lambda w: w["amount"].isNotNull()), F.lit(-1))["amount"]
    printed = lines.filter(F.col("line_text").contains(marker)).select("doc_id", total.alias("total"))
    distinct = printed.filter(F.col("total").isNotNull()).groupBy("doc_id", "total").count()
    return distinct.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_totals"), F.min("total").alias("least"), F.max("total").alias("greatest")
    ).withColumn("conflict", F.col("n_totals") > 1)


def page_anomalies(documents: DataFrame, words: DataFrame) -> DataFrame:
    """Missing, surplus and repeated pages, one row each.

    ``surplus`` pages lie beyond the page count or belong to no listed document. ``repeated`` names the first of several pages with equal content and how many there are.
    Content is hashed word by word and combined without order, so pages are never gathered.
    """
    mark = F.xxhash64("ord", "x0", "y0", "text")
    pages = words.groupBy("doc_id", "page").agg(
        F.bit_xor(mark).alias("_x"), F.sum(mark.cast("decimal(20,0)")).alias("_s"), F.count(F.lit(1)).alias("_n")
    )
    repeated = (
        pages.groupBy("doc_id", "_x", "_s", "_n")
        .agg(F.min("page").alias("page"), F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
        .select("doc_id", "page", F.lit("repeated").alias("anomaly"), "copies")
    )
    seen = pages.groupBy("doc_id", part_of_page().alias("part")).agg(F.collect_list("page").alias("_seen"))
    last = F.floor((F.col("n_pages") - 1) / PAGES_PER_PART).cast("bigint")
    parts = documents.filter(F.col("n_pages") > 0).select(
        "doc_id", "n_pages", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("part")
    )
    lo = F.col("part") * PAGES_PER_PART + 1
    hi = F.least(F.col("n_pages"), (F.col("part") + 1) * PAGES_PER_PART)
    gone = F.array_except(
        F.sequence(lo, hi).cast("array<int>"), F.coalesce("_seen", F.array().cast("array<int>"))
    )
    # Pages find their document through (document, part): a long one is spread over many parts.
    placed = pages.select("doc_id", "page", part_of_page().alias("part")).join(parts, ["doc_id", "part"], "left")
    surplus = placed.filter(F.col("n_pages").isNull() | (F.col("page") > F.col("n_pages"))).select(
        "doc_id", "page", F.lit("surplus").alias("anomaly"), F.lit(1).cast("bigint").alias("copies")
    )
    missing = parts.join(seen, ["doc_id", "part"], "left").select(
        "doc_id", F.explode(gone).alias("page"),
        F.lit("missing").alias("anomaly"), F.lit(0).cast("bigint").alias("copies"),
    )
    return missing.unionByName(surplus).unionByName(repeated)


def aborted(totals: DataFrame | None = None, anomalies: DataFrame | None = None, rejected: DataFrame | None = None,
            damage: DataFrame | None = None) -> DataFrame:
    """Documents the audit rejects outright, with a reason: input of ``guard.document_results``.

    ``rejected``: words that extraction leaves out (``guard.rejected_words``); their documents fail. ``damage``: records and
    files that could not be read (``tables.read_words_checked``), placed by ``tables.damaged_documents``."""
    found = []
    if totals is not None:
        found.append(
            totals.filter("conflict").select("doc_id", F.lit("Multiple conflicting totals").alias("abort_reason"))
        )
    if anomalies is not None:
        found.append(
            anomalies.groupBy("doc_id").agg(
                F.format_string(S.ABORT_PAGE, F.min("page")).alias("abort_reason")
            )
        )
    if rejected is not None:
        found.append(
            rejected.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
                F.format_string(S.ABORT_WORDS, F.count(F.lit(1))).alias("abort_reason")
            )
        )
    if damage is not None:
        found.append(damage.select("doc_id", "abort_reason"))
    return reduce(DataFrame.unionByName, found).groupBy("doc_id").agg(F.max("abort_reason").alias("abort_reason"))


def arithmetic(checked: DataFrame) -> DataFrame:
    """doc_id, n_breaks, n_unverifiable, n_one_side of a ledger checked by ``ledger.balance_continuity``."""
    return checked.groupBy("doc_id").agg(
        F.count_if(F.col("status") == "BREAK").alias("n_breaks"),
        F.count_if(F.col("status") == "UNVERIFIABLE").alias("n_unverifiable"),
        F.count_if(F.col("withdrawal").isNull() == F.col("deposit").isNull()).alias("n_one_side"),
    )


def decisions(results: DataFrame, arithmetic: DataFrame, approve_at: float = 0.8, reject_below: float = 0.5) -> DataFrame:
    """approve / review / reject per document. ``arithmetic``: counts of faults per doc_id.

    An aborted document goes to review, as does one with a wrong or unverifiable balance or with a row that
    moves both sides or none; otherwise the confidence decides.
    """
    counts = ("n_breaks", "n_unverifiable", "n_one_side")
    out = results.join(arithmetic.select("doc_id", *counts), "doc_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in counts}
    )
    return out.withColumn(
        "decision",
        F.when(~F.col("success"), "review")
        .when(F.col("n_breaks") + F.col("n_unverifiable") + F.col("n_one_side") > 0, "review")
        .when(F.col("confidence") >= approve_at, "approve")
        .when(F.col("confidence") >= reject_below, "review")
        .otherwise("reject"),
    )


def _readable(types: dict[str, str]):
    """Whether a correction names a known field and a value of its type (null clears a field)."""
    out = F.lit(False)
    for f in CORRECTABLE:
        out = F.when(F.col("field") == f, F.col("value").isNull() | F.col("value").try_cast(types[f]).isNotNull()).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _latest(corrections: DataFrame, types: dict[str, str], *more: str) -> DataFrame:
    """The readable entry of highest version of each field, per row and ``more``; of equal versions the greatest value, null
    before all."""
    entry = F.struct("version", "value")
    pick = lambda f: F.max(F.when(F.col("field") == f, entry))
    usable = corrections.filter(_readable(types))
    return usable.groupBy("doc_id", "txn_seq", *more).agg(*[pick(f).alias(f"_new_{f}") for f in CORRECTABLE])


def correction_history(ledger: DataFrame, corrections: DataFrame) -> DataFrame:
    """Every correction with its ``outcome``: applied, superseded by a later one, rejected (unreadable value or unknown
    field), or orphaned (no such row). No entry is lost."""
    types = dict(ledger.dtypes)
    latest = _latest(corrections, types)
    wins = F.lit(False)
    for f in CORRECTABLE:
        new = F.col(f"_new_{f}")
        same = new["version"].eqNullSafe(F.col("version")) & new["value"].eqNullSafe(F.col("value"))
        wins = F.when(F.col("field") == f, new.isNotNull() & same).otherwise(wins)
    rows = ledger.select("doc_id", "txn_seq", F.lit(True).alias("_row"))
    out = corrections.join(latest, ["doc_id", "txn_seq"], "left").join(rows, ["doc_id", "txn_seq"], "left")
    outcome = (
        F.when(F.col("_row").isNull(), "orphaned").when(~_readable(types), "rejected").when(wins, "applied").otherwise("superseded")
    )
    return out.select("doc_id", "txn_seq", "field", "value", "version", outcome.alias("outcome"))


def apply_corrections(ledger: DataFrame, corrections: DataFrame) -> DataFrame:
    """Reviewer values override extracted ones; the highest readable version of a field counts. An unreadable
    value changes nothing: :func:`correction_history` lists it as rejected.

    ``corrections``: doc_id, txn_seq, field, value (text, null to clear), version.
    """
    types = dict(ledger.dtypes)
    return _overridden(ledger.join(_latest(corrections, types), ["doc_id", "txn_seq"], "left"), types)


def _overridden(out: DataFrame, types: dict[str, str]) -> DataFrame:
    new = {
        f: F.when(F.col(f"_new_{f}").isNotNull(), F.col(f"_new_{f}.value").try_cast(types[f])).otherwise(F.col(f))
        for f in CORRECTABLE
    }
    out = out.withColumns(new).drop(*[f"_new_{f}" for f in CORRECTABLE])
    return out.withColumn("txn_date", K.parse_date("date_raw")) if "txn_date" in types else out


def ledger_as_of(ledger: DataFrame, corrections: DataFrame, asked: DataFrame) -> DataFrame:
    """The ledger as it stood at earlier correction versions, with ``as_of``.

    ``asked``: doc_id, as_of; a document may be asked for at several versions, documents not asked for give no rows. Entries
    meet the versions asked for on their document; those that came later are left out before the newest of each field is
    taken, so versions are never joined by inequality."""
    types = dict(ledger.dtypes)
    points = asked.select("doc_id", "as_of").distinct()
    known = corrections.join(points, "doc_id").filter(F.col("version") <= F.col("as_of"))
    latest = _latest(known, types, "as_of")
    return _overridden(ledger.join(points, "doc_id").join(latest, ["doc_id", "txn_seq", "as_of"], "left"), types)


def correction_intervals(ledger: DataFrame, corrections: DataFrame) -> DataFrame:
    """doc_id, txn_seq, field, value, from_version, to_version: while which versions each value of a corrected field held. The
    extracted value holds from null, the last one to null; entries that nobody can read never held."""
    types = dict(ledger.dtypes)
    entries = corrections.filter(_readable(types)).groupBy("doc_id", "txn_seq", "field", "version").agg(F.max(F.struct("value"))["value"].alias("value"))
    first = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in CORRECTABLE])
    rows = ledger.join(entries.select("doc_id", "txn_seq").distinct(), ["doc_id", "txn_seq"], "left_semi")
    original = rows.select("doc_id", "txn_seq", F.explode(first).alias("c")).select("doc_id", "txn_seq", "c.*").join(
        entries.select("doc_id", "txn_seq", "field").distinct(), ["doc_id", "txn_seq", "field"], "left_semi"
    )
    every = original.withColumn("version", F.lit(None).cast(entries.schema["version"].dataType)).unionByName(
        entries.join(rows.select("doc_id", "txn_seq"), ["doc_id", "txn_seq"], "left_semi")
    )
    by = W.partitionBy("doc_id", "txn_seq", "field").orderBy(F.col("version").asc_nulls_first())
    return every.select("doc_id", "txn_seq", "field", "value", F.col("version").alias("from_version"), F.lead("version").over(by).alias("to_version"))


def correction_audit(ledger: DataFrame, corrections: DataFrame) -> DataFrame:
    """One row per field whose value the corrections changed."""
    types = dict(ledger.dtypes)
    out = ledger.join(_latest(corrections, types), ["doc_id", "txn_seq"])
    changes = [
        F.when(
            F.col(f"_new_{f}").isNotNull()
            & ~F.col(f).eqNullSafe(F.col(f"_new_{f}.value").try_cast(types[f])),
            F.struct(
                F.lit(f).alias("field"), F.col(f).cast("string").alias("old_value"),
                F.col(f"_new_{f}.value").try_cast(types[f]).cast("string").alias("new_value"),
                F.col(f"_new_{f}.version").alias("version"),
            ),
        )
        for f in CORRECTABLE
    ]
    return out.select("doc_id", "txn_seq", F.explode(F.array_compact(F.array(*changes))).alias("c")).select(
        "doc_id", "txn_seq", "c.*"
    )
