"""Lines -> table region -> transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import schemas as S
from ..functions import tokens as K
from ..functions.ordered import prefix_scan
from ..sources.scratch import stored
from .geometry import BAND

AMOUNT_COLUMNS = ("withdrawal", "deposit", "balance")


def mark_region(lines: DataFrame, end_markers=S.TABLE_END_MARKERS, spread: bool = False) -> DataFrame:
    """Add ``has_table`` (page level), ``in_table`` and ``opens`` (line level).

    The table starts after the first currency line or at the first line that begins with a
    date, whichever comes first, and stops before the first end marker inside it.

    ``spread``: start and stop are aggregates of one row per page that are joined back, so no task holds the lines of a page.
    ``lines`` is read three times there and should be a written table.
    """
    # Same order as the row numbering that follows, so one sort serves both.
    page = W.partitionBy("doc_id", "page").orderBy("line_y").rowsBetween(
        W.unboundedPreceding, W.unboundedFollowing
    )

    def page_least(rows: DataFrame, name: str, value: Column) -> DataFrame:
        if not spread:
            return rows.withColumn(name, F.min(value).over(page))
        return rows.join(rows.groupBy("doc_id", "page").agg(F.min(value).alias(name)), ["doc_id", "page"])

    currency = F.upper("line_text").contains(S.CURRENCY_MARKER)
    starts = F.when(
        currency | K.starts_with_date("line_text"),
        F.struct(F.col("line_y").alias("y"), currency.alias("after")),
    )
    marked = page_least(lines, "_start", starts)
    after_start = (F.col("line_y") > F.col("_start.y")) | (
        (F.col("line_y") == F.col("_start.y")) & ~F.col("_start.after")
    )
    marked = marked.withColumns(
        {
            "has_table": F.col("_start").isNotNull(),
            "_after_start": F.coalesce(after_start, F.lit(False)),
        }
    )
    stop = F.when(F.col("_after_start") & K.contains_any("line_text", end_markers), F.col("line_y"))
    marked = page_least(marked, "_stop", stop)
    return marked.withColumns(
        {
            "in_table": F.col("_after_start")
            & (F.col("_stop").isNull() | (F.col("line_y") < F.col("_stop"))),
            "opens": K.is_date(F.get(F.col("words"), F.lit(0))["text"]),
        }
    ).drop("_start", "_after_start", "_stop")


def page_tables(lines: DataFrame) -> DataFrame:
    """doc_id, page, has_table of all pages that show lines: ``has_table`` of :func:`mark_region` without the rows."""
    opens = F.upper("line_text").contains(S.CURRENCY_MARKER) | K.starts_with_date("line_text")
    return lines.groupBy("doc_id", "page").agg(F.bool_or(opens).alias("has_table"))


def segment(lines: DataFrame, end_markers=S.TABLE_END_MARKERS, spread: bool = False) -> DataFrame:
    """Add ``row_in_page``: 1, 2, ... for the lines of each transaction, 0 for all others.

    ``spread``: for pages of any size. Lines are ordered within bands of a page only, and what earlier bands opened is added."""
    opens = (F.col("in_table") & F.col("opens")).cast("int")
    if spread:
        marked = mark_region(stored(lines, "lines"), end_markers, True)
        marked = marked.withColumns({"_page": F.struct("doc_id", "page"), "_band": F.floor(F.col("line_y") / BAND)})
        counted = prefix_scan(marked, "_page", ["_band", "line_y"], {"_opened": opens.cast("bigint")})
        row = F.when(F.col("in_table"), F.col("_opened")).otherwise(F.lit(0))
        return counted.withColumn("row_in_page", row).drop("_page", "_band", "_opened")
    marked = mark_region(lines, end_markers)
    down = W.partitionBy("doc_id", "page").orderBy("line_y").rowsBetween(W.unboundedPreceding, 0)
    opened = F.sum(opens).over(down)
    return marked.withColumn("row_in_page", F.when(F.col("in_table"), opened).otherwise(F.lit(0)))


def segment_across_pages(lines: DataFrame, end_markers=S.TABLE_END_MARKERS, spread: bool = False, keep_pages: bool = False) -> DataFrame:
    """Like :func:`segment`, but lines before the first date of a page belong to the row that is
    still open from an earlier page (``page`` becomes the page where the row was opened).

    ``keep_pages``: a line that moves leaves an empty one outside all rows, so that its page is still there to be reported on."""
    lines = segment(lines, end_markers, spread)
    opened = F.when(F.col("row_in_page") > 0, F.struct("page", F.col("row_in_page").alias("row")))
    if spread:
        lines = _with_open_row(lines)
    else:
        before = W.partitionBy("doc_id").orderBy("page", "line_y").rowsBetween(W.unboundedPreceding, -1)
        lines = lines.withColumn("_open", F.last(opened, ignorenulls=True).over(before))
    moves = F.col("in_table") & (F.col("row_in_page") == 0) & F.col("_open").isNotNull()
    place = lambda page, row, left: F.struct(page.alias("page"), row.cast("bigint").alias("row"), F.lit(left).alias("left"))
    stays = place(F.col("page"), F.col("row_in_page"), False)
    goes = [place(F.col("_open.page"), F.col("_open.row"), False), *([place(F.col("page"), F.lit(0), True)] if keep_pages else [])]
    lines = lines.withColumn("_place", F.explode(F.when(moves, F.array(*goes)).otherwise(F.array(stays))))
    full = ~F.col("_place.left")
    # line_y orders lines inside a row, so the source page must come first.
    return lines.select(
        "doc_id", F.col("_place.page").alias("page"), F.col("page").alias("source_page"), "line_y",
        F.filter("words", lambda w: full).alias("words"), F.when(full, F.col("line_text")).otherwise("").alias("line_text"),
        "has_table", "in_table", "opens", F.col("_place.row").alias("row_in_page"),
    )


def _with_open_row(lines: DataFrame, block: int = 4096) -> DataFrame:
    """Add ``_open``: the last row opened on an earlier page of the document.

    For documents of any length: one small row per page is carried forward, first within blocks
    of pages and then from block to block.
    """
    pages = (
        lines.groupBy("doc_id", "page")
        .agg(F.max("row_in_page").alias("_rows"))
        .withColumn("_block", F.floor(F.col("page") / block))
    )
    last = F.when(F.col("_rows") > 0, F.struct("page", F.col("_rows").alias("row")))
    in_block = W.partitionBy("doc_id", "_block").orderBy("page").rowsBetween(W.unboundedPreceding, -1)
    before_block = W.partitionBy("doc_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = pages.groupBy("doc_id", "_block").agg(F.max(last).alias("_last"))
    carried = carried.select(
        "doc_id", "_block", F.last("_last", ignorenulls=True).over(before_block).alias("_carried")
    )
    opened = (
        pages.withColumn("_near", F.last(last, ignorenulls=True).over(in_block))
        .join(carried, ["doc_id", "_block"])
        .select("doc_id", "page", F.coalesce("_near", "_carried").alias("_open"))
    )
    return lines.join(opened, ["doc_id", "page"])


def _in_column(code: int, nonzero: bool = False):
    if nonzero:
        return lambda w: (w["col"] == code) & (w["amount"] != 0)
    return lambda w: w["col"] == code


def _line_fields(lines: DataFrame) -> DataFrame:
    """What each line offers to its transaction, as plain columns next to its key."""
    order = F.struct("source_page", "line_y") if "source_page" in lines.columns else F.col("line_y")
    words, placed, first = F.col("words"), F.col("_placed"), F.col("_first")
    # The few amounts that stand in a column are singled out once; all amount rules use them.
    # The date itself is never among them.
    lines = lines.select(
        "doc_id", "page", "row_in_page", "has_table", "words", "line_text", order.alias("_at"),
        (F.col("opens") & F.col("in_table")).alias("_first"),
        F.filter(words, lambda w: w["col"].isNotNull()).alias("_placed"),
    )
    plain = F.transform(F.filter(words, lambda w: w["col"].isNull()), lambda w: w["text"])
    fields: dict[str, Column] = {
        "_date": F.when(first, F.get(words, F.lit(0))["text"]),
        "_text": F.when(
            first, K.strip(F.array_join(F.slice(plain, 2, F.greatest(F.size(plain) - 1, F.lit(0))), " "))
        ),
        "_more_text": F.when(
            ~first & ~F.exists(words, lambda w: w["amount"].isNotNull()), F.concat(F.lit(" "), F.col("line_text"))
        ),
        "_negative": F.exists(placed, lambda w: K.looks_negative(w["text"])),
    }
    for name, code in S.COLUMN_CODES.items():
        mine, money = _in_column(code), _in_column(code, nonzero=True)
        # On the date line the last amount of a column counts ...
        fields[f"_own_{name}"] = F.when(first, F.try_element_at(F.filter(placed, mine), F.lit(-1))["amount"])
        # ... on later lines the first that is not zero, and a zero only counts as "seen".
        fields[f"_fill_{name}"] = F.when(~first, F.get(F.filter(placed, money), F.lit(0))["amount"])
        fields[f"_seen_{name}"] = ~first & F.exists(placed, mine)
    return lines.select(
        "doc_id", "page", "row_in_page", "has_table", "_at", *[c.alias(n) for n, c in fields.items()]
    )


def repair_large(rows: DataFrame, limit=S.REPAIR_LIMIT) -> DataFrame:
    """Move a large amount that stands without a balance into the balance column.

    Withdrawal first; the deposit then sees the balance it may have set. ``reclassified`` tells.
    """
    rows = rows.withColumn("reclassified", F.lit(False))
    for side in ("withdrawal", "deposit"):
        amount, balance, moved = F.col(side), F.col("balance"), F.col("_moved")
        moves = K.present(side) & ~K.present("balance") & (amount > limit)
        rows = rows.withColumn("_moved", moves).withColumns(
            {
                "balance": F.when(moved, amount).otherwise(balance),
                side: F.when(~moved | moved.isNull(), amount),
                "reclassified": F.col("reclassified") | F.coalesce(moved, F.lit(False)),
            }
        )
    return rows.drop("_moved")


def assemble_rows(segmented: DataFrame, repair_limit=S.REPAIR_LIMIT) -> DataFrame:
    """One row per (document, page, row_in_page); row 0 stands for lines outside transactions."""
    aggs = [
        F.bool_or("has_table").alias("has_table"),
        F.max("_date").alias("date_raw"),
        F.max("_text").alias("_base"),
        F.sort_array(
            F.collect_list(F.when(F.col("_more_text").isNotNull(), F.struct("_at", "_more_text")))
        ).alias("_more"),
        F.bool_or("_negative").alias("negative"),
    ]
    for name in AMOUNT_COLUMNS:
        fill = f"_fill_{name}"
        aggs += [
            F.max(f"_own_{name}").alias(name),
            F.min_by(fill, F.when(F.col(fill).isNotNull(), F.col("_at"))).alias(fill),
            F.bool_or(f"_seen_{name}").alias(f"_seen_{name}"),
        ]
    rows = _line_fields(segmented).groupBy("doc_id", "page", "row_in_page").agg(*aggs)
    rows = repair_large(rows, repair_limit)
    filled = [
        F.coalesce(
            F.when(F.col(n) != 0, F.col(n)),
            F.col(f"_fill_{n}"),
            F.when(F.col(n).isNotNull() | F.col(f"_seen_{n}"), F.lit(0).cast(S.MONEY)),
        ).alias(n)
        for n in AMOUNT_COLUMNS
    ]
    return rows.select(
        "doc_id", "page", "row_in_page", "has_table", "date_raw",
        K.parse_date("date_raw").alias("txn_date"),
        F.concat(F.col("_base"), F.array_join(F.col("_more._more_text"), "")).alias("description"),
        *filled, "negative", "reclassified",
    )


def is_forward(description="description") -> Column:
    return F.coalesce(K.contains_any(description, S.FORWARD_MARKERS), F.lit(False))


def drop_forward(rows: DataFrame) -> DataFrame:
    """Remove carried and brought forward lines; they only repeat a balance at a page edge."""
    return rows.filter(~is_forward())


def number_rows(rows: DataFrame, spread: bool = False, block: int = 1024) -> DataFrame:
    """Add ``txn_seq``, dense from 1 in (page, row) order within the document."""
    if not spread:
        w = W.partitionBy("doc_id").orderBy("page", "row_in_page")
        return rows.withColumn("txn_seq", F.row_number().over(w).cast("bigint"))
    rows = rows.withColumn("_pages", F.floor(F.col("page") / block))
    one = {"txn_seq": F.lit(1).cast("bigint")}
    return prefix_scan(rows, "doc_id", ["_pages", "page", "row_in_page"], one).drop("_pages")


def parse_flat_text(rows: DataFrame, text: str = "text",
                    withdrawal_words=S.WITHDRAWAL_KEYWORDS,
                    deposit_words=S.DEPOSIT_KEYWORDS) -> DataFrame:
    """Read a transaction from one line of plain text; lines without a leading date give no row.

    The last amount is the balance. With three or more, the two before it are withdrawal and
    deposit. With exactly two, key words in the description say which side the first one is.
    """
    raw = F.col(text)
    rows = rows.filter(raw.rlike(S.DATE_PREFIX)).withColumn(
        "_rest", K.strip(F.substr(raw, F.lit(11)))
    )
    rows = rows.withColumn("_amounts", F.regexp_extract_all("_rest", F.lit(f"({S.AMOUNT_SCAN})"), F.lit(1)))
    rows = rows.withColumn(
        "description",
        K.strip(F.aggregate("_amounts", F.col("_rest"), lambda s, a: F.replace(s, a, F.lit("")))),
    )
    at = lambda i: K.money(F.try_element_at(F.col("_amounts"), F.lit(i)))
    n = F.size("_amounts")
    upper = F.upper("description")
    single = F.when((n == 2) & K.present(at(-2)), at(-2))
    is_out = K.contains_any(upper, withdrawal_words)
    is_in = ~is_out & K.contains_any(upper, deposit_words)
    return rows.select(
        *[c for c in rows.columns if c not in ("_rest", "_amounts", "description")],
        F.substring(raw, 1, 10).alias("date_raw"),
        K.parse_date(F.substring(raw, 1, 10)).alias("txn_date"),
        "description",
        F.when(n >= 3, at(-3)).when(is_out, single).alias("withdrawal"),
        F.when(n >= 3, at(-2)).when(is_in, single).alias("deposit"),
        at(-1).alias("balance"),
    )
