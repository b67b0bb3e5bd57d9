"""Statements rendered from order tables: ledgers and positioned words for queries and tests.

Each customer is a document and each order a transaction. Known faults are planted by order key
and document key, so that every check has something to find. Nothing is invented: the amount of
work grows with the tables read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import schemas as S
from ..functions.ordered import SHARE, SMALLEST_LARGE, hashed, many, prefix_scan, split_by_size

OPENING_CENTS = 2_000_000_000
ROWS_PER_PAGE = 10
PER_ROW, FIRST_PAGE = 14 + 3, 41
KEYWORDS = ("PAYNOW", "ATM", "SALARY", "POINT-OF-SALE", "GIRO")
X = {"date": 45.4, "description": 113.0, "withdrawal": 373.6, "deposit": 450.1, "balance": 512.6}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _every(key: str, n: int) -> Column:
    return F.col(key) % n == 0


def cents_to_money_expr(cents: Column) -> Column:
    return (cents.cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(S.MONEY)


def cents_to_money(c: str) -> Column:
    return cents_to_money_expr(F.col(c))


def ledger_cents(spark: SparkSession, sf_dir: str, share: float = SHARE, floor: int = SMALLEST_LARGE,
                 n_words: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Transactions in integer cents, numbered and with running balance per customer. ``n_words``: words that will be rendered from
    them; customers are then hashed as those words are to be. ``sizes``: optional known orders per customer (doc_id, n)."""
    o = table(spark, sf_dir, "orders")
    full = F.round(F.col("o_totalprice") * 100).cast("bigint")
    base = o.select(
        F.col("o_custkey").alias("doc_id"),
        F.col("o_orderkey").alias("okey"),
        F.col("o_orderdate").cast("date").alias("txn_date"),
        F.when(F.col("o_orderkey") % 2 == 0, full % 100_000).otherwise(full).alias("cents"),
        (F.col("o_orderstatus") == "F").alias("is_in"),
        "o_orderpriority",
    )
    move = F.when(F.col("is_in"), F.col("cents")).otherwise(-F.col("cents"))
    ordinary, large, _ = split_by_size(base, "doc_id", share, floor, sizes, hash_ordinary=n_words is None)
    if n_words and many(ordinary, n_words):  # few rows are hashed on the document by the window
        ordinary = hashed(ordinary, n_words, "doc_id")
    w = W.partitionBy("doc_id").orderBy("txn_date", "okey").rowsBetween(W.unboundedPreceding, 0)
    one = F.lit(1).cast("bigint")
    numbered = ordinary.select("*", F.sum(one).over(w).alias("txn_seq"), F.sum(move).over(w).alias("_run"))
    rows = numbered
    if large is not None:
        spread = prefix_scan(
            large.withColumn("_bucket", F.floor(F.col("okey") / 65_536)),
            "doc_id", ["txn_date", "_bucket", "okey"], {"txn_seq": one, "_run": move},
        ).drop("_bucket")
        rows = rows.unionByName(spread)
    word = F.element_at(F.array(*[F.lit(k) for k in KEYWORDS]), (F.pmod("okey", F.lit(5)) + 1).cast("int"))
    other = F.when(_every("okey", 83), F.lit(100).cast("bigint"))
    return rows.select(
        "doc_id", "okey", "txn_seq", "txn_date",
        (F.floor((F.col("txn_seq") - 1) / ROWS_PER_PAGE) + 2).cast("int").alias("page"),
        ((F.col("txn_seq") - 1) % ROWS_PER_PAGE).cast("int").alias("slot"),
        F.date_format("txn_date", S.DATE_FORMAT).alias("date_raw"),
        F.concat_ws(" ", word, "o_orderpriority").alias("title"),
        F.when(F.col("is_in"), other).otherwise(F.col("cents")).alias("w_cents"),
        F.when(F.col("is_in"), F.col("cents")).otherwise(other).alias("d_cents"),
        (OPENING_CENTS + F.col("_run")).alias("run_cents"),
        F.when(~_every("okey", 89), OPENING_CENTS + F.col("_run") + F.when(_every("okey", 97), 100).otherwise(0))
        .alias("b_cents"),
    )


def ledger(spark: SparkSession, sf_dir: str, **sizes) -> DataFrame:
    """The ledger as it would be read back from a perfect extraction."""
    reference = F.when(_every("okey", 7), F.concat(F.lit(" REF "), F.col("okey").cast("string"))).otherwise("")
    return ledger_cents(spark, sf_dir, **sizes).select(
        "doc_id", "page", "txn_seq", "date_raw", "txn_date",
        F.concat("title", reference).alias("description"),
        cents_to_money("w_cents").alias("withdrawal"),
        cents_to_money("d_cents").alias("deposit"),
        cents_to_money("b_cents").alias("balance"),
        "okey",
    )


def documents(spark: SparkSession, sf_dir: str, by_hash: bool = False) -> DataFrame:
    """All customers with their page count; every fiftieth document is empty. ``by_hash``: a join that leaves them hashed on the document."""
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    pages = F.ceil(F.coalesce("n_rows", F.lit(0)) / ROWS_PER_PAGE) + 1
    return (
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
        .join(counts.hint("merge") if by_hash else counts, "doc_id", "left")
        .select("doc_id", F.when(_every("doc_id", 50), 0).otherwise(pages).cast("int").alias("n_pages"))
    )


WORD_ARRAY = "array<struct<ord:int,x0:double,y0:double,text:string,block_no:int,line_no:int,word_no:int>>"
NO_WORDS = f"cast(array() as {WORD_ARRAY})"


def _word(ord_, x, y, text, block, line, number) -> str:
    """SQL of one positioned word."""
    return (
        f"named_struct('ord', int({ord_}), 'x0', double({x}), 'y0', double({y}), 'text', string({text}), "
        f"'block_no', int({block}), 'line_no', int({line}), 'word_no', int({number}))"
    )


def _phrase(text: str, ord_, x: float, y, block, line=0, step: int = 50, wobble: str = "0") -> str:
    """SQL of the words of a text, ``step`` apart."""
    return (
        f"transform(split({text}, ' '), (t, i) -> "
        f"{_word(f'{ord_} + i', f'{x} + i * {step}', f'{y} + {wobble}', 't', block, line, 'i')})"
    )


def _words(*words: str) -> str:
    return f"array({', '.join(words)})"


def _if(condition: str, words: str) -> str:
    return f"if({condition}, {words}, {NO_WORDS})"


def amount_text(cents: str) -> str:
    """SQL of an amount in cents as statements print it: 1,234.50."""
    return f"concat(if({cents} < 0, '-', ''), format_number(cast(abs({cents}) as decimal(18, 0)) * 0.01, 2))"


def _finish(exploded: DataFrame) -> DataFrame:
    return exploded.select(
        "doc_id", "page", "w.ord", "w.x0", "w.y0",
        (F.col("w.x0") + 5.0 * F.char_length("w.text")).alias("x1"), (F.col("w.y0") + 9.0).alias("y1"),
        "w.text", "w.block_no", "w.line_no", "w.word_no",
    )


def _exploded(rows: DataFrame) -> DataFrame:
    """One row per word ``w``. The array is a column first: as the argument of explode it would be interpreted, not compiled. No row
    is without words, and a plain explode would build the array a second time to find out."""
    return rows.select("doc_id", "page", F.explode_outer("_words").alias("w"))


def table_words(rows: DataFrame) -> DataFrame:
    """Words of the transaction pages. Header and footer come with the first row of a page, so
    no second pass over the pages is needed."""
    at, y, block = "100 + slot * 20", "240 + slot * 24", "slot + 10"
    low, low_line = f"{y} + if(okey % 3 = 0, 3, 0)", "if(okey % 3 = 0, 1, 0)"
    amount = lambda c, n, x, up, line: f"if({c} is not null, {_word(f'{at} + {n}', x, up, amount_text(c), block, line, n)}, null)"
    row = "array_compact(" + _words(
        _word(at, X["date"], y, "date_raw", block, 0, 0),
        amount("w_cents", 10, X["withdrawal"], low, low_line),
        amount("d_cents", 11, X["deposit"], low, low_line),
        amount("b_cents", 12, X["balance"], y, 0),
    ) + ")"
    title = _phrase("title", f"{at} + 1", X["description"], y, block, wobble="0.25 * pmod(okey + i, 3)")
    more = _if("okey % 7 = 0", _phrase("concat('REF ', okey)", f"{at} + 15", X["description"], f"{y} + 12", block, 2))
    heads = ["Date", "Description", "Withdrawal", "Deposit", "Balance"]
    header = _words(
        *[_word(1 + i, x, 190, f"'{h}'", 0, 0, i) for i, (h, x) in enumerate(zip(heads, X.values()))],
        _word(6, 45.4, 220, "'CURRENCY:'", 1, 0, 0), _word(7, 120, 220, "'SGD'", 1, 0, 1),
    )
    forward = _if("page = 2", "concat({}, {}, {})".format(
        _words(_word(8, X["date"], 228, "'01/01/1992'", 2, 0, 0)),
        _phrase("'Balance Brought Forward'", 9, X["description"], 228, 2),
        _words(_word(12, X["balance"], 228, "'20,000,000.00'", 2, 0, 4)),
    ))
    continued = _if(
        "page > 2 and (doc_id + page) % 5 = 0", _phrase("concat('CONTD ', page)", 13, X["description"], 230, 3)
    )
    total = "doc_id % 1000 * 100 + 50 + if(doc_id % 26 = 0, page * 100, 0)"
    footer = _if("doc_id % 2 = 0", "concat({}, {})".format(
        _phrase("'Total Balance Carried Forward'", 1000, X["description"], 500, 90),
        _words(_word(1004, X["balance"], 500, amount_text(f"({total})"), 90, 0, 4)),
    ))
    foot = _if("doc_id % 3 <> 0", _words(_word(1010, 45.4, 780, "'Page'", 91, 0, 0), _word(1011, 80, 780, "page", 91, 0, 1)))
    once = _if("slot = 0", f"concat({header}, {forward}, {continued}, {footer}, {foot})")
    shown = rows.filter("doc_id % 50 <> 0 and not (doc_id % 51 = 0 and page = 3)")
    return _finish(_exploded(shown.select("doc_id", "page", F.expr(f"concat({row}, {title}, {more}, {once})").alias("_words"))))


def cover_words(docs: DataFrame) -> DataFrame:
    """Words of the first pages, which show no transactions."""
    title = "if(doc_id % 7 = 0, 'Statement Overview', 'Account Summary')"
    body = "concat('Consolidated statement of all deposits and payments for customer ', doc_id)"
    words = "concat({}, {}, {})".format(
        _phrase(title, 1, 45.4, 100, 0),
        _if("doc_id % 11 <> 0", _phrase(body, 10, 45.4, 120, 1)),
        _phrase("'Page 1'", 30, 45.4, 140, 2),
    )
    pages = docs.filter("n_pages > 0")
    return _finish(_exploded(pages.select("doc_id", F.lit(1).alias("page"), F.expr(words).alias("_words"))))


def words(spark: SparkSession, sf_dir: str, counts: DataFrame | None = None, **sizes) -> DataFrame:
    """All positioned words of all documents. Orders and customers are hashed on the document as extraction hashes words, so that
    words need not move again. ``counts``: :func:`word_counts`, if they are there already."""
    known = None if counts is None else order_counts(counts)
    counts = word_counts(spark, sf_dir) if counts is None else counts
    n = counts.agg(F.sum("n")).first()[0] or 0
    rows = table_words(ledger_cents(spark, sf_dir, n_words=n, sizes=known, **sizes))
    few = many(rows, n) is None
    docs = documents(spark, sf_dir, by_hash=few)
    return rows.unionByName(cover_words(docs if few else hashed(docs, n, "doc_id")))


#: Points by which the amount columns of every third document stand elsewhere, and how far documents of one layout differ.
SHIFTS, WOBBLE = (0.0, -40.0, 12.0), 0.5


def shifted_words(spark: SparkSession, sf_dir: str, **sizes) -> DataFrame:
    """The same statements in three layouts: what stands right of x = 300 on transaction pages is moved by document. In the
    second layout the default column edges read every amount wrong."""
    by = F.element_at(F.array(*[F.lit(s) for s in SHIFTS]), (F.col("doc_id") % 3 + 1).cast("int")) + (F.col("doc_id") % 5 - 2) * WOBBLE
    moved = F.when((F.col("page") > 1) & (F.col("x0") > 300), by).otherwise(F.lit(0.0))
    return words(spark, sf_dir, **sizes).withColumns({"x0": F.col("x0") + moved, "x1": F.col("x1") + moved})


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper bound of the words per document, straight from the order table: at most 14 words
    per row, and per page of ``ROWS_PER_PAGE`` rows at most 21 more; 20 on the first page."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(
        (F.count(F.lit(1)) * PER_ROW + FIRST_PAGE).alias("n")
    )


def order_counts(counts: DataFrame) -> DataFrame:
    """Orders per document, from :func:`word_counts`."""
    return counts.select("doc_id", ((F.col("n") - FIRST_PAGE) / PER_ROW).cast("bigint").alias("n"))
