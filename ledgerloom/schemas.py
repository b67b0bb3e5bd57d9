"""Table contracts and the fixed values that decide what a statement looks like."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the published behaviour for results to match.
# ---------------------------------------------------------------------------
DATE_TOKEN = r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$"
DATE_PREFIX = r"^[0-9]{2}/[0-9]{2}/[0-9]{4}"
DATE_FORMAT = "dd/MM/yyyy"
AMOUNT_NOISE = r"[^0-9,.]"
AMOUNT_FORM = r"^[0-9,]+\.[0-9]{2}$"
AMOUNT_SCAN = r"[0-9,]+\.[0-9]{2}"
NUMERIC_ONLY = r"^[0-9,.]+$"
CURRENCY_MARKER = "CURRENCY:"
TABLE_END_MARKERS = (
    "Balance Carried Forward",
    "Total Balance Carried Forward",
    "Messages For",
    "Transaction Details as of",
    "Page",
)
FORWARD_MARKERS = ("Balance Brought Forward", "Balance Carried Forward")
EXPECTED_HEADERS = ("Transaction Details", "Account Summary")
WITHDRAWAL_KEYWORDS = ("WITHDRAWAL", "PAYMENT", "TRANSFER TO", "ATM", "DEBIT")
DEPOSIT_KEYWORDS = ("DEPOSIT", "INCOMING", "RECEIPT", "FROM:", "SALARY", "CREDIT")
WARN_EMPTY = "Empty document"
WARN_SHORT = "Insufficient text content - possible OCR needed"
WARN_HEADERS = "Expected headers not found"
WARN_NO_TEXT = "No text found on page %d"
WARN_NO_TABLE = "Could not find transaction table on page %d"
ABORT_INTEGRITY = "Document integrity check failed"
ABORT_PAGE = "Failed to extract transactions from page %d"
ABORT_WORDS = "%d malformed words"
ABORT_RECORDS = "%d unreadable records"
ABORT_FILE = "unreadable file"
LINE_TOLERANCE = 3.0
CLUSTER_GAP = 50.0
BOUND_MARGIN = 10.0
MIN_TEXT_CHARS = 50
SHORT_TEXT_PENALTY = 0.5
HEADER_PENALTY = 0.7
REPAIR_LIMIT = 1000
BALANCE_TOLERANCE = "0.01"


@dataclass(frozen=True)
class ColumnProfile:
    """Left edges of the three amount columns of one statement layout."""

    withdrawal_x: float = 364.0
    deposit_x: float = 440.0
    balance_x: float = 503.0


DEFAULT_PROFILE = ColumnProfile()

# Codes of the amount columns inside line rows; small numbers keep those rows narrow.
COLUMN_CODES = {"withdrawal": 1, "deposit": 2, "balance": 3}

MONEY = T.DecimalType(18, 2)
# Running totals and sums: wide enough for every row of a very large account.
MONEY_TOTAL = T.DecimalType(28, 2)


def words_schema(doc_type: T.DataType | None = None) -> T.StructType:
    """One row per positioned word; ``ord`` is the place in extraction order."""
    return T.StructType(
        [
            T.StructField("doc_id", doc_type or T.StringType()),
            T.StructField("page", T.IntegerType()),
            T.StructField("ord", T.IntegerType()),
            T.StructField("x0", T.DoubleType()),
            T.StructField("y0", T.DoubleType()),
            T.StructField("x1", T.DoubleType()),
            T.StructField("y1", T.DoubleType()),
            T.StructField("text", T.StringType()),
            T.StructField("block_no", T.IntegerType()),
            T.StructField("line_no", T.IntegerType()),
            T.StructField("word_no", T.IntegerType()),
        ]
    )


def transactions_schema(doc_type: T.DataType | None = None) -> T.StructType:
    return T.StructType(
        [
            T.StructField("doc_id", doc_type or T.StringType()),
            T.StructField("page", T.IntegerType()),
            T.StructField("txn_seq", T.LongType()),
            T.StructField("date_raw", T.StringType()),
            T.StructField("txn_date", T.DateType()),
            T.StructField("description", T.StringType()),
            T.StructField("withdrawal", MONEY),
            T.StructField("deposit", MONEY),
            T.StructField("balance", MONEY),
        ]
    )


# Rows inside a result record, as the record spells them.
RESULT_ROW = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("withdrawal", MONEY),
        T.StructField("deposit", MONEY),
        T.StructField("balance", MONEY),
        T.StructField("page", T.IntegerType()),
    ]
)


def result_schema(doc_type: T.DataType | None = None) -> T.StructType:
    return T.StructType(
        [
            T.StructField("doc_id", doc_type or T.StringType()),
            T.StructField("part", T.LongType()),
            T.StructField("first_seq", T.LongType()),
            T.StructField("success", T.BooleanType()),
            T.StructField("confidence", T.DoubleType()),
            T.StructField("warnings", T.ArrayType(T.StringType())),
            T.StructField("n_warnings", T.LongType()),
            T.StructField("abort_reason", T.StringType()),
            T.StructField("transaction_count", T.LongType()),
            T.StructField("transactions", T.ArrayType(RESULT_ROW)),
            T.StructField("data", T.ArrayType(RESULT_ROW)),
        ]
    )


class SchemaMismatch(ValueError):
    """A table does not carry the columns an operator needs."""


def require(df, *columns: str):
    """Check column names when a plan is built, not after hours of running it."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SchemaMismatch(f"missing columns {missing}; table has {df.columns}")
    return df
