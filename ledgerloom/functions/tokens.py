"""Column functions for words, amounts, dates and free text. All JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def contains_any(text, needles) -> Column:
    text = _col(text)
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles])


def amount(text) -> Column:
    """Money value of a token after dropping all but digits, comma and point; else null.

    The plain ``contains`` test in front keeps the two regexes off most words.
    """
    text = _col(text)
    kept = F.regexp_replace(text, S.AMOUNT_NOISE, "")
    return F.when(text.contains(".") & kept.rlike(S.AMOUNT_FORM), money(kept))


def money(text) -> Column:
    """``1,234.50`` -> 1234.50; null when it is not a number."""
    return F.regexp_replace(_col(text), ",", "").try_cast(S.MONEY)


def strict_amount(text) -> Column:
    """The layout diagnostics accept only tokens that are amounts as they stand."""
    text = _col(text)
    return F.when(text.rlike(S.AMOUNT_FORM), money(text))


def looks_negative(text) -> Column:
    """A sign or bracket that :func:`amount` drops."""
    return F.coalesce(_col(text).rlike(r"[-(−]"), F.lit(False))


def is_date(text) -> Column:
    return _col(text).rlike(S.DATE_TOKEN)


def starts_with_date(text) -> Column:
    return F.trim(_col(text)).rlike(S.DATE_PREFIX)


def parse_date(text) -> Column:
    return F.try_to_date(_col(text), S.DATE_FORMAT)


def column_of(x0, withdrawal_x, deposit_x, balance_x) -> Column:
    """Code of the amount column at a horizontal position; null means description text."""
    x0, code = _col(x0), {n: F.lit(c).cast("byte") for n, c in S.COLUMN_CODES.items()}
    return (
        F.when(x0 > balance_x, code["balance"])
        .when(x0 > deposit_x, code["deposit"])
        .when(x0 > withdrawal_x, code["withdrawal"])
    )


def present(value) -> Column:
    """Neither missing nor zero."""
    return F.coalesce(_col(value) != 0, F.lit(False))


def zero_if_null(value) -> Column:
    return F.coalesce(_col(value), F.lit(0).cast(S.MONEY))


def clip(text, start: int, length: int) -> Column:
    return F.substring(_col(text), start, length)


def strip(text) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(_col(text), r"^\s+|\s+$", "")


def keyword_match(text, keyword: str, literal: bool = False) -> Column:
    """Case-insensitive search; a missing text never matches."""
    text = _col(text)
    hit = F.lower(text).contains(keyword.lower()) if literal else text.rlike("(?iu)" + keyword)
    return F.coalesce(hit, F.lit(False))
