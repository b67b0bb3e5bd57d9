from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.functions import tokens as K
from ledgerloom.operators import rows

AMOUNTS = {
    "20.00": "20.00", "7,980.00": "7980.00", "-5.00": "5.00", "(5.00)": "5.00", "SGD20.00": "20.00",
    "12/34.56": "1234.56", "3.50%": "3.50", "1.23CR": "1.23", ",.50": "0.50", ".50": None, "5.0": None,
    "5.000": None, "1.234.56": None, "01DEC": None, "": None, "plain": None, "1٣.00": "1.00",
}


def test_amount_tokens(spark):
    df = spark.createDataFrame([(t,) for t in AMOUNTS], "t string")
    got = {r.t: r.v for r in df.select("t", K.amount("t").alias("v")).collect()}
    assert got == {t: (Decimal(v) if v else None) for t, v in AMOUNTS.items()}


def test_dropped_signs_are_flagged(spark):
    df = spark.createDataFrame([("-5.00",), ("(5.00)",), ("5.00",), (None,)], "t string")
    assert [r[0] for r in df.select(K.looks_negative("t")).collect()] == [True, True, False, False]


def test_strict_amount_does_not_strip(spark):
    df = spark.createDataFrame([("5.00",), ("-5.00",), ("1,000.25",)], "t string")
    assert [r[0] for r in df.select(K.strict_amount("t")).collect()] == [Decimal("5.00"), None, Decimal("1000.25")]


def test_dates_are_digits_only(spark):
    df = spark.createDataFrame([("99/99/9999",), ("01/02/2022",), ("1/2/2022",), ("01/02/2022x",)], "t string")
    got = df.select(K.is_date("t"), K.starts_with_date("t"), K.parse_date("t").cast("string")).collect()
    assert [tuple(r) for r in got] == [
        (True, True, None), (True, True, "2022-02-01"), (False, False, None), (False, True, None),
    ]


def test_column_edges(spark):
    xs = [364.0, 364.1, 440.0, 440.1, 503.0, 503.1]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.orderBy("x").select(K.column_of("x", 364.0, 440.0, 503.0)).collect()]
    assert got == [None, 1, 1, 2, 2, 3]


def test_keyword_search_is_regex_or_literal_and_null_safe(spark):
    df = spark.createDataFrame([("Incoming PayNow",), ("pay.now",), (None,)], "t string")
    assert [r[0] for r in df.select(K.keyword_match("t", "pay.?now")).collect()] == [True, True, False]
    assert [r[0] for r in df.select(K.keyword_match("t", "pay.now", literal=True)).collect()] == [False, True, False]


FLAT = [
    ("01/01/2022 ATM 20.00 7,980.00", ("ATM", "20.00", None, "7980.00")),
    ("02/01/2022 INCOMING X 125.00 8,093.40", ("INCOMING X", None, "125.00", "8093.40")),
    ("02/01/2022 SHOP 5.00 10.00", ("SHOP", None, None, "10.00")),
    ("02/01/2022 X 1.00 2.00 3.00", ("X", "1.00", "2.00", "3.00")),
    ("02/01/2022 DEBIT CREDIT 0.00 3.00", ("DEBIT CREDIT", None, None, "3.00")),
    ("02/01/2022 payment from: me 4.00 3.00", ("payment from: me", "4.00", None, "3.00")),
    ("02/01/2022 NOTHING", ("NOTHING", None, None, None)),
    # Removing one amount also cuts it out of a longer one.
    ("02/01/2022 X 1.00 21.00", ("X  2", None, None, "21.00")),
    ("SHOP 5.00", None),
]


def test_flat_text_rows(spark):
    df = spark.createDataFrame(list(enumerate(t for t, _ in FLAT)), "i int, text string")
    got = {r.i: r for r in rows.parse_flat_text(df).collect()}
    for i, (_, want) in enumerate(FLAT):
        if want is None:
            assert i not in got
            continue
        r = got[i]
        money = tuple(Decimal(v) if v else None for v in want[1:])
        assert (r.description, (r.withdrawal, r.deposit, r.balance)) == (want[0], money)


def test_clipping(spark):
    df = spark.createDataFrame([("x" * 80 + "y" * 10,)], "t string")
    assert tuple(df.select(K.clip("t", 1, 60), K.clip("t", 81, 80)).first()) == ("x" * 60, "y" * 10)


def test_present_means_not_zero(spark):
    df = spark.createDataFrame([(None,), (0,), (2,)], "v int")
    assert [r[0] for r in df.select(K.present("v")).collect()] == [False, False, True]
    assert df.filter(F.col("v") > 0).count() == 1
