import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskmart import functions as rf


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"c {kind}")


def apply(spark, values, build, kind="string"):
    return [r[0] for r in column(spark, values, kind).select(build(F.col("c"))).collect()]


@pytest.mark.parametrize(
    "build, cases",
    [
        (
            rf.text_to_int,
            {"3.7": 3, " 4 ": 4, "-5": -5, "-0.5": 0, ".5": 0, "7.": 7, "1e3": None, "": None,
             "x": None, None: None, "99999999999": None, "+8": 8, "3.7.1": None, ".": None},
        ),
        (rf.digits_to_int, {"12": 12, "-1": None, "1.5": None, "": None, None: None, "3_": None}),
        (
            rf.digits_to_int_or_zero,
            {"12": 12, "-1": 0, "abc": 0, "": 0, None: 0, "99999999999": None},
        ),
        (
            rf.signed_decimal_to_float,
            {"-3.5": -3.5, "11": 11.0, "_": None, None: None, "1.": None, "+1": None},
        ),
        (rf.strip_underscores, {"__1_0_": "10", "a": "a", None: None}),
        (rf.keep_if_digits, {"12": "12", "1a": None, None: None}),
        (rf.keep_if_signed_decimal, {"-1.5": "-1.5", "1e3": None}),
        (lambda c: rf.tokens_to(c, ["_", "NM"], "Unknown"), {"_": "Unknown", "a": "a", None: None}),
        (lambda c: rf.blank_to(c, "Unknown"), {"": "Unknown", None: "Unknown", "a": "a"}),
        (lambda c: rf.mask_to_null(c, "___"), {"x____y": None, "__": "__", None: None}),
        (
            rf.history_months,
            {"22 Years and 1 Months": 265, "3 Years": None, "NA": None, None: None,
             "1 Years 11 Months": 23},
        ),
        (
            rf.parse_date,
            {"1/7/2023": dt.date(2023, 7, 1), "2023-07-01": dt.date(2023, 7, 1),
             "31/2/2023": None, "2023": None, "soon": None, None: None,
             "12/11/2024": dt.date(2024, 11, 12)},
        ),
    ],
)
def test_text_rules(spark, build, cases):
    assert apply(spark, list(cases), build) == pytest.approx(list(cases.values()))


def test_range_rules(spark):
    ages = [-1, 0, 100, 101, None]
    assert apply(spark, ages, lambda c: rf.null_outside(c, 0, 100), "int") == [
        None, 0, 100, None, None,
    ]
    assert apply(spark, ages, lambda c: rf.null_outside(c, 0), "int") == [None, 0, 100, 101, None]
    assert apply(spark, ages, lambda c: rf.null_outside(c, None, 0), "int") == [
        -1, 0, None, None, None,
    ]
    assert apply(spark, [-3, 0, 5, None], rf.clip_to_zero, "int") == [0, 0, 5, 0]


def test_ratios(spark):
    rows = [(10.0, 4.0), (1.0, 0.0), (1.0, None), (None, 2.0), (0.0, 5.0)]
    df = spark.createDataFrame(rows, "n double, d double")
    got = df.select(
        rf.ratio_or_zero(F.col("n"), F.col("d")), rf.instalments_missed(F.col("n"), F.col("d"))
    ).collect()
    assert [r[0] for r in got] == [2.5, 0.0, 0.0, None, 0.0]
    assert [r[1] for r in got] == [3, 0, 0, None, 0]


def test_first_missed_date_clamps_and_never_fails(spark):
    day = dt.date(2023, 3, 31)
    rows = [(day, 1), (day, 0), (day, None), (day, 200_000), (day, 2_000_000_000)]
    df = spark.createDataFrame(rows, "s date, m int")
    first = rf.first_missed_date(F.col("s"), F.col("m"))
    got = df.select(F.datediff(F.col("s"), first)).collect()
    assert [r[0] for r in got[:4]] == [31, None, None, 6_087_374]
    assert 2_000_000_000 < got[4][0] < 2**31


def test_instalments_missed_saturates(spark):
    rows = [(2000.0, 1e-300), (1e300, 1.0), (-1e300, 1.0), (2000.0, 0.01)]
    df = spark.createDataFrame(rows, "n double, d double")
    got = [r[0] for r in df.select(rf.instalments_missed(F.col("n"), F.col("d"))).collect()]
    assert got[:2] == [2**31 - 1] * 2 and got[3] == 200_000


def test_month_series(spark):
    rows = [
        (dt.date(2023, 1, 15), dt.date(2023, 3, 1)),
        (dt.date(2023, 3, 2), dt.date(2023, 3, 1)),
        (dt.date(2023, 5, 1), dt.date(2023, 4, 30)),
    ]
    df = spark.createDataFrame(rows, "a date, b date")
    got = [r[0] for r in df.select(rf.month_series(F.col("a"), F.col("b"))).collect()]
    assert got[0] == [dt.date(2023, m, 1) for m in (1, 2, 3)]
    assert got[1] == [dt.date(2023, 3, 1)]
    assert got[2] == []


@settings(max_examples=200, deadline=None)
@given(st.dates(dt.date(1950, 1, 1), dt.date(2100, 1, 1)), st.integers(-600, 600))
def test_add_months_py(day, months):
    moved = rf.add_months_py(day, months)
    assert (moved.year * 12 + moved.month) - (day.year * 12 + day.month) == months
    assert moved.day == day.day or (moved.day < day.day and (moved + dt.timedelta(days=1)).day == 1)
