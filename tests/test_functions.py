"""Column helpers against hand-computed values."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from queuelens.functions.numeric import bucketize, pct, round_to, safe_corr, severity_rank
from queuelens.functions.tails import chi2_tail, normal_two_sided
from queuelens.functions.text import blank_to_null, lenient_int, relabel
from queuelens.functions.timecols import (
    days_between,
    minutes_between,
    month_start,
    parse_first,
    weekday_name,
    weekday_number,
)
from queuelens.profile import TIMESTAMP_FORMATS

ts = dt.datetime


def values(spark, schema, rows, column):
    """``column`` over ``rows``, in order."""
    data = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, f"pos int, {schema}")
    return [r[0] for r in df.select(column.alias("out"), "pos").orderBy("pos").select("out").collect()]


def test_differences_count_boundaries(spark):
    rows = [
        (ts(2025, 1, 1, 10, 0, 59), ts(2025, 1, 1, 10, 1, 1)),
        (ts(2025, 1, 1, 10, 1, 1), ts(2025, 1, 1, 10, 0, 59)),
        (ts(2025, 1, 1, 23, 59), ts(2025, 1, 2, 0, 1)),
        (ts(2025, 1, 1), None),
    ]
    schema = "a timestamp_ntz, b timestamp_ntz"
    a, b = F.col("a"), F.col("b")
    assert values(spark, schema, rows, minutes_between(a, b)) == [1, -1, 2, None]
    assert values(spark, schema, rows, days_between(a, b)) == [0, 0, 1, None]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_differences_ignore_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # a spring-forward night in New York
        rows = [(ts(2025, 3, 9, 0, 30), ts(2025, 3, 9, 4, 30))]
        out = minutes_between(F.col("a"), F.col("b"))
        assert values(spark, "a timestamp_ntz, b timestamp_ntz", rows, out) == [240]
        assert values(spark, "a timestamp_ntz", [(ts(2025, 3, 9, 2, 30),)], month_start(F.col("a"))) == [
            ts(2025, 3, 1)
        ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_parse_first(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    rows = [
        ("2025-03-09 02:30:00",),
        ("2025-01-02 03:04:05",),
        ("03/04/2025 09:05",),
        ("3/4/2025 9:05",),
        (" 2025-1-1 1:00:00 ",),
        ("2025-01-01  10:00:00",),
        ("2025-01-01 10:00:00\t",),
        ("\t1/2/25   7:08 ",),
        ("12025-01-01 10:00:00",),
        ("-2025-01-01 10:00:00",),
        ("1/2/12025 7:08",),
        ("31/02/2025 09:05",),
        ("",),
        ("2025-01-01 10:00:00.5",),
        ("2025/01/01 10:00:00",),
        ("soon",),
        (None,),
    ]
    try:
        got = values(spark, "x string", rows, parse_first(F.col("x"), TIMESTAMP_FORMATS))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [
        ts(2025, 3, 9, 2, 30),
        ts(2025, 1, 2, 3, 4, 5),
        ts(2025, 4, 3, 9, 5),
        ts(2025, 4, 3, 9, 5),
        ts(2025, 1, 1, 1, 0),
        ts(2025, 1, 1, 10),
        ts(2025, 1, 1, 10),
        ts(25, 2, 1, 7, 8),
        *[None] * 9,
    ]


def test_padded_times_are_cut_up(spark):
    """Text with all digits written reads like other text, and is NULL where no such time is."""
    rows = [("0000-01-01 00:00:00",), ("2024-02-29 23:59:59",), ("2023-02-29 10:00:00",), ("2024-13-01 10:00:00",),
            ("2024-01-01 24:00:00",), ("31/12/2024 23:59",), ("12/31/2024 23:59",), ("01/02/2024 10:60",)]
    padded = parse_first(F.col("x"), TIMESTAMP_FORMATS)
    spaced = parse_first(F.concat(F.col("x"), F.lit(" ")), TIMESTAMP_FORMATS)
    # a year 0 is out of Python's range
    got, other = (values(spark, "x string", rows, c.cast("string")) for c in (padded, spaced))
    assert got == other == [
        "0000-01-01 00:00:00", "2024-02-29 23:59:59", None, None, None, "2024-12-31 23:59:00", None, None,
    ]


def test_iso_text_is_cast_as_it_stands(spark):
    """Only text in another order, or with other separators, is cut up and put together again."""
    cut = spark.createDataFrame([("x",)], "x string").select(parse_first(F.col("x"), TIMESTAMP_FORMATS))
    assert ", 18, 2)" not in cut._jdf.queryExecution().optimizedPlan().toString()  # the seconds
    rows = [("2024/01/02 03:04:05",), ("2024/13/02 03:04:05",)]
    assert values(spark, "x string", rows, parse_first(F.col("x"), ("y/M/d H:m:s",))) == [ts(2024, 1, 2, 3, 4, 5), None]


def test_formats_of_one_shape_keep_their_order(spark):
    rows = [("01/02/2024 10:00",), ("13/02/2024 10:00",), ("01/13/2024 10:00",)]
    for formats, first in ((("d/M/y H:m", "M/d/y H:m"), ts(2024, 2, 1, 10)), (("M/d/y H:m", "d/M/y H:m"), ts(2024, 1, 2, 10))):
        got = values(spark, "x string", rows, parse_first(F.col("x"), formats))
        assert got == [first, ts(2024, 2, 13, 10), ts(2024, 1, 13, 10)]


def test_lenient_int(spark):
    rows = [("7",), ("7.5",), ("6.5",), ("1e1",), (" 7 ",), ("",), ("-0.5",), ("5d",), ("Infinity",), ("1e20",), ("abc",), (None,)]
    assert values(spark, "x string", rows, lenient_int(F.col("x"))) == [
        7, 8, 7, 10, 7, None, -1, None, None, None, None, None,
    ]


def test_relabel_and_blanks(spark):
    labels = {"bill": "Billing", "billing": "Billing"}
    x = F.col("x")
    rows = [(" BILL ",), ("Billing",), (" Refund",), (None,)]
    assert values(spark, "x string", rows, relabel(x, labels, F.trim(x))) == [
        "Billing", "Billing", "Refund", None,
    ]
    assert values(spark, "x string", [("  ",), (" a ",), (None,)], blank_to_null(x)) == [None, "a", None]


def test_rounding_is_on_the_binary_value(spark):
    x = F.col("x")
    assert values(spark, "x double", [(1.005,), (0.285,)], round_to(x, 2)) == [1.0, 0.28]
    assert values(spark, "x double", [(33.35,)], round_to(x, 1)) == [33.4]
    assert values(spark, "x double", [(2.5,), (-2.5,), (None,)], round_to(x)) == [3.0, -3.0, None]


def test_pct_of_nothing_is_null(spark):
    out = pct(F.col("a"), F.col("b"))
    assert values(spark, "a bigint, b bigint", [(1, 3), (0, 0)], out) == [33.3, None]


def test_bucketize_sends_null_to_the_last_bin(spark):
    out = bucketize(F.col("x"), ((2, "low"), (4, "mid"), (None, "high")))
    assert values(spark, "x double", [(1.9,), (2.0,), (4.0,), (None,)], out) == [
        "low", "mid", "high", "high",
    ]


def test_weekday_and_severity(spark):
    sunday = [(ts(2025, 6, 1),)]
    assert values(spark, "x timestamp_ntz", sunday, weekday_number(F.col("x"))) == [0]
    assert values(spark, "x timestamp_ntz", sunday, weekday_name(F.col("x"))) == ["Sunday"]
    ranks = severity_rank(F.col("x"), ("Urgent", "Low"))
    assert values(spark, "x string", [("Low",), ("Urgent",), ("odd",)], ranks) == [2, 1, None]


def test_safe_corr(spark):
    def corr(rows):
        df = spark.createDataFrame(rows, "x double, y double")
        return df.agg(safe_corr(F.col("x"), F.col("y"))).first()[0]

    assert corr([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)]) == pytest.approx(1.0)
    assert corr([(1.0, 2.0), (1.0, 4.0)]) is None
    assert corr([(1.0, 2.0)]) is None
    assert corr([(1.0, 3.0), (2.0, 1.0), (None, 9.0)]) == pytest.approx(-1.0)


def reference_chi2_tail(x, dof):
    """Direct sums in Python floats with the library's exact erfc and gamma."""
    h = x / 2
    if dof % 2 == 0:
        return math.exp(-h) * sum(h**i / math.factorial(i) for i in range(dof // 2))
    return math.erfc(math.sqrt(h)) + math.exp(-h) * sum(
        h ** (i - 0.5) / math.gamma(i + 0.5) for i in range(1, (dof - 1) // 2 + 1)
    )


def test_chi2_tail(spark):
    grid = [(x, d) for x in (0.01, 0.5, 3.84, 7.8147, 20.0, 60.0) for d in range(1, 21)]
    got = values(spark, "x double, d bigint", grid, chi2_tail("x", "d"))
    for (x, d), p in zip(grid, got):
        assert p == pytest.approx(reference_chi2_tail(x, d), rel=1e-6, abs=1e-12), (x, d)
    assert round(values(spark, "x double, d bigint", [(7.8147, 3)], chi2_tail("x", "d"))[0], 4) == 0.05


def test_chi2_tail_far_out(spark):
    rows = [(0.0, 3), (-1.0, 3), (None, 3), (5.0, 0), (5000.0, 5000), (5000.0, 5001), (3000.0, 2)]
    got = values(spark, "x double, d bigint", rows, chi2_tail("x", "d"))
    assert got[:4] == [1.0, 1.0, None, None]
    # the mean of the distribution splits it almost in half
    assert got[4] == pytest.approx(0.4973, abs=1e-3)
    assert got[5] == pytest.approx(0.5013, abs=1e-3)
    assert got[6] == 0.0


def test_normal_two_sided(spark):
    rows = [(1.959964,), (-1.959964,), (0.0,), (None,)]
    got = values(spark, "z double", rows, normal_two_sided("z"))
    assert got[0] == got[1] == pytest.approx(0.05, abs=1e-6)
    assert got[2] == pytest.approx(1.0, abs=1e-6)
    assert got[3] is None
