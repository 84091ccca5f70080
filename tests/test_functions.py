from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from routeboard.functions import (
    DAY_EXACT_CLASSES,
    PATH_EXACT_CLASSES,
    TXN_EXACT_CLASSES,
    TXN_RANGE_CLASSES,
    bucketize,
    quarter_label,
    route_label,
    stable_round,
    strict_double,
    time_bucket,
    weekday_label,
)


def one(spark, expr, value, schema):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("text,want", [
    ("1.5", 1.5), ("2", 2.0), ("1e3", 1000.0), (" 7 ", 7.0), ("-3.25", -3.25), ("+4", 4.0),
    ("5.", 5.0), (".5", 0.5), ("1E+5", 100000.0), ("-Infinity", float("-inf")), ("inf", float("inf")),
    ("1d", None), ("1f", None), ("0x1F", None), ("1,000", None), ("", None), ("abc", None),
    ("true", None), ("[1,2]", None), ('{"x":1}', None), (".", None), ("1e", None), (None, None),
])
def test_strict_double(spark, text, want):
    got = one(spark, strict_double("s"), text, "s string")
    assert got == want


def test_strict_double_nan(spark):
    got = one(spark, strict_double("s"), "NaN", "s string")
    assert got != got


@pytest.mark.parametrize("x,want", [(2.5, 3.0), (-2.5, -3.0), (2.4999999999, 3.0), (1.49994, 1.0), (None, None)])
def test_stable_round(spark, x, want):
    assert one(spark, stable_round("x"), x, "x double") == want


@pytest.mark.parametrize("n,want", [
    (0, None), (1, "1 Txn"), (2, "2 Txns"), (3, "3-5 Txns"), (5, "3-5 Txns"), (6, "6-10 Txns"),
    (10, "6-10 Txns"), (11, "11-15 Txns"), (15, "11-15 Txns"), (16, "16-25 Txns"), (25, "16-25 Txns"),
    (26, "26-50 Txns"), (50, "26-50 Txns"), (51, ">50 Txns"), (None, None),
])
def test_txn_ranges(spark, n, want):
    assert one(spark, bucketize("n", TXN_RANGE_CLASSES), n, "n bigint") == want


def test_exact_classes(spark):
    labels = [one(spark, bucketize("n", TXN_EXACT_CLASSES), n, "n bigint") for n in (1, 4, 7, 10, 11, 99)]
    assert labels == ["1 Txn", "4 Txn", "7 Txn", "10 Txns", ">10 Txns", ">10 Txns"]
    assert one(spark, bucketize("n", DAY_EXACT_CLASSES), 2, "n bigint") == "2 Days"
    assert one(spark, bucketize("n", PATH_EXACT_CLASSES), 1, "n bigint") == "1 Path"
    assert one(spark, bucketize("n", PATH_EXACT_CLASSES), 12, "n bigint") == ">10 Paths"


@pytest.mark.parametrize("d,want", [
    (date(2023, 3, 30), "Q1-2023"), (date(2023, 3, 31), None), (date(2023, 6, 29), "Q2-2023"),
    (date(2023, 6, 30), None), (date(2023, 9, 29), "Q3-2023"), (date(2023, 9, 30), None),
    (date(2023, 12, 30), "Q4-2023"), (date(2023, 12, 31), None), (date(2023, 1, 1), "Q1-2023"),
    (date(2022, 1, 1), "Q1-2022"), (date(2026, 12, 30), "Q4-2026"), (date(2021, 12, 31), None),
    (date(2027, 1, 1), None), (date(2024, 2, 29), "Q1-2024"),
])
def test_quarter_label(spark, d, want):
    assert one(spark, quarter_label("d"), d, "d date") == want


def test_quarter_label_options(spark):
    assert one(spark, quarter_label("d", inclusive_last_day=True), date(2023, 3, 31), "d date") == "Q1-2023"
    assert one(spark, quarter_label("d", years=None), date(2030, 5, 1), "d date") == "Q2-2030"


@pytest.mark.parametrize("ts,want", [
    (datetime(2024, 1, 7, 23, 59), "7 - Sun"), (datetime(2024, 1, 8, 0, 0), "1 - Mon"),
    (datetime(2024, 1, 13, 12, 0), "6 - Sat"), (datetime(2023, 1, 1, 0, 0), "7 - Sun"),
])
def test_weekday_label(spark, ts, want):
    assert one(spark, weekday_label("ts"), ts, "ts timestamp_ntz") == want


@pytest.mark.parametrize("grain,d,want", [
    ("day", date(2023, 1, 1), date(2023, 1, 1)),
    ("week", date(2023, 1, 1), date(2022, 12, 26)),   # a Sunday belongs to the week of the Monday before
    ("week", date(2023, 1, 2), date(2023, 1, 2)),
    ("month", date(2023, 2, 28), date(2023, 2, 1)),
])
def test_time_bucket(spark, grain, d, want):
    assert one(spark, time_bucket("d", grain), d, "d date") == want


def test_time_bucket_rejects_unknown_grain():
    with pytest.raises(ValueError):
        time_bucket(F.lit(None), "year")


def test_route_label(spark):
    df = spark.createDataFrame([("a", "b"), (None, "b"), ("a", None)], "s string, d string")
    got = [r["p"] for r in df.select(route_label("s", "d").alias("p")).collect()]
    assert got == ["a➡b", None, None]
