"""Column helpers: the places where Spark's own function would answer differently."""

import pytest
from pyspark.sql import functions as F

from martwright.functions import columns as c
from martwright.functions.growth import with_year_ago


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def date(text):
    return F.lit(text).cast("date")


@pytest.mark.parametrize(
    "start,end,full,calendar",
    [
        ("2024-01-31", "2024-02-29", 0, 1),
        ("2024-01-31", "2024-03-31", 2, 2),
        ("2024-01-01", "2024-12-31", 11, 11),
        ("2023-11-01", "2024-02-01", 3, 3),
        ("2024-03-01", "2024-01-31", -1, -2),
        ("2024-02-29", "2024-01-31", 0, -1),
    ],
)
def test_months_between(spark, start, end, full, calendar):
    assert one(spark, c.full_months_between(date(start), date(end))) == full
    assert one(spark, c.calendar_months_between(date(start), date(end))) == calendar


@pytest.mark.parametrize("x,digits,want", [(2.605, 2, 2.61), (1.005, 2, 1.01), (-0.125, 2, -0.13), (87.75, 1, 87.8)])
def test_round_half_away(spark, x, digits, want):
    assert one(spark, c.round_half_away(F.lit(x), digits)) == want


@pytest.mark.parametrize("amount,want", [(0.29, 290000), (0.004, 4000), (-3.33, -3330000), (1e9 + 0.01, 1000000000010000), (None, None)])
def test_parts(spark, amount, want):
    assert one(spark, c.parts(F.lit(amount).cast("double"))) == want


def test_concat_skips_nulls(spark):
    assert one(spark, c.concat_skipping_nulls(F.lit(None).cast("string"), F.lit("_"), date("2024-05-01"))) == "_2024-05-01"


@pytest.mark.parametrize(
    "name,want",
    [
        ("X Add?on", "X Add-on"),
        ("X Add–on", "X Add-on"),
        ("X Addon", "X Add-on"),
        ("X Add\non", "X Add-on"),
        ("xAdd?on yAdd?on", "xAdd-on yAdd?on"),
        ("line\nAdd?on", "line\nAdd-on"),
        ("Plain", "Plain"),
        (None, None),
    ],
)
def test_replace_first(spark, name, want):
    assert one(spark, c.replace_first(F.lit(name).cast("string"), "Add.?on", "Add-on")) == want


def test_blank(spark):
    values = spark.createDataFrame([(None,), ("",), (" ",), ("x",)], "v string")
    assert [r[0] for r in values.select(c.is_blank("v")).collect()] == [True, True, False, False]


def test_year_ago_needs_the_year_directly_before(spark, rows):
    df = spark.createDataFrame([("a", 2020, 1), ("a", 2021, 2), ("a", 2023, 3), (None, 2020, 4), (None, 2021, 5)], "k string, year int, v int")
    assert rows(with_year_ago(df, ["k"], "v"), "k", "year", "v", "v_year_ago") == sorted(
        [("a", 2020, 1, None), ("a", 2021, 2, 1), ("a", 2023, 3, None), (None, 2020, 4, None), (None, 2021, 5, 4)], key=repr
    )
