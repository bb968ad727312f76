"""Scalar functions on literal cases."""

import datetime as dt
import zlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import dates, geo, money, text


def value(spark, column_of, *values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"s {kind}")
    return [r.x for r in df.select(column_of(F.col("s")).alias("x")).collect()]


def test_amounts(spark):
    D = Decimal
    assert value(spark, lambda s: money.parse_amount_spend(s, repair=True), "704215 38", "£1,234.56", "-12", "0.00", "abc", None) == [D("704215.38"), D("1234.56"), D("-12.00"), None, None, None]
    assert value(spark, lambda s: money.parse_amount_spend(s, absolute=True), "-12.5") == [D("12.50")]
    assert value(spark, money.parse_amount_authority, "51846.27-", "51846.27", "") == [None, D("51846.27"), None]
    assert value(spark, money.parse_amount_register, "£2,450,000 (with fees) + £300,000 later work", "£12,500 p.a.", "none", "99999999999999", "£3.5") == [D("2450000.00"), D("12500.00"), None, None, D("3.50")]


def test_payment_dates(spark):
    d = dt.date
    got = value(spark, dates.parse_date_spend, "31/04/2026", "20/04/26", "Jun-23", "45000", "2024-02-29", "20240229", "12/25/2020", "01.02.2023", "5-MAR-21", "5 March 2021", "03/04/2022 10:15", "2022-04-03T10:15:00Z", "", None, "x", "39000")
    assert got == [None, d(2026, 4, 20), d(2023, 6, 1), d(2023, 3, 15), d(2024, 2, 29), d(2024, 2, 29), d(2020, 12, 25), d(2023, 2, 1), d(2021, 3, 5), d(2021, 3, 5), d(2022, 4, 3), d(2022, 4, 3), None, None, None, None]


def test_register_dates(spark):
    d = dt.date
    assert value(spark, dates.parse_date_register, "31/04/2026", "1st May 2020", "01/13/2020", "2020-05-06", "44000", "01/01/1800") == [d(2026, 5, 1), d(2020, 5, 1), d(2021, 1, 1), d(2020, 5, 6), d(2020, 6, 18), None]


def test_date_styles(spark):
    df = spark.createDataFrame([("03/04/2022", "month_first", "2022-03"), ("8000", "epoch2000", "2022-03"), ("5-Mar", "day_month", "2022-03"), ("03/04/2022", None, "2022-04")], "s string, style string, p string")
    got = [r.x for r in df.select(dates.parse_date_styled(F.col("s"), F.col("style"), F.col("p")).alias("x")).collect()]
    assert got[0] == dt.date(2022, 3, 4) and got[2] == dt.date(2022, 3, 5) and got[3] == dt.date(2022, 4, 3)
    assert got[1] == dt.date(1899, 12, 30) + dt.timedelta(days=8000 + 36525)


def test_period_repairs(spark):
    df = spark.createDataFrame([(dt.date(2022, 4, 3), "2022-03", True), (dt.date(2022, 4, 20), "2022-03", True), (None, "2022-03", True), (None, "2022-03", False)], "d date, p string, f boolean")
    r = df.select(dates.swap_into_period(F.col("d"), F.col("p")).alias("a"), dates.fallback_to_period(F.col("d"), F.col("p"), F.col("f")).alias("b")).collect()
    assert [x.a for x in r] == [dt.date(2022, 3, 4), dt.date(2022, 4, 20), None, None] and [x.b for x in r][2:] == [dt.date(2022, 3, 1), None]


def test_years_and_months(spark):
    assert value(spark, dates.fy_from_period, "2025-03", "2025-04") == [2024, 2025]
    assert value(spark, lambda s: dates.month_of_index(dates.month_index(s)), "1999-12", "2000-01") == ["1999-12", "2000-01"]
    r = spark.range(1).select(dates.fy_range(F.lit(2023))[0].alias("a"), dates.fy_range(F.lit(2023))[1].alias("b"), dates.last_complete_month(F.lit("2024-01-15").cast("date")).alias("c")).first()
    assert tuple(r) == (dt.date(2023, 4, 1), dt.date(2024, 3, 31), "2023-12")


def test_text(spark):
    assert value(spark, text.sanitise, " a\x00\tb  c ", " \n", None) == ["a b c", None, None]
    assert value(spark, text.strip_accents, "AtkinsRéalis Ñ") == ["atkinsrealis n"]
    assert value(spark, lambda s: text.truncate(s, 4), "abcde", "abcd", None) == ["abc…", "abcd", None]
    assert value(spark, lambda s: text.strip_tags(s, 5), "<b>ab😀cdefg</b>") == ["abcde"]
    assert value(spark, text.labelled_names, "Company name: A Ltd\nx\ncompany name: B", "none") == ["A Ltd / B", None]
    assert value(spark, text.lineage_year, "North 2027 body", "x") == [2027, None] and value(spark, lambda s: text.lineage_status(s, s == "North"), "TBD", "North", "South") == ["tbd", "live", "proposed"]
    assert value(spark, text.region_label, " yorkshire and The Humber", "Wales ") == ["Yorkshire and the Humber", "Wales"]


def test_urgency(spark):
    day = F.lit("2024-01-01").cast("date")
    assert value(spark, lambda s: text.urgency(F.to_date(s), day), "2024-01-30", "2024-03-01", "2024-06-01") == ["high", "medium", None]


def test_crc_and_distance(spark):
    r = spark.createDataFrame([("a", None)], "x string, y int").select(geo.row_crc(F.col("x"), F.col("y")).alias("c"), geo.haversine_km(F.lit(51.5), F.lit(0.0), F.lit(48.86), F.lit(2.35)).alias("km")).first()
    assert r.c == zlib.crc32(b"a\x1f~N~") and r.km == pytest.approx(337.5, abs=3)


def test_years_of_two_digits_and_times(spark):
    got = spark.range(1).select(
        dates.parse_date_spend(F.lit("01/02/85")).alias("a"), dates.parse_date_spend(F.lit("5-Mar-99")).alias("b"), dates.parse_date_spend(F.lit("5-Mar-24")).alias("c"), dates.parse_date_spend(F.lit("Mar-71")).alias("d"),
        dates.parse_date_register(F.lit("2026-03-03T00:00:00")).alias("e"), dates.parse_date_register(F.lit("2026-03-03 10:20:30")).alias("f"), dates.parse_date_register(F.lit("01/02/85")).alias("g"), dates.parse_date_register(F.lit("31/04/24")).alias("h"),
    ).first()
    assert tuple(map(str, got)) == ("1985-02-01", "1999-03-05", "2024-03-05", "1971-03-01", "2026-03-03", "2026-03-03", "1985-02-01", "2024-05-01")


def test_register_amounts_in_words(spark):
    cases = {"Paid £500": 500, "Payment of £3,000": 3000, "£20 p.a. from 2024": 20, "£30 per year, £40 later": 30, "£50 pa": 50, "Space at £60": 60}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: float(r.v) for r in df.select("t", money.parse_amount_register(F.col("t")).alias("v")).collect()} == cases
