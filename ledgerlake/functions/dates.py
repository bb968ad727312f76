"""Dates from text, financial years and month arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SERIAL_DAY_0 = "1899-12-30"
#: Two-digit years from here on are of the 20th century.
CENTURY_FROM = 70
#: Fixed values, tried in this order: a guard and a format; the guard keeps the parser from reading anything else.
SPEND_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/yy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/y"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.y"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/y"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-y"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{2}$", "d-MMM-yy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-y"),
    (r"^\d{1,2} [A-Za-z]{3} \d{2}$", "d MMM yy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM y"),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", "d MMMM y"),
)
DAY_FIRST_WITH_TIME = r"^(\d{1,2}/\d{1,2}/\d{4}) \d{1,2}:\d{2}(:\d{2})?$"
ISO_WITH_TIME = r"^(\d{4}-\d{2}-\d{2})[T ]\d{2}:\d{2}.*$"


def _of_century(d: Column) -> Column:
    """A date from a two-digit year, which the parser takes for 2000 to 2099: from CENTURY_FROM on a hundred years earlier."""
    return F.when(F.year(d) >= 2000 + CENTURY_FROM, F.add_months(d, -1200)).otherwise(d)


def _formats(text: Column, formats=SPEND_FORMATS) -> Column:
    # Month names in the case the parser wants: first letter upper.
    text = F.initcap(text)
    read = lambda form: F.try_to_timestamp(text, F.lit(form)).cast("date")
    return F.coalesce(*(F.when(text.rlike(guard), _of_century(read(form)) if form.endswith("yy") and not form.endswith("yyyy") else read(form)) for guard, form in formats))


def from_serial(n: Column, low: int, high: int, day_0: str = SERIAL_DAY_0) -> Column:
    """Spreadsheet serial strictly between ``low`` and ``high``."""
    n = n.try_cast("double")
    return F.when((n > low) & (n < high), F.date_add(F.lit(day_0).cast("date"), F.floor(n).cast("int")))


def parse_date_spend(s: Column) -> Column:
    """Payment date.  Impossible dates are NULL, they don't roll forward."""
    t = F.trim(F.regexp_replace(s, r"^[\s ​﻿]+|[\s ​﻿]+$", ""))
    month_year = F.when(t.rlike(r"^[A-Za-z]{3}-\d{2}$"), _of_century(F.try_to_timestamp(F.concat(F.lit("01-"), F.initcap(t)), F.lit("dd-MMM-yy")).cast("date")))
    day_first = F.regexp_extract(t, DAY_FIRST_WITH_TIME, 1)
    iso = F.regexp_extract(t, ISO_WITH_TIME, 1)
    serial = F.when(t.rlike(r"^\d+(\.\d+)?$"), from_serial(t, 40000, 60000))
    return F.coalesce(serial, month_year, _formats(t), F.when(day_first != "", _formats(day_first)), F.when(iso != "", _formats(iso)))


def parse_date_styled(s: Column, style: Column, period: Column) -> Column:
    """With a per-source ``style``, else (and for what it doesn't fit) as ``parse_date_spend``.

    month_first; epoch2000 (serials from 2000-01-01); day_month (year from the
    period); slash_iso (a day as y/m/d, whatever follows); year_bump (a date in
    the period's month of the year before is the period's).
    """

    def styled(t: Column, plain: Column) -> Column:
        month_first = F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(t, F.lit("M/d/y")).cast("date"))
        epoch = from_serial(t.try_cast("double") + 36525, 7000 + 36525, 12000 + 36525)
        dated = F.when(t.rlike(r"^\d{1,2}-[A-Za-z]{3}$"), F.try_to_timestamp(F.concat(F.initcap(t), F.lit("-"), F.left(period, F.lit(4))), F.lit("d-MMM-y")).cast("date"))
        head = F.regexp_extract(t, r"^(\d{4}/\d{2}/\d{2})", 1)
        slashed = F.when(head != "", F.try_to_timestamp(head, F.lit("yyyy/MM/dd")).cast("date"))
        late = (F.date_format(plain, "MM") == F.substring(period, 6, 2)) & (F.year(plain) + 1 == F.left(period, F.lit(4)).cast("int"))
        bumped = F.when(late, F.try_to_timestamp(F.concat(F.left(period, F.lit(4)), F.date_format(plain, "-MM-dd")), F.lit("yyyy-MM-dd")).cast("date"))
        own = F.when(style == "month_first", month_first).when(style == "epoch2000", epoch).when(style == "day_month", dated).when(style == "slash_iso", slashed).when(style == "year_bump", bumped)
        return F.coalesce(own, plain)

    # Text and plain date are used many times over: lambdas evaluate them once.
    once = lambda c, f: F.get(F.transform(F.array(c), f), 0)
    return once(F.trim(s), lambda t: once(parse_date_spend(t), lambda plain: styled(t, plain)))


def parse_date_register(s: Column) -> Column:
    """Register date.  Impossible numeric dates roll forward (31/04 is 1 May, month 13 next January); years 1900 to 2100."""
    t = F.trim(F.regexp_replace(s, r"(?i)(\d)(st|nd|rd|th)\b", "$1"))
    serial = F.when(t.rlike(r"^\d+(\.\d+)?$"), from_serial(t, 30000, 60000))

    def rolled(y: Column, m: Column, d: Column) -> Column:
        first = F.add_months(F.make_date(y, F.lit(1), F.lit(1)), m - 1)
        return F.date_add(first, d - 1)

    part = lambda pattern, k: F.nullif(F.regexp_extract(t, pattern, k), F.lit("")).cast("int")
    dmy, ymd = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$", r"^(\d{4})[/-](\d{1,2})[/-](\d{1,2})(?:[T ]\d{1,2}:\d{1,2}:\d{1,2})?$"
    short = r"^(\d{1,2})/(\d{1,2})/(\d{2})$"
    numeric = F.coalesce(rolled(part(dmy, 3), part(dmy, 2), part(dmy, 1)), rolled(part(ymd, 1), part(ymd, 2), part(ymd, 3)), rolled(part(short, 3) + F.when(part(short, 3) >= CENTURY_FROM, 1900).otherwise(2000), part(short, 2), part(short, 1)))
    out = F.coalesce(serial, numeric, _formats(t, SPEND_FORMATS[8:]))
    return F.when(F.year(out).between(1900, 2100), out)


def swap_into_period(d: Column, period: Column) -> Column:
    """Day and month swapped where only that puts the date in its period."""
    swapped = F.when(F.dayofmonth(d) <= 12, F.make_date(F.year(d), F.dayofmonth(d), F.month(d)))
    return F.when((F.date_format(d, "yyyy-MM") != period) & (F.date_format(swapped, "yyyy-MM") == period), swapped).otherwise(d)


def fallback_to_period(d: Column, period: Column, flag: Column) -> Column:
    """First of the period where the date is missing and the source is flagged."""
    return F.coalesce(d, F.when(flag, F.try_to_timestamp(F.concat(period, F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date")))


def fy_from_date(d: Column) -> Column:
    """Financial year from 1 April, named by its first calendar year."""
    return F.year(d) - F.when(F.month(d) < 4, 1).otherwise(0)


def fy_from_period(p: Column) -> Column:
    year, month = F.substring(p, 1, 4).cast("int"), F.substring(p, 6, 2).cast("int")
    return year - F.when(month < 4, 1).otherwise(0)


def fy_range(fy: Column) -> tuple[Column, Column]:
    return F.make_date(fy, F.lit(4), F.lit(1)), F.make_date(fy + 1, F.lit(3), F.lit(31))


def last_complete_month(as_of: Column) -> Column:
    return F.date_format(F.add_months(as_of, -1), "yyyy-MM")


def month_index(p: Column) -> Column:
    return F.substring(p, 1, 4).cast("int") * 12 + F.substring(p, 6, 2).cast("int") - 1


def month_of_index(n: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(n / 12).cast("int"), (n % 12 + 1).cast("int"))
