"""Dates with a precision, durations and ages as column expressions.

A precision date is STRUCT<days INT, precision INT>: days since 0001-01-01 (0 = unknown), precision 7 century, 8 decade,
9 year, 10 month, 11 day. Years before 1 have negative days.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_SHIFT = 719162  # days from 0001-01-01 to 1970-01-01

# The codes of precision.
CENTURY, DECADE, YEAR, MONTH, DAY = 7, 8, 9, 10, 11

STAMP = r"^([+-]?)(\d{4})-(\d{2})-(\d{2})T[^T]*Z$"


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 0001-01-01 by the proleptic Gregorian rule, for any year; NULL for an impossible day."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    limit = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    a = F.floor((14 - m) / 12).cast("int")
    yy, mm = y - a, m + 12 * a - 3
    days = d + F.floor((153 * mm + 2) / 5) + 365 * yy + F.floor(yy / 4) - F.floor(yy / 100) + F.floor(yy / 400) - 307
    return F.when(m.between(1, 12) & d.between(1, limit), days.cast("int"))


def precision_date(stamp: Column, precision: Column) -> Column:
    """A stamp with a precision code as days and precision; what is invalid becomes the zero date (0, 0)."""
    g = lambda i: F.nullif(F.regexp_extract(stamp, STAMP, i), F.lit(""))
    year = g(2).cast("int") * F.when(g(1) == "-", -1).otherwise(1)
    one = F.lit(1)
    days = (
        F.when(precision.isin(CENTURY, DECADE, YEAR), _days(year, one, one))
        .when(precision == MONTH, _days(year, g(3).cast("int"), one))
        .when(precision == DAY, _days(year, g(3).cast("int"), g(4).cast("int")))
    )
    ok = days.isNotNull()
    return F.struct(
        F.when(ok, days).otherwise(0).cast("int").alias("days"), F.when(ok, precision).otherwise(0).cast("int").alias("precision")
    )


def stated_year(stamp: Column) -> Column:
    g = lambda i: F.nullif(F.regexp_extract(stamp, STAMP, i), F.lit(""))
    return g(2).cast("int") * F.when(g(1) == "-", -1).otherwise(1)


def century(year: Column) -> Column:
    """1 for the years 0 to 100, -1 for the years -1 to -100, and so on."""
    up = F.floor((year - 1) / 100) + 1
    down = -(F.floor((-year - 1) / 100) + 1)
    return F.when(year > 0, up).when(year == 0, 1).otherwise(down).cast("int")


def days_to_date(days: Column) -> Column:
    """A DATE for known days of the years 1 to 9999."""
    return F.when(days > 0, F.date_from_unix_date(days - EPOCH_SHIFT))


def format_date(days: Column, locale: str) -> Column:
    return F.date_format(days_to_date(days), "yyyy-MM-dd" if locale == "en" else "dd-MM-yyyy")


def publication_date(dates: Column) -> Column:
    """The first publication date of a package record: a full ISO day, else a year alone, else the zero date."""
    first = F.get(F.filter(dates, lambda e: e["event"].isin("publication", "")), F.lit(0))["stamp"]
    day = F.when(first.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.unix_date(F.try_to_date(first, "yyyy-MM-dd")) + EPOCH_SHIFT)
    y = F.when(first.rlike(r"^\d{4}$") & (first != "0000"), first.cast("int"))
    year = _days(y, F.lit(1), F.lit(1))
    return F.struct(
        F.coalesce(day, year, F.lit(0)).cast("int").alias("days"),
        F.when(day.isNotNull(), DAY).when(year.isNotNull(), YEAR).otherwise(0).cast("int").alias("precision"),
    )


def pdf_date(created: Column, modified: Column) -> Column:
    """'D:YYYY[MM[DD]]', creation before modification, as days and precision."""
    pattern = r"^D:(\d{4})(\d{2})?(\d{2})?"
    pick = F.when(created.rlike(pattern), created).otherwise(modified)
    g = lambda i: F.nullif(F.regexp_extract(pick, pattern, i), F.lit("")).cast("int")
    y, m, d = g(1), g(2), g(3)
    days = _days(y, F.coalesce(m, F.lit(1)), F.coalesce(d, F.lit(1)))
    prec = F.when(d.isNotNull(), DAY).when(m.isNotNull(), MONTH).otherwise(YEAR)
    return F.struct(F.coalesce(days, F.lit(0)).alias("days"), F.when(days.isNotNull(), prec).otherwise(0).cast("int").alias("precision"))


def minutes_of(words: Column, wpm: Column) -> Column:
    """Whole minutes to read; NULL where either is not positive."""
    return F.when((words > 0) & (wpm > 0), F.round(words / wpm).cast("bigint"))


def reading_time(words: Column, wpm: Column) -> Column:
    """'Xd Yh Zm' or 'Yh Zm'; empty where words or speed aren't positive."""
    m = minutes_of(words, wpm)
    d, h, rest = F.floor(m / 1440), F.floor(m % 1440 / 60), m % 60
    text = F.concat(F.when(d > 0, F.concat(d.cast("string"), F.lit("d "))).otherwise(""), h.cast("string"), F.lit("h "), rest.cast("string"), F.lit("m"))
    return F.coalesce(text, F.lit(""))


def reading_time_sql(words: str, wpm: str) -> str:
    m = f"CAST(round({words} / {wpm}) AS BIGINT)"
    return (
        f"CASE WHEN {words} > 0 AND {wpm} > 0 THEN (CASE WHEN {m} // 1440 > 0 THEN ({m} // 1440)::VARCHAR || 'd ' ELSE '' END) "
        f"|| (({m} % 1440) // 60)::VARCHAR || 'h ' || ({m} % 60)::VARCHAR || 'm' ELSE '' END"
    )


def age(birth_days: Column, birth_precision: Column, death_days: Column, death_precision: Column, today: Column) -> Column:
    """Whole years of 365.25 days from birth to death or today; 0 unless the dates are known to the day."""
    dead = F.coalesce(death_days, F.lit(0)) != 0
    end = F.when(dead, death_days).otherwise(F.unix_date(today) + EPOCH_SHIFT)
    known = (birth_precision == DAY) & (birth_days != 0) & (~dead | (death_precision == DAY))
    return F.when(known, F.floor((end - birth_days) / 365.25)).otherwise(0).cast("int")
