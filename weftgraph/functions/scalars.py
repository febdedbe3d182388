"""Dates as epoch milliseconds, lists as ``;`` strings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DAY_MS = 86_400_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def add_days(start: str | Column, days: int | Column) -> Column:
    days = F.lit(days) if isinstance(days, int) else days
    return col(start) + days.cast("long") * F.lit(DAY_MS)


def in_window(date: str | Column, start, days) -> Column:
    """start <= date < start + days."""
    start = F.lit(start) if isinstance(start, int) else start
    return (col(date) >= start) & (col(date) < add_days(start, days))


def utc_date(ms: str | Column) -> Column:
    """The proleptic Gregorian date; also for dates before 1970."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(col(ms) / F.lit(DAY_MS)).cast("int"))


def birthday_in_window(birthday: str | Column, month: int) -> Column:
    """From the 21st of ``month`` to the 21st of the next."""
    date, following = utc_date(birthday), month % 12 + 1
    return ((F.month(date) == month) & (F.dayofmonth(date) >= 21)) | ((F.month(date) == following) & (F.dayofmonth(date) < 22))


def minutes_between(later: str | Column, earlier: str | Column) -> Column:
    """Whole minutes, truncated towards zero."""
    difference = col(later) - col(earlier)
    return (F.sign(difference) * F.floor(F.abs(difference) / 60_000)).cast("long")


def split_list(text: str | Column) -> Column:
    """The parts between semicolons; an empty string is the empty list."""
    return F.when(F.coalesce(col(text), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(col(text), ";"))


def join_list(values: str | Column) -> Column:
    return F.array_join(values, ";")


def optional_id(raw: str | Column) -> Column:
    """Empty and -1 are no id."""
    n = F.nullif(F.trim(col(raw).cast("string")), F.lit("")).cast("long")
    return F.when(n != -1, n)


def id_list(text: str | Column) -> Column:
    """The ids of a ``;`` list without -1 and what isn't a number."""
    ids = F.transform(split_list(text), lambda x: x.try_cast("long"))
    return F.filter(ids, lambda x: x.isNotNull() & (x != -1))


def org_year_list(text: str | Column) -> Column:
    """``org,year;org,year`` as structs; parts that don't parse are left out."""
    parts = F.transform(split_list(text), lambda x: F.struct(F.split(x, ",")[0].try_cast("long").alias("org"), F.get(F.split(x, ","), F.lit(1)).try_cast("int").alias("year")))
    return F.filter(parts, lambda x: x["org"].isNotNull() & x["year"].isNotNull() & (x["org"] != -1))


def bucket_floor(value: str | Column, size: int) -> Column:
    """The multiple of ``size`` at or below ``value``, in whole numbers: labelled ids are beyond the precision of doubles."""
    return col(value) - F.pmod(col(value), F.lit(size))
