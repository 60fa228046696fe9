"""Dates as fixed-width numbers YYYYMM[DD[HH[MM[SS]]]], as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = {"year": "yyyy", "month": "MM", "day": "dd", "hour": "HH", "minute": "mm", "second": "ss", "month_id": "yyyyMM", "day_id": "yyyyMMdd", "hour_id": "yyyyMMddHH", "minute_id": "yyyyMMddHHmm", "second_id": "yyyyMMddHHmmss", "date_str": "dd/MM/yyyy - HH:mm:ss", "date_short": "dd/MM/yyyy", "only_time": "HH:mm:ss", "year_dir": "yyyy"}
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
DAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]


def part(ts: Column, name: str) -> Column:
    return F.date_format(ts, PARTS[name])


def month_name(ts: Column, names: list[str] = MONTHS) -> Column:
    return F.get(F.array(*map(F.lit, names)), F.month(ts) - 1)


def day_name(ts: Column, names: list[str] = DAYS) -> Column:
    return F.get(F.array(*map(F.lit, names)), F.dayofweek(ts) - 1)


def _two(c: Column) -> Column:
    return F.lpad(c, 2, "0")


def str2dateid(c: Column) -> Column:
    """From D/M/YYYY, D.M.YYYY, YYYY-M-D or 8, 12 or 14 digits, with a time if there is one; else ''."""
    dmy, ymd, clock = r"(\d{1,2})[./](\d{1,2})[./](\d{4})", r"(\d{4})-(\d{1,2})-(\d{1,2})", r"(\d{1,2}):(\d{1,2})(?::(\d{2}))?"
    got = lambda p, i: F.regexp_extract(c, p, i)
    day = (
        F.when(c.rlike(dmy), F.concat(got(dmy, 3), _two(got(dmy, 2)), _two(got(dmy, 1))))
        .when(c.rlike(ymd), F.concat(got(ymd, 1), _two(got(ymd, 2)), _two(got(ymd, 3))))
        .when(c.rlike(r"^(?:\d{14}|\d{12}|\d{8})$"), c)
        .otherwise("")
    )
    second = F.when(got(clock, 3) == "", "00").otherwise(got(clock, 3))
    return F.concat(day, F.when(c.rlike(clock), F.concat(_two(got(clock, 1)), _two(got(clock, 2)), second)).otherwise(""))


def dateid2str(c: Column, months: list[str] = MONTHS) -> Column:
    s = lambda a, n: F.substring(c, a, n)
    day = F.concat_ws("/", s(7, 2), s(5, 2), s(1, 4))
    month = F.get(F.array(*map(F.lit, months)), s(5, 2).try_cast("int") - 1)
    return (
        F.when(c.rlike(r"^\d{14}"), F.concat(day, F.lit(" - "), F.concat_ws(":", s(9, 2), s(11, 2), s(13, 2))))
        .when(c.rlike(r"^\d{12}"), F.concat(day, F.lit(" - "), F.concat_ws(":", s(9, 2), s(11, 2))))
        .when(c.rlike(r"^\d{8}"), day)
        .when(c.rlike(r"^\d{6}"), F.concat_ws(" ", month, s(1, 4)))
        .otherwise(c)
    )


def time2str(ts: Column) -> Column:
    return F.date_format(ts, "dd/MM/yyyy - HH:mm:ss")


def to_date(dateid: Column) -> Column:
    return F.try_to_date(F.substring(dateid, 1, 8), "yyyyMMdd") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(F.substring(dateid, 1, 8), F.lit("yyyyMMdd")))


def day_range(first: Column, last: Column) -> Column:
    """All day ids between two, both included; empty if the first is later."""
    a, b = to_date(first), to_date(last)
    days = F.when(a <= b, F.sequence(a, F.greatest(a, b)))
    return F.coalesce(F.transform(days, lambda d: F.date_format(d, "yyyyMMdd")), F.array().cast("array<string>"))


def dateid2week(c: Column) -> Column:
    """Weeks begun on Sunday, the year's first days in week 1 (not ISO weeks)."""
    d = to_date(c)
    diff = (F.dayofyear(d) - 1) - (F.dayofweek(d) - 1)
    whole = F.floor(F.abs(diff) / 7).cast("int")
    return F.when(diff % 7 == 0, (diff / 7).cast("int") + 1).otherwise(whole + 2)


def offset2date(base: Column, offset: str) -> Column:
    """The day id that lies an offset such as -7D, 2M or 1Y1M from a date; months have 30 days and years 365."""
    import re

    n = sum(int(m[1]) * {"D": 1, "M": 30, "Y": 365}[m[2]] for m in re.finditer(r"(\d+)([DMY])", offset))
    return F.date_format(F.date_add(base.cast("date"), -n if offset.startswith("-") else n), "yyyyMMdd")


def days_in_month(d: Column) -> Column:
    return F.dayofmonth(F.last_day(d))
