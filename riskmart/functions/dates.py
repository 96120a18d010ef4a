"""Dates out of text, month arithmetic and month series."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The date type ends about 5.88 million years back. Whoever missed more months than fit
# gets the earliest date this far back, and with it the largest number of days past due.
MONTHS_BACK_IN_TYPE = 12 * 5_800_000


def parse_date(c: Column) -> Column:
    """Text in day/month/year or ISO form -> date, anything else -> NULL.

    Rearranged by pattern and then cast: a formatter per row would throw and
    catch an exception for every text of the other form. Text of the plain form
    yyyy-mm-dd, by far the most, needs no pattern: with its two dashes and a last
    digit in place, the cast takes nothing but digits between them.
    """
    plain = (
        (F.length(c) == 10)
        & (F.substring(c, 5, 1) == "-")
        & (F.substring(c, 8, 1) == "-")
        & F.substring(c, 10, 1).between("0", "9")
    )
    return F.coalesce(F.when(plain, c.try_cast("date")), _date_by_pattern(c))


def _date_by_pattern(c: Column) -> Column:
    iso = F.regexp_replace(c, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$2-$1")
    return F.regexp_extract(iso, r"^\d{4}-\d{1,2}-\d{1,2}$", 0).try_cast("date")


def first_missed_date(snapshot: Column, missed: Column) -> Column:
    """The snapshot moved back by the missed months (month ends are clamped).

    NULL only where no month was missed or their number is unknown.
    """
    months = F.least(missed, F.lit(MONTHS_BACK_IN_TYPE)).cast("int")
    return F.when(missed >= 1, F.add_months(snapshot, -months))


def history_months(c: Column) -> Column:
    """'22 Years and 1 Months' -> 265; NULL when either part is missing."""
    years = F.regexp_extract(c, r"(\d+)\s*Years", 1).try_cast("int")
    months = F.regexp_extract(c, r"(\d+)\s*Months", 1).try_cast("int")
    return F.try_add(F.try_multiply(years, F.lit(12)), months)


def month_series(start: Column, end: Column) -> Column:
    """Array of all firsts of a month from start's month up to end (empty if end is earlier)."""
    first = F.trunc(start, "MM")
    return F.when(first <= end, F.sequence(first, end, F.expr("interval 1 month"))).otherwise(
        F.array().cast("array<date>")
    )


def add_months_py(day: dt.date, months: int) -> dt.date:
    """Month arithmetic on a job argument, clamped to the month's last day."""
    index = day.year * 12 + day.month - 1 + months
    year, month = divmod(index, 12)
    return dt.date(year, month + 1, min(day.day, calendar.monthrange(year, month + 1)[1]))
