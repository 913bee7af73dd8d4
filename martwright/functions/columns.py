"""Column expressions whose plain Spark counterpart would give a different answer.

Every function takes and returns Columns (or column names), so all of it stays
inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_start(date: Column | str) -> Column:
    """First day of the month, as a date: the grain of every time series here."""
    return F.trunc(_col(date), "month")


def calendar_months_between(start: Column | str, end: Column | str) -> Column:
    """Months from `start` to `end` by calendar month, ignoring the day; may be negative."""
    start, end = _col(start), _col(end)
    return (F.year(end) - F.year(start)) * 12 + (F.month(end) - F.month(start))


def full_months_between(start: Column | str, end: Column | str) -> Column:
    """Completed months from `start` to `end`.

    `months_between` counts 31 January to 29 February as one month, because both are
    month ends. A completed month needs the day of month to be reached.
    """
    start, end = _col(start), _col(end)

    def completed(a: Column, b: Column) -> Column:
        return calendar_months_between(a, b) - (F.dayofmonth(b) < F.dayofmonth(a)).cast("int")

    return F.when(end >= start, completed(start, end)).otherwise(-completed(end, start))


#: Parts of a dollar in which money is added up: six decimals count, further ones are rounded.
PARTS = 1_000_000


def parts(amount: Column | str) -> Column:
    """Money as whole millionths (bigint).

    Sums of them do not depend on the order in which partitions are added up, so a
    retried task or another partitioning gives the same total.
    """
    return F.rint(_col(amount) * PARTS).cast("bigint")


def dollars(total_parts: Column | str) -> Column:
    """Whole millionths back to a double amount."""
    return _col(total_parts) / F.lit(PARTS)


def round_half_away(x: Column | str, digits: int) -> Column:
    """Round on decimals, halves away from zero, and return a double."""
    return F.round(_col(x).cast("decimal(38,10)"), digits).cast("double")


def concat_skipping_nulls(*parts: Column | str) -> Column:
    """Concatenate, treating NULL as absent (`concat` would return NULL)."""
    return F.concat_ws("", *[_col(p).cast("string") for p in parts])


def replace_first(text: Column | str, pattern: str, replacement: str) -> Column:
    """Replace the first match only; `.` also matches a newline."""
    return F.regexp_replace(_col(text), f"(?s)^(.*?)(?:{pattern})", f"$1{replacement}")


def is_blank(text: Column | str) -> Column:
    """NULL or the empty string."""
    return _col(text).isNull() | (_col(text) == "")
