"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date formats, day before month, first match wins.
DAY_FIRST_FORMATS = (
    "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-M-d", "yyyy/M/d", "yyyyMMdd",
    "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy",
)
TWO_DIGIT_YEARS = ("d/M/yy", "d-M-yy", "d.M.yy", "d MMM yy", "d-MMM-yy")
CENTURY_TURN = 2069  # two-digit years from 69 on belong to the 20th century


def day_first_date(column: str | Column) -> Column:
    """Date of a day-first string, a time of day left out; null when no format fits."""
    text = F.trim(F.col(column) if isinstance(column, str) else column)
    day = F.regexp_replace(text, r"[T\s]+\d{1,2}:\d{2}.*$", "")
    short = F.coalesce(*[F.try_to_date(day, fmt) for fmt in TWO_DIGIT_YEARS])
    early = F.when(F.year(short) >= CENTURY_TURN, F.add_months(short, -1200)).otherwise(short)
    return F.coalesce(*[F.try_to_date(day, fmt) for fmt in DAY_FIRST_FORMATS], early)
