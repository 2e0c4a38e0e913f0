"""Filter conditions shared by the reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_contains(needle: str, *columns: Column | str) -> Column:
    """Any column contains ``needle``, ignoring case; ``%`` and ``_`` are plain characters."""
    wanted = F.lower(F.lit(needle))
    hit = F.lit(False)
    for column in columns:
        column = F.col(column) if isinstance(column, str) else column
        hit = hit | F.coalesce(F.contains(F.lower(column), wanted), F.lit(False))
    return hit


def employee_contains(needle: str) -> Column:
    return text_contains(needle, "name", "alias")


def project_contains(needle: str) -> Column:
    return text_contains(needle, "project_reference_id", "name")


def overlaps(lo: dt.date, hi: dt.date) -> Column:
    """The row's interval shares a day with [lo, hi]; a NULL date never matches."""
    return (F.col("start_date") <= F.lit(hi)) & (F.col("end_date") >= F.lit(lo))


def contained(lo: dt.date, hi: dt.date) -> Column:
    """The row's interval lies inside [lo, hi]; a NULL date never matches."""
    return (F.col("start_date") >= F.lit(lo)) & (F.col("end_date") <= F.lit(hi))
