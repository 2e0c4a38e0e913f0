"""Normal forms of single mentions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hourlens.functions.periods import normalize_period

# Accepted date shapes and their formats.
DATE_FORMS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yy"),
    (r"^[A-Za-z]{4,} \d{1,2} \d{4}$", "MMMM d yyyy"),
    (r"^[A-Za-z]{3} \d{1,2} \d{4}$", "MMM d yyyy"),
    (r"^[A-Za-z]{4,} \d{1,2} \d{2}$", "MMMM d yy"),
    (r"^[A-Za-z]{3} \d{1,2} \d{2}$", "MMM d yy"),
    (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", "d MMMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
)


def normalize_date(text: Column) -> Column:
    """ISO date of a written date, else the text itself."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, ",", " "), r"\s+", " "))
    # Month names must be capitalised for the parser; digits are unaffected.
    plain = F.initcap(plain)

    def parsed(day: Column) -> Column:
        out = F
        for shape, fmt in DATE_FORMS:
            out = out.when(F.rlike(day, F.lit(shape)), F.try_to_date(day, fmt))
        return out

    # A one-element array binds the plain text once for all forms.
    return F.coalesce(F.date_format(F.get(F.transform(F.array(plain), parsed), 0), "yyyy-MM-dd"), text)


def normalize_number(text: Column) -> Column:
    """Number without thousands commas: ``1,000.50`` is ``1000.5``."""
    plain = F.regexp_replace(text, ",", "")
    whole = F.regexp_replace(plain, r"^0+(?=\d)", "")
    decimal = F.regexp_replace(F.regexp_replace(whole, r"0+$", ""), r"\.$", ".0")
    return (
        F.when(F.rlike(plain, F.lit(r"^\d+$")), whole)
        .when(F.rlike(plain, F.lit(r"^\d+\.\d*$")), decimal)
        .otherwise(text)
    )


def normalize_value(value: Column, kind: Column, as_of: Column) -> Column:
    """Normal form by type; names are returned as they are."""
    return (
        F.when(kind == "date", normalize_date(value))
        .when(kind == "time_period", normalize_period(value, as_of))
        .when(kind == "number", normalize_number(value))
        .otherwise(value)
    )
