"""Period phrases: canonical form and date range, as Column expressions.

``as_of`` is a DATE column (the day the question was asked) or a Python date.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names, ordinal words of quarters, Chinese numerals.
MONTHS = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)
QUARTER_WORDS = ("first", "second", "third", "fourth")
CHINESE_DIGITS = "一二三四五六七八九十"

_MONTH_ALT = "|".join(m.lower() for m in MONTHS)


def _as_date(as_of: Column | dt.date | str) -> Column:
    if isinstance(as_of, dt.date):
        return F.lit(as_of)
    return F.col(as_of) if isinstance(as_of, str) else as_of


def quarter_label(day: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(day).cast("string"), F.lit(" "), F.year(day).cast("string"))


def month_label(day: Column) -> Column:
    return F.date_format(day, "MMMM yyyy")


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def _lookup(key: Column, pairs: dict[str, str]) -> Column:
    table = F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))
    return F.try_element_at(table, key)


def _iso_day(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def _week_label(monday: Column) -> Column:
    return F.concat(_iso_day(monday), F.lit(" - "), _iso_day(F.date_add(monday, 6)))


def normalize_period(text: Column, as_of: Column | dt.date | str) -> Column:
    """Canonical period: ``Q1 2025``, ``March 2025``, ``2025``, ``Week 3 2025``, an ISO
    day, or ``day - day``. A text that holds no known phrase is returned trimmed."""
    today = _as_date(as_of)
    this_year = F.year(today).cast("string")
    raw = F.trim(text)
    plain = F.lower(F.regexp_replace(raw, r"\s+", " "))
    # A one-element array binds the plain text once for all patterns.
    return F.get(F.transform(F.array(plain), lambda low: _canonical(text, raw, low, today, this_year)), 0)


def _canonical(text: Column, raw: Column, low: Column, today: Column, this_year: Column) -> Column:
    words = {w: str(i + 1) for i, w in enumerate(QUARTER_WORDS)}
    chinese = {c: str(i + 1) for i, c in enumerate(CHINESE_DIGITS)}
    chinese |= {"十" + c: str(i + 11) for i, c in enumerate(CHINESE_DIGITS[:2])}

    def quarter(number: Column, year: Column) -> Column:
        return F.concat(F.lit("Q"), number, F.lit(" "), year)

    def month(number: Column, year: Column) -> Column:
        names = {str(i + 1): m for i, m in enumerate(MONTHS)}
        return F.concat(_lookup(F.ltrim(number, F.lit("0")), names), F.lit(" "), year)

    def shift(step: int, unit: str) -> Column:
        months = {"month": 1, "quarter": 3, "year": 12}[unit]
        start = F.add_months(F.trunc(today, unit), step * months)
        return {"month": month_label, "quarter": quarter_label}.get(
            unit, lambda d: F.year(d).cast("string")
        )(start)

    quarter_forms = [
        (r"q([1-4])\s*(\d{4})", 1, 2, None),
        (r"(\d{4})年?\s*q([1-4])", 2, 1, None),
        (r"quarter ([1-4]) (?:of )?(\d{4})", 1, 2, None),
        (r"(\d{4}) quarter ([1-4])", 2, 1, None),
        (r"(first|second|third|fourth) quarter (?:of )?(\d{4})", 1, 2, words),
        (r"(\d{4})年第?([一二三四])季度", 2, 1, chinese),
    ]
    out = F.when(F.rlike(raw, F.lit(r"^\d{4}-\d{2}-\d{2}( ?- ?\d{4}-\d{2}-\d{2})?$")), raw)
    for pattern, number, year, table in quarter_forms:
        digit = _group(low, pattern, number)
        out = out.when(
            F.rlike(low, F.lit(pattern)),
            quarter(_lookup(digit, table) if table else digit, _group(low, pattern, year)),
        )
    out = out.when(
        F.rlike(low, F.lit(r"\b(first|second|third|fourth) quarter\b")),
        quarter(_lookup(_group(low, r"(first|second|third|fourth) quarter", 1), words), this_year),
    )
    out = out.when(F.rlike(low, F.lit(r"^q[1-4]$")), quarter(F.substring(low, 2, 1), this_year))
    out = out.when(
        F.rlike(low, F.lit("第[一二三四]季度")),
        quarter(_lookup(_group(low, "第([一二三四])季度", 1), chinese), this_year),
    )
    relative = {-1: ("last|previous", "上"), 0: ("this", "今本"), 1: ("next", "下")}
    for step, (english, characters) in relative.items():
        for unit, character in (("month", "月"), ("quarter", "季"), ("year", "年")):
            out = out.when(
                F.rlike(low, F.lit(rf"\b({english}) {unit}\b|[{characters}]个?{character}")),
                shift(step, unit),
            )
        monday = F.date_add(F.trunc(today, "week"), 7 * step)
        out = out.when(F.rlike(low, F.lit(rf"\b({english}) week\b")), _week_label(monday))
        out = out.when(F.rlike(low, F.lit(rf"\b({english}) day\b")), _iso_day(F.date_add(today, step)))
    week = r"\bweek (\d{1,2})(?: of)? (\d{4})\b"
    out = out.when(
        F.rlike(low, F.lit(week)),
        F.concat(F.lit("Week "), _group(low, week, 1), F.lit(" "), _group(low, week, 2)),
    )
    named = rf"\b({_MONTH_ALT})\s*(\d{{4}})\b"
    out = out.when(
        F.rlike(low, F.lit(named)),
        F.concat(F.initcap(_group(low, named, 1)), F.lit(" "), _group(low, named, 2)),
    )
    numbered = r"(\d{4})年(0?[1-9]|1[0-2])月"
    out = out.when(
        F.rlike(low, F.lit(numbered)), month(_group(low, numbered, 2), _group(low, numbered, 1))
    )
    chinese_month = rf"^([{CHINESE_DIGITS}]|十[一二])月份?$"
    out = out.when(
        F.rlike(low, F.lit(chinese_month)),
        month(_lookup(_group(low, chinese_month, 1), chinese), this_year),
    )
    year = r"(?:^|[^\d-])(\d{4})(?:$|[^\d-])"
    out = out.when(F.rlike(low, F.lit(year)), _group(low, year, 1))
    return F.when(text.isNotNull(), out.otherwise(raw))


def period_range(canonical: Column) -> Column:
    """(start_date, end_date) struct of a canonical period; both NULL when unknown.

    Week 1 of a year starts on its first Monday.
    """

    def day(text: Column, fmt: str = "yyyy-MM-dd") -> Column:
        return F.try_to_date(text, fmt)

    span = r"^(\d{4}-\d{2}-\d{2})\s*-\s*(\d{4}-\d{2}-\d{2})$"
    quarter = r"^Q([1-4])\s+(\d{4})$"
    week = r"^(?i:week)\s+(\d{1,2})(?:\s+of)?\s+(\d{4})$"
    month_start = day(F.concat(F.lit("1 "), canonical), "d MMMM yyyy")
    # The CASTs see '' for rows of other forms, hence try_cast.
    q_month = (F.regexp_extract(canonical, quarter, 1).try_cast("int") * 3 - 2).cast("string")
    q_start = day(F.concat(F.regexp_extract(canonical, quarter, 2), F.lit("-"), q_month, F.lit("-1")), "yyyy-M-d")
    week_year = F.regexp_extract(canonical, week, 2)
    first_monday = F.next_day(F.date_sub(day(F.concat(week_year, F.lit("-01-01"))), 1), "MON")
    w_start = F.date_add(first_monday, (F.regexp_extract(canonical, week, 1).try_cast("int") - 1) * 7)

    def case(*branches: tuple[Column, Column]) -> Column:
        out = F
        for condition, value in branches:
            out = out.when(condition, value)
        return out

    is_span = F.rlike(canonical, F.lit(span))
    is_day = F.rlike(canonical, F.lit(r"^\d{4}-\d{2}-\d{2}$"))
    is_quarter = F.rlike(canonical, F.lit(quarter))
    is_year = F.rlike(canonical, F.lit(r"^\d{4}$"))
    is_week = F.rlike(canonical, F.lit(week))
    is_month = F.rlike(canonical, F.lit(rf"^({'|'.join(MONTHS)}) \d{{4}}$"))
    start = case(
        (is_span, day(F.regexp_extract(canonical, span, 1))), (is_day, day(canonical)),
        (is_quarter, q_start), (is_month, month_start),
        (is_year, day(F.concat(canonical, F.lit("-01-01")))), (is_week, w_start),
    )
    end = case(
        (is_span, day(F.regexp_extract(canonical, span, 2))), (is_day, day(canonical)),
        (is_quarter, F.last_day(F.add_months(q_start, 2))), (is_month, F.last_day(month_start)),
        (is_year, day(F.concat(canonical, F.lit("-12-31")))), (is_week, F.date_add(w_start, 6)),
    )
    known = start.isNotNull() & end.isNotNull()
    return F.struct(F.when(known, start).alias("start_date"), F.when(known, end).alias("end_date"))


def unresolved(canonical: Column) -> Column:
    """The period text names no known range."""
    return period_range(canonical)["start_date"].isNull()
