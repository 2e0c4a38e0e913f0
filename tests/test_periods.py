import datetime as dt

import pytest
from pyspark.sql import functions as F

from hourlens.functions.periods import normalize_period, period_range, unresolved

AS_OF = dt.date(2026, 2, 15)
Q1 = ("2025-01-01", "2025-03-31")
CASES = [
    ("Q1 2025", "Q1 2025", *Q1), ("q1 2025", "Q1 2025", *Q1), ("2025 Q1", "Q1 2025", *Q1),
    ("quarter 1 of 2025", "Q1 2025", *Q1), ("first quarter of 2025", "Q1 2025", *Q1),
    ("fourth quarter", "Q4 2026", "2026-10-01", "2026-12-31"),
    ("February 2024", "February 2024", "2024-02-01", "2024-02-29"),
    ("December 2025", "December 2025", "2025-12-01", "2025-12-31"),
    ("march 2025", "March 2025", "2025-03-01", "2025-03-31"),
    ("2025", "2025", "2025-01-01", "2025-12-31"), ("FY 2025", "2025", "2025-01-01", "2025-12-31"),
    ("2024-11-11 - 2024-11-17", "2024-11-11 - 2024-11-17", "2024-11-11", "2024-11-17"),
    ("2025-03-15", "2025-03-15", "2025-03-15", "2025-03-15"),
    ("Week 1 2025", "Week 1 2025", "2025-01-06", "2025-01-12"),
    ("week 23 of 2025", "Week 23 2025", "2025-06-09", "2025-06-15"),
    ("this month", "February 2026", "2026-02-01", "2026-02-28"),
    ("last month", "January 2026", "2026-01-01", "2026-01-31"),
    ("this quarter", "Q1 2026", "2026-01-01", "2026-03-31"),
    ("last quarter", "Q4 2025", "2025-10-01", "2025-12-31"),
    ("next quarter", "Q2 2026", "2026-04-01", "2026-06-30"),
    ("last year", "2025", "2025-01-01", "2025-12-31"),
    ("next week", "2026-02-16 - 2026-02-22", "2026-02-16", "2026-02-22"),
    ("maybe 2025", "2025", "2025-01-01", "2025-12-31"),
    ("2025年第一季度", "Q1 2025", *Q1), ("2025年3月", "March 2025", "2025-03-01", "2025-03-31"),
    ("上个月", "January 2026", "2026-01-01", "2026-01-31"), ("今年", "2026", "2026-01-01", "2026-12-31"),
    ("十二月", "December 2026", "2026-12-01", "2026-12-31"), ("2025年Q1", "Q1 2025", *Q1),
    ("sometime", "sometime", None, None), ("2025-02-31", "2025-02-31", None, None),
]


@pytest.fixture(scope="module")
def answers(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "text STRING")
    canonical = df.withColumn("canonical", normalize_period(F.col("text"), AS_OF))
    out = canonical.select("text", "canonical", period_range(F.col("canonical")).alias("r"),
                           unresolved(F.col("canonical")).alias("open"))
    return {r.text: r for r in out.collect()}


@pytest.mark.parametrize("text,canonical,start,end", CASES)
def test_period(answers, text, canonical, start, end):
    r = answers[text]
    assert r.canonical == canonical
    assert (str(r.r.start_date) if r.r.start_date else None, str(r.r.end_date) if r.r.end_date else None) == (start, end)
    assert r.open == (start is None)
