"""Chart data over the whole star and the question log."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourlens.functions import charts as C
from hourlens.operators import chartdata as D
from hourlens.plans import reports as R
from hourlens.sources.tpch import questions, star, table
from hourlens.workload import register
from hourlens.workload.reports import HE, with_star
from hourlens.workload.texts import with_questions


def _department_hours(spark, base):
    s = star(spark, base)
    fact = R._hours_per(s.work_hour, "employee_id")
    return R._of_employees(s, fact, F.lit(True)).groupBy("department").agg(F.sum("hours").alias("hours"))


@register("type_result_dates", """
SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS created_at, CASE WHEN o_orderstatus = 'F' THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS "date" FROM orders""")
def type_result_dates(spark, base):
    """created_at parses throughout and is typed, date does not and stays text."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = table(spark, base, "orders").select(
        "o_orderkey", day.alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", "unknown").otherwise(day).alias("date"))
    return D.type_result_dates(raw).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@register("chart_other_bucket", with_star(f"""
SELECT CASE WHEN rn <= 6 THEN department ELSE 'Other' END AS department, sum(hours) AS hours FROM (
  SELECT *, row_number() OVER (ORDER BY hours DESC, department) AS rn FROM (
    SELECT e.department, sum(h.hours) AS hours FROM {HE} GROUP BY e.department)) GROUP BY 1"""))
def chart_other_bucket(spark, base):
    return D.other_bucket(_department_hours(spark, base))


@register("chart_pivot", with_star(f"""
SELECT e.department, sum(h.hours) FILTER (work_type = 'AF') AS "AF", sum(h.hours) FILTER (work_type = 'AO') AS "AO",
  sum(h.hours) FILTER (work_type = 'NF') AS "NF", sum(h.hours) FILTER (work_type = 'NO') AS "NO",
  sum(h.hours) FILTER (work_type = 'RF') AS "RF", sum(h.hours) FILTER (work_type = 'RO') AS "RO"
FROM {HE} GROUP BY e.department"""))
def chart_pivot(spark, base):
    s = star(spark, base)
    fact = R._hours_per(s.work_hour, "employee_id", "work_type")
    cells = R._of_employees(s, fact, F.lit(True)).groupBy("department", "work_type").agg(F.sum("hours").alias("hours"))
    return D.pivot(cells)


@register("chart_sort", with_star(f"""
SELECT e.department, sum(h.hours) AS hours FROM {HE} GROUP BY e.department ORDER BY hours DESC, e.department"""))
def chart_sort(spark, base):
    return D.chart_sort(_department_hours(spark, base), "bar")


@register("table_preview", """
SELECT doc_id, CASE WHEN length(text) > 20 THEN left(text, 20) || '...' ELSE text END AS text, lang, source, n_chars
FROM documents ORDER BY doc_id LIMIT 15""")
def table_preview(spark, base):
    return D.table_preview(table(spark, base, "documents"), ["doc_id"])


@register("chart_type", with_questions("""
SELECT question_id, CASE
  WHEN contains(low, 'compare') THEN CASE WHEN n <= 10 THEN 'bar' ELSE 'horizontal_bar' END
  WHEN contains(low, 'most') THEN CASE WHEN n > 6 THEN 'horizontal_bar' ELSE 'bar' END
  WHEN c = 2 THEN CASE WHEN n > 10 THEN 'horizontal_bar' ELSE 'bar' END
  WHEN c > 3 THEN CASE WHEN n > 10 THEN 'heatmap' ELSE 'stacked_bar' END
  WHEN c >= 3 AND timed THEN 'line' WHEN n > 20 THEN 'table' ELSE 'bar' END AS chart
FROM (SELECT question_id, lower(text) AS low, session_id % 25 + 1 AS n, session_id % 4 + 2 AS c, session_id % 2 = 0 AS timed FROM questions)"""))
def chart_type(spark, base):
    """The result shape of a question is derived from its session."""
    rows = F.pmod("session_id", F.lit(25)) + 1
    columns = F.pmod("session_id", F.lit(4)) + 2
    timed = F.pmod("session_id", F.lit(2)) == 0
    kind = C.chart_type(rows, columns, timed, F.col("text"), F.lit(None).cast("string"))
    return questions(spark, base).select("question_id", kind.alias("chart"))


@register("chart_title", with_questions("""
SELECT question_id, CASE WHEN length(t) > 60 THEN left(t, 57) || '...' ELSE t END AS title
FROM (SELECT question_id, regexp_replace(text, '\\?$', '') AS t FROM questions)"""))
def chart_title(spark, base):
    title = C.chart_title(F.col("text"), F.lit(None).cast("string"))
    return questions(spark, base).select("question_id", title.alias("title"))


@register("axis_label", """
SELECT event_id, upper(left(event_type, 1)) || substring(event_type, 2) || ' Of User ' || user_id AS label FROM events""")
def axis_label(spark, base):
    name = F.concat("event_type", F.lit("_of_user_"), F.col("user_id").cast("string"))
    return table(spark, base, "events").select("event_id", C.axis_label(name).alias("label"))


@register("job_chart_data", with_star(f"""
SELECT 'horizontal_bar' AS chart, 'Share of hours by department' AS title, department, hours FROM (
  SELECT CASE WHEN rn <= 6 THEN department ELSE 'Other' END AS department, sum(hours) AS hours FROM (
    SELECT *, row_number() OVER (ORDER BY hours DESC, department) AS rn FROM (
      SELECT e.department, sum(h.hours) AS hours FROM {HE} GROUP BY e.department)) GROUP BY 1)"""))
def job_chart_data(spark, base):
    """A result typed, profiled and shaped: chart and title next to the series."""
    result = D.type_result_dates(_department_hours(spark, base))
    size = result.agg(F.count("*").alias("n")).scalar()
    text = F.lit("share of hours by department?")
    none = F.lit(None).cast("string")
    return D.other_bucket(result).select(
        C.chart_type(size, F.lit(len(result.columns)), F.lit(False), text, none).alias("chart"),
        C.chart_title(text, none).alias("title"), "department", "hours")
