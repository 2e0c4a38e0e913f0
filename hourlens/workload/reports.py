"""Star reports, filters, joins and aggregates (whole lineitem, supplier, nation, part)."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from hourlens.operators.partitioning import checkpoint_folder
from hourlens.operators.predicates import contained, employee_contains, overlaps, project_contains
from hourlens.plans import reports as R
from hourlens.sources.star import quarterly_rollup, read_rollup, write_rollup
from hourlens.sources.tpch import star
from hourlens.workload import register

STAR_SQL = """
employee AS (
  SELECT s_suppkey AS uuid, s_name AS name, concat('S-', s_suppkey) AS alias, n_name AS department
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
project AS (
  SELECT p_partkey AS uuid, concat('P-', p_partkey) AS project_reference_id, p_name AS name FROM part),
work_hour AS (
  SELECT l_suppkey AS employee_id, l_partkey AS project_id, l_returnflag || l_linestatus AS work_type,
         l_quantity AS hours, CAST(l_shipdate AS DATE) AS start_date,
         CAST(l_shipdate AS DATE) + l_linenumber AS end_date
  FROM lineitem)"""

ROLLUP_SQL = STAR_SQL + """,
work_hours AS (
  SELECT e.name AS employee, p.name AS project, e.department, h.work_type,
         concat('Q', quarter(h.start_date), ' ', year(h.start_date)) AS period, sum(h.hours) AS hours
  FROM work_hour h JOIN employee e ON e.uuid = h.employee_id JOIN project p ON p.uuid = h.project_id
  GROUP BY ALL)"""

LO, HI = dt.date(1997, 1, 1), dt.date(1997, 3, 31)
LO2, HI2 = dt.date(1998, 4, 1), dt.date(1998, 6, 30)
YLO, YHI = dt.date(1997, 1, 1), dt.date(1997, 12, 31)
OVER = "NOT (h.start_date > DATE '1997-03-31' OR h.end_date < DATE '1997-01-01')"
OVER_YEAR = "NOT (h.start_date > DATE '1997-12-31' OR h.end_date < DATE '1997-01-01')"
OVER2 = "NOT (h.start_date > DATE '1998-06-30' OR h.end_date < DATE '1998-04-01')"
INSIDE = "h.start_date >= DATE '1997-01-01' AND h.end_date <= DATE '1997-03-31'"
INSIDE_YEAR = "h.start_date >= DATE '1997-01-01' AND h.end_date <= DATE '1997-12-31'"
EMP, EMP2, PROJ, PROJ2 = "Supplier#000000001", "s-2", "Small Ring", "blue bolt"
EMP_SQL = "(contains(lower(e.name), 'supplier#000000001') OR contains(lower(e.alias), 'supplier#000000001'))"
EMP2_SQL = "(contains(lower(e.name), 's-2') OR contains(lower(e.alias), 's-2'))"
PROJ_SQL = "(contains(lower(p.project_reference_id), 'small ring') OR contains(lower(p.name), 'small ring'))"
PROJ2_SQL = "(contains(lower(p.project_reference_id), 'blue bolt') OR contains(lower(p.name), 'blue bolt'))"
DEPT, DEPT2 = "NATION_3", "NATION_7"
HE = "work_hour h JOIN employee e ON e.uuid = h.employee_id"
HP = "work_hour h JOIN project p ON p.uuid = h.project_id"
HEP = HE + " JOIN project p ON p.uuid = h.project_id"


def with_star(select: str) -> str:
    return f"WITH {STAR_SQL}\n{select}"


def with_rollup(select: str) -> str:
    return f"WITH {ROLLUP_SQL}\n{select}"


# --- sources -----------------------------------------------------------------


@register("src_star", with_star(f"""
SELECT e.name AS employee, e.department, p.project_reference_id, h.work_type, h.hours, h.start_date, h.end_date
FROM {HE} LEFT JOIN project p ON p.uuid = h.project_id"""))
def src_star(spark, base):
    s = star(spark, base)
    e = s.employee.select(F.col("uuid").alias("employee_id"), F.col("name").alias("employee"), "department")
    p = s.project.select(F.col("uuid").alias("project_id"), "project_reference_id")
    return (
        s.work_hour.join(e, "employee_id").join(p, "project_id", "left")
        .select("employee", "department", "project_reference_id", "work_type", "hours", "start_date", "end_date")
    )


@register("rollup_work_hours", with_rollup("SELECT * FROM work_hours"))
def rollup_work_hours(spark, base):
    return quarterly_rollup(star(spark, base))


def stored_rollup(spark, base):
    """The flat table as it is stored for such queries: written by period and read back."""
    path = f"{checkpoint_folder(spark).rstrip('/')}/rollup-{uuid.uuid4().hex}"
    write_rollup(quarterly_rollup(star(spark, base)), path)
    return read_rollup(spark, path)


# --- filters -------------------------------------------------------------------


@register("filter_employee_contains", with_star(f"SELECT e.* FROM employee e WHERE {EMP2_SQL}"))
def filter_employee_contains(spark, base):
    return star(spark, base).employee.where(employee_contains(EMP2))


@register("filter_project_contains", with_star(f"SELECT p.* FROM project p WHERE {PROJ_SQL}"))
def filter_project_contains(spark, base):
    return star(spark, base).project.where(project_contains(PROJ))


@register("filter_exact_name", with_star(
    "SELECT * FROM employee WHERE name = 'Supplier#000000001' OR department = 'NATION_3'"))
def filter_exact_name(spark, base):
    return star(spark, base).employee.where((F.col("name") == EMP) | (F.col("department") == DEPT))


@register("filter_period_overlap", with_star(f"SELECT h.* FROM work_hour h WHERE {OVER}"))
def filter_period_overlap(spark, base):
    return star(spark, base).work_hour.where(overlaps(LO, HI))


@register("filter_period_contained", with_star(f"SELECT h.* FROM work_hour h WHERE {INSIDE}"))
def filter_period_contained(spark, base):
    return star(spark, base).work_hour.where(contained(LO, HI))


@register("filter_period_label", with_rollup("SELECT * FROM work_hours WHERE period = 'Q1 1997'"))
def filter_period_label(spark, base):
    return stored_rollup(spark, base).where(F.col("period") == "Q1 1997")


@register("filter_in_list", with_star("SELECT * FROM employee WHERE department IN ('NATION_3', 'NATION_7')"))
def filter_in_list(spark, base):
    return star(spark, base).employee.where(F.col("department").isin(DEPT, DEPT2))


@register("distinct_projection", with_star(f"SELECT DISTINCT e.department, h.work_type FROM {HE} WHERE {OVER}"))
def distinct_projection(spark, base):
    s = star(spark, base)
    keys = s.work_hour.where(overlaps(LO, HI)).select("employee_id", "work_type").distinct()
    people = s.employee.select(F.col("uuid").alias("employee_id"), "department")
    return keys.join(people, "employee_id").select("department", "work_type").distinct()


@register("literal_label", with_star(
    f"SELECT 'Q1 1997' AS period, sum(h.hours) AS total_hours FROM work_hour h WHERE {OVER}"))
def literal_label(spark, base):
    return (
        star(spark, base).work_hour.where(overlaps(LO, HI))
        .agg(R.total()).select(F.lit("Q1 1997").alias("period"), "total_hours")
    )


# --- joins -----------------------------------------------------------------------


@register("join_hours_employee", with_star(
    f"SELECT e.name, e.department, h.hours, h.start_date FROM {HE} WHERE {OVER}"))
def join_hours_employee(spark, base):
    s = star(spark, base)
    return R._of_employees(s, s.work_hour.where(overlaps(LO, HI)), F.lit(True)).select(
        F.col("employee_name").alias("name"), "department", "hours", "start_date")


@register("join_hours_project", with_star(
    f"SELECT p.project_reference_id, p.name, h.hours, h.start_date FROM {HP} WHERE {OVER}"))
def join_hours_project(spark, base):
    s = star(spark, base)
    return R._of_projects(s, s.work_hour.where(overlaps(LO, HI)), F.lit(True)).select(
        "project_reference_id", F.col("project_name").alias("name"), "hours", "start_date")


@register("left_join_project", with_star(f"""
SELECT p.name, count(*) AS n_rows, sum(h.hours) AS total_hours
FROM work_hour h LEFT JOIN project p ON p.uuid = h.project_id AND p.name <> 'small ring'
WHERE {OVER} GROUP BY p.name"""))
def left_join_project(spark, base):
    s = star(spark, base)
    known = s._replace(project=s.project.where(F.col("name") != "small ring"))
    fact = (
        s.work_hour.where(overlaps(LO, HI)).groupBy("project_id")
        .agg(F.sum("hours").alias("hours"), F.count("*").alias("n"))
    )
    return R._with_project(known, fact).groupBy(F.col("project_name").alias("name")).agg(
        F.sum("n").alias("n_rows"), R.total())


# --- aggregates ----------------------------------------------------------------------


@register("sum_hours_total", with_star(f"SELECT sum(h.hours) AS total_hours FROM work_hour h WHERE {OVER}"))
def sum_hours_total(spark, base):
    return star(spark, base).work_hour.where(overlaps(LO, HI)).agg(R.total())


@register("sum_hours_by_key", with_star(
    f"SELECT h.employee_id, e.name, sum(h.hours) AS total_hours FROM {HE} WHERE {OVER} GROUP BY h.employee_id, e.name"))
def sum_hours_by_key(spark, base):
    s = star(spark, base)
    fact = R._hours_per(s.work_hour.where(overlaps(LO, HI)), "employee_id")
    return R._of_employees(s, fact, F.lit(True)).select(
        "employee_id", F.col("employee_name").alias("name"), F.col("hours").alias("total_hours"))


@register("sum_coalesce_zero", with_star(
    "SELECT coalesce(sum(h.hours), 0) AS total_hours FROM work_hour h WHERE h.work_type = 'none of them'"))
def sum_coalesce_zero(spark, base):
    return star(spark, base).work_hour.where(F.col("work_type") == "none of them").agg(
        F.coalesce(F.sum("hours"), F.lit(0.0)).alias("total_hours"))


@register("share_of_total", with_star(f"""
SELECT e.department, round(100 * sum(CASE WHEN {PROJ_SQL} THEN h.hours ELSE 0 END) / sum(h.hours), 6) AS share_pct
FROM {HEP} GROUP BY e.department"""))
def share_of_total(spark, base):
    s = star(spark, base)
    fact = R._hours_per(s.work_hour, "employee_id", "project_id")
    hit = project_contains(PROJ)
    tagged = fact.join(s.project.select(F.col("uuid").alias("project_id"), hit.alias("hit")), "project_id")
    on_project = F.sum(F.when(F.col("hit"), F.col("hours")).otherwise(0.0))
    return R._of_employees(s, tagged, F.lit(True)).groupBy("department").agg(
        F.round(100 * on_project / F.nullif(F.sum("hours"), F.lit(0.0)), 6).alias("share_pct"))


# --- whole-question reports ------------------------------------------------------------


@register("q_hours_emp_proj", with_star(
    f"SELECT sum(h.hours) AS total_hours FROM {HEP} WHERE {EMP_SQL} AND {PROJ_SQL} AND {OVER_YEAR}"))
def q_hours_emp_proj(spark, base):
    return R.employee_project_hours(star(spark, base), EMP, PROJ, YLO, YHI)


@register("q_projects_of_emp", with_star(f"""
SELECT DISTINCT p.project_reference_id, p.name FROM {HE} LEFT JOIN project p ON p.uuid = h.project_id
WHERE {EMP_SQL} AND {OVER}"""))
def q_projects_of_emp(spark, base):
    return R.projects_of_employee(star(spark, base), EMP, LO, HI)


@register("q_people_on_proj", with_star(f"SELECT DISTINCT e.name FROM {HEP} WHERE {PROJ_SQL} AND {OVER}"))
def q_people_on_proj(spark, base):
    return R.people_on_project(star(spark, base), PROJ, LO, HI)


@register("q_hours_emp", with_star(f"SELECT sum(h.hours) AS total_hours FROM {HE} WHERE {EMP_SQL} AND {OVER}"))
def q_hours_emp(spark, base):
    return R.employee_hours(star(spark, base), EMP, LO, HI)


@register("q_hours_proj", with_star(f"SELECT sum(h.hours) AS total_hours FROM {HP} WHERE {PROJ_SQL} AND {OVER}"))
def q_hours_proj(spark, base):
    return R.project_hours(star(spark, base), PROJ, LO, HI)


@register("q_compare_emps", with_star(f"""
SELECT e.name, sum(h.hours) AS total_hours FROM {HE}
WHERE ({EMP_SQL} OR {EMP2_SQL}) AND {OVER} GROUP BY e.uuid, e.name"""))
def q_compare_emps(spark, base):
    return R.compare_employees(star(spark, base), EMP, EMP2, LO, HI)


@register("q_compare_projs", with_star(f"""
SELECT p.project_reference_id, p.name, sum(h.hours) AS total_hours FROM {HP}
WHERE ({PROJ_SQL} OR {PROJ2_SQL}) AND {OVER} GROUP BY p.uuid, p.project_reference_id, p.name"""))
def q_compare_projs(spark, base):
    return R.compare_projects(star(spark, base), PROJ, PROJ2, LO, HI)


@register("q_top_projects", with_star(f"""
SELECT project_reference_id, name, total_hours FROM (
  SELECT p.uuid, p.project_reference_id, p.name, sum(h.hours) AS total_hours
  FROM work_hour h LEFT JOIN project p ON p.uuid = h.project_id WHERE {OVER}
  GROUP BY p.uuid, p.project_reference_id, p.name)
ORDER BY total_hours DESC, uuid ASC NULLS LAST LIMIT 5"""))
def q_top_projects(spark, base):
    return R.top_projects(star(spark, base), LO, HI)


@register("q_top_employees", with_star(f"""
SELECT name, total_hours FROM (
  SELECT e.uuid, e.name, sum(h.hours) AS total_hours FROM {HE} WHERE {OVER} GROUP BY e.uuid, e.name)
ORDER BY total_hours DESC, uuid LIMIT 5"""))
def q_top_employees(spark, base):
    return R.top_employees(star(spark, base), LO, HI)


@register("q_emp_by_project", with_star(f"""
SELECT p.project_reference_id, p.name, sum(h.hours) AS hours FROM {HE} LEFT JOIN project p ON p.uuid = h.project_id
WHERE {EMP_SQL} AND {OVER_YEAR} GROUP BY p.uuid, p.project_reference_id, p.name"""))
def q_emp_by_project(spark, base):
    return R.employee_hours_by_project(star(spark, base), EMP, YLO, YHI)


@register("q_hours_emp_proj_exact", with_star(f"""
SELECT sum(h.hours) AS total_hours FROM {HEP}
WHERE e.name = 'Supplier#000000001' AND contains(lower(p.name), 'small ring') AND {INSIDE_YEAR}"""))
def q_hours_emp_proj_exact(spark, base):
    return R.employee_project_hours_exact(star(spark, base), EMP, PROJ, YLO, YHI)


@register("q_dept_by_employee", with_star(f"""
SELECT e.name, sum(h.hours) AS total_hours FROM {HE} WHERE e.department = 'NATION_3' AND {INSIDE} GROUP BY e.name"""))
def q_dept_by_employee(spark, base):
    return R.department_hours_by_employee(star(spark, base), DEPT, LO, HI)


@register("q_hours_dept", with_star(
    f"SELECT sum(h.hours) AS total_hours FROM {HE} WHERE e.department = 'NATION_3' AND {OVER}"))
def q_hours_dept(spark, base):
    return R.department_hours(star(spark, base), DEPT, LO, HI)


@register("q_hours_work_type", with_star(
    f"SELECT sum(h.hours) AS total_hours FROM work_hour h WHERE h.work_type = 'RF' AND {OVER_YEAR}"))
def q_hours_work_type(spark, base):
    return R.work_type_hours(star(spark, base), "RF", YLO, YHI)


@register("q_compare_depts", with_star(f"""
SELECT d.department, coalesce(sum(h.hours), 0) AS total_hours
FROM (VALUES ('NATION_3'), ('NATION_7'), ('NOWHERE')) d(department)
LEFT JOIN employee e ON e.department = d.department
LEFT JOIN work_hour h ON h.employee_id = e.uuid AND {OVER} GROUP BY d.department"""))
def q_compare_depts(spark, base):
    return R.compare_departments(star(spark, base), [DEPT, DEPT2, "NOWHERE"], LO, HI)


@register("q_emp_work_type", with_star(
    f"SELECT sum(h.hours) AS total_hours FROM {HE} WHERE {EMP_SQL} AND h.work_type = 'RF' AND {OVER_YEAR}"))
def q_emp_work_type(spark, base):
    return R.employee_work_type_hours(star(spark, base), EMP, "RF", YLO, YHI)


@register("q_top_emp_in_dept", with_star(f"""
SELECT name, total_hours FROM (
  SELECT e.uuid, e.name, sum(h.hours) AS total_hours FROM {HE}
  WHERE e.department = 'NATION_3' AND {OVER} GROUP BY e.uuid, e.name)
ORDER BY total_hours DESC, uuid LIMIT 1"""))
def q_top_emp_in_dept(spark, base):
    return R.top_employees_in_department(star(spark, base), DEPT, LO, HI)


@register("q_work_types_of_dept", with_star(
    f"SELECT DISTINCT h.work_type FROM {HE} WHERE e.department = 'NATION_3' AND {OVER}"))
def q_work_types_of_dept(spark, base):
    return R.work_types_of_department(star(spark, base), DEPT, LO, HI)


@register("q_projects_of_dept", with_star(
    f"SELECT DISTINCT p.project_reference_id, p.name FROM {HEP} WHERE e.department = 'NATION_3' AND {OVER}"))
def q_projects_of_dept(spark, base):
    return R.projects_of_department(star(spark, base), DEPT, LO, HI)


@register("q_dept_project_share", with_star(f"""
SELECT round(100 * sum(CASE WHEN {PROJ_SQL} THEN h.hours ELSE 0 END) / sum(h.hours), 6) AS share_pct
FROM {HE} LEFT JOIN project p ON p.uuid = h.project_id WHERE e.department = 'NATION_3' AND {OVER}"""))
def q_dept_project_share(spark, base):
    return R.department_project_share(star(spark, base), DEPT, PROJ, LO, HI)


PERIODS = [("Q1 1997", LO, HI), ("Q2 1998", LO2, HI2)]
PERIODS_SQL = with_star(f"""
SELECT 'Q1 1997' AS period, coalesce(sum(h.hours), 0) AS total_hours FROM {HE} WHERE e.department = 'NATION_3' AND {OVER}
UNION
SELECT 'Q2 1998' AS period, coalesce(sum(h.hours), 0) AS total_hours FROM {HE} WHERE e.department = 'NATION_3' AND {OVER2}""")


@register("q_compare_periods", PERIODS_SQL)
def q_compare_periods(spark, base):
    return R.department_in_periods(star(spark, base), DEPT, PERIODS)


@register("union_periods", PERIODS_SQL)
def union_periods(spark, base):
    """The same report written as a distinct union of labelled aggregates."""
    s = star(spark, base)
    parts = [
        R.department_hours(s, DEPT, lo, hi).select(
            F.lit(label).alias("period"), F.coalesce("total_hours", F.lit(0.0)).alias("total_hours"))
        for label, lo, hi in PERIODS
    ]
    return parts[0].union(parts[1]).distinct()


@register("q_flat_total", with_rollup("""
SELECT sum(hours) AS total_hours FROM work_hours
WHERE employee = 'Supplier#000000001' AND project = 'small ring' AND period = 'Q1 1997'"""))
def q_flat_total(spark, base):
    return R.flat_total(stored_rollup(spark, base), EMP, "small ring", "Q1 1997")


@register("q_flat_projects", with_rollup(
    "SELECT DISTINCT project FROM work_hours WHERE employee = 'Supplier#000000001' AND period = 'Q1 1997'"))
def q_flat_projects(spark, base):
    return R.flat_projects(stored_rollup(spark, base), EMP, "Q1 1997")


@register("q_emp_proj_breakdown", with_star(f"""
SELECT e.name AS employee, p.name AS project, sum(h.hours) AS total_hours FROM {HEP}
WHERE {INSIDE} GROUP BY e.name, p.name"""))
def q_emp_proj_breakdown(spark, base):
    return R.employee_project_breakdown(star(spark, base), LO, HI)


# --- sorts ------------------------------------------------------------------------------


@register("top_n", with_star(f"""
SELECT employee_id, sum(hours) AS total_hours FROM work_hour h WHERE {OVER_YEAR}
GROUP BY employee_id ORDER BY total_hours DESC, employee_id LIMIT 5"""))
def top_n(spark, base):
    return (
        star(spark, base).work_hour.where(overlaps(YLO, YHI)).groupBy("employee_id").agg(R.total())
        .orderBy(F.desc("total_hours"), "employee_id").limit(5)
    )


@register("order_desc", with_star(f"""
SELECT employee_id, sum(hours) AS total_hours FROM work_hour h WHERE {OVER_YEAR}
GROUP BY employee_id ORDER BY total_hours DESC, employee_id"""))
def order_desc(spark, base):
    return (
        star(spark, base).work_hour.where(overlaps(YLO, YHI)).groupBy("employee_id").agg(R.total())
        .orderBy(F.desc("total_hours"), "employee_id")
    )
