"""Whole-question reports over the work-hour star.

Two plan shapes are used. Lookups of one person, project or department filter
the dimension and let Spark pick the join from its size statistics (a small
side is broadcast, a large one is shuffled with a runtime bloom filter on the
fact and adaptive skew splitting). Reports over every person or project sum
the fact on its own key first, so a key that holds a third of the rows is
reduced map-side and the join sees one row per key.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourlens.operators.predicates import (
    contained,
    employee_contains,
    overlaps,
    project_contains,
)
from hourlens.sources.star import Star

def total() -> Column:
    return F.sum("hours").alias("total_hours")


def _of_employees(star: Star, fact: DataFrame, where: Column) -> DataFrame:
    """Fact rows of the employees that satisfy ``where``, with their attributes."""
    people = star.employee.where(where).select(
        F.col("uuid").alias("employee_id"), F.col("name").alias("employee_name"), "department"
    )
    return fact.join(people, "employee_id")


def _of_projects(star: Star, fact: DataFrame, where: Column) -> DataFrame:
    """Fact rows of the projects that satisfy ``where``, with their attributes."""
    projects = star.project.where(where).select(
        F.col("uuid").alias("project_id"), "project_reference_id",
        F.col("name").alias("project_name"),
    )
    return fact.join(projects, "project_id")


def _with_project(star: Star, fact: DataFrame) -> DataFrame:
    """Left join: rows without a known project stay, under NULL."""
    projects = star.project.select(
        F.col("uuid").alias("project_id"), F.col("uuid").alias("project_uuid"),
        "project_reference_id", F.col("name").alias("project_name"),
    )
    return fact.join(projects, "project_id", "left")


def _hours_per(fact: DataFrame, *keys: str) -> DataFrame:
    return fact.groupBy(*keys).agg(F.sum("hours").alias("hours"))


def employee_project_hours(star: Star, employee: str, project: str, lo: dt.date, hi: dt.date) -> DataFrame:
    """Hours of an employee on a project in a period (NULL when nothing matches)."""
    fact = star.work_hour.where(overlaps(lo, hi))
    fact = _of_employees(star, fact, employee_contains(employee))
    return _of_projects(star, fact, project_contains(project)).agg(total())


def projects_of_employee(star: Star, employee: str, lo: dt.date, hi: dt.date) -> DataFrame:
    fact = star.work_hour.where(overlaps(lo, hi))
    ids = _of_employees(star, fact, employee_contains(employee)).select("project_id").distinct()
    return _with_project(star, ids).select(
        "project_reference_id", F.col("project_name").alias("name")
    ).distinct()


def people_on_project(star: Star, project: str, lo: dt.date, hi: dt.date) -> DataFrame:
    fact = star.work_hour.where(overlaps(lo, hi))
    ids = _of_projects(star, fact, project_contains(project)).select("employee_id").distinct()
    return _of_employees(star, ids, F.lit(True)).select(
        F.col("employee_name").alias("name")
    ).distinct()


def employee_hours(star: Star, employee: str, lo: dt.date, hi: dt.date) -> DataFrame:
    fact = star.work_hour.where(overlaps(lo, hi))
    return _of_employees(star, fact, employee_contains(employee)).agg(total())


def project_hours(star: Star, project: str, lo: dt.date, hi: dt.date) -> DataFrame:
    fact = star.work_hour.where(overlaps(lo, hi))
    return _of_projects(star, fact, project_contains(project)).agg(total())


def compare_employees(star: Star, first: str, second: str, lo: dt.date, hi: dt.date) -> DataFrame:
    """Hours of each employee that matches either text; equal names stay apart by key."""
    fact = _hours_per(star.work_hour.where(overlaps(lo, hi)), "employee_id")
    either = employee_contains(first) | employee_contains(second)
    return _of_employees(star, fact, either).select(
        F.col("employee_name").alias("name"), F.col("hours").alias("total_hours")
    )


def compare_projects(star: Star, first: str, second: str, lo: dt.date, hi: dt.date) -> DataFrame:
    fact = _hours_per(star.work_hour.where(overlaps(lo, hi)), "project_id")
    either = project_contains(first) | project_contains(second)
    return _of_projects(star, fact, either).select(
        "project_reference_id", F.col("project_name").alias("name"),
        F.col("hours").alias("total_hours"),
    )


def top_projects(star: Star, lo: dt.date, hi: dt.date, n: int = 5) -> DataFrame:
    """The n projects with most hours; hours without a project count under NULL."""
    fact = _hours_per(star.work_hour.where(overlaps(lo, hi)), "project_id")
    return (
        _with_project(star, fact)
        .groupBy("project_uuid", "project_reference_id", F.col("project_name").alias("name"))
        .agg(total())
        .orderBy(F.desc("total_hours"), F.asc_nulls_last("project_uuid"))
        .limit(n)
        .select("project_reference_id", "name", "total_hours")
    )


def top_employees(star: Star, lo: dt.date, hi: dt.date, n: int = 5) -> DataFrame:
    fact = _hours_per(star.work_hour.where(overlaps(lo, hi)), "employee_id")
    return (
        _of_employees(star, fact, F.lit(True))
        .orderBy(F.desc("hours"), "employee_id")
        .limit(n)
        .select(F.col("employee_name").alias("name"), F.col("hours").alias("total_hours"))
    )


def employee_hours_by_project(star: Star, employee: str, lo: dt.date, hi: dt.date) -> DataFrame:
    fact = star.work_hour.where(overlaps(lo, hi))
    mine = _hours_per(_of_employees(star, fact, employee_contains(employee)), "project_id")
    return (
        _with_project(star, mine)
        .groupBy("project_uuid", "project_reference_id", F.col("project_name").alias("name"))
        .agg(F.sum("hours").alias("hours"))
        .orderBy(F.desc("hours"), F.asc_nulls_last("project_uuid"))
        .select("project_reference_id", "name", "hours")
    )


def employee_project_hours_exact(star: Star, employee: str, project: str, lo: dt.date, hi: dt.date) -> DataFrame:
    """Exact employee name, project name contains the text, rows inside the period."""
    fact = star.work_hour.where(contained(lo, hi))
    fact = _of_employees(star, fact, F.col("name") == employee)
    matching = F.contains(F.lower("name"), F.lower(F.lit(project)))
    return _of_projects(star, fact, matching).agg(total())


def department_hours_by_employee(star: Star, department: str, lo: dt.date, hi: dt.date) -> DataFrame:
    """Hours per employee name of a department, most first; equal names are one row."""
    fact = _hours_per(star.work_hour.where(contained(lo, hi)), "employee_id")
    return (
        _of_employees(star, fact, F.col("department") == department)
        .groupBy(F.col("employee_name").alias("name"))
        .agg(total())
        .orderBy(F.desc("total_hours"), "name")
    )


def department_hours(star: Star, department: str, lo: dt.date, hi: dt.date) -> DataFrame:
    fact = star.work_hour.where(overlaps(lo, hi))
    return _of_employees(star, fact, F.col("department") == department).agg(total())


def work_type_hours(star: Star, work_type: str, lo: dt.date, hi: dt.date) -> DataFrame:
    return star.work_hour.where(overlaps(lo, hi) & (F.col("work_type") == work_type)).agg(total())


def compare_departments(star: Star, departments: Sequence[str], lo: dt.date, hi: dt.date) -> DataFrame:
    """One row per listed department; 0 when it has no hours."""
    fact = _hours_per(star.work_hour.where(overlaps(lo, hi)), "employee_id")
    spark = star.employee.sparkSession
    names = F.array(*(F.lit(d) for d in dict.fromkeys(departments)))
    listed = spark.range(1).select(F.explode(names).alias("department"))
    sums = (
        _of_employees(star, fact, F.col("department").isin(*departments))
        .groupBy("department").agg(F.sum("hours").alias("hours"))
    )
    return listed.join(sums, "department", "left").select(
        "department", F.coalesce("hours", F.lit(0.0)).alias("total_hours")
    )


def employee_work_type_hours(star: Star, employee: str, work_type: str, lo: dt.date, hi: dt.date) -> DataFrame:
    fact = star.work_hour.where(overlaps(lo, hi) & (F.col("work_type") == work_type))
    return _of_employees(star, fact, employee_contains(employee)).agg(total())


def top_employees_in_department(star: Star, department: str, lo: dt.date, hi: dt.date, n: int = 1) -> DataFrame:
    fact = _hours_per(star.work_hour.where(overlaps(lo, hi)), "employee_id")
    return (
        _of_employees(star, fact, F.col("department") == department)
        .orderBy(F.desc("hours"), "employee_id")
        .limit(n)
        .select(F.col("employee_name").alias("name"), F.col("hours").alias("total_hours"))
    )


def work_types_of_department(star: Star, department: str, lo: dt.date, hi: dt.date) -> DataFrame:
    fact = star.work_hour.where(overlaps(lo, hi))
    return _of_employees(star, fact, F.col("department") == department).select("work_type").distinct()


def projects_of_department(star: Star, department: str, lo: dt.date, hi: dt.date) -> DataFrame:
    fact = star.work_hour.where(overlaps(lo, hi))
    ids = _of_employees(star, fact, F.col("department") == department).select("project_id").distinct()
    return _of_projects(star, ids, F.lit(True)).select(
        "project_reference_id", F.col("project_name").alias("name")
    ).distinct()


def department_project_share(star: Star, department: str, project: str, lo: dt.date, hi: dt.date) -> DataFrame:
    """Percentage of a department's hours spent on matching projects; NULL without hours."""
    fact = star.work_hour.where(overlaps(lo, hi))
    mine = _hours_per(_of_employees(star, fact, F.col("department") == department), "project_id")
    hit = project_contains(project)
    tagged = mine.join(
        star.project.select(F.col("uuid").alias("project_id"), hit.alias("hit")), "project_id", "left"
    )
    on_project = F.sum(F.when(F.col("hit"), F.col("hours")).otherwise(0.0))
    return tagged.agg(
        F.round(100 * on_project / F.nullif(F.sum("hours"), F.lit(0.0)), 6).alias("share_pct")
    )


def department_in_periods(star: Star, department: str, periods: Sequence[tuple[str, dt.date, dt.date]]) -> DataFrame:
    """One labelled sum per period, 0 when empty, equal rows merged.

    All periods are answered in one scan: a conditional sum per period over
    the rows of the covering range, then one row per label.
    """
    cover = overlaps(min(p[1] for p in periods), max(p[2] for p in periods))
    fact = _of_employees(star, star.work_hour.where(cover), F.col("department") == department)
    sums = fact.agg(*(
        F.coalesce(F.sum(F.when(overlaps(lo, hi), F.col("hours"))), F.lit(0.0)).alias(f"p{i}")
        for i, (_, lo, hi) in enumerate(periods)
    ))
    rows = F.array(*(
        F.struct(F.lit(label).alias("period"), F.col(f"p{i}").alias("total_hours"))
        for i, (label, _, _) in enumerate(periods)
    ))
    return sums.select(F.inline(rows)).distinct()


def employee_project_breakdown(star: Star, lo: dt.date, hi: dt.date) -> DataFrame:
    """Hours per (employee name, project name) of rows inside the period."""
    fact = star.work_hour.where(contained(lo, hi)).select("employee_id", "project_id", "hours")
    fact = _of_projects(star, _of_employees(star, fact, F.lit(True)), F.lit(True))
    return fact.groupBy(
        F.col("employee_name").alias("employee"), F.col("project_name").alias("project")
    ).agg(total())


def flat_total(rollup: DataFrame, employee: str, project: str, period: str) -> DataFrame:
    """Hours on the flat table for an exact employee, project and period label."""
    return rollup.where(
        (F.col("employee") == employee) & (F.col("project") == project) & (F.col("period") == period)
    ).agg(total())


def flat_projects(rollup: DataFrame, employee: str, period: str) -> DataFrame:
    return rollup.where(
        (F.col("employee") == employee) & (F.col("period") == period)
    ).select("project").distinct()


def flat_answers(rollup: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (question_id, employee, project, period) with the hours of each on the flat table, null without any.

    Equal questions meet the flat table once. Where the asked periods are known
    to be few, Spark reads only their folders of the stored table.
    """
    keys = ["employee", "project", "period"]
    totals = rollup.join(asked.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.sum("hours").alias("total_hours"))
    return asked.join(totals, keys, "left").select("question_id", *keys, "total_hours")
