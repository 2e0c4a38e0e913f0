"""The work-hour star: employee, project and work_hour tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Star(NamedTuple):
    """One fact table and its two dimensions."""

    employee: DataFrame
    project: DataFrame
    work_hour: DataFrame


def read_star(spark: SparkSession, base: str, fmt: str = "parquet", **options: str) -> Star:
    """Read a star stored as ``base/employee``, ``base/project``, ``base/work_hour``."""
    reader = spark.read.format(fmt).options(**options)
    return Star(*(reader.load(f"{base}/{name}") for name in Star._fields))


def read_star_jdbc(spark: SparkSession, url: str, partitions: int = 32, **options: str) -> Star:
    """Read a star from a database.

    The fact is read in ``partitions`` slices of ``employee_id``; the slice
    bounds come from one min/max query that runs inside the database.
    """
    def load(**own: object) -> DataFrame:
        # Options stay on a reader, so every table gets its own.
        return spark.read.format("jdbc").options(url=url, **options).options(**own).load()

    span = load(query="SELECT MIN(employee_id) AS lo, MAX(employee_id) AS hi FROM work_hour").first()
    fact = load(dbtable="work_hour", partitionColumn="employee_id", numPartitions=partitions,
                lowerBound=span.lo or 0, upperBound=(span.hi or 0) + 1)
    return Star(load(dbtable="employee"), load(dbtable="project"), fact)


def write_star(star: Star, base: str) -> None:
    """Store a star; the fact is clustered by start date so period filters skip files."""
    star.employee.write.mode("overwrite").parquet(f"{base}/employee")
    star.project.write.mode("overwrite").parquet(f"{base}/project")
    (
        star.work_hour.repartitionByRange("start_date", "employee_id")
        .sortWithinPartitions("start_date")
        .write.mode("overwrite")
        .parquet(f"{base}/work_hour")
    )


def register_views(star: Star) -> None:
    """Expose the star to ``spark.sql`` under the names used in SQL templates."""
    for name, frame in star._asdict().items():
        frame.createOrReplaceTempView(name)


def quarterly_rollup(star: Star) -> DataFrame:
    """Flat table: hours per person, project, department, work type and quarter label.

    Names are joined to the fact before the one sum: the keys of the flat table
    are almost those of the fact, so a sum in front would move the fact twice
    and save next to nothing. Spark broadcasts dimensions it knows to be small
    and splits a skewed key of one that is not.
    """
    quarter = F.concat(
        F.lit("Q"), F.quarter("start_date").cast("string"),
        F.lit(" "), F.year("start_date").cast("string"),
    )
    people = star.employee.select(F.col("uuid").alias("employee_id"), F.col("name").alias("employee"), "department")
    projects = star.project.select(F.col("uuid").alias("project_id"), F.col("name").alias("project"))
    return (
        star.work_hour.select("employee_id", "project_id", "work_type", quarter.alias("period"), "hours")
        .join(people, "employee_id").join(projects, "project_id")
        .groupBy("employee", "project", "department", "work_type", "period")
        .agg(F.sum("hours").alias("hours"))
    )


ROLLUP = "employee STRING, project STRING, department STRING, work_type STRING, hours DOUBLE, period STRING"


def write_rollup(rollup: DataFrame, path: str) -> None:
    """Store the flat table partitioned by period, so a period filter reads one folder."""
    (
        rollup.repartition("period", F.pmod(F.hash("employee", "project"), F.lit(16)))
        .write.mode("overwrite").partitionBy("period").parquet(path)
    )


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """The stored flat table. A filter or a join on period reads the folders of these periods only."""
    return spark.read.schema(ROLLUP).parquet(path)
