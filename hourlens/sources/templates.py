"""Template tables: the built-in libraries, JSON input and Parquet output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourlens.functions import sqltext
from hourlens.functions.similarity import intent
from hourlens.schemas import TEMPLATES

_JOIN = {
    "e": " JOIN employee e ON e.uuid = h.employee_id",
    "p": " JOIN project p ON p.uuid = h.project_id",
    "lp": " LEFT JOIN project p ON p.uuid = h.project_id",
}
_OVERLAP = "h.start_date <= '{time_period_0}-end' AND h.end_date >= '{time_period_0}-start'"
_INSIDE = "h.start_date >= '{time_period_0}_start' AND h.end_date <= '{time_period_0}_end'"


def _employee(n: int = 0) -> str:
    return f"(e.name LIKE '%{{employee_{n}}}%' OR e.alias LIKE '%{{employee_{n}}}%')"


def _project(n: int = 0) -> str:
    return f"(p.project_reference_id LIKE '%{{project_{n}}}%' OR p.name LIKE '%{{project_{n}}}%')"


def _sql(columns: str, joins: tuple[str, ...], conditions: tuple[str, ...], tail: str = "") -> str:
    joined = "".join(_JOIN[j] for j in joins)
    return f"SELECT {columns} FROM work_hour h{joined} WHERE {' AND '.join(conditions)}{tail}"


_SUM = "SUM(h.hours) AS total_hours"
_PROJECT_KEYS = "p.project_reference_id, p.name"
_BY_PROJECT = " GROUP BY p.uuid, p.project_reference_id, p.name"
_TOP = " ORDER BY total_hours DESC LIMIT 5"

# The questions of the general and of the special library, with their SQL.
GENERAL = (
    ("How many hours did {employee_0} work on the {project_0} project in {time_period_0}?",
     _sql(_SUM, ("e", "p"), (_employee(), _project(), _OVERLAP))),
    ("What projects did {employee_0} work on in {time_period_0}?",
     _sql(f"DISTINCT {_PROJECT_KEYS}", ("e", "lp"), (_employee(), _OVERLAP))),
    ("Who worked on the {project_0} project in {time_period_0}?",
     _sql("DISTINCT e.name", ("e", "p"), (_project(), _OVERLAP))),
    ("How many hours did {employee_0} work in {time_period_0}?",
     _sql(_SUM, ("e",), (_employee(), _OVERLAP))),
    ("How many hours were spent on the {project_0} project in {time_period_0}?",
     _sql(_SUM, ("p",), (_project(), _OVERLAP))),
    ("Compare the hours worked by {employee_0} and {employee_1} in {time_period_0}",
     _sql(f"e.name, {_SUM}", ("e",), (f"({_employee(0)} OR {_employee(1)})", _OVERLAP), " GROUP BY e.uuid, e.name")),
    ("Compare the hours spent on {project_0} and {project_1} in {time_period_0}",
     _sql(f"{_PROJECT_KEYS}, {_SUM}", ("p",), (f"({_project(0)} OR {_project(1)})", _OVERLAP), _BY_PROJECT)),
    ("Which projects had the most hours in {time_period_0}?",
     _sql(f"{_PROJECT_KEYS}, {_SUM}", ("lp",), (_OVERLAP,), _BY_PROJECT + _TOP)),
    ("Which employees worked the most hours in {time_period_0}?",
     _sql(f"e.name, {_SUM}", ("e",), (_OVERLAP,), " GROUP BY e.uuid, e.name" + _TOP)),
    ("List all hours for {employee_0} by project in {time_period_0}",
     _sql(f"{_PROJECT_KEYS}, SUM(h.hours) AS hours", ("e", "lp"), (_employee(), _OVERLAP),
          _BY_PROJECT + " ORDER BY hours DESC")),
)
SPECIAL = (
    ("How many hours did {employee_0} work on {project_0} in {time_period_0}?",
     _sql(_SUM, ("e", "p"), ("e.name = '{employee_0}'", "p.name LIKE '%{project_0}%'", _INSIDE))),
    ("How many hours did employees in {department_0} work in {time_period_0}?",
     _sql(f"e.name, {_SUM}", ("e",), ("e.department = '{department_0}'", _INSIDE),
          " GROUP BY e.name ORDER BY total_hours DESC")),
)


def complete_templates(raw: DataFrame) -> DataFrame:
    """Fill the typed columns of (template_id, template_query, sql_template, source, ...) rows.

    Slots, intent and tables come from the texts; statistics keep their given
    value or start at 0 uses and success rate 1.
    """
    given = set(raw.columns)

    def column(name: str, default):
        return F.coalesce(F.col(name), default) if name in given else default

    return raw.select(
        F.col("template_id").cast("bigint").alias("template_id"), "template_query", "sql_template",
        sqltext.slots(F.col("template_query")).alias("slots"),
        column("source", F.lit("external")).alias("source"),
        intent(F.col("template_query")).alias("intent"),
        sqltext.tables_used(F.col("sql_template")).alias("tables_used"),
        column("usage_count", F.lit(0)).cast("bigint").alias("usage_count"),
        column("success_rate", F.lit(1.0)).cast("double").alias("success_rate"),
        column("last_used", F.lit(None)).cast("timestamp_ntz").alias("last_used"),
        column("created_at", F.lit(None)).cast("timestamp_ntz").alias("created_at"),
        column("needs_review", F.lit(False)).cast("boolean").alias("needs_review"),
    )


def merge_libraries(*libraries: DataFrame) -> DataFrame:
    merged = libraries[0]
    for library in libraries[1:]:
        merged = merged.unionByName(library)
    return merged


def library(spark: SparkSession, special: bool = True) -> DataFrame:
    """The built-in templates, ids from 1."""
    def part(rows, first: int, source: str) -> DataFrame:
        data = [(first + i, q, s, source) for i, (q, s) in enumerate(rows)]
        return spark.createDataFrame(
            data, "template_id BIGINT, template_query STRING, sql_template STRING, source STRING")

    general = part(GENERAL, 1, "predefined")
    if not special:
        return complete_templates(general)
    return complete_templates(merge_libraries(general, part(SPECIAL, 1 + len(GENERAL), "special")))


_ONE = (
    "template_query STRING, sql_template STRING, usage_count BIGINT, success_rate DOUBLE, "
    "metadata MAP<STRING, STRING>"
)


def load_templates(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Templates from JSON: ``{"templates": [...]}`` or a bare list. Ids are hashes of the texts.

    With ``lines`` every line of a file is one template, and Spark splits large files.
    """
    one = T.StructType.fromDDL(_ONE)
    both = T.StructType([T.StructField("templates", T.ArrayType(one)), *one.fields])
    raw = spark.read.schema(both).option("multiLine", not lines).json(path)
    single = F.struct("template_query", "sql_template", "usage_count", "success_rate", "metadata")
    rows = raw.select(F.inline(F.coalesce("templates", F.array(single)))).where("template_query IS NOT NULL")
    ids = F.xxhash64("template_query", "sql_template")
    return complete_templates(rows.select(
        ids.alias("template_id"), "template_query", "sql_template", "usage_count", "success_rate",
        F.try_element_at("metadata", F.lit("source")).alias("source")))


def save_templates(templates: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The whole table as Parquet, or as JSON what :func:`load_templates` reads from lines."""
    if fmt == "parquet":
        templates.write.mode("overwrite").parquet(path)
    elif fmt == "json":
        templates.select("template_query", "sql_template", "usage_count", "success_rate",
                         F.create_map(F.lit("source"), "source").alias("metadata")).write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TEMPLATES).parquet(path)
