"""Round trips through files, a Chinese log, and the streaming jobs over logs stored as files.

Files are written to the session's shared folder, a new place for each call.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hourlens import schemas
from hourlens.functions import extract as X
from hourlens.operators import chartdata as D
from hourlens.operators import names as N
from hourlens.operators.partitioning import checkpoint_folder
from hourlens.plans import extraction as E
from hourlens.plans import reports as R
from hourlens.sources import dictionaries, templates
from hourlens.sources.tpch import aliases, dictionary, feedback, question_parts, questions, star, table, used_templates
from hourlens.streaming import jobs as streams
from hourlens.workload import cores, register
from hourlens.workload.jobs import LEARNED_SQL, _generated
from hourlens.workload.learning import with_feedback
from hourlens.workload.names import DICTIONARY_SQL, MENTIONS_SQL, SKELETONS_SQL, with_aliases
from hourlens.workload.reports import HE, with_star
from hourlens.workload.templates import TEMPLATES_SQL
from hourlens.workload.texts import PARTS_SQL


def _place(spark, name: str) -> str:
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("load_dictionary", f"WITH {DICTIONARY_SQL.strip()} SELECT entity_type, trim(entity) AS entity FROM dictionary")
def load_dictionary(spark, base):
    """Every name of the dictionary through JSON lines, some hundred names a line."""
    path = _place(spark, "dictionary")
    known = dictionary(spark, base)
    known.groupBy("entity_type", F.pmod(F.xxhash64("entity"), F.lit(64)).alias("part")).agg(
        F.collect_list("entity").alias("names")).select(
        F.to_json(F.create_map("entity_type", "names")).alias("value")).write.text(path)
    return dictionaries.load_dictionary(spark, path, lines=True)


@register("load_aliases", with_aliases("SELECT entity_type, canonical, alias, alias_seq FROM aliases"))
def load_aliases(spark, base):
    """Aliases through one nested JSON file per type."""
    path = _place(spark, "aliases")
    nested = dictionaries.nested_aliases(aliases(spark, base))
    nested.select("entity_type", F.concat(
        F.lit('{"'), F.col("entity_type"), F.lit('":'), F.col("aliases"), F.lit("}")).alias("value")).repartition(
        "entity_type").write.partitionBy("entity_type").text(path)
    loaded = [dictionaries.load_aliases(spark, f"{path}/entity_type={kind}") for kind in ("employee", "project", "department")]
    return loaded[0].unionByName(loaded[1]).unionByName(loaded[2]).select("entity_type", "canonical", "alias", "alias_seq")


@register("load_templates", f"""
WITH {TEMPLATES_SQL.strip()} SELECT template_query, sql_template, usage_count, success_rate,
  CASE WHEN template_id <= 10 THEN 'predefined' ELSE 'special' END AS source FROM templates""")
def load_templates(spark, base):
    """The used templates through JSON lines."""
    path = _place(spark, "templates")
    used_templates(spark, base).select(
        "template_query", "sql_template", "usage_count", "success_rate",
        F.create_map(F.lit("source"), "source").alias("metadata")).write.json(path)
    return templates.load_templates(spark, path, lines=True).select(
        "template_query", "sql_template", "usage_count", "success_rate", "source")


@register("save_aliases", with_aliases("SELECT entity_type, canonical, canonical_seq, alias, alias_seq FROM aliases"))
def save_aliases(spark, base):
    """Aliases through JSON lines, one canonical name a line."""
    path = _place(spark, "alias-lines")
    dictionaries.save_aliases(aliases(spark, base), path, "json")
    return dictionaries.load_aliases(spark, path, lines=True)


@register("save_templates", f"""
WITH {TEMPLATES_SQL.strip()} SELECT template_query, sql_template, usage_count, success_rate,
  CASE WHEN template_id <= 10 THEN 'predefined' ELSE 'special' END AS source FROM templates""")
def save_templates(spark, base):
    """The used templates saved as JSON and loaded again."""
    path = _place(spark, "saved-templates")
    templates.save_templates(used_templates(spark, base), path, "json")
    return templates.load_templates(spark, path, lines=True).select(
        "template_query", "sql_template", "usage_count", "success_rate", "source")


@register("export_csv", with_star(f"SELECT e.name, sum(h.hours) AS hours FROM {HE} GROUP BY e.name"))
def export_csv(spark, base):
    """Hours of every employee through a CSV file with a header."""
    path, s = _place(spark, "csv"), star(spark, base)
    totals = s.employee.join(R._hours_per(s.work_hour, "employee_id"), F.col("uuid") == F.col("employee_id")).groupBy(
        "name").agg(F.sum("hours").alias("hours"))
    D.export_csv(totals, path)
    return spark.read.option("header", True).schema("name STRING, hours DOUBLE").csv(path)


@register("chart_columns", with_star(f"""
SELECT department, unnest(['AF', 'AO', 'NF', 'NO', 'RF', 'RO']) AS series,
       unnest([sum(hours) FILTER (work_type = 'AF'), sum(hours) FILTER (work_type = 'AO'), sum(hours) FILTER (work_type = 'NF'),
               sum(hours) FILTER (work_type = 'NO'), sum(hours) FILTER (work_type = 'RF'), sum(hours) FILTER (work_type = 'RO')]) AS value
FROM {HE} GROUP BY department"""))
def chart_columns(spark, base):
    """All value columns of a stacked bar of departments by work type, as series."""
    s = star(spark, base)
    fact = R._hours_per(s.work_hour, "employee_id", "work_type")
    cells = R._of_employees(s, fact, F.lit(True)).groupBy("department", "work_type").agg(F.sum("hours").alias("hours"))
    return D.long_series(D.pivot(cells), "stacked_bar")


# --- a Chinese log, one text per order ------------------------------------------------------

_DIGITS = "零一二三四五六七八九"
_CHINESE_SQL = f"""chinese AS (
  SELECT question_id, translate(CAST(session_id % 50 AS VARCHAR), '0123456789', '{_DIGITS}') AS who, CASE question_id % 5
    WHEN 0 THEN strftime(day, '%Y') || '年第' || ('一二三四')[quarter(day)] || '季度，' || who || '经理的施工工作' WHEN 1 THEN '上个月' || who || '中心 Q' || quarter(day) || ' 2025年'
    WHEN 2 THEN who || who || ' Manager ' || strftime(day, '%B') || ' ' || year(day) || '年' WHEN 3 THEN year(day) || '年' || month(day) || '月 ' || who || '大厦'
    ELSE year(day) || '年Q' || quarter(day) || ' hours of ' || who || '项目' END AS text FROM parts)"""


def _chinese(spark, base):
    day, number = F.col("day"), F.col("question_id")
    who = F.translate(F.pmod("session_id", F.lit(50)).cast("string"), "0123456789", _DIGITS)
    year, quarter = F.year(day).cast("string"), F.quarter(day)
    texts = [
        F.concat(year, F.lit("年第"), F.substring(F.lit("一二三四"), quarter, F.lit(1)), F.lit("季度，"), who, F.lit("经理的施工工作")),
        F.concat(F.lit("上个月"), who, F.lit("中心 Q"), quarter.cast("string"), F.lit(" 2025年")),
        F.concat(who, who, F.lit(" Manager "), F.date_format(day, "MMMM"), F.lit(" "), year, F.lit("年")),
        F.concat(year, F.lit("年"), F.month(day).cast("string"), F.lit("月 "), who, F.lit("大厦")),
        F.concat(year, F.lit("年Q"), quarter.cast("string"), F.lit(" hours of "), who, F.lit("项目")),
    ]
    text = F.element_at(F.array(*texts), (F.pmod(number, F.lit(5)) + 1).cast("int"))
    return question_parts(spark, base).select("question_id", who.alias("who"), text.alias("text"))


def _patterns_sql(*kinds: str) -> str:
    patterns = {k: p for k, p in X.CHINESE_GRAMMAR if k in kinds}
    found = " UNION ALL ".join(
        f"SELECT question_id, '{kind}' AS entity_type, unnest(regexp_extract_all(text, '{pattern}')) AS value FROM chinese"
        for kind, pattern in patterns.items())
    return f"SELECT DISTINCT * FROM ({found}) WHERE length(trim(value)) >= 2"


def _by_type(*kinds: str) -> str:
    return f"WITH {PARTS_SQL}, {_CHINESE_SQL} {_patterns_sql(*kinds)}"


def _mentions(spark, base, *kinds: str):
    found = F.explode(X.chinese_mentions(F.col("text"))).alias("m")
    return _chinese(spark, base).select("question_id", found).select(
        "question_id", F.col("m.type").alias("entity_type"), "m.value").where(F.col("entity_type").isin(*kinds)).distinct()


@register("ext_chinese", _by_type("department", "work_type", "project"))
def ext_chinese(spark, base):
    return _mentions(spark, base, "department", "work_type", "project")


@register("ext_mixed", _by_type("time_period", "employee"))
def ext_mixed(spark, base):
    """Periods and people, with Latin months, quarters and titles among the characters."""
    return _mentions(spark, base, "time_period", "employee")


@register("merge_mentions", f"""
WITH {PARTS_SQL}, {MENTIONS_SQL}, {_CHINESE_SQL}
SELECT 'en' AS log, question_id, entity_type, value FROM (SELECT DISTINCT question_id, entity_type, value FROM mentions)
UNION ALL SELECT 'zh', question_id, entity_type, value FROM (
  {_patterns_sql("time_period", "department", "employee", "work_type", "project")}
  UNION SELECT question_id, 'time_period', 'Q' || quarter(day) FROM parts WHERE question_id % 5 = 1)""")
def merge_mentions(spark, base):
    """All mentions of a question as one set: the English log, and a Chinese one with mixed mentions.

    Beside characters only a quarter between spaces is a mention of the Latin patterns.
    """
    known, spelled = dictionary(spark, base), aliases(spark, base)
    chinese = _chinese(spark, base).join(questions(spark, base).select("question_id", "ts"), "question_id")
    logs = {"en": questions(spark, base), "zh": chinese}
    en, zh = (E.merge_mentions(log, known, spelled, partitions=cores(spark)).select(F.lit(name).alias("log"), "*")
              for name, log in logs.items())
    return en.union(zh)


@register("dictionary_match_partial", f"""
WITH {PARTS_SQL}, {_CHINESE_SQL},
known AS (SELECT 'project' AS entity_type, translate(CAST(n_nationkey AS VARCHAR), '0123456789', '{_DIGITS}') || '项目' AS entity FROM nation
          UNION SELECT 'department', translate(CAST(r_regionkey AS VARCHAR), '0123456789', '{_DIGITS}') || '中心' FROM region),
runs AS (SELECT question_id, unnest(regexp_extract_all(text, '[{X.CJK}]{{2,}}')) AS run FROM chinese)
SELECT DISTINCT question_id, entity_type, entity FROM runs JOIN known ON contains(run, entity) OR contains(entity, run)""")
def dictionary_match_partial(spark, base):
    def named(name: str, key: str, kind: str, end: str):
        digits = F.translate(F.col(key).cast("string"), "0123456789", _DIGITS)
        return table(spark, base, name).select(F.lit(kind).alias("entity_type"), F.concat(digits, F.lit(end)).alias("name"))

    known = named("nation", "n_nationkey", "project", "项目").unionByName(named("region", "r_regionkey", "department", "中心"))
    return N.partial_chinese_matches(_chinese(spark, base), known.distinct())


# --- streams over stored logs ---------------------------------------------------------------


def _stream(spark, df, name: str):
    """A table as a stream of its files."""
    path = _place(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


@register("stream_extract", f"WITH {PARTS_SQL}, {MENTIONS_SQL} SELECT * FROM mentions")
def stream_extract(spark, base):
    """Mentions of the question log read as a stream."""
    out = _place(spark, "mentions")
    log = questions(spark, base).repartition(cores(spark))
    streams.start_extraction(_stream(spark, log, "questions"), dictionary(spark, base), aliases(spark, base), out,
                             _place(spark, "progress"), chinese=False).awaitTermination()
    return spark.read.parquet(out).select("question_id", "entity_type", "ordinal", "value", "normalized")


@register("stream_feedback", with_feedback("SELECT template_id, event_id, success FROM feedback"))
def stream_feedback(spark, base):
    """The feedback log as a stream in which every event comes twice: each is appended once."""
    out, log = _place(spark, "appended"), feedback(spark, base)
    streams.start_feedback(_stream(spark, log.union(log), "doubled"), out, _place(spark, "progress"), late="60 days").awaitTermination()
    return spark.read.parquet(out).select("template_id", "event_id", "success")


@register("stream_template_rate", with_feedback("""
SELECT template_id, uses, round(pow(0.9, uses) + sum(CASE WHEN success THEN 0.1 * pow(0.9, uses - i) ELSE 0 END), 9) AS success_rate
FROM (SELECT template_id, success, count(*) OVER (PARTITION BY template_id) AS uses,
             row_number() OVER (PARTITION BY template_id ORDER BY ts, event_id) AS i FROM feedback)
GROUP BY template_id, uses"""))
def stream_template_rate(spark, base):
    out = _place(spark, "rates")
    streams.start_template_rates(_stream(spark, feedback(spark, base), "feedback"), out,
                                 _place(spark, "progress")).awaitTermination()
    return streams.current_rates(spark, out).withColumn("success_rate", F.round("success_rate", 9))


@register("stream_learn", f"""
WITH {PARTS_SQL}, {SKELETONS_SQL}, {LEARNED_SQL.strip()} SELECT template_query, sql_template FROM learned""")
def stream_learn(spark, base):
    """New templates from a stream of questions with generated SQL."""
    out = _place(spark, "learned")
    log = questions(spark, base).join(_generated(spark, base), "question_id")
    streams.start_learning(_stream(spark, log, "generated"), templates.library(spark), dictionary(spark, base), aliases(spark, base),
                           out, _place(spark, "progress")).awaitTermination()
    return spark.read.schema(schemas.TEMPLATES).parquet(out).select("template_query", "sql_template")
