"""Slot filling, answers, learning, maintenance and context over the whole question log."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourlens.functions import sqltext as Q
from hourlens.functions.similarity import THRESHOLDS, shared_types, template_quality
from hourlens.operators import learning as L
from hourlens.operators import matching as M
from hourlens.operators.partitioning import materialize
from hourlens.plans import answering as A
from hourlens.plans import context as C
from hourlens.plans import maintenance as MT
from hourlens.plans.chain import answer_questions, match_log
from hourlens.plans.extraction import find_mentions, mentions_long
from hourlens.plans.reports import flat_answers
from hourlens.sources.templates import library
from hourlens.sources.tpch import (
    OPENINGS, aliases, dictionary, feedback, question_parts, questions, skeleton_log, star, table, used_templates,
)
from hourlens.workload import cores, register
from hourlens.workload.learning import FEEDBACK_SQL
from hourlens.workload.names import MENTIONS_SQL, SKELETONS_SQL, extracted
from hourlens.workload.reports import ROLLUP_SQL, STAR_SQL, stored_rollup
from hourlens.workload.templates import _OPEN, AS_OF, LOG_SQL, TEMPLATES_SQL, TFIDF_SQL
from hourlens.workload.texts import PARTS_SQL

# --- SQL texts ------------------------------------------------------------------------

_TEXTS = (
    "'SELECT SUM(hours) FROM work_hours WHERE employee = ~{employee_0}~ AND period = ~{time_period_0}~'",
    "'SELECT created_at FROM work_hours WHERE kind = ~' || o_orderpriority || '~'",
    "'DROP TABLE orders_' || o_orderkey",
    "'SELECT (a FROM t_' || o_custkey",
    "'SELECT ~a FROM t_' || o_custkey",
    "'SELECT a FROM t JOIN u_' || o_custkey || ' ON x = y WHERE d > ~Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) || '-start~'",
    "'SELECT a FROM t WHERE p = ~{project_0}~ AND d <= ~{time_period_0}-end~'",
)
_MAPPED = ("{employee_0}|{time_period_0}", "", "", "", "", "", "{employee_0}|{time_period_0}")
_ISSUES = (
    "", "", "dangerous: DROP|missing: SELECT|missing: FROM", "unbalanced parentheses", "unbalanced quotes", "",
    "unknown slot: {project_0}|unused slot: {employee_0}",
)


def _case(key: str, texts, quote: bool) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {n} THEN {repr(t) if quote else t}" for n, t in enumerate(texts)) + " END"


def _quotes(expression: str) -> str:
    """The texts above write ~ for a quote, which both SQL dialects read alike."""
    return f"replace({expression}, '~', chr(39))"


SQL_TEXTS = f"""sql_texts AS (
  SELECT o_orderkey, o_orderkey % {len(_TEXTS)} AS n, {_quotes(_case(f"o_orderkey % {len(_TEXTS)}", _TEXTS, False))} AS sql FROM orders)"""


def _sql_texts(spark, base):
    turn = f"pmod(o_orderkey, {len(_TEXTS)})"
    mapped = F.expr(_case(turn, _MAPPED, True))
    return table(spark, base, "orders").select(
        "o_orderkey", F.expr(_quotes(_case(turn, _TEXTS, False))).alias("sql"),
        F.filter(F.split(mapped, r"\|"), lambda p: p != "").alias("mapped"))


@register("lint_sql", f"WITH {SQL_TEXTS} SELECT o_orderkey, {_case('n', _ISSUES, True)} AS issues FROM sql_texts")
def lint_sql(spark, base):
    return _sql_texts(spark, base).select(
        "o_orderkey", F.array_join(Q.lint_sql(F.col("sql"), F.col("mapped")), "|").alias("issues"))


@register("unresolved_period", f"""
WITH {SQL_TEXTS} SELECT o_orderkey, regexp_matches(sql, '''Q[1-4]\\s+\\d{{4}}-start''') OR contains(sql, '{{time_period_0}}-end') AS unresolved FROM sql_texts""")
def unresolved_period(spark, base):
    return _sql_texts(spark, base).select("o_orderkey", Q.unresolved_period(F.col("sql")).alias("unresolved"))


@register("drop_unresolved", f"WITH {SQL_TEXTS} SELECT o_orderkey, sql FROM sql_texts WHERE n NOT IN (5, 6)")
def drop_unresolved(spark, base):
    return MT.drop_unresolved(_sql_texts(spark, base)).select("o_orderkey", "sql")


@register("tables_used", f"""
WITH {SQL_TEXTS}
SELECT o_orderkey, array_to_string(list_sort(list_distinct(
  regexp_extract_all(sql, '\\b(?:FROM|JOIN)\\s+([^\\s,]+)', 1))), '|') AS tables FROM sql_texts""")
def tables_used(spark, base):
    return _sql_texts(spark, base).select(
        "o_orderkey", F.array_join(F.array_sort(Q.tables_used(F.col("sql"))), "|").alias("tables"))


@register("migrate_period_sql", f"""
WITH {SQL_TEXTS}
SELECT o_orderkey, replace(sql, 'period = ''{{time_period_0}}''',
  'NOT (start_date > ''{{time_period_0}}-end'' OR end_date < ''{{time_period_0}}-start'')') AS sql,
  CASE WHEN n = 0 THEN 'simple' WHEN n = 6 THEN 'start_end' ELSE 'other' END AS style FROM sql_texts""")
def migrate_period_sql(spark, base):
    return _sql_texts(spark, base).select(
        "o_orderkey", Q.migrate_period_sql(F.col("sql")).alias("sql"), Q.period_style(F.col("sql")).alias("style"))


# --- matches, slots, filled SQL ------------------------------------------------------------

# The template each question shape belongs to (a library question, word for word).
_TEMPLATE_OF = {0: 1, 1: 2, 2: 3, 3: 4, 4: 5, 5: 6, 7: 8, 8: 9, 9: 10, 10: 12}
MATCHES_SQL = "matches AS (SELECT question_id, CAST(CASE shape " + " ".join(
    f"WHEN {s} THEN {t}" for s, t in _TEMPLATE_OF.items()) + " END AS BIGINT) AS template_id FROM parts WHERE shape IN (" + ", ".join(
    map(str, _TEMPLATE_OF)) + "))"
RANGES_SQL = """
spans AS (
  SELECT DISTINCT question_id, normalized,
    CASE WHEN normalized[1] = 'Q' THEN make_date(CAST(right(normalized, 4) AS BIGINT), CAST(normalized[2] AS BIGINT) * 3 - 2, 1)
         WHEN length(normalized) = 4 THEN make_date(CAST(normalized AS BIGINT), 1, 1)
         ELSE CAST(strptime('1 ' || normalized, '%d %B %Y') AS DATE) END AS start_date,
    CASE WHEN normalized[1] = 'Q' THEN last_day(make_date(CAST(right(normalized, 4) AS BIGINT), CAST(normalized[2] AS BIGINT) * 3, 1))
         WHEN length(normalized) = 4 THEN make_date(CAST(normalized AS BIGINT), 12, 31)
         ELSE last_day(CAST(strptime('1 ' || normalized, '%d %B %Y') AS DATE)) END AS end_date
  FROM mentions WHERE entity_type = 'time_period')"""
SLOTS_SQL = f"""{MENTIONS_SQL}, {MATCHES_SQL}, {RANGES_SQL.strip()},
slots AS (
  SELECT m.question_id, m.template_id, '{{' || e.entity_type || '_' || e.ordinal || '}}' AS placeholder, e.entity_type,
         e.value, e.normalized, s.start_date, s.end_date
  FROM matches m JOIN mentions e USING (question_id) LEFT JOIN spans s
    ON s.question_id = m.question_id AND s.normalized = e.normalized AND e.entity_type = 'time_period')"""


def _exact_matches(log, templates):
    """Questions whose skeleton is a template's question word for word."""
    return log.join(
        templates.select("template_id", F.col("template_query").alias("skeleton")), "skeleton"
    ).select("question_id", "template_id")


def _extracted(spark, base):
    """The extracted log as a table: the jobs below read it several times."""
    return materialize(extracted(spark, base))


def _slots(spark, base):
    log, templates = _extracted(spark, base), library(spark)
    return A.fill_slots(_exact_matches(log, templates), templates, mentions_long(log)), templates


@register("slot_fill_join", f"""
WITH {PARTS_SQL}, {SLOTS_SQL} SELECT question_id, template_id, placeholder, value, normalized, start_date, end_date FROM slots""")
def slot_fill_join(spark, base):
    return _slots(spark, base)[0].select(
        "question_id", "template_id", "placeholder", "value", "normalized", "start_date", "end_date")


_FILLED = """
filled AS (
  SELECT m.question_id, m.template_id, replace(replace(replace(replace(replace(replace(replace(replace(sql_template,
           '{employee_0}', coalesce(e0, '{employee_0}')), '{employee_1}', coalesce(e1, '{employee_1}')),
           '{project_0}', coalesce(p0, '{project_0}')), '{department_0}', coalesce(d0, '{department_0}')),
           '{time_period_0}-start', strftime(s, '%Y-%m-%d')), '{time_period_0}-end', strftime(t, '%Y-%m-%d')),
           '{time_period_0}_start', strftime(s, '%Y-%m-%d')), '{time_period_0}_end', strftime(t, '%Y-%m-%d')) AS sql
  FROM (SELECT question_id, any_value(template_id) AS template_id,
               max(normalized) FILTER (placeholder = '{employee_0}') AS e0, max(normalized) FILTER (placeholder = '{employee_1}') AS e1,
               max(normalized) FILTER (placeholder = '{project_0}') AS p0, max(normalized) FILTER (placeholder = '{department_0}') AS d0,
               max(start_date) AS s, max(end_date) AS t FROM slots GROUP BY question_id) m
  JOIN library USING (template_id))"""


@register("fill_sql", f"""
WITH {PARTS_SQL}, {TEMPLATES_SQL.strip()}, {SLOTS_SQL}, {_FILLED.strip()} SELECT question_id, template_id, sql FROM filled""")
def fill_sql(spark, base):
    slots, templates = _slots(spark, base)
    return A.filled_sql(slots, templates)


@register("job_fill", f"""
WITH {PARTS_SQL}, {TEMPLATES_SQL.strip()}, {SLOTS_SQL}, {_FILLED.strip()}
SELECT question_id, any_value(template_id) AS template_id, any_value(sql) AS sql,
  coalesce(string_agg(normalized, '|' ORDER BY placeholder) FILTER (entity_type = 'employee'), '') AS employees,
  coalesce(string_agg(normalized, '|' ORDER BY placeholder) FILTER (entity_type = 'project'), '') AS projects,
  coalesce(string_agg(normalized, '|' ORDER BY placeholder) FILTER (entity_type = 'department'), '') AS departments,
  coalesce(string_agg(start_date || ' ' || end_date, '|' ORDER BY placeholder), '') AS periods
FROM slots JOIN filled USING (question_id, template_id) GROUP BY question_id""")
def job_fill(spark, base):
    slots, templates = _slots(spark, base)
    periods = F.transform("periods", lambda p: F.concat_ws(" ", p["start_date"].cast("string"), p["end_date"].cast("string")))
    lists = A.parameters(slots).select(
        "question_id", *(F.array_join(name, "|").alias(name) for name in ("employees", "projects", "departments")),
        F.array_join(periods, "|").alias("periods"))
    return A.filled_sql(slots, templates).join(lists, "question_id")


@register("sql_to_template", f"""
WITH {PARTS_SQL}, {SKELETONS_SQL}
SELECT question_id, CASE shape WHEN 6 THEN CASE WHEN length(i2) > length(i)
  THEN 'SELECT SUM(hours) FROM work_hours WHERE ref IN (''{{project_id_1}}'', ''{{project_id_0}}'') AND period = ''{{time_period_0}}'''
  ELSE 'SELECT SUM(hours) FROM work_hours WHERE ref IN (''{{project_id_0}}'', ''{{project_id_1}}'') AND period = ''{{time_period_0}}''' END
  WHEN 9 THEN 'SELECT project FROM work_hours WHERE employee = ''{{employee_0}}'' AND period = ''{{time_period_0}}'''
  WHEN 11 THEN 'DROP TABLE report' ELSE 'SELECT SUM(hours) FROM work_hours WHERE period = ''{{time_period_0}}''' END AS sql_template
FROM parts WHERE shape IN (6, 9, 11, 12)""")
def sql_to_template(spark, base):
    return MT.sql_templates(_generated(spark, base), extracted(spark, base)).select("question_id", "sql_template")


def _generated(spark, base):
    """SQL a generator wrote for four of the question shapes."""
    sql = F.expr("""CASE shape
      WHEN 6 THEN concat("SELECT SUM(hours) FROM work_hours WHERE ref IN ('", i, "', '", i2, "') AND period = '", m, "'")
      WHEN 9 THEN concat("SELECT project FROM work_hours WHERE employee = '", e, "' AND period = '", q, "'")
      WHEN 11 THEN 'DROP TABLE report'
      WHEN 12 THEN concat("SELECT SUM(hours) FROM work_hours WHERE period = '", q, "'") END""")
    return question_parts(spark, base).select("question_id", sql.alias("sql")).where("sql IS NOT NULL")


LEARNED_SQL = """
learned AS (
  SELECT DISTINCT skeleton AS template_query, CASE
    WHEN skeleton = 'How many hours did they work in {time_period_0}?' THEN 'SELECT SUM(hours) FROM work_hours WHERE period = ''{time_period_0}'''
    WHEN starts_with(skeleton, 'Compare the hours spent on {project_id_0}')
      THEN 'SELECT SUM(hours) FROM work_hours WHERE ref IN (''{project_id_0}'', ''{project_id_1}'') AND period = ''{time_period_0}'''
    ELSE 'SELECT SUM(hours) FROM work_hours WHERE ref IN (''{project_id_1}'', ''{project_id_0}'') AND period = ''{time_period_0}''' END AS sql_template
  FROM skeletons WHERE shape IN (6, 12))"""


@register("job_learn", f"""
WITH {PARTS_SQL}, {SKELETONS_SQL}, {LEARNED_SQL.strip()}
SELECT template_query, sql_template, CASE WHEN starts_with(template_query, 'How many') THEN 'aggregation' ELSE 'comparison' END AS intent,
       'work_hours' AS tables FROM learned""")
def job_learn(spark, base):
    new = MT.learn(_generated(spark, base), extracted(spark, base), library(spark))
    return new.select("template_query", "sql_template", "intent", F.array_join("tables_used", "|").alias("tables"))


@register("template_upsert", f"""
WITH {TEMPLATES_SQL.strip()},
batch AS (SELECT CASE o_orderkey % 2 WHEN 0 THEN 'Which projects had the most hours in {{time_period_0}}?'
                 ELSE 'Who is on ' || o_orderpriority || '?' END AS template_query, o_orderdate AS ts FROM orders),
used AS (SELECT template_query, count(*) AS uses, max(ts) AS last_used FROM batch GROUP BY ALL)
SELECT l.template_query, l.usage_count + coalesce(u.uses, 0) AS usage_count, greatest(l.last_used, u.last_used) AS last_used
FROM templates l LEFT JOIN used u USING (template_query)
UNION ALL SELECT template_query, uses, last_used FROM used ANTI JOIN library USING (template_query)""")
def template_upsert(spark, base):
    """A batch of uses: one known skeleton, and one new skeleton per order priority."""
    known = F.lit("Which projects had the most hours in {time_period_0}?")
    new_text = F.concat(F.lit("Who is on "), "o_orderpriority", F.lit("?"))
    batch = table(spark, base, "orders").select(
        F.when(F.pmod("o_orderkey", F.lit(2)) == 0, known).otherwise(new_text).alias("template_query"),
        F.col("o_orderdate").alias("last_used"))
    used = batch.groupBy("template_query").agg(F.count("*").alias("uses"), F.max("last_used").alias("last_used"))
    templates = used_templates(spark, base).select("template_query", "usage_count", "last_used")
    return MT.upsert(templates, used, used.withColumnRenamed("uses", "usage_count"))


@register("merge_libraries", f"""
WITH {TEMPLATES_SQL.strip()}
SELECT template_id, usage_count, CASE WHEN template_id <= 10 THEN 'predefined' ELSE 'special' END AS source FROM templates""")
def merge_libraries(spark, base):
    return used_templates(spark, base).select("template_id", "usage_count", "source")


@register("job_maintain", f"""
WITH {TFIDF_SQL.strip()}
SELECT template_id, round(quality, 9) AS quality FROM quality ORDER BY quality DESC, template_id LIMIT 10""")
def job_maintain(spark, base):
    """All library templates are valid; the ten best by quality stay."""
    types = F.size(F.array_distinct(F.transform("slots", lambda s: s["type"])))
    quality = template_quality(F.col("success_rate"), F.col("usage_count"), F.col("last_used"), types, F.lit(AS_OF))
    return MT.maintain(used_templates(spark, base), quality, 10).select("template_id", F.round("quality", 9).alias("quality"))


@register("sample_rows", f"""
WITH {STAR_SQL}
SELECT employee_id, rank, start_date, project_id, hours FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY employee_id ORDER BY start_date NULLS FIRST, project_id NULLS FIRST, hours NULLS FIRST) AS INTEGER)
    AS rank FROM work_hour) WHERE rank <= 5""")
def sample_rows(spark, base):
    """First five fact rows of every employee."""
    fact = star(spark, base).work_hour.select("employee_id", "start_date", "project_id", "hours")
    return MT.first_rows(fact, "employee_id")


# --- answers ------------------------------------------------------------------------------

_LOG_PARAMS = """params AS (
  SELECT question_id, e AS employee, p AS project, CAST(date_trunc('quarter', day) AS DATE) AS start_date,
         last_day(CAST(date_trunc('quarter', day) + INTERVAL 2 MONTH AS DATE)) AS end_date FROM parts)"""


@register("answer_question_log", f"""
WITH {PARTS_SQL}, {_LOG_PARAMS},
who AS (SELECT DISTINCT v.employee, e.uuid FROM (SELECT DISTINCT employee FROM params) v JOIN employee e
        ON contains(lower(e.name), lower(v.employee)) OR contains(lower(e.alias), lower(v.employee))),
what AS (SELECT DISTINCT v.project, p.uuid FROM (SELECT DISTINCT project FROM params) v JOIN project p
         ON contains(lower(p.name), lower(v.project)) OR contains(lower(p.project_reference_id), lower(v.project))),
answers AS (
  SELECT q.question_id, sum(h.hours) AS total_hours FROM params q
  JOIN who ON who.employee = q.employee JOIN what ON what.project = q.project
  JOIN work_hour h ON h.employee_id = who.uuid AND h.project_id = what.uuid
   AND h.start_date <= q.end_date AND h.end_date >= q.start_date GROUP BY q.question_id)
SELECT question_id, employee, project, start_date, end_date, total_hours FROM params LEFT JOIN answers USING (question_id)""")
def answer_question_log(spark, base):
    """Hours of an employee on a project in a quarter, one question per order, in one plan."""
    start = F.trunc("day", "quarter")
    params = question_parts(spark, base).select(
        "question_id", F.col("e").alias("employee"), F.col("p").alias("project"),
        start.alias("start_date"), F.last_day(F.add_months(start, 2)).alias("end_date"))
    return A.answer_totals(materialize(params), star(spark, base))


@register("q_flat_log", f"""
WITH {PARTS_SQL}, {ROLLUP_SQL.removeprefix(STAR_SQL).removeprefix(",").strip()}
SELECT question_id, e AS employee, p AS project, q AS period, total_hours FROM parts LEFT JOIN (
  SELECT employee, project, period, sum(hours) AS total_hours FROM work_hours GROUP BY ALL) w
  ON w.employee = e AND w.project = p AND w.period = q""")
def q_flat_log(spark, base):
    """Hours of every question's person, project and quarter on the stored flat table."""
    asked = question_parts(spark, base).select(
        "question_id", F.col("e").alias("employee"), F.col("p").alias("project"), F.col("q").alias("period"))
    return flat_answers(stored_rollup(spark, base), asked)


@register("period_range_join", f"""
WITH {STAR_SQL},
periods AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS start_date, last_day(CAST(o_orderdate AS DATE)) AS end_date FROM orders)
SELECT p.start_date, p.end_date, sum(h.hours) AS total_hours FROM periods p LEFT JOIN work_hour h
  ON h.start_date <= p.end_date AND h.end_date >= p.start_date GROUP BY p.start_date, p.end_date""")
def period_range_join(spark, base):
    """Hours that overlap each month with an order."""
    day = F.col("o_orderdate").cast("date")
    periods = table(spark, base, "orders").select(
        F.trunc(day, "month").alias("start_date"), F.last_day(day).alias("end_date")).distinct()
    return A.answer_totals(periods, star(spark, base), by=())


ANSWERS_SQL = """ranges AS (SELECT question_id, any_value(template_id) AS template_id, max(start_date) AS lo, max(end_date) AS hi FROM slots GROUP BY question_id),
asked AS (SELECT r.*, coalesce(entity_type, '') AS kind, normalized AS v FROM ranges r
          LEFT JOIN slots s ON s.question_id = r.question_id AND s.entity_type IN ('employee', 'project', 'department')),
who AS (SELECT DISTINCT v, uuid, name FROM (SELECT DISTINCT v FROM asked WHERE kind = 'employee') a JOIN employee e
        ON contains(lower(e.name), lower(v)) OR contains(lower(e.alias), lower(v))),
what AS (SELECT DISTINCT v, uuid, name FROM (SELECT DISTINCT v FROM asked WHERE kind = 'project') a JOIN project p
         ON contains(lower(p.name), lower(v)) OR contains(lower(p.project_reference_id), lower(v))),
both_of AS (SELECT a.question_id, a.template_id, a.lo, a.hi, a.v AS e, b.v AS p FROM asked a JOIN asked b
            ON a.question_id = b.question_id AND a.kind = 'employee' AND b.kind = 'project' AND a.template_id = 1),
totals AS (
  SELECT question_id, sum(hours) AS total_hours FROM both_of JOIN who ON who.v = e JOIN what ON what.v = p
  JOIN work_hour h ON h.employee_id = who.uuid AND h.project_id = what.uuid AND h.start_date <= hi AND h.end_date >= lo GROUP BY 1
  UNION ALL SELECT question_id, sum(hours) FROM asked JOIN who USING (v)
  JOIN work_hour h ON h.employee_id = who.uuid AND h.start_date <= hi AND h.end_date >= lo WHERE template_id = 4 GROUP BY 1
  UNION ALL SELECT question_id, sum(hours) FROM asked JOIN what USING (v)
  JOIN work_hour h ON h.project_id = what.uuid AND h.start_date <= hi AND h.end_date >= lo WHERE template_id = 5 GROUP BY 1),
by_person AS (
  SELECT question_id, template_id, h.employee_id, h.project_id, hours FROM asked JOIN who USING (v)
  JOIN work_hour h ON h.employee_id = who.uuid AND h.start_date <= hi AND h.end_date >= lo WHERE template_id IN (2, 6, 10)),
by_project AS (
  SELECT question_id, template_id, h.employee_id, hours FROM asked JOIN what USING (v)
  JOIN work_hour h ON h.project_id = what.uuid AND h.start_date <= hi AND h.end_date >= lo WHERE template_id = 3),
periods AS (SELECT DISTINCT template_id, lo, hi FROM ranges WHERE template_id IN (8, 9)),
sums AS (SELECT template_id, lo, hi, CASE template_id WHEN 8 THEN h.project_id ELSE h.employee_id END AS key, sum(hours) AS hours
         FROM periods JOIN work_hour h ON h.start_date <= hi AND h.end_date >= lo GROUP BY ALL),
largest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY template_id, lo, hi ORDER BY hours DESC, key) AS rank FROM sums) WHERE rank <= 5)
SELECT question_id, template_id, NULL::BIGINT AS key, NULL::VARCHAR AS item, total_hours, NULL::INTEGER AS rank
FROM ranges LEFT JOIN totals USING (question_id) WHERE template_id IN (1, 4, 5)
UNION ALL SELECT DISTINCT question_id, 2, project_id, p.name, NULL, NULL FROM by_person LEFT JOIN project p ON p.uuid = project_id WHERE template_id = 2
UNION ALL SELECT DISTINCT question_id, 3, NULL, e.name, NULL, NULL FROM by_project JOIN employee e ON e.uuid = employee_id
UNION ALL SELECT question_id, 6, e.uuid, e.name, sum(hours), NULL FROM by_person JOIN employee e ON e.uuid = employee_id WHERE template_id = 6 GROUP BY 1, 3, 4
UNION ALL SELECT question_id, 10, project_id, p.name, sum(hours), NULL FROM by_person LEFT JOIN project p ON p.uuid = project_id WHERE template_id = 10 GROUP BY 1, 3, 4
UNION ALL SELECT question_id, template_id, key, coalesce(p.name, e.name), hours, rank FROM ranges JOIN largest USING (template_id, lo, hi)
  LEFT JOIN project p ON template_id = 8 AND p.uuid = key LEFT JOIN employee e ON template_id = 9 AND e.uuid = key
UNION ALL SELECT question_id, 12, NULL, e.name, sum(hours), NULL FROM asked JOIN employee e ON e.department = v AND kind = 'department'
  JOIN work_hour h ON h.employee_id = e.uuid AND h.start_date >= lo AND h.end_date <= hi WHERE template_id = 12 GROUP BY 1, 4"""


@register("job_answer", f"WITH {PARTS_SQL}, {SLOTS_SQL},\n{ANSWERS_SQL}")
def job_answer(spark, base):
    """From question text to answers of every matched question: totals, lists, comparisons and the five largest."""
    slots, _ = _slots(spark, base)
    return A.answer_log(A.parameters(slots), star(spark, base))


# The skeletons that extraction finds in the opened questions, and the best template of each.
_SAID_SQL = SKELETONS_SQL.replace("skeletons AS (", "plain AS (") + f""",
said AS (SELECT question_id, {_OPEN} || skeleton AS skeleton FROM plain JOIN orders ON o_orderkey = question_id),
skeletons AS (SELECT DISTINCT skeleton FROM said)"""
_BEST_SQL = """
best AS (SELECT skeleton, template_id, similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY skeleton ORDER BY round(combined, 9) DESC, template_id) AS rn
  FROM combined WHERE similarity >= 0.65) WHERE rn = 1),
matches AS (SELECT question_id, template_id, similarity FROM said JOIN best USING (skeleton))"""
CHAIN_SQL = f"""{PARTS_SQL}, {_SAID_SQL}, {TFIDF_SQL.replace(LOG_SQL + ",", "").strip()}, {_BEST_SQL.strip()}, {SLOTS_SQL.replace(MATCHES_SQL + ", ", "")}"""


def _chain(spark, base):
    """Every question with an opening of its order's status, through the whole chain."""
    opening = F.create_map(*(F.lit(x) for pair in OPENINGS.items() for x in pair))
    status = table(spark, base, "orders").select(
        F.col("o_orderkey").alias("question_id"), F.coalesce(F.try_element_at(opening, "o_orderstatus"), F.lit("")).alias("opening"))
    log = questions(spark, base).join(status, "question_id").select(
        "question_id", "session_id", "ts", F.concat("opening", "text").alias("text"))
    return answer_questions(log, dictionary(spark, base), aliases(spark, base), used_templates(spark, base), star(spark, base),
                            as_of=AS_OF, chinese=False, partitions=cores(spark))


@register("job_chain_matches", f"""
WITH {CHAIN_SQL}
SELECT question_id, template_id, round(similarity, 9) AS similarity FROM matches""")
def job_chain_matches(spark, base):
    """The template of every opened question, found by its skeleton however it is opened."""
    return _chain(spark, base)[0].select("question_id", "template_id", F.round("similarity", 9).alias("similarity"))


@register("job_chain", f"WITH {CHAIN_SQL},\n{ANSWERS_SQL}")
def job_chain(spark, base):
    """From opened questions to answers: nearly matched questions are filled and answered like those word for word."""
    return _chain(spark, base)[1]


@register("job_match", f"""
WITH {TFIDF_SQL.strip()},
best AS (SELECT skeleton, template_id, similarity, combined FROM (
  SELECT *, row_number() OVER (PARTITION BY skeleton ORDER BY combined DESC, template_id) AS rn
  FROM combined WHERE similarity >= 0.65) WHERE rn = 1)
SELECT question_id, template_id, round(similarity, 9) AS similarity, round(combined, 9) AS combined
FROM skeleton_log LEFT JOIN best USING (skeleton)""")
def job_match(spark, base):
    """Best template of every question, NULL on a miss; scored once per distinct skeleton."""
    log, templates = skeleton_log(spark, base), used_templates(spark, base)
    scores = M.combined(M.tfidf_scores(log, templates), templates, AS_OF)
    best = M.best_by_combined(scores, THRESHOLDS["tfidf"])
    return log.join(best, "skeleton", "left").select(
        "question_id", "template_id", F.round("similarity", 9).alias("similarity"), F.round("combined", 9).alias("combined"))


# --- context ---------------------------------------------------------------------------------

TURNS_SQL = f"""{MENTIONS_SQL},
turns AS (SELECT question_id, session_id, shape, row_number() OVER (PARTITION BY session_id ORDER BY ts, question_id) AS turn FROM parts),
recent AS (
  SELECT t.question_id, t.shape, m.entity_type, m.ordinal, m.value, m.normalized, p.turn AS said_in
  FROM turns t JOIN turns p ON p.session_id = t.session_id AND p.turn BETWEEN t.turn - 3 AND t.turn - 1
  JOIN mentions m ON m.question_id = p.question_id)"""


def _conversation(spark, base):
    log = _extracted(spark, base)
    return C.number_turns(questions(spark, base)), mentions_long(log)


@register("recent_messages", f"""
WITH {PARTS_SQL}, {TURNS_SQL}
SELECT question_id, entity_type, string_agg(DISTINCT normalized, '|' ORDER BY normalized) AS recent FROM recent GROUP BY ALL""")
def recent_messages(spark, base):
    messages, mentions = _conversation(spark, base)
    return C.recent_mentions(messages, mentions).groupBy("question_id", "entity_type").agg(
        F.array_join(F.array_sort(F.collect_set("normalized")), "|").alias("recent"))


RESOLVED_SQL = f"""
WITH {PARTS_SQL}, {TURNS_SQL},
latest AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY said_in DESC, ordinal DESC) AS rn
  FROM recent WHERE shape = 12 AND entity_type = 'employee')
SELECT question_id, entity_type, ordinal, value, normalized, CAST(NULL AS BIGINT) AS resolved_from FROM mentions
UNION ALL SELECT question_id, entity_type, 0, value, normalized, said_in FROM latest WHERE rn = 1"""


@register("resolve_reference", RESOLVED_SQL)
def resolve_reference(spark, base):
    return C.resolve_references(*_conversation(spark, base))


@register("shared_tables_semi", f"""
WITH {TEMPLATES_SQL.strip()}
SELECT template_id, usage_count FROM templates WHERE regexp_matches(sql_template, '(FROM|JOIN) project')""")
def shared_tables_semi(spark, base):
    """Templates that use a table the session has used (here: project)."""
    session = spark.range(1).select(F.lit("project").alias("t"))
    exploded = used_templates(spark, base).select("template_id", "usage_count", F.explode("tables_used").alias("t"))
    return exploded.join(session, "t", "left_semi").select("template_id", "usage_count").distinct()


_CONTEXT_SQL = f"""
WITH {TFIDF_SQL.strip()},
boosted AS (
  SELECT skeleton, template_id, similarity,
    similarity + CASE WHEN regexp_matches(sql_template, '(FROM|JOIN) project') THEN 0.1 ELSE 0 END + 0.05 * len(list_intersect(
      list_distinct(regexp_extract_all(skeleton, '\\{{([a-z_]+)_\\d+\\}}', 1)),
      list_distinct(regexp_extract_all(template_query, '\\{{([a-z_]+)_\\d+\\}}', 1)))) AS score
  FROM tfidf JOIN templates USING (template_id)),
best AS (SELECT skeleton, template_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY skeleton ORDER BY score DESC, template_id) AS rn FROM boosted WHERE similarity >= 0.65)
  WHERE rn = 1)"""


def _context_scores(spark, base):
    templates = used_templates(spark, base)
    kinds = F.array_distinct(F.regexp_extract_all("skeleton", F.lit(r"\{([a-z_]+)_\d+\}"), F.lit(1)))
    slot_kinds = F.array_distinct(F.transform("slots", lambda s: s["type"]))
    return M.tfidf_scores(skeleton_log(spark, base), templates).join(
        templates.select("template_id", "tables_used", "slots"), "template_id"
    ).select(
        F.col("skeleton").alias("key"), "template_id", "similarity",
        F.array_contains("tables_used", "project").alias("tables_shared"),
        shared_types(kinds, slot_kinds).alias("shared_types"))


@register("context_boost", f"{_CONTEXT_SQL} SELECT skeleton, template_id, round(score, 9) AS score FROM boosted")
def context_boost(spark, base):
    score = F.col("similarity") + C.context_boost(F.col("tables_shared"), F.col("shared_types"))
    return _context_scores(spark, base).select(
        F.col("key").alias("skeleton"), "template_id", F.round(score, 9).alias("score"))


@register("top1_contextual", f"{_CONTEXT_SQL} SELECT skeleton, template_id, round(score, 9) AS score FROM best")
def top1_contextual(spark, base):
    return C.contextual_best(_context_scores(spark, base), THRESHOLDS["tfidf"]).select(
        F.col("key").alias("skeleton"), "template_id", F.round("score", 9).alias("score"))


# Skeletons of the log as extraction finds them, and of the questions that refer to a person, read with the name.
_CONTEXT_SKELETONS = SKELETONS_SQL.replace("skeletons AS (", "plain AS (") + """,
referring AS (
  SELECT question_id, normalized, 'How many hours did {employee_0} work in {time_period_0}?' AS skeleton FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY said_in DESC, ordinal DESC) AS rn
    FROM recent WHERE shape = 12 AND entity_type = 'employee') WHERE rn = 1),
skeletons AS (SELECT DISTINCT skeleton FROM plain UNION SELECT DISTINCT skeleton FROM referring)"""
_USED = "list_distinct(regexp_extract_all(sql_template, '(?:FROM|JOIN) ([a-z_]+)', 1))"


@register("job_context", f"""
WITH {PARTS_SQL}, {TURNS_SQL}, {_CONTEXT_SKELETONS}, {TFIDF_SQL.replace(LOG_SQL + ",", "").strip()},
best AS (SELECT skeleton, template_id FROM (
  SELECT *, row_number() OVER (PARTITION BY skeleton ORDER BY round(combined, 9) DESC, template_id) AS rn
  FROM combined WHERE similarity >= 0.65) WHERE rn = 1),
used AS (SELECT t.session_id, t.turn, unnest({_USED}) AS tab FROM turns t JOIN plain USING (question_id) JOIN best USING (skeleton)
         JOIN templates USING (template_id)),
seen AS (SELECT DISTINCT t.question_id, tab FROM turns t JOIN used u ON u.session_id = t.session_id AND u.turn BETWEEN t.turn - 3 AND t.turn - 1),
scored AS (
  SELECT question_id, normalized, template_id, similarity
    + CASE WHEN list_has_any({_USED}, coalesce((SELECT list(tab) FROM seen WHERE seen.question_id = r.question_id), [])) THEN 0.1 ELSE 0 END
    + 0.05 * len(list_intersect(['employee', 'time_period'], list_distinct(regexp_extract_all(template_query, '\\{{([a-z_]+)_\\d+\\}}', 1)))) AS score
  FROM referring r JOIN tfidf USING (skeleton) JOIN templates USING (template_id) WHERE similarity >= 0.65)
SELECT question_id, template_id, normalized AS employee, round(score, 9) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, template_id) AS rn FROM scored) WHERE rn = 1""")
def job_context(spark, base):
    """Questions that refer to a person named before: who it is, and the template they then fit in their session."""
    log = materialize(find_mentions(
        questions(spark, base), dictionary(spark, base), aliases(spark, base), chinese=False, partitions=cores(spark), spans=True))
    templates = used_templates(spark, base)
    matches = match_log(log, templates, "tfidf", AS_OF)
    messages = materialize(C.number_turns(log.select("question_id", "session_id", "ts", "text")))
    spliced, best = C.contextual_matches(log, messages, matches, templates, THRESHOLDS["tfidf"])
    people = spliced.select("question_id", F.inline("entities")).where("entity_type = 'employee'")
    return best.join(people, "question_id").select(
        "question_id", "template_id", F.col("normalized").alias("employee"), F.round("score", 9).alias("score"))


@register("job_feedback", f"""
WITH {FEEDBACK_SQL.strip()}
SELECT template_id, uses, successes, round(successes / uses, 9) AS success_rate, last_used,
       round(pow(0.9, uses) + weighted, 9) AS ema_rate FROM (
  SELECT template_id, count(*) AS uses, count(*) FILTER (success) AS successes, max(ts) AS last_used,
         sum(CASE WHEN success THEN 0.1 * pow(0.9, later) ELSE 0 END) AS weighted
  FROM (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY ts DESC, event_id DESC) - 1 AS later FROM feedback)
  GROUP BY template_id)""")
def job_feedback(spark, base):
    """New statistics of every template from the whole feedback log."""
    log = feedback(spark, base)
    counts = log.groupBy("template_id").agg(
        F.count("*").alias("uses"), F.count_if("success").alias("successes"), F.max("ts").alias("last_used"))
    rates = L.ema_success_rate(log).select("template_id", F.round("success_rate", 9).alias("ema_rate"))
    return counts.join(rates, "template_id").select(
        "template_id", "uses", "successes", F.round(F.col("successes") / F.col("uses"), 9).alias("success_rate"),
        "last_used", "ema_rate")
