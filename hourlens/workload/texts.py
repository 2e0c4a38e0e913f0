"""Extraction and normalization over the question log, documents and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourlens.functions import extract as X
from hourlens.functions.normalize import normalize_date, normalize_number
from hourlens.functions.periods import normalize_period, period_range
from hourlens.operators.partitioning import compute_once, spread
from hourlens.operators.windows import dedupe_first, number_by_length
from hourlens.sources.tpch import QUESTION_SHAPES, question_parts, questions, table
from hourlens.workload import cores, register
from hourlens.workload.reports import STAR_SQL


def _shape_sql(shape: str) -> str:
    pieces = shape.replace("}", "{").split("{")
    return " || ".join(f"{p}" if i % 2 else f"'{p}'" for i, p in enumerate(pieces))


PARTS_SQL = STAR_SQL + f""",
parts AS (
  SELECT o_orderkey AS question_id, o_custkey AS session_id, o_orderdate AS ts, CAST(o_orderdate AS DATE) AS day,
         o_orderkey % {len(QUESTION_SHAPES)} AS shape, e1.name AS e, 'Staff ' || e1.uuid AS a, e2.name AS e2, e1.department AS d, j.name AS p,
         'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) AS q, strftime(o_orderdate, '%B %Y') AS m,
         CAST(year(o_orderdate) AS VARCHAR) AS y,
         ['first', 'second', 'third', 'fourth'][quarter(o_orderdate)] || ' quarter of ' || year(o_orderdate) AS w,
         'P-' || ((o_orderkey * 2) // 15) AS i, 'P-' || xor((o_orderkey * 2) // 15, 1) AS i2,
         strftime(o_orderdate, '%Y-%m-%d') AS t, CAST(o_custkey AS VARCHAR) AS k
  FROM orders
  JOIN employee e1 ON e1.uuid = o_custkey // 15
  JOIN employee e2 ON e2.uuid = xor(o_custkey // 15, 1)
  JOIN project j ON j.uuid = (o_orderkey * 2) // 15)"""
QUESTIONS_SQL = PARTS_SQL + """,
questions AS (
  SELECT question_id, session_id, ts, CASE shape """ + " ".join(
    f"WHEN {n} THEN {_shape_sql(s)}" for n, s in enumerate(QUESTION_SHAPES)) + " END AS text FROM parts)"


def with_questions(select: str, more: str = "") -> str:
    return f"WITH {QUESTIONS_SQL}{more}\n{select}"


def _blanked(patterns: str) -> str:
    return f"regexp_replace(text, '{patterns}', ' ~ ', 'g')"


def _found_sql(source: str, pattern: str) -> str:
    """Distinct matches per question, sorted and joined by '|'."""
    return with_questions(f"""
SELECT question_id, array_to_string(list_sort(list_distinct(hits)), '|') AS found
FROM (SELECT question_id, regexp_extract_all({source}, '{pattern}') AS hits FROM questions)
WHERE len(hits) > 0""")


def _found(spark, base, *forms: str) -> DataFrame:
    hits = X.mentions_of_form(F.col("text"), *forms)
    found = compute_once(spread(questions(spark, base), cores(spark)), "hits", hits)
    return found.where(F.size("hits") > 0).select(
        "question_id", F.array_join(F.array_sort("hits"), "|").alias("found"))


@register("src_questions", with_questions("SELECT * FROM questions"))
def src_questions(spark, base):
    return questions(spark, base)


@register("ext_date", _found_sql("text", X.DATE))
def ext_date(spark, base):
    return _found(spark, base, "date")


@register("ext_quarter", _found_sql("text", X.QUARTER))
def ext_quarter(spark, base):
    return _found(spark, base, "quarter")


@register("ext_quarter_words", with_questions("""
SELECT question_id, w AS found, q AS normalized FROM parts WHERE shape = 4"""))
def ext_quarter_words(spark, base):
    hits = X.mentions_of_form(F.col("text"), "quarter_words")
    found = F.col("found")
    return (
        questions(spark, base)
        .select("question_id", F.col("ts").cast("date").alias("day"), F.explode_outer(hits).alias("found"))
        .where(F.col("found").isNotNull())
        .select("question_id", "found", normalize_period(found, "day").alias("normalized"))
    )


@register("ext_relative_period", with_questions("""
SELECT question_id, CASE shape WHEN 7 THEN 'last quarter' ELSE 'this year' END AS found FROM parts WHERE shape IN (7, 8)"""))
def ext_relative_period(spark, base):
    return _found(spark, base, "relative")


@register("ext_month_year", _found_sql(_blanked(X.DATE), X.MONTH_YEAR))
def ext_month_year(spark, base):
    return _found(spark, base, "month_year")


_PERIODS = "|".join((X.DATE, X.QUARTER, X.QUARTER_WORDS, X.WEEK, X.MONTH_YEAR, X.PROJECT_ID, X.EMAIL))


@register("ext_year", _found_sql(_blanked(_PERIODS), X.YEAR))
def ext_year(spark, base):
    return _found(spark, base, "year")


@register("ext_number", _found_sql(_blanked(_PERIODS + "|" + X.PERCENTAGE), r"\b\d+(?:\.\d+)?\b"))
def ext_number(spark, base):
    """Numbers of the question log, bare years taken apart by type below."""
    return _found(spark, base, "number", "year")


@register("ext_percentage", _found_sql("text", X.PERCENTAGE))
def ext_percentage(spark, base):
    return _found(spark, base, "percentage")


@register("ext_project_id", _found_sql(_blanked(X.EMAIL), X.PROJECT_ID))
def ext_project_id(spark, base):
    return _found(spark, base, "project_id")


@register("ext_email", f"""
SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{X.EMAIL}'))), '|') AS emails
FROM documents WHERE regexp_matches(text, '{X.EMAIL}')""")
def ext_email(spark, base):
    """Addresses in whole documents; a plain substring test skips the regex where no @ occurs."""
    emails = F.array_sort(F.array_distinct(X.matches(F.col("text"), X.EMAIL)))
    return (
        compute_once(table(spark, base, "documents").where(F.contains("text", F.lit("@"))), "emails", emails)
        .where(F.size("emails") > 0)
        .select("doc_id", F.array_join("emails", "|").alias("emails"))
    )


@register("language_class", f"""
SELECT doc_id, regexp_matches(text, '[{X.CJK}]') AS has_chinese,
       CASE WHEN regexp_matches(text, '[{X.CJK}]') AND regexp_matches(text, '[A-Za-z]') THEN 'mixed'
            WHEN regexp_matches(text, '[{X.CJK}]') THEN 'zh' ELSE 'en' END AS language
FROM documents""")
def language_class(spark, base):
    text = F.col("text")
    return table(spark, base, "documents").select(
        "doc_id", X.has_chinese(text).alias("has_chinese"), X.language_class(text).alias("language"))


@register("valid_mention", with_questions(r"""
SELECT question_id, token FROM (
  SELECT question_id, unnest(string_split_regex(text, ' +')) AS token FROM questions)
WHERE length(token) >= 6 AND regexp_matches(token, '\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2}')"""))
def valid_mention(spark, base):
    token = F.explode(F.split("text", " +"))
    return questions(spark, base).select("question_id", token.alias("token")).where(
        X.valid_mention(F.col("token"), F.lit("date")))


# The written date shapes, by turn.
_DATE_FORMATS = (
    ("yyyy-MM-dd", "%Y-%m-%d"), ("MM/dd/yyyy", "%m/%d/%Y"), ("MM/dd/yy", "%m/%d/%y"),
    ("MMMM d, yyyy", "%B %-d, %Y"), ("MMM d, yyyy", "%b %-d, %Y"),
    ("MMMM d yyyy", "%B %-d %Y"), ("MMM d yyyy", "%b %-d %Y"),
)


def _written_date(day: Column, turn: Column) -> Column:
    out = F
    for n, (fmt, _) in enumerate(_DATE_FORMATS):
        out = out.when(turn == n, F.date_format(day, fmt))
    return out


@register("norm_date", """
SELECT o_orderkey, CASE o_orderkey % 7 """ + " ".join(
    f"WHEN {n} THEN strftime(o_orderdate, '{f}')" for n, (_, f) in enumerate(_DATE_FORMATS)) + """ END AS written,
  CASE WHEN o_orderkey % 7 = 2 THEN strftime(CASE WHEN year(o_orderdate) < 2000
       THEN o_orderdate + INTERVAL 100 YEAR ELSE o_orderdate END, '%Y-%m-%d')
  ELSE strftime(o_orderdate, '%Y-%m-%d') END AS normalized
FROM orders""")
def norm_date(spark, base):
    """Two-digit years are read in 2000-2099."""
    written = _written_date(F.col("o_orderdate").cast("date"), F.pmod("o_orderkey", F.lit(7)))
    return table(spark, base, "orders").select("o_orderkey", written.alias("written")).select(
        "o_orderkey", "written", normalize_date(F.col("written")).alias("normalized"))


@register("norm_number", """
SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) AS normalized,
       CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS whole FROM orders""")
def norm_number(spark, base):
    priced = F.format_number("o_totalprice", 2)
    return table(spark, base, "orders").select(
        "o_orderkey", normalize_number(priced).alias("normalized"),
        normalize_number(F.format_number(F.floor("o_totalprice"), 0)).alias("whole"))


# (phrase expression, canonical expression, start, end): Spark and DuckDB share the phrase text.
_PHRASES = (
    ("q", "q", "qs", "qe"), ("lower(q)", "q", "qs", "qe"), ("y || ' ' || left(q, 2)", "q", "qs", "qe"),
    ("'quarter ' || substring(q, 2, 1) || ' of ' || y", "q", "qs", "qe"), ("w", "q", "qs", "qe"),
    ("m", "m", "ms", "me"), ("lower(m)", "m", "ms", "me"), ("y", "y", "ys", "ye"),
    ("'maybe ' || y", "y", "ys", "ye"), ("'this quarter'", "q", "qs", "qe"), ("'this month'", "m", "ms", "me"),
    ("'this year'", "y", "ys", "ye"),
    ("'last month'", "strftime(ms - 1, '%B %Y')", "CAST(date_trunc('month', ms - 1) AS DATE)", "ms - 1"),
    ("'last year'", "CAST(year(day) - 1 AS VARCHAR)", "CAST(ys - INTERVAL 1 YEAR AS DATE)", "ys - 1"),
    ("'next quarter'", "'Q' || quarter(qe + 1) || ' ' || year(qe + 1)", "qe + 1",
     "last_day(CAST(qe + 1 + INTERVAL 2 MONTH AS DATE))"),
    ("t", "t", "day", "day"), ("'sometime'", "'sometime'", "CAST(NULL AS DATE)", "CAST(NULL AS DATE)"),
    ("'week 3 of ' || y", "'Week 3 ' || y", "fm + 14", "fm + 20"),
    ("'next week'", "strftime(wk + 7, '%Y-%m-%d') || ' - ' || strftime(wk + 13, '%Y-%m-%d')", "wk + 7", "wk + 13"),
)
_PHRASE_CASE = " ".join(f"WHEN {n} THEN {p}" for n, (p, *_) in enumerate(_PHRASES))


def _phrase_sql(columns: str) -> str:
    def pick(index: int) -> str:
        return "CASE n " + " ".join(f"WHEN {n} THEN {row[index]}" for n, row in enumerate(_PHRASES)) + " END"

    return f"""WITH {PARTS_SQL},
dated AS (
  SELECT *, question_id % {len(_PHRASES)} AS n, CAST(date_trunc('quarter', day) AS DATE) AS qs,
         last_day(CAST(date_trunc('quarter', day) + INTERVAL 2 MONTH AS DATE)) AS qe,
         CAST(date_trunc('month', day) AS DATE) AS ms, last_day(day) AS me,
         CAST(date_trunc('year', day) AS DATE) AS ys, CAST(y || '-12-31' AS DATE) AS ye,
         CAST(date_trunc('week', day) AS DATE) AS wk,
         CAST(y || '-01-01' AS DATE) + CAST((8 - isodow(CAST(y || '-01-01' AS DATE))) % 7 AS INTEGER) AS fm
  FROM parts),
answers AS (
  SELECT question_id, {pick(0)} AS phrase, {pick(1)} AS canonical, {pick(2)} AS start_date, {pick(3)} AS end_date FROM dated)
SELECT {columns} FROM answers"""


def _phrases(spark, base) -> DataFrame:
    phrase = F.expr(f"CASE pmod(question_id, {len(_PHRASES)}) {_PHRASE_CASE} END")
    return question_parts(spark, base).select("question_id", "day", phrase.alias("phrase"))


@register("norm_period", _phrase_sql("question_id, phrase, canonical"))
def norm_period(spark, base):
    canonical = normalize_period(F.col("phrase"), "day")
    return _phrases(spark, base).select("question_id", "phrase", canonical.alias("canonical"))


@register("period_range", _phrase_sql(
    "question_id, start_date, end_date, start_date IS NULL AS unresolved_period"))
def period_range_query(spark, base):
    canonical = normalize_period(F.col("phrase"), "day")
    return (
        _phrases(spark, base).withColumn("canonical", canonical)
        .withColumn("span", period_range(F.col("canonical")))
        .select("question_id", "span.start_date", "span.end_date",
                F.col("span.start_date").isNull().alias("unresolved_period"))
    )


@register("placeholder_ordinals", with_questions(f"""
SELECT question_id, entity_type, value, row_number() OVER (
         PARTITION BY question_id ORDER BY length(value) DESC, pos) - 1 AS ordinal
FROM (SELECT question_id, 'project_id' AS entity_type, value, min(pos) AS pos FROM (
        SELECT question_id, unnest(hits) AS value, generate_subscripts(hits, 1) AS pos FROM (
          SELECT question_id, regexp_extract_all(text, '{X.PROJECT_ID}') AS hits FROM questions))
      GROUP BY question_id, value)"""))
def placeholder_ordinals(spark, base):
    found = questions(spark, base).select(
        "question_id", F.lit("project_id").alias("entity_type"),
        F.posexplode(X.matches(F.col("text"), X.PROJECT_ID)).alias("pos", "value"))
    return number_by_length(found).select(
        "question_id", "entity_type", "value", F.col("ordinal").cast("long").alias("ordinal"))


@register("dedupe_first", """
SELECT conv_id, value FROM (
  SELECT conv_id, value, row_number() OVER (PARTITION BY conv_id, lower(value) ORDER BY turn, pos) AS rn FROM (
    SELECT conv_id, turn, unnest(w) AS value, generate_subscripts(w, 1) AS pos FROM (
      SELECT conv_id, turn, string_split_regex(text, '\\s+') AS w FROM conversations)))
WHERE rn = 1""")
def dedupe_first_query(spark, base):
    words = table(spark, base, "conversations").select(
        "conv_id", "turn", F.posexplode(F.split("text", r"\s+")).alias("pos", "value"))
    return dedupe_first(words, ["conv_id"], "value", ["turn", "pos"]).select("conv_id", "value")
