"""Template table, similarity and matching of the skeletons of the whole question log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from hourlens.functions import similarity as S
from hourlens.operators import matching as M
from hourlens.sources.templates import GENERAL, SPECIAL
from hourlens.sources.tpch import OPENINGS, SKELETONS, skeleton_log, table, used_templates
from hourlens.workload import cores, register

AS_OF = dt.date(2024, 2, 1)


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_ROWS = [(i + 1, q, s) for i, (q, s) in enumerate(GENERAL + SPECIAL)]
_INTENT = "CASE " + " ".join(
    f"WHEN regexp_matches(lower(X), '{'|'.join(h)}') THEN '{n}'" for n, h in S.INTENTS) + " ELSE 'general' END"
TEMPLATES_SQL = f"""
library(template_id, template_query, sql_template) AS (VALUES {", ".join(
    f"(CAST({i} AS BIGINT), {_quote(q)}, {_quote(s)})" for i, q, s in _ROWS)}),
use_stats AS (
  SELECT user_id % {len(_ROWS)} + 1 AS template_id, count(*) AS usage_count,
         avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) AS success_rate, max(ts) AS last_used
  FROM events GROUP BY 1),
templates AS (
  SELECT l.*, coalesce(usage_count, 0) AS usage_count, coalesce(success_rate, 1.0) AS success_rate, last_used,
         {_INTENT.replace("X", "template_query")} AS intent,
         len(list_distinct(regexp_extract_all(template_query, '\\{{([a-z_]+)_\\d+\\}}', 1))) AS n_types
  FROM library l LEFT JOIN use_stats USING (template_id))"""
_OPEN = "CASE o_orderstatus " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in OPENINGS.items()) + " ELSE '' END"
LOG_SQL = f"""
skeleton_log AS (
  SELECT o_orderkey AS question_id, o_custkey AS session_id, o_orderdate AS ts,
         {_OPEN} || CASE o_orderkey % {len(SKELETONS)} {" ".join(
    f"WHEN {i} THEN {_quote(s)}" for i, s in enumerate(SKELETONS))} END AS skeleton FROM orders),
skeletons AS (SELECT DISTINCT skeleton FROM skeleton_log)"""
_STOP = "[" + ", ".join(_quote(w) for w in (*S.STOP_WORDS, "[ENTITY]")) + "]"
WORD_SETS_SQL = TEMPLATES_SQL + "," + LOG_SQL + f""",
s_words AS (SELECT DISTINCT skeleton, unnest(string_split_regex(lower(skeleton), '\\s+')) AS w FROM skeletons),
t_words AS (SELECT DISTINCT template_id, unnest(string_split_regex(lower(template_query), '\\s+')) AS w FROM templates),
s_content AS (SELECT * FROM s_words WHERE NOT list_contains({_STOP}, w)),
t_content AS (
  SELECT * FROM (SELECT DISTINCT template_id, unnest(string_split_regex(
    regexp_replace(lower(template_query), '\\{{[^}}]+\\}}', '[ENTITY]', 'g'), '\\s+')) AS w FROM templates)
  WHERE NOT list_contains({_STOP}, w)),
word_scores AS (
  SELECT a.skeleton, a.template_id, shared / (ns + nt - shared) AS word FROM (
    SELECT skeleton, template_id, count(*) AS shared FROM s_words JOIN t_words USING (w) GROUP BY ALL) a
  JOIN (SELECT skeleton, count(*) AS ns FROM s_words GROUP BY ALL) USING (skeleton)
  JOIN (SELECT template_id, count(*) AS nt FROM t_words GROUP BY ALL) USING (template_id)),
content_scores AS (
  SELECT a.skeleton, a.template_id, shared / (ns + nt - shared) AS content FROM (
    SELECT skeleton, template_id, count(*) AS shared FROM s_content JOIN t_content USING (w) GROUP BY ALL) a
  JOIN (SELECT skeleton, count(*) AS ns FROM s_content GROUP BY ALL) USING (skeleton)
  JOIN (SELECT template_id, count(*) AS nt FROM t_content GROUP BY ALL) USING (template_id))"""
TEXT_SQL = WORD_SETS_SQL + """,
chars AS (
  SELECT skeleton, template_id, string_split(lower(skeleton), '') AS a, string_split(lower(template_query), '') AS b,
         jaro_winkler_similarity(lower(skeleton), lower(template_query)) AS jaro
  FROM skeletons CROSS JOIN templates),
lcs_rows AS (
  SELECT skeleton, template_id, list_reduce(
    list_transform(a, lambda c: [c]),
    lambda prev, c: list_transform(range(0, len(b) + 1), lambda j:
      CASE WHEN j = 0 THEN '0' ELSE CAST(list_max(list_transform(range(1, j + 1), lambda k:
        CASE WHEN b[k] = c[1] THEN CAST(prev[k] AS INTEGER) + 1 ELSE CAST(prev[k + 1] AS INTEGER) END)) AS VARCHAR) END),
    list_transform(range(0, len(b) + 1), lambda j: '0')) AS last_row, len(a) AS na, len(b) AS nb
  FROM chars),
lcs_scores AS (
  SELECT skeleton, template_id, CAST(last_row[len(last_row)] AS INTEGER) / greatest(na, nb) AS lcs FROM lcs_rows)"""


def with_templates(select: str) -> str:
    return f"WITH {TEMPLATES_SQL.strip()}\n{select}"


def _word_pairs(spark, base):
    return M.word_pairs(skeleton_log(spark, base), used_templates(spark, base))


@register("question_template_pairs", f"""
WITH {WORD_SETS_SQL.strip()}
SELECT skeleton, template_id, round(word, 9) AS word, round(coalesce(content, 0), 9) AS content
FROM word_scores LEFT JOIN content_scores USING (skeleton, template_id)""")
def question_template_pairs(spark, base):
    """Every distinct skeleton with every template it shares a word with."""
    return _word_pairs(spark, base).select(
        "skeleton", "template_id", F.round("word", 9).alias("word"), F.round("content", 9).alias("content"))


@register("sim_jaccard", f"""
WITH {WORD_SETS_SQL.strip()} SELECT skeleton, template_id, round(word, 9) AS similarity FROM word_scores""")
def sim_jaccard(spark, base):
    return _word_pairs(spark, base).select("skeleton", "template_id", F.round("word", 9).alias("similarity"))


@register("sim_placeholder", f"""
WITH {WORD_SETS_SQL.strip()} SELECT skeleton, template_id, round(content, 9) AS similarity FROM content_scores""")
def sim_placeholder(spark, base):
    return _word_pairs(spark, base).where(F.col("content") > 0).select(
        "skeleton", "template_id", F.round("content", 9).alias("similarity"))


def _text_scores(spark, base):
    return M._with_text_scores(_word_pairs(spark, base))


@register("sim_lcs", f"""
WITH {TEXT_SQL.strip()}
SELECT skeleton, template_id, round(lcs, 9) AS similarity FROM lcs_scores SEMI JOIN word_scores USING (skeleton, template_id)""")
def sim_lcs(spark, base):
    return _text_scores(spark, base).select("skeleton", "template_id", F.round("lcs", 9).alias("similarity"))


@register("sim_jaro_winkler", f"""
WITH {WORD_SETS_SQL.strip()}
SELECT skeleton, template_id, round(jaro_winkler_similarity(lower(skeleton), lower(template_query)), 9) AS similarity
FROM word_scores JOIN templates USING (template_id)""")
def sim_jaro_winkler(spark, base):
    return _text_scores(spark, base).select("skeleton", "template_id", F.round("jaro", 9).alias("similarity"))


SCORES_SQL = TEXT_SQL + """,
keyword AS (
  SELECT skeleton, template_id,
         0.4 * coalesce(word, 0) + 0.2 * jaro + 0.2 * lcs + 0.2 * coalesce(content, 0) AS score
  FROM chars JOIN lcs_scores USING (skeleton, template_id)
  LEFT JOIN word_scores USING (skeleton, template_id) LEFT JOIN content_scores USING (skeleton, template_id)),
best_keyword AS (
  SELECT skeleton, template_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY skeleton ORDER BY score DESC, template_id) AS rn FROM keyword)
  WHERE rn = 1 AND score >= 0.55 * 0.7)"""


@register("sim_keyword", f"""
WITH {SCORES_SQL.strip()}
SELECT skeleton, template_id, round(score, 9) AS score FROM keyword SEMI JOIN word_scores USING (skeleton, template_id)""")
def sim_keyword(spark, base):
    return _text_scores(spark, base).select("skeleton", "template_id", F.round("score", 9).alias("score"))


@register("top1_keyword", f"""
WITH {SCORES_SQL.strip()} SELECT skeleton, template_id, round(score, 9) AS score FROM best_keyword""")
def top1_keyword(spark, base):
    best = M.best_by_keyword(skeleton_log(spark, base), used_templates(spark, base))
    return best.select("skeleton", "template_id", F.round("score", 9).alias("score"))


@register("intent", f"""
SELECT doc_id, {_INTENT.replace("X", "text")} AS intent FROM documents""")
def intent_query(spark, base):
    """Intent words anywhere in whole documents."""
    return table(spark, base, "documents").select("doc_id", S.intent(F.col("text")).alias("intent"))


# --- tf-idf -----------------------------------------------------------------------------

_STOP_LIST = "(" + ", ".join(_quote(w) for w in S.STOP_WORDS) + ")"
_TOKEN = r"[\p{L}\p{N}_]{2,}"


@register("tfidf_fit", f"""
WITH tf AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) AS term FROM documents)
  WHERE term NOT IN {_STOP_LIST} GROUP BY ALL)
SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS df,
       round(ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1, 9) AS idf
FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 1000""")
def tfidf_fit(spark, base):
    """Vocabulary of the whole documents table; the 1000 most frequent terms are the feature."""
    fitted = M.tfidf_fit(table(spark, base, "documents"), "doc_id", "text", 1000, partitions=cores(spark))
    return fitted.withColumn("idf", F.round("idf", 9))


TFIDF_SQL = TEMPLATES_SQL + "," + LOG_SQL + f""",
t_tf AS (
  SELECT template_id, term, count(*) AS tf FROM (
    SELECT template_id, unnest(regexp_extract_all(lower(template_query), '{_TOKEN}')) AS term FROM templates)
  WHERE term NOT IN {_STOP_LIST} GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM templates)) / (1 + count(*))) + 1 AS idf FROM t_tf GROUP BY term),
t_w AS (SELECT template_id, term, tf * idf AS w FROM t_tf JOIN idf USING (term)),
s_w AS (
  SELECT skeleton, term, count(*) * any_value(idf) AS w FROM (
    SELECT skeleton, unnest(regexp_extract_all(lower(skeleton), '{_TOKEN}')) AS term FROM skeletons) JOIN idf USING (term)
  GROUP BY ALL),
tfidf AS (
  SELECT skeleton, template_id, sum(s.w * t.w) / any_value(sn.n * tn.n) AS similarity
  FROM s_w s JOIN t_w t USING (term)
  JOIN (SELECT skeleton, sqrt(sum(w * w)) AS n FROM s_w GROUP BY ALL) sn USING (skeleton)
  JOIN (SELECT template_id, sqrt(sum(w * w)) AS n FROM t_w GROUP BY ALL) tn USING (template_id)
  GROUP BY skeleton, template_id),
quality AS (
  SELECT template_id, intent, 0.4 * success_rate + 0.2 * least(ln(1 + usage_count) / 10, 1)
         + 0.2 * coalesce(exp(-date_diff('day', CAST(last_used AS DATE), DATE '2024-02-01') / 30), 0)
         + 0.2 * least(n_types / 5, 1) AS quality FROM templates),
combined AS (
  SELECT skeleton, template_id, similarity,
         similarity * CASE WHEN {_INTENT.replace("X", "skeleton")} = intent THEN 1.15 ELSE 1.0 END * (0.8 + 0.2 * quality) AS combined
  FROM tfidf JOIN quality USING (template_id))"""


@register("sim_tfidf", f"""
WITH {TFIDF_SQL.strip()} SELECT skeleton, template_id, round(similarity, 9) AS similarity FROM tfidf""")
def sim_tfidf(spark, base):
    return M.tfidf_scores(skeleton_log(spark, base), used_templates(spark, base)).withColumn(
        "similarity", F.round("similarity", 9))


@register("template_quality", f"""
WITH {TFIDF_SQL.strip()} SELECT template_id, round(quality, 9) AS quality FROM quality""")
def template_quality(spark, base):
    types = F.size(F.array_distinct(F.transform("slots", lambda s: s["type"])))
    quality = S.template_quality(F.col("success_rate"), F.col("usage_count"), F.col("last_used"), types, F.lit(AS_OF))
    return used_templates(spark, base).select("template_id", F.round(quality, 9).alias("quality"))


def _combined(spark, base):
    templates = used_templates(spark, base)
    return M.combined(M.tfidf_scores(skeleton_log(spark, base), templates), templates, AS_OF)


@register("combined_score", f"""
WITH {TFIDF_SQL.strip()} SELECT skeleton, template_id, round(combined, 9) AS combined FROM combined""")
def combined_score(spark, base):
    return _combined(spark, base).select("skeleton", "template_id", F.round("combined", 9).alias("combined"))


@register("top1_template", f"""
WITH {TFIDF_SQL.strip()}
SELECT skeleton, template_id, round(similarity, 9) AS similarity, round(combined, 9) AS combined FROM (
  SELECT *, row_number() OVER (PARTITION BY skeleton ORDER BY combined DESC, template_id) AS rn
  FROM combined WHERE similarity >= 0.65) WHERE rn = 1""")
def top1_template(spark, base):
    return M.best_by_combined(_combined(spark, base), S.THRESHOLDS["tfidf"]).select(
        "skeleton", "template_id", F.round("similarity", 9).alias("similarity"), F.round("combined", 9).alias("combined"))


@register("top3_candidates", f"""
WITH {TFIDF_SQL.strip()}
SELECT skeleton, template_id, round(similarity, 9) AS similarity, round(combined, 9) AS combined, CAST(rn AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY skeleton ORDER BY combined DESC, template_id) AS rn FROM combined)
WHERE rn <= 3""")
def top3_candidates(spark, base):
    return M.top_candidates(_combined(spark, base)).select(
        "skeleton", "template_id", F.round("similarity", 9).alias("similarity"),
        F.round("combined", 9).alias("combined"), "rank")


@register("method_threshold", f"""
WITH {TFIDF_SQL.strip()}
SELECT skeleton, method, bool_or(similarity >= threshold) AS accepted FROM tfidf
CROSS JOIN (VALUES ('embedding', 0.75), ('tfidf', 0.65), ('keyword', 0.55)) m(method, threshold) GROUP BY ALL""")
def method_threshold(spark, base):
    """Whether a skeleton has a hit under each method's threshold."""
    best = M.tfidf_scores(skeleton_log(spark, base), used_templates(spark, base)).groupBy("skeleton").agg(
        F.max("similarity").alias("best"))
    methods = F.create_map(*(F.lit(x) for pair in S.THRESHOLDS.items() for x in pair))
    return best.select("skeleton", "best", F.explode(methods).alias("method", "threshold")).select(
        "skeleton", "method", (F.col("best") >= F.col("threshold")).alias("accepted"))


@register("sim_embedding", """
WITH t AS (SELECT label AS template_id, embedding AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings),
scored AS (
  SELECT q.vec_id AS question_id, CAST(t.template_id AS BIGINT) AS template_id,
         list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(t.e AS DOUBLE[])) AS similarity
  FROM embeddings q JOIN t ON t.rn = 1)
SELECT question_id, template_id, round(similarity, 9) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, template_id) AS rn FROM scored)
WHERE rn = 1 AND similarity >= 0.2""")
def sim_embedding(spark, base):
    """All vectors as questions, the first vector of each label as its template."""
    vectors = table(spark, base, "embeddings")
    templates = vectors.groupBy(F.col("label").cast("bigint").alias("template_id")).agg(
        F.min_by("embedding", "vec_id").alias("embedding"))
    questions = vectors.select(F.col("vec_id").alias("question_id"), "embedding")
    return M.embedding_best(questions, templates, threshold=0.2).withColumn("similarity", F.round("similarity", 9))


# --- the template table itself -------------------------------------------------------------


@register("templates_by_types", with_templates("""
SELECT template_id, usage_count FROM templates
WHERE contains(template_query, '{employee_') AND contains(template_query, '{project_')"""))
def templates_by_types(spark, base):
    return used_templates(spark, base).where(S.all_types_used(F.col("slots"), ["employee", "project"])).select(
        "template_id", "usage_count")


@register("template_by_id", with_templates(
    "SELECT template_id, template_query, usage_count FROM templates WHERE template_id = 8"))
def template_by_id(spark, base):
    return used_templates(spark, base).where(F.col("template_id") == 8).select(
        "template_id", "template_query", "usage_count")


@register("entity_type_overlap", f"""
WITH {WORD_SETS_SQL.strip()}
SELECT skeleton, template_id,
  len(list_intersect(list_distinct(regexp_extract_all(skeleton, '\\{{([a-z_]+)_\\d+\\}}', 1)),
                     list_distinct(regexp_extract_all(template_query, '\\{{([a-z_]+)_\\d+\\}}', 1)))) AS shared_types
FROM word_scores JOIN templates USING (template_id)""")
def entity_type_overlap(spark, base):
    kinds = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"\{([a-z_]+)_\d+\}"), F.lit(1)))
    shared = S.shared_types(kinds(F.col("skeleton")), kinds(F.col("template_query")))
    return _word_pairs(spark, base).select(
        "skeleton", "template_id", shared.cast("long").alias("shared_types"))
