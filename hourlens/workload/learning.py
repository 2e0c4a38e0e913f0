"""Feedback and request statistics over the whole events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourlens.functions.similarity import THRESHOLDS, template_quality
from hourlens.operators import learning as L
from hourlens.sources.tpch import feedback, requests, table, used_templates
from hourlens.streaming.jobs import windowed_metrics
from hourlens.workload import register
from hourlens.workload.templates import AS_OF, TFIDF_SQL

FEEDBACK_SQL = """
feedback AS (
  SELECT user_id AS template_id, event_id, ts, event_type <> 'error' AS success, value * 25 AS execution_ms,
         CASE WHEN event_type = 'error' THEN 'failed: ' || props END AS error,
         event_type IN ('view', 'click', 'purchase') AS used
  FROM events),
requests AS (SELECT event_id AS request_id, ts, event_type IN ('view', 'click', 'purchase') AS hit, value AS ms FROM events)"""


def with_feedback(select: str) -> str:
    return f"WITH {FEEDBACK_SQL.strip()}\n{select}"


@register("append_feedback", with_feedback(
    "SELECT template_id, event_id, ts, success, execution_ms, error FROM feedback"))
def append_feedback(spark, base):
    """A log without the failures receives all events again."""
    log = feedback(spark, base)
    return L.append_feedback(log.where("success"), log)


@register("feedback_for_template", with_feedback("""
SELECT template_id, event_id, ts, success, execution_ms, error FROM feedback
WHERE template_id = 7 AND (error IS NOT NULL OR execution_ms <> 0)"""))
def feedback_for_template(spark, base):
    return L.feedback_of(feedback(spark, base), 7)


@register("cache_metrics", with_feedback("""
SELECT count(*) AS requests, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses,
       round(count(*) FILTER (hit) / count(*), 9) AS hit_rate, round(avg(ms), 6) AS mean_ms, 12 AS templates FROM requests"""))
def cache_metrics(spark, base):
    return L.cache_metrics(requests(spark, base), used_templates(spark, base)).select(
        "requests", "hits", "misses", F.round("hit_rate", 9).alias("hit_rate"),
        F.round("mean_ms", 6).alias("mean_ms"), F.col("templates").cast("int").alias("templates"))


@register("feedback_summary", with_feedback("""
SELECT count(*) AS total, count(*) FILTER (success) AS successes,
       round(count(*) FILTER (success) / count(*), 9) AS success_rate FROM feedback"""))
def feedback_summary(spark, base):
    return L.feedback_summary(feedback(spark, base)).withColumn("success_rate", F.round("success_rate", 9))


RATES_SQL = FEEDBACK_SQL + """,
rates AS (
  SELECT template_id, count(*) FILTER (success) AS successes, count(*) FILTER (NOT success) AS failures,
         count(*) FILTER (success) / count(*) AS success_rate FROM feedback GROUP BY template_id HAVING count(*) >= 5),
graded AS (SELECT *, CASE WHEN success_rate >= 0.8 THEN 'best' WHEN success_rate <= 0.3 THEN 'worst' END AS grade FROM rates)"""


@register("template_success_rates", f"""
WITH {RATES_SQL.strip()}
SELECT template_id, successes, failures, round(success_rate, 9) AS success_rate, grade FROM graded""")
def template_success_rates(spark, base):
    return L.success_rates(feedback(spark, base)).withColumn("success_rate", F.round("success_rate", 9))


@register("best_worst_templates", f"""
WITH {RATES_SQL.strip()}
SELECT grade, CAST(rn AS INTEGER) AS rank, template_id, round(success_rate, 9) AS success_rate FROM (
  SELECT *, row_number() OVER (PARTITION BY grade ORDER BY CASE grade WHEN 'best' THEN -success_rate ELSE success_rate END,
                               template_id) AS rn FROM graded WHERE grade IS NOT NULL) WHERE rn <= 5""")
def best_worst_templates(spark, base):
    return L.best_and_worst(feedback(spark, base)).withColumn("success_rate", F.round("success_rate", 9))


@register("needs_review", with_feedback("""
SELECT template_id, uses, round(success_rate, 9) AS success_rate, success_rate < 0.3 AND uses > 10 AS needs_review FROM (
  SELECT template_id, count(*) AS uses, count(*) FILTER (execution_ms < 350) / count(*) AS success_rate
  FROM feedback GROUP BY template_id)"""))
def needs_review(spark, base):
    """Here a use is good when it took less than 350 ms, so that some templates are flagged."""
    rates = feedback(spark, base).groupBy("template_id").agg(
        F.count("*").alias("uses"), (F.count_if(F.col("execution_ms") < 350) / F.count("*")).alias("success_rate"))
    return L.needs_review(rates).withColumn("success_rate", F.round("success_rate", 9))


ERRORS_SQL = """
errors AS (
  SELECT template_id, error, frequency FROM (
    SELECT template_id, left(error, 50) AS error, count(*) AS frequency,
           row_number() OVER (PARTITION BY template_id ORDER BY count(*) DESC, left(error, 50)) AS rn
    FROM feedback WHERE error IS NOT NULL GROUP BY template_id, left(error, 50)) WHERE rn = 1),
slow AS (
  SELECT template_id, avg(execution_ms) AS mean_ms FROM feedback WHERE execution_ms <> 0
  GROUP BY template_id HAVING avg(execution_ms) > 1000)"""


@register("common_error", f"WITH {FEEDBACK_SQL.strip()}, {ERRORS_SQL.strip()} SELECT * FROM errors")
def common_error(spark, base):
    return L.common_errors(feedback(spark, base))


@register("slow_templates", f"""
WITH {FEEDBACK_SQL.strip()}, {ERRORS_SQL.strip()} SELECT template_id, round(mean_ms, 6) AS mean_ms FROM slow""")
def slow_templates(spark, base):
    return L.slow_templates(feedback(spark, base)).withColumn("mean_ms", F.round("mean_ms", 6))


@register("improvement_suggestions", f"""
WITH {FEEDBACK_SQL.strip()}, {ERRORS_SQL.strip()}
SELECT template_id, 'common_error' AS type, 'Most common error: ' || error AS description, frequency FROM errors
UNION ALL
SELECT template_id, 'performance', 'Average execution time is high: ' || CAST(round(mean_ms) AS BIGINT) || 'ms', NULL FROM slow""")
def improvement_suggestions(spark, base):
    return L.improvement_suggestions(feedback(spark, base))


RECENT_SQL = "recent AS (SELECT success FROM feedback ORDER BY ts DESC, event_id DESC LIMIT 50)"


@register("recent_success_rate", f"""
WITH {FEEDBACK_SQL.strip()}, {RECENT_SQL}
SELECT count(*) AS events, round(avg(CAST(success AS DOUBLE)), 9) AS success_rate FROM recent""")
def recent_success_rate(spark, base):
    return L.recent_success_rate(feedback(spark, base)).withColumn("success_rate", F.round("success_rate", 9))


@register("tuned_thresholds", f"""
WITH {FEEDBACK_SQL.strip()}, {RECENT_SQL},
rate AS (SELECT avg(CAST(success AS DOUBLE)) AS r, count(*) AS n FROM recent)
SELECT method, round(CAST(threshold AS DOUBLE) * CASE WHEN r < 0.6 THEN 0.95 WHEN r > 0.9 THEN 1.02 ELSE 1 END, 9) AS threshold
FROM (VALUES ('embedding', 0.75), ('tfidf', 0.65), ('keyword', 0.55)) t(method, threshold), rate WHERE n >= 50""")
def tuned_thresholds(spark, base):
    pairs = F.create_map(*(F.lit(x) for pair in THRESHOLDS.items() for x in pair))
    thresholds = spark.range(1).select(F.explode(pairs).alias("method", "threshold"))
    return L.tuned_thresholds(feedback(spark, base), thresholds).withColumn("threshold", F.round("threshold", 9))


@register("running_mean_ms", with_feedback("""
SELECT request_id, round(sum(ms) OVER w, 2) / count(*) OVER w AS running_mean_ms FROM requests
WINDOW w AS (ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING)"""))
def running_mean_ms(spark, base):
    return L.running_mean_ms(requests(spark, base)).select(
        "request_id", (F.round("total_ms", 2) / F.col("n")).alias("running_mean_ms"))


@register("ema_success_rate", with_feedback("""
SELECT template_id, uses, round(pow(0.9, uses) + sum(CASE WHEN success THEN 0.1 * pow(0.9, uses - i) ELSE 0 END), 9) AS success_rate
FROM (SELECT template_id, success, count(*) OVER (PARTITION BY template_id) AS uses,
             row_number() OVER (PARTITION BY template_id ORDER BY ts, event_id) AS i FROM feedback)
GROUP BY template_id, uses"""))
def ema_success_rate(spark, base):
    return L.ema_success_rate(feedback(spark, base)).withColumn("success_rate", F.round("success_rate", 9))


@register("adaptive_success_rate", with_feedback("""
SELECT template_id, n AS uses, round(list_reduce(steps, lambda acc, e: {'a': 0.0, 'b': acc.b * e.a + e.b}, {'a': 0.0, 'b': 1.0}).b, 9) AS success_rate
FROM (
  SELECT template_id, max(u) AS n, list({'a': 1 - 1 / (1 + ln(1 + u)), 'b': CASE WHEN success THEN 1 / (1 + ln(1 + u)) ELSE 0 END} ORDER BY ts, event_id) AS steps
  FROM (SELECT *, CAST(count(*) FILTER (used) OVER (PARTITION BY template_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS u FROM feedback)
  GROUP BY template_id)"""))
def adaptive_success_rate(spark, base):
    kind = F.col("event_type")
    log = table(spark, base, "events").select(
        F.col("user_id").alias("template_id"), "ts", "event_id",
        kind.isin("view", "click", "purchase").alias("used"), (kind != "error").alias("success"))
    return L.adaptive_success_rate(log).withColumn("success_rate", F.round("success_rate", 9))


@register("retain_top_templates", f"""
WITH {TFIDF_SQL.strip()}
SELECT template_id, round(quality, 9) AS quality FROM quality ORDER BY quality DESC, template_id LIMIT 5""")
def retain_top_templates(spark, base):
    types = F.size(F.array_distinct(F.transform("slots", lambda s: s["type"])))
    quality = template_quality(F.col("success_rate"), F.col("usage_count"), F.col("last_used"), types, F.lit(AS_OF))
    return L.retain_top(used_templates(spark, base), quality, 5).select(
        "template_id", F.round("quality", 9).alias("quality"))


@register("stream_metrics", with_feedback("""
SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, count(*) AS requests, count(*) FILTER (hit) AS hits,
       count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit) / count(*), 9) AS hit_rate, round(avg(ms), 6) AS mean_ms
FROM requests GROUP BY 1"""))
def stream_metrics(spark, base):
    """Batch twin of the windowed stream metrics."""
    return windowed_metrics(requests(spark, base)).select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "requests", "hits", "misses",
        F.round("hit_rate", 9).alias("hit_rate"), F.round("mean_ms", 6).alias("mean_ms"))
