import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from hourlens import schemas
from hourlens.operators import learning as L
from hourlens.operators.windows import even_slices, running_sums

T0 = dt.datetime(2024, 1, 1)


def feedback(spark, events):
    """events: (template_id, minutes, success)."""
    rows = [(t, i, T0 + dt.timedelta(minutes=m), s, 5.0, None if s else f"failed {i % 2}") for i, (t, m, s) in enumerate(events)]
    return spark.createDataFrame(rows, schemas.FEEDBACK)


@pytest.fixture(scope="module")
def events():
    rng = random.Random(1)
    # Template 1 holds most of the log, many events share a minute.
    return [(1 if rng.random() < 0.7 else rng.randrange(2, 5), rng.randrange(600), rng.random() < 0.6) for _ in range(400)]


def in_order(events):
    return [e for _, e in sorted(enumerate(events), key=lambda p: (p[1][1], p[0]))]


def test_ema_equals_fold(spark, events):
    small = feedback(spark, [(1, 0, True), (1, 1, False), (1, 2, True)])
    assert L.ema_success_rate(small).first().success_rate == pytest.approx(0.91)
    rates = {}
    for t, _, s in in_order(events):
        rates[t] = 0.9 * rates.get(t, 1.0) + 0.1 * s
    got = {r.template_id: r for r in L.ema_success_rate(feedback(spark, events)).collect()}
    for t, rate in rates.items():
        assert got[t].success_rate == pytest.approx(rate, abs=1e-12)
        assert got[t].uses == sum(e[0] == t for e in events)


@pytest.mark.parametrize("first_use", [True, False])
def test_adaptive_equals_fold(spark, events, first_use):
    log = feedback(spark, events).withColumn("used", F.lit(True) if first_use else F.col("event_id") % 3 == 0)
    log = log.withColumn("success", F.when(F.col("event_id") % 5 != 0, F.col("success")))
    uses, rates = {}, {}
    for t, _, _, i, s in sorted((t, m, i, i, s) for i, (t, m, s) in enumerate(events)):
        uses[t] = uses.get(t, 0) + (first_use or i % 3 == 0)
        if i % 5:
            lr = 1 / (1 + math.log1p(uses[t]))
            rates[t] = (1 - lr) * rates.get(t, 1.0) + lr * s
    got = {r.template_id: r.success_rate for r in L.adaptive_success_rate(log).collect()}
    assert got == {t: pytest.approx(r, abs=1e-9) for t, r in rates.items()}


def test_adaptive_golden():
    def step(uses, rate, x):
        lr = 1 / (1 + math.log1p(uses))
        return (1 - lr) * rate + lr * x

    assert (step(0, 0.5, 1), round(step(10, 0.5, 0), 6), round(step(11, 0.35, 0), 6)) == (1.0, 0.352850, 0.249567)


def test_running_sums_equal_loop(spark, events):
    log = feedback(spark, events)
    got = running_sums(log, ["template_id"], ["ts", "event_id"], L.hour_of(), {"n": F.lit(1), "good": F.col("success").cast("int")})
    seen, want = {}, {}
    for i, (t, m, s) in sorted(enumerate(events), key=lambda p: (p[1][1], p[0])):
        n, g = seen.get(t, (0, 0))
        seen[t] = want[i] = (n + 1, g + s)
    assert {r.event_id: (r.n, r.good) for r in got.collect()} == want
    whole = L.running_mean_ms(log.select(F.col("event_id").alias("request_id"), "ts", F.lit(True).alias("hit"), F.col("event_id").cast("double").alias("ms")))
    order = [i for i, _ in sorted(enumerate(events), key=lambda p: (p[1][1], p[0]))]
    means = {i: sum(order[: k + 1]) / (k + 1) for k, i in enumerate(order)}
    assert {r.request_id: r.running_mean_ms for r in whole.collect()} == pytest.approx(means)


@pytest.mark.parametrize("rate,count,factor", [(0.5, 50, 0.95), (0.95, 60, 1.02), (0.7, 50, 1.0), (0.5, 49, None)])
def test_tuned_thresholds(spark, rate, count, factor):
    log = feedback(spark, [(1, i, i % 20 < rate * 20) for i in range(count)])
    thresholds = spark.createDataFrame([("keyword", 0.55)], "method STRING, threshold DOUBLE")
    row = L.tuned_thresholds(log, thresholds).first()
    if factor is None:
        assert row is None
    else:
        recent = L.recent_success_rate(log).first()
        want = 0.95 if recent.success_rate < 0.6 else 1.02 if recent.success_rate > 0.9 else 1.0
        assert row.threshold == pytest.approx(0.55 * want) and recent.events == 50


def test_reports_and_suggestions(spark):
    log = feedback(spark, [(1, i, i > 3) for i in range(20)] + [(2, i, False) for i in range(6)] + [(3, 0, True)])
    graded = {r.template_id: r.grade for r in L.success_rates(log).collect()}
    assert graded == {1: "best", 2: "worst"}
    assert [(r.grade, r.rank) for r in L.best_and_worst(log).orderBy("grade").collect()] == [("best", 1), ("worst", 1)]
    assert {r.template_id: (r.error, r.frequency) for r in L.common_errors(log).collect()} == {1: ("failed 0", 2), 2: ("failed 0", 3)}
    assert L.slow_templates(log).count() == 0
    assert L.improvement_suggestions(log.withColumn("execution_ms", F.lit(1500.4))).where("type = 'performance'").first().description.endswith("1500ms")
    flags = L.needs_review(spark.createDataFrame([(1, 11, 0.29), (2, 10, 0.1)], "template_id INT, uses INT, success_rate DOUBLE"))
    assert {r.template_id: r.needs_review for r in flags.collect()} == {1: True, 2: False}


def test_append_is_idempotent(spark):
    log = feedback(spark, [(1, 0, True), (1, 1, False)])
    assert L.append_feedback(log, log.union(log)).count() == 2


def test_metrics_of_an_empty_log(spark):
    requests = spark.createDataFrame([], schemas.REQUESTS)
    row = L.cache_metrics(requests, spark.range(3)).first()
    assert (row.requests, row.hits, row.hit_rate, row.mean_ms, row.templates) == (0, 0, 0.0, None, 3)
    assert L.feedback_summary(feedback(spark, [(1, 0, True)]).where("false")).first().success_rate == 0.0


def test_one_hour_of_one_template_lies_over_several_slices(spark):
    """Slices of equal size in order of key and time, whatever the hour; the rates folded over them equal a loop."""
    rng = random.Random(4)
    hour = dt.datetime(2024, 1, 1, 5)
    events = [(1 if i % 10 else 2, i, hour + dt.timedelta(milliseconds=rng.choice([0, i])), rng.random() < 0.4, 1.0, None) for i in range(2000)]
    log = spark.createDataFrame(events, schemas.FEEDBACK).repartition(5)
    sliced = even_slices(log, ["template_id"], ["ts", "event_id"], rows=90)
    sliced.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/slices-{rng.random()}")
    sliced = spark.read.parquet(path)
    sizes = sliced.groupBy("template_id", "_chunk").count().collect()
    assert max(r["count"] for r in sizes) <= 90 and sum(r.template_id == 1 for r in sizes) >= 20
    placed = sorted((r.template_id, r.ts, r.event_id, r._chunk) for r in sliced.collect())
    for template in (1, 2):
        chunks = [c for t, _, _, c in placed if t == template]
        assert chunks == sorted(chunks)
    want = {}
    for template, _, _, success, _, _ in sorted(events, key=lambda e: (e[0], e[2], e[1])):
        uses, rate = want.get(template, (0, 1.0))
        want[template] = uses + 1, 0.9 * rate + 0.1 * success
    for chunk in (F.col("_chunk"), None):
        rows_ = L.ema_success_rate(sliced if chunk is not None else log, chunk=chunk).collect()
        assert {r.template_id: (r.uses, r.success_rate) for r in rows_} == {k: (n, pytest.approx(r, abs=1e-9)) for k, (n, r) in want.items()}
