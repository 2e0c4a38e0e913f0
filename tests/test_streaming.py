import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hourlens import schemas
from hourlens.operators.learning import ema_success_rate
from hourlens.plans.extraction import find_mentions, mentions_long
from hourlens.schemas import TEMPLATES
from hourlens.sources.templates import library
from hourlens.streaming import jobs as J
from tests.conftest import ask, rows

T0 = dt.datetime(2024, 1, 1)


def as_stream(spark, parts, path):
    """One file per part, read one file per micro-batch in order."""
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_extraction_stream_equals_batch(spark, dictionary, tmp_path):
    log = ask(spark, "Alex Stone in Q1 2025", "Sam Reed on the Mobile App", "nothing", "Robin Vale last year")
    stream = as_stream(spark, [log.where("question_id < 2"), log.where("question_id >= 2")], tmp_path / "in")
    J.start_extraction(stream, dictionary, None, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    columns = ("question_id", "entity_type", "ordinal", "value", "normalized")
    assert rows(spark.read.parquet(str(tmp_path / "out")), *columns) == rows(mentions_long(find_mentions(log, dictionary)), *columns)


def test_rates_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    log = spark.createDataFrame(
        [(rng.choice([1, 1, 2, 3]), i, T0 + dt.timedelta(minutes=7 * i), rng.random() < 0.5, 1.0, None) for i in range(90)], schemas.FEEDBACK)
    stream = as_stream(spark, [log.where(f"event_id >= {lo} AND event_id < {lo + 30}") for lo in (0, 30, 60)], tmp_path / "in")
    J.start_template_rates(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.template_id: (r.uses, r.success_rate) for r in J.current_rates(spark, str(tmp_path / "out")).collect()}
    want = {r.template_id: (r.uses, pytest.approx(r.success_rate)) for r in ema_success_rate(log).collect()}
    assert got == want


def test_feedback_is_appended_once(spark, tmp_path):
    """Events sent again in the same and in a later batch, and a batch that is run again from its checkpoint."""
    log = spark.createDataFrame(
        [(i % 3, i, T0 + dt.timedelta(minutes=5 * i), i % 2 == 0, 1.0, None) for i in range(40)], schemas.FEEDBACK)
    parts = [log.where("event_id < 25").union(log.where("event_id < 5")), log.where("event_id >= 20"), log.where("event_id > 30")]
    out, progress = str(tmp_path / "out"), str(tmp_path / "cp")
    J.start_feedback(as_stream(spark, parts, tmp_path / "in"), out, progress).awaitTermination()
    assert rows(spark.read.parquet(out), "event_id") == sorted(((i,) for i in range(40)), key=str)
    # The last batch was written but not committed: it runs again and replaces its folder.
    commits = sorted(p for p in (tmp_path / "cp" / "commits").iterdir() if p.name.isdigit())
    for file in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        file.unlink(missing_ok=True)
    J.start_feedback(spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")),
                     out, progress).awaitTermination()
    assert rows(spark.read.parquet(out), "event_id") == sorted(((i,) for i in range(40)), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_rates_do_not_depend_on_the_split_or_order_of_the_log(spark, tmp_path, seed):
    """Batches that overlap in time, events out of order within the lateness, one template with most of the rows."""
    rng = random.Random(seed)
    events = [(rng.choice([1, 1, 1, 1, 2, 3]), i, T0 + dt.timedelta(minutes=11 * i), rng.random() < 0.5, 1.0, None) for i in range(300)]
    log = spark.createDataFrame(events, schemas.FEEDBACK)
    order = sorted(range(300), key=lambda i: i + rng.uniform(0, 100))  # up to 100 events, under a day, too late
    parts = [spark.createDataFrame([events[i] for i in order[lo:lo + 75]], schemas.FEEDBACK) for lo in range(0, 300, 75)]
    J.start_template_rates(as_stream(spark, parts, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.template_id: (r.uses, r.success_rate) for r in J.current_rates(spark, str(tmp_path / "out")).collect()}
    want = {}
    for template, _, _, success, _, _ in events:
        uses, rate = want.get(template, (0, 1.0))
        want[template] = uses + 1, 0.9 * rate + 0.1 * success
    assert got == {k: (n, pytest.approx(r, abs=1e-12)) for k, (n, r) in want.items()}
    # The stream goes on from its state where it was stopped.
    more = spark.createDataFrame([(1, 900, T0 + dt.timedelta(days=4), True, 1.0, None)], schemas.FEEDBACK)
    J.start_template_rates(as_stream(spark, [more], tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    after = {r.template_id: (r.uses, r.success_rate) for r in J.current_rates(spark, str(tmp_path / "out")).collect()}
    uses, rate = want[1]
    assert after[1] == (uses + 1, pytest.approx(0.9 * rate + 0.1, abs=1e-12)) and after[2] == got[2]


def test_metrics_stream_equals_batch_and_drops_late_rows(spark, tmp_path):
    log = spark.createDataFrame(
        [(i, T0 + dt.timedelta(minutes=10 * i), i % 3 == 0, float(i)) for i in range(30)], schemas.REQUESTS)
    late = spark.createDataFrame([(99, T0, True, 1.0)], schemas.REQUESTS)
    stream = as_stream(spark, [log.where("request_id < 20"), log.where("request_id >= 20"), late], tmp_path / "in")
    J.windowed_metrics(stream).writeStream.outputMode("append").format("memory").queryName("metrics").trigger(
        availableNow=True).start().awaitTermination()
    columns = ("window_start", "requests", "hits", "misses", "mean_ms")
    got = rows(spark.table("metrics"), *columns)
    want = rows(J.windowed_metrics(log), *columns)
    assert got == want[: len(got)] and len(got) >= 4


def test_learning_stream(spark, dictionary, tmp_path):
    log = ask(spark, "Hours of Alex Stone in Q1 2025", "Hours of Robin Vale in Q2 2025", "Days of Sam Reed in Q1 2025")
    sql = F.concat(F.lit("SELECT SUM(h) FROM work_hours WHERE e = '"), F.regexp_extract("text", "of (.*) in", 1),
                   F.lit("' AND period = '"), F.regexp_extract("text", r"(Q\d \d+)", 1), F.lit("'"))
    rows_ = log.withColumn("sql", sql)
    stream = as_stream(spark, [rows_.where("question_id = 0"), rows_.where("question_id > 0")], tmp_path / "in")
    J.start_learning(stream, library(spark), dictionary, None, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.schema(TEMPLATES).parquet(str(tmp_path / "out"))
    assert rows(got, "template_query") == [("Days of {employee_0} in {time_period_0}",), ("Hours of {employee_0} in {time_period_0}",)]
