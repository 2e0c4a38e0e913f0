"""The batch jobs on live logs.

Windowed metrics are a plain streaming aggregation, template rates keyed state.
The other jobs run their batch plan on every micro-batch. All write under the
batch id, so a replayed batch replaces its own output and nothing is counted
twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hourlens.plans.extraction import find_mentions, mentions_long
from hourlens.plans.maintenance import learn
from hourlens.schemas import TEMPLATES

RATES = "template_id BIGINT, uses BIGINT, success_rate DOUBLE"


def windowed_metrics(requests: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests, hits, misses, hit rate and mean ms per tumbling window; later rows than ``late`` are dropped.

    Works on a stream and on a table alike.
    """
    source = requests.withColumn("ts", F.col("ts").cast("timestamp"))
    if source.isStreaming:
        source = source.withWatermark("ts", late)
    total, hits = F.count("*"), F.count_if("hit")
    return source.groupBy(F.window("ts", width).alias("w")).agg(
        total.alias("requests"), hits.alias("hits"), (total - hits).alias("misses"),
        (hits / total).alias("hit_rate"), F.avg("ms").alias("mean_ms"),
    ).select(F.col("w.start").alias("window_start"), "requests", "hits", "misses", "hit_rate", "mean_ms")


def _start(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], **trigger) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def _version(path: str, batch: int) -> str:
    return f"{path}/batch={batch}"


def _earlier(spark: SparkSession, path: str, schema: str, batch: int) -> DataFrame:
    """Rows written under smaller batch ids (none before the first batch)."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return spark.createDataFrame([], f"{schema}, batch BIGINT")
    return spark.read.schema(f"{schema}, batch BIGINT").parquet(path).where(F.col("batch") < batch)


def start_extraction(
    questions: DataFrame, dictionary: DataFrame, aliases: DataFrame | None, out: str, checkpoint: str,
    chinese: bool = True, **trigger,
) -> StreamingQuery:
    """Mentions of a question stream, appended to ``out``."""
    def each(batch: DataFrame, number: int) -> None:
        found = mentions_long(find_mentions(batch, dictionary, aliases, chinese=chinese))
        found.write.mode("overwrite").parquet(_version(out, number))

    return _start(questions, checkpoint, each, **trigger)


def start_feedback(feedback: DataFrame, out: str, checkpoint: str, late: str = "1 day", **trigger) -> StreamingQuery:
    """Feedback events appended once each, however often they are sent within ``late``.

    The ids of the last ``late`` are in the state store, so nothing is looked
    up in what was written before. A batch that is run again after a failure
    replaces its own folder.
    """
    def each(batch: DataFrame, number: int) -> None:
        batch.drop("_at").write.mode("overwrite").parquet(_version(out, number))

    events = feedback.withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", late)
    return _start(events.dropDuplicatesWithinWatermark(["event_id"]), checkpoint, each, **trigger)


_STATE = "uses LONG, rate DOUBLE, ms ARRAY<LONG>, ids ARRAY<LONG>, values ARRAY<DOUBLE>"


def _rate_state(alpha: float, start: float):
    """Exponential success rate of one template; events that earlier ones may still precede are kept apart.

    The state holds uses and rate up to the watermark, and the events behind
    it. A timeout at the newest of these settles what has become certain;
    every answer is the settled rate with the open events folded onto it in
    their order.
    """

    def fold(uses: int, rate: float, events: list[tuple]) -> tuple[int, float]:
        for _, _, value in events:
            uses, rate = uses + 1, (1 - alpha) * rate + alpha * value
        return uses, rate

    def update(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        uses, rate, *kept = state.get if state.exists else (0, float(start), [], [], [])
        new = [] if state.hasTimedOut else [
            (int(t.value // 1_000_000), int(i), float(v)) for part in parts
            for t, i, v in zip(part["at"], part["event_id"], part["success"])]
        events = sorted([*zip(*kept), *new])
        until = state.getCurrentWatermarkMs()
        certain = sum(e[0] < until for e in events)
        uses, rate = fold(uses, rate, events[:certain])
        rest = events[certain:]
        state.update((uses, rate, *([list(c) for c in zip(*rest)] if rest else ([], [], []))))
        if rest:
            state.setTimeoutTimestamp(max(rest[-1][0], until) + 1)
        uses, rate = fold(uses, rate, rest)
        yield pd.DataFrame({"template_id": [key[0]], "uses": [uses], "success_rate": [rate]})

    return update


def start_template_rates(feedback: DataFrame, out: str, checkpoint: str, alpha: float = 0.1, start: float = 1.0,
                         late: str = "1 day", **trigger) -> StreamingQuery:
    """Running exponential success rate per template in keyed state; each batch appends the templates it changed.

    Events (template_id, ts, event_id, success) may come in any order: those
    within ``late`` of the newest are folded again when one comes in before
    them, older ones are settled, and what is later still is dropped by the
    watermark, as in every stream. An event without success counts as failed.
    State lives in the state store under ``checkpoint``, which recovers it.
    """
    events = feedback.select(
        "template_id", F.col("ts").cast("timestamp").alias("at"), F.col("event_id").cast("long").alias("event_id"),
        F.coalesce(F.col("success").cast("double"), F.lit(0.0)).alias("success")).withWatermark("at", late)
    rates = events.groupBy("template_id").applyInPandasWithState(
        _rate_state(alpha, start), RATES, _STATE, "update", GroupStateTimeout.EventTimeTimeout)

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(_version(out, number))

    return (rates.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def current_rates(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of every template in what the batches appended."""
    rows = spark.read.schema(f"{RATES}, batch BIGINT").parquet(path)
    return rows.groupBy("template_id").agg(F.max_by(F.struct("uses", "success_rate"), "batch").alias("r")).select(
        "template_id", "r.*")


def start_learning(
    generated: DataFrame, templates: DataFrame, dictionary: DataFrame, aliases: DataFrame | None,
    out: str, checkpoint: str, **trigger,
) -> StreamingQuery:
    """New valid templates from a stream of (question_id, ts, text, sql); known skeletons add nothing."""
    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = templates.unionByName(_earlier(spark, out, TEMPLATES, number).drop("batch"))
        extracted = find_mentions(batch.drop("sql"), dictionary, aliases)
        new = learn(batch.select("question_id", "sql"), extracted, known)
        new.write.mode("overwrite").parquet(_version(out, number))

    return _start(generated, checkpoint, each, **trigger)
