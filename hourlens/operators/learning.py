"""Template statistics from feedback and request logs.

Counting statistics are plain aggregates with map-side combining. The two
order-dependent rates are linear recurrences r <- a r + b; they are composed
slice by slice of equal size, so a template that owns a third of the log, or
one hour of it that does, is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourlens.operators.windows import even_slices, running_sums

ORDER = ["ts", "event_id"]


def hour_of(ts: str = "ts") -> Column:
    return F.date_trunc("hour", F.col(ts))


def append_feedback(log: DataFrame, new: DataFrame) -> DataFrame:
    """The log plus the events it does not hold yet; sending an event twice changes nothing."""
    fresh = new.dropDuplicates(["event_id"]).join(log.select("event_id"), "event_id", "left_anti")
    return log.unionByName(fresh)


def write_feedback(new: DataFrame, path: str) -> None:
    new.write.mode("append").parquet(path)


def feedback_of(log: DataFrame, template_id: int) -> DataFrame:
    """Events of one template that carry an error or a non-zero time."""
    timed = F.col("execution_ms").isNotNull() & (F.col("execution_ms") != 0)
    return log.where((F.col("template_id") == template_id) & (F.col("error").isNotNull() | timed))


def cache_metrics(requests: DataFrame, templates: DataFrame) -> DataFrame:
    """Requests, hits, misses, hit rate (0 without requests), mean ms and number of templates."""
    size = templates.agg(F.count("*").alias("n")).scalar()
    total = F.count("*")
    hits = F.count_if("hit")
    return requests.agg(
        total.alias("requests"), hits.alias("hits"), (total - hits).alias("misses"),
        F.coalesce(hits / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("hit_rate"),
        F.avg("ms").alias("mean_ms"),
    ).select("*", size.alias("templates"))


def feedback_summary(log: DataFrame) -> DataFrame:
    total, good = F.count("*"), F.count_if("success")
    return log.agg(
        total.alias("total"), good.alias("successes"),
        F.coalesce(good / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("success_rate"))


def success_rates(log: DataFrame, min_uses: int = 5, best: float = 0.8, worst: float = 0.3) -> DataFrame:
    """Successes, failures and rate per template with enough uses; ``grade`` is best, worst or NULL."""
    counts = log.groupBy("template_id").agg(
        F.count_if("success").alias("successes"), F.count_if(~F.col("success")).alias("failures"))
    uses = F.col("successes") + F.col("failures")
    rate = F.col("successes") / uses
    return counts.where(uses >= min_uses).select(
        "*", rate.alias("success_rate"),
        F.when(rate >= best, "best").when(rate <= worst, "worst").alias("grade"))


def best_and_worst(log: DataFrame, n: int = 5, **limits: float) -> DataFrame:
    """The n best and the n worst graded templates, ranked from 1 within their grade."""
    rated = success_rates(log, **limits).where(F.col("grade").isNotNull())
    key = F.when(F.col("grade") == "best", -F.col("success_rate")).otherwise(F.col("success_rate"))
    order = Window.partitionBy("grade").orderBy(key, "template_id")
    ranked = rated.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.select("grade", "rank", "template_id", "success_rate")


def needs_review(rates: DataFrame, below: float = 0.3, more_than: int = 10) -> DataFrame:
    """Add ``needs_review`` to (template_id, uses, success_rate) rows."""
    return rates.withColumn("needs_review", (F.col("success_rate") < below) & (F.col("uses") > more_than))


def common_errors(log: DataFrame, width: int = 50) -> DataFrame:
    """Most frequent error of each template by its first characters; ties by text."""
    counted = log.where(F.length("error") > 0).groupBy(
        "template_id", F.substring("error", 1, width).alias("error")
    ).agg(F.count("*").alias("n"))
    # Smallest (-n, text) is the most frequent error with ties by text.
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("error").alias("error"))).alias("b")
    return counted.groupBy("template_id").agg(best).select(
        "template_id", F.col("b.error").alias("error"), (-F.col("b.neg")).alias("frequency"))


def slow_templates(log: DataFrame, limit_ms: float = 1000.0) -> DataFrame:
    """Templates whose mean time, zero and NULL left out, exceeds the limit."""
    timed = log.where(F.col("execution_ms") != 0)
    means = timed.groupBy("template_id").agg(F.avg("execution_ms").alias("mean_ms"))
    return means.where(F.col("mean_ms") > limit_ms)


def improvement_suggestions(log: DataFrame, limit_ms: float = 1000.0) -> DataFrame:
    """(template_id, type, description, frequency) from common errors and slow templates."""
    errors = common_errors(log).select(
        "template_id", F.lit("common_error").alias("type"),
        F.concat(F.lit("Most common error: "), "error").alias("description"), "frequency")
    slow = slow_templates(log, limit_ms).select(
        "template_id", F.lit("performance").alias("type"),
        F.concat(F.lit("Average execution time is high: "), F.round("mean_ms").cast("bigint").cast("string"),
                 F.lit("ms")).alias("description"),
        F.lit(None).cast("bigint").alias("frequency"))
    return errors.unionByName(slow)


def recent_success_rate(log: DataFrame, last: int = 50) -> DataFrame:
    """Events and success rate of the last ``last`` feedback events of the whole log."""
    recent = log.orderBy(F.desc("ts"), F.desc("event_id")).limit(last)
    return recent.agg(
        F.count("*").alias("events"), F.avg(F.col("success").cast("double")).alias("success_rate"))


def tuned_thresholds(log: DataFrame, thresholds: DataFrame, last: int = 50) -> DataFrame:
    """Thresholds x 0.95 after many failures, x 1.02 after many successes; no rows below ``last`` events."""
    recent = recent_success_rate(log, last)
    rate = recent.select("success_rate").scalar()
    enough = recent.select("events").scalar() >= last
    factor = F.when(rate < 0.6, 0.95).when(rate > 0.9, 1.02).otherwise(1.0)
    return thresholds.where(enough).withColumn("threshold", F.col("threshold") * factor)


def running_mean_ms(requests: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Requests, total and mean response time up to and including each request of the whole log."""
    sums = running_sums(
        requests, [], ["ts", "request_id"], chunk,
        {"n": F.lit(1), "total_ms": F.col("ms")})
    return sums.withColumn("running_mean_ms", F.col("total_ms") / F.col("n"))


def ema_slices(log: DataFrame, alpha: float = 0.1, chunk: Column | None = None) -> DataFrame:
    """(template_id, _chunk, uses, a, b): the moving average over a slice as a map r -> a r + b.

    Inside a slice the weight of an event is (1 - alpha) to the number of later events.
    """
    sliced = even_slices(log, ["template_id"], ORDER) if chunk is None else log.withColumn("_chunk", chunk)
    later = F.row_number().over(
        Window.partitionBy("template_id", "_chunk").orderBy(F.desc("ts"), F.desc("event_id"))) - 1
    weight = alpha * F.pow(F.lit(1 - alpha), later)
    parts = sliced.withColumn("_b", weight * F.col("success").cast("double")).groupBy("template_id", "_chunk").agg(
        F.count("*").alias("uses"), F.sum("_b").alias("b"))
    return parts.withColumn("a", F.pow(F.lit(1 - alpha), F.col("uses")))


def ema_success_rate(log: DataFrame, alpha: float = 0.1, start: float = 1.0, chunk: Column | None = None) -> DataFrame:
    """Final exponential moving average per template, r <- (1 - alpha) r + alpha x, oldest event first."""
    return _fold_slices(ema_slices(log, alpha, chunk), start)


def _fold_slices(parts: DataFrame, start: float) -> DataFrame:
    """(template_id, uses, success_rate) from per-slice maps r -> a r + b, in slice order.

    What a slice adds is kept by the maps behind it: products of their a, as
    sums of logarithms, nothing behind a slice with a = 0 that lies later.
    """
    later = Window.partitionBy("template_id").orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    ln = F.when(F.col("a") > 0, F.log(F.when(F.col("a") > 0, F.col("a")))).otherwise(0.0)
    marked = parts.withColumns({"_ln": ln, "_zero": (F.col("a") <= 0).cast("int")})

    def kept(logs: Column, zeros: Column) -> Column:
        return F.when(F.coalesce(zeros, F.lit(0)) > 0, 0.0).otherwise(F.exp(F.coalesce(logs, F.lit(0.0))))

    added = marked.withColumn("_add", F.col("b") * kept(F.sum("_ln").over(later), F.sum("_zero").over(later)))
    return added.groupBy("template_id").agg(
        F.sum("uses").alias("uses"),
        (F.sum("_add") + start * kept(F.sum("_ln"), F.sum("_zero"))).alias("success_rate"))


def adaptive_success_rate(uses: DataFrame, start: float = 1.0, chunk: Column | None = None) -> DataFrame:
    """Success rate with a learning rate that falls with use: lr = 1 / (1 + ln(1 + uses)).

    ``uses`` is the merged log of uses and feedback: template_id, ts, event_id,
    ``used`` (the event is a use) and ``success`` (NULL when it gives no
    feedback). A feedback sees the uses up to and including its own event.
    """
    counted = running_sums(
        uses, ["template_id"], ORDER, chunk,
        {"_uses": F.col("used").cast("int")}, keep_chunk=True)
    rate = F.when(F.col("success").isNotNull(), 1 / (1 + F.log1p("_uses"))).otherwise(0.0)
    keep = 1 - F.col("_lr")
    learned = counted.withColumn("_lr", rate).withColumn(
        "_ln", F.when(keep > 0, F.log(F.when(keep > 0, keep))).otherwise(0.0)
    ).withColumn("_reset", (keep <= 0).cast("int"))
    # Later events of the slice: a reset (learning rate 1) wipes out what came before it.
    later = (
        Window.partitionBy("template_id", "_chunk").orderBy(F.desc("ts"), F.desc("event_id"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    kept = F.when(F.coalesce(F.sum("_reset").over(later), F.lit(0)) > 0, 0.0).otherwise(
        F.exp(F.coalesce(F.sum("_ln").over(later), F.lit(0.0))))
    success = F.coalesce(F.col("success").cast("double"), F.lit(0.0))
    parts = learned.withColumn("_b", F.col("_lr") * success * kept).groupBy("template_id", "_chunk").agg(
        F.sum(F.col("used").cast("int")).alias("uses"), F.sum("_b").alias("b"),
        F.when(F.sum("_reset") > 0, 0.0).otherwise(F.exp(F.sum("_ln"))).alias("a"))
    return _fold_slices(parts, start)


def retain_top(templates: DataFrame, quality: Column, n: int) -> DataFrame:
    """At most n templates, best quality first, ties by id."""
    return templates.withColumn("quality", quality).orderBy(F.desc("quality"), "template_id").limit(n)
