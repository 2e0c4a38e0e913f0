"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourlens.llm.shared import written

#: Rows of one source that are sorted together, about; larger sources are cut into more slices of the key's range.
SLICE = 8_000


def size_of(text: Column) -> Column:
    """Words of a text: runs of characters other than space and the controls 9 to 13 (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], most: float) -> DataFrame:
    """Add ``target`` to (source, source_size, n_units).

    Sources by code point, null last, weigh ``weights``, repeating, and share
    the sum of all sizes. No target is above ``most`` times its source's size;
    the excess is shared by weight among the rest until none is above, which
    is what this loop repeats: it fixes those above and divides what is left.
    Every round fixes a source or ends. Sources, not documents, are ordered by
    one window here.
    """
    place = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int"))
    state = written(sources.withColumn("weight", weight).withColumn(
        "most", F.col("source_size") * float(most)), "sources")
    total, level = state.agg(F.sum("source_size")).first()[0] or 0, 0.0
    while True:
        full = F.col("most") <= F.col("weight") * level
        fixed, open_weight = state.agg(
            F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        new = (total - fixed) / open_weight if open_weight else math.inf
        if new <= level or math.isinf(new):
            break
        level = new
    share = F.least(F.col("most"), F.col("weight") * level) if total else F.lit(0.0)
    return state.select("source", "source_size", "n_units", share.alias("target"))


def sliced(units: DataFrame, plan: DataFrame) -> DataFrame:
    """Units (source, unit, rate, ...) with ``rest`` of their source's plan and ``slice``, its keys' range cut evenly.

    A key with rate r is above x with a chance of exp(-r x), so the mean of
    that over a source's rates, 1 - G(x), spreads its keys evenly over 0 to 1 in
    their order. Rates are counted in bins 10 % wide, a few per source; the
    bins decide how even the slices are, never what is taken.
    """
    bins = units.groupBy("source", F.round(F.log("rate"), 1).alias("ln")).agg(F.count("*").alias("n"))
    shape = written(bins.groupBy(F.col("source").alias("known_source")).agg(
        F.collect_list(F.struct(F.exp("ln").alias("rate"), F.col("n").cast("double").alias("n"))).alias("bins"),
        F.sum("n").cast("double").alias("total")), "shape")
    known = plan.select(F.col("source").alias("plan_source"), "slices", "rest")
    above = F.aggregate("bins", F.lit(0.0), lambda s, b: s + b["n"] * F.exp(-b["rate"] * F.col("unit.key"))) / F.col("total")
    place = F.least(F.floor((1 - above) * F.col("slices")), F.col("slices") - 1)
    return units.join(known, F.col("source").eqNullSafe(F.col("plan_source"))).join(
        shape, F.col("source").eqNullSafe(F.col("known_source"))).withColumn(
        "slice", F.greatest(place, F.lit(0))).drop("plan_source", "known_source", "bins", "total")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 0) -> DataFrame:
    """How often the mix takes each row of ``docs`` (doc_id, source, size, quality; see :func:`size_of`).

    Adds source_size, target, copies and taken (size times copies); other
    columns are kept, so none of them may have one of these names. A source
    whose target is above its size is first taken whole as often as that fits.
    The rest of the target is filled in the order of exponential keys,
    -ln(u) / quality, with u from a hash of the doc_id: the better a document
    is, the likelier. A document is taken if at least half of it fits, so each
    source ends within half a document of its target, and no document is taken
    more than ``most`` times. The same rows give the same result.

    Only (source, key, doc_id, size) is sorted and shuffled. A source is cut
    into slices of the keys' range, as many as its number of rows asks for;
    slices are sorted apart, each begins where the sums of those before it
    end. What the mix takes of a source is then all rows up to one key.

    Size 0 is taken or not like others; null sources are a source, the last;
    quality that is null or not positive counts as 1; rows of one source with
    equal doc_id, size and quality go together, as one document of their
    summed size; empty tables give no rows.
    """
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") + 0.5) / float(1 << 53)
    rate = F.when(F.col("quality") > 0, F.col("quality")).otherwise(1.0)
    key = -F.log(u) / rate
    order = F.struct(key.alias("key"), F.coalesce("doc_id", F.lit(-1 << 63)).alias("doc_id"), F.col("size"))
    units = written(docs.groupBy("source", order.alias("unit")).agg(
        F.count("*").alias("n"), F.max(rate).alias("rate")), "units").withColumn("words", F.col("n") * F.col("unit.size"))
    plan = targets(units.groupBy("source").agg(F.sum("words").alias("source_size"), F.count("*").alias("n_units")),
                   weights, most)
    plan = written(plan.withColumns({
        "epochs": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0),
        "slices": F.ceil(F.col("n_units") / float(SLICE)),
    }).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "plan")
    units = sliced(units, plan)
    sums = written(units.groupBy("source", "slice").agg(F.sum("words").alias("words")), "slices")
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("at_source"), F.col("slice").alias("at_slice"),
                         F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "slice").orderBy("unit").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    middle = F.col("start") + F.sum("words").over(inside) - F.col("words") / 2
    last = units.join(
        starts, F.col("source").eqNullSafe(F.col("at_source")) & (F.col("slice") == F.col("at_slice"))
    ).withColumn("middle", middle).where((F.col("middle") <= F.col("rest")) & (F.col("rest") > 0)).groupBy(
        "source").agg(F.max("unit").alias("_last")).withColumnRenamed("source", "_last_source")
    ends = written(plan.join(last, F.col("source").eqNullSafe(F.col("_last_source")), "left").select(
        F.col("source").alias("_source"), "source_size", "target", F.col("epochs").alias("_epochs"), "_last"), "ends")
    copies = F.col("_epochs") + F.coalesce(order <= F.col("_last"), F.lit(False)).cast("int")
    return docs.join(ends, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "copies", F.least(copies, F.lit(most)).cast("long")).withColumn(
        "taken", F.col("copies") * F.col("size")).drop("_source", "_epochs", "_last")


def quality_of(text: Column) -> Column:
    """Quality weight of a text, 0.1 to 1: less for each character that is neither letter nor white space.

    Null and empty texts weigh 1.
    """
    signs = F.try_divide(F.regexp_count(text, F.lit("[^\\p{L}\\s]")), F.length(text))
    return F.coalesce(F.greatest(F.lit(0.1), 1 - 3 * signs), F.lit(1.0))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source, and any others), with all columns, as often as the mix takes them.

    Null and empty texts have size 0 and are taken or not like others; null
    sources are a source; equal rows go together; an empty table gives an empty
    table. Columns may have any names.
    """
    rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"),
                       quality_of(F.col("text")).alias("quality"), F.struct(*docs.columns).alias("row"))
    taken = mix(rows, weights, most, seed).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
