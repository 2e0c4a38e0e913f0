import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hourlens.llm import mixing
from hourlens.llm.mixing import mix, mixed, quality_of, size_of, targets


def fill(sizes, weights=(1, 2, 3), most=3):
    """Targets by repeating the rule until no target is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, left = {}, set(names)
    while left:
        total = sum(sizes.values()) - sum(fixed.values())
        share = {s: total * weight[s] / sum(weight[x] for x in left) for s in left}
        above = {s for s in left if share[s] > most * sizes[s]}
        if not above:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in above}
        left -= above
    return fixed


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 1, "c": 1000, None: 7, "é": 30}, {"a": 5}, {"b": 1, "a": 0, "c": 1_000_000}, {"x": 10, "y": 10}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_units long")
    got = {r.source: r.target for r in targets(rows, (1, 2, 3), 3).collect()}
    assert got == pytest.approx(fill(sizes))


def documents(spark, n=3000):
    rows = spark.range(n).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(
            F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"),
        (F.pmod(F.xxhash64("id"), F.lit(90)) + 1).alias("size"), F.lit(1.0).alias("quality"))
    return rows


@pytest.mark.parametrize("slice_", [50, 100_000])
def test_mix_meets_targets(spark, monkeypatch, slice_):
    monkeypatch.setattr(mixing, "SLICE", slice_)
    docs = documents(spark)
    rows = mix(docs).collect()
    assert len(rows) == 3000
    sizes, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        target[r.source] = r.target
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
    assert target == pytest.approx(fill(sizes))
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s]
    again = {r.doc_id: r.taken for r in mix(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_slices_do_not_change_the_result(spark, monkeypatch):
    docs = documents(spark, 1000)
    whole = {r.doc_id: r.taken for r in mix(docs).collect()}
    monkeypatch.setattr(mixing, "SLICE", 20)
    assert {r.doc_id: r.taken for r in mix(docs).collect()} == whole


def test_keys_are_those_of_the_method(spark):
    """In a source that is taken in part, what is taken are the smallest keys -ln(u) / quality."""
    docs = documents(spark, 600).withColumn("quality", F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(0.5))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(0), "doc_id"), 11).cast("double") + 0.5) / float(1 << 53)
    rows = mix(docs).withColumn("u", u).where("source = 'hot'").collect()
    keys = sorted((-math.log(r.u) / r.quality, r.copies) for r in rows)
    copies = [c for _, c in keys]
    assert copies == sorted(copies, reverse=True) and 0 < sum(copies) < len(copies)
    better = [r for r in rows if r.copies]
    assert sum(r.quality == 4.0 for r in better) > len(better) / 2


def test_odd_rows(spark, odd, none):
    rows = odd.select("doc_id", "source", size_of(F.col("text")).alias("size"), quality_of(F.col("text")).alias("quality"))
    got = mix(rows).collect()
    assert len(got) == odd.count()
    assert {r.size for r in got if r.doc_id in (1, 2, 3)} == {0}
    again = mixed(odd)
    assert again.columns == odd.columns
    assert again.count() == sum(r.copies for r in got)
    assert mixed(none).collect() == [] and mix(rows.limit(0)).collect() == []


def test_size_counts_runs(spark):
    rows = spark.createDataFrame([("a b c",), ("\x1ca\x0bb\r\n",), (" ",), (None,)], "text string")
    assert [r[0] for r in rows.select(size_of(F.col("text"))).collect()] == [2, 2, 0, 0]


@pytest.mark.parametrize("quality", [0.1, 1.0, None])
def test_slices_are_even_whatever_the_quality(spark, monkeypatch, quality):
    """No slice of a source holds more than three times its share of the rows; None: qualities from 0.1 to 1."""
    monkeypatch.setattr(mixing, "SLICE", 100)
    docs = documents(spark, 6000).withColumn("source", F.lit("one")).withColumn(
        "quality", F.lit(quality) if quality else (F.col("doc_id") % 10 + 1) / 10)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(0), "doc_id"), 11).cast("double") + 0.5) / float(1 << 53)
    units = docs.select("source", F.struct((-F.log(u) / F.col("quality")).alias("key"), "doc_id", "size").alias("unit"),
                        F.col("quality").alias("rate"))
    plan = spark.createDataFrame([("one", 60, 1.0)], "source string, slices long, rest double")
    found = mixing.sliced(units, plan).groupBy("slice").agg(
        F.count("*").alias("n"), F.min("unit.key").alias("low"), F.max("unit.key").alias("high")).orderBy("slice").collect()
    assert len(found) > 50 and max(r.n for r in found) <= 3 * 6000 / 60
    assert all(a.high <= b.low for a, b in zip(found, found[1:]))


def test_whole_result_equals_sorting_in_one_place(spark, monkeypatch):
    """Every document's copies against a plain sort of the exponential keys and a running sum."""
    monkeypatch.setattr(mixing, "SLICE", 40)
    docs = documents(spark, 900).withColumn("quality", F.element_at(F.array(*map(F.lit, (0.1, 0.5, 1.0, 0.0))), (
        F.col("doc_id") % 4 + 1).cast("int")))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(0), "doc_id"), 11).cast("double") + 0.5) / float(1 << 53)
    rows = docs.select("doc_id", "source", "size", "quality", u.alias("u")).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
    wanted, want = fill(sizes), {}
    for source, size in sizes.items():
        epochs = math.floor(wanted[source] / size)
        rest, before = wanted[source] - epochs * size, 0
        for r in sorted((r for r in rows if r.source == source), key=lambda r: (-math.log(r.u) / (r.quality or 1.0), r.doc_id)):
            want[r.doc_id] = epochs + (rest > 0 and before + r.size / 2 <= rest)
            before += r.size
    assert {r.doc_id: r.copies for r in mix(docs).collect()} == want and len(set(want.values())) > 2
