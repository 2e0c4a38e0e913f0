"""Near-duplicate documents: MinHash with banding, checks on signatures and full sets, connected components."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourlens.llm.components import components
from hourlens.llm.shared import drop, release, shingles, small, spare, written


@dataclass(frozen=True)
class Settings:
    """Percent of similarity, words per shingle, and the shape of signatures.

    With 24 bands of 6 minima a pair at 85 % shares no band with a chance of
    1.2 in 100,000. Two signatures of such a pair agree on ``agree`` of their
    minima or less with a chance of 1 in 100,000 (mean 122 of 144, deviation 4.3).
    """

    percent: int = 85
    words: int = 5
    bands: int = 24
    rows: int = 6
    agree: int = 103
    seed: int = 1

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def functions(settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and summands of the universal hash functions x -> a x + b on 32 bits."""
    rng = np.random.default_rng(settings.seed)
    a = rng.integers(0, 1 << 32, settings.hashes, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    return a, rng.integers(0, 1 << 32, settings.hashes, dtype=np.uint64).astype(np.uint32)


def signature(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of every function over a set of 64-bit hashes."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):  # pieces that stay in the processor's cache
        values = np.multiply.outer(a, x[i:i + 2048])
        values += b[:, None]
        np.minimum(out, values.min(axis=1), out=out)
    return out


def sign(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, text_key (hash of the text), n_shingles, print (128-bit hash of the set) and signature of each row.

    Print and signature are null for empty sets.
    """

    def run(batches):
        a, b = functions(settings)
        for batch in small(batches, 256):
            n, prints, signs = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, settings.words)
                n.append(len(found))
                prints.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                signs.append(signature(found, a, b).astype("<u4").tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(prints, pa.binary()),
                 pa.array(signs, pa.binary())], ["doc_id", "text_key", "n_shingles", "print", "signature"])
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key")).mapInArrow(
        run, "doc_id long, text_key long, n_shingles long, print binary, signature binary")


def buckets(classes: DataFrame, settings: Settings) -> DataFrame:
    """(bucket, id) for every band of every class; a bucket is the hash of the band's number and minima."""
    size = 4 * settings.rows

    def run(batches):
        for batch in batches:
            keys = np.array([
                xxhash.xxh3_64_intdigest(s[j * size:(j + 1) * size], j)
                for s in batch.column(1).to_pylist() for j in range(settings.bands)], np.uint64).view(np.int64)
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), settings.bands)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids)], ["bucket", "id"])

    return classes.select("id", "signature").mapInArrow(run, "bucket long, id long")


def _joined(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (a, b) with columns of both their rows of ``table`` (id, ...), named a_x and b_x."""
    for side in "ab":
        pairs = pairs.join(table.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]), side)
    return pairs


def _screened(pairs: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose signatures agree often enough."""

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        x = np.frombuffer(b"".join(a), "<u4").reshape(len(a), -1)
        y = np.frombuffer(b"".join(b), "<u4").reshape(len(b), -1)
        return pd.Series((x == y).sum(axis=1) >= settings.agree)

    both = _joined(pairs, classes, ["n", "signature"])
    sized = both.where(100 * F.least("a_n", "b_n") >= settings.percent * F.greatest("a_n", "b_n"))
    return sized.where(alike("a_signature", "b_signature")).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Pairs whose full sets are similar enough."""

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= settings.percent * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    return _joined(pairs, sets, ["found"]).where(similar("a_found", "b_found")).select("a", "b")


def _full_sets(docs: DataFrame, classes: DataFrame, ids: DataFrame, settings: Settings) -> DataFrame:
    """(id, found) of the classes in ``ids``, from the texts again: most sets are never needed."""

    def run(batches):
        for batch in small(batches, 256):
            found = [shingles(t, settings.words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([xxhash.xxh3_128_digest(f.tobytes()) for f in found], pa.binary()),
                pa.array([f.astype("<u8").tobytes() for f in found], pa.binary())], ["id", "print", "found"])

    wanted = classes.join(ids, "id", "left_semi").select("id", F.col("doc_id").alias("d"), F.col("text_key").alias("k"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("k")))
    sets = texts.select("id", "text").mapInArrow(run, "id long, print binary, found binary")
    return sets.join(classes.select("id", "print"), ["id", "print"], "left_semi").dropDuplicates(["id"]).drop("print")


def _prefix_pairs(sets: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """Pairs of classes with different labels that could be similar, exactly, by prefixes of rare shingles.

    With the shingles of every set in one order, rare ones first, similar sets
    share one of the first few, and the places of the first shared one bound
    how many they can share. Sets made different by edits of their own begin
    with shingles that no other has, and so meet nobody.
    """

    def run(batches):
        for batch in batches:
            for i, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(found, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), i)), pa.array(values), pa.array(
                    np.full(len(values), len(values)))], ["id", "shingle", "n"])

    t = settings.percent
    rows = sets.mapInArrow(run, "id long, shingle long, n long")
    shared = written(rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    own = Window.partitionBy("id")
    ordered = rows.join(shared, "shingle").withColumn(
        "place", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "shingle")) - 1)
    prefix = written(
        ordered.where(100 * (F.col("n") - F.col("place")) >= t * F.col("n")).join(labels, "id", "left").select(
            "id", "shingle", "n", "place", F.coalesce("label", "id").alias("label")), "prefix")
    mixed = prefix.groupBy("shingle").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    prefix = written(prefix.join(mixed, "shingle", "left_semi"), "mixed")
    a, b = (prefix.select("shingle", *[F.col(c).alias(f"{side}_{c}") for c in ("id", "n", "place", "label")])
            for side in "ab")
    most = F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place"))
    return a.join(b, (a["shingle"] == b["shingle"]) & (F.col("a_id") < F.col("b_id")) & (F.col("a_label") != F.col("b_label"))
                  & (100 * F.least("a_n", "b_n") >= t * F.greatest("a_n", "b_n"))
                  & ((100 + t) * most >= t * (F.col("a_n") + F.col("b_n")))).select(
        F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()


def links(docs: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """Confirmed pairs (a, b) of classes whose closure holds every pair that shares a band and is similar enough.

    In each bucket all are first compared with one pivot: the class that shares
    most buckets with others, which of a text and its edited copies is that
    text. Buckets whose members are not all connected by these links go on to
    :func:`_prefix_pairs`. So no group is expanded into its pairs.
    """
    rows = buckets(classes, settings)
    shared = written(rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    members = written(rows.join(shared, "bucket"), "members")
    ids = written(members.select("id").distinct(), "ids")
    sets = written(_full_sets(docs, classes, ids, settings), "sets")
    degree = members.groupBy("id").agg(F.sum("size").alias("degree"))
    pivots = written(members.join(degree, "id").groupBy("bucket").agg(
        F.max(F.struct("degree", (-F.col("id")).alias("at"))).alias("top")).select(
        "bucket", (-F.col("top.at")).alias("pivot")), "pivots")
    first = members.join(pivots, "bucket").where("id <> pivot").select(
        F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    first = written(_confirmed(written(_screened(first, classes, settings), "likely"), sets, settings), "links")
    labels = written(components(first).select(F.col("node").alias("id"), F.col("component").alias("label")), "labels")
    labelled = members.join(labels, "id", "left").select("bucket", "id", F.coalesce("label", "id").alias("label"))
    mixed = written(labelled.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y"),
                    "mixed")
    left = written(members.join(mixed, "bucket", "left_semi").select("id").distinct(), "left")
    pairs = _prefix_pairs(sets.join(left, "id", "left_semi"), labels, settings)
    rest = _confirmed(written(_screened(pairs, classes, settings), "likely"), sets, settings)
    return first.union(rest)


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text; other columns are ignored).

    Texts with equal sets form a class and are compared once; links between
    classes are confirmed on full sets (of 64-bit hashes), and all texts of one
    doc_id are linked. ``component_id`` is the smallest doc_id reachable,
    ``kept`` whether that is the row's own. Null, empty and blank texts have no
    shingles and are linked with nothing by them. Rows without a doc_id are
    compared as well: copies of rows with one are not kept, and where no row
    of a component has one, ``component_id`` is null and the text with the
    smallest text_key is kept. Rows with one doc_id (or none) and one text are
    kept or not together (text_key is a hash of the text); an empty table
    gives no rows.
    """
    signed = written(sign(docs, settings), "signed")
    usable = signed.where(F.col("print").isNotNull())
    grouped = written(usable.groupBy("print").agg(
        F.min(F.struct("doc_id", "text_key", "n_shingles", "signature")).alias("m"), F.min("doc_id").alias("least"),
        F.min(F.when(F.col("doc_id").isNull(), F.col("text_key"))).alias("least_key")), "classes")
    classes = written(grouped.select(
        F.monotonically_increasing_id().alias("id"), "print", "least", "least_key", "m.doc_id", "m.text_key",
        F.col("m.n_shingles").alias("n"), F.col("m.signature").alias("signature")), "classes")
    drop(grouped)
    # A doc_id may stand on several texts: their classes are tied to one of them.
    several = written(usable.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("print").alias("x"), F.max("print").alias("y")).where("x <> y").select("doc_id", "x"), "several")
    at = classes.select("print", "id")
    ties = usable.join(several, "doc_id").select("print", "x").distinct().join(
        at.select(F.col("print").alias("x"), F.col("id").alias("a")), "x").join(
        at.withColumnRenamed("id", "b"), "print").where("a <> b").select("a", "b")
    found = written(components(links(docs, classes, settings).union(ties)), "components")
    parts = written(classes.join(found, F.col("id") == F.col("node"), "left").select(
        "print", "least", "least_key", F.coalesce("component", "id").alias("part")), "parts")
    least = parts.groupBy("part").agg(F.min("least").alias("component"), F.min("least_key").alias("first_key"))
    named = written(parts.select("print", "part").join(least, "part").select("print", "component", "first_key"), "named")
    kept = F.when(F.col("first").isNull(), F.lit(True)).when(
        F.col("component").isNotNull(), F.coalesce(F.col("component") == F.col("doc_id"), F.lit(False))).otherwise(
        F.col("text_key") == F.col("first_key"))
    return signed.join(named.withColumn("first", F.lit(1)), "print", "left").select(
        "doc_id", "text_key", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), kept.alias("kept"))


def without_copies(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, with all columns, that are kept; of rows with one doc_id (or none) and one text one stays.

    Texts are shuffled once, by doc_id and hash, at every size: what is dropped has no bound.
    """
    id_, key = spare("id", docs), spare("key", docs)
    named = written(near_duplicates(docs, settings).select("doc_id", "text_key", "n_shingles", "kept"), "decided")
    named = named.withColumnsRenamed({"doc_id": id_, "text_key": key})
    gone = written(named.where(~F.col("kept")).select(id_, key).distinct(), "gone")
    often = written(named.where(F.col("kept") & (F.col(id_).isNotNull() | (F.col("n_shingles") > 0))).groupBy(id_, key).agg(
        F.count("*").alias("n")).where("n > 1").select(id_, key), "often")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key))
    stay = docs.join(gone.hint("merge"), same, "left_anti")
    if often.isEmpty():
        return stay
    return stay.join(often, same, "left_anti").union(
        stay.join(often, same, "left_semi").dropDuplicates(["doc_id", "text"]))
