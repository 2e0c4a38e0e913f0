"""Nearest neighbours by inner product with randomly rotated one-bit codes (after RaBitQ: Gao and Long, 2024).

A vector is rotated at random and kept as the signs of its coordinates, with
its length and how well the signs point along it. For a query these give an
estimate of the inner product and a bound on its error. Vectors that may be
among the nearest by these bounds are reranked with the original vectors in
double precision.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourlens.llm.shared import written


@dataclass(frozen=True)
class Settings:
    """Nearest wanted, width of the error bound in deviations, bits of a query's coordinates, rows per block, queries held at once."""

    k: int = 20
    width: float = 3.0
    query_bits: int = 6
    block: int = 8192
    queries: int = 2048
    asked: int = 65536
    seed: int = 7


#: No rows of (query_id, vec_id, score).
NOTHING = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


@lru_cache(maxsize=4)
def rotation(dims: int, seed: int) -> np.ndarray:
    """A random rotation, the same everywhere, made once by each worker."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def codes(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs of the rotated vectors as 64-bit words, and two correction scalars.

    The first turns the product of signs and query into an estimate of the
    inner product, the second times the query's length is one deviation of it.
    """
    rotated, dims = vectors @ turn.T, vectors.shape[1]
    length = np.linalg.norm(vectors, axis=1)
    along = np.abs(rotated).sum(axis=1) / np.sqrt(dims) / length
    signs = np.packbits(rotated > 0, axis=1, bitorder="little")
    words = np.zeros((len(vectors), -(-dims // 64) * 8), np.uint8)
    words[:, :signs.shape[1]] = signs
    off = length * np.sqrt(np.maximum(1 - along ** 2, 0)) / along / np.sqrt(max(dims - 1, 1))
    return words.view(np.uint64), length / along / np.sqrt(dims), off


def planes(queries: np.ndarray, turn: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated queries as whole numbers of some bits: packed planes (query, bit, word), their step and lowest value."""
    rotated = queries @ turn.T
    low = rotated.min(axis=1)
    step = np.maximum((rotated.max(axis=1) - low) / ((1 << bits) - 1), 1e-300)
    whole = np.rint((rotated - low[:, None]) / step[:, None]).astype(np.uint16)
    out = np.zeros((len(queries), bits, -(-queries.shape[1] // 64) * 8), np.uint8)
    for j in range(bits):
        packed = np.packbits((whole >> j) & 1, axis=1, bitorder="little")
        out[:, j, :packed.shape[1]] = packed
    return out.view(np.uint64), step, low


def search(ids: np.ndarray, vectors: np.ndarray, words: np.ndarray, scale: np.ndarray, off: np.ndarray,
           query_ids: np.ndarray, queries: np.ndarray, turn: np.ndarray, s: Settings):
    """For each query the nearest of one block: (query_id, vec_id, score) arrays."""
    bit_planes, step, low = planes(queries, turn, s.query_bits)
    dims, ones = vectors.shape[1], np.bitwise_count(words).sum(axis=1).astype(np.int64)
    lengths = np.linalg.norm(queries, axis=1)
    found = []
    for i in range(len(queries)):
        # sum of sign_j * q_j = 2 * sum over set bits of q_j - sum of all q_j, with q_j = low + step * whole_j
        inside = np.zeros(len(ids), np.int64)
        for j in range(s.query_bits):
            inside += np.bitwise_count(words & bit_planes[i, j]).sum(axis=1, dtype=np.int64) << j
        total = sum(int(np.bitwise_count(bit_planes[i, j]).sum()) << j for j in range(s.query_bits))
        product = 2 * (low[i] * ones + step[i] * inside) - (low[i] * dims + step[i] * total)
        estimate = product * scale
        # The rounding of the query moves each coordinate by half a step at most.
        bound = s.width * off * lengths[i] + scale * step[i] * np.sqrt(dims) / 2
        other = ids != query_ids[i]
        surest = (estimate - bound)[other]
        if len(surest) > s.k:
            least = np.partition(surest, len(surest) - s.k)[len(surest) - s.k]
            likely = np.flatnonzero(other & (estimate + bound >= least))
        else:
            likely = np.flatnonzero(other)
        # Row by row: a matrix product's last bit depends on where a row stands, and equal vectors must tie.
        exact = (vectors[likely] * queries[i]).sum(axis=1)
        best = np.lexsort((ids[likely], -exact))[:s.k]
        found.append((np.full(len(best), query_ids[i]), ids[likely][best], exact[best]))
    return [np.concatenate(x) for x in zip(*found)] if found else list(NOTHING)


def best_of(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The first k rows of each query of (query_id, vec_id, score) arrays, by score and then vec_id."""
    query_ids, ids, scores = found
    order = np.lexsort((ids, -scores, query_ids))
    own = query_ids[order]
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(starts, np.diff(np.r_[starts, len(own)]))
    return [x[order[rank < k]] for x in found]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) rows that take part: finite, not zero; of rows with one vec_id the smallest vector."""
    real = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = rows.where(F.col("vec_id").isNotNull() & real & F.exists("embedding", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _number(rows: DataFrame) -> np.dtype:
    """How components are kept: as given, so that nothing is rounded."""
    single = rows.schema["embedding"].dataType.elementType.typeName() == "float"
    return np.dtype("<f4" if single else "<f8")


def _blocks(rows: DataFrame, size: int, turned: int | None) -> DataFrame:
    """Rows packed as (dims, ids, vectors[, codes and scalars]) of at most ``size`` each, without a shuffle."""
    number = _number(rows)

    def pack(ids, vectors):
        ids, vectors = np.array(ids, "<i8"), np.array(vectors, number)
        packed = [pa.array([vectors.shape[1]], pa.int32()), pa.array([ids.tobytes()], pa.binary()),
                  pa.array([vectors.tobytes()], pa.binary())]
        names = ["dims", "ids", "vectors"]
        if turned is not None:
            parts = codes(vectors.astype(np.float64), rotation(vectors.shape[1], turned))
            for name, part in zip(("words", "scale", "off"), parts):
                packed.append(pa.array([part.tobytes()], pa.binary()))
                names.append(name)
        return pa.RecordBatch.from_arrays(packed, names)

    def run(batches):
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, vectors = held.setdefault(len(v), ([], []))
                ids.append(i)
                vectors.append(v)
                if len(ids) >= size:
                    yield pack(*held.pop(len(v)))
        for ids, vectors in held.values():
            yield pack(ids, vectors)

    extra = "" if turned is None else ", words binary, scale binary, off binary"
    return rows.select("vec_id", "embedding").mapInArrow(run, "dims int, ids binary, vectors binary" + extra)


def nearest(vectors: DataFrame, every: int = 20, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest of all others to each vector whose vec_id ``every`` divides.

    Nearest is the largest inner product of the original vectors in double
    precision, ties to the smaller vec_id; all candidates where there are
    fewer than k. Every vector is coded. Blocks of vectors lie in groups, at
    most as many as there are shuffle partitions, and are shuffled once; only
    blocks of queries, of the same length, go to every group. A group gives at
    most k rows a query, of which the best are kept. Beyond ``settings.asked``
    queries the groups are made again for the next ones, so what a worker holds
    is bounded. Grouped, not joined: nothing that is repeated can be broadcast.
    Null, zero and not finite vectors take no part; rows with one vec_id are
    one vector; vectors of different lengths are not compared; an empty table
    gives no rows.
    """
    rows = written(usable(vectors), "vectors")
    number = _number(rows)
    data = written(_blocks(rows, settings.block, settings.seed), "blocks")
    asked = written(_blocks(rows.where(F.col("vec_id") % every == 0), settings.queries, None), "queries")
    count = rows.where(F.col("vec_id") % every == 0).count()
    groups = max(1, min(data.count(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rounds = max(1, -(-count // settings.asked))
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    data = data.withColumn("x", place(groups)).withColumn("y", every_of(rounds))
    asked = asked.withColumn("y", place(rounds)).withColumn("x", every_of(groups))

    def run(key, data: pa.Table, asked: pa.Table) -> pa.Table:
        dims, found = key[0].as_py(), []
        turn = rotation(dims, settings.seed)
        for i in range(asked.num_rows):
            query_ids, queries = (asked.column(c)[i].as_py() for c in ("ids", "vectors"))
            query_ids = np.frombuffer(query_ids, "<i8")
            queries = np.frombuffer(queries, number).reshape(-1, dims).astype(np.float64)
            kept = list(NOTHING)
            for j in range(data.num_rows):
                ids, vectors, words, scale, off = (data.column(c)[j].as_py() for c in ("ids", "vectors", "words", "scale", "off"))
                block = search(np.frombuffer(ids, "<i8"), np.frombuffer(vectors, number).reshape(-1, dims).astype(np.float64),
                               np.frombuffer(words, "<u8").reshape(-1, -(-dims // 64)), np.frombuffer(scale), np.frombuffer(off),
                               query_ids, queries, turn, settings)
                kept = best_of([np.concatenate(p) for p in zip(kept, block)], settings.k)
            found.append(kept)
        return pa.table([np.concatenate(p) for p in zip(*found)] if found else list(NOTHING), ["query_id", "vec_id", "score"])

    on = ["dims", "x", "y"]
    found = data.groupBy(*on).cogroup(asked.groupBy(*on)).applyInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= settings.k).select(
        "query_id", "rank", "vec_id", "score")
