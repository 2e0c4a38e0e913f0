"""Helpers that several operators use: shared folder, written tables, words and shingles of texts."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multipliers for combining the hashes of neighbouring words; wrap-around arithmetic on 64 bits.
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def folder(spark: SparkSession) -> str:
    """The folder all machines share, from ``spark.checkpoint.dir``; where that is unset, an error says so."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts the lineage and makes its size known."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that no later plan reads."""
    spark = df.sparkSession
    here = spark._jvm.org.apache.hadoop.fs.Path(folder(spark)).toUri().getPath()
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if path.getParent().toUri().getPath() != here:
            raise ValueError(f"not a table in the shared folder: {path}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spare(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name in taken:
        name = f"_{name}"
    return name


def small(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into slices, so that what Python holds of long texts stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def sized(batches: Iterable[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the texts of a column hold at most ``limit`` bytes in each, or are a single row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, first = np.cumsum(sizes), 0
        while first < batch.num_rows:
            before = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(first, last - first)
            first = last


def release() -> None:
    """Give back what a task has freed. Python workers are kept for later tasks, and with them memory they do not use."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # only the GNU library keeps freed memory this way
        trim(0)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a column as bytes, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def held_out(doc_id: Column) -> Column:
    """True for rows no model may learn from: crc32 of the id's text leaves remainder 1 by 3 (null id: false)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def words(text: str | None) -> list[bytes]:
    """Words of a text as bytes: A-Z in lower case, separated by space and the controls 9 to 13."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hashes(items: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, items), np.uint64, len(items))


def windows(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n neighbouring values; one hash of the whole where there are fewer, none of nothing."""
    if not len(values):
        return values
    n = min(n, len(values))
    count = len(values) - n + 1
    out = np.full(count, n, np.uint64)
    for i in range(n):
        out = (out ^ values[i:i + count]) * _MIX
        out ^= out >> np.uint64(29)
        out *= _STEP
    return out ^ (out >> np.uint64(32))


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of n words."""
    return np.unique(windows(hashes(words(text)), n))
