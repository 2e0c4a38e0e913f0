"""Token counts of whole texts by a map-side lookup in two tiers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourlens.llm import bpe
from hourlens.llm.shared import small


def frequent_pieces(docs: DataFrame, sample_texts: int, size: int) -> list[str]:
    """The ``size`` most frequent pieces of at most ``sample_texts`` texts picked by a hash of their ids.

    This only decides which lookups are fast; counts do not depend on it.
    Tasks count pieces of their part of the sample and drop those met once.
    """
    total = docs.count()
    rows = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(total, 1))) < 2 * sample_texts).limit(sample_texts)

    def count(batches):
        met = Counter()
        for batch in small(batches):
            for text in batch.column(0).to_pylist():
                if text:
                    met.update((bpe.space_pieces(text) or [])[1:])
        pairs = [(p, n) for p, n in met.most_common(size) if n > 1 and "\0" not in p]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in pairs], pa.string()), pa.array([n for _, n in pairs], pa.int64())], ["piece", "n"])

    met = Counter()
    for row in rows.select("text").mapInArrow(count, "piece string, n long").toLocalIterator():
        met[row.piece] += row.n
    return [p for p, _ in met.most_common(size)]


def compact(pieces: list[str], path: str) -> tuple[str, bytes]:
    """The frequent tier in compact form: pieces in one text, a byte for each length."""
    encode = bpe.after_space(path)
    lengths = [len(encode(p)) for p in pieces]
    kept = [(p, n) for p, n in zip(pieces, lengths) if n < 256]
    return "\0".join(p for p, _ in kept), bytes(n for _, n in kept)


@lru_cache(maxsize=2)
def _expand(packed: tuple[str, bytes]) -> dict[str, int]:
    pieces, lengths = packed
    return dict(zip(pieces.split("\0"), lengths)) if lengths else {}


@lru_cache(maxsize=2)
def _cache(path: str, size: int) -> bpe.Cache:
    encode = bpe.after_space(path)
    return bpe.Cache(lambda new: [len(encode(p)) for p in new], size)


def count_texts(texts: list[str | None], frequent: dict[str, int], path: str, cache_size: int) -> np.ndarray:
    """Tokens of each text: first the frequent tier, then this worker's cache, then the library for new pieces."""
    tokenizer, cache, (_, pattern) = bpe.load(path), _cache(path, cache_size), bpe.special(path)
    encode = bpe.piece_encoder(path, bpe.SPACED)
    out = np.zeros(len(texts), np.int64)
    missed: dict[int, list[str]] = {}
    whole: list[tuple[int, str]] = []
    for i, text in enumerate(texts):
        if not text:
            continue
        pieces = None if pattern is not None and pattern.search(text) else bpe.space_pieces(text)
        if pieces is None:
            whole.append((i, text))
            continue
        if first := pieces.pop(0):
            out[i] = len(encode(first))
        found = list(map(frequent.get, pieces))
        if None in found:
            missed[i] = [p for p, n in zip(pieces, found) if n is None]
            found = filter(None, found)
        out[i] += sum(found)
    cache.add(set().union(*missed.values()))
    for i, pieces in missed.items():
        out[i] += sum(map(cache.__getitem__, pieces))
    for (i, _), encoded in zip(whole, tokenizer.encode_batch([t for _, t in whole], add_special_tokens=False)):
        out[i] += len(encoded.ids)
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 1024, frequent: int = 1 << 16, sample_texts: int = 2048,
                 cache_size: int = 500_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text; other columns are ignored).

    ``path`` is a file of the tokenizers library with a byte-level rule. The
    broadcast tier has at most ``frequent`` pieces, so its size is bounded; it
    is taken from at most ``sample_texts`` texts and changes no result. Nothing
    is shuffled. Null and empty texts have 0 bytes and tokens; repeated rows
    are counted each; null ids stay null; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    table = spark.sparkContext.broadcast(compact(frequent_pieces(docs, sample_texts, frequent), path))

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _expand(table.value)
        for part in texts:
            values = part.tolist()
            yield pd.Series(np.concatenate(
                [count_texts(values[i:i + 512], known, path, cache_size) for i in range(0, len(values), 512)]
                or [np.zeros(0, np.int64)]))

    return docs.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        count("text").alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
