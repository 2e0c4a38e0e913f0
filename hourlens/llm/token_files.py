"""Token ids in binary segments: patched frame-of-reference blocks with an index of block starts.

A segment is one row of a Parquet table, so Spark's writers commit it whole or
not at all on any file system. Its ``payload`` is a file in itself, numbers
little-endian:

    magic "PFR1", n_ids uint64, n_blocks uint32
    starts: n_blocks + 1 uint64, the place of each block behind this index
    blocks: minimum uint32, width uint8, n_exceptions uint16, BLOCK values of ``width`` bits (differences to the
            minimum, low bits of exceptions), then positions uint16 and whole differences uint32 of the exceptions
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourlens.llm import bpe
from hourlens.llm.shared import release, sized, small, written

MAGIC = b"PFR1"
BLOCK = 512
#: Share of a block's values that the packed width must hold; the rest are exceptions.
HELD = 0.9
#: Ids after which a segment is closed. A document is never divided, so a segment has at most that and a document.
SEGMENT = 1 << 18
#: Bytes of text that are encoded together.
CHUNK = 4 << 20
_HEAD = struct.Struct("<4sQI")
_BLOCK_HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("n", "<u2")])

SEGMENTS = """shard int, segment int, first_in_shard long, n_ids long,
              doc_ids array<bigint>, lengths array<bigint>, payload binary"""
_SCHEMA = pa.schema([
    ("shard", pa.int32()), ("segment", pa.int32()), ("first_in_shard", pa.int64()), ("n_ids", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])


def _bits(values: np.ndarray) -> np.ndarray:
    """Number of bits each unsigned value needs."""
    return np.frexp(values.astype(np.float64))[1]


def encode(ids: np.ndarray) -> bytes:
    """One payload from unsigned 32-bit ids."""
    n_blocks = -(-len(ids) // BLOCK)
    if not n_blocks:
        return _HEAD.pack(MAGIC, 0, 0) + bytes(8)
    padded = np.concatenate([ids, np.full(n_blocks * BLOCK - len(ids), ids[-1], ids.dtype)]).astype("<u4")
    values = padded.reshape(n_blocks, BLOCK)
    low = values.min(axis=1)
    rest = values - low[:, None]
    at = int(np.ceil(HELD * BLOCK)) - 1
    width = _bits(np.partition(rest, at, axis=1)[:, at]).astype(np.uint8)
    limit = (np.uint64(1) << width.astype(np.uint64))
    odd = rest >= limit[:, None]
    n_odd = odd.sum(axis=1)
    rows, places = np.nonzero(odd)
    whole = rest[rows, places]
    first_odd = np.concatenate([[0], np.cumsum(n_odd)])
    heads = np.zeros(n_blocks, _BLOCK_HEAD)
    heads["low"], heads["width"], heads["n"] = low, width, n_odd
    sizes = _BLOCK_HEAD.itemsize + width.astype(np.int64) * (BLOCK // 8) + 6 * n_odd
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
    packed: dict[int, Iterator[np.ndarray]] = {}
    for w in np.unique(width):
        own = rest[width == w]
        lane = np.uint16 if w <= 16 else np.uint32
        low_bits = own.astype(lane).view(np.uint8).reshape(-1, lane().nbytes)
        bits = np.unpackbits(low_bits, axis=1, bitorder="little", count=max(int(w), 1))
        packed[int(w)] = iter(np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little") if w else
                              np.zeros((len(own), 0), np.uint8))
    places, whole = places.astype("<u2"), whole.astype("<u4")
    parts = [_HEAD.pack(MAGIC, len(ids), n_blocks), starts.tobytes()]
    for i in range(n_blocks):
        mine = slice(first_odd[i], first_odd[i + 1])
        parts += [heads[i].tobytes(), next(packed[int(width[i])]).tobytes(), places[mine].tobytes(),
                  whole[mine].tobytes()]
    return b"".join(parts)


def decode(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids ``first`` to before ``last`` of a payload; only the blocks that hold them are unpacked."""
    magic, n_ids, n_blocks = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    last = n_ids if last is None else min(last, n_ids)
    if first >= last:
        return np.zeros(0, np.uint32)
    base = _HEAD.size + 8 * (n_blocks + 1)
    starts = np.frombuffer(payload, "<u8", n_blocks + 1, _HEAD.size).astype(np.int64) + base
    blocks = range(first // BLOCK, -(-last // BLOCK))
    raw = np.frombuffer(payload, np.uint8)
    own = starts[blocks.start:blocks.stop]
    heads = raw[own[:, None] + np.arange(_BLOCK_HEAD.itemsize)].view(_BLOCK_HEAD)[:, 0]
    out = np.zeros((len(own), BLOCK), np.uint32)
    for w in np.unique(heads["width"]):
        if not w:
            continue
        mine = heads["width"] == w
        size = int(w) * (BLOCK // 8)
        body = raw[(own[mine] + _BLOCK_HEAD.itemsize)[:, None] + np.arange(size)]
        bits = np.unpackbits(body, axis=1, bitorder="little").reshape(-1, int(w))
        lane = np.uint16 if w <= 16 else np.uint32
        whole = np.zeros((len(bits), 8 * lane().nbytes), np.uint8)
        whole[:, :int(w)] = bits
        out[mine] = np.packbits(whole, axis=1, bitorder="little").view(lane).reshape(-1, BLOCK)
    for i in np.flatnonzero(heads["n"]):
        n, at = int(heads["n"][i]), int(own[i]) + _BLOCK_HEAD.itemsize + int(heads["width"][i]) * (BLOCK // 8)
        out[i, np.frombuffer(payload, "<u2", n, at)] = np.frombuffer(payload, "<u4", n, at + 2 * n)
    out += heads["low"][:, None]
    skip = blocks.start * BLOCK
    return out.reshape(-1)[first - skip:last - skip]


@lru_cache(maxsize=2)
def _cache(path: str, size: int) -> bpe.Cache:
    encode_piece = bpe.piece_encoder(path, bpe.UNSPACED)
    return bpe.Cache(
        lambda new: [array("I", [t.id for t in encode_piece(p)]).tobytes() for p in new], size)


def _pieces(texts: list[str]) -> pa.ListArray:
    """Pieces between white space of each text."""
    return pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))


def encode_texts(texts: list[str | None], path: str, end_id: int, cache_size: int) -> list[np.ndarray]:
    """Ids of each text with the end id.

    The pieces of all texts are numbered by Arrow; each distinct one is looked
    up once in this worker's cache, and Arrow strings their ids together.
    """
    tokenizer, cache, (_, pattern) = bpe.load(path), _cache(path, cache_size), bpe.special(path)
    ready = ["" if not t else None if pattern is not None and pattern.search(t) else bpe.spaced(t) for t in texts]
    whole = iter(tokenizer.encode_batch(
        [t for t, r in zip(texts, ready) if r is None], add_special_tokens=False))
    pieces = _pieces([r or "" for r in ready])
    numbered = pieces.flatten().dictionary_encode()
    distinct = numbered.dictionary.to_pylist()
    cache.add(distinct)
    strung = pa.array([cache[p] for p in distinct], pa.large_binary()).take(numbered.indices)
    offsets, data = strung.buffers()[1:]
    ids = np.frombuffer(data, "u4", len(data) // 4) if data is not None and len(data) else np.zeros(0, "u4")
    ends = np.frombuffer(offsets, "i8", len(strung) + 1) if len(strung) else np.zeros(1, np.int64)
    places = ends[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()] // 4
    end = np.array([end_id], "<u4")
    return [np.concatenate([np.array(next(whole).ids, "<u4") if r is None else ids[a:b], end])
            for r, a, b in zip(ready, places[:-1], places[1:])]


def _write_segments(batches, path: str, end_id: int, cache_size: int):
    shard, segment, before = TaskContext.get().partitionId(), 0, 0
    ids, doc_ids, lengths, held = [], [], [], 0

    def close():
        return pa.RecordBatch.from_pylist([{
            "shard": shard, "segment": segment, "first_in_shard": before, "n_ids": held, "doc_ids": doc_ids,
            "lengths": lengths, "payload": encode(np.concatenate(ids))}], _SCHEMA)

    for batch in sized(batches, 1, CHUNK):
        for doc_id, own in zip(batch.column(0).to_pylist(),
                               encode_texts(batch.column(1).to_pylist(), path, end_id, cache_size)):
            ids.append(own)
            doc_ids.append(doc_id)
            lengths.append(len(own))
            held += lengths[-1]
            if held >= SEGMENT:
                yield close()
                segment, before = segment + 1, before + held
                ids, doc_ids, lengths, held = [], [], [], 0
    if doc_ids:
        yield close()
    ids = doc_ids = lengths = batch = own = None
    release()


def write_tokens(docs: DataFrame, path: str, end_id: int, cache_size: int = 700_000) -> DataFrame:
    """Segments of all texts of ``docs`` (doc_id, text; other columns are ignored) in ascending doc_id order.

    Rows are dealt by ranges of doc_id, so shard, segment and place follow its
    order; null ids come first, rows of one id stay together in the order of
    their texts (null first). Null texts are empty: they have the end id alone. The table is written to the shared
    folder and read back.
    """
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(
        lambda batches: _write_segments(batches, path, end_id, cache_size), SEGMENTS), "tokens")


def shard_starts(segments: DataFrame) -> DataFrame:
    """shard, shard_start: ids before each shard. One row per shard passes the ordered window."""
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


def _read_segments(batches):
    for batch in small(batches, 1):
        for row in batch.to_pylist():
            data = decode(row["payload"]).astype("<u4").tobytes()
            ends = np.cumsum(np.array(row["lengths"], np.int64))
            starts = ends - np.array(row["lengths"], np.int64)
            view = memoryview(data)
            yield pa.RecordBatch.from_arrays([
                pa.array(row["doc_ids"], pa.int64()), pa.array(np.full(len(ends), row["shard"], np.int32)),
                pa.array(starts + row["first_in_shard"]), pa.array(row["lengths"], pa.int64()),
                pa.array([zlib.crc32(view[4 * a:4 * b]) for a, b in zip(starts, ends)], pa.int64()),
            ], ["doc_id", "shard", "place", "n_tokens", "ids_crc32"])


def read_tokens(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the segments, from their unpacked ids."""
    docs = segments.select("shard", "first_in_shard", "doc_ids", "lengths", "payload").mapInArrow(
        _read_segments, "doc_id long, shard int, place long, n_tokens long, ids_crc32 long")
    return docs.join(shard_starts(segments), "shard").select(
        "doc_id", (F.col("shard_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write the ids of all documents and return what the files hold (see the two functions above).

    An empty table gives an empty table of segments and no rows. Repeated rows are written each.
    """
    return read_tokens(write_tokens(docs, path, end_id))
