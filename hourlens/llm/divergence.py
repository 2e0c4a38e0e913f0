"""How far the sources of a language lie apart in their words: exact counts from packed terms, exact arithmetic."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourlens.llm.shared import sized, utf8, written

#: Bytes of text whose terms are sorted and counted together.
CHUNK = 16 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of terms: letters A to Z in both cases and every byte of a character beyond ASCII.
_TERM = np.zeros(256, bool)
_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows by several unsigned columns, the first one weighing most, 16 bits a pass.

    Passes over digits that all rows have alike are left out.
    """
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        digits = key.view(np.uint16).reshape(len(key), -1)
        places = range(digits.shape[1]) if np.little_endian else reversed(range(digits.shape[1]))
        for i in places:
            digit = digits[:, i]
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _packed(data: np.ndarray, start: np.ndarray, length: np.ndarray, skip: int) -> np.ndarray:
    """Bytes ``skip`` to ``skip + 8`` of each term as one number that orders like them; short terms end in zeros."""
    out = np.zeros(len(start), np.uint64)
    for i in range(skip, skip + 8):
        inside = length > i
        out[inside] |= data[start[inside] + i].astype(np.uint64) << np.uint64(8 * (7 + skip - i))
    return out


def _runs(changed: list[np.ndarray], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, count, documents) of each run of equal rows among sorted ones."""
    new = np.ones(len(docs), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in changed])
    other = new.copy()
    other[1:] |= docs[1:] != docs[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(docs))), np.add.reduceat(other.astype(np.int64), first)


def count_terms(texts: list[bytes], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(group, count, documents, term) of every term in every group; each text is a document of its group.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z in lower
    case. Those of up to 8 bytes are one number, of up to 16 bytes two, sorted
    by radix; longer ones are padded to the next power of two and sorted as
    bytes, one bucket for each such length.
    """
    data = _LOWER[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[1:] = _TERM[data]
    edge = np.diff(inside)
    start = np.flatnonzero(edge == 1)
    length = np.flatnonzero(edge == -1) - start
    ends = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(ends, start, "right")
    group = groups[doc].astype(np.uint32)
    found = []
    bucket = np.where(length <= 8, 8, np.where(length <= 16, 16, 0))
    long = bucket == 0
    bucket[long] = 1 << np.ceil(np.log2(length[long])).astype(np.int64)
    for width in np.unique(bucket):
        mine = np.flatnonzero(bucket == width)
        at, size, own, of = start[mine], length[mine], group[mine], doc[mine]
        if width <= 16:
            words = [_packed(data, at, size, skip) for skip in range(0, int(width), 8)]
            order = radix_order([own, *words])
            keys = [own[order], *[w[order] for w in words]]
        else:
            padded = np.zeros((len(mine), int(width)), np.uint8)
            row = np.repeat(np.arange(len(mine)), size)
            column = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            padded[row, column] = data[np.repeat(at, size) + column]
            terms = padded.view(f"S{int(width)}")[:, 0]
            order = np.argsort(terms, kind="stable")
            order = order[np.argsort(own[order], kind="stable")]
            keys = [own[order], terms[order]]
        first, count, docs = _runs(keys, of[order])
        chosen = order[first]
        found.append((own[chosen], count, docs, at[chosen], size[chosen]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, pa.array([], pa.string())
    own, count, docs, at, size = (np.concatenate(c) for c in zip(*found))
    places = np.concatenate([[0], np.cumsum(size)])
    letters = data[np.arange(places[-1]) + np.repeat(at - places[:-1], size)]
    terms = pa.LargeStringArray.from_buffers(
        len(size), pa.py_buffer(places.astype(np.int64).tobytes()), pa.py_buffer(letters.tobytes()))
    return own, count, docs, terms.cast(pa.string())


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: sums of these over rows give the counts of ``docs`` (lang, source, text, no nulls).

    Counted by blocks of a task's texts, so that a word of a third of all
    texts is one row of each block.
    """

    def run(batches):
        for batch in sized(batches, 2, CHUNK):
            if not batch.num_rows:
                continue
            pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            known = {pair: i for i, pair in enumerate(dict.fromkeys(pairs))}
            own, count, in_docs, terms = count_terms(utf8(batch.column(2)), np.array([known[p] for p in pairs]))
            langs, sources = (pa.array(c, pa.string()) for c in zip(*known))
            at = pa.array(own.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [langs.take(at), sources.take(at), terms, pa.array(count, pa.int64()), pa.array(in_docs, pa.int64())],
                ["lang", "source", "term", "n", "docs"])

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _share(count: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), exact by whole decimals."""
    return F.expr(f"1 + (cast(1000000000 as decimal(38, 0)) * ({count} + 2)) div "
                  f"cast({total} + 2 * {terms} as decimal(38, 0))")


def _apart(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)) of whole numbers."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def divergence(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) that occurs in ``docs`` (lang, source, text).

    A language keeps the terms that are in at least ``least_docs`` of its
    documents; p, of a term in a group, is its smoothed share in units of
    10^-9, exact, and two shares are (p - q)^2 / (p + q) apart. Part ``pair``
    sums that over all kept terms for each other source of the language, part
    ``term`` lists the ``top`` terms that a source has more of than its
    language. Both are ranked by value and then by the item's bytes.

    Sums over all kept terms are built from those a source has: a source's
    terms against the share of an absent term in the other, which depends on
    their counts alone, and a correction for terms that both have. So nothing
    is spread over terms times sources. The terms of one language are joined
    by term; a pair of sources is summed within each task first.

    Null text, lang and source are empty strings, each row is a document
    (repeated ones too), groups without terms take part, a language without
    kept terms gives pairs of value 0, other columns are ignored, and an empty
    table gives no rows.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = term_counts(rows).repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    kept = written(counts.withColumns({
        "in_docs": F.sum("docs").over(same), "total": F.sum("n").over(same),
        "once": (F.col("source") == F.min("source").over(same)).cast("long"),
    }).where(F.col("in_docs") >= least_docs).select("lang", "term", "source", "n", "total", "once"), "kept")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.sum("once").alias("once"))
    own = Window.partitionBy("lang")
    groups = written(rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").select(
        "lang", "source", F.coalesce("size", F.lit(0)).alias("size"),
        F.coalesce(F.sum("size").over(own), F.lit(0)).alias("lang_size"),
        F.coalesce(F.sum("once").over(own), F.lit(0)).alias("terms")), "groups")
    shares = kept.join(groups, ["lang", "source"]).withColumn("p", _share("n", "size", "terms"))

    term = shares.withColumn("q", _share("total", "lang_size", "terms")).where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart("p", "q").alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    term = term.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    levels = groups.where("terms > 0").select("lang", "source", "terms", _share("0", "size", "terms").alias("zero"))
    pairs = levels.select("lang", F.col("source").alias("a"), F.col("zero").alias("a0"), "terms").join(
        levels.select("lang", F.col("source").alias("b"), F.col("zero").alias("b0")), "lang").where("a <> b")
    base = pairs.select("lang", "a", "b", (F.col("terms") * _apart("a0", "b0")).alias("value"))
    often = shares.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count("*").alias("times"))
    single = often.join(pairs, ["lang", "a"]).select(
        "lang", "a", "b", (F.col("times") * (_apart("p", "b0") - _apart("a0", "b0"))).alias("value"))
    left, right = (shares.select("lang", "term", F.col("source").alias(s), F.col("p").alias(f"{s}_p"),
                                 _share("0", "size", "terms").alias(f"{s}0")) for s in "ab")
    shared = left.join(right, ["lang", "term"]).where("a < b").select("lang", "a", "b", (
        _apart("a_p", "b_p") - _apart("a_p", "b0") - _apart("a0", "b_p") + _apart("a0", "b0")).alias("value")).groupBy(
        "lang", "a", "b").agg(F.sum("value").alias("value"))
    turned = [part.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value") for part in (single, shared)]
    others = groups.select("lang", F.col("source").alias("a")).join(
        groups.select("lang", F.col("source").alias("b")), "lang").where("a <> b").select(
        "lang", "a", "b", F.lit(0).cast("long").alias("value"))
    values = others.union(base).union(single).union(shared).union(turned[0]).union(turned[1]).groupBy(
        "lang", "a", "b").agg(F.sum("value").alias("value"))
    pair = values.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"),
                         "value").withColumn("rank", F.row_number().over(best))
    return pair.union(term)
