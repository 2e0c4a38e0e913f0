"""Fill-in-the-middle: documents cut at two token borders, which a learned rank index finds, and rearranged."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourlens.llm.shared import sized, utf8

#: Marks of prefix, suffix and middle. None is the end of another, so none can arise where two parts meet.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of text that are indexed together.
CHUNK = 4 << 20
#: Most ranks in a segment, and the largest residual a segment may have (residuals are stored in a byte).
SPAN, ERROR = 4096, 127

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def borders(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, first): places of all token borders in the joined texts, and the rank of each text's first border.

    Tokens are ``[A-Za-z]+|[^A-Za-z]`` over code points. A text of n tokens
    has n + 1 borders, from its own start to its own end.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    starts = ends - [len(t) for t in texts]
    letter = _LETTER[data]
    begins = (data & 0xC0) != 0x80
    inner = letter[1:] & letter[:-1]
    begins[1:] &= ~inner
    begins[starts[starts < ends]] = True
    places = np.flatnonzero(begins)
    before = np.searchsorted(places, starts)
    n = np.searchsorted(places, ends) - before
    first = np.concatenate([[0], np.cumsum(n + 1)]).astype(np.int64)
    offsets = np.empty(first[-1], np.int64)
    offsets[np.arange(len(places)) + np.repeat(np.arange(len(texts)), n)] = places
    offsets[first[1:] - 1] = ends
    return offsets, first


class RankIndex:
    """Offsets of borders by rank: line segments that miss none by more than ``ERROR``, and what they miss it by.

    Segments begin with at most ``SPAN`` ranks of one text; a segment's line
    goes through its first and last border. Those that miss a border by more
    than the bound are halved until none does; two borders are always met.
    All arithmetic is on whole numbers, so the corrected place is exact.
    """

    def __init__(self, offsets: np.ndarray, first: np.ndarray, span: int = SPAN, error: int = ERROR):
        sizes = np.diff(first)
        pieces = -(-sizes // span)
        start = np.repeat(first[:-1], pieces) + span * (np.arange(pieces.sum()) - np.repeat(
            np.cumsum(pieces) - pieces, pieces))
        stop = np.minimum(start + span, np.repeat(first[1:], pieces))
        self.residuals = np.zeros(len(offsets), np.int8)
        done = []
        while len(start):
            length = stop - start
            low, rise, run = offsets[start], offsets[stop - 1] - offsets[start], np.maximum(length - 1, 1)
            heads = np.cumsum(length) - length
            step = np.arange(length.sum()) - np.repeat(heads, length)
            ranks = np.repeat(start, length) + step
            missed = offsets[ranks] - np.repeat(low, length) - np.repeat(rise, length) * step // np.repeat(run, length)
            fits = np.maximum.reduceat(np.abs(missed), heads) <= error
            held = np.repeat(fits, length)
            self.residuals[ranks[held]] = missed[held]
            done.append(np.stack([start[fits], low[fits], rise[fits], run[fits]]))
            start, stop = start[~fits], stop[~fits]
            half = (start + stop) // 2
            start, stop = np.concatenate([start, half]), np.concatenate([half, stop])
        found = np.concatenate(done, axis=1) if done else np.zeros((4, 0), np.int64)
        self.start, self.low, self.rise, self.run = found[:, np.argsort(found[0])]

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.start, ranks, "right") - 1
        return self.low[at] + self.rise[at] * (ranks - self.start[at]) // self.run[at]

    def place(self, ranks: np.ndarray) -> np.ndarray:
        """Exact offsets: what the segments predict, corrected by the stored residuals."""
        return self.predict(ranks) + self.residuals[ranks]


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """h1 to h4: the first four groups of 8 hexadecimal digits of sha256 of ``seed:doc_id`` (null: no digits)."""
    text = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(text[i:i + 8], 16) for i in range(0, 32, 8))


def _arrange(ids: list[int | None], texts: list[bytes], plain: int, spm: int, seed: int) -> pa.RecordBatch:
    offsets, first = borders(texts)
    index = RankIndex(offsets, first)
    n = np.diff(first) - 1
    drawn = np.array([draws(i, seed) for i in ids], np.int64).reshape(-1, 4)
    cuts = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1)
    own = np.cumsum([0, *map(len, texts)])[:-1, None]
    places = index.place((first[:-1, None] + cuts).reshape(-1)).reshape(-1, 2) - own
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    out = []
    for text, (a, b), (_, _, h3, h4) in zip(texts, places.tolist(), drawn.tolist()):
        if not text or p in text or s in text or m in text or h3 % 100 >= plain:
            out.append(("plain", None, None, text))
            continue
        before, middle, after = text[:a], text[a:b], text[b:]
        form, parts = ("spm", (s, after, p, before, m, middle)) if h4 % 100 < spm else (
            "psm", (p, before, s, after, m, middle))
        out.append((form, len(before.decode()), len(middle.decode()), b"".join(parts)))
    form, before, middle, text = zip(*out)
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(form), pa.array(before, pa.int64()),
        pa.array(middle, pa.int64()), pa.array(text, pa.string())],
        ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def rearrange(docs: DataFrame, plain: int = 90, spm: int = 20, seed: int = 1) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row of ``docs`` (doc_id, text).

    ``n`` counts tokens (see :func:`borders`). Numbers drawn from the doc_id
    (:func:`draws`) choose both cuts among the n + 1 borders, whether a text
    stays ``plain`` (those of ``plain`` percent do not) and whether its suffix
    goes first (``spm``, of ``spm`` percent) or its prefix (``psm``). Empty
    texts, null ones among them, and texts that hold a mark are plain; their
    output is the text and their counts of characters are null.

    Rows are treated one by one without a shuffle: repeated rows give repeated
    results, rows of one doc_id on different texts draw the same numbers, a
    null doc_id draws as if it had no digits, other columns are ignored, and
    an empty table gives no rows. Texts are taken whole.
    """

    def run(batches):
        for batch in sized(batches, 1, CHUNK):
            if batch.num_rows:
                yield _arrange(batch.column(0).to_pylist(), utf8(batch.column(1)), plain, spm, seed)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that a rearranged output was made from."""

    def between(start: Column | int, end: Column) -> Column:
        return F.substring(output, F.lit(start) if isinstance(start, int) else start, end - start)

    p, s, m, end = F.instr(output, PREFIX), F.instr(output, SUFFIX), F.instr(output, MIDDLE), F.length(output) + 1
    psm = F.concat(between(4, s), between(m + 3, end), between(s + 3, m))
    spm = F.concat(between(p + 3, m), between(m + 3, end), between(4, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
