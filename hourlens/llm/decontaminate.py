"""Benchmark decontamination by template windows: questions with other numbers, names and units are found too.

Texts become templates: numbers, units behind numbers and names (capitalised
words, runs of them as one) are placeholders with a type, other words stand
for themselves in lower case without signs around them. The first word of a
sentence may be a name or not, and a copy may have lost its capitals: texts
are read in several ways, and a window counts when any of its readings is found.
Windows of neighbouring words of documents and benchmark items are joined by
their hash. Where windows line up, what fills the placeholders must map
one to one between item and document. Items of
fewer words than a window are one shorter window; items that are mostly names
and numbers are looked up as they stand, by windows of all their tokens.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourlens.llm.shared import release, sized, small, spare, windows, written

# Units of measure and of money, in the singular and as signs.
UNITS = """mm cm m km inch inches foot feet yard yards mile miles mg g kg t ton tons ounce ounces pound pounds ml l
 liter liters litre litres gallon gallons second seconds s minute minutes min hour hours h day days week weeks month
 months year years percent % degree degrees ° celsius fahrenheit dollar dollars $ euro euros € cent cents meter meters
 metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms watt watts kw volt volts mph
 km/h""".split()
# Numbers written as words.
NUMBERS = """two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen
 eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million""".split()

_UNITS, _NUMBERS = frozenset(UNITS), frozenset(NUMBERS)
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
_AROUND = re.compile(r"^\W+|\W+$")
_NUM, _NAME, _UNIT, _CAPITAL, _END = 1, 2, 4, 8, 16
_HASHES = {t: xxhash.xxh3_64_intdigest(f"<{t}>") for t in (_NUM, _NAME, _UNIT)}


@dataclass(frozen=True)
class Settings:
    """Words per window, how many of them must be words themselves, and the share of an item's windows to be found."""

    words: int = 5
    plain: int = 3
    share: float = 0.8
    filter_bits: int = 24


class _Words(dict):
    """Hash of each token's word, with flags in the low bits; starts anew when it is large."""

    def __missing__(self, token: str) -> int:
        plain = token.isalpha()
        word = token if plain else _AROUND.sub("", token)
        lower = word.lower()
        flags = 0
        if lower in _NUMBERS or not plain and _NUMBER.fullmatch(token.strip("()[]{}.,;:!?\"'")):
            flags |= _NUM
        if lower in _UNITS or not plain and token.strip(".,;:!?") in _UNITS:
            flags |= _UNIT
        if word[:1].isupper():
            flags |= _CAPITAL
        if not plain and token.rstrip("\"')]}»”’")[-1:] in (".", "!", "?", ":"):
            flags |= _END
        if not word and not flags & (_NUM | _UNIT):
            value = 0  # signs alone are no word
        else:
            value = xxhash.xxh3_64_intdigest(lower) >> 6 << 5 | flags
        if len(self) >= 400_000:
            self.clear()
        self[token] = value
        return value


#: Bytes of text that are read together.
CHUNK = 2 << 20


class _Tokens(dict):
    """Hash of each token as it stands, in lower case without punctuation around it; starts anew when it is large."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        self[token] = value = xxhash.xxh3_64_intdigest((token.strip("()[]{}.,;:!?\"'").lower() or token), 1)
        return value


class Texts:
    """The tokens of some texts, numbered by Arrow, so that each distinct one is looked at once.

    ``first`` holds the number of tokens before each text and, at the end, of
    all; ``doc`` the text of each token.
    """

    def __init__(self, texts: list[str | None]):
        # A unit glued to a number is a token of its own.
        apart = pc.replace_substring_regex(pa.array([t or "" for t in texts], pa.large_string()), r"([0-9])(\p{L})", r"\1 \2")
        pieces = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(apart))
        numbered = pieces.flatten().dictionary_encode()
        self.words, self.numbers = numbered.dictionary.to_pylist(), numbered.indices.to_numpy(zero_copy_only=False)
        self.first = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def look_up(self, known: dict) -> np.ndarray:
        return np.fromiter(map(known.__getitem__, self.words), np.uint64, len(self.words))[self.numbers]

    def tokens(self, first: int, last: int) -> list[str]:
        return [self.words[i] for i in self.numbers[first:last]]


class Template:
    """One reading of texts: hashes of their template's words, types (0: a word), texts, and tokens they begin with."""

    def __init__(self, texts: Texts, info: np.ndarray, names: bool, open_first: bool = False):
        flags = (info & np.uint64(31)).astype(np.int64)
        begins = np.ones(len(flags), bool)
        begins[1:] = ((flags[:-1] & _END) > 0) | (texts.doc[1:] != texts.doc[:-1])
        number = (flags & _NUM) > 0
        start = begins.copy()
        if open_first:
            start[texts.first[:-1][np.diff(texts.first) > 0]] = False
        name = (((flags & _CAPITAL) > 0) | start) & ~number if names else np.zeros(len(flags), bool)
        unit = np.zeros(len(flags), bool)
        unit[1:] = ((flags[1:] & _UNIT) > 0) & number[:-1] & (texts.doc[1:] == texts.doc[:-1])
        kinds = np.select([number, name & ~unit, unit], [_NUM, _NAME, _UNIT], 0)
        kept = info > 0
        again = np.zeros(len(kept), bool)
        again[1:] = (kinds[1:] == _NAME) & (kinds[:-1] == _NAME) & ~begins[1:]
        kept &= ~again
        value = info >> np.uint64(5)
        for kind, h in _HASHES.items():
            value[kinds == kind] = np.uint64(h)
        self.texts, self.at = texts, np.flatnonzero(kept)
        self.values, self.kinds, self.doc = value[self.at], kinds[self.at], texts.doc[self.at]
        self.first = np.searchsorted(self.doc, np.arange(len(texts.first)))

    def windows(self, size: int, plain: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first place of every window of one text with enough plain words."""
        if len(self.values) < size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = windows(self.values, size).view(np.int64)
        words = np.concatenate([[0], np.cumsum(self.kinds == 0)])
        good = (words[size:] - words[:-size] >= min(plain, size)) & (self.doc[size - 1:] == self.doc[:len(self.doc) - size + 1])
        at = np.flatnonzero(good)
        return hashes[at], at

    def slots(self, place: int, size: int) -> list[str]:
        """Values of the placeholders in a window, each with its type in front."""
        out = []
        for i in range(place, min(place + size, len(self.kinds))):
            if self.kinds[i]:
                stop = self.at[i] + 1
                if self.kinds[i] == _NAME:
                    last = i + 1 == len(self.at) or self.doc[i + 1] != self.doc[i]
                    stop = self.texts.first[self.doc[i] + 1] if last else self.at[i + 1]
                out.append(f"{self.kinds[i]}:" + " ".join(
                    _AROUND.sub("", t).lower() or t for t in self.texts.tokens(self.at[i], stop)))
        return out


def readings(texts: Texts, known: dict, open_first: bool = False) -> list[Template]:
    """Texts with names and with none. A window counts when either reading of it is found.

    Where there are names, capitalised words are, and so is the first word of
    every sentence whatever it is: it cannot be told from a name there. With
    ``open_first`` the first word of a text is also read as it would be
    inside a sentence, where a text may have been put.
    """
    info = texts.look_up(known)
    found = [Template(texts, info, True), Template(texts, info, False)]
    return found + [Template(texts, info, True, True)] if open_first else found


def template(text: str | None, known: dict, names: bool = True) -> Template:
    texts = Texts([text])
    return Template(texts, texts.look_up(known), names)


def _items(benchmark: DataFrame, s: Settings) -> DataFrame:
    """(item_id, hash, size, literal, place, counted, total, item_values) of the items' windows in all readings.

    ``counted`` is the window's first token, in a run of names that of the
    run: it is one in all readings. The windows that count are those with
    enough plain words where there are names, or else those of any reading. Where these have none either,
    all windows of the tokens as they stand count (``literal``), unless no
    token has a letter or digit.
    """

    def run(batches):
        known, tokens = _Words(), _Tokens()
        for batch in small(batches):
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts = Texts([text])
                some = readings(texts, known, open_first=True)
                names, found = some[0], []
                for read in some:
                    size = min(s.words, len(read.values))
                    if size:
                        hashes, places = read.windows(size, s.plain)
                        heads = names.at[np.maximum(np.searchsorted(names.at, read.at[places], "right") - 1, 0)]
                        found += [(h, size, p, c, tuple(read.slots(p, size)))
                                  for h, p, c in zip(hashes.tolist(), places.tolist(), heads.tolist())]
                size = min(s.words, len(names.values))
                counted = set(names.at[names.windows(size, s.plain)[1]].tolist()) if size else set()
                counted = counted or {c for _, _, _, c, _ in found}
                rows += {(item, h, n, False, p, c, len(counted), values) for h, n, p, c, values in found if c in counted}
                if not counted and any(map(str.isalnum, text or "")):
                    values = texts.look_up(tokens)
                    hashes = windows(values, s.words).view(np.int64).tolist()
                    rows += [(item, h, min(s.words, len(values)), True, p, p, len(hashes), ()) for p, h in enumerate(hashes)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(
                    (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string())))],
                ["item_id", "hash", "size", "literal", "place", "counted", "total", "item_values"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return items.mapInArrow(
        run, "item_id long, hash long, size int, literal boolean, place int, counted int, total int, item_values array<string>")


def matches(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Documents that hold benchmark items: doc_id, text_key, item_id, found, share, changed.

    ``found`` of the item's windows lie in the document with values that map
    one to one, or unchanged, which is ``share`` of them, at least ``settings.share``;
    ``changed`` tells whether some value differs. ``text_key`` is a hash of the
    text, for rows of different texts with one doc_id. All windows of all
    texts are looked at: a bitmap of fixed size, made of the items' hashes,
    keeps those that may match, and the join is by the whole hash. Null and
    empty texts and items match nothing, nor do items without a letter or digit; one
    item on several rows is looked up as one row each; rows repeated give one
    result; an item shorter than a window is one window, of which every text
    is searched.
    """
    s = settings
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = written(_items(benchmark, s), "items")
    mask = (1 << s.filter_bits) - 1
    bits = np.zeros(1 << s.filter_bits, bool)
    for row in items.select(F.col("hash").bitwiseAND(F.lit(mask)).alias("bit")).distinct().toLocalIterator():
        bits[row.bit] = True
    sizes = {flag: sorted(r["size"] for r in items.where(F.col("literal") == flag).select("size").distinct().collect())
             for flag in (False, True)}
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits, bitorder="little"))

    def run(batches):
        known, tokens, filter_ = _Words(), _Tokens(), shared.value

        def hits(hashes):
            bit = hashes & np.int64(mask)
            return np.flatnonzero((filter_[bit >> np.int64(3)] >> (bit & np.int64(7)).astype(np.uint8)) & np.uint8(1))

        for batch in sized(batches, 2, CHUNK):
            if not batch.num_rows:
                continue
            rows, texts = set(), Texts(batch.column(2).to_pylist())
            for read in readings(texts, known) if sizes[False] else []:
                for size in sizes[False]:
                    hashes, places = read.windows(size, s.plain)
                    at = hits(hashes)
                    rows |= {(d, h, p - f, tuple(read.slots(p, size))) for h, p, d, f in zip(
                        hashes[at].tolist(), places[at].tolist(), read.doc[places[at]].tolist(),
                        read.first[read.doc[places[at]]].tolist())}
            values = texts.look_up(tokens) if sizes[True] else np.zeros(0, np.uint64)
            for size in sizes[True]:
                if len(values) >= size:
                    hashes = windows(values, size).view(np.int64)
                    at = hits(hashes)
                    at = at[texts.doc[at] == texts.doc[at + size - 1]]
                    rows |= {(d, h, p, ()) for h, p, d in zip(
                        hashes[at].tolist(), (at - texts.first[texts.doc[at]]).tolist(), texts.doc[at].tolist())}
            rows = list(rows)
            of = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(of), batch.column(1).take(of), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(
                    (pa.int64(), pa.int32(), pa.list_(pa.string())), 1))],
                ["doc_id", "text_key", "hash", "doc_place", "doc_values"])
        known.clear(), tokens.clear()
        release()

    hits = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        run, "doc_id long, text_key long, hash long, doc_place int, doc_values array<string>")
    both = hits.join(items, "hash").withColumn("shift", F.col("doc_place") - F.col("place"))
    # Windows of one shift lie over the item as one. What fills their slots there must be one to one; where it is not,
    # the windows whose values the document has unchanged are found all the same.
    pair = F.zip_with("item_values", "doc_values", lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    same = F.forall(pair, lambda p: p["x"] == p["y"])
    laid = both.groupBy("doc_id", "text_key", "item_id", "total", "shift").agg(
        F.collect_set("counted").alias("places"), F.collect_set(F.when(same, F.col("counted"))).alias("equal"),
        F.array_distinct(F.flatten(F.collect_set(pair))).alias("pairs"))
    one = [F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p[side]))) for side in "xy"]
    found = F.when(one[0] & one[1], F.col("places")).otherwise(F.col("equal"))
    changed = (one[0] & one[1]) & F.exists("pairs", lambda p: p["x"] != p["y"])
    return laid.groupBy("doc_id", "text_key", "item_id", "total").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(found)))).alias("found"),
        F.max(changed).alias("changed")).withColumn("share", F.col("found") / F.col("total")).where(
        F.col("share") >= s.share).select("doc_id", "text_key", "item_id", "found", "share", "changed")


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, and any others), with all columns, that hold no benchmark item.

    Rows go by doc_id and text: of rows with one doc_id, or none, only those
    whose text holds an item. Null and empty texts stay; repeated rows go or
    stay together; an empty table gives an empty table.
    """
    id_, key = spare("id", docs), spare("key", docs)
    held = written(matches(docs, benchmark, settings).select(
        F.col("doc_id").alias(id_), F.col("text_key").alias(key)).distinct(), "held")
    return docs.join(held, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key)), "left_anti")
