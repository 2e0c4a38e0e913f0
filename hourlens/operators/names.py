"""Known names and aliases: lookup, variations, fuzzy match, search, maintenance.

Text-to-name matching is written as equi-joins on first words or short pieces,
so Spark hashes or broadcasts it by size; nothing compares every text with
every name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourlens.functions import extract as X
from hourlens.operators.partitioning import materialize

WORD = r"[\p{L}\p{N}_]+"


# --- aliases -------------------------------------------------------------------


def variations_long(aliases: DataFrame) -> DataFrame:
    """Every spelling of a canonical name; the name itself stands before its aliases."""
    canonicals = aliases.groupBy("entity_type", "canonical").agg(
        F.min("canonical_seq").alias("canonical_seq")
    ).select(
        "entity_type", "canonical", "canonical_seq",
        F.col("canonical").alias("variation"), F.lit(-1).alias("alias_seq"),
    )
    listed = aliases.where(F.col("alias").isNotNull()).select(
        "entity_type", "canonical", "canonical_seq", F.col("alias").alias("variation"), "alias_seq"
    )
    return canonicals.unionByName(listed)


def alias_lookup(aliases: DataFrame) -> DataFrame:
    """(entity_type, key) -> canonical; a spelling with several owners goes to the last inserted."""
    return variations_long(aliases).groupBy(
        "entity_type", F.lower("variation").alias("key")
    ).agg(F.max_by("canonical", F.struct("canonical_seq", "alias_seq")).alias("canonical"))


def normalize_names(df: DataFrame, aliases: DataFrame, value: str = "value", kind: str = "entity_type") -> DataFrame:
    """Add ``normalized``: the canonical name of ``value``, or ``value`` itself."""
    lookup = alias_lookup(aliases).select(
        F.col("entity_type").alias("_type"), F.col("key").alias("_key"), "canonical"
    )
    hit = (F.col(kind) == F.col("_type")) & (F.lower(F.trim(F.col(value))) == F.col("_key"))
    return df.join(lookup, hit, "left").select(
        *df.columns, F.coalesce("canonical", F.col(value)).alias("normalized")
    )


def alias_variations(aliases: DataFrame) -> DataFrame:
    """(entity_type, canonical, variations): the name, then its aliases in insertion order."""
    ordered = F.array_sort(F.collect_list(F.struct("alias_seq", "variation")))
    return variations_long(aliases).groupBy("entity_type", "canonical").agg(
        F.transform(ordered, lambda v: v["variation"]).alias("variations")
    )


def with_variations(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Add ``variations`` of each normalized mention; an unknown name varies only as itself."""
    known = alias_variations(aliases).withColumnsRenamed({"canonical": "normalized"})
    return mentions.join(known, ["entity_type", "normalized"], "left").withColumn(
        "variations", F.coalesce("variations", F.array("normalized"))
    )


def alias_collisions(aliases: DataFrame) -> DataFrame:
    """Spellings that point to more than one canonical name, with their number of owners."""
    owners = aliases.where(F.col("alias").isNotNull()).groupBy(
        "entity_type", F.lower("alias").alias("alias")
    ).agg(F.countDistinct("canonical").alias("owners"))
    return owners.where(F.col("owners") > 1)


def alias_stats(aliases: DataFrame) -> DataFrame:
    """Number of types, canonical names and aliases."""
    return aliases.agg(
        F.countDistinct("entity_type").alias("entity_types"),
        F.countDistinct("entity_type", "canonical").alias("canonicals"),
        F.count("alias").alias("aliases"),
    )


def canonicals_by_type(aliases: DataFrame) -> DataFrame:
    """Canonical names of each type with their place in insertion order."""
    return aliases.groupBy("entity_type", "canonical").agg(F.min("canonical_seq").alias("canonical_seq"))


def alias_upsert(aliases: DataFrame, new: DataFrame) -> DataFrame:
    """Add (entity_type, canonical, alias) rows that are not there yet.

    A new canonical goes behind the last one of its type, a new alias behind
    the last one of its canonical; ``added`` tells the new rows apart.
    """
    from pyspark.sql import Window

    fresh = new.distinct().join(
        aliases.select("entity_type", "canonical", "alias"), ["entity_type", "canonical", "alias"], "left_anti"
    )
    last_of_type = aliases.groupBy("entity_type").agg(F.max("canonical_seq").alias("_last_canonical"))
    owners = aliases.groupBy("entity_type", "canonical").agg(
        F.min("canonical_seq").alias("_known"), F.max("alias_seq").alias("_last_alias")
    )
    joined = fresh.join(owners, ["entity_type", "canonical"], "left").join(last_of_type, "entity_type", "left")
    unknown_first = Window.partitionBy("entity_type").orderBy(F.col("_known").isNotNull(), "canonical")
    within = Window.partitionBy("entity_type", "canonical").orderBy("alias")
    placed = joined.select(
        "entity_type", "canonical",
        F.coalesce(
            "_known", F.coalesce("_last_canonical", F.lit(-1)) + F.dense_rank().over(unknown_first)
        ).cast("int").alias("canonical_seq"),
        "alias",
        (F.coalesce("_last_alias", F.lit(-1)) + F.row_number().over(within)).cast("int").alias("alias_seq"),
        F.lit(True).alias("added"),
    )
    return aliases.withColumn("added", F.lit(False)).unionByName(placed)


def alias_remove(aliases: DataFrame, gone: DataFrame) -> DataFrame:
    """Drop (entity_type, canonical, alias) rows; another owner of the spelling keeps it.

    A canonical that loses its last alias stays, with a NULL alias.
    """
    keys = ["entity_type", "canonical", "alias"]
    left = aliases.join(gone.select(*keys).distinct(), keys, "left_anti")
    bare = (
        aliases.join(left.select("entity_type", "canonical"), ["entity_type", "canonical"], "left_anti")
        .groupBy("entity_type", "canonical").agg(F.min("canonical_seq").alias("canonical_seq"))
        .select("entity_type", "canonical", "canonical_seq",
                F.lit(None).cast("string").alias("alias"), F.lit(None).cast("int").alias("alias_seq"))
    )
    return left.unionByName(bare)


def alias_search(aliases: DataFrame, term: str, entity_type: str | None = None) -> DataFrame:
    """Canonical names with a spelling that contains ``term``: exact hits first, then most hits."""
    rows = variations_long(aliases)
    if entity_type is not None:
        rows = rows.where(F.col("entity_type") == entity_type)
    wanted = F.lower(F.lit(term.strip()))
    spelled = F.lower("variation")
    return (
        rows.where(F.contains(spelled, wanted))
        .groupBy("entity_type", "canonical")
        .agg(F.count_if(spelled == wanted).alias("exact_hits"), F.count("*").alias("hits"))
        .orderBy(F.desc("exact_hits"), F.desc("hits"), "entity_type", "canonical")
    )


# --- containment as equi-joins -----------------------------------------------------


#: Characters of the pieces by which contained texts are looked up; shorter texts are looked up as they are.
GRAM = 3
#: Places of a text from which its rarest piece is taken.
PLACES = 1 << 20


def _grams(text: Column, size: Column) -> Column:
    """Distinct pieces of ``size`` characters of a text."""
    count = F.length(text) - size + 1
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(text, i, size))
    return F.when(count >= 1, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def containing_pairs(
    needles: DataFrame, needle: str, texts: DataFrame, text: str, on: list[str], min_ratio: float = 0.0
) -> DataFrame:
    """All columns of both sides where ``text`` contains ``needle`` and is at most 1 / ``min_ratio`` times as long.

    A needle is looked up by one piece of GRAM characters only, the one that
    the fewest texts have, and compared with these; one that has a piece no
    text has meets nothing. A text of n characters gives up to 3 n
    pieces, whatever the needles are. Empty and null needles are in nothing.
    """
    size = F.least(F.length(needle), F.lit(GRAM))
    number = lambda column: F.xxhash64(*on, column)
    # Needles, texts and pieces go by hashes, so that a task holds narrow rows; what they meet is compared with the
    # text itself, and whatever piece of a needle is looked up, its texts have it.
    asked = needles.select(*on, needle).where(F.length(needle) > 0).distinct().withColumn("_n", number(needle))
    cut = F.explode(F.flatten(F.transform(F.array(*map(F.lit, range(1, GRAM + 1))), lambda n: _grams(F.col(text), n))))
    # Texts are made distinct, not their many pieces, which would fill a task's memory; a text's pieces are distinct.
    distinct = texts.where(F.length(text) > 0).select(*on, text).distinct()
    index = distinct.select(*on, F.xxhash64(text).alias("_h"), cut.alias("_gram")).select(number("_gram").alias("_g"), "_h")
    held = index.groupBy("_g").agg(F.count("*").alias("_df"))
    # The rarest piece as one number, its count and place: a minimum that is hashed by needle, not a sort of all pieces.
    own = F.slice(_grams(F.col(needle), size), 1, PLACES)
    pieces = asked.select(*on, "_n", F.posexplode(own).alias("_at", "_gram")).select("_n", "_at", number("_gram").alias("_g"))
    rarest = pieces.join(held, "_g", "left").groupBy("_n").agg(
        F.min(F.coalesce("_df", F.lit(0)) * PLACES + F.col("_at")).alias("_r"))
    place = (F.col("_r") % PLACES).cast("int")
    rare = asked.join(rarest, "_n").withColumn("_gram", F.coalesce(F.get(own, place), F.get(own, F.lit(0)))).select(
        *on, needle, number("_gram").alias("_g"))
    met = rare.join(index, "_g").select(*on, needle, "_h").distinct()
    found = texts.withColumn("_h", F.xxhash64(text)).join(met, [*on, "_h"]).where(
        F.contains(text, F.col(needle)) & (F.length(needle) >= F.length(text) * F.lit(min_ratio) - F.lit(1e-9)))
    return needles.join(found.drop("_h").distinct(), [*on, needle])


def containment_pairs(
    left: DataFrame, left_text: str, right: DataFrame, right_text: str, on: list[str], min_ratio: float = 0.0
) -> DataFrame:
    """Pairs where either text contains the other, with score = shorter / longer length (at least ``min_ratio``).

    Exact, in both directions by :func:`containing_pairs`; empty texts are in no pair.
    """
    columns = [*left.columns, *(c for c in right.columns if c not in on)]
    a = containing_pairs(right, right_text, left, left_text, on, min_ratio).select(*columns)
    b = containing_pairs(left, left_text, right, right_text, on, min_ratio).select(*columns)
    short = F.least(F.length(left_text), F.length(right_text))
    long = F.greatest(F.length(left_text), F.length(right_text))
    return a.unionByName(b).distinct().withColumn("score", short / long)


def fuzzy_canonical(df: DataFrame, aliases: DataFrame, threshold: float = 0.8,
                    value: str = "value", kind: str = "entity_type") -> DataFrame:
    """Add ``canonical`` and ``score``: the exact owner, else the best containing spelling, else NULL.

    Works on distinct (type, text) pairs; among equal scores the first inserted spelling wins.
    """
    texts = df.select(
        F.col(kind).alias("entity_type"), F.lower(F.trim(F.col(value))).alias("_text")
    ).distinct()
    spelled = variations_long(aliases).select(
        "entity_type", "canonical", "canonical_seq", "alias_seq", F.lower("variation").alias("_variation")
    )
    near = containment_pairs(texts, "_text", spelled, "_variation", ["entity_type"], threshold)
    rank = F.struct(F.col("score"), -F.col("canonical_seq"), -F.col("alias_seq"))
    best = near.where(F.col("score") >= threshold).groupBy("entity_type", "_text").agg(
        F.max_by("canonical", rank).alias("_near"), F.max("score").alias("_near_score")
    )
    exact = alias_lookup(aliases).withColumnsRenamed({"key": "_text", "canonical": "_exact"})
    resolved = (
        texts.join(exact, ["entity_type", "_text"], "left").join(best, ["entity_type", "_text"], "left")
        .select(
            F.col("entity_type").alias("_type"), "_text",
            F.coalesce("_exact", "_near").alias("canonical"),
            F.when(F.col("_exact").isNotNull(), F.lit(1.0)).otherwise(F.col("_near_score")).alias("score"),
        )
    )
    same = (F.col(kind) == F.col("_type")) & (F.lower(F.trim(F.col(value))) == F.col("_text"))
    return df.join(resolved, same, "left").drop("_type", "_text")


def rows_containing(values: DataFrame, value: str, dim: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(value, key): dimension rows whose name columns contain each distinct value, ignoring case.

    The set form of a ``LIKE '%value%'`` filter (:func:`containing_pairs`).
    """
    wanted = values.select(value).where(F.length(value) > 0).distinct().select(F.col(value), F.lower(value).alias("_needle"))
    names = dim.select(key, F.explode(F.array(*(F.lower(F.col(c)) for c in columns))).alias("_text")).where("_text IS NOT NULL")
    return containing_pairs(wanted, "_needle", names, "_text", []).select(value, key).distinct()


# --- dictionary matching ----------------------------------------------------------------


def known_names(dictionary: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(entity_type, name, canonical): dictionary names plus, if given, every alias."""
    names = dictionary.where(F.length(F.trim("entity")) >= 2).select(
        "entity_type", F.trim("entity").alias("name")
    ).distinct()
    if aliases is None:
        return names.withColumn("canonical", F.col("name"))
    spelled = variations_long(aliases).select("entity_type", F.col("variation").alias("name"))
    return (
        normalize_names(names.unionByName(spelled), aliases, "name")
        .groupBy("entity_type", F.lower("name").alias("_key"))
        .agg(F.min("name").alias("name"), F.max("normalized").alias("canonical")).drop("_key")
    )


def _starts_chinese(name: Column) -> Column:
    return F.rlike(name, F.lit(f"^[{X.CJK}]"))


_LEAD, _TRAIL = r"^[^\p{L}\p{N}_]+", r"[^\p{L}\p{N}_]+$"


#: Words (characters of a Chinese name) by which a name is looked up at most, and signs that are carried around them.
HEAD, SIGNS = 8, 4

_HEAD = "struct<start:int,before:int,around:string,first:string,chinese:boolean>"


def _head(text: Column, start: Column, end: Column, first: Column, chinese: bool) -> Column:
    """A place where a name may begin: up to HEAD words from there, with a few signs around them."""
    before = F.least(start, F.lit(SIGNS))
    around = F.substring(text, start - before + 1, before + end - start + SIGNS)
    return F.struct(start.alias("start"), before.alias("before"), around.alias("around"), first.alias("first"),
                    F.lit(chinese).alias("chinese"))


#: A word with what lies in front of it.
_CHUNK = rf"[^\p{{L}}\p{{N}}_]*{WORD}"


#: Size of the map of first words; it changes speed only.
MARKS = 1 << 14


def _mark(word: Column) -> Column:
    return F.pmod(F.hash(word), F.lit(MARKS))


def _may_begin(index: DataFrame):
    """A test of lower-case words: false only for words with which no name of ``index`` begins."""
    marks = bytearray(MARKS)
    for row in index.select(_mark(F.col("first")).alias("mark")).distinct().collect():
        marks[row.mark] = 1
    return lambda word: F.substring(F.lit(bytes(marks)), _mark(word) + 1, F.lit(1)) == F.lit(b"\x01")


def _word_heads(text: Column, words: Column, chunks: Column, at: Column, starts: Column) -> Column:
    """Heads at the words whose places are ``at``."""
    def head(i: Column, start: Column) -> Column:
        first = F.get(words, i)
        rest = F.array_join(F.slice(chunks, i + 2, F.lit(HEAD - 1)), "")
        return _head(text, start, start + F.length(first) + F.length(rest), first, False)

    return F.zip_with(at, starts, head)


def _chinese_heads(text: Column) -> Column:
    size = F.length(text)
    starts = F.filter(
        F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))),
        lambda p: _starts_chinese(F.substring(text, p + 1, F.lit(1))),
    )
    heads = F.transform(starts, lambda p: _head(text, p, F.least(p + HEAD, size), F.substring(text, p + 1, F.lit(1)), True))
    return F.when(X.has_chinese(text), heads).otherwise(F.array().cast(f"array<{_HEAD}>"))


def _meeting(pieces: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Inner join in which only ``known`` may be broadcast.

    Pieces of texts are many times what the planner takes the texts for, so
    they must not be gathered. A left join builds its right side, and the
    generator keeps later filters from turning it into an inner join.
    """
    rows = known.select(*on, F.struct(*(c for c in known.columns if c not in on)).alias("_known"))
    met = pieces.join(rows, on, "left").select(*pieces.columns, F.explode_outer(F.array("_known")).alias("_known"))
    return met.where("_known IS NOT NULL").select(*pieces.columns, "_known.*")


def name_index(names: DataFrame) -> DataFrame:
    """Names as they are looked up: their first word, how many words (at most HEAD) are looked up, and these as one piece.

    ``whole`` tells whether the piece and the signs carried around it are all
    of the name; the others are compared with the text itself.
    """
    bare = F.regexp_replace(F.regexp_replace("name", _LEAD, ""), _TRAIL, "")
    signs = [F.length(F.regexp_extract("name", pattern, 0)) for pattern in (_LEAD, _TRAIL)]
    rows = names.select("entity_type", "canonical", "name", bare.alias("bare"), *(
        n.alias(c) for n, c in zip(signs, ("lead", "trail"))), _starts_chinese(bare).alias("chinese")).where(F.length("bare") > 0)
    size = F.when(F.col("chinese"), F.length("bare")).otherwise(F.size(X.matches(F.col("bare"), WORD)))
    rows = rows.withColumn("size", size)
    words = F.regexp_extract("bare", rf"^{WORD}(?:[^\p{{L}}\p{{N}}_]+{WORD}){{0,{HEAD - 1}}}", 0)
    piece = F.when(F.col("chinese"), F.substring("bare", 1, HEAD)).otherwise(words)
    first = F.when(F.col("chinese"), F.substring("bare", 1, 1)).otherwise(F.regexp_extract("bare", WORD, 0))
    return rows.select(
        "entity_type", "canonical", "chinese", "lead", F.lower("name").alias("_name"), F.lower("bare").alias("_bare"),
        F.lower(first).alias("first"), F.least("size", F.lit(HEAD)).alias("words"), F.lower(piece).alias("piece"),
        ((F.col("size") <= HEAD) & (F.greatest("lead", "trail") <= SIGNS)).alias("whole"))


def dictionary_hits(texts: DataFrame, names: DataFrame, key: str = "question_id", text: str = "text") -> DataFrame:
    """Every known name in every text: (key, start, end, entity_type, value, canonical).

    Latin names match whole words, ignoring case; Chinese names match anywhere.
    Names are looked up like in a trie cut at two levels: each word of a text
    that a small map of hashes does not rule out is joined with the first words of names, and only where one begins are as
    many words as names with that beginning have, HEAD at most, joined with
    the names themselves. A row carries HEAD words, never its text, however
    long a name is; names with more words are compared with the text, which is
    read once more for the places that begin like them.
    """
    body = F.col(text)
    # As tables their sizes are known, so that texts are not shuffled to meet a few names.
    index = materialize(name_index(names))
    begun = materialize(index.groupBy("first", "chinese").agg(F.collect_set("words").alias("sizes")))
    may_begin = _may_begin(index)
    places = F.filter(F.transform("_words", lambda w, i: F.when(may_begin(F.lower(w)), i)), lambda i: i.isNotNull())
    start = lambda i: F.length(F.array_join(F.slice("_chunks", F.lit(1), i + 1), "")) - F.length(F.get("_words", i))
    read = texts.select(key, text, X.matches(body, WORD).alias("_words"), X.matches(body, _CHUNK).alias("_chunks")).withColumn(
        "_at", places).withColumn("_starts", F.transform("_at", start))
    heads = read.select(key, F.explode(F.concat(
        _word_heads(body, *map(F.col, ("_words", "_chunks", "_at", "_starts"))), _chinese_heads(body))).alias("_h")).select(
        key, "_h.start", "_h.before", "_h.around", F.lower("_h.first").alias("first"), "_h.chinese")
    # What a head can hold: its words with the signs between them, or its characters.
    bare = F.expr("substring(around, before + 1)")
    chunks = F.when(F.col("chinese"), F.split(bare, "")).otherwise(X.matches(bare, _CHUNK))
    met = _meeting(heads, begun, ["first", "chinese"]).withColumn("_chunks", chunks).select(
        key, "start", "before", "around", "chinese", "_chunks",
        F.explode(F.filter("sizes", lambda n: n <= F.size("_chunks"))).alias("words"))
    piece = F.lower(F.array_join(F.slice("_chunks", F.lit(1), F.col("words")), ""))
    pieces = _meeting(met.withColumn("piece", piece).drop("_chunks"), index, ["piece", "words", "chinese"])
    start = F.col("start") - F.col("lead")
    out = [key, start.alias("start"), (start + F.length("_name")).alias("end"), "entity_type"]
    value = F.substring(F.col("around"), F.col("before") - F.col("lead") + 1, F.length("_name"))
    found = pieces.where(F.col("whole") & (start >= 0) & (F.lower(value) == F.col("_name"))).select(
        *out, value.alias("value"), "canonical")
    if index.where(~F.col("whole")).isEmpty():
        return found
    begins = pieces.where(~F.col("whole") & (start >= 0)).select(
        F.col(key).alias("_key"), "start", "lead", "_name", "_bare", "entity_type", "canonical", "chinese")
    value = F.substring(body, start + 1, F.length("_name"))
    behind = F.substring(body, F.col("start") + F.length("_bare") + 1, F.lit(1))
    rest = begins.join(texts.select(key, text), F.col("_key") == F.col(key)).where(
        (F.lower(value) == F.col("_name")) & (F.col("chinese") | ~F.rlike(behind, F.lit(WORD))))
    return found.unionByName(rest.select(*out, value.alias("value"), "canonical"))


def partial_chinese_matches(texts: DataFrame, names: DataFrame, key: str = "question_id", text: str = "text") -> DataFrame:
    """(key, entity_type, entity): a run of two or more Chinese characters and a name contain one another."""
    runs = texts.select(key, F.explode(X.matches(F.col(text), f"[{X.CJK}]{{2,}}")).alias("_run"))
    distinct = runs.select("_run").distinct()
    known = names.select("entity_type", F.col("name").alias("entity")).where(F.length("entity") >= 2)
    pairs = containment_pairs(distinct, "_run", known, "entity", [])
    return runs.join(pairs, "_run").select(key, "entity_type", "entity").distinct()
