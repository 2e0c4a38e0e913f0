"""Question log -> mentions and skeletons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourlens.functions import extract as X
from hourlens.functions.normalize import normalize_value
from hourlens.operators.names import dictionary_hits, known_names
from hourlens.operators.partitioning import materialize, spread


def _mask(text, kept):
    """The text with kept mentions blanked out, same length."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, m):
        gap = F.substring(text, acc["at"] + 1, m["start"] - acc["at"])
        return F.struct((-m["neg_end"]).alias("at"),
                        F.concat(acc["out"], gap, F.repeat(F.lit(" "), -m["neg_end"] - m["start"])).alias("out"))

    return F.aggregate(kept, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def find_mentions(
    questions: DataFrame, dictionary: DataFrame | None, aliases: DataFrame | None = None,
    as_of: str = "ts", chinese: bool = True, partitions: int | None = None, spans: bool = False,
) -> DataFrame:
    """Questions with their values as ``entities`` and their ``skeleton``; with ``spans`` also ``kept``.

    What does not depend on the day is found once for each distinct text, where
    it lies; logs repeat their questions. Only dictionary hits are grouped by
    text, and a text's hits are bounded by its length. ``partitions`` deals the
    texts out first, for logs in few files.
    """
    texts = distinct_texts(questions, partitions)
    text = F.col("text")
    none = F.array().cast(f"array<{X.MENTION}>")
    found = texts.withColumn("_found", X.pattern_mentions(text))
    if dictionary is not None:
        names = known_names(dictionary, aliases)
        hit = X.mention(F.col("start"), F.col("end"), F.col("entity_type"), F.col("value"), F.col("canonical"))
        hits = dictionary_hits(texts, names, "text_id").groupBy("text_id").agg(
            F.collect_list(hit).alias("_hits")
        )
        found = found.join(hits, "text_id", "left").withColumn(
            "_found", F.concat("_found", F.coalesce("_hits", none))
        ).drop("_hits")
    found = found.withColumn("kept", X.keep_longest(F.col("_found")))
    if chinese:
        rest = X.chinese_mentions(_mask(text, F.col("kept")))
        found = found.withColumn(
            "kept", F.when(X.has_chinese(text), X.keep_longest(F.concat("kept", rest))).otherwise(F.col("kept"))
        )
    done = _entities(of_texts(questions, _numbered(found).drop("_found", "text_id", "keys")), as_of)
    return done if spans else done.drop("kept")


def distinct_texts(questions: DataFrame, partitions: int | None = None) -> DataFrame:
    """(text_id, text): each text once, stored."""
    texts = spread(questions.select("text").distinct(), partitions)
    return materialize(texts.select(F.monotonically_increasing_id().alias("text_id"), "text"))


def of_texts(questions: DataFrame, found: DataFrame) -> DataFrame:
    """Questions with the columns of each row of ``found`` that has their text.

    Never by broadcast: what is found is many times what the planner takes it for.
    """
    columns = [c for c in found.columns if c != "text"]
    rows = found.withColumnRenamed("text", "_text").hint("merge")
    return questions.join(rows, F.col("text").eqNullSafe(F.col("_text"))).select(*questions.columns, *columns)


def with_skeleton(found: DataFrame, as_of: str = "ts") -> DataFrame:
    """Questions with spans ``kept``: add their ``entities`` and ``skeleton``."""
    return _entities(_numbered(found).drop("keys"), as_of)


def _numbered(found: DataFrame) -> DataFrame:
    """Texts with spans ``kept``: add ``keys``, ``numbered`` and ``skeleton``."""
    keyed = found.withColumn("keys", X.entity_keys(F.col("kept")))
    numbered = keyed.withColumn("numbered", X.number_mentions(F.col("kept"), F.col("keys")))
    return numbered.withColumn("skeleton", X.skeleton(F.col("text"), *map(F.col, ("kept", "keys", "numbered"))))


def _entities(numbered: DataFrame, as_of: str) -> DataFrame:
    day = F.col(as_of).cast("date")
    entities = F.transform("numbered", lambda n: F.struct(
        n["entity_type"].alias("entity_type"), n["ordinal"].alias("ordinal"), n["value"].alias("value"),
        F.coalesce(n["canonical"], normalize_value(n["value"], n["entity_type"], day)).alias("normalized"),
    ))
    return numbered.withColumn("entities", entities).drop("numbered")


def merge_mentions(
    questions: DataFrame, dictionary: DataFrame | None, aliases: DataFrame | None = None, as_of: str = "ts",
    partitions: int | None = None,
) -> DataFrame:
    """(question_id, entity_type, value), each once: what patterns, names and Chinese and mixed patterns find.

    All types of mentions. Where patterns and names overlap the first and then
    the longer one stays, as in :func:`find_mentions`; each Chinese or mixed
    pattern adds what it finds in the whole text, whatever else lies there.
    """
    found = mentions_long(find_mentions(questions, dictionary, aliases, as_of, False, partitions))
    more = questions.where(X.has_chinese(F.col("text"))).select(
        "question_id", F.explode(X.chinese_mentions(F.col("text"))).alias("m"))
    return found.select("question_id", "entity_type", "value").union(
        more.select("question_id", "m.type", "m.value")).distinct()


def mentions_long(extracted: DataFrame) -> DataFrame:
    """One row per question and entity: question_id, entity_type, ordinal, value, normalized."""
    rows = extracted.select("question_id", F.inline_outer("entities"))
    return rows.where(F.col("entity_type").isNotNull())


def entity_map(extracted: DataFrame) -> DataFrame:
    """Nested form: placeholder -> (type, value, normalized)."""
    entries = F.transform("entities", lambda e: F.struct(
        X.placeholder(e["entity_type"], e["ordinal"]).alias("key"),
        F.struct(e["entity_type"].alias("type"), e["value"].alias("value"), e["normalized"].alias("normalized")).alias("value"),
    ))
    return extracted.select("question_id", F.map_from_entries(entries).alias("entity_map"))


def fill_text(template, entities, value: str = "value"):
    """Placeholders of a template replaced by the entities' values."""
    return F.aggregate(
        entities, template,
        lambda acc, e: F.replace(acc, X.placeholder(e["entity_type"], e["ordinal"]), e[value]),
    )
