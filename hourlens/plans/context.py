"""Conversation context: recent mentions, references, contextual match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourlens.functions import extract as X
from hourlens.functions.similarity import context_boost, shared_types
from hourlens.operators import matching as M
from hourlens.operators.partitioning import materialize
from hourlens.operators.windows import running_sums
from hourlens.plans.extraction import mentions_long, with_skeleton

# Words that refer to an entity named before, by type.
REFERENCES = {
    "employee": r"\b(?:he|she|they|him|her|them|his|their)\b|\b(?:this|that|the same) (?:person|employee)\b"
                "|(?<!其)他(?![们人国乡])|她(?!们)|这个人|那个人|同事",
    "project": r"\bit\b|\b(?:this|that|the same) project\b|这个项目|那个项目|该项目",
    "department": r"\b(?:this|that|the same|the) department\b|这个部门|那个部门|该部门",
}


def number_turns(messages: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Add ``turn``: the place of each message in its session by (ts, question_id), from 1.

    Long sessions are numbered slice by slice; ``chunk`` may give slices that are there already.
    """
    return running_sums(messages, ["session_id"], ["ts", "question_id"], chunk, {"turn": F.lit(1)})


def recent_mentions(messages: DataFrame, mentions: DataFrame, back: int = 3) -> DataFrame:
    """Mentions of the previous ``back`` messages, as seen from each later message.

    Each mention is sent to the next ``back`` turns of its session and met by
    equality on (session_id, turn), so a long session is not one group.
    """
    placed = mentions.join(messages.select("question_id", "session_id", "turn"), "question_id").select(
        "session_id", "entity_type", "ordinal", "value", "normalized", F.col("turn").alias("said_in"),
        F.explode(F.sequence(F.col("turn") + 1, F.col("turn") + back)).alias("turn"))
    return messages.select("question_id", "session_id", "turn").join(placed, ["session_id", "turn"])


def resolve_references(messages: DataFrame, mentions: DataFrame, back: int = 3) -> DataFrame:
    """Mentions plus one per reference: the latest mention of that type in the previous messages.

    A reference counts when the text has a referring word of a type and no
    mention of that type; ``resolved_from`` is the turn it was taken from.
    """
    checks = F.array(*(
        F.struct(F.lit(kind).alias("entity_type"), F.rlike(F.lower("text"), F.lit(pattern)).alias("hit"))
        for kind, pattern in REFERENCES.items()))
    refers = messages.select("question_id", F.inline(checks)).where("hit").select("question_id", "entity_type")
    open_ = refers.join(mentions.select("question_id", "entity_type"), ["question_id", "entity_type"], "left_anti")
    latest = F.struct("said_in", "ordinal")
    found = (
        recent_mentions(messages, mentions, back).join(open_, ["question_id", "entity_type"])
        .groupBy("question_id", "entity_type")
        .agg(F.max_by("value", latest).alias("value"), F.max_by("normalized", latest).alias("normalized"),
             F.max("said_in").alias("resolved_from"))
        .select("question_id", "entity_type", F.lit(0).alias("ordinal"), "value", "normalized", "resolved_from")
    )
    return mentions.select(
        "question_id", "entity_type", "ordinal", "value", "normalized", F.lit(None).cast("bigint").alias("resolved_from")
    ).unionByName(found)


def splice_references(extracted: DataFrame, resolved: DataFrame, as_of: str = "ts") -> DataFrame:
    """Extracted questions with their resolved references as mentions in the text: new ``entities`` and ``skeleton``.

    ``extracted`` holds the spans ``kept``, ``resolved`` (question_id,
    entity_type, normalized) what references mean. Every referring word of such
    a type becomes a mention of that name, unless a mention lies there already;
    so a skeleton reads as if the name stood in the text. Questions without a
    resolved reference are left out.
    """
    text = F.col("text")
    meaning = resolved.groupBy("question_id").agg(
        F.map_from_entries(F.collect_list(F.struct("entity_type", "normalized"))).alias("_means"))
    joined = extracted.drop("entities", "skeleton").join(meaning, "question_id")
    none = F.array().cast(f"array<{X.MENTION}>")

    def said(kind: str, pattern: str) -> Column:
        means = F.col("_means")[kind]
        found = F.transform(X.spans(text, f"((?i:{pattern}))"),
                            lambda s: X.mention(s["start"], s["end"], F.lit(kind), s["value"], means))
        return F.when(means.isNotNull(), found).otherwise(none)

    free = F.filter(F.concat(*(said(*entry) for entry in REFERENCES.items())), lambda r: ~F.exists("kept", lambda m: (m["start"] < -r["neg_end"]) & (r["start"] < -m["neg_end"])))
    return with_skeleton(joined.withColumn("kept", X.keep_longest(F.concat("kept", free))).drop("_means"), as_of)


def recent_tables(messages: DataFrame, matches: DataFrame, templates: DataFrame, back: int = 3) -> DataFrame:
    """(question_id, tables): what the templates matched by the previous ``back`` messages of the session use.

    Met by equality on (session_id, turn), like :func:`recent_mentions`.
    """
    used = matches.join(templates.select("template_id", "tables_used"), "template_id").join(
        messages.select("question_id", "session_id", "turn"), "question_id")
    later = used.select("session_id", "tables_used", F.explode(F.sequence(F.col("turn") + 1, F.col("turn") + back)).alias("turn"))
    return messages.select("question_id", "session_id", "turn").join(later, ["session_id", "turn"]).groupBy("question_id").agg(
        F.array_distinct(F.flatten(F.collect_list("tables_used"))).alias("tables"))


def contextual_matches(extracted: DataFrame, messages: DataFrame, matches: DataFrame, templates: DataFrame,
                       threshold: float, back: int = 3) -> tuple[DataFrame, DataFrame]:
    """(spliced, best): questions with references, read with what they mean, and the best template of each.

    ``extracted`` holds spans, ``messages`` turns, ``matches`` (question_id,
    template_id) what the messages matched by themselves. A template whose
    similarity reaches the threshold is raised when it uses a table that the
    last messages used, and for every type of entity it shares with the
    question, references included (:func:`contextual_best`).
    """
    found = resolve_references(messages, mentions_long(extracted), back).where("resolved_from IS NOT NULL")
    spliced = materialize(splice_references(extracted, found))
    scores = M.tfidf_alike(spliced, templates, threshold)
    kinds = F.array_distinct(F.transform("entities", lambda e: e["entity_type"]))
    own = spliced.select("question_id", "skeleton", kinds.alias("kinds")).join(
        recent_tables(messages, matches, templates, back), "question_id", "left")
    slots = templates.select("template_id", "tables_used", F.array_distinct(F.transform("slots", lambda s: s["type"])).alias("types"))
    scored = own.join(scores, "skeleton").join(slots, "template_id").select(
        F.col("question_id").alias("key"), "template_id", "similarity",
        F.coalesce(F.arrays_overlap("tables", "tables_used"), F.lit(False)).alias("tables_shared"),
        shared_types(F.col("kinds"), F.col("types")).alias("shared_types"))
    return spliced, contextual_best(scored, threshold).withColumnRenamed("key", "question_id")


def contextual_best(scores: DataFrame, threshold: float) -> DataFrame:
    """Best template per key by similarity plus context boost, similarity at least the threshold.

    ``scores`` holds (key, template_id, similarity, tables_shared, shared_types).
    """
    total = F.col("similarity") + context_boost(F.col("tables_shared"), F.col("shared_types"))
    rank = F.struct(total.alias("score"), (-F.col("template_id")).alias("neg_id"))
    return scores.where(F.col("similarity") >= threshold).groupBy("key").agg(F.max(rank).alias("b")).select(
        "key", (-F.col("b.neg_id")).alias("template_id"), F.col("b.score").alias("score"))
