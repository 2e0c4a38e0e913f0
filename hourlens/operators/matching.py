"""Distinct skeletons against the template table: candidates, scores, best templates.

Candidates come from equi-joins (shared words, shared terms, equal length);
only pairs that can still win reach the text comparison.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourlens.functions.similarity import (
    KEYWORD_RELAXATION,
    STOP_WORDS,
    THRESHOLDS,
    combined_score,
    content_words,
    intent,
    jaccard,
    keyword_score,
    template_quality,
    text_similarity,
    words,
)
from hourlens.operators import ranked
from hourlens.operators.partitioning import compute_once, materialize, spread
from hourlens.operators.setjoin import may_be_similar, scored_candidates


def word_pairs(skeletons: DataFrame, templates: DataFrame) -> DataFrame:
    """(skeleton, template_id, template_query, word, content) of pairs that share a word.

    ``word`` and ``content`` are the two set similarities; both are 0 for every
    pair left out.
    """
    text = F.col("skeleton")
    s = skeletons.select("skeleton").distinct().select(
        "skeleton", words(text).alias("s_words"), content_words(text, False).alias("s_content"))
    body = F.col("template_query")
    index = templates.select(
        "template_id", "template_query", words(body).alias("t_words"),
        content_words(body, True).alias("t_content"),
    ).select("*", F.explode("t_words").alias("w"))
    # One shuffle on the skeleton serves the de-duplication and all later steps per skeleton.
    hits = s.select("*", F.explode("s_words").alias("w")).join(index, "w").repartition("skeleton")
    pairs = hits.dropDuplicates(["skeleton", "template_id"])
    return pairs.select(
        "skeleton", "template_id", "template_query",
        jaccard(F.col("s_words"), F.col("t_words")).alias("word"),
        jaccard(F.col("s_content"), F.col("t_content")).alias("content"),
    )


def _with_text_scores(pairs: DataFrame, floor: float | None = None) -> DataFrame:
    """Pairs with their text similarities and ``score``; null, with a ``floor``, where the score is below it for sure."""
    least = None if floor is None else (floor - 0.4 * F.col("word") - 0.2 * F.col("content")) / 0.2
    scored = pairs.withColumn("_t", text_similarity("skeleton", "template_query", least))
    return scored.select(
        *pairs.columns, F.col("_t.lcs").alias("lcs"), F.col("_t.jaro").alias("jaro"),
    ).withColumn("score", keyword_score(F.col("word"), F.col("jaro"), F.col("lcs"), F.col("content")))


def keyword_scores(skeletons: DataFrame, templates: DataFrame, floor: float, prune: bool = True) -> DataFrame:
    """Keyword scores of the pairs that can be a skeleton's best template with score >= ``floor``.

    With L = 0.4 word + 0.2 content, a score lies in [L, L + 0.4]. A pair with
    L + 0.4 below the skeleton's largest L cannot win. A pair without a shared
    word scores at most 0.4, and to reach the floor its LCS ratio, which is at
    most the ratio of the lengths, must be at least 5 * floor - 1; those pairs
    are found by an equi-join on length, for skeletons whose L leaves room.
    """
    if floor <= 0.2:
        raise ValueError("a floor of 0.2 or less accepts pairs with nothing in common")
    every = word_pairs(skeletons, templates)
    pairs = every.withColumn("_l", 0.4 * F.col("word") + 0.2 * F.col("content"))
    per_skeleton = Window.partitionBy("skeleton")
    if prune:
        pairs = pairs.withColumn("_best", F.max("_l").over(per_skeleton)).where(
            F.col("_l") + 0.4 >= F.col("_best") - 1e-12)
    shared = _with_text_scores(pairs.select("skeleton", "template_id", "template_query", "word", "content"))

    ratio = 5 * floor - 1
    settled = pairs.where(F.col("_l") >= 0.4).select("skeleton").distinct()
    open_ = skeletons.select("skeleton").distinct().join(settled, "skeleton", "left_anti")
    size = F.length("skeleton")
    lengths = F.sequence(F.ceil(size * ratio - 1e-9).cast("int"), F.floor(size / ratio + 1e-9).cast("int"))
    alike = (
        open_.where(size > 0).select("skeleton", F.explode(lengths).alias("_n"))
        .join(templates.select("template_id", "template_query", F.length("template_query").alias("_n")), "_n")
        .join(every.select("skeleton", "template_id"), ["skeleton", "template_id"], "left_anti")
        .select("skeleton", "template_id", "template_query",
                F.lit(0.0).alias("word"), F.lit(0.0).alias("content"))
    )
    return shared.unionByName(_with_text_scores(alike)).where(F.col("score") >= floor)


#: Weight of shared words from which a pair is looked for first, and the least one that is looked up by words.
SEED, LEAST_WORDS = 0.3, 0.1


def _keyword_sets(text: Column, is_template: bool) -> dict[str, Column]:
    """Words, content words among them and length of a text; a template's marked placeholders meet no word."""
    found, inner = words(text), content_words(text, is_template)
    return {"words": found, "inner": F.array_intersect(found, inner) if is_template else inner, "size": F.length(F.lower(text))}


def _text_bound(a_size: Column, b_size: Column) -> Column:
    """What common subsequence and Jaro-Winkler can add at most: the one is at most the ratio of the lengths r, Jaro (2 + r) / 3."""
    ratio = F.least(a_size, b_size) / F.greatest(a_size, b_size)
    return 0.2 * ratio + 0.2 * (0.4 + 0.2 * (2 + ratio))


def _pair_scores(pairs: DataFrame, asked: DataFrame, templates: DataFrame) -> DataFrame:
    """Texts, word and content similarity of pairs (a, b), and ``most``, what their score is at most."""
    bodies = templates.select(F.col("template_id").alias("b"), "template_query")
    both = pairs.join(bodies, "b").join(asked, "a")
    text, body = F.col("skeleton"), F.col("template_query")
    # Each step is computed once, not again for the filter on what comes of it.
    sets = compute_once(both, "_s", F.struct(words(text).alias("a"), words(body).alias("b"), content_words(text, False).alias("c"),
                                             content_words(body, True).alias("d")))
    alike = compute_once(sets, "_j", F.struct(jaccard(F.col("_s.a"), F.col("_s.b")).alias("word"),
                                              jaccard(F.col("_s.c"), F.col("_s.d")).alias("content")))
    most = 0.4 * F.col("_j.word") + 0.2 * F.col("_j.content") + _text_bound(F.length(F.lower(text)), F.length(F.lower(body)))
    return alike.select("a", "skeleton", F.col("b").alias("template_id"), "template_query", "_j.*", most.alias("most"))


def bounded_pairs(skeletons: DataFrame, templates: DataFrame, floor: float) -> tuple[DataFrame, DataFrame]:
    """(pairs, open): pairs that can be a skeleton's best with ``floor`` or more, and skeletons that words do not bound.

    Words and sizes of both texts bound their score
    (:func:`scored_candidates`). Where ``floor`` is so low that texts could
    reach it with hardly a word in common, the pairs that share half of a
    skeleton's words by weight are found first; the score of the one with the
    most in common is what a better one must reach. Pairs go by numbers until
    their texts are compared.
    """
    asked = _numbered(skeletons)
    left = asked.select(F.col("a").alias("key"), *(c.alias(n) for n, c in _keyword_sets(F.col("skeleton"), False).items()))
    right = templates.select(F.col("template_id").alias("key"),
                             *(c.alias(n) for n, c in _keyword_sets(F.col("template_query"), True).items()))

    def found(sets: DataFrame, least: float) -> DataFrame:
        return scored_candidates(sets, right, 0.4, 0.2, _text_bound, 0.4, least)

    if floor - 0.4 >= LEAST_WORDS:
        pairs = _pair_scores(found(left, floor - 0.4), asked, templates)
        return pairs.where(F.col("most") >= floor - 1e-9), asked.where("false").select("skeleton")
    seeds = _pair_scores(found(left, SEED), asked, templates)
    first = _first_scores(seeds)
    need = F.greatest(F.lit(float(floor)), F.coalesce("score", F.lit(0.0)))
    bound = materialize(asked.join(first, "a", "left").select("a", "skeleton", need.alias("bound")))
    closed = bound.where(F.col("bound") - 0.4 >= LEAST_WORDS)
    bounds = closed.select(F.col("a").alias("key"), F.col("bound").alias("need"))
    pairs = _pair_scores(found(left.join(bounds, "key"), LEAST_WORDS), asked, templates).join(closed.select("a", "bound"), "a").where(
        F.col("most") >= F.col("bound") - 1e-9)
    return pairs.drop("bound"), bound.where(F.col("bound") - 0.4 < LEAST_WORDS).select("skeleton")


def _first_scores(pairs: DataFrame) -> DataFrame:
    """(a, score): the keyword score of the pair of each a whose words give most."""
    first = pairs.groupBy("a").agg(F.max_by(F.struct("skeleton", "template_id", "template_query", "word", "content"),
                                            0.4 * F.col("word") + 0.2 * F.col("content")).alias("m"))
    return _with_text_scores(first.select("a", "m.*")).select("a", "score")


def best_by_keyword(skeletons: DataFrame, templates: DataFrame, threshold: float = THRESHOLDS["keyword"]) -> DataFrame:
    """Best template per skeleton by keyword score, if it reaches 0.7 of the threshold; ties by id.

    Skeletons that have a good template are settled by words alone; the others
    (where the floor is 0.4 or less and nothing much alike is found) meet every
    template with a shared word or a like length.
    """
    floor = threshold * KEYWORD_RELAXATION
    pairs, open_ = bounded_pairs(skeletons, templates, floor)
    scored = _with_text_scores(pairs.drop("a", "most"), floor).where(F.col("score") >= floor)
    if floor - 0.4 < LEAST_WORDS:
        scored = scored.unionByName(keyword_scores(open_, templates, floor))
    best = F.max(F.struct("score", (-F.col("template_id")).alias("neg_id"))).alias("b")
    return scored.groupBy("skeleton").agg(best).select(
        "skeleton", (-F.col("b.neg_id")).alias("template_id"), F.col("b.score").alias("score"))


def word_sets_alike(skeletons: DataFrame, templates: DataFrame, least: float, content: bool = False) -> DataFrame:
    """(skeleton, template_id, similarity) of all pairs whose words (or content words) have this Jaccard similarity or more."""
    asked = _numbered(skeletons)
    text, body = F.col("skeleton"), F.col("template_query")
    left = content_words(text, False) if content else words(text)
    right = content_words(body, True) if content else words(body)
    pairs = may_be_similar(asked.select(F.col("a").alias("key"), left.alias("words")),
                           templates.select(F.col("template_id").alias("key"), right.alias("words")), least)
    # The texts are joined, once, and not their words, which take more room.
    bodies = templates.select(F.col("template_id").alias("b"), "template_query")
    return pairs.join(bodies, "b").join(asked, "a").select(
        "skeleton", F.col("b").alias("template_id"), jaccard(left, right).alias("similarity")).where(F.col("similarity") >= least)


def _numbered(skeletons: DataFrame) -> DataFrame:
    """Distinct (a, skeleton), so that no shuffle of words or pairs carries texts; distinct skeletons may bring ``skeleton_id``."""
    if "skeleton_id" in skeletons.columns:
        return skeletons.select("skeleton", F.col("skeleton_id").alias("a"))
    return materialize(skeletons.select("skeleton").distinct().withColumn("a", F.monotonically_increasing_id()))


# --- tf-idf ----------------------------------------------------------------------

TOKEN = r"[\p{L}\p{N}_]{2,}"


def tokens(df: DataFrame, key: str, text: str, stop_words=STOP_WORDS, partitions: int | None = None) -> DataFrame:
    """(key, term, tf): word counts of each text.

    The texts are shuffled by their key, not their words, which take more room;
    what is grouped by key afterwards lies there already.
    """
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    terms = spread(df, partitions).select(key, text).repartition(key).select(key, F.explode_outer(found).alias("term")).where(
        F.col("term").isNotNull() & ~F.col("term").isin(*stop_words))
    return terms.groupBy(key, "term").agg(F.count("*").alias("tf"))


def tfidf_fit(df: DataFrame, key: str, text: str, max_terms: int | None = None, stop_words=STOP_WORDS,
              partitions: int | None = None) -> DataFrame:
    """Vocabulary (term, total, df, idf) with smoothed idf: all terms, or the ``max_terms`` most frequent."""
    counts = tokens(df, key, text, stop_words, partitions).groupBy("term").agg(
        F.sum("tf").alias("total"), F.count("*").alias("df"))
    top = counts if max_terms is None else counts.orderBy(F.desc("total"), "term").limit(max_terms)
    size = df.agg(F.count("*").alias("n")).scalar()
    return top.select(
        "term", "total", "df", (F.log((1 + size) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf_vectors(df: DataFrame, key: str, text: str, vocabulary: DataFrame, stop_words=STOP_WORDS, name: str = "term") -> DataFrame:
    """(key, term, weight): l2-normalized tf-idf, one row per non-zero entry; ``name`` is the column of the vocabulary for ``term``."""
    raw = tokens(df, key, text, stop_words).join(vocabulary.select("term", F.col(name).alias("_name"), "idf"), "term").withColumn(
        "w", F.col("tf") * F.col("idf"))
    norm = Window.partitionBy(key)
    return raw.select(key, F.col("_name").alias("term"), (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(norm))).alias("weight"))


def tfidf_scores(skeletons: DataFrame, templates: DataFrame, stop_words=STOP_WORDS) -> DataFrame:
    """(skeleton, template_id, similarity) of pairs that share a term; fitted on the templates."""
    vocabulary = tfidf_fit(templates, "template_id", "template_query", stop_words=stop_words)
    left = tfidf_vectors(skeletons.select("skeleton").distinct().withColumn("text", F.col("skeleton")),
                         "skeleton", "text", vocabulary, stop_words)
    right = tfidf_vectors(templates, "template_id", "template_query", vocabulary, stop_words).select(
        "template_id", "term", F.col("weight").alias("t_weight"))
    return left.join(right, "term").groupBy("skeleton", "template_id").agg(
        F.sum(F.col("weight") * F.col("t_weight")).alias("similarity"))


#: So many texts in turn, by their number, share one reading of the vocabulary, as a power of two.
CHUNK = 15


def packed_vectors(asked: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """(a, norm, entries) as :func:`ranked.packed` of the tf-idf vectors of texts, whose ``key`` are whole numbers.

    ``known`` is (term, number, idf, df, highest). Texts in turn are a chunk:
    the distinct words of a chunk meet the vocabulary, and what is known of
    them goes back to its texts, so no shuffle holds a word once per text.
    """
    chunk = F.shiftright(key, CHUNK).alias("chunk")
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    terms = asked.select(chunk, F.explode(F.array_distinct(found)).alias("term")).distinct().join(known, "term")
    texts = asked.select(F.col(key).alias("a"), chunk, text).repartition("chunk").select("chunk", "a", found.alias("found"))

    def run(texts: pa.Table, terms: pa.Table) -> pa.Table:
        found, ids = texts.column("found").combine_chunks(), texts.column("a").to_numpy()
        lens = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
        own = {c: terms.column(c).to_numpy() for c in ("number", "idf", "df", "highest")}
        at = pc.fill_null(pc.index_in(pc.list_flatten(found), value_set=terms.column("term").combine_chunks()), -1).to_numpy(zero_copy_only=False)
        text, met = np.repeat(np.arange(len(ids)), lens)[at >= 0], at[at >= 0]
        size = max(terms.num_rows, 1)
        both, tf = np.unique(text * size + met, return_counts=True)
        text, met = both // size, both % size
        order = np.lexsort((own["number"][met], own["df"][met], text))
        text, met, tf = text[order], met[order], tf[order]
        raw = tf * own["idf"][met]
        norm = np.sqrt(np.bincount(text, raw * raw, len(ids)))
        have = np.flatnonzero(norm)
        starts = np.searchsorted(text, np.r_[have, len(ids)]).astype(np.int32)
        entries = pa.StructArray.from_arrays(
            [pa.array(own["df"][met]), pa.array(own["number"][met]), pa.array(raw), pa.array(own["highest"][met])], ["df", "term", "raw", "highest"])
        return pa.table([pa.array(ids[have]), pa.array(norm[have]), pa.ListArray.from_arrays(pa.array(starts), entries)], ["a", "norm", "entries"])

    return texts.groupBy("chunk").cogroup(terms.groupBy("chunk")).applyInArrow(
        run, "a long, norm double, entries array<struct<df:long,term:long,raw:double,highest:double>>")


def _tfidf_sides(skeletons: DataFrame, templates: DataFrame, stop_words) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(a, skeleton), packed vectors of skeletons, (b, term, b_weight) of templates and its index, fitted on the templates.

    Skeletons and terms go by numbers, so that no shuffle of entries or pairs
    carries texts; distinct skeletons may bring theirs as ``skeleton_id``.
    """
    fitted = tfidf_fit(templates, "template_id", "template_query", stop_words=stop_words)
    vocabulary = materialize(fitted.withColumn("number", F.monotonically_increasing_id()))
    asked = _numbered(skeletons)
    right = materialize(tfidf_vectors(templates, "template_id", "template_query", vocabulary, stop_words, "number").toDF("b", "term", "b_weight"))
    lists = materialize(ranked.index(right))
    known = materialize(vocabulary.select("term", "number", "idf").join(
        ranked.tops(lists).withColumnRenamed("term", "number"), "number").select("term", "number", "idf", "df", "highest"))
    return asked, packed_vectors(asked, "a", "skeleton", known), right, lists


def tfidf_alike(skeletons: DataFrame, templates: DataFrame, least: float = THRESHOLDS["tfidf"], stop_words=STOP_WORDS) -> DataFrame:
    """(skeleton, template_id, similarity) of all pairs with this similarity or more; frequent terms are not joined in full."""
    asked, *sides = _tfidf_sides(skeletons, templates, stop_words)
    return ranked.packed_alike(*sides, least).join(asked, "a").select("skeleton", F.col("b").alias("template_id"), "similarity")


def tfidf_best(skeletons: DataFrame, templates: DataFrame, as_of, n: int = 3, stop_words=STOP_WORDS) -> DataFrame:
    """The n best templates of each skeleton by combined score, as :func:`top_candidates` of all pairs would give."""
    quality = templates.agg(F.max(_quality(as_of)).alias("q")).scalar()
    asked, *sides = _tfidf_sides(skeletons, templates, stop_words)
    intents = asked.select("a", intent(F.col("skeleton")).alias("s_intent"))

    def score(pairs: DataFrame) -> DataFrame:
        named = pairs.join(intents, "a").withColumnRenamed("b", "template_id")
        return combined(named, templates, as_of, F.col("s_intent")).select(
            "a", F.col("template_id").alias("b"), "similarity",
            F.round("combined", 9).alias("score"))  # equal scores stay equal, whatever order their terms are summed in

    # A combined score is at most the similarity raised for equal intent and for the best quality.
    most = combined_score(F.lit(1.0), F.lit(True), F.greatest(quality, F.lit(0.0)))
    return ranked.packed_best(*sides, score, most, n).join(asked, "a").select(
        "skeleton", F.col("b").alias("template_id"), "similarity", F.col("score").alias("combined"), "rank")


# --- dense vectors ------------------------------------------------------------------


def embedding_best(
    questions: DataFrame, templates: DataFrame, threshold: float = THRESHOLDS["embedding"],
    block_rows: int = 64, salts: int = 8,
) -> DataFrame:
    """(question_id, template_id, similarity): nearest template by cosine, if it reaches the threshold.

    Templates are packed into blocks of about ``block_rows`` vectors. Each
    question meets each block once, through an equi-join on (block, salt), and
    keeps the best of the block; the salt spreads the questions of a block.
    """
    blocks = max(1, -(-templates.count() // block_rows))

    def unit(v):
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        return F.transform(v, lambda x: x.cast("double") / norm)

    packed = (
        templates.select("template_id", unit(F.col("embedding")).alias("v"))
        .groupBy(F.pmod(F.xxhash64("template_id"), F.lit(blocks)).cast("int").alias("block"))
        .agg(F.collect_list(F.struct("template_id", "v")).alias("members"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    asked = questions.select(
        "question_id", unit(F.col("embedding")).alias("q"),
        F.pmod(F.xxhash64("question_id"), F.lit(salts)).cast("int").alias("salt"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    best = F.array_max(F.transform("members", lambda m: F.struct(
        dot(F.col("q"), m["v"]).alias("similarity"), (-m["template_id"]).alias("neg_id"))))
    per_block = asked.join(packed, ["block", "salt"]).select("question_id", best.alias("b"))
    return per_block.groupBy("question_id").agg(F.max("b").alias("b")).select(
        "question_id", (-F.col("b.neg_id")).alias("template_id"), F.col("b.similarity").alias("similarity"),
    ).where(F.col("similarity") >= threshold)


# --- ranking ---------------------------------------------------------------------------


def _quality(as_of) -> Column:
    return template_quality(
        F.col("success_rate"), F.col("usage_count"), F.col("last_used"),
        F.size(F.array_distinct(F.transform("slots", lambda s: s["type"]))), F.lit(as_of))


def combined(scores: DataFrame, templates: DataFrame, as_of, asked: Column | None = None) -> DataFrame:
    """Add ``combined``: similarity raised for equal intent and for template quality; ``asked`` is the intent, by default the skeleton's."""
    rated = templates.select("template_id", F.col("intent").alias("t_intent"), _quality(as_of).alias("quality"))
    same = (intent(F.col("skeleton")) if asked is None else asked) == F.col("t_intent")
    return scores.join(rated, "template_id").withColumn(
        "combined", combined_score(F.col("similarity"), same, F.col("quality"))).drop("t_intent", "quality")


def best_by_combined(scores: DataFrame, threshold: float) -> DataFrame:
    """Among templates whose similarity reaches the threshold, the one with the best combined score."""
    rank = F.struct("combined", (-F.col("template_id")).alias("neg_id"), "similarity")
    return scores.where(F.col("similarity") >= threshold).groupBy("skeleton").agg(F.max(rank).alias("b")).select(
        "skeleton", (-F.col("b.neg_id")).alias("template_id"),
        F.col("b.similarity").alias("similarity"), F.col("b.combined").alias("combined"))


def top_candidates(scores: DataFrame, n: int = 3) -> DataFrame:
    """The n best templates of each skeleton by combined score, ranked from 1."""
    order = Window.partitionBy("skeleton").orderBy(F.desc("combined"), "template_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
