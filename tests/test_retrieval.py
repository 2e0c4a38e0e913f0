"""Set-similarity joins and ranked retrieval against brute force, and how many candidates they look at."""

import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from hourlens.functions import similarity as S
from hourlens.operators import matching as M
from hourlens.operators import ranked, setjoin
from hourlens.sources.templates import complete_templates
from test_matching import brute_best


def sets(n, seed, copies=0.3):
    """Word sets with a few very frequent words, some of them edited copies of earlier ones."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if out and rng.random() < copies:
            words = set(rng.choice(out)[1])
            words ^= {f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 2))}
        else:
            words = {f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 12))} | set(rng.sample(["the", "of", "and"], rng.randint(0, 3)))
        out.append((i, sorted(words)))
    return out


SCHEMA = "key long, words array<string>"


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a and b else 0.0


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8, 1.0])
def test_similar_sets_equal_all_pairs(spark, least):
    left, right = sets(120, 1) + [(900, []), (901, None)], sets(100, 1, 0.2) + [(902, ["only"]), (903, [])]
    found = setjoin.similar_sets(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), least)
    want = {(a, b): jaccard(x or [], y) for (a, x), (b, y) in itertools.product(left, right)}
    assert {(r.a, r.b): r.similarity for r in found.collect()} == {k: pytest.approx(v) for k, v in want.items() if v >= least}


def test_few_pairs_are_candidates(spark):
    rows = spark.createDataFrame(sets(400, 2), SCHEMA)
    frequency = setjoin.frequencies(rows)
    ordered = setjoin.rarest_first(rows, frequency)
    met = rows.select("key", F.explode("words").alias("w"))
    share = met.join(met.toDF("other", "w"), "w").select("key", "other").distinct().count()
    similar = setjoin.similar_sets(rows, rows, 0.7).count()
    found = setjoin.candidates(ordered, ordered, 0.7).count()
    assert similar <= found < 2 * similar and found < share / 20


def test_least_must_be_positive(spark):
    rows = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        setjoin.similar_sets(rows, rows, 0.0)
    assert setjoin.similar_sets(rows, rows, 0.5).collect() == []


def texts(n, seed):
    rng = random.Random(seed)
    stems = ["hour", "project", "week", "team", "cost", "plan", "task", "sum", "list", "show"]
    vocabulary = ["the", "of", "in", *(a + b for a, b in itertools.product(stems, stems))]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.4:
            words = rng.choice(out).split()
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(2, 9))] + rng.sample(["the", "of", "in"], rng.randint(0, 2))
        out.append(" ".join(words))
    return out


def template_rows(spark, made):
    return complete_templates(spark.createDataFrame(
        [(i, t, "SELECT 1", i % 7) for i, t in enumerate(made)],
        "template_id BIGINT, template_query STRING, sql_template STRING, usage_count BIGINT"))


@pytest.mark.parametrize("threshold", [0.55, 0.8])
def test_best_by_keyword_equals_all_pairs(spark, threshold):
    made = texts(60, 3)
    asked = spark.createDataFrame([(t,) for t in [*texts(50, 4), *made[:20], "nothing alike", "THE"]], "skeleton STRING")
    templates = template_rows(spark, made)
    got = {r.skeleton: (r.template_id, r.score) for r in M.best_by_keyword(asked, templates, threshold).collect()}
    want = brute_best(spark, asked.distinct(), templates, threshold * 0.7)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(v[1]) for k, v in want.items())


def test_words_bound_the_texts_that_are_compared(spark):
    made = texts(150, 5)
    asked = spark.createDataFrame([(f"{t} now",) for t in made], "skeleton STRING").distinct()
    templates = template_rows(spark, made)
    pairs, open_ = M.bounded_pairs(asked, templates, 0.385)
    met = M.word_pairs(asked, templates).count()
    # A text of two words and "now" shares too little with its origin to be bounded.
    assert open_.count() < 0.1 * asked.count() and pairs.count() < met / 8


def test_pairs_by_words_go_by_numbers_and_lose_none(spark):
    """Candidates of a keyword score: narrow rows of numbers, every pair that can reach the floor, few others."""
    made = texts(150, 6)
    asked = spark.createDataFrame([(t, i) for i, t in enumerate(sorted({*texts(60, 7), *(f"{t} now" for t in made[:80])}))],
                                  "skeleton STRING, skeleton_id BIGINT")
    templates = template_rows(spark, made)
    pairs, open_ = M.bounded_pairs(asked, templates, 0.595)
    assert open_.isEmpty()
    got = {(r.skeleton, r.template_id) for r in pairs.collect()}
    every = M._with_text_scores(M.word_pairs(asked, templates)).collect()
    assert {(r.skeleton, r.template_id) for r in every if r.score >= 0.595} <= got and len(got) < len(every) / 8
    sides = [df.select(F.col(key).alias("key"), *(c.alias(n) for n, c in M._keyword_sets(F.col(text), other).items()))
             for df, key, text, other in ((asked, "skeleton_id", "skeleton", False), (templates, "template_id", "template_query", True))]
    found = setjoin.scored_candidates(*sides, 0.4, 0.2, M._text_bound, 0.4, 0.195)
    assert {t for _, t in found.dtypes} == {"bigint"} and len(got) <= found.count() < len(every) / 4


def test_texts_that_cannot_reach_the_floor_are_not_compared(spark):
    rows = [(a, b, least) for a in ("alpha beta", "ahpla", "", "Zeta") for b in ("beta alpha", "zeta", "qqq", "") for least in (0.1, 0.9, 1.5)]
    df = spark.createDataFrame(rows, "a STRING, b STRING, least DOUBLE")
    both = df.select("least", S.text_similarity("a", "b").alias("x"), S.text_similarity("a", "b", F.col("least")).alias("y")).collect()
    assert all(r.y == r.x or (r.y.lcs is None and r.x.lcs + r.x.jaro < r.least) for r in both)
    assert sum(r.y.lcs is None for r in both) > 10


def vectors(n, seed, key):
    """Unit vectors over a vocabulary with frequent terms."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        terms = {f"t{int(rng.paretovariate(0.6)) % 300}": rng.random() + 0.05 for _ in range(rng.randint(0, 9))}
        norm = math.sqrt(sum(w * w for w in terms.values()))
        rows += [(i, t, w / norm) for t, w in terms.items()]
    return rows, f"{key} long, term string, {key}_weight double"


def dots(left, right):
    out = {}
    for a, t, x in left:
        for b, u, y in right:
            if t == u:
                out[a, b] = out.get((a, b), 0.0) + x * y
    return out


@pytest.mark.parametrize("least", [0.1, 0.5, 0.9])
def test_alike_equals_all_pairs(spark, least):
    (left, ls), (right, rs) = vectors(80, 1, "a"), vectors(90, 2, "b")
    found = ranked.alike(spark.createDataFrame(left, ls), spark.createDataFrame(right, rs), least).collect()
    want = {k: v for k, v in dots(left, right).items() if v >= least}
    assert {(r.a, r.b): r.similarity for r in found} == {k: pytest.approx(v) for k, v in want.items()}


@pytest.mark.parametrize("k", [1, 3])
def test_best_equals_all_pairs(spark, k):
    (left, ls), (right, rs) = vectors(80, 3, "a"), vectors(90, 4, "b")

    def score(pairs):  # raised for even b, so that the order by score is not that of similarity
        return pairs.withColumn("score", F.col("similarity") * F.when(F.col("b") % 2 == 0, 1.3).otherwise(1.0))

    found = ranked.best(spark.createDataFrame(left, ls), spark.createDataFrame(right, rs), score, 1.3, k).collect()
    want = {}
    for (a, b), v in dots(left, right).items():
        want.setdefault(a, []).append((-v * (1.3 if b % 2 == 0 else 1.0), b))
    want = {(a, i): b for a, rows in want.items() for i, (_, b) in enumerate(sorted(rows)[:k], 1)}
    assert {(r.a, r["rank"]): r.b for r in found} == want and len(found) == len(want)


def test_frequent_terms_are_not_joined_in_full(spark):
    """A term that all vectors have is looked up by no vector that has a rare one of more weight."""
    x, y = math.sqrt(0.9), math.sqrt(0.1)
    left = [(i, t, w) for i in range(60) for t, w in ((f"r{i}", x), ("all", y))]
    both = spark.createDataFrame(left, "a long, term string, a_weight double")
    lists = ranked.index(both.toDF("b", "term", "b_weight"))
    assert ranked.candidates(both, lists, F.lit(0.65)).count() == 60
    assert ranked.candidates(both, lists, F.lit(0.05)).count() == 3600


def test_best_templates_equal_all_scores(spark):
    made = texts(80, 6)
    asked = spark.createDataFrame([(t,) for t in texts(70, 7) + made[:10]], "skeleton STRING")
    templates = template_rows(spark, made)
    as_of = dt.date(2024, 2, 1)
    every = M.combined(M.tfidf_scores(asked, templates), templates, as_of).withColumn("combined", F.round("combined", 9))
    want = M.top_candidates(every, 3).select("skeleton", "rank", "template_id", F.round("combined", 7)).collect()
    got = M.tfidf_best(asked, templates, as_of, 3).select("skeleton", "rank", "template_id", F.round("combined", 7)).collect()
    assert set(map(tuple, got)) == set(map(tuple, want)) and len(got) == len(want)
    best = M.best_by_combined(every, S.THRESHOLDS["tfidf"]).select("skeleton", "template_id").collect()
    alike = M.combined(M.tfidf_alike(asked, templates), templates, as_of).withColumn("combined", F.round("combined", 9))
    assert set(M.best_by_combined(alike, S.THRESHOLDS["tfidf"]).select("skeleton", "template_id").collect()) == set(best)


def test_word_sets_alike_shuffle_no_text_with_a_word(spark):
    """Sentences go by numbers and their first words by hashes: what is dealt out by words holds no strings."""
    said = spark.createDataFrame([(i, " ".join(words)) for i, words in sets(200, 5) if words], "skeleton_id long, skeleton string")
    templates = said.where("skeleton_id % 3 = 0").select(F.col("skeleton_id").alias("template_id"), F.col("skeleton").alias("template_query"))
    for content in (False, True):
        found = M.word_sets_alike(said, templates, 0.7, content)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan
        left = {r.skeleton: r.words for r in said.select("skeleton", (S.content_words if content else lambda t, _: S.words(t))(F.col("skeleton"), False).alias("words")).collect()}
        right = {r.template_id: left[r.template_query] for r in templates.collect()}
        want = {(a, b) for a, x in left.items() for b, y in right.items() if jaccard(x, y) >= 0.7}
        assert {(r.skeleton, r.template_id) for r in found.collect()} == want


def test_pairs_with_one_shared_term_are_dropped_in_the_join(spark):
    """60 vectors share a rare term but have other heavy ones: lengths of parts by groups of terms keep them apart."""
    x, y = math.sqrt(0.3), math.sqrt(0.7)
    rows = [(i, t, w) for i in range(60) for t, w in (("shared", x), (f"t{i // 6}", y))]
    rows += [(100 + i, f"t{i // 61}", 1.0) for i in range(610)]
    both = spark.createDataFrame(rows, "a long, term string, a_weight double")
    right = both.toDF("b", "term", "b_weight")
    found = ranked.candidates(both.where("a < 100"), ranked.index(right), F.lit(0.65)).where("b < 100").count()
    assert 360 <= found < 1500
    got = {(r.a, r.b) for r in ranked.alike(both.where("a < 100"), right, 0.65).where("b < 100").collect()}
    assert got == {(a, b) for a in range(60) for b in range(60) if a // 6 == b // 6}


def test_packed_vectors_equal_rows(spark):
    """Words of a chunk meet the vocabulary once; null, empty and unknown texts have no vector."""
    made = [None, "", "zzz qqq", "the of", *texts(60, 9)]
    asked = spark.createDataFrame([((i << 20) + i, t) for i, t in enumerate(made)], "a long, skeleton string")
    templates = spark.createDataFrame(list(enumerate(texts(80, 8))), "template_id long, template_query string")
    vocabulary = M.tfidf_fit(templates, "template_id", "template_query").withColumn("number", F.xxhash64("term"))
    known = vocabulary.select("term", "number", "idf", "df", F.lit(1.0).alias("highest"))
    want = {(r.a, r.term): r.weight for r in M.tfidf_vectors(asked, "a", "skeleton", vocabulary, name="number").collect()}
    rows = M.packed_vectors(asked, "a", "skeleton", known).select("a", "norm", F.inline("entries")).collect()
    assert len(rows) == len(want) > 0 and {(r.a, r.term): r.raw / r.norm for r in rows} == {k: pytest.approx(v) for k, v in want.items()}
