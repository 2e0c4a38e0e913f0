import datetime as dt
import itertools
import math

import pytest
from pyspark.sql import functions as F

from hourlens.functions import similarity as S
from hourlens.operators import matching as M
from hourlens.sources.templates import library

T1 = "How many hours did {employee_0} work on the {project_0} project in {time_period_0}?"
T4 = "How many hours did {employee_0} work in {time_period_0}?"
T8 = "Which projects had the most hours in {time_period_0}?"
WEATHER = "What is the weather like today?"


def skeletons(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "skeleton STRING")


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_golden_scores(spark):
    want = {
        (T4, T4): (1.0, 0.625, 1.0, 1.0, 0.925), (T4, T1): (0.666667, 0.555556, 0.674699, 0.909940, 0.694705),
        (T4, T8): (0.230769, 0.083333, 0.589286, 0.696691, 0.366170),
        (WEATHER, T8): (0.076923, 0.0, 0.358491, 0.639383, 0.230344),
    }
    pairs = M._with_text_scores(M.word_pairs(skeletons(spark, T4, WEATHER), library(spark)))
    got = {(r.skeleton, r.template_query): (r.word, r.content, r.lcs, r.jaro, r.score) for r in pairs.collect()}
    for key, values in want.items():
        assert got[key] == pytest.approx(values, abs=1e-6)


def test_lcs_equals_table(spark):
    texts = ["abcbdab", "bdcaba", "", "a", "aaaa", "xyz", "the quick brown", "brown quick the"]
    df = spark.createDataFrame(list(itertools.product(texts, texts)), "a STRING, b STRING")
    for r in df.select("a", "b", S.text_similarity("a", "b").alias("s")).collect():
        want = lcs(r.a, r.b) / max(len(r.a), len(r.b)) if r.a and r.b else 0.0
        assert r.s.lcs == pytest.approx(want)


def brute_best(spark, asked, templates, floor):
    pairs = asked.join(templates.select("template_id", "template_query"))
    scored = pairs.select("skeleton", "template_id", S.text_similarity("skeleton", "template_query").alias("t"), S.keyword_score(
        S.jaccard(S.words(F.col("skeleton")), S.words(F.col("template_query"))), F.lit(0.0), F.lit(0.0),
        S.jaccard(S.content_words(F.col("skeleton"), False), S.content_words(F.col("template_query"), True))).alias("l"))
    best = {}
    for r in scored.collect():
        score = r.l + 0.2 * r.t.lcs + 0.2 * r.t.jaro
        if score >= floor:
            best[r.skeleton] = max(best.get(r.skeleton, (0, 0)), (score, -r.template_id))
    return {k: (-v[1], v[0]) for k, v in best.items()}


def test_pruning_keeps_the_best(spark):
    """Pairs without a shared word (one-word texts that differ in one character) are found too."""
    words = ["totalhoursbyproject1", "totalhoursbyproject2", "Totalhoursbyprojects", "unrelated"]
    texts = [T1, T4, T8, WEATHER, "hours", "Who worked on {project_0} in {time_period_0}?", *words[:1], words[3]]
    own = spark.createDataFrame([(100, words[1], "s"), (101, words[2], "s")],
                                "template_id BIGINT, template_query STRING, sql_template STRING")
    templates = library(spark).select("template_id", "template_query", "sql_template").union(own)
    asked = skeletons(spark, *texts)
    got = {r.skeleton: (r.template_id, r.score) for r in M.best_by_keyword(asked, templates).collect()}
    want = brute_best(spark, asked, templates, 0.55 * 0.7)
    assert set(got) == set(want) and WEATHER not in got and words[0] in got
    for key, (template_id, score) in want.items():
        assert got[key][0] == template_id and got[key][1] == pytest.approx(score)


def test_floor_without_meaning_is_refused(spark):
    with pytest.raises(ValueError):
        M.keyword_scores(skeletons(spark, T1), library(spark), 0.1)


def test_no_templates(spark):
    assert M.best_by_keyword(skeletons(spark, T1), library(spark).where("false")).count() == 0


def test_no_plan_compares_all_pairs(spark):
    plan = M.best_by_keyword(skeletons(spark, T1), library(spark))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_embedding_best_equals_brute_force(spark):
    vectors = [(i, [math.sin(i * k + k) for k in range(1, 9)]) for i in range(60)]
    templates = spark.createDataFrame(vectors[:20], "template_id BIGINT, embedding ARRAY<FLOAT>")
    asked = spark.createDataFrame(vectors[20:], "question_id BIGINT, embedding ARRAY<FLOAT>")
    got = {r.question_id: r for r in M.embedding_best(asked, templates, 0.3, block_rows=4, salts=3).collect()}

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    for i, v in vectors[20:]:
        score, t = max((cos(v, w), -t) for t, w in vectors[:20])
        assert (i in got) == (score >= 0.3)
        if i in got:
            assert got[i].template_id == -t and got[i].similarity == pytest.approx(score, abs=1e-6)


def test_quality_combined_intent(spark):
    as_of = dt.date(2024, 2, 1)
    df = spark.createDataFrame([(1.0, 9, dt.date(2024, 1, 2), 3)], "r DOUBLE, u INT, d DATE, t INT")
    q = df.select(S.template_quality(F.col("r"), F.col("u"), F.col("d"), F.col("t"), F.lit(as_of)).alias("q"))
    assert q.first().q == pytest.approx(0.639628, abs=1e-6)
    assert q.select(S.combined_score(F.lit(0.8), F.lit(True), F.col("q"))).first()[0] == pytest.approx(0.853691, abs=1e-6)
    texts = spark.createDataFrame([("How many x",), ("Which had the most",), ("Compare the",), ("hello",)], "t STRING")
    assert [r[0] for r in texts.select(S.intent(F.col("t"))).collect()] == ["aggregation", "listing", "comparison", "general"]


def test_context_boost_and_types(spark):
    scores = spark.createDataFrame([("k", 1, 0.8, False, 1), ("k", 2, 0.78, True, 1), ("k", 3, 0.5, True, 9)],
                                   "key STRING, template_id BIGINT, similarity DOUBLE, tables_shared BOOLEAN, shared_types INT")
    from hourlens.plans.context import contextual_best

    r = contextual_best(scores, 0.7).first()
    assert (r.template_id, round(r.score, 6)) == (2, 0.93)
    both = library(spark).where(S.all_types_used(F.col("slots"), ["employee", "project"]))
    assert sorted(r.template_id for r in both.collect()) == [1, 11]
