"""Question to answer in one chain, by every matching method; references read as the names they mean."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourlens import schemas
from hourlens.plans import chain as K
from hourlens.plans import context as C
from hourlens.plans import reports as R
from hourlens.plans.extraction import find_mentions
from hourlens.sources.dictionaries import load_aliases, save_aliases
from hourlens.sources.templates import library, load_templates, save_templates
from tests.conftest import ask, rows

AS_OF = dt.date(2026, 2, 15)
TEXTS = ["How many hours did Alex Stone work in Q1 2025?", "please: how many hours did Robin Vale work in Q1 2025?",
         "tell me, who worked on the Mobile App project in Q1 2025?", "What is the weather like today?",
         "Compare the hours worked by Alex Stone and Robin Vale in Q1 2025"]


def by_letters(column):
    """A user's embedding: how often each letter pair of a small alphabet occurs."""

    def vectors(texts: pd.Series) -> pd.Series:
        letters = "aehiklnoprstuwy{_0"
        return texts.str.lower().map(lambda t: [float(t.count(a + b)) + 1e-3 for a in letters for b in letters])

    return F.pandas_udf(vectors, "array<float>")(column)


@pytest.mark.parametrize("method", ["keyword", "tfidf", "embedding"])
def test_near_questions_are_filled_and_answered(spark, small_star, dictionary, method):
    log = ask(spark, *TEXTS)
    matches, answers = K.answer_questions(
        log, dictionary, None, library(spark), small_star, method, AS_OF, embed=by_letters if method == "embedding" else None)
    found = {r.question_id: r for r in matches.collect()}
    assert {q: found[q].template_id for q in (0, 1, 2, 4)} == {0: 4, 1: 4, 2: 3, 4: 6} and 3 not in found
    assert "'%Robin Vale%'" in found[1].sql and "{" not in found[1].sql
    lo, hi = dt.date(2025, 1, 1), dt.date(2025, 3, 31)
    got = {(r.question_id, r.item): r.total_hours for r in answers.collect()}
    for q, name in ((0, "Alex Stone"), (1, "Robin Vale")):
        assert got[q, None] == R.employee_hours(small_star, name, lo, hi).first()[0]
    assert got[4, "Alex Stone"] == got[0, None] and got[4, "Robin Vale"] == got[1, None]
    assert {i for q, i in got if q == 2} == {"Robin Vale"}


def test_exact_matches_word_for_word_only(spark, dictionary):
    log = find_mentions(ask(spark, *TEXTS), dictionary)
    assert rows(K.match_log(log, library(spark), "exact", AS_OF), "question_id", "template_id") == [(0, 4), (4, 6)]
    with pytest.raises(ValueError):
        K.match_log(log, library(spark), "guess", AS_OF)
    with pytest.raises(ValueError):
        K.match_log(log, library(spark), "embedding", AS_OF)


def test_references_are_read_as_names(spark, dictionary):
    texts = ["How many hours did Alex Stone work in Q1 2025?", "And how many hours did they work in Q2 2025?",
             "Who worked on it in Q1 2025?", "How many hours were spent on the Mobile App project in Q1 2025?",
             "Who worked on that project in Q2 2025? Was it they or Sam Reed?"]
    log = spark.createDataFrame([(i, 1, dt.datetime(2026, 1, 1 + i), t) for i, t in enumerate(texts)], schemas.QUESTIONS)
    found = find_mentions(log, dictionary, spans=True)
    messages = C.number_turns(log)
    templates = library(spark)
    matches = K.match_log(found, templates, "tfidf", AS_OF)
    spliced, best = C.contextual_matches(found, messages, matches, templates, 0.65)
    skeletons = {r.question_id: r.skeleton for r in spliced.collect()}
    # Question 2 has no project before it, so "it" stays a word; question 4 names a person, so "they" does.
    assert skeletons == {1: "And how many hours did {employee_0} work in {time_period_0}?",
                         4: "Who worked on {project_0} in {time_period_0}? Was {project_0} they or {employee_0}?"}
    entities = {r.question_id: {(e.entity_type, e.normalized) for e in r.entities} for r in spliced.collect()}
    assert ("employee", "Alex Stone") in entities[1] and ("project", "Mobile App") in entities[4]
    top = {r.question_id: (r.template_id, r.score) for r in best.collect()}
    # One table and two types of entities shared with the question before.
    assert top[1][0] == 4 and 0.2 + 0.65 <= top[1][1] <= 0.2 + 1


def test_savers_write_json_that_loads_again(spark, aliases, tmp_path):
    bare = aliases.union(spark.createDataFrame([("employee", "Nobody", 2, None, None)], schemas.ALIASES))
    save_aliases(bare, str(tmp_path / "a"), "json")
    loaded = load_aliases(spark, str(tmp_path / "a"), lines=True)
    assert rows(loaded, *bare.columns) == rows(bare, *bare.columns)
    save_templates(library(spark), str(tmp_path / "t"), "json")
    columns = ("template_query", "sql_template", "usage_count", "success_rate", "source", "intent")
    assert rows(load_templates(spark, str(tmp_path / "t"), lines=True), *columns) == rows(library(spark), *columns)
    for save in (lambda: save_aliases(aliases, "x", "xml"), lambda: save_templates(library(spark), "x", "xml")):
        with pytest.raises(ValueError):
            save()
