"""The mention step: what it carries and what the shortened pattern finds."""

import datetime as dt

from pyspark.sql import functions as F

from hourlens import schemas
from hourlens.functions import extract as X
from hourlens.operators import names as N
from hourlens.plans import extraction as E
from tests.conftest import ask


def test_only_words_that_may_begin_a_name_are_carried(spark, dictionary, monkeypatch):
    carried, plain = [], N._meeting

    def counted(pieces, known, on):
        carried.append(pieces.count())
        return plain(pieces, known, on)

    monkeypatch.setattr(N, "_meeting", counted)
    texts = ask(spark, "how many hours did (Alex Stone), and robin vale too, spend on it over there in all those years", "nothing here")
    found = N.dictionary_hits(texts, N.known_names(dictionary)).select("start", "end", "value").collect()
    assert sorted(map(tuple, found)) == [(20, 30, "Alex Stone"), (37, 47, "robin vale")]
    assert carried[0] < 5


def test_lexer_tries_no_less_than_all_entries(spark):
    texts = ("Q3 2024 2024 q1 quarter 2 of 2023 QUARTER 1 2020 First quarter third quarter of 2022 FOURTH quarter second quarter",
             "this month LAST year next Week previous quarter week 3 of 2024 fiscal year 2024 FY 2023 year 2022 2021 june 2020",
             "P-1 PROJ-22 PROJECT-3 ABC-1234 ABC-12 x.y+z%@a-b.co 5% 3.25 7 march 3, 2024 Sept 4 2024 aug 5, 24 3 May 2021 12/1/24 2024-1-2",
             "january february march april may june july august september october november december " * 2, "Jan 1, 2024 Oct 2, 24 Dec 3 2020", "", "a@b")
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    every = X.LEXER.replace(X._BEGINS, "")
    assert every != X.LEXER
    for row in df.select(X.lex(F.col("t")).alias("a"), X.spans(F.col("t"), every, len(X.GRAMMAR)).alias("b")).collect():
        assert row.a == row.b


def test_each_text_is_read_once_and_each_day_counts(spark, dictionary, monkeypatch):
    """A question asked again costs no second look; its relative period still follows its own day, and null texts stay."""
    read = []
    plain = E.dictionary_hits

    def counted(texts, *args, **kwargs):
        read.append(texts.count())
        return plain(texts, *args, **kwargs)

    monkeypatch.setattr(E, "dictionary_hits", counted)
    log = spark.createDataFrame(
        [(i, 1, dt.datetime(2024, 1 + i % 12, 5), "hours of Sam Reed last month" if i < 60 else None) for i in range(64)], schemas.QUESTIONS)
    found = {r.question_id: r for r in E.find_mentions(log, dictionary).collect()}
    assert read == [2] and len(found) == 64
    assert {found[i].skeleton for i in range(60)} == {"hours of {employee_0} {time_period_0}"}
    assert [found[i].entities[1].normalized for i in (0, 1, 14)] == ["December 2023", "January 2024", "February 2024"]
    assert all(found[i].skeleton is None and found[i].entities == [] for i in range(60, 64))
