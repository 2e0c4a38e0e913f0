import pytest
from pyspark.sql import functions as F

from hourlens.functions import extract as X
from hourlens.functions.normalize import normalize_date, normalize_number
from hourlens.plans.extraction import entity_map, fill_text, find_mentions, mentions_long
from tests.conftest import ask, rows

EXPECTED = {
    "Report from 2023-01-15": [("date", "2023-01-15", "2023-01-15")],
    "Report from 01/15/2023": [("date", "01/15/2023", "2023-01-15")],
    "Report from January 15, 2023": [("date", "January 15, 2023", "2023-01-15")],
    "Report from Jan 15 2023": [("date", "Jan 15 2023", "2023-01-15")],
    "Report from 15 January 2023": [("date", "15 January 2023", "2023-01-15")],
    "Work hours for next week": [("time_period", "next week", "2026-02-16 - 2026-02-22")],
    "Work hours for January 2023": [("time_period", "January 2023", "January 2023")],
    "Mail a.b@example.com about PROJ-5 and ABC-1234": [
        ("email", "a.b@example.com", "a.b@example.com"), ("project_id", "ABC-1234", "ABC-1234"),
        ("project_id", "PROJ-5", "PROJ-5")],
    "12.5% of hours": [("percentage", "12.5%", "12.5%")],
    "Hours in 2023": [("time_period", "2023", "2023")],
    "nothing here": [],
    "": [],
}


def test_mentions_by_pattern(spark):
    texts = list(EXPECTED)
    got = mentions_long(find_mentions(ask(spark, *texts), None)).collect()
    for i, text in enumerate(texts):
        found = sorted((r.entity_type, r.value, r.normalized) for r in got if r.question_id == i)
        assert found == EXPECTED[text], text


@pytest.fixture(scope="module")
def skeletons(spark, dictionary):
    log = ask(
        spark,
        "How many hours did Alex Stone work on the Website Redesign project in Q1 2023?",
        "Compare the hours worked by Alex Stone and Robin Vale in Q1 2025",
        "alex stone's hours, Alex Stone again",
        "Alexander Stoneman worked 40 hours",
    )
    return {r.question_id: r for r in find_mentions(log, dictionary).withColumn(
        "again", fill_text(F.col("skeleton"), F.col("entities"))).collect()}


def test_skeleton_and_round_trip(skeletons):
    r = skeletons[0]
    assert r.skeleton == "How many hours did {employee_0} work on the {project_0} project in {time_period_0}?"
    assert len(r.entities) == 3 and r.again == r.text
    assert skeletons[1].skeleton == "Compare the hours worked by {employee_0} and {employee_1} in {time_period_0}"
    assert [e.value for e in skeletons[1].entities if e.entity_type == "employee"] == ["Alex Stone", "Robin Vale"]


def test_word_bounds_and_repeats(skeletons):
    assert skeletons[2].skeleton == "{employee_0}'s hours, {employee_0} again"
    assert skeletons[3].skeleton == "Alexander Stoneman worked {number_0} hours"


def test_entity_map(spark, dictionary):
    nested = entity_map(find_mentions(ask(spark, "Sam Reed in Q2 2024"), dictionary)).first().entity_map
    assert nested["{employee_0}"].value == "Sam Reed" and nested["{time_period_0}"].normalized == "Q2 2024"


def test_aliases_share_an_ordinal(spark, dictionary, aliases):
    found = find_mentions(ask(spark, "张三在Q1 2025工作了多少小时", "hours of Zhang San and MANAGER ZHANG"), dictionary, aliases)
    by_id = {r.question_id: r for r in found.collect()}
    assert [(e.entity_type, e.normalized) for e in by_id[0].entities if e.entity_type == "employee"] == [("employee", "张三")]
    assert by_id[0].skeleton.startswith("{employee_0}在{time_period_0}")
    assert by_id[1].skeleton == "hours of {employee_0} and {employee_0}"


def test_chinese_patterns(spark):
    log = ask(spark, "2025年第一季度", "财务管理部", "欧阳工程师", "Manager 王五", "January 2025年", "plain text")
    got = rows(mentions_long(find_mentions(log, None)), "question_id", "entity_type", "value")
    assert (0, "time_period", "2025年第一季度") in got
    assert (1, "department", "财务管理部") in got
    assert (2, "employee", "欧阳工程师") in got
    assert (3, "employee", "Manager 王五") in got
    assert not [g for g in got if g[0] == 5]


def test_language_class(spark):
    df = spark.createDataFrame([("hours",), ("工作",), ("工作 hours",)], "t STRING")
    assert [r[0] for r in df.select(X.language_class(F.col("t"))).collect()] == ["en", "zh", "mixed"]


def test_spans_are_exact(spark):
    text = "x17 17 \x01 a-17,17"
    got = spark.createDataFrame([(text,)], "t STRING").select(X.spans(F.col("t"), r"\b(17)\b")).first()[0]
    assert [(s.start, s.end) for s in got] == [(4, 6), (11, 13), (14, 16)]
    assert all(text[s.start:s.end] == s.value for s in got)


def test_numbers_and_dates(spark):
    df = spark.createDataFrame([("1000",), ("1,000",), ("1,000.50",), ("007",), ("x",)], "t STRING")
    assert [r[0] for r in df.select(normalize_number(F.col("t"))).collect()] == ["1000", "1000", "1000.5", "7", "x"]
    df = spark.createDataFrame([("1/5/23",), ("2023-02-30",), ("soon",)], "t STRING")
    assert [r[0] for r in df.select(normalize_date(F.col("t"))).collect()] == ["2023-01-05", "2023-02-30", "soon"]


def test_valid_mention(spark):
    df = spark.createDataFrame([("Jan", "date"), ("Jan 15 2023", "date"), (" ", "number"), ("X", "employee")], "v STRING, k STRING")
    assert [r[0] for r in df.select(X.valid_mention(F.col("v"), F.col("k"))).collect()] == [False, True, False, False]
