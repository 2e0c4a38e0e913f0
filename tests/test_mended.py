"""Inputs on which an earlier version was wrong."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from hourlens.functions import extract as X
from hourlens.functions.normalize import normalize_date
from hourlens.functions.periods import normalize_period
from hourlens.operators import chartdata as D
from hourlens.operators import learning as L
from hourlens.operators import matching as M
from hourlens.operators.names import dictionary_hits
from hourlens.plans import answering as A
from hourlens.plans import context as C
from hourlens.plans import maintenance as MT
from hourlens.sources import star as S
from hourlens.sources.templates import library

from conftest import ask, d

PARAMS = "question_id BIGINT, employee STRING, project STRING, start_date DATE, end_date DATE"


def test_all_terms_count_unless_a_cap_is_asked_for(spark):
    texts = [f"word{i}x thing{i}y" for i in range(1500)]
    templates = spark.createDataFrame(list(enumerate(texts)), "template_id BIGINT, template_query STRING")
    skeletons = spark.createDataFrame([(t,) for t in texts], "skeleton STRING")
    scores = M.tfidf_scores(skeletons, templates).where("similarity > 0.999")
    assert scores.select("skeleton").distinct().count() == 1500
    assert M.tfidf_fit(templates, "template_id", "template_query").count() == 3000
    assert M.tfidf_fit(templates, "template_id", "template_query", 1000).count() == 1000


def test_maintenance_keeps_all_by_default(spark):
    one = library(spark).limit(1)
    many = one.crossJoin(spark.range(1200)).withColumns({
        "template_id": F.col("id"), "template_query": F.concat("template_query", F.col("id").cast("string"))}).drop("id")
    assert MT.maintain(many, F.col("usage_count").cast("double")).count() == 1200
    assert MT.maintain(many, F.col("usage_count").cast("double"), 7).count() == 7
    with pytest.raises(TypeError):
        L.retain_top(many, F.lit(1.0))


def test_parameters_keep_every_entity_and_period(spark):
    slots = spark.createDataFrame(
        [(1, 1, "employee", 1, "B", None, None), (1, 1, "employee", 0, "A", None, None),
         (1, 1, "time_period", 0, "Q1 2025", d("2025-01-01"), d("2025-03-31")),
         (1, 1, "time_period", 1, "Q4 2025", d("2025-10-01"), d("2025-12-31"))],
        "question_id BIGINT, template_id BIGINT, entity_type STRING, ordinal INT, normalized STRING, start_date DATE, end_date DATE")
    row = A.parameters(slots).first()
    assert row.employees == ["A", "B"] and row.employee == "A" and row.projects == [] and row.project is None
    assert [(p.start_date, p.end_date) for p in row.periods] == [
        (d("2025-01-01"), d("2025-03-31")), (d("2025-10-01"), d("2025-12-31"))]
    assert (row.start_date, row.end_date) == (d("2025-01-01"), d("2025-03-31"))


def test_rows_that_end_before_they_start_change_nothing(spark, small_star):
    odd = spark.createDataFrame([(1, 1, "Design", 9.0, d("2025-06-10"), d("2024-12-01"))], small_star.work_hour.schema)
    asked = spark.createDataFrame([(1, "Alex", "Website", d("2025-01-01"), d("2025-01-31"))], PARAMS)
    star = small_star._replace(work_hour=small_star.work_hour.unionByName(odd))
    assert A.answer_totals(asked, star).first().total_hours == 10.0


def test_earlier_hours_take_no_digits(spark, small_star):
    rows = [(1, 1, "Design", 1e9, d("2020-01-01"), d("2020-01-02"))] * 3 + [(1, 1, "Design", 0.1, d("2025-06-01"), d("2025-06-02"))]
    star = small_star._replace(work_hour=spark.createDataFrame(rows, small_star.work_hour.schema))
    asked = spark.createDataFrame([(1, "Alex", "Website", d("2025-06-01"), d("2025-06-30")),
                                   (2, "Alex", "Website", d("2019-01-01"), d("2025-06-30"))], PARAMS)
    got = {r.question_id: r.total_hours for r in A.answer_totals(asked, star).collect()}
    assert got == {1: 0.1, 2: 3000000000.1}


def test_days_are_pushed_to_the_scan(spark, small_star, tmp_path):
    small_star.work_hour.write.parquet(str(tmp_path / "fact"))
    star = small_star._replace(work_hour=spark.read.parquet(str(tmp_path / "fact")))
    asked = spark.createDataFrame([(1, "Alex", "Website", d("2025-01-01"), d("2025-01-31"))], PARAMS)
    plan = A.answer_totals(asked, star)._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.splitlines() if "FileScan" in line and "employee_id" in line]
    assert scan and all("DataFilters" in line and "end_date" in line for line in scan)


def test_null_is_a_category_like_others(spark):
    rows = [(None, 100.0)] + [(c, float(10 - i)) for i, c in enumerate("abcdefgh")] + [("a", 1.0)]
    got = {r[0]: r[1] for r in D.other_bucket(spark.createDataFrame(rows, "category STRING, hours DOUBLE")).collect()}
    assert got == {None: 100.0, "a": 11.0, "b": 9.0, "c": 8.0, "d": 7.0, "e": 6.0, "Other": 12.0}


def test_jdbc_options_of_one_table_stay_with_it(monkeypatch):
    seen = []

    class Reader:
        def __init__(self):
            self.own = {}

        def format(self, kind):
            assert kind == "jdbc"
            return self

        def options(self, **more):
            self.own |= more
            return self

        def load(self):
            seen.append(self.own)

            class Frame:
                def first(self):
                    return type("Row", (), {"lo": 3, "hi": 9})

            return Frame()

    class Session:
        @property
        def read(self):
            return Reader()

    S.read_star_jdbc(Session(), "jdbc:some:url", 4, user="me")
    assert [sorted(o) for o in seen] == [
        ["query", "url", "user"],
        ["dbtable", "lowerBound", "numPartitions", "partitionColumn", "upperBound", "url", "user"],
        ["dbtable", "url", "user"], ["dbtable", "url", "user"]]
    assert seen[1]["lowerBound"] == 3 and seen[1]["upperBound"] == 10


@pytest.mark.parametrize("text, form, found", [
    ("hours in q1 2025", "quarter", ["q1 2025"]), ("2025 q3 hours", "quarter", ["2025 q3"]),
    ("since Jan 15, 23 we", "date", ["Jan 15, 23"]), ("Jan 15, 2023", "date", ["Jan 15, 2023"])])
def test_mentions(spark, text, form, found):
    one = spark.createDataFrame([(text,)], "text STRING")
    assert one.select(X.mentions_of_form(F.col("text"), form)).first()[0] == found


def test_normal_forms(spark):
    one = spark.createDataFrame([("Jan 15, 23", "q1 2025", dt.date(2026, 1, 1))], "a STRING, b STRING, day DATE")
    assert tuple(one.select(normalize_date(F.col("a")), normalize_period(F.col("b"), F.col("day"))).first()) == (
        "2023-01-15", "Q1 2025")


@pytest.mark.parametrize("text, hit", [("其他项目的工时", False), ("他们的工时", False), ("他的工时", True), ("她做了什么", True)])
def test_references_to_a_person(spark, text, hit):
    one = spark.createDataFrame([(text,)], "text STRING")
    assert one.where(F.col("text").rlike(C.REFERENCES["employee"])).count() == int(hit)


def test_generated_sql_is_made_a_template_once_for_all_checks(spark):
    extracted = ask(spark, "Hours of Alex Stone", "Hours of Alex Stone", "Days of Alex Stone").select("question_id", F.col("text").alias("skeleton")).withColumn(
        "entities", F.expr("array(named_struct('entity_type', 'employee', 'ordinal', 0, 'value', 'Alex Stone', 'normalized', 'Alex Stone'))"))
    generated = spark.createDataFrame([
        (0, "DROP TABLE t"), (1, "SELECT h FROM t WHERE e = 'Alex Stone'"), (2, "SELECT 1")], "question_id BIGINT, sql STRING")
    new = MT.learn(generated, extracted, library(spark))
    assert new._jdf.queryExecution().optimizedPlan().toString().count("array_sort(transform(entries") == 1
    assert [(r.template_query, r.sql_template) for r in new.collect()] == [
        ("Hours of Alex Stone", "SELECT h FROM t WHERE e = '{employee_0}'")]


def test_words_of_texts_are_not_broadcast(spark, tmp_path):
    ask(spark, "Hours of name 7 word", "Hours of (name 299) and name 41 x").write.parquet(str(tmp_path / "texts"))
    texts = spark.read.parquet(str(tmp_path / "texts"))
    names = spark.range(300_000).select(
        F.lit("employee").alias("entity_type"), F.concat(F.lit("name "), F.col("id").cast("string")).alias("name")).withColumn(
        "canonical", F.col("name"))
    found = dictionary_hits(texts, names)
    assert "BuildLeft" not in found._jdf.queryExecution().sparkPlan().toString()
    assert sorted((r.question_id, r.start, r.end, r.value) for r in found.collect()) == [
        (0, 9, 15, "name 7"), (1, 10, 18, "name 299"), (1, 24, 31, "name 41")]


def test_pairs_alike_by_terms_are_found_as_one_row_a_pair(spark):
    texts = [f"alpha{i % 50} beta{i % 70} gamma{i % 30} delta" for i in range(300)]
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "skeleton_id BIGINT, skeleton STRING")
    templates = spark.createDataFrame([(i, t + " more") for i, t in enumerate(texts[::3])], "template_id BIGINT, template_query STRING")
    found = M.tfidf_alike(asked, templates, 0.65)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert not re.search(r"Join \[(b#\w+, term|term#\w+, b)#", plan)
    every = M.tfidf_scores(asked, templates).where("similarity >= 0.65")
    rows = lambda df: sorted((r.skeleton, r.template_id, round(r.similarity, 9)) for r in df.collect())
    assert rows(found) == rows(every) and len(rows(every)) == 100
