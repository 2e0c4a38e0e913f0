import datetime as dt
import random


from hourlens import schemas
from hourlens.plans import answering as A
from hourlens.plans import context as C
from hourlens.plans import reports as R
from hourlens.plans.extraction import find_mentions, mentions_long
from hourlens.sources.star import Star
from hourlens.sources.templates import library
from tests.conftest import ask

PARAMS = "question_id BIGINT, employee STRING, project STRING, start_date DATE, end_date DATE"


def day(n):
    return dt.date(2025, 1, 1) + dt.timedelta(days=n)


def test_log_equals_loop_of_single_reports(spark, small_star):
    rng = random.Random(2)
    hours = [(rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 2, None]), "Design", float(rng.randrange(1, 9)), s, s + dt.timedelta(days=rng.randrange(9)))
             for s in (day(rng.randrange(60)) for _ in range(150))]
    hours += [(1, 1, "Design", 3.0, None, day(3)), (1, 1, "Design", 3.0, day(3), None)]
    star = Star(small_star.employee, small_star.project, spark.createDataFrame(hours, schemas.WORK_HOUR))
    names, projects = ["Alex Stone", "e", "RV", "Nobody"], ["Website", "P-", "App"]
    asked = [(i, names[i % 4], projects[i % 3], day(5 * (i % 11)), day(5 * (i % 11) + i % 13)) for i in range(24)]
    asked += [(100, None, "App", day(1), day(9)), (101, "e", "App", None, None), (102, "e", "P-", day(0), day(70))]
    params = spark.createDataFrame(asked, PARAMS)
    got = {r.question_id: r.total_hours for r in A.answer_totals(params, star).collect()}
    assert len(got) == len(asked) and got[100] is None and got[101] is None
    for i, e, p, lo, hi in asked[:24:5] + asked[26:]:
        assert got[i] == R.employee_project_hours(star, e, p, lo, hi).first()[0]
    people = {r.question_id: r.total_hours for r in A.answer_totals(params.where("question_id < 4"), star, ("employee",)).collect()}
    for i, e, _, lo, hi in asked[:4]:
        assert people[i] == R.employee_hours(star, e, lo, hi).first()[0]


def test_slots_sql_and_parameters(spark, dictionary):
    log = find_mentions(ask(
        spark, "How many hours did Alex Stone work on the Website Redesign project in Q1 2023?",
        "Compare the hours worked by Alex Stone and Robin Vale in last month"), dictionary)
    templates = library(spark)
    matches = spark.createDataFrame([(0, 1), (1, 6), (1, 7)], "question_id BIGINT, template_id BIGINT").where("template_id < 7")
    slots = A.fill_slots(matches, templates, mentions_long(log))
    sql = {r.question_id: r.sql for r in A.filled_sql(slots, templates).collect()}
    assert "'%Alex Stone%'" in sql[0] and "h.start_date <= '2023-03-31'" in sql[0] and "{" not in sql[0]
    assert "'%Robin Vale%'" in sql[1] and "h.end_date >= '2026-01-01'" in sql[1]
    row = A.parameters(slots).where("question_id = 0").first()
    assert (row.employee, row.project, row.start_date, row.end_date) == (
        "Alex Stone", "Website Redesign", dt.date(2023, 1, 1), dt.date(2023, 3, 31))


def test_unfilled_slots_stay(spark, dictionary):
    log = find_mentions(ask(spark, "hours in Q1 2023"), dictionary)
    matches = spark.createDataFrame([(0, 4)], "question_id BIGINT, template_id BIGINT")
    sql = A.filled_sql(A.fill_slots(matches, library(spark), mentions_long(log)), library(spark)).first().sql
    assert "{employee_0}" in sql and "2023-03-31" in sql


def test_references(spark, dictionary):
    texts = ["Alex Stone in Q1 2025", "and Sam Reed?", "what did he do", "hours of they", "x", "y", "z", "his hours",
             "Robin Vale: is it her project"]
    rows = [(i, 7, dt.datetime(2025, 1, 1 + i), t) for i, t in enumerate(texts)] + [(50, 8, dt.datetime(2025, 1, 1), "their hours")]
    log = spark.createDataFrame(rows, schemas.QUESTIONS)
    mentions = mentions_long(find_mentions(log, dictionary))
    turns = C.number_turns(log)
    assert {r.question_id: r.turn for r in turns.where("session_id = 7").collect()} == {i: i + 1 for i in range(9)}
    got = {r.question_id: (r.normalized, r.resolved_from) for r in C.resolve_references(turns, mentions).where("resolved_from IS NOT NULL").collect()}
    assert got == {2: ("Sam Reed", 2), 3: ("Sam Reed", 2)}
    chinese = spark.createDataFrame([(0, 1, dt.datetime(2025, 1, 1), "Sam Reed"), (1, 1, dt.datetime(2025, 1, 2), "他的工时")], schemas.QUESTIONS)
    found = C.resolve_references(C.number_turns(chinese), mentions_long(find_mentions(chinese, dictionary)))
    assert found.where("question_id = 1 AND entity_type = 'employee'").first().normalized == "Sam Reed"
