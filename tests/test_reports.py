import datetime as dt


from hourlens.plans import reports as R
from hourlens.sources.star import quarterly_rollup, read_rollup, read_star, write_rollup, write_star
from tests.conftest import rows

LO, HI = dt.date(2025, 1, 1), dt.date(2025, 3, 31)


def one(df):
    return df.first()[0]


def test_overlap_and_contained(small_star):
    assert one(R.employee_project_hours(small_star, "alex", "website", LO, HI)) == 15
    assert one(R.employee_project_hours_exact(small_star, "Alex Stone", "Website", LO, HI)) == 10


def test_unknown_person_is_null(small_star):
    assert one(R.employee_hours(small_star, "Nobody", LO, HI)) is None
    assert one(R.employee_hours(small_star, "%", LO, HI)) is None


def test_top_projects_keeps_hours_without_project(small_star):
    got = [tuple(r) for r in R.top_projects(small_star, LO, HI).collect()]
    assert got == [("P-1", "Website Redesign", 15.0), ("P-2", "Mobile App", 8.0), (None, None, 4.0)]


def test_departments(small_star):
    got = rows(R.compare_departments(small_star, ["Engineering", "HR"], LO, HI), "department", "total_hours")
    assert got == [("Engineering", 23.0), ("HR", 0.0)]
    assert one(R.department_project_share(small_star, "Engineering", "P-1", LO, HI)) == round(1500 / 23, 6)
    assert one(R.department_project_share(small_star, "HR", "P-1", LO, HI)) is None


def test_periods_merge_equal_rows(small_star):
    periods = [("a", LO, HI), ("b", dt.date(2030, 1, 1), dt.date(2030, 2, 1)), ("a", LO, HI)]
    got = rows(R.department_in_periods(small_star, "Engineering", periods), "period", "total_hours")
    assert got == [("a", 23.0), ("b", 0.0)]


def test_lists(small_star):
    assert rows(R.people_on_project(small_star, "P-1", LO, HI), "name") == [("Alex Stone",)]
    assert rows(R.projects_of_employee(small_star, "Sam", LO, HI), "name") == [(None,)]
    assert rows(R.work_types_of_department(small_star, "Engineering", LO, HI), "work_type") == [("Design",), ("Review",)]
    assert rows(R.employee_hours_by_project(small_star, "RV", LO, HI), "name", "hours") == [("Mobile App", 8.0)]


def test_stored_star_prunes_and_pushes_down(spark, small_star, tmp_path):
    write_star(small_star, str(tmp_path / "star"))
    star = read_star(spark, str(tmp_path / "star"))
    report = R.employee_project_hours(star, "alex", "website", LO, HI)
    assert one(report) == 15
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = report._jdf.queryExecution().toString()
    assert "LessThanOrEqual(start_date,2025-03-31)" in plan
    assert "GreaterThanOrEqual(end_date,2025-01-01)" in plan
    assert "CartesianProduct" not in plan
    assert "work_type" not in plan.split("== Physical Plan ==")[1]


def test_rollup_is_pruned_by_period(spark, small_star, tmp_path):
    write_rollup(quarterly_rollup(small_star), str(tmp_path / "flat"))
    flat = spark.read.parquet(str(tmp_path / "flat"))
    report = R.flat_total(flat, "Alex Stone", "Website Redesign", "Q1 2025")
    assert one(report) == 15
    assert "PartitionFilters: [isnotnull(period" in report._jdf.queryExecution().toString()


def test_reports_over_all_people_sum_before_they_join(small_star):
    plan = R.top_employees(small_star, LO, HI)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_rollup_reads_only_asked_periods(spark, small_star, tmp_path):
    write_rollup(quarterly_rollup(small_star), str(tmp_path / "flat"))
    flat = read_rollup(spark, str(tmp_path / "flat"))
    assert sorted(map(str, flat.collect())) == sorted(map(str, quarterly_rollup(small_star).select(*flat.columns).collect()))
    one = R.flat_total(flat, "Alex Stone", "Website Redesign", "Q1 2025")
    assert "PartitionFilters: [isnotnull(period" in plan_of(one) and "(period" in plan_of(one).split("PartitionFilters")[1]
    assert len(flat.where("period = 'Q1 2025'").inputFiles()) > 0
    # A log whose periods are few prunes folders while it runs.
    asked = [(i, "Alex Stone", "Website Redesign", q) for i, q in enumerate(["Q1 2025", "Q1 2025", "Q3 1999", None])]
    log = spark.createDataFrame(asked, "question_id BIGINT, employee STRING, project STRING, period STRING")
    log.write.parquet(str(tmp_path / "log"))
    stored = spark.read.parquet(str(tmp_path / "log")).where("question_id < 3")
    answers = R.flat_answers(flat, stored)
    assert "dynamicpruning" in plan_of(answers).lower()
    assert sorted((r.question_id, r.total_hours) for r in answers.collect()) == [(0, 15.0), (1, 15.0), (2, None)]
