import json

from pyspark.sql import functions as F

from hourlens.functions import sqltext as Q
from hourlens.plans import maintenance as MT
from hourlens.plans.extraction import find_mentions
from hourlens.sources.templates import library, load_templates, read_templates, save_templates
from tests.conftest import ask


def lint(spark, sql, *mapped):
    row = spark.createDataFrame([(sql, list(mapped))], "s STRING, m ARRAY<STRING>")
    return row.select(Q.lint_sql(F.col("s"), F.col("m"))).first()[0]


def test_lint(spark):
    assert lint(spark, "SELECT SUM(hours) FROM t WHERE e = '{employee_0}'", "{employee_0}") == []
    assert lint(spark, "SELECT created_at FROM t") == []
    assert lint(spark, "DROP TABLE t") == ["dangerous: DROP", "missing: SELECT", "missing: FROM"]
    assert lint(spark, "SELECT (a FROM t") == ["unbalanced parentheses"]
    assert lint(spark, "SELECT )a( FROM t") == ["unbalanced parentheses"]
    assert lint(spark, "SELECT 'a FROM t") == ["unbalanced quotes"]
    assert lint(spark, "SELECT a FROM t WHERE p = '{project_0}'", "{employee_0}") == [
        "unknown slot: {project_0}", "unused slot: {employee_0}"]


def test_period_text(spark):
    df = spark.createDataFrame([("d > 'Q1 2025-start'",), ("d > '2025_end'",), ("d > '2025-01-01'",)], "s STRING")
    assert [r[0] for r in df.select(Q.unresolved_period(F.col("s"))).collect()] == [True, True, False]
    old = spark.createDataFrame([("SELECT a FROM t WHERE period = '{time_period_0}' AND period='{time_period_1}'",)], "s STRING")
    assert old.select(Q.migrate_period_sql(F.col("s"))).first()[0] == (
        "SELECT a FROM t WHERE NOT (start_date > '{time_period_0}-end' OR end_date < '{time_period_0}-start') AND "
        "NOT (start_date > '{time_period_1}-end' OR end_date < '{time_period_1}-start')")


def test_values_to_slots_and_back(spark):
    entries = "array<struct<placeholder:string,value:string>>"
    df = spark.createDataFrame([(
        "SELECT a FROM t WHERE n = 'Al' AND m = 'Al (x)' AND k = 'Also'", [("{e_0}", "Al (x)"), ("{e_1}", "Al")])],
        f"s STRING, e {entries}")
    assert df.select(Q.sql_to_template(F.col("s"), F.col("e"))).first()[0] == (
        "SELECT a FROM t WHERE n = '{e_1}' AND m = '{e_0}' AND k = 'Also'")
    filled = spark.sql("""SELECT "x = '{e_0}' AND d <= '{p_0}-end' AND c > '{p_0}_start'" AS s, array(
        named_struct('placeholder', '{e_0}', 'value', "O'Neil", 'start_date', CAST(NULL AS DATE), 'end_date', CAST(NULL AS DATE)),
        named_struct('placeholder', '{p_0}', 'value', '2025', 'start_date', DATE'2025-01-01', 'end_date', DATE'2025-12-31')) AS e""")
    assert filled.select(Q.fill_sql(F.col("s"), F.col("e"))).first()[0] == (
        "x = 'O''Neil' AND d <= '2025-12-31' AND c > '2025-01-01'")


def test_library(spark):
    rows = library(spark).collect()
    assert [r.template_id for r in rows] == list(range(1, 13))
    assert rows[0].intent == "aggregation" and rows[0].tables_used == ["work_hour", "employee", "project"]
    assert [s.placeholder for s in rows[5].slots] == ["{employee_0}", "{employee_1}", "{time_period_0}"]
    checked = library(spark).select(Q.lint_sql(F.col("sql_template"), F.transform("slots", lambda s: s["placeholder"])).alias("i"))
    assert all(r.i == [] for r in checked.collect())
    assert library(spark, special=False).count() == 10


def test_json_and_parquet(spark, tmp_path):
    items = [{"template_query": "Hours of {employee_0}?", "sql_template": "SELECT SUM(h) FROM t WHERE e = '{employee_0}'",
              "usage_count": 3, "metadata": {"source": "file"}}]
    for name, content in (("a.json", {"templates": items}), ("b.json", items)):
        (tmp_path / name).write_text(json.dumps(content))
        row = load_templates(spark, str(tmp_path / name)).first()
        assert (row.template_query, row.usage_count, row.source, row.success_rate) == ("Hours of {employee_0}?", 3, "file", 1.0)
    save_templates(library(spark), str(tmp_path / "t"))
    assert read_templates(spark, str(tmp_path / "t")).count() == 12


def test_learn_and_upsert(spark, dictionary):
    log = ask(spark, "Hours of Alex Stone in Q1 2025", "Hours of Robin Vale in Q2 2025", "Drop it in Q1 2025",
              "How many hours did Sam Reed work in Q1 2025?")
    sql = "SELECT SUM(h) FROM work_hours WHERE e = '{}' AND period = '{}'"
    generated = spark.createDataFrame([
        (0, sql.format("Alex Stone", "Q1 2025")), (1, sql.format("Robin Vale", "Q2 2025")), (2, "DROP TABLE t"),
        (3, sql.format("Sam Reed", "Q1 2025"))], "question_id BIGINT, sql STRING")
    new = MT.learn(generated, find_mentions(log, dictionary), library(spark))
    rows = new.collect()
    assert [(r.template_query, r.sql_template) for r in rows] == [(
        "Hours of {employee_0} in {time_period_0}", sql.format("{employee_0}", "{time_period_0}"))]
    used = spark.createDataFrame([("Hours of {employee_0} in {time_period_0}", 2)], "template_query STRING, uses BIGINT").withColumn(
        "last_used", F.lit("2025-01-01").cast("timestamp_ntz"))
    once = MT.upsert(library(spark), used, new)
    twice = MT.upsert(once, used, new)
    assert once.count() == twice.count() == 13
    assert twice.where("usage_count = 2").count() == 1


def test_maintain(spark):
    extra = library(spark).limit(2).withColumn("template_id", F.col("template_id") + 50)
    bad = library(spark).limit(1).withColumn("template_id", F.lit(99).cast("bigint")).withColumn("template_query", F.lit("x")).withColumn(
        "sql_template", F.lit("DROP TABLE x"))
    kept = MT.maintain(library(spark).union(extra).union(bad), F.col("usage_count").cast("double"), 5)
    assert sorted(r.template_id for r in kept.collect()) == [1, 2, 3, 4, 5]
    assert MT.drop_unresolved(spark.createDataFrame([("a > '2025-start'",), ("a",)], "sql STRING")).count() == 1
    one = spark.createDataFrame([(1, i) for i in range(9)] + [(2, 1)], "k INT, v INT")
    samples = {r.k: r.samples for r in MT.sample_rows(one, "k").collect()}
    assert len(samples[1]) == 5 and samples[2] == ['{"v":1}'] and samples[1][0] == '{"v":0}'
