import pytest
from pyspark.sql import functions as F

from hourlens.functions import charts as C
from hourlens.operators import chartdata as D


@pytest.mark.parametrize("rows,columns,timed,text,kind,want", [
    (8, 2, False, "Percentage of hours", None, "horizontal_bar"), (7, 2, False, "share", None, "pie"),
    (3, 2, False, "trend by month", None, "line"), (11, 2, False, "compare a and b", None, "horizontal_bar"),
    (10, 2, False, None, None, "bar"), (11, 4, False, None, None, "heatmap"), (10, 4, False, None, None, "stacked_bar"),
    (10, 3, True, None, None, "line"), (21, 3, False, None, None, "table"), (5, 3, False, None, None, "bar"),
    (7, 2, False, None, "topEmployees", "horizontal_bar"), (3, 2, False, None, "hoursOverTime", "line"),
])
def test_chart_type(spark, rows, columns, timed, text, kind, want):
    df = spark.createDataFrame([(rows, columns, timed, text, kind)], "r INT, c INT, t BOOLEAN, x STRING, k STRING")
    assert df.select(C.chart_type(*(F.col(n) for n in "rctxk"))).first()[0] == want


def test_titles(spark):
    df = spark.createDataFrame([("hours of Alex?", None), ("x" * 70, None), (None, "hoursByPerson"), (None, None)], "t STRING, k STRING")
    got = [r[0] for r in df.select(C.chart_title(F.col("t"), F.col("k"))).collect()]
    assert got == ["Hours of Alex", "X" + "x" * 56 + "...", "Hours By Person", "Query Results"]
    assert spark.range(1).select(C.axis_label(F.lit("total_hours"))).first()[0] == "Total Hours"


def test_other_bucket(spark):
    nine = spark.createDataFrame([(f"c{i}", float(i)) for i in range(1, 10)], "c STRING, v DOUBLE")
    got = {r.c: r.v for r in D.other_bucket(nine).collect()}
    assert len(got) == 7 and got["Other"] == 6.0 and got["c9"] == 9.0
    assert D.other_bucket(nine.where("v <= 7")).count() == 7


def test_pivot(spark):
    cells = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "r STRING, c STRING, v INT")
    assert {r.r: (r.x, r.y) for r in D.pivot(cells).collect()} == {"a": (1, 2), "b": (3, None)}
    with pytest.raises(ValueError):
        D.pivot(cells.union(cells))


def test_types_columns_and_preview(spark, tmp_path):
    df = spark.createDataFrame([("2025-01-02", "soon", "x" * 30, 1.0)], "date STRING, time STRING, note STRING, v DOUBLE")
    typed = dict(D.type_result_dates(df).dtypes)
    assert typed["date"] == "timestamp" and typed["time"] == "string"
    assert D.table_preview(df, ["date"]).first().note == "x" * 20 + "..."
    two = df.select("v", "time")
    assert D.chart_columns(two, "line") == ["time", "v"] and D.chart_columns(two, "heatmap") == ["v"]
    for kind in ("scatter", "stacked_bar"):
        with pytest.raises(ValueError):
            D.chart_columns(two, kind)
    sums = spark.createDataFrame([("a", 1, 2), ("b", 5, 0)], "c STRING, v INT, w INT")
    assert [r.c for r in D.chart_sort(sums, "bar").collect()] == ["b", "a"]
    assert [r.c for r in D.chart_sort(sums, "horizontal_bar").collect()] == ["a", "b"]
    assert D.long_series(sums, "stacked_bar").count() == 4
    D.export_csv(sums, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["c", "v", "w"]
