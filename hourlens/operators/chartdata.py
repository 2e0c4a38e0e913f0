"""Shaping of results for charts: typing, sorting, bucketing, pivoting, previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names that hold times.
DATE_NAMES = ("date", "datetime", "time", "timestamp", "created_at", "updated_at")
TIME_AXIS_NAMES = ("date", "datetime", "time", "timestamp", "period", "month", "year", "quarter")


def type_result_dates(df: DataFrame) -> DataFrame:
    """Text columns with a time name become timestamps if every value of the column parses."""
    named = [f.name for f in df.schema if f.name.lower() in DATE_NAMES and isinstance(f.dataType, T.StringType)]
    if not named:
        return df
    bad = df.agg(*(
        F.count_if(F.col(c).isNotNull() & F.try_to_timestamp(F.col(c)).isNull()).alias(c) for c in named)).first()
    return df.withColumns({c: F.try_to_timestamp(F.col(c)) for c in named if bad[c] == 0})


def other_bucket(df: DataFrame, keep: int = 6, most: int = 7, other: str = "Other") -> DataFrame:
    """First column as category, second as value: above ``most`` categories, the ``keep`` largest and their rest.

    Values are summed by category first; NULL is a category like others. The
    largest are a distributed top-k that meets the sums by equality.
    """
    category, value = df.columns[:2]
    df = df.groupBy(category).agg(F.sum(value).alias(value))
    top = df.orderBy(F.desc(value), category).limit(keep).select(F.col(category).alias("_top"), F.lit(True).alias("_in"))
    many = df.agg(F.count("*").alias("n")).scalar() > most
    tagged = df.join(top, F.col(category).eqNullSafe(F.col("_top")), "left")
    in_rest = many & F.col("_in").isNull()
    return tagged.select(
        in_rest.alias("_rest"), F.when(in_rest, F.lit(other)).otherwise(F.col(category)).alias(category), value,
    ).groupBy("_rest", category).agg(F.sum(value).alias(value)).drop("_rest")


def pivot(df: DataFrame) -> DataFrame:
    """First column by second column, cells from the third; two values for a cell are an error."""
    row, column, value = df.columns[:3]
    if not df.groupBy(row, column).count().where("count > 1").isEmpty():
        raise ValueError("pivot: more than one value for a cell")
    return df.groupBy(row).pivot(column).agg(F.first(value))


def time_column(df: DataFrame) -> str:
    return next((c for c in df.columns if c.lower() in TIME_AXIS_NAMES), df.columns[0])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def chart_sort(df: DataFrame, kind: str) -> DataFrame:
    """Lines by their time column, horizontal bars ascending, other charts by value descending."""
    if len(df.columns) < 2:
        raise ValueError(f"{kind} needs a category and a value column")
    if kind == "line":
        return df.orderBy(time_column(df))
    category, value = df.columns[:2]
    if kind == "horizontal_bar":
        return df.orderBy(F.asc(value), category)
    return df.orderBy(F.desc(value), category)


def chart_columns(df: DataFrame, kind: str) -> list[str]:
    """The columns a chart uses, by position and type."""
    least = {"stacked_bar": 3, "table": 1}.get(kind, 2)
    numbers = numeric_columns(df)
    if kind == "scatter":
        if len(numbers) < 2:
            raise ValueError("scatter needs two numeric columns")
        return numbers[:2]
    if kind == "heatmap" and len(df.columns) < 3:
        if not numbers:
            raise ValueError("heatmap needs numeric data")
        return numbers
    if len(df.columns) < least:
        raise ValueError(f"{kind} needs {least} columns")
    if kind == "line":
        axis = time_column(df)
        return [axis, *(c for c in df.columns if c != axis)]
    return {"stacked_bar": df.columns, "heatmap": df.columns[:3], "table": df.columns[:8]}.get(kind, df.columns[:2])


def long_series(df: DataFrame, kind: str) -> DataFrame:
    """Several value columns as (category, series, value) rows."""
    axis, *values = chart_columns(df, kind)
    return df.unpivot(axis, [c for c in values if c in numeric_columns(df)], "series", "value")


def table_preview(df: DataFrame, order: list[str], rows: int = 15, columns: int = 8, width: int = 20) -> DataFrame:
    """First rows and columns, long texts cut."""
    shown = df.columns[:columns]
    texts = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.orderBy(*order).limit(rows).select(*(
        F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("..."))).otherwise(F.col(c)).alias(c)
        if c in texts else F.col(c) for c in shown))


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
