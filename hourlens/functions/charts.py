"""Chart choice and labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hint words by kind of question, in order of precedence.
TEXT_HINTS = (
    ("share", ("distribution", "breakdown", "percentage", "percent", "proportion", "share")),
    ("trend", ("trend", "over time", "by month", "by year", "by quarter")),
    ("compare", ("compare", "comparison", "versus", "vs")),
    ("rank", ("top", "bottom", "rank", "ranking", "most", "least")),
)
TYPE_HINTS = (
    ("share", ("distribution", "percentage")), ("trend", ("trend", "overtime")),
    ("compare", ("compare",)), ("rank", ("rank", "top")),
)


def _hint(text: Column, hints) -> Column:
    low = F.lower(text)
    out = F
    for name, words in hints:
        out = out.when(F.rlike(low, F.lit("|".join(words))), F.lit(name))
    return out


def chart_type(rows: Column, columns: Column, has_time: Column, text: Column, query_type: Column) -> Column:
    """Chart for a result of the given shape: the question's words first, then the query type, then the shape."""
    hint = F.coalesce(_hint(text, TEXT_HINTS), _hint(query_type, TYPE_HINTS))
    return (
        F.when(hint == "share", F.when(rows <= 7, "pie").otherwise("horizontal_bar"))
        .when(hint == "trend", "line")
        .when(hint == "compare", F.when(rows <= 10, "bar").otherwise("horizontal_bar"))
        .when(hint == "rank", F.when(rows > 6, "horizontal_bar").otherwise("bar"))
        .when(columns == 2, F.when(rows > 10, "horizontal_bar").otherwise("bar"))
        .when(columns > 3, F.when(rows > 10, "heatmap").otherwise("stacked_bar"))
        .when((columns >= 3) & has_time, "line")
        .when(rows > 20, "table")
        .otherwise("bar")
    )


def chart_title(text: Column, query_type: Column) -> Column:
    """The question as a title of at most 60 characters, else the query type in words, else a default."""
    asked = F.concat(F.upper(F.substring(text, 1, 1)), F.regexp_replace(F.substring(text, F.lit(2), F.length(text)), r"\?$", ""))
    short = F.when(F.length(asked) > 60, F.concat(F.substring(asked, 1, 57), F.lit("..."))).otherwise(asked)
    words = F.regexp_extract_all(query_type, F.lit(r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)"), F.lit(0))
    return (
        F.when(F.length(text) > 0, short)
        .when(F.length(query_type) > 0, F.initcap(F.array_join(words, " ")))
        .otherwise("Query Results")
    )


def axis_label(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
