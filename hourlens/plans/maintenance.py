"""Growing and cleaning the template table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourlens.functions import sqltext as Q
from hourlens.functions.extract import placeholder
from hourlens.operators.learning import retain_top
from hourlens.sources.templates import complete_templates


def sql_templates(generated: DataFrame, extracted: DataFrame) -> DataFrame:
    """(question_id, skeleton, sql_template, mapped): generated SQL with values turned into slots."""
    entries = F.transform("entities", lambda e: F.struct(
        _slot_name(e).alias("placeholder"), e["normalized"].alias("value")))
    joined = generated.join(extracted.select("question_id", "skeleton", entries.alias("entries")), "question_id")
    return joined.select(
        "question_id", "skeleton", Q.sql_to_template(F.col("sql"), F.col("entries")).alias("sql_template"),
        F.transform("entries", lambda e: e["placeholder"]).alias("mapped"))


def _slot_name(entity: Column) -> Column:
    return placeholder(entity["entity_type"], entity["ordinal"])


def learn(generated: DataFrame, extracted: DataFrame, templates: DataFrame) -> DataFrame:
    """New valid templates: one per skeleton that the table does not hold yet.

    The first question (smallest id) with valid SQL gives the SQL of a skeleton.
    Equal texts of a skeleton are one before they are checked; both minima
    combine on the map side, however often a skeleton occurs.
    """
    found = sql_templates(generated, extracted)
    # The checks read results of the aggregation: a filter on its keys would be pushed into the join, once for every check.
    texts = found.groupBy("skeleton", "sql_template", "mapped").agg(
        F.min("question_id").alias("first"), F.any_value(F.struct("sql_template", "mapped")).alias("t"))
    valid = texts.where(F.size(Q.lint_sql(F.col("t.sql_template"), F.col("t.mapped"))) == 0)
    first = valid.groupBy("skeleton").agg(F.min_by("t.sql_template", "first").alias("sql_template"))
    new = first.join(templates.select(F.col("template_query").alias("skeleton")), "skeleton", "left_anti")
    return complete_templates(new.select(
        F.xxhash64("skeleton").alias("template_id"), F.col("skeleton").alias("template_query"), "sql_template"))


def upsert(templates: DataFrame, used: DataFrame, new: DataFrame) -> DataFrame:
    """The table after a batch: statistics of used templates raised, new skeletons inserted.

    ``used`` holds (template_query, uses, last_used) of the batch.
    """
    batch = used.groupBy("template_query").agg(F.sum("uses").alias("_uses"), F.max("last_used").alias("_last"))
    kept = templates.join(batch, "template_query", "left").withColumns({
        "usage_count": F.col("usage_count") + F.coalesce("_uses", F.lit(0)),
        "last_used": F.greatest("last_used", "_last"),
    }).select(*templates.columns)
    fresh = new.join(templates.select("template_query"), "template_query", "left_anti")
    return kept.unionByName(fresh.select(*templates.columns))


def first_rows(result: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first n rows of each key's result, in the order of all columns, with their ``rank`` from 1."""
    order = Window.partitionBy(key).orderBy(*(c for c in result.columns if c != key))
    return result.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def sample_rows(result: DataFrame, key: str, n: int = 5) -> DataFrame:
    """(key, samples): the first n rows of each key's result as JSON texts.

    A key gathers these n rows only.
    """
    columns = [c for c in result.columns if c != key]
    rows = F.array_sort(F.collect_list(F.struct("rank", F.to_json(F.struct(*columns)).alias("row"))))
    return first_rows(result, key, n).groupBy(key).agg(F.transform(rows, lambda r: r["row"]).alias("samples"))


def drop_unresolved(entries: DataFrame, sql: str = "sql") -> DataFrame:
    """Entries whose filled SQL holds no period text where a date belongs."""
    return entries.where(~Q.unresolved_period(F.col(sql)))


def maintain(templates: DataFrame, quality: Column, capacity: int | None = None) -> DataFrame:
    """Migrated, valid and de-duplicated template table (smallest id per skeleton), with its quality.

    With ``capacity`` the best so many stay, otherwise all.
    """
    migrated = templates.withColumn("sql_template", Q.migrate_period_sql(F.col("sql_template")))
    names = F.transform("slots", lambda s: s["placeholder"])
    valid = migrated.where(
        (F.size(Q.lint_sql(F.col("sql_template"), names)) == 0)
        & ~Q.unresolved_period(F.regexp_replace("sql_template", Q.PLACEHOLDER, "")))
    ids = valid.groupBy("template_query").agg(F.min("template_id").alias("template_id")).select("template_id")
    kept = valid.join(ids, "template_id", "left_semi")
    return kept.withColumn("quality", quality) if capacity is None else retain_top(kept, quality, capacity)
