"""Dictionary and alias files: nested JSON <-> rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_dictionary(spark: SparkSession, *paths: str, lines: bool = False) -> DataFrame:
    """``{type: [name, ...]}`` files as distinct (entity_type, entity) rows.

    With ``lines`` every line of a file is such an object, and Spark splits large files.
    """
    text = spark.read.text(list(paths), wholetext=not lines)
    nested = text.select(F.from_json("value", "MAP<STRING, ARRAY<STRING>>").alias("m"))
    by_type = nested.select(F.explode("m").alias("entity_type", "names"))
    names = by_type.select("entity_type", F.explode("names").alias("name"))
    return names.select("entity_type", F.trim("name").alias("entity")).distinct()


_LINE = "entity_type STRING, canonical STRING, canonical_seq INT, aliases ARRAY<STRING>"


def load_aliases(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``{type: {canonical: [alias, ...]}}`` as rows that keep the insertion order.

    A canonical without aliases keeps one row with a NULL alias. With ``lines``
    every line of a file is one canonical name as :func:`save_aliases` writes
    it, and Spark splits large files.
    """
    if lines:
        return spark.read.schema(_LINE).json(path).select(
            "entity_type", "canonical", "canonical_seq", F.posexplode_outer("aliases").alias("alias_seq", "alias")
        ).select("entity_type", "canonical", "canonical_seq", "alias", "alias_seq")
    text = spark.read.text(path, wholetext=True)
    nested = text.select(F.from_json("value", "MAP<STRING, MAP<STRING, ARRAY<STRING>>>").alias("m"))
    by_type = nested.select(F.explode("m").alias("entity_type", "c"))
    by_name = by_type.select("entity_type", F.posexplode("c").alias("canonical_seq", "canonical", "a"))
    return by_name.select(
        "entity_type", "canonical", "canonical_seq", F.posexplode_outer("a").alias("alias_seq", "alias")
    ).select("entity_type", "canonical", "canonical_seq", "alias", "alias_seq")


def save_aliases(aliases: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Alias rows as Parquet, one folder per type, or as JSON, one canonical name with its aliases a line."""
    if fmt == "parquet":
        aliases.write.mode("overwrite").partitionBy("entity_type").parquet(path)
        return
    if fmt != "json":
        raise ValueError(f"unknown format {fmt}")
    own = F.array_sort(F.collect_list(F.when(F.col("alias").isNotNull(), F.struct("alias_seq", "alias"))))
    per_name = aliases.groupBy("entity_type", "canonical").agg(F.min("canonical_seq").alias("canonical_seq"), own.alias("a"))
    per_name.select("entity_type", "canonical", "canonical_seq", F.transform("a", lambda a: a["alias"]).alias("aliases")).write.mode(
        "overwrite").json(path)


def nested_aliases(aliases: DataFrame) -> DataFrame:
    """One JSON text per type: {canonical: [alias, ...]} in insertion order."""
    listed = F.transform(
        F.array_sort(F.collect_list(F.when(F.col("alias").isNotNull(), F.struct("alias_seq", "alias")))),
        lambda a: a["alias"],
    )
    per_name = aliases.groupBy("entity_type", "canonical").agg(
        F.min("canonical_seq").alias("seq"), listed.alias("names"))
    entries = F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "canonical", "names"))),
        lambda e: F.struct(e["canonical"].alias("key"), e["names"].alias("value")),
    )
    return per_name.groupBy("entity_type").agg(F.to_json(F.map_from_entries(entries)).alias("aliases"))
