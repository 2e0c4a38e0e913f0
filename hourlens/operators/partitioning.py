"""Partitioning helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """Deal rows to a number of partitions before CPU-heavy text work, if the caller asks for one.

    For inputs whose files give too few tasks; others are scanned as they lie.
    """
    return df if partitions is None else df.repartition(partitions)


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column so that later filters reuse it.

    A filter on a plain projected column is pushed below the projection and
    takes a copy of the expression with it. A generator stops that.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def checkpoint_folder(spark) -> str:
    """The shared folder for intermediate tables, ``spark.checkpoint.dir``; where that is unset, an error says so."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write a result that several branches read, and read it back.

    The table survives lost executors, is computed once, and its size is known
    to the planner.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/hourlens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
