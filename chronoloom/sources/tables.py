"""Readers for the tables of a data directory, one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str, *where: Column | str) -> DataFrame:
    """graph_nodes where the conditions hold, each id once: late and repeated deliveries are whole-row copies, so any of them will do, and
    a condition before removing them gives the same rows as one after it, but reaches the scan."""
    return _where(table(spark, sf_dir, "graph_nodes"), where).dropDuplicates(["id"])


def edges(spark: SparkSession, sf_dir: str, *where: Column | str) -> DataFrame:
    """graph_edges where the conditions hold, each id once, ends trimmed and lower-cased, blank ends null."""
    tidy = lambda c: F.when(F.trim(c) != "", F.lower(F.trim(c)))
    e = table(spark, sf_dir, "graph_edges").withColumn("from_id", tidy(F.col("from_id"))).withColumn("to_id", tidy(F.col("to_id")))
    return _where(e, where).dropDuplicates(["id"])


def _where(df: DataFrame, conditions: tuple[Column | str, ...]) -> DataFrame:
    for c in conditions:
        df = df.where(c)
    return df


def as_utc(df: DataFrame) -> DataFrame:
    """Timestamps without zone become session timestamps (UTC), which watermarks and unix_millis need."""
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampNTZType):
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df
