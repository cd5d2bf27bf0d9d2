"""Graph snapshots, branches, export and import as Parquet and JSON folders. Every write goes to a folder the caller names."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.text import word_jaccard
from chronoloom.operators.bitemporal import is_active

TABLES = ("nodes", "edges", "members")


def write_snapshot(root: str, ts: int, **tables: DataFrame) -> None:
    """Each table below root/<table>/ts=<ts>; a snapshot of the same ts is replaced."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/ts={ts}")


def list_snapshots(spark: SparkSession, root: str, table: str = "nodes") -> list[int]:
    """Times of the snapshots, by folder name alone."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return sorted(int(s.getPath().getName()[3:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("ts="))


def nearest_snapshot(spark: SparkSession, root: str, ts: int) -> int | None:
    """The last snapshot at or before ts."""
    return max((t for t in list_snapshots(spark, root) if t <= ts), default=None)


def restore_snapshot(spark: SparkSession, root: str, ts: int) -> dict[str, DataFrame]:
    """The tables as of the last snapshot at or before ts; empty if there is none."""
    t = nearest_snapshot(spark, root, ts)
    return {} if t is None else {name: spark.read.parquet(f"{root}/{name}/ts={t}") for name in TABLES if t in list_snapshots(spark, root, name)}


def write_branch(df: DataFrame, root: str, branch: str) -> None:
    """The state of a branch; only that branch's partition is replaced."""
    df.withColumn("branch", F.lit(branch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("branch").parquet(root)


def read_branch(spark: SparkSession, root: str, branch: str) -> DataFrame:
    return spark.read.parquet(root).where(F.col("branch") == branch).drop("branch")


def prune_branches(branches: DataFrame, living: DataFrame, now: int, ttl_days: int = 30) -> DataFrame:
    """(branch, reason) to delete: gone, or not updated for the time to live. branches: (branch, updated_at)."""
    alive = living.select("branch", F.lit(True).alias("alive")).distinct()
    reason = F.when(F.col("alive").isNull(), "gone").when(F.col("updated_at") < now - ttl_days * 86_400_000, "old")
    return branches.join(alive, "branch", "left").select("branch", reason.alias("reason")).where("reason is not null")


def export_graph(nodes: DataFrame, edges: DataFrame, communities: DataFrame, root: str) -> None:
    """Active nodes and edges, and communities, as JSON lines; vectors stay out."""
    nodes.where(is_active()).drop("embedding", "embedding_code").write.mode("overwrite").json(f"{root}/nodes")
    edges.where("t_valid_until is null").write.mode("overwrite").json(f"{root}/edges")
    communities.write.mode("overwrite").json(f"{root}/communities")


def read_export(spark: SparkSession, root: str, like: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of an export, with the schemas of the tables given."""
    return {k: spark.read.schema(df.drop("embedding", "embedding_code").schema).json(f"{root}/{k}") for k, df in like.items()}


def import_merge(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after an import is merged: nodes of an existing active (name, type) with like words (above 0.8) are the same and keep
    their id, others are added unless their id is taken; edges come in if both of their ends exist then, and their id is new."""
    cols = nodes.columns
    have = nodes.where(is_active()).groupBy("name", "type").agg(F.min_by("content", "id").alias("old"))
    fresh = new_nodes.join(have, ["name", "type"], "left").where(F.col("old").isNull() | (word_jaccard(F.col("old"), F.col("content")) <= 0.8)).drop("old")
    fresh = fresh.join(nodes.select("id"), "id", "left_anti").dropDuplicates(["id"])
    all_nodes = nodes.unionByName(fresh, allowMissingColumns=True).select(*cols)
    ids = all_nodes.select("id")
    e = new_edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    e = e.join(edges.select("id"), "id", "left_anti").dropDuplicates(["id"])
    return all_nodes, edges.unionByName(e, allowMissingColumns=True).select(*edges.columns)


def import_replace(nodes: DataFrame, new_nodes: DataFrame, now: int) -> DataFrame:
    """Nodes after an import replaced the graph: what was active is archived now, the new rows are added."""
    old = nodes.withColumn("archived_at", F.when(is_active(), F.lit(now)).otherwise(F.col("archived_at")))
    return old.unionByName(new_nodes, allowMissingColumns=True)


def merge_repos(frames: dict[str, DataFrame | None]) -> tuple[DataFrame | None, list[str]]:
    """One table of several repos' tables with repo_id, and the repos that couldn't be read (None)."""
    out = None
    for repo, df in frames.items():
        if df is not None:
            df = df.withColumn("repo_id", F.lit(repo))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out, sorted(r for r, df in frames.items() if df is None)


def audit_rows(spark: SparkSession, operation: str, ids: list[str], now: int) -> DataFrame:
    """Rows for an append-only audit log."""
    return spark.createDataFrame([(operation, i, now, json.dumps({"id": i})) for i in ids], "operation string, entity_id string, ts long, detail string")
