"""What changed between consecutive full snapshots.

Each delivery is parsed once into (record kind, record id, 128-bit hash of the record's canonical form). Consecutive
snapshots of a repo are then two sides of one union; a single aggregation by (repo, later snapshot, kind, id) compares
the sides' hashes.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.session import materialize

RECORD_SCHEMA = "snapshot_id long, repo_hash string, timestamp long, received_at timestamp_ntz, record_kind string, record_id string, h binary"


def _not_json(name: str) -> None:
    raise ValueError(name)


def _canonical(v):
    """Numbers by value (1, 1.0 and 1e0 agree), absent and null fields alike, texts and lists as they are."""
    if isinstance(v, dict):
        return {k: _canonical(x) for k, x in v.items() if x is not None}
    if isinstance(v, list):
        return [_canonical(x) for x in v]
    if isinstance(v, float) and v.is_integer():
        return int(v)
    return v


def parse_records(text: str | None) -> list[tuple[str, bytes]] | None:
    """(id, hash) of each record, or None if the text is no valid JSON. Elements without an id are no records."""
    if text is None:
        return None
    try:
        value = json.loads(text, parse_constant=_not_json)
    except (ValueError, RecursionError):
        return None
    out = []
    for r in value if isinstance(value, list) else []:
        if isinstance(r, dict) and r.get("id") is not None:
            body = json.dumps(_canonical(r), sort_keys=True, separators=(",", ":")).encode()
            out.append((r["id"] if isinstance(r["id"], str) else json.dumps(_canonical(r["id"])), hashlib.blake2b(body, digest_size=16).digest()))
    return out


def _parse_batches(batches):
    for b in batches:
        for row in b.to_pylist():
            both = {"entity": parse_records(row["entities"]), "edge": parse_records(row["edges"])}
            if any(v is None for v in both.values()):
                continue
            rows = [("delivered", "", b"")] + [(kind, i, h) for kind, v in both.items() for i, h in v]
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["snapshot_id"]] * n, pa.int64()),
                    pa.array([row["repo_hash"]] * n, pa.string()),
                    pa.array([row["timestamp"]] * n, pa.int64()),
                    pa.array([row["received_at"]] * n, pa.timestamp("us")),
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1].encode("utf-8", "replace").decode() for r in rows], pa.string()),
                    pa.array([r[2] for r in rows], pa.binary()),
                ],
                names=["snapshot_id", "repo_hash", "timestamp", "received_at", "record_kind", "record_id", "h"],
            )


def snapshot_records(snapshots: DataFrame) -> DataFrame:
    """One row per record of each valid snapshot, and one of kind `delivered` per valid snapshot. Damaged ones give none."""
    s = snapshots.select(
        F.col("snapshot_id").cast("long"), "repo_hash", F.col("timestamp").cast("long"), F.col("received_at").cast("timestamp_ntz"), "entities", "edges"
    ).where(F.col("repo_hash").isNotNull() & F.col("timestamp").isNotNull())
    return s.mapInArrow(_parse_batches, RECORD_SCHEMA)


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """(repo_hash, timestamp, record_kind, record_id, change) between each snapshot and the valid one before it.

    A snapshot whose entities or edges are null or no valid JSON counts as not delivered, so the next is compared with
    the one before it. Of equal timestamps the one received first counts (ties: smaller snapshot_id). The first
    snapshot of a repo has no predecessor and gives no rows. Rows without repo or timestamp are left out. A record
    repeated within a snapshot counts once; if its copies differ, the pair of smallest and largest hash is compared. Extra columns
    are ignored; an empty table gives an empty result.
    """
    records = materialize(snapshot_records(snapshots), "snapshot_records")
    at = Window.partitionBy("repo_hash").orderBy("timestamp")
    first = F.min(F.struct("received_at", "snapshot_id"))
    delivered = (
        records.where("record_kind = 'delivered'")
        .groupBy("repo_hash", "timestamp")
        .agg(first["snapshot_id"].alias("snapshot_id"))
        .withColumn("previous", F.lag("timestamp").over(at))
        .withColumn("next", F.lead("timestamp").over(at))
        .select("snapshot_id", "previous", "next")
    )
    sides = (
        records.where("record_kind <> 'delivered'")
        .select("snapshot_id", "repo_hash", "timestamp", "record_kind", "record_id", "h")
        .join(delivered, "snapshot_id")
        .select(
            "repo_hash",
            "record_kind",
            "record_id",
            "h",
            F.inline(
                F.array(
                    F.struct(F.when(F.col("previous").isNotNull(), F.col("timestamp")).alias("timestamp"), F.lit(True).alias("later")),
                    F.struct(F.col("next").alias("timestamp"), F.lit(False).alias("later")),
                )
            ),
        )
        .where(F.col("timestamp").isNotNull())
    )
    side = lambda later, f: f(F.when(F.col("later") == later, F.col("h")))
    change = (
        F.when(F.col("old_min").isNull(), "added")
        .when(F.col("new_min").isNull(), "removed")
        .when((F.col("old_min") != F.col("new_min")) | (F.col("old_max") != F.col("new_max")), "changed")
    )
    return (
        sides.groupBy("repo_hash", "timestamp", "record_kind", "record_id")
        .agg(
            side(False, F.min).alias("old_min"),
            side(False, F.max).alias("old_max"),
            side(True, F.min).alias("new_min"),
            side(True, F.max).alias("new_max"),
        )
        .withColumn("change", change)
        .where(F.col("change").isNotNull())
        .select("repo_hash", "timestamp", "record_kind", "record_id", "change")
    )


def change_summary(changes: DataFrame) -> DataFrame:
    """Number of changes per repo, snapshot, kind and change."""
    return changes.groupBy("repo_hash", "timestamp", "record_kind", "change").agg(F.count(F.lit(1)).alias("n_records"))
