"""The write path as an append-only change log: the present state of a table is one aggregation over its rows and the log."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.bitemporal import edge_is_active, is_active

#: Word similarity above which a candidate says nothing new, and from which it rewrites the node of its name.
SAME, REWRITE = 0.8, 0.4


def node_states(nodes: DataFrame, log: DataFrame, fields: list[str]) -> DataFrame:
    """The nodes after a log of changes: id, the `fields`, access_count, last_accessed, t_valid_until, archived_at.

    log: id, at (ms), seq, op and the fields. insert and update set the fields they give (null: not given), the last one by (at, seq) wins;
    touch counts an access; invalidate and archive end a node at their time, the first of them counts. Ids that were never a node and are
    not inserted have no state. A node's own row is its first insert. Unknown ops change nothing.
    """
    base = nodes.select("id", F.lit(None).cast("long").alias("at"), F.lit(None).cast(dict(log.dtypes)["seq"]).alias("seq"), F.lit("base").alias("op"), *fields, "access_count", "last_accessed", "t_valid_until", "archived_at")
    none = [F.lit(None).cast("long").alias(c) for c in ("access_count", "last_accessed", "t_valid_until", "archived_at")]
    rows = base.unionByName(log.select("id", "at", "seq", "op", *fields, *none))
    order = F.struct(F.col("op") != "base", "at", "seq")
    sets = F.col("op").isin("base", "insert", "update")
    when = lambda op: F.min(F.when(F.col("op") == op, F.col("at")))
    out = rows.where("id is not null").groupBy("id").agg(
        F.max(F.col("op").isin("base", "insert")).alias("known"),
        *[F.max_by(c, F.when(sets & F.col(c).isNotNull(), order)).alias(c) for c in fields],
        (F.coalesce(F.max("access_count"), F.lit(0)) + F.count_if(F.col("op") == "touch")).alias("access_count"),
        F.greatest(F.max("last_accessed"), F.max(F.when(F.col("op").isin("touch", "insert"), F.col("at")))).alias("last_accessed"),
        F.least(F.min("t_valid_until"), when("invalidate")).alias("t_valid_until"),
        F.least(F.min("archived_at"), when("archive")).alias("archived_at"),
    )
    return out.where("known").drop("known")


def edge_states(edges: DataFrame, log: DataFrame) -> DataFrame:
    """(id, from_id, to_id, type, t_valid_until): edges after a log (id, at, op, from_id, to_id, type) of inserts and invalidations."""
    rows = edges.select("id", F.lit("insert").alias("op"), F.col("t_created").alias("at"), "from_id", "to_id", "type", "t_valid_until")
    rows = rows.unionByName(log.select("id", "op", "at", "from_id", "to_id", "type", F.lit(None).cast("long").alias("t_valid_until")))
    first = F.when(F.col("op") == "insert", F.col("at"))
    one = F.min_by(F.struct("from_id", "to_id", "type"), F.when(F.col("op") == "insert", F.struct("at", "from_id", "to_id", "type")))
    out = rows.where("id is not null").groupBy("id").agg(F.min(first).alias("t"), one.alias("e"), F.least(F.min("t_valid_until"), F.min(F.when(F.col("op") == "invalidate", F.col("at")))).alias("t_valid_until"))
    return out.where("t is not null").select("id", "e.from_id", "e.to_id", "e.type", "t_valid_until")


def audit(log: DataFrame) -> DataFrame:
    """(op, day, n, n_ids): changes per kind and UTC day."""
    day = F.date_format(F.timestamp_millis("at"), "yyyy-MM-dd")
    return log.groupBy("op", day.alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"))


def consolidate_in_order(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fact_id, action, match_id, similarity): candidate facts (fact_id, at, name, type, content) taken one after another, each held
    against what the ones before it left behind.

    No node of that name and type: ADD, and the fact becomes the node. Above 0.8 word similarity NOOP; from 0.4 UPDATE, the node gets the
    fact's content; below INVALIDATE, the fact becomes the node in its place. Facts of one name and type go by (at, fact_id); of several active
    nodes the one of the smallest id counts. Facts of a hot name stream through one task, which holds the present content only.
    Null names match nothing (ADD, without becoming a node).
    """
    cols = ["name", "type", "kind", "at", "fact_id", "content"]
    old = nodes.where(is_active()).where("name is not null").groupBy("name", "type").agg(F.min(F.struct("id", "content")).alias("m"))
    old = old.select("name", "type", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at"), F.col("m.id").alias("fact_id"), F.col("m.content").alias("content"))
    rows = old.unionByName(facts.select("name", "type", F.lit(1).alias("kind"), F.col("at").cast("long").alias("at"), "fact_id", "content"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, words = None, None, frozenset()
        for b in batches:
            out: list[tuple] = []
            for name, type_, kind, _, fact, content in zip(*(b.column(c).to_pylist() for c in cols), strict=True):
                new = frozenset((content or "").split())
                if (name, type_) != key or name is None:
                    key, node, words = (name, type_), None, frozenset()
                if kind == 0:
                    node, words = fact, new
                    continue
                if node is None:
                    out.append((fact, "ADD", None, None))
                    node, words = fact, new
                    continue
                s = len(words & new) / len(words | new) if words and new else 0.0
                action = "NOOP" if s > SAME else "UPDATE" if s >= REWRITE else "INVALIDATE"
                out.append((fact, action, node, s))
                if action != "NOOP":
                    words = new
                if action == "INVALIDATE":
                    node = fact
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.float64()))], names=["fact_id", "action", "match_id", "similarity"])

    ordered = rows.select(*cols).repartition("name", "type").sortWithinPartitions(*cols[:5])
    return ordered.mapInArrow(fold, "fact_id string, action string, match_id string, similarity double")


def nearest_package(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(path, package): for each file path the package (package: its folder) nearest above it, null without any. An equi-join on the
    folders above a file, not a prefix comparison."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    rows = files.select("path").distinct().select("path", F.explode(above).alias("package"))
    hit = rows.join(packages.select("package").distinct(), "package", "left_semi").groupBy("path").agg(F.max_by("package", F.length("package")).alias("package"))
    return files.select("path").distinct().join(hit, "path", "left")


def best_spans(spans: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """Of the rows with equal keys the one of the highest score (ties: smallest `tie`)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(tie))
    return spans.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def repair_json(c: Column) -> Column:
    """A JSON text as a model may have written it: without a fence around it, without commas before a closing bracket."""
    bare = F.regexp_replace(F.trim(c), r"(?s)^```[a-z]*\s*\n?(.*?)\n?```$", "$1")
    return F.regexp_replace(bare, r",\s*([}\]])", "$1")


def live_bridges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, state): active edges whose ends are both among the live nodes are kept, others are to be ended; an edge with a null end can't
    be verified and is kept."""
    live = nodes.where(is_active()).select("id").distinct()
    e = edges.where(edge_is_active()).select("id", "from_id", "to_id")
    gone = lambda c: e.where(F.col(c).isNotNull()).join(live.withColumnRenamed("id", c), c, "left_anti").select("id")
    dead = gone("from_id").unionByName(gone("to_id")).distinct().withColumn("dead", F.lit(True))
    unsure = F.col("from_id").isNull() | F.col("to_id").isNull()
    return e.join(dead, "id", "left").select("id", F.when(unsure, "unverified").when(F.col("dead"), "ended").otherwise("kept").alias("state"))
