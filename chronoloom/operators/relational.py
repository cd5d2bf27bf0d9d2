"""Joins, rollups and top-k lists over nodes, edges, communities and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.bitemporal import edge_is_active, is_active


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, numbered r; Spark cuts each map task's groups to k rows before the shuffle."""
    return df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("r") <= k)


def symmetric(edges: DataFrame) -> DataFrame:
    """(a, b, type, weight, confidence): each active edge seen from both of its ends."""
    e = edges.where(edge_is_active()).where("from_id is not null and to_id is not null")
    cols = ["id", "type", "weight", "confidence"]
    return e.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), *cols).unionByName(e.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"), *cols))


def backlinks(edges: DataFrame, nodes: DataFrame, target: DataFrame) -> DataFrame:
    """(to_id, edge_type, n, sources): active edges into the targets (id), grouped by type, with the five most important sources."""
    e = edges.where(edge_is_active()).join(target.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    src = nodes.where(is_active()).select(F.col("id").alias("from_id"), "name", "importance")
    rows = e.select("to_id", "from_id", F.col("type").alias("edge_type"), F.col("id").alias("edge_id")).join(src, "from_id")
    # a target may have a tenth of all edges: they are counted on the way, and only five of them are brought together
    by = ["to_id", "edge_type"]
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    first = top_k(rows, by, [F.desc("importance"), F.asc("from_id"), F.asc("edge_id")], 5)
    names = F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"])
    return counts.join(first.groupBy(*by).agg(F.concat_ws(" | ", names).alias("sources")), by)


def community_leaders(members: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """(community_id, r, entity_id, importance): the k most important active members of each community."""
    rows = members.join(nodes.where(is_active()).select(F.col("id").alias("entity_id"), "name", "importance"), "entity_id")
    return top_k(rows, ["community_id"], [F.desc("importance"), F.asc("entity_id")], k).select("community_id", "r", "entity_id", "name", "importance")


def degree_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): every active node with its number of active edges, 0 included; a self-loop counts once. The join on either end is
    an equi-join on exploded ends."""
    ends = edges.where(edge_is_active()).select(F.col("id").alias("edge"), F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("id"))
    count = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.where(is_active()).select("id", "importance").join(count, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ids."""
    return edges.join(ids.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(ids.select(F.col("id").alias("to_id")), "to_id", "left_semi")


def between(edges: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
    """Edges from a node of one set to a node of the other, in either direction."""
    f, t = (lambda d: d.select(F.col("id").alias("from_id"))), (lambda d: d.select(F.col("id").alias("to_id")))
    ab = edges.join(f(one), "from_id", "left_semi").join(t(two), "to_id", "left_semi")
    ba = edges.join(f(two), "from_id", "left_semi").join(t(one), "to_id", "left_semi")
    return ab.unionByName(ba).dropDuplicates(["id"])


def file_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, n): links between files, lifted from active edges between their nodes; no file links to itself."""
    files = nodes.where(is_active()).select("id", F.explode(F.array_distinct("file_paths")).alias("file"))
    e = edges.where(edge_is_active()).select("from_id", "to_id")
    src = e.join(files.withColumnsRenamed({"id": "from_id", "file": "src"}), "from_id")
    both = src.join(files.withColumnsRenamed({"id": "to_id", "file": "dst"}), "to_id").where("src <> dst")
    return both.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def path_prefixes(column: str) -> Column:
    """All folders above a path, the nearest last: a/b/c.ts gives a, a/b."""
    parts = F.split(F.col(column), "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def folder_rollup(nodes: DataFrame) -> DataFrame:
    """(folder, n_files, n_nodes) for every folder above a file of an active node."""
    files = nodes.where(is_active()).select("id", F.explode("file_paths").alias("file"))
    rows = files.withColumn("folder", F.explode(path_prefixes("file")))
    return rows.groupBy("folder").agg(F.countDistinct("file").alias("n_files"), F.countDistinct("id").alias("n_nodes"))


def first_by_name(nodes: DataFrame) -> DataFrame:
    """(name, id): the active node that a bare name stands for, the one of the smallest id."""
    return nodes.where(is_active()).groupBy("name").agg(F.min("id").alias("id"))


def mentions(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, name, id): active nodes whose name occurs in a text as a whole word.

    Names are identifiers, so that containment is an equi-join on the text's identifiers, once each, instead of a nested loop.
    """
    words = texts.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))).alias("name"))
    return words.join(first_by_name(nodes), "name").select("doc_id", "name", "id")


def allowed_triples(edges: DataFrame, nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, source_type, type, target_type, allowed): each edge against the rules (source_type, edge_type, target_type), a table of the schema."""
    t = nodes.select("id", F.col("type").alias("t"))
    rows = edges.select("id", "from_id", "to_id", "type").join(t.withColumnsRenamed({"id": "from_id", "t": "source_type"}), "from_id").join(t.withColumnsRenamed({"id": "to_id", "t": "target_type"}), "to_id")
    r = rules.select("source_type", F.col("edge_type").alias("type"), "target_type").distinct().withColumn("allowed", F.lit(True))
    return rows.join(r, ["source_type", "type", "target_type"], "left").select("id", "source_type", "type", "target_type", F.coalesce("allowed", F.lit(False)).alias("allowed"))


def applicable_rule(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, visibility): the sharing rule of each fact: of its workspace before global, of its type before any type.

    rules: workspace?, entity_type?, visibility; a small table of settings. Facts without a rule are private.
    """
    # a rule without workspace or type stands under a mark; each fact asks for its four keys, so that the join is on equal keys
    mark = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("*"))
    r = rules.select(mark(F.col("workspace")).alias("_w"), mark(F.col("entity_type")).alias("_t"), "visibility")
    any_ = F.lit("*")
    keys = [(mark(F.col("workspace")), mark(F.col("type"))), (mark(F.col("workspace")), any_), (any_, mark(F.col("type"))), (any_, any_)]
    asked = facts.select("id", F.inline(F.array(*[F.struct(F.lit(i).alias("_rank"), w.alias("_w"), t.alias("_t")) for i, (w, t) in enumerate(keys)])))
    best = asked.join(r, ["_w", "_t"]).groupBy("id").agg(F.min_by("visibility", F.struct("_rank", "visibility")).alias("visibility"))
    return facts.select("id").distinct().join(best, "id", "left").withColumn("visibility", F.coalesce("visibility", F.lit("private")))


def unprocessed_sessions(events: DataFrame, processed: DataFrame) -> DataFrame:
    """Sessions with events that were never processed, or whose processing failed."""
    s = events.select("session_id").where("session_id is not null").distinct().join(processed.select("session_id", "status"), "session_id", "left")
    return s.where("status is null or status = 'failed'").select("session_id", F.coalesce("status", F.lit("orphaned")).alias("status"))


def last_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Upsert: the last row of each key."""
    return top_k(rows, keys, order, 1).drop("r")


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table and those rows whose key it lacks."""
    return table.unionByName(rows.join(table.select(*keys), keys, "left_anti").dropDuplicates(keys))
