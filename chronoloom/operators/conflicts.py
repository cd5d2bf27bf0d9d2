"""Conflicts between nodes, and nodes of other developers: blocked joins on equal keys, then components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.text import word_jaccard
from chronoloom.operators.bitemporal import is_active, overlaps
from chronoloom.operators.components import connected_components
from chronoloom.operators.maintenance import content_pairs, peer_verdict

#: Similarity above which two contents, or two vectors, speak of the same thing.
SAME_TEXT, SAME_VECTOR = 0.95, 0.85


def conflict_pairs(nodes: DataFrame, like_vectors: DataFrame | None = None) -> DataFrame:
    """(a, b): active nodes of one type, valid at some common time, that say almost the same in other words: contents above SAME_TEXT alike
    (every such pair, see content_pairs) or vectors above SAME_VECTOR, but contents not equal.

    like_vectors: (a, b, cosine) of near vectors from whatever index is at hand; pairs that it has are judged by the vectors alone. Null
    contents conflict with nothing.
    """
    n = nodes.where(is_active())
    text = content_pairs(n).where(F.col("similarity") > SAME_TEXT).select("a", "b")
    if like_vectors is not None:
        near = like_vectors.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine").distinct()
        text = text.join(near.select("a", "b"), ["a", "b"], "left_anti").unionByName(near.where(F.col("cosine") > SAME_VECTOR).select("a", "b"))
    side = lambda s: n.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("type", "content", "t_valid_from", "t_valid_until")])
    both = text.join(side("a"), "a").join(side("b"), "b")
    return both.where((F.col("type_a") == F.col("type_b")) & (F.col("content_a") != F.col("content_b")) & overlaps("t_valid_from_a", "t_valid_until_a", "t_valid_from_b", "t_valid_until_b")).select("a", "b").distinct()


def conflict_groups(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, group_id): nodes that conflict, and those of groups already known, in transitive groups: a group that holds a known one keeps
    the smallest known name, another is called by its smallest node."""
    known = nodes.where(is_active() & F.col("conflict_group_id").isNotNull()).select("id", "conflict_group_id")
    links = pairs.select(F.concat(F.lit("n:"), "a").alias("src"), F.concat(F.lit("n:"), "b").alias("dst")).unionByName(known.select(F.concat(F.lit("n:"), "id").alias("src"), F.concat(F.lit("g:"), "conflict_group_id").alias("dst")))
    # g: sorts before n:, so that a component is named by its smallest known group, else by its smallest node
    parts = connected_components(links)
    return parts.where("id like 'n:%'").select(F.substring("id", 3, 1 << 30).alias("id"), F.substring("component", 3, 1 << 30).alias("group_id"))


def peer_matches(local: DataFrame, peers: DataFrame, like_vectors: DataFrame | None = None) -> DataFrame:
    """(id, peer_id, verdict): local nodes and peers' nodes of the same type that are one thing (merged) or may be (pending); a pair without
    a row is different. Names are compared by their words: equal word sets meet by an equi-join on the sorted words, which a similarity
    above 0.95 of names under 20 words amounts to; vectors (a: local, b: peer, cosine) as given."""
    words = F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.lower("name"), r"[^a-z0-9]+"), lambda w: w != ""))), " ")
    side = lambda df, c: df.where(is_active()).select(F.col("id").alias(c), "type", F.col("name").alias(f"name_{c}"), words.alias("w")).where("w <> ''")
    pairs = side(local, "id").join(side(peers, "peer_id"), ["type", "w"]).select("id", "peer_id", F.lit(1.0).alias("name"), F.lit(None).cast("double").alias("cosine"))
    if like_vectors is not None:
        types = local.select(F.col("id"), "type").join(like_vectors.select(F.col("a").alias("id"), F.col("b").alias("peer_id"), "cosine"), "id")
        types = types.join(peers.select(F.col("id").alias("peer_id"), F.col("type").alias("t"), F.col("name").alias("n2")), "peer_id").where("type = t")
        named = types.join(local.select("id", F.col("name").alias("n1")), "id")
        pairs = pairs.unionByName(named.select("id", "peer_id", word_jaccard(F.col("n1"), F.col("n2")).alias("name"), "cosine"))
    verdict = peer_verdict(F.max("name"), F.coalesce(F.max("cosine"), F.lit(0.0)))
    return pairs.where("id <> peer_id").groupBy("id", "peer_id").agg(verdict.alias("verdict")).where("verdict <> 'different'")


def pulled(local: DataFrame, remote: DataFrame, keys: list[str], clock: str) -> DataFrame:
    """The local rows after a pull: of each key the row of the later clock (ties: the local one); rows that the peer keeps private or that
    have no clock are not taken."""
    take = remote.where((F.col("visibility") != "private") & F.col(clock).isNotNull())
    rows = local.withColumn("_own", F.lit(True)).unionByName(take.select(*local.columns).withColumn("_own", F.lit(False)))
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(clock), F.desc("_own"))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_own")
