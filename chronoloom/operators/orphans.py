"""References to records that do not exist.

A Bloom filter over the parent keys, of a bounded size, proves most orphans without touching the parents again. The
references it lets through are verified by an exact join, in which hot keys are salted. Rows are aggregated last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.session import catalyst_column, column_expression, materialize, millis_to_period, shuffle_partitions

#: Bits of the filter at most: 16 MB are broadcast however many parents there are. Beyond about 17 million parents the
#: share of false positives grows; each only means one more row in the exact join, never a wrong result.
MAX_FILTER_BITS = 128 * 1024 * 1024
BITS_PER_KEY = 8
#: Salts a hot key is spread over.
SALTS = 16


def key_filter(parents: DataFrame, key: str) -> bytes:
    """A serialised Bloom filter of the keys, built in one aggregation on the executors and at most 16 MB; empty without keys."""
    hashed = parents.where(F.col(key).isNotNull()).select(F.xxhash64(F.col(key)).alias("h"))
    n = hashed.count()
    if not n:
        return b""
    bits = max(1024, min(MAX_FILTER_BITS, n * BITS_PER_KEY))
    bloom = hashed._jdf.stat().bloomFilter("h", n, bits)
    out = parents.sparkSession._jvm.java.io.ByteArrayOutputStream()
    bloom.writeTo(out)
    return bytes(out.toByteArray())


def may_exist(filter_bytes: bytes, ref: str) -> Column:
    """False only if no parent has this key. Runs inside the JVM's generated code."""
    if not filter_bytes:
        return F.lit(False)
    from pyspark.sql import SparkSession

    expressions = SparkSession.active()._jvm.org.apache.spark.sql.catalyst.expressions
    return catalyst_column(
        expressions.BloomFilterMightContain(
            column_expression(F.lit(bytearray(filter_bytes))), column_expression(F.xxhash64(F.col(ref)))
        )
    )


def hot_keys(refs: DataFrame, key: str, share: int) -> DataFrame:
    """Keys that hold more than one in `share` rows: fewer than `share` keys, so the result is small by construction."""
    counts = refs.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = refs.count()
    return counts.where(F.col("n") > max(1000, total // share)).select(key)


def salted_left_join(refs: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """refs left join parents (unique keys) on `key`; hot keys are spread over SALTS tasks, the parents' few hot rows copied."""
    share = 4 * shuffle_partitions(refs.sparkSession)
    hot = [r[0] for r in hot_keys(refs, key, share).collect()]  # fewer than `share` keys
    if not hot:
        return refs.join(parents, key, "left")
    is_hot = F.col(key).isin(hot)
    left = refs.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*refs.columns), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = parents.withColumn("_salt", F.explode(copies))
    return left.join(right, [key, "_salt"], "left").drop("_salt")


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Rows of refs (table_name, field, record_id, ref_id, ref_ms) whose parent is missing, later or archived.

    parents: id, t_created, archived_at (unix ms). ref_id is compared trimmed and lower-cased; null and blank ones are
    no case. A parent delivered several times counts as there from its first t_created, and as archived from its first
    archived_at. Reasons: missing, later (created after the reference), archived (at or before it). A reference without
    a time can only be missing, and its period is null. A null t_created of a parent counts as always there. Repeated
    rows come out once. Other columns of either side are ignored. Empty inputs give an empty result.
    """
    tidy = F.lower(F.trim(F.col("ref_id")))
    refs = (
        refs.select("table_name", "field", "record_id", tidy.alias("ref_id"), F.col("ref_ms").cast("long").alias("ref_ms"))
        .where(F.col("ref_id") != "")
    )
    # the filter, its size and the join read the parents' few columns: one row per key, made once
    parents = materialize(
        parents.where(F.col("id").isNotNull())
        .groupBy(F.lower(F.trim(F.col("id"))).alias("ref_id"))
        .agg(
            F.min(F.coalesce(F.col("t_created").cast("long"), F.lit(-(2**62)))).alias("p_created"),
            F.min(F.col("archived_at").cast("long")).alias("p_archived"),
        ),
        "parents",
    )
    seen = may_exist(key_filter(parents, "ref_id"), "ref_id")
    refs = materialize(refs.withColumn("maybe", F.coalesce(seen, F.lit(False))), "refs")
    cols = ["table_name", "field", "record_id", "ref_id", "ref_ms"]
    absent = refs.where(~F.col("maybe")).select(*cols, F.lit("missing").alias("reason"))
    checked = salted_left_join(refs.where("maybe").select(*cols), parents, "ref_id")
    reason = (
        F.when(F.col("p_created").isNull(), "missing")
        .when(F.col("p_created") > F.col("ref_ms"), "later")
        .when(F.col("p_archived") <= F.col("ref_ms"), "archived")
    )
    found = checked.select(*cols, reason.alias("reason")).where(F.col("reason").isNotNull())
    # only orphans are compared with one another; references that are in order never meet their copies
    return absent.unionByName(found).distinct().withColumn("period", millis_to_period(F.col("ref_ms")))


def graph_references(edges: DataFrame, members: DataFrame, communities: DataFrame) -> DataFrame:
    """The references of graph_edges and community_members in the form orphan_references() takes."""
    e = edges.select(
        F.lit("graph_edges").alias("table_name"),
        F.inline(
            F.array(
                F.struct(F.lit("from_id").alias("field"), F.col("from_id").alias("ref_id")),
                F.struct(F.lit("to_id").alias("field"), F.col("to_id").alias("ref_id")),
            )
        ),
        F.col("id").alias("record_id"),
        F.col("t_created").alias("ref_ms"),
    )
    c = communities.groupBy(F.col("id").alias("community_id")).agg(F.max("updated_at").alias("ref_ms"))
    m = (
        members.select("community_id", "entity_id")
        .join(c, "community_id", "left")
        .select(
            F.lit("community_members").alias("table_name"),
            F.lit("entity_id").alias("field"),
            F.col("community_id").alias("record_id"),
            F.col("entity_id").alias("ref_id"),
            "ref_ms",
        )
    )
    return e.unionByName(m)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field, period and reason, with the number of distinct missing keys."""
    per_key = orphans.groupBy("table_name", "field", "period", "reason", "ref_id").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("table_name", "field", "period", "reason").agg(
        F.sum("n").alias("n_references"), F.count(F.lit(1)).alias("n_keys")
    )
