"""Queries of the llm operators, over whole tables, with the equivalent SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import abuse, credentials, mixing, near_duplicates, neighbours, packing, tokens
from chronoloom.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_pairs(table(spark, d, "graph_nodes"))


def p1_search(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar of all other vectors for a fiftieth of the usable vectors as queries, by greedy search on the graph."""
    g = neighbours.VectorGraph(neighbours.stored_vectors(table(spark, d, "graph_nodes")), neighbours.DIMS, 0.8)
    asked = g.members().where(F.pmod(F.xxhash64("id"), F.lit(50)) == 0).select(F.concat_ws("/", "field", "id").alias("q"), "cid", "id")
    return g.nearest(asked, 5).withColumn("similarity", F.round("similarity", 4))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return credentials.stored_texts(table(spark, d, "hook_events"), table(spark, d, "graph_nodes"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.find_credentials(_texts(spark, d)).select("table_name", "field", "record_id", "start_pos").distinct()


def p5_masked(spark: SparkSession, d: str) -> DataFrame:
    # repeated rows are whole copies; only the few texts with credentials are compared
    return credentials.mask_credentials(_texts(spark, d)).dropDuplicates(["table_name", "field", "record_id"])


def p5_pruning(spark: SparkSession, d: str) -> DataFrame:
    return credentials.pruning(_texts(spark, d))


def _near(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.stored_texts(table(spark, d, "graph_nodes"), table(spark, d, "detected_patterns"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(_near(spark, d))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(_near(spark, d))


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_items(tokens.with_token_counts(table(spark, d, "documents"), ["doc_id"]), table(spark, d, "context_budgets"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(_placed(spark, d))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_placed(spark, d))


def _mix(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("text_key", F.unhex(F.md5("text")))
    return mixing.mix(tokens.with_token_counts(docs, ["doc_id", "source", "text_key"]), table(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.share_report(_mix(spark, d), table(spark, d, "mix_targets"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.abuse_scores(table(spark, d, "documents"), table(spark, d, "abuse_labels"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).where("abusive").select("doc_id").distinct()


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates_by_source(_scores(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_search, p4_found, p4_groups, p5_found, p5_masked, p5_pruning, p7_containers, p7_fill, p8_mix, p8_shares, p9_found, p9_scores, p9_rates)}
ORACLE: dict[str, str] = {
    "p4_found": """
with t as (select 'graph_nodes' as table_name, 'content' as field, id, content as text from graph_nodes union select 'graph_nodes', 'summary', id, summary from graph_nodes union
  select 'detected_patterns', 'matched_line', pattern_id, matched_line from detected_patterns),
w as (select table_name, field, id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from t),
v as (select * from w where len(w) >= 6)
select distinct a.table_name, a.field, a.id as id_a, b.id as id_b from v a join v b on a.table_name = b.table_name and a.field = b.field and a.id < b.id
  and len(a.w) * 5 >= len(b.w) * 4 and len(b.w) * 5 >= len(a.w) * 4 where len(list_intersect(a.w, b.w)) * 5 >= len(list_distinct(list_concat(a.w, b.w))) * 4""",
}
