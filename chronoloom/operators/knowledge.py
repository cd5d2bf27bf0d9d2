"""Views of the graph for readers: lookups with fallbacks, summaries, reports, document freshness, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.bitemporal import DAY, edge_is_active, is_active, kind_not_in
from chronoloom.operators.relational import top_k
from chronoloom.operators.retrieval import bm25


def file_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def nodes_by_file(nodes: DataFrame, paths: DataFrame, k: int = 10) -> DataFrame:
    """(path, id, how, r): for each asked path the k most important active nodes of exactly that file; if there is none, of a file whose
    name (after the last slash) begins with the asked one's: how is exact or name."""
    n = nodes.where(is_active()).select("id", "importance", F.explode(F.array_distinct("file_paths")).alias("file"))
    asked = paths.select("path").where("path is not null").distinct()
    exact = asked.join(n, F.col("path") == F.col("file")).select("path", "id", "importance", F.lit("exact").alias("how"))
    open_ = asked.join(exact.select("path").distinct(), "path", "left_anti").withColumn("name", file_name(F.col("path")))
    # a name that begins another one begins with the same two letters
    named = n.where(F.col("file").contains("/")).withColumn("other", file_name(F.col("file")))
    like = open_.withColumn("head", F.substring("name", 1, 2)).join(named.withColumn("head", F.substring("other", 1, 2)), "head").where(F.col("other").startswith(F.col("name")) & (F.length("name") > 1))
    rows = exact.unionByName(like.select("path", "id", "importance", F.lit("name").alias("how")).distinct())
    return top_k(rows.distinct(), ["path"], [F.desc("importance"), F.asc("id")], k).select("path", "id", "how", "r")


def top_by_package(nodes: DataFrame, k: int) -> DataFrame:
    """(package_path, id, importance): the k most important active nodes over all packages, of at most k from each: the search over a
    workspace merges the lists of its repositories."""
    own = top_k(nodes.where(is_active()), ["package_path"], [F.desc("importance"), F.asc("id")], k)
    return own.select("package_path", "id", "importance").orderBy(F.desc("importance"), "id").limit(k)


def communities_of(communities: DataFrame, members: DataFrame, asked: DataFrame, k: int = 3) -> DataFrame:
    """(entity_id, r, id, level, member_count): the k largest communities of each asked node (entity_id)."""
    m = members.select(F.col("community_id").alias("id"), "entity_id").distinct().join(asked.select("entity_id").distinct(), "entity_id", "left_semi")
    c = communities.select("id", "level", "member_count")
    return top_k(m.join(c, "id"), ["entity_id"], [F.desc("member_count"), F.asc("id")], k).select("entity_id", "r", "id", "level", "member_count")


def augment(docs: DataFrame, nodes: DataFrame, edges: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """(q, id, r, edges): the k best text hits of each query (q, text) with up to k outgoing active edges each, heaviest first, as
    type:to_id. Queries under 3 characters have none."""
    hits = bm25(docs, queries.where(F.length("text") >= 3), k)
    hits = hits.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id")))
    e = edges.where(edge_is_active()).where("to_id is not null").join(hits.select(F.col("id").alias("from_id")).distinct(), "from_id", "left_semi")
    e = top_k(e, ["from_id"], [F.desc("weight"), F.asc("id")], k)
    lists = e.groupBy(F.col("from_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("r", F.concat_ws(":", "type", "to_id").alias("t")))).alias("l"))
    return hits.join(lists, "id", "left").select("q", "id", "r", F.concat_ws(" ", F.transform("l", lambda x: x["t"])).alias("edges"))


def word_search(docs: DataFrame, nodes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(q, id, how): the k best text hits of each query (q, text); a query without any gets the most important active nodes with the text as
    it stands in name or content."""
    hits = bm25(docs, queries, k).select("q", "id", F.lit("words").alias("how"))
    rest = queries.join(hits.select("q").distinct(), "q", "left_anti")
    # the queries asked are a stated, small set; every node is read once
    part = nodes.where(is_active()).join(F.broadcast(rest), F.lower("name").contains(F.lower("text")) | F.lower("content").contains(F.lower("text")))
    return hits.unionByName(top_k(part, ["q"], [F.desc("importance"), F.asc("id")], k).select("q", "id", F.lit("part").alias("how")))


def document_code(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, file): files of code that a document refers to, itself or through its chunks. Documents are nodes that are no code and no
    chunk; all nodes and edges on the way are active."""
    live = nodes.where(is_active())
    e = edges.where(edge_is_active()).select("from_id", "to_id")
    code = live.where("type in ('CodeEntity', 'FileNode')").select(F.col("id").alias("to_id"), F.explode("file_paths").alias("file"))
    chunk = live.where("type = 'ContentChunk'").select(F.col("id").alias("to_id"))
    docs = live.where("type not in ('CodeEntity', 'FileNode', 'ContentChunk')").select(F.col("id").alias("from_id"))
    own = e.join(docs, "from_id", "left_semi")
    direct = own.join(code, "to_id").select(F.col("from_id").alias("doc_id"), "file")
    parts = own.join(chunk, "to_id", "left_semi").select(F.col("from_id").alias("doc_id"), F.col("to_id").alias("from_id"))
    return direct.unionByName(parts.join(e, "from_id").join(code, "to_id").select("doc_id", "file")).distinct()


def document_staleness(nodes: DataFrame, refs: DataFrame, mtimes: DataFrame, days: int = 90) -> DataFrame:
    """(doc_id, n_files, newest, lag_days, stale): how much later the newest code of a document (refs: doc_id, file) changed than the
    document (its t_created); stale above `days`. mtimes: (file, mtime); files without are left out."""
    d = refs.join(mtimes, "file").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_files"), F.max("mtime").alias("newest"))
    lag = (F.col("newest") - F.col("t_created")) / F.lit(float(DAY))
    return d.join(nodes.select(F.col("id").alias("doc_id"), "t_created"), "doc_id").select("doc_id", "n_files", "newest", lag.alias("lag_days"), (lag > days).alias("stale"))


def validated(nodes: DataFrame, mtimes: DataFrame) -> DataFrame:
    """(id, confidence): trusted notes on code (tier 1) of which a file changed after they were made lose 0.1 of confidence, down to 0.01."""
    n = nodes.where(is_active()).where("trust_tier = 1 and type in ('CodeEntity', 'Convention', 'Decision')")
    files = n.select("id", "t_created", "confidence", F.explode("file_paths").alias("file")).join(mtimes, "file").where("mtime > t_created")
    return files.groupBy("id").agg(F.greatest(F.lit(0.01), F.first("confidence") - 0.1).alias("confidence"))


def doubtful_claims(nodes: DataFrame, deleted: DataFrame, k: int = 20) -> DataFrame:
    """(id, verdict, confidence): of the k least certain inferred nodes (tier 3), those with a deleted file are invalidated, the others
    confirmed with 0.05 more. deleted: (file)."""
    few = nodes.where(is_active()).where("trust_tier = 3").orderBy("confidence", "id").limit(k)
    gone = few.select("id", F.explode("file_paths").alias("file")).join(deleted.select("file").distinct(), "file", "left_semi").select("id", F.lit(True).alias("gone")).distinct()
    rows = few.join(gone, "id", "left")
    return rows.select("id", F.when(F.col("gone"), "invalidated").otherwise("confirmed").alias("verdict"), F.when(F.col("gone"), F.col("confidence")).otherwise(F.least(F.lit(1.0), F.col("confidence") + 0.05)).alias("confidence"))


def summary_tree(nodes: DataFrame, communities: DataFrame) -> DataFrame:
    """(id, level, scope_id, token_count, content_hash): level 0 is the content of every active node, 1 its summary (or the first 240
    characters of the content), 2 the summary of every community (or a sentence that it has none). token_count counts words.
    A one-row overview of all communities is left to the reader: it would hold them all."""
    live = nodes.where(is_active())
    text = F.when(F.trim("summary") != "", F.col("summary"))
    rows = live.select(F.lit(0).alias("level"), F.col("id").alias("scope_id"), F.col("content").alias("t"))
    rows = rows.unionByName(live.select(F.lit(1).alias("level"), F.col("id").alias("scope_id"), F.coalesce(text, F.substring("content", 1, 240)).alias("t")))
    rows = rows.unionByName(communities.select(F.lit(2).alias("level"), F.col("id").alias("scope_id"), F.coalesce(text, F.concat(F.lit("Community "), "id", F.lit(" has no summary."))).alias("t")))
    words = F.size(F.filter(F.split(F.coalesce("t", F.lit("")), r"\s+"), lambda x: x != ""))
    return rows.select(F.concat(F.lit("lvl"), "level", F.lit(":"), "scope_id").alias("id"), "level", "scope_id", words.alias("token_count"), F.sha2(F.coalesce("t", F.lit("")), 256).alias("content_hash"))


def detection_due(nodes: DataFrame, since: int, least: int = 100, fresh: int = 20) -> DataFrame:
    """(n_active, n_new, due): whether communities are to be found anew: enough active nodes, and more than `fresh` since then."""
    n = nodes.where(is_active()).agg(F.count(F.lit(1)).alias("n_active"), F.count_if(F.col("t_created") > since).alias("n_new"))
    return n.withColumn("due", (F.col("n_active") >= least) & (F.col("n_new") > fresh))


def dominant_package(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(community_id, package_path): the one package of all active members; null if there are several or a member has none."""
    rows = members.select("community_id", "entity_id").distinct().join(nodes.where(is_active()).select(F.col("id").alias("entity_id"), "package_path"), "entity_id")
    one = (F.min("package_path") == F.max("package_path")) & (F.count("package_path") == F.count(F.lit(1)))
    return rows.groupBy("community_id").agg(F.when(one, F.min("package_path")).alias("package_path"))


def within_json_budget(rows: DataFrame, by: str, order: list[Column], columns: list[str], budget: int = 8000) -> DataFrame:
    """The first rows of each group whose JSON texts together have at most `budget` characters. Spark cuts each group to that many rows
    (a row has 2 characters at least) before it is brought together."""
    first = top_k(rows, [by], order, max(1, budget // 2)).drop("r")
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return first.withColumn("used", F.sum(F.length(F.to_json(F.struct(*columns)))).over(w)).where(F.col("used") <= budget)


def session_context(nodes: DataFrame, limits: dict[str, int | None]) -> DataFrame:
    """(type, id, name): what a session starts from: of each type the newest active nodes, so many (None: all)."""
    live = nodes.where(is_active())
    out = None
    for k in sorted({v for v in limits.values() if v is not None}):
        own = top_k(live.where(F.col("type").isin(*[t for t, v in limits.items() if v == k])), ["type"], [F.desc("created_at"), F.asc("id")], k).select("type", "id", "name")
        out = own if out is None else out.unionByName(own)
    whole = live.where(F.col("type").isin(*[t for t, v in limits.items() if v is None])).select("type", "id", "name")
    return whole if out is None else out.unionByName(whole)


def unexplored(nodes: DataFrame, k: int, kinds: tuple[str, ...], topic: str | None = None) -> DataFrame:
    """(id, trust_tier, access_count): the k best trusted nodes (tier 2 and better) that were hardly ever read (3 times at most), without
    the given kinds, with the topic in name or summary if one is given."""
    n = nodes.where(is_active() & kind_not_in(*kinds)).where("trust_tier <= 2 and access_count <= 3")
    if topic:
        n = n.where(F.lower("name").contains(topic.lower()) | F.lower("summary").contains(topic.lower()))
    return n.orderBy("trust_tier", "access_count", "id").limit(k).select("id", "trust_tier", "access_count")


def episodes(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """(session_id, n_calls, n_nodes, first_at, last_at, summary): one line per session: its tool calls and the nodes it left."""
    calls = events.where("session_id is not null").groupBy("session_id").agg(F.count("tool_name").alias("n_calls"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"))
    made = nodes.where("session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    rows = calls.join(made, "session_id", "left").withColumn("n_nodes", F.coalesce("n_nodes", F.lit(0)))
    return rows.withColumn("summary", F.concat(F.lit("Session "), "session_id", F.lit(": "), "n_calls", F.lit(" tool calls, "), "n_nodes", F.lit(" signals")))


def debounced(events: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """(key, first_at, last_at, n): bursts of events of one key with pauses under `gap`: a session window, in batch as in a stream."""
    w = events.where(F.col(key).isNotNull()).groupBy(F.col(key), F.session_window(at, gap))
    return w.agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count(F.lit(1)).alias("n")).drop("session_window")


def sprint_report(nodes: DataFrame, since: int, until: int, k: int = 5) -> DataFrame:
    """(type, n, share, latest): what a period brought per type: count, share of all, and the k newest as name (day)."""
    n = nodes.where(F.col("created_at").between(since, until))
    counts = n.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    newest = top_k(n, ["type"], [F.desc("created_at"), F.asc("id")], k)
    label = F.concat("name", F.lit(" ("), F.date_format(F.timestamp_millis("created_at"), "yyyy-MM-dd"), F.lit(")"))
    lists = newest.groupBy("type").agg(F.array_sort(F.collect_list(F.struct("r", label.alias("t")))).alias("l"))
    total = n.agg(F.count(F.lit(1)).alias("total"))
    return counts.join(lists, "type").join(F.broadcast(total)).select("type", "n", (F.col("n") / F.col("total")).alias("share"), F.concat_ws(", ", F.transform("l", lambda x: x["t"])).alias("latest"))


def missing_fields(rows: DataFrame, key: str, required: list[str]) -> DataFrame:
    """(key, missing): rows that lack a required field (null or blank), with the names of those."""
    lack = F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(c)) for c in required]))
    return rows.select(key, F.concat_ws(",", lack).alias("missing")).where("missing <> ''")


def subgraph(nodes: DataFrame, degrees: DataFrame, edges: DataFrame, k: int = 50) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the k most important active nodes (ties: degree, id) and the active edges among them, for a picture."""
    n = nodes.where(is_active()).select("id", "name", "type", "importance").join(degrees.select("id", "degree"), "id", "left")
    few = n.withColumn("degree", F.coalesce("degree", F.lit(0))).orderBy(F.desc("importance"), F.desc("degree"), "id").limit(k)
    ids = F.broadcast(few.select("id"))  # k rows
    e = edges.where(edge_is_active()).join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return few, e.select("id", "from_id", "to_id", "type")


def unlogged(pairs: DataFrame, log: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) that no log row (a, b) has, in either order."""
    both = log.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")}).join(both, ["a", "b"], "left_anti")


def json_lengths(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, n_<column>): the length of each column's JSON array; broken JSON and other values count as empty."""
    n = [F.coalesce(F.json_array_length(F.col(c)), F.lit(0)).alias(f"n_{c}") for c in columns]
    return rows.select(key, *n)
