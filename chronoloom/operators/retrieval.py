"""Hybrid retrieval: BM25, vectors and graph, fused by reciprocal ranks and weighted by trust.

Queries come as a DataFrame (q, text), so that one run answers many. Statistics are over all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.bitemporal import is_active
from chronoloom.operators.relational import top_k

K1, B = 1.2, 0.75
#: Query vectors that are sent to all tasks at a time.
QUERIES = 2000
#: Constant of reciprocal rank fusion, trust weights by tier, boosts.
RRF_K, TRUST, PACKAGE_BOOST, TASK_BOOST = 60, {1: 1.0, 2: 0.9, 3: 0.7, 4: 0.5}, 0.15, 0.3
#: Words of questions about the whole and about parts; types that a task favours.
GLOBAL_WORDS = ("architecture", "overview", "explain", "structure", "high-level", "design", "modules", "subsystems")
LOCAL_WORDS = ("function", "class", "method", "variable", "import", "error", "bug", "fix", "implement", "where is", "how does", "what does")
TASK_TYPES = {"bug-fix": ("Bug", "Solution"), "regression": ("Bug", "Solution"), "feature": ("Concept", "Decision"), "review": ("Convention",)}


def terms(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9_]+)"), F.lit(1))


def inverted_index(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, id, tf, dl): postings of the wanted terms (term) in docs (id, text), with each document's length. Other terms end at the join,
    before anything is shuffled."""
    d = docs.select("id", terms(F.col("text")).alias("t"))
    rows = d.select("id", F.size("t").alias("dl"), F.explode("t").alias("term")).join(wanted.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(q, id, score, norm): the k best documents (id, text) that have every term of a query (q, text); norm runs from 0 to 1 over them."""
    asked = queries.select("q", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    postings = inverted_index(docs, asked)
    # one row of totals
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(terms(F.col("text")))).alias("avgdl"))
    need = asked.groupBy("q").agg(F.count(F.lit(1)).alias("need"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    hits = postings.join(df, "term").join(asked, "term").join(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy("q", "id").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("have")).join(need, "q").where("have = need")
    best = top_k(scored.withColumn("score", F.round("score", 9)), ["q"], [F.desc("score"), F.asc("id")], k).select("q", "id", "score")
    w = Window.partitionBy("q")  # k rows a query
    low, high = F.min("score").over(w), F.max("score").over(w)
    return best.withColumn("norm", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if one is all zeros, null if their lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i.cast("double") * j.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), None).otherwise(F.when(norm > 0, dot(a, b) / norm).otherwise(0.0))


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 15, least: float = 0.3) -> DataFrame:
    """(q, id, score): the k most similar vectors (id, v) to each query (q, v), at least `least` similar. Exact: a stated query set is held
    against every row, in blocks of QUERIES queries that are sent to all tasks, by matrix products on Arrow batches; each batch gives k rows
    a query at most. Rows and queries without a vector, with NaN, or of different lengths have no score; all zeros have 0."""
    queries = queries.select("q", "v").where("v is not null")
    blocks = max(1, -(-queries.count() // QUERIES))
    types = dict(queries.dtypes)["q"], dict(vectors.dtypes)["id"]
    out = None
    for i in range(blocks):
        rows = [(r["q"], np.array(r["v"], np.float64)) for r in queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).collect()]
        found = vectors.select("id", "v").where("v is not null").mapInArrow(_most_similar(rows, k, least), f"q {types[0]}, id {types[1]}, score double")
        out = found if out is None else out.unionByName(found)
    return top_k(out, ["q"], [F.desc("score"), F.asc("id")], k).select("q", "id", "score")


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.where(np.isnan(n), np.nan, 0.0) * np.ones_like(m), where=n > 0)


def _most_similar(rows: list[tuple], k: int, least: float):
    sides = {}
    for n in {len(v) for _, v in rows}:
        own = [(q, v) for q, v in rows if len(v) == n]
        sides[n] = [q for q, _ in own], _unit(np.array([v for _, v in own]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for n, (names, x) in sides.items():
                own = b.filter(pa.array(sizes == n))
                if not own.num_rows or not n:
                    continue
                y = own.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(own.num_rows, n)
                s = np.round(x @ _unit(y).T, 9)
                ids = own.column("id")
                for i, name in enumerate(names):
                    hit = np.flatnonzero(s[i] >= least)
                    if len(hit) > k:
                        # all that tie with the k-th stay, so that ids can decide
                        hit = hit[s[i][hit] >= np.partition(s[i][hit], -k)[-k]]
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(hit)), ids.take(pa.array(hit)), pa.array(s[i][hit])], names=["q", "id", "score"])

    return search


def query_terms(text: str) -> list[str]:
    """Terms of a query for names: words of two letters and more, parts of camelCase, neighbours joined as PascalCase and snake_case."""
    words = re.findall(r"[A-Za-z0-9_]{2,}", text)
    parts = [p for w in words for p in re.findall(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])", w) if len(p) >= 2 and p != w]
    pairs = [f(a, b) for a, b in zip(words, words[1:], strict=False) for f in (lambda a, b: a.capitalize() + b.capitalize(), lambda a, b: f"{a.lower()}_{b.lower()}")]
    return list(dict.fromkeys(words + parts + pairs))


def graph_channel(nodes: DataFrame, sym: DataFrame, queries: DataFrame, per_term: int = 5, k: int = 20) -> DataFrame:
    """(q, id, score): 1.0 for nodes of a term's name, 0.9 for the first nodes whose name contains it (3 letters and more), 0.7 for their
    neighbours; the best counts. queries: (q, term)."""
    n = nodes.where(is_active()).select("id", "name")
    exact = queries.join(n, F.col("term") == F.col("name")).select("q", "id", F.lit(1.0).alias("score"))
    # the terms of the queries asked are few; every name is read once
    part = n.join(F.broadcast(queries.where(F.length("term") >= 3)), F.lower("name").contains(F.lower("term")))
    part = top_k(part, ["q", "term"], [F.asc("id")], per_term).select("q", "id", F.lit(0.9).alias("score"))
    found = exact.unionByName(part).groupBy("q", "id").agg(F.max("score").alias("score"))
    near = found.select("q", F.col("id").alias("a")).join(sym.select("a", "b").distinct(), "a").select("q", F.col("b").alias("id")).distinct().join(n.select("id"), "id", "left_semi")
    all_ = found.unionByName(near.select("q", "id", F.lit(0.7).alias("score"))).groupBy("q", "id").agg(F.max("score").alias("score"))
    return top_k(all_, ["q"], [F.desc("score"), F.asc("id")], k).select("q", "id", "score")


def rrf(ranked: DataFrame) -> DataFrame:
    """(q, id, score): reciprocal rank fusion of ranked (q, channel, id, score); ties within a channel by id."""
    w = Window.partitionBy("q", "channel").orderBy(F.desc("score"), "id")
    return ranked.withColumn("r", F.row_number().over(w)).groupBy("q", "id").agg(F.sum(1.0 / (RRF_K + F.col("r"))).alias("score"))


def trust_weight(c: Column) -> Column:
    out = F.lit(TRUST[4])
    for tier in (3, 2, 1):
        out = F.when(c == tier, TRUST[tier]).otherwise(out)
    return out


def rerank(fused: DataFrame, nodes: DataFrame, task: str | None = None, package: str | None = None, k: int = 15) -> DataFrame:
    """(q, id, final): fused scores weighted by importance, confidence, trust and task, plus a boost for the same package."""
    n = nodes.select("id", "type", "importance", "confidence", "trust_tier", "package_path")
    boost = F.when(F.col("type").isin(*TASK_TYPES.get(task or "", ("",))), 1 + TASK_BOOST).otherwise(1.0)
    same = F.when(F.col("package_path") == package, PACKAGE_BOOST).otherwise(0.0) if package else F.lit(0.0)
    final = F.round(F.col("score") * F.col("importance") * F.col("confidence") * trust_weight(F.col("trust_tier")) * boost + same, 9)
    return top_k(fused.join(n, "id").withColumn("final", final), ["q"], [F.desc("final"), F.asc("id")], k).select("q", "id", "type", "final")


def hybrid_search(nodes: DataFrame, sym: DataFrame, queries: DataFrame, vectors: DataFrame, k: int = 15, task: str | None = None, package: str | None = None) -> DataFrame:
    """(q, id, type, final) for queries (q, text, terms, v): three channels of 3k results, one hop around the graph's, fused and reranked."""
    active = nodes.where(is_active())
    docs = active.select("id", F.concat_ws(" ", "name", "content", "summary", F.array_join("tags", " ")).alias("text"))
    words = bm25(docs, queries.select("q", "text"), 3 * k).select("q", F.lit("bm25").alias("channel"), "id", F.col("norm").alias("score"))
    like = vector_search(vectors, queries.select("q", "v"), 3 * k).select("q", F.lit("vector").alias("channel"), "id", "score")
    linked = graph_channel(nodes, sym, queries.select("q", F.explode("terms").alias("term")), k=3 * k).select("q", F.lit("graph").alias("channel"), "id", "score")
    return rerank(rrf(words.unionByName(like).unionByName(linked)), active, task, package, k)


def second_stage(hits: DataFrame, nodes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(q, id, overlap, final, r, and where it is from: created_by, session_id, trust_tier): of the hits (q, id, final) of each query (q, text)
    the k that share most of its words (ties: final, id)."""
    text = nodes.select("id", F.concat_ws(" ", "name", "summary", "content").alias("t"), "created_by", "session_id", "trust_tier")
    rows = hits.select("q", "id", "final").join(text, "id").join(queries.select("q", F.col("text").alias("asked")), "q")
    rows = rows.withColumn("overlap", F.round(token_overlap(F.col("asked"), F.col("t")), 9))
    return top_k(rows, ["q"], [F.desc("overlap"), F.desc("final"), F.asc("id")], k).select("q", "id", "overlap", "final", "r", "created_by", "session_id", "trust_tier")


def answer_globally(questions: list[tuple[str, str]], nodes: DataFrame, communities: DataFrame, k: int = 5) -> DataFrame:
    """(q, r, id, level, member_count): for each question about the whole the k largest communities that have a summary; questions about
    parts, and those to a small graph, have none. questions: (q, text), a stated list."""
    n = nodes.where(is_active()).count()
    wide = [q for q, t in questions if classify_question(t, n)["scope"] == "global"]
    best = communities.where("trim(summary) <> ''").orderBy(F.desc("member_count"), "id").limit(k)
    rows = best.select("id", "level", "member_count", F.explode(F.array(*[F.lit(q) for q in wide]).cast("array<string>")).alias("q"))
    return top_k(rows, ["q"], [F.desc("member_count"), F.asc("id")], k).select("q", "r", "id", "level", "member_count")


def answer_terms(text: str) -> str:
    """A question as the words that must match: quoted phrases and words, without operators and signs."""
    return " ".join(sanitize_query(text))


def classify_question(text: str, active_nodes: int, least: int = 100) -> dict[str, object]:
    """Whether a question is about the whole (answered from communities) or about parts; small graphs are always asked for parts."""
    t = text.lower()
    wide = sum(w in t for w in GLOBAL_WORDS) > sum(w in t for w in LOCAL_WORDS)
    return {"scope": "global" if wide and active_nodes >= least else "local", "global_unavailable": wide and active_nodes < least}


def sanitize_query(text: str) -> list[str]:
    """Quoted phrases whole, other words without operators and signs; all of them must match."""
    phrases = re.findall(r'"([^"]+)"', text)
    rest = re.sub(r'"[^"]*"?', " ", text)
    return phrases + [w for w in re.findall(r"\w+", rest) if w.upper() not in ("AND", "OR", "NOT", "NEAR")]


def weighted_fusion() -> Column:
    """Score of a candidate (bm25, vector, graph, ce, trust_tier, same_package) where ranks aren't at hand."""
    c = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    return (0.3 * c("bm25") + 0.25 * c("vector") + 0.2 * c("graph") + 0.25 * c("ce")) * trust_weight(F.col("trust_tier")) + F.when(F.col("same_package"), 0.1).otherwise(0.0)


def time_features(days: Column) -> Column:
    """16 numbers of a time span: one linear and 15 sines of rising frequency, of log2(1 + days)."""
    tau = F.log2(1 + F.greatest(days, F.lit(0.0)))
    return F.concat(F.array(-0.1 * tau + 0.5), F.transform(F.sequence(F.lit(0), F.lit(14)), lambda i: F.sin(tau * 0.01 * F.pow(F.lit(10.0), 3 * i / 14.0))))


def throttle(calls: DataFrame, normal: int = 3, reduced: int = 8) -> DataFrame:
    """(session_id, tool_name, event_id, n, mode): each call of a tool in a session, by time: normal, then reduced, then blocked."""
    w = Window.partitionBy("session_id", "tool_name").orderBy("occurred_at", "event_id")
    n = calls.where("session_id is not null and tool_name is not null").withColumn("n", F.row_number().over(w))
    return n.select("session_id", "tool_name", "event_id", "n", F.when(F.col("n") <= normal, "normal").when(F.col("n") <= reduced, "reduced").otherwise("blocked").alias("mode"))


def token_budget(rows: DataFrame, by: str, order: list[Column], size: Column, budget: int) -> DataFrame:
    """The first rows of each group whose sizes together stay within the budget."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def token_overlap(query: Column, text: Column) -> Column:
    """Share of the query's terms that a text has: the stand-in for a cross-encoder where no model is at hand."""
    q = F.array_distinct(terms(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, F.array_distinct(terms(text)))) / F.size(q)).otherwise(0.0)


def freshness(created: Column, changed: Column) -> Column:
    """fresh, stale (file changed up to 30 days after) or rotten, from a node's and its file's times in ms; unknown without a file."""
    return F.when(changed.isNull(), "unknown").when(changed <= created, "fresh").when(changed - created <= 30 * 86_400_000, "stale").otherwise("rotten")
