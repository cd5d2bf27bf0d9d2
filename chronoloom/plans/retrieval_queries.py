"""Queries of hybrid retrieval, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import retrieval as r
from chronoloom.operators.bitemporal import is_active
from chronoloom.operators.relational import symmetric
from chronoloom.plans.sql import PRE
from chronoloom.plans.temporal_queries import T0, events
from chronoloom.session import materialize
from chronoloom.sources.tables import edges, nodes, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
QUESTIONS = [("q1", "token session"), ("q2", "graph"), ("q3", "stale ledger"), ("q4", "semantic writer")]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = PRE + sql
        return f

    return add


_ASKED = ", asked(q, text) as (values " + ", ".join(str(x) for x in QUESTIONS) + ")"
_BM25 = """, d as (select id, regexp_extract_all(lower(concat_ws(' ', name, content, summary, array_to_string(tags, ' '))), '[a-z0-9_]+') as t from an),
p as (select term, id, count(*) as tf from (select id, unnest(t) as term from d) group by all), len as (select id, len(t) as dl from d),
st as (select count(*) as n, avg(dl) as avgdl from len), a as (select q, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) as term from asked),
df as (select term, count(*) as df from p group by term),
sc as (select q, p.id, round(sum(ln(1 + (n - df + .5) / (df + .5)) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * dl / avgdl))), 9) as score, count(*) as have from p join a using (term) join df using (term) join len on len.id = p.id, st group by q, p.id),
b as (select q, id, score from sc where have = (select count(*) from a where a.q = sc.q) qualify row_number() over (partition by q order by score desc, id) <= {k}),
bm as (select q, id, score, case when max(score) over (partition by q) > min(score) over (partition by q) then (score - min(score) over (partition by q)) / (max(score) over (partition by q) - min(score) over (partition by q)) else 1.0 end as norm from b)
"""


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "q string, text string")


@query(_ASKED + _BM25.format(k=20) + "select q, id, score, round(norm, 6) as norm from bm")
def retrieve_bm25(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d, is_active())
    docs = n.select("id", F.concat_ws(" ", "name", "content", "summary", F.array_join("tags", " ")).alias("text"))
    return r.bm25(docs, questions(spark)).withColumn("norm", F.round("norm", 6))


@query("""select a.vec_id as q, b.vec_id as id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a, embeddings b
where a.vec_id % 50 = 0 and list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= .3 qualify row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) desc, b.vec_id) <= 15""")
def retrieve_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    out = r.vector_search(e, e.where("id % 50 = 0").select(F.col("id").alias("q"), "v"))
    return out.withColumn("score", F.round("score", 6))


_TERMS = [(q, t) for q, text in QUESTIONS for t in r.query_terms(text)]
_GRAPH = ", tm(q, term) as (values " + ", ".join(str(x) for x in _TERMS) + """),
f as (select q, id, 1.0 as score from tm join an on an.name = tm.term union all select q, id, .9 from (select q, term, id, row_number() over (partition by q, term order by id) as r from tm join an on contains(lower(name), lower(term)) where length(term) >= 3) where r <= 5),
g as (select q, id, max(score) as score from (select * from f union all select f.q, an.id, .7 from f join (select from_id as a, to_id as b from ae union select to_id, from_id from ae) s on s.a = f.id join an on an.id = s.b) group by all),
gr as (select * from g qualify row_number() over (partition by q order by score desc, id) <= {k})
"""


@query(_GRAPH.format(k=20) + "select q, id, score::double as score from gr")
def retrieve_graph(spark: SparkSession, d: str) -> DataFrame:
    return r.graph_channel(nodes(spark, d), symmetric(edges(spark, d)), spark.createDataFrame(_TERMS, "q string, term string"))


def _with_vectors(spark: SparkSession, nodes_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions take the vector of the first node that one of their terms names, in lieu of a model; vectors of active nodes."""
    n = nodes_.where(F.forall("embedding", lambda x: ~F.isnan(x)) & (F.size("embedding") == 384))
    v = n.select("id", F.col("embedding").alias("v"))
    t = spark.createDataFrame(_TERMS, "q string, term string")
    hit = n.select("id", "name", F.col("embedding").alias("v")).join(F.broadcast(t), F.lower("name").contains(F.lower("term")))
    qv = hit.groupBy("q").agg(F.min_by("v", "id").alias("v"))
    q = questions(spark).join(t.groupBy("q").agg(F.collect_list("term").alias("terms")), "q").join(qv, "q", "left")
    return q, v


_HYBRID = _ASKED + _BM25.format(k=45) + _GRAPH.format(k=45) + """,
ev as (select id, name, embedding::double[] as v from an where len(embedding) = 384 and len(list_filter(embedding, lambda x: isnan(x))) = 0),
qv as (select q, min_by(v, id) as v from tm join ev on contains(lower(name), lower(term)) group by q),
vc as (select q, id, round(case when list_dot_product(ev.v, ev.v) = 0 or list_dot_product(qv.v, qv.v) = 0 then 0 else list_cosine_similarity(qv.v, ev.v) end, 9) as score from qv, ev),
vs as (select * from vc where score >= .3 qualify row_number() over (partition by q order by score desc, id) <= 45),
al as (select q, 'b' as ch, id, norm as score from bm union all select q, 'v', id, score from vs union all select q, 'g', id, score from gr),
fu as (select q, id, sum(1.0 / (60 + r)) as score from (select *, row_number() over (partition by q, ch order by score desc, id) as r from al) group by all)
select q, id, type, round(score * importance * confidence * case trust_tier when 1 then 1.0 when 2 then .9 when 3 then .7 else .5 end * case when type in ('Bug', 'Solution') then 1.3 else 1.0 end
+ case when package_path = 'packages/billing' then .15 else 0 end, 9)::double as final from fu join an using (id) qualify row_number() over (partition by q order by final desc, id) <= 15"""


@query(_HYBRID)
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    # six channels and joins read the nodes: they are made unique once
    cols = ["id", "name", "type", "content", "summary", "tags", "importance", "confidence", "trust_tier", "package_path", "embedding", "t_valid_until", "archived_at"]
    n = materialize(nodes(spark, d, is_active()).select(*cols), "active")
    q, v = _with_vectors(spark, n)
    return r.hybrid_search(n, symmetric(edges(spark, d)), q, v, task="bug-fix", package="packages/billing")


_LAST = _HYBRID.rindex("\nselect q, id, type")


@query(_HYBRID[:_LAST] + ", hy as (" + _HYBRID[_LAST:] + """), tx as (select hy.q, hy.id, final, created_by, session_id, trust_tier, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) as w,
list_distinct(regexp_extract_all(lower(concat_ws(' ', name, summary, content)), '[a-z0-9_]+')) as t from hy join an using (id) join asked on asked.q = hy.q)
select q, id, round(len(list_intersect(w, t)) / len(w), 9) as overlap, final, row_number() over (partition by q order by round(len(list_intersect(w, t)) / len(w), 9) desc, final desc, id) as r, created_by, session_id, trust_tier from tx qualify r <= 10""")
def search_second_stage(spark: SparkSession, d: str) -> DataFrame:
    return r.second_stage(hybrid_search(spark, d), nodes(spark, d, is_active()), questions(spark))


_WIDE = [("w1", "explain the architecture overview"), ("w2", "how does the function fix the bug"), ("w3", "structure of the modules")]


@query("select q, row_number() over (partition by q order by member_count desc, id) as r, id, level, member_count from (select * from communities where trim(summary) <> '' order by member_count desc, id limit 5), (values ('w1'), ('w3')) v(q)")
def search_global(spark: SparkSession, d: str) -> DataFrame:
    return r.answer_globally(_WIDE, nodes(spark, d, is_active()), table(spark, d, "communities"))


_QUOTED = [("s1", '"token session" AND'), ("s2", "stale: (ledger)")]


@query(", asked(q, text) as (values ('s1', 'token session'), ('s2', 'stale ledger'))" + _BM25.format(k=20) + "select q, id, score from bm")
def search_sanitized(spark: SparkSession, d: str) -> DataFrame:
    """Questions with quotes, operators and signs are asked as their words."""
    asked = spark.createDataFrame([(q, r.answer_terms(t)) for q, t in _QUOTED], "q string, text string")
    n = nodes(spark, d, is_active())
    return r.bm25(n.select("id", F.concat_ws(" ", "name", "content", "summary", F.array_join("tags", " ")).alias("text")), asked).select("q", "id", "score")


@query("select session_id, tool_name, event_id, n, case when n <= 3 then 'normal' when n <= 8 then 'reduced' else 'blocked' end as mode from (select *, row_number() over (partition by session_id, tool_name order by occurred_at, event_id) as n from h where session_id is not null and tool_name is not null)")
def search_throttle(spark: SparkSession, d: str) -> DataFrame:
    return r.throttle(events(spark, d))


@query("select type, id, used from (select type, id, sum(length(content)) over (partition by type order by importance desc, id rows unbounded preceding) as used from an) where used <= 8000")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d, is_active())
    return r.token_budget(n, "type", [F.desc("importance"), F.asc("id")], F.length("content"), 8000).select("type", "id", "used")


@query(f"select id, list_transform(range(0, 16), lambda i: round(case when i = 0 then -.1 * log2(1 + days) + .5 else sin(log2(1 + days) * .01 * pow(10.0, 3 * (i - 1) / 14.0)) end, 6)) as features from (select id, greatest(({T0} - created_at) / 86400000.0, 0)::double as days from an)")
def time_features(spark: SparkSession, d: str) -> DataFrame:
    days = (F.lit(T0) - F.col("created_at")) / F.lit(86_400_000.0)
    return nodes(spark, d, is_active()).select("id", F.transform(r.time_features(days), lambda x: F.round(x, 6)).alias("features"))


@query(f"""select an.id, case when f is null then 'unknown' when f <= created_at then 'fresh' when f - created_at <= {30 * 86_400_000} then 'stale' else 'rotten' end as state
from an left join (select id, max(f) as f from (select id, unnest(file_paths) as file from an) join (select file, max(last_accessed) as f from (select unnest(file_paths) as file, last_accessed from n) group by file) using (file) group by id) x using (id)""")
def freshness_notes(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    files = n.select(F.explode("file_paths").alias("file"), "last_accessed").groupBy("file").agg(F.max("last_accessed").alias("f"))
    a = n.where(is_active()).select("id", "created_at", "file_paths")
    newest = a.select("id", F.explode("file_paths").alias("file")).join(files, "file").groupBy("id").agg(F.max("f").alias("f"))
    return a.join(newest, "id", "left").select("id", r.freshness(F.col("created_at"), F.col("f")).alias("state"))
