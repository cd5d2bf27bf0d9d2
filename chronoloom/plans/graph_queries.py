"""Queries of the graph operators, with their SQL where SQL can say it; the iterative ones are tested against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import graph
from chronoloom.operators.bitemporal import edge_is_active, is_active
from chronoloom.operators.components import connected_components
from chronoloom.operators.relational import degree_table, symmetric
from chronoloom.plans.sql import PRE
from chronoloom.plans.temporal_queries import members
from chronoloom.sources.tables import edges, nodes

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_SYM = PRE.replace("with n as", "with recursive n as") + ", sym as (select id, confidence, from_id as a, to_id as b from ae where from_id is not null and to_id is not null union all select id, confidence, to_id, from_id from ae where from_id is not null and to_id is not null), seed as (select min(from_id) as id from ae)\n"


def query(sql: str | None = None, pre: str = PRE):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = pre + sql
        return f

    return add


def seed(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d, edge_is_active()).agg(F.min("from_id").alias("id"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d, edge_is_active(), "from_id is not null and to_id is not null").select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), "type", "confidence")


_BFS = ", r(id, depth) as (select id, 0 from seed union select s.b, r.depth + 1 from r join {t} s on s.a = r.id where r.depth < {k}), best as (select id, min(depth) as depth from r group by id)\n"


@query(_BFS.format(t="sym", k=2) + "select id, depth from best order by depth, id limit 50", _SYM)
def graph_expand(spark: SparkSession, d: str) -> DataFrame:
    return graph.expand(symmetric(edges(spark, d)), seed(spark, d))[0].select("id", "depth")


@query(", cs as (select * from sym where confidence >= 0.5)" + _BFS.format(t="cs", k=3) + "select id, depth, case depth when 1 then 'WILL BREAK' when 2 then 'LIKELY AFFECTED' else 'MAY NEED TESTING' end as label from best where depth > 0", _SYM)
def graph_impact(spark: SparkSession, d: str) -> DataFrame:
    return graph.impact_layers(symmetric(edges(spark, d)), seed(spark, d)).select("id", "depth", "label")


@query(", ds as (select from_id as a, to_id as b from ae where from_id is not null and to_id is not null)" + _BFS.format(t="ds", k=120) + "select n.id, best.depth as distance from n left join best using (id)", _SYM)
def graph_shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    return graph.shortest_paths(pairs(spark, d), seed(spark, d), nodes(spark, d)).select("id", "distance")


#: Rounds of the registered PageRank; as long as they change more than the tolerance, SQL can say them one after another.
_ROUNDS = 20
_LINKS = """, l as materialized (select from_id as a, to_id as b from ae where type in ('calls', 'imports', 'inherits_from') and from_id in (select id from an) and to_id in (select id from an)),
o as materialized (select a, 1.0::double / count(*) as share from l group by a), c as materialized (select count(*)::double as n from an), p0 as materialized (select id, 1.0::double / n as score from an, c)"""
_STEP = """, p{j} as materialized (select p.id, 0.15::double / n + 0.85::double * (coalesce(i, 0) + lost / n) as score from p{i} p left join (select l.b as id, sum(score * share) as i from l join p{i} p on p.id = l.a join o on o.a = l.a group by l.b) x on x.id = p.id, c,
(select coalesce(sum(score), 0) as lost from p{i} p where id not in (select a from o)))"""


@query("".join(_STEP.format(i=i, j=i + 1) for i in range(_ROUNDS)) + f" select id, round(score, 12) as score from p{_ROUNDS}", PRE + _LINKS)
def graph_pagerank(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d).where(F.col("type").isin("calls", "imports", "inherits_from"))
    return graph.pagerank(p, nodes(spark, d, is_active()).select("id"), rounds=_ROUNDS).withColumn("score", F.round("score", 12))


@query(", r(id, x) as (select a, a from sym union select r.id, s.b from r join sym s on s.a = r.x) select id, min(x) as component from (select * from r union all select id, id from (select unnest([from_id, to_id]) as id from ae where from_id is not null and to_id is not null)) group by id", _SYM)
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    return connected_components(pairs(spark, d).select(F.col("a").alias("src"), F.col("b").alias("dst")))


@query()
def graph_betweenness(spark: SparkSession, d: str) -> DataFrame:
    """Over all sources."""
    p = symmetric(edges(spark, d, F.col("type").isin("inherits_from", "contradicts"))).select("a", "b")
    return graph.betweenness(p, p.select(F.col("a").alias("id")).distinct())


@query()
def graph_communities(spark: SparkSession, d: str) -> DataFrame:
    return graph.communities(graph.community_graph(edges(spark, d)))


@query("""select least(from_id, to_id) as a, greatest(from_id, to_id) as b, round(sum(weight * coalesce(k, 0.3)), 6) as w from ae left join
(values ('calls', 0.5), ('imports', 0.5), ('inherits_from', 0.5), ('contains', 0.5), ('depends_on', 0.5), ('co_occurrence', 0.3), ('cochange', 0.2), ('git-cochange', 0.2)) v(t, k) on v.t = ae.type
where from_id <> to_id group by all""")
def graph_weights(spark: SparkSession, d: str) -> DataFrame:
    return graph.community_graph(edges(spark, d)).withColumn("w", F.round("w", 6))


@query("""select round(within / t - kk / (4 * t * t), 8) as modularity from (select sum(k * k) as kk from (select c, sum(w) as k from (select fa as c, w from x union all select fb, w from x) group by c)), (select sum(w) as t, sum(case when fa = fb then w else 0 end) as within from x)""",
       PRE + ", g as (select least(from_id, to_id) as a, greatest(from_id, to_id) as b, sum(weight) as w from ae where from_id <> to_id group by all), x as (select g.w, p.type as fa, q.type as fb from g join n p on p.id = g.a join n q on q.id = g.b)\n")
def graph_modularity(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d, edge_is_active(), "from_id <> to_id")
    g = e.groupBy(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).agg(F.sum("weight").alias("w"))
    return graph.modularity(g, nodes(spark, d).select("id", F.col("type").alias("community"))).withColumn("modularity", F.round("modularity", 8))


@query("""select community_id, count(*) filter (inside) as internal, count(*) as incident, count(*) filter (inside)::double / count(*) as cohesion from
(select m.community_id, ae.id, count(distinct m.entity_id) = (case when from_id = to_id then 1 else 2 end) as inside from ae join (select distinct community_id, entity_id from m) m on m.entity_id = ae.from_id or m.entity_id = ae.to_id group by m.community_id, ae.id, from_id, to_id) group by community_id""")
def graph_cohesion(spark: SparkSession, d: str) -> DataFrame:
    return graph.cohesion(members(spark, d), edges(spark, d))


@query("""select community_id, string_agg(case when r <= 5 then concat_ws(': ', name, summary) end, '; ' order by r) as summary, sha256(count(*)::varchar || ':' || sum(('0x' || substr(md5(entity_id), 1, 15))::bigint)::hugeint::varchar) as summary_hash, count(*) as member_count
from (select m.community_id, m.entity_id, name, summary, row_number() over (partition by m.community_id order by importance desc, m.entity_id) as r from (select distinct community_id, entity_id from m) m join an on an.id = m.entity_id) group by community_id""")
def graph_summaries(spark: SparkSession, d: str) -> DataFrame:
    return graph.community_summaries(members(spark, d), nodes(spark, d))


@query(", marks as (select id from an order by access_count desc, id limit 25), r(landmark, id, distance) as (select id, id, 0 from marks union select r.landmark, s.b, r.distance + 1 from r join sym s on s.a = r.id where r.distance < 5) select landmark, id, min(distance) as distance from r group by all", _SYM)
def graph_landmarks(spark: SparkSession, d: str) -> DataFrame:
    return graph.landmarks(nodes(spark, d), symmetric(edges(spark, d)))


@query("""select id, name, round(least(1.0, (case when list_contains(tags, 'isExported') then .35 else 0 end) + (case when regexp_matches(name, '(?i)^(main|index)$') then .55 when regexp_matches(name, '^handle[A-Z]') then .4
when regexp_matches(name, '^on[A-Z]') then .35 when regexp_matches(name, '(?i)controller$') then .35 else 0 end) + (case when i + o > 0 and .2 * i / (i + o) > .01 then .2 * i / (i + o) else 0 end)
+ (case when k > 0 then least(.55, .35 + .15 * (k - 1)) else 0 end))::double, 9) as score from (select an.id, name, tags, coalesce(i, 0) as i, coalesce(o, 0) as o,
len(list_filter(tags, lambda t: lower(t) in ('route', 'handler', 'controller', 'endpoint', 'middleware'))) as k from an left join (select to_id as id, count(*) as i from ae where type = 'calls' group by 1) x on x.id = an.id
left join (select from_id as id, count(*) as o from ae where type = 'calls' group by 1) y on y.id = an.id where type = 'CodeEntity')""")
def graph_entry_points(spark: SparkSession, d: str) -> DataFrame:
    return graph.entry_point_scores(nodes(spark, d), edges(spark, d)).withColumn("score", F.round("score", 9))


@query()
def graph_processes(spark: SparkSession, d: str) -> DataFrame:
    # chains from the 20 best entry points; the test data has none above 0.5, from where on one counts by itself
    starts = graph.entry_point_scores(nodes(spark, d), edges(spark, d)).orderBy(F.desc("score"), "id").limit(20).select("id")
    calls = pairs(spark, d).where("type = 'calls'").select("a", "b", "confidence")
    return graph.trace_processes(calls, starts).select(F.array_join("path", ">").alias("path"))


@query(""", deg as (select id, count(distinct e) as degree from (select from_id as id, id as e from ae union all select to_id, id from ae) where id in (select id from an) group by id),
d0 as (select distinct an.id from an, unnest(file_paths) as t(f) where f in (select unnest(file_paths) from an) and f like 'packages/%' or f like 'core/%'),
s1 as (select distinct s.b as id from sym s where s.a in (select id from d0) and s.b not in (select id from d0)), d1 as (select s1.id, case when degree > 50 then 'maybe_dirty' else 'dirty' end as state from s1 left join deg using (id)),
s2 as (select distinct s.b as id from sym s where s.a in (select id from d1 where state = 'dirty') and s.b not in (select id from d0) and s.b not in (select id from d1)), d2 as (select s2.id, case when degree > 50 then 'maybe_dirty' else 'dirty' end as state from s2 left join deg using (id))
select id, 'dirty' as state, 0 as depth from d0 union all select id, state, 1 from d1 union all select id, state, 2 from d2""", _SYM)
def graph_dirty(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    changed = n.where(is_active()).select(F.explode("file_paths").alias("file")).where("file like 'packages/%' or file like 'core/%'").distinct()
    return graph.dirty_nodes(changed, n, symmetric(edges(spark, d)), degree_table(n, edges(spark, d)).select("id", "degree"))


@query("""select coalesce(o.name, x.name) as name, case when o.name is null then 'insert' when x.name is null then 'remove' when o.kind is distinct from x.kind then 'update' else 'move' end as change, coalesce(x.kind, o.kind) as kind, o.kind as was
from (select name, type as kind, package_path as parent, row_number() over (partition by name order by type, package_path nulls first) as i from n where t_created < 1750000000000) o
full join (select name, type as kind, package_path as parent, row_number() over (partition by name order by type, package_path nulls first) as i from n where t_valid_until is null) x on o.name = x.name and o.i = x.i
where o.name is null or x.name is null or o.kind is distinct from x.kind or o.parent is distinct from x.parent""")
def graph_tree_diff(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).select("name", F.col("type").alias("kind"), F.col("package_path").alias("parent"), "t_created", "t_valid_until")
    return graph.tree_diff(n.where("t_created < 1750000000000"), n.where("t_valid_until is null"))
