"""Queries of upkeep, sync, feedback and sessions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import maintenance as mt
from chronoloom.operators.bitemporal import DAY, is_active
from chronoloom.functions import text as tx
from chronoloom.plans.sql import PRE
from chronoloom.plans.temporal_queries import NOW, T0, events
from chronoloom.sources.tables import edges, nodes, table
from chronoloom.streaming import sessions as ss

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = PRE + sql
        return f

    return add


_W = "list_distinct(list_filter(regexp_split_to_array(coalesce({}, ''), '\\s+'), lambda x: x <> ''))"


def _jac(a: str, b: str) -> str:
    return f"(case when len({a}) = 0 or len({b}) = 0 then 0 else len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) end)"


@query(f"""select fact_id, case when match_id is null then 'ADD' when s > .8 then 'NOOP' when s >= .4 then 'UPDATE' else 'INVALIDATE' end as action, match_id, round(case when match_id is not null then s end, 6)::double as similarity from
(select f.id as fact_id, o.id as match_id, {_jac("a", "b")} as s from (select id, name, type, {_W.format("summary")} as a from n) f left join (select name, type, min(id) as id, min_by({_W.format("content")}, id) as b from an group by all) o using (name, type))""")
def upkeep_consolidate(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    facts = n.select(F.col("id").alias("fact_id"), "name", "type", F.col("summary").alias("content"))
    return mt.consolidate(facts, n).withColumn("similarity", F.round("similarity", 6))


_INJECTION = "least(1.0, " + " + ".join("case when regexp_matches(t, '" + p.replace("'", "''") + "') then .4 else 0 end" for _, p in tx.INJECTION) + " + case when len(w) > 0 and len(regexp_extract_all(t, '" + tx.IMPERATIVES.replace("'", "''") + "')) / len(w) > .15 then .3 else 0 end)"


@query(f"""select id, case when old then 'expired' when s > .3 or confidence < .75 then 'quarantined' else 'passed' end as status, case when old then null when s > .3 then 'pattern_injection' when confidence < .75 then 'low_confidence' end as reason from
(select *, created_at + 604800000 < 1757000000000 as old, {_INJECTION} as s from (select *, content as t, list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '') as w from n where trust_tier = 4))""")
def upkeep_staging(spark: SparkSession, d: str) -> DataFrame:
    return mt.promote(mt.stage(nodes(spark, d)), T0)


@query("""select from_id, to_id, type, weight from (select a.id as from_id, b.id as to_id,
case when a.type = 'Solution' and b.type = 'Bug' and .35 + .55 * o > greatest(case when a.package_path = b.package_path then .3 + .4 * o else 0 end, o) then 'solves' when a.type = 'Bug' and b.type = 'Solution' and .35 + .55 * o > greatest(case when a.package_path = b.package_path then .3 + .4 * o else 0 end, o) then 'solved_by' else 'relates_to' end as type,
round(greatest(case when a.package_path = b.package_path then .3 + .4 * o else 0 end, o, case when (a.type = 'Solution' and b.type = 'Bug') or (a.type = 'Bug' and b.type = 'Solution') then .35 + .55 * o else 0 end)::double, 9) as weight
from (select * from an where created_at > 1765000000000) a, lateral (select b.*, case when len(a.tags) = 0 or len(b.tags) = 0 then 0.0::double else len(list_intersect(a.tags, b.tags))::double / len(list_distinct(list_concat(a.tags, b.tags))) end as o from an b where b.id <> a.id) b where (len(a.tags) > 0 or a.type in ('Bug', 'Solution')) and (len(a.tags) > 0 or len(b.tags) > 0))
where weight >= .3 qualify row_number() over (partition by from_id order by weight desc, to_id) <= 5""")
def upkeep_edges(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return mt.infer_edges(n.where("created_at > 1765000000000"), n)


@query(f"""select id, round(greatest(base_importance * pow(.5, days / case type when 'Decision' then 90.0 when 'Convention' then 60.0 when 'Bug' then 45.0 when 'Solution' then 45.0 else 30.0 end) + least(.02 * edge_count, .3), .01, case when edge_count > 20 then .25 else 0 end)::double, 6) as importance,
round((case when trust_tier = 2 then 0.0 else base_confidence * exp(-ln(2.0) / case when trust_tier = 1 then 30.0 when trust_tier = 4 then 7.0 when type = 'Convention' then 21.0 when type in ('Bug', 'Solution') then 7.0 else 14.0 end * case when trust_tier = 1 then .5 when trust_tier = 4 then 3.0 when type in ('Bug', 'Solution') then 1.5 else 1.0 end * days) end)::double, 6) as confidence
from (select *, ({NOW} - last_accessed) / {DAY}.0::double as days from an)""")
def upkeep_decay(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d, is_active()).select("id", F.round(mt.importance_after(NOW), 6).alias("importance"), F.round(mt.confidence_after(NOW), 6).alias("confidence"))


@query(f"select id from an where importance < .05 and edge_count = 0 and last_accessed < {NOW - 90 * DAY}")
def upkeep_archive(spark: SparkSession, d: str) -> DataFrame:
    return mt.archivable(nodes(spark, d), NOW).select("id")


_DEPS = "(select source_path, node_id, min(dep_type) as dep_type from (select id as node_id, unnest(file_paths) as source_path, 'defines' as dep_type from an union all select e.from_id, f.source_path, 'pertains_to' from ae e join (select id, unnest(file_paths) as source_path from an) f on f.id = e.to_id where e.type = 'pertains_to') group by all)"


@query(f"select * from {_DEPS}")
def upkeep_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return mt.dependencies(nodes(spark, d), edges(spark, d))


@query(f"""select an.id, case when gone is null then 'fresh' when gone > 0 then 'rotten' when newest <= created_at then 'fresh' when newest - created_at <= 300000 then 'stale' else 'rotten' end as state from an left join
(select node_id as id, max(mtime) as newest, count(*) filter (mtime is null) as gone from {_DEPS} d left join (select f as source_path, max(created_at) as mtime from (select unnest(file_paths) as f, created_at from n where trust_tier < 4) group by f) m using (source_path) group by node_id) x using (id)""")
def upkeep_stale_reads(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    mtimes = n.where("trust_tier < 4").select(F.explode("file_paths").alias("source_path"), "created_at").groupBy("source_path").agg(F.max("created_at").alias("mtime"))
    return mt.stale_reads(n, mt.dependencies(n, edges(spark, d)), mtimes)


@query("select coalesce(o.path, x.path) as path, coalesce(o.name, x.name) as name, case when o.name is null then 'insert' when x.name is null then 'invalidate' when o.content is not distinct from x.content then 'keep' else 'replace' end as action from (select path, name, min(content) as content from (select unnest(file_paths) as path, * from n where t_created < 1757000000000) group by path, name) o full join (select path, name, min(content) as content from (select unnest(file_paths) as path, * from an) group by path, name) x on o.path = x.path and o.name = x.name")
def upkeep_file_changes(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).withColumn("path", F.explode("file_paths"))
    side = lambda df: df.groupBy("path", "name").agg(F.min("content").alias("content"))
    return mt.file_changes(side(n.where("t_created < 1757000000000")), side(n.where(is_active())))


@query(f"""select a, b, type, round(s, 6) as similarity, case when s > .92 then 'merged' else 'related' end as verdict from (select a.id as a, b.id as b, a.type, {_jac("a.w", "b.w")} as s
from (select id, type, {_W.format("content")} as w from an) a join (select id, type, {_W.format("content")} as w from an) b on a.type = b.type and a.id < b.id) where s > .5""")
def upkeep_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return mt.content_pairs(nodes(spark, d))


@query(f"select name as key, round(sum(importance * exp(-.01 * ({NOW} - created_at) / {DAY}.0::double)) / sum(exp(-.01 * ({NOW} - created_at) / {DAY}.0::double)), 6) as importance, max(trust_tier) as trust_tier, list_sort(list_distinct(flatten(list(tags)))) as tags from an group by name")
def sync_merge(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d, is_active()).withColumn("key", F.col("name"))
    return mt.merged_importance(n, NOW).withColumn("importance", F.round("importance", 6))


@query("""select id, (w << 16) | c as clock from (select id, case when c > 65535 then w + 1 else w end as w, case when c > 65535 then 0 else c end as c from (select id, w, case when w = l and w = r then greatest(lc, rc) + 1 when w = l then lc + 1 when w = r then rc + 1 else 0 end as c
from (select id, created_at as l, access_count % 65536 as lc, t_created as r, edge_count % 65536 as rc, greatest(created_at, t_created, 1745000000000) as w from n)))""")
def sync_clock(spark: SparkSession, d: str) -> DataFrame:
    local = mt.hlc_pack(F.col("created_at"), F.col("access_count") % 65536)
    remote = mt.hlc_pack(F.col("t_created"), F.col("edge_count") % 65536)
    return nodes(spark, d).select("id", mt.hlc_receive(local, remote, F.lit(1_745_000_000_000)).alias("clock"))


@query("select id, from_id, to_id from ae where from_id in (select id from an where visibility <> 'private') and to_id in (select id from an where visibility <> 'private')")
def sync_push_edges(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d, is_active()).withColumn("synced_at", F.lit(None).cast("long")).withColumn("hlc_modified", F.col("t_created"))
    from chronoloom.operators.bitemporal import edge_is_active
    from chronoloom.operators.relational import induced

    return induced(edges(spark, d, edge_is_active()), mt.to_push(n).select("id")).select("id", "from_id", "to_id")


@query("""select rank_position, count(*) as n, round((case rank_position when 0 then 1.0 when 1 then .85 when 2 then .7 when 3 then .55 when 4 then .4 when 5 then .25 else .15 end * 5 + count(*) filter (event_type in ('click', 'purchase'))) / (count(*) + 5)::double, 9) as p,
round(least(1 / greatest((case rank_position when 0 then 1.0 when 1 then .85 when 2 then .7 when 3 then .55 when 4 then .4 when 5 then .25 else .15 end * 5 + count(*) filter (event_type in ('click', 'purchase'))) / (count(*) + 5)::double, .01), 10.0), 6) as weight from (select user_id % 8 as rank_position, event_type from events) group by rank_position""")
def feedback_positions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("user_id") % 8).alias("rank_position"), F.when(F.col("event_type").isin("click", "purchase"), 1.0).otherwise(0.0).alias("signal_strength"))
    x = mt.examination(e)
    return x.select("rank_position", "n", F.round("p", 9).alias("p"), F.round(mt.ips_weight(F.col("p"), F.lit(False)), 6).alias("weight"))


@query("select list_transform(list(x order by i), lambda v: round(v, 6)) as centroid from (select i, avg(v[i]::double) as x from (select embedding as v, unnest(range(1, 65)) as i from embeddings) group by i)")
def upkeep_centroid(spark: SparkSession, d: str) -> DataFrame:
    c = mt.centroid(table(spark, d, "embeddings").select(F.col("embedding").alias("v")))
    return c.select(F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


@query("select session_id, count(*) as calls, sum(case when tool_name in ('Write', 'Edit') then 10 when tool_name = 'Bash' then 5 when tool_name = 'Read' then 2 when tool_name = 'Grep' then 3 else 4 end)::double / (10 * count(*)) as significance, arg_max(tool_name, (occurred_at, event_id)) as last_tool from h where session_id is not null and tool_name is not null group by session_id")
def session_state(spark: SparkSession, d: str) -> DataFrame:
    return ss.session_state(events(spark, d))


@query("""select session_id, count(*) as n, least(1.0, coalesce(avg(case when event_type = 'discomfort' then score end), 0)) as drift, case when least(1.0, coalesce(avg(case when event_type = 'discomfort' then score end), 0)) > .9 then 'block' when least(1.0, coalesce(avg(case when event_type = 'discomfort' then score end), 0)) > .75 then 'warn' else 'ok' end as level
from (select session_id, case when tool_name in ('Write', 'Edit') then 'discomfort' else 'other' end as event_type, case when tool_name = 'Write' then 1.0 else .5 end::double as score from h where session_id is not null qualify row_number() over (partition by session_id order by occurred_at desc, event_id desc) <= 20) group by session_id""".replace("count(*) as n, ", ""))
def session_drift(spark: SparkSession, d: str) -> DataFrame:
    h = events(spark, d).where("session_id is not null").select("session_id", "event_id", F.col("occurred_at").alias("created_at"), F.when(F.col("tool_name").isin("Write", "Edit"), "discomfort").otherwise("other").alias("event_type"), F.when(F.col("tool_name") == "Write", 1.0).otherwise(0.5).alias("score"))
    return ss.drift(h)


@query("""select session_id, span, min(us) as first_us, max(us) as last_us, count(*) as n from (select session_id, us, sum(case when us - prev > 3600000000 then 1 else 0 end) over (partition by session_id order by us, event_id) as span
from (select session_id, event_id, epoch_us(occurred_at) as us, lag(epoch_us(occurred_at)) over (partition by session_id order by occurred_at, event_id) as prev from h where session_id is not null)) group by all""")
def session_spans(spark: SparkSession, d: str) -> DataFrame:
    return ss.session_spans(events(spark, d))


@query("""select session_id, case when exists (select 1 from h o where o.cwd = f.cwd and o.session_id <> f.session_id and o.occurred_at >= f.at - interval 300 second and o.occurred_at < f.at) then 'subagent' else 'primary' end as kind
from (select session_id, arg_min(cwd, (occurred_at, event_id)) as cwd, min(occurred_at) as at from h where session_id is not null group by session_id) f""")
def session_kind(spark: SparkSession, d: str) -> DataFrame:
    return ss.concurrent(events(spark, d))


@query("select session_id, tool_name as kind, count(*) as n, max(length(tool_input)) as strongest, arg_max(occurred_at, (length(tool_input), occurred_at)) as strongest_at from h where session_id is not null and tool_name is not null and tool_input is not null group by all having count(*) >= 3")
def session_rollup(spark: SparkSession, d: str) -> DataFrame:
    s = events(spark, d).where("session_id is not null and tool_name is not null and tool_input is not null")
    return ss.signal_rollup(s.select("session_id", F.col("tool_name").alias("kind"), F.length("tool_input").cast("long").alias("intensity"), F.col("occurred_at").alias("at")))
