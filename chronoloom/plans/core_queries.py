"""Queries of the general data-processing operators, over whole tables, with the equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import orphans, rolling, snapshot_diff
from chronoloom.sources.tables import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs = orphans.graph_references(table(spark, d, "graph_edges"), table(spark, d, "community_members"), table(spark, d, "communities"))
    return orphans.orphan_references(refs, table(spark, d, "graph_nodes").select("id", "t_created", "archived_at"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "period", "field", "record_id", "ref_id").distinct()


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_diff.snapshot_changes(table(spark, d, "graph_snapshots"))


def p3_summary(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_diff.change_summary(snapshot_diff.snapshot_changes(table(spark, d, "graph_snapshots")))


def p6_rolling(spark: SparkSession, d: str) -> DataFrame:
    return rolling.rolling_costs(table(spark, d, "cost_entries"))


def p6_corrected(spark: SparkSession, d: str) -> DataFrame:
    """The same result from a stored tree of what came in within an hour, to which all later entries are corrections."""
    e = table(spark, d, "cost_entries")
    late = F.coalesce(F.unix_millis(F.col("received_at").cast("timestamp")) - rolling.tidy_millis(F.col("timestamp")) > 3_600_000, F.lit(True))
    first = e.where(~late)
    tree = rolling.StoredTree(rolling.daily_costs(first))
    tree.correct(rolling.corrections(first, e.where(late)))
    return rolling.cost_windows(tree.nodes().drop("shard"))


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p3_found, p3_summary, p6_rolling, p6_corrected)}

_ORPHANS = """
with n as (select lower(trim(id)) as ref_id, min(t_created) as p_created, min(archived_at) as p_archived from graph_nodes where id is not null group by 1),
c as (select id, max(updated_at) as ms from communities group by 1),
r as (
  select 'graph_edges' as table_name, 'from_id' as field, id as record_id, lower(trim(from_id)) as ref_id, t_created as ms from graph_edges
  union select 'graph_edges', 'to_id', id, lower(trim(to_id)), t_created from graph_edges
  union select 'community_members', 'entity_id', m.community_id, lower(trim(m.entity_id)), c.ms from community_members m left join c on c.id = m.community_id),
o as (select r.*, case when n.ref_id is null then 'missing' when p_created > ms then 'later' else 'archived' end as reason, strftime(to_timestamp(ms / 1000) at time zone 'UTC', '%Y-%m') as period
  from r left join n using (ref_id) where r.ref_id <> '' and (n.ref_id is null or p_created > ms or p_archived <= ms))
"""

ORACLE = {
    "p2_found": _ORPHANS + "select distinct table_name, period, field, record_id, ref_id from o",
    "p2_report": _ORPHANS + "select table_name, field, period, reason, count(*) as n_references, count(distinct ref_id) as n_keys from o group by all",
    "p6_rolling": """
with e0 as (select entry_id, coalesce(nullif(lower(trim(provider)), ''), '(none)') as provider,
    cast(floor((case when abs(timestamp) < 100000000000 then timestamp * 1000 else timestamp end) / 86400000) as bigint) as day,
    estimated_cost::decimal(38,9) as cost, input_tokens::bigint as tokens,
    row_number() over (partition by entry_id order by received_at desc) as rn from cost_entries),
e as (select * from e0 where rn = 1),
span as (select provider, min(day) as lo, max(day) as hi from e group by 1),
days as (select provider, unnest(range(lo, hi + 1)) as d from span),
daily as (select provider, day, sum(cost) as cost, count(cost) as n, sum(tokens) as tok, count(tokens) as tn, count(*) as calls from e group by 1, 2),
f as (select days.provider, days.d, coalesce(cost, 0) as cost, coalesce(n, 0) as n, coalesce(tok, 0) as tok, coalesce(tn, 0) as tn, coalesce(calls, 0) as calls
  from days left join daily on daily.provider = days.provider and daily.day = days.d),
w as (select provider, d,
  (sum(cost) over a)::double as c7, sum(n) over a as n7, sum(tok) over a as t7, sum(tn) over a as tn7, sum(calls) over a as k7,
  (sum(cost) over b)::double as c30, sum(n) over b as n30, sum(tok) over b as t30, sum(tn) over b as tn30, sum(calls) over b as k30
  from f window a as (partition by provider order by d rows between 6 preceding and current row), b as (partition by provider order by d rows between 29 preceding and current row))
select provider, date '1970-01-01' + d::int as day,
  c7 as cost_sum_7, case when n7 > 0 then c7 / n7 end as cost_avg_7, c7 / 7 as cost_per_day_7, t7::bigint as tokens_sum_7,
  case when tn7 > 0 then t7::double / tn7 end as tokens_avg_7, t7::double / 7 as tokens_per_day_7, k7::bigint as calls_7,
  c30 as cost_sum_30, case when n30 > 0 then c30 / n30 end as cost_avg_30, c30 / 30 as cost_per_day_30, t30::bigint as tokens_sum_30,
  case when tn30 > 0 then t30::double / tn30 end as tokens_avg_30, t30::double / 30 as tokens_per_day_30, k30::bigint as calls_30
from w""",
}
ORACLE["p6_corrected"] = ORACLE["p6_rolling"]
_RECORD = "list_sort(list_transform(list_filter(json_keys(x), lambda k: json_type(x, '$.\"' || k || '\"') <> 'NULL'), lambda k: k || '=' || case when json_type(x, '$.\"' || k || '\"') in ('UBIGINT', 'BIGINT', 'DOUBLE') then (json_extract(x, '$.\"' || k || '\"')::double)::varchar else json_extract(x, '$.\"' || k || '\"')::varchar end))"
_CHANGES = f"""
with s as (select repo_hash, timestamp, entities, edges from graph_snapshots where json_valid(entities) and json_valid(edges) qualify row_number() over (partition by repo_hash, timestamp order by snapshot_id) = 1),
t as (select *, lag(timestamp) over w as before, lead(timestamp) over w as after from s window w as (partition by repo_hash order by timestamp)),
r as (select repo_hash, timestamp, before, after, 'entity' as record_kind, unnest(from_json(entities, '["JSON"]')) as x from t union all
  select repo_hash, timestamp, before, after, 'edge', unnest(from_json(edges, '["JSON"]')) from t),
k as (select repo_hash, timestamp, any_value(before) as before, any_value(after) as after, record_kind, x->>'id' as record_id, list_sort(list(distinct {_RECORD})) as v from r where x->>'id' is not null group by all),
c as (select a.repo_hash, a.timestamp, a.record_kind, a.record_id, case when b.record_id is null then 'added' when a.v <> b.v then 'changed' end as change
  from k a left join k b on b.repo_hash = a.repo_hash and b.record_kind = a.record_kind and b.record_id = a.record_id and b.timestamp = a.before where a.before is not null
  union all select a.repo_hash, a.after, a.record_kind, a.record_id, 'removed' from k a left join k b on b.repo_hash = a.repo_hash and b.record_kind = a.record_kind and b.record_id = a.record_id and b.timestamp = a.after
  where a.after is not null and b.record_id is null)
"""
ORACLE["p3_found"] = _CHANGES + "select * from c where change is not null"
ORACLE["p3_summary"] = _CHANGES + "select repo_hash, timestamp, record_kind, change, count(*) as n_records from c where change is not null group by all"
