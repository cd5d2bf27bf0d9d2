"""Queries of storage, valid time, joins and rollups, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import bitemporal as bt
from chronoloom.operators import relational as rel
from chronoloom.plans.sql import PRE
from chronoloom.sources.tables import edges, nodes, table

T0, SINCE, NOW = 1_757_000_000_000, 1_745_000_000_000, 1_780_000_000_000

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = PRE + sql
        return f

    return add


def members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "community_members").select("community_id", F.lower(F.trim("entity_id")).alias("entity_id"), "level").distinct()


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hook_events").dropDuplicates(["event_id"])


def hub(spark: SparkSession, d: str) -> DataFrame:
    """The node with most active edges into it."""
    e = edges(spark, d, bt.edge_is_active(), "to_id is not null")
    return e.groupBy(F.col("to_id").alias("id")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "id").limit(1).select("id")


@query("select id, type, name from an")
def scan_active(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d, bt.is_active()).select("id", "type", "name")


@query("select id, type, name, importance from n where id = (select min(id) from n)")
def scan_point(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "graph_nodes")
    least = n.agg(F.min("id")).first()[0]
    return n.where(F.col("id") == least).dropDuplicates(["id"]).select("id", "type", "name", "importance")


@query("select id, package_path, kind from an where package_path = 'packages/billing' or kind = 'CodeSymbol'")
def scan_scope(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d, bt.is_active() & ((F.col("package_path") == "packages/billing") | (F.col("kind") == "CodeSymbol"))).select("id", "package_path", "kind")


@query("select id, from_id, to_id, type from ae where type in ('calls', 'imports', 'solves') and (from_id in (from hub) or to_id in (from hub))")
def edges_of_node(spark: SparkSession, d: str) -> DataFrame:
    x = hub(spark, d).first()
    own = F.lit(False) if x is None else (F.col("from_id") == x[0]) | (F.col("to_id") == x[0])
    return edges(spark, d, bt.edge_is_active() & F.col("type").isin("calls", "imports", "solves") & own).select("id", "from_id", "to_id", "type")


@query("select session_id, event_id, hook_event_name from h where session_id is not null qualify row_number() over (partition by session_id order by occurred_at desc, event_id desc) <= 3")
def session_events(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).where("session_id is not null")
    return rel.top_k(e, ["session_id"], [F.desc("occurred_at"), F.desc("event_id")], 3).select("session_id", "event_id", "hook_event_name")


@query("select level, id, summary, member_count, row_number() over (partition by level order by member_count desc, id) as r from communities where summary is not null qualify r <= 3")
def community_scan(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "communities").where("summary is not null")
    return rel.top_k(c, ["level"], [F.desc("member_count"), F.asc("id")], 3).select("level", "id", "summary", "member_count", "r")


@query(f"select id, type, importance, count(*) over () as total from n where (t_valid_from is null or t_valid_from <= {T0}) and (t_valid_until is null or t_valid_until > {T0}) and archived_at is null order by importance desc, id limit 50")
def asof_nodes(spark: SparkSession, d: str) -> DataFrame:
    return bt.as_of(nodes(spark, d), T0, 50).select("id", "type", "importance", "total")


@query(f"select id, from_id, to_id from e where (t_valid_from is null or t_valid_from <= {T0}) and (t_valid_until is null or t_valid_until > {T0})")
def asof_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d, bt.valid_at(T0)).select("id", "from_id", "to_id")


@query(f"select id, t_valid_until from n where t_valid_until <= {T0}")
def superseded(spark: SparkSession, d: str) -> DataFrame:
    return bt.superseded_by(nodes(spark, d), T0).select("id", "t_valid_until")


@query(f"""select id, type, 'added' as change from n where t_created between {SINCE} and {T0} union all
select id, type, 'invalidated' from n where t_valid_until between {SINCE} and {T0} union all select id, type, 'archived' from n where archived_at between {SINCE} and {T0}""")
def compare_states(spark: SparkSession, d: str) -> DataFrame:
    return bt.compare_states(nodes(spark, d), SINCE, T0)


@query(f"select strftime(epoch_ms(created_at), '%Y-%m-%d') as day, type, count(*) as n from n where created_at between {SINCE} and {T0} group by all")
def history(spark: SparkSession, d: str) -> DataFrame:
    return bt.history_by_day(nodes(spark, d), SINCE, T0)


@query(f"""select type, count(*) as n, string_agg(case when r <= 5 then name end, ' | ' order by r) as names, coalesce(list_position(['Decision','Convention','Bug','Solution','Concept'], type) - 1, 5) as position
from (select *, row_number() over (partition by type order by importance desc, id) as r from an where created_at between {T0 - 30 * bt.DAY} and {T0}) group by type""")
def digest_monthly(spark: SparkSession, d: str) -> DataFrame:
    return bt.digest(nodes(spark, d), T0, "monthly")


@query(f"""select type, count(*) as n, string_agg(case when r <= 5 then name end, ' | ' order by r) as names, coalesce(list_position(['Decision','Convention','Bug','Solution','Concept'], type) - 1, 5) as position
from (select *, row_number() over (partition by type order by importance desc, id) as r from an where created_at between {T0 - 7 * bt.DAY} and {T0}) group by type""")
def digest_weekly(spark: SparkSession, d: str) -> DataFrame:
    return bt.digest(nodes(spark, d), T0, "weekly")


@query(f"select id, type, created_at from n where created_at between {SINCE} and {T0} order by created_at desc, id limit 100")
def history_newest(spark: SparkSession, d: str) -> DataFrame:
    return bt.history_list(nodes(spark, d), SINCE, T0).select("id", "type", "created_at")


@query(f"select id, weight, count(*) over () as total from e where (t_valid_from is null or t_valid_from <= {T0}) and (t_valid_until is null or t_valid_until > {T0}) order by weight desc, id limit 200")
def asof_edges_capped(spark: SparkSession, d: str) -> DataFrame:
    return bt.as_of_edges(edges(spark, d, bt.valid_at(T0)), T0, 200).select("id", "weight", "total")


@query("""select 'nodes' as name, count(*) as n from an union all select 'edges', count(*) from ae union all select 'communities', count(*) from communities union all select 'sessions', count(distinct session_id) from h union all
select 'latest update', max(updated_at) from communities union all select 'latest node', max(t_created) from n""")
def stats_totals(spark: SparkSession, d: str) -> DataFrame:
    sessions = events(spark, d).select("session_id").where("session_id is not null").distinct()
    counts = bt.totals({"nodes": nodes(spark, d, bt.is_active()), "edges": edges(spark, d, bt.edge_is_active()), "communities": table(spark, d, "communities"), "sessions": sessions})
    latest = table(spark, d, "communities").agg(F.max("updated_at").alias("n")).select(F.lit("latest update").alias("name"), "n")
    return counts.unionByName(latest).unionByName(nodes(spark, d).agg(F.max("t_created").alias("n")).select(F.lit("latest node").alias("name"), "n"))


@query("""select id, from_id, to_id from e where (from_id is null or from_id not in (select id from n where archived_at is not null and t_valid_until is null))
and (to_id is null or to_id not in (select id from n where archived_at is not null and t_valid_until is null))""")
def prune_edges(spark: SparkSession, d: str) -> DataFrame:
    return bt.prune_archived(nodes(spark, d), edges(spark, d), members(spark, d))[1].select("id", "from_id", "to_id")


@query(f"select id, 'archived' as reason from n where archived_at < {NOW - 90 * bt.DAY}")
def compaction(spark: SparkSession, d: str) -> DataFrame:
    return bt.compactable(nodes(spark, d), bt.degrees(edges(spark, d)), NOW)


@query("select conflict_group_id, count(*) as n, count(distinct type) as n_types, max(importance) as top from an where conflict_group_id is not null group by 1")
def conflict_groups(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d, bt.is_active() & F.col("conflict_group_id").isNotNull())
    return n.groupBy("conflict_group_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("type").alias("n_types"), F.max("importance").alias("top"))


@query(f"""select id, conflict_group_id, t_valid_until from (select id, case when conflict_group_id = g and id <> k then {NOW} else t_valid_until end as t_valid_until,
case when conflict_group_id = g then null else conflict_group_id end as conflict_group_id
from n, (select min(conflict_group_id) as g from n) , (select min(id) as k from n where conflict_group_id = (select min(conflict_group_id) from n)))""")
def conflict_resolved(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).select("id", "conflict_group_id", "t_valid_until", "t_expired")
    g = n.where("conflict_group_id is not null").groupBy("conflict_group_id").agg(F.min("id").alias("k")).orderBy("conflict_group_id").first()
    return bt.resolve_conflict(n, g[0] if g else "", g[1] if g else "", NOW).select("id", "conflict_group_id", "t_valid_until")


@query("select 'node' as what, type, count(*) as n from n where t_expired is null group by type union all select 'edge', type, count(*) from e where t_expired is null group by type")
def stats_by_type(spark: SparkSession, d: str) -> DataFrame:
    count = lambda df, what: df.where("t_expired is null").groupBy("type").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(what))
    return count(nodes(spark, d), "node").unionByName(count(edges(spark, d), "edge")).select("what", "type", "n")


@query("""select type, trust_tier, kind, count(*) as n, count(*) filter (t_valid_until is null and archived_at is null) as active, count(*) filter (archived_at is not null) as archived,
count(*) filter (t_valid_until is not null) as invalidated, min(created_at) as first, max(created_at) as last from n group by grouping sets ((type), (trust_tier), (kind), ())""")
def status_rollup(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return n.groupingSets([["type"], ["trust_tier"], ["kind"], []], "type", "trust_tier", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(bt.is_active()).alias("active"), F.count_if(F.col("archived_at").isNotNull()).alias("archived"),
        F.count_if(F.col("t_valid_until").isNotNull()).alias("invalidated"), F.min("created_at").alias("first"), F.max("created_at").alias("last"),
    )


@query("""select trust_tier, round(avg(confidence::decimal(12,6))::double, 2) as avg_confidence, count(*) filter (confidence > 0.7) as fresh, count(*) filter (confidence < 0.3) as rotten,
count(*) filter (confidence between 0.3 and 0.7) as stale, round(100.0 * count(*) filter (len(file_paths) > 0) / count(*), 1)::double as coverage from an group by trust_tier""")
def freshness_report(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("confidence")
    return nodes(spark, d, bt.is_active()).groupBy("trust_tier").agg(
        F.round(F.avg(c.cast("decimal(12,6)")).cast("double"), 2).alias("avg_confidence"), F.count_if(c > 0.7).alias("fresh"), F.count_if(c < 0.3).alias("rotten"),
        F.count_if(c.between(0.3, 0.7)).alias("stale"), F.round(100.0 * F.count_if(F.size("file_paths") > 0) / F.count(F.lit(1)), 1).cast("double").alias("coverage"),
    )


@query("select created_by, type, count(*) as n, max(created_at) as latest from an group by all")
def knowledge_map(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d, bt.is_active()).groupBy("created_by", "type").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("latest"))


@query("""select ae.to_id, ae.type as edge_type, count(*) as n, string_agg(case when r <= 5 then name end, ' | ' order by r) as sources from
(select ae.to_id, ae.type, an.name, row_number() over (partition by ae.to_id, ae.type order by an.importance desc, an.id, ae.id) as r from ae join an on an.id = ae.from_id where ae.to_id is not null) ae group by all""")
def backlinks_all(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return rel.backlinks(e, nodes(spark, d), e.select(F.col("to_id").alias("id")).where("id is not null").distinct())


@query("select community_id, row_number() over (partition by community_id order by importance desc, entity_id) as r, entity_id, name, importance from (select distinct community_id, entity_id from m) m join an on an.id = m.entity_id qualify r <= 5")
def community_leaders(spark: SparkSession, d: str) -> DataFrame:
    return rel.community_leaders(members(spark, d).select("community_id", "entity_id").distinct(), nodes(spark, d))


@query("select m.entity_id, c.id as community_id, c.level, coalesce(c.summary, c.package_path, c.id) as label from m join communities c on c.id = m.community_id")
def community_labels(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "communities").select(F.col("id").alias("community_id"), F.col("level").alias("l"), F.coalesce("summary", "package_path", "id").alias("label"))
    return members(spark, d).join(c, "community_id").select("entity_id", "community_id", F.col("l").alias("level"), "label")


@query("select an.id, an.importance, count(x.id) as degree from an left join ae x on x.from_id = an.id or x.to_id = an.id group by all")
def degree_table(spark: SparkSession, d: str) -> DataFrame:
    return rel.degree_table(nodes(spark, d), edges(spark, d))


@query("select a, count(distinct b) as neighbours from (select from_id as a, to_id as b from ae union all select to_id, from_id from ae) where a is not null and b is not null group by a")
def neighbour_counts(spark: SparkSession, d: str) -> DataFrame:
    return rel.symmetric(edges(spark, d)).groupBy("a").agg(F.countDistinct("b").alias("neighbours"))


@query("select id, from_id, to_id from ae where from_id in (select id from an where type = 'CodeEntity') and to_id in (select id from an where type = 'CodeEntity')")
def induced_code(spark: SparkSession, d: str) -> DataFrame:
    return rel.induced(edges(spark, d, bt.edge_is_active()), nodes(spark, d, bt.is_active() & (F.col("type") == "CodeEntity")).select("id")).select("id", "from_id", "to_id")


@query("""select id, from_id, to_id from ae where (from_id in (select id from an where type = 'CodeEntity') and to_id in (select id from an where type in ('Decision', 'Convention', 'Bug')))
or (to_id in (select id from an where type = 'CodeEntity') and from_id in (select id from an where type in ('Decision', 'Convention', 'Bug')))""")
def knowledge_to_code(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d, bt.is_active())
    e = rel.between(edges(spark, d, bt.edge_is_active()), n.where("type = 'CodeEntity'"), n.where(F.col("type").isin("Decision", "Convention", "Bug")))
    return e.select("id", "from_id", "to_id")


@query("""select f.file as src, t.file as dst, count(*) as n from ae join (select distinct id, unnest(file_paths) as file from an) f on f.id = ae.from_id
join (select distinct id, unnest(file_paths) as file from an) t on t.id = ae.to_id where f.file <> t.file group by all""")
def file_graph(spark: SparkSession, d: str) -> DataFrame:
    return rel.file_edges(edges(spark, d), nodes(spark, d))


@query("""select folder, count(distinct file) as n_files, count(distinct id) as n_nodes from (select id, file, array_to_string(parts[1:i], '/') as folder from
(select id, file, parts, unnest(range(1, len(parts))) as i from (select id, file, string_split(file, '/') as parts from (select id, unnest(file_paths) as file from an)))) group by folder""")
def folder_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rel.folder_rollup(nodes(spark, d))


@query("""select doc_id, name, an.id from (select distinct doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) as name from documents) w
join (select name, min(id) as id from an group by name) an using (name)""")
def doc_mentions(spark: SparkSession, d: str) -> DataFrame:
    return rel.mentions(table(spark, d, "documents"), nodes(spark, d))


RULES = [("Solution", "solves", "Bug"), ("CodeEntity", "calls", "CodeEntity"), ("CodeEntity", "imports", "CodeEntity"), ("Decision", "pertains_to", "CodeEntity"), ("Concept", "relates_to", "Concept")]


@query("""select e.id, a.type as source_type, e.type, b.type as target_type, coalesce(r.allowed, false) as allowed from e join n a on a.id = e.from_id join n b on b.id = e.to_id left join
(select *, true as allowed from (values """ + ", ".join(str(r) for r in RULES) + """) v(s, x, t)) r on r.s = a.type and r.x = e.type and r.t = b.type""")
def ontology_check(spark: SparkSession, d: str) -> DataFrame:
    return rel.allowed_triples(edges(spark, d), nodes(spark, d), spark.createDataFrame(RULES, "source_type string, edge_type string, target_type string"))


SHARING = [(None, None, "private"), (None, "Convention", "team"), ("packages/billing", None, "project"), ("packages/billing", "Bug", "private")]


@query("""select id, coalesce(min_by(visibility, case when w is not null and t is not null then 0 when w is not null then 1 when t is not null then 2 else 3 end), 'private') as visibility
from an left join (values (null, null, 'private'), (null, 'Convention', 'team'), ('packages/billing', null, 'project'), ('packages/billing', 'Bug', 'private')) r(w, t, visibility)
on (w is null or w = package_path) and (t is null or t = type) group by id""".replace("min_by(visibility", "min_by(r.visibility"))
def sharing_rules(spark: SparkSession, d: str) -> DataFrame:
    facts = nodes(spark, d, bt.is_active()).select("id", "type", F.col("package_path").alias("workspace"))
    return rel.applicable_rule(facts, spark.createDataFrame(SHARING, "workspace string, entity_type string, visibility string"))


@query("select distinct session_id, 'orphaned' as status from h where session_id is not null and session_id not in (select session_id from an where session_id is not null)")
def unprocessed_sessions(spark: SparkSession, d: str) -> DataFrame:
    done = nodes(spark, d, bt.is_active() & F.col("session_id").isNotNull()).select("session_id", F.lit("done").alias("status")).distinct()
    return rel.unprocessed_sessions(events(spark, d), done)


@query("select c.id, c.updated_at, max(s.t_created) as nearest_t_created from communities c left join (select m.community_id, n.t_created from m join n on n.id = m.entity_id) s on s.community_id = c.id and s.t_created <= c.updated_at group by all")
def asof_join(spark: SparkSession, d: str) -> DataFrame:
    born = members(spark, d).join(nodes(spark, d).select(F.col("id").alias("entity_id"), "t_created"), "entity_id").select(F.col("community_id").alias("id"), "t_created")
    return bt.nearest_before(table(spark, d, "communities").select("id", "updated_at"), born, "id", "updated_at", "t_created", "t_created")


@query("""select e.id, case when f.id is null and t.id is null then 'both' when f.id is null then 'from' else 'to' end as missing from e left join n f on f.id = e.from_id left join n t on t.id = e.to_id where f.id is null or t.id is null""")
def doctor_orphan_edges(spark: SparkSession, d: str) -> DataFrame:
    ids = nodes(spark, d).select("id", F.lit(True).alias("there"))
    e = edges(spark, d).join(ids.withColumnsRenamed({"id": "from_id", "there": "f"}), "from_id", "left").join(ids.withColumnsRenamed({"id": "to_id", "there": "t"}), "to_id", "left")
    missing = F.when(F.col("f").isNull() & F.col("t").isNull(), "both").when(F.col("f").isNull(), "from").when(F.col("t").isNull(), "to")
    return e.select("id", missing.alias("missing")).where("missing is not null")


@query("select id, name from an where trust_tier < 4 and (lower(name) like '%token%' or lower(content) like '%token%' or lower(summary) like '%token%' or lower(name) like '%graph%' or lower(content) like '%graph%' or lower(summary) like '%graph%') and (kind is null or kind not in ('Bug', 'Solution'))")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d, bt.is_active() & bt.trusted_only() & bt.any_keyword(["token", "graph"], ["name", "content", "summary"]) & bt.kind_not_in("Bug", "Solution")).select("id", "name")


@query("select id from an where len(list_filter(tags, lambda x: lower(x) like '%token%')) > 0 or list_contains(file_paths, (select min(f) from (select unnest(file_paths) as f from an)))")
def tag_or_file(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d, bt.is_active())
    least = n.select(F.explode("file_paths").alias("f")).agg(F.min("f")).first()[0]
    return n.where(bt.any_tag_like("token") | F.array_contains("file_paths", least or "")).select("id")


@query("select package_path, count(*) filter (type = 'Bug') as bugs, count(*) as recent, sum(coalesce(x.degree, 0)) as links, floor(.4 * least(20 * count(*) filter (type = 'Bug'), 100) + .35 * least(15 * count(*), 100) + .25 * least(5 * sum(coalesce(x.degree, 0)), 100) + .5) as risk, case when risk > 70 then 'HIGH' when risk >= 40 then 'MEDIUM' else 'LOW' end as band from an left join (select id, count(*) as degree from (select from_id as id from ae union all select to_id from ae) where id is not null group by id) x on x.id = an.id where package_path is not null group by package_path")
def qa_risk(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d, bt.is_active() & F.col("package_path").isNotNull()).join(bt.degrees(edges(spark, d)), "id", "left")
    g = n.groupBy("package_path").agg(F.count_if(F.col("type") == "Bug").alias("bugs"), F.count(F.lit(1)).alias("recent"), F.sum(F.coalesce("degree", F.lit(0))).alias("links"))
    part = lambda w, k, c: w * F.least(k * F.col(c), F.lit(100))
    risk = F.floor(part(0.4, 20, "bugs") + part(0.35, 15, "recent") + part(0.25, 5, "links") + 0.5)
    return g.withColumn("risk", risk.cast("double")).withColumn("band", F.when(F.col("risk") > 70, "HIGH").when(F.col("risk") >= 40, "MEDIUM").otherwise("LOW"))
