"""Queries of the write path and of the readers' views, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import conflicts as cf
from chronoloom.operators import knowledge as kn
from chronoloom.operators import maintenance as mt
from chronoloom.operators import writing as wr
from chronoloom.operators.bitemporal import edge_is_active, is_active
from chronoloom.operators.relational import degree_table, top_k
from chronoloom.plans.retrieval_queries import _ASKED, _BM25, QUESTIONS, questions
from chronoloom.plans.sql import PRE
from chronoloom.plans.temporal_queries import SINCE, T0, events, members
from chronoloom.sources.tables import as_utc, edges, nodes, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, pre: str = PRE):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = pre + sql
        return f

    return add


# ---- write path ---------------------------------------------------------------------------------------------------

_LOG = """, log as (select to_id as id, t_created as ms, case type when 'supersedes' then 'invalidate' when 'contradicts' then 'archive' when 'elaborates' then 'update' else 'touch' end as op,
  id as edge, case when type = 'elaborates' then 'edge ' || id end as summary, case when type = 'elaborates' then weight end as importance from ae where to_id is not null)
"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    """A change log read off the edges: one that elaborates rewrites its target's summary and importance, one that supersedes ends it."""
    e = edges(spark, d, edge_is_active(), "to_id is not null")
    op = F.when(F.col("type") == "supersedes", "invalidate").when(F.col("type") == "contradicts", "archive").when(F.col("type") == "elaborates", "update").otherwise("touch")
    news = F.col("type") == "elaborates"
    return e.select(
        F.col("to_id").alias("id"), F.col("t_created").alias("at"), F.col("id").alias("seq"), op.alias("op"), F.when(news, F.concat(F.lit("edge "), "id")).alias("summary"), F.when(news, F.col("weight")).alias("importance")
    )


@query("""select n.id, coalesce(u.summary, n.summary) as summary, coalesce(u.importance, n.importance) as importance, (n.access_count + coalesce(touches, 0))::bigint as access_count,
greatest(n.last_accessed, touched) as last_accessed, least(n.t_valid_until, ended) as t_valid_until, least(n.archived_at, archived) as archived_at
from n left join (select id, arg_max(summary, (ms, edge)) filter (op = 'update') as summary, arg_max(importance, (ms, edge)) filter (op = 'update') as importance, count(*) filter (op = 'touch') as touches, max(ms) filter (op = 'touch') as touched,
min(ms) filter (op = 'invalidate') as ended, min(ms) filter (op = 'archive') as archived from log group by id) u on u.id = n.id""", PRE + _LOG)
def write_node_states(spark: SparkSession, d: str) -> DataFrame:
    return wr.node_states(nodes(spark, d), _log(spark, d), ["summary", "importance"])


@query("select op, strftime(epoch_ms(ms), '%Y-%m-%d') as day, count(*) as n, count(distinct id) as n_ids from log group by all", PRE + _LOG)
def write_audit(spark: SparkSession, d: str) -> DataFrame:
    return wr.audit(_log(spark, d))


@query("""select e.id, e.from_id, e.to_id, e.type, least(e.t_valid_until, x.ms) as t_valid_until from e left join
(select from_id, to_id, min(t_created) as ms from e where type = 'supersedes' group by all) x on x.from_id = e.from_id and x.to_id = e.to_id and e.type <> 'supersedes'""")
def write_edge_states(spark: SparkSession, d: str) -> DataFrame:
    """An edge that supersedes ends the other edges between the same two nodes."""
    e = edges(spark, d)
    ends = e.where("type = 'supersedes'").groupBy("from_id", "to_id").agg(F.min("t_created").alias("at"))
    log = e.where("type <> 'supersedes'").join(ends, ["from_id", "to_id"]).select("id", F.lit("invalidate").alias("op"), "at", "from_id", "to_id", "type")
    return wr.edge_states(e, log)


@query()
def write_consolidate_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Detected patterns as candidates, named by their first word, by the time they were detected."""
    p = table(spark, d, "detected_patterns").dropDuplicates(["pattern_id"])
    facts = p.select(F.col("pattern_id").alias("fact_id"), F.col("detected_at").alias("at"), F.lower(F.element_at(F.split("content", " "), 1)).alias("name"), "type", "content")
    return wr.consolidate_in_order(facts, nodes(spark, d, is_active())).withColumn("similarity", F.round("similarity", 6))


@query("select path, max_by(package, length(package)) as package from (select distinct f as path from (select unnest(file_paths) as f from n)) left join (select distinct package_path as package from n where package_path is not null union select distinct split_part(f, '/', 1) || '/' || split_part(f, '/', 2) from (select unnest(file_paths) as f from an) where f like '%/%/%') on path = package or starts_with(path, package || '/') group by path")
def write_packages(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    files = n.select(F.explode("file_paths").alias("path"))
    two = F.substring_index("path", "/", 2)
    known = n.select(F.col("package_path").alias("package")).where("package is not null").unionByName(n.where(is_active()).select(F.explode("file_paths").alias("path")).where(F.size(F.split("path", "/")) > 2).select(two.alias("package")))
    return wr.nearest_package(files, known)


@query("select type, content, confidence, pattern_id from (select *, row_number() over (partition by type, content order by confidence desc, pattern_id) as r from (select * from detected_patterns qualify row_number() over (partition by pattern_id) = 1)) where r = 1")
def write_best_spans(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "detected_patterns").dropDuplicates(["pattern_id"])
    return wr.best_spans(p, ["type", "content"], "confidence", "pattern_id").select("type", "content", "confidence", "pattern_id")


@query("""select id, case when from_id is null or to_id is null then 'unverified' when from_id in (select id from an) and to_id in (select id from an) then 'kept' else 'ended' end as state from ae""")
def write_bridges(spark: SparkSession, d: str) -> DataFrame:
    return wr.live_bridges(edges(spark, d), nodes(spark, d))


# ---- readers' views -----------------------------------------------------------------------------------------------

_ASKED_FILES = ", asked as (select distinct json_extract_string(tool_input, '$.file_path') as path from h where tool_name = 'Read' and json_valid(tool_input) and json_extract_string(tool_input, '$.file_path') is not null union select distinct regexp_extract(f, '[^/]+$') as path from (select unnest(file_paths) as f from an)), fl as (select id, importance, unnest(list_distinct(file_paths)) as file from an)\n"


@query("""select path, id, how, r from (select *, row_number() over (partition by path order by importance desc, id) as r from (
select path, id, importance, 'exact' as how from asked join fl on file = path union
select path, id, importance, 'name' from (select * from asked where path not in (select file from fl)) join fl on file like '%/%' and starts_with(regexp_extract(file, '[^/]*$'), regexp_extract(path, '[^/]*$')) and length(regexp_extract(path, '[^/]*$')) > 1)) where r <= 10""", PRE + _ASKED_FILES)
def view_by_file(spark: SparkSession, d: str) -> DataFrame:
    h = events(spark, d).where("tool_name = 'Read'").select(F.get_json_object("tool_input", "$.file_path").alias("path")).where("path is not null")
    n = nodes(spark, d)
    names = n.where(is_active()).select(F.explode("file_paths").alias("file")).select(kn.file_name(F.col("file")).alias("path"))
    return kn.nodes_by_file(n, h.unionByName(names))


@query("select package_path, id, importance from (select *, row_number() over (partition by package_path order by importance desc, id) as r from an) where r <= 20 order by importance desc, id limit 20")
def view_workspace(spark: SparkSession, d: str) -> DataFrame:
    return kn.top_by_package(nodes(spark, d, is_active()), 20)


@query("select entity_id, r, id, level, member_count from (select entity_id, c.id, c.level, member_count, row_number() over (partition by entity_id order by member_count desc, c.id) as r from (select distinct community_id, entity_id from m) x join communities c on c.id = x.community_id where entity_id in (select id from an where type = 'Decision')) where r <= 3")
def view_communities(spark: SparkSession, d: str) -> DataFrame:
    asked = nodes(spark, d, is_active() & (F.col("type") == "Decision")).select(F.col("id").alias("entity_id"))
    return kn.communities_of(table(spark, d, "communities"), members(spark, d), asked)


def _docs(n: DataFrame) -> DataFrame:
    return n.select("id", F.concat_ws(" ", "name", "content", "summary", F.array_join("tags", " ")).alias("text"))


@query(_ASKED + _BM25.format(k=3) + """select q, b.id, b.r, coalesce(l, '') as edges from (select *, row_number() over (partition by q order by score desc, id) as r from bm) b left join
(select from_id, string_agg(type || ':' || to_id, ' ' order by r) as l from (select *, row_number() over (partition by from_id order by weight desc, id) as r from ae where to_id is not null) where r <= 3 group by from_id) x on x.from_id = b.id""")
def view_augment(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d, is_active())
    return kn.augment(_docs(n), n, edges(spark, d), questions(spark))


_PARTS = [*QUESTIONS, ("q5", "pac"), ("q6", "zzz")]


@query(_BM25.format(k=10) + """select q, id, 'words' as how from bm union all select q, id, 'part' from (select q, id, row_number() over (partition by q order by importance desc, id) as r
from asked join an on contains(lower(name), lower(text)) or contains(lower(content), lower(text)) where q not in (select q from bm)) where r <= 10""", PRE + ", asked(q, text) as (values " + ", ".join(map(str, _PARTS)) + ")")
def view_word_search(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d, is_active())
    return kn.word_search(_docs(n), n, spark.createDataFrame(_PARTS, "q string, text string"))


_REFS = """, code as (select id, unnest(file_paths) as file from an where type in ('CodeEntity', 'FileNode')), doc as (select id, t_created from an where type not in ('CodeEntity', 'FileNode', 'ContentChunk')), chunk as (select id from an where type = 'ContentChunk'),
refs as (select distinct doc.id as doc_id, file from doc join ae on ae.from_id = doc.id join code on code.id = ae.to_id union
  select distinct doc.id, file from doc join ae a on a.from_id = doc.id join chunk on chunk.id = a.to_id join ae b on b.from_id = chunk.id join code on code.id = b.to_id),
mt as (select file, max(last_accessed) as mtime from (select unnest(file_paths) as file, last_accessed from n) group by file)
"""


def _mtimes(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).select(F.explode("file_paths").alias("file"), "last_accessed").groupBy("file").agg(F.max("last_accessed").alias("mtime"))


@query("select doc_id, file from refs", PRE + _REFS)
def view_document_code(spark: SparkSession, d: str) -> DataFrame:
    return kn.document_code(nodes(spark, d), edges(spark, d))


@query("select doc_id, count(*) as n_files, max(mtime) as newest, (max(mtime) - any_value(t_created)) / 86400000.0::double as lag_days, (max(mtime) - any_value(t_created)) / 86400000.0::double > 90 as stale from refs join mt using (file) join doc on doc.id = doc_id group by doc_id", PRE + _REFS)
def view_document_staleness(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return kn.document_staleness(n, kn.document_code(n, edges(spark, d)), _mtimes(spark, d))


@query("select an.id, round(greatest(.01, any_value(an.confidence) - .1)::double, 9) as confidence from (select *, unnest(file_paths) as file from an where trust_tier = 1 and type in ('CodeEntity', 'Convention', 'Decision')) an join mt using (file) where mtime > t_created group by an.id", PRE + _REFS)
def view_validated(spark: SparkSession, d: str) -> DataFrame:
    return kn.validated(nodes(spark, d), _mtimes(spark, d)).withColumn("confidence", F.round("confidence", 9))


@query("""select id, case when g then 'invalidated' else 'confirmed' end as verdict, round((case when g then confidence else least(1.0, confidence + .05) end)::double, 9) as confidence from (select *, len(list_intersect(file_paths, (select list(file) from gone))) > 0 as g from an where trust_tier = 3 order by confidence, id limit 20)""",
       PRE + ", gone as (select distinct unnest(file_paths) as file from n where archived_at is not null)\n")
def view_doubtful(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    gone = n.where("archived_at is not null").select(F.explode("file_paths").alias("file"))
    return kn.doubtful_claims(n, gone).withColumn("confidence", F.round("confidence", 9))


@query("""select 'lvl' || level || ':' || scope_id as id, level, scope_id, len(list_filter(regexp_split_to_array(coalesce(t, ''), '\\s+'), lambda x: x <> '')) as token_count, sha256(coalesce(t, '')) as content_hash from
(select 0 as level, id as scope_id, content as t from an union all select 1, id, coalesce(case when trim(summary) <> '' then summary end, substr(content, 1, 240)) from an union all
select 2, id, coalesce(case when trim(summary) <> '' then summary end, 'Community ' || id || ' has no summary.') from communities)""")
def view_summary_tree(spark: SparkSession, d: str) -> DataFrame:
    return kn.summary_tree(nodes(spark, d), table(spark, d, "communities"))


@query(f"select count(*) as n_active, count(*) filter (t_created > {T0}) as n_new, count(*) >= 100 and count(*) filter (t_created > {T0}) > 20 as due from an")
def view_detection_due(spark: SparkSession, d: str) -> DataFrame:
    return kn.detection_due(nodes(spark, d, is_active()), T0)


@query("select community_id, case when count(distinct package_path) = 1 and count(package_path) = count(*) then min(package_path) end as package_path from (select distinct community_id, entity_id from m) x join an on an.id = x.entity_id group by community_id")
def view_dominant_package(spark: SparkSession, d: str) -> DataFrame:
    return kn.dominant_package(members(spark, d), nodes(spark, d, is_active()))


@query("""select type, id, used from (select type, id, sum(length('{"id":"' || id || '","name":"' || name || '"}')) over (partition by type order by importance desc, id rows unbounded preceding) as used from an) where used <= 8000""")
def view_json_budget(spark: SparkSession, d: str) -> DataFrame:
    return kn.within_json_budget(nodes(spark, d, is_active()), "type", [F.desc("importance"), F.asc("id")], ["id", "name"]).select("type", "id", "used")


@query("select type, id, name from (select *, row_number() over (partition by type order by created_at desc, id) as r from an) where (type = 'Decision' and r <= 5) or type = 'Convention' or (type = 'Bug' and r <= 3)")
def view_session_context(spark: SparkSession, d: str) -> DataFrame:
    return kn.session_context(nodes(spark, d), {"Decision": 5, "Convention": None, "Bug": 3})


@query("select id, trust_tier, access_count from an where trust_tier <= 2 and access_count <= 3 and (kind is null or kind not in ('Signal', 'Episode')) and (contains(lower(name), 'token') or contains(lower(summary), 'token')) order by trust_tier, access_count, id limit 20")
def view_unexplored(spark: SparkSession, d: str) -> DataFrame:
    return kn.unexplored(nodes(spark, d), 20, ("Signal", "Episode"), "token")


@query("""select session_id, n_calls, coalesce(n_nodes, 0) as n_nodes, first_at, last_at, 'Session ' || session_id || ': ' || n_calls || ' tool calls, ' || coalesce(n_nodes, 0) || ' signals' as summary
from (select session_id, count(tool_name) as n_calls, epoch_us(min(occurred_at)) as first_at, epoch_us(max(occurred_at)) as last_at from h where session_id is not null group by session_id) left join (select session_id, count(*) as n_nodes from n group by session_id) using (session_id)""")
def view_episodes(spark: SparkSession, d: str) -> DataFrame:
    e = kn.episodes(as_utc(events(spark, d)), nodes(spark, d))
    return e.withColumns({c: F.unix_micros(c) for c in ("first_at", "last_at")})


@query("""select cwd, epoch_us(min(occurred_at)) as first_at, epoch_us(max(occurred_at)) as last_at, count(*) as n from (select *, sum(case when prev is null or occurred_at - prev >= interval 10 minute then 1 else 0 end) over (partition by cwd order by occurred_at, event_id) as burst
from (select *, lag(occurred_at) over (partition by cwd order by occurred_at, event_id) as prev from h where cwd is not null)) group by cwd, burst""")
def view_bursts(spark: SparkSession, d: str) -> DataFrame:
    b = kn.debounced(as_utc(events(spark, d)), "cwd", "occurred_at", "10 minutes")
    return b.withColumns({c: F.unix_micros(c) for c in ("first_at", "last_at")})


@query(f"""select type, count(*) as n, count(*) / (select count(*) from p) as share, string_agg(name || ' (' || strftime(epoch_ms(created_at), '%Y-%m-%d') || ')', ', ' order by r) filter (r <= 5) as latest
from (select *, row_number() over (partition by type order by created_at desc, id) as r from p) group by type""", PRE + f", p as (select * from n where created_at between {SINCE} and {T0})\n")
def view_sprint(spark: SparkSession, d: str) -> DataFrame:
    return kn.sprint_report(nodes(spark, d), SINCE, T0)


@query("select id, concat_ws(',', case when coalesce(trim(summary), '') = '' then 'summary' end, case when coalesce(trim(package_path), '') = '' then 'package_path' end, case when coalesce(trim(kind), '') = '' then 'kind' end) as missing from n where coalesce(trim(summary), '') = '' or coalesce(trim(package_path), '') = '' or coalesce(trim(kind), '') = ''")
def view_missing_fields(spark: SparkSession, d: str) -> DataFrame:
    return kn.missing_fields(nodes(spark, d), "id", ["summary", "package_path", "kind"])


@query("select id, from_id, to_id, type from ae where from_id in (select id from few) and to_id in (select id from few)",
       PRE + ", few as (select an.id from an left join (select id, count(distinct e) as degree from (select from_id as id, id as e from ae union all select to_id, id from ae) group by id) g on g.id = an.id order by importance desc, coalesce(degree, 0) desc, an.id limit 200)\n")
def view_subgraph(spark: SparkSession, d: str) -> DataFrame:
    n, e = nodes(spark, d, is_active()), edges(spark, d)
    return kn.subgraph(n, degree_table(n, e), e, 200)[1]


_SETS = ", w as (select id, type, session_id, conflict_group_id, list_distinct(list_filter(regexp_split_to_array(coalesce(content, ''), '\\s+'), lambda x: x <> '')) as w from an)\n"
_PAIRS = """(select a.id as a, b.id as b, a.type, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) as s, a.session_id is not null or b.session_id is not null as own, coalesce(a.conflict_group_id = b.conflict_group_id, false) as logged
from w a join w b on a.type = b.type and a.id < b.id where len(a.w) > 0 and len(b.w) > 0 and len(a.w) < 2 * len(b.w) and len(b.w) < 2 * len(a.w)) where s > .5"""


@query("select a, b, type, round(s, 6) as similarity, case when s > .92 then 'merged' else 'related' end as verdict from " + _PAIRS + " and own and not logged", PRE + _SETS)
def view_session_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Like pairs with a node of a session, without those that a conflict group already has."""
    n = nodes(spark, d, is_active())
    own = n.where("session_id is not null").select(F.col("id").alias("x")).distinct()
    pairs = mt.content_pairs(n)
    hit = pairs.join(own.withColumnRenamed("x", "a"), "a", "left_semi").unionByName(pairs.join(own.withColumnRenamed("x", "b"), "b", "left_semi")).distinct()
    group = n.where("conflict_group_id is not null").select("id", "conflict_group_id")
    log = hit.join(group.withColumnsRenamed({"id": "a", "conflict_group_id": "g"}), "a").join(group.withColumnsRenamed({"id": "b", "conflict_group_id": "h"}), "b").where("g = h").select("a", "b")
    return kn.unlogged(hit, log).select("a", "b", "type", "similarity", "verdict")


@query("select snapshot_id, case when json_valid(entities) and json_type(entities) = 'ARRAY' then json_array_length(entities) else 0 end::int as n_entities, case when json_valid(edges) and json_type(edges) = 'ARRAY' then json_array_length(edges) else 0 end::int as n_edges from (select * from graph_snapshots qualify row_number() over (partition by snapshot_id) = 1)")
def view_snapshot_sizes(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "graph_snapshots").dropDuplicates(["snapshot_id"])
    return kn.json_lengths(s, "snapshot_id", ["entities", "edges"])


@query("select type, id, created_at from (select *, row_number() over (partition by type order by created_at, id) as r from n where trust_tier = 4 and created_at + 604800000 >= " + str(T0) + ") where r <= 50")
def view_staged(spark: SparkSession, d: str) -> DataFrame:
    """Of each type the 50 external facts that wait longest and have not expired."""
    staged = mt.stage(nodes(spark, d, "trust_tier = 4")).where(F.col("expires_at") >= T0)
    return top_k(staged, ["proposed_type"], [F.asc("created_at"), F.asc("id")], 50).select(F.col("proposed_type").alias("type"), "id", "created_at")


# ---- sync ---------------------------------------------------------------------------------------------------------

_CONFLICTS = _SETS + """, cp as (select a, b from """ + _PAIRS.replace("s > .5", "s > .95") + """ and (select content from an where id = a) <> (select content from an where id = b)),
ln as (select 'n:' || a as x, 'n:' || b as y from cp union select 'n:' || id, 'g:' || conflict_group_id from an where conflict_group_id is not null), sy as (select x, y from ln union select y, x from ln),
cl(id, x) as (select x, x from sy union select cl.id, sy.y from cl join sy on sy.x = cl.x)
"""


@query("select substr(id, 3) as id, substr(min(x), 3) as group_id from cl where id like 'n:%' group by id", PRE.replace("with n as", "with recursive n as") + _CONFLICTS)
def sync_conflicts(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d, is_active())
    return cf.conflict_groups(n, cf.conflict_pairs(n))


_NAME = "list_aggregate(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda w: w <> ''))), 'string_agg', ' ')"


@query(f"select distinct l.id, p.id as peer_id, 'merged' as verdict from (select *, {_NAME} as w from an where created_by = 'local') l join (select *, {_NAME} as w from an where created_by <> 'local') p on l.type = p.type and l.w = p.w where l.w <> '' and l.id <> p.id")
def sync_peers(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d, is_active())
    return cf.peer_matches(n.where("created_by = 'local'"), n.where("created_by <> 'local'"))


@query("""select name, type, arg_max(id, (clock, own, id)) as id, max(clock) as clock from (select name, type, id, t_created as clock, 1 as own from an where created_by = 'local' union all
select name, type, id, last_accessed, 0 from an where created_by <> 'local' and visibility <> 'private') group by name, type""")
def sync_pull(spark: SparkSession, d: str) -> DataFrame:
    """Of each name and type the latest node: local ones by their creation, peers' by their last use."""
    n = nodes(spark, d, is_active()).select("id", "name", "type", "visibility", "created_by", "t_created", "last_accessed")
    first = lambda df, c: df.withColumn("clock", F.col(c)).groupBy("name", "type").agg(F.max(F.struct("clock", "id", "visibility")).alias("b")).select("name", "type", "b.*")
    mine = first(n.where("created_by = 'local'"), "t_created")
    theirs = first(n.where("created_by <> 'local' and visibility <> 'private'"), "last_accessed")
    return cf.pulled(mine, theirs, ["name", "type"], "clock").select("name", "type", "id", "clock")
