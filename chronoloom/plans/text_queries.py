"""Queries of the text functions over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions import tables as tf
from chronoloom.functions import text as tx
from chronoloom.plans.sql import PRE
from chronoloom.plans.temporal_queries import events
from chronoloom.sources.tables import nodes, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = PRE + sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "source", F.col("file_path").alias("path"))


def _case(rules: list[tuple[str, str]], c: str, otherwise: str = "null") -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    return "case " + " ".join(f"when regexp_matches({c}, {q(p)}) then {q(t)}" for t, p in rules) + f" else {otherwise} end"


def _sum(rules: list[tuple[str, float]], c: str) -> str:
    return " + ".join("case when regexp_matches({}, '{}') then {} else 0 end".format(c, p.replace("'", "''"), w) for p, w in rules)


@query("select doc_id as id, round(least(1.0, " + _sum([(p, 0.4) for _, p in tx.INJECTION], "t") + " + case when len(w) > 0 and len(regexp_extract_all(t, '" + tx.IMPERATIVES.replace("'", "''") + "')) / len(w) > .15 then .3 else 0 end)::double, 6) as score from (select doc_id, t, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '') as w from (select doc_id, coalesce(text, '') as t from documents))")
def text_injection(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("id", F.round(tx.injection_score(F.col("text")), 6).alias("score"))


@query("select pattern_id, " + _case(tx.TASKS, "lower(matched_line)", "'trivial'") + " as task, round(least(1.0, " + _sum(tx.APPROVAL, "matched_line") + ")::double, 6) as approval from detected_patterns qualify row_number() over (partition by pattern_id) = 1")
def text_tasks(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "detected_patterns").dropDuplicates(["pattern_id"])
    return p.select("pattern_id", tx.task_type(F.col("matched_line")).alias("task"), F.round(tx.approval_score(F.col("matched_line")), 6).alias("approval"))


@query("select id, line_no, type, content, confidence from (select pattern_id as id, 1 as line_no, trim(matched_line) as content from detected_patterns qualify row_number() over (partition by pattern_id) = 1) x, (values " + ", ".join("('{}', '{}', {})".format(t, p.replace("'", "''"), c) for t, p, c in tx.LINE_RULES) + ") r(type, p, confidence) where regexp_matches(content, p)")
def text_knowledge_lines(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "detected_patterns").dropDuplicates(["pattern_id"])
    return tf.knowledge_lines(p.select(F.col("pattern_id").alias("id"), F.col("matched_line").alias("text"))).select("id", "line_no", "type", "content", F.col("confidence").cast("double").alias("confidence"))


@query("select id, type, count(*) as n from (select doc_id as id, " + _case(tx.SENTENCE_TYPES, "s") + " as type from (select doc_id, trim(unnest(regexp_split_to_array(text, '\\. |\\n'))) as s from documents) where s <> '') where type is not null group by all")
def text_sentence_facts(spark: SparkSession, d: str) -> DataFrame:
    return tf.sentence_facts(docs(spark, d).select("id", "text")).groupBy("id", "type").agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id as id, unnest(regexp_extract_all(text, '\\[\\[([^\\]]+)\\]\\]', 1)) as link from documents")
def text_wikilinks(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("id", F.explode(tx.wikilinks(F.col("text"))).alias("link"))


@query("select id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(name), '[\\s_]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g') as slug, trim(regexp_replace(lower(trim(name)), '[^a-z0-9\\-_]+', ' ', 'g')) as normal, left(sha256(content), 16) as hash from n")
def text_names(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).select("id", tx.slug(F.col("name")).alias("slug"), tx.normal_name(F.col("name")).alias("normal"), tx.content_hash(F.col("content")).alias("hash"))


@query("select id, case when len(a) = 0 or len(b) = 0 then 0 else round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) end::double as j from (select id, list_distinct(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '')) as a, list_distinct(list_filter(regexp_split_to_array(summary, '\\s+'), lambda x: x <> '')) as b from n)")
def text_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).select("id", F.round(tx.word_jaccard(F.col("content"), F.col("summary")), 6).alias("j"))


@query("select id, url, " + _case(tx.SERVICES, "url") + " as service from (select event_id as id, unnest(regexp_extract_all(concat_ws(' ', tool_input, tool_response), 'https?://[^\\s)>\\]\"'']+')) as url from h)")
def text_links(spark: SparkSession, d: str) -> DataFrame:
    return tf.external_links(events(spark, d).select(F.col("event_id").alias("id"), F.concat_ws(" ", "tool_input", "tool_response").alias("text"))).select("id", "url", "service")


@query("select event_id, case when len(regexp_extract_all(coalesce(tool_response, ''), 'https?://([a-z0-9.]+)', 1)) > len(regexp_extract_all(coalesce(tool_response, ''), 'https?://(localhost|127\\.0\\.0\\.1)', 1)) then 4 when hook_event_name = 'Stop' then 1 when json_extract_string(tool_input, '$.file_path') is not null then 2 else 3 end as tier from h")
def text_payload_tier(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", tx.payload_tier(F.col("hook_event_name"), F.get_json_object("tool_input", "$.file_path"), F.col("tool_response")).alias("tier"))


@query("select doc_id as id, (len(string_split(text, chr(10))))::int as n_lines, len(regexp_replace(text, '[^' || chr(96) || ']', '', 'g'))::int as n_ticks from documents where text is not null")
def text_line_stats(spark: SparkSession, d: str) -> DataFrame:
    lines = tf.numbered_lines(docs(spark, d).select("id", "text"))
    return lines.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("n_lines"), F.sum(F.length(F.regexp_replace("line", "[^`]", ""))).cast("int").alias("n_ticks"))


@query()
def text_heading_chunks(spark: SparkSession, d: str) -> DataFrame:
    return tf.heading_chunks(docs(spark, d).select("id", "text")).select("id", "chunk", "heading", F.length("text").alias("size"))


@query()
def text_typed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return tf.typed_chunks(docs(spark, d).select("id", "text")).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).alias("longest"))


@query()
def text_front_matter(spark: SparkSession, d: str) -> DataFrame:
    return tf.front_matter(docs(spark, d).select("id", "text")).where(F.size("fields") > 0).select("id", F.to_json("fields").alias("fields"), F.length("body").alias("body"))


@query()
def text_symbols(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).select("id", F.explode("file_paths").alias("path"), F.col("content").alias("text"))
    return tf.symbols(n).distinct()


_P = "(select pattern_id, event_id, content, matched_line from detected_patterns qualify row_number() over (partition by pattern_id) = 1)"


@query(f"""select distinct event_id, id from (select id, list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(trim(p), '\\s+', ' ', 'g')), '[^a-z0-9-]+'), lambda w: length(w) >= 3 and w not in ('the', 'and', 'for', 'with', 'any', 'use', 'into', 'from', 'that', 'this'))) as k
from (select pattern_id as id, unnest(regexp_extract_all(content, '(?i)\\b(?:never|do not|don''t|must not|avoid)\\s+([^.\\n;]+)', 1)) as p from {_P}) where trim(p) <> '') r join {_P} c on len(k) >= 2 and len(list_filter(k, lambda x: contains(lower(matched_line), x))) = len(k)""")
def text_violations(spark: SparkSession, d: str) -> DataFrame:
    """Lines in which detected patterns were found, held against what the patterns forbid."""
    p = table(spark, d, "detected_patterns").dropDuplicates(["pattern_id"])
    rules = tf.prohibitions(p.select(F.col("pattern_id").alias("id"), F.col("content").alias("text")))
    return tf.violations(p.select("event_id", F.col("matched_line").alias("text")), rules)


@query("select id, kind from (select doc_id as id, case when c > 0 and p > 0 then case when c > 2 * p then 'code' when p > 2 * c then 'nl' else 'mixed' end when c > 0 then 'code' else 'nl' end as kind from (select doc_id, ("
    + _sum([(r, 1) for r in (r"\.[a-z]{1,4}$", r"\.[a-z]{1,4}\s", r"[a-z]+/[a-z]+", r"[a-z][A-Z][a-z]", r"[A-Z][a-z]+[A-Z][a-z]", r"\(.*\)", r"\{.*\}", r"import\s", r"require\s*\(", r"=>", r"[a-z]+_[a-z]+")], "t")
    + " + case when length(regexp_replace(t, '[a-zA-Z\\s]', '', 'g')) / greatest(length(t), 1) > .3 then 2 else 0 end) as c, ("
    + _sum([(r, 1) for r in (r"(?i)^(why|what|how|when|where|who|which|should|does|is|are|can|will|do)\s", r"\?$", r"(?i)\b(the|a|an|this|that|these|those)\s", r"(?i)\b(because|since|therefore|however|although)\b")], "t")
    + ") as p from (select pattern_id as doc_id, matched_line as t from detected_patterns qualify row_number() over (partition by pattern_id) = 1)))")
def text_content_kind(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "detected_patterns").dropDuplicates(["pattern_id"])
    return p.select(F.col("pattern_id").alias("id"), tx.content_kind(F.col("matched_line")).alias("kind"))


@query("select id, type, confidence, content from (select id, type, confidence::double as confidence, regexp_replace(line, p, '') as content, line, p from (select pattern_id as id, trim(split_part(matched_line, chr(10), 1)) as line from " + _P + ") x, (values " + ", ".join("('{}', '{}', {})".format(t, p.replace("'", "''"), c) for t, p, c in tx.COMMIT_RULES) + ") r(type, p, confidence)) where regexp_matches(line, p)")
def text_commits(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "detected_patterns").dropDuplicates(["pattern_id"])
    return tf.commit_facts(p.select(F.col("pattern_id").alias("id"), F.col("matched_line").alias("text"))).withColumn("confidence", F.col("confidence").cast("double"))


@query("""select * from (select doc_id as id, 'heading' as kind, unnest(regexp_extract_all(text, '(?m)^(#{1,6}[ \t]+[^\n]+)', 1)) as value from documents union all
select doc_id, 'code', unnest(regexp_extract_all(text, '(?s)```[A-Za-z]*\n(.*?)```', 1)) from documents union all select doc_id, 'link', unnest(regexp_extract_all(text, '\\[[^\\]\n]*\\]\\(([^)\\s]+)\\)', 1)) from documents) where not (kind = 'link' and regexp_matches(value, '^[a-z]+:'))""")
def text_markdown(spark: SparkSession, d: str) -> DataFrame:
    return tf.markdown_parts(docs(spark, d).select("id", "text"))
