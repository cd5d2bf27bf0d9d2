"""Repositories, documents, transcripts and manifests as tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions import tables as tf
from chronoloom.functions.text import slug, wikilinks

#: Kinds of documents in order of priority, by path; folders that hold none.
DOC_PATTERNS = [
    (1, r"(?i)(^|/)(AGENTS|CLAUDE|CONVENTIONS)\.md$"),
    (2, r"(?i)(^|/)(ARCHITECTURE|DESIGN)\.md$"),
    (3, r"(?i)(^|/)(adr|adrs|decisions)/[^/]+\.md$"),
    (4, r"(?i)(^|/)(README|CONTRIBUTING)(\.[\w-]+)?\.md$"),
    (5, r"(?i)(^|/)docs?/.+\.md$"),
    (6, r"(?i)(^|/)(CHANGELOG|ROADMAP|SECURITY)\.md$"),
]
SKIPPED_DIRS = r"(^|/)(node_modules|\.git|dist|build|target|vendor|__pycache__|\.venv)(/|$)"


def ignore_regex(patterns: list[str]) -> tuple[str, str]:
    """(ignored, kept again): lines of an ignore file as two regular expressions on relative paths. # starts a comment, ! takes back, a
    leading or inner / ties a pattern to the root, a final / means folders only, * stays within a name and ** doesn't."""
    parts: dict[bool, list[str]] = {False: [], True: []}
    for raw in patterns:
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        back, line = line.startswith("!"), line.lstrip("!")
        folder, body = line.endswith("/"), line.strip("/")
        out = re.escape(body).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        rooted = "/" in line.rstrip("/")
        parts[back].append(("^" if rooted else "(?:^|/)") + out + ("/" if folder else "(?:/|$)"))
    return "|".join(parts[False]) or r"(?!)", "|".join(parts[True]) or r"(?!)"


def not_ignored(path: Column, patterns: list[str]) -> Column:
    ignored, kept = ignore_regex(patterns)
    return ~path.rlike(ignored) | path.rlike(kept)


def scan_repository(spark: SparkSession, root: str, patterns: list[str] | None = None, endings: list[str] | None = None) -> DataFrame:
    """(path, mtime, size, text, hash) of the files below root: relative path, without ignored and skipped ones, of the given endings."""
    base = root.rstrip("/") + "/"
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    f = f.withColumn("rel", F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(base), ""))
    keep = ~F.col("rel").rlike(SKIPPED_DIRS) & not_ignored(F.col("rel"), patterns or [])
    if endings:
        keep = keep & F.lower(F.regexp_extract("rel", r"\.([A-Za-z0-9]+)$", 1)).isin(*[e.lower() for e in endings])
    rows = f.where(keep).select(F.col("rel").alias("path"), F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("text"))
    return rows.withColumn("hash", F.left(F.sha2("text", 256), F.lit(16)))


def discover_documents(files: DataFrame) -> DataFrame:
    """(path, priority): documents among files (path), at their best priority."""
    priority = reduce(lambda acc, p: F.when(F.col("path").rlike(p[1]), p[0]).otherwise(acc), reversed(DOC_PATTERNS), F.lit(None).cast("int"))
    depth = F.size(F.split("path", "/"))
    rows = files.where(~F.col("path").rlike(SKIPPED_DIRS) & (depth <= 6)).select("path", priority.alias("priority")).where("priority is not null")
    return rows.groupBy("path").agg(F.min("priority").alias("priority"))


def ingest_markdown(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of Markdown files (path, text): a FileNode per file and a ContentChunk per heading, tied by child_of. Ids are hashes of
    path and name, so that a file read again gives the same rows."""
    key = lambda *c: F.sha2(F.concat_ws("\x1f", *c), 256)
    body = tf.front_matter(files.select(F.col("path").alias("id"), "text"))
    chunks = tf.heading_chunks(body.select("id", F.col("body").alias("text")))
    file_nodes = body.select(key(F.col("id"), F.lit("")).alias("id"), F.lit("FileNode").alias("type"), F.col("id").alias("name"), F.col("body").alias("content"), F.array("id").alias("file_paths"))
    name = F.when(F.col("heading") == "", F.col("id")).otherwise(F.trim(F.regexp_replace("heading", "^#+ ", "")))
    parts = chunks.select(key(F.col("id"), name, F.col("chunk").cast("string")).alias("cid"), name.alias("name"), F.col("text").alias("content"), "id")
    chunk_nodes = parts.select(F.col("cid").alias("id"), F.lit("ContentChunk").alias("type"), "name", "content", F.array("id").alias("file_paths"))
    edges = parts.select(key(F.col("cid"), F.lit("child_of")).alias("id"), F.col("cid").alias("from_id"), key(F.col("id"), F.lit("")).alias("to_id"), F.lit("child_of").alias("type"))
    return file_nodes.unionByName(chunk_nodes), edges


def import_vault(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a vault of notes (path, text): a node per note, and an edge per [[link]] to a note of that slug; '- type: [[x]]' names
    the edge's type, else it is relates_to."""
    body = tf.front_matter(files.select(F.col("path").alias("id"), "text"))
    title = F.coalesce(F.try_element_at("fields", F.lit("name")), F.try_element_at("fields", F.lit("title")), F.regexp_replace(F.regexp_extract("id", r"([^/]+)$", 1), r"\.md$", ""))
    notes = body.select("id", title.alias("name"), F.coalesce(F.try_element_at("fields", F.lit("type")), F.lit("Concept")).alias("type"), F.col("body").alias("content")).withColumn("slug", slug(F.col("name")))
    lines = tf.numbered_lines(notes.select("id", F.col("content").alias("text")))
    links = lines.select("id", F.explode(wikilinks(F.col("line"))).alias("to"), F.regexp_extract("line", r"^\s*-\s*([\w-]+):\s*\[\[", 1).alias("t"))
    edges = links.withColumn("slug", slug(F.col("to"))).join(notes.groupBy("slug").agg(F.min("id").alias("to_id")), "slug")
    rows = edges.select(F.col("id").alias("from_id"), "to_id", F.when(F.col("t") != "", F.col("t")).otherwise("relates_to").alias("type")).where("from_id <> to_id").distinct()
    return notes.drop("slug"), rows


def vault_notes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, text): a Markdown note per active node, with front matter and a list of its links, in a folder per type."""
    names = nodes.select(F.col("id").alias("to_id"), F.col("name").alias("target"))
    links = edges.where("t_valid_until is null").join(names, "to_id").groupBy(F.col("from_id").alias("id")).agg(F.array_sort(F.collect_set(F.concat(F.lit("- "), "type", F.lit(": [["), "target", F.lit("]]")))).alias("links"))
    n = nodes.where("t_valid_until is null and archived_at is null").join(links, "id", "left")
    text = F.concat(
        F.lit("---\nid: "), "id", F.lit("\nname: "), "name", F.lit("\ntype: "), "type", F.lit("\n---\n\n# "), "name", F.lit("\n\n"), F.coalesce("content", F.lit("")), F.lit("\n"),
        F.when(F.size("links") > 0, F.concat(F.lit("\n## Links\n"), F.array_join("links", "\n"), F.lit("\n"))).otherwise(""),
    )
    return n.select(F.concat(F.lower("type"), F.lit("/"), slug(F.col("name")), F.lit("-"), F.left("id", F.lit(8)), F.lit(".md")).alias("path"), text.alias("text"))


def transcript_tail(lines: DataFrame, schema: str, last: int = 100) -> DataFrame:
    """The last lines of each transcript (path, line_no, value), parsed; lines that are no valid JSON are left out."""
    w = Window.partitionBy("path").orderBy(F.desc("line_no"))
    tail = lines.withColumn("r", F.row_number().over(w)).where(F.col("r") <= last)
    parsed = tail.withColumn("v", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.where("v._bad is null and v is not null").select("path", "line_no", "v.*").drop("_bad")


def manifest_links(files: DataFrame) -> DataFrame:
    """(path, kind, target): members and local dependencies that project manifests (path, text) name: Cargo members, go.mod replaces,
    pyproject paths, package.json workspaces, C includes and C# project references."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    grab = lambda k, when, p: F.when(when, F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(1)), lambda x: F.struct(F.lit(k).alias("kind"), x.alias("target"))))
    members = F.regexp_extract("text", r"(?s)members\s*=\s*\[(.*?)\]", 1)
    spaces = F.regexp_extract("text", r"""(?s)"workspaces"\s*:\s*(?:\{\s*"packages"\s*:\s*)?\[(.*?)\]""", 1)
    inner = lambda k, when, c: F.when(when, F.transform(F.regexp_extract_all(c, F.lit(r"""["']([^"']+)["']"""), F.lit(1)), lambda x: F.struct(F.lit(k).alias("kind"), x.alias("target"))))
    found = [
        inner("cargo_member", name == "Cargo.toml", members),
        inner("workspace", name == "package.json", spaces),
        grab("go_replace", name == "go.mod", r"(?m)^\s*(?:replace\s+)?\S+(?:\s+v\S+)?\s+=>\s+(\.\S+)"),
        grab("py_path", name == "pyproject.toml", r"""path\s*=\s*["']([^"']+)["']"""),
        grab("include", name.rlike(r"\.(c|h|cc|cpp|hpp)$"), r"""(?m)^\s*#\s*include\s+"([^"]+)\""""),
        grab("project_reference", name.rlike(r"\.csproj$"), r"""<ProjectReference\s+Include="([^"]+)\""""),
    ]
    empty = F.array().cast("array<struct<kind:string,target:string>>")
    return files.where("text is not null").select("path", F.inline(F.concat(*[F.coalesce(f, empty) for f in found])))


def api_contracts(files: DataFrame) -> DataFrame:
    """(path, format): files that hold an API contract, by name and content."""
    p, t = F.lower("path"), F.coalesce("text", F.lit(""))
    kind = (
        F.when(p.rlike(r"\.(ya?ml|json)$") & t.rlike(r"""(?m)^\s*["']?openapi["']?\s*:"""), "openapi").when(p.rlike(r"\.(ya?ml|json)$") & t.rlike(r"""(?m)^\s*["']?swagger["']?\s*:"""), "swagger")
        .when(p.rlike(r"\.(graphql|gql)$"), "graphql").when(p.rlike(r"\.proto$"), "grpc").when(p.rlike(r"\.avsc$"), "avro").when(p.rlike(r"\.thrift$"), "thrift")
        .when(p.rlike(r"\.(ya?ml|json)$") & t.rlike(r"""(?m)^\s*["']?asyncapi["']?\s*:"""), "asyncapi").when(p.rlike(r"\.wsdl$"), "wsdl")
    )
    return files.select("path", kind.alias("format")).where("format is not null")
