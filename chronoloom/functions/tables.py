"""Table functions on texts: one row in, many rows out. What built-in expressions can say stays in the JVM; only splitting that
depends on what came before (fences, sizes) runs in Python, on whole Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.text import COMMIT_RULES, LINE_RULES, SENTENCE_TYPES, first_match, service_of

LINE_CHUNK = 2048


def numbered_lines(docs: DataFrame) -> DataFrame:
    """(id, line_no, line) of docs (id, text), lines counted from 1."""
    return docs.where("text is not null").select("id", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("id", (F.col("p") + 1).alias("line_no"), "line")


def knowledge_lines(docs: DataFrame) -> DataFrame:
    """(id, line_no, type, content, confidence): every rule that a line meets."""
    rules = F.array(*[F.when(F.col("line").rlike(p), F.struct(F.lit(t).alias("type"), F.lit(c).alias("confidence"), F.lit(i).alias("rule"))) for i, (t, p, c) in enumerate(LINE_RULES)])
    rows = numbered_lines(docs).withColumn("line", F.trim("line")).where("line <> ''")
    return rows.select("id", "line_no", F.col("line").alias("content"), F.inline(F.array_compact(rules)))


def sentence_facts(docs: DataFrame) -> DataFrame:
    """(id, type, name, summary, content): sentences that tell a decision, bug, convention or solution; the first kind counts."""
    s = docs.where("text is not null").select("id", F.explode(F.split("text", r"\. |\n")).alias("s")).withColumn("s", F.trim("s")).where("s <> ''")
    rows = s.withColumn("type", first_match(F.col("s"), SENTENCE_TYPES)).where("type is not null")
    return rows.select("id", "type", F.substring("s", 1, 50).alias("name"), F.substring("s", 1, 80).alias("summary"), F.col("s").alias("content"))


def external_links(docs: DataFrame) -> DataFrame:
    """(id, line_no, url, service?): links per line; service is null for those of no known service."""
    urls = numbered_lines(docs).select("id", "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"""(https?://[^\s)>\]"']+)"""), F.lit(1))).alias("url"))
    return urls.withColumn("service", service_of(F.col("url")))


def sql_objects(docs: DataFrame) -> DataFrame:
    """(id, kind, name) of tables and indexes created in SQL texts."""
    t = F.transform(F.regexp_extract_all("text", F.lit(r"(?i)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)"), F.lit(1)), lambda x: F.struct(F.lit("table").alias("kind"), x.alias("name")))
    i = F.transform(F.regexp_extract_all("text", F.lit(r"(?i)CREATE\s+(?:UNIQUE\s+)?INDEX\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)"), F.lit(1)), lambda x: F.struct(F.lit("index").alias("kind"), x.alias("name")))
    return docs.where("text is not null").select("id", F.inline(F.concat(t, i)))


def prisma_objects(docs: DataFrame) -> DataFrame:
    """(id, kind, name) of models and enums in Prisma schemas."""
    kind = lambda k: F.transform(F.regexp_extract_all("text", F.lit(rf"(?m)^\s*{k}\s+(\w+)\s*\{{"), F.lit(1)), lambda x: F.struct(F.lit(k).alias("kind"), x.alias("name")))
    return docs.where("text is not null").select("id", F.inline(F.concat(kind("model"), kind("enum"))))


#: Patterns by language family: how a function, a class, an import and an export look. Group 1 is the name.
SYMBOLS = {
    "script": {"function": r"\bfunction\s*\*?\s+([A-Za-z_$][\w$]*)", "class": r"\bclass\s+([A-Za-z_$][\w$]*)", "import": r"""\bfrom\s+["']([^"']+)["']""", "export": r"\bexport\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|interface|type)\s+([A-Za-z_$][\w$]*)"},
    "python": {"function": r"(?m)^\s*(?:async\s+)?def\s+(\w+)", "class": r"(?m)^\s*class\s+(\w+)", "import": r"(?m)^\s*(?:from|import)\s+([\w.]+)", "export": r"(?m)^__all__\s*=\s*\[([^\]]*)\]"},
    "rust": {"function": r"\bfn\s+(\w+)", "class": r"\b(?:struct|enum|trait)\s+(\w+)", "import": r"\buse\s+([\w:]+)", "export": r"\bpub\s+(?:fn|struct|enum|trait)\s+(\w+)"},
    "go": {"function": r"\bfunc\s+(?:\([^)]*\)\s*)?(\w+)", "class": r"\btype\s+(\w+)\s+(?:struct|interface)", "import": r"""(?m)^\s*(?:import\s+)?"([\w./-]+)"$""", "export": r"\bfunc\s+(?:\([^)]*\)\s*)?([A-Z]\w*)"},
    "java": {"function": r"\b(?:public|private|protected)\s+(?:static\s+)?[\w<>\[\]]+\s+(\w+)\s*\(", "class": r"\b(?:class|interface|enum|record)\s+(\w+)", "import": r"\bimport\s+(?:static\s+)?([\w.]+)", "export": r"\bpublic\s+(?:class|interface|enum|record)\s+(\w+)"},
    "kotlin": {"function": r"\bfun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)", "class": r"\b(?:class|interface|object)\s+(\w+)", "import": r"(?m)^\s*import\s+([\w.]+)"},
    "swift": {"function": r"\bfunc\s+(\w+)", "class": r"\b(?:class|struct|enum|protocol|actor)\s+(\w+)", "import": r"(?m)^\s*import\s+(\w+)"},
    "php": {"function": r"\bfunction\s+&?(\w+)", "class": r"\b(?:class|interface|trait|enum)\s+(\w+)", "import": r"(?m)^\s*use\s+([\w\\]+)"},
    "ruby": {"function": r"\bdef\s+(?:self\.)?(\w+[?!]?)", "class": r"(?m)^\s*(?:class|module)\s+([\w:]+)", "import": r"""\brequire(?:_relative)?\s+["']([^"']+)["']"""},
    "scala": {"function": r"\bdef\s+(\w+)", "class": r"\b(?:class|object|trait)\s+(\w+)", "import": r"(?m)^\s*import\s+([\w.]+)"},
    "elixir": {"function": r"\bdefp?\s+(\w+[?!]?)", "class": r"\bdefmodule\s+([\w.]+)", "import": r"(?m)^\s*(?:import|alias|use|require)\s+([\w.]+)"},
    "dart": {"function": r"[\w<>?]+\s+(?!(?:if|for|while|switch|catch)\b)(\w+)\s*\([^;{}]*\)\s*(?:async\s*)?(?:\{|=>)", "class": r"\b(?:class|mixin|extension)\s+(\w+)", "import": r"""(?m)^\s*import\s+["']([^"']+)["']"""},
    "c": {"function": r"(?m)^[A-Za-z_][\w\s*]*\s\*?(\w+)\s*\([^;{]*\)\s*\{", "class": r"\b(?:struct|enum|union|class)\s+(\w+)", "import": r"""(?m)^\s*#include\s+[<"]([^>"]+)[>"]""", "export": r"\bextern\s+[\w\s*]+?(\w+)\s*\("},
}
LANGUAGE = {
    "ts": "script", "tsx": "script", "js": "script", "jsx": "script", "mjs": "script", "cjs": "script", "py": "python", "rs": "rust", "go": "go", "java": "java", "kt": "kotlin", "kts": "kotlin", "cs": "java",
    "swift": "swift", "php": "php", "rb": "ruby", "scala": "scala", "ex": "elixir", "exs": "elixir", "dart": "dart", "c": "c", "h": "c", "cpp": "c", "hpp": "c",
}
#: A name before a bracket is a call, unless it is a word of a language or of its own definition.
CALL = r"([A-Za-z_]\w*)\s*\("
NO_CALLS = ("if", "for", "while", "switch", "catch", "return", "throw", "typeof", "await", "else", "case", "do", "in", "of", "try", "yield", "import", "require", "def", "defp", "class", "fn", "func", "fun", "function", "pub", "async", "self", "super", "this", "new", "use", "match", "when", "with", "not", "and", "or", "lambda", "sizeof", "elif", "except", "assert", "print")


def symbols(files: DataFrame) -> DataFrame:
    """(id, language, category, name), each once per file, of files (id, path, text); the ending of the path tells the language. Categories are
    function, class, import, export and call; a call is of a name that the file neither defines nor imports."""
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    language = F.create_map(*[F.lit(x) for kv in LANGUAGE.items() for x in kv])[ending]
    rows = files.where("text is not null").withColumn("language", language).where("language is not null")

    def named(category: str, pattern: str):
        names = F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))
        return F.transform(names, lambda x: F.struct(F.lit(category).alias("category"), x.alias("name")))

    found = [F.when(F.col("language") == lang, named(c, p)) for lang, rules in SYMBOLS.items() for c, p in rules.items()]
    empty = F.array().cast("array<struct<category:string,name:string>>")
    rows = rows.select("id", "language", "text", F.concat(*[F.coalesce(f, empty) for f in found]).alias("s"))
    own = F.transform("s", lambda x: x["name"])
    calls = F.filter(named("call", CALL), lambda x: ~x["name"].isin(*NO_CALLS) & ~F.array_contains(own, x["name"]))
    return rows.select("id", "language", F.inline(F.concat("s", calls)))


def _chunks(cut: Callable[[str], list[tuple[str, str]]], docs: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, k, h, t) for i, text in zip(pdf["id"], pdf["text"], strict=True) for k, (h, t) in enumerate(cut(text))]
            yield pd.DataFrame(out, columns=["id", "chunk", "heading", "text"])

    return docs.where("text is not null").select(F.col("id").cast("string"), "text").mapInPandas(rows, "id string, chunk int, heading string, text string")


def cut_headings(text: str) -> list[tuple[str, str]]:
    """A new chunk at every Markdown heading outside of fenced code."""
    out: list[tuple[str, list[str]]] = [("", [])]
    fenced = False
    for line in text.split("\n"):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        elif not fenced and re.match(r"#{1,6} ", line):
            out.append((line, []))
        out[-1][1].append(line)
    return [(h, "\n".join(lines)) for h, lines in out if lines]


def cut_lines(text: str) -> list[tuple[str, str]]:
    """Whole lines together up to LINE_CHUNK characters; a longer line is a chunk of its own."""
    out, now = [], ""
    for line in text.split("\n"):
        both = f"{now}\n{line}" if now else line
        if len(both) > LINE_CHUNK and now:
            out.append(("", now))
            both = line
        now = both
    return [*out, ("", now)] if now else out


def cut_by_type(text: str) -> list[tuple[str, str]]:
    """JSON is laid out and cut by lines, Markdown with headings by these, anything else by lines."""
    t = text.strip()
    if t[:1] in "[{" and t:
        try:
            return cut_lines(json.dumps(json.loads(t), indent=2, ensure_ascii=False))
        except ValueError:
            pass
    return cut_headings(text) if re.search(r"(?m)^#{1,6} ", text) else cut_lines(text)


def heading_chunks(docs: DataFrame) -> DataFrame:
    return _chunks(cut_headings, docs)


def line_chunks(docs: DataFrame) -> DataFrame:
    return _chunks(cut_lines, docs)


def typed_chunks(docs: DataFrame) -> DataFrame:
    return _chunks(cut_by_type, docs)


def front_matter(docs: DataFrame) -> DataFrame:
    """(id, fields, body): the key: value lines between leading --- lines as a map, and the rest of the text."""
    head = F.regexp_extract("text", r"(?s)\A---\r?\n(.*?)\r?\n---\r?(?:\n|\z)", 1)
    pairs = F.filter(F.transform(F.split(head, r"\r?\n"), lambda l: F.get(F.regexp_extract_all(l, F.lit(r"^([\w-]+):\s*(.*)$"), F.lit(0)), F.lit(0))), lambda x: x.isNotNull())
    entries = F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("k"), F.trim(F.regexp_replace(F.regexp_replace(p, r"^[\w-]+:\s*", ""), r"""^["']|["']$""", "")).alias("v")))
    body = F.regexp_replace("text", r"(?s)\A---\r?\n.*?\r?\n---\r?(?:\n|\z)", "")
    keys = F.array_distinct(F.transform("e", lambda x: x["k"]))
    rows = docs.where("text is not null").select("id", F.when(F.length(head) > 0, entries).otherwise(F.array().cast("array<struct<k:string,v:string>>")).alias("e"), body.alias("body"))
    # of a key said twice the first counts
    return rows.select("id", F.map_from_arrays(keys, F.transform(keys, lambda k: F.get(F.filter("e", lambda x: x["k"] == k), F.lit(0))["v"])).alias("fields"), "body")


def failures(docs: DataFrame) -> DataFrame:
    """(id, file, test, error) of failing tests in pytest output."""
    lines = F.regexp_extract_all("text", F.lit(r"(?m)^FAILED\s+(\S+::\S+\s+-\s+.+)$"), F.lit(1))
    rows = docs.where("text is not null").select("id", F.explode(lines).alias("l"))
    return rows.select("id", F.substring_index("l", "::", 1).alias("file"), F.regexp_extract("l", r"::(\S+)\s+-\s+", 1).alias("test"), F.trim(F.regexp_extract("l", r"\s+-\s+(.+)$", 1)).alias("error"))


def block_failures(docs: DataFrame) -> DataFrame:
    """(id, file, test, error) of failing tests in the output of runners that list them under their file: a line with the file and how many
    failed, lines with a cross and a test's name, and an arrow with its error (without one: Test failed)."""
    blocks = F.filter(F.split("text", r"(?m)^\s*❯\s+(?=\S+\.(?:test|spec)\.\S+\s+\([^)]*failed)"), lambda b: b.rlike(r"^\S+\.(?:test|spec)\.\S+\s+\([^)]*failed"))
    rows = docs.where("text is not null").select("id", F.explode(blocks).alias("b"))
    tests = rows.select("id", F.regexp_extract("b", r"^(\S+)", 1).alias("file"), F.explode(F.filter(F.split("b", "×\\s+"), lambda x: ~x.rlike(r"^\S+\.(?:test|spec)\."))).alias("t"))
    error = F.regexp_extract("t", r"→\s+(.+)", 1)
    return tests.select("id", "file", F.trim(F.substring_index("t", "\n", 1)).alias("test"), F.when(error != "", F.trim(error)).otherwise("Test failed").alias("error"))


def commit_facts(docs: DataFrame) -> DataFrame:
    """(id, type, confidence, content): what the first line of a commit message says by its prefix; other messages say nothing."""
    line = F.trim(F.substring_index("text", "\n", 1))
    rules = F.array(*[F.when(line.rlike(p), F.struct(F.lit(t).alias("type"), F.lit(c).alias("confidence"), F.regexp_replace(line, p, "").alias("content"))) for t, p, c in COMMIT_RULES])
    return docs.where("text is not null").select("id", F.inline(F.array_compact(rules)))


def diff_files(docs: DataFrame) -> DataFrame:
    """(id, line_no, path): files named by the lines of a diff: status lines with tabs (all their paths), stat lines with a bar, or bare
    paths; a summary of how many files changed names none."""
    t = F.trim("line")
    status = F.filter(F.transform(F.split(t, "\t"), F.trim), lambda x: (x != "") & ~x.rlike(r"^[ACDMRTUX]\d*$"))
    paths = F.when(t.rlike(r"^[ACDMRTUX]\d*\t"), status).when(t.contains("|"), F.array(F.trim(F.substring_index(t, "|", 1)))).when(t.rlike("[/.]"), F.array(t))
    rows = numbered_lines(docs).where((t != "") & ~t.rlike(r"^\d+\s+files?\s+changed"))
    return rows.select("id", "line_no", F.explode(paths).alias("path")).where("path <> ''")


def markdown_parts(docs: DataFrame) -> DataFrame:
    """(id, kind, value) of Markdown texts: every heading (with its marks), fenced code block (its body) and link to another file or anchor
    (its target); links out of the repository are no part."""
    def found(kind: str, pattern: str, group: int):
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))

    parts = F.concat(found("heading", r"(?m)^(#{1,6}[ \t]+[^\n]+)", 1), found("code", r"(?s)```[A-Za-z]*\n(.*?)```", 1), found("link", r"\[[^\]\n]*\]\(([^)\s]+)\)", 1))
    return docs.where("text is not null").select("id", F.inline(parts)).where("not (kind = 'link' and value rlike '^[a-z]+:')")


def prohibitions(docs: DataFrame) -> DataFrame:
    """(id, prohibition, keywords): what a text forbids (never / do not / don't / must not / avoid ...), with its words of three letters and more."""
    found = F.regexp_extract_all("text", F.lit(r"(?i)\b(?:never|do not|don't|must not|avoid)\s+([^.\n;]+)"), F.lit(1))
    rows = docs.where("text is not null").select("id", F.explode(found).alias("p")).withColumn("p", F.regexp_replace(F.trim("p"), r"\s+", " ")).where("p <> ''")
    words = F.array_distinct(F.filter(F.split(F.lower("p"), r"[^a-z0-9-]+"), lambda w: (F.length(w) >= 3) & ~w.isin("the", "and", "for", "with", "any", "use", "into", "from", "that", "this")))
    return rows.select("id", F.col("p").alias("prohibition"), words.alias("keywords"))


def violations(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """(event_id, id): tool calls whose text has every keyword of a prohibition with at least two. calls: (event_id, text).

    A keyword may stand within a word. Calls meet a rule through the first three letters of its longest keyword: of a call's trigrams only
    those that some rule begins with go on to the join.
    """
    r = rules.where(F.size("keywords") >= 2).withColumn("gram", F.substring(F.array_sort("keywords", lambda a, b: F.length(b) - F.length(a))[0], 1, 3))
    t = calls.select("event_id", F.lower("text").alias("t")).where(F.length("t") >= 3)
    grams = t.select("event_id", "t", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("t") - 2), lambda i: F.col("t").substr(i, F.lit(3))))).alias("gram"))
    met = grams.join(r.select("gram").distinct(), "gram", "left_semi").join(r.select("id", "keywords", "gram"), "gram")
    return met.where(F.forall("keywords", lambda k: F.col("t").contains(k))).select("event_id", "id").distinct()
