"""Scalar text functions as column expressions: all run inside the JVM. Null in, null or the neutral value out, as stated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, weights and words that results must agree on.
INJECTION = [
    ("instruction_like", r"(?i)\b(remember to always|from now on|this is mandatory|you must always|never forget)\b"),
    ("authority_claim", r"(?i)\b(team convention|project rule|always do|never do|mandatory practice|required by)\b"),
    ("prompt_injection", r"(?i)\b(ignore previous|disregard|override instructions|system prompt|you are now)\b"),
    ("json_in_text", r"""(?i)\{["\s]*[a-z_]+["\s]*:"""),
]
IMPERATIVES = r"(?i)\b(always|never|must|shall|should|ensure|make sure|do not|don't|require)\b"
SENTENCE_TYPES = [
    ("Decision", r"(?i)decided to|chose|we will use|going with|selected|opted for"),
    ("Bug", r"(?i)bug|error|crash|broken|failing|exception|regression"),
    ("Convention", r"(?i)always|never|must|convention|rule:|standard:"),
    ("Solution", r"(?i)fix|solved|workaround|resolution|patch"),
]
LINE_RULES = [
    ("Decision", r"(?i)\bwe decided\b", 0.85),
    ("Decision", r"(?i)\bchose\s+\S+\s+over\b", 0.8),
    ("Decision", r"(?i)\bdecision:\s*", 0.9),
    ("Convention", r"(?i)\bconvention:\s*", 0.9),
    ("Convention", r"(?i)\balways use\b", 0.7),
    ("Convention", r"(?i)\bnever use\b", 0.7),
    ("Bug", r"(?i)\bBUG:\s*", 0.9),
    ("Bug", r"(?i)\bFIXME:\s*", 0.85),
    ("Bug", r"(?i)\bHACK:\s*", 0.8),
    ("Concept", r"(?i)\bTODO:\s*", 0.75),
    ("Concept", r"(?i)\bREFACTOR:\s*", 0.75),
]
COMMIT_RULES = [("Solution", r"(?i)^fix(\(.+?\))?:\s*", 0.85), ("Decision", r"(?i)^feat(\(.+?\))?:\s*", 0.75), ("Decision", r"(?i)^refactor(\(.+?\))?:\s*", 0.7)]
APPROVAL = [
    (r"(?i)you'?r?e? absolutely right", 0.35),
    (r"(?i)you'?r?e? (completely|totally|entirely) right", 0.3),
    (r"(?i)i (was wrong|made a mistake|stand corrected)", 0.3),
    (r"(?i)i apologize for (the confusion|that|my mistake)", 0.2),
    (r"(?i)good (point|catch|observation|call)", 0.2),
    (r"(?i)that'?s? a (great|excellent|valid|fair) (point|suggestion|observation)", 0.2),
    (r"(?i)you'?r?e? right(,| —| \.)", 0.25),
]
TASKS = [
    ("bug-fix", r"\b(fix|broken|error|failing|crash|regression|slow|exception|timeout)\b|500|wrong output|not working"),
    ("review", r"\b(review|check|audit|convention|style|standards|pr|lint)\b|pull request|code quality"),
    ("feature", r"\b(add|implement|build|create|new|extend|support|integrate|enable)\b"),
]
SERVICES = [
    ("notion", r"notion\.so/"),
    ("confluence", r"[\w-]+\.atlassian\.net/wiki/"),
    ("google-docs", r"docs\.google\.com/"),
    ("jira", r"[\w-]+\.atlassian\.net/browse/"),
    ("linear", r"linear\.app/"),
    ("figma", r"figma\.com/"),
    ("miro", r"miro\.com/"),
    ("github-wiki", r"github\.com/[\w-]+/[\w-]+/wiki"),
    ("github-issue", r"github\.com/[\w-]+/[\w-]+/issues/\d+"),
    ("github-pr", r"github\.com/[\w-]+/[\w-]+/pull/\d+"),
    ("stackoverflow", r"stackoverflow\.com/questions/\d+"),
]


def first_match(c: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    return reduce(lambda acc, r: F.when(c.rlike(r[1]), r[0]).otherwise(acc), reversed(rules), F.lit(otherwise))


def word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != ""))


def array_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if one is empty or null."""
    a, b = (F.array_distinct(F.coalesce(x, F.array().cast("array<string>"))) for x in (a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def word_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the white-space separated words of two texts, case kept."""
    return array_jaccard(word_set(a), word_set(b))


def normal_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9\-_]+", " "))


def sanitized(c: Column, most: int = 2000) -> Column:
    """Without control characters, runs of blanks as one, cut at a word's end where that keeps more than half."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " "), r" {2,}", " ")
    cut = F.substring(t, 1, most)
    space = F.length(F.regexp_extract(cut, r"^(?s)(.*) ", 1))
    return F.trim(F.when(F.length(t) <= most, t).otherwise(F.when(space > most / 2, F.substring(cut, F.lit(1), space)).otherwise(cut)))


def flag_reason(c: Column) -> Column:
    return sanitized(F.regexp_replace(c, r"[`<>{}]", ""), 100)


def prompt_safe(c: Column) -> Column:
    t = sanitized(c, 5000)
    for a, b in ((r"\*\*\*", "* * *"), ("```", "` ` `"), ("<<", "< <"), (">>", "> >")):
        t = F.regexp_replace(t, a, b)
    return t


def injection_score(c: Column) -> Column:
    """0.4 for each pattern, 0.3 for a density of imperatives above 0.15, at most 1. 0 for empty texts."""
    t = F.coalesce(c, F.lit(""))
    hits = reduce(lambda a, b: a + b, [F.when(t.rlike(p), 0.4).otherwise(0.0) for _, p in INJECTION])
    words = F.size(F.filter(F.split(t, r"\s+"), lambda x: x != ""))
    dense = F.when((words > 0) & (F.regexp_count(t, F.lit(IMPERATIVES)) / words > 0.15), 0.3).otherwise(0.0)
    return F.least(F.lit(1.0), hits + dense)


def injection_reason(c: Column) -> Column:
    """The first pattern that is there, else imperative_density if that alone scores, else null."""
    return F.coalesce(first_match(F.coalesce(c, F.lit("")), INJECTION), F.when(injection_score(c) > 0, "imperative_density"))


def approval_score(c: Column) -> Column:
    t = F.coalesce(c, F.lit(""))
    return F.least(F.lit(1.0), reduce(lambda a, b: a + b, [F.when(t.rlike(p), w).otherwise(0.0) for p, w in APPROVAL]))


def task_type(c: Column) -> Column:
    return first_match(F.lower(F.coalesce(c, F.lit(""))), TASKS, "trivial")


def service_of(url: Column) -> Column:
    return first_match(url, SERVICES)


def wikilinks(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))


def slug(c: Column) -> Column:
    for a, b in ((r"[\s_]+", "-"), (r"[^a-z0-9-]", ""), (r"-{2,}", "-"), (r"^-+|-+$", "")):
        c = F.regexp_replace(F.lower(c), a, b)
    return c


def content_hash(c: Column) -> Column:
    return F.left(F.sha2(c, 256), F.lit(16))


def payload_tier(kind: Column, path: Column, content: Column) -> Column:
    """Trust tier of a captured payload: what the user said at a stop 1, files 2, else 3; with an external URL 4."""
    external = F.regexp_count(F.coalesce(content, F.lit("")), F.lit(r"https?://(?!localhost|127\.0\.0\.1)")) > 0
    return F.when(external, 4).when(kind == "Stop", 1).when(path.isNotNull(), 2).otherwise(3)


def private_address(host: Column) -> Column:
    """Whether a host must not be fetched: loopback, private, link-local and unspecified ranges."""
    return host.rlike(r"(?i)^(localhost|0\.0\.0\.0|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|::1$|\[?::1\]?$|f[cd][0-9a-f]{2}:|fe80:)")


def git_status(line: Column) -> Column:
    """(status, path) of a line of git diff --name-status: renamed files count as modified at the new path, copies as added."""
    p = F.split(line, "\t")
    code = F.left(p[0], F.lit(1))
    status = F.when(code == "A", "added").when(code == "D", "deleted").when(code == "C", "added").when(code.isin("M", "R"), "modified")
    return F.struct(status.alias("status"), F.when(code.isin("R", "C"), F.try_element_at(p, F.lit(3))).otherwise(F.try_element_at(p, F.lit(2))).alias("path"))


def content_kind(c: Column) -> Column:
    """code, nl or mixed, from signs of either in a question."""
    t = F.coalesce(c, F.lit(""))
    code = [r"\.[a-z]{1,4}$", r"\.[a-z]{1,4}\s", r"[a-z]+/[a-z]+", r"[a-z][A-Z][a-z]", r"[A-Z][a-z]+[A-Z][a-z]", r"\(.*\)", r"\{.*\}", r"import\s", r"require\s*\(", r"=>", r"[a-z]+_[a-z]+"]
    plain = [r"(?i)^(why|what|how|when|where|who|which|should|does|is|are|can|will|do)\s", r"\?$", r"(?i)\b(the|a|an|this|that|these|those)\s", r"(?i)\b(because|since|therefore|however|although)\b"]
    count = lambda rules: reduce(lambda a, b: a + b, [F.when(t.rlike(r), 1).otherwise(0) for r in rules])
    other = F.length(F.regexp_replace(t, r"[a-zA-Z\s]", "")) / F.greatest(F.length(t), F.lit(1))
    c_, n_ = count(code) + F.when(other > 0.3, 2).otherwise(0), count(plain)
    return F.when((c_ > 0) & (n_ > 0), F.when(c_ > 2 * n_, "code").when(n_ > 2 * c_, "nl").otherwise("mixed")).when(c_ > 0, "code").otherwise("nl")


def html_text(c: Column) -> Column:
    """Readable text of HTML: scripts and styles out, block ends as line breaks, tags out, the common entities decoded."""
    for a, b in (
        (r"(?is)<(script|style)[^>]*>.*?</\1>", " "), (r"(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr)>", "\n"), (r"<[^>]+>", ""),
        ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"), (r"[ \t]+", " "), (r"\s*\n\s*", "\n"), (r"^\s+|\s+$", ""),
    ):
        c = F.regexp_replace(c, a, b)
    return c
