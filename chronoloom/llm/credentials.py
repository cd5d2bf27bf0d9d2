"""Credentials embedded in source code: find every place, and mask the values in place.

Texts are cut into overlapping chunks, and every shard of rows (an Arrow batch) gets a trigram index: one pass over the chunks
posts each trigram that some rule needs with the chunks that have it. From each detection regex the trigrams that any match must
contain are derived by walking its syntax tree; intersecting postings leaves the candidate chunks, and the regex runs on those
only. As in a file-sharded code search, the index of a shard lives beside its texts, so nothing is shuffled; pruning() reports
how many chunks it leaves to each rule.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from re import _constants as _c
from re import _parser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk, and how far the text of the next chunks is indexed with it: no match but a private key is longer,
#: and of those only the BEGIN line is matched.
CHUNK, OVERLAP = 8192, 1024
#: Characters of texts that are indexed together at most (a longer text alone is a shard).
SHARD = 4_000_000
#: Exact strings followed per regex piece before it is cut into conditions.
MAX_STRINGS, MAX_LEADING = 24, 300

# ---- trigram conditions -------------------------------------------------------------------------------------------


@dataclass
class _Strings:
    """The exact strings a part of a regex can match, and conditions that were closed on the way."""

    open: set[str] = field(default_factory=lambda: {""})
    closed: list[frozenset[frozenset[str]]] = field(default_factory=list)

    def close(self) -> None:
        # a trigram with other letters than ASCII isn't indexed: without it the condition is only weaker
        alternatives = [frozenset(t for i in {0, (len(s) - 3) // 2, len(s) - 3} if len(s) >= 3 for t in [s[i : i + 3]] if t.isascii()) for s in self.open]
        if alternatives and all(alternatives):
            self.closed.append(frozenset(alternatives))
        self.open = {""}

    def add(self, strings: set[str] | None) -> None:
        if strings is None or len(self.open) * len(strings) > MAX_STRINGS:
            self.close()
        if strings is not None:
            self.open = {a + b for a in self.open for b in strings} if len(strings) <= MAX_STRINGS else {""}


def _exact(tree, most: int = MAX_STRINGS) -> set[str] | None:
    """All strings the tree matches if they are few, else None."""
    out = {""}
    for op, arg in tree:
        if op is _c.LITERAL:
            step: set[str] | None = {chr(arg).lower()}
        elif op is _c.IN and all(o is _c.LITERAL for o, _ in arg) and len(arg) <= 8:
            step = {chr(x).lower() for _, x in arg}
        elif op is _c.BRANCH:
            parts = [_exact(t, most) for t in arg[1]]
            step = None if any(p is None for p in parts) else set().union(*parts)
        elif op is _c.SUBPATTERN:
            step = _exact(arg[3], most)
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[1] is not _c.MAXREPEAT and arg[1] <= 1:
            one = _exact(arg[2], most)
            step = None if one is None else one | ({""} if arg[0] == 0 else set())
        elif op in (_c.AT, _c.ASSERT, _c.ASSERT_NOT):
            step = {""}
        else:
            step = None
        if step is None or len(out) * len(step) > most:
            return None
        out = {a + b for a in out for b in step}
    return out


def _walk(tree, s: _Strings) -> None:
    for op, arg in tree:
        few = _exact([(op, arg)])
        if few is not None:
            s.add(few)
        elif op is _c.SUBPATTERN:
            _walk(arg[3], s)
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[0] >= 1:
            s.close()
            _walk(arg[2], s)
            s.close()
        elif op is _c.BRANCH:
            # every branch must give a condition, else nothing is required here
            s.close()
            conditions: set[frozenset[str]] = set()
            for t in arg[1]:
                b = _Strings()
                _walk(t, b)
                b.close()
                if not b.closed:
                    conditions = set()
                    break
                conditions |= min(b.closed, key=len)
            if conditions:
                s.closed.append(frozenset(conditions))
        else:
            s.close()


def required_trigrams(pattern: str) -> list[frozenset[frozenset[str]]]:
    """Conditions that every text matched by the pattern meets, in lower case: all of them, of each some alternative, of that
    all trigrams. An empty list means that nothing is required, so every chunk is a candidate.
    """
    s = _Strings()
    _walk(_parser.parse(pattern, re.I | re.A | re.X), s)
    s.close()
    return s.closed


# ---- detection rules ----------------------------------------------------------------------------------------------

# Words that name a credential, and texts that only stand in for one.
NAMES = (
    r"password|passwort|passwd|passphrase|passcode|(?<![a-z])pass|pwd|kennwort|contrase(?:n|ñ)a|senha|secret|token|credentials?"
    r"|(?:api|access|secret|signing|encryption|private|master|account|service|auth|session|client|license|webhook|app|deploy|shared|storage)[_-]?key"
)
#: What may follow such a name.
ENDING = r"(?:_?[0-9]{1,2}|_(?:base|b64|base64|value|text|plain|raw|old|new|prod|dev|test|staging|main|primary|secondary))?"
PLACEHOLDER = re.compile(
    r"(?ix)^(?: [*x.•#_-]+ | \$?\{.*\}? | <.*>? | %\(?\w+.* | \{\{.* | \[.* | (?:your|my|the|some|insert|enter|put|replace|add|example|sample|dummy|fake|test|placeholder|change|changeme|redacted|masked|removed|todo|tbd|none|null|nil|undefined|true|false|empty|n/?a|not[-_ ]?set|missing)(?:$|[-_ .].*)"
    r" | .*(?:example[-_]only|[-_]here|placeholder|redacted|changeme|change[-_]me|dummy|not[-_]a[-_](?:real|secret)).* | process\.env.* | os\.(?:environ|getenv).* | env[.\[(].* | \d{1,7} | x{4,}.* | \$[\w({].* | @\w+.* | vault:.* | (?:secretmanager|arn:aws|ssm|sm|op):.* )$"
)
#: Every rule starts with literals, so that its places can be found by plain search; what stands before a name (db_, X-,
#: camelCase) doesn't matter, what follows it does. Earlier rules win where two find the same place.
RULES: list[tuple[str, str]] = [
    ("private_key", r"(?P<v>-----BEGIN\ (?:[A-Z0-9]+\ )*PRIVATE\ KEY(?:\ BLOCK)?-----)"),
    ("access_key_id", r"(?P<v>A(?:KI|SI)A[A-Z0-9]{16})(?![A-Za-z0-9])"),
    (
        "provider_token",
        r"(?P<v>(?:gh[posru]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|sk_(?:live|test)_[A-Za-z0-9]{12,}|rk_live_[A-Za-z0-9]{12,}|sk-[A-Za-z0-9_-]{20,}"
        r"|xox[abeoprs]-[A-Za-z0-9-]{10,}|npm_[A-Za-z0-9]{20,}|pypi-[\w-]{20,}|hf_[A-Za-z0-9]{20,}|AIza[\w-]{30,}|dop_v1_[a-f0-9]{32,}|shpat_[a-fA-F0-9]{16,}))",
    ),
    ("jwt", r"(?P<v>eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,})"),
    ("auth_header", r"Authorization\\?[\"'`]?\s?[:=,]\s?\\?[\"'`]?(?P<scheme>Bearer|Basic|Token|ApiKey|Digest)\s+(?P<v>[^\s\"'`\\,;<>]{6,})"),
    ("bearer", r"Bearer\s+(?P<v>[A-Za-z0-9._~+/=-]{16,})"),
    ("url_password", r"://[^\s:/@\"'`\\<>]{0,64}:(?P<v>[^\s@\"'`\\<>]{3,})@"),
    ("basic_flag", r"curl\b[^\n]{0,200}?\ (?:-u|--user)[\ =]?\\?[\"']?[^\s:\"'\\]{1,64}:(?P<v>[^\s\"'`\\]{4,})"),
    ("url_query", rf"[?&](?:[a-z]{{0,20}}_)?(?:{NAMES}|key|sig|signature)=(?P<v>[^\s&\"'`\\<>#]{{6,}})"),
    ("element", rf"(?:{NAMES}){ENDING}>(?P<v>[^<>\n]{{4,}})</"),
    ("flag", rf"--(?:[a-z]+-){{0,3}}(?:{NAMES})(?:=|\ )(?P<q>\\?[\"'`])?(?P<v>[^-\s\"'`\\][^\s\"'`\\]{{5,}})"),
    ("connection", r"(?:Password|Pwd)\s?=\s?(?P<v>[^;\s\"'`\\]{4,});"),
    ("auth_line", r"_auth(?:Token)?\s?=\s?(?P<q>\\?[\"'`])?(?P<v>[^\s\"'`\\]{6,})"),
    # the value goes on to the closing quote, however far that is: see _closing()
    ("assigned", rf"(?P<name>{NAMES}){ENDING}(?:\\*[\"'`])?\]?\s{{0,4}}(?::=|=>|[:=])\s{{0,4}}(?P<q>\\*[\"'`])(?P<v>)"),
    ("assigned_bare", rf"(?:{NAMES}){ENDING}(?:\\*[\"'`])?\]?[ \t]{{0,4}}[:=][ \t]{{0,4}}(?P<v>[^\s\"'`\\<>,;(){{}}\[\]][^\s\"'`\\<>]{{5,}})"),
    ("is_prose", r"(?:password|passwort|passphrase|kennwort|contrase(?:n|ñ)a|mot\ de\ passe|senha)\ (?:is|ist|est|es|é|lautet|was)\ (?P<q>\\?[\"'`])?(?P<v>[^\s\"'`\\<>,;()]{6,})"),
    ("login_prose", r"user\ [\w.@-]{1,40},\ (?:[a-zñéç]+\ ){0,3}[a-zñéç]+:?\ (?P<q>\\?[\"'`])?(?P<v>[^\s\"'`\\<>,;()]{6,})"),
    ("login_table", r"(?:console|login|account|admin|portal)\ ?\|\s*(?P<v>[^\s|]{6,})\s*\|"),
]
#: Flags of all rules: blanks in a pattern don't count, only ASCII letters have cases.
FLAGS = re.I | re.A | re.X
_COMPILED = [(n, re.compile(p, FLAGS)) for n, p in RULES]
_NEEDED = [required_trigrams(p) for _, p in RULES]
#: Where a rule must not begin right behind a letter, digit or sign of a name.
_WHOLE = {"access_key_id", "provider_token", "jwt", "bearer", "flag"}
VOCABULARY = sorted({t for need in _NEEDED for alternatives in need for a in alternatives for t in a})

_CALL = re.compile(r"^[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*[(\[]|^(?:await|new|function|async|lambda|return|typeof)\b|^[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+$")
_WEAK_WORDS = re.compile(r"^[A-Za-z]+(?:[-_ ][A-Za-z]+)*$")
_HEX = re.compile(r"^[0-9a-f]{7,12}$")
_JOINED = re.compile(r"""(?P<q>\\*["'`])\s*(?:\+|\.)\s*(?P<o>\\*["'`])(?P<v>[^"'`\\\n]{1,})(?=\\*["'`])""")


def _mixed(v: str) -> bool:
    """A value that looks made: it has a digit or sign beside letters, or changes case inside."""
    letters = any(c.isalpha() for c in v)
    return letters and (any(c.isdigit() for c in v) or bool(re.search(r"[a-z][A-Z]|[A-Za-z][^\w\s.:/-][A-Za-z]", v)))


def _is_value(rule: str, v: str, quoted: bool) -> bool:
    """Whether v is an actual value rather than a variable, a call, a placeholder or a plain word."""
    if not v.strip() or PLACEHOLDER.match(v):
        return False
    if rule in ("private_key", "access_key_id", "provider_token", "jwt"):
        return True
    if len(v) < 12 and re.fullmatch(r"[\d.,:_+-]+", v):
        return False
    if quoted:
        if re.search(r"\s", v) or re.match(r"\.{0,2}/|https?://", v):
            return False
        return _mixed(v) or (len(v) >= 10 and bool(re.search(r"[^\w\s]", v)) and not _WEAK_WORDS.match(v))
    return not _CALL.match(v) and not _WEAK_WORDS.match(v) and _mixed(v)


#: A passphrase of several plain words.
_WORDED = re.compile(r"[A-Za-z0-9]{2,}(?:[ .-]+[A-Za-z0-9]{2,}){3,}")


def _closing(text: str, start: int, quote: str) -> int:
    """Where the value that begins at start ends: at its closing quote, which must be on the same line; else -1."""
    end = text.find(quote, start)
    return end if end - start >= 4 and text.find("\n", start, end) < 0 else -1


def _basic(v: str) -> bool:
    """Whether v is base64 of user:password."""
    try:
        return b":" in base64.b64decode(v, validate=True)
    except (binascii.Error, ValueError):
        return False


def _key_end(text: str, start: int) -> int:
    """End of the private key that begins at start: after its END line, or, if it was cut off, of its base64 lines."""
    end = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----").search(text, start)
    begin = text.find("-----BEGIN", start + 10)
    if end and (begin < 0 or begin > end.start()):
        return end.end()
    return re.compile(r"-----BEGIN [A-Z0-9 ]+-----(?:(?:\\+r)?(?:\\+n|\r?\n|\s)?[A-Za-z0-9+/=:,-]{16,})*").match(text, start).end()


def leading_literals(pattern: str) -> list[str]:
    """The few lower-case strings one of which every match begins with; none if that can't be said."""
    out: set[str] = {""}
    for part in _parser.parse(pattern, FLAGS):
        some = _exact([part], MAX_LEADING)
        if some is None and part[0] is _c.SUBPATTERN:
            inner = set()
            for branch in [part[1][3]] if part[1][3][0][0] is not _c.BRANCH else part[1][3][0][1][1]:
                head = {""}
                for x in branch:
                    step = _exact([x], MAX_LEADING)
                    if step is None:
                        break
                    head = {a + b for a in head for b in step}
                inner |= head
            return sorted({a + b for a in out for b in inner})
        if some is None or len(out) * len(some) > MAX_LEADING:
            break
        out = {a + b for a in out for b in some}
    return sorted(out)


def _starts(lowered: str, literals: list[str], lo: int, hi: int) -> list[int]:
    at = set()
    for x in literals:
        i = lowered.find(x, lo)
        while 0 <= i < hi:
            at.add(i)
            i = lowered.find(x, i + 1)
    return sorted(at)


_LEADING = [[] if "" in x else x for x in (leading_literals(p) for _, p in RULES)]


def _accepts(rule: str, v: str, quoted: bool, scheme: str) -> bool:
    if rule == "auth_header" and scheme == "basic":
        return _basic(v) or (not PLACEHOLDER.match(v) and _mixed(v))
    if rule in ("auth_header", "bearer"):
        return not PLACEHOLDER.match(v) and _mixed(v)
    return _is_value(rule, v, quoted or rule in ("element", "connection", "login_table", "url_password"))


def find_in(text: str, rules: list[int] | None = None, lo: int = 0, hi: int | None = None, lowered: str | None = None) -> list[tuple[int, str, list[tuple[int, int]]]]:
    """(start, rule, spans of the value's pieces) of each credential whose match begins in lo..hi, in order of start."""
    found: dict[int, tuple[str, list[tuple[int, int]]]] = {}
    taken: list[tuple[int, int]] = []
    end_at = len(text) if hi is None else hi
    lowered = text.lower() if lowered is None else lowered
    for k in range(len(RULES)) if rules is None else rules:
        rule, rx = _COMPILED[k]
        if _LEADING[k] and len(lowered) == len(text):
            matches = (rx.match(text, i) for i in _starts(lowered, _LEADING[k], lo, end_at))
        else:
            matches = rx.finditer(text, lo)
        for m in matches:
            if m is None or m.start() >= end_at:
                continue
            if rule in _WHOLE and m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "_-") and not text[max(0, m.start() - 2) : m.start()] == "\\n":
                continue
            a, b = m.span("v")
            groups = m.groupdict()
            quoted = bool(groups.get("q"))
            if rule == "private_key":
                b = _key_end(text, a)
            elif rule == "assigned":
                b = _closing(text, a, groups["q"])
                if b < 0:
                    continue
            elif not quoted and rule not in ("url_password", "connection", "element", "login_table"):
                b = a + len(text[a:b].rstrip(".,;:)}]|"))
            v = text[a:b]
            if rule.startswith("assigned") and ("-----BEGIN" in v or text[b : b + 1] == "("):
                continue
            worded = rule == "assigned" and groups["name"].lower() == "passphrase" and _WORDED.fullmatch(v) and not PLACEHOLDER.match(v)
            if any(x <= a < y for x, y in taken) or not (worded or _accepts(rule, v, quoted, (groups.get("scheme") or "").lower())):
                continue
            spans = [(a, b)]
            if quoted and rule != "private_key":
                while more := _JOINED.match(text, spans[-1][1]):
                    spans.append(more.span("v"))
            found[a] = (rule, spans)
            taken += spans
    return sorted((a, rule, spans) for a, (rule, spans) in found.items())


# ---- index and search ---------------------------------------------------------------------------------------------


def chunks_of(text: str) -> list[int]:
    """Starts of the chunks of a text; a text of length 0 has none."""
    return list(range(0, len(text), CHUNK))


def _trigram_codes(b: np.ndarray) -> np.ndarray:
    return (b[:-2].astype(np.int32) << 16) | (b[1:-1].astype(np.int32) << 8) | b[2:]


def _code_table() -> np.ndarray:
    """For each of 2**24 trigrams of bytes its row in the index, 0 for those that no rule needs. Capitals are those of small letters."""
    table = np.zeros(1 << 24, np.uint8 if len(VOCABULARY) < 255 else np.uint16)
    for i, t in enumerate(VOCABULARY, 1):
        forms = [[ord(c), ord(c.upper())] for c in t]
        for x in forms[0]:
            for y in forms[1]:
                for z in forms[2]:
                    table[(x << 16) | (y << 8) | z] = i
    return table


_TABLE: list[np.ndarray] = []


def postings(chunks: list[str]) -> dict[str, np.ndarray]:
    """For each trigram of VOCABULARY, which of the chunks have it, from one pass over all of them."""
    if not _TABLE:
        _TABLE.append(_code_table())
    # between chunks stands a byte that no trigram has
    data = [c.encode("utf-8", "surrogatepass") for c in chunks]
    whole = np.frombuffer(b"\xff\xff".join([*data, b""]), np.uint8)
    starts = np.cumsum([0, *[len(d) + 2 for d in data]])
    hit = np.zeros((len(VOCABULARY) + 1, len(chunks)), bool)
    for lo in range(0, max(0, len(whole) - 2), 1 << 20):
        row = _TABLE[0][_trigram_codes(whole[lo : lo + (1 << 20) + 2])]
        at = np.flatnonzero(row)
        hit[row[at], np.searchsorted(starts, at + lo, "right") - 1] = True
    return {t: hit[i] for i, t in enumerate(VOCABULARY, 1)}


def candidates(index: dict[str, np.ndarray], n: int) -> list[np.ndarray]:
    """For each rule, the chunks that meet all its trigram conditions."""
    out = []
    for need in _NEEDED:
        hit = np.ones(n, bool)
        for alternatives in need:
            some = np.zeros(n, bool)
            for a in alternatives:
                every = np.ones(n, bool)
                for t in a:
                    every &= index[t]
                some |= every
            hit &= some
        out.append(hit)
    return out


def shards(texts: list[str | None]) -> Iterator[list[int]]:
    """Positions of texts in runs of about SHARD characters."""
    run, size = [], 0
    for i, t in enumerate(texts):
        if t:
            run.append(i)
            size += len(t)
            if size >= SHARD:
                yield run
                run, size = [], 0
    if run:
        yield run


def shard_candidates(texts: list[str], own: list[int]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The chunks (text, start) of a shard, and a table of which are candidates of which rule."""
    at = [(i, c) for i in own for c in chunks_of(texts[i])]
    return at, np.array(candidates(postings([texts[i][c : c + CHUNK + OVERLAP] for i, c in at]), len(at))).T


def search_shard(texts: list[str | None]) -> list[list[tuple[int, str, list[tuple[int, int]]]]]:
    """The findings of each text, through the trigram indices of their shards."""
    found: list[dict] = [{} for _ in texts]
    for own in shards(texts):
        at, table = shard_candidates(texts, own)
        lowered: dict[int, str] = {}
        for row in np.flatnonzero(table.any(axis=1)):
            i, c = at[row]
            if i not in lowered:
                lowered[i] = texts[i].lower()
            for a, rule, spans in find_in(texts[i], np.flatnonzero(table[row]).tolist(), c, c + CHUNK, lowered[i]):
                found[i].setdefault(a, (a, rule, spans))
    return [sorted(f.values()) for f in found]


def mask(text: str, findings: list[tuple[int, str, list[tuple[int, int]]]]) -> str:
    """The text with every character of the values but line breaks turned into *, so that length, quotes and JSON stay."""
    out, at = [], 0
    for a, b in sorted({s for f in findings for s in f[2]}):
        if a >= at:
            out += [text[at:a], re.sub(r"[^\r\n]", "*", text[a:b])]
            at = b
    return "".join([*out, text[at:]])


def _found_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for_rows = search_shard([t if isinstance(t, str) else None for t in pdf["text"]])
        rows = [(i, f[0], f[1], sum(b - a for a, b in f[2])) for i, fs in enumerate(for_rows) for f in fs]
        at = [r[0] for r in rows]
        head = pdf[["table_name", "field", "record_id"]].iloc[at].reset_index(drop=True)
        yield head.assign(start_pos=[r[1] for r in rows], rule=[r[2] for r in rows], length=[r[3] for r in rows]).astype({"start_pos": "int64", "length": "int64", "rule": "object"})


def _masked_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = [t if isinstance(t, str) else None for t in pdf["text"]]
        found = search_shard(texts)
        keep = [i for i, f in enumerate(found) if f]
        out = pdf[["table_name", "field", "record_id"]].iloc[keep].reset_index(drop=True)
        yield out.assign(text=[mask(texts[i], found[i]) for i in keep], n_values=[len(found[i]) for i in keep]).astype({"n_values": "int64", "text": "object"})


def find_credentials(texts: DataFrame) -> DataFrame:
    """(table_name, field, record_id, start_pos, rule, length) of every credential in texts (table_name, field, record_id, text).

    start_pos counts characters from 0. A value in pieces is one row at its first piece. Null and empty texts have none;
    repeated rows give repeated results; other columns are ignored.
    """
    return texts.select("table_name", "field", "record_id", "text").mapInPandas(
        _found_batches, "table_name string, field string, record_id string, start_pos long, rule string, length long"
    )


def mask_credentials(texts: DataFrame) -> DataFrame:
    """(table_name, field, record_id, text, n_values): the texts that hold credentials, with the values masked."""
    return texts.select("table_name", "field", "record_id", "text").mapInPandas(
        _masked_batches, "table_name string, field string, record_id string, text string, n_values long"
    )


def pruning(texts: DataFrame) -> DataFrame:
    """(rule, n_chunks, n_candidates, share): how many chunks of the texts the index leaves to each rule; 'any' is those left to some rule."""
    names = [n for n, _ in RULES] + ["any"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, left = 0, np.zeros(len(names), np.int64)
        for pdf in batches:
            values = [t if isinstance(t, str) else None for t in pdf["text"]]
            for own in shards(values):
                at, table = shard_candidates(values, own)
                n += len(at)
                left += [*table.sum(axis=0), table.any(axis=1).sum()]
        yield pd.DataFrame({"rule": names, "n_chunks": n, "n_candidates": left})

    sums = texts.select("text").mapInPandas(rows, "rule string, n_chunks long, n_candidates long").groupBy("rule").agg(F.sum("n_chunks").alias("n_chunks"), F.sum("n_candidates").alias("n_candidates"))
    return sums.withColumn("share", F.when(F.col("n_chunks") > 0, F.col("n_candidates") / F.col("n_chunks")))


def trigram_index(texts: DataFrame) -> DataFrame:
    """The index as a table: (trigram, table_name, field, record_id, chunk) for the trigrams that the rules need."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = [t if isinstance(t, str) else None for t in pdf["text"]]
            for own in shards(values):
                at = [(i, c) for i in own for c in chunks_of(values[i])]
                for t, hit in postings([values[i][c : c + CHUNK + OVERLAP] for i, c in at]).items():
                    k = np.flatnonzero(hit)
                    head = pdf[["table_name", "field", "record_id"]].iloc[[at[x][0] for x in k]].reset_index(drop=True)
                    yield head.assign(trigram=t, chunk=[at[x][1] // CHUNK for x in k]).astype({"chunk": "int64"})

    return texts.select("table_name", "field", "record_id", "text").mapInPandas(
        rows, "table_name string, field string, record_id string, trigram string, chunk long"
    )


def stored_texts(hook_events: DataFrame, nodes: DataFrame) -> DataFrame:
    """The texts that can hold credentials; a record delivered twice is there twice."""
    parts = [
        hook_events.select(F.lit("hook_events").alias("table_name"), F.lit(c).alias("field"), F.col("event_id").cast("string").alias("record_id"), F.col(c).alias("text"))
        for c in ("tool_input", "tool_response")
    ]
    parts.append(nodes.select(F.lit("graph_nodes").alias("table_name"), F.lit("content").alias("field"), F.col("id").alias("record_id"), F.col("content").alias("text")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where(F.length("text") > 0)
