"""Abusive, hateful or sexual content: nearest labelled examples by exact TF-IDF cosine.

Documents are cut into passages (sentences, lines, turns) and these into words that are folded so that spellings meant to hide a
word meet the plain one. Passages of labelled documents are the examples. Every passage is compared with all examples by
exact cosine through an inverted index in blocks: a block is read only if the sum of its largest weights can still reach the
passage's k nearest; a passage whose words cannot bring it near any abusive example has score 0 without more work. The
nearest examples vote by distance; a document has the highest score of its passages, with that passage as evidence.

The labelled sample and hence the index are bounded (MAX_LABELLED); idf counts and scores cover all documents.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.session import materialize

#: Labelled documents used at most (those of the smallest hash of doc_id), whole, and characters of all of them together: the
#: index has a proven bound.
MAX_LABELLED, MAX_CHARS = 20_000, 100_000_000
#: Blocks read at a time, those of the highest bounds first.
TOGETHER = 32
#: Harmless passages without any telling word that are kept as examples at most (those of the smallest hash); all others stay.
MAX_PLAIN = 20_000
#: Nearest examples that vote, and the least cosine of an example that may vote.
NEAREST, LEAST = 7, 0.35
#: Examples per block of the index; examples with the same heaviest words stand together.
BLOCK = 16
#: A word is telling if its rate in passages of labelled documents called abusive is this many times that in the others' passages, among
#: which so many from all documents are mixed, and if chance alone would give as many with this probability at most.
TELLING, MIXED, CHANCE = 3.0, 1000, 0.05
#: Nearest passages of other documents with telling words that are asked whether a passage of a labelled document is abusive, and how
#: much they must weigh together, in squared cosines, to decide it.
OPINIONS, ENOUGH = 15, 0.25
#: Passages times blocks of the index that are bounded at a time.
CELLS = 4_000_000

# Letters of other scripts and signs that stand in for Latin letters. i, l, 1, ! and | fold to one letter.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ӏ": "i", "ո": "n",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "υ": "u", "ν": "v", "τ": "t", "κ": "k", "η": "n", "χ": "x", "ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "ł": "i", "đ": "d", "ı": "i",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "!": "i", "|": "i", "l": "i",
    "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
}
_FOLD = str.maketrans(_LOOKALIKES)
_FIRST = re.compile(r"<dev_\d+>|(?:dev_\d+|user|assistant|tool):$")
_CODE = re.compile(r"[/\\{}()=<>`]|[a-z][A-Z]|\w_\w\w|[a-z]\.[a-z]|^[A-Z]+_[A-Z]|^[a-z]{2,}-[a-z]{2,}|^[0-9a-f]{7,}$|^\W*\d+\W*$|^[a-z]{17,}$")
_SPELLED = re.compile(r"(?<![\w])(?:[^\W\d_][-_.·* ]){2,}[^\W\d_]{1,3}(?![\w])")
_EDGES = re.compile(r"^[^\w@$*]+|[^\w@$*!]+$|!+$")
_RUN = re.compile(r"(.)\1+")
_NAME = re.compile(r"^@?d[e3]v_?\d+$", re.I)
_MENTION = re.compile(r"d[e3]v_?\d", re.I)
_IDENTIFIER = re.compile(r"[a-z][A-Z]|[A-Za-z0-9]_[A-Za-z0-9]{2}")


def fold_word(token: str) -> str:
    """The one spelling of a token, or nothing for code, numbers and signs."""
    if token.isascii() and token.isalpha() and len(token) < 17 and (token.islower() or token.istitle()):
        # a plain word, the usual case: what is below comes to this
        w = token.lower()
        return "" if len(w) >= 7 and not w.strip("abcdef") else _RUN.sub(r"\1", w.replace("l", "i"))
    if _IDENTIFIER.search(token) and not _MENTION.search(token) and "**" not in token:
        return ""
    t = _EDGES.sub("", token)
    if not t or len(t) > 40:
        return ""
    if _NAME.match(t):
        return "@name"
    if _CODE.search(t) and "**" not in t:
        return ""
    t = t.lower()
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    t = _RUN.sub(r"\1", t.translate(_FOLD))
    return "".join(c for c in t if c.isalnum() or c == "*")


# what else is to know of a token: it is the last or the first of a passage, it has a mask, letters in it are set apart, its last
# letter stands alone (behind another one), it begins with a letter that stands alone, it is short
_ENDS, _STARTS, _MASKED, _APART, _ALONE, _TWICE, _OPENS, _SHORT = (1 << i for i in range(8))
_PAIR = re.compile(r"[^\W\d_][-_.·*][^\W\d_][-_.·*]?$")
_LEAD = re.compile(r"\W*[^\W\d_](?:[-_.·*]|$)")
_FEW = re.compile(r"[^\W\d_]{1,3}(?!\w)")


def token_shape(t: str) -> int:
    if t.isalnum():
        return 0 if len(t) > 3 or not t.isalpha() else _SHORT | (_ALONE | _OPENS if len(t) == 1 else 0)
    shape = _ENDS if t.rstrip("\"')]")[-1:] in (".", "!", "?", "…") else 0
    if _FIRST.match(t):
        shape |= _STARTS
    if "*" in t:
        shape |= _MASKED
    if len(t) > 4 and _SPELLED.search(t):
        shape |= _APART
    end = t[:-1] if t[-1] in "-_.·*" else t
    if end[-1:].isalpha() and not end[-2:-1].isalpha() and not end[-2:-1].isdigit():
        shape |= _ALONE | (_TWICE if _PAIR.search(t) else 0)
    if _LEAD.match(t):
        shape |= _OPENS
    return shape | (_SHORT if _FEW.match(t) else 0)


class _Memory(dict):
    """Folded tokens and what else is to know of them, computed when first asked for, forgotten when there are too many."""

    def __missing__(self, token: str) -> tuple[str, int]:
        if len(self) > 300_000:
            self.clear()
        w = self[token] = fold_word(token), token_shape(token)
        return w


class _Folder:
    """Texts as passages (sentences, lines, turns) and their folded words, in one walk over the tokens."""

    def __init__(self) -> None:
        self.known = _Memory()

    def split(self, text: str) -> list[tuple[list[str], int, int, list[str], int]]:
        """(tokens of the line, first, end, words, shapes of the tokens together) of each passage of a text."""
        out: list[tuple[list[str], int, int, list[str], int]] = []
        for line in text.split("\n"):
            self._line(line, out, True)
        return out

    def _line(self, line: str, out: list, look: bool) -> None:
        tokens, known = line.split(), self.known
        words: list[str] = []
        before = len(out)
        first = shapes = last = 0
        for i, t in enumerate(tokens):
            w, shape = known[t]
            if shape:
                # letters that are set apart are put together first
                if look and (shape & _APART or last & _ALONE and shape & _OPENS or last & _TWICE and shape & _SHORT) and _SPELLED.search(line):
                    del out[before:]
                    self._line(_SPELLED.sub(lambda m: re.sub(r"[-_.·* ]", "", m[0]), line), out, False)
                    return
                if shape & _STARTS and i > first:
                    out.append((tokens, first, i, words, shapes))
                    words, first, shapes = [], i, 0
                shapes |= shape
            last = shape
            if w:
                words.append(w)
            if shape & _ENDS:
                out.append((tokens, first, i + 1, words, shapes))
                words, first, shapes = [], i + 1, 0
        if first < len(tokens):
            out.append((tokens, first, len(tokens), words, shapes))

    def words(self, passage: str) -> list[str]:
        return [w for p in self.split(passage) for w in p[3]]

    def passages(self, text: str) -> list[tuple[str, list[str]]]:
        """Each passage of a text with its words."""
        return [(" ".join(t[a:b]), words) for t, a, b, words, _ in self.split(text)]


# ---- index --------------------------------------------------------------------------------------------------------


class ExampleIndex:
    """Block-max inverted index over labelled passages, with exact cosine search."""

    def __init__(self, tokens: list[tuple[str, ...]], labels: np.ndarray, weights: np.ndarray, docs: list[int], idf: dict[str, float], rare: float) -> None:
        vocabulary = sorted({w for t in tokens for w in t})
        self.ids = {w: i for i, w in enumerate(vocabulary)}
        self.idf = np.array([idf.get(w, rare) for w in vocabulary], np.float64)
        self.rare = rare
        # abusive examples first, so that blocks are of one kind; then by their rarest words
        heavy = [sorted(set(t), key=lambda w: (-idf.get(w, rare), w))[:3] for t in tokens]
        order = np.array(sorted(range(len(tokens)), key=lambda i: (-labels[i], heavy[i])), int)
        self.labels, self.weights, self.docs = np.asarray(labels, float)[order], np.asarray(weights, float)[order], [docs[i] for i in order]
        cols, vals, starts = [], [], [0]
        for i in order:
            c = Counter(tokens[i])
            k = np.array([self.ids[w] for w in c], np.int32)
            v = (1 + np.log(np.array(list(c.values()), float))) * self.idf[k]
            cols.append(k)
            vals.append(v / max(1e-9, np.linalg.norm(v)))
            starts.append(starts[-1] + len(k))
        self.cols = np.concatenate(cols) if cols else np.zeros(0, np.int32)
        self.vals = np.concatenate(vals) if vals else np.zeros(0)
        self.starts = np.array(starts)
        n = len(order)
        self.n_blocks = -(-n // BLOCK) if n else 0
        block = np.repeat(np.arange(n) // BLOCK, np.diff(self.starts))
        # per word: the blocks that have it and its largest weight in each
        key = self.cols.astype(np.int64) * max(1, self.n_blocks) + block
        o = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], key[o][1:] != key[o][:-1]])) if len(o) else np.zeros(0, int)
        self.top = np.maximum.reduceat(self.vals[o], first) if len(first) else np.zeros(0)
        self.top_block = (key[o][first] % max(1, self.n_blocks)).astype(np.int32) if len(first) else np.zeros(0, np.int32)
        self.top_at = np.searchsorted(key[o][first] // max(1, self.n_blocks) if len(first) else np.zeros(0), np.arange(len(vocabulary) + 1))
        # per word: the largest weight in any abusive example
        self.bad = np.zeros(len(vocabulary))
        n_bad = int((self.labels > 0.5).sum())
        end = self.starts[n_bad]
        np.maximum.at(self.bad, self.cols[:end], self.vals[:end])
        self.n_bad = n_bad
        # the heaviest words of each abusive example, until those left together weigh less than LEAST: without one of
        # them a passage cannot be LEAST similar to it
        lead: set[int] = set()
        for i in range(n_bad):
            k, v = self.cols[self.starts[i] : self.starts[i + 1]], self.vals[self.starts[i] : self.starts[i + 1]]
            o = np.argsort(-v)
            after = 1 - np.cumsum(v[o] ** 2)
            lead.update(k[o][: int(np.argmax(after < LEAST * LEAST)) + 1].tolist())
        self.lead = frozenset(vocabulary[i] for i in lead)
        self.bad_word = {w: float(self.bad[i] * self.idf[i]) for w, i in self.ids.items() if self.bad[i] > 0}
        # per word: the abusive examples that have it, with its weight
        o = np.argsort(self.cols[:end], kind="stable")
        self.bad_list, self.bad_vals = np.repeat(np.arange(n), np.diff(self.starts))[:end][o], self.vals[:end][o]
        self.bad_at = np.searchsorted(self.cols[:end][o], np.arange(len(vocabulary) + 1))
        # the blocks of abusive examples come first in each word's list: how many these are
        self.bad_blocks = -(-n_bad // BLOCK)
        word = np.repeat(np.arange(len(vocabulary)), np.diff(self.top_at))
        self.bad_size = np.bincount(word[self.top_block < self.bad_blocks], minlength=len(vocabulary))
        self.wild: dict[str, str] = {}

    def known(self, w: str) -> str:
        """A word with masked letters as the word of an abusive example that it can stand for, if there is one."""
        if "*" not in w:
            return w
        if w not in self.wild:
            # a run of masks was folded to one
            rx = re.compile(re.escape(w).replace(r"\*", ".{1,4}"))
            self.wild[w] = min((x for x in self.bad_word if rx.fullmatch(x)), default=w.replace("*", "")) if len(w) >= 3 and w.strip("*") else ""
        return self.wild[w]

    def vector(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Columns and unit weights of the known words. The length counts words of no example too, all at half the weight of the rarest word."""
        c = Counter(words)
        cols = np.array([self.ids[w] for w in c if w in self.ids], np.int32)
        v = (1 + np.log(np.array([c[w] for w in c if w in self.ids], float))) * self.idf[cols] if len(cols) else np.zeros(0)
        unknown = sum(1 for w in c if w not in self.ids)
        norm = np.sqrt(float((v**2).sum()) + unknown * (0.5 * self.rare) ** 2)
        return cols, v / max(1e-9, norm)

    def may_be_abusive(self, passages_: list[list[str]]) -> np.ndarray:
        """For many passages: whether some abusive example is LEAST similar. Most are settled without looking at examples: none of these
        examples' leading words is there, or in no block of theirs the largest weights of the passage's words add up to LEAST."""
        out = np.zeros(len(passages_), bool)
        some = [i for i, w in enumerate(passages_) if not self.lead.isdisjoint(w)]
        get, unknown = self.ids.get, (0.5 * self.rare) ** 2
        step = max(1, min(20_000, CELLS // max(1, self.bad_blocks)))
        for lo in range(0, len(some), step):
            part = some[lo : lo + step]
            cols: list[int] = []
            starts, strange, often = [], [], []
            for i in part:
                words = passages_[i]
                once = set(words)
                k = [c for c in map(get, once) if c is not None]
                starts.append(len(cols))
                cols += k
                strange.append(len(once) - len(k))
                often.append(len(words) - len(once))
            c = np.array(cols, np.int64)
            q = self.idf[c]
            # a word said n times weighs 1 + log n times as much
            need = LEAST * np.sqrt(np.add.reduceat(q * q, starts) + unknown * np.array(strange)) * (1 - 1e-9) / (1 + np.log1p(np.array(often)))
            owner = np.repeat(np.arange(len(part)), np.diff([*starts, len(cols)]))
            # the largest weights in any abusive example first, then those of each block
            open_ = np.add.reduceat(self.bad[c] * q, starts) >= need
            c, q, owner = c[open_[owner]], q[open_[owner]], owner[open_[owner]]
            size = self.bad_size[c]
            at = np.repeat(self.top_at[c] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            bound = np.bincount(np.repeat(owner, size) * self.bad_blocks + self.top_block[at], self.top[at] * np.repeat(q, size), len(part) * self.bad_blocks)
            if len(bound):
                left = np.array(part)[open_ & (bound.reshape(len(part), -1).max(axis=1) >= need)]
                for k in range(0, len(left), max(1, CELLS // max(1, self.n_bad))):
                    rows = left[k : k + max(1, CELLS // max(1, self.n_bad))]
                    out[rows] = self._nearest_bad([passages_[i] for i in rows]) >= LEAST - 1e-12
        return out

    def _nearest_bad(self, passages_: list[list[str]]) -> np.ndarray:
        """The exact cosine of each passage's nearest abusive example, for many passages at once."""
        cols: list[int] = []
        often: list[int] = []
        starts, strange = [], []
        get = self.ids.get
        for words in passages_:
            starts.append(len(cols))
            unknown = 0
            for w, n in Counter(words).items():
                c = get(w)
                if c is None:
                    unknown += 1
                else:
                    cols.append(c)
                    often.append(n)
            strange.append(unknown)
        c = np.array(cols, np.int64)
        v = (1 + np.log(np.array(often, float))) * self.idf[c]
        owner = np.repeat(np.arange(len(passages_)), np.diff([*starts, len(cols)]))
        v /= np.sqrt(np.bincount(owner, v * v, len(passages_)) + np.array(strange) * (0.5 * self.rare) ** 2)[owner]
        size = self.bad_at[c + 1] - self.bad_at[c]
        at = np.repeat(self.bad_at[c] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        cos = np.bincount(np.repeat(owner, size) * self.n_bad + self.bad_list[at], self.bad_vals[at] * np.repeat(v, size), len(passages_) * self.n_bad)
        return cos.reshape(len(passages_), -1).max(axis=1)

    def nearest(self, words: list[str], k: int = NEAREST, without: int | None = None, only_if_bad: bool = False) -> list[tuple[float, int]]:
        """(cosine, example) of the k nearest examples with a cosine of at least LEAST. without: a document to leave out.
        only_if_bad: nothing at all if no abusive example is LEAST similar, which is looked at first."""
        cols, vals = self.vector(words)
        if not len(cols):
            return []
        dense = np.zeros(len(self.idf))
        dense[cols] = vals
        if only_if_bad and not self._search(dense, self._bounds(cols, vals, self.bad_size[cols], self.bad_blocks), 1, None, self.n_bad):
            return []
        return self._search(dense, self._bounds(cols, vals, self.top_at[cols + 1] - self.top_at[cols], self.n_blocks), k, without, len(self.labels))

    def _bounds(self, cols: np.ndarray, vals: np.ndarray, size: np.ndarray, n_blocks: int) -> np.ndarray:
        """For each of the first blocks the most that the cosine of one of its examples can be; size: blocks to read in each word's list."""
        at = np.repeat(self.top_at[cols] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        return np.bincount(self.top_block[at], self.top[at] * np.repeat(vals, size), n_blocks)

    def _search(self, dense: np.ndarray, bound: np.ndarray, k: int, without: int | None, n: int) -> list[tuple[float, int]]:
        """The k nearest of the first n examples, whose blocks have these bounds: those of the highest bounds are read first, and only as
        long as their bounds reach the k-th nearest."""
        found: list[tuple[float, int]] = []
        some = np.flatnonzero(bound >= LEAST - 1e-12)
        order = some[np.argsort(-bound[some], kind="stable")]
        for at_ in range(0, len(order), TOGETHER):
            worst = found[k - 1][0] if len(found) >= k else LEAST
            blocks = order[at_ : at_ + TOGETHER]
            blocks = blocks[bound[blocks] >= worst - 1e-12]
            if not len(blocks):
                break
            rows = (np.sort(blocks)[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            rows = rows[rows < n]
            size = self.starts[rows + 1] - self.starts[rows]
            first = np.cumsum(size) - size
            cells = np.arange(int(size.sum())) + np.repeat(self.starts[rows] - first, size)
            cos = np.add.reduceat(dense[self.cols[cells]] * self.vals[cells], first)
            for i in np.flatnonzero(cos >= worst - 1e-12):
                if without is None or self.docs[rows[i]] != without:
                    found.append((float(cos[i]), int(rows[i])))
            found.sort(key=lambda x: (-x[0], x[1]))
            del found[k:]
        return found

    def score(self, words: list[str], without: int | None = None) -> tuple[float, int, float]:
        """(vote for abuse in 0..1, nearest abusive example or -1, its cosine)."""
        near = self.nearest(words, without=without, only_if_bad=True)
        total = votes = 0.0
        best, cosine = -1, 0.0
        for cos, i in near:
            w = cos**4
            total += w
            votes += w * float(self.labels[i])
            if self.labels[i] > 0.5 and cos > cosine:
                best, cosine = i, cos
        return (votes / (total + 0.02) if total else 0.0), best, cosine


def telling_words(tokens: list[tuple[str, ...]], share: np.ndarray, df_counts: dict[str, int], n_passages: int, docs: list[int] | None = None) -> frozenset[str]:
    """The words that passages of documents called abusive have TELLING times as often as others, and that more of these documents have
    than passages would by chance: few labels prove little of common words, and one document repeats its own. docs: the passages' documents,
    each its own if not given."""
    within: dict[str, set[int]] = {}
    for d, t, x in zip(docs or range(len(tokens)), tokens, share, strict=True):
        if x >= 0.5:
            for w in set(t):
                within.setdefault(w, set()).add(d)
    bad, fine = Counter(), Counter()
    for t, x in zip(tokens, share, strict=True):
        (bad if x >= 0.5 else fine).update(set(t))
    n_bad = int((share >= 0.5).sum())
    n_fine = len(tokens) - n_bad + MIXED

    def tells(n: int, n_docs: int, expected: float) -> bool:
        if n < TELLING * expected or n_docs <= expected:
            return False
        if expected > 100:
            return n_docs > expected + 2 * math.sqrt(expected)
        term = below = math.exp(-expected)  # Poisson: the chance of fewer than n_docs
        for i in range(1, n_docs):
            term *= expected / i
            below += term
        return 1 - below <= CHANCE

    return frozenset(w for w, n in bad.items() if tells(n, len(within[w]), n_bad * (fine[w] + MIXED * df_counts.get(w, 0) / max(1, n_passages)) / n_fine))


def calibration(scores: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, shares) of a rising line that gives the share of raters who call a document of a score abusive: means of
    neighbouring scores are pooled until they rise."""
    order = np.argsort(scores, kind="stable")
    pools: list[list[float]] = []
    for x, y in zip(scores[order], shares[order], strict=True):
        pools.append([float(x), float(y), 1.0])
        while len(pools) > 1 and (pools[-2][1] >= pools[-1][1] or pools[-2][0] == pools[-1][0]):
            x1, y1, n1 = pools.pop()
            x0, y0, n0 = pools.pop()
            pools.append([(x0 * n0 + x1 * n1) / (n0 + n1), (y0 * n0 + y1 * n1) / (n0 + n1), n0 + n1])
    return np.array([p[0] for p in pools]), np.array([p[1] for p in pools])


def build_index(labelled: pd.DataFrame, df_counts: dict[str, int], n_passages: int) -> tuple[ExampleIndex, float, tuple[np.ndarray, np.ndarray]]:
    """The index of labelled (doc_id, text, share of raters who said abusive, n_raters), the decision threshold, and the calibration of scores.

    What is telling comes from the labels alone. A passage with a telling word is an example of abuse if its document and those of the
    passages like it were mostly called so; where no passage is like it, if its telling words are together rarer than any one word can be,
    or weigh the most in a document that several raters called abusive. Other passages with telling words in documents called abusive are doubtful and no
    examples at all; all the rest are examples of harmless text. The threshold is the one of the best F1 on the labelled documents, each
    scored without its own passages.
    """
    folder = _Folder()
    idf = {w: float(np.log((n_passages + 1) / (n + 0.5))) for w, n in df_counts.items()}
    rare = float(np.log((n_passages + 1) / 1.5))
    rows: dict[tuple[int, tuple[str, ...]], float] = {}
    for doc, text, share in zip(labelled["doc_id"], labelled["text"], labelled["share"], strict=True):
        for _, words in folder.passages(text):
            if words:
                rows[(int(doc), tuple(words))] = float(share)
    docs = [d for d, _ in rows]
    tokens = [t for _, t in rows]
    share = np.array(list(rows.values()), float)
    per_doc: dict[int, list[int]] = {}
    for i, d in enumerate(docs):
        per_doc.setdefault(d, []).append(i)
    telling = telling_words(tokens, share, df_counts, n_passages, docs)
    weight = np.array([sum(idf.get(w, rare) for w in telling.intersection(t)) for t in tokens], float)

    def once(which: np.ndarray, label: np.ndarray) -> ExampleIndex:
        seen: dict[tuple[str, ...], list[int]] = {}
        for i in which:
            seen.setdefault(tokens[i], []).append(i)
        firsts = [v[0] for v in seen.values()]
        return ExampleIndex([tokens[i] for i in firsts], np.array([float(np.mean(label[v])) for v in seen.values()]), np.array([len(v) for v in seen.values()], float), [docs[i] for i in firsts], idf, rare)

    # raters err: what a passage is, the documents of passages like it tell better than its own alone
    suspects = np.flatnonzero(weight > 0)
    label = np.zeros(len(tokens))
    if len(suspects):
        agreed = dict(zip(labelled["doc_id"].astype(int), labelled["n_raters"] > 1, strict=True))
        # a word of one passage alone, however often that is copied, may be there by chance
        seen = Counter(w for t in {tokens[i] for i in np.flatnonzero(share >= 0.5)} for w in telling.intersection(t))
        met = [sum(idf.get(w, rare) for w in telling.intersection(t) if seen[w] > 1) for t in tokens]
        most = {d: max(met[i] for i in own) for d, own in per_doc.items()}
        opinions = ExampleIndex([tokens[i] for i in suspects], share[suspects], np.ones(len(suspects)), [docs[i] for i in suspects], idf, rare)
        for i in suspects:
            near = opinions.nearest(list(tokens[i]), OPINIONS, without=docs[i])
            w = np.array([c * c for c, _ in near])
            if w.sum() >= ENOUGH:
                own = min(1.0, weight[i] / (1.2 * rare))  # the less its words tell, the less its own document's say counts
                label[i] = float(own * share[i] + (w * opinions.labels[[j for _, j in near]]).sum() >= 0.5 * (own + w.sum()))
            elif share[i] >= 0.5:
                label[i] = 1.0 if weight[i] >= 1.2 * rare or (agreed[docs[i]] and met[i] and met[i] == most[docs[i]]) else np.nan
    rest: dict[tuple[str, ...], int] = {}
    for i in np.flatnonzero(weight == 0):
        rest.setdefault(tokens[i], int(i))
    plain = sorted(rest.values(), key=lambda i: zlib.crc32(" ".join(tokens[i]).encode()))[:MAX_PLAIN]
    index = once(np.sort(np.concatenate([suspects[~np.isnan(label[suspects])], np.array(plain, int)])), label)
    truth, scores = [], []
    for d, own in per_doc.items():
        words = [list(tokens[i]) for i in own]
        scores.append(max((index.score(words[i], without=d)[0] for i in np.flatnonzero(index.may_be_abusive(words))), default=0.0))
        truth.append(share[own[0]])
    truth_a, scores_a = np.array(truth, float), np.array(scores, float)
    bad = truth_a >= 0.5
    best, threshold = -1.0, 0.5
    for t in np.arange(0.3, 0.71, 0.05):
        hit = scores_a >= t
        f1 = 2 * (hit & bad).sum() / max(1, hit.sum() + bad.sum())
        if f1 > best + 1e-9 or (abs(f1 - best) < 1e-9 and abs(t - 0.5) < abs(threshold - 0.5)):
            best, threshold = f1, float(t)
    return index, threshold, calibration(scores_a, truth_a)


# ---- Spark --------------------------------------------------------------------------------------------------------


def word_counts(documents: DataFrame, vocabulary: frozenset[str]) -> DataFrame:
    """(word, n): number of passages that have each folded word of the vocabulary, over all documents; the word '' counts all passages."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder, counts, known = _Folder(), Counter(), shared.value
        for pdf in batches:
            for text in pdf["text"]:
                if isinstance(text, str):
                    own = folder.split(text)
                    counts[""] += len(own)
                    for p in own:
                        counts.update(known.intersection(p[3]))
        yield pd.DataFrame({"word": list(counts), "n": list(counts.values())}).astype({"word": "object", "n": "int64"})

    return documents.select("text").mapInPandas(rows, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def labelled_texts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, share, n_raters): labelled documents, whole, with the share of raters who called them abusive: at most MAX_LABELLED, and as many
    of these as have MAX_CHARS characters together."""
    votes = labels.where("abusive is not null").groupBy("doc_id").agg(F.avg(F.col("abusive").cast("double")).alias("share"), F.count(F.lit(1)).alias("n_raters"))
    few = votes.withColumn("o", F.xxhash64("doc_id")).orderBy("o", "doc_id").limit(MAX_LABELLED)
    some = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(few), "doc_id").dropDuplicates(["doc_id"])
    some = materialize(some, "labelled")
    # the running sum is over MAX_LABELLED lengths at most, without the texts
    upto = F.sum("n").over(Window.orderBy("o", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    fit = some.select("doc_id", "o", F.length("text").cast("long").alias("n")).withColumn("upto", upto).where(F.col("upto") <= MAX_CHARS)
    return some.join(F.broadcast(fit.select("doc_id")), "doc_id").select("doc_id", "text", "share", "n_raters")


def abuse_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, score, abusive, evidence, example_doc, similarity) for every document.

    score is the share of raters that the highest vote of the document's passages stands for, as calibrated on the labels, and abusive
    whether that vote reaches the threshold found on them; it is 0 where no passage is like an abusive example. evidence is that passage, example_doc the labelled document it is most like. Null and empty texts have score 0. Without labels
    every score is 0. A document delivered twice gives two rows. Other columns are ignored.
    """
    spark = documents.sparkSession
    labelled = labelled_texts(documents, labels).toPandas()  # bounded by MAX_LABELLED and MAX_CHARS
    folder = _Folder()
    vocabulary = frozenset(w for t in labelled["text"] for _, words in folder.passages(t) for w in words)
    counts = {r["word"]: r["n"] for r in word_counts(documents, vocabulary).collect()}  # no more than the labelled texts have words
    shared = spark.sparkContext.broadcast(build_index(labelled, counts, counts.pop("", 0)))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix, limit, line = shared.value
        fold, memory = _Folder(), {}
        for pdf in batches:
            best: list[tuple] = [(0.0, None, None, None)] * len(pdf)
            owner: list[int] = []
            said: list[tuple] = []
            folded: list[list[str]] = []
            for row, text in enumerate(pdf["text"]):
                if isinstance(text, str):
                    own = fold.split(text)
                    owner += [row] * len(own)
                    said += own
                    folded += [[ix.known(w) for w in p[3]] if p[4] & _MASKED else p[3] for p in own]
            for i in np.flatnonzero(ix.may_be_abusive(folded)):
                key = " ".join(folded[i])
                if key not in memory:
                    if len(memory) > 50_000:
                        memory.clear()
                    memory[key] = ix.score(folded[i])
                s, example, cos = memory[key]
                if s > best[owner[i]][0]:
                    best[owner[i]] = (s, " ".join(said[i][0][said[i][1] : said[i][2]]), ix.docs[example] if example >= 0 else None, cos)
            out = pdf[["doc_id", "source"]].reset_index(drop=True)
            yield out.assign(
                score=[float(np.interp(b[0], *line)) if b[0] > 0 else 0.0 for b in best],
                abusive=[b[0] >= limit and b[0] > 0 for b in best],
                evidence=pd.Series([b[1] for b in best], dtype="object"),
                example_doc=pd.array([b[2] for b in best], dtype="Int64"),
                similarity=pd.Series([b[3] for b in best], dtype="float64"),
            )

    return documents.select("doc_id", "source", "text").mapInPandas(
        rows, "doc_id long, source string, score double, abusive boolean, evidence string, example_doc long, similarity double"
    )


def rates_by_source(scores: DataFrame) -> DataFrame:
    """Documents, abusive documents and their share per source; names are compared trimmed, in lower case, with - as _."""
    source = F.regexp_replace(F.lower(F.trim("source")), "[- ]+", "_")
    return scores.groupBy(source.alias("source")).agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if("abusive").alias("n_abusive"), F.avg(F.col("abusive").cast("double")).alias("rate"), F.avg("score").alias("mean_score")
    )
