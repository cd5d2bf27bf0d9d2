"""Token counts of texts with a public byte-pair tokenizer. Its vocabulary file is a parameter and is read where it lies."""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts longer than this many characters are encoded in pieces of about as many, cut where the tokenizer's own pattern ends a word: the
#: tokens are those of the whole text. A word is never cut, however long.
PIECE = 50_000


def default_vocabulary() -> str:
    """Path of the 50k byte-level vocabulary of the installed public tokenizers."""
    found = importlib.util.find_spec("public_tokenizers")
    return os.environ.get("TOKENIZER_FILE") or (os.path.join(os.path.dirname(found.origin), "byte_bpe_50k.tiktoken") if found else "/opt/tokenizers/byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _words():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def pieces(text: str) -> list[str]:
    if len(text) <= PIECE:
        return [text]
    out, lo = [], 0
    for m in _words().finditer(text):
        # what follows white space has a say in how much of it is one word, so cuts are behind other words
        if m.end() - lo >= PIECE and not m[0][-1].isspace():
            out.append(text[lo : m.end()])
            lo = m.end()
    return [*out, text[lo:]] if lo < len(text) else out


def count_tokens(text: str | None, path: str) -> int:
    return sum(len(encoder(path).encode_ordinary(p)) for p in pieces(text)) if text else 0


def with_token_counts(documents: DataFrame, columns: list[str], path: str | None = None) -> DataFrame:
    """`columns` of documents and n_tokens of its `text`: 0 for null and empty texts. Broken characters count as what the
    encoder makes of them. A map over the rows, without a shuffle."""
    path = path or default_vocabulary()
    kept = documents.select(*columns, F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", n_tokens long"

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = [count_tokens(t, path) if isinstance(t, str) else 0 for t in pdf["_text"]]
            yield pdf.drop(columns="_text").assign(n_tokens=pd.Series(n, index=pdf.index, dtype="int64"))

    return kept.mapInPandas(rows, schema)
