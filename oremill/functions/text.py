"""Text functions as Column expressions; Unicode folding is a vectorised UDF."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UNIT = "\u001f"
#: Words that a relaxed keyword query drops.
STOP_WORDS = (
    "a an and are as at be by for from has have how in into is it its of on or that the their there these this those to was were what when where which who whom why with within"
).split()
#: Words that a query's tokens for fact and entity matching drop.
QUERY_STOP_WORDS = (
    "the and that this with from into about what which who whom whose when where why how did does are was were is in on of to for by as a an including include relation relationship novel narrative"
).split()
#: Fixed values, in order: Markdown syntax and what replaces it.
MARKDOWN = (
    ("(?s)```.*?```", ""), ("`([^`]+)`", "$1"), ("!\\[([^\\]]*)\\]\\([^)]+\\)", "$1"), ("\\[([^\\]]+)\\]\\([^)]+\\)", "$1"), ("#{1,6}\\s+", ""),
    ("\\*\\*(.+?)\\*\\*", "$1"), ("__(.+?)__", "$1"), ("\\*(.+?)\\*", "$1"), ("_(.+?)_", "$1"), ("~~(.+?)~~", "$1"),
    ("(?m)^\\s*>\\s+", ""), ("(?m)^\\s*[-*+]\\s+", ""), ("(?m)^\\s*\\d+\\.\\s+", ""), ("(?m)^[-*_]{3,}\\s*$", ""), ("<[^>]+>", ""), ("\\n{3,}", "\n\n"),
)


def sanitize(s: Column) -> Column:
    """NUL goes; other control characters but tab and line ends become spaces."""
    return F.regexp_replace(F.regexp_replace(s, "\\x00", ""), "[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", " ")


def strip_markdown(s: Column) -> Column:
    for pattern, to in MARKDOWN:
        s = F.regexp_replace(s, pattern, to)
    return F.regexp_replace(s, "^\\s+|\\s+$", "")


def tokens(s: Column) -> Column:
    """Lower-cased runs of letters and numbers."""
    return F.filter(F.split(F.lower(s), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def relaxed_terms(query: str, most: int = 16) -> list[str]:
    """Quoted phrases and words of a query, without short ones and stop words, each once."""
    out: list[str] = []
    found = re.findall("[\"'“”‘’]([^\"'“”‘’]{2,80})[\"'“”‘’]", query) + re.findall(r"[^\W_][\w'-]*", query)
    for x in found:
        term = " ".join(re.sub(r"[^\w\s'-]+|_", " ", x).split()).strip("'-")
        key = term.lower()
        if term and key not in {t.lower() for t in out} and (" " in term or len(term) > 2 and key not in STOP_WORDS):
            out.append(term)
    return out[:most]


def keyword_score(words: Column, terms: list[str]) -> Column:
    """Saturating term frequency over the terms: all terms matched counts in full, some of them three quarters."""
    if not terms:
        return F.lit(0.0)

    def score(hits: Column) -> Column:
        tf = [_count(hits, t) for t in terms]
        relaxed = sum((n / (n + 1.0) for n in tf), F.lit(0.0)) / len(terms)
        every = tf[0] > 0
        for n in tf[1:]:
            every = every & (n > 0)
        return F.when(every, relaxed).otherwise(0.75 * relaxed)

    # bound to a lambda's variable, the words are split and searched once
    return F.get(F.transform(F.array(F.filter(words, lambda w: w.isin(*terms))), score), F.lit(0))


def _count(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def idempotency_key(*fields: Column) -> Column:
    raw = F.concat_ws("::", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields))
    return F.when(F.length(raw) > 128, F.sha2(raw, 256)).otherwise(raw)


def hash_store_key(tenant: Column, bucket: Column, key: Column) -> Column:
    return F.concat_ws("::", F.coalesce(tenant, F.lit("__global__")), bucket, key)


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws(UNIT, *(p.cast("string") for p in parts)), 256), 1, 32))


def chunk_id(model: Column, bucket: Column, key: Column, index: Column) -> Column:
    return stable_id("chk", model, bucket, key, index)


def dedup_key(bucket: Column, source: Column, index: Column, content: Column) -> Column:
    whole = bucket.isNotNull() & source.isNotNull() & index.isNotNull() & (bucket != "") & (source != "")
    return F.when(whole, F.concat_ws(":", bucket, source, index.cast("string"))).otherwise(F.sha2(F.coalesce(content, F.lit("")), 256))


def identity_key(bucket: Column, source: Column, index: Column, content: Column) -> Column:
    """Which result a row is: its chunk, or its content where it has none."""
    return F.coalesce(F.concat(bucket, F.lit(":"), source, F.lit(":"), index.cast("string")), content)


def estimate_tokens(s: Column) -> Column:
    """Words by 1.3, rounded up (in integers: 13 words in 10 tokens)."""
    words = F.size(F.filter(F.split(s, "\\s+"), lambda w: w != ""))
    return F.ceil(words * F.lit(13) / F.lit(10)).cast("long")


def xml_escape(s: Column, attribute: bool = False) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&quot;"), ("'", "&apos;")] if attribute else [])
    for a, b in pairs:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def format_score(x: Column) -> Column:
    return F.format_string("%.4f", x)


def relation_phrase(relation: Column) -> Column:
    return F.lower(F.replace(relation, F.lit("_"), F.lit(" ")))


def fact_text(source: Column, relation: Column, target: Column) -> Column:
    return F.concat_ws(" ", source, relation_phrase(relation), target)


def sanitize_predicate(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(s)), "[\\s-]+", "_"), "[^A-Z0-9_]", "")


def external_id(value: Column, kind: Column, encoding: Column) -> Column:
    """Normal form of an external id by its type and encoding."""
    s, k = F.trim(value), F.lower(F.trim(kind))
    handle = (k == "email") | k.endswith("_email") | (k == "github_handle")
    return F.when(F.coalesce(encoding, F.lit("none")) == "sha256", F.lower(s)).when(handle, F.lower(s)).when(k == "phone", F.regexp_replace(s, "[^0-9+]", "")).otherwise(s)


def fold_text(s: str, compact: bool = False) -> str:
    """Latin ligatures opened, marks dropped, lower case; other characters become one space, or nothing."""
    s = s.replace("Æ", "ae").replace("æ", "ae").replace("Œ", "oe").replace("œ", "oe")
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()
    return re.sub("[^a-z0-9]+", "" if compact else " ", s).strip()


@F.pandas_udf(StringType())
def fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """fold_text for columns that may hold other than ASCII."""
    for s in batches:
        yield s.map(lambda x: None if x is None else fold_text(x))


def fold_ascii(s: Column, compact: bool = False) -> Column:
    """fold_text for ASCII columns, inside generated code."""
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "" if compact else " "))
