"""Entity resolution and rule-based extraction.

Resolution blocks names by shared trigrams of their folded form that are rare enough to tell (a prefix filter, exact for the
threshold) among names with the same numbers, as the name rules want, scores candidate pairs by trigram Jaccard, drops pairs
that the name rules forbid, and takes connected components; equal folded names are one whatever their length; the smallest id is canonical."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from oremill.functions import scoring as S
from oremill.functions.text import fold, fold_text
from oremill.operators import graph
from oremill.plans.scratch import store

THRESHOLD = 0.85
#: Titles that don't tell persons apart.
TITLES = {"mr", "mrs", "ms", "dr", "prof", "sir", "lord", "lady", "king", "queen", "prince", "princess"}
_NUMBER = re.compile(r"\d+")


def may_merge(a: str, b: str, kind: str | None) -> bool:
    """Name rules: numbers must agree; two persons need more than a surname in common."""
    x, y = fold_text(a).split(), fold_text(b).split()
    if sorted(_NUMBER.findall(" ".join(x))) != sorted(_NUMBER.findall(" ".join(y))):
        return False
    if kind == "person" and len(x) > 1 and len(y) > 1 and x[-1] == y[-1]:
        given, other = set(x[:-1]) - TITLES, set(y[:-1]) - TITLES
        if given and other and not given & other and not (x[0].startswith(y[0]) or y[0].startswith(x[0])):
            return False
    return True


@F.pandas_udf(BooleanType())
def _may_merge(a: pd.Series, b: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([may_merge(*x) for x in zip(a, b, kind, strict=True)], dtype=bool)


def candidates(entities: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a < b, score: pairs of unlike names of one type whose trigram Jaccard reaches the threshold.

    Two sets of that similarity share a trigram among the rarest (1 - threshold) share of both, plus one."""
    folded = entities.select("id", "name", "type", fold("name").alias("folded"))
    numbers = F.array_join(F.array_sort(F.regexp_extract_all("folded", F.lit("([0-9]+)"))), " ").alias("numbers")
    e = folded.select("id", "name", "type", F.regexp_replace("folded", " ", "").alias("flat"), numbers).where(F.length("flat") > 0)
    e = store(e.withColumn("grams", S.trigrams(F.col("flat"))), "names")
    reps = e.groupBy("flat", "type").agg(F.min_by(F.struct("id", "name", "numbers", "grams"), "id").alias("r")).select("flat", "type", "r.*")
    block = ["type", "numbers", "g"]
    g = reps.where(F.length("flat") >= 3).select("id", "type", "numbers", F.size("grams").alias("n"), F.explode("grams").alias("g"))
    often = g.groupBy(*block).agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("often", "g"))
    first = g.join(often, block).withColumn("place", place).where(F.col("place") <= F.floor(F.col("n") * (1 - threshold) + 1e-9) + 1)
    first = store(first.select("id", "type", "numbers", "n", "g"), "prefixes")
    a, b = first.toDF("a", "type", "numbers", "an", "g"), first.toDF("b", "type", "numbers", "bn", "g")
    near = a.join(b, block).where((F.col("a") < F.col("b")) & (F.least("an", "bn") >= threshold * F.greatest("an", "bn"))).select("a", "b").distinct()
    names = reps.select("id", "name", "type", "flat")
    both = near.join(names.toDF("a", "a_name", "type", "a_flat"), "a").join(names.select("id", "name", "flat").toDF("b", "b_name", "b_flat"), "b")
    scored = both.withColumn("score", S.trigram_jaccard(F.col("a_flat"), F.col("b_flat"))).where(F.col("score") >= threshold)
    same = e.join(reps.select("flat", "type", F.col("id").alias("rep")), ["flat", "type"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score"))
    return scored.where(_may_merge("a_name", "b_name", "type")).select("a", "b", "score").unionByName(same)


def resolve(entities: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """id and canonical_id of every entity (id, name, type)."""
    pairs = store(candidates(entities, threshold), "same")
    found = graph.components(pairs.select(F.col("a").alias("source"), F.col("b").alias("target")))
    return entities.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("canonical_id"))


_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_TRIPLE = re.compile(r"\b([A-ZÀ-Þ]\w+)\s+(?:(was|is)\s+)?(\w+)\s+(?:(by|of|in|for|with|to)\s+)?([A-ZÀ-Þ]\w+)")


def triples(text: str) -> Iterator[tuple[str, str, str]]:
    """Capitalised name, verb phrase, capitalised name: a deterministic stand-in for a model that extracts triples."""
    for sentence in _SENTENCE.split(text):
        for s, _, verb, link, o in _TRIPLE.findall(sentence):
            yield s, "_".join(x.upper() for x in (verb, link) if x), o


def extract(chunks: DataFrame, extractor=triples) -> DataFrame:
    """id, triple_no, subject, predicate, object of each chunk (id, content), by a plug-in from text to triples."""
    kind = chunks.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, n, *t) for i, text in zip(f["id"], f["content"], strict=True) for n, t in enumerate(extractor(text or ""))]
            yield pd.DataFrame(rows, columns=["id", "triple_no", "subject", "predicate", "object"])

    return chunks.select("id", "content").mapInPandas(run, f"id {kind}, triple_no int, subject string, predicate string, object string")
