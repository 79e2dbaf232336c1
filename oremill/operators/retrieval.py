"""Ranked search and rank fusion.

Ranks are taken after ORDER BY and LIMIT, so a ranking window sees as many rows as a list has, not the table.
Every order ends in an id: equal scores never make results differ between runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oremill.functions import scoring as S
from oremill.functions.text import dedup_key, keyword_score, tokens
from oremill.functions.vector import cosine

OVERFETCH = 3


def similarity(df: DataFrame, query: list[float], vector: str = "embedding") -> DataFrame:
    """df with its cosine similarity to a query vector."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return df.withColumn("similarity", F.round(cosine(F.col(vector), q, len(query)), 6))


def ranked(df: DataFrame, score: str, k: int, id_col: str, rank: str, keep: list[str] | None = None) -> DataFrame:
    """The k best by score then id, with their 1-based rank."""
    top = df.orderBy(F.desc(score), id_col).limit(k)
    return top.select(*(keep or df.columns), F.row_number().over(Window.orderBy(F.desc(score), id_col)).alias(rank))


def semantic_topk(df: DataFrame, query: list[float], k: int = 10, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    return similarity(df, query, vector).orderBy(F.desc("similarity"), id_col).limit(k)


def batch_topk(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", vector: str = "embedding", bound: int = 10_000) -> DataFrame:
    """query_id, id, similarity, rank for many query vectors at once.

    Each task multiplies its rows with the matrix of queries and keeps its own k best of each query, so k rows a query and
    task are shuffled. The queries are sent to every task: at most `bound` of them, else use several batches."""
    rows = queries.select("query_id", vector).limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} queries in a batch")
    rows.sort(key=lambda r: r[0])
    names = [r[0] for r in rows]
    q = np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300) if len(q) else q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_s, best_i = [np.zeros(0)] * len(names), [np.zeros(0, np.int64)] * len(names)
        for b in batches:
            if not b.num_rows or not len(names):
                continue
            ids = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            n = np.linalg.norm(x, axis=1)
            scores = np.round(np.where(n > 0, (q @ x.T) / np.maximum(n, 1e-300), 0.0), 6)
            for j in range(len(names)):
                s, i = np.r_[best_s[j], scores[j]], np.r_[best_i[j], ids]
                keep = np.lexsort((i, -s))[:k]
                best_s[j], best_i[j] = s[keep], i[keep]
        n = [len(s) for s in best_s]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array(names, np.int64), n)), pa.array(np.concatenate([*best_i, np.zeros(0, np.int64)])), pa.array(np.concatenate([*best_s, np.zeros(0)]))], ["query_id", "id", "similarity"]
        )

    found = df.where(F.size(vector) > 0).select(F.col(id_col).cast("long"), vector).mapInArrow(run, "query_id long, id long, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def keyword_scored(df: DataFrame, terms: list[str], text: str = "content") -> DataFrame:
    """Rows that match a term at least, with their keyword score."""
    return df.withColumn("keyword", F.round(keyword_score(tokens(F.col(text)), terms), 6)).where("keyword > 0")


def hybrid(vectors: DataFrame, texts: DataFrame, query: list[float], terms: list[str], k: int = 10, id_col: str = "id") -> DataFrame:
    """Reciprocal-rank fusion of a vector list and a keyword list, each 3k long: id, similarity, keyword, rrf."""
    v = ranked(similarity(vectors, query), "similarity", OVERFETCH * k, id_col, "rank", [id_col, "similarity"])
    t = ranked(keyword_scored(texts, terms), "keyword", OVERFETCH * k, id_col, "rank", [id_col, "keyword"])
    both = v.withColumn("keyword", F.lit(None).cast("double")).unionByName(t.withColumn("similarity", F.lit(None).cast("double")))
    fused = both.groupBy(id_col).agg(F.max("similarity").alias("similarity"), F.max("keyword").alias("keyword"), F.round(F.sum(S.rrf_term(F.col("rank"))), 9).alias("rrf"))
    return fused.orderBy(F.desc("rrf"), id_col).limit(k)


def memory_hybrid(memories: DataFrame, texts: DataFrame, query: list[float], terms: list[str], k: int = 10, id_col: str = "id") -> DataFrame:
    """0.7 / (60 + vector rank) + 0.3 / (60 + keyword rank), over the vector list; no keyword rank counts as 1000."""
    v = ranked(similarity(memories, query), "similarity", OVERFETCH * k, id_col, "vrank", [id_col, "similarity"])
    t = ranked(keyword_scored(texts, terms), "keyword", OVERFETCH * k, id_col, "krank", [id_col, "keyword"])
    score = S.rrf_term(F.col("vrank"), 0.7) + S.rrf_term(F.coalesce("krank", F.lit(1000)), 0.3)
    return v.join(t, id_col, "left").withColumn("score", F.round(score, 9)).orderBy(F.desc("score"), id_col).limit(k)


def with_sources(top: DataFrame, sources: DataFrame) -> DataFrame:
    """A short list with its sources' columns; the list, at most as long as its limit, is the broadcast side."""
    return sources.join(F.broadcast(top), "source_id")


def best_chunk(df: DataFrame, score: str = "score") -> DataFrame:
    """The best chunk of each source (the first place among equals), without sorting sources: max_by with partial aggregation."""
    order = F.struct(F.col(score).alias("s"), (-F.col("chunk_index")).alias("i"))
    rest = [c for c in df.columns if c != "source_id"]
    return df.groupBy("source_id").agg(F.max_by(F.struct(*rest), order).alias("b")).select("source_id", "b.*")


def min_max(df: DataFrame, score: str, out: str, by: list[str]) -> DataFrame:
    """Scores scaled to 0..1 in each list; a list of equal scores is all 1."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(out, F.when(high == low, 1.0).otherwise((F.col(score) - low) / (high - low)))


def merge_runners(candidates: DataFrame, k: int, signals: set[str] = frozenset(S.SIGNALS), weights: dict[str, float] | None = None, lists: list[str] | None = None) -> DataFrame:
    """Fuse runners' lists by chunk identity, calibrate, combine and rank.

    candidates: bucket_id, source_id, chunk_index, content, mode, rank and the raw scores (semantic, keyword, graph, memory,
    memory_similarity; NULL where a runner has none). lists: the runners that returned something, if that is known."""
    raw = ("semantic", "keyword", "graph", "memory", "memory_similarity")
    keyed = candidates.withColumn("key", dedup_key(F.col("bucket_id"), F.col("source_id"), F.col("chunk_index"), F.col("content")))
    term = S.rrf_term(F.col("rank"), S.runner_weight(F.col("mode"), weights))
    group = keyed.groupBy("key").agg(F.sum(term).alias("rrf"), F.sort_array(F.collect_set("mode")).alias("modes"), *(F.max(c).alias(c) for c in raw))
    if lists is None:
        lists = [r[0] for r in candidates.select("mode").distinct().collect()]  # one row for each runner
    most = sum(S.runner_weights(weights).get(m, S.OTHER_RUNNER_WEIGHT) for m in lists) / (S.RRF_K + 1)
    has = lambda m: F.array_contains("modes", m)
    scores = {
        "rrf": F.least(F.col("rrf") / most, F.lit(1.0)) if most else F.lit(0.0),
        "semantic": F.coalesce(S.calibrate_semantic(F.col("semantic")), F.when(has("memory"), S.calibrate_semantic(F.col("memory_similarity"))), F.when(has("indexed"), 0.0)),
        "keyword": F.coalesce(S.calibrate_keyword(F.col("keyword")), F.lit(0.0 if "keyword" in signals else None).cast("double")),
        "graph": S.normalize_ppr(F.coalesce("graph", F.lit(0.0))) if "graph" in signals else F.lit(None).cast("double"),
        "memory": F.when(has("memory"), S.clamp01(F.coalesce("memory", F.lit(0.0)))),
    }
    out = group.withColumn("composite", F.round(S.composite_score(scores, set(signals), weights), 9)).withColumn("rrf", F.round("rrf", 9))
    return out.select("key", F.concat_ws(",", "modes").alias("modes"), "rrf", "composite").orderBy(F.desc("composite"), F.desc("rrf"), "key").limit(k)


def memory_only(modes: Column) -> Column:
    """Is a merged result (its modes, joined by commas) a memory and nothing else? Such results are listed apart from chunks."""
    return modes == "memory"


def counters(results: DataFrame) -> DataFrame:
    """One row of counts by mode and of all merged results."""
    has = lambda m: F.count_if(F.array_contains(F.split("modes", ","), m)).alias(m)
    return results.agg(F.count("*").alias("results"), has("indexed"), has("graph"), has("memory"), F.count_if(memory_only(F.col("modes"))).alias("memories"))


def reinforce(graph: DataFrame, indexed: DataFrame, mode: str, key: str = "key") -> DataFrame:
    """off: all graph hits; prefer: those that the index found too count 1.5 times; only: just those (all, without any indexed hit)."""
    if mode == "off":
        return graph
    seen = indexed.select(key).distinct()
    if mode == "prefer":
        both = graph.join(seen.withColumn("__in", F.lit(True)), key, "left")
        return both.withColumn("graph", F.when(F.col("__in"), F.col("graph") * 1.5).otherwise(F.col("graph"))).drop("__in")
    return graph if seen.isEmpty() else graph.join(seen, key, "left_semi")


def boost_scope(hits: DataFrame, refs: DataFrame, score: str = "score", on: tuple[str, ...] = ("bucket_id", "source_id", "chunk_index")) -> DataFrame:
    marked = hits.join(refs.select(*on).distinct().withColumn("__in", F.lit(True)), list(on), "left")
    return marked.withColumn(score, S.scope_boost(F.col(score), F.coalesce("__in", F.lit(False)))).drop("__in")


def lexical_ladder(name: Column, aliases: Column, query: str) -> Column:
    """How well a name or its aliases match a query: equal, alias equal, prefix, contained."""
    q, low = query.lower(), F.lower(name)
    in_alias = lambda test: F.coalesce(F.exists(aliases, lambda a: test(F.lower(a))), F.lit(False))
    return (
        F.when(low == q, 1.0).when(in_alias(lambda a: a == q), 0.98).when(low.startswith(q), 0.88).when(in_alias(lambda a: a.startswith(q)), 0.86).when(F.contains(low, F.lit(q)), 0.84)
    )


def best_of(branches: list[DataFrame], id_col: str, score: str, k: int) -> DataFrame:
    """Union of branches, the best score of each id, the k best."""
    both = branches[0].select(id_col, score)
    for b in branches[1:]:
        both = both.unionByName(b.select(id_col, score))
    return both.groupBy(id_col).agg(F.max(score).alias(score)).orderBy(F.desc(score), id_col).limit(k)


#: Patterns of query classes over the lower-cased text, in the order in which they are tried, and signal weights.
CLASS_PATTERNS = {
    "relational": (r"\bwhat\b.*\b(connect|relat|link)", r"\bhow\b.*\b(relat|connect)", r"\bbetween\b.*\band\b", r"\bthrough\b", r"\bvia\b", r"\b(path|chain|connection|relationship) (from|between)\b"),
    "temporal": (
        r"\b(recent|recently|latest|last (week|month|day|year|time))\b", r"\b(when|timeline|history of|chronolog|over time)\b", r"\b(before|after|during|since|until)\b.*\b\d{4}\b",
        r"\b(yesterday|today|this (week|month|year))\b", r"\b(changed|updated|modified|added)\b.*\b(recently|lately)\b",
    ),
    "entity-centric": (r"\btell me (about|everything about)\b", r"\bwhat do (you|we) know about\b", r"\bsummarize\b.*\babout\b", r"\bbackground (on|of)\b", r"\bprofile (of|for)\b"),
    "factual-lookup": (
        r"^(what|who|where|which) (is|are|was|were)\b", r"\b(phone number|address|email|name of|birthday|born|founded|created|invented)\b", r"\b(how (many|much|old|tall|long|far))\b", r"\b(define|definition of)\b",
    ),
}
CLASS_WEIGHTS = {
    "factual-lookup": {"semantic": 0.40, "keyword": 0.25, "graph": 0.05, "memory": 0.30}, "entity-centric": {"semantic": 0.30, "keyword": 0.10, "graph": 0.45, "memory": 0.15},
    "relational": {"semantic": 0.20, "keyword": 0.05, "graph": 0.65, "memory": 0.10}, "temporal": {"semantic": 0.30, "keyword": 0.10, "graph": 0.15, "memory": 0.45},
    "exploratory": {"semantic": 0.45, "keyword": 0.05, "graph": 0.25, "memory": 0.25},
}
CLASS_CONFIDENCE = {"relational": 0.8, "temporal": 0.7, "entity-centric": 0.7, "factual-lookup": 0.7, "exploratory": 0.3}
CAPITALISED_CONFIDENCE = 0.6


def classify(text: Column) -> tuple[Column, Column]:
    """Class and confidence of a query, for whole columns of queries."""
    low = F.lower(text)
    words = F.slice(F.split(text, "\\s+"), 2, 1 << 30)
    capitals = F.size(F.filter(words, lambda w: (F.length(w) > 1) & (F.upper(F.substring(w, 1, 1)) == F.substring(w, 1, 1)) & (F.lower(F.substring(w, 1, 1)) != F.substring(w, 1, 1))))
    kind, sure = F, F
    first = None
    for name in ("relational", "temporal", "entity-centric"):
        hit = low.rlike("|".join(f"(?:{p})" for p in CLASS_PATTERNS[name]))
        kind = F.when(hit, name) if first is None else kind.when(hit, name)
        sure = F.when(hit, CLASS_CONFIDENCE[name]) if first is None else sure.when(hit, CLASS_CONFIDENCE[name])
        first = name
    fact = low.rlike("|".join(f"(?:{p})" for p in CLASS_PATTERNS["factual-lookup"]))
    kind = kind.when(capitals >= 3, "entity-centric").when(fact, "factual-lookup").otherwise("exploratory")
    sure = sure.when(capitals >= 3, CAPITALISED_CONFIDENCE).when(fact, CLASS_CONFIDENCE["factual-lookup"]).otherwise(CLASS_CONFIDENCE["exploratory"])
    return kind, sure
