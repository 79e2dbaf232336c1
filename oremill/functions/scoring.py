"""Score calibration and combination as Column expressions. NULL means "not eligible", 0 means "eligible and poor"."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K = 60
#: Weights of runners in rank fusion, and of signals in the composite score by the signals that are on.
RUNNER_WEIGHTS = {"indexed": 0.5, "memory": 0.2, "graph": 0.15}
OTHER_RUNNER_WEIGHT = 0.5
DEFAULT_WEIGHTS = {
    "s": {"semantic": 1.0}, "sk": {"semantic": 0.85, "keyword": 0.15}, "sg": {"semantic": 0.55, "graph": 0.45}, "sm": {"semantic": 0.55, "memory": 0.45},
    "skg": {"semantic": 0.45, "keyword": 0.10, "graph": 0.45}, "skm": {"semantic": 0.45, "keyword": 0.10, "memory": 0.45},
    "skgm": {"semantic": 0.35, "keyword": 0.05, "graph": 0.30, "memory": 0.30}, "sgm": {"semantic": 0.35, "graph": 0.35, "memory": 0.30},
    "k": {"keyword": 1.0}, "kg": {"keyword": 0.20, "graph": 0.80}, "km": {"keyword": 0.20, "memory": 0.80}, "kgm": {"keyword": 0.10, "graph": 0.45, "memory": 0.45},
    "gm": {"graph": 0.50, "memory": 0.50}, "g": {"graph": 1.0}, "m": {"memory": 1.0},
}
SIGNALS = ("semantic", "keyword", "graph", "memory")


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def linear(x: Column, floor: float, ceiling: float) -> Column:
    """0 up to floor, 1 from ceiling, linear between; NULL stays NULL."""
    return F.when(x.isNotNull(), F.when(x <= floor, 0.0).when(x >= ceiling, 1.0).otherwise((x - floor) / (ceiling - floor)))


def calibrate_semantic(cosine: Column, floor: float = 0.0, ceiling: float = 0.85) -> Column:
    return linear(cosine, floor, ceiling)


def calibrate_keyword(score: Column, floor: float = 0.0, ceiling: float = 1.0) -> Column:
    return linear(score, floor, ceiling)


def normalize_rrf(score: Column, lists: int | Column, k: int = RRF_K) -> Column:
    most = F.lit(lists) / F.lit(k + 1.0) if isinstance(lists, int) else lists / F.lit(k + 1.0)
    return F.when(most > 0, F.least(score / most, F.lit(1.0))).otherwise(0.0)


def normalize_ppr(p: Column) -> Column:
    """Fourth root, at most 1; nothing positive and finite gives 0."""
    usable = p.isNotNull() & ~F.isnan(p) & (p > 0) & (p < float("inf"))
    return F.when(usable, F.least(F.sqrt(F.sqrt(p)), F.lit(1.0))).otherwise(0.0)


def rrf_term(rank: Column, weight: float | Column = 1.0, k: int = RRF_K) -> Column:
    return (F.lit(weight) if isinstance(weight, float) else weight) / (F.lit(float(k)) + rank)


def composite(parts: list[tuple[float, Column]]) -> Column:
    """Weighted sum; the weight of NULL parts goes to the others in proportion; no part at all gives 0."""
    total = sum(w for w, _ in parts)
    eligible = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for w, v in parts), F.lit(0.0))
    value = sum((F.coalesce(v * w, F.lit(0.0)) for w, v in parts), F.lit(0.0))
    return F.when(eligible > 0, value * total / eligible).otherwise(0.0)


def default_weights(signals: set[str]) -> dict[str, float]:
    return DEFAULT_WEIGHTS.get("".join(s[0] for s in SIGNALS if s in signals), DEFAULT_WEIGHTS["s"])


def composite_score(scores: dict[str, Column], signals: set[str], weights: dict[str, float] | None = None) -> Column:
    chosen = weights or default_weights(signals)
    return composite([(chosen[k], scores[k]) for k in (*SIGNALS, "rrf") if chosen.get(k) and k in scores])


def display_scores(raw: dict[str, Column], signals: set[str], lists: int) -> dict[str, Column]:
    """The normalised scores that a result shows: raw semantic, keyword, rrf, graph and memory scores of the signals that are on.

    Without a keyword match the fused rank counts half. A memory score is shown of memories only (NULL elsewhere)."""
    none = F.lit(None).cast("double")
    out = {}
    if "semantic" in signals:
        out["semantic"] = calibrate_semantic(F.coalesce(raw.get("semantic", none), F.lit(0.0)))
    if "keyword" in signals:
        keyword = F.coalesce(raw.get("keyword", none), F.lit(0.0))
        out["keyword"] = calibrate_keyword(keyword)
        out["rrf"] = normalize_rrf(raw.get("rrf", none), lists) * F.when(keyword > 0, 1.0).otherwise(0.5)
    if "graph" in signals:
        out["graph"] = normalize_ppr(F.coalesce(raw.get("graph", none), F.lit(0.0)))
    if "memory" in signals:
        out["memory"] = clamp01(raw.get("memory", none))
    return out


def runner_weights(weights: dict[str, float] | None = None) -> dict[str, float]:
    """Rank-fusion weights of runners from the user's signal weights."""
    if not weights:
        return RUNNER_WEIGHTS
    return {"indexed": weights.get("semantic", 0.5) + weights.get("keyword", 0.0), "memory": weights.get("memory", 0.2), "graph": weights.get("graph", 0.15)}


def runner_weight(mode: Column, weights: dict[str, float] | None = None) -> Column:
    out = F.lit(OTHER_RUNNER_WEIGHT)
    for k, w in runner_weights(weights).items():
        out = F.when(mode == k, w).otherwise(out)
    return out


def recency(age_ms: Column, half_life_ms: float = 7 * 86_400_000.0) -> Column:
    return F.exp(-F.lit(math.log(2) / half_life_ms) * F.greatest(age_ms, F.lit(0)))


def decay_score(age_ms: Column, importance: Column, accesses: Column) -> Column:
    frequency = F.least(F.lit(1.0), F.log(1.0 + F.coalesce(accesses, F.lit(0))) / F.lit(math.log(100)))
    return 0.4 * recency(age_ms) + 0.4 * clamp01(importance) + 0.2 * frequency


def memory_score(similarity: Column, importance: Column, recent: Column) -> Column:
    return clamp01(0.55 * F.coalesce(similarity, F.lit(0.0)) + 0.30 * F.coalesce(importance, F.lit(0.5)) + 0.15 * recent)


def scope_boost(score: Column, in_scope: Column) -> Column:
    return F.when(in_scope, F.least(F.lit(1.0), score * 1.15 + 0.05)).otherwise(score)


def overlap(a: Column, b: Column) -> Column:
    """Shared distinct tokens over those of a; 0 where a is empty."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_distinct(a)), F.lit(1))


def overlap_coefficient(a: Column, b: Column) -> Column:
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def trigrams(s: Column) -> Column:
    return F.when(F.length(s) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substring(s, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def trigram_jaccard(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_union(x, y))
    return F.when((F.length(a) < 3) | (F.length(b) < 3) | (both == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / both)


def entity_chunk_weight(mentions: Column, confidence: Column) -> Column:
    sure = F.when(confidence > 0, confidence).otherwise(0.75)
    return F.least(F.lit(3.0), 0.5 + F.log2(1.0 + mentions) * sure)
