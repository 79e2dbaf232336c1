"""Predicates for identity, visibility, memory state and metadata, and scans over them."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oremill.functions.temporal import active_at


@dataclass(frozen=True)
class Identity:
    tenant: str | None = None
    group: str | None = None
    user: str | None = None
    agent: str | None = None
    conversation: str | None = None

    def given(self) -> dict[str, str]:
        return {f.name: v for f in fields(self) if (v := getattr(self, f.name)) is not None}

    def key(self) -> str:
        """One deterministic name of the scope."""
        if not self.given():
            raise ValueError("a scope needs one id at least")
        return "|".join(f"{k}:{v}" for k, v in self.given().items())


def identity_filter(who: Identity) -> Column:
    """Equality on every id that is given."""
    out = F.lit(True)
    for k, v in who.given().items():
        out = out & (F.col(f"{k}_id") == v)
    return out


def visibility_gate(who: Identity) -> Column:
    """Public rows, and rows of a level whose id is given and equal."""
    out = F.col("visibility").isNull()
    for k, v in who.given().items():
        out = out | ((F.col("visibility") == k) & (F.col(f"{k}_id") == v))
    return out


def scan(df: DataFrame, who: Identity = Identity(), buckets: list[str] | None = None, as_of: dt.datetime | None = None, time_col: str = "indexed_at", visible: bool = True) -> DataFrame:
    """The filtered scan below every ranked search: all predicates reach the files."""
    df = df.where(identity_filter(who))
    if visible:
        df = df.where(visibility_gate(who))
    if buckets is not None:
        df = df.where(F.col("bucket_id").isin(buckets) if buckets else F.lit(False))
    return df if as_of is None else df.where(F.col(time_col) <= F.lit(as_of))


def require_filter(**given) -> dict:
    """The filters that say something; deletes and bulk reads refuse to run without one."""
    kept = {k: v for k, v in given.items() if v is not None and v != [] and v != ""}
    if not kept:
        raise ValueError("a filter is needed")
    return kept


def memory_filter(ids: list[str] | None = None, categories: list[str] | None = None, statuses: list[str] | None = None, active: bool = False, include_expired: bool = False, as_of: dt.datetime | None = None, metadata: dict[str, str] | None = None) -> Column:
    out = F.lit(True)
    for name, values in (("id", ids), ("category", categories), ("status", statuses)):
        if values is not None:
            out = out & (F.col(name).isin(values) if values else F.lit(False))
    if active:
        out = out & F.col("invalid_at").isNull() & (F.col("status") == "active")
    elif not include_expired:
        out = out & ~F.col("status").isin("invalidated", "expired")
    if as_of is not None:
        out = out & active_at(F.lit(as_of), F.col("valid_at"), F.col("invalid_at"))
    for k, v in (metadata or {}).items():
        out = out & (F.variant_get(F.col("metadata"), _path(k), "string") == v)
    return out


def _path(key: str) -> str:
    """The path of a key of a variant, whatever characters the key holds; it is a literal, never part of an expression."""
    if '"' not in key:
        return f'$["{key}"]'
    if "'" not in key:
        return f"$['{key}']"
    raise ValueError("a metadata key with both kinds of quotes")


def entities_by_id(entities: DataFrame, ids: list[str], who: Identity = Identity()) -> DataFrame:
    """Entities of the given ids that the caller may see."""
    own = entities.where(F.col("id").isin(ids) if ids else F.lit(False))
    return own.where(identity_filter(who) & visibility_gate(who))


def scope_matches(who: Identity) -> Column:
    """Does a record's scope fit the query's? Every id that both give must be equal; what either leaves open fits."""
    out = F.lit(True)
    for k, v in who.given().items():
        out = out & (F.col(f"{k}_id").isNull() | (F.col(f"{k}_id") == v))
    return out


def after(df: DataFrame, key: str, last, limit: int) -> DataFrame:
    """The next page of a full scan, by key."""
    return (df if last is None else df.where(F.col(key) > F.lit(last))).orderBy(key).limit(limit)


def filtered_entities(found: DataFrame, edges: DataFrame, kind: str | None = None, connections: int = 0) -> DataFrame:
    """A search's short list after its limit: of one type, with so many edges at least; the list is the broadcast side of the count."""
    kept = found if kind is None else found.where(F.col("type") == kind)
    if connections <= 0:
        return kept
    few = F.broadcast(kept.select("id"))
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).join(few, "id").groupBy("id").agg(F.count("*").alias("connections"))
    return kept.join(ends.where(F.col("connections") >= connections), "id")


def by_refs(chunks: DataFrame, refs: DataFrame, on: tuple[str, ...] = ("bucket_id", "source_id", "chunk_index")) -> DataFrame:
    """Chunks at the given points; an empty list of points gives none."""
    return chunks.join(refs.select(*on).distinct(), list(on), "left_semi")


def neighbours(chunks: DataFrame, refs: DataFrame, span: int) -> DataFrame:
    """Chunks within `span` places of the given ones, in the same source: an equality join on the exploded places."""
    near = refs.select("bucket_id", "source_id", F.explode(F.sequence(F.col("chunk_index") - span, F.col("chunk_index") + span)).alias("chunk_index")).distinct()
    return chunks.join(near, ["bucket_id", "source_id", "chunk_index"], "left_semi")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def contains_name(df: DataFrame, query: str, mentions: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """Entities whose name, an alias or a mention contains the query, whatever the case; by name and id."""
    q = query.lower()
    hit = F.contains(F.lower("name"), F.lit(q)) | F.coalesce(F.exists("aliases", lambda a: F.contains(F.lower(a), F.lit(q))), F.lit(False))
    if mentions is not None:
        found = mentions.where(F.contains(F.lower("surface_text"), F.lit(q))).select(F.col("entity_id").alias("id")).distinct().withColumn("__m", F.lit(True))
        df = df.join(found, "id", "left")
        hit = hit | F.col("__m").isNotNull()
    return df.where(hit).drop("__m").orderBy("name", "id").limit(limit)
