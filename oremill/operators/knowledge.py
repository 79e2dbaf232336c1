"""Building and searching the knowledge graph: triples to edges, profiles, subjects, scopes, graph-guided retrieval, jobs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oremill.functions import scoring as S
from oremill.operators import graph, ontology, retrieval

TYPE_PENALTY, COOCCURRENCE = 0.85, 0.3
#: How much of a profile is kept.
EVIDENCE, ACTIVITIES = 25, 10


def add_triples(triples: DataFrame, names: DataFrame, mismatched: DataFrame | None = None) -> DataFrame:
    """Triples (subject, predicate, object, confidence) to edges: relations normalised, swapped ones turned round, symmetric ones in
    one order, unknown relations and self-loops dropped, weights of mismatched types (predicate) cut, equal edges added up."""
    t = ontology.normalise(triples, names).where("valid AND subject <> object")
    turn = F.col("symmetric") & (F.col("subject") > F.col("object"))
    t = t.withColumn("source", F.when(turn, F.col("object")).otherwise(F.col("subject"))).withColumn("target", F.when(turn, F.col("subject")).otherwise(F.col("object")))
    weight = F.col("confidence")
    if mismatched is not None:
        t = t.join(mismatched.select("predicate").distinct().withColumn("__m", F.lit(True)), "predicate", "left")
        weight = F.when(F.col("__m"), weight * TYPE_PENALTY).otherwise(weight)
    return t.groupBy("source", F.col("predicate").alias("relation"), "target").agg(F.sum(weight).alias("weight"), F.count("*").alias("evidence_count"))


def contradicts(text, subject, relation, object_):
    """Does a text say the relation the other way round (object, relation, subject)?"""
    quote = lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))
    back = F.concat(F.lit("(?is)\\b"), quote(object_), F.lit("\\s+"), quote(F.replace(relation, F.lit("_"), F.lit(" "))), F.lit("\\s+"), quote(subject), F.lit("\\b"))
    return F.regexp_like(text, back)


def cooccurrence(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Weak edges for entities of a chunk (chunk_id, entity_id, position) without any edge: to the chunk's first entity, so their
    number is that of members, never of pairs."""
    linked = edges.select(F.explode(F.array("source", "target")).alias("entity_id")).distinct()
    lone = members.join(linked, "entity_id", "left_anti")
    first = members.groupBy("chunk_id").agg(F.min_by("entity_id", F.struct("position", "entity_id")).alias("hub"))
    pairs = lone.join(first, "chunk_id").where("entity_id <> hub")
    return pairs.select(F.least("hub", "entity_id").alias("source"), F.greatest("hub", "entity_id").alias("target")).distinct().withColumn("relation", F.lit("RELATED_TO")).withColumn("weight", F.lit(COOCCURRENCE))


def profiles(facts: DataFrame) -> DataFrame:
    """Per source entity: facts counted, the latest EVIDENCE fact ids, ACTIVITIES distinct relations, two sentences. facts: source, relation, content, id, at."""
    # the latest of each of 64 shares of a source's facts first, so that a hot source is no single task's
    shared = Window.partitionBy("source", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy(F.desc("at"), "id")
    few = facts.withColumn("n", F.row_number().over(shared)).where(F.col("n") <= EVIDENCE)
    top = few.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("at"), "id"))).where(F.col("n") <= EVIDENCE)
    kept = F.transform(F.sort_array(F.collect_list(F.struct("n", "id", "content", "relation"))), lambda s: s)
    g = top.groupBy("source").agg(kept.alias("k"))
    total = facts.groupBy("source").agg(F.count("*").alias("facts"))
    return g.join(total, "source").select(
        "source", "facts", F.array_join(F.transform("k", lambda s: s["id"].cast("string")), ",").alias("evidence"),
        F.array_join(F.slice(F.sort_array(F.array_distinct(F.transform("k", lambda s: s["relation"]))), 1, ACTIVITIES), ",").alias("activities"),
        F.array_join(F.slice(F.transform("k", lambda s: s["content"]), 1, 2), ". ").alias("description"),
    )


def subjects(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges from a source's subject entity to its first chunk."""
    first = chunks.where("chunk_index = 0").select("source_id", F.col("id").alias("target"))
    return sources.where("subject_id IS NOT NULL").join(first, "source_id").select(F.col("subject_id").alias("source"), "target", F.lit("PRIMARY_SOURCE_CHUNK").alias("relation"), F.lit(1.0).alias("weight"))


def mentions(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """Entities (id, name, aliases) found in chunks (chunk_id, words) by one-word names: an equality join on words."""
    names = entities.select(F.col("id").alias("entity_id"), F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.expr("cast(array() as array<string>)"))))).alias("surface_text"))
    words = chunks.select("chunk_id", F.explode(F.array_distinct("words")).alias("word"))
    return words.join(names, words.word == F.lower("surface_text")).select("entity_id", "chunk_id", "surface_text").distinct()


def upsert_mentions(old: DataFrame, new: DataFrame) -> DataFrame:
    """By entity, chunk and type: the new confidence and surface, the old ones where those are null."""
    keys = ["entity_id", "chunk_id", "mention_type"]
    both = old.withColumn("__n", F.lit(0)).unionByName(new.withColumn("__n", F.lit(1)))
    return both.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("__n", c))).alias(c) for c in ("confidence", "surface_text")))


def scope_chunks(entity_ids: DataFrame, external: DataFrame, wanted: DataFrame, entity_chunks: DataFrame) -> DataFrame:
    """chunk_id of every chunk at an entity given by id or by external id (type, value); either is enough."""
    ids = entity_ids.select("id").union(external.join(wanted, ["type", "value"], "left_semi").select(F.col("entity_id").alias("id"))).distinct()
    return entity_chunks.join(ids.withColumnRenamed("id", "entity_id"), "entity_id", "left_semi").select("chunk_id").distinct()


def graph_search(entity_edges: DataFrame, entity_chunks: DataFrame, seeds: DataFrame, dense: DataFrame, lexical: DataFrame, k: int, chunk_seed: float = 0.05, restart: float = 0.5, iterations: int = 50, fixed: bool = False) -> DataFrame:
    """Chunks by PageRank over the mixed graph of entities and chunks: seeds are entities (id, weight) and, lightly, the nearest chunks.

    dense, lexical: id, similarity and id, keyword of chunk candidates. The k best of ppr + 0.15 dense + 0.12 lexical."""
    links = entity_chunks.select(F.col("entity_id").alias("source"), F.col("chunk_id").alias("target"), "weight")
    adj = graph.adjacency(entity_edges.select("source", "target", "weight").unionByName(links))
    start = seeds.select("id", F.col("weight").cast("double")).unionByName(dense.select("id", (F.greatest(F.col("similarity"), F.lit(0.0)) * chunk_seed).alias("weight")))
    rank = graph.pagerank(adj, start, restart, iterations, fixed=fixed)
    chunks = links.select(F.col("target").alias("id")).distinct()
    top = rank.join(chunks, "id", "left_semi").orderBy(F.desc(F.round("score", 12)), "id").limit(3 * k)
    out = top.join(dense, "id", "left").join(lexical, "id", "left")
    final = F.col("score") + 0.15 * F.coalesce("similarity", F.lit(0.0)) + 0.12 * F.coalesce("keyword", F.lit(0.0))
    return out.select("id", F.round("score", 9).alias("ppr"), F.round(final, 9).alias("final")).where("final > 0").orderBy(F.desc("final"), "id").limit(k)


def explore(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Edges at anchors (id, score), scored anchor * confidence * log2(1 + weight); the better end counts."""
    a = anchors.select("id", F.col("score"))
    s, t = a.toDF("source", "__s"), a.toDF("target", "__t")
    both = edges.join(s, "source", "left").join(t, "target", "left").where("__s IS NOT NULL OR __t IS NOT NULL")
    anchor = F.greatest(F.coalesce("__s", F.lit(0.0)), F.coalesce("__t", F.lit(0.0)))
    return both.withColumn("explore", F.round(anchor * F.coalesce("confidence", F.lit(1.0)) * F.log2(1 + F.col("weight")), 6)).drop("__s", "__t")


def knowledge(entities: DataFrame, facts: DataFrame, query: str, k: int) -> DataFrame:
    """Entities and facts that match a query's words, without walking the graph: kind, id, score."""
    words = F.split(F.lit(query.lower()), " ")
    has = lambda c: S.overlap(words, F.split(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), " "))
    e = entities.select(F.lit("entity").alias("kind"), F.col("id").cast("string").alias("id"), F.round(has(F.col("name")), 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k)
    f = facts.select(F.lit("fact").alias("kind"), F.col("id").cast("string").alias("id"), F.round(has(F.col("content")), 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k)
    return e.unionByName(f)


def bucket_report(hits: DataFrame) -> DataFrame:
    """Results by bucket."""
    return hits.groupBy("bucket_id").agg(F.count("*").alias("n"), F.max("score").alias("best"))


def models(buckets: DataFrame) -> DataFrame:
    """Buckets grouped by the embedding model that their searches need."""
    return buckets.groupBy("embedding_model").agg(F.array_join(F.sort_array(F.collect_set("bucket_id")), ",").alias("buckets"))


def job_progress(jobs: DataFrame, steps: DataFrame) -> DataFrame:
    """Jobs (id, processed, total) after increments (id, n): summed, so concurrent ones don't overwrite each other."""
    done = steps.groupBy("id").agg(F.sum("n").alias("__n"))
    out = jobs.join(done, "id", "left").withColumn("processed", F.col("processed") + F.coalesce("__n", F.lit(0))).drop("__n")
    return out.withColumn("status", F.when(F.col("processed") >= F.col("total"), "completed").when(F.col("processed") > 0, "running").otherwise("pending"))


_ABBREVIATION = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St)\.$|\b[A-Z]\.$")


def sentences(text: str) -> list[str]:
    out: list[str] = []
    for part in re.split(r"(?<=[.!?])\s+(?=[A-Z\"'])", " ".join(text.split())):
        if out and _ABBREVIATION.search(out[-1]):
            out[-1] += f" {part}"
        elif part:
            out.append(part)
    return out


def merge_descriptions(old: str, new: str, most: int = 320) -> str:
    """At most two sentences of both, without near repeats (four fifths of the shorter one's words), within `most` characters."""
    kept: list[str] = []
    words = lambda s: set(re.sub("[^a-z0-9]+", " ", s.lower()).split())
    for s in sentences(old or "") + sentences(new or ""):
        w = words(s)
        if not w or any(len(w & words(k)) >= 0.8 * min(len(w), len(words(k))) for k in kept):
            continue
        if len(kept) == 2 or len(" ".join([*kept, s])) > most:
            if not kept:
                kept = [s[:most].rsplit(" ", 1)[0]]
            break
        kept.append(s)
    return " ".join(kept)


def top_edges(edges: DataFrame, entity: str, k: int = 20) -> DataFrame:
    """An entity's heaviest edges, either way."""
    return edges.where((F.col("source") == entity) | (F.col("target") == entity)).orderBy(F.desc("weight"), "edge_id").limit(k)


def dense_candidates(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    return retrieval.semantic_topk(vectors, query, k).select("id", "similarity")
