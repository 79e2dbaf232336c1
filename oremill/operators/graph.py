"""Graph operators over edges (source, target, relation, weight) and entities (id, type).

Iterations write their state to the shared folder and read it back: lineage stays short, a lost executor costs a stage,
and adaptive execution sees real sizes and splits hot vertices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oremill.plans.scratch import drop, store

#: Of synonym_pairs: numbers in a block's vectors, and rows on each side of a tile.
BLOCK_VALUES, TILE = 1 << 20, 1024


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions, parallel edges summed: source, target, weight."""
    both = edges.select("source", "target", "weight").union(edges.select(F.col("target"), F.col("source"), F.col("weight")))
    return both.groupBy("source", "target").agg(F.sum("weight").alias("weight"))


def adjacency(edges: DataFrame) -> DataFrame:
    """undirected with damped weights, log2(1 + w)."""
    return undirected(edges).withColumn("weight", F.log2(1.0 + F.col("weight")))


def pagerank(adj: DataFrame, seeds: DataFrame, restart: float = 0.5, iterations: int = 50, tolerance: float = 1e-6, least: float = 1e-10, fixed: bool = False) -> DataFrame:
    """Personalised PageRank from weighted seeds (id, weight): id, score. Mass at vertices without edges is dropped.

    A step is one join and one aggregation; the scores of the step before are dropped. fixed: run all iterations."""
    some = adj.where("weight > 0")
    # out-weights by partial sums and a join: a window would put all edges of a hot vertex in one task
    total = some.groupBy("source").agg(F.sum("weight").alias("total"))
    shares = store(some.join(total, "source").select("source", "target", (F.col("weight") / F.col("total")).alias("share")), "shares")
    positive = seeds.where("weight > 0")
    mass = positive.agg(F.sum("weight")).first()[0]
    if not mass:
        return positive.select("id", F.col("weight").alias("score")).limit(0)
    reset = store(positive.groupBy("id").agg((F.sum("weight") / mass).alias("reset")), "reset")
    scores = reset.select("id", F.col("reset").alias("score"))
    for _ in range(iterations):
        flow = scores.join(shares, scores.id == shares.source).groupBy(F.col("target").alias("id")).agg(F.sum(F.col("score") * F.col("share") * (1 - restart)).alias("flow"))
        new = flow.join(reset, "id", "full").select("id", (F.coalesce("flow", F.lit(0.0)) + restart * F.coalesce("reset", F.lit(0.0))).alias("score"))
        new = store(new, "ppr")
        if not fixed:
            moved = new.join(scores.withColumnRenamed("score", "old"), "id", "full").agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0]
            if (moved or 0.0) < tolerance:
                scores = new
                break
        drop(scores)
        scores = new
    return scores.where(F.col("score") > least)


def _step(edges: DataFrame, frontier: DataFrame, direction: str = "both") -> DataFrame:
    """parent, id of the edges that leave the frontier: a join for each direction, so that edges are neither doubled nor deduplicated."""
    at = frontier.select(F.col("id").alias("parent"))
    out = edges.select(F.col("source").alias("parent"), F.col("target").alias("id")).join(at, "parent")
    into = edges.select(F.col("target").alias("parent"), F.col("source").alias("id")).join(at, "parent")
    return out if direction == "out" else into if direction == "in" else out.unionByName(into)


def khop(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "both") -> DataFrame:
    """id and depth (0 for seeds) of all vertices within `depth` steps, nearest depth first."""
    seen = store(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "frontier")
    frontier = seen
    for d in range(1, depth + 1):
        reached = _step(edges, frontier, direction).select("id").distinct()
        frontier = store(reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(d)), "frontier")
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return seen


def subgraph(edges: DataFrame, seeds: DataFrame, depth: int, types: list[str] | None = None, entities: DataFrame | None = None, relations: list[str] | None = None, least_weight: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices within `depth` steps, filtered, and the edges with both ends among them."""
    nodes = khop(edges, seeds, depth)
    if types is not None and entities is not None:
        nodes = nodes.join(entities.where(F.col("type").isin(types)).select("id"), "id", "left_semi")
    kept = edges
    if relations is not None:
        kept = kept.where(F.col("relation").isin(relations))
    if least_weight is not None:
        kept = kept.where(F.col("weight") >= least_weight)
    ends = nodes.select("id")
    kept = kept.join(ends.withColumnRenamed("id", "source"), "source", "left_semi").join(ends.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes, kept


def shortest_path(edges: DataFrame, start: str, end: str, most: int = 5) -> DataFrame:
    """step, id along one undirected shortest path of at most `most` edges (the smallest parent at every step); empty if there is none."""
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start, None, 0)], "id string, parent string, depth int")
    frontier = seen
    for d in range(1, most + 1):
        if not seen.where(F.col("id") == end).isEmpty():
            break
        near = _step(edges, frontier).groupBy("id").agg(F.min("parent").alias("parent"))
        frontier = store(near.join(seen, "id", "left_anti").withColumn("depth", F.lit(d)), "path")
        seen = seen.unionByName(frontier)
    path, at = [], end
    while at is not None and (row := seen.where(F.col("id") == at).first()):  # `most` lookups
        path.append((row["depth"], at))
        at = row["parent"]
    return spark.createDataFrame(sorted(path), "step int, id string")


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """id and component (its smallest id): labels spread to neighbours and jump to their label's label until none changes."""
    steps = store(edges.select("source", "target").union(edges.select(F.col("target"), F.col("source"))).distinct(), "steps")
    ids = steps.select(F.col("source").alias("id")).distinct()
    if nodes is not None:
        ids = ids.union(nodes.select("id")).distinct()
    labels = store(ids.withColumn("component", F.col("id")), "labels")
    while True:
        near = steps.join(labels.withColumnRenamed("id", "target"), "target").groupBy(F.col("source").alias("id")).agg(F.min("component").alias("near"))
        spread = store(labels.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("to")), "spread")
        jump = spread.select(F.col("id").alias("to"), F.col("to").alias("next"))
        new = store(spread.join(jump, "to", "left").select("id", "old", F.coalesce("next", "to").alias("component")), "labels")
        if new.where("component <> old").isEmpty():
            return new.select("id", "component")
        drop(labels, spread)
        labels = store(new.select("id", "component"), "labels")
        drop(new)


def degree(edges: DataFrame) -> DataFrame:
    """id and the number of distinct edges at it (edges need an id)."""
    ends = edges.select("edge_id", F.explode(F.array("source", "target")).alias("id"))
    return ends.groupBy("id").agg(F.count_distinct("edge_id").alias("degree"))


def degree_distribution(edges: DataFrame) -> DataFrame:
    """degree, n: out- and in-degrees are observations of their own."""
    out, into = edges.groupBy("source").count(), edges.groupBy("target").count()
    return out.select("count").union(into.select("count")).groupBy(F.col("count").alias("degree")).agg(F.count("*").alias("n"))


def frequency(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def stats(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: entities, edges, relations, types and edges per entity."""
    e = edges.agg(F.count("*").alias("edges"), F.count_distinct("relation").alias("relations"))
    return entities.agg(F.count("*").alias("entities"), F.count_distinct("type").alias("types")).crossJoin(e).withColumn("edges_per_entity", F.round(F.col("edges") / F.greatest(F.col("entities"), F.lit(1)), 2))


def fact_chains(facts: DataFrame, k: int, among: int = 16) -> DataFrame:
    """Ordered pairs of the best facts (id, source, target, content, score) that share an entity; the first of four tests
    that holds gives the bonus; equal contents once."""
    top = facts.orderBy(F.desc("score"), "id").limit(among)
    a, b = top.alias("a"), top.alias("b")
    tests = (("a.target", "b.source", 1.5), ("a.source", "b.target", 1.25), ("a.source", "b.source", 0.5), ("a.target", "b.target", 0.5))
    bonus = F.coalesce(*(F.when(F.col(x) == F.col(y), w) for x, y, w in tests))
    pairs = a.join(F.broadcast(b), (F.col("a.id") != F.col("b.id")) & bonus.isNotNull())  # `among` rows on each side
    chains = pairs.select(F.col("a.id").alias("first"), F.col("b.id").alias("second"), F.concat_ws("; ", "a.content", "b.content").alias("content"), F.round(F.col("a.score") + F.col("b.score") + bonus, 6).alias("score"))
    key = F.trim(F.regexp_replace(F.lower("content"), "[^a-z0-9]+", " "))
    once = chains.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "first", "second"))).where("__n = 1").drop("__n")
    return once.orderBy(F.desc("score"), "first", "second").limit(k)


def rerank_facts(facts: DataFrame, query_tokens: list[str]) -> DataFrame:
    """Facts (id, source_name, relation, target_name, content, similarity) by meaning, words, anchors and relation; repeats pay 0.2 each."""
    q = F.array(*map(F.lit, query_tokens)) if query_tokens else F.array().cast("array<string>")
    words = lambda c: F.split(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), " ")
    part = lambda c: F.size(F.array_intersect(q, words(c))) / F.greatest(F.size(q), F.lit(1))
    again = (F.row_number().over(Window.partitionBy("source_name", "relation", "target_name", "content").orderBy("id")) - 1) * 0.2
    score = 0.45 * F.greatest(F.coalesce("similarity", F.lit(0.0)), F.lit(0.0)) + 0.28 * part(F.col("content")) + 0.22 * F.greatest(part(F.col("source_name")), part(F.col("target_name"))) + 0.05 * part(F.replace(F.col("relation"), F.lit("_"), F.lit(" "))) - again
    return facts.withColumn("score", F.round(score, 6))


def mention_edges(mentions: DataFrame) -> DataFrame:
    """Mentions (entity_id, chunk_id, confidence, surface_text, mention_type) to weighted entity-chunk edges."""
    g = mentions.groupBy("entity_id", "chunk_id").agg(
        F.count("*").alias("mentions"), F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.array_size(F.collect_set(F.lower(F.trim("surface_text")))).alias("surfaces"), F.array_size(F.collect_set("mention_type")).alias("types")
    )
    sure = F.when(F.col("confidence") > 0, F.col("confidence")).otherwise(0.75)
    return g.withColumn("weight", F.round(F.least(F.lit(3.0), 0.5 + F.log2(1.0 + F.col("mentions")) * sure), 6))


def edge_matches(sources: list[str], targets: list[str], predicates: list[str], symmetric: list[str]) -> Column:
    """Does an edge answer an intent? Symmetric relations match either way round."""
    ok = F.col("relation").isin(predicates) if predicates else F.lit(True)
    one = (F.col("source").isin(sources) if sources else F.lit(True)) & (F.col("target").isin(targets) if targets else F.lit(True))
    other = (F.col("target").isin(sources) if sources else F.lit(True)) & (F.col("source").isin(targets) if targets else F.lit(True))
    return ok & (one | (F.col("relation").isin(symmetric) & other))


def synonym_pairs(vectors: DataFrame, threshold: float = 0.85, blocks: int = 8, dims: int = 64, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """a < b with a cosine of at least the threshold: exact, by blocks.

    Rows are dealt into blocks of about BLOCK_VALUES numbers (`dims` a row), into `blocks` at least; each pair of blocks is one group,
    whose two matrices are multiplied tile by tile. A task holds two blocks, a tile's scores and its pairs, however many rows
    or copies there are; the work and the pairs are quadratic."""
    blocks = max(blocks, -(-vectors.count() * dims // BLOCK_VALUES))
    own = vectors.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("block"))
    # a row goes to every pair of blocks that its own is in
    cells = own.select("id", "v", "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")).select("id", "v", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    tile = TILE

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = (k.as_py() for k in key)
        rows = pa.Table.from_batches(batches)
        ids, block = rows["id"].to_numpy(), rows["block"].to_numpy()
        v = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in rows["v"].chunks]).astype(np.float64).reshape(len(ids), -1)
        del rows
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        for p in range(0, len(left), tile):
            for q in range(p if i == j else 0, len(right), tile):
                x, y = left[p : p + tile], right[q : q + tile]
                s = v[x] @ v[y].T
                m, n = np.nonzero(s >= threshold - 1e-6)
                s, a, b = np.round(s[m, n], 6), ids[x[m]], ids[y[n]]
                # two tiles of one block meet once, a tile meets itself both ways round
                keep = (s >= threshold) & ((a < b) if i == j and p == q else (a != b))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep]), pa.array(s[keep])], ["a", "b", "similarity"])

    return cells.groupBy("i", "j").applyInArrow(run, "a long, b long, similarity double")
