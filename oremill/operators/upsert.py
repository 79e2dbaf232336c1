"""Upserts, cascades and merges as set operations: old rows and new rows in, the table's next version out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGE_CAP = 5.0


def keyed(old: DataFrame, new: DataFrame, keys: list[str], seq: str = "seq", keep_old: tuple[str, ...] = (), coalesce: tuple[str, ...] = ()) -> DataFrame:
    """The last writer by `seq` wins; keep_old columns stay as they were first; coalesce columns take the last that isn't null."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    order = F.struct("__new", seq)
    rest = [c for c in both.columns if c not in (*keys, "__new")]
    picked = []
    for c in rest:
        if c in keep_old:
            picked.append(F.min_by(c, order).alias(c))
        elif c in coalesce:
            picked.append(F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c))
        else:
            picked.append(F.max_by(c, order).alias(c))
    return both.groupBy(*keys).agg(*picked)


def sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """By (bucket, tenant or '', content_hash): the existing id stays; was_created says whether there was none."""
    key = ["bucket_id", "tenant_key", "content_hash"]
    tenant = F.coalesce("tenant_id", F.lit(""))
    had = old.withColumn("tenant_key", tenant).groupBy(*key).agg(F.min("id").alias("__old"))
    fresh = new.withColumn("tenant_key", tenant).groupBy(*key).agg(F.max_by(F.struct(*[c for c in new.columns if c not in key]), F.col("seq")).alias("r")).select(*key, "r.*")
    return fresh.join(had, key, "left").withColumn("was_created", F.col("__old").isNull()).withColumn("id", F.coalesce("__old", "id")).drop("__old", "tenant_key")


def semantic_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Weights add up, without a cap; the earliest valid_at; an edge seen again is valid again."""
    return old.unionByName(new).groupBy("source", "target", "relation").agg(F.sum("weight").alias("weight"), F.min("valid_at").alias("valid_at"))


def graph_edges(old: DataFrame, new: DataFrame, cap: float = EDGE_CAP) -> DataFrame:
    """Weights add up to the cap (a single heavier first edge stays); evidence is united.

    With weights of at least 0, capping each step is capping the sum."""
    both = old.unionByName(new)
    g = both.groupBy("source", "target", "relation").agg(F.sum("weight").alias("total"), F.count("*").alias("n"))
    weight = F.when(F.col("n") == 1, F.col("total")).otherwise(F.least(F.lit(cap), F.col("total")))
    # each piece of evidence once: the set is made in the tasks first, and holds distinct values only
    proof = both.select("source", "target", "relation", F.explode("evidence").alias("e")).where("e <> ''").groupBy("source", "target", "relation").agg(F.sort_array(F.collect_set("e")).alias("evidence"))
    out = g.select("source", "target", "relation", weight.alias("weight")).join(proof, ["source", "target", "relation"], "left")
    return out.withColumn("evidence", F.coalesce("evidence", F.expr("cast(array() as array<string>)")))


def facts(old: DataFrame, new: DataFrame) -> DataFrame:
    """By edge: the greatest weight and evidence count, the latest text."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.groupBy("edge_id").agg(F.min_by("id", F.struct("__new", "id")).alias("id"), F.max_by("fact_text", F.struct("__new", "id")).alias("fact_text"), F.max("weight").alias("weight"), F.max("evidence_count").alias("evidence_count"))


def chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """By (source, chunk_index): new wins, and places beyond a source's new end go (total_chunks)."""
    total = new.groupBy("source_id").agg(F.max("total_chunks").alias("__end"))
    both = keyed(old, new, ["source_id", "chunk_index"])
    return both.join(total, "source_id", "left").where(F.col("__end").isNull() | (F.col("chunk_index") < F.col("__end"))).drop("__end")


def unchanged(batch: DataFrame, hashes: DataFrame) -> DataFrame:
    """batch with skip: the stored content hash, model and chunk count are all the same."""
    known = hashes.select("store_key", F.col("content_hash").alias("__h"), F.col("embedding_model").alias("__m"), F.col("chunk_count").alias("__n"))
    same = (F.col("content_hash") == F.col("__h")) & (F.col("embedding_model") == F.col("__m")) & (F.col("chunk_count") == F.col("__n"))
    return batch.join(known, "store_key", "left").withColumn("skip", F.coalesce(same, F.lit(False))).drop("__h", "__m", "__n")


def delete_cascade(gone: DataFrame, tables: dict[str, tuple[DataFrame, str, str]]) -> dict[str, DataFrame]:
    """Each table without the rows of the gone keys; tables: name -> (table, its column, gone's column)."""
    out = {}
    for name, (table, own, of) in tables.items():
        keys = gone.select(F.col(of).alias(own)).distinct()
        out[name] = table.join(keys, own, "left_anti")
    return out


def patch(table: DataFrame, patches: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Non-null patch values replace; used for sources and, for visibility, for their chunks."""
    p = patches.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    out = table.join(p, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"__{c}", c)).drop(f"__{c}")
    return out


def merge_entities(edges: DataFrame, merges: DataFrame, cap: float = EDGE_CAP) -> DataFrame:
    """Edges with merged ids (merges: old_id, new_id) rewritten, collapsed by key with capped sums, self-loops invalid."""
    m = merges.select("old_id", "new_id")
    out = edges
    for end in ("source", "target"):
        out = out.join(m.toDF(end, "__to"), end, "left").withColumn(end, F.coalesce("__to", end)).drop("__to")
    g = out.groupBy("source", "target", "relation").agg(F.sum("weight").alias("total"), F.count("*").alias("n"))
    weight = F.when(F.col("n") == 1, F.col("total")).otherwise(F.least(F.lit(cap), F.col("total")))
    return g.select("source", "target", "relation", weight.alias("weight"), (F.col("source") != F.col("target")).alias("valid"))


def delete_entities(edges: DataFrame, gone: DataFrame, purge: bool) -> DataFrame:
    """invalidate: edges at gone ids become invalid; purge: they go."""
    ids = gone.select("id").distinct()
    if purge:
        return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").join(ids.withColumnRenamed("id", "target"), "target", "left_anti")
    marks = ids.withColumn("__x", F.lit(True))
    out = edges.join(marks.toDF("source", "__s"), "source", "left").join(marks.toDF("target", "__t"), "target", "left")
    return out.withColumn("valid", F.col("valid") & F.col("__s").isNull() & F.col("__t").isNull()).drop("__s", "__t")


def invalidate_edges(edges: DataFrame, at: Column, ids: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Edges (edge_id, source, target, invalid_at) with the given ids, or at the given nodes (id), end at a time unless they have ended."""
    mark = F.lit(True)
    out = edges
    for column, keys in (("edge_id", ids), ("source", nodes), ("target", nodes)):
        if keys is not None:
            out = out.join(keys.select(F.col("id").alias(column)).distinct().withColumn(f"__{column}", mark), column, "left")
    marks = [c for c in out.columns if c.startswith("__")]
    hit = F.coalesce(*marks, F.lit(False)) if marks else F.lit(False)
    return out.withColumn("invalid_at", F.when(hit & F.col("invalid_at").isNull(), at).otherwise(F.col("invalid_at"))).drop(*marks)


def merge_properties(old: Column, new: Column) -> Column:
    """Shallow merge of two maps: the new one's keys win."""
    kept = F.map_filter(F.coalesce(old, F.expr("cast(map() as map<string,string>)")), lambda k, v: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    return F.map_concat(kept, F.coalesce(new, F.expr("cast(map() as map<string,string>)")))


def delete_hashes(hashes: DataFrame, keys: DataFrame | None = None, bucket: str | None = None, tenant: str | None = None) -> DataFrame:
    """Hashes without those of the given store keys, or of a bucket (of one tenant, or of all)."""
    if keys is not None:
        return hashes.join(keys.select("store_key").distinct(), "store_key", "left_anti")
    if bucket is None:
        raise ValueError("keys or a bucket are needed")
    gone = F.col("bucket_id") == bucket
    return hashes.where(~F.coalesce(gone if tenant is None else gone & (F.col("tenant_id") == tenant), F.lit(False)))


def with_external_ids(entities: DataFrame, external: DataFrame) -> DataFrame:
    """Entities with the sorted list of their external ids (type:value), each once."""
    lists = external.groupBy(F.col("entity_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws(":", "type", "value"))), ",").alias("external_ids"))
    return entities.join(lists, "id", "left").withColumn("external_ids", F.coalesce("external_ids", F.lit("")))


def conflicts(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """External ids of `new` that another entity owns already, or that two new entities claim."""
    owners = old.unionByName(new).groupBy(*keys).agg(F.count_distinct("entity_id").alias("owners"), F.min("entity_id").alias("first"))
    return owners.where("owners > 1")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
