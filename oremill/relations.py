"""The engine's relations, derived from the driver's tables; and the same as SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = dt.datetime(2024, 2, 1)
EPOCH = 1_704_067_200  # 2024-01-01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk a document: bucket from its source, tenant from its language; visibility from its label."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    vis = F.when(F.col("quality") == 1, F.lit(None).cast("string")).when(F.col("quality") == 0, "tenant").otherwise("user")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("source_id"), F.col("source").alias("bucket_id"), F.col("lang").alias("tenant_id"),
        F.concat(F.lit("u"), F.col("doc_id") % 7).alias("user_id"), (F.col("doc_id") % 5).cast("int").alias("chunk_index"), F.col("text").alias("content"), vis.alias("visibility"),
    )


CHUNKS = """chunks AS (SELECT doc_id AS id, CAST(doc_id AS VARCHAR) AS source_id, source AS bucket_id, lang AS tenant_id, 'u' || (doc_id % 7) AS user_id,
  CAST(doc_id % 5 AS INTEGER) AS chunk_index, text AS content, CASE WHEN quality = 1 THEN NULL WHEN quality = 0 THEN 'tenant' ELSE 'user' END AS visibility
  FROM documents LEFT JOIN (SELECT doc_id, quality FROM labels) USING (doc_id))"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("bucket"), "embedding")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


VECTORS = """vec AS (SELECT vec_id AS id, label AS bucket, embedding, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]),
  (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS similarity FROM embeddings)"""


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    second = F.lit(EPOCH) + F.col("conv_id") * 3600 + F.col("turn") * 60
    created = F.timestamp_seconds(second)
    kind = F.when(F.col("role") == "user", "episodic").when(F.col("role") == "assistant", "semantic").otherwise("procedural")
    state = (F.col("conv_id") + F.col("turn")) % 10
    status = F.when(state == 0, "invalidated").when(state == 1, "consolidated").when(state == 2, "archived").otherwise("active")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), kind.alias("category"), status.alias("status"), F.col("text").alias("content"), F.col("conv_id").alias("conversation_id"),
        (F.length("text") % 100 / 100.0).alias("importance"), (F.col("turn") % 7).alias("access_count"), created.alias("created_at"), F.timestamp_seconds(second + F.col("turn") * 86_400).alias("last_accessed_at"),
        created.alias("valid_at"), F.when(state == 0, F.timestamp_seconds(second + 86_400)).alias("invalid_at"),
    )


MEMORIES = f"""memories AS (SELECT conv_id * 1000 + turn AS id, CASE role WHEN 'user' THEN 'episodic' WHEN 'assistant' THEN 'semantic' ELSE 'procedural' END AS category,
  CASE (conv_id + turn) % 10 WHEN 0 THEN 'invalidated' WHEN 1 THEN 'consolidated' WHEN 2 THEN 'archived' ELSE 'active' END AS status, text AS content, conv_id AS conversation_id,
  (length(text) % 100) / 100.0 AS importance, turn % 7 AS access_count, {EPOCH} + conv_id * 3600 + turn * 60 AS created_s, {EPOCH} + conv_id * 3600 + turn * 60 + turn * 86400 AS accessed_s,
  CASE WHEN (conv_id + turn) % 10 = 0 THEN {EPOCH} + conv_id * 3600 + turn * 60 + 86400 END AS invalid_s FROM conversations),
 decayed AS (SELECT *, round(0.4 * exp(-ln(2) / 604800.0 * greatest(1706745600 - accessed_s, 0)) + 0.4 * greatest(0, least(1, importance)) + 0.2 * least(1.0, ln(1.0 + access_count) / ln(100)), 6) AS decay FROM memories)"""


def edges(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("LOCATED_IN", "PLACED_BY", "CONTAINS", "SUPPLIED_BY")) -> DataFrame:
    """edge_id, source, target, relation, weight; parallel edges stay apart."""
    name = lambda p, c: F.concat(F.lit(f"{p}:"), F.col(c).cast("string"))
    parts = []
    if "LOCATED_IN" in kinds:
        parts.append(table(spark, sf_dir, "customer").select(name("cn", "c_custkey").alias("edge_id"), name("cust", "c_custkey").alias("source"), name("nation", "c_nationkey").alias("target"), F.lit("LOCATED_IN").alias("relation"), F.lit(1.0).alias("weight")))
    if "PLACED_BY" in kinds:
        parts.append(table(spark, sf_dir, "orders").select(name("oc", "o_orderkey").alias("edge_id"), name("ord", "o_orderkey").alias("source"), name("cust", "o_custkey").alias("target"), F.lit("PLACED_BY").alias("relation"), F.lit(1.0).alias("weight")))
    lines = table(spark, sf_dir, "lineitem")
    if "CONTAINS" in kinds:
        parts.append(lines.select(F.concat(name("op", "l_orderkey"), F.lit(":"), F.col("l_linenumber").cast("string")).alias("edge_id"), name("ord", "l_orderkey").alias("source"), name("part", "l_partkey").alias("target"), F.lit("CONTAINS").alias("relation"), F.col("l_quantity").alias("weight")))
    if "SUPPLIED_BY" in kinds:
        pairs = lines.groupBy("l_partkey", "l_suppkey").agg(F.count("*").cast("double").alias("weight"))
        parts.append(pairs.select(F.concat(name("ps", "l_partkey"), F.lit(":"), F.col("l_suppkey").cast("string")).alias("edge_id"), name("part", "l_partkey").alias("source"), name("supp", "l_suppkey").alias("target"), F.lit("SUPPLIED_BY").alias("relation"), "weight"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


EDGES = """edges AS (SELECT 'cn:' || c_custkey AS edge_id, 'cust:' || c_custkey AS source, 'nation:' || c_nationkey AS target, 'LOCATED_IN' AS relation, 1.0::DOUBLE AS weight FROM customer
  UNION ALL SELECT 'oc:' || o_orderkey, 'ord:' || o_orderkey, 'cust:' || o_custkey, 'PLACED_BY', 1.0 FROM orders
  UNION ALL SELECT 'op:' || l_orderkey || ':' || l_linenumber, 'ord:' || l_orderkey, 'part:' || l_partkey, 'CONTAINS', l_quantity FROM lineitem
  UNION ALL SELECT 'ps:' || l_partkey || ':' || l_suppkey, 'part:' || l_partkey, 'supp:' || l_suppkey, 'SUPPLIED_BY', count(*)::DOUBLE FROM lineitem GROUP BY l_partkey, l_suppkey)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, prefix, key, label, kind in (("customer", "cust", "c_custkey", "c_name", "person"), ("nation", "nation", "n_nationkey", "n_name", "location"), ("part", "part", "p_partkey", "p_name", "product"), ("supplier", "supp", "s_suppkey", "s_name", "organization")):
        one = table(spark, sf_dir, name).select(F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string")).alias("id"), F.col(label).alias("name"), F.lit(kind).alias("type"))
        out = one if out is None else out.unionByName(one)
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("ord:"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"), F.lit("document").alias("type"))
    return out.unionByName(orders)


ENTITIES = """entities AS (SELECT 'cust:' || c_custkey AS id, c_name AS name, 'person' AS type FROM customer UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'location' FROM nation
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'product' FROM part UNION ALL SELECT 'supp:' || s_suppkey, s_name, 'organization' FROM supplier
  UNION ALL SELECT 'ord:' || o_orderkey, 'order ' || o_orderkey, 'document' FROM orders)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and type, each event is valid until the next one."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    nxt = F.lead("ts").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return e.select("event_id", "user_id", "event_type", F.col("ts").alias("valid_at"), nxt.alias("invalid_at"))


INTERVALS = "intervals AS (SELECT event_id, user_id, event_type, ts AS valid_at, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS invalid_at FROM events)"
