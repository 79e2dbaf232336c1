"""Queries of building and searching the knowledge graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from oremill import relations as R
from oremill.functions import text as X
from oremill.operators import knowledge, ontology, retrieval, upsert
from oremill.queries import query

_T = "t AS (SELECT 's' || (l_suppkey % 50) AS s, 'p' || (l_partkey % 50) AS o, l_discount AS c, l_linenumber % 4 AS k FROM lineitem)"


@query(f"""WITH {_T}, e AS (SELECT CASE k WHEN 0 THEN o WHEN 1 THEN least(s, o) ELSE s END AS source, CASE k WHEN 0 THEN 'FOUNDED' WHEN 1 THEN 'PARTNERED_WITH' ELSE 'USES' END AS relation, CASE k WHEN 0 THEN s WHEN 1 THEN greatest(s, o) ELSE o END AS target, CASE WHEN k = 2 THEN c * 0.85 ELSE c END AS c FROM t WHERE k < 3)
  SELECT source, relation, target, round(sum(c), 6) AS weight, count(*) AS evidence_count FROM e GROUP BY source, relation, target""")
def add_triples(spark, sf_dir):
    k = F.col("l_linenumber") % 4
    p = F.when(k == 0, "founded by").when(k == 1, "collaborated with").when(k == 2, "USES").otherwise("HAS")
    t = R.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey") % 50).alias("subject"), p.alias("predicate"), F.concat(F.lit("p"), F.col("l_partkey") % 50).alias("object"), F.col("l_discount").alias("confidence"))
    bad = spark.createDataFrame([("USES",)], "predicate string")
    return knowledge.add_triples(t, ontology.table(spark), bad).withColumn("weight", F.round("weight", 6))


@query("""WITH m AS (SELECT DISTINCT 'o' || l_orderkey AS c, 'p' || l_partkey AS e, l_linenumber AS n FROM lineitem), linked AS (SELECT 'p' || l_partkey AS e FROM lineitem WHERE l_partkey % 3 = 0),
  h AS (SELECT c, e AS hub FROM m QUALIFY row_number() OVER (PARTITION BY c ORDER BY n, e) = 1)
  SELECT DISTINCT least(hub, e) AS source, greatest(hub, e) AS target, 'RELATED_TO' AS relation, 0.3::DOUBLE AS weight FROM m JOIN h USING (c) WHERE e NOT IN (SELECT e FROM linked) AND e <> hub""")
def cooccurrence(spark, sf_dir):
    lines = R.table(spark, sf_dir, "lineitem")
    m = lines.select(F.concat(F.lit("o"), "l_orderkey").alias("chunk_id"), F.concat(F.lit("p"), "l_partkey").alias("entity_id"), F.col("l_linenumber").alias("position"))
    e = lines.where("l_partkey % 3 = 0").select(F.concat(F.lit("p"), "l_partkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"))
    return knowledge.cooccurrence(m, e)


@query("""WITH f AS (SELECT 'c' || o_custkey AS source, CASE o_orderkey % 3 WHEN 0 THEN 'BUYS' WHEN 1 THEN 'RETURNS' ELSE 'ASKS' END AS relation, o_orderkey AS id, o_orderdate AS placed, 'order ' || o_orderkey AS content FROM orders),
  t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY placed DESC, id) AS n, count(*) OVER (PARTITION BY source) AS facts FROM f QUALIFY n <= 25)
  SELECT source, facts, string_agg(CAST(id AS VARCHAR), ',' ORDER BY n) AS evidence, string_agg(DISTINCT relation, ',' ORDER BY relation) AS activities, string_agg(content, '. ' ORDER BY n) FILTER (n <= 2) AS description FROM t GROUP BY source, facts""")
def entity_profiles(spark, sf_dir):
    o = R.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 3
    f = o.select(F.concat(F.lit("c"), "o_custkey").alias("source"), F.when(k == 0, "BUYS").when(k == 1, "RETURNS").otherwise("ASKS").alias("relation"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.concat(F.lit("order "), "o_orderkey").alias("content"))
    return knowledge.profiles(f)


@query("SELECT 'cust:' || o_custkey AS source, o_orderkey * 10 AS target, 'PRIMARY_SOURCE_CHUNK' AS relation, 1.0::DOUBLE AS weight FROM orders WHERE o_custkey % 2 = 0")
def source_subjects(spark, sf_dir):
    o = R.table(spark, sf_dir, "orders")
    s = o.select(F.col("o_orderkey").alias("source_id"), F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("cust:"), "o_custkey")).alias("subject_id"))
    c = o.select(F.col("o_orderkey").alias("source_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_index")).withColumn("id", F.col("source_id") * 10 + F.col("chunk_index"))
    return knowledge.subjects(s, c)


_NAMES = ["nicht", "thing", "thble"]


@query(r"""WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents) SELECT 'e:' || n AS entity_id, doc_id AS chunk_id, n AS surface_text FROM w, (VALUES ('Nicht'), ('Thing'), ('Thble')) v(n) WHERE list_contains(w, lower(n))""")
def mention_build(spark, sf_dir):
    e = spark.createDataFrame([(f"e:{n.title()}", n.title(), None) for n in _NAMES], "id string, name string, aliases array<string>")
    d = R.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), X.tokens(F.col("text")).alias("words"))
    return knowledge.mentions(e, d)


@query("""SELECT l_partkey AS entity_id, l_orderkey AS chunk_id, l_linestatus AS mention_type, max(CASE WHEN l_linenumber > 2 THEN l_discount END) IS NOT NULL AS fresh, coalesce(max(CASE WHEN l_linenumber > 2 THEN l_discount END), max(CASE WHEN l_linenumber <= 2 THEN l_discount END)) AS confidence FROM lineitem GROUP BY 1, 2, 3""")
def mention_upsert(spark, sf_dir):
    m = R.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("chunk_id"), F.col("l_linestatus").alias("mention_type"), F.col("l_discount").alias("confidence"), F.lit(None).cast("string").alias("surface_text"), "l_linenumber")
    old = m.where("l_linenumber <= 2").drop("l_linenumber").withColumn("surface_text", F.lit("old"))
    new = m.where("l_linenumber > 2").drop("l_linenumber").withColumn("surface_text", F.lit("new"))
    return knowledge.upsert_mentions(old, new).select("entity_id", "chunk_id", "mention_type", (F.col("surface_text") == "new").alias("fresh"), "confidence")


@query("SELECT DISTINCT l_orderkey AS chunk_id FROM lineitem WHERE l_partkey IN (3, 5) OR l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#7' AND p_size < 10)")
def entity_scope(spark, sf_dir):
    part = R.table(spark, sf_dir, "part")
    external = part.select(F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("type"), F.when(F.col("p_size") < 10, "small").otherwise("large").alias("value"))
    ids = spark.createDataFrame([(3,), (5,)], "id long")
    wanted = spark.createDataFrame([("Brand#7", "small")], "type string, value string")
    links = R.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("chunk_id"))
    return knowledge.scope_chunks(ids, external, wanted, links)


def _search_sql(steps: int, k: int) -> str:
    out = f"""WITH {R.VECTORS}, ee AS (SELECT 'supp:' || l_suppkey AS source, 'part:' || l_partkey AS target, l_quantity AS weight FROM lineitem WHERE l_linenumber = 1),
  ec AS (SELECT 'part:' || l_partkey AS source, 'chunk:' || l_orderkey AS target, l_discount * 10 AS weight FROM lineitem), pair AS (SELECT * FROM ee UNION ALL SELECT * FROM ec),
  u AS (SELECT source, target, log2(1 + sum(weight)) AS weight FROM (SELECT * FROM pair UNION ALL SELECT target, source, weight FROM pair) GROUP BY source, target),
  sh AS (SELECT source, target, weight / sum(weight) OVER (PARTITION BY source) AS share FROM u WHERE weight > 0),
  dense AS (SELECT 'chunk:' || id AS id, similarity FROM vec ORDER BY similarity DESC, vec.id LIMIT 20),
  seeds AS (SELECT 'supp:1' AS id, 1.0::DOUBLE AS w UNION ALL SELECT id, greatest(similarity, 0) * 0.05 FROM dense), reset AS (SELECT id, sum(w) / (SELECT sum(w) FROM seeds) AS reset FROM seeds WHERE w > 0 GROUP BY id), p0 AS (SELECT id, reset AS score FROM reset)"""
    for i in range(1, steps + 1):
        out += f", p{i} AS (SELECT id, sum(score) AS score FROM (SELECT target AS id, 0.5 * score * share AS score FROM p{i - 1} JOIN sh ON source = id UNION ALL SELECT id, 0.5 * reset FROM reset) GROUP BY id)"
    return out + f""", top AS (SELECT id, score FROM p{steps} WHERE score > 1e-10 AND id IN (SELECT target FROM ec) ORDER BY round(score, 12) DESC, id LIMIT {3 * k})
  SELECT id, round(score, 9) AS ppr, round(score + 0.15 * coalesce(similarity, 0) + 0.12 * coalesce(CASE WHEN CAST(substr(id, 7) AS BIGINT) % 7 = 0 THEN 0.5 END, 0), 9) AS final FROM top LEFT JOIN dense USING (id) ORDER BY final DESC, id LIMIT {k}"""


@query(_search_sql(3, 10))
def graph_search(spark, sf_dir):
    lines = R.table(spark, sf_dir, "lineitem")
    supplier, part, chunk = (F.concat(F.lit(p), c) for p, c in (("supp:", "l_suppkey"), ("part:", "l_partkey"), ("chunk:", "l_orderkey")))
    ee = lines.where("l_linenumber = 1").select(supplier.alias("source"), part.alias("target"), F.col("l_quantity").alias("weight"))
    ec = lines.select(part.alias("entity_id"), chunk.alias("chunk_id"), (F.col("l_discount") * 10).alias("weight"))
    dense = knowledge.dense_candidates(R.vectors(spark, sf_dir), R.query_vector(spark, sf_dir), 20).select(F.concat(F.lit("chunk:"), "id").alias("id"), "similarity")
    lexical = R.table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select(F.concat(F.lit("chunk:"), "o_orderkey").alias("id"), F.lit(0.5).alias("keyword"))
    return knowledge.graph_search(ee, ec, spark.createDataFrame([("supp:1", 1.0)], "id string, weight double"), dense, lexical, 10, iterations=3, fixed=True)


@query(f"WITH {R.EDGES} SELECT edge_id, round(greatest(CASE WHEN source = 'supp:1' THEN 1.0 WHEN source = 'part:3' THEN 0.5 ELSE 0 END, CASE WHEN target = 'supp:1' THEN 1.0 WHEN target = 'part:3' THEN 0.5 ELSE 0 END) * 0.9 * log2(1 + weight), 6) AS explore FROM edges WHERE source IN ('supp:1', 'part:3') OR target IN ('supp:1', 'part:3')")
def graph_explore(spark, sf_dir):
    anchors = spark.createDataFrame([("supp:1", 1.0), ("part:3", 0.5)], "id string, score double")
    return knowledge.explore(R.edges(spark, sf_dir).withColumn("confidence", F.lit(0.9)), anchors).select("edge_id", "explore")


_HAS = "len(list_intersect(['red', 'widget'], regexp_split_to_array(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' '))) / 2.0"


@query(f"""WITH e AS (SELECT 'entity' AS kind, CAST(p_partkey AS VARCHAR) AS id, round({_HAS.format('p_name')}, 6) AS score FROM part QUALIFY score > 0 AND row_number() OVER (ORDER BY score DESC, id) <= 15),
  f AS (SELECT 'fact' AS kind, CAST(s_suppkey AS VARCHAR) AS id, round({_HAS.format("s_name || ' sells a widget'")}, 6) AS score FROM supplier QUALIFY score > 0 AND row_number() OVER (ORDER BY score DESC, id) <= 15) SELECT * FROM e UNION ALL SELECT * FROM f""")
def knowledge_search(spark, sf_dir):
    e = R.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    f = R.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat("s_name", F.lit(" sells a widget")).alias("content"))
    return knowledge.knowledge(e, f, "red widget", 15)


@query("SELECT source AS bucket_id, count(*) AS n, max(n_chars) AS best FROM documents GROUP BY source")
def bucket_report(spark, sf_dir):
    return knowledge.bucket_report(R.table(spark, sf_dir, "documents").select(F.col("source").alias("bucket_id"), F.col("n_chars").alias("score")))


@query("SELECT 'm' || (n_nationkey % 3) AS embedding_model, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS buckets FROM nation GROUP BY 1")
def model_groups(spark, sf_dir):
    return knowledge.models(R.table(spark, sf_dir, "nation").select(F.concat(F.lit("m"), F.col("n_nationkey") % 3).alias("embedding_model"), F.col("n_name").alias("bucket_id")))


@query("SELECT c_custkey AS id, coalesce(n, 0) AS processed, CASE WHEN coalesce(n, 0) >= 10 THEN 'completed' WHEN coalesce(n, 0) > 0 THEN 'running' ELSE 'pending' END AS status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def job_progress(spark, sf_dir):
    jobs = R.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(0).cast("long").alias("processed"), F.lit(10).alias("total"))
    return knowledge.job_progress(jobs, R.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.lit(1).alias("n"))).select("id", "processed", "status")


@query(f"WITH {R.EDGES} SELECT edge_id, relation, weight FROM edges WHERE source = 'part:3' OR target = 'part:3' ORDER BY weight DESC, edge_id LIMIT 20")
def entity_edges(spark, sf_dir):
    return knowledge.top_edges(R.edges(spark, sf_dir), "part:3").select("edge_id", "relation", "weight")


@query("SELECT type, value, count(DISTINCT entity_id) AS owners, min(entity_id) AS first FROM (SELECT p_partkey AS entity_id, p_type AS type, p_brand AS value FROM part WHERE p_size <= 5) GROUP BY type, value HAVING count(DISTINCT entity_id) > 1")
def external_id_conflicts(spark, sf_dir):
    p = R.table(spark, sf_dir, "part").where("p_size <= 5").select(F.col("p_partkey").alias("entity_id"), F.col("p_type").alias("type"), F.col("p_brand").alias("value"))
    return upsert.conflicts(p.where("entity_id % 2 = 0"), p.where("entity_id % 2 = 1"), ["type", "value"]).select("type", "value", "owners", "first")


@query(f"WITH {R.EDGES}, {R.ENTITIES} SELECT source, string_agg(DISTINCT coalesce(a.name, source) || ' ' || lower(replace(relation, '_', ' ')) || ' ' || coalesce(b.name, target), '; ' ORDER BY coalesce(a.name, source) || ' ' || lower(replace(relation, '_', ' ')) || ' ' || coalesce(b.name, target)) AS text FROM edges LEFT JOIN entities a ON a.id = source LEFT JOIN entities b ON b.id = target WHERE relation = 'LOCATED_IN' GROUP BY source")
def subgraph_text(spark, sf_dir):
    from oremill.operators import context

    return context.subgraph_text(R.edges(spark, sf_dir, ("LOCATED_IN",)), R.entities(spark, sf_dir))


@query("SELECT count(DISTINCT source) AS sources, count(DISTINCT target) AS targets, count(*) AS edges FROM (SELECT l_orderkey AS source, l_partkey AS target FROM lineitem)")
def graph_counters(spark, sf_dir):
    e = R.table(spark, sf_dir, "lineitem")
    return e.agg(F.count_distinct("l_orderkey").alias("sources"), F.count_distinct("l_partkey").alias("targets"), F.count("*").alias("edges"))


@query("SELECT s_suppkey AS id, round(least(1, 0.5 * (s_acctbal / 9876.54321) + 0.25), 6) AS score FROM supplier QUALIFY row_number() OVER (ORDER BY score DESC, id) <= 10")
def merge_limited(spark, sf_dir):
    s = R.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.round(F.least(F.lit(1.0), 0.5 * (F.col("s_acctbal") / 9876.54321) + 0.25), 6).alias("score"))
    return retrieval.best_of([s, s.withColumn("score", F.col("score") / 2)], "id", "score", 10)
