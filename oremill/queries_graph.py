"""Registered queries of intents, graph answers, facts, access and edits, and the SQL that gives the same rows.

Nothing in the SQL is made from the engine's own constants."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from oremill import relations as R
from oremill.functions import scoring as S
from oremill.functions import text as X
from oremill.operators import access as A
from oremill.operators import answers, intent, knowledge, memory, retrieval, upsert
from oremill.queries import query

#: Questions about customers (n) and nations (m): the question, then sources, targets, predicates, mode and strictness.
QUESTIONS = (
    ("'Who founded ' || n || '?'", "''", "n", "'FOUNDED'", "'fact'", "'strict'"),
    ("'who did ' || n || ' marry?'", "n", "''", "'MARRIED'", "'fact'", "'strict'"),
    ("'Who is the wife of ' || n || '?'", "n", "''", "'MARRIED'", "'fact'", "'strict'"),
    ("'Who was the father of ' || n", "''", "n", "'PARENT_OF'", "'fact'", "'strict'"),
    ("'Where is ' || n || ' headquartered?'", "n", "''", "'HEADQUARTERED_IN'", "'fact'", "'strict'"),
    ("'Where is ' || n || '?'", "n", "''", "'LOCATED_IN'", "'fact'", "'strict'"),
    ("'where does ' || n || ' work'", "n", "''", "'WORKS_FOR'", "'fact'", "'strict'"),
    ("'What does ' || n || ' use?'", "n", "''", "'USES'", "'fact'", "'strict'"),
    ("'How are ' || n || ' and ' || m || ' connected?'", "n", "m", "''", "'relationship'", "'soft'"),
    ("'Tell me about the ' || n || '.'", "n", "''", "''", "'summary'", "'soft'"),
    ("'Write a poem for ' || n", "n", "''", "''", "'creative'", "'soft'"),
    ("'summarize the relationship between ' || n || ' and ' || m", "n", "m", "''", "'summary'", "'soft'"),
)


def _asked(column: int) -> str:
    """A CASE over the key; the thirteenth question asks nothing."""
    return "CASE k % 13 " + " ".join(f"WHEN {i} THEN {q[column]}" for i, q in enumerate(QUESTIONS)) + " ELSE 'nothing is asked here' END"


_PEOPLE = "SELECT c_custkey AS k, c_name AS n, concat(upper(left(n_name, 1)), lower(substr(n_name, 2))) AS m FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE instr(n_name, ' ') = 0"


@query(f"WITH people AS ({_PEOPLE}) SELECT k AS id, {_asked(1)} AS sources, {_asked(2)} AS targets, {_asked(3)} AS predicates, {_asked(4)} AS mode, {_asked(5)} AS strictness FROM people WHERE k % 13 < 12")
def intent_parse(spark, sf_dir):
    c, n = R.table(spark, sf_dir, "customer"), R.table(spark, sf_dir, "nation")
    people = c.join(n, c.c_nationkey == n.n_nationkey).where("instr(n_name, ' ') = 0").selectExpr("c_custkey AS k", "c_name AS n", "concat(upper(left(n_name, 1)), lower(substr(n_name, 2))) AS m")
    return intent.parse(people.selectExpr("k AS id", f"{_asked(0)} AS query"))


@query()
def intent_of_turns(spark, sf_dir):
    return intent.parse(R.table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("text").alias("query")))


# --- graph answers

_ASK = "tell me about Customer#000000001"
_ANCHOR = "found AS (SELECT id AS entity_id, CASE WHEN lower(name) = 'customer#000000001' THEN 1.0 ELSE 0.88 END AS score FROM entities WHERE starts_with(lower(name), 'customer#000000001') ORDER BY score DESC, id LIMIT 5)"
_AT = "facts AS (SELECT edge_id, source, target, max(score) AS score FROM edges JOIN found ON entity_id IN (source, target) GROUP BY ALL)"
_SEEDS = "seeds AS (SELECT entity_id, max(weight) AS weight FROM (SELECT entity_id, score AS weight FROM found UNION ALL SELECT source, 0.5 * score FROM facts UNION ALL SELECT target, 0.5 * score FROM facts) GROUP BY entity_id)"


@query(f"""WITH {R.ENTITIES}, {R.EDGES}, {_ANCHOR}, {_AT}, {_SEEDS} SELECT 'anchor' AS stage, entity_id AS what, round(score, 6)::DOUBLE AS score FROM found
  UNION ALL SELECT 'fact', edge_id, round(score, 6) FROM facts UNION ALL SELECT 'seed', entity_id, round(weight, 6) FROM seeds""")
def graph_explain(spark, sf_dir):
    return answers.explain(_ASK, R.entities(spark, sf_dir), R.edges(spark, sf_dir))


def _walk(steps: int) -> str:
    out = "both_ways AS (SELECT source, target, log2(1 + sum(weight)) AS weight FROM (SELECT source, target, weight FROM known UNION ALL SELECT target, source, weight FROM known) GROUP BY ALL), "
    out += "sh AS MATERIALIZED (SELECT source, target, weight / sum(weight) OVER (PARTITION BY source) AS share FROM both_ways), r AS (SELECT entity_id AS id, weight / (SELECT sum(weight) FROM seeds) AS reset FROM seeds), p0 AS (SELECT id, reset AS score FROM r)"
    for i in range(1, steps + 1):
        out += f", p{i} AS MATERIALIZED (SELECT id, sum(score) AS score FROM (SELECT target AS id, 0.5 * score * share AS score FROM p{i - 1} JOIN sh ON source = id UNION ALL SELECT id, 0.5 * reset FROM r) GROUP BY id)"
    return out


@query(f"""WITH {R.ENTITIES}, {R.EDGES}, {_ANCHOR}, {_AT}, {_SEEDS}, known AS (SELECT source, target, weight FROM edges), {_walk(4)}
  SELECT id, round(score, 9) AS ppr, round(score, 9) AS final FROM p4 WHERE id LIKE 'ord:%' AND score > 1e-10 ORDER BY round(score, 12) DESC, id LIMIT 10""")
def graph_retrieve(spark, sf_dir):
    """Orders stand for chunks: a customer's and a part's edges to them are what links entities to chunks."""
    edges = R.edges(spark, sf_dir)
    chunks = edges.where("relation IN ('PLACED_BY', 'CONTAINS')").select(F.col("target").alias("entity_id"), F.col("source").alias("chunk_id"), "weight")
    rest = edges.where("relation IN ('LOCATED_IN', 'SUPPLIED_BY')")
    none = spark.createDataFrame([], "id string, similarity double, keyword double")
    start = answers.seeds(*answers._asked(_ASK, R.entities(spark, sf_dir), edges, ())).select(F.col("entity_id").alias("id"), "weight")
    return knowledge.graph_search(rest, chunks, start, none.select("id", "similarity"), none.select("id", "keyword"), 10, iterations=4, fixed=True)


_FACTS = f"{R.VECTORS}, f AS (SELECT id, similarity, 'part ' || (id % 40) || ' from supplier ' || (id % 7) AS content FROM vec)"


@query(f"""WITH {_FACTS}, w AS (SELECT id, (CASE WHEN id % 40 = 3 THEN 1 ELSE 0 END + CASE WHEN id % 7 = 3 THEN 1 ELSE 0 END) AS n3, 1 AS np FROM f),
  k AS (SELECT id, round(CASE WHEN n3 > 0 THEN (n3 / (n3 + 1.0) + 0.5) / 2 ELSE 0.75 * 0.25 END, 6) AS score FROM w), a AS (SELECT id, similarity AS score FROM f ORDER BY score DESC, id LIMIT 30), b AS (SELECT * FROM k ORDER BY score DESC, id LIMIT 30)
  SELECT id, max(score) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id ORDER BY score DESC, id LIMIT 10""")
def fact_hybrid(spark, sf_dir):
    f = R.vectors(spark, sf_dir).withColumn("content", F.concat(F.lit("part "), (F.col("id") % 40).cast("string"), F.lit(" from supplier "), (F.col("id") % 7).cast("string")))
    return answers.fact_hybrid(f, R.query_vector(spark, sf_dir), ["3", "part"], 10)


@query(f"WITH {_FACTS} SELECT id, similarity FROM f WHERE id % 40 < 20 ORDER BY similarity DESC, id LIMIT 15")
def fact_topk(spark, sf_dir):
    return retrieval.semantic_topk(R.vectors(spark, sf_dir).where("id % 40 < 20"), R.query_vector(spark, sf_dir), 15).select("id", "similarity")


_HOP1 = "n1 AS (SELECT 'part:1' AS id, 0 AS depth UNION ALL SELECT DISTINCT o, 1 FROM (SELECT CASE WHEN source = 'part:1' THEN target ELSE source END AS o FROM edges WHERE 'part:1' IN (source, target)))"


@query(f"WITH {R.EDGES}, {R.ENTITIES}, {_HOP1} SELECT n1.id, depth FROM n1 JOIN entities USING (id) WHERE length(name) % 2 = 0 OR type <> 'document'")
def neighbors_at(spark, sf_dir):
    """Entities with names of odd length ended before the time that is asked for."""
    ended = F.when((F.length("name") % 2 == 1) & (F.col("type") == "document"), F.lit(dt.datetime(2024, 1, 1)))
    e = R.entities(spark, sf_dir).withColumn("invalid_at", ended)
    return answers.neighbours_at(R.edges(spark, sf_dir), e, spark.createDataFrame([("part:1",)], "id string"), 1, F.col("invalid_at").isNull() | (F.col("invalid_at") > F.lit(dt.datetime(2024, 2, 1)))).select("id", "depth")


@query("SELECT o_orderkey AS id, o_totalprice AS total, l_quantity AS weight FROM orders JOIN (SELECT l_orderkey, l_quantity FROM (SELECT l_orderkey, max(l_quantity) AS l_quantity FROM lineitem WHERE l_partkey = 1 GROUP BY l_orderkey) ORDER BY l_quantity DESC, l_orderkey LIMIT 20) ON l_orderkey = o_orderkey")
def entity_chunks(spark, sf_dir):
    c = R.table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("part:"), "l_partkey").alias("entity_id"), F.col("l_orderkey").alias("chunk_id")).agg(F.max("l_quantity").alias("weight"))
    return answers.chunks_of("part:1", c, R.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total"))).select("id", "total", "weight")


@query(f"WITH {R.EDGES}, {R.ENTITIES}, d AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id) SELECT id, coalesce(degree, 0) AS degree, round(coalesce(degree, 0) / (SELECT max(degree) FROM d), 6) AS size FROM entities LEFT JOIN d USING (id)")
def subgraph_stats(spark, sf_dir):
    return answers.subgraph_stats(R.entities(spark, sf_dir), R.edges(spark, sf_dir))


# --- access


@query(f"WITH {R.ENTITIES} SELECT id, name FROM entities WHERE id IN ('cust:1', 'cust:2', 'nation:3', 'part:2') AND length(id) % 2 = 0")
def entity_get(spark, sf_dir):
    """Entities of even ids are user 0's, half of them private; those of user 1 aren't the caller's."""
    e = R.entities(spark, sf_dir).withColumn("visibility", F.when(F.length("name") % 2 == 1, "user")).withColumn("tenant_id", F.lit("t")).withColumn("user_id", (F.length("id") % 2).cast("string"))
    return A.entities_by_id(e, ["cust:1", "cust:2", "nation:3", "part:2"], A.Identity(tenant="t", user="0")).select("id", "name")


@query("SELECT o_orderkey AS id, o_totalprice AS total FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50")
def backfill_page(spark, sf_dir):
    return A.after(R.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total")), "id", 100, 50)


@query(f"""WITH {R.ENTITIES}, {R.EDGES}, top AS (SELECT id, name, type FROM entities WHERE contains(lower(name), '1') ORDER BY name, id LIMIT 40)
  SELECT id, name, n AS connections FROM top JOIN (SELECT id, count(*) AS n FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id) USING (id) WHERE type = 'person' AND n >= 3""")
def entity_search_filtered(spark, sf_dir):
    found = A.contains_name(R.entities(spark, sf_dir).withColumn("aliases", F.array().cast("array<string>")), "1", limit=40).select("id", "name", "type")
    return A.filtered_entities(found, R.edges(spark, sf_dir), "person", 3).select("id", "name", "connections")


@query(f"WITH {R.CHUNKS} SELECT id FROM chunks WHERE (tenant_id IS NULL OR tenant_id = 'de') AND (id % 3 = 0 OR user_id = 'u2')")
def scope_match(spark, sf_dir):
    c = R.chunks(spark, sf_dir).withColumn("user_id", F.when(F.col("id") % 3 != 0, F.col("user_id")))
    return c.where(A.scope_matches(A.Identity(tenant="de", user="u2"))).select("id")


@query(f"WITH {R.MEMORIES} SELECT id, status FROM memories WHERE conversation_id % 5 = 2 AND (id % 2 = 0 OR id % 3 = 0) AND status NOT IN ('invalidated', 'expired') AND id % 7 = 1")
def recall_gated(spark, sf_dir):
    """Memories of tenant 2, public or the caller's own, with a key of their metadata that holds a quote."""
    m = R.memories(spark, sf_dir).select("id", "status", "category", "invalid_at", "valid_at", (F.col("conversation_id") % 5).cast("string").alias("tenant_id"), F.when(F.col("id") % 3 == 0, "u0").otherwise("u1").alias("user_id"), F.when(F.col("id") % 2 != 0, "user").alias("visibility"), (F.col("id") % 7).alias("x"))
    m = m.withColumn("metadata", F.parse_json(F.concat(F.lit('{"it\'s": "'), F.col("x").cast("string"), F.lit('"}'))))
    who = A.Identity(tenant="2")
    mine = A.Identity(tenant="2", user="u0")
    gate = A.identity_filter(who) & (A.visibility_gate(mine))
    return m.where(gate & A.memory_filter(metadata={"it's": "1"})).select("id", "status")


@query(f"WITH {R.VECTORS} SELECT v.id, similarity FROM vec v JOIN documents d ON d.doc_id = v.id WHERE lang = 'en' AND source <> 'src1' ORDER BY similarity DESC, v.id LIMIT 10")
def semantic_topk_by_source(spark, sf_dir):
    """Sources are joined and filtered before the ranking."""
    d = R.table(spark, sf_dir, "documents").where("lang = 'en' AND source <> 'src1'").select(F.col("doc_id").alias("id"))
    return retrieval.semantic_topk(R.vectors(spark, sf_dir).join(d, "id", "left_semi"), R.query_vector(spark, sf_dir), 10).select("id", "similarity")


@query("SELECT l_orderkey AS source_id, l_linenumber AS chunk_index, 'part:' || l_partkey AS entity_id, o_orderstatus AS bucket_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE (l_returnflag = 'R') = (o_orderstatus = 'F')")
def mention_chunks(spark, sf_dir):
    """Mentions meet chunks by source, place and bucket."""
    lines, orders = R.table(spark, sf_dir, "lineitem"), R.table(spark, sf_dir, "orders")
    mentions = lines.select(F.concat(F.lit("part:"), "l_partkey").alias("entity_id"), F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("chunk_index"), (F.col("l_returnflag") == "R").alias("side"))
    chunks = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("chunk_index"), (F.col("o_orderstatus") == "F").alias("side"), F.col("o_orderstatus").alias("bucket_id")).distinct()
    return mentions.join(chunks, ["source_id", "chunk_index", "side"]).select("source_id", "chunk_index", "entity_id", "bucket_id")


# --- edits


@query(f"WITH {R.ENTITIES}, x AS (SELECT 'cust:' || c_custkey AS id, 'email:' || c_custkey || '@x.org,phone:' || (c_custkey % 5) AS e FROM customer WHERE c_custkey % 2 = 0) SELECT id, name, coalesce(e, '') AS external_ids FROM entities LEFT JOIN x USING (id)")
def attach_external_ids(spark, sf_dir):
    c = R.table(spark, sf_dir, "customer").where("c_custkey % 2 = 0")
    one = lambda kind, value: c.select(F.concat(F.lit("cust:"), "c_custkey").alias("entity_id"), F.lit(kind).alias("type"), value.alias("value"))
    x = one("phone", (F.col("c_custkey") % 5).cast("string")).unionByName(one("email", F.concat(F.col("c_custkey").cast("string"), F.lit("@x.org"))))
    return upsert.with_external_ids(R.entities(spark, sf_dir), x.union(x)).select("id", "name", "external_ids")


@query(f"WITH {R.EDGES} SELECT edge_id, CASE WHEN weight = 3 THEN 5 WHEN edge_id LIKE '%7' OR source = 'cust:1' OR target = 'cust:1' THEN 9 END AS invalid_at FROM edges")
def edges_invalidate(spark, sf_dir):
    e = R.edges(spark, sf_dir).withColumn("invalid_at", F.when(F.col("weight") == 3, 5))
    return upsert.invalidate_edges(e, F.lit(9), e.where("edge_id LIKE '%7'").select(F.col("edge_id").alias("id")), spark.createDataFrame([("cust:1",)], "id string")).select("edge_id", "invalid_at")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE o_orderstatus END AS status, o_orderpriority AS priority, CASE WHEN o_orderkey % 2 = 0 THEN 'y' END AS x FROM orders")
def properties_merge(spark, sf_dir):
    o = R.table(spark, sf_dir, "orders")
    old = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    new = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("status"), F.lit("new"), F.lit("x"), F.lit("y")))
    m = o.select(F.col("o_orderkey").alias("id"), F.from_json(F.to_json(upsert.merge_properties(old, new)), "map<string,string>").alias("m"))
    return m.select("id", F.col("m")["status"].alias("status"), F.col("m")["priority"].alias("priority"), F.col("m")["x"].alias("x"))


@query("SELECT doc_id AS id FROM documents WHERE NOT (source = 'src1' AND lang = 'en') AND doc_id % 9 <> 4")
def hash_delete(spark, sf_dir):
    h = R.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("store_key"), F.col("source").alias("bucket_id"), F.col("lang").alias("tenant_id"))
    return upsert.delete_hashes(upsert.delete_hashes(h, bucket="src1", tenant="en"), h.where("id % 9 = 4")).select("id")


# --- memory


@query(f"WITH {R.MEMORIES} SELECT id, CASE WHEN id % 4 = 1 THEN 'expired' ELSE status END AS status, id % 4 = 1 AS ended FROM memories")
def memory_expire(spark, sf_dir):
    m = R.memories(spark, sf_dir)
    return memory.expire(m, m.where("id % 4 = 1"), R.AS_OF).select("id", "status", (F.col("expired_at") == F.lit(R.AS_OF)).alias("ended")).fillna(False, ["ended"])


@query(f"WITH {R.MEMORIES} SELECT id FROM memories WHERE id % 10 IN (SELECT id % 10 FROM memories WHERE id % 10 IN (2, 3))")
def memory_about(spark, sf_dir):
    m = R.memories(spark, sf_dir)
    links = m.select(F.col("id").alias("memory_id"), F.concat(F.lit("e"), (F.col("id") % 10).cast("string")).alias("entity_id"))
    return memory.about(m, links, spark.createDataFrame([("e2",), ("e3",)], "id string")).select("id")


@query(f"WITH {R.MEMORIES}, a AS (SELECT conversation_id, id, row_number() OVER (PARTITION BY conversation_id ORDER BY created_s, id) AS n FROM memories WHERE category = 'episodic' AND status = 'active' AND contains(lower(content), 'the')) SELECT conversation_id, count(*) AS episodes, string_agg(id, ',' ORDER BY n) AS ids FROM a WHERE n <= 50 GROUP BY conversation_id HAVING count(*) >= 2")
def procedural_promotion(spark, sf_dir):
    return memory.promotable(R.memories(spark, sf_dir), "the", least=2).select("conversation_id", "episodes", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query("""WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal / 10000 END AS s, (c_custkey % 5) / 10.0 AS k, (c_custkey % 100) / 4000.0 AS r FROM customer),
  n AS (SELECT id, least(1, greatest(0, coalesce(s, 0) / 0.85)) AS s, k, least(1, r / (2 / 61.0)) * CASE WHEN k > 0 THEN 1 ELSE 0.5 END AS r FROM c) SELECT id, round(s, 6) AS semantic, round(k, 6) AS keyword, round(r, 6) AS rrf FROM n""")
def display_scores(spark, sf_dir):
    key = F.col("c_custkey")
    c = R.table(spark, sf_dir, "customer").select(key.alias("id"), F.when(key % 3 != 0, F.col("c_acctbal") / 10_000).alias("s"), (key % 5 / 10.0).alias("k"), (key % 100 / 4000.0).alias("r"))
    shown = S.display_scores({"semantic": F.col("s"), "keyword": F.col("k"), "rrf": F.col("r")}, {"semantic", "keyword"}, 2)
    return c.select("id", *(F.round(v, 6).alias(k) for k, v in shown.items()))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN source || ':' || doc_id || ':0' ELSE text END AS key FROM documents")
def result_identity(spark, sf_dir):
    own = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string"))
    return R.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), X.identity_key(F.col("source"), own, F.lit(0), F.col("text")).alias("key"))


@query("SELECT c_custkey AS id, list_contains(m, 'memory') AND len(m) = 1 AS is_memory FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN ['memory'] WHEN 1 THEN ['indexed', 'memory'] ELSE ['indexed'] END AS m FROM customer)")
def partition_results(spark, sf_dir):
    modes = F.when(F.col("c_custkey") % 3 == 0, "memory").when(F.col("c_custkey") % 3 == 1, "indexed,memory").otherwise("indexed")
    return R.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), retrieval.memory_only(modes).alias("is_memory"))
