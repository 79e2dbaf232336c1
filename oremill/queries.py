"""The registered queries of the engine's own operators and the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oremill import relations as R
from oremill.functions import scoring as S
from oremill.functions import temporal as T
from oremill.functions import text as X
from oremill.operators import access as A
from oremill.operators import chunking, context, governance, graph, memory, ontology, resolution, retrieval, upsert
from oremill.plans.shipping import ship
from oremill.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


TERMS = X.relaxed_terms("und, nicht or thing and the thble ertion attion?")
_TF = "len(list_filter(w, lambda x: x = '{}'))"
_ALL = " AND ".join(f"{_TF.format(t)} > 0" for t in TERMS)
_SUM = "(" + " + ".join(f"{_TF.format(t)} / ({_TF.format(t)} + 1.0)" for t in TERMS) + f") / {len(TERMS)}"
SCORED = rf"""words AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
 scored AS (SELECT id, round(greatest(CASE WHEN {_ALL} THEN {_SUM} ELSE 0 END, 0.75 * ({_SUM})), 6) AS keyword FROM words)"""


# --- vector and keyword retrieval


@query(f"WITH {R.VECTORS} SELECT id, bucket, similarity FROM vec ORDER BY similarity DESC, id LIMIT 10")
def semantic_topk(spark, sf_dir):
    return retrieval.semantic_topk(R.vectors(spark, sf_dir), R.query_vector(spark, sf_dir)).select("id", "bucket", "similarity")


@query(f"WITH {R.VECTORS} SELECT id, bucket, similarity FROM vec WHERE bucket IN (1, 2) ORDER BY similarity DESC, id LIMIT 10")
def semantic_topk_filtered(spark, sf_dir):
    return retrieval.semantic_topk(R.vectors(spark, sf_dir).where(F.col("bucket").isin(1, 2)), R.query_vector(spark, sf_dir)).select("id", "bucket", "similarity")


@query("""SELECT query_id, id, similarity, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, s AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, e.vec_id) AS rank
  FROM (SELECT q.vec_id AS qi, e.vec_id AS ei, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS s FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0) p
  JOIN embeddings q ON q.vec_id = qi JOIN embeddings e ON e.vec_id = ei) WHERE rank <= 10""")
def semantic_batch_topk(spark, sf_dir):
    v = R.vectors(spark, sf_dir)
    return retrieval.batch_topk(v, v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding"), 10)


@query(f"WITH {SCORED} SELECT id, keyword FROM scored WHERE keyword > 0")
def keyword_score(spark, sf_dir):
    return retrieval.keyword_scored(R.chunks(spark, sf_dir), TERMS).select("id", "keyword")


@query(f"WITH {SCORED} SELECT id, keyword, row_number() OVER (ORDER BY keyword DESC, id) AS rank FROM scored WHERE keyword > 0 ORDER BY keyword DESC, id LIMIT 20")
def keyword_topk(spark, sf_dir):
    return retrieval.ranked(retrieval.keyword_scored(R.chunks(spark, sf_dir), TERMS), "keyword", 20, "id", "rank", ["id", "keyword"])


_LISTS = f"""{R.VECTORS}, {SCORED}, v AS (SELECT id, similarity, row_number() OVER (ORDER BY similarity DESC, id) AS rank FROM vec QUALIFY rank <= 30),
 k AS (SELECT id, keyword, row_number() OVER (ORDER BY keyword DESC, id) AS rank FROM scored WHERE keyword > 0 QUALIFY rank <= 30)"""
_HYBRID = f"""WITH {_LISTS}, h AS (SELECT id, max(similarity) AS similarity, max(keyword) AS keyword, round(sum(1.0 / (60 + rank)), 9) AS rrf FROM
  (SELECT id, similarity, NULL::DOUBLE AS keyword, rank FROM v UNION ALL SELECT id, NULL, keyword, rank FROM k) GROUP BY id)"""


@query(f"{_HYBRID} SELECT * FROM h ORDER BY rrf DESC, id LIMIT 10")
def hybrid_rrf(spark, sf_dir):
    return retrieval.hybrid(R.vectors(spark, sf_dir), R.chunks(spark, sf_dir), R.query_vector(spark, sf_dir), TERMS)


@query(f"WITH {_LISTS} SELECT v.id, similarity, v.rank AS vrank, keyword, k.rank AS krank, round(0.7 / (60 + v.rank) + 0.3 / (60 + coalesce(k.rank, 1000)), 9) AS score FROM v LEFT JOIN k USING (id) ORDER BY score DESC, v.id LIMIT 10")
def hybrid_memory_rrf(spark, sf_dir):
    return retrieval.memory_hybrid(R.vectors(spark, sf_dir), R.chunks(spark, sf_dir), R.query_vector(spark, sf_dir), TERMS)


@query(f"{_HYBRID} SELECT h.id, rrf, source, lang FROM (SELECT * FROM h ORDER BY rrf DESC, id LIMIT 10) h JOIN documents ON doc_id = h.id")
def hybrid_with_sources(spark, sf_dir):
    top = hybrid_rrf(spark, sf_dir).withColumn("source_id", F.col("id"))
    return retrieval.with_sources(top, R.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "source", "lang")).select("id", "rrf", "source", "lang")


# --- filters and scans

_SEEN = f"WITH {R.CHUNKS} SELECT id, bucket_id, visibility FROM chunks WHERE tenant_id = 'de' AND (visibility IS NULL OR visibility = 'tenant' OR (visibility = 'user' AND user_id = 'u3')) AND user_id = 'u3'"


@query(_SEEN)
def visibility_gate(spark, sf_dir):
    return A.scan(R.chunks(spark, sf_dir), A.Identity(tenant="de", user="u3")).select("id", "bucket_id", "visibility")


@query(f"WITH {R.CHUNKS} SELECT id, bucket_id FROM chunks WHERE bucket_id IN ('src1', 'src2') AND visibility IS NULL")
def bucket_scan(spark, sf_dir):
    return A.scan(R.chunks(spark, sf_dir), buckets=["src1", "src2"]).select("id", "bucket_id")


@query(f"WITH {R.CHUNKS} SELECT id, bucket_id, source_id, chunk_index FROM chunks WHERE (bucket_id, source_id, chunk_index) IN (SELECT bucket_id, source_id, chunk_index FROM chunks WHERE id % 10 = 3)")
def chunkref_semijoin(spark, sf_dir):
    c = R.chunks(spark, sf_dir)
    return A.by_refs(c, c.where("id % 10 = 3").select("bucket_id", "source_id", "chunk_index")).select("id", "bucket_id", "source_id", "chunk_index")


_LINES = "c AS (SELECT CAST(l_orderkey AS VARCHAR) AS source_id, l_linenumber AS chunk_index, l_returnflag AS bucket_id, l_partkey AS id FROM lineitem)"


def _lines(spark, sf_dir):
    return R.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("source_id"), F.col("l_linenumber").alias("chunk_index"), F.col("l_returnflag").alias("bucket_id"), F.col("l_partkey").alias("id"))


@query(f"WITH {_LINES} SELECT DISTINCT c.* FROM c JOIN (SELECT * FROM c WHERE id % 50 = 7) r ON c.source_id = r.source_id AND c.bucket_id = r.bucket_id AND abs(c.chunk_index - r.chunk_index) <= 1")
def neighbor_range(spark, sf_dir):
    c = _lines(spark, sf_dir)
    return A.neighbours(c, c.where("id % 50 = 7"), 1).select("source_id", "chunk_index", "bucket_id", "id").distinct()


@query(f"WITH {R.MEMORIES} SELECT id, category, status FROM memories WHERE category IN ('episodic', 'semantic') AND status NOT IN ('invalidated', 'expired') AND created_s <= {R.EPOCH} + 86400 * 10 AND (invalid_s IS NULL OR invalid_s > {R.EPOCH} + 86400 * 10)")
def memory_list(spark, sf_dir):
    at = dt.datetime(2024, 1, 11)
    return R.memories(spark, sf_dir).where(A.memory_filter(categories=["episodic", "semantic"], as_of=at)).select("id", "category", "status")


@query("SELECT doc_id AS id, source, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 10")
def source_page(spark, sf_dir):
    d = R.table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"), "source", "n_chars")
    return A.page(d, [F.desc("n_chars"), F.col("id")], 20, 10)


@query(f"WITH {R.ENTITIES} SELECT id, name FROM entities WHERE contains(lower(name), 'widget') ORDER BY name, id LIMIT 20")
def entity_search(spark, sf_dir):
    return A.contains_name(R.entities(spark, sf_dir).withColumn("aliases", F.array().cast("array<string>")), "Widget").select("id", "name")


@query(f"""WITH {R.ENTITIES}, l AS (SELECT id, CASE WHEN lower(name) = 'red widget' THEN 1.0 WHEN starts_with(lower(name), 'red widget') THEN 0.88 WHEN contains(lower(name), 'red widget') THEN 0.84 END AS score FROM entities),
  v AS (SELECT 'part:' || vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings)
  SELECT id, max(score) AS score FROM (SELECT * FROM l WHERE score IS NOT NULL UNION ALL SELECT * FROM v) GROUP BY id ORDER BY score DESC, id LIMIT 30""")
def entity_hybrid(spark, sf_dir):
    names = R.entities(spark, sf_dir).withColumn("score", retrieval.lexical_ladder(F.col("name"), F.array().cast("array<string>"), "red widget")).where("score IS NOT NULL")
    near = retrieval.similarity(R.vectors(spark, sf_dir), R.query_vector(spark, sf_dir)).select(F.concat(F.lit("part:"), "id").alias("id"), F.col("similarity").alias("score"))
    return retrieval.best_of([names, near], "id", "score", 30)


@query(f"WITH {R.INTERVALS} SELECT event_id FROM intervals WHERE valid_at <= TIMESTAMP '2024-01-15' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '2024-01-15')")
def temporal_as_of(spark, sf_dir):
    return R.intervals(spark, sf_dir).where(T.active_at(F.lit(dt.datetime(2024, 1, 15)), F.col("valid_at"), F.col("invalid_at"))).select("event_id")


@query(f"WITH {R.INTERVALS} SELECT event_id FROM intervals WHERE valid_at <= TIMESTAMP '2024-01-12' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '2024-01-10')")
def temporal_between(spark, sf_dir):
    return R.intervals(spark, sf_dir).where(T.active_between(F.lit(dt.datetime(2024, 1, 10)), F.lit(dt.datetime(2024, 1, 12)), F.col("valid_at"), F.col("invalid_at"))).select("event_id")


@query(f"""WITH {R.INTERVALS} SELECT a.event_id AS a, b.event_id AS b FROM intervals a JOIN intervals b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'purchase'
  AND (b.invalid_at IS NULL OR a.valid_at < b.invalid_at) AND (a.invalid_at IS NULL OR b.valid_at < a.invalid_at)""")
def temporal_overlap(spark, sf_dir):
    i = R.intervals(spark, sf_dir)
    a, b = i.where("event_type = 'error'").alias("a"), i.where("event_type = 'purchase'").alias("b")
    both = (F.col("a.user_id") == F.col("b.user_id")) & T.overlaps(F.col("a.valid_at"), F.col("a.invalid_at"), F.col("b.valid_at"), F.col("b.invalid_at"))
    return a.join(b, both).select(F.col("a.event_id").alias("a"), F.col("b.event_id").alias("b"))


# --- fusion


@query("SELECT l_orderkey AS source_id, l_linenumber AS chunk_index, l_extendedprice AS score FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) = 1")
def best_chunk_per_source(spark, sf_dir):
    c = R.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("chunk_index"), F.col("l_extendedprice").alias("score"))
    return retrieval.best_chunk(c).select("source_id", "chunk_index", "score")


@query("""SELECT c_custkey AS id, c_nationkey AS list, round(CASE WHEN max(c_acctbal) OVER w = min(c_acctbal) OVER w THEN 1 ELSE (c_acctbal - min(c_acctbal) OVER w) / (max(c_acctbal) OVER w - min(c_acctbal) OVER w) END, 6) AS scaled
  FROM customer WINDOW w AS (PARTITION BY c_nationkey)""")
def minmax_normalize(spark, sf_dir):
    c = R.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("list"), "c_acctbal")
    return retrieval.min_max(c, "c_acctbal", "scaled", ["list"]).select("id", "list", F.round("scaled", 6).alias("scaled"))


def _candidates(spark, sf_dir):
    v = retrieval.similarity(R.vectors(spark, sf_dir), R.query_vector(spark, sf_dir)).select("id", "bucket", "similarity")
    null = F.lit(None).cast("double")
    shape = lambda df, mode, **s: df.select(
        F.concat(F.lit("b"), "bucket").alias("bucket_id"), F.col("id").cast("string").alias("source_id"), F.lit(0).alias("chunk_index"), F.lit("").alias("content"), F.lit(mode).alias("mode"), "rank",
        *(s.get(c, null).alias(c) for c in ("semantic", "keyword", "graph", "memory", "memory_similarity")),
    )
    indexed = shape(retrieval.ranked(v, "similarity", 30, "id", "rank"), "indexed", semantic=F.col("similarity"), keyword=F.when(F.col("id") % 2 == 0, (F.col("id") % 10) / 10.0))
    linked = shape(retrieval.ranked(v.where("id % 3 = 0").withColumn("g", 1 / (1.0 + F.col("id"))), "g", 20, "id", "rank"), "graph", graph=F.col("g"))
    recalled = shape(retrieval.ranked(v.where("id % 5 = 0"), "similarity", 15, "id", "rank"), "memory", memory=0.5 + F.col("similarity") / 2, memory_similarity=F.col("similarity"))
    return indexed, linked, recalled


_CANDIDATES = f"""{R.VECTORS}, i AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS rank FROM vec QUALIFY rank <= 30),
 g AS (SELECT *, row_number() OVER (ORDER BY 1 / (1.0 + id) DESC, id) AS rank FROM vec WHERE id % 3 = 0 QUALIFY rank <= 20),
 m AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS rank FROM vec WHERE id % 5 = 0 QUALIFY rank <= 15),
 c AS (SELECT 'b' || bucket || ':' || id || ':0' AS key, 'indexed' AS mode, rank, 0.5 AS w, similarity AS semantic, CASE WHEN id % 2 = 0 THEN (id % 10) / 10.0 END AS keyword, NULL::DOUBLE AS graph, NULL::DOUBLE AS memory, NULL::DOUBLE AS ms FROM i
  UNION ALL SELECT 'b' || bucket || ':' || id || ':0', 'graph', rank, 0.15, NULL, NULL, 1 / (1.0 + id), NULL, NULL FROM g
  UNION ALL SELECT 'b' || bucket || ':' || id || ':0', 'memory', rank, 0.2, NULL, NULL, NULL, 0.5 + similarity / 2, similarity FROM m),
 a AS (SELECT key, string_agg(DISTINCT mode, ',' ORDER BY mode) AS modes, sum(w / (60.0 + rank)) AS rrf, max(semantic) AS semantic, max(keyword) AS keyword, max(graph) AS graph, max(memory) AS memory, max(ms) AS ms FROM c GROUP BY key),
 n AS (SELECT key, modes, rrf, least(1, greatest(0, coalesce(semantic, ms, CASE WHEN modes LIKE '%indexed%' THEN 0 END) / 0.85)) AS s, semantic IS NULL AND ms IS NULL AND modes NOT LIKE '%indexed%' AS no_s,
  least(1, greatest(0, coalesce(keyword, 0))) AS k, CASE WHEN graph > 0 THEN least(1, sqrt(sqrt(graph))) ELSE 0 END AS g, CASE WHEN modes LIKE '%memory%' THEN least(1, greatest(0, coalesce(memory, 0))) END AS m FROM a)"""


@query(f"""WITH {_CANDIDATES} SELECT key, modes, round(rrf, 9) AS rrf, round((CASE WHEN no_s THEN 0 ELSE 0.35 * s END + 0.05 * k + 0.30 * g + coalesce(0.30 * m, 0)) * (0.35 + 0.05 + 0.30 + 0.30)
  / (CASE WHEN no_s THEN 0 ELSE 0.35 END + 0.05 + 0.30 + CASE WHEN m IS NULL THEN 0 ELSE 0.30 END), 9) AS composite FROM n ORDER BY composite DESC, rrf DESC, key LIMIT 25""")
def runner_merge(spark, sf_dir):
    indexed, linked, recalled = _candidates(spark, sf_dir)
    return retrieval.merge_runners(indexed.unionByName(linked).unionByName(recalled), 25, lists=["indexed", "graph", "memory"])


@query("""WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE least(1, greatest(0, (c_acctbal / 10000) / 0.85)) END AS s, (c_custkey % 11) / 10.0 AS k, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE (c_custkey % 7) / 7.0 END AS m FROM customer)
  SELECT id, round((coalesce(0.45 * s, 0) + 0.10 * least(k, 1) + coalesce(0.45 * m, 0)) / (CASE WHEN s IS NULL THEN 0 ELSE 0.45 END + 0.10 + CASE WHEN m IS NULL THEN 0 ELSE 0.45 END), 6) AS score FROM c""")
def composite_score(spark, sf_dir):
    key = F.col("c_custkey")
    parts = {
        "semantic": F.when(key % 3 != 0, S.calibrate_semantic(F.col("c_acctbal") / 10_000)),
        "keyword": S.calibrate_keyword(key % 11 / 10.0),
        "memory": F.when(key % 4 != 0, key % 7 / 7.0),
    }
    return R.table(spark, sf_dir, "customer").select(key.alias("id"), F.round(S.composite_score(parts, {"semantic", "keyword", "memory"}), 6).alias("score"))


@query("""SELECT o_orderkey AS id, round(least((o_totalprice / 1e6) / (2 / 61.0), 1), 6) AS rrf, round(least(sqrt(sqrt(o_totalprice / 1e6)), 1), 6) AS ppr, round(least(1, greatest(0, (o_totalprice / 412345.678901) / 0.85)), 6) AS semantic FROM orders""")
def calibrations(spark, sf_dir):
    p = F.col("o_totalprice")
    return R.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.round(S.normalize_rrf(p / 1e6, 2), 6).alias("rrf"), F.round(S.normalize_ppr(p / 1e6), 6).alias("ppr"), F.round(S.calibrate_semantic(p / 412345.678901), 6).alias("semantic"))


def _keyed(df):
    return df.withColumn("key", X.dedup_key(F.col("bucket_id"), F.col("source_id"), F.col("chunk_index"), F.col("content")))


@query(f"WITH {_CANDIDATES} SELECT key, round(CASE WHEN key IN (SELECT key FROM c WHERE mode = 'indexed') THEN graph * 1.5 ELSE graph END, 9) AS graph FROM c WHERE mode = 'graph'")
def reinforce_prefer(spark, sf_dir):
    indexed, linked, _ = _candidates(spark, sf_dir)
    return retrieval.reinforce(_keyed(linked), _keyed(indexed), "prefer").select("key", F.round("graph", 9).alias("graph"))


@query(f"WITH {_CANDIDATES} SELECT key, round(graph, 9) AS graph FROM c WHERE mode = 'graph' AND key IN (SELECT key FROM c WHERE mode = 'indexed')")
def reinforce_only(spark, sf_dir):
    indexed, linked, _ = _candidates(spark, sf_dir)
    return retrieval.reinforce(_keyed(linked), _keyed(indexed), "only").select("key", F.round("graph", 9).alias("graph"))


@query(f"WITH {R.CHUNKS} SELECT id, round(CASE WHEN id % 10 = 3 THEN least(1, (id % 100) / 100.0 * 1.15 + 0.05) ELSE (id % 100) / 100.0 END, 6) AS score FROM chunks")
def scope_boost(spark, sf_dir):
    c = R.chunks(spark, sf_dir).withColumn("score", F.col("id") % 100 / 100.0)
    return retrieval.boost_scope(c, c.where("id % 10 = 3")).select("id", F.round("score", 6).alias("score"))


def _classify_sql() -> str:
    # a class's patterns, tried in order
    hit = lambda name: "(" + " OR ".join(f"regexp_matches(t, '{p}')" for p in retrieval.CLASS_PATTERNS[name]) + ")"
    capitals = "len(list_filter((regexp_split_to_array(text, '\\s+'))[2:], lambda w: length(w) > 1 AND upper(w[1]) = w[1] AND lower(w[1]) <> w[1])) >= 3"
    order = [("relational", hit("relational"), 0.8), ("temporal", hit("temporal"), 0.7), ("entity-centric", hit("entity-centric"), 0.7), ("entity-centric", capitals, 0.6), ("factual-lookup", hit("factual-lookup"), 0.7)]
    kind = " ".join(f"WHEN {test} THEN '{name}'" for name, test, _ in order)
    sure = " ".join(f"WHEN {test} THEN {p}" for _, test, p in order)
    return f"SELECT conv_id, turn, CASE {kind} ELSE 'exploratory' END AS kind, CASE {sure} ELSE 0.3 END::DOUBLE AS confidence FROM (SELECT conv_id, turn, text, lower(text) AS t FROM conversations)"


@query(_classify_sql())
def classify_queries(spark, sf_dir):
    kind, sure = retrieval.classify(F.col("text"))
    return R.table(spark, sf_dir, "conversations").select("conv_id", "turn", kind.alias("kind"), sure.alias("confidence"))


# --- memory


@query(f"WITH {R.MEMORIES} SELECT id, decay FROM decayed")
def decay_score(spark, sf_dir):
    return memory.decayed(R.memories(spark, sf_dir), R.AS_OF).select("id", "decay")


@query(f"WITH {R.MEMORIES} SELECT id, CASE WHEN decay < 0.1 AND status = 'active' THEN 'archived' ELSE status END AS status FROM decayed")
def decay_forget(spark, sf_dir):
    return memory.forget(R.memories(spark, sf_dir), R.AS_OF).select("id", "status")


@query(f"""WITH {R.MEMORIES}, {R.ENTITIES}, {R.EDGES} SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'invalidated') AS invalidated, count(*) FILTER (status = 'consolidated') AS consolidated,
  round(count(*) FILTER (status = 'active') / count(*) FILTER (status IN ('active', 'invalidated')), 3) AS precision, round(count(*) FILTER (status = 'active' AND decay < 0.1) / count(*) FILTER (status = 'active'), 3) AS staleness,
  (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM edges) AS edges, round((SELECT count(*) FROM edges) / (SELECT count(*) FROM entities), 2) AS edges_per_entity FROM decayed""")
def memory_health(spark, sf_dir):
    return memory.health(R.memories(spark, sf_dir), R.entities(spark, sf_dir), R.edges(spark, sf_dir), R.AS_OF)


@query(f"""WITH {R.MEMORIES}, {R.VECTORS} SELECT m.id, round(least(1, greatest(0, 0.55 * similarity + 0.30 * importance + 0.15 * exp(-ln(2) / 604800.0 * greatest(1706745600 - accessed_s, 0)))), 6) AS score
  FROM memories m JOIN vec ON vec.id = m.id % 500 ORDER BY score DESC, m.id LIMIT 20""")
def memory_runner_score(spark, sf_dir):
    near = retrieval.similarity(R.vectors(spark, sf_dir), R.query_vector(spark, sf_dir)).select(F.col("id").alias("v"), "similarity")
    m = R.memories(spark, sf_dir)
    return memory.runner_scores(m.join(near, m.id % 500 == near.v), R.AS_OF, 20).select("id", "score")


@query(f"""WITH {R.MEMORIES}, a AS (SELECT (user_id % 20) * 1000 + event_id % 4 AS id, count(*) AS n, max(ts) AS t FROM events GROUP BY 1)
  SELECT m.id, access_count + coalesce(n, 0) AS access_count, greatest(make_timestamp(accessed_s * 1000000), t) AS last_accessed_at FROM memories m LEFT JOIN a USING (id)""")
def memory_access(spark, sf_dir):
    a = R.table(spark, sf_dir, "events").select((F.col("user_id") % 20 * 1000 + F.col("event_id") % 4).alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    return memory.record_access(R.memories(spark, sf_dir), a).select("id", "access_count", F.col("last_accessed_at").cast("timestamp_ntz").alias("last_accessed_at"))


_MOVES = " OR ".join(f"(status = '{k}' AND wanted IN ({', '.join(repr(x) for x in v)}))" for k, v in T.TRANSITIONS.items() if v)


@query(f"WITH {R.MEMORIES}, w AS (SELECT id, status, CASE id % 4 WHEN 0 THEN 'archived' WHEN 1 THEN 'expired' WHEN 2 THEN 'active' ELSE 'consolidated' END AS wanted FROM memories) SELECT *, {_MOVES} AS allowed, CASE WHEN {_MOVES} THEN wanted ELSE status END AS result FROM w")
def memory_transitions(spark, sf_dir):
    want = F.when(F.col("id") % 4 == 0, "archived").when(F.col("id") % 4 == 1, "expired").when(F.col("id") % 4 == 2, "active").otherwise("consolidated")
    return memory.transitions(R.memories(spark, sf_dir).select("id", "status", want.alias("wanted")))


@query(f"WITH {R.MEMORIES} SELECT conversation_id, id, CAST(floor((row_number() OVER (PARTITION BY conversation_id ORDER BY created_s, id) - 1) / 2) AS INTEGER) AS batch FROM memories WHERE category = 'episodic' AND status = 'active' AND created_s <= 1706745600 - 3600")
def consolidation_batches(spark, sf_dir):
    return memory.consolidation_batches(R.memories(spark, sf_dir), R.AS_OF, size=2).select("conversation_id", "id", "batch")


@query(f"WITH {R.MEMORIES}, x AS (SELECT conv_id * 1000 AS id FROM conversations WHERE conv_id % 3 = 0) SELECT id, CASE WHEN id IN (SELECT id FROM x) AND status = 'active' THEN 'invalidated' ELSE status END AS status, CASE WHEN id IN (SELECT id FROM x) AND invalid_s IS NULL THEN 1706745600 ELSE invalid_s END AS invalid_s FROM memories")
def memory_invalidate(spark, sf_dir):
    m = R.memories(spark, sf_dir)
    out = memory.invalidate(m, m.where("id % 1000 = 0 AND conversation_id % 3 = 0"), R.AS_OF)
    return out.select("id", "status", F.unix_seconds(F.col("invalid_at").cast("timestamp")).alias("invalid_s"))


@query(f"WITH {R.MEMORIES} SELECT conversation_id, category, (CASE category WHEN 'semantic' THEN 'Facts' WHEN 'episodic' THEN 'Episodes' ELSE 'Procedures' END) || ':' || chr(10) || string_agg('- ' || content, chr(10) ORDER BY id) AS text FROM memories GROUP BY conversation_id, category")
def memory_prompt(spark, sf_dir):
    return memory.prompt(R.memories(spark, sf_dir))


# --- graph


@query(f"WITH {R.EDGES} SELECT relation, count(*) AS n FROM edges GROUP BY relation")
def relation_types(spark, sf_dir):
    return graph.frequency(R.edges(spark, sf_dir), "relation")


@query(f"WITH {R.ENTITIES} SELECT type, count(*) AS n FROM entities GROUP BY type")
def entity_types(spark, sf_dir):
    return graph.frequency(R.entities(spark, sf_dir), "type")


@query(f"WITH {R.EDGES} SELECT degree, count(*) AS n FROM (SELECT count(*) AS degree FROM edges GROUP BY source UNION ALL SELECT count(*) FROM edges GROUP BY target) GROUP BY degree")
def degree_distribution(spark, sf_dir):
    return graph.degree_distribution(R.edges(spark, sf_dir))


@query(f"WITH {R.EDGES} SELECT id, count(DISTINCT edge_id) AS degree FROM (SELECT source AS id, edge_id FROM edges UNION ALL SELECT target, edge_id FROM edges) GROUP BY id")
def entity_degree(spark, sf_dir):
    return graph.degree(R.edges(spark, sf_dir))


@query(f"WITH {R.EDGES}, {R.ENTITIES} SELECT *, round(edges / entities, 2) AS edges_per_entity FROM (SELECT (SELECT count(*) FROM entities) AS entities, (SELECT count(DISTINCT type) FROM entities) AS types, count(*) AS edges, count(DISTINCT relation) AS relations FROM edges)")
def graph_stats(spark, sf_dir):
    return graph.stats(R.edges(spark, sf_dir), R.entities(spark, sf_dir))


@query(f"WITH {R.EDGES} SELECT source, target, round(log2(1 + sum(weight)), 6) AS weight FROM (SELECT source, target, weight FROM edges UNION ALL SELECT target, source, weight FROM edges) GROUP BY source, target")
def adjacency(spark, sf_dir):
    return graph.adjacency(R.edges(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


_STEPS = "steps AS MATERIALIZED (SELECT source, target FROM edges UNION SELECT target, source FROM edges)"


def _hops(depth: int) -> str:
    out = "h0 AS (SELECT 'supp:1' AS id, 0 AS depth)"
    for d in range(1, depth + 1):
        out += f", h{d} AS MATERIALIZED (SELECT id, depth FROM h{d - 1} UNION ALL SELECT DISTINCT target, {d} FROM h{d - 1} JOIN steps ON source = id WHERE target NOT IN (SELECT id FROM h{d - 1}))"
    return out


@query(f"WITH {R.EDGES}, {_STEPS}, {_hops(2)} SELECT id, depth FROM h2")
def khop_neighbors(spark, sf_dir):
    return graph.khop(R.edges(spark, sf_dir), spark.createDataFrame([("supp:1",)], "id string"), 2)


@query(f"WITH {R.EDGES}, {_STEPS}, {_hops(2)} SELECT edge_id, source, target, relation, weight FROM edges WHERE source IN (SELECT id FROM h2) AND target IN (SELECT id FROM h2) AND weight >= 10 AND relation IN ('CONTAINS', 'SUPPLIED_BY')")
def subgraph(spark, sf_dir):
    return graph.subgraph(R.edges(spark, sf_dir), spark.createDataFrame([("supp:1",)], "id string"), 2, relations=["CONTAINS", "SUPPLIED_BY"], least_weight=10.0)[1].select("edge_id", "source", "target", "relation", "weight")


_BFS = _hops(5).replace("supp:1", "cust:1")


@query(f"""WITH RECURSIVE {R.EDGES}, {_STEPS}, {_BFS}, up AS MATERIALIZED (SELECT b.id, min(s.source) AS parent, b.depth FROM h5 b JOIN steps s ON s.target = b.id JOIN h5 a ON a.id = s.source AND a.depth = b.depth - 1 GROUP BY b.id, b.depth),
  walk AS (SELECT 'supp:1' AS id, (SELECT depth FROM h5 WHERE id = 'supp:1') AS step UNION ALL SELECT up.parent, walk.step - 1 FROM walk JOIN up ON up.id = walk.id) SELECT CAST(step AS INTEGER) AS step, id FROM walk WHERE step IS NOT NULL""")
def shortest_path(spark, sf_dir):
    return graph.shortest_path(R.edges(spark, sf_dir), "cust:1", "supp:1")


def _components_sql(rounds: int) -> str:
    """The least id spreads by one step a round; no two vertices of a component are further apart."""
    out = f"WITH {R.EDGES}, {_STEPS}, c0 AS MATERIALIZED (SELECT DISTINCT source AS id, source AS component FROM steps)"
    for i in range(1, rounds + 1):
        out += f", c{i} AS MATERIALIZED (SELECT c.id, least(any_value(c.component), min(n.component)) AS component FROM c{i - 1} c JOIN steps ON source = c.id JOIN c{i - 1} n ON n.id = target GROUP BY c.id)"
    return out + f" SELECT id, component FROM c{rounds}"


@query(_components_sql(10))
def components(spark, sf_dir):
    return graph.components(R.edges(spark, sf_dir))


def _ppr_sql(steps: int) -> str:
    out = f"WITH {R.EDGES}, u AS (SELECT source, target, sum(weight) AS weight FROM (SELECT source, target, weight FROM edges UNION ALL SELECT target, source, weight FROM edges) GROUP BY ALL), "
    out += "sh AS (SELECT source, target, weight / sum(weight) OVER (PARTITION BY source) AS share FROM u), reset AS (SELECT * FROM (VALUES ('cust:1', 2 / 3.0::DOUBLE), ('nation:3', 1 / 3.0::DOUBLE)) t(id, reset)), p0 AS (SELECT id, reset AS score FROM reset)"
    for i in range(1, steps + 1):
        out += f", p{i} AS (SELECT id, sum(score) AS score FROM (SELECT target AS id, 0.5 * score * share AS score FROM p{i - 1} JOIN sh ON source = id UNION ALL SELECT id, 0.5 * reset FROM reset) GROUP BY id)"
    return out + f" SELECT id, round(score, 9) AS score FROM p{steps} WHERE score > 1e-10"


@query(_ppr_sql(5))
def ppr_fixed_iterations(spark, sf_dir):
    seeds = spark.createDataFrame([("cust:1", 2.0), ("nation:3", 1.0)], "id string, weight double")
    return graph.pagerank(graph.undirected(R.edges(spark, sf_dir)), seeds, iterations=5, fixed=True).select("id", F.round("score", 9).alias("score"))


_FACTS = "facts AS (SELECT l_orderkey * 10 + l_linenumber AS id, 'part:' || (l_partkey % 40) AS source, 'supp:' || (l_suppkey % 10) AS target, 'part ' || (l_partkey % 40) || ' from ' || (l_suppkey % 10) AS content, round(l_extendedprice / 100000, 6) AS score FROM lineitem)"


def _facts(spark, sf_dir):
    p, s = (F.col("l_partkey") % 40).cast("string"), (F.col("l_suppkey") % 10).cast("string")
    return R.table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("part:"), p).alias("source"), F.concat(F.lit("supp:"), s).alias("target"), F.concat(F.lit("part "), p, F.lit(" from "), s).alias("content"), F.round(F.col("l_extendedprice") / 100_000, 6).alias("score")
    )


@query(f"""WITH {_FACTS}, top AS (SELECT * FROM facts ORDER BY score DESC, id LIMIT 16), p AS (SELECT a.id AS first, b.id AS second, a.content || '; ' || b.content AS content, round(a.score + b.score + CASE WHEN a.target = b.source THEN 1.5 WHEN a.source = b.target THEN 1.25 WHEN a.source = b.source THEN 0.5 WHEN a.target = b.target THEN 0.5 END, 6) AS score FROM top a, top b WHERE a.id <> b.id)
  SELECT first, second, content, score FROM p WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY content ORDER BY score DESC, first, second) = 1 ORDER BY score DESC, first, second LIMIT 10""")
def fact_chains(spark, sf_dir):
    return graph.fact_chains(_facts(spark, sf_dir), 10)


_WORDS = "regexp_split_to_array(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' ')"
_PART = "len(list_intersect(['supplier', '7', 'located', 'nation'], " + _WORDS + ")) / 4.0"


@query(f"""WITH f AS (SELECT s_suppkey AS id, s_name AS source_name, 'LOCATED_IN' AS relation, n_name AS target_name, s_name || ' located in ' || n_name AS content, s_acctbal / 10000 AS similarity FROM supplier JOIN nation ON n_nationkey = s_nationkey)
  SELECT id, round(0.45 * greatest(similarity, 0) + 0.28 * ({_PART.format("content")}) + 0.22 * greatest({_PART.format("source_name")}, {_PART.format("target_name")}) + 0.05 * ({_PART.format("replace(relation, '_', ' ')")})
  - 0.2 * (row_number() OVER (PARTITION BY source_name, relation, target_name, content ORDER BY id) - 1), 6) AS score FROM f""")
def fact_rerank(spark, sf_dir):
    s, n = R.table(spark, sf_dir, "supplier"), R.table(spark, sf_dir, "nation")
    f = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("source_name"), F.lit("LOCATED_IN").alias("relation"), F.col("n_name").alias("target_name"), F.concat_ws(" located in ", "s_name", "n_name").alias("content"), (F.col("s_acctbal") / 10_000).alias("similarity"))
    return graph.rerank_facts(f, ["supplier", "7", "located", "nation"]).select("id", "score")


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id < b.vec_id AND round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) >= 0.4")
def synonym_pairs(spark, sf_dir):
    return graph.synonym_pairs(R.vectors(spark, sf_dir), 0.4)


@query("SELECT 'part:' || l_partkey AS entity_id, 'ord:' || l_orderkey AS chunk_id, count(*) AS mentions, max(l_discount * 10) AS confidence, count(DISTINCT lower(l_returnflag)) AS surfaces, count(DISTINCT l_linestatus) AS types, round(least(3, 0.5 + log2(1 + count(*)) * CASE WHEN max(l_discount * 10) > 0 THEN max(l_discount * 10) ELSE 0.75 END), 6) AS weight FROM lineitem GROUP BY 1, 2")
def mention_rollup(spark, sf_dir):
    m = R.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("part:"), "l_partkey").alias("entity_id"), F.concat(F.lit("ord:"), "l_orderkey").alias("chunk_id"), (F.col("l_discount") * 10).alias("confidence"), F.col("l_returnflag").alias("surface_text"), F.col("l_linestatus").alias("mention_type"))
    return graph.mention_edges(m)


@query(f"WITH {R.EDGES}, {R.ENTITIES} SELECT edge_id, coalesce(a.name, source) AS source_name, relation, coalesce(b.name, target) AS target_name FROM edges LEFT JOIN entities a ON a.id = source LEFT JOIN entities b ON b.id = target")
def hydrate_names(spark, sf_dir):
    e, n = R.edges(spark, sf_dir), R.entities(spark, sf_dir)
    return context.hydrate(e, n).select("edge_id", "source_name", "relation", "target_name")


@query(f"WITH {R.EDGES} SELECT edge_id, source, target, relation FROM edges WHERE (source = 'cust:1' OR target = 'cust:1') AND relation IN ('LOCATED_IN', 'PLACED_BY')")
def edge_intent(spark, sf_dir):
    e = R.edges(spark, sf_dir)
    both = graph.edge_matches(["cust:1"], [], ["LOCATED_IN", "PLACED_BY"], ["LOCATED_IN", "PLACED_BY"])
    return e.where(both).select("edge_id", "source", "target", "relation")


# --- upserts and cascades

_PS = "SELECT 'part:' || l_partkey AS source, 'supp:' || l_suppkey AS target, 'SUPPLIED_BY' AS relation, l_quantity / 10 AS weight, l_shipdate AS valid_at, l_returnflag AS flag FROM lineitem"


def _part_edges(spark, sf_dir):
    return R.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("part:"), "l_partkey").alias("source"), F.concat(F.lit("supp:"), "l_suppkey").alias("target"), F.lit("SUPPLIED_BY").alias("relation"), (F.col("l_quantity") / 10).alias("weight"), F.col("l_shipdate").alias("valid_at"), F.col("l_returnflag").alias("flag"), "l_linenumber")


@query(f"SELECT source, target, relation, round(sum(weight), 6) AS weight, min(valid_at) AS valid_at FROM ({_PS}) GROUP BY source, target, relation")
def edge_upsert(spark, sf_dir):
    e = _part_edges(spark, sf_dir)
    cols = ["source", "target", "relation", "weight", "valid_at"]
    return upsert.semantic_edges(e.where("l_linenumber = 1").select(cols), e.where("l_linenumber > 1").select(cols)).withColumn("weight", F.round("weight", 6))


@query(f"SELECT source, target, relation, round(CASE WHEN count(*) = 1 THEN sum(weight) ELSE least(5, sum(weight)) END, 6) AS weight, string_agg(DISTINCT flag, ',' ORDER BY flag) AS evidence FROM ({_PS}) GROUP BY source, target, relation")
def graph_edge_upsert_capped(spark, sf_dir):
    e = _part_edges(spark, sf_dir).withColumn("evidence", F.array("flag"))
    cols = ["source", "target", "relation", "weight", "evidence"]
    return upsert.graph_edges(e.where("l_linenumber = 1").select(cols), e.where("l_linenumber > 1").select(cols)).select("source", "target", "relation", F.round("weight", 6).alias("weight"), F.array_join("evidence", ",").alias("evidence"))


@query("""WITH n AS (SELECT l_orderkey AS source_id, l_linenumber - 1 AS chunk_index, 'new ' || l_partkey AS content, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS total FROM lineitem WHERE l_orderkey % 3 = 0 AND l_linenumber <= 2 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC) = 1),
  o AS (SELECT l_orderkey AS source_id, l_linenumber - 1 AS chunk_index, 'old ' || l_partkey AS content FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC) = 1)
  SELECT source_id, chunk_index, coalesce(n.content, o.content) AS content FROM o FULL JOIN n USING (source_id, chunk_index) WHERE source_id NOT IN (SELECT source_id FROM n) OR chunk_index < (SELECT max(total) FROM n m WHERE m.source_id = coalesce(n.source_id, o.source_id))""")
def chunk_upsert(spark, sf_dir):
    lines = upsert.latest(R.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], [F.desc("l_partkey"), F.desc("l_suppkey")])
    shape = lambda df, word: df.select(F.col("l_orderkey").alias("source_id"), (F.col("l_linenumber") - 1).alias("chunk_index"), F.concat(F.lit(f"{word} "), "l_partkey").alias("content"), F.lit(0).alias("seq"))
    new = shape(lines.where("l_orderkey % 3 = 0 AND l_linenumber <= 2"), "new")
    new = new.withColumn("total_chunks", F.max(F.col("chunk_index") + 1).over(Window.partitionBy("source_id")))
    return upsert.chunks(shape(lines, "old"), new).select("source_id", "chunk_index", "content")


@query("""SELECT doc_id AS id, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 11 <> 0 AS skip FROM documents""")
def hash_skip(spark, sf_dir):
    d = R.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("store_key"), F.sha2("text", 256).alias("content_hash"), F.lit("m:64").alias("embedding_model"), F.lit(1).alias("chunk_count"))
    known = d.where("id % 11 <> 0").select("store_key", F.when(F.col("id") % 3 == 0, "other").otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.col("id") % 5 == 0, "n:32").otherwise(F.col("embedding_model")).alias("embedding_model"), "chunk_count")
    return upsert.unchanged(d, known).select("id", "skip")


@query("""SELECT 'src' || min(doc_id) AS id, source AS bucket_id, lang AS tenant_id, sha256(text) AS content_hash, min(doc_id) % 2 <> 0 AND bool_and(doc_id % 2 <> 0) AS was_created FROM documents GROUP BY source, lang, text, sha256(text) HAVING true""")
def source_upsert(spark, sf_dir):
    g = R.table(spark, sf_dir, "documents").select(F.concat(F.lit("src"), "doc_id").alias("id"), F.col("source").alias("bucket_id"), F.col("lang").alias("tenant_id"), F.sha2("text", 256).alias("content_hash"), (-F.col("doc_id")).alias("seq"), "doc_id")
    first = upsert.latest(g, ["bucket_id", "tenant_id", "content_hash"], [F.desc("seq")])
    even = g.where("doc_id % 2 = 0").select("bucket_id", "tenant_id", "content_hash").distinct()
    old = first.join(even, ["bucket_id", "tenant_id", "content_hash"], "left_semi")
    return upsert.sources(old.drop("doc_id"), g.drop("doc_id")).select("id", "bucket_id", "tenant_id", "content_hash", "was_created")


@query("SELECT o_orderkey AS source_id, l_linenumber AS chunk_index FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F'")
def delete_cascade(spark, sf_dir):
    o, lines = R.table(spark, sf_dir, "orders"), R.table(spark, sf_dir, "lineitem")
    out = upsert.delete_cascade(o.where("o_orderstatus = 'F'"), {"chunks": (lines.select("l_orderkey", "l_linenumber"), "l_orderkey", "o_orderkey"), "sources": (o, "o_orderkey", "o_orderkey")})
    return out["chunks"].join(out["sources"].select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").select(F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("chunk_index"))


_MERGED = "CASE WHEN {0} LIKE 'supp:%' THEN 'supp:' || (CAST(substr({0}, 6) AS BIGINT) // 2 * 2) ELSE {0} END"


@query(f"SELECT {_MERGED.format('source')} AS source, {_MERGED.format('target')} AS target, relation, round(CASE WHEN count(*) = 1 THEN sum(weight) ELSE least(5, sum(weight)) END, 6) AS weight, true AS valid FROM ({_PS}) GROUP BY ALL")
def entity_merge(spark, sf_dir):
    merges = R.table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 1").select(F.concat(F.lit("supp:"), "s_suppkey").alias("old_id"), F.concat(F.lit("supp:"), F.col("s_suppkey") - 1).alias("new_id"))
    return upsert.merge_entities(_part_edges(spark, sf_dir).select("source", "target", "relation", "weight"), merges).withColumn("weight", F.round("weight", 6))


@query(f"WITH {R.EDGES} SELECT edge_id, NOT (source LIKE 'supp:%' AND TRY_CAST(substr(source, 6) AS BIGINT) % 3 = 0) AND NOT (target LIKE 'supp:%' AND TRY_CAST(substr(target, 6) AS BIGINT) % 3 = 0) AS valid FROM edges")
def entity_delete(spark, sf_dir):
    gone = R.table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("supp:"), "s_suppkey").alias("id"))
    return upsert.delete_entities(R.edges(spark, sf_dir).withColumn("valid", F.lit(True)), gone, purge=False).select("edge_id", "valid")


# --- text


_GRAMS = "list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3)))"


@query(f"SELECT a, b, round(len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))), 6) AS score FROM (SELECT n_name AS a, r_name AS b, {_GRAMS.format('n_name')} AS ta, {_GRAMS.format('r_name')} AS tb FROM nation JOIN region ON r_regionkey = n_regionkey)")
def trigram_jaccard(spark, sf_dir):
    n, r = R.table(spark, sf_dir, "nation"), R.table(spark, sf_dir, "region")
    pairs = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("a"), F.col("r_name").alias("b"))
    return pairs.withColumn("score", F.round(S.trigram_jaccard(F.col("a"), F.col("b")), 6))


@query(f"SELECT p_partkey AS id, round(len(list_intersect(['red', 'widget', 'large'], {_WORDS.format('p_name')})) / 3.0, 6) AS score FROM part")
def token_overlap(spark, sf_dir):
    q = F.array(*map(F.lit, ("red", "widget", "large")))
    return R.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(S.overlap(q, X.tokens(F.col("p_name"))), 6).alias("score"))


def _markdown_sql(column: str) -> str:
    # the m in JavaScript-like patterns is an option of DuckDB's function
    for pattern, to in X.MARKDOWN:
        options = "g" + ("m" if pattern.startswith("(?m)") else "") + ("s" if pattern.startswith("(?s)") else "")
        body = pattern.removeprefix("(?m)").removeprefix("(?s)").replace("'", "''")
        body = f"(?m){body}" if "m" in options else body
        column = f"regexp_replace({column}, '{body}', {_sql_text(to.replace('$1', chr(92) + '1'))}, 'g{'s' if 's' in options else ''}')"
    return f"regexp_replace({column}, '^\\s+|\\s+$', '', 'g')"


def _sql_text(s: str) -> str:
    return "'" + s.replace("\n", "' || chr(10) || '") + "'"


_MARKED = "'# ' || left(url, 40) || chr(10) || chr(10) || chr(10) || '- **' || page_id || '** and `' || page_id || '`' || chr(10) || '> [text](' || url || ') ~~x~~ ' || html"


@query(f"SELECT page_id, md5({_markdown_sql('(' + _MARKED + ')')}) AS stripped FROM pages")
def strip_markdown(spark, sf_dir):
    marked = F.expr("concat('# ', left(url, 40), '\\n\\n\\n', '- **', page_id, '** and `', page_id, '`', '\\n', '> [text](', url, ') ~~x~~ ', html)")
    return R.table(spark, sf_dir, "pages").select("page_id", F.md5(X.strip_markdown(marked)).alias("stripped"))


@query("SELECT doc_id AS id, CASE WHEN length(k) > 128 THEN sha256(k) ELSE k END AS key, 'en::b::' || CASE WHEN length(k) > 128 THEN sha256(k) ELSE k END AS store_key FROM (SELECT doc_id, coalesce(lang, '') || '::' || coalesce(text, '') AS k FROM documents)")
def idempotency_key(spark, sf_dir):
    key = X.idempotency_key(F.col("lang"), F.col("text"))
    return R.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), key.alias("key"), X.hash_store_key(F.lit("en"), F.lit("b"), key).alias("store_key"))


@query("SELECT doc_id AS id, 'chk_' || substr(sha256('m:64' || chr(31) || source || chr(31) || doc_id || chr(31) || '0'), 1, 32) AS chunk_id FROM documents")
def stable_ids(spark, sf_dir):
    return R.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), X.chunk_id(F.lit("m:64"), F.col("source"), F.col("doc_id"), F.lit(0)).alias("chunk_id"))


@query("SELECT page_id AS id, replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, CAST((len(list_filter(regexp_split_to_array(html, '\\s+'), lambda w: w <> '')) * 13 + 9) // 10 AS BIGINT) AS tokens FROM pages")
def text_functions(spark, sf_dir):
    return R.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), X.xml_escape(F.col("url")).alias("escaped"), X.estimate_tokens(F.col("html")).alias("tokens"))


@query("SELECT c_custkey AS id, lower(c_name) || '@x.org' AS email, '+' || (c_custkey + 1000) AS phone FROM customer")
def external_ids(spark, sf_dir):
    c = R.table(spark, sf_dir, "customer")
    mail, phone = F.concat(F.lit(" "), F.upper("c_name"), F.lit("@X.org ")), F.concat(F.lit("+ ("), (F.col("c_custkey") + 1000).cast("string"), F.lit(")"))
    return c.select(F.col("c_custkey").alias("id"), X.external_id(mail, F.lit("email"), F.lit("none")).alias("email"), X.external_id(phone, F.lit("phone"), F.lit(None).cast("string")).alias("phone"))


_TRIPLES = "t AS (SELECT s_suppkey AS id, 's' || s_suppkey AS subject, CASE s_suppkey % 5 WHEN 0 THEN 'founded by' WHEN 1 THEN 'Works-At' WHEN 2 THEN 'ALSO_CALLED' WHEN 3 THEN 'married to' ELSE 'likes' END AS p, 'n' || s_nationkey AS object FROM supplier)"


@query(f"""WITH {_TRIPLES} SELECT id, CASE WHEN id % 5 = 0 THEN object ELSE subject END AS subject, CASE WHEN id % 5 = 0 THEN subject ELSE object END AS object, CASE id % 5 WHEN 0 THEN 'FOUNDED_BY' WHEN 1 THEN 'WORKS_AT' WHEN 2 THEN 'ALSO_CALLED' WHEN 3 THEN 'MARRIED_TO' ELSE 'LIKES' END AS original,
  CASE id % 5 WHEN 0 THEN 'FOUNDED' WHEN 1 THEN 'WORKS_FOR' WHEN 2 THEN 'ALSO_CALLED' WHEN 3 THEN 'MARRIED' ELSE 'LIKES' END AS predicate, id % 5 IN (0, 1, 3) AS valid, id % 5 = 3 AS symmetric, NULL::VARCHAR AS temporal_status FROM t""")
def predicate_normalize(spark, sf_dir):
    k = F.col("s_suppkey") % 5
    p = F.when(k == 0, "founded by").when(k == 1, "Works-At").when(k == 2, "ALSO_CALLED").when(k == 3, "married to").otherwise("likes")
    t = R.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("s"), "s_suppkey").alias("subject"), p.alias("predicate"), F.concat(F.lit("n"), "s_nationkey").alias("object"))
    return ontology.normalise(t, ontology.table(spark))


# --- governance and context


@query("""WITH p AS (SELECT * FROM (VALUES ('p1', 'de', NULL, 'index', 'deny', NULL, NULL), ('p2', NULL, NULL, 'query', 'deny', 'source', 'src1'), ('p3', NULL, NULL, 'query', 'allow', NULL, NULL), ('p4', 'fr', 'u3', 'query', 'deny', NULL, NULL)) t(id, tenant_id, user_id, action, effect, k, v))
  SELECT doc_id, count(p.id) = 0 AS allowed, string_agg(p.id, ',' ORDER BY p.id) AS violations FROM documents LEFT JOIN p ON effect = 'deny' AND action = 'query' AND (p.tenant_id IS NULL OR p.tenant_id = lang) AND (p.user_id IS NULL OR p.user_id = 'u' || (doc_id % 7)) AND (k IS NULL OR v = source) GROUP BY doc_id""")
def policy_eval(spark, sf_dir):
    rows = [("p1", "de", None, "index", "deny", None), ("p2", None, None, "query", "deny", {"source": "src1"}), ("p3", None, None, "query", "allow", None), ("p4", "fr", "u3", "query", "deny", None)]
    policies = spark.createDataFrame(rows, "id string, tenant_id string, user_id string, action string, effect string, conditions map<string,string>")
    asks = R.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("tenant_id"), F.concat(F.lit("u"), F.col("doc_id") % 7).alias("user_id"), F.lit("query").alias("action"), F.create_map(F.lit("source"), F.col("source")).alias("metadata"))
    return governance.evaluate(asks, policies, "doc_id").select("doc_id", "allowed", "violations")


@query("""WITH c AS (SELECT conv_id, turn, CAST((len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) * 13 + 9) // 10 AS BIGINT) AS tokens FROM conversations),
  r AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM c) SELECT conv_id, turn, tokens, CAST(used AS BIGINT) AS used FROM r WHERE n = 1 OR used <= 200""")
def token_budget(spark, sf_dir):
    c = R.table(spark, sf_dir, "conversations").select("conv_id", "turn", X.estimate_tokens(F.col("text")).alias("tokens"))
    return context.within_budget(c, ["conv_id"], ["turn"], "tokens", 200).select("conv_id", "turn", "tokens", "used")


@query()
def chunk_text(spark, sf_dir):
    return chunking.chunk_documents(R.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))


@query()
def entity_resolution(spark, sf_dir):
    return resolution.resolve(R.entities(spark, sf_dir))


@query()
def extract_triples(spark, sf_dir):
    return resolution.extract(R.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))


# --- events


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return streams.tumbling(R.table(spark, sf_dir, "events"), "1 day").select(F.col("start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    return streams.sessions(R.table(spark, sf_dir, "events"), "30 minutes").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
