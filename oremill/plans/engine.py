"""The facade: ingest documents, query them with several signals, forget and remember, over one catalog."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oremill.functions import scoring as S
from oremill.functions import text as X
from oremill.operators import access, answers, chunking, context, governance, memory, retrieval, upsert
from oremill.plans.scratch import store
from oremill.plans.shipping import ship
from oremill.sources.catalog import Catalog

DEFAULT_BUCKET = "bkt_default"


def hash_embedding(text: Column, dims: int = 16) -> Column:
    """A deterministic offline embedding: signed counts of hashed words, inside generated code."""
    words = X.tokens(text)
    cell = lambda i: F.aggregate(words, F.lit(0.0), lambda a, w: a + F.when(F.pmod(F.xxhash64(w), F.lit(dims)) == i, F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)).otherwise(0.0))
    return F.array(*(cell(i) for i in range(dims)))


@dataclass
class Config:
    model: str = "hash:16"
    embed: Callable[[Column], Column] = hash_embedding
    tokens: int = 512
    overlap: int = 64
    markdown: bool = False
    weights: dict[str, float] | None = None
    key_fields: tuple[str, ...] = ("url",)
    policies: DataFrame | None = None


@dataclass
class Results:
    ranked: DataFrame
    kind: str
    signals: set[str] = field(default_factory=set)


class Engine:
    """spark, the folder of its tables, and a configuration."""

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None):
        ship(spark)
        self.spark, self.catalog, self.config = spark, Catalog(spark, root), config or Config()

    def _check(self, action: str, who: access.Identity) -> None:
        if self.config.policies is not None:
            ids = {f"{k}_id": v for k, v in who.given().items()}
            ask = self.spark.createDataFrame([(0,)], "k int").select("k", F.lit(action).alias("action"), F.create_map().cast("map<string,string>").alias("metadata"), *(F.lit(v).alias(k) for k, v in ids.items()))
            governance.enforce(ask, self.config.policies, "k")

    def ingest(self, sources: DataFrame, bucket: str = DEFAULT_BUCKET, who: access.Identity = access.Identity(), at: dt.datetime | None = None, replace: bool = False) -> DataFrame:
        """Sources (id, content, url and more) to chunks: unchanged ones are skipped, places beyond a shorter text's end go; returns id and skipped.

        replace: sources of the bucket that aren't in this batch go."""
        self._check("index", who)
        at = at or dt.datetime.now()
        c = self.config
        fields = [F.col(f) for f in c.key_fields if f in sources.columns]
        # without a url, the id is the key
        key = F.coalesce(F.nullif(X.idempotency_key(*fields), F.lit("")), F.col("id").cast("string")) if fields else F.col("id").cast("string")
        s = sources.withColumn("content", X.sanitize(F.coalesce("content", F.lit("")))).withColumn("source_id", X.stable_id("src", F.lit(bucket), key)).withColumn("content_hash", F.sha2("content", 256))
        s = upsert.latest(s, ["source_id"], [F.desc("content_hash")])
        ids = {f"{k}_id": F.lit(who.given().get(k)).cast("string") for k in ("tenant", "group", "user", "agent", "conversation")}
        visibility = F.col("visibility") if "visibility" in sources.columns else F.lit(None).cast("string")
        s = s.withColumn("embedding_model", F.lit(c.model))
        # the hash test comes first: an unchanged source is neither chunked nor embedded
        old = self.catalog.read("chunks", bucket) if self.catalog.exists("chunks") else None
        done = s.select("source_id", F.lit(False).alias("skip"))
        if old is not None:
            stored = old.groupBy(F.col("source_id").alias("store_key")).agg(F.first("content_hash").alias("content_hash"), F.first("embedding_model").alias("embedding_model"), (F.count("*") == F.max("total_chunks")).alias("whole"))
            known = stored.where("whole").select("store_key", "content_hash", "embedding_model", F.lit(1).alias("chunk_count"))
            done = upsert.unchanged(s.select(F.col("source_id").alias("store_key"), "content_hash", "embedding_model", F.lit(1).alias("chunk_count")), known).select(F.col("store_key").alias("source_id"), "skip")
        done = store(done, "ingest")
        s = s.join(done.where("NOT skip").select("source_id"), "source_id", "left_semi")
        made = chunking.chunk_documents(s, "source_id", "content", c.tokens, c.overlap)
        made = made.join(s.select("source_id", "content_hash", visibility.alias("visibility")), "source_id").select(
            X.chunk_id(F.lit(c.model), F.lit(bucket), F.col("source_id"), F.col("chunk_index")).alias("id"), "source_id", "chunk_index", "total_chunks", "content", "content_hash", F.lit(bucket).alias("bucket_id"), F.lit(c.model).alias("embedding_model"),
            c.embed(X.strip_markdown(F.col("content")) if c.markdown else F.col("content")).alias("embedding"), F.lit(at).cast("timestamp").alias("indexed_at"), "visibility", *(v.alias(k) for k, v in ids.items()), F.lit(0).alias("seq"),
        )
        kept = made.limit(0) if old is None else old
        if replace:
            kept = kept.join(done.select("source_id"), "source_id", "left_semi").select(kept.columns)
        # one bucket's part is written anew, and only if something changes
        changed = replace or not done.where("NOT skip").isEmpty()
        self.catalog.commit({"last_ingest": done}, {"chunks": {bucket: upsert.chunks(kept, made).select(made.columns)}} if changed else None)
        return self.catalog.read("last_ingest")

    def query(self, text: str, k: int = 10, who: access.Identity = access.Identity(), signals: set[str] = frozenset({"semantic", "keyword"}), buckets: list[str] | None = None, as_of: dt.datetime | None = None, auto_weights: bool = False) -> Results:
        """The best chunks by the signals that are on; one lazy plan up to the limit."""
        self._check("query", who)
        ask = self.spark.createDataFrame([(text,)], "q string")
        kind = ask.select(retrieval.classify(F.col("q"))[0]).first()[0]
        weights = {s: w for s, w in retrieval.CLASS_WEIGHTS[kind].items() if s in signals} if auto_weights else self.config.weights
        chunks = access.scan(self.catalog.read("chunks").where(F.col("embedding_model") == self.config.model), who, buckets, as_of)
        vector = list(ask.select(self.config.embed(F.col("q"))).first()[0])
        terms = [w.lower() for t in X.relaxed_terms(text) for w in t.split()]
        n = retrieval.OVERFETCH * k
        lists = []
        if "semantic" in signals:
            lists.append(retrieval.ranked(retrieval.similarity(chunks, vector), "similarity", n, "id", "rank", ["id", "similarity"]).withColumn("keyword", F.lit(None).cast("double")))
        if "keyword" in signals and terms:
            lists.append(retrieval.ranked(retrieval.keyword_scored(chunks, terms), "keyword", n, "id", "rank", ["id", "keyword"]).withColumn("similarity", F.lit(None).cast("double")))
        both = lists[0]
        for x in lists[1:]:
            both = both.unionByName(x)
        fused = both.groupBy("id").agg(F.max("similarity").alias("similarity"), F.max("keyword").alias("keyword"), F.sum(S.rrf_term(F.col("rank"))).alias("rrf"))
        scores = {"semantic": S.calibrate_semantic(F.coalesce("similarity", F.lit(0.0))), "keyword": S.calibrate_keyword(F.coalesce("keyword", F.lit(0.0))), "rrf": S.normalize_rrf(F.col("rrf"), len(lists))}
        top = fused.withColumn("score", F.round(S.composite_score(scores, set(signals), weights), 9)).orderBy(F.desc("score"), F.desc("rrf"), "id").limit(k)
        if signals & {"graph", "memory"}:
            return Results(self._merged(text, k, who, chunks, fused, vector, terms, set(signals), weights, as_of), kind, set(signals))
        found = chunks.select("id", "source_id", "chunk_index", "bucket_id", "content").join(F.broadcast(top), "id").orderBy(F.desc("score"), F.desc("rrf"), "id")
        return Results(found, kind, set(signals))

    def _merged(self, text: str, k: int, who: access.Identity, chunks: DataFrame, fused: DataFrame, vector: list[float], terms: list[str], signals: set[str], weights: dict[str, float] | None, as_of: dt.datetime | None) -> DataFrame:
        """The runners' lists (index, graph, memory) by chunk identity, calibrated and ranked together."""
        null, n = F.lit(None).cast("double"), retrieval.OVERFETCH * k
        keys = ("bucket_id", "source_id", "chunk_index", "content")

        def shaped(df: DataFrame, mode: str, order: str, **scores: str) -> DataFrame:
            top = retrieval.ranked(df, order, n, "source_id", "rank")
            return top.select(*keys, F.lit(mode).alias("mode"), "rank", *((F.col(scores[c]) if c in scores else null).alias(c) for c in ("semantic", "keyword", "graph", "memory", "memory_similarity")))

        own = chunks.select("id", *keys)
        lists = [shaped(own.join(fused, "id"), "indexed", "rrf", semantic="similarity", keyword="keyword")]
        if "graph" in signals and self.catalog.exists("entities") and self.catalog.exists("edges") and self.catalog.exists("entity_chunks"):
            hits = answers.retrieve(text, self.catalog.read("entities"), self.catalog.read("edges"), self.catalog.read("entity_chunks"), fused.select("id", F.coalesce("similarity", F.lit(0.0)).alias("similarity")), fused.where("keyword IS NOT NULL").select("id", "keyword"), n)
            lists.append(shaped(own.join(hits, "id"), "graph", "final", graph="ppr"))
        if "memory" in signals and self.catalog.exists("memories"):
            found = self._memories(who, as_of=as_of)
            scored = memory.runner_scores(retrieval.similarity(found, vector), as_of or dt.datetime.now(), n)
            lists.append(shaped(scored.select(F.lit("memory").alias("bucket_id"), F.col("id").cast("string").alias("source_id"), F.lit(0).alias("chunk_index"), "content", "score", "similarity"), "memory", "score", memory="score", memory_similarity="similarity"))
        both = lists[0]
        for x in lists[1:]:
            both = both.unionByName(x)
        both = store(both, "candidates")  # a few lists of n rows
        ranked = retrieval.merge_runners(both, k, signals, weights)
        keyed = both.withColumn("key", X.dedup_key(F.col("bucket_id"), F.col("source_id"), F.col("chunk_index"), F.col("content"))).dropDuplicates(["key"])
        return keyed.select("key", *keys).join(F.broadcast(ranked), "key").select(*keys, "modes", "rrf", F.col("composite").alias("score")).orderBy(F.desc("score"), F.desc("rrf"), "key")

    def context(self, results: Results, form: str = "xml", budget: int = context.BUDGETS["total"]) -> str:
        """Text for a prompt from the (short) ranked list."""
        rows = results.ranked.select("content", X.estimate_tokens(F.col("content")).alias("n")).collect()
        return context.render(context.trim({"chunks": [(r["content"], r["n"]) for r in rows]}, budget), form)

    def delete(self, who: access.Identity = access.Identity(), **filters) -> None:
        """Delete the caller's chunks by equality; refuses to delete without a filter."""
        given = access.require_filter(**filters)
        self._check("source.delete", who)
        gone = access.identity_filter(who) & access.visibility_gate(who)
        for c, v in given.items():
            gone = gone & F.col(c).eqNullSafe(F.lit(v))
        parts = [given["bucket_id"]] if "bucket_id" in given else self.catalog.parts("chunks")
        self.catalog.commit({}, {"chunks": {p: self.catalog.read("chunks", p).where(~F.coalesce(gone, F.lit(False))) for p in parts}})

    def delete_bucket(self, bucket: str, who: access.Identity = access.Identity()) -> None:
        """A bucket goes with its chunks, sources and hashes."""
        if bucket == DEFAULT_BUCKET:
            raise ValueError("the default bucket stays")
        self._check("bucket.delete", who)
        rest = {t: self.catalog.read(t).where(~F.col(c).eqNullSafe(F.lit(bucket))) for t, c in (("buckets", "id"), ("sources", "bucket_id"), ("hashes", "bucket_id")) if self.catalog.exists(t) and c in self.catalog.read(t).columns}
        self.catalog.commit(rest, {"chunks": {bucket: None}} if bucket in self.catalog.parts("chunks") else None)

    def update_visibility(self, sources: DataFrame, who: access.Identity = access.Identity()) -> None:
        """New visibility (source_id, visibility) of the caller's sources, for all their chunks."""
        self._check("index", who)
        new = sources.select("source_id", F.col("visibility").alias("__v"), F.lit(True).alias("__x"))
        own = access.identity_filter(who) & access.visibility_gate(who)
        parts = {}
        for p in self.catalog.parts("chunks"):
            c = self.catalog.read("chunks", p)
            parts[p] = c.join(new, "source_id", "left").withColumn("visibility", F.when(F.col("__x") & own, F.col("__v")).otherwise(F.col("visibility"))).select(c.columns)
        self.catalog.commit({}, {"chunks": parts})

    def remember(self, memories: DataFrame, who: access.Identity = access.Identity()) -> None:
        """Upsert the caller's memories by id and tenant; an embedding is kept when the new one is null."""
        self._check("memory.write", who)
        for k in ("tenant", "group", "user", "agent", "conversation"):
            given = who.given().get(k)
            if given is not None or f"{k}_id" not in memories.columns:
                memories = memories.withColumn(f"{k}_id", F.lit(given).cast("string"))
        if "visibility" not in memories.columns:
            memories = memories.withColumn("visibility", F.lit(None).cast("string"))
        old = self.catalog.read_or("memories", memories)
        self.catalog.commit({"memories": upsert.keyed(old, memories, ["id", "tenant_id"], "created_at", keep_old=("category",), coalesce=tuple(c for c in ("embedding",) if c in memories.columns))})

    def _memories(self, who: access.Identity, **filters) -> DataFrame:
        """The memories that the caller may see."""
        return self.catalog.read("memories").where(access.identity_filter(who) & access.visibility_gate(who) & access.memory_filter(**filters))

    def recall(self, vector: list[float], k: int = 10, who: access.Identity = access.Identity(), as_of: dt.datetime | None = None, **filters) -> DataFrame:
        self._check("memory.read", who)
        return retrieval.semantic_topk(self._memories(who, as_of=as_of, **filters), vector, k)

    def forget(self, as_of: dt.datetime, policy: str = "archive", who: access.Identity = access.Identity()) -> None:
        """The caller's decayed memories; those of others stay as they are."""
        self._check("memory.delete", who)
        every = self.catalog.read("memories")
        own = F.coalesce(access.identity_filter(who) & access.visibility_gate(who), F.lit(False))
        self.catalog.commit({"memories": memory.forget(every.where(own), as_of, policy).select(every.columns).unionByName(every.where(~own))})
