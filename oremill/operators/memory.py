"""Agent-memory operators over memories (id, category, status, importance, access_count, last_accessed_at, created_at, valid_at, invalid_at)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oremill.functions import scoring as S
from oremill.functions.temporal import may_move

#: Fixed value: the labels of categories in memory prompts.
CATEGORY_TITLES = {"semantic": "Facts", "episodic": "Episodes", "procedural": "Procedures"}


def age_ms(as_of: dt.datetime) -> Column:
    """Milliseconds from the last access (else creation) to as_of."""
    since = F.coalesce("last_accessed_at", "created_at")
    return ((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / 1000).cast("double")


def decayed(memories: DataFrame, as_of: dt.datetime) -> DataFrame:
    return memories.withColumn("decay", F.round(S.decay_score(age_ms(as_of), F.col("importance"), F.col("access_count")), 6))


def forget(memories: DataFrame, as_of: dt.datetime, policy: str = "archive", least: float = 0.1) -> DataFrame:
    """archive: decayed active rows become archived; delete: they go; summarize: they become consolidated."""
    scored = decayed(memories, as_of)
    stale = (F.col("decay") < least) & (F.col("status") == "active")
    if policy == "delete":
        return scored.where(~stale).drop("decay")
    to = {"archive": "archived", "summarize": "consolidated"}[policy]
    return scored.withColumn("status", F.when(stale, to).otherwise(F.col("status"))).drop("decay")


def runner_scores(memories: DataFrame, as_of: dt.datetime, k: int) -> DataFrame:
    """Memories with a similarity, scored for fusion: score desc, id."""
    score = S.memory_score(F.col("similarity"), F.col("importance"), S.recency(age_ms(as_of)))
    return memories.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "id").limit(k)


def health(memories: DataFrame, entities: DataFrame, edges: DataFrame, as_of: dt.datetime) -> DataFrame:
    """One row of counts, precision, staleness and edges per entity, over all rows."""
    status = lambda s: F.count_if(F.col("status") == s)
    kept = status("active") + status("invalidated")
    stale = F.count_if((F.col("status") == "active") & (F.col("decay") < 0.1))
    m = decayed(memories, as_of).agg(
        F.count("*").alias("total"), status("active").alias("active"), status("invalidated").alias("invalidated"), status("consolidated").alias("consolidated"),
        F.round(F.when(kept > 0, status("active") / kept).otherwise(1.0), 3).alias("precision"), F.round(F.when(status("active") > 0, stale / status("active")).otherwise(0.0), 3).alias("staleness"),
    )
    e = entities.agg(F.count("*").alias("entities")).crossJoin(edges.agg(F.count("*").alias("edges")))
    return m.crossJoin(e).withColumn("edges_per_entity", F.round(F.when(F.col("entities") > 0, F.col("edges") / F.col("entities")).otherwise(0.0), 2))


def record_access(memories: DataFrame, accesses: DataFrame) -> DataFrame:
    """Adds accesses (id, ts): counts, and the latest time."""
    seen = accesses.groupBy("id").agg(F.count("*").alias("__n"), F.max("ts").alias("__t"))
    out = memories.join(seen, "id", "left")
    return out.withColumn("access_count", F.col("access_count") + F.coalesce("__n", F.lit(0))).withColumn("last_accessed_at", F.greatest("last_accessed_at", "__t")).drop("__n", "__t")


def invalidate(memories: DataFrame, ids: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Ends the validity of the given ids; their status becomes invalidated where it may."""
    out = memories.join(ids.select("id").distinct().withColumn("__x", F.lit(True)), "id", "left")
    hit = F.col("__x").isNotNull()
    return (
        out.withColumn("invalid_at", F.when(hit & F.col("invalid_at").isNull(), F.lit(as_of)).otherwise(F.col("invalid_at")))
        .withColumn("status", F.when(hit & may_move(F.col("status"), F.lit("invalidated")), "invalidated").otherwise(F.col("status")))
        .drop("__x")
    )


def transitions(requests: DataFrame) -> DataFrame:
    """Requests (id, status, wanted) with the state that results and whether the move is allowed."""
    ok = may_move(F.col("status"), F.col("wanted"))
    return requests.withColumn("allowed", ok).withColumn("result", F.when(ok, F.col("wanted")).otherwise(F.col("status")))


def consolidation_batches(memories: DataFrame, as_of: dt.datetime, least_age_h: int = 1, size: int = 10) -> DataFrame:
    """Active episodes older than least_age_h, in batches of `size` a conversation by time: what a summariser gets at once."""
    ready = memories.where((F.col("category") == "episodic") & (F.col("status") == "active") & (F.col("created_at") <= F.lit(as_of - dt.timedelta(hours=least_age_h))))
    place = F.row_number().over(Window.partitionBy("conversation_id").orderBy("created_at", "id"))
    return ready.withColumn("batch", F.floor((place - 1) / size).cast("int"))


def summarise(batches: DataFrame, summary: Callable[[list[str]], str]) -> DataFrame:
    """conversation_id, batch, n, content: one semantic memory a batch, by a plug-in that maps texts to a text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["content"] = [summary(list(x)) for x in f.pop("contents")]
            yield f

    grouped = batches.groupBy("conversation_id", "batch").agg(F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("created_at", "id", "content"))), lambda s: s["content"]).alias("contents"))
    kind = batches.schema["conversation_id"].dataType.simpleString()
    return grouped.mapInPandas(run, f"conversation_id {kind}, batch int, n long, content string")


def correct(memories: DataFrame, corrections: DataFrame, as_of: dt.datetime, most: int = 1000) -> DataFrame:
    """Facts that contain a correction's wrong text, or are contained in it, end; corrections: wrong.

    Corrections are one request's, broadcast up to `most`; more are refused."""
    facts = memories.where((F.col("category") == "semantic") & (F.col("status") == "active")).select("id", F.lower("content").alias("c"))
    wrong = corrections.select(F.lower("wrong").alias("w")).distinct()
    if wrong.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} corrections at once")
    hit = facts.join(F.broadcast(wrong), F.contains("c", F.col("w")) | F.contains("w", F.col("c"))).select("id")
    return invalidate(memories, hit, as_of)


def prompt(memories: DataFrame, by: tuple[str, ...] = ("conversation_id",)) -> DataFrame:
    """by, category, text: a bulleted list of contents by category, for each conversation (or whatever bounds a prompt)."""
    title = F.lit("Memories")
    for k, v in CATEGORY_TITLES.items():
        title = F.when(F.col("category") == k, v).otherwise(title)
    lines = F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("id", "content"))), lambda s: F.concat(F.lit("- "), s["content"])))
    return memories.groupBy(*by, "category").agg(lines.alias("lines")).select(*by, "category", F.concat_ws("\n", F.concat(title, F.lit(":")), "lines").alias("text"))


def expire(memories: DataFrame, ids: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The given ids end their life, whatever their state; expired_at says when."""
    if "expired_at" not in memories.columns:
        memories = memories.withColumn("expired_at", F.lit(None).cast("timestamp"))
    out = memories.join(ids.select("id").distinct().withColumn("__x", F.lit(True)), "id", "left")
    hit = F.col("__x").isNotNull()
    return out.withColumn("expired_at", F.when(hit, F.lit(as_of).cast("timestamp")).otherwise(F.col("expired_at"))).withColumn("status", F.when(hit, "expired").otherwise(F.col("status"))).drop("__x")


def history(memories: DataFrame, memory_id) -> DataFrame:
    """The one row that is kept of a memory, whatever its state."""
    return memories.where(F.col("id") == memory_id)


def has_any(memories: DataFrame) -> bool:
    """Is there a memory at all? One row is read."""
    return not memories.limit(1).isEmpty()


def about(memories: DataFrame, links: DataFrame, entities: DataFrame) -> DataFrame:
    """Memories linked (memory_id, entity_id) to any of the given entities (id)."""
    at = links.join(entities.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_semi")
    return memories.join(at.select(F.col("memory_id").alias("id")).distinct(), "id", "left_semi")


def promotable(memories: DataFrame, word: str, least: int = 3, most: int = 50) -> DataFrame:
    """Conversations with `least` active episodes that tell of an action, and their first `most` episodes' ids: what procedures are learned from."""
    acts = memories.where((F.col("category") == "episodic") & (F.col("status") == "active") & F.contains(F.lower("content"), F.lit(word)))
    w = Window.partitionBy("conversation_id").orderBy("created_at", "id")
    first = acts.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most)
    lists = first.groupBy("conversation_id").agg(F.count("*").alias("episodes"), F.transform(F.sort_array(F.collect_list(F.struct("__n", "id"))), lambda s: s["id"]).alias("ids"))
    return lists.where(F.col("episodes") >= least)


def contradictions(facts: DataFrame, new: DataFrame, judge: Callable[[str, str], bool], k: int = 10) -> DataFrame:
    """new_id, id of old facts (id, content, embedding) that a new one (new_id, content, embedding) contradicts, by a plug-in that sees the k nearest of each."""
    from oremill.operators.retrieval import batch_topk

    near = batch_topk(facts, new.select(F.col("new_id").alias("query_id"), "embedding"), k).select(F.col("query_id").alias("new_id"), "id")
    pairs = near.join(facts.select("id", F.col("content").alias("old")), "id").join(new.select("new_id", F.col("content").alias("said")), "new_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[[judge(a, b) for a, b in zip(f["said"], f["old"], strict=True)]][["new_id", "id"]]

    return pairs.mapInPandas(run, "new_id long, id long")
