"""Exact deduplication by deterministic block naming (native: DataFrame functions only).

A normalised text is cut into blocks of BLOCK code points. Blocks are sorted and equal blocks get one
integer name, the smallest number among their occurrences; then the names of adjacent blocks are paired,
pairs are named in the same way, and so on until each document has one name. Names stand for contents,
not for hashes of them, so equal (length, name) means equal texts: there are no collisions.

Skew: a block that makes up more than a 4096th of all blocks (so there are at most HOT of them, and at most
HOT * BLOCK code points) is named by a broadcast join and its rows are dealt out by number; rarer blocks are
named by a sort within their hash partition. Higher names are pairs of integers, pre-aggregated before they are
shuffled and joined back from stored tables, where adaptive execution splits a hot pair. A document group
of any size is one row of a pre-aggregated table.

Defined results: null text is empty; empty texts form one group; rows with a null id take part (an id beats
none when lengths tie) and repeated rows are separate rows of one group, of which exactly one is kept; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import base

BLOCK = 4096
#: At most this many blocks are broadcast; no block of fewer than MIN_HOT rows is.
HOT, MIN_HOT = 4096, 1000
#: Fixed value: the characters that normalisation deletes.
DELETED = "[\\x20\\x09-\\x0D]+"
_ROW = "__oremill_row"


def _blocks(docs: DataFrame, id_col: str, text_col: str, row: Column | None) -> DataFrame:
    """One row per block: row, pos, block, parts; the document's own columns at pos 0 only."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(
        (F.monotonically_increasing_id() if row is None else row).alias("row"), F.col(id_col).alias("id"), F.length(text).alias("n_chars"), F.regexp_replace(text, DELETED, "").alias("norm")
    )
    split = whole.select("row", "id", "n_chars", F.length("norm").alias("n_norm"), F.sha2("norm", 256).alias("sha"), F.posexplode_outer(F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).alias("pos", "block"))
    first = F.coalesce("pos", F.lit(0)) == 0
    return split.select(
        "row", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("block", F.lit("")).alias("block"), "n_norm",
        F.greatest(F.lit(1), F.ceil(F.col("n_norm") / BLOCK)).cast("int").alias("parts"),
        *(F.when(first, F.col(c)).alias(c) for c in ("id", "n_chars", "sha")),
        F.monotonically_increasing_id().alias("number"),
    )


def _named_blocks(blocks: DataFrame) -> DataFrame:
    """Level 0: every block's name. Hot blocks get the names -1, -2, ... in their order."""
    counts = base.store(blocks.groupBy(F.xxhash64("block").alias("h")).count(), "block-counts")
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = [r[0] for r in counts.where(F.col("count") > max(total / HOT, MIN_HOT)).select("h").collect()]  # fewer than HOT
    base.drop(counts)
    if hot:
        names = blocks.where(F.xxhash64("block").isin(hot)).groupBy("block").agg(F.lit(1).alias("one"))
        order = Window.partitionBy("one").orderBy("block")
        blocks = blocks.join(F.broadcast(names.select("block", (-F.row_number().over(order)).cast("long").alias("hot"))), "block", "left")
    else:
        blocks = blocks.withColumn("hot", F.lit(None).cast("long"))
    # a hot block's rows are dealt by their numbers and carry no text any more
    keyed = blocks.withColumn("key", F.when(F.col("hot").isNull(), F.col("block"))).withColumn("deal", F.when(F.col("hot").isNotNull(), F.pmod("number", F.lit(65_536)))).drop("block")
    same = Window.partitionBy("key", "deal").orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return keyed.select("row", "pos", "n_norm", "parts", "id", "n_chars", "sha", "number", F.coalesce("hot", F.first("number").over(same)).alias("name"))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None) -> DataFrame:
    """row, id, n_chars, n_norm, sha, name: equal (n_norm, name) means equal normalised texts.

    row: a stored number of each row, unique; else rows are numbered in the one scan that makes the names."""
    level = base.store(_named_blocks(_blocks(docs, id_col, text_col, row)), "level0")
    heads = level.where("pos = 0").select("row", "id", "n_chars", "n_norm", "sha", "parts", F.col("name").alias("own"))
    deepest = level.agg(F.max("parts")).first()[0] or 1
    left, done = level.where("parts > 1").select("row", "pos", "parts", "number", "name"), None
    for k in range(math.ceil(math.log2(deepest))):
        half = F.shiftright("pos", 1).alias("pos")
        odd = F.col("pos") % 2 == 1
        pairs = left.groupBy("row", half).agg(
            F.max(F.when(~odd, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-(1 << 62))).alias("b"), F.min("number").alias("number"), F.ceil(F.max("parts") / 2).cast("int").alias("parts")
        )
        pairs = base.store(pairs, f"pairs{k}")
        names = base.store(pairs.groupBy("a", "b").agg(F.min("number").alias("name")), f"names{k}")
        named = pairs.join(names, ["a", "b"]).select("row", "pos", "parts", "number", "name")
        ended = named.where("parts = 1").select("row", "name")
        done = ended if done is None else done.unionByName(ended)
        left = named.where("parts > 1")
    if done is None:
        return heads.withColumnRenamed("own", "name").drop("parts")
    return heads.join(done, "row", "left").withColumn("name", F.coalesce("name", "own")).drop("own", "parts")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 (, and its row number, if `row` gives a stored one).

    Of equal texts, the one with the most code points stays, then the smallest id."""
    each = base.store(identities(docs, id_col, text_col, row), "identities")
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("id").isNull().alias("none"), "id", "row"))
    groups = base.store(each.groupBy("n_norm", "name").agg(best.alias("best"), F.count("*").alias("group_size")), "groups")
    out = each.join(groups, ["n_norm", "name"])
    return out.select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256"), *([] if row is None else [F.col("row").alias(_ROW)])
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns.

    docs is stored once with a number for each row, and both the names and the rows that stay are read from that table: numbers made
    in two scans would differ whenever the files are split otherwise, as with another number of executors."""
    numbered = base.store(docs.withColumn(_ROW, F.monotonically_increasing_id()), "numbered")
    kept = exact_dedup(numbered, id_col, text_col, F.col(_ROW)).where("kept").select(_ROW)
    return numbered.join(kept, _ROW, "left_semi").drop(_ROW)


ORACLE = """
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS c, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t ORDER BY c DESC, doc_id)
"""
