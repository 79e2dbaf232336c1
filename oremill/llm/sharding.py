"""Sharding by proportional stratified interleaving (native: DataFrame functions only).

Rows of each source are put in the order of a seeded hash; the k-th of a source's n rows has the fractional
rank (k + 1/2) / n; all rows are sorted by it, so that every stretch of the order holds the sources in their
proportions; the order is cut into shards whose row counts differ by one at most.

Ranks are exact and no task holds a whole source (``place``): a sort key is cut into cells of about CELL rows;
counts of cells are summed in two levels, and only the rows of a cell are sorted together.

Defined results: null text has size 1; null sources are one source; rows with a null id are dealt like others;
repeated rows are separate rows; shards may be empty when there are fewer rows than shards; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import base

#: Rows in a cell, about.
CELL = 2048
KEY_BITS = 52


def place(df: DataFrame, stratum: str, key: str, bits: int, ties: list[str]) -> DataFrame:
    """df with `place`, a row's 0-based place in its stratum by (key, ties), and `among`, the stratum's rows.

    key: a long from 0 to 2^52, near evenly spread; 2^bits cells."""
    order = [stratum, "__coarse", "__cell"]
    df = df.withColumn("__cell", F.shiftright(key, KEY_BITS - bits)).withColumn("__coarse", F.shiftright("__cell", bits - bits // 2))
    cells = base.store(df.groupBy(*order).agg(F.count("*").alias("n")), "cells")
    earlier = (Window.unboundedPreceding, -1)
    fine = cells.withColumn("fine", F.coalesce(F.sum("n").over(Window.partitionBy(stratum, "__coarse").orderBy("__cell").rowsBetween(*earlier)), F.lit(0)))
    coarse = cells.groupBy(stratum, "__coarse").agg(F.sum("n").alias("m"))
    coarse = coarse.select(
        stratum, "__coarse", F.coalesce(F.sum("m").over(Window.partitionBy(stratum).orderBy("__coarse").rowsBetween(*earlier)), F.lit(0)).alias("far"), F.sum("m").over(Window.partitionBy(stratum)).alias("among")
    )
    offsets = base.store(fine.join(coarse, [stratum, "__coarse"]).select(*order, (F.col("fine") + F.col("far")).alias("before"), "among"), "offsets")
    within = Window.partitionBy(stratum, "__cell").orderBy(key, *ties)
    return df.join(offsets, order).withColumn("place", F.col("before") + F.row_number().over(within) - 1).drop("before", "__cell", "__coarse")


def _floor(df: Column) -> Column:
    return F.floor(df).cast("long")


def interleave(docs: DataFrame, shards: int = 8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard and place: the law is `rows`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"),
        F.when(F.col(source_col).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(source_col).cast("string"))).alias("stratum"),
    )
    rows = base.store(rows.withColumn("key", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 64 - KEY_BITS)), "rows")
    total = rows.count()
    bits = max(1, (max(total, 1) // CELL).bit_length())
    ranked = place(rows, "stratum", "key", bits, ["id", "size", "text_crc32"])
    fraction = (F.col("place") + 0.5) / F.col("among")
    ranked = base.store(ranked.select("id", "size", "text_crc32", "stratum", F.col("place").alias("own"), _floor(fraction * float(1 << KEY_BITS)).alias("key"), F.lit(0).alias("all")), "fractions")
    out = place(ranked, "all", "key", bits, ["stratum", "own"])
    shard = _floor(F.expr(f"place * {shards} div {max(total, 1)}"))
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return (
        out.withColumn("shard", shard.cast("int"))
        .withColumn("slot", (F.col("place") - first).cast("long"))
        .select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
    )
