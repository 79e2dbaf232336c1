"""Document fingerprints: an improbable-feature similarity digest.

1. Every WINDOW-byte window of a text gets its Shannon entropy, kept up to date from byte to byte: a byte that
   enters or leaves a window changes it by a function of how often the byte is in it. Sums are integers.
2. Rarity: how often each of the LEVELS of entropy occurs over all windows of the corpus (a histogram of fixed
   size, counted over every row); the rarer a window's level, the lower its rank. Near-constant and near-random
   windows (levels outside LOW..HIGH) are never features.
3. Of every RUN neighbouring windows, the leftmost of least rank gets a point; windows of at least POINTS points
   are the document's features.
4. A feature's bytes set five bits of a 2048-bit Bloom filter; after PER_FILTER features the next filter is begun,
   so a long text is a chain of filters. The digest is written as hexadecimal, a filter to 512 digits, with its
   number of features.
5. Likeness: each filter of the shorter chain takes its best partner in the other: common bits, less those that
   chance explains, over those possible; the mean over the filters.

One rule holds for texts of all sizes; a text without features (shorter than a window, or flat) is one feature, the whole text. Defined results: null text
is empty; the empty text has no filter, is like another empty text (1) and unlike all else (0); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .minhash import mix

WINDOW, RUN, LEVELS, LOW, HIGH, POINTS, PER_FILTER, BITS, SLACK = 8, 16, 1000, 100, 990, 4, 160, 2048, 0.3
SCALE = 1 << 20
#: Ranges of ids, at most: their bounds are sent to all tasks.
RANGES = 16_384
_C = np.arange(WINDOW + 2, dtype=np.float64)
_CLOGC = np.round(SCALE * _C * np.log2(np.maximum(_C, 1))).astype(np.int64)
_STEP = _CLOGC[1:] - _CLOGC[:-1]
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint16)


def levels(x: np.ndarray) -> np.ndarray:
    """The level of entropy (0 to LEVELS) of each window of bytes x."""
    n = len(x)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    before = np.zeros(n, np.uint8)  # equal bytes among those before in a window
    after = np.zeros(n, np.uint8)
    for d in range(1, WINDOW):
        same = x[d:] == x[:-d]
        before[d:] += same
        after[:-d] += same
    first = int(_CLOGC[np.bincount(x[:WINDOW], minlength=256)].sum())
    change = np.empty(n - WINDOW + 1, np.int64)
    change[0] = first
    change[1:] = _STEP[before[WINDOW:]] - _STEP[after[: n - WINDOW]]
    entropy = np.log2(WINDOW) - np.cumsum(change) / (SCALE * WINDOW)
    return np.clip(np.floor(entropy / np.log2(WINDOW) * LEVELS + 0.5), 0, LEVELS).astype(np.int64)


def features(x: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Where the chosen windows begin. rank: of each level, lower is rarer."""
    n = len(x) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64)
    level = levels(x)
    never = (level < LOW) | (level > HIGH)
    r = np.where(never, LEVELS + 1, rank[level])
    key = (r << 40) + np.arange(n)
    least, span = key, 1
    while span < RUN:  # the minimum over `span` windows, doubled
        step = min(span, RUN - span)
        least = np.minimum(least[: len(least) - step], least[step:]) if len(least) > step else least[:1] * 0 + least.min()
        span += step
    points = np.bincount(least & (1 << 40) - 1, minlength=n)
    need = min(POINTS, max(1, n - RUN + 1))
    return np.flatnonzero((points >= need) & ~never)


def digest(x: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The chain of filters (k x 256 bytes) and the features in each."""
    if not len(x):
        return np.zeros((0, BITS // 8), np.uint8), []
    at = features(x, rank)
    if len(at):
        words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, WINDOW)[at]).view(np.uint64)
        h = np.zeros(len(at), np.uint64)
        for i in range(WINDOW // 8):
            h = mix(h ^ words[:, i])
        h = h[np.sort(np.unique(h, return_index=True)[1])]  # each feature once, in order
    else:
        h = np.frombuffer(hashlib.sha256(x.tobytes()).digest()[:8], np.uint64)
    k = -(-len(h) // PER_FILTER)
    bits = np.zeros((k, BITS), np.uint8)
    filter_of = np.arange(len(h)) // PER_FILTER
    for i in range(5):
        bits[filter_of, ((h >> np.uint64(11 * i)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1), np.bincount(filter_of, minlength=k).tolist()


def likeness(a: tuple[np.ndarray, list[int]], b: tuple[np.ndarray, list[int]]) -> float:
    """0 to 1."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    if (len(a[0]), sum(a[1])) > (len(b[0]), sum(b[1])):
        a, b = b, a
    ones_b, total = _ONES[b[0]].sum(axis=1).astype(np.float64), 0.0
    for row in a[0]:
        ones = float(_ONES[row].sum())
        common = _ONES[b[0] & row].sum(axis=1)
        most = np.minimum(ones, ones_b)
        chance = ones * ones_b / BITS
        cut = chance + SLACK * (most - chance)
        total += float(np.max(np.where(most > cut, np.clip((common - cut) / np.maximum(most - cut, 1e-9), 0, 1), common == most)))
    return total / len(a[0])


def written(d: tuple[np.ndarray, list[int]]) -> str:
    return "|".join(f"{n}:{row.tobytes().hex()}" for row, n in zip(*d, strict=True))


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The rank of each level by how often it occurs over all windows of all texts, rarest first; ties by level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS + 1, np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    total += np.bincount(levels(_bytes(text)), minlength=LEVELS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS + 1)), pa.array(total)], ["level", "n"])

    counts = np.zeros(LEVELS + 1, np.int64)
    for r in base.map_arrow(docs.select(F.col(text_col).alias("text")), run, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():  # LEVELS rows
        counts[r["level"]] = r["n"]
    rank = np.empty(LEVELS + 1, np.int64)
    rank[np.lexsort((np.arange(LEVELS + 1), counts))] = np.arange(LEVELS + 1)
    return rank


def fingerprint(docs: DataFrame, rank: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint of each row. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([written(digest(_bytes(t or ""), rank)) for t in b.column(1).to_pylist()], pa.string())], ["id", "fingerprint"])

    return base.map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """docs dealt into ranges of descending id: columns range, id, text, hash, tail; a range's last rows (tail) are copies of the row
    that begins the next one. Rows with equal ids are ordered by text; null ids come last, by the hash of their text. Also the number of ranges.

    Ranges begin at quantiles of the ids, so they are of near equal counts however the ids lie: twice as many as shuffle partitions, at most
    RANGES. Null ids are cut into as many by ranges of the hash. A range is sorted with spilling and read as a stream, so its size bounds no memory."""
    spark = docs.sparkSession
    base.prepare(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.when(F.col(id_col).isNull(), F.xxhash64(text)).alias("hash"))
    ranges = min(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), RANGES)
    cuts = F.percentile_approx("id", [k / ranges for k in range(1, ranges)], 20 * ranges)
    total, known, high, bounds = own.agg(F.count("*"), F.count("id"), F.max("id"), cuts).first()
    bounds = np.array(sorted({b for b in bounds or [] if b != high}), np.int64)  # range k begins at the k-th from the end; the first one at the highest id
    nulls = -(-ranges * (total - known) // max(total, 1))
    cell = F.floor((F.col("hash") / 2.0**64 + 0.5) * nulls).cast("int")
    heads = {r["cell"]: r["head"] for r in own.where("id IS NULL").groupBy(cell.alias("cell")).agg(F.min("hash").alias("head")).collect()} if nulls else {}  # `nulls` rows
    base_of = (len(bounds) + 1) if known else 0
    order = [*range(base_of), *(base_of + c for c in sorted(heads))]
    before = {k: order[i - 1] for i, k in enumerate(order)}  # the first row follows the last
    head_of = {base_of + c: h for c, h in heads.items()}

    @F.pandas_udf("range int, before int")
    def placed(missing: pd.Series, ids: pd.Series, cells: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        at = np.where(missing, base_of + cells.to_numpy(), len(bounds) - np.searchsorted(bounds, ids.to_numpy(), side="left"))
        begin = np.array([high if high is not None else 0, *bounds[::-1]], np.int64)
        first = [h == head_of.get(k) if m else i == begin[k] for m, i, k, h in zip(missing, ids, at, hashes, strict=True)]
        return pd.DataFrame({"range": at.astype(np.int32), "before": pd.array([before[int(k)] if f else None for k, f in zip(at, first, strict=True)], "Int32")})

    zero = F.lit(0).cast("long")
    own = own.withColumn("p", placed(F.col("id").isNull(), F.coalesce("id", zero), F.coalesce(cell, F.lit(0)), F.coalesce("hash", zero)))
    copies = F.filter(F.array(F.struct(F.col("p.range").alias("range"), F.lit(False).alias("tail")), F.struct(F.col("p.before").alias("range"), F.lit(True).alias("tail"))), lambda c: c["range"].isNotNull())
    return own.select("id", "text", "hash", F.explode(copies).alias("c")).select("id", "text", "hash", "c.range", "c.tail"), ranges + nulls


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The edited text has its last third replaced by as many first characters of the next document (by descending id;
    the first follows the last). One shuffle of the texts, by range of ids; only the row that ends a range is read twice."""
    rank = rarity(docs, text_col)
    dealt, ranges = with_next(docs, id_col, text_col)
    dealt = dealt.repartitionByRange(ranges, "range").sortWithinPartitions("range", "tail", F.desc_nulls_last("id"), "hash", "text").drop("hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (range, id, text, digest) that waits for its next
        for b in batches:
            out: list[tuple] = []
            for key, i, text, tail in zip(*(b.column(c).to_pylist() for c in ("range", "id", "text", "tail")), strict=True):
                same = last is not None and last[0] == key
                if tail and not same:
                    continue
                d = digest(_bytes(text), rank)
                if same:
                    _, j, t, dt = last
                    n = len(t)
                    take = n // 3
                    edited = t[: n - take] + text[:take]
                    de = digest(_bytes(edited), rank)
                    out.append((j, n, hashlib.sha256(edited.encode()).hexdigest(), written(dt), written(de), likeness(dt, de), likeness(dt, d)))
                if tail:
                    last = None
                else:
                    last = (key, i, text, d)
            names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    return base.map_arrow(dealt, run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("id", id_col)
