"""Near-duplicates by ProbMinHash, banding and verification.

1. Shingles: five consecutive words (runs of letters, digits and underscores, lower-cased); a text of one to four
   words is one shingle. Documents with the same sequence of words are collapsed first: one representative, its
   class and its members, whatever their number. A shingle that occurs f times weighs 1 + ln f.
2. ProbMinHash: each shingle is a Poisson process whose rate is its weight; its arrivals carry a random register
   each. A register keeps the shingle of its first arrival, so two texts agree in a register with the probability
   Jaccard similarity of their weighted shingles. Arrivals are drawn round by round for a batch of texts at once,
   and a shingle's process ends at its first arrival after the latest of its text's register minima.
3. Banding: BANDS groups of ROWS registers of the weighted sketch, and of the sketch of the bare set (all weights 1)
   where a shingle is repeated; without repeats the two are the same. Links are defined by bare sets, and two texts'
   bare sketches agree in a register with the probability of their sets' Jaccard similarity, so that at 0.8 a pair
   shares no band with a probability of 5e-6, whatever its weights. Bands with one representative are dropped.
4. Verification. A pair is a link where the exact Jaccard similarity of its sets of shingles reaches the threshold.
   In every band the smallest id leads, and only pairs with the leader are compared (a star, never all pairs). Links
   give classes; bands whose members have one class are settled. One round of further stars, from a member of
   the least and one of the greatest of a band's classes, joins most of what is left. The members of bands that
   are still unsettled go through an exact prefix filter: a document's shingles are put in the order of how many of
   these documents hold them, and a link needs a common shingle among the first (1 - threshold) share of both. A
   common passage comes late in that order, so sharing it makes no pair. At a pair's first common shingle, what
   follows in both must be enough for the threshold. Only pairs of different classes and of sizes within the
   threshold are compared. So every linked pair that shares a band ends in one class, and no list
   of candidates is capped.
5. Classes are the connected components of the links, by label propagation with pointer jumping over stored tables.

Defined results: null text is empty; a text without words has no shingles and is a class of its own; repeated rows
(equal ids and texts) fall in one class; texts of one id are told apart, each by its words, so that a class is one of texts (two classes whose smallest ids
are equal have that one as their class_id); a null id is in no link and is a class of its own (class_id null); extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base

WORDS, THRESHOLD, BANDS, ROWS = 5, 0.8, 40, 6
_WORD = re.compile(r"\w+")
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix)."""
    x = x + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def word_hash(w: str) -> int:
    return xxhash.xxh3_64_intdigest(w)


_HASHES = base.Memo(word_hash)


def word_hashes(text: str) -> np.ndarray:
    words = _WORD.findall(text.lower())
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Hashes of the runs of k words, in order; of all words where there are fewer."""
    n = max(len(words) - k + 1, min(len(words), 1))
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(words))):
        out = mix(out ^ words[i : i + n]) if n else out
    return out


def weighted(words: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    values, counts = np.unique(shingles(words, k), return_counts=True)
    return values, 1.0 + np.log(counts)


def probminhash(texts: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """Signatures (texts x m) of weighted sets without empty ones."""
    sizes = np.array([len(v) for v, _ in texts], np.int64)
    value = np.concatenate([v for v, _ in texts]) if texts else np.zeros(0, np.uint64)
    weight = np.concatenate([w for _, w in texts]) if texts else np.zeros(0)
    doc = np.repeat(np.arange(len(texts)), sizes)
    least = np.full(len(texts) * m, np.inf)
    winner = np.zeros(len(texts) * m, np.uint64)
    time, state = np.zeros(len(value)), value
    live = np.arange(len(value))
    while len(live):
        state = mix(state)
        # the exponential gap to the next arrival, and the register that it goes to
        time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[live]
        slot = doc[live] * m + (mix(state ^ _M2) % np.uint64(m)).astype(np.int64)
        np.minimum.at(least, slot, time)
        won = least[slot] == time
        winner[slot[won]] = value[live[won]]
        latest = least.reshape(len(texts), m).max(axis=1)
        go = time < latest[doc[live]]
        live, time, state = live[go], time[go], state[go]
    return winner.reshape(len(texts), m)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(signatures), bands), np.uint64)
    for r in range(rows):
        out = mix(out ^ signatures[:, r::rows][:, :bands])
    return out.view(np.int64)


def words_key(words: np.ndarray) -> bytes | None:
    """A key of the sequence of words; null without words."""
    return xxhash.xxh3_128_digest(words.tobytes()) if len(words) else None


def _sketches(docs: DataFrame, bands: int, rows: int, k: int) -> DataFrame:
    """id, row, words_key and the distinct keys of its bands, from id, text and row."""
    number = mix(np.arange(bands, dtype=np.uint64))

    def keyed(texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return mix(band_keys(probminhash(texts, bands * rows), bands, rows).view(np.uint64) ^ number).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [word_hashes(x or "") for x in b.column(1).to_pylist()]
            keys = list(map(words_key, words))
            full = [i for i, w in enumerate(words) if len(w)]
            got: list = [None] * len(words)
            at = 0
            while at < len(full):  # groups of texts of about 200,000 words together
                to, total = at, 0
                while to < len(full) and (to == at or total + len(words[full[to]]) <= 200_000):
                    total += len(words[full[to]])
                    to += 1
                texts = [weighted(words[i], k) for i in full[at:to]]
                for i, x in zip(full[at:to], keyed(texts), strict=True):
                    got[i] = x
                repeats = [(i, (v, np.ones(len(v)))) for i, (v, w) in zip(full[at:to], texts, strict=True) if w.max() > 1]
                if repeats:
                    for (i, _), x in zip(repeats, keyed([t for _, t in repeats]), strict=True):
                        got[i] = np.unique(np.r_[got[i], x])
                at = to
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(keys, pa.binary()), pa.array(got, pa.list_(pa.int64()))], ["id", "row", "words_key", "bands"])
        _HASHES.reset()  # the worker lives on for other operators

    return base.map_arrow(docs.select("id", "text", "row"), run, "id long, row long, words_key binary, bands array<long>")


def shingle_sets(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """words_key and the sorted set of shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [word_hashes(x or "") for x in b.column(0).to_pylist()]
            got = [np.unique(shingles(w, k)).view(np.int64) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(list(map(words_key, words)), pa.binary()), pa.array(got, pa.list_(pa.int64()))], ["words_key", "shingles"])
        _HASHES.reset()

    return base.map_arrow(docs.select("text"), run, "words_key binary, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with their exact Jaccard similarity. The sets go by stored tables, where a hot id can be split."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", (common / (F.size("x") + F.size("y") - common)).alias("similarity"))


def links(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """A stored table of linked pairs (a, b) that joins all classes, from the members (band, id) of the bands. members, if stored, is deleted."""
    room, fuzz, spark = 1 - threshold, 1e-9, members.sparkSession
    none = spark.createDataFrame([], "a long, b long")

    def linked(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        known = base.store(_verified(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets), "verified")
        return known, known.where(F.col("similarity") >= threshold - fuzz).select("a", "b")

    leads = base.store(members.groupBy("band").agg(F.min("id").alias("lead")), "leads")
    star = base.store(members.join(leads, "band"), "star")
    base.drop(members, leads)
    known, found = linked(star.select(F.col("lead").alias("a"), F.col("id").alias("b")))
    found = base.store(none.unionByName(found), "links")

    def unsettled() -> DataFrame:
        labels = components(found)
        placed = star.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        placed = base.store(placed, "placed")
        base.drop(labels)
        mixed = base.store(placed.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("band"), "mixed")
        out = base.store(placed.join(mixed, "band"), "unsettled")
        base.drop(placed, mixed)
        return out

    left = unsettled()
    if left.isEmpty():
        return found
    # of the least class the last member, of the greatest the first: partial aggregates, whatever the size of a band
    low, high = F.min(F.struct("label", (-F.col("id")).alias("n"))).alias("low"), F.max(F.struct("label", (-F.col("id")).alias("n"))).alias("high")
    ends = left.groupBy("band").agg(low, high).select("band", F.explode(F.array("low", "high")).alias("p"))
    pivots = base.store(ends.select("band", (-F.col("p.n")).alias("pivot"), F.col("p.label").alias("side")), "pivots")
    found = base.store(found.unionByName(linked(left.join(pivots, "band").where("label <> side").select(F.col("pivot").alias("a"), F.col("id").alias("b")))[1]), "links")
    base.drop(left, pivots)
    left = unsettled()
    base.drop(star)
    if left.isEmpty():
        return found
    docs = base.store(left.select("id", "label").distinct(), "unsettled-ids")
    base.drop(left)
    held = base.store(sets.join(docs, "id").select("id", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("s")), "held")
    often = held.groupBy("s").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("often", "s"))
    first = held.join(often, "s").withColumn("place", place).where(F.col("often") > 1).where(F.col("place") <= F.floor(F.col("n") * (room + fuzz)) + 1)
    first = base.store(first.select("id", "label", "n", "s", "place"), "prefixes")
    base.drop(held, docs)
    # within a shingle, pairs need one member outside its commonest class
    main = base.store(first.groupBy("s").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.mode("label", True).alias("main")).where("low <> high").select("s", "main"), "mixed-shingles")
    mixed = first.join(main, "s")
    other = mixed.where("label <> main").select("s", *(F.col(c).alias(f"p_{c}") for c in ("id", "label", "n", "place")))
    could = (F.col("p_label") != F.col("label")) & ((F.col("label") == F.col("main")) | (F.col("p_id") < F.col("id")))
    could &= F.least("p_n", "n") >= (threshold - fuzz) * F.greatest("p_n", "n")
    # true of a linked pair's first common shingle, whose forerunners they don't share
    could &= F.least(F.col("p_n") - F.col("p_place"), F.col("n") - F.col("place")) + 1 >= (F.col("p_n") + F.col("n")) * threshold / (1 + threshold) - 1e-6
    rest = other.join(mixed, "s").where(could).select(F.least("p_id", "id").alias("a"), F.greatest("p_id", "id").alias("b")).distinct()
    return base.store(found.unionByName(linked(rest.join(known, ["a", "b"], "left_anti"))[1]), "links")


def components(edges: DataFrame) -> DataFrame:
    """id and the smallest id of its component, for every id of edges (a, b): labels spread and jump until none changes."""
    both = base.store(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = base.store(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).select(F.col("a").alias("id"), "label"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("to"))
        spread = base.store(spread, "spread")
        jump = spread.select(F.col("id").alias("to"), F.col("to").alias("next"))
        new = base.store(spread.join(jump, "to", "left").select("id", "old", F.coalesce("next", "to").alias("label")), "labels")
        done = new.where("label <> old").isEmpty()
        base.drop(labels, spread)
        labels = base.store(new.select("id", "label"), "labels")
        base.drop(new)
        if done:
            base.drop(both)
            return labels


def _classed(own: DataFrame, threshold: float, bands: int, rows: int, k: int) -> DataFrame:
    """id, row, class (a number; null without words or without an id) and class_id of own's rows (id, text, row), stored; nothing else stays."""
    with base.noted() as made:
        out = _classes(own, threshold, bands, rows, k)
    base.discard(made, out)
    return out


def _classes(own: DataFrame, threshold: float, bands: int, rows: int, k: int) -> DataFrame:
    sketches = base.store(_sketches(own, bands, rows, k), "sketches")
    usable = F.col("words_key").isNotNull() & F.col("id").isNotNull()
    reps = sketches.where(usable).groupBy("words_key").agg(F.min("id").alias("least"), F.first("bands").alias("bands"))
    # representatives have numbers of their own: an id can have several texts
    reps = base.store(reps.withColumn("rep", F.monotonically_increasing_id()), "representatives")
    banded = reps.select("rep", F.explode("bands").alias("band")).select("band", F.col("rep").alias("id"))
    shared = base.store(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"), "shared-bands")
    members = base.store(banded.join(shared, "band"), "members")
    base.drop(shared)
    wanted = base.store(reps.join(members.select(F.col("id").alias("rep")).distinct(), "rep").select("rep", "words_key", "least"), "candidates")
    texts = own.join(wanted.select(F.col("least").alias("id")).distinct(), "id", "left_semi")
    sets = shingle_sets(texts, k).join(wanted.select("words_key", F.col("rep").alias("id")), "words_key").drop("words_key")
    sets = base.store(sets.dropDuplicates(["id"]), "shingle-sets")  # equal sequences of words, equal sets
    base.drop(wanted)
    linked = reps.join(components(links(members, sets, threshold).distinct()).withColumnRenamed("id", "rep"), "rep").select("rep", "least", "label")
    linked = base.store(linked, "linked")
    named = base.store(linked.groupBy("label").agg(F.min("least").alias("named")), "named")
    linked = linked.join(named, "label").select("rep", F.col("label"), "named")
    classes = reps.join(linked, "rep", "left").select("words_key", F.coalesce("label", "rep").alias("class"), F.coalesce("named", "least").alias("class_id"))
    classes = base.store(classes, "classes")
    row = sketches.select("id", "row", F.when(usable, F.col("words_key")).alias("words_key")).join(classes, "words_key", "left")
    return base.store(row.select("id", "row", "class", F.coalesce("class_id", "id").alias("class_id")), "rows")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, k: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id (the smallest id of its class) and class_size of every row."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("row"))
    row = _classed(own, threshold, bands, rows, k)
    sizes = base.store(row.where("class IS NOT NULL").groupBy("class").agg(F.count("*").alias("class_size")), "sizes")
    out = row.join(sizes, "class", "left").select("id", "class_id", F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"))
    return out.withColumnRenamed("id", id_col)


_ROW = "__oremill_row"


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, k: int = WORDS) -> DataFrame:
    """One row of each class of near-duplicates, that of the smallest id, with all its columns; rows without words or without an id stay.

    docs is stored once with a number for each row, which all steps read."""
    numbered = base.store(docs.withColumn(_ROW, F.monotonically_increasing_id()), "numbered")
    row = _classed(numbered.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(_ROW).alias("row")), threshold, bands, rows, k)
    first = base.store(row.where("class IS NOT NULL").groupBy("class").agg(F.min(F.struct("id", "row")).alias("first"), F.count("*").alias("n")).where("n > 1").select("class", F.col("first.row").alias("stays")), "first")
    dropped = row.join(first, "class").where("row <> stays").select(F.col("row").alias(_ROW))
    return numbered.join(dropped, _ROW, "left_anti").drop(_ROW)
