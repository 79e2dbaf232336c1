"""Best-fit packing of tokenised documents into fixed-length sequences, bulk-synchronously.

1. Tokenise: every document's ids and an end id; documents over the capacity are cut into
   capacity-long pieces, the first of which may be shorter. A piece over half the capacity begins a sequence of its own: no two share one.
2. The other pieces follow by classes of length, each down to half the last one's (the last down to 1). A class is packed by supersteps:
   a. Range-sort: the class's pieces and the open gaps, by size from the largest down, a gap before pieces of its size. A gap that holds
      several of the class stands for as many of them.
   b. Successor sweep (``sweep``): every piece wants its successor, the least gap that holds it. Each range is swept by its own task: a piece
      takes the last gap before it that no piece between them takes. All pieces of a range look at once, as matching parentheses do.
   c. Conflicts are resolved by rank: what a range leaves over is its first pieces and its last gaps. Their numbers, two a range, say which ranks of which
      range's pieces meet which ranks of which earlier range's gaps (``meet``); pieces and gaps join by that number.
   d. Gaps are updated; pieces left over repeat. When no gap holds any of them, as many sequences are begun as the left
      lengths need by themselves.
   A superstep places at least half of what the gaps could take, so their number depends on the capacity, not on that of documents.
3. Pieces of a sequence (at most `capacity`) are put side by side in the order of their coming.

The driver holds counts by length and by gap (at most `capacity` rows each) and two numbers a range.

Defined results: null text is empty and makes one piece with the end id only; repeated rows (and rows with
a null id) are packed one by one; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base
from .token_counts import byte_symbols

#: Rows in a range that one task sweeps, about; classes end at this length.
EVENTS, LAST = 250_000, 32
#: Fixed value: the splitting pattern of the byte-level tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe:
    """The ids that the tokenizers library gives for a byte-level BPE file, by its vocabulary as ranks.

    Ids are ranks where every merge's id follows its place, which is checked; else the library encodes."""

    def __init__(self, spec: str):
        import tiktoken

        self.spec, self._library = spec, None
        model = json.loads(spec)
        byte = {c: b for b, c in enumerate(byte_symbols())}
        vocab = model["model"]["vocab"]
        merged = [vocab["".join(m.split(" ", 1) if isinstance(m, str) else m)] for m in model["model"]["merges"]]
        special = {t["content"]: t["id"] for t in model["added_tokens"] if t["special"]}
        plain = {t: i for t, i in vocab.items() if t not in special}
        first = min(merged)
        if merged != sorted(merged) or any(len(t) > 1 and i < first for t, i in plain.items()):
            self.fast = None
        else:
            self.fast = tiktoken.Encoding("oremill", pat_str=PATTERN, mergeable_ranks={bytes(byte[c] for c in t): i for t, i in plain.items()}, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        # Runs this long would meet the regex engine's backtracking limit.
        if self.fast is None or len(text) > 100_000 and _long_blank(text):
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_str(self.spec)
            return np.array(self._library.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special="all")


def _long_blank(text: str) -> bool:
    return any(c * 10_000 in text for c in " \n\t\r") or max(map(len, text.split()), default=0) > 100_000 or len(text) - sum(map(len, text.split())) > len(text) // 2


_MADE: dict[int, ByteBpe] = {}


def encoder(spec: str) -> ByteBpe:
    if (k := hash(spec)) not in _MADE:
        _MADE.clear()
        _MADE[k] = ByteBpe(spec)
    return _MADE[k]


def cut(n: int, capacity: int) -> list[int]:
    """Piece lengths of a document of n ids: only the first may be under the capacity."""
    first = n % capacity or capacity
    return [first] + [capacity] * ((n - first) // capacity)


def sweep(is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of gaps and pieces in order, the places of pieces and of the gaps that they take.

    As with parentheses: a piece closes the last open gap, which is the nearest event before it of its own level of nesting."""
    depth = np.cumsum(np.where(is_gap, 1, -1))
    level = np.where(is_gap, depth, depth + 1)
    order = np.argsort(level, kind="stable")
    pair = np.flatnonzero((level[order[1:]] == level[order[:-1]]) & is_gap[order[:-1]] & ~is_gap[order[1:]]) if len(order) > 1 else np.zeros(0, np.int64)
    return order[pair + 1], order[pair]


def meet(left: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """left: range -> (pieces, gaps) that its own sweep left over. Returns (range of pieces, first rank, how many, range of gaps, rank of the
    gap that the first one takes; the others take those before it): each piece takes the last gap that is free."""
    out, free = [], []  # free: [range, gaps]
    for k in sorted(left):
        pieces, gaps = left[k]
        at = 0
        while at < pieces and free:
            n = min(pieces - at, free[-1][1])
            out.append((k, at, n, free[-1][0], free[-1][1] - 1))
            at += n
            free[-1][1] -= n
            if not free[-1][1]:
                free.pop()
        if gaps:
            free.append([k, gaps])
    return out


def superstep(items: DataFrame, slots: DataFrame, events: int) -> DataFrame:
    """items (pid, length) and slots (bin, slot, gap, size) to a stored table of all items with the bin and slot they take, or nulls."""
    none = F.lit(None).cast("long")
    both = items.select(F.col("length").alias("size"), F.lit(1).alias("kind"), none.alias("gap"), F.col("pid").alias("id"), F.lit(0).alias("slot")).unionByName(
        slots.select("size", F.lit(0).alias("kind"), "gap", F.col("bin").alias("id"), "slot")
    )
    order = [F.desc("size"), F.col("kind"), F.desc("gap"), F.col("id"), F.col("slot")]
    dealt = both.repartitionByRange(max(1, -(-events // EVENTS)), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # a range: about EVENTS rows
        if not held:
            return
        t, part = pa.Table.from_batches(held), TaskContext.get().partitionId()
        size, kind, ident, slot = (t.column(c).to_numpy() for c in ("size", "kind", "id", "slot"))
        piece, gap = sweep(kind == 0)
        free = np.ones(len(kind), bool)
        free[piece] = free[gap] = False
        # rows: matched pieces with their bin and slot, then what is left, with its rank among its kind
        for k, rows in ((1, piece), (1, np.flatnonzero(free & (kind == 1))), (0, np.flatnonzero(free & (kind == 0)))):
            own = rows is piece
            null = np.full(len(rows), not own)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(rows), part, np.int32)), pa.array(np.full(len(rows), k, np.int32)), pa.array(ident[rows]), pa.array(size[rows]), pa.array(slot[rows].astype(np.int32)),
                    pa.array(np.arange(len(rows)), mask=~null), pa.array(ident[gap] if own else ident[rows], mask=null), pa.array((slot[gap] if own else slot[rows]).astype(np.int32), mask=null),
                ],
                ["part", "kind", "id", "size", "own_slot", "rank", "bin", "slot"],
            )

    swept = base.store(base.map_arrow(dealt, run, "part int, kind int, id long, size long, own_slot int, rank long, bin long, slot int"), "swept")
    left: dict[int, list[int]] = {}
    for r in swept.where("rank IS NOT NULL").groupBy("part", "kind").count().collect():  # two numbers a range
        left.setdefault(r["part"], [0, 0])[1 - r["kind"]] = r["count"]
    table, number = [], 0
    for k, at, n, of, top in meet({k: (p, g) for k, (p, g) in left.items()}):
        # (kind, range, first and last rank, number of the meeting at rank 0, sign)
        table += [(1, k, at, at + n - 1, number - at, 1), (0, of, top - n + 1, top, number + top, -1)]
        number += n
    pieces = swept.where("kind = 1").select(F.col("id").alias("pid"), F.col("size").alias("length"), "bin", "slot", "part", "rank")
    if not table:
        return pieces.drop("part", "rank")
    met = swept.sparkSession.createDataFrame(table, "kind int, part int, low long, high long, zero long, sign int")
    numbered = swept.where("rank IS NOT NULL").join(F.broadcast(met), ["kind", "part"]).where("rank BETWEEN low AND high").withColumn("number", F.col("zero") + F.col("sign") * F.col("rank"))  # a few rows a range
    pairs = numbered.where("kind = 1").select("number", F.col("id").alias("pid")).join(numbered.where("kind = 0").select("number", F.col("id").alias("to"), F.col("own_slot").alias("at")), "number")
    out = pieces.drop("part", "rank").join(pairs.drop("number"), "pid", "left")
    out = base.store(out.select("pid", "length", F.coalesce("bin", "to").alias("bin"), F.coalesce("slot", "at").alias("slot")), "matched")
    base.drop(swept)
    return out


def best_fit(items: DataFrame, capacity: int) -> DataFrame:
    """pid, bin, step, slot of items (pid, length), a stored table: pieces of a bin lie in the order of step and slot."""
    spark = items.sparkSession
    half = capacity // 2
    count = lambda df, c: {r[0]: r[1] for r in df.groupBy(c).count().collect()}  # noqa: E731  at most `capacity` rows
    lengths = count(items, "length")
    alone = items.where(F.col("length") > half)
    placed = [alone.select("pid", F.col("pid").alias("bin"), F.lit(0).alias("step"), F.lit(0).alias("slot"))]
    bins = alone.select(F.col("pid").alias("bin"), (capacity - F.col("length")).alias("gap")).where("gap > 0")
    gaps = {capacity - n: k for n, k in lengths.items() if half < n < capacity}
    step = begun = 0
    high = half
    while high and lengths:
        low = high // 2 if high > LAST else 0
        own = {n: k for n, k in lengths.items() if low < n <= high}
        rest = items.where((F.col("length") > low) & (F.col("length") <= high))
        while own:
            least, many = min(own), sum(own.values())
            if not any(g >= least for g in gaps):
                new = math.ceil(sum(k / (capacity // n) for n, k in own.items()))
                bins = bins.unionByName(spark.range(begun + 1, begun + new + 1).select((-F.col("id")).alias("bin"), F.lit(capacity).cast("long").alias("gap")))
                gaps[capacity] = gaps.get(capacity, 0) + new
                begun += new
            step += 1
            # of gaps that hold several, the least that have room for all
            most, room = 0, 0
            for g in sorted(g for g in gaps if g >= high):
                if room < many:
                    most, room = g, room + gaps[g] * (g // high)
            slots = bins.where((F.col("gap") >= least) & (F.col("gap") <= max(most, high - 1)))
            slots = slots.select("bin", "gap", F.least("gap", F.lit(high)).alias("size"), F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"cast(gap div {high} as int)") - 1))).alias("slot"))
            events = many + room + sum(k for g, k in gaps.items() if least <= g < high)
            out = superstep(rest, slots, events)
            found = out.where("bin IS NOT NULL")
            placed.append(found.select("pid", "bin", F.lit(step).alias("step"), "slot"))
            taken = found.groupBy("bin").agg(F.sum("length").alias("taken"))
            bins = base.store(bins.join(taken, "bin", "left").select("bin", (F.col("gap") - F.coalesce("taken", F.lit(0))).alias("gap")).where("gap > 0"), "bins")
            gaps = count(bins, "gap")
            rest = out.where("bin IS NULL").select("pid", "length")
            own = count(rest, "length")
        high = low
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 (, ids), and pid, a number of its own (the same as long as the plan isn't run again: store it)."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, seen = encoder(spec), TaskContext.get().partitionId() << 36
        end = np.array([end_id], np.uint32)
        for b in batches:
            rows, numbers, starts, lengths, sums, kept = [], [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = np.concatenate([e.ids(text), end]) if text else end
                raw, at = memoryview(ids.astype("<u4").tobytes()), 0
                for k, n in enumerate(cut(len(ids), capacity)):
                    rows.append(i)
                    numbers.append(k)
                    starts.append(at)
                    lengths.append(n)
                    sums.append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                    if with_ids:
                        kept.append(ids[at : at + n].astype(np.int64))
                    at += n
            pid = np.arange(seen, seen + len(rows))
            seen += len(rows)
            columns = [b.column(0).take(pa.array(rows, pa.int32())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()), pa.array(pid)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.list_(pa.int64()))] * with_ids, ["id", "piece", "start", "length", "ids_crc32", "pid"] + ["ids"] * with_ids)

    return base.map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, piece int, start long, length long, ids_crc32 long, pid long" + ", ids array<long>" * with_ids)


def pack(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence_id and offset; with_ids adds the token ids themselves."""
    cutoff = base.store(pieces(docs, path, end_id, capacity, id_col, text_col, with_ids), "pieces")
    placed = best_fit(cutoff.select("pid", "length"), capacity)
    before = Window.partitionBy("bin").orderBy("step", "slot").rowsBetween(Window.unboundedPreceding, -1)
    out = cutoff.join(placed, "pid").withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    names = ["piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    return out.select(F.col("id").alias(id_col), *names, F.col("bin").alias("sequence_id"), "offset")
