"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

1. Examples: at most EXAMPLES labelled rows of each label, the first by hash of id (a documented bound on labelled rows; texts are
   whole). Terms are all words of all examples, the stems (first STEM characters) of longer ones, and for each of both a second
   term that stands for its occurring twice or more.
2. Document frequencies of all terms are counted over all documents. A text's vector has
   (1 + ln tf) * (1 + ln((N + 1) / (df + 1))) * relevance by term, and length one. Relevance is the square of the chi-square of
   the term's presence and the label over the examples, that at least LEAST: no term is left out.
3. Index: examples in blocks of BLOCK, ordered so that like ones lie together; for each term and block a posting
   list and the largest weight in it. A query sums the largest weights to a bound on every block's scores, scores
   blocks exactly in the order of their bounds, a few at a time, and stops when no bound exceeds the K-th best
   score so far: the K nearest are exact (ties: the earlier example).
4. Votes are weighted by squared cosine, smoothed by the prior, and calibrated by logistic regression on the
   examples' own leave-one-out votes, weighted to the label's share among all labelled rows. Evidence: the ids,
   cosines and labels of the nearest examples.

Inputs of a score are the text and nothing else. Defined results: null text is empty; a text without a word of
any example (an empty one too) gets the share of label 1 among such examples, smoothed; a null label is no label;
without any label the score is 0, with one label only it is the share; repeated rows give repeated results; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base

EXAMPLES, LEAST, BLOCK, K, WAVE, SMOOTH, LIGHT, TOGETHER, REMEMBERED = 2000, 0.01, 64, 16, 16, 0.25, 0.01, 16, 4000
#: TOGETHER: texts that are searched by the same array operations. REMEMBERED: texts whose results are kept at hand for copies of them.
#: Characters of a stem, and what ends the names of stems and of terms that stand for another's second occurrence.
STEM, STEMMED, TWICE = 5, "\1", "\0"
_WORD = re.compile(r"\w+")
#: Of the first 256 characters, those that aren't of a word become spaces.
_PLAIN = bytes(c if _WORD.match(chr(c)) else 32 for c in range(256))


def words_of(text: str) -> list[str]:
    text = text.lower()
    try:
        return text.encode("latin-1").translate(_PLAIN).decode("latin-1").split()  # the same words in a third of the time
    except UnicodeEncodeError:
        return _WORD.findall(text)


def terms_of(text: str) -> Counter:
    """A text's terms, with their counts."""
    words = words_of(text)
    out = Counter(words + [w[:STEM] + STEMMED for w in words if len(w) > STEM])
    out.update({t + TWICE: n - 1 for t, n in out.items() if n > 1})
    return out


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """id, y, text of the examples, stored; the least text of an id that has several."""
    given = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    ids = None
    for y in (0, 1):
        part = given.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(EXAMPLES)
        ids = part if ids is None else ids.unionByName(part)
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return base.store(own.join(F.broadcast(base.store(ids, "example-ids")), "id").groupBy("id", "y").agg(F.min("text").alias("text")), "examples")  # 2 * EXAMPLES ids at most


def counted(examples: DataFrame) -> tuple[str, int, list[tuple]]:
    """The terms of all examples (a line each, see Terms), how many they are, and of each example by id: id, y, its terms' numbers and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [terms_of(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([list(c) for c in got], pa.list_(pa.string())), pa.array([list(c.values()) for c in got], pa.list_(pa.int64()))], ["id", "y", "terms", "n"])

    kind = examples.schema["id"].dataType.simpleString()
    table = base.map_arrow(examples.select("id", "y", "text"), run, f"id {kind}, y int, terms array<string>, n array<long>").toArrow()  # 2 * EXAMPLES rows at most
    # terms are numbered in Arrow, as they first come: as Python strings they would take the driver's memory
    table = table.take(pc.sort_indices(table["id"])).combine_chunks()
    terms = table["terms"].combine_chunks()
    ends = (terms.offsets.to_numpy() - terms.offsets[0].as_py())[1:-1]
    coded = terms.flatten().dictionary_encode()
    numbers, n = np.split(coded.indices.to_numpy(), ends), np.split(table["n"].combine_chunks().flatten().to_numpy().astype(np.int32), ends)
    rows = list(zip(table["id"].to_pylist(), table["y"].to_pylist(), numbers, n, strict=True)) if len(table) else []
    return "\n".join(coded.dictionary.to_pylist()), len(coded.dictionary), rows


class Terms:
    """Texts to term numbers. vocabulary: the terms, a line each (none holds a line's end)."""

    def __init__(self, vocabulary: str):
        at = {t: i for i, t in enumerate(vocabulary.split("\n") if vocabulary else [])}
        self.stem = {t[:-1]: i for t, i in at.items() if t[-1] == STEMMED}
        # the numbers of a word (high) and of its stem (low), each plus one; 0 for none
        self.both = {t: (i + 1 << 32) + (self.stem.get(t[:STEM], -1) + 1 if len(t) > STEM else 0) for t, i in at.items() if t[-1] not in (STEMMED, TWICE)}
        self.twice = np.array([at.get(t + TWICE, -1) for t in at], np.int64)

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the terms in a text, and in how many places each is."""
        c = Counter(words_of(text))
        own, stem = self.both.get, self.stem.get
        both = np.fromiter([b if (b := own(x)) is not None else stem(x[:STEM], -1) + 1 if len(x) > STEM else 0 for x in c], np.int64, len(c))
        n = np.fromiter(c.values(), np.int64, len(c))
        w, s = (both >> 32) - 1, (both & 0xFFFFFFFF) - 1
        word, part = w >= 0, s >= 0
        stems, of = np.unique(s[part], return_inverse=True)
        t, n = np.concatenate([w[word], stems]), np.concatenate([n[word], np.bincount(of, n[part], len(stems)).astype(np.int64)])
        second = self.twice[t]
        again = (n > 1) & (second >= 0)
        return np.concatenate([t, second[again]]), np.concatenate([n, n[again] - 1])


_TERMS: dict[bytes, Terms] = {}


def key_of(vocabulary: str) -> bytes:
    return hashlib.sha256(vocabulary.encode()).digest()


def terms(key: bytes, vocabulary: str) -> Terms:
    """The Terms of the vocabulary with this key_of, one at a time a process."""
    if key not in _TERMS:
        _TERMS.clear()
        _TERMS[key] = Terms(vocabulary)
    return _TERMS[key]


def document_frequencies(docs: DataFrame, vocabulary: str, size: int, text_col: str) -> tuple[int, np.ndarray]:
    """The number of documents and how many hold each term: over all rows, summed in the tasks first."""
    key = key_of(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, n, total = terms(key, vocabulary), np.zeros(size, np.int64), 0
        known = base.Memo(lambda x: t.counts(x)[0], REMEMBERED, 4_000_000, 100_000)  # equal texts are split once
        for b in batches:
            for text in b.column(0).to_pylist():
                total += 1
                n[known[text or ""]] += 1
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some]), pa.array(np.r_[total, n[some]])], ["term", "n"])

    table = base.map_arrow(docs.select(F.col(text_col).alias("text")), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # one row a term
    term, n = (table[c].to_numpy().astype(np.int64) for c in ("term", "n"))
    out = np.zeros(size, np.int64)
    out[term[term >= 0]] = n[term >= 0]
    return int(n[term < 0].sum()), out


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places start[i], ..., start[i] + n[i] - 1 of all i."""
    return np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


class Index:
    """Block-max inverted index over unit vectors (term numbers under `size`, weights).

    The vectors are what is kept and sent; postings and bounds follow from them, where it is first searched (open), until close()."""

    def __init__(self, size: int, vectors: list[tuple[np.ndarray, np.ndarray]], ids: list, y: np.ndarray):
        lead = [(int(t[np.argmax(w)]), -float(w.max())) if len(t) else (size, 0.0) for t, w in vectors]  # by the heaviest term
        order = sorted(range(len(vectors)), key=lambda i: (lead[i], i))
        self.ids, self.y = [ids[i] for i in order], y[order]
        self.blocks = max(1, -(-len(order) // BLOCK))
        self.terms = size
        self.size = np.array([len(vectors[i][0]) for i in order], np.int64)
        self.begin = np.r_[0, np.cumsum(self.size)[:-1]] if len(order) else np.zeros(0, np.int64)
        self.term_of, self.weight_of = np.concatenate([vectors[i][0] for i in order] or [np.zeros(0)]).astype(np.int32), np.concatenate([vectors[i][1] for i in order] or [np.zeros(0)])
        self.close()

    def close(self) -> None:
        self.row = self.weight = self.start = self.count = self.block = self.most = self.cells = self.top = self.query = None

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("ids", "y", "blocks", "terms", "size", "begin", "term_of", "weight_of")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.close()

    def open(self) -> None:
        by = np.argsort(self.term_of, kind="stable")  # rows rise within a term
        term, self.weight = self.term_of[by], self.weight_of[by]
        self.row = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)[by]
        del by
        # a cell is a term's postings in a block
        block = self.row // BLOCK
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(new)
        self.block, self.start, self.count = block[first], first.astype(np.int32), np.diff(np.r_[first, len(term)]).astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.cells = np.searchsorted(term[first], np.arange(self.terms + 1, dtype=np.int32))
        self.top = np.zeros(self.terms)
        np.maximum.at(self.top, term[first], self.most)
        self.query = np.zeros(self.terms)

    def vector(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """A row's terms and weights."""
        at = slice(self.begin[row], self.begin[row] + self.size[row])
        return self.term_of[at], self.weight_of[at]

    def in_full(self, rows: np.ndarray) -> np.ndarray:
        """The cosines of rows with the vector laid out in `query`."""
        query, term_of, weight_of = self.query, self.term_of, self.weight_of
        return np.array([query[term_of[a:z]] @ weight_of[a:z] for a, z in zip(self.begin[rows].tolist(), (self.begin[rows] + self.size[rows]).tolist(), strict=True)])

    def search(self, t: np.ndarray, w: np.ndarray, k: int = K, without: int = -1, light: float = LIGHT) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest with a cosine over 0, nearest first."""
        return self.search_all([(t, w)], k, [without], light)[0]

    def search_all(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = K, without: list[int] | None = None, light: float = LIGHT) -> list[tuple[np.ndarray, np.ndarray]]:
        """search() of many queries at once.

        Terms of a query that together can add no more than `light` wait (`rest`): the others find candidates, whose cosines are then
        taken in full. Of the blocks, the WAVE of highest bounds are scored first, then all those whose bounds reach the k-th best."""
        if self.row is None:
            self.open()
        m, all_rows = len(queries), len(self.ids)
        rest, parts = np.zeros(m), []
        for q, (t, w) in enumerate(queries):
            most = w * self.top[t]
            by = np.argsort(most)
            rising = np.cumsum(most[by])
            cut = int(np.searchsorted(rising, light, side="right"))
            rest[q] = rising[cut - 1] if cut else 0.0
            parts.append(by[cut:])
        t, w = np.concatenate([t[p] for (t, _), p in zip(queries, parts, strict=True)]), np.concatenate([w[p] for (_, w), p in zip(queries, parts, strict=True)])
        n = self.cells[t + 1] - self.cells[t]
        cell, each = _ranges(self.cells[t], n), np.repeat(w, n)
        at = np.repeat(np.repeat(np.arange(m), [len(p) for p in parts]), n)
        place = at * self.blocks + self.block[cell]
        bound = np.bincount(place, each * self.most[cell], m * self.blocks).reshape(m, self.blocks)
        first = np.zeros((m, self.blocks), bool)
        np.put_along_axis(first, np.argpartition(-bound, min(WAVE, self.blocks) - 1, axis=1)[:, :WAVE], True, axis=1)
        score, worst = np.zeros(m * all_rows), np.zeros(m)

        def add(chosen: np.ndarray) -> None:
            mine = np.flatnonzero(chosen.ravel()[place])
            count = self.count[cell[mine]]
            posting = _ranges(self.start[cell[mine]], count)
            score[:] += np.bincount(np.repeat(at[mine], count) * all_rows + self.row[posting], np.repeat(each[mine], count) * self.weight[posting], m * all_rows)
            table = score.reshape(m, all_rows)
            if without is not None:
                table[np.arange(m), without] = np.where(np.array(without) >= 0, 0, table[np.arange(m), without])
            if k < all_rows:
                worst[:] = np.partition(table, all_rows - k, axis=1)[:, all_rows - k]

        add(first)
        more = ~first & (bound > 0) & (bound + rest[:, None] >= worst[:, None] - 1e-9)
        if more.any():
            add(more)
        out = []
        for q, (t, w) in enumerate(queries):
            own = score[q * all_rows : (q + 1) * all_rows]
            rows = np.flatnonzero((own > 0) & (own + rest[q] >= worst[q] - 1e-9))
            scores = own[rows]
            if rest[q]:
                if len(rows) < k or worst[q] <= rest[q] + 1e-9:  # light terms alone may make a neighbour
                    out.append(self.search(t, w, k, without[q] if without else -1, 0.0))
                    continue
                # in full: first those that seem the nearest, then those that their k-th still leaves room for
                self.query[t] = w
                seem = np.argsort(-scores, kind="stable")
                top, other = seem[:k], seem[k:]
                exact = self.in_full(rows[top])
                other = other[scores[other] + rest[q] >= exact.min() - 1e-9]
                scores = np.concatenate([exact, self.in_full(rows[other])])
                rows = rows[np.concatenate([top, other])]
                self.query[t] = 0
            keep = np.lexsort((rows, -np.round(scores, 9)))[:k]
            out.append((rows[keep], scores[keep]))
        return out


class Model:
    def __init__(self, vocabulary: str, total: int, df: np.ndarray, relevance: np.ndarray):
        self.key, self.vocabulary, self.weight = key_of(vocabulary), vocabulary, (1 + np.log((total + 1) / (df + 1))) * np.maximum(relevance, LEAST) ** 2
        self.index, self.prior, self.flat, self.slope, self.shift = None, 0.0, 0.0, 1.0, 0.0
        self.known = base.Memo(None, REMEMBERED, 4_000_000, 100_000)  # texts that were just scored

    def weighted(self, t: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(n)) * self.weight[t]
        return t, w / max(np.sqrt(w @ w), 1e-300)

    def fit(self, rows: list[tuple], share: float) -> None:
        """rows: id, terms, weights, y; emptied, as the index holds them. share: of label 1 among all labelled rows."""
        y = np.array([r[3] for r in rows], np.float64)
        self.index = Index(len(self.weight), [(r[1], r[2]) for r in rows], [r[0] for r in rows], y)
        ones = min(max(y.mean(), 1e-9), 1 - 1e-9)
        self.prior = ones
        empty_y = [r[3] for r in rows if not len(r[1])]
        rows.clear()
        vote, weight, label = [], [], []
        empty = np.zeros(2)
        of = np.array([(1 - share) / (1 - ones), share / ones])
        order = np.flatnonzero(self.index.size).tolist()
        for at in range(0, len(order), TOGETHER):
            some = order[at : at + TOGETHER]
            for i, near in zip(some, self.index.search_all([self.index.vector(i) for i in some], without=some), strict=True):
                vote.append(self.vote(*near))
                label.append(int(self.index.y[i]))
                weight.append(of[label[-1]])
        for k in empty_y:
            empty[k] += of[k]
        self.flat = (empty[1] + share * SMOOTH) / (empty.sum() + SMOOTH)
        if len(set(label)) == 2:
            self.slope, self.shift = logistic(logit(np.array(vote)), np.array(label), np.array(weight))
        self.index.close()

    def vote(self, rows: np.ndarray, cosines: np.ndarray) -> float:
        w = cosines**2
        return float((w @ self.index.y[rows] + SMOOTH * self.prior) / (w.sum() + SMOOTH))

    def scores(self, texts: list[str]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """Of each text the score, and the index's rows and the cosines of its nearest examples."""
        nothing = np.zeros(0, np.int64), np.zeros(0)
        if self.index is None:
            yield from ((float(self.flat), *nothing) for _ in texts)
            return
        own = terms(self.key, self.vocabulary)
        for at in range(0, len(texts), TOGETHER):
            # equal texts are searched once
            some = texts[at : at + TOGETHER]
            found = {x: own.counts(x) for x in dict.fromkeys(some) if x not in self.known}
            ask = {x: self.weighted(t, n) for x, (t, n) in found.items() if len(t)}
            near = dict(zip(ask, self.index.search_all(list(ask.values())), strict=True)) if ask else {}
            if near:
                vote = logit(np.array([self.vote(*x) for x in near.values()]))
                p = dict(zip(near, (1 / (1 + np.exp(-(self.slope * vote + self.shift)))).tolist(), strict=True))
            got = {x: (p[x], *near[x]) if x in near else (float(self.flat), *nothing) for x in found}
            yield from [got[x] if x in got else self.known[x] for x in some]
            for x, g in got.items():
                self.known.put(x, g)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic regression on one variable, a little ridge on both (Newton)."""
    a = np.array([1.0, 0.0])
    z = np.c_[x, np.ones_like(x)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        g = z.T @ (weight * (p - y)) + 0.1 * (a - [1.0, 0.0])
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2)
        step = np.linalg.solve(h, g)
        a -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(a[0], 0.0)), float(a[1])


def chi_square(rows: list[tuple], size: int) -> np.ndarray:
    """Of each term, how much its presence in the examples (id, y, terms, counts) depends on the label, with Yates's correction for small counts."""
    have = np.zeros((2, size))
    for _, y, t, _ in rows:
        have[y, t] += 1
    n1 = sum(r[1] for r in rows)
    n0, (b, a) = len(rows) - n1, have
    return len(rows) * np.maximum(np.abs(a * n0 - b * n1) - len(rows) / 2, 0) ** 2 / (max(n1 * n0, 1) * (a + b) * np.maximum(len(rows) - a - b, 1))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """labels: id and label of the rows that may be learned from."""
    examples = sample(docs, labels, id_col, text_col, label_col)
    vocabulary, size, rows = counted(examples)
    base.drop(examples)
    pa.default_memory_pool().release_unused()
    share = float(labels.where(F.col(label_col).isin(0, 1)).agg(F.avg(label_col)).first()[0] or 0.0)
    if len({r[1] for r in rows}) < 2:
        model = Model("", 0, np.zeros(0), np.zeros(0))
        model.flat = share
        return model
    model = Model(vocabulary, *document_frequencies(docs, vocabulary, size, text_col), chi_square(rows, size))
    rows = [(i, *model.weighted(t, n), y) for i, y, t, n in rows]
    model.fit(rows, share)
    return model


def score(docs: DataFrame, model: Model, at: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted and evidence (id, cosine and label of the nearest examples) of every row. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = pa.array(model.index.ids if model.index else [])
        labels = (model.index.y if model.index else np.zeros(0)).astype(np.int32)
        for b in batches:
            if not b.num_rows:
                continue
            got = list(model.scores([x or "" for x in b.column(1).to_pylist()]))
            p, rows = np.array([g[0] for g in got]), np.concatenate([g[1] for g in got])
            near = pa.StructArray.from_arrays([ids.take(pa.array(rows)) if len(rows) else pa.array([], b.column(0).type), pa.array(np.concatenate([g[2] for g in got])), pa.array(labels[rows])], ["id", "cosine", "label"])
            evidence = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(g[1]) for g in got)]), pa.int32()), near)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= at).astype(np.int32)), evidence], ["id", "score", "predicted", "evidence"])
        model.known.reset()  # the worker lives on for other operators

    out = base.map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, score double, predicted int, evidence array<struct<id: {kind}, cosine: double, label: int>>")
    return out.withColumnRenamed("id", id_col)


def scored(model: Model, text: Column) -> Column:
    """The score alone, as a column of text."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([g[0] for g in model.scores([x or "" for x in s])], dtype="float64")
        model.known.reset()

    return run(text)


def keep_clean(docs: DataFrame, model: Model, at: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is under `at`."""
    base.prepare(docs.sparkSession)
    return docs.where(scored(model, F.col(text_col)) < at)
