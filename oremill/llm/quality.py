"""Quality classifier by co-training of two views.

The text view sees the content: hashed words and word shapes, and measures of the text (symbols, repeats, word and
line lengths). The metadata view sees what is known about the page without reading it: url (host, path and its depth), source, language, declared length;
columns that the table lacks are null. Both views of every document are taken once, over whole texts, and stored (``views``).

Each view is a logistic regression. Both start from the labelled sample (at most LABELLED rows, a documented bound on labelled rows). In each of ROUNDS
rounds each view ranks all unlabelled documents that it hasn't labelled yet, and the GROW that it is surest of in each class become examples for the
other one. Rank, not a level of the chance, decides, so that a weak view teaches too; how much an example counts is how much its teacher's calibrated
chance says beyond the class's share, so that it does no harm. Ranking is a top-k in every task and then of those. The views are
calibrated on labelled rows that were kept apart, and a logistic regression on both calibrated margins, fitted there, scores every document.

Defined results: null text is empty; null metadata are values of their own; a null label is no label; without labels of
both kinds every score is the share of label 1 (1 without any label); repeated rows give repeated results; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base

LABELLED, ROUNDS, GROW, APART = 4000, 3, 200, 4
HASHED, META = 1024, 256
MEASURES = 12
_SHAPE = ((re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "0"))


def _buckets(token: str) -> tuple[int, int]:
    """The word's bucket and its shape's: letters and digits folded, symbols kept."""
    shape = token
    for pattern, to in _SHAPE:
        shape = pattern.sub(to, shape)
    half = HASHED // 2
    return xxhash.xxh3_64_intdigest("w" + token.lower()) % half, half + xxhash.xxh3_64_intdigest("s" + shape[:32]) % half


_TOKENS = base.Memo(_buckets)


def text_view(text: str) -> bytes:
    """HASHED shares of words and shapes (square roots, a byte each) and MEASURES measures (32-bit floats)."""
    tokens = text.split()
    n = len(tokens)
    if not n:
        return bytes(HASHED + 4 * MEASURES)
    pairs = np.array(list(map(_TOKENS.__getitem__, tokens)), np.int64).ravel()
    shares = np.rint(255 * np.sqrt(np.minimum(np.bincount(pairs, minlength=HASHED) / n, 1))).astype(np.uint8)
    seen = Counter(tokens)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(str.isalpha, text))
    measures = (
        np.log1p(n), letters / len(text), len(seen) / n, max(seen.values()) / n, len("".join(tokens)) / n / 10, len(set(lines)) / len(lines),
        len(lines) / n, text.count(".") / n, text.count("|") / n, sum(map(str.isupper, text)) / len(text), sum(map(str.isdigit, text)) / len(text), sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)) / n,
    )
    return shares.tobytes() + np.array(measures, "<f4").tobytes()


def meta_view(url: str | None, source: str | None, lang: str | None, n_chars: float | None) -> bytes:
    """META hashed marks, a byte each."""
    out = np.zeros(META, np.uint8)
    host, _, path = (url or "").partition("://")[2].partition("/")
    size = "-" if n_chars is None or n_chars != n_chars else str(int(2 * np.log2(max(n_chars, 0) + 1)))
    page = [f"host={host.lower()}", f"depth={path.count('/')}", f"query={'?' in path}", *(f"path={x}" for x in re.findall(r"[a-z]+", path.lower())[:16])] if url else ["no url"]
    for x in (*page, f"source={source}", f"lang={lang}", f"size={size}", f"{lang},{size}"):
        out[xxhash.xxh3_64_intdigest(x) % META] = 1
    return out.tobytes()


def matrices(t: list[bytes], m: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of both views."""
    raw = np.frombuffer(b"".join(t), np.uint8).reshape(len(t), HASHED + 4 * MEASURES)
    text = np.empty((len(t), HASHED + MEASURES), np.float32)
    text[:, :HASHED] = raw[:, :HASHED] / np.float32(255)
    text[:, HASHED:] = np.ascontiguousarray(raw[:, HASHED:]).view("<f4")
    return text, np.frombuffer(b"".join(m), np.uint8).reshape(len(m), META).astype(np.float32)


@dataclass
class Linear:
    """Logistic regression on standardised columns, by accelerated gradient steps."""

    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, each: np.ndarray, ridge: float = 1e-3, steps: int = 120) -> None:
        """each: how much a row counts."""
        each = (each / each.sum()).astype(np.float32)
        mean, scale = x.mean(0), x.std(0) + 0.02
        z = ((x - mean) / scale).astype(np.float32)
        top = np.ones(z.shape[1], np.float32)
        for _ in range(12):  # the largest singular value bounds the step
            top = z.T @ (z @ (top / np.linalg.norm(top)))
        w, b, v, u = np.zeros(z.shape[1]), 0.0, np.zeros(z.shape[1]), 0.0
        rate = 3.0 / (float(np.linalg.norm(top)) / len(z) + 1)
        for k in range(steps):
            momentum = k / (k + 3)
            w_ahead, b_ahead = w + momentum * v, b + momentum * u
            e = each * (1 / (1 + np.exp(-np.clip(z @ w_ahead + b_ahead, -30, 30))) - y)
            new_w, new_b = w_ahead - rate * (z.T @ e + ridge * w_ahead), b_ahead - rate * e.sum()
            v, u, w, b = new_w - w, new_b - b, new_w, new_b
        self.weight, self.bias = w / scale, float(b - (mean / scale) @ w)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weight + self.bias

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.raw(x) + self.shift, -12, 12)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        (self.slope,), self.shift = newton(self.raw(x)[:, None], y)
        self.slope = max(float(self.slope), 0.0)


def newton(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """A small logistic regression with a little ridge: weights and bias."""
    z = np.c_[z, np.ones(len(z))]
    a = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(len(a)), z.T @ (p - y) + 0.5 * a)
        a -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return a[:-1], float(a[-1])


@dataclass
class Model:
    text: Linear
    meta: Linear
    mix: np.ndarray
    shift: float
    constant: float | None = None
    #: for each round, what each view taught the other: rows of label 0 and of label 1
    rounds: list[dict[str, tuple[int, int]]] = field(default_factory=list)

    def chances(self, t: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Columns: combined, text view, metadata view."""
        if self.constant is not None:
            return np.full((len(t), 3), self.constant)
        a, b = self.text.margin(t), self.meta.margin(m)
        return 1 / (1 + np.exp(-np.c_[self.mix[0] * a + self.mix[1] * b + self.shift, a, b]))


#: What a view teaches: (pool row, label, its chance of label 1, text view, metadata view).
Taught = tuple[int, int, float, bytes, bytes]


def cotrain(t: list[bytes], m: list[bytes], y: np.ndarray, surest: Callable[[str, Linear, set[int]], list[Taught]], rounds: int = ROUNDS) -> Model:
    """y: 0 or 1. Every APART-th labelled row is kept for calibration.

    surest(view, its model, rows to leave out) gives the pool rows that a view is surest of, in each class."""
    if len(set(y.tolist())) < 2:
        return Model(Linear(), Linear(), np.zeros(2), 0.0, float(y.mean()) if len(y) else 1.0)
    apart = np.arange(len(y)) % APART == APART - 1
    if len(set(y[apart].tolist())) < 2 or len(set(y[~apart].tolist())) < 2:
        apart = np.zeros(len(y), bool)
    known, check = ~apart, apart if apart.any() else ~apart
    views = dict(zip(("text", "meta"), matrices(t, m), strict=True))
    models, other = {"text": Linear(), "meta": Linear()}, {"text": "meta", "meta": "text"}
    learned: dict[str, list[Taught]] = {"text": [], "meta": []}  # by the view that learns
    share, log = float(y[known].mean()), []
    for k in range(rounds + 1):
        for name, model in models.items():
            x, target, each = views[name][known], y[known], np.ones(known.sum())
            if got := learned[name]:
                x = np.r_[x, matrices([g[3] for g in got], [g[4] for g in got])[0 if name == "text" else 1]]
                target = np.r_[target, [g[1] for g in got]]
                # what the teacher's chance of the label says beyond the label's share
                sure = np.array([(g[2] - share) / (1 - share) if g[1] else (share - g[2]) / share for g in got])
                each = np.r_[each, np.clip(sure, 0.01, 1)]
            model.fit(x, target, each)
            model.calibrate(views[name][check], y[check])
        if k == rounds:
            break
        taught = {name: surest(name, model, {g[0] for g in learned[other[name]]}) for name, model in models.items()}
        for name, rows in taught.items():
            learned[other[name]] += rows
        log.append({name: (sum(g[1] == 0 for g in rows), sum(g[1] == 1 for g in rows)) for name, rows in taught.items()})
    mix, shift = newton(np.c_[models["text"].margin(views["text"][check]), models["meta"].margin(views["meta"][check])], y[check])
    return Model(models["text"], models["meta"], np.maximum(mix, 0.0), shift, rounds=log)


_VIEWS = ("__text_view", "__meta_view", "__row")


def _inputs(docs: DataFrame, text_col: str) -> list[Column]:
    """The five inputs; a column that docs lacks is null."""
    has = {c.lower() for c in docs.columns}
    return [F.col(text_col), *((F.col(c).try_cast(k) if c in has else F.lit(None).cast(k)).alias(c) for c, k in (("url", "string"), ("source", "string"), ("lang", "string"), ("n_chars", "double")))]


def _viewed(inputs: list[Column]) -> Column:
    @F.pandas_udf("t binary, m binary")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for text, url, source, lang, n_chars in batches:
            size = n_chars.astype(object).where(n_chars.notna(), None)
            yield pd.DataFrame({"t": [text_view(x or "") for x in text], "m": [meta_view(*x) for x in zip(url, source, lang, size, strict=True)]})
        _TOKENS.reset()  # the worker lives on for other operators

    return run(*inputs)


def views(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """A stored table of docs' columns `keep`, both views of each row and a number of its own: the one pass over the texts."""
    base.prepare(docs.sparkSession)
    out = docs.select(*keep, _viewed(_inputs(docs, text_col)).alias("__v"))
    return base.store(out.select(*keep, F.col("__v.t").alias(_VIEWS[0]), F.col("__v.m").alias(_VIEWS[1]), F.monotonically_increasing_id().alias(_VIEWS[2])), "views")


def fit(viewed: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", rounds: int = ROUNDS, grow: int = GROW) -> Model:
    """viewed: a table of views() with its ids; labels: id and label of the rows that may be learned from."""
    t, m, row = _VIEWS
    given = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    own = viewed.select(F.col(id_col).alias("id"), t, m, row)
    chosen = base.store(given.join(own.select("id").where("id IS NOT NULL"), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(LABELLED), "labelled")
    got = own.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min(F.struct(t, m, "y")).alias("r")).select("id", "r.*").collect()  # LABELLED rows at most
    got.sort(key=lambda r: (r[t], r[m], r["y"]))
    got = [got[i] for i in np.random.default_rng(17).permutation(len(got))]
    # the pool: every row without a label
    pool = base.store(own.where("id IS NOT NULL").join(given, "id", "left_anti").select(row, t, m), "pool")

    def surest(name: str, model: Linear, out: set[int]) -> list[Taught]:
        left = np.array(sorted(out), np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, list[tuple]] = {0: [], 1: []}
            for b in batches:
                if not b.num_rows:
                    continue
                rows, a, c = b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2).to_pylist()
                p = 1 / (1 + np.exp(-model.margin(matrices(a, c)[0 if name == "text" else 1])))
                free = ~np.isin(rows, left)
                for label, sure in ((1, p), (0, 1 - p)):
                    top = [i for i in np.lexsort((rows, -sure)) if free[i]][:grow]
                    best[label] = sorted([*best[label], *((-sure[i], int(rows[i]), label, float(p[i]), a[i], c[i]) for i in top)])[:grow]
            for kept in best.values():
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*kept, strict=True)], ["order", "row", "label", "p", "t", "m"])

        found = base.map_arrow(pool, run, "order double, row long, label long, p double, t binary, m binary")
        taught, seen = [], set()
        for label in (1, 0):
            for r in found.where(F.col("label") == label).orderBy("order", "row").limit(grow).collect():  # `grow` rows
                if r["row"] not in seen:  # a short pool's rows can be among the surest of both classes
                    seen.add(r["row"])
                    taught.append((r["row"], label, r["p"], bytes(r["t"]), bytes(r["m"])))
        return taught

    model = cotrain([bytes(r[t]) for r in got], [bytes(r[m]) for r in got], np.array([r["y"] for r in got], np.float64), surest, rounds)
    base.drop(pool, chosen)
    return model


def _scored(model: Model) -> Column:
    @F.pandas_udf("score double, text_score double, meta_score double")
    def run(t: pd.Series, m: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(model.chances(*matrices(t.to_list(), m.to_list())), columns=["score", "text_score", "meta_score"])

    return run(*_VIEWS[:2])


def score(viewed: DataFrame, model: Model, at: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    """id, score (chance of label 1), predicted and each view's calibrated chance, of a table of views()."""
    out = viewed.select(F.col(id_col), _scored(model).alias("s"))
    return out.select(id_col, "s.score", (F.col("s.score") >= at).cast("int").alias("predicted"), "s.text_score", "s.meta_score")


def keep_good(docs: DataFrame, labels: DataFrame, at: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least `at`."""
    viewed = views(docs, docs.columns, text_col)
    return viewed.where(_scored(fit(viewed, labels, id_col, label_col))["score"] >= at).drop(*_VIEWS)
