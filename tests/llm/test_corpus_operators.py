"""Near-duplicates, fingerprints, toxicity, quality and the pipeline against brute force and held-out labels."""

import collections
import hashlib
import os
import pickle
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oremill.llm import base, fingerprint, minhash, quality, queries, toxicity
from tests.llm.conftest import LONG, ROWS

SF = "/root/testdata/sf0.01"


# --- near-duplicates


def plain_classes(texts):
    """Components of pairs whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"\w+", (t or "").lower())
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in texts}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    where = collections.defaultdict(list)
    for i in sorted(sets):
        shared = collections.Counter(j for g in sets[i] for j in where[g])
        for j, k in shared.items():
            if k / (len(sets[i]) + len(sets[j]) - k) >= 0.8 - 1e-9:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
        for g in sets[i]:
            where[g].append(i)
    return {i: find(i) for i in texts}


def test_near_duplicates_of_a_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == plain_classes({r["doc_id"]: r["text"] for r in docs.collect()})


def test_near_duplicate_chains_and_passages(spark):
    """Copies of copies drift apart, a passage is shared by unlike texts: the tail of the verification runs."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    texts, passage = {}, [word() for _ in range(60)]
    for _ in range(4):
        words = [word() for _ in range(150)]
        for _ in range(25):
            texts[len(texts)] = " ".join(words)
            for _ in range(2):
                words[r.randrange(len(words))] = word()
    for _ in range(120):
        texts[len(texts)] = " ".join([*(word() for _ in range(20)), *passage, *(word() for _ in range(20))])
    got = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {x["doc_id"]: x["class_id"] for x in got.collect()} == plain_classes(texts)


@pytest.mark.parametrize(("extra", "times"), [(20, 100), (20, 20), (15, 50)])
def test_near_duplicates_that_repeat_a_line(spark, extra, times):
    """Pairs whose sets are alike (0.83 or more) though one text repeats a line: their weights are not."""
    r = random.Random(extra * times)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(9))
    texts = {}
    for i in range(0, 60, 2):
        common, line = [word() for _ in range(104)], [word() for _ in range(extra - 4)]
        texts[i], texts[i + 1] = " ".join(common), " ".join(common + line * times)
    want = plain_classes(texts)
    assert sum(i != c for i, c in want.items()) == 30
    got = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {x["doc_id"]: x["class_id"] for x in got.collect()} == want


def test_probability_jaccard():
    a, b = minhash.mix(np.arange(1, 1001, dtype=np.uint64)), minhash.mix(np.arange(101, 1101, dtype=np.uint64))
    s = minhash.probminhash([(a, np.ones(1000)), (b, np.ones(1000))], 4000)
    assert (s[0] == s[1]).mean() == pytest.approx(900 / 1100, abs=0.03)
    heavy = np.where(np.arange(1000) < 500, 3.0, 1.0)
    s = minhash.probminhash([(a, np.ones(1000)), (a, heavy)], 4000)
    want = sum(1 / sum(max(1.0, heavy[j] / heavy[i]) for j in range(1000)) for i in range(1000))
    assert (s[0] == s[1]).mean() == pytest.approx(want, abs=0.03)


def test_near_duplicates_odd(spark, odd, none):
    rows = minhash.near_duplicates(odd).collect()
    got = collections.defaultdict(set)
    for r in rows:
        got[r["class_id"]].add(r["doc_id"])
    assert len(rows) == len(ROWS)
    assert got[1] == {1, 2, 8} and got[6] == {6, 7} and got[3] == {3} and got[4] == {4} and got[5] == {5} and got[9] == {9} and got[None] == {None}
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 3, 4, 5, 6, 9, 10, 11, None}
    assert kept.count() == len({r["doc_id"] for r in kept.collect()})  # of repeated rows one
    assert minhash.near_duplicates(none).count() == 0 and minhash.keep_one(none).count() == 0


def test_texts_of_one_id_are_told_apart(spark):
    r = random.Random(2)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    a, b, c = text(), text(), text()
    docs = spark.createDataFrame([(5, a), (5, b), (2, a + " end"), (7, b + " end"), (9, c), (5, c)], "doc_id long, text string")
    got = collections.Counter(tuple(x) for x in minhash.near_duplicates(docs).select("doc_id", "class_id", "class_size").collect())
    assert got == collections.Counter([(5, 2, 2), (2, 2, 2), (5, 5, 2), (7, 5, 2), (9, 5, 2), (5, 5, 2)])
    kept = sorted((x["doc_id"], x["text"]) for x in minhash.keep_one(docs).collect())
    assert kept == sorted([(2, a + " end"), (5, b), (5, c)])


# --- fingerprints


def test_entropy_levels():
    x = np.frombuffer(b"hello world, windows of entropy " * 9 + bytes(range(200)), np.uint8)
    for i, level in enumerate(fingerprint.levels(x)):
        c = np.bincount(x[i : i + fingerprint.WINDOW])
        p = c[c > 0] / fingerprint.WINDOW
        assert abs(-(p * np.log2(p)).sum() / np.log2(fingerprint.WINDOW) * 1000 - level) <= 1


def test_leftmost_least_ranks():
    r = np.random.default_rng(1)
    x = r.integers(97, 110, 400).astype(np.uint8)
    rank = r.permutation(fingerprint.LEVELS + 1)
    level = fingerprint.levels(x)
    rk = np.where((level < fingerprint.LOW) | (level > fingerprint.HIGH), fingerprint.LEVELS + 1, rank[level])
    run = fingerprint.RUN
    points = collections.Counter(i + int(np.argmin(rk[i : i + run])) for i in range(len(rk) - run + 1))
    want = [i for i, n in sorted(points.items()) if n >= fingerprint.POINTS and rk[i] <= fingerprint.LEVELS]
    assert fingerprint.features(x, rank).tolist() == want


@pytest.mark.parametrize("parts", [1, 3])
def test_edited_texts(spark, odd, parts):
    texts = sorted(((i is None, -(i or 0), t or "", i) for i, t, *_ in ROWS))
    order = [(i, t) for _, _, t, i in texts]
    want = []
    for k, (i, t) in enumerate(order):
        take = len(t) // 3
        want.append((str(i), len(t), hashlib.sha256((t[: len(t) - take] + order[(k + 1) % len(order)][1][:take]).encode()).hexdigest()))
    got = fingerprint.compare_edited(odd.repartition(parts)).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    by = collections.defaultdict(set)
    for r in got:
        by[next(x[1] for x in ROWS if x[0] == r["doc_id"])].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by.values())


def test_edited_texts_of_far_and_missing_ids(spark):
    """One id far from all others, repeated ids and many null ones: ranges follow the rows, and every row meets the next."""
    r = random.Random(6)
    rows = [(i if i < 150 else None if i < 230 else 5, "".join(r.choice("abcd ") for _ in range(r.randint(0, 30)))) for i in range(260)] + [(1 << 60, "far")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashes = {x["text"]: x["h"] for x in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), hashes[x[1]] if x[0] is None else 0, x[1]))
    want = collections.Counter()
    for k, (i, t) in enumerate(order):
        take = len(t) // 3
        want[str(i), hashlib.sha256((t[: len(t) - take] + order[(k + 1) % len(order)][1][:take]).encode()).hexdigest()] += 1
    assert collections.Counter((str(x["doc_id"]), x["edited_sha256"]) for x in fingerprint.compare_edited(docs).collect()) == want


def test_likeness_tells_edits_from_others(spark, none):
    got = fingerprint.compare_edited(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    assert np.mean([r["near_edited"] > r["near_next"] for r in got]) > 0.97
    assert fingerprint.compare_edited(none).count() == 0
    assert fingerprint.likeness(*[fingerprint.digest(np.frombuffer(LONG.encode(), np.uint8), np.arange(1001))] * 2) == 1.0


# --- toxicity


def test_block_max_search_is_exact():
    r = np.random.default_rng(3)
    vectors = []
    for _ in range(500):
        t = np.sort(r.choice(40, r.integers(1, 6), replace=False))
        w = r.random(len(t)) + 0.1
        vectors.append((t, w / np.sqrt(w @ w)))
    index = toxicity.Index(41, vectors, list(range(500)), np.zeros(500))
    dense = np.zeros((500, 41))
    at = {i: k for k, i in enumerate(index.ids)}
    for i, (t, w) in enumerate(vectors):
        dense[at[i], t] = w
    for t, w in vectors[:100]:
        scores = dense[:, t] @ w
        want = [k for k in np.lexsort((np.arange(500), -np.round(scores, 9))) if scores[k] > 0][:16]
        for light in (0.0, 0.02, 0.3):
            rows, cosines = index.search(t, w, light=light)
            assert rows.tolist() == want and np.allclose(cosines, scores[want])


def test_search_misses_no_row_of_light_terms_alone():
    """Sixteen rows with next to nothing in common used to hide a nearer one that shares a light term only."""
    unit = lambda x: (np.array([0, 2]), np.array([x, np.sqrt(1 - x * x)]))
    vectors = [unit(0.5), *[unit(0.001) for _ in range(20)], (np.array([1]), np.ones(1))]
    index = toxicity.Index(3, vectors, list(range(22)), np.zeros(22))
    rows, cosines = index.search(np.array([0, 1]), np.array([np.sqrt(1 - 0.0001), 0.01]), light=0.02)
    assert [index.ids[r] for r in rows[:2]] == [0, 21] and len(rows) == 16 and cosines[1] == pytest.approx(0.01)


def test_toxicity_terms_of_any_character():
    signs = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    for text in ["".join(f"a{x}B" for x in signs[:256]), *(f"a{x}bc {x}" for x in signs)]:
        assert toxicity.words_of(text) == re.findall(r"\w+", text.lower())
    every = toxicity.terms_of("short longer longest longer Stemmed stemmer ünïcödé ünïcö")
    there = toxicity.Terms("\n".join(every))
    for text in ("longer short other", "longes stemming stemming longer longer", "Ünïcödés ünïcö 中文", ""):
        known = {k: n for k, n in toxicity.terms_of(text).items() if k in every}
        t, n = there.counts(text)
        assert dict(zip(t.tolist(), n.tolist(), strict=True)) == {list(every).index(k): c for k, c in known.items()}


def test_toxicity_index_is_sent_without_what_follows_from_it():
    """Postings, bounds and a list of terms beside the vectors took the driver's memory: 51 bytes a posting."""
    r = np.random.default_rng(5)
    rows = []
    for i in range(400):
        t = np.sort(r.choice(5000, 300, replace=False)).astype(np.int32)
        w = r.random(300)
        rows.append((i, t, w / np.sqrt(w @ w), i % 2))
    asked = [r[1:3] for r in rows[:20]]
    model = toxicity.Model("\n".join(f"w{i}" for i in range(5000)), 1000, np.full(5000, 3), np.ones(5000))
    model.fit(rows, 0.5)
    sent = pickle.dumps(model)
    assert len(sent) < 400 * 300 * 14 + 200_000
    assert sum(getattr(v, "nbytes", 0) for v in vars(model.index).values()) < 400 * 300 * 13
    there = pickle.loads(sent)
    for (a, x), (b, y) in zip(model.index.search_all(asked), there.index.search_all(asked), strict=True):
        assert a.tolist() == b.tolist() and x.tolist() == y.tolist() and len(a) == toxicity.K
    assert list(there.scores(["w1 w2 w3", ""])) and toxicity.terms(there.key, there.vocabulary).counts("w7 w7 other")[0].tolist() == [7]


def test_toxicity_vectors_hold_every_term(spark):
    """The cosines of the evidence are those of plain TF-IDF vectors over all terms."""
    texts = {i: t for i, t in enumerate(["you bad bad fool", "a kind word", "bad fools again", "kind people here", "quite a word", "the fool is here", "people word"])}
    labels = {0: 1, 1: 0, 2: 1, 3: 0, 5: 1}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))

    def terms(text):
        w = collections.Counter(text.split())
        w += collections.Counter({k[:5] + "~": n for k, n in w.items() if len(k) > 5})
        return w | collections.Counter({k + "2": n - 1 for k, n in w.items() if n > 1})

    every = {i: terms(t) for i, t in texts.items()}
    known = set().union(*(every[i] for i in labels))

    def weight(k):
        df = sum(k in c for c in every.values())
        a, b = sum(k in every[i] for i in labels if labels[i]), sum(k in every[i] for i in labels if not labels[i])
        chi = 5 * max(abs(a * 2 - b * 3) - 2.5, 0) ** 2 / (6 * (a + b) * max(5 - a - b, 1))
        return (1 + np.log(8 / (df + 1))) * max(chi, 0.01) ** 2

    vector = {i: {k: (1 + np.log(n)) * weight(k) for k, n in c.items() if k in known} for i, c in every.items()}
    norm = {i: np.sqrt(sum(x * x for x in v.values())) for i, v in vector.items()}
    for r in toxicity.score(docs, model).collect():
        i = r["doc_id"]
        got = {e["id"]: e["cosine"] for e in r["evidence"]}
        want = {j: sum(x * vector[j].get(k, 0) for k, x in vector[i].items()) / norm[i] / norm[j] for j in labels}
        assert got == pytest.approx({j: c for j, c in want.items() if c > 0})


def test_toxicity_on_held_out_rows(spark):
    got = {r["doc_id"]: r for r in queries.op2_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    hit = [i for i in held if got[i]["predicted"]]
    assert sum(labels[i] for i in hit) / len(hit) > 0.95 and sum(labels[i] for i in hit) / sum(labels[i] for i in held) > 0.85
    assert all((r["score"] >= 0.7) == bool(r["predicted"]) and 0 <= r["score"] <= 1 for r in got.values())
    assert not {e["id"] for r in got.values() for e in r["evidence"]} & set(held)


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (6, 1), (7, 1), (11, 0), (None, 1), (3, None), (1, 0)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    assert toxicity.score(odd, model).count() == len(ROWS)
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    assert toxicity.score(none, model).count() == 0
    for few in (labels.limit(0), labels.where("toxic = 1")):
        assert {0.0 <= r["score"] <= 1.0 for r in toxicity.score(odd, toxicity.fit(odd, few)).collect()} == {True}
    assert toxicity.fit(none, labels).index is None


# --- quality


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    viewed = quality.views(docs, ["doc_id"])
    model = quality.fit(viewed, labels.where(~held))
    # each view teaches the other in every round, both classes
    assert len(model.rounds) == 3 and {n for r in model.rounds for pair in r.values() for n in pair} == {quality.GROW}
    got = quality.score(viewed, model).join(labels.where(held), "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.98
    assert np.mean([r["predicted"] for r in got if r["quality"]]) > 0.99


def test_views_teach_each_other(spark):
    """Two views that agree, few labels: the metadata view learns hosts that no labelled page has from what the text view is sure of."""
    r = random.Random(5)
    rows = []
    for i in range(1200):
        y = r.random() < 0.5
        words = r.choices(["calm", "river", "stone", "light"] if y else ["$$$", "WIN", "##", "0000"], k=12) + r.choices(["a", "the", "of"], k=8)
        host = f"{r.choice(['lib', 'press', 'study'] if y else ['bets', 'spin', 'cash'])}{r.randrange(3)}.example"
        rows.append((i, " ".join(r.sample(words, 20)), f"https://{host}/x/{i}", int(y)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, url string, quality int").repartition(3)
    viewed = quality.views(docs.drop("quality"), ["doc_id"])
    few = docs.where("doc_id < 24").select("doc_id", "quality")
    alone, taught = quality.fit(viewed, few, rounds=0), quality.fit(viewed, few, grow=50)
    assert [x["meta"] for x in taught.rounds] == [x["text"] for x in taught.rounds] == [(50, 50)] * 3
    right = lambda model, c: np.mean([(x[c] >= 0.5) == rows[x["doc_id"]][3] for x in quality.score(viewed, model).where("doc_id >= 24").collect()])
    assert right(taught, "meta_score") > max(right(alone, "meta_score"), 0.97) - 0.005 and right(taught, "score") > 0.98


def test_surest_rows_by_brute_force(spark, monkeypatch):
    """What a view teaches in round one is the top of a full sort of all unlabelled rows."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    viewed = quality.views(docs, ["doc_id"])
    seen = {}

    def spy(t, m, y, surest, rounds):
        one = quality.Linear(np.linspace(-1, 1, quality.META), 0.1)
        seen["got"] = surest("meta", one, set())
        seen["again"] = surest("meta", one, {g[0] for g in seen["got"]})
        pool = [x for x in viewed.collect() if x["doc_id"] not in {z["doc_id"] for z in labels.where("quality IS NOT NULL").collect()}]
        p = 1 / (1 + np.exp(-one.margin(quality.matrices([x[1] for x in pool], [x[2] for x in pool])[1])))
        ids = np.array([x[3] for x in pool])
        seen["want"] = [{*ids[np.lexsort((ids, -s))[:7]].tolist()} for s in (p, 1 - p)]
        return quality.Model(quality.Linear(), quality.Linear(), np.zeros(2), 0.0, 0.5)

    monkeypatch.setattr(quality, "cotrain", spy)
    quality.fit(viewed, labels, grow=7)
    assert [{g[0] for g in seen["got"] if g[1] == k} for k in (1, 0)] == seen["want"]
    assert not {g[0] for g in seen["got"]} & {g[0] for g in seen["again"]}


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (6, 0), (7, 0), (11, 1), (None, 1), (3, None), (1, 1)], "doc_id long, quality int")
    viewed, empty = quality.views(odd, ["doc_id"]), quality.views(none, ["doc_id"])
    model = quality.fit(viewed, labels)
    assert quality.score(viewed, model).count() == len(ROWS) and quality.keep_good(odd, labels).columns == odd.columns
    assert quality.score(empty, model).count() == 0 and quality.keep_good(none, labels).count() == 0
    assert {r["score"] for r in quality.score(viewed, quality.fit(viewed, labels.limit(0))).collect()} == {1.0}
    assert {r["score"] for r in quality.score(viewed, quality.fit(empty, labels)).collect()} == {1.0}
    bare = quality.views(odd.select("doc_id", "text"), ["doc_id"])
    assert quality.score(bare, model).count() == len(ROWS)


# --- pipeline


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if i < 4:
            assert out.columns == columns, name
            out.write.parquet(f"file://{tmp_path}/{i}")
            before, docs = {r["doc_id"]: r["text"] for r in docs.collect()}, spark.read.parquet(f"file://{tmp_path}/{i}")
            kept = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert kept.items() <= before.items()
            if name == "exact_dedup":
                groups = collections.defaultdict(list)
                for k, t in before.items():
                    groups[re.sub(r"[\x20\x09-\x0d]", "", t)].append((-len(t), k))
                assert set(kept) == {min(g)[1] for g in groups.values()}
            if name == "near_dedup":
                assert set(kept) == set(plain_classes(before).values())
            seen.append(len(kept))
    assert {r["doc_id"] for r in out.collect()} == set(kept) and seen[-1] < seen[0]
    assert corpus_pipeline.run(spark, sf).count() == out.count()


def scratch(spark):
    """The names of the stored tables in the shared folder."""
    at = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/oremill"
    return {x.rsplit("-", 1)[0]: x for x in os.listdir(at)} if os.path.isdir(at) else {}


def test_pipeline_stages_free_what_the_stage_before_left(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    base.clear()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before, out = set(scratch(spark).values()), stage(spark, docs, sf)
        out.write.parquet(f"file://{tmp_path}/{i}")
        docs = spark.read.parquet(f"file://{tmp_path}/{i}")
        assert not before & set(scratch(spark).values()), name
    assert set(scratch(spark)) == {"numbered", "rows", "first"}
    # a result that is passed on as it is keeps what it reads
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf)
    assert docs.count() == spark.read.parquet(f"file://{tmp_path}/3").count()


def test_near_duplicates_leave_their_result_only(spark):
    base.clear()
    got = minhash.near_duplicates(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert set(scratch(spark)) == {"rows", "sizes"} and got.count() == 200
