import datetime as dt
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import GroupedData
from pyspark.sql import functions as F

from oremill.operators import access, answers, chunking, context, governance, graph, intent, knowledge, memory, ontology, resolution, retrieval, upsert
from oremill.plans import scratch


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def edges(spark, pairs):
    return frame(spark, [(f"{a}{b}", a, b, "R", float(w)) for a, b, w in pairs], "edge_id string, source string, target string, relation string, weight double")


def test_pagerank_like_a_plain_model(spark):
    r = random.Random(3)
    pairs = [(f"n{r.randrange(12)}", f"n{r.randrange(12)}", r.randint(1, 5)) for _ in range(40)]
    adj = {}
    for a, b, w in pairs:
        adj.setdefault(a, {}).setdefault(b, 0)
        adj[a][b] += w
    seeds = {"n1": 2.0, "n2": 1.0}
    reset = {k: v / 3 for k, v in seeds.items()}
    p = dict(reset)
    for _ in range(50):
        new = {k: 0.5 * v for k, v in reset.items()}
        for a, out in adj.items():
            for b, w in out.items():
                new[b] = new.get(b, 0) + 0.5 * p.get(a, 0) * w / sum(out.values())
        moved = sum(abs(new.get(k, 0) - p.get(k, 0)) for k in {*new, *p})
        p = new
        if moved < 1e-6:
            break
    df = edges(spark, pairs).groupBy("source", "target").agg(F.sum("weight").alias("weight"))
    got = {x["id"]: x["score"] for x in graph.pagerank(df, frame(spark, list(seeds.items()), "id string, weight double")).collect()}
    assert sum(got.values()) <= 1 + 1e-9
    assert got == pytest.approx({k: v for k, v in p.items() if v > 1e-10}, abs=1e-9)


def test_walks(spark):
    e = edges(spark, [("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("x", "y", 1)])
    seed = frame(spark, [("a",)], "id string")
    assert {tuple(r) for r in graph.khop(e, seed, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {tuple(r) for r in graph.khop(e, seed, 2, "in").collect()} == {("a", 0)}
    assert [r["id"] for r in graph.shortest_path(e, "d", "a").orderBy("step").collect()] == ["d", "c", "b", "a"]
    assert graph.shortest_path(e, "a", "y").count() == 0
    assert {tuple(r) for r in graph.components(e).collect()} == {*((x, "a") for x in "abcd"), ("x", "x"), ("y", "x")}
    nodes, kept = graph.subgraph(e, seed, 1)
    assert nodes.count() == 2 and [r["edge_id"] for r in kept.collect()] == ["ab"]


def test_long_chain_components(spark):
    e = edges(spark, [(f"v{i:03d}", f"v{i + 1:03d}", 1) for i in range(60)])
    assert {r["component"] for r in graph.components(e).collect()} == {"v000"}


def test_identity_and_visibility(spark):
    rows = [(1, "t1", "u1", None, "b"), (2, "t1", "u1", "tenant", "b"), (3, "t1", "u2", "user", "b"), (4, "t2", "u1", None, "b")]
    df = frame(spark, rows, "id int, tenant_id string, user_id string, visibility string, bucket_id string")
    ids = lambda who: {r["id"] for r in access.scan(df, who).collect()}
    assert ids(access.Identity()) == {1, 4}
    assert ids(access.Identity(tenant="t1")) == {1, 2}
    assert ids(access.Identity(tenant="t1", user="u2")) == {3}
    assert access.scan(df, buckets=[]).count() == 0
    assert access.Identity("t", user="u").key() == "tenant:t|user:u"
    with pytest.raises(ValueError):
        access.require_filter(bucket=None)


def test_upserts(spark):
    old = frame(spark, [(1, "a", "x", 0), (2, "b", None, 0)], "id int, v string, w string, seq int")
    new = frame(spark, [(1, "c", None, 1), (1, "d", None, 2), (3, "e", "y", 1)], "id int, v string, w string, seq int")
    got = {r["id"]: (r["v"], r["w"]) for r in upsert.keyed(old, new, ["id"], keep_old=(), coalesce=("w",)).collect()}
    assert got == {1: ("d", "x"), 2: ("b", None), 3: ("e", "y")}
    e = lambda rows: frame(spark, rows, "source string, target string, relation string, weight double, evidence array<string>")
    g = {r["source"]: (r["weight"], r["evidence"]) for r in upsert.graph_edges(e([("a", "b", "R", 4.0, ["x"])]), e([("a", "b", "R", 3.0, ["", "y"]), ("c", "b", "R", 9.0, [])])).collect()}
    assert g == {"a": (5.0, ["x", "y"]), "c": (9.0, [])}
    k = lambda rows: frame(spark, rows, "entity_id string, type string, value string")
    assert upsert.conflicts(k([("e2", "email", "a")]), k([("e1", "email", "a"), ("e1", "email", "b")]), ["type", "value"]).count() == 1


def test_merge_and_delete(spark):
    e = frame(spark, [("a", "b", "R", 1.0), ("c", "b", "R", 2.0), ("a", "c", "R", 1.0)], "source string, target string, relation string, weight double")
    got = {(r["source"], r["target"]): (r["weight"], r["valid"]) for r in upsert.merge_entities(e, frame(spark, [("c", "a")], "old_id string, new_id string")).collect()}
    assert got == {("a", "b"): (3.0, True), ("a", "a"): (1.0, False)}
    gone = frame(spark, [("b",)], "id string")
    assert upsert.delete_entities(e.withColumn("valid", F.lit(True)), gone, purge=True).count() == 1
    assert upsert.delete_entities(e.withColumn("valid", F.lit(True)), gone, purge=False).where("valid").count() == 1


@pytest.mark.parametrize("seed", range(5))
def test_chunks_keep_the_text(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["word", "Longer. ", "a", " ", "\n\n", "\n\n\n", "! ", "x" * 70]) for _ in range(200)) + "z" * 40
    for most in (20, 50, 200):
        made = chunking.chunk(text, most)
        # only blank chunks may be missing
        assert "".join("".join(text[c["start"] : c["stop"]] for c in made).split()) == "".join(text.split())
        over = chunking.chunk(text, most, 10)
        assert all(o["content"].endswith(text[o["start"] : o["stop"]]) for o in over)
    assert chunking.chunk(" \n", 10) == [] and chunking.chunk(None, 10) == []


def test_chunk_sizes():
    made = chunking.chunk("One two three. Four five six. " * 20, 60, least=5)
    assert max(len(c["content"]) for c in made) <= 60 + 5 and len(made) > 8
    assert len(chunking.chunk("a" * 30 + " " + "b" * 30 + " cc", 31)) == 2


def test_resolution(spark):
    rows = [("1", "Acme Widgets", "organization"), ("2", "ACME widgets", "organization"), ("3", "Acme Widgetz Ltd", "organization"), ("4", "Version 2", "product"), ("5", "Version 3", "product"), ("6", "Acme Widgets", "person")]
    got = {r["id"]: r["canonical_id"] for r in resolution.resolve(frame(spark, rows, "id string, name string, type string")).collect()}
    assert got["2"] == "1" and got["4"] == "4" and got["5"] == "5" and got["6"] == "6"
    assert not resolution.may_merge("John Smith", "Mary Smith", "person") and resolution.may_merge("Jon Smith", "Jonathan Smith", "person")
    assert list(resolution.triples("Alice founded Acme. Bob was hired by Carol.")) == [("Alice", "FOUNDED", "Acme"), ("Bob", "HIRED_BY", "Carol")]


def test_intents(spark):
    want = {
        "Who killed the Old King?": ("", "Old King", "KILLED", "fact", "strict"), "who was the wife of Henry Ford?": ("Henry Ford", "", "MARRIED", "fact", "strict"), "Who is Ada's father": ("", "Ada", "PARENT_OF", "fact", "strict"),
        "where is Acme headquartered": ("Acme", "", "HEADQUARTERED_IN", "fact", "strict"), "where is Acme located?": ("Acme", "", "LOCATED_IN", "fact", "strict"), "Where was Ada born?": ("Ada", "", "BORN_IN", "fact", "strict"),
        "Tell me about the fox": ("fox", "", "", "summary", "soft"), "Tell me about Ada Lovelace": ("Ada Lovelace", "", "", "summary", "soft"), "How are Bob and Eve related?": ("Bob", "Eve", "", "relationship", "soft"),
        "tell me about it": None, "nothing here": None, "": None, "Ada met Charles Babbage": ("Ada, Charles Babbage", "", "", "summary", "soft"), "Write a letter to 'x' from Ada": ("Ada", "", "", "creative", "soft"),
        "What does \"Big Corp\" own?": ("Big Corp", "", "OWNS", "fact", "strict"), "why did Ada go": None,
    }
    got = {r["id"]: tuple(r)[1:] for r in intent.parse(frame(spark, [(q, q) for q in want], "id string, query string")).collect()}
    assert got == {q: v for q, v in want.items() if v}
    assert intent.parse(frame(spark, [(1, None)], "id int, query string")).count() == 0


def test_ontology(spark):
    rows = [("a", "founded by", "b"), ("a", "was employed by", "b"), ("a", "AKA", "b"), ("a", "co-founded by", "b"), ("a", "is", "b")]
    got = [tuple(r) for r in ontology.normalise(frame(spark, rows, "subject string, predicate string, object string"), ontology.table(spark)).select("subject", "predicate", "valid", "temporal_status").collect()]
    assert sorted(got, key=str) == sorted([("b", "FOUNDED", True, None), ("a", "WORKS_FOR", True, "former"), ("a", "AKA", False, None), ("b", "FOUNDED", True, None), ("a", "IS", False, None)], key=str)


def test_policies(spark):
    p = frame(spark, [("p1", "t1", "query", "deny", None)], "id string, tenant_id string, action string, effect string, conditions map<string,string>")
    ask = lambda t: frame(spark, [(1, t, "query", {})], "k int, tenant_id string, action string, metadata map<string,string>")
    governance.enforce(ask("t2"), p, "k")
    with pytest.raises(governance.PolicyViolation):
        governance.enforce(ask("t1"), p, "k")


def test_context():
    s = {"chunks": [("a<b", 5), ("c", 5)], "facts": [("f", 5)]}
    assert context.trim(s, 10) == {"chunks": [("a<b", 5), ("c", 5)], "facts": []}
    assert context.trim(s, 1) == {"chunks": [("a<b", 5)], "facts": []}
    assert "<chunk>a&lt;b</chunk>" in context.render(s) and "## Facts" in context.render(s, "markdown")


def test_memory_plugins(spark):
    rows = [(i, "episodic", "active", f"m{i}", "c", 0.5, 0, None, "2024-01-01 00:00:00") for i in range(5)]
    m = frame(spark, rows, "id int, category string, status string, content string, conversation_id string, importance double, access_count int, last_accessed_at string, created_at string")
    m = m.withColumn("created_at", F.col("created_at").cast("timestamp")).withColumn("last_accessed_at", F.col("last_accessed_at").cast("timestamp"))
    import datetime as dt

    out = memory.summarise(memory.consolidation_batches(m, dt.datetime(2024, 1, 2), size=2), lambda texts: "+".join(texts))
    assert sorted(r["content"] for r in out.collect()) == ["m0+m1", "m2+m3", "m4"]
    assert memory.forget(m, dt.datetime(2026, 1, 1), "delete").count() == 5  # importance alone keeps them


def test_batch_topk_is_exact_and_bounded(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(200)]
    df = frame(spark, rows, "id long, embedding array<float>").repartition(5)
    q = df.where("id < 3").select(F.col("id").alias("query_id"), "embedding")
    got = retrieval.batch_topk(df, q, 4)
    for i in range(3):
        want = [x["id"] for x in retrieval.semantic_topk(df, rows[i][1], 4).collect()]
        assert [x["id"] for x in got.where(F.col("query_id") == i).orderBy("rank").collect()] == want
    with pytest.raises(ValueError):
        retrieval.batch_topk(df, q, 4, bound=2)


def test_descriptions():
    assert knowledge.sentences("Dr. Smith came. He left.") == ["Dr. Smith came.", "He left."]
    assert knowledge.merge_descriptions("Ada wrote notes.", "Ada wrote notes. She met Babbage. A third one.") == "Ada wrote notes. She met Babbage."
    assert knowledge.merge_descriptions("", "word " * 100, 40).startswith("word word") and len(knowledge.merge_descriptions("", "word " * 100, 40)) <= 40


def test_contradictions(spark):
    rows = [("Bob KILLED Al", "Al", "KILLED", "Bob"), ("Al killed Bob", "Al", "KILLED", "Bob"), ("a (b) c", "c", "x", "(b)")]
    df = frame(spark, rows, "t string, s string, r string, o string")
    assert [r[0] for r in df.select(knowledge.contradicts(F.col("t"), F.col("s"), F.col("r"), F.col("o"))).collect()] == [True, False, False]


def test_resolution_of_all_entities_and_short_names(spark):
    import __spark_entry__
    from oremill import relations

    sf = "/root/testdata/sf0.001"
    got = {r["id"]: r["canonical_id"] for r in __spark_entry__.queries()["entity_resolution"](spark, sf).collect()}
    assert got.keys() == {r["id"] for r in relations.entities(spark, sf).collect()}
    assert all(got[i] == i for i in got if i.startswith(("cust:", "ord:")))  # their numbers differ
    rows = [("a", "HP", "organization"), ("b", "h.p", "organization"), ("c", "HQ", "organization"), ("d", "--", "organization"), ("e", "!", "organization"), ("f", "Jonathan Bartholomew Montgomery Smithson 7", "person"), ("g", "Jonathan Bartholomew Montgomery Smithsons 7", "person"), ("h", "Jonathan Bartholomew Montgomery Smithson 8", "person")]
    got = {r["id"]: r["canonical_id"] for r in resolution.resolve(frame(spark, rows, "id string, name string, type string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e", "f": "f", "g": "f", "h": "h"}


def test_small_memory_operators(spark):
    old = frame(spark, [(1, "Ada likes tea", [1.0, 0.0]), (2, "Bob likes tea", [0.0, 1.0]), (3, "Ada likes rain", [0.9, 0.1])], "id long, content string, embedding array<double>")
    new = frame(spark, [(7, "Ada hates tea", [1.0, 0.0])], "new_id long, content string, embedding array<double>")
    judge = lambda a, b: a.split()[0] == b.split()[0] and a.split()[2] == b.split()[2]
    assert [tuple(r) for r in memory.contradictions(old, new, judge).collect()] == [(7, 1)]
    assert memory.has_any(old) and not memory.has_any(old.limit(0)) and memory.history(old, 2).count() == 1
    with pytest.raises(ValueError):
        memory.correct(frame(spark, [], "id string, category string, status string, content string, invalid_at timestamp"), spark.range(5).select(F.col("id").cast("string").alias("wrong")), dt.datetime(2024, 1, 1), most=3)
    merged = frame(spark, [("indexed,memory",), ("memory",), ("graph",)], "modes string")
    assert tuple(retrieval.counters(merged).first()) == (3, 1, 1, 2, 1)


def test_anchors_of_common_names(spark):
    """Equal names first, then prefixes, then names that hold it; at most k of each name."""
    rows = [(f"e{i:03}", "red widget" if i == 50 else f"red widget {i}" if i % 2 else f"old red widget {i}") for i in range(100)]
    found = answers.anchors(frame(spark, [(1, "Tell me about red widget")], "id int, query string"), frame(spark, rows, "id string, name string"), 3)
    assert sorted((r["entity_id"], float(r["score"])) for r in found.collect()) == [("e001", 0.88), ("e003", 0.88), ("e050", 1.0)]


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        scratch.root(Cluster)


def test_synonym_pairs_hold_a_tile_of_scores(spark, monkeypatch):
    """Whole blocks of scores took a task's memory: no product is larger than a tile, and the pairs are those of brute force."""
    # what a task allocates for the scores of one group, run here
    made = []
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda self, run, schema: made.append(run))
    graph.synonym_pairs(frame(spark, [(0, [1.0])], "id long, embedding array<float>"))
    monkeypatch.undo()
    n = 6000
    x = np.random.default_rng(4).normal(size=(n, 4)).astype(np.float32)
    v = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 4).cast(pa.list_(pa.float32()))
    b = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), v, pa.array(np.arange(n, dtype=np.int32) % 2)], ["id", "v", "block"])
    tracemalloc.start()
    found = sum(r.num_rows for r in made[0]((pa.scalar(0), pa.scalar(1)), iter([b])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    assert found == int((np.round(u[::2] @ u[1::2].T, 6) >= 0.85).sum()) and peak < 64 << 20  # all scores of the group: 72 MB

    # many small blocks and tiles, copies, a null and an id twice
    rows = [(i, [float(z) for z in x[i % 150]]) for i in range(300)] + [(7, [float(z) for z in x[400]]), (None, [1.0] * 4), (301, None)]
    monkeypatch.setattr(graph, "BLOCK_VALUES", 128)
    monkeypatch.setattr(graph, "TILE", 5)
    got = sorted(map(tuple, graph.synonym_pairs(frame(spark, rows, "id long, embedding array<float>"), 0.9, blocks=2, dims=4).collect()))
    known = [(i, np.array(e) / np.linalg.norm(e)) for i, e in rows if i is not None and e is not None]
    want = sorted((i, j, round(float(a @ b), 6)) for i, a in known for j, b in known if i < j and round(float(a @ b), 6) >= 0.9)
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-6)
