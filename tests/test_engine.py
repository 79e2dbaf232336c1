import datetime as dt

import pytest
from pyspark.sql import functions as F

from oremill.operators import access
from oremill.operators.access import Identity
from oremill.operators.governance import PolicyViolation
from oremill.plans.engine import Config, Engine
from oremill.sources import tables
from oremill.sources.catalog import Catalog
from oremill.streaming import events


@pytest.fixture()
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/tables", Config(tokens=20, overlap=0))


def sources(spark, *rows):
    return spark.createDataFrame(rows, "id string, content string, url string")


def test_ingest_is_idempotent(spark, engine):
    docs = sources(spark, ("1", "The quick brown fox jumps over the lazy dog. " * 6, "u1"), ("2", "Graphs and vectors.", None))
    assert engine.ingest(docs).where("NOT skip").count() == 2
    first = engine.catalog.read("chunks")
    ids = {r["id"] for r in first.collect()}
    assert engine.ingest(docs).where("NOT skip").count() == 0
    assert {r["id"] for r in engine.catalog.read("chunks").collect()} == ids
    # a shorter text leaves no chunk beyond its end
    engine.ingest(sources(spark, ("1", "Short now.", "u1")))
    assert engine.catalog.read("chunks").count() == 2
    engine.ingest(sources(spark, ("1", "Short now.", "u1")), replace=True)
    assert engine.catalog.read("chunks").count() == 1


def test_query_and_context(spark, engine):
    engine.ingest(sources(spark, ("1", "A red fox lives in the forest", "a"), ("2", "Spark joins large tables", "b"), ("3", "The fox and the hound", "c")))
    r = engine.query("Where is the red fox?", 2)
    assert r.ranked.first()["content"].startswith("A red fox") and r.ranked.count() == 2
    assert "<chunk>" in engine.context(r)
    assert engine.query("what happened via the joins", 1, auto_weights=True).kind == "relational"


def test_isolation(spark, engine):
    docs = sources(spark, ("1", "secret fox", "a")).withColumn("visibility", F.lit("user"))
    engine.ingest(docs, who=Identity(tenant="t", user="u1"))
    assert engine.query("fox", who=Identity(tenant="t", user="u1")).ranked.count() == 1
    assert engine.query("fox", who=Identity(tenant="t")).ranked.count() == 0
    assert engine.query("fox", who=Identity(tenant="t", user="u2")).ranked.count() == 0


def memories(spark, *rows):
    return spark.createDataFrame([(i, "semantic", "active", 0.5, 0, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1), None, v, c) for i, v, c in rows], "id string, category string, status string, importance double, access_count int, last_accessed_at timestamp, created_at timestamp, valid_at timestamp, invalid_at timestamp, embedding array<double>, content string")


def test_memories_of_other_tenants(spark, engine):
    a, b = Identity(tenant="a", user="u"), Identity(tenant="b")
    engine.remember(memories(spark, ("1", [1.0, 0.0], "a's")), who=a)
    engine.remember(memories(spark, ("1", [1.0, 0.0], "b's"), ("2", [1.0, 0.1], "b's too")), who=b)
    said = lambda who: {r["content"] for r in engine.recall([1.0, 0.0], who=who).collect()}
    assert said(a) == {"a's"} and said(b) == {"b's", "b's too"} and said(Identity(tenant="c")) == set()
    engine.remember(memories(spark, ("3", [1.0, 0.0], "private")).withColumn("visibility", F.lit("user")), who=a)
    assert said(Identity(tenant="a")) == {"a's"} and said(a) == {"a's", "private"}
    # forgetting is for one's own
    engine.forget(dt.datetime(2060, 1, 1), "delete", who=b)
    assert engine.catalog.read("memories").where("tenant_id = 'a'").count() == 2


def test_policies_bind_every_call(spark, tmp_path):
    deny = spark.createDataFrame([(f"p{i}", "t", x, "deny", None) for i, x in enumerate(("index", "query", "memory.read", "memory.write", "memory.delete", "source.delete", "bucket.delete"))], "id string, tenant_id string, action string, effect string, conditions map<string,string>")
    e = Engine(spark, f"file://{tmp_path}/tables", Config(policies=deny))
    who, rows = Identity(tenant="t"), memories(spark, ("1", [1.0], "x"))
    e.remember(rows, who=Identity(tenant="free"))
    for call in (
        lambda: e.ingest(sources(spark, ("1", "x", "u")), who=who), lambda: e.query("x", who=who), lambda: e.recall([1.0], who=who), lambda: e.remember(rows, who=who), lambda: e.forget(dt.datetime(2025, 1, 1), who=who),
        lambda: e.delete(who=who, bucket_id="b"), lambda: e.delete_bucket("b", who=who), lambda: e.update_visibility(spark.createDataFrame([("s", "user")], "source_id string, visibility string"), who=who),
    ):
        with pytest.raises(PolicyViolation):
            call()


def test_metadata_keys_are_no_expressions(spark):
    m = spark.createDataFrame([("1", '{"a\'b": "x", "k": "y"}'), ("2", '{"k": "z"}')], "id string, j string").select("id", F.parse_json("j").alias("metadata"), F.lit("active").alias("status"))
    found = lambda **f: [r["id"] for r in m.where(access.memory_filter(metadata=f["of"])).collect()]
    assert found(of={"a'b": "x"}) == ["1"] and found(of={"k": "z"}) == ["2"] and found(of={"k', 'string') = 'z' OR ('1": "1"}) == []


def test_only_touched_buckets_are_written(spark, engine):
    engine.ingest(sources(spark, ("1", "one fox", "a")), bucket="b1")
    engine.ingest(sources(spark, ("2", "two foxes", "b")), bucket="b2")
    before = dict(engine.catalog.versions()["chunks"])
    engine.ingest(sources(spark, ("3", "three", "c")), bucket="b2")
    after = engine.catalog.versions()["chunks"]
    assert after["b1"] == before["b1"] and after["b2"] != before["b2"]
    engine.ingest(sources(spark, ("3", "three", "c")), bucket="b2")  # nothing new
    assert engine.catalog.versions()["chunks"] == after
    assert engine.catalog.vacuum() and engine.catalog.read("chunks").count() == 3 and not engine.catalog.vacuum()
    engine.update_visibility(engine.catalog.read("chunks", "b1").select("source_id", F.lit("user").alias("visibility")))
    assert {(r["bucket_id"], r["visibility"]) for r in engine.catalog.read("chunks").collect()} == {("b1", "user"), ("b2", None)}


def test_query_with_graph_and_memory(spark, engine):
    engine.ingest(sources(spark, ("1", "Acme makes red widgets", "a"), ("2", "A report on quarterly numbers", "b"), ("3", "nothing else", "c")))
    ids = {r["content"]: r["id"] for r in engine.catalog.read("chunks").collect()}
    frame = spark.createDataFrame
    engine.catalog.commit({
        "entities": frame([("e1", "Acme Corp", "organization"), ("e2", "Bolt Ltd", "organization")], "id string, name string, type string"),
        "edges": frame([("x", "e1", "OWNS", "e2", 1.0)], "edge_id string, source string, relation string, target string, weight double"),
        "entity_chunks": frame([("e2", ids["A report on quarterly numbers"], 1.0), ("e1", ids["Acme makes red widgets"], 1.0)], "entity_id string, chunk_id string, weight double"),
    })
    engine.remember(memories(spark, ("m", engine.spark.createDataFrame([("acme",)], "q string").select(engine.config.embed(F.col("q"))).first()[0], "Acme is a client")))
    got = {r["content"]: r["modes"] for r in engine.query("What does Acme Corp own?", 5, signals={"semantic", "keyword", "graph", "memory"}).ranked.collect()}
    assert "graph" in got["A report on quarterly numbers"] and got["Acme is a client"] == "memory" and set(got["Acme makes red widgets"].split(",")) >= {"graph", "indexed"}


def test_delete(spark, engine):
    engine.ingest(sources(spark, ("1", "one", "a")), bucket="b1")
    engine.ingest(sources(spark, ("2", "two", "b")), bucket="b2")
    engine.delete_bucket("b1")
    assert [r["bucket_id"] for r in engine.catalog.read("chunks").collect()] == ["b2"]
    with pytest.raises(ValueError):
        engine.delete()
    with pytest.raises(ValueError):
        engine.delete_bucket("bkt_default")


def test_memories(spark, engine):
    t = dt.datetime(2024, 1, 1)
    schema = "id string, category string, status string, content string, importance double, access_count int, created_at timestamp, last_accessed_at timestamp, valid_at timestamp, invalid_at timestamp, embedding array<double>"
    row = lambda i, e: (i, "semantic", "active", "x", 0.0, 0, t, t, t, None, e)
    engine.remember(spark.createDataFrame([row("a", [1.0, 0.0]), row("b", [0.0, 1.0])], schema))
    engine.remember(spark.createDataFrame([row("a", None)], schema))
    assert [r["id"] for r in engine.recall([1.0, 0.1], 1, as_of=t).collect()] == ["a"]
    engine.forget(dt.datetime(2025, 1, 1))
    assert {r["status"] for r in engine.catalog.read("memories").collect()} == {"archived"}


def test_catalog(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c")
    c.commit({"a": spark.range(3), "b": spark.range(2)})
    c.commit({"a": spark.range(5), "b": None})
    assert c.read("a").count() == 5 and not c.exists("b")
    with pytest.raises(RuntimeError):
        c.undeploy()
    c.commit({"a": spark.range(0)})
    c.undeploy()
    assert not c.exists("a")


def test_stream_equals_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema).parquet("/root/testdata/sf0.001/events*.parquet")
    q = events.tumbling(stream, "1 day", "2 days").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("w").collect()} == {tuple(r) for r in events.tumbling(batch, "1 day").collect()}
    q = events.sink(stream, f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == batch.count()


def test_keyed_tables(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/k")
    buckets = tables.Table(c, "buckets")
    t = dt.datetime(2024, 1, 1)
    row = lambda i, m, at: (i, m, f"name {i}", at)
    schema = "id string, embedding_model string, name string, created_at timestamp"
    buckets.put(spark.createDataFrame([row("b1", "m", t), row("bkt_default", "m", t)], schema))
    buckets.put(spark.createDataFrame([("b1", "other", "renamed", t + dt.timedelta(1))], schema))
    b = buckets.get(id="b1")
    assert (b["embedding_model"], b["name"], b["created_at"]) == ("m", "renamed", t)
    assert buckets.count() == 2 and buckets.list(limit=1, offset=1).count() == 1 and buckets.list(id=["b1", "x"]).count() == 1
    buckets.patch(spark.createDataFrame([("b1", None, "again")], "id string, embedding_model string, name string"))
    assert buckets.get(id="b1")["name"] == "again"
    with pytest.raises(ValueError):
        buckets.delete(id="bkt_default")
    buckets.delete(id="b1")
    assert [r["id"] for r in buckets.all().collect()] == ["bkt_default"]
    assert tables.last_run(c, "b1") is None
    tables.set_last_run(c, "b1", t)
    tables.set_last_run(c, "b1", t + dt.timedelta(2))
    assert tables.last_run(c, "b1") == t + dt.timedelta(2)


def test_stream_ingest(spark, engine, tmp_path):
    path = f"file://{tmp_path}/in"
    sources(spark, ("1", "one text", "a"), ("2", "two texts", "b")).write.parquet(path)
    for _ in range(2):
        events.ingest(engine, spark.readStream.schema("id string, content string, url string").parquet(path), f"{tmp_path}/ck", "b").awaitTermination()
    assert engine.catalog.read("chunks").count() == 2
    seen = events.first_seen(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), ["user_id"], "1 day")
    assert seen.columns[0] == "event_id"
