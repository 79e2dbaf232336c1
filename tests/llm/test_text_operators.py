"""Exact deduplication, tokenizers, packing, sharding and URL rules against brute force."""

import collections
import gc
import hashlib
import io
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from oremill.llm import exact_dedup, packing, sentencepiece_codec, sharding, token_counts, url_filter
from oremill.llm.queries import ORACLES, QUERIES, URL_RULES
from tests.compare import duck_rows, spark_rows
from tests.llm.conftest import ROWS

SF = "/root/testdata/sf0.001"
PIECE, BYTE, WORD = (public_tokenizers.path(p) for p in ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"))
ALPHABET = "aA'stredvml  \n\t.,!1²é́Σσς\x1c\x85\xa0 中文…’▁<s></s><|endoftext|>😀\x00"


def strings(n, most=60, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, most))) for _ in range(n)] + ["", " ", "  ", "\n", "▁", "a " * 3]


def texts_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# --- exact deduplication


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(SF, ORACLES[name])


def plain_dedup(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        norm = re.sub("[\x20\x09-\x0d]", "", t or "")
        out.append((i, min(groups[norm])[3], len(groups[norm]), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block,hot", [(4096, 1000), (3, 1000), (3, 1)])
def test_exact_dedup(spark, odd, monkeypatch, block, hot):
    monkeypatch.setattr(exact_dedup, "BLOCK", block if block > 3 else 64)
    monkeypatch.setattr(exact_dedup, "MIN_HOT", hot)
    got = exact_dedup.exact_dedup(odd)
    assert sorted((tuple(r)[:3] + (r["text_sha256"],) for r in got.collect()), key=str) == plain_dedup([r[:2] for r in ROWS])
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns
    # one row of each group, of two equal rows too
    assert kept.count() == len({re.sub(r"[\x20\x09-\x0d]", "", r[1] or "") for r in ROWS})


def test_keep_first_when_files_are_split_anew(spark, odd):
    """Reading with another parallelism than planning must lose nothing."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {i for i, k, *_ in plain_dedup([(r["doc_id"], r["text"]) for r in docs.collect()]) if i == k}
    try:
        for sizes in (("128m", "10k"), ("10k", "128m")):
            spark.conf.set(key, sizes[0])
            kept = exact_dedup.keep_first(spark.read.parquet(f"{SF}/documents.parquet"))
            spark.conf.set(key, sizes[1])
            assert {r["doc_id"] for r in kept.select("doc_id").collect()} == want
    finally:
        spark.conf.set(key, before)


def test_exact_dedup_random(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BLOCK", 3)
    monkeypatch.setattr(exact_dedup, "MIN_HOT", 5)
    r = random.Random(5)
    rows = [(i, "".join(r.choice("ab \n") for _ in range(r.randint(0, 24)))) for i in range(400)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(x)[:3] + (x["text_sha256"],) for x in got.collect()), key=str) == plain_dedup(rows)
    assert got.where("kept AND doc_id <> keep_id").count() == 0 and got.where("kept").count() == len({x[3] for x in plain_dedup(rows)})


# --- tokenizers


def test_token_counts_as_library(spark, odd):
    library = Tokenizer.from_file(WORD)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    t = token_counts.Transducer(open(WORD, encoding="utf-8").read())
    for s in strings(1500):
        assert t.count(s) == count(s) == t.count(s, chunk=5), s
    got = token_counts.count_tokens(odd, WORD, limit=10)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((r[0], len((r[1] or "").encode()), count(r[1]), count(r[1]) > 10) for r in ROWS), key=str)


def test_state_maps_compose_in_any_order():
    t = token_counts.Transducer(open(WORD, encoding="utf-8").read())
    r = random.Random(2)
    for s in strings(200, 80):
        s = t.normalise(s)
        cuts = sorted(r.randrange(len(s) + 1) for _ in range(4))
        parts = [s[a:b] for a, b in zip([0, *cuts], [*cuts, len(s)], strict=True)]
        m = [t.chunk_map(p) for p in parts]
        left = m[0]
        for x in m[1:]:
            left = t.compose(left, x)
        right = m[-1]
        for x in reversed(m[:-1]):
            right = t.compose(x, right)
        assert left == right == token_counts.scan(m, t.compose)[-1]
        assert t.total(left) == t.count(s)


def test_token_counts_of_every_character():
    """Classes and normalisation are the tokenizer's own, whatever Python's tables know."""
    library = Tokenizer.from_file(WORD)
    t = token_counts.Transducer(open(WORD, encoding="utf-8").read())
    points = [c for c in (*range(0x20000), *range(0x30000, 0x32400), *range(0xE0000, 0xE0200)) if not 0xD800 <= c < 0xE000]
    texts = [f"{c}'s .{c}! 1{c} x{c}" for c in map(chr, points)]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [p for p, s, n in zip(points, texts, want, strict=True) if t.count(s) != n] == []


def test_transitions_emit_what_is_certain():
    """Tokens emitted never shrink, and a bounded table of states that begins anew changes nothing."""
    t = token_counts.Transducer(open(WORD, encoding="utf-8").read())
    library = Tokenizer.from_file(WORD)
    r = random.Random(3)
    for _ in range(300):
        w = "".join(r.choice("aeinorst") for _ in range(r.randint(1, 25)))
        at, total = t.boundary, 0
        for c in w + " ":
            at, n = t.read(at, c)
            assert n >= 0
            total += n
        assert total == len(library.encode(w, add_special_tokens=False).ids) and at == t.boundary
        if r.random() < 0.1:
            t.words.states.clear()


def test_states_of_old_tables_are_let_go(monkeypatch):
    """A reading of the first table led to every state made since: the bound on states was none."""
    monkeypatch.setattr(token_counts, "STATES", 200)
    gc.collect()
    before = sum(type(x) is token_counts.State for x in gc.get_objects())
    t = token_counts.Transducer(open(WORD, encoding="utf-8").read())
    library = Tokenizer.from_file(WORD)
    r = random.Random(6)
    for _ in range(400):
        s = " ".join("".join(r.choice("aeinorst'!7") for _ in range(r.randint(1, 25))) for _ in range(5))
        assert t.count(s) == len(library.encode(s, add_special_tokens=False).ids) == t.count(s, chunk=7)
    assert sum(type(x) is token_counts.State for x in gc.get_objects()) - before <= 2 * 200


def test_long_word_merges():
    t = token_counts.Transducer(open(WORD, encoding="utf-8").read())
    library = Tokenizer.from_file(WORD)
    for s in ("ab" * 3000, "hello" * 500, "!" * 999):
        assert t.count(s) == len(library.encode(s, add_special_tokens=False).ids)


def test_sentencepiece_as_library(spark, odd):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    c = sentencepiece_codec.Codec(open(PIECE, "rb").read())
    texts = strings(1500)
    for s, (n, a, b, crc), (own, ends) in zip(texts, c.digests(texts), c.spans(texts), strict=True):
        ids = [*sp.encode(s), sp.eos_id()]
        assert (n, a, b) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()), s
        assert c.encode(s) == ids and c.decode(ids) == sp.decode(ids)
        assert own == ids[:-1] and zlib.crc32(ends.astype("<u4").tobytes()) == crc
        assert np.all(np.diff(np.r_[0, ends]) >= 0) and (not len(ends) or ends[-1] == len(s.encode()))
    made = sentencepiece_codec.encode(odd, PIECE)
    back = {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode(made, PIECE).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t, *_ in ROWS)
    assert sentencepiece_codec.digests(odd, PIECE).count() == len(ROWS)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_character_map_as_library(rule):
    n = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    own = sentencepiece_codec.Normalizer(n.serialized_model_proto())
    own.dummy = own.squeeze = own.escape = False
    for s in [*strings(500), "ﬁ ｱﾊﾟｰﾄ ① ½ É"]:
        got, align = own(s)
        assert got == n.Normalize(s), s
        assert len(align) == len(got) + 1 and np.all(np.diff(align) >= 0)


@pytest.mark.parametrize("rule,kind,fallback", [("nmt_nfkc", "bpe", True), ("nmt_nfkc", "unigram", False), ("nfkc_cf", "bpe", False), ("nfkc_cf", "unigram", True)])
def test_codec_of_models_with_a_map(spark, rule, kind, fallback):
    """Models that rewrite text are encoded through our normaliser; spans point to the bytes that were rewritten."""
    out, r = io.BytesIO(), random.Random(4)
    words = ["".join(r.choice("abcdeilnorst") for _ in range(r.randint(2, 9))) for _ in range(400)]
    sentencepiece.SentencePieceTrainer.train(
        sentence_iterator=iter([" ".join(r.choices(words, k=12)) for _ in range(200)]), model_writer=out, vocab_size=400, model_type=kind, normalization_rule_name=rule, byte_fallback=fallback, hard_vocab_limit=False, minloglevel=2
    )
    c, sp = sentencepiece_codec.Codec(out.getvalue()), sentencepiece.SentencePieceProcessor(model_proto=out.getvalue())
    texts = [*strings(600), "ﬁ ｱﾊﾟｰﾄ ① ½ É", "  two  spaces  ", "x ▁"]
    for s, (ids, ends) in zip(texts, c.spans(texts), strict=True):
        assert ids == sp.encode(s) and c.decode(ids) == sp.decode(ids), s
        assert np.all(np.diff(np.r_[0, ends]) >= 0) and (not len(ends) or ends[-1] <= len(s.encode()))
    # the bytes of a piece, normalised by the library, are the piece
    n = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=False, escape_whitespaces=True, remove_extra_whitespaces=False)
    source = "ﬁne ①② ½ Ünder"
    (ids, ends), = c.spans([source])
    for i, a, b in zip(ids, np.r_[0, ends[:-1]], ends, strict=True):
        got = n.Normalize(source.encode()[a:b].decode("utf-8", "replace")) if b > a else ""
        assert i in c.byte or i == c.unknown or c.pieces[i].lstrip("▁") in got


# --- packing


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else capacity) - s)
    return len(gaps)


def test_sweeps_of_ranges_are_one_sweep():
    """However the order is cut into ranges, every piece takes the last free gap before it."""
    r = random.Random(8)
    for _ in range(200):
        gap = np.array([r.random() < 0.5 for _ in range(r.randint(1, 60))])
        want, free = {}, []
        for i, g in enumerate(gap):
            if g:
                free.append(i)
            elif free:
                want[i] = free.pop()
        assert dict(zip(*(x.tolist() for x in packing.sweep(gap)), strict=True)) == want
        cuts = [0, *sorted(r.randrange(len(gap) + 1) for _ in range(4)), len(gap)]
        got, left, rows = {}, {}, {}
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            pieces, gaps = packing.sweep(gap[a:b])
            got |= dict(zip((pieces + a).tolist(), (gaps + a).tolist(), strict=True))
            over = [i for i in range(a, b) if i - a not in {*pieces.tolist(), *gaps.tolist()}]
            rows[k] = [i for i in over if not gap[i]], [i for i in over if gap[i]]
            left[k] = tuple(map(len, rows[k]))
        for k, at, n, of, top in packing.meet(left):
            got |= {rows[k][0][at + i]: rows[of][1][top - i] for i in range(n)}
        assert got == want


@pytest.mark.parametrize("events", [9, 250_000])
@pytest.mark.parametrize("capacity,longest", [(64, 64), (64, 20), (10, 10)])
def test_best_fit_in_supersteps(spark, monkeypatch, events, capacity, longest):
    monkeypatch.setattr(packing, "EVENTS", events)
    monkeypatch.setattr(packing, "LAST", 4)
    r = random.Random(capacity + longest)
    sizes = [r.randint(1, longest) for _ in range(150)]
    got = packing.best_fit(packing.base.store(spark.createDataFrame(list(enumerate(sizes)), "pid long, length long"), "sizes"), capacity).collect()
    assert sorted(x["pid"] for x in got) == list(range(len(sizes))) and len({(x["bin"], x["step"], x["slot"]) for x in got}) == len(sizes)
    filled = collections.Counter()
    for x in got:
        filled[x["bin"]] += sizes[x["pid"]]
    assert max(filled.values()) <= capacity
    assert len(filled) <= best_fit_decreasing(sizes, capacity) + 1


def test_packing(spark, odd):
    library = Tokenizer.from_file(BYTE)
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 2]
    got = packing.pack(odd, BYTE, end_id=2, capacity=16, with_ids=True).collect()
    by = collections.defaultdict(list)
    for r in got:
        assert len(r["ids"]) == r["length"] <= 16 and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 16
    want = collections.Counter(tuple(ids(r[1])) for r in ROWS)
    made, held = collections.Counter(), []
    for r in sorted(got, key=lambda r: (str(r["doc_id"]), r["piece"], r["start"])):
        held.append(r)
    whole = collections.defaultdict(list)
    for r in held:
        whole[r["doc_id"]].append(r)
    for i, t, *_ in ROWS:
        pieces = whole[i]
        copies = sum(x[0] == i for x in ROWS)
        n = len(ids(t))
        assert [p["length"] for p in pieces[::copies]] == packing.cut(n, 16)
        made[tuple(x for p in pieces[::copies] for x in p["ids"])] += 1
    assert made == want
    total = sum(len(ids(r[1])) for r in ROWS)
    assert len(by) <= -(-total // 16) + len(ROWS)


def test_byte_ids_as_library():
    library, own = Tokenizer.from_file(BYTE), packing.ByteBpe(open(BYTE, encoding="utf-8").read())
    for s in [*strings(1500), " " * 200_000 + "a", "a" * 200_000]:
        assert own.ids(s).tolist() == library.encode(s, add_special_tokens=False).ids


# --- sharding


def check_shards(rows, sizes, shards):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    counts = [len(by[k]) for k in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted(sizes)


def test_sharding(spark, odd, monkeypatch):
    want = [(len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ROWS]
    check_shards(sharding.interleave(odd).collect(), want, 8)
    monkeypatch.setattr(sharding, "CELL", 4)
    rows = [(i, f"text {i}", "hot" if i % 3 else f"s{i % 7}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sharding.interleave(docs).collect()
    check_shards(got, [(len(t) + 1, zlib.crc32(t.encode())) for _, t, _ in rows], 8)
    source = {i: s for i, _, s in rows}
    for name, n in collections.Counter(source.values()).items():
        each = collections.Counter(r["shard"] for r in got if source[r["doc_id"]] == name)
        assert all(abs(each[k] - n / 8) <= 2 for k in range(8))
    assert [tuple(r) for r in sorted(got)] == [tuple(r) for r in sorted(sharding.interleave(docs.repartition(7)).collect())]


# --- URL filter


def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, what) for what, r in URL_RULES if (host == (h := r.partition("/")[0]) or host.endswith("." + h)) and path.startswith("/" + r.partition("/")[2])]
    return (host, path, *((max(fits)[1:]) if fits else (None, None)))


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/7", "https://a.example.com/en/71?x#y", "http://com/en/", "http://xcom/en/1", "http://example.net/de/8/", "http://b.net/de/8", "ftp://x.org/es/", "http://x.org?/es/", "http://ÄB.org/es/a://b", "://com/en/", "http://com", "http://a.com/fr/7", "http://example.com/en/7"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(3, urls[3])], "page_id long, url string")
    none = spark.createDataFrame([], "url string, y int")
    for r in url_filter.judge(pages, none, URL_RULES).collect():
        host, path, rule, verdict = plain_rule(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")
    assert url_filter.judge(pages.limit(0), none, URL_RULES).count() == 0


def test_url_trees_learn(spark):
    r = random.Random(4)
    bad = lambda: f"http://x{r.randrange(99)}-win.example.net/a/{r.randrange(10**9)}?a=1&b=2&c=3"
    good = lambda: f"https://site{r.randrange(9)}.example.org/story/{r.choice(['cats', 'dogs', 'trees'])}"
    rows = [(bad(), 1) if r.random() < 0.4 else (good(), 0) for _ in range(600)]
    labelled = spark.createDataFrame(rows[:400], "url string, y int")
    test = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(rows[400:])], "page_id long, url string, y int")
    got = {x["page_id"]: x["verdict"] for x in url_filter.judge(test, labelled, []).collect()}
    assert sum((got[i] == "block") == bool(y) for i, (_, y) in enumerate(rows[400:])) >= 195


def test_url_suffixes_of_all_labels(spark):
    """More labelled urls than the trees learn from: a suffix is judged by all of its labels, not by those in the sample."""
    y = (F.crc32(F.col("s").cast("string")) % 2).cast("int").alias("y")
    host = F.concat(F.lit("https://s"), F.lpad(F.col("s").cast("string"), 4, "0"), F.lit(".example.net/"))
    each = spark.range(60_000).withColumn("s", F.col("id") % 6000)
    assert each.count() > url_filter.SAMPLE
    labelled = each.select(F.concat(host, F.lpad((F.col("id") * 7919 % 99991).cast("string"), 5, "0")).alias("url"), y)
    pages = spark.range(6000).withColumn("s", F.col("id")).select(F.col("id").alias("page_id"), F.concat(host, F.lpad("s", 5, "9")).alias("url"), y)
    got = url_filter.judge(pages, labelled, []).join(pages.select("page_id", "y"), "page_id").collect()
    assert len(got) == 6000
    assert [r["page_id"] for r in got if (r["verdict"] == "block") != bool(r["y"])] == []


def test_url_odd(spark):
    """Clashing columns, null and very long urls, repeated pages, labels of one kind or none."""
    rows = [(1, None, 2), (2, "", 2), (2, "", 2), (3, "http://example.com/a", 2), (None, "x://" + "a." * 9000 + "com/" + "b/" * 9000, 2), (5, "no scheme", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, score int").withColumns({c: F.lit("x") for c in ("host", "path", "suffix", "y", "rule", "id", "depth", "__n")})
    labelled = spark.createDataFrame([("http://example.com/a", 1), ("http://www.example.com/b", 1), (None, 1), ("http://x.org", None)], "url string, y int")
    for given, verdict in ((labelled, "block"), (labelled.withColumn("y", F.lit(0)), "allow"), (labelled.limit(0), "allow")):
        got = url_filter.judge(pages, given, [("allow", "com/never/")]).collect()
        assert len(got) == len(rows) and {r["verdict"] for r in got} == {verdict}
        assert {r["host"] for r in got if r["page_id"] in (1, 2, 5)} == {""}
    suffixes = spark.createDataFrame([("example.com",), ("www.example.com",), ("a.b.example.com",), ("com",), ("",)], "host string").select(url_filter.suffix_of(F.col("host"))).collect()
    assert [r[0] for r in suffixes] == ["example.com", "www.example.com", "b.example.com", "com", ""]


def test_empty_tables(spark, none):
    assert exact_dedup.exact_dedup(none).count() == 0
    assert sentencepiece_codec.digests(none, PIECE).count() == 0
    assert sharding.interleave(none).count() == 0
    assert packing.pack(none, BYTE).count() == 0
    assert token_counts.count_tokens(none, WORD).count() == 0
    assert none.select(F.lit(1)).count() == 0
