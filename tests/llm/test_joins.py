"""Joins, archives, ledgers and filters against brute force and on edge cases."""

import gzip
import hashlib
import io
import itertools
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.llm import decontam, embed, registry, token_counts, urlfilter, warc
from lodestream.llm.components import components
from lodestream.llm.ngram_join import ngram_components
from lodestream.llm.store import new_path
from lodestream.session import table

SF = "/root/testdata/sf0.001"


def union(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) >= 5:
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return frozenset([tuple(words)] if words else [])


def brute(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingle_set(t))
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(sets.items(), 2) if any(s and r and 100 * len(s & r) >= 80 * len(s | r) for s in x for r in y)]
    return union(sets, links)


def near_copies(seed=3, n=40):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(4)]
    rows = []
    for k in range(n):
        words = list(base[k % 4])
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"z{rng.randrange(9999)}"
        rows.append((k, " ".join(words)))
    return rows + [(100, None), (101, ""), (102, " \n"), (103, "One Two"), (104, "one two"), (105, rows[0][1].upper()), (106, rows[0][1])]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(200 + i, 201 + i) for i in range(30)] + [(300, 300 + i) for i in range(1, 40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = union({x for p in pairs for x in p}, pairs)
    assert got == {n: want[n] for n in got} and {x for a, b in pairs if a != b for x in (a, b)} == set(got)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_ngram_join(spark):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("k", F.lit(1)).withColumn("g", F.lit(2))
    got = {r.doc_id: r for r in ngram_components(df).collect()}
    want = brute(rows)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_shingles == len(shingle_set(t)) for i, t in rows)


def test_ngram_join_repeats_and_nulls(spark):
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(5, text), (5, text), (None, text), (9, text + " b"), (7, "q w e r t y"), (9, "q w e r t y")]
    got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (5, 5), (5, 5), (7, 5), (9, 5), (9, 5)]
    assert ngram_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(name, spark):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = registry.queries()[name](spark, SF)
    asked = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in asked.description]
    want = [tuple(dict(zip(columns, r, strict=True))[c] for c in df.columns) for r in asked.fetchall()]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


def test_decontamination(spark):
    ask = "In total Anna bought 12 apples and 5 pears for 20 dollars, then Bob gave Anna 12 more apples today."
    other = ask.replace("Anna", "Maria").replace("12", "31").replace("Bob", "Tom")
    docs = [(1, "x y. " + ask), (2, other.upper().lower()), (3, "Yes. " + other), (4, other.replace("gave Maria", "gave Karl")), (5, None), (6, ""), (None, ask), (7, "nothing of that kind here at all, sorry"), (1, "x y. " + ask), (8, "Alpha beta gamma delta epsilon zeta!")]
    bench = [(9, ask), (10, None), (11, ""), (None, ask), (12, "one two"), (13, "alpha, beta gamma delta epsilon zeta")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("item_id", F.lit(3))
    b = spark.createDataFrame(bench, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated_pairs(d, b).collect()}
    assert got[1, 9].contaminated and got[1, 9].exact and got[3, 9].contaminated and not got[3, 9].exact
    assert not got[4, 9].consistent and not got[4, 9].contaminated and got[8, 13].contaminated and not any(i in (5, 6, 7) for i, _ in got)
    left = decontam.remove_contaminated(d, b)
    assert {r.doc_id for r in left.collect()} >= {4, 5, 6, 7, None} and left.columns == d.columns
    assert decontam.contaminated_pairs(d.limit(0), b).count() == 0 and decontam.contaminated_pairs(d, b.limit(0)).count() == 0


def test_decontamination_judges_every_alignment(spark):
    ask = "In total Anna bought 12 apples and 5 pears for 20 dollars, then Bob gave Anna 12 more apples today."
    good = ask.replace("Anna", "Maria").replace("12", "31").replace("Bob", "Tom")
    bad = good.replace("gave Maria", "gave Karl")
    items = [(1, ask), (2, "What is 12 + 30 - 4 * 2?"), (3, "Why not?"), (4, "The Big Red Dog Sat On The Old Log By Our House.")]
    long = [f"w{chr(97 + k // 5)}{chr(97 + k % 5)}" for k in range(30)]
    items.append((5, " ".join(long)))
    split = " ".join([*long[:10], "put", "in", *long[10:20], "once", "more", *long[20:]])  # no alignment holds half of it
    docs = [
        (10, f"Yes. {bad} Well. {good}"), (11, f"Yes. {good} Well. {bad}"), (12, f"Yes. {bad}"), (13, ask.lower()), (14, ask.replace("by", "by\n").replace(" gave", "\ngave")),
        (15, "he asked: what is 12 + 30 - 4 * 2?"), (16, "why not"), (17, "why not go there then"), (18, "the big red dog sat on the old log by our house"), (19, split), (20, "x"), (20, f"Yes. {good}"),
        (21, "word " * 50_000 + ask), (22, bad), (22, "other text entirely of no interest to anyone who reads it"),
    ]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    pairs = decontam.contaminated_pairs(d, b).collect()
    assert len({(r.doc_id, r.item_id) for r in pairs}) == len(pairs)
    caught = {(r.doc_id, r.item_id) for r in pairs if r.contaminated}
    assert caught == {(10, 1), (11, 1), (13, 1), (14, 1), (15, 2), (16, 3), (18, 4), (19, 5), (20, 1), (21, 1)}
    clean = {(r.doc_id, r.item_id): r for r in pairs if not r.contaminated}
    assert not clean[12, 1].consistent and clean[12, 1].same_words * 2 >= clean[12, 1].item_words and (22, 1) in clean
    assert {r.doc_id for r in decontam.remove_contaminated(d, b).collect()} == {12, 17, 22}


def test_warc(spark):
    rows = [(1, "http://a", "abc"), (2, "http://b\r\nX: 1", "abc"), (3, None, None), (4, "c", ""), (5, "d", "é" * 300_000), (None, "z", "abc"), (2, "q", "abc"), (6, "e", "\r\n\r\nWARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    manifest = warc.write_archives(pages, new_path(spark, "warc-test"))
    read = warc.read_archives(manifest, payloads=True).collect()
    assert len(read) == len(rows)
    for r in read:
        want = [h or "" for i, _, h in rows if i == r.page_id]
        assert r.payload_bytes in [len(h.encode()) for h in want] and (r.record_type == "revisit") == (r.payload is None)
        assert r.payload_digest in [warc.digest(h.encode()) for h in want]
        if r.payload is not None:
            assert r.payload.decode() in want
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in read if r.payload_bytes == 3) == [(0, "revisit", 2), (1, "revisit", 2), (2, "response", None), (2, "response", None)]
    assert {(r.page_id, r.refers_to) for r in read if r.payload_bytes == 0} == {(3, 4), (4, None)}
    read = warc.read_archives(spark.createDataFrame([(f"{k}",) for k in range(9)], "path string"))
    assert read.rdd.getNumPartitions() == 9  # an archive is a task
    assert warc.round_trip(pages.limit(0)).count() == 0 and sum(r.records for r in manifest.collect()) == len(rows)


def test_warc_framing():
    good = warc.record(1, "u", b"payload", None, False) + warc.record(2, "v", b"payload", 1, True)
    assert gzip.decompress(good).count(b"WARC/1.1") == 2
    assert [f["warc-type"] for f, _, _ in warc.records(io.BytesIO(good))] == ["response", "revisit"]
    bad = gzip.compress(gzip.decompress(warc.record(1, "u", b"payload", None, False)).replace(b"payload", b"pAyload"))
    with pytest.raises(ValueError, match="digest"):
        list(warc.records(io.BytesIO(bad)))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(good[:-20])))


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16))
    x[200:260] = x[0] + rng.normal(scale=0.05, size=(60, 16))
    x[260:300] = x[100:140] + rng.normal(scale=0.08, size=(40, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0]), (None, x[0].tolist()), (904, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("id", F.lit(1))
    got = {r.vec_id: r for r in embed.near_duplicates(df, k=6, audit=64).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    g = u @ u.T >= 0.9
    np.fill_diagonal(g, False)
    want = union(range(300), zip(*np.nonzero(g), strict=True))
    linked = [i for i in range(300) if got[i].n_links == g[i].sum() and got[i].component_id == want[i]]
    assert len(linked) >= 297 and all(got[i].n_links <= g[i].sum() for i in range(300))
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (900, 901, 902, 903, 904)) and got[None].component_id is None
    assert embed.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_saturated_groups(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(260, 16))
    a = x[0] / np.linalg.norm(x[0])
    b = x[1] - (x[1] @ a) * a
    b = 0.93 * a + (1 - 0.93**2) ** 0.5 * b / np.linalg.norm(b)
    x[100:140] = a + rng.normal(scale=1e-7, size=(40, 16))  # unequal copies fill each other's lists
    x[140:180] = b + rng.normal(scale=1e-7, size=(40, 16))
    c = x[2] / np.linalg.norm(x[2])
    d = x[3] - (x[3] @ c) * c
    x[180:220], x[220:260] = c, 0.95 * c + (1 - 0.95**2) ** 0.5 * d / np.linalg.norm(d)  # equal copies
    rows = [(i, v.tolist()) for i, v in enumerate(x[4:], 4)] + [(1168, rng.normal(size=16).tolist())]  # by its hash the one audit query
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embed.near_duplicates(df, k=6, audit=1).collect()}
    assert {(got[i].component_id, got[i].n_links) for i in range(100, 180)} == {(100, 79)}
    assert {(got[i].component_id, got[i].n_links) for i in range(180, 260)} == {(180, 79)}
    assert sum(r.kept for r in got.values()) == 99


def test_embeddings_of_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [-1.0, 0.0]), (4, [-1.0, 0.0]), (5, [-2.0, 0.1]), (9, [0.0, -3.0])]
    got = embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [
        (1, 2, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (4, 1, 4, True), (5, 1, 4, False), (9, 0, 9, True)
    ]


def test_embeddings_audit(spark):
    x = np.random.default_rng(6).normal(size=(300, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert [r.recall for r in embed.near_duplicates(df, audit=1).select("recall").distinct().collect()] == [None]  # no link to judge by
    truth = spark.createDataFrame([(1, b, 1.0) for b in range(2, 102)] + [(200, 201, 0.95)], "a long, b long, cos double")
    member = spark.createDataFrame([(b, 1) for b in range(1, 102)], "node long, component long")
    assert embed._recall(truth, member) == 0.0 and embed._recall(truth.where("a = 1"), member) == 1.0
    assert embed._bits(51_282) == 14 and embed._bits(3_000_000) == 20


def test_token_ledger(spark):
    rows = [(1, "s", "en", "a b c"), (2, "s", "en", "a b c"), (3, "t", None, "x y\nx y"), (4, None, "de", None), (5, "t", "de", ""), (None, "s", "en", "q"), (3, "t", None, "x y\nx y")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").withColumn("tokens", F.lit(9)).withColumn("docs", F.lit(9))
    got = {(r.source, r.lang): (r.docs, r.tokens) for r in token_counts.corpus_totals(docs).where("tokenizer = 'words'").collect()}
    assert got == {("s", "en"): (2, 4), ("t", None): (2, 4), (None, "de"): (1, 0), ("t", "de"): (1, 0)}
    ledger = token_counts.TokenLedger(spark, new_path(spark, "ledger-test"))
    counted = token_counts.count(docs)
    assert ledger.commit("a", upserts=counted) and not ledger.commit("a", upserts=counted)
    before = sorted(map(str, ledger.totals().collect()))
    assert ledger.commit("b", upserts=counted.where("doc_id IS NOT NULL")) and sorted(map(str, ledger.totals().collect())) == before
    ledger.commit("c", deletes=spark.createDataFrame([(1,), (1,), (77,), (None,)], "doc_id long"))
    assert {(r.source, r.lang): r.docs for r in ledger.totals().where("tokenizer = 'words'").collect()}["s", "en"] == 2
    ledger.commit("d")
    assert ledger.committed() == ["a", "b", "c", "d"]
    before = [sorted(map(str, x.collect())) for x in (ledger.totals(), ledger.rows())]
    ledger.compact()
    assert [sorted(map(str, x.collect())) for x in (ledger.totals(), ledger.rows())] == before and len(ledger._parts()) == 1
    assert not ledger.commit("a", upserts=counted) and ledger.commit("e", deletes=spark.createDataFrame([(2,)], "doc_id long"))
    assert {(r.source, r.lang): r.docs for r in ledger.totals().where("tokenizer = 'words'").collect()}["s", "en"] == 1 and len(ledger._parts()) == 2
    assert token_counts.corpus_totals(docs.limit(0)).count() == 0


def test_corpus_totals_equal_brute_force(spark):
    docs = table(spark, SF, "documents")
    encoding = token_counts._encoding(token_counts.default_ranks())
    kept = {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        kept.setdefault(r.text, r)  # copies of a text: the smallest id stays
    want = {}
    for r in kept.values():
        text = "\n".join(dict.fromkeys(r.text.split("\n")))
        for name, n in (("words", len(text.split())), ("byte_bpe_50k", len(encoding.encode_ordinary(text)))):
            docs_, tokens = want.get((r.source, r.lang, name), (0, 0))
            want[r.source, r.lang, name] = docs_ + 1, tokens + n
    assert {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in token_counts.corpus_totals(docs).collect()} == want


def test_token_counts_equal_the_library(spark):
    docs = table(spark, SF, "documents").limit(20)
    encoding = token_counts._encoding(token_counts.default_ranks())
    want = {r.doc_id: len(encoding.encode_ordinary(r.text)) for r in docs.collect()}
    assert {r.doc_id: r.tokens for r in token_counts.count(docs).where("tokenizer <> 'words'").collect()} == want


def test_urls(spark):
    rows = [(1, "http://Foo.NET/x"), (2, "nothing"), (3, None), (4, "https://a.example.net/en/1"), (5, "http://notnet/x"), (6, "http://www.example.com/de/x?y"), (7, "x://fr.org/fr/"), (8, "http://x.net"), (9, "http://a.b/login?x"), (9, "http://a.b/login?x"), (10, "http://a.b/login/help"), (11, "")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("token", F.lit(0))
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df).collect())
    assert [g[3:] for g in got] == [("net/", "block"), (None, "allow"), (None, "allow"), ("example.net/en/", "allow"), (None, "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "allow"), (None, "block"), (None, "block"), (None, "allow"), (None, "allow")]
    assert got[0][1:3] == ("foo.net", "/x") and urlfilter.judge(df.limit(0)).count() == 0
    rules = spark.createDataFrame([("net/", "block", 0), ("*", "allow", 1), ("^q^", "block", 1), ("*b*", "block", 1), (None, "block", 0), ("net/", "block", 0)], "pattern string, verdict string, tier int")
    said = {r.page_id: (r.pattern, r.verdict) for r in urlfilter.judge(df, rules).collect()}
    assert said[1] == ("net/", "block") and said[5] == ("*", "allow") and said[9] == ("*b*", "block") and said[3] == (None, "allow")
    few, urlfilter.INDEX_ROWS = urlfilter.INDEX_ROWS, 0
    hot, urlfilter.HOT = urlfilter.HOT, 2
    try:
        assert {r.page_id: (r.pattern, r.verdict) for r in urlfilter.judge(df, rules).collect()} == said
    finally:
        urlfilter.INDEX_ROWS, urlfilter.HOT = few, hot
    loose = [urlfilter.Rule("*evil*", "block"), urlfilter.Rule("good/", "allow")]
    assert urlfilter.judge(spark.createDataFrame([(1, "http://medEvil.org/"), (2, "http://medevil.org/")], "page_id long, url string"), loose).where("verdict = 'block'").count() == 2


def test_rule_tokens_are_whole():
    tokens = lambda pattern: urlfilter.Rule(pattern, "block").tokens()
    assert tokens("example.net/en/") == ["example", "net", "en"] and tokens("example.net/en") == ["example", "net"]
    assert tokens("/ads/*") == ["ads"] and tokens("*track*") == [] and tokens("ads^") == []


ODD = [(1, None, "en", "s", 0), (2, "", None, "s", 0), (None, "a null id keeps its text", "en", None, None), (3, "word " * 200_000, "en", "s", 1), (4, "one two three four five six", "de", "t", 2), (4, "one two three four five six", "de", "t", 2), (5, "One two three four five SIX", "de", "t", 2)]


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline

    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").withColumn("hub", F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES:
        got, none = stage(spark, docs, SF), stage(spark, docs.limit(0), SF)
        assert none.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got.columns == docs.columns
        ids = sorted((r.doc_id or 0) for r in got.collect())
        if name == "n-gram Jaccard join":  # all rows of the smallest id of a group stay, rows without an id or words too
            assert ids == [0, 1, 2, 3, 4, 4]
        elif name != "quality classifier":
            assert ids == [0, 1, 2, 3, 4, 4, 5]


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    kept = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, kept = kept, stage(spark, kept, SF).cache()
        if k + 1 < len(corpus_pipeline.STAGES):
            assert kept.columns == docs.columns
        assert kept.count() <= before.count()
        if k == 1:
            want = brute([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id for r in kept.collect()} == set(want.values())
        if k == 3:
            assert kept.count() == before.count() and not any(re.search("token = \"[0-9a-f]{40}", r.text) for r in kept.collect())
    assert all(r.round_trip for r in kept.collect())
    assert hashlib.sha256(str(sorted(r.doc_id for r in kept.collect())).encode()).hexdigest() == hashlib.sha256(str(sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect())).encode()).hexdigest()
