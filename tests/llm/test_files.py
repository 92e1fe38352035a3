"""Whitening, token files and spelling variants against brute force."""

import itertools
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestream.llm import registry, spelling, tokenfile, whiten
from lodestream.session import table


@pytest.fixture(scope="module")
def encoder():
    return tokenfile.Encoder(tokenfile.default_tokenizer(), most=50)


# --- whitening ----------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 150])
def test_spectrum_slices(n):
    a = np.random.default_rng(n).standard_normal((n, n))
    v = a @ a.T
    e, x, certified = whiten.leading(v, 8)
    want = np.linalg.eigvalsh(v)[::-1][:8]
    assert np.allclose(e, want, rtol=1e-10, atol=1e-12 * want[0]) and all(certified)
    assert np.abs(v @ x - x * e).max() < 1e-12 * want[0] and np.abs(x.T @ x - np.eye(len(e))).max() < 1e-12


@pytest.mark.parametrize("values", [[5, 5, 5, 4, 4, 3, 3, 3, 2], [1] * 12, [7] + [0] * 11, [3, 3 - 1e-9, 3 - 2e-9] + [1] * 9, [0] * 5])
def test_ties_and_missing_dimensions(values):
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((len(values), len(values))))[0]
    v = (q * np.array(values, float)) @ q.T
    e, x, certified = whiten.leading((v + v.T) / 2, 8)
    assert np.allclose(e, sorted(values, reverse=True)[: len(e)], atol=1e-12) and all(certified)
    assert np.allclose(x.T @ x, np.eye(len(e)), atol=1e-12)


@given(st.integers(1, 12), st.integers(0, 999), st.floats(-3, 3))
@settings(max_examples=80, deadline=None)
def test_inertia_counts_signs(n, seed, shift):
    a = np.random.default_rng(seed).standard_normal((n, n)).round(1)
    a = a + a.T
    signs = np.linalg.eigvalsh(a - shift * np.eye(n))
    if np.abs(signs).min() > 1e-9:
        assert whiten.above(a, shift) == (signs > 0).sum()
    assert sum(whiten.inertia(a)) == n


def test_limbs_add_up():
    y = np.array([[0, 1, -1], [1 << 45, -(1 << 60), (1 << 19) - 1], [-(1 << 19), 1 << 19, 12345678901234]])
    assert (sum((p.astype(np.int64).astype(object) << (whiten.LIMB * k)) for k, p in enumerate(whiten.limbs(y))) == y.astype(object)).all()


def brute_whitening(vectors):
    """Numbers, deviations, and components with their eigenvalues, of a list of (id, vector)."""
    x = np.array([[int(np.floor(1024 * float(c))) + 100000 for c in v] for _, v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    y = (x - np.array([s / n for s in sums])).astype(float)
    e, q = np.linalg.eigh(y.T @ y / n)
    return n, deviation, y, e[::-1], q[:, ::-1]


def check_whitening(got, vectors, k=8):
    n, deviation, y, e, q = brute_whitening(vectors)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation_exact), {}).setdefault(r.component, []).append(r)
    rows = sum(len(v) for r in by.values() for v in r.values())
    k = min(k, int((e > 1e-10 * e.sum()).sum()))
    assert rows == n * k
    for j in range(k):
        want = y @ q[:, j] / np.sqrt(e[j])
        mine = np.array([by[i, d][j + 1][0].whitened for (i, _), d in zip(vectors, deviation, strict=True)])
        if (j == 0 or e[j - 1] - e[j] > 1e-6 * e[0]) and (j + 1 == len(e) or e[j] - e[j + 1] > 1e-6 * e[0]):
            assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-7
    for r in got:
        assert r.n == n and abs(r.explained - e[r.component - 1] / e.sum()) < 1e-9 and r.identity_error < 1e-9 and r.certified
        assert r.deviation == (r.deviation_exact if r.deviation_exact < 1 << 63 else None)


def test_whitening_query(spark, sf):
    got = registry.op11_embedding_whitening(spark, sf).collect()
    check_whitening(got, [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()])


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(int(i % 37), [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((120, 5)).astype(np.float32) * [1, 2, 1000, 5, 0])]
    odd = [(1, None), (2, [1.0, None, 1.0, 1.0, 1.0]), (3, [float("nan")] * 5), (4, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (5, [1e30] * 5), (6, []), (7, [1.0, 2.0]), (None, [0.5] * 5)]
    df = spark.createDataFrame([(i, v, "x") for i, v in good + odd], "vec_id long, embedding array<double>, n string").repartition(5)
    check_whitening(whiten.whitened(df).collect(), good + [odd[-1]])
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, [(1, None)]):
        none = whiten.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        assert none.count() == 0 and "identity_error" in none.columns
    far = [(k, [float(k) * 2**38, float(k * k)]) for k in range(6)]
    got = whiten.whitened(spark.createDataFrame(far, "vec_id long, embedding array<double>")).collect()
    assert {int(r.deviation_exact) for r in got} == set(brute_whitening(far)[1]) and any(r.deviation is None for r in got)


# --- token files --------------------------------------------------------------------------------


@given(st.lists(st.text(st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from(" \n\t'’“€日é<|>\x85\xa0 ")), max_size=40), max_size=4))
@settings(max_examples=300, deadline=None)
def test_pieces_encode_as_the_library(encoder, texts):
    texts = [*texts, "it's <|endoftext|> ''s we'll  \n x", ""]
    for text, data in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(data, f"<u{encoder.width}").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


AWKWARD = [*" \n\t\x85\xa0\x1c''stmdlverea1²!’€éſɏ", " ", "'s", "'ll", " '", "x'"]


@given(st.lists(st.lists(st.sampled_from(AWKWARD), max_size=14).map("".join), max_size=6))
@settings(max_examples=500, deadline=None)
def test_pieces_are_the_librarys(encoder, texts):
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    bounds = tokenfile.cut(data, offsets, np.zeros(len(raw), bool), tokenfile.kinds_of(data)).tolist()
    want = {len(data)}
    for t, at in zip(texts, offsets.tolist(), strict=False):
        want |= {at + len(t[:a].encode()) for _, (a, _) in encoder.tokenizer.pre_tokenizer.pre_tokenize_str(t)}
    assert bounds == sorted(want)


class Counted:
    """Passes calls on and notes what was given."""

    def __init__(self, inner):
        self.inner, self.given = inner, []

    def encode_batch_fast(self, texts, **kwargs):
        self.given += texts
        return self.inner.encode_batch_fast(texts, **kwargs)

    def tokenize(self, piece):
        self.given.append(piece)
        return self.inner.tokenize(piece)


def test_new_pieces_go_to_the_model_alone_and_once():
    one = tokenfile.Encoder(tokenfile.default_tokenizer(), most=4)
    one.tokenizer, one.model = Counted(one.tokenizer), Counted(one.model)
    one.encode(["alpha beta alpha", "beta 日", "", "alpha beta", "beta 日"])
    assert one.tokenizer.given == ["beta 日"]  # odd texts only: the whole library costs several times the model
    assert sorted(one.model.given) == ["alpha", "Ġalpha", "Ġbeta"]
    one.encode(["beta alpha beta", "c d e"])
    one.encode([" beta"])  # from the older generation
    assert sorted(one.model.given[3:]) == ["beta", "c", "Ġd", "Ġe"]


@given(st.sets(st.tuples(st.integers(-(1 << 63), (1 << 63) - 1), st.integers(0, 1 << 40)), min_size=0, max_size=300), st.integers(0, 9))
@settings(max_examples=60, deadline=None)
def test_perfect_hash(keys, extra):
    ids = np.array([k[0] for k in keys], np.int64).view(np.uint64)
    nth = np.array([k[1] for k in keys], np.uint64)
    number = np.arange(len(keys))
    file = tokenfile.IndexFile.load(tokenfile.IndexFile.build(ids, nth, number, number * 3, number * 5, number + 1).dump())
    assert sorted(file.hash.slots(ids, nth)) == list(range(len(keys)))  # minimal and without collisions
    there, slots = file.find(ids, nth)
    assert there.all() and (slots["start"] == number * 5).all() and (slots["length"] == number + 1).all()
    absent = np.arange(1, 200, dtype=np.uint64)
    absent = absent[~np.isin(absent, ids)]
    assert not file.find(absent, np.full(len(absent), 77 + extra, np.uint64))[0].any()


def test_repeated_keys_do_not_build():
    with pytest.raises(ValueError):
        tokenfile.PerfectHash.build(np.array([3, 3], np.uint64), np.array([1, 1], np.uint64))


def test_token_ids_query(spark, sf, encoder):
    got = sorted(map(tuple, registry.op12_token_ids(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    want, start = [], 0
    for doc_id, text in sorted((r.doc_id, r.text) for r in table(spark, sf, "documents").collect()):
        ids = encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


@pytest.mark.parametrize("shards", [1, 9])
def test_token_files_odd_rows(spark, tmp_path, encoder, shards):
    rows = [(None, "a b", 1), (None, "c", 2), (3, None, 3), (3, "x", 4), (3, "", 5), (1, "é <|endoftext|> z", 6), (5, "日本 x", 7), (-4, "x " * 300_000, 8)]
    rows += [(7, "same", 9)] * 400 + [(8, f"t{k}", k) for k in range(60)] + [(7, "other", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long")
    files = tokenfile.TokenFiles.write(docs, f"{tmp_path}/f", shards=shards, bucket_keys=50)
    got = sorted(files.read(ids=True).collect(), key=lambda r: r.start)
    assert len({(r.doc_id, r.nth) for r in got}) == len(got) == len(rows)
    at = 0
    for r in got:
        assert r.start == at and len(r.ids) == r.n_tokens and r.ids[-1] == 2 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        at += r.n_tokens
    assert [r.doc_id for r in got] == [None, None, *sorted(r[0] for r in rows if r[0] is not None)]
    want = Counter((i, tuple(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [2])) for i, t, _ in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    asked = spark.createDataFrame([(7, 400), (7, 401), (99, 0), (None, 1), (None, 2)], "doc_id long, nth long")
    assert {(r.doc_id, r.nth) for r in files.read(asked).collect()} == {(7, 400), (None, 1)}
    assert tokenfile.round_trip(docs.limit(0)).count() == 0


def test_a_cut_shard_is_noticed(spark, tmp_path):
    files = tokenfile.TokenFiles.write(spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id long, text string"), f"{tmp_path}/f", shards=1)
    path = files.places.first()["path"].removeprefix("file://")
    os.truncate(path, os.path.getsize(path) - 1)
    with pytest.raises(Exception, match="cut short|multiple of element"):
        files.read().collect()


# --- spelling variants --------------------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_near(words):
    out = {}
    for a, b in itertools.combinations(sorted(words), 2):
        if one_edit(a, b):
            out.setdefault(a, []).append(b)
            out.setdefault(b, []).append(a)
    return {w: (len(o), *min((-words[x], x) for x in o)) for w, o in out.items()}


def made_words(seed, letters, count, low=7, high=12):
    rng = np.random.default_rng(seed)
    words = {"".join(rng.choice(list(letters), rng.integers(low, high))) for _ in range(count)}
    for w in sorted(words)[: count // 2]:
        at = int(rng.integers(0, len(w)))
        words |= {w[:at] + w[at + 1 :], w[:at] + str(rng.choice(list(letters))) + w[at:], w[:at] + str(rng.choice(list(letters))) + w[at + 1 :]}
    return {w: int(rng.integers(2, 400)) for w in sorted(words) if len(w) >= low}


@pytest.mark.parametrize(("seed", "letters", "count", "hot"), [(1, "ab", 400, 4096), (1, "ab", 400, 20), (2, "abcéÿ", 900, 4096), (3, "abcdefgh", 900, 8), (4, "a", 5, 2)])
def test_near_words(spark, seed, letters, count, hot):
    words = made_words(seed, letters, count)
    df = spark.createDataFrame(sorted(words.items()), "word string, n long").repartition(4)
    got = {r.word: (r.n_near, -r.best_n, r.best) for r in spelling.near_counts(df, hot=hot).collect()}
    assert got == brute_near(words)


@given(st.text("abc", min_size=7, max_size=11), st.text("abc", min_size=7, max_size=11))
@settings(max_examples=300, deadline=None)
def test_tile_finds_single_edits(a, b):
    one, other = spelling.code_points([a, b]), spelling.code_points([b])
    assert spelling.compare(one, other)[0][:, 0].tolist() == [one_edit(a, b), False]
    m = min(len(a), len(b))
    prefix = spelling.compare(one, other)[1][0, 0]
    assert sum(low <= prefix < high for _, _, low, high in spelling._kinds(m)) == 1


def test_spelling_odd_rows(spark):
    texts = [(1, "Overcast overcast,OVERCAST overcäst naïveté Überfluß"), (2, None), (3, ""), (None, "overcast overcast naïveté"), (4, "covercast covercast " + "overcast " * 30), (4, "x" * 50_000 + " " + "x" * 50_000)]
    texts += [(k, "marvellous marvelous naïveté") for k in range(40)]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, n int")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    want = con.execute(spelling.oracle()).fetchall()
    got = [tuple(r) for r in spelling.variants(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    known = {r[0]: r for r in got}
    assert known["covercast"][1:3] == ("overcast", "overcast") and known["naïveté"][3] > 30
    assert spelling.variants(df.limit(0)).count() == 0


def test_roots_follow_chains(spark):
    links = [(f"w{k}", f"w{k + 1}") for k in range(9)] + [("x", "w9"), ("y", "z")]
    got = dict(map(tuple, spelling.roots(spark.createDataFrame(links, "word string, form string")).collect()))
    assert got == {**{f"w{k}": "w9" for k in range(9)}, "x": "w9", "y": "z"}


def test_spelling_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(registry.oracle_sql()["op13_spelling_variants"]).fetchall()
    assert sorted(map(tuple, registry.op13_spelling_variants(spark, sf).collect()), key=str) == sorted(want, key=str)
