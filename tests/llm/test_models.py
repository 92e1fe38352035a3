"""Classifiers, the character network and the encoder: held-out accuracy, round trips, edge cases."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.llm import pieces, quality, secrets, textbatch, toxicity
from lodestream.session import table

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "a" * 200_000), (6, "x y " * 40_000), (None, "text"), (4, "word"), (7, "漢字 ▁ é")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("n", F.lit(1))


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_toxicity_on_held_out_texts(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    known = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    said = {r.doc_id: r.predicted for r in toxicity.score_toxicity(known, toxicity.train(docs, labels)).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect() if held(r.doc_id)}
    hit = sum(said[i] and t for i, t in truth.items())
    assert hit / sum(truth.values()) >= 0.6 and hit / sum(said[i] for i in truth) >= 0.98


def test_kernel_is_that_of_enumerated_subsequences():
    def features(word):
        out = {}
        for i, j, k in itertools.combinations(range(len(word)), 3):
            if k - i < toxicity.SPAN:
                key = tuple(word[x] for x in (i, j, k))
                out[key] = out.get(key, 0.0) + toxicity.DECAY ** (k - i + 1)
        return out

    rng = np.random.default_rng(2)
    words = [bytes([0, *rng.integers(1, 5, n)]) for n in (3, 5, 8, 12, 20)]
    rows = toxicity._dense(words)
    norm = [toxicity._NORM[len(w)] for w in words]
    for a, u in enumerate(words):
        for b, v in enumerate(words):
            fu, fv = features(u), features(v)
            want = sum(x * fv.get(t, 0.0) for t, x in fu.items()) / norm[a] / norm[b]
            assert rows[a] @ rows[b] == pytest.approx(want) and toxicity._kernel([u], rows[[b]])[0, 0] == pytest.approx(want)
    # Landmarks folded into one table of triples give the same sum in one pass over a text's letters.
    weights = rng.normal(size=len(words))
    table_of = (rows.T @ weights).astype(np.float64)
    text = "abc abdcc x y z dacbdacbdacbabcabc".encode()
    machine = toxicity.Machine(table_of, 0.25, 1.0, 0.0, -9.0)
    units = toxicity._units(text.decode())
    assert len(units) == 4  # three single letters are one word
    assert machine.margins(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0] == pytest.approx(max(toxicity._kernel([u], rows)[0] @ weights + 0.25 for u in units))
    long = "".join("abcd"[i] for i in rng.integers(0, 4, 100)).encode()
    assert machine.margins(np.frombuffer(long, np.uint8), np.array([0, 100]))[0] == pytest.approx(max(toxicity._kernel([u], rows)[0] @ weights + 0.25 for u in toxicity._units(long.decode())))


@pytest.mark.parametrize("module,label,threshold,least", [(quality, "quality", 0.3, 0.9), (toxicity, "toxic", 0.5, 0.85)])
def test_classifiers(spark, odd, module, label, threshold, least):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = module.train(docs, labels)
    score = quality.score_quality if module is quality else toxicity.score_toxicity
    rows = {r.doc_id: r for r in score(docs, model).collect()}
    assert len(rows) == docs.count()
    truth = {r.doc_id: r[label] for r in labels.collect()}
    for r in rows.values():
        assert r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
    out = [i for i in truth if held(i)]
    assert np.mean([rows[i].predicted == truth[i] for i in out]) >= least
    got = score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert score(odd.limit(0), model).count() == 0
    blank = module.train(docs, labels.limit(0))
    assert len({r.score for r in score(odd, blank).collect()}) == 1


def test_interactions_are_the_identity():
    rng = np.random.default_rng(0)
    width = quality.BUCKETS + quality.N_STRUCTURE
    fm = quality.FactorisationMachine(0.1, rng.normal(size=width), rng.normal(size=(width, 3)), np.zeros(quality.N_STRUCTURE), np.ones(quality.N_STRUCTURE))
    text = "Some words, some of them twice: words.\n\nA line | of # marks".encode()
    f = quality.features(np.frombuffer(text * 2, np.uint8), np.array([0, 0, len(text), 2 * len(text)]))
    assert fm.margin_of(f) == pytest.approx(fm.margin(fm.prepare(f.dense())), rel=1e-5)
    x = np.zeros((1, width))
    at = rng.choice(width, 6, replace=False)
    x[0, at] = rng.normal(size=6)
    pairs = sum(fm.factors[i] @ fm.factors[j] * x[0, i] * x[0, j] for k, i in enumerate(at) for j in at[:k])
    assert fm.margin(x)[0] == pytest.approx(0.1 + x[0] @ fm.linear + pairs)


def test_disguised_insults():
    texts = ["the nice text of a day", "what a fine world of words"] * 40 + ["you are an idiot here", "such a moron there", "idiot of the day", "a moron it is"] * 20
    y = np.array([0.0] * 80 + [1.0] * 80)
    model = toxicity.fit(texts, y, np.ones(160))
    said = lambda t: model.score(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]
    assert all(said(t) > 0.5 for t in ("IDIOT", "id-iot", "i d i o t", "1diot", "m.o.r.o.n")) and said("a fine day") < 0.5


def test_word_hashes_do_not_depend_on_place():
    data = np.frombuffer("Abc abc  déf\nabc".encode(), np.uint8)
    starts, ends, first = textbatch.words(data, np.array([0, 4, len(data)]))
    hashes = textbatch.hash_words(data, starts, ends)
    assert len(starts) == 4 and first.tolist() == [0, 1, 4] and hashes[0] == hashes[1] == hashes[3] != hashes[2]


SAMPLES = ["", " ", "  two  spaces ", "Hello, world!", "a\tb\nc\r\n", "漢字かな", "naïve café ﬁ", "    indent", "http://x.y/z?q=1", "🙂 emoji", "a" * 5000]


def test_encoder_equals_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    vocabulary = pieces.Vocabulary.load(pieces.default_model())
    texts = SAMPLES + [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pieces.encode(df, vocabulary).collect()}
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(df, vocabulary), vocabulary).collect()}
    for k, text in enumerate(texts):
        assert rows[k].ids == library.encode(text) and rows[k].n_tokens == len(rows[k].ids)
        assert rows[k].round_trip and back[k] == text


def test_encoder_edges(spark, odd):
    rows = {r.doc_id: r for r in pieces.encode(odd, pieces.Vocabulary.load(pieces.default_model())).collect()}
    assert rows[1].ids == [] and rows[1].round_trip and rows[2].ids == [] and not rows[7].round_trip and rows[5].round_trip
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in pieces.decode(none, pieces.Vocabulary.load(pieces.default_model())).collect()} == {1: None, 2: ""}


def test_unigram_paths_have_the_best_score():
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(pieces.default_model(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    raw = proto.SerializeToString()
    library, encoder = SentencePieceProcessor(model_proto=raw), pieces.Encoder(pieces.Vocabulary.load(raw, pieces.UNIGRAM))
    total = lambda ids: sum(library.get_score(i) for i in ids)
    for text in ("the quick brown fox", "internationalisation of words", "abc def"):
        ids = np.frombuffer(encoder.encode([text])[0], np.int32).tolist()
        best = 0.0
        for word in text.split():
            marked, at = pieces.MARK + word, [0.0]
            for i in range(1, len(marked) + 1):  # every piece at every place
                at.append(max(at[j] + encoder.v.scores[encoder.v.ids[marked[j:i]]] for j in range(i) if marked[j:i] in encoder.v.ids))
            best += at[-1]
        assert total(ids) == pytest.approx(best) and best >= total(library.encode(text))


@pytest.fixture(scope="module")
def net():
    return secrets.train(1500, 4)


def test_secret_network(net):
    found, y = secrets.labelled_findings(600, 99)
    sure = net.probabilities(*secrets._encode(found)) >= net.threshold
    assert sure[y == 1].mean() >= 0.9 and sure[y == 0].mean() <= 0.05


def test_secret_gradients():
    net = secrets.CharCnn.fresh(1)
    found, y = secrets.labelled_findings(8, 4)
    codes, inside = secrets._encode(found)
    grad = net.step(codes, inside, y)[3]
    loss = lambda: float(np.mean(np.log1p(np.exp(-(2 * y - 1) * net.margins(codes, inside)))))
    for k in (0, 40, 90):
        net.out[k] += 1e-5
        up = loss()
        net.out[k] -= 2e-5
        down = loss()
        net.out[k] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(grad[k], abs=1e-6)


def test_secret_scan_equals_brute_force(spark, net):
    small = "/root/testdata/sf0.001"
    rows = table(spark, small, "documents").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in rows] + [(None, "password = hunter22 and token=abc"), (-1, None), (-1, "AKIA" + "Q" * 17), (-2, "é" * 9 + "ab" * 12 + "g")]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), net).collect()
    want = []
    for i, t in rows:
        t = t or ""
        found = [("assign", m.start(), m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
        found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 24]
        found.sort(key=lambda f: (f[1], ["assign", "access", "hex"].index(f[0])))
        count = [sum(f[0] == k for f in found) for k in ("assign", "access", "hex")]
        want.append((i, *count, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256)) for r in got)
    # The method's own spans are runs of token characters beside the base ones.
    texts = dict(rows)
    for r in got:
        for span in (s.split(":") for s in r.spans.split(",") if s.startswith("cnn")):
            assert re.fullmatch(r"[A-Za-z0-9+/_=-]{16,}", (texts[r.doc_id] or "")[int(span[1]) : int(span[2])])


def test_one_very_long_text_of_tokens(spark, net):
    text = "x" + "a1B2" * 100_000 + " " + "q9Z8w7X6" * 3
    row = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), net).first()
    assert row.n_cnn <= 2 and all(int(s.split(":")[2]) <= len(text) for s in row.spans.split(",") if s)


def test_secret_spans(spark, odd, net):
    key = "AKIA" + "ABCDEFGH12345678"
    text = f"é token = \"abcdef123\" {key} {'0a' * 13} password: abc AKIA12 secret=token=xyz"
    row = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), net).first()
    base = [s for s in row.spans.split(",") if not s.startswith("cnn")]
    assert (row.n_assign, row.n_access, row.n_hex) == (2, 1, 1)
    assert base[0] == f"assign:2:{2 + len('token = ') + 10}" and base[1] == f"access:{text.index(key)}:{text.index(key) + 20}"
    assert secrets.redact(spark.createDataFrame([(1, text, 5)], "doc_id long, text string, n_chars long"), net).first().text.count("[SECRET]") >= 4
    assert secrets.scan(odd, net).count() == len(ODD) and secrets.redact(odd, net).count() == len(ODD)
    assert secrets.scan(odd.limit(0), net).count() == 0


_FIT = """
import sys, zlib, numpy as np, duckdb
from lodestream.llm import toxicity
rows = duckdb.sql("SELECT d.doc_id, any_value(d.text), max(toxic) FROM '/root/testdata/sf0.01/documents.parquet' d JOIN '/root/testdata/sf0.01/labels.parquet' USING (doc_id) WHERE length(d.text) < 6000 GROUP BY 1 ORDER BY 1").fetchall()
y = np.array([r[2] for r in rows], float)
m = toxicity.fit([r[1] for r in rows], y, np.ones(len(y)))
print(zlib.crc32(m.table.tobytes()), m.bias, m.slope, m.offset)
"""


def test_toxicity_does_not_depend_on_hash_seeds():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    said = {subprocess.run([sys.executable, "-c", _FIT], cwd=root, env=os.environ | {"PYTHONHASHSEED": str(k)}, capture_output=True, text=True, check=True).stdout for k in range(3)}
    assert len(said) == 1


def test_repeated_ids_train_with_one_text(spark):
    from lodestream.llm.labelled import training_sample

    rows = [(k, f"text {j} of {k}") for k in range(40) for j in range(3)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    first = training_sample(docs.repartition(7), labels, "toxic", 50, 100)[0]
    assert first == training_sample(docs.orderBy(F.desc("text")), labels, "toxic", 50, 100)[0] and len(first) == len(set(first))
