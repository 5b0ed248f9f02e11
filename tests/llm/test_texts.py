import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
import tiktoken
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import ODD, SF, documents
from vibrata.llm import bpe, gru_lm, licenses, quality, queries, toxicity

import public_tokenizers

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.Tokenizer(*bpe.vocabulary(PATH), PATTERN)


def expected(encoder, text):
    ids = encoder.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_of_all_documents(spark, encoder):
    want = {r.doc_id: expected(encoder, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r[0]: tuple(r[1:4]) for r in queries.op7_byte_bpe(spark, SF).collect()} == want


@pytest.mark.parametrize("clashing", [False, True])
def test_bpe_of_odd_rows(spark, encoder, clashing):
    table = documents(spark, ODD, clashing)
    want = sorted((str(r[0]), *expected(encoder, r[1])) for r in ODD)
    assert sorted((str(r[0]), *r[1:]) for r in bpe.round_trip(table, PATH, PATTERN).collect()) == want
    encoded = bpe.encode(table.where("length(text) < 1000"), PATH, PATTERN)
    assert all(bytes(r.decoded) == r.text.encode() for r in bpe.decode(encoded, PATH, PATTERN).collect())
    assert bpe.round_trip(documents(spark, []), PATH, PATTERN).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="aeinrst .,'\n0́é漢", max_size=120))
def test_bpe_of_any_text(encoder, tokenizer, text):
    ids = tokenizer.encode(text)
    assert ids == encoder.encode_ordinary(text)
    assert tokenizer.decode(ids) == text.encode()


def auc(rows):
    good, bad = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / max(len(good) * len(bad), 1)


@pytest.mark.parametrize("name,label,cut,least", [("op2_toxicity", "toxic", 0.5, 0.9), ("op5_quality_classifier", "quality", 0.3, 0.9)])
def test_classifiers_on_held_out_rows(spark, name, label, cut, least):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.QUERIES[name](spark, sf).collect()}
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in list(got.values())[:500]:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert auc([(got[d].score, y) for d, y in labels.items() if y is not None and d in got and got[d].held_out]) > least


@pytest.mark.parametrize("train,score,label", [(toxicity.train, toxicity.score, "toxic"), (quality.train, quality.score, "quality")])
def test_classifiers_of_odd_rows(spark, train, score, label):
    table = documents(spark, ODD, True)
    scored = lambda model: (toxicity.score(table, model) if label == "toxic" else quality.score(table, model, ["doc_id"])).collect()
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert len(scored(train(table, empty))) == len(ODD)
    some = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (5, 1, 1), (6, None, None), (7, 3, 3), (None, 1, 1), (8, 0, 0), (10, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in scored(train(table, some)))


@pytest.mark.parametrize("train,label", [(toxicity.train, "toxic"), (quality.train, "quality")])
def test_classifiers_of_empty_and_clashing_tables(spark, train, label):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], f"doc_id long, {label} int")
    empty = documents(spark, [])
    model = train(empty, labels)
    assert (toxicity.score(empty, model) if label == "toxic" else quality.score(empty, model, ["doc_id"])).count() == 0
    table = documents(spark, [(i, "good old words here" if i % 2 else "bad new words there") for i in range(60)])
    if label == "quality":
        clash = table.withColumn("score", F.lit("a")).withColumn("text_read", F.lit("b")).withColumn("chars_read", F.lit("c")).drop("n_chars")
        kept = quality.accepted(clash, labels)
        rows = kept.collect()
        assert kept.columns == clash.columns and rows and all((r.score, r.text_read, r.chars_read) == ("a", "b", "c") for r in rows)
        assert {r.doc_id % 2 for r in rows} == {1}
        assert quality.accepted(clash, labels.limit(0)).count() == 60


def test_samples_are_bounded_in_rows_and_words(spark):
    from vibrata.llm.common import labelled_sample, within

    rows = [(i % 50, f"text {i} " * (1 + i % 7)) for i in range(400)]  # ids repeat eight times
    labels = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, toxic int")
    sample = labelled_sample(documents(spark, rows), labels, "toxic", 20, {"text": F.col("text")}).withColumn("n", F.length("text"))
    got = sample.collect()
    assert len(got) == 20
    kept = within(sample, "n", 100).collect()
    assert 0 < len(kept) < 20 and sum(r.n for r in kept) <= 100
    assert within(sample, "n", 0).count() == 0
    model = toxicity.train(documents(spark, rows), labels, most_words=10)
    assert toxicity.score(documents(spark, rows[:5]), model).count() == 5


def test_the_convolution_against_a_plain_loop():
    """Largest responses over all places of a text, padding included, computed word by word."""
    import numpy as np

    rng = np.random.default_rng(6)
    model = toxicity.ToxicityModel(rng.normal(size=(41, 3)), {w: rng.normal(size=(w, 3, 4)) for w in (1, 2, 3)}, {w: rng.normal(size=4) for w in (1, 2, 3)}, rng.normal(size=12), 0.2, 1.3, -0.1, {})
    model.embedding[-1] = 0
    texts = [rng.integers(0, 40, n).astype(np.int32) for n in (5, 1, 0, 17)]
    ids, starts = toxicity.stream(texts, model.pad, 2)
    scores = model.score(model.pooled(ids, starts, model.tables()))
    for text, got in zip(texts, scores):
        padded = [model.pad] * 2 + list(text) + [model.pad] * 2
        pooled = []
        for w in (1, 2, 3):
            places = range(len(text) + 2)
            best = [max(sum(float(model.embedding[padded[p + k]] @ model.filters[w][k][:, f]) for k in range(w)) for p in places) for f in range(4)]
            pooled += [max(b + float(c), 0) for b, c in zip(best, model.biases[w])]
        margin = sum(p * o for p, o in zip(pooled, model.out)) + model.offset
        assert math.isclose(got, 1 / (1 + math.exp(-(margin * 1.3 - 0.1))), rel_tol=1e-5)


def test_bpe_of_columns_named_like_its_own(spark):
    table = documents(spark, [(1, "some text"), (2, None)]).withColumn("__text", F.lit("clash")).withColumn("text_read", F.lit("too"))
    encoded = bpe.encode(table, PATH, PATTERN)
    assert encoded.columns == [*table.columns, "ids"] and {(r["__text"], r.text_read) for r in encoded.collect()} == {("clash", "too")}
    decoded = bpe.decode(encoded, PATH, PATTERN)
    assert {bytes(r.decoded) for r in decoded.collect()} == {b"some text", b""}
    with pytest.raises(ValueError):
        bpe.decode(decoded, PATH, PATTERN)


def test_lm_against_a_plain_recurrence():
    """Log-likelihoods of texts by the published equations of a gated recurrent unit, word by word in plain numpy."""
    import numpy as np

    rng = np.random.default_rng(11)
    net = gru_lm.untrained(rng.random(gru_lm.CLASSES * gru_lm.MEMBERS) * 50)
    net.w_class[:], net.w_word[:] = rng.normal(0, 0.5, net.w_class.shape), rng.normal(0, 0.5, net.w_word.shape)
    net.b_in[:] = rng.normal(0, 0.3, net.b_in.shape)
    docs = [rng.integers(0, gru_lm.CLASSES * gru_lm.MEMBERS, n).astype(np.int16) for n in (1, 7, 300, 40)]
    hidden, sig = len(net.w_state), lambda x: 1 / (1 + np.exp(-x))
    for doc, got in zip(docs, gru_lm.log_likelihoods(net, docs)):
        h, before, total = np.zeros(hidden), net.start, 0.0
        for symbol in doc:
            a, b = net.embed[before].astype(float) @ net.w_in + net.b_in, h @ net.w_state
            z, r = sig(a[:hidden] + b[:hidden]), sig(a[hidden : 2 * hidden] + b[hidden : 2 * hidden])
            h = z * h + (1 - z) * np.tanh(a[2 * hidden :] + r * b[2 * hidden :])
            c, m = divmod(int(symbol), gru_lm.MEMBERS)
            to_class, to_word = h @ net.w_class + net.b_class, h @ net.w_word[c] + net.b_word[c]
            total += to_class[c] - np.log(np.exp(to_class).sum()) + to_word[m] - np.log(np.exp(to_word).sum())
            before = int(symbol)
        assert math.isclose(got, total, rel_tol=1e-4)


def test_factorisation_identity():
    import numpy as np

    rng = np.random.default_rng(2)
    model = quality.QualityModel(rng.normal(size=20), rng.normal(size=(20, 4)), np.zeros((0, 0)), 20, 0.3)
    index, value = np.array([1, 5, 7, 19]), rng.normal(size=4)
    pairs = sum(model.factors[a] @ model.factors[b] * x * y for i, (a, x) in enumerate(zip(index, value)) for b, y in list(zip(index, value))[:i])
    assert math.isclose(model.margin(index, value), 0.3 + model.weights[index] @ value + pairs)


def words_of(text):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))] + [b" "]


def base_scores(rows):
    train = [words_of(t) for d, t in rows if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2]
    counts = Counter(w for ws in train for w in ws)
    n, v = sum(counts.values()), len(counts)
    return n, [(d, len(ws := words_of(t)), sum(w in counts for w in ws), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for d, t in rows]


def test_lm_scores_of_all_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n, want = base_scores(rows)
    got = {r.doc_id: r for r in queries.op6_gru_lm(spark, SF).collect()}
    assert len(got) == len(rows)
    gain = 0.0
    for d, tokens, known, base in want:
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n) and math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-6)
        assert r.score < 0
        gain += (r.score - r.base_score) * r.held_out
    assert gain > 0  # the network beats the base on texts it did not learn from


def test_lm_scores_of_odd_rows(spark):
    table = documents(spark, ODD, True)
    n, want = base_scores([(r[0], r[1]) for r in ODD])
    got = gru_lm.lm_scoring(table).collect()
    key = lambda x: (str(x[0]), round(x[3], 3))
    rows = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got), key=key)
    for have, full in zip(rows, sorted(want, key=key), strict=True):
        assert have[:3] == full[:3] and math.isclose(have[3], full[3], rel_tol=1e-9, abs_tol=1e-6)
    assert gru_lm.lm_scoring(documents(spark, [])).count() == 0


def test_lm_probabilities_add_up():
    """Over all symbols, classes and members of the factored softmax sum to one, at any state."""
    import numpy as np

    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 40, 30).astype(np.int16) for _ in range(12)]
    counts = np.bincount(np.concatenate(docs), minlength=gru_lm.CLASSES * gru_lm.MEMBERS).astype(float)
    net = gru_lm.train_network(docs, counts, epochs=1)
    head = docs[0][:5]
    every = [np.append(head, s).astype(np.int16) for s in range(gru_lm.CLASSES * gru_lm.MEMBERS)]
    whole = gru_lm.log_likelihoods(net, every) - gru_lm.log_likelihoods(net, [head])[0]
    assert math.isclose(np.exp(whole).sum(), 1, rel_tol=1e-3)
    # The state is carried over blocks of positions: a text scored alone or with others has the same likelihood.
    long = np.tile(docs[1], 30)
    assert math.isclose(gru_lm.log_likelihoods(net, [long])[0], gru_lm.log_likelihoods(net, [*docs, long])[-1], rel_tol=1e-4)


def test_licenses_found_and_confirmed(spark):
    filler = "the quiet river runs past seven old mills and nobody counts them any more "
    rows, want = [], set()
    for i, (name, text) in enumerate(licenses.TEMPLATES.items()):
        rows.append((i, filler * 5 + text + " " + filler * 5))
        want.add((i, name))
    changed = licenses.TEMPLATES["MIT-header"].replace("free of charge", "free of cost")
    rows += [(100, filler + changed), (101, filler * 40), (102, None), (103, ""), (104, "a licence to chill and permission to rest " * 3)]
    got = licenses.license_scan(documents(spark, rows, True)).collect()
    found = {(r.doc_id, r.license) for r in got}
    assert want <= found and {d for d, _ in found} <= {*range(len(licenses.TEMPLATES)), 100}
    texts = dict(rows)
    for r in got:
        span = texts[r.doc_id].encode()[r.start : r.end]
        assert span and r.n_changed <= 0.1 * r.n_words
    mit = next(r for r in got if r.doc_id == 100)
    assert mit.license == "MIT-header" and mit.n_changed == 1 and mit.changes == ["charge -> cost"]
    assert licenses.license_scan(documents(spark, [])).count() == 0


def test_licenses_against_plain_search(spark):
    """Every exact occurrence of a template's words in a document is covered by a finding."""
    wanted = {k: " ".join(w.decode() for w, _, _ in licenses.words(t.encode())) for k, t in licenses.TEMPLATES.items()}
    found: dict[int, set] = {}
    for r in queries.op1_license_scan(spark, SF).collect():
        found.setdefault(r.doc_id, set()).add(r.license)
    for r in spark.read.parquet(f"{SF}/documents.parquet").where("text IS NOT NULL").collect():
        flat = " " + " ".join(w.decode(errors="replace") for w, _, _ in licenses.words(r.text.encode())) + " "
        for name, words in wanted.items():
            if f" {words} " in flat:
                assert found.get(r.doc_id), (r.doc_id, name)


def test_lm_counts_joined_or_at_hand_are_the_same(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i))) for i in range(60)]
    table = documents(spark, rows)
    few, counts = gru_lm.fit(table, known_words=20)
    assert len(few.words) <= 20 and gru_lm.known_level(counts, 10**6) == 0
    many, _ = gru_lm.fit(table)
    a, b = ({r.doc_id: r for r in gru_lm.score(table, m, counts).collect()} for m in (few, many))
    for d in a:
        assert a[d].n_known == b[d].n_known and math.isclose(a[d].base_score, b[d].base_score, rel_tol=1e-9, abs_tol=1e-9)
