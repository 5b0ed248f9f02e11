"""What the language model's network learns from."""

import zlib

import numpy as np

from tests.llm.helpers import documents
from vibrata.llm import gru_lm


def learned_from(spark, monkeypatch, rows, **options):
    """Lengths of the texts that reach training, by partition."""
    seen = []

    def watched(pieces, network):
        seen.extend(pieces.rdd.glom().map(lambda part: [len(r.ids) // 2 for r in part]).collect())
        return network

    with monkeypatch.context() as m:
        m.setattr(gru_lm, "train_apart", watched)
        gru_lm.fit(documents(spark, rows), **options)
    return seen


def test_whole_texts_train_without_a_cap(spark, monkeypatch):
    rows = [(i, f"w{i} and some more words " * 10_000) for i in range(45)]  # over two million tokens
    parts = learned_from(spark, monkeypatch, rows, piece=1 << 19)
    assert sorted(n for p in parts for n in p) == [50_001] * 45
    assert len(parts) == 5


def test_training_share_grows_with_the_corpus(spark, monkeypatch):
    few, many = ([n for p in learned_from(spark, monkeypatch, [(None, f"text number {i}") for i in range(k)], fewest=100) for n in p] for k in (2000, 8000))
    assert 180 < len(few) < 320 and 850 < len(many) < 1150  # an eighth, of one null id too


def test_networks_trained_apart_and_averaged_learn(spark):
    rng = np.random.default_rng(3)
    docs = [np.cumsum(rng.integers(1, 3, 600)).astype(np.int16) % 40 for _ in range(400)]
    counts = np.bincount(np.concatenate(docs), minlength=gru_lm.CLASSES * gru_lm.MEMBERS).astype(float)
    plain = gru_lm.untrained(counts)
    table = spark.createDataFrame([(d.astype(np.int16).tobytes(),) for d in docs], "ids binary").repartition(5)
    net = gru_lm.train_apart(table, plain)
    before, after = (gru_lm.log_likelihoods(n, docs).sum() for n in (plain, net))
    assert after > 0.95 * before  # log-likelihoods are negative
    # A partition without rows, or no rows at all, is no hindrance.
    assert gru_lm.train_apart(table.limit(1).repartition(3), plain) is not plain
    assert np.array_equal(gru_lm.train_apart(table.limit(0), plain).embed, plain.embed)


def test_held_out_rows_alone_are_scored(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = gru_lm.lm_scoring(documents(spark, [(i, "some words here") for i in held])).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got) == [(i, 4, 0, 0, 0.0) for i in held]
    assert all(r.held_out and r.score < 0 for r in got)


def test_the_query_learns_from_every_training_text(spark, monkeypatch):
    seen = []

    def watched(pieces, network):
        seen.extend(len(r.ids) // 2 for r in pieces.collect())
        return network

    monkeypatch.setattr(gru_lm, "train_apart", watched)
    monkeypatch.setattr(gru_lm.fit, "__defaults__", tuple(100 if x == gru_lm.FEWEST else x for x in gru_lm.fit.__defaults__))
    gru_lm.lm_scoring(documents(spark, [(i, "one more text " * (i % 5)) for i in range(2000)]))
    assert sorted(seen) == sorted(3 * (i % 5) + 1 for i in range(2000) if zlib.crc32(str(i).encode()) % 7 != 2)


def test_every_text_has_its_round():
    for length in (10, 1000, 40_000):  # pieces that are learned from in all rounds, in two and in one
        docs = [np.full(length, i, np.int16) for i in range(100)]
        rounds = [[int(d[0]) for d in gru_lm.part_of_round(docs, k, 3)] for k in range(3)]
        assert set().union(*rounds) == set(range(100)) and max(map(len, rounds)) - min(map(len, rounds)) <= 1
        assert sum(map(len, rounds)) == 100 * min(3, -(-gru_lm.WANTED // (100 * length)))
