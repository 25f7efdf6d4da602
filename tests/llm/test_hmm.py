"""Segments of long documents, shards, and a text of many words."""

import resource
import time

import numpy as np
import pytest

from driftline.llm import hmm


@pytest.fixture
def model():
    rng = np.random.default_rng(7)
    return hmm.Model(*(x / x.sum(axis=a, keepdims=True) for x, a in ((rng.random(4), 0), (rng.random((4, 4)), 1), (rng.random((hmm.CLASSES, 4)), 0))))


def test_segments_give_what_whole_documents_give(model, monkeypatch):
    rng = np.random.default_rng(8)
    lengths = np.array([700, 256, 255, 130, 64, 64, 9, 1])
    codes, starts = rng.integers(0, 90, int(lengths.sum())), np.concatenate(([0], np.cumsum(lengths)[:-1]))

    def both():
        into = (np.zeros(4), np.zeros((4, 4)), np.zeros((hmm.CLASSES, 4)))
        return hmm.forward(model, codes, starts, lengths), hmm.expect(model, codes, starts, lengths, into), into

    whole = both()
    for size, at_once in ((64, 300_000), (64, 100), (7, 1000), (1, 50)):
        monkeypatch.setattr(hmm, "SEGMENT", size)
        monkeypatch.setattr(hmm, "AT_ONCE", at_once)
        cut = both()
        assert cut[0] == pytest.approx(whole[0]) and cut[1] == pytest.approx(whole[1])
        assert all(np.allclose(a, b) for a, b in zip(cut[2], whole[2], strict=True))


def test_a_text_of_millions_of_words(model):
    n = 2_000_000
    codes = np.random.default_rng(9).integers(0, 5000, n).astype(np.uint16)
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    into = (np.zeros(4), np.zeros((4, 4)), np.zeros((hmm.CLASSES, 4)))
    total = hmm.expect(model, codes, np.array([0]), np.array([n]), into)
    assert into[2].sum() == pytest.approx(n) and into[1].sum() == pytest.approx(n - 1) and np.isfinite(total)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000 and time.time() - began < 120


def test_the_model_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    scores = [{r.doc_id: (r.n_known, r.base_score, r.score) for r in hmm.score_documents(docs.repartition(n)).collect()} for n in (1, 5)]
    assert all(a == pytest.approx(scores[1][i], rel=1e-6) for i, a in scores[0].items())
