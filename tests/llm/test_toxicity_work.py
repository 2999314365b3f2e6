"""What the toxicity operator spends: which words get kernel values, and where the fit runs."""

import os
import random

import numpy as np

from docwatch.llm import toxicity


def test_only_words_with_a_landmarks_letters_are_looked_at(monkeypatch):
    """Words that lack too many letters of every landmark get no pieces, and by the kernel itself they have no value."""
    rng = random.Random(5)
    marks = toxicity.Landmarks(["blorkus", "frindle", "abcdefghijk", "oxo"], 3)
    words = {"".join(rng.choice("blorkusfindeacghjx") for _ in range(rng.randrange(3, 30))) for _ in range(3000)} | {"blrkus", "xblorkus", "abcdefghij", "oox"}
    some = set(marks.possible(list(words)))
    assert {"xblorkus", "abcdefghij", "oox"} <= some < words and "blrkus" not in some
    order = sorted(words)
    bags = np.stack([[w.count(c) for c in map(chr, marks.letters)] for w in order])
    shared = np.minimum(bags[:, None], marks.bag[None]).sum(2)
    passing = (shared >= toxicity.SHARE * marks.lengths) & (np.array([len(w) for w in order])[:, None] <= 3 * marks.lengths)
    want = np.zeros(passing.shape)
    for i, k in zip(*np.nonzero(passing)):
        own = toxicity._codes([order[i]])[0]
        want[i, k] = toxicity.kernel(own, marks.codes[k : k + 1, : marks.lengths[k]])[0] / np.sqrt(toxicity.kernel(own, own)[0] * marks.norm[k])
    assert passing.sum() > 20 and np.allclose(marks.values(order), want, rtol=1e-4)
    model = toxicity.Model(marks, toxicity.Landmarks(["blor"], 1))
    looked, real = [], toxicity.Landmarks.pieces_of
    monkeypatch.setattr(toxicity.Landmarks, "pieces_of", lambda self, of: looked.extend(of) or real(self, of))
    model.scores([" ".join(order)])
    assert looked and set(looked) == some


def test_fit_runs_in_a_task(spark, monkeypatch):
    """The driver gets the model only: what a fit needs would stay in its memory for all stages that follow."""
    real = toxicity.fit

    def fit(texts, labels):
        model = real(texts, labels)
        model.pid = os.getpid()
        return model

    monkeypatch.setattr(toxicity, "fit", fit)
    docs = spark.createDataFrame([(n, f"some words {n} " + "blorkus" * (n % 2)) for n in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(40)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert getattr(model, "pid", 0) != os.getpid()
    assert model.scores(["blorkus", "words"])[0] > 0.3 > model.scores(["words"])[0]
