"""The start of the language model comes from all training texts."""

from collections import Counter

import numpy as np

from wirelake.llm import hmm


def test_long_texts_are_in_the_start(spark):
    rng = np.random.default_rng(8)
    topics = [[f"{t}{k}" for k in range(6)] for t in "abcd"]
    rows = [(k, "one two " * 20) for k in range(20)] + [(90 + k, " ".join(rng.choice(t, 25_000))) for k, t in enumerate(topics)] + [(100, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert all(len(t or "") > 50_000 for k, t in rows if 90 <= k < 100)
    model = hmm.fit(docs, passes=0)
    number = {w: i for i, (w, _) in enumerate(model.top)}
    stream = hmm.symbols([[w.encode() for w in rng.choice(topics[2], 400)]], number, len(number))
    score = hmm.log10_likelihoods(stream, np.array([len(stream)]), model.p)[0] / len(stream)
    alone = np.mean([model.base(n) for w, n in model.top if w.decode() in topics[2]])
    assert score > alone + 0.3  # that words of one text follow each other is known


def test_neighbours_of_all_texts(spark):
    rows = [(k, " ".join(f"w{(k * j) % 13}" for j in range(k % 40))) for k in range(300)] + [(301, "w1 w2 " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    number = {f"w{k}".encode(): k for k in range(13)}
    names = spark.sparkContext.broadcast((number, 13))
    for coarse in (13, 5):
        want = Counter()
        for _, t in rows:
            x = [coarse + 1, *(min(number[w.encode()], coarse) for w in t.split()), coarse + 1]
            want.update(zip(x, x[1:]))
        got = hmm.neighbours(docs, names, coarse)
        assert {(int(a), int(b)): int(got[a, b]) for a, b in zip(*np.nonzero(got))} == dict(want)


def test_start_of_neighbours_is_a_model():
    rng = np.random.default_rng(3)
    pairs, overall = rng.integers(0, 50, (8, 8)).astype(float), rng.dirichlet(np.ones(8))
    for n in (pairs, np.zeros((8, 8))):
        p = hmm.from_neighbours(n, overall, states=4)
        assert np.allclose(p.emit.sum(axis=0), 1) and np.allclose(p.moves.sum(axis=1), 1) and np.isclose(p.start.sum(), 1)
