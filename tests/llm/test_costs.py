"""Kernels that were made cheaper: the same results from less work."""

import numpy as np

from wirelake.llm import hmm, repeats


def test_ranks_cover_the_texts_only(monkeypatch):
    ranked = []
    plain = repeats._ranks
    monkeypatch.setattr(repeats, "_ranks", lambda x: ranked.append(len(x)) or plain(x))
    rng = np.random.default_rng(3)
    shared = bytes(rng.integers(97, 123, 110, np.uint8))
    texts = [bytes([65 + k]) + shared + bytes([97 + k]) for k in range(20)] + [shared[:60], shared[60:], b"x"]
    found = repeats.maximal_repeats(texts, 100)
    # the halves lie next to each other, but no window runs from one text into another
    assert [(n, sorted(at)) for n, at in found] == [(110, [(k, 1) for k in range(20)])]
    assert max(ranked) <= sum(map(len, texts)) + 108


def test_expected_counts_of_texts_in_one_sequence():
    rng = np.random.default_rng(5)
    states, size = 3, 6
    moves, emit = rng.random((states, states)), rng.random((size, states))
    p = hmm.Parameters(np.array([0.2, 0.5, 0.3]), moves / moves.sum(1, keepdims=True), emit / emit.sum(0))
    docs = [[b"a", b"b", b"z", b"a"], [], [b"c"], [b"b", b"b"]]
    stream = hmm.symbols(docs, {b"a": 0, b"b": 1, b"c": 2, b"d": 3}, 4)
    assert stream.tolist() == [0, 1, 4, 0, 5, 5, 2, 5, 1, 1, 5]
    got, want = hmm.counts_of(p), hmm.counts_of(p)
    hmm.expected(stream, p, got)
    for text in ([0, 1, 4, 0, 5], [5], [2, 5], [1, 1, 5]):  # over all paths
        paths = {}
        for path in np.ndindex(*[states] * len(text)):
            steps = [p.start[path[0]], *(p.moves[a, b] for a, b in zip(path, path[1:])), *(p.emit[x, s] for x, s in zip(text, path, strict=True))]
            paths[path] = np.prod(steps)
        for path, weight in paths.items():
            weight /= sum(paths.values())
            want[0][path[0]] += weight
            for a, b in zip(path, path[1:]):
                want[1][a, b] += weight
            for x, s in zip(text, path, strict=True):
                want[2][x, s] += weight
    assert all(np.allclose(a, b) for a, b in zip(got, want, strict=True))


def test_training_numbers_words_once(spark, monkeypatch):
    seen = []
    for name in ("word_counts", "neighbours", "baum_welch"):
        plain = getattr(hmm, name)
        monkeypatch.setattr(hmm, name, lambda training, *a, plain=plain, name=name: seen.append((name, "text" in training.columns)) or plain(training, *a))
    texts = ["one two three " * 30, None, "", "two\tone  Two", "x" * 70_000 + " one", *(f"one word{k % 4} three" for k in range(50))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = hmm.fit(docs)
    # texts are read for their counts; passes read numbers
    assert seen == [("word_counts", True), ("neighbours", False), ("baum_welch", False), ("baum_welch", False)]
    number = {w: i for i, (w, _) in enumerate(model.top)}
    names = spark.sparkContext.broadcast((number, len(number)))
    got = sorted(np.frombuffer(r.stream, np.int32).tolist() for r in hmm.numbered(docs, names).collect())
    want = sorted(hmm.symbols([hmm.ascii_lower(t).split()], number, len(number)).tolist() for t in texts)
    assert got == want
