"""Pairs of unlike sets are ruled out by sketches, before the sets are moved."""

import random

import numpy as np

from tests.llm.test_operators import DOCS, plain_first_of_groups
from wirelake.llm import simhash


def test_sketches_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(2)
    for n in (0, 1, 30, 700, 5000):
        both = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)
        for left, right in ((0, 0), (3, 0), (40, 25), (900, 1200)):
            a, b = (np.unique(np.concatenate((both, rng.integers(0, 1 << 63, m, np.uint64)))) for m in (left, right))
            differ = np.bitwise_count((simhash.sketch(a) ^ simhash.sketch(b)).view(np.uint64)).sum()
            assert differ <= len(np.setxor1d(a, b)) and (differ or not left)


def test_sets_of_unlike_pairs_stay(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    block = lambda: " ".join(word() for _ in range(12))
    pool = [block() for _ in range(10)]
    texts = []
    for _ in range(30):  # two texts share a rare block; the others of either are frequent ones
        rare = block()
        texts += [" ".join([*rng.sample(pool[:5], 3), rare]), " ".join([rare, *rng.sample(pool[5:], 3)])]
    alike = [f"{t} {word()}" for t in texts[:4]]
    rows = list(enumerate(texts + alike))
    moved, plain = set(), simhash.shingles_of
    monkeypatch.setattr(simhash, "shingles_of", lambda docs, nodes, ends, shingle: moved.update(r.node for r in ends.collect()) or plain(docs, nodes, ends, shingle))
    kept = {r.doc_id for r in simhash.without_near_copies(spark.createDataFrame([(*r, "en", "s0", 1) for r in rows], DOCS)).collect()}
    assert {(False, k) for k in kept} == plain_first_of_groups(rows)[0] and kept == set(range(60))
    # those of the similar pairs, and hardly any other
    assert {simhash.set_hash(simhash.shingle_set(t, 5)) for t in texts[:4] + alike} <= moved and len(moved) <= 12
