"""Near duplicates whose links are not the closest by fingerprint, against exact similarity."""

import random

import numpy as np

from tests.llm.test_operators import DOCS, plain_first_of_groups
from wirelake.llm import simhash


def families(seed=11):
    """Short texts in families around the limit of similarity, with some texts of frequent words only."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    common = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(3)]
    rows = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(25, 60))]
        for _ in range(8):
            v = base[rng.randint(0, 4) :] + [rng.choice(words) for _ in range(rng.randint(0, 5))]
            if rng.random() < 0.3:
                v[rng.randrange(len(v))] = "changed"
            rows.append(" ".join(v))
    rows += [f"{c} {rng.choice(words)}" for c in common for _ in range(20)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_no_similar_pair_is_missed(spark):
    rows = families()
    docs = spark.createDataFrame([(*r, "en", "s0", 1) for r in rows], DOCS)
    first, groups, _ = plain_first_of_groups(rows)
    kept = [r.doc_id for r in simhash.without_near_copies(docs).collect()]
    assert len(kept) == groups and {(False, i) for i in kept} == first


def test_rest_alone_finds_all_pairs(spark):
    """What follows the fingerprints proposes every similar pair by itself, whatever the order of the shingles."""
    rows = families(12)
    docs = spark.createDataFrame([(*r, "en", "s0", 1) for r in rows], DOCS)
    sets = {simhash.set_hash(g): set(g.tolist()) for g in (simhash.shingle_set(t, 5) for _, t in rows)}
    nodes = sorted(sets)
    want = {(u, v) for k, v in enumerate(nodes) for u in nodes[:k] if len(sets[u] & sets[v]) >= 0.8 * len(sets[u] | sets[v])}
    marked = simhash.set_fingerprints(docs, 5).cache()
    counts = simhash.shingle_counts(marked)
    assert counts.sum() == sum(len(np.unique(simhash.shingle_hashes(t, 5))) for _, t in rows)
    for order in (counts, np.zeros_like(counts), counts[::-1].copy()):
        runs = simhash.shared_postings(simhash.postings(docs, order, 0.8, 5), 0.8)
        placed = runs.selectExpr("gram", "node as group", "node", "place", "size")
        got = {(r.u, r.v) for r in simhash.pairs_between(placed, 0.8).distinct().collect()}
        assert want <= got and len(want) > 50
