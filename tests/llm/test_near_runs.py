"""Large families of texts around the limit of similarity: what is proposed stays in proportion, and no pair is missed."""

import random

import numpy as np
import pytest

from tests.llm.test_operators import DOCS, plain_first_of_groups
from wirelake.llm import simhash


def family(n, seed=3):
    """Copies of one text with three or four words changed, so that most pairs are below 0.8 and some are not."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for k in range(n):
        v = list(base)
        for at in rng.sample(range(2, 98, 4), rng.randint(2, 4)):
            v[at] = f"x{rng.randrange(3)}"
        rows.append((k, " ".join(v)))
    return rows


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("cut", [None, 70])
def test_similar_sets(cut):
    sets = [simhash.shingle_set(t, 5) for _, t in family(120)] + [np.arange(7, dtype=np.uint64), np.arange(8, dtype=np.uint64)]
    sizes, plain = np.array([len(x) for x in sets]), [set(x.tolist()) for x in sets]
    roots = simhash.similar_sets(np.concatenate(sets).view(np.int64), sizes, cut, 0.8)
    n = len(sets)
    want = [(i, j) for j in range(n) for i in range(j) if (cut is None or i < cut <= j) and jaccard(plain[i], plain[j]) >= 0.8]
    assert (roots == simhash.link_roots(n, [(np.array([i]), np.array([j])) for i, j in want])).all() and len(want) > 5


def test_rows_follow_the_postings(spark):
    proposed = {}
    for n in (60, 480):
        docs = spark.createDataFrame([(*r, "en", "s0", 1) for r in family(n)], DOCS)
        counts = np.zeros(1 << simhash.COUNT_BITS, np.int64)
        placed = simhash.shared_postings(simhash.postings(docs, counts, 0.8, 5), 0.8).selectExpr("gram", "node as group", "node", "place", "size").cache()
        whole = simhash.pairs_between(placed, 0.8, whole=True)
        proposed[n] = whole.count() / placed.count()
        assert n < 100 or whole.where("v is null").count() > 0
    assert proposed[480] <= max(simhash.FEW, 2 * proposed[60])


def test_no_pair_of_a_large_family_is_missed(spark, monkeypatch):
    rows = family(200)
    monkeypatch.setattr(simhash, "PART", 64)  # several parts a run
    docs = spark.createDataFrame([(*r, "en", "s0", 1) for r in rows] + [(1000, "alone in the world of words", "en", "s0", 1), (0, rows[0][1], "en", "s0", 1)], DOCS)
    first, groups, _ = plain_first_of_groups([*rows, (1000, "alone in the world of words"), (0, rows[0][1])])
    kept = [r.doc_id for r in simhash.without_near_copies(docs).collect()]
    assert len(kept) == groups and {(False, i) for i in kept} == first


def test_rest_by_runs_joins_what_pairs_join(spark):
    rows = family(200, 5)
    docs = spark.createDataFrame([(*r, "en", "s0", 1) for r in rows], DOCS)
    sets = {simhash.set_hash(g): g for g in (simhash.shingle_set(t, 5) for _, t in rows)}
    plain = {k: set(g.tolist()) for k, g in sets.items()}
    placed = simhash.shared_postings(simhash.postings(docs, np.zeros(1 << simhash.COUNT_BITS, np.int64), 0.8, 5), 0.8).selectExpr("gram", "node as group", "node", "place", "size")
    found = simhash.pairs_between(placed, 0.8, whole=True).cache()
    held = spark.createDataFrame([(k, g.view(np.int64).tolist()) for k, g in sets.items()], "node long, grams array<long>")
    edges = {(r.u, r.v) for r in simhash.links_in_runs(found.where("v is null"), held, 0.8).collect()}
    edges |= {(r.u, r.v) for r in found.where("v is not null").collect() if jaccard(plain[r.u], plain[r.v]) >= 0.8}
    at = {k: i for i, k in enumerate(sorted(sets))}

    def roots(pairs):
        return simhash.link_roots(len(at), [(np.array([at[u] for u, _ in pairs]), np.array([at[v] for _, v in pairs]))]).tolist()

    want = [(u, v) for u in at for v in at if u < v and jaccard(plain[u], plain[v]) >= 0.8]
    assert roots(sorted(edges)) == roots(want) and want


def test_sieve_lets_every_wanted_row_pass(spark):
    rows = spark.range(20000).selectExpr("xxhash64(id) as t", "id")
    may = simhash.sieve(rows.where("id % 7 = 0").select("t"))
    passed = {r.id for r in rows.where(may(rows["t"])).select("id").collect()}
    assert {i for i in range(20000) if i % 7 == 0} <= passed and len(passed) < 3500
