"""The operators over small tables: plain versions, and nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wirelake.llm import bpe, crf, hmm, langid, lcp, mixing, nndescent, pii, repeats, simhash
from wirelake.llm.common import Scratch, fold
from wirelake.llm.graph import components

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = ("fp", "rep", "bits", "tile", "t", "h", "g", "block", "slot", "place", "score", "ids", "spans", "node", "component", "extra", "n")


def corpus():
    rng = random.Random(1)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(150)] for lang, letters in (("en", "abcdefghi"), ("de", "mnopqrstü"))}
    rows = []
    for k in range(60):
        lang = "de" if k % 3 == 0 else "en"
        text = " ".join(rng.choice(words[lang]) for _ in range(rng.randint(30, 90)))
        rows.append((k, text, lang, f"s{k % 4 if k % 2 else 0}"))
    passage = rows[5][1][:150]
    rows += [(60, rows[3][1], "de", "s0"), (61, rows[3][1] + " more", "de", "s1"), (62, "pre " + passage + " post", "en", None), (63, None, None, "s9"), (64, "", "en", "s0"), (65, " \n ", None, "s0"), (66, "!!! 123", "en", "s2")]
    rows += [(67, "call +1 (555) 010-9999 or mail a.b@example.com", "en", "s2"), (68, "x" * 30_000, "en", "s2"), (69, "é漢😀 " * 40, "fr", "s3"), (70, "A b", "en", "s3"), (70, "A b", "en", "s3")]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    out = spark.createDataFrame(corpus(), DOCS).repartition(5, "doc_id")
    for c in CLASHING:
        out = out.withColumn(c, F.lit("clash"))
    return Scratch(spark, "test").table(out, "docs")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(0, 80)] + [(200, x) for x in range(201, 260)] + [(int(a), int(b)) for a, b in rng.integers(300, 400, (60, 2))] + [(5, 5), (7, 6)]
    found = {r.node: r.component for r in components(Scratch(spark, "cc"), spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert found == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(Scratch(spark, "cc"), spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs, tile=16).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fps = [simhash.fingerprint(t) for _, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, _) in enumerate(rows):
        for m, (j, _) in enumerate(rows[:k]):
            if (fps[k] ^ fps[m]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    expected = sorted((i, f"{f:016x}", find(i)) for (i, _), f in zip(rows, fps, strict=True))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == expected
    assert len({r.component_id for r in got if r.doc_id in (63, 64, 65)}) == 1
    assert simhash.near_duplicates(empty).count() == 0


def plain_first_of_groups(rows, least=0.8, shingle=5):
    """(doc_id, text) of the first row of each group of texts joined by exact Jaccard similarity of word shingles."""

    def grams(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))) if w else frozenset()

    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))
    hash_ = {t: None for _, t in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, x in enumerate(sets):
        for m, y in enumerate(sets[:k]):
            if x == y or (x and y and len(x & y) >= least * len(x | y)):
                a, b = sorted((find(k), find(m)))
                root[b] = a
    groups = {}
    for k, row in enumerate(rows):
        groups.setdefault(find(k), []).append(row)
    return {min((i is None, i) if i is not None else (True, 0) for i, _ in g) for g in groups.values()}, len(groups), hash_


@pytest.mark.parametrize("tile", [16, simhash.TILE])
def test_without_near_copies(docs, empty, spark, tile):
    rng = random.Random(5)
    rows = []
    for k in range(40):
        w = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randint(100, 300))]
        rows.append((1000 + k, " ".join(w)))
        for j in range(k % 4):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"  # five of a hundred or more shingles
            rows.append((2000 + 10 * k + j, " ".join(v)))
        half = list(w)
        half[: len(w) // 3] = reversed(half[: len(w) // 3])
        rows.append((3000 + k, " ".join(half)))
    rows += [(None, rows[0][1]), (None, "only here without an id"), (1000, rows[5][1] + " tail"), rows[9], rows[9], (5000, None), (5001, ""), (5002, " ")]
    made = spark.createDataFrame([(*r, "en", "s0", 1) for r in rows], DOCS)
    both = docs.select(*made.columns).unionByName(made).withColumn("t", F.lit("clash")).withColumn("node", F.lit("clash"))
    got = simhash.without_near_copies(both, tile=tile)
    assert got.columns == both.columns
    kept = [r.doc_id for r in got.collect()]
    first, groups, _ = plain_first_of_groups([(r.doc_id, r.text) for r in both.collect()])
    assert len(kept) == groups and {(i is None, i or 0) for i in kept} == first
    assert simhash.without_near_copies(empty).count() == 0


def test_forest_is_lightest():
    rng = np.random.default_rng(6)
    n, m = 60, 300
    a, b, w = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 9, m)
    keep = a != b
    a, b, w = a[keep], b[keep], w[keep]
    root, total, edges = list(range(n)), 0, 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k in np.argsort(w, kind="stable"):
        x, y = find(a[k]), find(b[k])
        if x != y:
            root[x], total, edges = y, total + int(w[k]), edges + 1
    at = simhash.forest(n, a, b, w)
    assert (len(at), int(w[at].sum())) == (edges, total) and len(simhash.forest(3, a[:0], b[:0], w[:0])) == 0


def test_mixing(docs, empty):
    weights = {"s0": 3, "s1": 2}
    rows = mixing.mix(docs, weights, block_rows=2, group_rows=8).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    slots = {}
    for r in rows:
        slots.setdefault(r.slot, set()).add((r.source, r.block))
        assert r.release <= r.slot < r.deadline
    assert sorted(slots) == list(range(len(slots))) and all(len(s) == 1 for s in slots.values())
    first = [next(iter(slots[k]))[0] for k in range(len(slots)) if any(r.slot == k and r.phase == 0 for r in rows)]
    own = {s: weights.get(s, 1) for s in {r.source for r in rows}}
    for s, w in own.items():
        for k in range(len(first) + 1):
            assert abs(first[:k].count(s) - k * w / sum(own.values())) < 1
    assert mixing.mix(empty).count() == 0
    ordered = mixing.in_mix_order(docs, weights, block_rows=2)
    assert ordered.columns == docs.columns and ordered.count() == docs.count()
    with pytest.raises(ValueError):
        mixing.mix(docs, {"s0": 0})


@pytest.mark.parametrize("sources", [3, 230, 900])
def test_mixing_many_sources_and_ids_in_bulk(spark, monkeypatch, sources):
    monkeypatch.setattr(mixing, "TOGETHER", 40 if sources == 900 else 230)
    rows = [(None if k % 5 == 0 else 7 if k % 5 == 1 else k, None if k % sources == 2 else f"s{k % sources}", f"text {k % 50}") for k in range(4000)]
    table = Scratch(spark, "mix").table(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6), "rows")
    weights = {f"s{k}": 1 + k % 3 for k in range(sources)}
    got = mixing.mix(table, weights, block_rows=4, group_rows=64).collect()
    assert sorted((str(r.doc_id), str(r.source)) for r in got) == sorted((str(i), str(s)) for i, s, _ in rows)
    blocks = {}
    for r in got:
        blocks.setdefault(r.slot, {}).setdefault((r.source, r.block), []).append(r.place)
    assert sorted(blocks) == list(range(len(blocks))) and all(len(b) == 1 for b in blocks.values())
    assert all(sorted(p) == list(range(len(p))) for b in blocks.values() for p in b.values())
    placed = mixing.with_places(table, weights, block_rows=4, part_rows=500)
    out = placed.collect()
    assert sorted((str(r.doc_id), str(r.source), r.text) for r in out) == sorted((str(i), str(s), t) for i, s, t in rows)
    assert [(r.mix_slot, r.mix_place) for r in out] == sorted((r.mix_slot, r.mix_place) for r in out) and len({(r.mix_slot, r.mix_place) for r in out}) == 4000
    by_slot = {}
    for r in out:
        by_slot.setdefault(r.mix_slot, set()).add(r.source)
    assert all(len(x) == 1 for x in by_slot.values()) and sorted(by_slot) == sorted(blocks)
    assert {k: next(iter(x)) for k, x in by_slot.items()} == {k: next(iter(b))[0] for k, b in blocks.items()}
    # the rows themselves are moved once
    assert placed._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


def test_bpe(docs, empty):
    got = [(r.doc_id, r.ids_sha256, r.decoded_sha256, r.n_tokens) for r in bpe.digests(docs, PATH).collect()]
    tiktoken = pytest.importorskip("tiktoken")
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(PATH), special_tokens={})
    expected = []
    for r in docs.collect():
        ids = encoder.encode_ordinary(r.text or "")
        expected.append((r.doc_id, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest(), len(ids)))
    assert sorted(got) == sorted(expected)
    assert bpe.digests(empty, PATH).count() == 0
    rows = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert all(bytes(r.data) == (r.text or "").encode() and (r.ends[-1] if r.ends else 0) == len(r.data) for r in rows)


def test_language_model(docs, empty, spark):
    got = hmm.held_out_scores(docs).collect()
    assert len(got) == docs.count()
    texts = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.withColumn("f", fold("doc_id", 5)).where("f <> 1").collect()]
    counts = {}
    for _, w in texts:
        for x in [*w, b""]:
            counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()), len(counts)
    all_ = {r.doc_id: [*(r.text or "").encode().lower().split(), b""] for r in docs.collect()}
    for r in got:
        w = all_[r.doc_id]
        assert (r.n_tokens, r.train_tokens, r.n_known) == (len(w), n, sum(x in counts for x in w))
        assert np.isclose(r.base_score, sum(np.log10((counts.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert np.isfinite(r.score) and r.score < 0
    assert hmm.held_out_scores(empty).count() == 0
    assert np.isfinite(hmm.scores(docs, hmm.fit(empty)).agg(F.sum("score")).first()[0])


def test_language_model_by_hand(docs, spark):
    """Every score against a plain forward recursion with logs, one text at a time, over the same fitted model."""
    odd = spark.createDataFrame([(None, "abc dea bcd " * 3000), (None, None), (None, "never met"), (900, "never met"), (900, "never met")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(odd)
    model = hmm.fit(docs.where(fold("doc_id", 5) != 1))
    counts = {bytes(r.word): r.n for r in model.counts.collect()}
    number = {w: i for i, (w, _) in enumerate(model.top)}
    assert number and set(number) == {w for w, n in counts.items() if w and n >= 2}
    n_rare = sum(n for w, n in counts.items() if w and w not in number)
    p = model.p
    assert np.allclose(p.emit.sum(axis=0), 1) and np.allclose(p.moves.sum(axis=1), 1) and np.isclose(p.start.sum(), 1)

    def plain(text):
        total, a = 0.0, None
        words = (text or "").encode().lower().split()
        for w in [*words, None]:
            e = p.emit[number.get(w, len(number)) if w is not None else len(number) + 1]
            a = (p.start if a is None else a @ p.moves) * e
            total += np.log10(a.sum())
            a = a / a.sum()
            if w is not None and w not in number:
                c = counts.get(w, 0)
                total += np.log10((c - hmm.DISCOUNT if c else hmm.DISCOUNT * sum(n and w not in number for w, n in counts.items() if w)) / n_rare)
        return round(total, 6)

    want = sorted((str(r.doc_id), plain(r.text)) for r in rows.collect())
    got = sorted((str(r.doc_id), round(r.score, 6)) for r in hmm.scores(rows, model).collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], atol=2e-5)


def test_expected_counts_of_all_texts(docs, spark):
    """One pass adds up to the counts of words, starts and moves that the texts hold."""
    model = hmm.fit(docs, passes=0)
    number = {w: i for i, (w, _) in enumerate(model.top)}
    names = spark.sparkContext.broadcast((number, len(number)))
    seen = {}

    def keep(counts, overall):
        seen["counts"] = counts
        return model.p

    real, hmm.maximise = hmm.maximise, keep
    try:
        hmm.baum_welch(docs, model.p, names, np.ones(len(number) + 2))
    finally:
        hmm.maximise = real
    starts, moves, emissions = seen["counts"]
    n = docs.count()
    assert np.isclose(emissions.sum(), model.n_all, rtol=1e-5) and np.isclose(starts.sum(), n, rtol=1e-5)
    assert np.allclose(emissions.sum(axis=1)[: len(number)], [c for _, c in model.top], rtol=1e-4)


def test_toxicity(docs, empty, spark):
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 2)) for k in range(60)], "doc_id long, quality int, toxic int")
    marked = docs.withColumn("text", F.when(F.col("doc_id").between(0, 59) & (F.col("doc_id") % 5 == 2), F.concat("text", F.lit(" Grumble!"))).otherwise(F.col("text")))
    rows = by_id(crf.held_out_scores(marked, labels))
    assert len(rows) == 71 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    assert [k for k in range(60) if rows[k].predicted] == list(range(2, 60, 5))
    odd = spark.createDataFrame([(None, "Grumble!"), (None, None), (99, "clean " * 40_000), (99, "clean " * 40_000)], "doc_id long, text string")
    model = crf.fit(marked, labels.unionByName(labels.selectExpr("doc_id", "quality", "0 as toxic")))  # of two labels the higher counts
    both = marked.select("doc_id", "text").unionByName(odd)

    def plain(text):
        """Forward-backward in plain probabilities, word by word."""
        u = [np.exp(model.unary(w)) for w in (text or "").lower().split()]
        m, ahead, back = np.exp(model.moves), [], [np.ones(2)]
        for e in u:
            a = np.array([1.0, e]) if not ahead else (ahead[-1] @ m) * [1.0, e]
            ahead.append(a / a.sum())
        for e in u[:0:-1]:
            b = m @ (back[-1] * [1.0, e])
            back.append(b / b.sum())
        p = [(a * b)[1] / (a * b).sum() for a, b in zip(ahead, back[::-1])]
        x, y = (np.clip(max(np.log(q / (1 - q)) for q in p), -15, 15), np.log1p(sum(p))) if p else (-15.0, 0.0)
        c, f, g = model.document
        return 1 / (1 + np.exp(-(c + f * x + g * y)))

    want = sorted((str(r.doc_id), round(plain(r.text), 6)) for r in both.collect())
    got = sorted((str(r.doc_id), round(r.score, 6)) for r in crf.tag(both, model).collect())
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-5)
    assert crf.held_out_scores(empty, labels).count() == 0
    nothing = crf.held_out_scores(docs, labels.where("toxic = 0")).collect()
    assert {r.score for r in nothing} == {0.0}
    model = crf.Model({"w=grumble": 9.0}, -4.0, np.zeros((2, 2)), (-2.0, 1.0, 0.0))
    spans = {r.doc_id: (r.text, r.spans) for r in crf.tag(marked, model).join(marked.select("doc_id", "text"), "doc_id").collect()}
    text, found = spans[2]
    assert [text[s.start : s.end] for s in found] == ["Grumble!"] and spans[63][1] == []


def plain_removal(rows, least):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        covered = np.zeros(len(data), bool)
        for k in range(len(data) - least + 1):
            if data[k : k + least] in seen:
                covered[k : k + least] = True
            seen.add(data[k : k + least])
        kept = bytes(np.frombuffer(data, np.uint8)[~covered])
        runs = int((np.diff(np.concatenate(([0], covered.astype(int)))) == 1).sum())
        out[i] = (len(data), int(covered.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [5000, 2])
def test_repeats(docs, empty, spark, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(5)
    line = "".join(rng.choice("abcdef ") for _ in range(90))
    many = [(100 + k, "".join(rng.choice("ghijkl ") for _ in range(40)) + line + "".join(rng.choice("gh") for _ in range(60)), None, None, None) for k in range(25)]
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(many, DOCS)).where("doc_id <> 68")
    expected = plain_removal({(r.doc_id, r.text) for r in rows.collect()}, 100)
    got = repeats.without_repeats(rows).collect()
    assert len(got) == rows.count()
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[r.doc_id] for r in got)
    assert repeats.without_repeats(empty).count() == 0


def test_runs_of_one_byte(spark):
    rows = spark.createDataFrame([(1, "x" * 3000), (2, "x" * 150), (3, "x" * 99)], "doc_id long, text string")
    expected = plain_removal([(r.doc_id, r.text) for r in rows.collect()], 100)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(rows).collect()} == expected


def test_personal_data(docs, empty):
    rows = by_id(pii.digests(docs))
    assert (rows[67].n_email, rows[67].n_phone, rows[67].spans) == (1, 1, "phone:5:22,email:31:46,".rstrip(","))
    assert rows[67].base_sha256 == hashlib.sha256(rows[67].spans.encode()).hexdigest() and rows[63].spans == ""
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    kept = by_id(clean)
    assert kept[67].text == "call [PHONE] or mail [EMAIL]" and kept[67].n_chars == len(kept[67].text)
    assert kept[63].text is None and kept[63].n_chars is None and kept[70].text == "A b"
    assert pii.redact(empty).count() == 0 and pii.find(docs).count() == docs.count()


def test_redacts_base_kinds_of_any_score(spark):
    text = "order placed from 10.1.2.3"
    assert [(k, p) for k, _, _, p in pii.spans(text)] == [("ip", 0.4)]
    assert pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text == "order placed from [IP]"


def test_fingerprints(docs, empty, spark):
    got = lcp.edited(docs, group=4).collect()
    assert len(got) == docs.count()
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (-r[0], r[1]))
    expected = []
    for k, (i, text) in enumerate(rows):
        after, cut = rows[(k + 1) % len(rows)][1], len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = lcp.sketches([text, edited, after])[:, None]
        expected.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), lcp.render(a)[0], lcp.render(b)[0], lcp.likeness(a, b)[0], lcp.likeness(a, c)[0]))
    assert sorted(tuple(r) for r in got) == sorted(expected)
    assert lcp.edited(empty).count() == 0
    # wide ids, one outlier, null and repeated ids in bulk, a very long text
    rng = random.Random(15)
    ids = [-(1 << 63), 5, (1 << 63) - 1, 1 << 61, *range(100, 400), *[None] * 300, *[77] * 100]
    wide = [(i, "long " * 60_000 if i == 5 else " ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(rng.randint(0, 40)))) for i in ids]
    made = Scratch(spark, "wide").table(spark.createDataFrame(wide, "doc_id long, text string").repartition(6), "docs")
    hashed = {r.text: r.t for r in made.select("text", F.xxhash64("text").alias("t")).collect()}
    rows = sorted(wide, key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1]]))
    want = []
    for (i, text), (_, after) in zip(rows, [*rows[1:], rows[0]], strict=True):
        cut = len(text) // 3
        want.append((str(i), hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.edited_sha256) for r in lcp.edited(made, group=16).collect()) == sorted(want)
    per = lcp.neighbours(made, group=16).groupBy("p").agg(F.count("*").alias("n"), F.sum(F.col("extra").cast("int")).alias("more")).collect()
    assert max(r.n for r in per) < 16 * 10 and {r.more for r in per} == {1} and len(per) > 20
    one = spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")
    assert lcp.edited(one).first().edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    equal = {r.text: r.fingerprint for r in lcp.fingerprints(docs).collect()}
    assert all(equal[r.text] == r.fingerprint for r in lcp.fingerprints(docs).collect())


def test_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 16))
    rows = [(k, (base[k % 40] + rng.normal(size=16) * (0.01 + 0.2 * (k % 3))).tolist()) for k in range(240)]
    rows += [(300 + k, (base[0] + 1e-3 * rng.normal(size=16)).tolist()) for k in range(60)]
    rows += [(400 + k, base[1].tolist()) for k in range(20)] + [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [None] * 16), (504, []), (505, [1.0, 2.0]), (506, [2.0, 4.0]), (507, [float("inf")] * 16), (None, base[3].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("n", F.lit("clash"))
    got = {r.vec_id: r for r in nndescent.near_duplicates(table).collect()}
    usable = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: [j for j, w in usable if j != i and len(w) == len(v) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.9] for i, v in usable}
    root = {i: i for i in links}
    for _ in range(20):
        for i, js in links.items():
            low = min([root[i], *(root[j] for j in js)])
            for j in [i, *js]:
                root[j] = min(root[j], low)
    assert len(got) == len(rows)
    wrong = [i for i in links if (got[i].n_links, got[i].component_id) != (len(links[i]), root[i])]
    assert wrong == []
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (500, 501, 502, 503, 504, 507))
    assert got[506].n_links == 1 and got[506].component_id == 505 and not got[506].kept
    assert nndescent.near_duplicates(table.limit(0)).count() == 0


def plain_links(rows):
    """n_links and component of rows (id, vector) by brute force."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    low = ids.copy()
    while True:
        after = np.where(near, low[None, :], ids.max()).min(axis=1)
        if (after == low).all():
            break
        low = after
    return {int(i): (int(n) - 1, int(c)) for i, n, c in zip(ids, near.sum(axis=1), low, strict=True)}


def test_vectors_lost_outside_a_large_group(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(120, 32))
    rows = [(k, (base[0] + 1e-3 * rng.normal(size=32)).tolist()) for k in range(150)]
    rows += [(200 + 2 * k + s, (base[k] + 0.01 * rng.normal(size=32)).tolist()) for k in range(1, 120) for s in (0, 1)]
    whole = nndescent.descend
    # lists that miss each link outside the large group
    monkeypatch.setattr(nndescent, "ATTEMPTS", 1)

    def lossy(scratch, nodes, *more):
        lists, full = whole(scratch, nodes, *more)
        large = nodes.where("vec_id < 200").select("id")
        return lists.join(large.withColumnRenamed("id", "u"), "u", "left_semi").join(large.withColumnRenamed("id", "v"), "v", "left_semi").select("u", "v", "sim", "cap"), full

    monkeypatch.setattr(nndescent, "descend", lossy)
    got = nndescent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == plain_links(rows)


def test_vectors_one_link_between_saturated_groups(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "FEW", 20)
    degrees = [*np.linspace(0, 4.5, 59), 5.0, 30.5, *np.linspace(31, 35.5, 59)]
    rows = [(k, [float(np.cos(np.radians(a))), float(np.sin(np.radians(a)))]) for k, a in enumerate(degrees)]
    got = nndescent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    expected = plain_links(rows)
    assert expected[59] == (60, 0) and expected[60] == (60, 0) and expected[0] == (59, 0)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == expected


def two_groups(n, dims):
    """Two groups of n vectors whose facing edges reach a cosine of 0.9: each has more near neighbours within its group than any list holds."""
    rng = np.random.default_rng(8)
    a, b = np.linalg.qr(rng.normal(size=(dims, 2)))[0].T
    angle = np.concatenate((np.linspace(0, 0.2, n), np.linspace(0.62, 0.82, n)))
    x = np.cos(angle)[:, None] * a + np.sin(angle)[:, None] * b + 1e-4 * rng.normal(size=(2 * n, dims))
    return [(k, v.tolist()) for k, v in enumerate(x)]


@pytest.mark.parametrize("enlarged", [2])
def test_vectors_of_two_groups_that_touch(spark, monkeypatch, enlarged):
    monkeypatch.setattr(nndescent, "ENLARGED", enlarged)
    rows = two_groups(201, 16)
    got = nndescent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    expected = plain_links(rows)
    assert {c for _, c in expected.values()} == {0} and 201 * 200 * 2 < sum(n for n, _ in expected.values()) < 402 * 401
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == expected


def test_vectors_that_share_an_id(spark):
    v, w = [1.0, 0.0, 0.1], [0.0, 1.0, 0.1]
    rows = [(1, v), (5, w), (5, None), (7, None), (5, v), (9, w), (None, v)]
    got = nndescent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == sorted([(1, 1, 1, True), (5, 1, 5, True), (5, 0, 5, True), (7, 0, 7, True), (5, 1, 1, False), (9, 1, 5, False), (0, 0, 0, False)])


def test_language(docs, empty):
    rows = by_id(langid.held_out_predictions(docs))
    assert len(rows) == 71 and all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (63, 64, 65, 66))
    assert all(rows[k].lang_pred == ("de" if k % 3 == 0 else "en") for k in range(60))
    assert langid.held_out_predictions(empty).count() == 0
    assert {r.lang_pred for r in langid.held_out_predictions(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_by_hand(docs, spark):
    """Labels and scores against plain out-of-place distances of dictionaries; rows without an id and a very long text too."""
    odd = spark.createDataFrame([(None, "abc dea bcd " * 20_000, "en"), (None, None, None), (None, "mnop qrst", None)], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").unionByName(odd)
    rows = both.withColumn("held", fold("doc_id", 3) == 1).collect()
    number = langid.letters()

    def counts(text):
        out, run = {}, [langid.GAP]
        for c in text:
            x = int(number[ord(c)])
            if x != langid.GAP or run[-1] != langid.GAP:
                run.append(x)
        if run[-1] != langid.GAP:
            run.append(langid.GAP)
        for k, x in enumerate(run):
            if x != langid.GAP:
                out[x] = out.get(x, 0) + 1
            if k and (x != langid.GAP or run[k - 1] != langid.GAP):
                pair = run[k - 1] << langid.BITS | x
                out[pair] = out.get(pair, 0) + 1
            if 0 < k < len(run) - 1 and x != langid.GAP:
                three = run[k - 1] << 2 * langid.BITS | x << langid.BITS | run[k + 1]
                out[three] = out.get(three, 0) + 1
        return out

    def ranks(found):
        return {c: r for r, c in enumerate(sorted(found, key=lambda c: (-found[c], c))[: langid.TOP])}

    totals = {}
    for r in rows:
        if not r.held and r.lang and r.text is not None:
            own = totals.setdefault(r.lang, {})
            for c, n in counts(r.text).items():
                own[c] = own.get(c, 0) + n
    known = {lang: ranks(own) for lang, own in totals.items()}

    def predict(text):
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        own = ranks(counts(text))
        away = {k: sum(min(langid.TOP, abs(p.get(c, 10**9) - r)) for c, r in own.items()) / (langid.TOP * len(own)) for k, p in known.items()}
        best = min(sorted(away), key=away.get)
        return best, round(1 - away[best], 9)

    want = sorted((str(r.doc_id), bool(r.held), *predict(r.text)) for r in rows)
    got = sorted((str(r.doc_id), r.held_out, r.lang_pred, round(r.score, 9)) for r in langid.held_out_predictions(both).collect())
    assert got == want


def test_rows_without_an_id(spark):
    rows = [(None, "call +1 555 010 9999 now " * 5000), (None, None), (1, "a b c d e"), (None, "a b c d e")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((str(r.doc_id), r.n_phone) for r in pii.digests(table).collect())
    assert found == [("1", 0), ("None", 0), ("None", 0), ("None", 5000)]
    near = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(table).collect())
    assert near == [("1", "1"), *[("None", "None")] * 3]
    scored = crf.tag(table, None).collect()
    assert len(scored) == 4 and {r.predicted for r in scored} == {0}
