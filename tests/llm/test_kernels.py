"""The operators' kernels against plain versions of the same definitions."""

import base64
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from wirelake.llm import bpe, crf, hmm, langid, lcp, mixing, nndescent, pii, repeats, simhash

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
LETTERS = "aab'restvml d  \n\t12!?éß漢٣ ́😀\r²"


@pytest.fixture(scope="module")
def reference_encoder():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(texts, **more):
    out = [[] for _ in texts]
    for k, ids, _ in bpe.coder(PATH).windows(texts, **more):
        out[k] += ids.tolist()
    return out


def test_bpe_equals_library(reference_encoder):
    rng = random.Random(1)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["", " ", "  ", "\n", "'", "'s", "a's", " 's", "'s's", "!'s", "x" * 5000, "ab" * 3000]
    assert ids_of(texts) == [reference_encoder.encode_ordinary(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_bpe_round_trip(text):
    (ids,) = ids_of([text])
    assert bpe.coder(PATH).decode(np.array(ids, np.int64)) == text.encode()


def test_bpe_long_text_in_windows(reference_encoder):
    rng = random.Random(2)
    text = "".join(rng.choice(LETTERS) for _ in range(20000)) + "z" * 4000
    assert ids_of([text], window=1500) == [reference_encoder.encode_ordinary(text)]


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", "   ", "One", "one two three", "A b C d", "a b c d a b c d a b c d", "É é x y z w q", "\x0b\x0ca\tb\nc\rd e"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("split", [False, True])
def test_tile_comparison(split):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.int64).view(np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(600)], np.uint64)
    fp = np.unique(np.concatenate((base[rng.integers(0, 40, 600)] ^ flips, rng.integers(0, 2**63, 300, dtype=np.int64).view(np.uint64))))
    rng.shuffle(fp)
    cut = len(fp) // 2
    roots = simhash.compare(fp[:cut], fp[cut:], 4) if split else simhash.compare(fp, None, 4)
    expected = list(range(len(fp)))

    def find(i):
        while expected[i] != i:
            i = expected[i]
        return i

    for i, j in itertools.combinations(range(len(fp)), 2):
        if (not split or i < cut <= j) and int(fp[i] ^ fp[j]).bit_count() <= 4:
            a, b = find(i), find(j)
            expected[max(a, b)] = min(a, b)
    assert roots.tolist() == [find(i) for i in range(len(fp))]


def test_tile_plan_covers_all_counts():
    plan = simhash.tile_plan({0: 1, 20: 5, 32: 100, 33: 7, 64: 1}, tile=10)
    assert [(a, b) for a, b, _ in plan] == [(0, 31), (32, 32), (33, 64)] and plan[1][2] == 10


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(1, 9), min_size=1))
def test_schedule_is_fair(weights):
    total = sum(weights.values())
    slots = mixing.template(weights)
    assert sorted(x for s in slots.values() for x in s) == list(range(total))
    for s, w in weights.items():
        for k, t in enumerate(slots[s]):
            assert k * total // w <= t < -(-(k + 1) * total // w)
        for t in range(total + 1):
            assert abs(sum(x < t for x in slots[s]) - t * w / total) < 1


def test_phases_use_every_block_once():
    blocks, weights = {"a": 50, "b": 3, "c": 7, "d": 0}, {"a": 2, "b": 2, "c": 1, "d": 1}
    used = {s: 0 for s in blocks}
    slots = set()
    for phase in mixing.phases(blocks, weights):
        for s, (first, end, w, at) in phase["sources"].items():
            assert first == used[s]
            used[s] = end
            slots |= {phase["slot"] + (k - first) // w * phase["total"] + at[(k - first) % w] for k in range(first, end)}
    assert used == blocks and slots == set(range(60))


def plain_pii(text):
    """The base patterns as they stand."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        if 12 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in double) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(("email", "ip", "card", "phone")[k], s, e) for s, k, e in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.text("ab1290.@+- ()é\n-", max_size=40))
def test_pii_base_spans(text):
    assert [s[:3] for s in pii.spans(text) if s[0] in pii.KINDS[:4]] == plain_pii(text)


def test_pii_checks_and_context():
    text = "card 4111 1111 1111 1111 iban DE89 3704 0044 0532 0130 00, not 4111 1111 1111 1112; a@b.co 1.2.3.256 10.0.0.1 +1 (555) 010-9999"
    found = pii.spans(text)
    assert [s[0] for s in found] == ["card", "iban", "email", "ip", "phone"]
    assert found[0][3] > pii.BASE_SCORE["card"] and text[found[1][1] : found[1][2]] == "DE89 3704 0044 0532 0130 00"
    assert pii.spans("1" * 50_000 + "@" * 50_000) == []


def test_repeats_kernel():
    rng = random.Random(4)
    passage = bytes(rng.randrange(97, 105) for _ in range(40))
    texts = [bytes(rng.randrange(97, 123) for _ in range(rng.randrange(0, 30))) + passage[rng.randrange(3) :] + bytes(rng.randrange(97, 123) for _ in range(9)) for _ in range(12)] + [passage, b"", b"x" * 30, passage]
    found = repeats.maximal_repeats(texts, least=10)
    covered = [np.zeros(len(t), bool) for t in texts]
    for size, places in found:
        strings = {texts[o][p : p + size] for o, p in places}
        assert len(strings) == 1 and size >= 10
        where = {(o, p) for o, t in enumerate(texts) for p in range(len(t) - size + 1) if t[p : p + size] in strings}
        assert set(places) == where and len(places) == len(where)
        for o, p in sorted(places)[1:]:
            covered[o][p : p + size] = True
    seen, expected = set(), [np.zeros(len(t), bool) for t in texts]
    for o, t in enumerate(texts):
        for p in range(len(t) - 9):
            if t[p : p + 10] in seen:
                expected[o][p : p + 10] = True
            seen.add(t[p : p + 10])
    assert all((a == b).all() for a, b in zip(covered, expected, strict=True))


def test_anchors_do_not_depend_on_the_place():
    rng = np.random.default_rng(5)
    passage = rng.integers(97, 110, 300).astype(np.uint8)
    a = np.concatenate((rng.integers(97, 110, 777).astype(np.uint8), passage, rng.integers(97, 110, 50).astype(np.uint8)))
    shared = []
    for data in (passage, a):
        begin, length, h, c = repeats.anchors(data)
        assert begin[0] == 0 and (begin[1:] == begin[:-1] + length[:-1] - repeats.LEAST + 1).all()
        shared.append(set(zip(h.tolist(), c.tolist(), strict=True)))
    assert len(shared[0] & shared[1]) >= len(shared[0]) - 2
    assert len(repeats.anchors(passage[:99])[0]) == 0


def test_parsing_is_locally_consistent():
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(600))
    a, b, c = lcp.sketches([text, "zzz qqq " + text, text[::-1]])[:, None]
    assert lcp.likeness(a, b)[0] > 0.6 and lcp.likeness(a, a)[0] == 1 and lcp.likeness(a, c)[0] < 0.2
    alone = lcp.sketches([text])[0]
    assert (alone == a[0]).all()
    short = lcp.sketches(["", "a", "aaaaaaaa", "", "ab"])
    assert lcp.likeness(short[:1], short[3:4])[0] == 1 and lcp.likeness(short[1:2], short[2:3])[0] <= 1


def test_hmm_forward_is_exact():
    rng = np.random.default_rng(7)
    p = hmm.Parameters(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), rng.dirichlet(np.ones(5), 2).T)
    texts = [[0, 2, 1], [], [3], [1, 1, 0, 2]]
    stream = hmm.symbols([[bytes([x]) for x in t] for t in texts], {bytes([x]): x for x in range(4)}, 3)
    got = hmm.log10_likelihoods(stream, np.array([len(t) + 1 for t in texts]), p)
    for t, value in zip(texts, got, strict=True):
        total = 0.0
        for path in itertools.product(range(2), repeat=len(t) + 1):
            q = p.start[path[0]]
            for i, x in enumerate([*t, 4]):
                q *= p.emit[x, path[i]] * (p.moves[path[i], path[i + 1]] if i < len(t) else 1)
            total += q
        assert np.isclose(10**value, total)


def test_hmm_training_raises_the_likelihood():
    rng = np.random.default_rng(8)
    stream = np.concatenate([np.append(rng.integers(0, 3, 20) + 3 * (k % 2), 7) for k in range(60)]).astype(np.int32)
    overall = np.bincount(stream, minlength=8) + 0.5
    overall /= overall.sum()
    lengths = np.full(60, 21)
    first = hmm.first_guess(overall, stream, passes=0, states=4)
    later = hmm.first_guess(overall, stream, passes=10, states=4)
    assert hmm.log10_likelihoods(stream, lengths, later).sum() > hmm.log10_likelihoods(stream, lengths, first).sum() + 50


def test_crf_marginals_are_exact():
    rng = np.random.default_rng(9)
    moves = rng.normal(size=(2, 2))
    lengths = np.array([3, 1, 4, 0])
    unary = rng.normal(size=8)
    odds = crf.marginal_odds(unary, np.cumsum(lengths) - lengths, lengths, moves)
    for first, n in zip(np.cumsum(lengths) - lengths, lengths, strict=True):
        u, on, total = unary[first : first + n], np.zeros(n), 0.0
        for tags in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(u[i] for i in range(n) if tags[i]) + sum(moves[a, b] for a, b in zip(tags, tags[1:])))
            total += w
            on += w * np.array(tags)
        assert np.allclose(odds[first : first + n] / (1 + odds[first : first + n]), on / total)


def test_crf_expectations_are_exact():
    rng = np.random.default_rng(12)
    moves, lengths = rng.normal(size=(2, 2)), np.array([3, 1, 4])
    unary = rng.normal(size=8)
    p, clean, pairs = crf.expectations(unary, lengths, moves)
    for k, (first, n) in enumerate(zip(np.cumsum(lengths) - lengths, lengths, strict=True)):
        u, total, on, none, moved = unary[first : first + n], 0.0, np.zeros(n), 0.0, np.zeros(4)
        for tags in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(u[i] for i in range(n) if tags[i]) + sum(moves[a, b] for a, b in zip(tags, tags[1:])))
            total += w
            on += w * np.array(tags)
            none += w * (not any(tags))
            for a, b in zip(tags, tags[1:]):
                moved[2 * a + b] += w
        assert np.allclose(p[first : first + n], on / total) and np.isclose(clean[k], np.log(none / total)) and np.allclose(pairs[k], moved / total)


def test_crf_leaves_unexplained_labels_alone():
    """Labels of a third of the toxic documents that no word explains don't make their words toxic; without word labels the marks are found."""
    rng = random.Random(13)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    texts, label, marked = [], [], []
    for k in range(600):
        w = [rng.choice(vocabulary) for _ in range(50)]
        marked.append(k % 10 < 2)
        label.append(k % 10 < 3)
        if marked[-1]:
            w[rng.randrange(50)] = rng.choice(["grumble", "blasted!"])
        texts.append(" ".join(w))
    model = crf.train(texts[:500], [int(y) for y in label[:500]], 0.3)
    tagger = crf.Tagger(model)
    odds = tagger.odds(texts[500:])
    assert [tagger.score(o) >= 0.5 for o in odds] == marked[500:]
    for text, o in zip(texts[500:], odds, strict=True):
        assert {w.strip("!") for w, x in zip(text.split(), o, strict=True) if x >= 1} <= {"grumble", "blasted"}


def test_near_copies_of_one_label_count_once():
    rng = random.Random(14)
    base = [" ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(200)) for _ in range(3)]
    texts = [base[0], base[0] + " end", base[0], base[1], base[2] + " " + base[1][:80], base[2]]
    assert crf._independent(texts, [0, 0, 1, 0, 1, 1]) == [0, 2, 3, 4]


def test_crf_finds_marked_documents():
    rng = random.Random(10)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(200)]
    texts, toxic = [], []
    for k in range(300):
        w = [rng.choice(vocabulary) for _ in range(60)]
        toxic.append(k % 3 == 0)
        if toxic[-1]:
            w[rng.randrange(60)] = rng.choice(["grumble", "blast!"])
        texts.append(" ".join(w))
    model = crf.train(texts[:240], [int(t) for t in toxic[:240]], 1 / 3)
    tagger = crf.Tagger(model)
    assert [tagger.score(o) >= 0.5 for o in tagger.odds(texts[240:])] == toxic[240:]
    assert 0 <= tagger.score(tagger.odds([""])[0]) < 0.5
    assert crf.train(["a"], [0], 0.5) is None


def test_profiles_tell_languages_apart():
    rng = random.Random(11)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(80))
    known = {}
    for lang, letters in (("x", "abcdef"), ("y", "defghi")):
        _, code, n, _ = langid.ngrams([make(letters)])
        known[lang] = code[np.lexsort((code, -n))][:300]
    away, size = langid.distances([make("abcdef"), make("defghi"), "123 !", ""], list(known.values()))
    assert away.argmin(axis=1)[:2].tolist() == [0, 1] and size.tolist() == [400, 400, 0, 0]


def test_ngrams_of_one_word():
    owner, code, n, size = langid.ngrams(["Aa-a", "b"])
    a, b, gap = (int(langid.letters()[ord(c)]) for c in "ab-")
    k = langid.BITS
    expected = {a: 3, gap << k | a: 2, a << k | a: 1, a << k | gap: 2, gap << 2 * k | a << k | a: 1, a << 2 * k | a << k | gap: 1, gap << 2 * k | a << k | gap: 1}
    assert {c: m for o, c, m in zip(owner.tolist(), code.tolist(), n.tolist(), strict=True) if o == 0} == expected
    assert size.tolist() == [3, 1] and b in code[owner == 1]


def test_best_keeps_distinct_neighbours():
    u, v, s, _ = nndescent.best(np.array([1, 1, 1, 2, 1]), np.array([5, 6, 5, 1, 7]), np.array([0.5, 0.9, 0.5, 0.1, 0.7]), np.full(5, 2))
    assert list(zip(u.tolist(), v.tolist(), strict=True)) == [(1, 6), (1, 7), (2, 1)]


def test_folds_are_crc32(spark):
    from wirelake.llm.common import fold

    rows = spark.range(50).select("id", fold("id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)
