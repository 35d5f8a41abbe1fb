"""Toxic spans and documents by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import fold, texts_in_chunks

#: Labelled documents of each class that the model is fitted on, about (drawn by a hash of doc_id), and the longest of them in characters.
SAMPLE, LONGEST = 1200, 20_000
#: A feature has a weight if so many sample documents have it.
LEAST_DOCS = 2
#: Share of the toxic labels that no word explains; least hashes by which near copies are told.
MISLABELLED, MINIMA = 0.2, 8
#: Training: documents of a step, passes and steps at least, step size, pull to zero.
BATCH, PASSES, STEPS, RATE, DECAY = 128, 4, 60, 0.1, 1e-2
#: To begin with: log odds of a word, standard errors taken off a feature's weight.
START_BIAS, DOUBT = -4.0, 2.0
#: Words whose score one worker keeps.
CACHE = 300_000
_EDGES = re.compile(r"^\W+|\W+$")


def features(word: str) -> list[str]:
    """Of one word: itself without punctuation at its ends, and its first 4, 5 and 6 letters."""
    w = _EDGES.sub("", word)
    return [f"w={w}", *(f"{k}={w[:k]}" for k in (4, 5, 6) if len(w) > k)] if w else []


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    moves: np.ndarray  # log potentials [from, to] of clean and toxic
    document: tuple[float, float, float]  # of the document score: constant, log odds of the likeliest word, log of 1 + expected toxic words

    def unary(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(word))


def words(text: str) -> list[str]:
    return text.lower().split()


def ratios(unary: np.ndarray, first: np.ndarray, length: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of all sequences at once, as ratios of toxic to clean, which can't overflow; their product is each word's odds."""
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    e = np.exp(np.clip(unary, -30, 30))
    cc, ct, tc, tt = np.exp(moves).ravel()
    ahead, back = np.empty_like(e), np.ones_like(e)
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), "left")
    for t in range(steps):
        at = first[: active[t]] + t
        if t:
            r = ahead[at - 1]
            ahead[at] = e[at] * (ct + r * tt) / (cc + r * tc)
        else:
            ahead[at] = e[at]
    for t in range(steps - 2, -1, -1):
        n = active[t + 1]
        at = first[:n] + t
        q = e[at + 1] * back[at + 1]
        back[at] = (tc + q * tt) / (cc + q * ct)
    return ahead, back


def marginal_odds(unary: np.ndarray, first: np.ndarray, length: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Odds that each word is toxic, by forward-backward."""
    ahead, back = ratios(unary, first, length, moves)
    return ahead * back


def expectations(unary: np.ndarray, length: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sequences that follow each other, none empty: each word's probability to be toxic, the log probability of each sequence to
    have no toxic word, and its expected moves [sequence, from * 2 + to]."""
    first = np.cumsum(length) - length
    ahead, back = ratios(unary, first, length, moves)
    e, m = np.exp(np.clip(unary, -30, 30)), np.exp(moves)
    odds = ahead * back
    inner = np.ones(len(unary), bool)
    last = first + length - 1
    inner[last] = False
    at = np.flatnonzero(inner)
    r, q = ahead[at], e[at + 1] * back[at + 1]
    each = np.stack([np.full(len(at), m[0, 0]), m[0, 1] * q, r * m[1, 0], r * q * m[1, 1]], axis=1)
    each /= each.sum(axis=1, keepdims=True)
    owner = np.repeat(np.arange(len(length)), length)[at]
    pairs = np.stack([np.bincount(owner, each[:, k], len(length)) for k in range(4)], axis=1)
    clean = (length - 1) * moves[0, 0] - np.bincount(owner, np.log(m[0, 0] + r * m[1, 0]), len(length)) - np.log1p(ahead[last])
    return odds / (1 + odds), clean, pairs


def _independent(texts: list[str], toxic: list[int]) -> list[int]:
    """One of each group of near copies with one label, which would otherwise count a document's words many times.

    A text goes if most of its MINIMA least hashes of three-word grams are those of one text before it.
    """
    keys: dict[tuple[int, int, int], int] = {}
    kept = []
    for i, (text, y) in enumerate(zip(texts, toxic, strict=True)):
        w = text.split()
        hashes = np.array([xxhash.xxh64_intdigest(" ".join(w[k : k + 3])) for k in range(max(1, len(w) - 2))], np.uint64)
        mine = [(y, seed, int((hashes * np.uint64((2 * seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).min())) for seed in range(MINIMA)]
        before = Counter(keys[k] for k in mine if k in keys)
        if not before or max(before.values()) <= MINIMA // 2:
            kept.append(i)
            for k in mine:
                keys.setdefault(k, i)
    return kept


def first_weights(docs: list[list[str]], of_word: dict[str, list[str]], label: np.ndarray, index: dict[str, int]) -> np.ndarray:
    """How much more often each feature is in toxic documents: the log ratio less DOUBT standard errors, where that is positive."""
    have = np.zeros((2, len(index)))
    for d, y in zip(docs, label, strict=True):
        have[y, sorted({index[f] for w in set(d) for f in of_word[w] if f in index})] += 1
    total = np.bincount(label, minlength=2)[:, None] + 1.0
    rate = np.log((have + 0.5) / total)
    error = np.sqrt((1 / (have + 0.5) - 1 / total).sum(axis=0))
    return np.maximum(0.0, rate[1] - rate[0] - DOUBT * error)


def train(texts: list[str], toxic: list[int], prior: float) -> Model | None:
    """Fits the model to texts with a label each; prior is the share of toxic ones among all. None without both classes.

    Which words are toxic is not given: their labels are hidden. A document labelled clean has no toxic word, one
    labelled toxic has one at least, apart from a share MISLABELLED of toxic labels that no word explains. So a toxic
    document's expected features are those of the chain's distribution without the path on which all words are clean,
    weighted by how likely its label is explained at all; the gradient is their difference from the model's own
    expectations, for words and for moves alike, by forward-backward over whole documents.
    """
    rows = [i for i in _independent(texts, toxic) if words(texts[i])]
    texts, toxic = [texts[i] for i in rows], [toxic[i] for i in rows]
    n = [toxic.count(0), toxic.count(1)]
    if not min(n):
        return None
    docs = [words(t) for t in texts]
    of_word = {w: features(w) for d in docs for w in set(d)}
    counts: Counter = Counter(f for d in docs for f in {f for w in set(d) for f in of_word[w]})
    index = {f: i for i, f in enumerate(sorted(f for f, c in counts.items() if c >= LEAST_DOCS))}
    ids = {w: [index[f] for f in fs if f in index] for w, fs in of_word.items()}
    length = np.fromiter(map(len, docs), np.int64, len(docs))
    at = [ids[w] for d in docs for w in d]
    size = np.fromiter(map(len, at), np.int64, len(at))
    column = np.fromiter((i for x in at for i in x), np.int64, int(size.sum()))
    begin, first = np.cumsum(size) - size, np.cumsum(length) - length
    label = np.array(toxic)
    weight = np.where(label == 1, 0.5 / n[1], 0.5 / n[0]) * len(docs)
    w, bias, moves = first_weights(docs, of_word, label, index), START_BIAS, np.zeros((2, 2))
    seen, seen_moves = np.full(len(index) + 1, 1e-8), np.full((2, 2), 1e-8)
    rng = np.random.default_rng(5)
    per_pass = -(-len(docs) // BATCH)
    for _ in range(max(PASSES, -(-STEPS // per_pass))):
        # documents of about one length make a step, since it takes as long as the longest
        alike = np.argsort(length * rng.uniform(0.7, 1.3, len(docs)))
        for k in rng.permutation(np.arange(0, len(docs), BATCH)):
            rows = np.sort(alike[k : k + BATCH])
            lengths = length[rows]
            tokens = np.repeat(first[rows] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            sizes = size[tokens]
            cols = column[np.repeat(begin[tokens] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
            row = np.repeat(np.arange(len(tokens)), sizes)
            u = bias + np.bincount(row, w[cols], len(tokens))
            p, clean, pairs = expectations(u, lengths, moves)
            y, some = label[rows], -np.expm1(np.minimum(clean, -1e-12))
            # of a toxic label: how much each path with a toxic word counts, and what is left for the clean path
            up = np.where(y == 1, (1 - MISLABELLED) / (MISLABELLED + (1 - MISLABELLED) * some), 0.0)
            owner = np.repeat(np.arange(len(rows)), lengths)
            share = weight[rows] / len(rows)
            miss = p * (1 - up[owner]) * share[owner]
            g = np.bincount(cols, miss[row], len(index) + 1)
            g[-1] = miss.sum()
            g[:-1] += DECAY * w
            seen += g * g
            step = RATE * g / np.sqrt(seen)
            w -= step[:-1]
            bias -= step[-1]
            moved = (pairs * ((1 - up) * share)[:, None]).sum(axis=0)
            moved[0] = -moved[1:].sum()  # the moves of a sequence are as many on both sides
            g = moved.reshape(2, 2)
            seen_moves += g * g
            moves = np.clip(moves - RATE * g / np.sqrt(seen_moves), -4, 4)
    model = Model({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-3}, float(bias), moves, (0.0, 1.0, 1.0))
    score = {v: model.bias + sum(model.weights.get(f, 0.0) for f in fs) for v, fs in of_word.items()}
    odds = marginal_odds(np.fromiter((score[v] for d in docs for v in d), np.float64, int(length.sum())), first, length, moves)
    x = np.array([summary(odds[a : a + k]) for a, k in zip(first, length, strict=True)])
    share = np.where(label == 1, prior / n[1], (1 - prior) / n[0])
    model.document = fit_document(x, label.astype(float), share)
    return model


def summary(odds: np.ndarray) -> tuple[float, float]:
    """Log odds of the likeliest word and log of one more than the expected number of toxic words."""
    if not len(odds):
        return -15.0, 0.0
    return float(np.clip(np.log(odds.max()), -15, 15)), float(np.log1p((odds / (1 + odds)).sum()))


def fit_document(x: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps, with a pull to zero so that separable classes stay finite."""
    z, b = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ b))
        pull = 1e-4 * np.eye(3)
        b = b - np.linalg.solve((z * (share * p * (1 - p))[:, None]).T @ z + pull, z.T @ (share * (p - y)) + 1e-4 * b)
    return tuple(b.tolist())


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of the labelled documents given, from a bounded sample (SAMPLE, LONGEST) that comes to the driver."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return None
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(5)), F.lit(1 << 20))
    limit = F.when(F.col("toxic") == 1, round(min(1, SAMPLE / n[1]) * (1 << 20))).otherwise(round(min(1, SAMPLE / n[0]) * (1 << 20)))
    # about 2 * SAMPLE ids, 4 * SAMPLE at most: small enough to send everywhere, so no text is shuffled for the few that are wanted
    drawn = docs.sparkSession.createDataFrame(marked.where(draw < limit).limit(4 * SAMPLE).collect(), "doc_id long, toxic int")
    sample = docs.where(F.length("text") <= LONGEST).select("doc_id", "text").join(F.broadcast(drawn), "doc_id").orderBy("doc_id", "text").limit(3 * SAMPLE)
    rows = sample.collect()
    return train([r.text for r in rows], [r.toxic for r in rows], n[1] / (n[0] + n[1]))


class Tagger:
    """Scores of words met before, and documents' marginals."""

    def __init__(self, model: Model):
        tagger = self

        class Scores(dict):
            def __missing__(self, word):
                out = self[word] = model.unary(word)
                if len(self) > CACHE:
                    tagger.full = True
                return out

        self.model, self.scores, self.full = model, Scores(), False

    def odds(self, texts: list[str]) -> list[np.ndarray]:
        """Odds of each word of each text."""
        if self.full:
            self.scores.clear()
            self.full = False
        tokens = [words(t) for t in texts]
        length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.fromiter((self.scores[w] for d in tokens for w in d), np.float64, int(length.sum()))
        edges = np.concatenate(([0], np.cumsum(length)))
        odds = marginal_odds(flat, edges[:-1], length, self.model.moves)
        return [odds[a:b] for a, b in zip(edges, edges[1:])]

    def score(self, odds: np.ndarray) -> float:
        c, a, b = self.model.document
        x, y = summary(odds)
        return float(1 / (1 + np.exp(-np.clip(c + a * x + b * y, -30, 30))))


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def tag(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted, spans) of every document: spans are (start, end, p) of runs of words with marginals of at least ``least``.

    Offsets are code points. Null, empty and blank texts have the score of a text without toxic words. Without a model
    (no labels of one class) all scores are 0. Whole texts are tagged; repeated rows come back as often as they are
    there; only doc_id and text are read.
    """
    schema = "doc_id long, score double, predicted int, spans array<struct<start:int,end:int,p:double>>"
    split = re.compile(r"\S+")

    def spans(text, odds):
        p = odds / (1 + odds)
        hot = np.flatnonzero(p >= least)
        if not len(hot):
            return []
        places = [m.span() for m in split.finditer(text)]
        out = []
        for run in np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1):
            out.append({"start": places[run[0]][0], "end": places[run[-1]][1], "p": float(p[run].max())})
        return out

    def run(batches):
        tagger = model and Tagger(model)
        for batch in batches:
            scores, found = [], []
            for _, texts in texts_in_chunks(batch, limit=4_000_000, most_rows=4000):
                odds = tagger.odds(texts) if tagger else [np.zeros(0)] * len(texts)
                scores += [tagger.score(o) if tagger else 0.0 for o in odds]
                found += [spans(t, o) for t, o in zip(texts, odds, strict=True)]
            arrays = [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(found, _SPANS)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "score", "predicted", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model of the labels outside the held-out fold: (doc_id, held_out, score, predicted, n_spans)."""
    model = fit(docs.where(fold("doc_id", 5) != 0), labels.where(fold("doc_id", 5) != 0))
    return tag(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))
