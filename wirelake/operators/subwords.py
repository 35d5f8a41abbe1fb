"""Subword vocabularies: words are counted by Spark, the vocabulary is learned from the counts on the driver."""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
# Special pieces of the trainers.
BERT_SPECIALS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")


@dataclass
class Model:
    """Pieces in order of their ids; ``scores`` of unigram pieces; ``merges`` of pairs by rank."""

    kind: str
    pieces: list[str]
    merges: dict[tuple[str, str], int] = field(default_factory=dict)
    scores: dict[str, float] = field(default_factory=dict)
    unknown: str = "<unk>"


def word_counts(lines: DataFrame, column: str = "sentence", longest: int | None = None, prefix: bool = False, most: int = 1_000_000) -> DataFrame:
    """(word, n) of whitespace-separated words; all but a line's first carry a mark (``prefix``: that one too). Lines with more bytes than ``longest`` are skipped.

    Only the ``most`` frequent words go on, so the table that a trainer collects is bounded.
    """
    kept = lines.where(F.octet_length(column) <= longest) if longest else lines
    words = kept.select(F.posexplode(F.split(F.trim(F.col(column)), "\\s+")).alias("i", "w")).where("w <> ''")
    marked = F.concat(F.lit(MARK), F.col("w"))
    word = marked if prefix else F.when(F.col("i") == 0, F.col("w")).otherwise(marked)
    return words.groupBy(word.alias("word")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most)


def _collect(counts: DataFrame) -> list[tuple[str, int]]:
    return sorted((r.word, r.n) for r in counts.collect())


def train_bpe(words: list[tuple[str, int]], size: int, specials: tuple[str, ...] = ("<unk>", "<s>", "</s>"), symbols: tuple[str, ...] = ()) -> Model:
    """Byte-pair merges of the most frequent pair, ties by the pair's text, until there are ``size`` pieces."""
    chars = Counter()
    for w, n in words:
        for c in w:
            chars[c] += n
    split = [list(w) for w, _ in words]
    pairs, where = Counter(), defaultdict(set)
    for k, (parts, (_, n)) in enumerate(zip(split, words, strict=True)):
        for p in zip(parts, parts[1:]):
            pairs[p] += n
            where[p].add(k)
    heap = [(-n, p) for p, n in pairs.items()]
    heapq.heapify(heap)
    merges, pieces = {}, []
    room = size - len(specials) - len(symbols) - len(chars)
    while heap and len(pieces) < room:
        n, pair = heapq.heappop(heap)
        if -n != pairs.get(pair, 0) or n == 0:
            continue
        joined = "".join(pair)
        merges[pair] = len(merges)
        if joined not in pieces:
            pieces.append(joined)
        changed = set()
        for k in where.pop(pair, ()):
            parts, count = split[k], words[k][1]
            i = 0
            for p in zip(parts, parts[1:]):
                pairs[p] -= count
                changed.add(p)
            out = []
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(joined)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            split[k] = out
            for p in zip(out, out[1:]):
                pairs[p] += count
                where[p].add(k)
                changed.add(p)
        for p in changed:
            if pairs[p] > 0:
                heapq.heappush(heap, (-pairs[p], p))
    alphabet = [c for c, _ in sorted(chars.items(), key=lambda x: (-x[1], x[0]))]
    return Model("bpe", [*specials, *symbols, *pieces, *alphabet], merges)


def train_wordpiece(words: list[tuple[str, int]], size: int = 30522, least: int = 2, specials: tuple[str, ...] = BERT_SPECIALS) -> Model:
    """Merges the pair whose count is largest against its parts' counts; pieces inside words start with ##."""
    split = [[w[:1], *("##" + c for c in w[1:])] for w, _ in words]
    pieces = sorted({p for s in split for p in s})
    known = set(pieces)
    while len(pieces) + len(specials) < size:
        single, pairs = Counter(), Counter()
        for s, (_, n) in zip(split, words, strict=True):
            for p in s:
                single[p] += n
            for p in zip(s, s[1:]):
                pairs[p] += n
        usable = [(n / (single[a] * single[b]), n, a, b) for (a, b), n in pairs.items() if n >= least]
        if not usable:
            break
        _, _, a, b = max(usable, key=lambda x: (x[0], x[1], x[2], x[3]))
        joined = a + b.removeprefix("##")
        if joined not in known:
            known.add(joined)
            pieces.append(joined)
        for k, s in enumerate(split):
            out, i = [], 0
            while i < len(s):
                if i + 1 < len(s) and s[i] == a and s[i + 1] == b:
                    out.append(joined)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            split[k] = out
    return Model("wordpiece", [*specials, *pieces], unknown="[UNK]")


def train_unigram(words: list[tuple[str, int]], size: int, longest: int = 16, passes: int = 4, specials: tuple[str, ...] = ("<unk>", "<s>", "</s>")) -> Model:
    """Expectation-maximisation over substrings, pruned by a fifth at a time to ``size`` pieces; single characters stay."""
    seeds = Counter()
    for w, n in words:
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + longest) + 1):
                seeds[w[i:j]] += n
    chars = {c for w, _ in words for c in w}
    room = max(len(chars), size - len(specials))
    ranked = sorted((p for p in seeds if len(p) > 1), key=lambda p: (-seeds[p] * len(p), p))[: 20 * room]
    total = sum(seeds[p] for p in [*ranked, *chars]) or 1
    scores = {p: math.log(seeds[p] / total) for p in [*ranked, *sorted(chars)]}
    while True:
        for _ in range(passes):
            used = Counter()
            for w, n in words:
                for p in viterbi(w, scores, longest):
                    used[p] += n
            total = sum(used.values()) + 0.01 * len(scores)
            scores = {p: math.log((used[p] + 0.01) / total) for p in scores}
        if len(scores) <= room:
            break
        keep = max(room, int(len(scores) * 0.8))
        order = sorted((p for p in scores if p not in chars), key=lambda p: (-used[p] * len(p), p))
        kept = set(order[: keep - len(chars)]) | chars
        scores = {p: s for p, s in scores.items() if p in kept}
    ordered = sorted(scores, key=lambda p: (-scores[p], p))
    return Model("unigram", [*specials, *ordered], scores=scores)


def viterbi(word: str, scores: dict[str, float], longest: int = 16) -> list[str]:
    """The likeliest cut of a word into pieces; a character that is none is one by itself."""
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - longest), j):
            s = scores.get(word[i:j], -1e3 if j == i + 1 else None)
            if s is not None and best[i][0] + s > best[j][0]:
                best[j] = (best[i][0] + s, i)
    out, j = [], len(word)
    while j:
        i = best[j][1]
        out.append(word[i:j])
        j = i
    return out[::-1]


def train(lines: DataFrame, kind: str = "bpe", size: int = 8000, column: str = "sentence", longest: int = 4096, sentences: int | None = None, symbols: tuple[str, ...] = (), seed: int = 0) -> Model:
    """A model of the lines: bpe, unigram, char, word or wordpiece.

    With ``sentences`` the lines are a sample of about that many, drawn by a hash; 0 or None takes all. Words are
    counted in Spark, and the trainer gets the counts of the most frequent million at most.
    """
    if sentences:
        n = lines.count()
        if n > sentences:
            lines = lines.where(F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1 << 30)) < int(sentences / n * (1 << 30)))
    words = _collect(word_counts(lines, column, longest))
    if kind == "bpe":
        return train_bpe(words, size, symbols=symbols)
    if kind == "unigram":
        return train_unigram(words, size)
    if kind == "wordpiece":
        return train_wordpiece([(w.lstrip(MARK), n) for w, n in words], size)
    specials = ("<unk>", "<s>", "</s>")
    counted = Counter()
    for w, n in words:
        for p in w if kind == "char" else [w]:
            counted[p] += n
    if kind not in ("char", "word"):
        raise ValueError(f"unknown kind: {kind}")
    return Model(kind, [*specials, *symbols, *(p for p, _ in sorted(counted.items(), key=lambda x: (-x[1], x[0]))[: size - len(specials) - len(symbols)])])


def pieces_of(word: str, model: Model) -> list[str]:
    """A marked word in pieces."""
    if model.kind == "unigram":
        return viterbi(word, model.scores)
    if model.kind == "word":
        return [word]
    if model.kind == "wordpiece":
        known, out, i = set(model.pieces), [], 0
        while i < len(word):
            j = len(word)
            while j > i and ("##" if i else "") + word[i:j] not in known:
                j -= 1
            if j == i:
                return [model.unknown]
            out.append(("##" if i else "") + word[i:j])
            i = j
        return out
    parts = list(word)
    while model.merges and len(parts) > 1:
        rank, i = min((model.merges.get(p, math.inf), i) for i, p in enumerate(zip(parts, parts[1:])))
        if rank == math.inf:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def encode(text: Column, model: Model, as_ids: bool = False) -> Column:
    """Pieces (or ids) of each line; the words met before are kept."""
    number = {p: i for i, p in enumerate(model.pieces)}
    unknown = number.get(model.unknown, 0)

    @F.arrow_udf(T.ArrayType(T.IntegerType() if as_ids else T.StringType()))
    def run(text: pa.Array) -> pa.Array:
        seen: dict[str, list] = {}
        out = []
        for line in text.to_pylist():
            if line is None:
                out.append(None)
                continue
            row = []
            for i, w in enumerate(line.split()):
                word = w if i == 0 or model.kind == "wordpiece" else MARK + w
                if word not in seen:
                    seen[word] = pieces_of(word, model)
                row += seen[word]
            out.append([number.get(p, unknown) for p in row] if as_ids else row)
        return pa.array(out, pa.list_(pa.int32() if as_ids else pa.string()))

    return run(text)


def decode(pieces: Column) -> Column:
    """Text of pieces."""
    return F.trim(F.replace(F.array_join(pieces, ""), F.lit(MARK), F.lit(" ")))


def evaluate(lines: DataFrame, model: Model, column: str = "sentence", samples: int = 1000, order: str | None = None) -> DataFrame:
    """Figures of the first ``samples`` lines in pieces."""
    from wirelake.operators.stats import eval_stats

    first = lines.where(F.trim(column) != "").orderBy(order or column).limit(samples)
    pieces = first.select(F.size(F.split(F.trim(column), "\\s+")).alias("tokens"), encode(F.col(column), model).alias("pieces"))
    return eval_stats(pieces, len(model.pieces), samples)


def sample_encodings(lines: DataFrame, model: Model, column: str = "sentence", n: int = 10) -> DataFrame:
    """The first lines with their pieces, both shortened for display."""
    first = lines.orderBy(column).limit(n).select(column, encode(F.col(column), model).alias("p"))
    shown = F.concat(F.left(F.col(column), F.lit(100)), F.when(F.length(column) > 100, F.lit("...")).otherwise(F.lit("")))
    return first.select(shown.alias("text"), F.size("p").alias("num_pieces"), F.slice("p", 1, 20).alias("pieces"))
