"""Language-model scores by a hidden Markov model over words."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import Scratch, ascii_lower, fold

#: Hidden states; words with an emission probability of their own, at most: all whose count reaches a limit, 2 at least. Steps of the limit in a doubling.
STATES, VOCABULARY, STEPS = 16, 65_536, 64
#: Most frequent words that the start tells apart in its counts of neighbours; passes over these on the driver. Then passes over all training documents.
START_WORDS, START_PASSES, PASSES = 1022, 60, 2
#: Words of one training sequence, sequences of a step.
LENGTH, LANES = 256, 256
#: Occurrences of each word that are dealt to the states by their overall shares; weight of the words' overall shares in each state; count added to each move.
EVEN, SMOOTH, MOVE_SMOOTH = 2.0, 20.0, 1.0
#: Taken off each rare word's count for words never met.
DISCOUNT = 0.75
#: Words that one task counts before it hands the counts on.
COUNTED = 400_000
#: Words read together.
CHUNK = 400_000
_PARTS = ["doc_id", "t", "word", "times", "n_tokens", "known", "base", "score"]


@dataclass
class Parameters:
    """A model: words have the numbers 0 to V - 1, all other words V, the end of a text V + 1."""

    start: np.ndarray  # [state]
    moves: np.ndarray  # [from, to]
    emit: np.ndarray  # [symbol, state]


def symbols(docs: list[list[bytes]], number: dict[bytes, int], size: int) -> np.ndarray:
    """All words and ends as numbers, text after text."""
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    out = np.full(int(sizes.sum()) + len(docs), size + 1, np.int32)
    is_word = np.ones(len(out), bool)
    is_word[np.cumsum(sizes + 1) - 1] = False
    out[is_word] = np.fromiter(map(number.get, chain.from_iterable(docs), repeat(size)), np.int32, int(sizes.sum()))
    return out


def expected(stream: np.ndarray, p: Parameters, into: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """Adds the expected counts of starts, moves and emissions in a stream of whole texts, by scaled forward-backward.

    The stream is cut into sequences of LENGTH words that are run side by side. One that starts within a text has the
    states' overall shares before it, which aren't counted as starts.
    """
    fresh = np.ones(len(stream), bool)
    fresh[1:] = stream[:-1] == len(p.emit) - 1
    for k in range(0, len(stream), LENGTH * LANES):
        part, new = stream[k : k + LENGTH * LANES], fresh[k : k + LENGTH * LANES]
        whole = len(part) // LENGTH * LENGTH
        for a, b, length in ((0, whole, LENGTH), (whole, len(part), len(part) - whole)):
            if b > a:
                _expected(part[a:b].reshape(-1, length).T, new[a:b].reshape(-1, length).T, p, into)


def _expected(obs, fresh, p, into):
    starts, moves, emissions = into
    length, lanes = obs.shape
    states = len(p.start)
    share = np.linalg.matrix_power(p.moves, 64)[0]
    e = p.emit[obs]
    ahead = np.empty((length, lanes, states))
    # the lanes in which a text begins, by step
    step, lane = np.nonzero(fresh)
    first = np.searchsorted(step, np.arange(length + 1))
    begins = [lane[a:b] for a, b in zip(first, first[1:])]
    ones = np.ones(states)
    for t in range(length):
        a = ahead[t]
        if t:
            np.matmul(ahead[t - 1], p.moves, out=a)
        else:
            a[:] = share
        if len(begins[t]):
            a[begins[t]] = p.start
        a *= e[t]
        # a sum of each row; what follows needs e only as scaled
        scale = (1 / (a @ ones))[:, None]
        a *= scale
        e[t] *= scale
    # messages back: those before a text's first word are ones, and no move leads there; what is ahead turns into the
    # shares of the states, which sum to one as they are: either side is scaled by the same
    back = np.ones((lanes, states))
    against = p.moves.T.copy()
    moved = np.zeros((states, states))
    for t in range(length - 1, 0, -1):
        q = e[t]
        q *= back
        if len(begins[t]):
            q[begins[t]] = 0
        moved += ahead[t - 1].T @ q
        ahead[t] *= back
        np.matmul(q, against, out=back)
        if len(begins[t]):
            back[begins[t]] = 1
    ahead[0] *= back
    moves += moved * p.moves
    gamma = ahead
    starts += gamma[fresh].sum(axis=0)
    flat, g = obs.ravel(), gamma.reshape(-1, states)
    order = np.argsort(flat)
    at = flat[order]
    edge = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    emissions[at[edge]] += np.add.reduceat(g[order], edge, axis=0)


def counts_of(p: Parameters):
    return np.zeros(len(p.start)), np.zeros_like(p.moves), np.zeros_like(p.emit)


def maximise(counts, overall: np.ndarray) -> Parameters:
    """The model of expected counts, smoothed with the symbols' overall shares."""
    starts, moves, emissions = counts
    states = len(starts)
    start = (starts + 1 / states) / (starts.sum() + 1)
    moves = (moves + MOVE_SMOOTH) / (moves.sum(axis=1, keepdims=True) + MOVE_SMOOTH * states)
    of_word, of_state = emissions.sum(axis=1, keepdims=True), emissions.sum(axis=0)
    emissions = of_word * (emissions + EVEN * of_state / max(1e-9, of_state.sum())) / (of_word + EVEN)
    emit = (emissions + SMOOTH * overall[:, None]) / (emissions.sum(axis=0) + SMOOTH)
    return Parameters(start, moves, emit)


def first_guess(overall: np.ndarray, stream: np.ndarray, passes: int = 0, states: int = STATES) -> Parameters:
    """A random start with states that tend to stay, and Baum-Welch passes over a small stream."""
    rng = np.random.default_rng(4)
    emit = overall[:, None] * rng.gamma(1.0, 1.0, (len(overall), states))
    moves = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
    p = Parameters(np.full(states, 1 / states), moves, emit / emit.sum(axis=0))
    for _ in range(passes):
        c = counts_of(p)
        expected(stream, p, c)
        p = maximise(c, overall)
    return p


def log10_likelihoods(stream: np.ndarray, lengths: np.ndarray, p: Parameters) -> np.ndarray:
    """Exact log10 probability of each whole text (its numbers, end included) by the scaled forward recursion, longest texts first."""
    first = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    at0, long_ = first[order], lengths[order]
    steps = int(long_[0]) if len(long_) else 0
    active = np.searchsorted(-long_, -np.arange(steps), "left")
    scale = np.ones(len(stream))
    a = None
    for t in range(steps):
        n = active[t]
        at = at0[:n] + t
        a = (a[:n] @ p.moves if t else p.start[None, :]) * p.emit[stream[at]]
        s = a.sum(axis=1)
        scale[at] = s
        a /= s[:, None]
    return np.add.reduceat(np.log10(scale), first) if len(lengths) else np.zeros(0)


def _split(batch: pa.RecordBatch, column: int):
    """(first row, words of each text) by chunks of about CHUNK words."""
    first, docs, size = 0, [], 0
    for row, t in enumerate(batch.column(column)):
        w = ascii_lower(t.as_py()).split()
        docs.append(w)
        size += len(w)
        if size >= CHUNK:
            yield first, docs
            first, docs, size = row + 1, [], 0
    if docs:
        yield first, docs


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of the texts as UTF-8 with A-Z lower-cased; the empty word counts the ends."""

    def run(batches):
        def record():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                counts.update(ascii_lower(t.as_py()).split())
                counts[b""] += 1
                if len(counts) > COUNTED:
                    yield record()
        if counts:
            yield record()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, most: int = VOCABULARY) -> list[tuple[bytes, int]]:
    """The words with emissions of their own and their counts, most frequent first; all others are rare words.

    All words whose count reaches a limit: the least one, of 2 or more, that at most ``most`` words reach.
    """
    words = counts.where(F.octet_length("word") > 0)
    rank = F.floor(F.log2("n") * STEPS)
    least, above = STEPS, 0
    # from a histogram of some thousand rows; a word met once is always a rare one: that gives words never met their share
    for r in sorted(words.groupBy(rank.alias("rank")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r["rank"]):
        above += r.k
        if above > most:
            least = max(least, r["rank"] + 1)
            break
    return sorted(((bytes(r.word), r.n) for r in words.where(rank >= least).collect()), key=lambda x: (-x[1], x[0]))


def numbered(training: DataFrame, names) -> DataFrame:
    """(stream): the numbers of each text's words and its end, as 32-bit numbers; a table that has these is left as it is."""
    if training.columns == ["stream"]:
        return training

    def run(batches):
        number, size = names.value
        for batch in batches:
            for _, docs in _split(batch, 0):
                ends = np.cumsum(np.fromiter((4 * len(d) + 4 for d in docs), np.int32, len(docs)), dtype=np.int32)
                buffers = [None, pa.py_buffer(np.concatenate((np.zeros(1, np.int32), ends))), pa.py_buffer(symbols(docs, number, size))]
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(docs), buffers)], names=["stream"])

    return training.select("text").mapInArrow(run, "stream binary")


def _streams(batch: pa.RecordBatch):
    """The numbers of whole texts (``numbered``), about CHUNK at once."""
    texts = batch.column(0)
    ends = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
    first = 0
    while first < len(ends):
        last = min(len(ends), int(np.searchsorted(ends, (ends[first - 1] if first else 0) + 4 * CHUNK)) + 1)
        yield np.frombuffer(b"".join(texts.slice(first, last - first).to_pylist()), np.int32)
        first = last


def neighbours(training: DataFrame, names, coarse: int) -> np.ndarray:
    """Counts [before, after] of all neighbouring symbols of all training texts, which may be ``numbered``. Words from ``coarse`` on are one symbol; the first of a text follows an end."""
    width = coarse + 2

    def run(batches):
        size = names.value[1]
        counts = np.zeros(width * width, np.int64)
        for batch in batches:
            for stream in _streams(batch):
                after = np.where(stream == size + 1, coarse + 1, np.minimum(stream, coarse)).astype(np.int64)
                # every chunk ends with an end
                before = np.concatenate(([coarse + 1], after[:-1]))
                counts += np.bincount(before * width + after, minlength=width * width)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], names=["pair", "n"])

    table = numbered(training, names).mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # width * width rows at most
    out = np.zeros(width * width)
    out[table["pair"].to_numpy(np.int64)] = table["n"].to_numpy(np.float64)
    return out.reshape(width, width)


def from_neighbours(pairs: np.ndarray, overall: np.ndarray, passes: int = START_PASSES, states: int = STATES) -> Parameters:
    """The model that raises the likelihood of counts of neighbours [before, after], the end last, by expectation-maximisation."""
    p = first_guess(overall, np.zeros(0, np.int32), 0, states)
    firsts, pairs = pairs[-1], pairs[:-1]
    share = np.full(states, 1 / states)
    for _ in range(passes):
        left = p.emit[:-1] * share
        moved = left @ p.moves
        ratio = pairs / np.maximum(moved @ p.emit.T, 1e-300)
        right = ratio @ p.emit
        begin = p.emit * p.start
        begin *= (firsts / np.maximum(begin.sum(axis=1), 1e-300))[:, None]
        counts = begin.sum(axis=0), p.moves * (left.T @ right), p.emit * (ratio.T @ moved) + begin
        of_state = (left * (right @ p.moves.T)).sum(axis=0)
        share = (of_state + 1 / states) / (of_state.sum() + 1)
        p = maximise(counts, overall)
    return p


def start(training: DataFrame, names, overall: np.ndarray, most: int = START_WORDS) -> Parameters:
    """A start from the counts of neighbours of all training texts; words from ``most`` on have one distribution over the states."""
    coarse = min(most, len(overall) - 2)
    rest = overall[coarse:-1]
    p = from_neighbours(neighbours(training, names, coarse), np.array([*overall[:coarse], rest.sum(), overall[-1]]))
    p.emit = np.concatenate((p.emit[:coarse], p.emit[coarse] * (rest / rest.sum())[:, None], p.emit[-1:]))
    return p


def baum_welch(training: DataFrame, p: Parameters, names, overall: np.ndarray) -> Parameters:
    """One pass over all training texts, which may be ``numbered``: each task's expected counts, added up, and the model that they give.

    At most VOCABULARY + STATES + 3 rows of STATES numbers leave a task, and as many reach the driver.
    """
    spark = training.sparkSession
    columns = [f"g{k}" for k in range(STATES)]
    model = spark.sparkContext.broadcast(p)  # (VOCABULARY + 2) * STATES numbers

    def run(batches):
        into = counts_of(model.value)
        for batch in batches:
            for stream in _streams(batch):
                expected(stream, model.value, into)
        starts, moves, emissions = into
        at = np.flatnonzero(emissions.any(axis=1))
        table = np.concatenate((emissions[at], moves, starts[None, :]))
        keys = np.concatenate((at, -2 - np.arange(STATES), [-1]))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array(np.ascontiguousarray(table[:, k]).astype(np.float32)) for k in range(STATES))], names=["sym", *columns])

    schema = "sym int, " + ", ".join(f"{c} float" for c in columns)
    table = numbered(training, names).mapInArrow(run, schema).groupBy("sym").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
    c = counts_of(p)
    values = table[columns].to_numpy(np.float64)
    sym = table["sym"].to_numpy()
    for into, mask, at in ((c[2], sym >= 0, sym), (c[1], sym <= -2, -2 - sym), (c[0][None, :], sym == -1, 0 * sym)):
        into[at[mask]] = values[mask]
    return maximise(c, overall)


@dataclass
class Model:
    """Of a training corpus: counts of all its words (a table), the frequent words with theirs, totals, and the hidden Markov model."""

    counts: DataFrame
    top: list[tuple[bytes, int]]
    n_all: int
    v_all: int
    n_ends: int
    p: Parameters

    @property
    def rare(self) -> tuple[int, int]:
        """Occurrences and number of the rare words."""
        return self.n_all - self.n_ends - sum(n for _, n in self.top), max(0, self.v_all - len(self.top) - bool(self.n_ends))

    def base(self, count):
        return np.log10((np.asarray(count, float) + 0.5) / (self.n_all + 0.5 * (self.v_all + 1)))


def fit(training: DataFrame, passes: int = PASSES) -> Model:
    """The model of all training texts: a start from their counts of neighbours, then passes over all of them."""
    spark = training.sparkSession
    scratch = Scratch(spark, "hmm")
    counts = scratch.table(word_counts(training), "counts")
    total = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    ends = counts.where(F.octet_length("word") == 0).first()
    model = Model(counts, vocabulary(counts), int(total.n), int(total.v), int(ends.n) if ends else 0, None)
    number, size = {w: i for i, (w, _) in enumerate(model.top)}, len(model.top)
    overall = np.array([*(n for _, n in model.top), model.rare[0] + 0.5, model.n_ends + 0.5], np.float64)
    overall /= overall.sum()
    names = spark.sparkContext.broadcast((number, size))  # VOCABULARY words
    # texts are split and looked up once; what training reads again and again are numbers
    streams = scratch.table(numbered(training, names), "streams")
    model.p = start(streams, names, overall)
    for _ in range(passes):
        model.p = baum_welch(streams, model.p, names, overall)
    scratch.drop("streams")
    return model


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every document.

    A text's tokens are its words and one end; all words never met in training are one word, as in the base. score is
    the log10 probability of the text under the hidden Markov model: the frequent words and the end are emitted
    themselves; any other word is emitted as a rare word, and which one it is has a probability that doesn't depend on
    the state: its count less DISCOUNT among the rare words, and what the discounts leave for the words never met. So
    the probabilities of all tokens sum to one in each state, the forward recursion over a bounded vocabulary is exact,
    and the rare words' share comes from a join. base_score is that of smoothed single words.

    Null texts count as empty (one token, the end); null and repeated doc_ids are kept apart by their texts, and rows
    that share both come back as often as they are there. Without training texts all words are one rare word. An empty
    table gives an empty result. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    n_all, v_all, n_ends = model.n_all, model.v_all, model.n_ends
    rare_n, rare_v = model.rare
    names = spark.sparkContext.broadcast(({w: i for i, (w, _) in enumerate(model.top)}, len(model.top)))
    shared = spark.sparkContext.broadcast(model.p)
    base = spark.sparkContext.broadcast(model.base([*(n for _, n in model.top), 0, n_ends]))

    def forward(batches):
        """Of each text one row for each of its rare words, or one row without; the first has what the frequent words give."""
        number, size = names.value
        p, each = shared.value, base.value
        for batch in batches:
            for begin, docs in _split(batch, 2):
                stream = symbols(docs, number, size)
                lengths = np.fromiter(map(len, docs), np.int64, len(docs)) + 1
                first = np.cumsum(lengths) - lengths
                is_rare = stream == size
                known = ~is_rare & ((stream != size + 1) | (n_ends > 0))
                heads = (lengths, np.add.reduceat(known.astype(np.int64), first), np.add.reduceat(np.where(is_rare, 0.0, each[stream]), first), log10_likelihoods(stream, lengths, p))
                at = np.flatnonzero(is_rare)
                owner = np.searchsorted(first, at, "right") - 1
                rare = [docs[k][i] for k, i in zip(owner.tolist(), (at - first[owner]).tolist(), strict=True)]
                ends = np.searchsorted(owner, np.arange(len(docs) + 1)).tolist()
                lists = [Counter(rare[a:b]) or {None: 0} for a, b in zip(ends, ends[1:])]
                sizes = np.fromiter(map(len, lists), np.int64, len(lists))
                row = np.repeat(np.arange(len(docs)), sizes)
                later = np.ones(len(row), bool)
                later[np.cumsum(sizes) - sizes] = False
                at = pa.array(row + begin)
                words = pa.array([w for c in lists for w in c], pa.binary())
                times = pa.array(np.fromiter((n for c in lists for n in c.values()), np.int32, len(row)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), words, times, *(pa.array(x[row], mask=later) for x in heads)], names=_PARTS)

    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text").mapInArrow(forward, "doc_id long, t long, word binary, times int, n_tokens long, known long, base double, score double")
    # the head of a text is one value that most rows lack
    head = F.when(F.col("n_tokens").isNotNull(), F.struct("n_tokens", "known", "base", "score")).alias("head")
    joined = parts.select("doc_id", "t", "word", "times", head).join(model.counts.withColumnRenamed("n", "c"), "word", "left")
    met, c = F.col("c").isNotNull(), F.coalesce(F.col("c"), F.lit(0)).cast("double")
    fresh = float(np.log10(DISCOUNT * rare_v / rare_n)) if rare_n else 0.0
    which = F.when(met, F.log10((c - DISCOUNT) / float(max(rare_n, 1)))).otherwise(F.lit(fresh))
    one = F.log10((c + 0.5) / (n_all + 0.5 * (v_all + 1)))
    real = F.when(F.col("times") > 0, F.col("times")).otherwise(F.lit(0))

    def both(name, tail):
        return (F.sum(f"head.{name}") + F.sum(tail)).alias(name)

    summed = joined.groupBy("doc_id", "t").agg(
        F.sum("head.n_tokens").alias("n_tokens"),
        both("known", F.when(met, real).otherwise(F.lit(0))),
        both("base", real * one),
        both("score", real * which),
        F.count("head").alias("copies"),
    )
    # equal rows were added up
    return summed.select("doc_id", "n_tokens", "known", "base", "score", "copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select(
        "doc_id",
        F.expr("n_tokens div copies").alias("n_tokens"),
        F.expr("known div copies").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies")).alias("base_score"),
        (F.col("score") / F.col("copies")).alias("score"),
    )


def held_out_scores(docs: DataFrame) -> DataFrame:
    """Scores of all documents by a model of those outside the held-out fold, with ``held_out``."""
    out = scores(docs, fit(docs.where(fold("doc_id", 5) != 1)))
    return out.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
