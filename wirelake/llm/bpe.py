"""Byte-level BPE encoding and decoding with boundaries found by transition-function scans."""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import code_points, giving_back, texts_in_chunks, with_fields

#: A code point past Unicode marks the end of a text.
END_POINT = 0x110000
#: Pieces whose ids are kept in one worker process.
CACHE = 200_000
#: Characters whose texts are encoded together.
TOGETHER = 400_000
#: A piece up to this many bytes is merged by rescanning, a longer one with a heap.
SHORT = 48
#: Lanes advance together in the scan; each has this many code points.
STRIDE = 256

# Kinds of code points, looking ahead by two: what the scan reads.
END, LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, LEAD, INNER, LAST = range(9)
# What the piece so far is, before the next code point.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_LEAD, IN_SPACE, ONE_LEFT, TWO_LEFT = range(8)
# White_Space of Unicode.
SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def point_classes() -> np.ndarray:
    """LETTER, NUMBER, INNER (any white space), OTHER or END of each code point."""
    of = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(END_POINT)), np.uint8, END_POINT)
    table[SPACES] = INNER
    return np.append(table, np.uint8(END))


def step(state: int, kind: int) -> tuple[int, bool]:
    """The state after a code point of this kind, and whether a piece starts with it."""
    if kind == END:
        return START, True
    if kind == LAST:
        return START, True
    if kind == LEAD:
        return AFTER_LEAD, True
    if kind == INNER:
        return IN_SPACE, state != IN_SPACE
    if kind == LETTER and state in (ONE_LEFT, TWO_LEFT):
        return (START if state == ONE_LEFT else ONE_LEFT), False
    if kind in (QUOTE1, QUOTE2) and state not in (IN_OTHERS, AFTER_LEAD):
        return (ONE_LEFT if kind == QUOTE1 else TWO_LEFT), True
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS}.get(kind, IN_OTHERS)
    return run, state not in (run, AFTER_LEAD)


@cache
def machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the automaton: next state and start flag by [state, kind]; function number by kind; compositions; images of START."""
    after = np.array([[step(s, k)[0] for k in range(9)] for s in range(8)], np.uint8)
    starts = np.array([[step(s, k)[1] for k in range(9)] for s in range(8)], bool)
    functions = list(dict.fromkeys(tuple(after[:, k].tolist()) for k in range(9)))
    generators = len(functions)
    number = {f: i for i, f in enumerate(functions)}
    for f in functions:  # the list grows until it is closed under composition with the generators
        for g in functions[:generators]:
            h = tuple(g[x] for x in f)
            if h not in number:
                number[h] = len(functions)
                functions.append(h)
    composed = np.array([[number[tuple(g[x] for x in f)] for g in functions] for f in functions], np.int32)
    by_kind = np.array([number[tuple(after[:, k].tolist())] for k in range(9)], np.int32)
    return after, starts, by_kind, composed, np.array(functions, np.uint8)


def kinds(points: np.ndarray) -> np.ndarray:
    """The kind of each code point; the last ones are taken to stand before the end of a text."""
    c = point_classes()[points]
    following = np.append(c[1:], np.uint8(END))
    before_word = (following != INNER) & (following != END)
    space = c == INNER
    out = c.copy()
    out[space & before_word & (points == 0x20)] = LEAD
    out[space & before_word & (points != 0x20)] = LAST
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        far = np.append(points, [END_POINT, END_POINT])
        one, two = far[quotes + 1], far[quotes + 2]
        short = np.isin(one, [ord(x) for x in "stmd"])
        long_ = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        out[quotes[short]] = QUOTE1
        out[quotes[long_]] = QUOTE2
    return out


def piece_starts(points: np.ndarray) -> np.ndarray:
    """Where the pieces of the pattern start, END_POINTs included as pieces of their own.

    Three phases of a parallel prefix: the transition functions of each lane are composed, the lanes' functions are
    scanned, and with the state at each lane's start known, all lanes run at once.
    """
    after, starts, by_kind, composed, images = machine()
    n = len(points)
    lanes = -(-n // STRIDE)
    padded = np.full(lanes * STRIDE, END, np.uint8)
    padded[:n] = kinds(points)
    columns = np.ascontiguousarray(padded.reshape(lanes, STRIDE).T)
    f = by_kind[columns[0]]
    for k in columns[1:]:
        f = composed[f, by_kind[k]]
    state, entering = START, np.empty(lanes, np.uint8)
    for lane, g in enumerate(f.tolist()):
        entering[lane] = state
        state = images[g][state]
    s, flags = entering, np.empty((STRIDE, lanes), bool)
    flat_after, flat_starts = after.ravel(), starts.ravel()
    for i, k in enumerate(columns):
        at = s * np.uint8(9) + k
        flags[i] = flat_starts[at]
        s = flat_after[at]
    return np.flatnonzero(flags.T.ravel()[:n])


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of lowest rank is merged, leftmost first, until none is in the vocabulary."""
    if piece in rank:
        return [rank[piece]]
    if len(piece) <= SHORT:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        none = len(rank) + 1
        scores = [rank.get(piece[i : i + 2], none) for i in range(len(parts) - 1)]
        while scores:
            low = min(scores)
            if low == none:
                break
            i = scores.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = rank.get(parts[i] + parts[i + 1], none)
            if i:
                scores[i - 1] = rank.get(parts[i - 1] + parts[i], none)
        return [rank[p] for p in parts]
    ends = list(range(1, len(piece) + 1))  # of the part that starts here; 0: it was merged away
    before = list(range(-1, len(piece) - 1))
    heap = [(rank[piece[i : i + 2]], i, i + 1, i + 2) for i in range(len(piece) - 1) if piece[i : i + 2] in rank]
    heapq.heapify(heap)

    def propose(i):
        j = ends[i]
        if j < len(piece) and (r := rank.get(piece[i : ends[j]])) is not None:
            heapq.heappush(heap, (r, i, j, ends[j]))

    while heap:
        _, i, j, k = heapq.heappop(heap)
        if ends[i] != j or j >= len(piece) or ends[j] != k:
            continue
        ends[i], ends[j] = k, 0
        if k < len(piece):
            before[k] = i
            propose(i)
        if before[i] >= 0:
            propose(before[i])
    out, i = [], 0
    while i < len(piece):
        out.append(rank[piece[i : ends[i]]])
        i = ends[i]
    return out


class Coder:
    """Encoder and decoder of one vocabulary, with the ids of pieces met before."""

    def __init__(self, path: str):
        self.rank = ranks(path)
        tokens = sorted(self.rank.items(), key=lambda x: x[1])
        self.size = tokens[-1][1] + 1
        self.lengths = np.zeros(self.size, np.int64)
        self.lengths[[r for _, r in tokens]] = [len(t) for t, _ in tokens]
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(t for t, _ in tokens), np.uint8)
        self.forget()

    def forget(self):
        self.flat, self.first, self.count = array("I"), array("q"), array("q")
        coder = self

        class Pieces(dict):
            def __missing__(self, piece):
                ids = merge(piece, coder.rank)
                coder.first.append(len(coder.flat))
                coder.count.append(len(ids))
                coder.flat.extend(ids)
                self[piece] = out = len(coder.first) - 1
                return out

        self.pieces = Pieces()

    def ids_of(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each piece has."""
        if len(self.pieces) > CACHE:
            self.forget()
        at = np.fromiter(map(self.pieces.__getitem__, pieces), np.int64, len(pieces))
        first, count, flat = (np.array(x, t) for x, t in ((self.first, np.int64), (self.count, np.int64), (self.flat, np.uint32)))
        return spread(flat, first[at], count[at]), count[at]

    def decode(self, ids: np.ndarray) -> bytes:
        return spread(self.bytes, self.offsets[ids], self.lengths[ids]).tobytes()

    def windows(self, texts: list[str], window: int = 1_000_000):
        """(text number, ids, bytes of each id) of the texts in order; a very long text comes in several windows."""
        if len(texts) == 1 and len(texts[0]) > window:
            yield from ((0, ids, sizes) for ids, sizes in self._long(texts[0], window))
            return
        points, first = code_points(texts, END_POINT)
        at = piece_starts(points)
        at, owner = at[points[at] != END_POINT], None
        owner = np.searchsorted(first, at, "right") - 1
        ids, count = self._encode(points, at, first)
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        edges = np.concatenate(([0], np.cumsum(count)))[cuts]
        for k in range(len(texts)):
            mine = ids[edges[k] : edges[k + 1]]
            yield k, mine, self.lengths[mine]

    def _encode(self, points, at, first):
        width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        ends_here = points == END_POINT
        width[ends_here] = 0
        place = np.cumsum(width, dtype=np.int64)
        place = np.concatenate(([0], place))
        text = points[~ends_here].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        cuts = place[at].tolist()
        cuts.append(len(text))
        return self.ids_of([text[a:b] for a, b in zip(cuts, cuts[1:])])

    def _long(self, text, window):
        """Pieces that start before the last two code points of a window are final; the rest goes to the next one."""
        begin, size = 0, window
        while begin < len(text):
            part = text[begin : begin + size]
            final = begin + len(part) >= len(text)
            points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
            at = piece_starts(points)
            if not final:
                sure = at[at <= len(points) - 3]
                if len(sure) < 2:
                    size *= 2
                    continue
                points, at = points[: sure[-1]], sure[:-1]
            ids, _ = self._encode(points, at, None)
            yield ids, self.lengths[ids]
            begin, size = begin + len(points), window


def spread(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """values[first : first + count] of all pairs, one after another."""
    total = int(count.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(count)
    at = np.repeat(first - (ends - count), count)
    at += np.arange(total)
    return values[at]


@cache
def coder(path: str) -> Coder:
    return Coder(path)


def _each(batches, path):
    """(row of the batch, batch, ids, bytes of each id) by window, and a None at the end of each text."""
    own = coder(path)
    for batch in batches:
        for first, texts in texts_in_chunks(batch):
            last = 0
            for k, ids, sizes in own.windows(texts):
                while last < k:
                    yield batch, first + last, None, None
                    last += 1
                yield batch, first + k, ids, sizes
            while last < len(texts):
                yield batch, first + last, None, None
                last += 1


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document.

    The text is encoded, and the ids decoded again. A null text counts as empty (no ids); repeated rows come back as
    often as they are there; columns other than doc_id and text are not read; an empty table gives an empty result.
    """

    def run(batches):
        last, out = None, ([], [], [], [])

        def record():
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        own = coder(path)
        n, a, b = 0, hashlib.sha256(), hashlib.sha256()
        for batch, row, ids, _ in _each(batches, path):
            if last is not None and batch is not last and out[0]:
                yield record()
                out = ([], [], [], [])
            last = batch
            if ids is not None:
                n += len(ids)
                a.update(ids.astype("<u4").tobytes())
                b.update(own.decode(ids))
                continue
            for x, y in zip(out, (batch.column(0)[row].as_py(), n, a.hexdigest(), b.hexdigest()), strict=True):
                x.append(y)
            n, a, b = 0, hashlib.sha256(), hashlib.sha256()
        if out[0]:
            yield record()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """The documents with ``ids`` and ``ends`` (the byte offset in the UTF-8 text after each id), by the vocabulary at ``path``.

    Any columns of those names are replaced. A null text counts as empty: both arrays are empty.
    """
    kept = [c for c in docs.columns if c not in ("ids", "ends")]
    at = kept.index("text")
    schema = with_fields(docs.select(*kept).schema, "ids array<int>, ends array<long>")

    def run(batches):
        own = coder(path)
        for batch in giving_back(batches):
            for first, texts in texts_in_chunks(batch, at, TOGETHER):
                ids, sizes, counts = [], [], np.zeros(len(texts), np.int64)
                for k, i, s in own.windows(texts):
                    ids.append(i)
                    sizes.append(s)
                    counts[k] += len(i)
                flat = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)
                ends = np.cumsum(np.concatenate([*sizes, np.zeros(0, np.int64)]))
                offsets = np.concatenate(([0], np.cumsum(counts)))
                before = np.concatenate(([0], ends))[offsets[:-1]]
                ends = ends - np.repeat(before, counts)
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x)) for x in (flat, ends)]
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, *lists], names=[*kept, "ids", "ends"])

    return docs.select(*kept).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows with ``data``: the bytes that their ``ids`` stand for; null for null ids."""

    def run(batches):
        own = coder(path)
        for batch in batches:
            data = [None if x is None else own.decode(np.array(x, np.int64)) for x in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], names=[*batch.schema.names, "data"])

    kept = encoded.drop("data")
    return kept.mapInArrow(run, with_fields(kept.schema, "data binary"))
