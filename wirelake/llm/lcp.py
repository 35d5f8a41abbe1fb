"""Document fingerprints by locally consistent parsing."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import code_points, texts_in_chunks, with_fields

#: Levels whose phrase names are kept, lowest first; a phrase of level n spans about 2.6 ** n characters.
LEVELS = (2, 3, 4)
#: Bins of the sketch of one level, and bits of a bin.
BINS = 64
#: A level says how alike two texts are if both have so many filled bins.
ENOUGH = 12
#: Documents of a range of neighbouring ids, ranges at most, and shuffle partitions for them at most.
GROUP, RANGES, MOST_TASKS = 2048, 65_536, 20_000
_EMPTY = 0


def _scatter(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def coin_toss(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of deterministic coin tossing: twice the lowest bit at which a label differs from the one before it, plus its own bit there.

    Neighbours' labels differ before and after. At a text's first symbol (``first``) the label before counts as its complement in bit 0.
    """
    before = np.empty_like(labels)
    before[1:] = labels[:-1]
    before[first] = labels[first] ^ labels.dtype.type(1)
    differ = labels ^ before
    low = differ & (~differ + labels.dtype.type(1))
    place = np.bitwise_count(low - labels.dtype.type(1))
    own = ((labels & low) != 0).astype(np.uint8)
    return place * np.uint8(2) + own


def parse(names: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of one level of all texts: their names and owners.

    Runs of one symbol become a symbol first, so that neighbours differ; three rounds of coin tossing bring the labels
    down to a few; a phrase starts at each local maximum of the labels. Where it starts depends on a bounded
    neighbourhood only. A name is a hash of the phrase's symbols in order.
    """
    n = len(names)
    if not n:
        return names, owner
    new = np.ones(n, bool)
    new[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, n)).astype(np.uint64)
    symbols, owner = names[at], owner[at]
    with np.errstate(over="ignore"):
        symbols = np.where(runs > 1, _scatter(symbols + runs * np.uint64(0x632BE59BD9B4E019)), symbols)
        first = np.ones(len(symbols), bool)
        first[1:] = owner[1:] != owner[:-1]
        # equal neighbours can only come of a hash collision of runs; they are told apart by parity of place
        labels = coin_toss(_scatter(symbols), first)
        for _ in range(2):
            labels = coin_toss(labels, first)
        left, right = np.empty_like(labels), np.empty_like(labels)
        left[1:], right[:-1] = labels[:-1], labels[1:]
        left[first] = 255
        last = np.append(first[1:], True)
        right[last] = 0
        start = ((labels > left) & (labels >= right)) | first
        begins = np.flatnonzero(start)
        place = np.arange(len(symbols)) - np.repeat(begins, np.diff(np.append(begins, len(symbols))))
        mixed = _scatter(symbols + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
        return _scatter(np.add.reduceat(mixed, begins)), owner[begins]


def sketches(texts: list[str]) -> np.ndarray:
    """[text, level, bin]: for each level, the least name of each bin, folded to 16 bits; 0 for an empty bin."""
    points, first = code_points(texts, 0x110000)
    owner = np.repeat(np.arange(len(texts)), np.diff(np.append(first, len(points))))
    inner = points != 0x110000
    names, owner = points[inner].astype(np.uint64), owner[inner]
    out = np.zeros((len(texts), len(LEVELS), BINS), np.uint16)
    for level in range(1, LEVELS[-1] + 1):
        names, owner = parse(names, owner)
        if level in LEVELS and len(names):
            with np.errstate(over="ignore"):
                spread = _scatter(names ^ np.uint64(level))
            at = owner * BINS + (spread >> np.uint64(58)).astype(np.int64)
            best = np.full(len(texts) * BINS, np.iinfo(np.uint64).max)
            np.minimum.at(best, at, spread & np.uint64((1 << 58) - 1))
            folded = (best % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
            folded[best == np.iinfo(np.uint64).max] = _EMPTY
            out[:, LEVELS.index(level)] = folded.reshape(len(texts), BINS)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bins among those that either fingerprint fills, from the highest level with enough bins; 0 to 1.

    Texts too short for any level are alike if their fingerprints are equal.
    """
    filled = (a != _EMPTY) | (b != _EMPTY)
    equal = ((a == b) & filled).sum(axis=2)
    total = filled.sum(axis=2)
    each = equal / np.maximum(1, total)
    fewer = np.minimum((a != _EMPTY).sum(axis=2), (b != _EMPTY).sum(axis=2))
    out = each[:, 0]
    for k in range(1, len(LEVELS)):
        out = np.where(fewer[:, k] >= ENOUGH, each[:, k], out)
    return np.where((a == b).all(axis=(1, 2)), 1.0, out)


def render(sketch: np.ndarray) -> list[str]:
    """Fingerprints as hex: the levels' bins in order, 4 digits each."""
    return [x.astype(">u2").tobytes().hex() for x in sketch]


def fingerprints(docs: DataFrame) -> DataFrame:
    """The documents with ``fingerprint``; equal texts have equal ones, null counts as empty."""
    docs = docs.drop("fingerprint")
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            out = [x for _, texts in texts_in_chunks(batch, at) for x in render(sketches(texts))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "fingerprint"])

    return docs.mapInArrow(run, with_fields(docs.schema, "fingerprint string"))


def order_keys(ids: pa.Array, *more: np.ndarray) -> np.ndarray:
    """Fixed-width byte strings that sort as the documents do: by descending id, null last, then by the other numbers."""
    known = np.asarray(ids.is_valid())
    out = np.zeros((len(ids), 9 + 8 * len(more)), np.uint8)
    out[:, 0] = ~known
    falling = ~np.where(known, np.asarray(ids.fill_null(0)), 0).astype(np.int64)
    for k, x in enumerate((falling, *more)):
        sorted_as = x.view(np.uint64) ^ np.uint64(1 << 63)
        out[:, 1 + 8 * k : 9 + 8 * k] = sorted_as.astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view(f"S{out.shape[1]}").ravel()


def neighbours(docs: DataFrame, group: int = GROUP, most: int = RANGES) -> DataFrame:
    """(p, doc_id, text, extra): the documents in ranges of their order, each sorted within its partition, and one row more.

    The order is by descending doc_id, null last, then by the text's hash, then by place. Ranges begin at drawn rows, one
    of about ``group``, ``most`` at most, so they hold about as many rows whatever the ids are. The first row of each
    range is also the last of the range before it, with extra = true; the first of all that of the last one. Texts are
    moved once.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), F.monotonically_increasing_id().alias("m"), "text")
    keys = keyed.select("doc_id", "t", "m")
    n = max(1, docs.count())
    wanted = max(1, min(most, n // group))
    order = (F.col("doc_id").isNull(), F.desc("doc_id"), F.col("t"), F.col("m"))
    drawn = keys.where(F.pmod(F.xxhash64("m", "t"), F.lit(1 << 30)) < F.lit(round(wanted / n * (1 << 30))))
    begins = keys.orderBy(*order).limit(1).toArrow(), drawn.toArrow()  # about ``most`` rows of 24 bytes
    begins = pa.concat_tables(begins).combine_chunks()
    held = np.unique(order_keys(begins.column("doc_id").combine_chunks(), *(begins.column(c).to_numpy().astype(np.int64) for c in ("t", "m"))))
    shared = spark.sparkContext.broadcast(held)

    @F.arrow_udf("long")
    def place(doc_id: pa.Array, t: pa.Array, m: pa.Array) -> pa.Array:
        """Twice the range, and one more for its first row."""
        begins = shared.value
        own = order_keys(doc_id, np.asarray(t), np.asarray(m))
        p = np.searchsorted(begins, own, "right") - 1
        return pa.array(p * 2 + (begins[p] == own))

    placed = keyed.withColumn("at", place("doc_id", "t", "m"))
    p = F.shiftright("at", 1)
    ranges = max(1, len(held))
    before = F.pmod(p - 1, F.lit(ranges))
    one = F.array(F.struct(p.alias("p"), F.lit(False).alias("extra")))
    two = F.concat(one, F.array(F.struct(before.alias("p"), F.lit(True).alias("extra"))))
    both = placed.withColumn("x", F.explode(F.when(F.col("at") % 2 == 1, two).otherwise(one))).select("x.p", "x.extra", "doc_id", "t", "m", "text")
    # sorted and read as a stream: a range may be larger than a task's memory
    parts = min(MOST_TASKS, ranges)
    return both.repartitionById(parts, F.pmod("p", F.lit(parts)).cast("int")).sortWithinPartitions("p", "extra", *order).select("p", "doc_id", "text", "extra")


def edited(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    In the edited text the last third of the code points gives way to the first as many of the next document. A null
    text counts as empty and a null doc_id comes last. Rows that share a doc_id follow each other by the hash of their
    text, equal ones anyhow. One document alone is its own next. An empty table gives an empty result; other columns are
    not read.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [c.split()[0] for c in schema.split(", ")]

    def part(rows):
        """Of rows (range, id, text, extra) in order: all but the last and the extra ones."""
        at = [k for k, r in enumerate(rows[:-1]) if not r[3]]
        texts = [r[2] for r in rows]
        changed = [texts[k][: len(texts[k]) - len(texts[k]) // 3] + texts[k + 1][: len(texts[k]) // 3] for k in at]
        each, b = sketches(texts), sketches(changed)
        a, following = each[at], each[[k + 1 for k in at]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[k][1] for k in at], pa.int64()),
                pa.array([len(texts[k]) for k in at], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
                pa.array(render(a), pa.string()),
                pa.array(render(b), pa.string()),
                pa.array(likeness(a, b), pa.float64()),
                pa.array(likeness(a, following), pa.float64()),
            ],
            names=names,
        )

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in (0, 1)), batch.column(2), batch.column(3).to_pylist(), strict=True):
                row = (*row[:2], row[2].as_py() or "", row[3])
                held.append(row)
                size += len(row[2]) * 2
                if size > 1_000_000 and len(held) > 1:
                    yield part(held)
                    held, size = [row], len(row[2])
        if len(held) > 1:
            yield part(held)

    return neighbours(docs, group).mapInArrow(run, schema)
