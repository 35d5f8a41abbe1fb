"""SimHash near-duplicate detection by tiled exact comparison."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wirelake.llm.common import Scratch, ascii_lower, give_back, giving_back, link_roots, release
from wirelake.llm.graph import components

#: Distinct fingerprints in one tile; two tiles and one block of comparisons are what a task holds.
TILE = 65536
BLOCK = 256
#: Most shuffle partitions of the tile pairs.
MOST_TASKS = 20_000
#: Shingles are counted by the last COUNT_BITS bits of their hashes, in COUNT_PARTS rows a task.
COUNT_BITS, COUNT_PARTS = 18, 64
#: Shingles that are counted together, postings and pairs that are looked at together.
COUNTED, TOGETHER = 250_000, 250_000
#: Of a run of more than SMALL_RUN postings that has more than FEW pairs a posting, or a share MANY of its mean size if that
#: is more, or MOST_PAIRS in all, the sets themselves are compared within a task, PART sets or PART_SIZE shingles with as many.
SMALL_RUN, FEW, MANY, MOST_PAIRS = 16, 8, 0.1, 1_000_000
PART, PART_SIZE = 512, 1_000_000
#: Bits by which rows are told that surely are not among wanted ones: 4 MB for each task.
SIEVE_BITS = 1 << 25
#: Bits between the limits by which a task tells whether a pair joins anything.
STEP = 6
#: Words of 64 bits of a set's sketch. Unlike sets of up to some 1,100 shingles are told apart by 8; larger ones are compared in full.
SKETCH = 8


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of all word shingles with repeats; of the whole sequence if there are fewer words, of none without words."""
    words = ascii_lower(text).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 of none."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash over word shingles with repeats; 0 without words."""
    return majority(shingle_hashes(text, shingle))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The different shingle hashes of a text, in order."""
    return np.unique(shingle_hashes(text, shingle))


def set_hash(grams: np.ndarray) -> int:
    """A signed hash of a set of shingles: the number of its node."""
    return xxhash.xxh64_intdigest(grams.tobytes(), 42) - (1 << 63)


def sketch(grams: np.ndarray) -> np.ndarray:
    """SKETCH signed words: of how many shingles the first bits of the hash are a number, odd or even, one bit each.

    Two sketches differ in no more bits than there are shingles that only one of the sets has.
    """
    at = (grams >> np.uint64(64 - (64 * SKETCH - 1).bit_length())).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * SKETCH) & 1).astype(np.uint8)).view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint's bits as a signed long. A null or blank text has 0."""

    def run(batches):
        for batch in giving_back(batches):
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def set_fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, t, node, fp, size, s0, s1 ...) of every row: hashes of the text and of its set of shingles, and the set's fingerprint, size and sketch.

    From each task COUNT_PARTS more rows have (part, counts): how often each value of the last COUNT_BITS bits is met,
    as 32-bit numbers.
    """
    mask, width = np.uint64((1 << COUNT_BITS) - 1), (1 << COUNT_BITS) // COUNT_PARTS
    words = [f"s{k}" for k in range(SKETCH)]
    names = ["doc_id", "t", "node", "fp", "size", *words, "part", "counts"]

    def run(batches):
        counts, held, size = np.zeros(1 << COUNT_BITS, np.int64), [], 0
        for batch in giving_back(batches):
            nodes, fps, sizes = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.uint64), np.empty(batch.num_rows, np.int32)
            sketches = np.empty((SKETCH, batch.num_rows), np.int64)
            for row, t in enumerate(batch.column(2)):
                grams = shingle_set(t.as_py(), shingle)
                nodes[row], fps[row], sizes[row], sketches[:, row] = set_hash(grams), majority(grams), len(grams), sketch(grams)
                held.append(grams & mask)
                size += len(grams)
                if size >= COUNTED:
                    counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=len(counts))
                    held, size = [], 0
            none = pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes), pa.array(fps.view(np.int64)), pa.array(sizes), *map(pa.array, sketches), *none], names=names)
        if held:
            counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=len(counts))
        if counts.any():
            parts = [x.astype(np.int32).tobytes() for x in counts.reshape(-1, width)]
            none = [pa.nulls(COUNT_PARTS, pa.int32() if c == "size" else pa.int64()) for c in names[:-2]]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(COUNT_PARTS), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text").mapInArrow(run, f"doc_id long, t long, node long, fp long, size int, {', '.join(f'{w} long' for w in words)}, part int, counts binary")


def shingle_counts(marked: DataFrame) -> np.ndarray:
    """The counts of all tasks of ``set_fingerprints``, added up: 2 ** COUNT_BITS numbers."""

    def run(table):
        total = sum(np.frombuffer(x.as_py(), np.int32).astype(np.int64) for x in table.column("counts"))
        return pa.table({"part": table.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((COUNT_PARTS, (1 << COUNT_BITS) // COUNT_PARTS), np.int64)
    for r in marked.where("part is not null").select("part", "counts").groupBy("part").applyInArrow(run, "part int, counts binary").collect():
        out[r.part] = np.frombuffer(r.counts, np.int64)
    return out.ravel()


def fits(size_a, at_a, size_b, at_b, least: float):
    """Whether sets of these sizes, whose first common shingle is at these places of their orders, can have a similarity of ``least``."""
    # the sizes' own limit follows: no set shares more than it has
    return np.minimum(size_a - at_a, size_b - at_b) * (1 + least) >= least * (size_a + size_b) - 1e-6


def postings(docs: DataFrame, counts: np.ndarray, least: float, shingle: int) -> DataFrame:
    """(gram, node, place, size): the first shingles of every set, the rarest by ``counts`` first, and their places.

    Of two sets with a similarity of ``least`` the first common shingle is among these of both: after it the smaller part
    that is left out has too few for what they must share. The counts only set an order, which is the same for all sets.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # 2 ** COUNT_BITS numbers
    mask = np.uint64((1 << COUNT_BITS) - 1)
    names = ["gram", "node", "place", "size"]

    def run(batches):
        def record():
            out = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(out[0].view(np.int64)), *map(pa.array, out[1:])], names=names)

        held, total, seen = [], 0, set()
        for batch in giving_back(batches):
            for t in batch.column(0):
                grams = shingle_set(t.as_py(), shingle)
                if not len(grams):
                    continue
                if (node := set_hash(grams)) in seen:
                    continue  # a copy within the task: its postings are there
                seen.add(node)
                n = len(grams) - math.ceil(least * len(grams) - 1e-9) + 1
                first = grams[np.lexsort((grams, shared.value[grams & mask]))[:n]]
                held.append((first, np.full(n, node), np.arange(n, dtype=np.int32), np.full(n, len(grams), np.int32)))
                total += n
                if total >= TOGETHER:
                    yield record()
                    total = 0
                    if len(seen) > TOGETHER:
                        seen.clear()
        if held:
            yield record()

    return docs.select("text").mapInArrow(run, "gram long, node long, place int, size int")


def _whole_runs(batches):
    """Columns of whole runs of one gram, about TOGETHER rows or more at once."""
    held, rows = [], 0
    for batch in giving_back(batches):
        held.append([np.asarray(c) for c in batch.columns])
        rows += batch.num_rows
        if rows < TOGETHER:
            continue
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        held, rows = [[c[cut:] for c in columns]], len(columns[0]) - cut
        if cut:
            yield [c[:cut] for c in columns]
    if rows:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _edges_of(*columns) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values begin and end, for each row."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    begin = np.flatnonzero(new)
    sizes = np.diff(np.append(begin, len(new)))
    return np.repeat(begin, sizes), np.repeat(begin + sizes, sizes)


def shared_postings(found: DataFrame, least: float) -> DataFrame:
    """The postings of grams that several sets have, once each, with ``hub``: the run's smallest node, if that can be similar."""

    def run(batches):
        for gram, node, place, size in _whole_runs(batches):
            once = np.ones(len(gram), bool)
            once[1:] = (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])
            gram, node, place, size = gram[once], node[once], place[once], size[once]
            begin, end = _edges_of(gram)
            several = end - begin > 1
            hub = begin[several]
            gram_, node_, place_, size_ = gram[several], node[several], place[several], size[several]
            none = (node[hub] == node_) | ~fits(size[hub], place[hub], size_, place_, least)
            yield pa.RecordBatch.from_arrays([*map(pa.array, (gram_, node_, place_, size_)), pa.array(node[hub], mask=none)], names=["gram", "node", "place", "size", "hub"])

    return found.repartition("gram").sortWithinPartitions("gram", "node").mapInArrow(run, "gram long, node long, place int, size int, hub long")


def pairs_between(found: DataFrame, least: float, hubs: bool = False, whole: bool = False) -> DataFrame:
    """(u, v): all pairs of postings (gram, group, node, place, size) of one gram but different groups that can be similar. Pairs may repeat.

    With ``hubs`` only those of one node a gram, another for each gram; so they are no more than the postings. With
    ``whole`` there are (gram, parts) too: runs that have many pairs come as their postings instead (v is null), to be
    compared in as many parts. What is returned is then bounded by the postings, not by the square of a run.
    """
    names = ["u", "v", "gram", "parts"] if whole else ["u", "v"]

    def record(*columns):
        return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=names)

    def pairs(node, a, b):
        if len(a):
            x, y = node[a], node[b]
            yield record(np.minimum(x, y), np.maximum(x, y), *((pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32())) if whole else ()))

    def run(batches):
        for gram, group, node, place, size in _whole_runs(batches):
            (_, begin), (start, end) = _edges_of(gram, group), _edges_of(gram)

            def that_fit(a, b):
                keep = fits(size[a], place[a], size[b], place[b], least)
                return a[keep], b[keep]

            def partners(at):
                """(a, b): the rows ``at`` and those that follow their groups, about TOGETHER pairs at once."""
                many = end[at] - begin[at]
                total = np.cumsum(many)
                first = 0
                while first < len(at):
                    last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + TOGETHER, "right")))
                    n = many[first:last]
                    a = np.repeat(at[first:last], n)
                    b = np.repeat(begin[at[first:last]] - (np.cumsum(n) - n), n) + np.arange(len(a))
                    yield that_fit(a, b)
                    first = last

            if hubs:
                with np.errstate(over="ignore"):
                    mixed = (node ^ gram).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                hub = np.lexsort((mixed ^ (mixed >> np.uint64(31)), start))[start]
                other = np.flatnonzero(group != group[hub])
                yield from pairs(node, *that_fit(hub[other], other))
                continue
            large = end - start > SMALL_RUN if whole else np.zeros(len(gram), bool)
            for a, b in partners(np.flatnonzero(~large)):
                yield from pairs(node, a, b)
            for first in np.unique(start[large]).tolist():
                last = int(end[first])
                n, sizes = last - first, int(size[first:last].sum(dtype=np.int64))
                most, held, total = min(n * max(FEW, MANY * sizes / n), MOST_PAIRS), [], 0
                for a, b in partners(np.arange(first, last)):
                    held.append((a, b))
                    total += len(a)
                    if total > most:
                        break
                if total <= most:
                    for a, b in held:
                        yield from pairs(node, a, b)
                    continue
                parts = max(-(-n // PART), -(-sizes // PART_SIZE))
                yield record(node[first:last], pa.nulls(n, pa.int64()), gram[first:last], np.full(n, parts, np.int32))

    return found.repartition("gram").sortWithinPartitions("gram", "group").mapInArrow(run, "u long, v long" + ", gram long, parts int" * whole)


def similar_sets(grams: np.ndarray, sizes: np.ndarray, cut: int | None, least: float) -> np.ndarray:
    """Smallest index linked to each of the sets, whose shingles follow each other, by a Jaccard similarity of ``least``.

    All are compared with each other or, with ``cut``, those before it with the rest. Shingles that many sets have are
    counted by a product of matrices, the others by their postings.
    """
    n, owner = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
    right = 0 if cut is None else cut
    roots = np.arange(n)
    code = np.unique(grams, return_inverse=True)[1]
    frequent = np.bincount(code) > max(16, n / 16)
    column = np.cumsum(frequent) - 1
    at = np.flatnonzero(frequent[code])
    wide, row = column[code[at]], owner[at]
    rare = np.flatnonzero(~frequent[code])
    code, owner = code[rare], owner[rare]
    theirs = np.flatnonzero(owner >= right)
    theirs = theirs[np.argsort(code[theirs], kind="stable")]
    many = np.bincount(code[theirs], minlength=len(frequent))
    begin = np.cumsum(many) - many
    bounds = np.searchsorted(owner, np.arange(n + 1))
    for first in range(0, n if cut is None else cut, BLOCK):
        last = min(first + BLOCK, n if cut is None else cut)
        shared = np.zeros((last - first, n - right), np.float32)
        for low in range(0, int(frequent.sum()), 4096):
            here = (wide >= low) & (wide < low + 4096)
            has = np.zeros((n, 4096), np.float32)
            has[row[here], wide[here] - low] = 1
            shared += has[first:last] @ has[right:].T
        x = bounds[first]
        total = np.cumsum(many[code[x : bounds[last]]])
        while x < bounds[last]:
            done = total[x - bounds[first] - 1] if x > bounds[first] else 0
            y = max(x + 1, bounds[first] + int(np.searchsorted(total, done + TOGETHER, "right")))
            m = many[code[x:y]]
            other = owner[theirs[np.repeat(begin[code[x:y]] - (np.cumsum(m) - m), m) + np.arange(m.sum())]] - right
            np.add.at(shared, (np.repeat(owner[x:y], m) - first, other), 1)
            x = y
        shared = shared.astype(np.float64)
        a, b = np.nonzero(shared >= least * (sizes[first:last, None] + sizes[None, right:] - shared))
        roots = link_roots(n, [(a + first, b + right)], roots)
    return roots


def links_in_runs(runs: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """(u, v): edges that join all similar sets of each run (u, gram, parts) that ``pairs_between`` leaves whole.

    ``held`` has the shingles (node, grams). Each pair of parts is one group, which returns a star for each of its
    components, so no pair is a row. A set is moved once for each part of its runs.
    """
    own = F.pmod(F.xxhash64("u"), "parts").cast("int")
    spread = runs.select("gram", "u", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    keyed = spread.select("gram", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).cast("int").alias("side"), "u")
    keyed = keyed.join(held.withColumnRenamed("node", "u"), "u").select("gram", "a", "b", "side", "u", "grams")

    def run(table):
        table = table.combine_chunks().sort_by([("side", "ascending"), ("u", "ascending")])
        nodes, cut = table.column("u").to_numpy(), int((table.column("side").to_numpy() == 0).sum())
        grams = table.column("grams").combine_chunks()
        sizes = grams.value_lengths().to_numpy().astype(np.int64)
        same = table.column("a")[0].as_py() == table.column("b")[0].as_py()
        roots = np.arange(len(nodes)) if not same and cut in (0, len(nodes)) else similar_sets(grams.flatten().to_numpy(), sizes, None if same else cut, least)
        y = np.flatnonzero(roots != np.arange(len(nodes)))
        give_back()
        return pa.table({"u": nodes[roots[y]], "v": nodes[y]})

    return keyed.groupBy("gram", "a", "b").applyInArrow(run, "u long, v long")


def tile_plan(histogram: dict[int, int], tile: int = TILE) -> list[tuple[int, int, int]]:
    """(lowest, highest population count, shards) of the tiles: neighbouring counts are merged up to ``tile`` rows, larger ones split."""
    plan, low, size = [], None, 0
    for count in sorted(histogram):
        n = histogram[count]
        if low is not None and size + n > tile:
            plan.append((low, count - 1, max(1, -(-size // tile))))
            low, size = None, 0
        low, size = count if low is None else low, size + n
    if low is not None:
        plan.append((low, 64, max(1, -(-size // tile))))
    return plan


def close_pairs(left: np.ndarray, right: np.ndarray | None, first: int, radius: int, done=lambda a, b: False):
    """(a, b, bits) of all pairs of fingerprints [row, word] of one tile or of two, which follow each other, block by block.

    Pairs differ in at most ``first`` bits of the first word and ``radius`` of all. Both sides are sorted by the
    population counts of the first word's 16-bit parts; blocks whose ranges of counts differ by more than ``first`` in
    sum can't hold a pair and are skipped; ``done`` may skip others; all the rest are compared in full.
    """

    def blocks(tile, base):
        parts = np.bitwise_count(np.ascontiguousarray(tile[:, 0]).view(np.uint16).reshape(-1, 4)).astype(np.int16)
        order = np.lexsort((parts[:, 3], parts[:, 2], parts[:, 1], parts[:, 0], parts.sum(axis=1)))
        out = []
        for k in range(0, len(order), BLOCK):
            at = order[k : k + BLOCK]
            p = np.column_stack((parts[at], parts[at].sum(axis=1)))
            out.append((tile[at], at + base, p.min(axis=0), p.max(axis=0)))
        return out

    a = blocks(left, 0)
    b = a if right is None else blocks(right, len(left))
    low, high = np.array([x[2] for x in b]), np.array([x[3] for x in b])
    for i, (bits, at, lo, hi) in enumerate(a):
        gap = np.maximum(0, np.maximum(low - hi, lo - high))
        near = (gap[:, :4].sum(axis=1) <= first) & (gap[:, 4] <= first)
        for j in np.flatnonzero(near):
            if (right is None and j < i) or done(at, b[j][1]):
                continue
            other = b[j][0]
            apart = np.bitwise_count(bits[:, None, 0] ^ other[None, :, 0])
            x, y = np.nonzero(apart <= first)
            if right is None and i == j:
                x, y = x[x < y], y[x < y]
            if not len(x):
                continue
            total = apart[x, y].astype(np.int16)
            for k in range(1, bits.shape[1]):
                total += np.bitwise_count(bits[x, k] ^ other[y, k])
            keep = total <= radius
            if keep.any():
                yield at[x[keep]], b[j][1][y[keep]], total[keep]


def compare(left: np.ndarray, right: np.ndarray | None, radius: int) -> np.ndarray:
    """Smallest index linked to each of the fingerprints left (and right, if it is another tile), which follow each other."""
    left, right = left.reshape(len(left), -1), None if right is None else right.reshape(len(right), -1)
    n = len(left) + (0 if right is None else len(right))
    roots = np.arange(n)

    def joined(a, b):
        return (roots[a] == roots[a[0]]).all() and (roots[b] == roots[a[0]]).all()

    for x, y, _ in close_pairs(left, right, radius, radius, joined):
        roots = link_roots(n, [(x, y)], roots)
    return roots


def forest(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Edges (as indices) of a lightest spanning forest of n nodes: each tree takes its lightest edge to another until none is left."""
    order = np.lexsort((b, a, weight))
    a, b = a[order], b[order]
    roots, kept, live = np.arange(n), [], np.arange(len(order))
    while len(live):
        ra, rb = roots[a[live]], roots[b[live]]
        live, ra, rb = live[ra != rb], ra[ra != rb], rb[ra != rb]
        if not len(live):
            break
        least = np.full(n, len(order))
        np.minimum.at(least, ra, live)
        np.minimum.at(least, rb, live)
        take = np.unique(least[least < len(order)])
        kept.append(take)
        roots = link_roots(n, [(a[take], b[take])], roots)
    return order[np.concatenate([*kept, np.zeros(0, np.int64)]).astype(np.int64)]


def closest(left: np.ndarray, right: np.ndarray | None, first: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, bits): of all pairs within the radius those of a spanning forest that is lightest but for STEP bits.

    For each of some limits the trees of all pairs within it are kept; a pair within a limit whose ends are in one tree
    by then is left out. So what is held grows with the fingerprints, not with the pairs of a large group of copies.
    """
    n = len(left) + (0 if right is None else len(right))
    limits = np.arange(radius, 0, -STEP)[::-1]
    roots = np.tile(np.arange(n), (len(limits), 1))
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int16))]
    for x, y, d in close_pairs(left, right, first, radius):
        level = np.searchsorted(limits, d)
        new = roots[level, x] != roots[level, y]
        if new.any():
            x, y, d, level = x[new], y[new], d[new], level[new]
            held.append((x, y, d))
            for k in range(level.min(), len(limits)):
                up = level <= k
                roots[k] = link_roots(n, [(x[up], y[up])], roots[k])
    a, b, w = (np.concatenate(x) for x in zip(*held))
    at = forest(n, a, b, w)
    return a[at], b[at], w[at]


def links(distinct: DataFrame, radius: int, tile: int = TILE, first: int | None = None) -> DataFrame:
    """Edges (u, v, bits) that join the representatives of all distinct fingerprints (rep, fp, ...) within the radius.

    Each pair of tiles is one group, made in Spark from each tile's range of partners; what a group returns is a star for each of
    its components (bits is null) or, with ``first``, a lightest spanning forest: the radius is then of all words together.
    """
    spark = distinct.sparkSession
    words = [c for c in distinct.columns if c.startswith("fp")]
    counted = distinct.withColumn("bits", F.bit_count("fp"))
    plan = tile_plan({r.bits: r.n for r in counted.groupBy("bits").agg(F.count("*").alias("n")).collect()}, tile)
    schema = "u long, v long, bits int"
    if not plan:
        return spark.createDataFrame([], schema)
    reach = radius if first is None else first
    begin = np.concatenate(([0], np.cumsum([shards for *_, shards in plan]))).tolist()
    at, tasks = F.lit(None), 0
    for k, (low, high, shards) in enumerate(plan):  # at most 65 entries
        near = [j for j, (other, top, _) in enumerate(plan) if other - high <= reach and low - top <= reach]
        lo, hi = begin[near[0]], begin[near[-1] + 1] - 1
        tasks += shards * (hi - lo + 1)
        here = F.struct((F.lit(begin[k]) + F.pmod(F.xxhash64(*words), F.lit(shards)).cast("int")).alias("tile"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
        at = F.when(F.col("bits") >= low, here).otherwise(at)
    spread = counted.withColumn("at", at).withColumn("other", F.explode(F.sequence("at.lo", "at.hi")))
    mine = F.col("at.tile")
    keyed = spread.select(F.least(mine, "other").alias("a"), F.greatest(mine, "other").alias("b"), (mine > F.col("other")).cast("int").alias("side"), *words, "rep")

    def run(table):
        side, rep = table.column("side").to_numpy(), table.column("rep").to_numpy()
        order = np.lexsort((rep, side))
        fp = np.column_stack([table.column(w).to_numpy()[order].view(np.uint64) for w in words])
        side, rep = side[order], rep[order]
        cut = int((side == 0).sum())
        if table.column("a")[0].as_py() == table.column("b")[0].as_py():
            left, right = fp, None
        else:
            left, right = fp[:cut], fp[cut:]
        if right is not None and not (len(left) and len(right)):
            x = y = d = np.zeros(0, np.int64)
        elif first is None:
            found = compare(left, right, radius)
            y = np.flatnonzero(found != np.arange(len(fp)))
            x, d = found[y], None
        else:
            x, y, d = closest(left, right, first, radius)
        return pa.table({"u": pa.array(rep[x], pa.int64()), "v": pa.array(rep[y], pa.int64()), "bits": pa.nulls(len(x), pa.int32()) if d is None else pa.array(d, pa.int32())})

    # comparisons take long and few bytes: as many partitions as pairs, not as the bytes suggest
    return keyed.repartition(min(MOST_TASKS, max(1, tasks // 2)), "a", "b").groupBy("a", "b").applyInArrow(run, schema)


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, tile: int = TILE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; component_id is the smallest doc_id
    reachable, the document's own included. Null, blank and wordless texts have fingerprint zero and are linked like
    any other; repeated rows come back as often as they are there; an empty table gives an empty result; columns other
    than doc_id and text are not read. Rows with a null doc_id are left out of linking and keep a null component_id.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.table(fingerprints(docs, shingle), "marked")
    known = marked.where("doc_id is not null")
    distinct = scratch.table(known.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    edges = scratch.table(links(distinct, radius, tile).select("u", "v"), "edges")
    found = components(scratch, edges)
    classes = scratch.table(distinct.join(found, distinct.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "classes")
    joined = marked.join(classes, "fp", "left")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def sieve(keys: DataFrame):
    """A function of a column of hashes: false only if none of ``keys`` (t) equals it.

    SIEVE_BITS bits are what the driver and the tasks hold; the more keys, the more rows pass that needn't.
    """
    at = keys.select((F.pmod(F.xxhash64("t"), F.lit(SIEVE_BITS)) + 1).alias("p"))
    parts = at.groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    bits = np.zeros((SIEVE_BITS // 32768, 4096), np.uint8)
    for r in parts.collect():  # as many rows as the array
        bits[r.k - 1] = np.frombuffer(r.bits, np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(bits.ravel())

    @F.arrow_udf("boolean")
    def among(p: pa.Array) -> pa.Array:
        p = np.asarray(p)
        return pa.array((shared.value[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool))

    return lambda t: among(F.pmod(F.xxhash64(t), F.lit(SIEVE_BITS)))


def shingles_of(docs: DataFrame, nodes: DataFrame, ends: DataFrame, shingle: int) -> DataFrame:
    """(node, grams): the sets of shingles of the nodes ``ends``; of the texts hardly more than theirs are moved."""
    wanted = nodes.join(ends, "node", "left_semi").select("one.doc_id", "one.t", "node")
    texts = _with_key(docs).select("__wirelake_id", "__wirelake_t", "text")
    texts = texts.where(sieve(wanted.select("t"))("__wirelake_t"))
    both = F.xxhash64("__wirelake_id", "__wirelake_t").alias("__wirelake_k")
    wanted = wanted.withColumn("k", F.xxhash64("doc_id", "t"))
    texts = texts.select(both, "*").join(wanted, (F.col("__wirelake_k") == F.col("k")) & F.col("__wirelake_id").eqNullSafe(F.col("doc_id")) & (F.col("__wirelake_t") == F.col("t")))

    def sets(batches):
        for batch in giving_back(batches):
            grams = [shingle_set(t.as_py(), shingle).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.list_(pa.int64()))], names=["node", "grams"])

    # repeated rows have one key, by which they are together already
    turn = F.row_number().over(Window.partitionBy("k", "node").orderBy(F.lit(1)))
    return texts.select("k", "node", "text").withColumn("turn", turn).where("turn = 1").select("node", "text").mapInArrow(sets, "node long, grams array<long>")


def plausible(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) of nodes without those whose sizes and sketches rule out a Jaccard similarity of ``least``."""

    def of(end):
        return nodes.select(F.col("node").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in ("size", *(f"s{k}" for k in range(SKETCH)))))

    apart = sum((F.bit_count(F.col(f"u_s{k}").bitwiseXOR(F.col(f"v_s{k}"))) for k in range(SKETCH)), F.lit(0))
    # what only one of two similar sets has, at most
    most = (F.col("u_size") + F.col("v_size")) * F.lit((1 - least) / (1 + least)) + F.lit(1e-6)
    return pairs.join(of("u"), "u").join(of("v"), "v").where((apart <= most) & (F.abs(F.col("u_size") - F.col("v_size")) <= most)).select("u", "v")


def alike(scratch: Scratch, docs: DataFrame, nodes: DataFrame, pairs: DataFrame, least: float, shingle: int, name: str, runs: DataFrame | None = None) -> DataFrame:
    """Those of the pairs (u, v) of nodes whose sets of shingles have a Jaccard similarity of at least ``least``.

    With ``runs`` (u, gram, parts) edges that join all similar sets of each run too. Pairs that sketches rule out don't
    have their sets moved.
    """
    pairs = scratch.table(plausible(pairs, nodes, least), f"{name}-plausible")
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    if runs is not None:
        ends = ends.unionByName(runs.select(F.col("u").alias("node")).distinct()).distinct()
    ends = scratch.table(ends, f"{name}-ends")
    held = scratch.table(shingles_of(docs, nodes, ends, shingle), f"{name}-grams")
    release(docs.sparkSession)
    a, b = held.select(F.col("node").alias("u"), F.col("grams").alias("x")), held.select(F.col("node").alias("v"), F.col("grams").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    found = pairs.join(a, "u").join(b, "v").where(shared >= F.lit(least) * (F.size("x") + F.size("y") - shared)).select("u", "v")
    edges = scratch.table(found, f"{name}-edges")
    if runs is not None and not runs.isEmpty():
        edges = edges.unionByName(scratch.table(links_in_runs(runs, held, least).distinct(), f"{name}-stars"))
    scratch.drop(f"{name}-plausible", f"{name}-ends", f"{name}-grams")
    release(docs.sparkSession)
    return edges


def without_near_copies(docs: DataFrame, least: float = 0.8, shingle: int = 5, tile: int = TILE, radius: int = 4) -> DataFrame:
    """The rows of ``docs``, one of each group: that with the smallest doc_id (null last), then by the text's hash and the other columns.

    Groups are joined by all pairs of texts whose sets of word shingles have a Jaccard similarity of at least ``least``.
    First, fingerprints within ``radius`` bits, found by tiled exact comparison, and the hubs of shared rare shingles
    propose pairs, which are held against the shingles themselves; that joins most. Other hubs join more of what is
    left. Then all pairs between different groups that share one of their first shingles (``postings``) are held
    against them, so no similar pair is missed. Where a shingle has many such pairs, its sets are compared within
    tasks instead of pair by pair.
    Texts with equal sets are one node, so all wordless texts, null and blank ones too, are one group; repeated rows
    are a group as any other copies. An empty table gives an empty result; all columns are returned.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    marked = scratch.table(set_fingerprints(docs, shingle), "marked")
    one = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "t")
    nodes = scratch.table(marked.where("part is null").groupBy("node").agg(F.min(one).alias("one"), *(F.min(c).alias(c) for c in ("fp", "size", *(f"s{k}" for k in range(SKETCH)))), F.count("*").alias("rows")), "nodes")
    ordered = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    near = links(nodes.select(F.col("node").alias("rep"), "fp"), radius, tile, radius).select(*ordered)
    runs = scratch.table(shared_postings(postings(docs, shingle_counts(marked), least, shingle), least), "runs")
    release(docs.sparkSession)
    hubs = runs.where("hub is not null").select(F.col("hub").alias("u"), F.col("node").alias("v")).select(*ordered)
    pairs = scratch.table(near.unionByName(hubs).distinct(), "pairs")
    edges = alike(scratch, docs, nodes, pairs, least, shingle, "first")
    groups = components(scratch, edges).select(F.col("node").alias("at"), "component")
    for name in ("hubs", "rest"):
        placed = runs.join(groups, F.col("node") == F.col("at"), "left").select("gram", F.coalesce("component", "node").alias("group"), "node", "place", "size")
        whole = None
        if name == "hubs":
            found = pairs_between(placed, least, hubs=True)
        else:
            found = scratch.table(pairs_between(placed, least, whole=True), "found")
            whole = found.where("v is null").select("u", "gram", "parts")
            found = found.where("v is not null").select("u", "v")
        more = scratch.table(found.distinct().join(pairs, ["u", "v"], "left_anti"), name)
        if not (more.isEmpty() and (whole is None or whole.isEmpty())):
            pairs = pairs.unionByName(more)
            edges = edges.unionByName(alike(scratch, docs, nodes, more, least, shingle, name, whole))
            groups = components(Scratch(docs.sparkSession, name), edges).select(F.col("node").alias("at"), "component")
    scratch.drop("runs")
    rooted = scratch.table(nodes.select("node", "one", "rows").join(groups, F.col("node") == F.col("at"), "left").select("node", "one", "rows", "component"), "rooted")
    first = rooted.groupBy(F.coalesce("component", "node").alias("root")).agg(F.min("one").alias("one"))
    first = scratch.table(first.select(F.col("one.doc_id").alias("a"), F.col("one.t").alias("b")), "first")
    # a row whose set no other has, and that no edge joins, stays where it is
    several = rooted.where("rows > 1 or component is not null").select("node")
    several = sieve(marked.where("part is null").join(several, "node", "left_semi").select("t"))
    release(docs.sparkSession)
    own = _with_key(docs).withColumn("__wirelake_several", several("__wirelake_t"))
    alone = own.where(~F.col("__wirelake_several")).select(*docs.columns)
    own = own.where("__wirelake_several")
    kept = own.join(first, F.col("__wirelake_id").eqNullSafe(F.col("a")) & (F.col("__wirelake_t") == F.col("b")), "left_semi")
    # rows that share doc_id and text are together already
    others = [F.col(c).cast("string") for c in docs.columns if c != "text"]
    turn = F.row_number().over(Window.partitionBy("__wirelake_id", "__wirelake_t").orderBy(*others))
    return alone.union(kept.withColumn("__wirelake_turn", turn).where(F.col("__wirelake_turn") == 1).select(*docs.columns))


def _with_key(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__wirelake_id": F.col("doc_id").cast("long"), "__wirelake_t": F.xxhash64("text")})
