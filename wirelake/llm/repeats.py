"""Repeated passages: maximal repeats from an enhanced suffix array, cut out of all documents but the first."""

from __future__ import annotations

import gc
import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import Scratch

#: Bytes of a passage, and of the grams that anchor it.
LEAST, GRAM = 100, 16
#: Window starts that are worked on together; a longer text is taken in parts.
SEGMENT = 1_000_000
#: Contexts of one suffix array, about; an anchor with more different contexts than this goes window by window.
ARRAY, HOT = 2000, 5000
_ODD = 0x9E3779B97F4A7C15
_PLACE = (1 << 24) - 1


def _scatter(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one word; data needs 8 bytes more than there are places."""
    x = data.astype(np.uint64)
    for k in (1, 2, 4):
        x = x[:-k] | (x[k:] << np.uint64(8 * k))
    return x


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and of its inverse."""
    base = np.uint64(_ODD)
    inverse = np.uint64(pow(_ODD, -1, 1 << 64))
    with np.errstate(over="ignore"):
        up, down = np.full(n, base), np.full(n, inverse)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def anchors(data: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, gram hash, context hash) of the contexts of one text.

    Each window of ``least`` bytes is anchored at the gram with the smallest hash in it, the first of equal ones: the
    same bytes have the same anchor wherever they are. The context of an anchor is the span of its windows. So windows
    can be equal only within contexts that share a gram hash, and if contexts are equal, so are all their windows.
    """
    n = len(data) - least + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    wide = np.concatenate((data, np.zeros(2 * GRAM, np.uint8)))
    grams = len(data) - GRAM + 1
    with np.errstate(over="ignore"):
        eight = _eights(wide)
        hashes = _scatter(_scatter(eight[:grams]) + eight[8 : grams + 8] * np.uint64(_ODD))
        low = (hashes & ~np.uint64(_PLACE)) | np.arange(grams, dtype=np.uint64)
        span, reach = least - GRAM + 1, 1
        while reach * 2 <= span:
            low = np.minimum(low[: len(low) - reach], low[reach:])
            reach *= 2
        if reach < span:
            low = np.minimum(low[:n], low[span - reach : span - reach + n])
        at = (low[:n] & np.uint64(_PLACE)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.append(begin[1:], n) - 1
        length = last - begin + least
        up, down = _powers(SEGMENT + least + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[:grams], dtype=np.uint64)))
        context = _scatter((total[begin + length - GRAM + 1] - total[begin]) * down[begin] + length.astype(np.uint64))
    return begin, length, hashes[at[begin]], context


def _ranks(x: np.ndarray) -> np.ndarray:
    """Of each value its place among the different ones."""
    order = np.argsort(x)
    x = x[order]
    out = np.empty(len(x), np.int64)
    out[order] = np.cumsum(np.concatenate(([False], x[1:] != x[:-1])))
    return out


def maximal_repeats(texts: list[bytes], least: int = LEAST) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, [(text, place), ...]) of the maximal repeats of at least that many bytes, with all their occurrences.

    A repeat is maximal if its occurrences have different bytes before and after them (an end of a text differs from
    everything). The suffixes are ranked by doubling prefixes to ``least`` bytes, and neighbours in that order with
    equal rank are the common-prefix intervals of that depth. Intervals whose left bytes are all alike are dropped: they
    are part of a repeat that starts earlier. In the others the suffix array is finished, and a scan with a stack over
    the common prefixes of neighbours walks the interval tree; each interval with different left bytes is a repeat.
    """
    texts = [bytes(t) for t in texts]
    # end to end: only windows within a text are looked at, and the ranks that make them up cover nothing else
    data = np.frombuffer(b"".join([*texts, bytes(least)]), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(sizes) - sizes
    starts = np.maximum(0, sizes - least + 1)
    if not starts.sum():
        return []
    # places that start a window, of all texts
    place = np.arange(starts.sum()) + np.repeat(first - (np.cumsum(starts) - starts), starts)
    owner = np.repeat(np.arange(len(texts)), starts)
    rank = _eights(np.concatenate((data, np.zeros(8, np.uint8))))
    rank = _ranks(rank)
    size = 8
    while size * 2 <= least:
        rank = _ranks((rank[:-size] << 32) | rank[size:])
        size *= 2
    tail = least - size
    key = (rank[place] << 32) | rank[np.minimum(place + tail, len(rank) - 1)]
    order = np.argsort(key)
    place, owner, key = place[order], owner[order], key[order]
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(edge, len(key)))
    before = np.where(place == first[owner], -1 - place, data[place - 1].astype(np.int64))
    diverse = (count > 1) & (np.minimum.reduceat(before, edge) != np.maximum.reduceat(before, edge))
    out = []
    for a, n in zip(edge[diverse], count[diverse], strict=True):
        rows = [(texts[o][p - first[o] :], int(b), int(o), int(p - first[o])) for o, p, b in zip(owner[a : a + n], place[a : a + n], before[a : a + n], strict=True)]
        out += _intervals(rows, least)
    return out


def _common(a: bytes, b: bytes, known: int) -> int:
    low, high = known, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _intervals(rows: list[tuple[bytes, int, int, int]], least: int):
    """The repeats among suffixes (text, byte before, owner, place) that share their first ``least`` bytes."""
    rows.sort()
    shared = [_common(x[0], y[0], least) for x, y in zip(rows, rows[1:])]
    out, stack = [], []  # (depth, first suffix)
    for i, depth in enumerate([*shared, -1]):
        start = i
        while stack and stack[-1][0] > depth:
            size, start = stack.pop()
            inside = rows[start : i + 1]
            if len({r[1] for r in inside}) > 1:
                out.append((size, [(o, p) for _, _, o, p in inside]))
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, start))
    return out


def _contexts(docs: DataFrame, least: int) -> DataFrame:
    """(h, c, doc_id, t, place): all contexts; place is start * 65536 + length (a context is less than two windows long)."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(4)]
            for row, t in enumerate(batch.column(2)):
                data = np.frombuffer((t.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
                for a in range(0, max(0, len(data) - least + 1), SEGMENT):
                    begin, length, h, c = anchors(data[a : a + SEGMENT + least - 1], least)
                    for x, y in zip(out, (h.view(np.int64), c.view(np.int64), np.full(len(begin), row), ((begin + a) << 16) | length), strict=True):
                        x.append(y)
            if out[0]:
                h, c, rows, places = (np.concatenate(x) for x in out)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), batch.column(0).take(at), batch.column(1).take(at), pa.array(places)], names=["h", "c", "doc_id", "t", "place"])

    return docs.mapInArrow(run, "h long, c long, doc_id long, t long, place long")


def _release(spark) -> None:
    """Lets Spark delete the shuffle files of finished steps now rather than at some later garbage collection."""
    gc.collect()
    spark._jvm.System.gc()


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def spans(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, t, spans): of each document of (doc_id, t, text), the bytes covered by windows that also start earlier, as (start, end); they may overlap.

    The documents' contexts are matched by hashes: with map-side aggregates, so that a passage shared by all documents
    is one row a task. Contexts that occur again are repeats as a whole. Different contexts around one anchor may share
    some windows; these are few, and their maximal repeats come from suffix arrays over one copy of each.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    all_ = _contexts(docs, least)
    seen = all_.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n"))
    repeated = scratch.table(seen.where("n > 1").select("h", (F.col("low") != F.col("high")).alias("mixed")), "grams")
    _release(spark)
    again = scratch.table(all_.join(repeated, "h"), "contexts")
    _release(spark)
    order = F.struct("doc_id", "t", "place")
    first = scratch.table(again.groupBy("h", "c").agg(F.min(order).alias("first"), F.count("*").alias("n"), F.first("mixed").alias("mixed")), "first")
    whole = first.where("n > 1").select("h", "c", "first")
    copies = again.select("h", "c", "doc_id", "t", "place").join(whole, ["h", "c"]).where(order != F.col("first"))
    start, length = F.shiftright("place", 16), F.col("place").bitwiseAND(0xFFFF)
    by_copy = scratch.table(copies.select("doc_id", "t", start.alias("start"), (start + length).alias("end")), "copies")
    mixed = first.where("mixed").select("h", "first.*")
    crowd = mixed.groupBy("h").agg(F.count("*").alias("k"))
    wanted = mixed.join(crowd, "h").select("doc_id", "t", F.struct("h", "place", (F.col("k") > HOT).alias("hot")).alias("x"))
    wanted = scratch.table(wanted.groupBy("doc_id", "t").agg(F.collect_list("x").alias("wanted")), "wanted")
    scratch.drop("grams", "contexts", "first")
    _release(spark)
    a, b = docs.alias("a"), wanted.alias("b")
    with_text = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.t") == F.col("b.t"))).select("a.doc_id", "a.t", "text", "wanted")

    def cut(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for i, t, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for x in wanted:
                    begin = x["place"] >> 16
                    for o, v in zip(out, (x["h"], x["hot"], i, t, begin, data[begin : begin + (x["place"] & 0xFFFF)]), strict=True):
                        o.append(v)
            types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, types, strict=True)], names=["h", "hot", "doc_id", "t", "begin", "bytes"])

    cuts = scratch.table(with_text.mapInArrow(cut, "h long, hot boolean, doc_id long, t long, begin long, bytes binary"), "cuts")
    scratch.drop("wanted")
    _release(spark)
    groups = max(1, cuts.count() // ARRAY)

    def repeats(table):
        # rows that are the same document give the same contexts
        each = {x[:3]: x[3] for x in zip(*(table.column(k).to_pylist() for k in ("doc_id", "t", "begin", "bytes")), strict=True)}
        keys, covered = list(each), [[] for _ in each]
        rank = [(i is not None, i or 0, t, begin) for i, t, begin in keys]
        for size, found in maximal_repeats(list(each.values()), least):
            first = min(found, key=lambda x: (*rank[x[0]][:3], rank[x[0]][3] + x[1]))
            at = keys[first[0]], keys[first[0]][2] + first[1]
            for o, p in found:
                if keys[o][:2] != at[0][:2] or keys[o][2] + p != at[1]:
                    covered[o].append((p, p + size))
        out = [[] for _ in range(4)]
        for (i, t, begin), parts in zip(keys, covered, strict=True):
            for a, b in _union(parts):
                for x, v in zip(out, (i, t, begin + a, begin + b), strict=True):
                    x.append(v)
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("doc_id", "t", "start", "end"), out, strict=True)})

    schema = "doc_id long, t long, start long, end long"
    by_array = cuts.where("not hot").withColumn("g", F.pmod(F.xxhash64("h"), F.lit(groups))).groupBy("g").applyInArrow(repeats, schema)

    def windows(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                data = batch.column(3)[row].as_py()
                n = len(data) - least + 1
                found = [hashlib.blake2b(data[k : k + least], digest_size=16).digest() for k in range(n)]
                at = pa.array(np.full(n, row))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(0).take(at), batch.column(1).take(at), pa.array(np.arange(n) + batch.column(2)[row].as_py())], names=["w", "doc_id", "t", "at"])

    each = cuts.where("hot").select("doc_id", "t", "begin", "bytes").mapInArrow(windows, "w binary, doc_id long, t long, at long")
    one = F.struct("doc_id", "t", "at")
    earliest = each.groupBy("w").agg(F.min(one).alias("first"), F.count("*").alias("n")).where("n > 1").select("w", "first")
    by_window = each.join(earliest, "w").where(one != F.col("first")).select("doc_id", "t", F.col("at").alias("start"), (F.col("at") + least).alias("end"))
    all_spans = by_copy.unionByName(by_array).unionByName(by_window).groupBy("doc_id", "t").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    found = scratch.table(all_spans, "found")
    scratch.drop("copies", "cuts")
    _release(spark)
    return found


def without_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every document.

    Of each text, as UTF-8, the bytes covered by a ``least``-byte string that also starts earlier (in a document with a
    smaller doc_id, or earlier in the same one) are removed; ``kept`` is what is left, which may cut a character. All
    strings are judged on the input. Null texts count as empty. Rows with one doc_id and equal texts are one document
    and have equal results; with different texts they are ordered by a hash of the text; a null doc_id comes first. An
    empty table gives an empty result; other columns are not read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    a, b = own.alias("a"), spans(own, least).alias("b")
    joined = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.t") == F.col("b.t")), "left").select("a.doc_id", "text", "spans")

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(5)]
            lists = batch.column(2)
            for row, t in enumerate(batch.column(1)):
                data = (t.as_py() or "").encode("utf-8", "surrogatepass")
                kept, removed, runs, done, end = [], 0, 0, 0, -1
                if lists[row].is_valid:
                    pairs = lists[row].values
                    begins, ends = pairs.field("start").to_numpy(), pairs.field("end").to_numpy()
                    order = np.argsort(begins, kind="stable")
                    for s, e in zip(begins[order].tolist(), ends[order].tolist()):
                        if s > end:
                            runs += 1
                            kept.append(data[done:s])
                        removed += max(0, e - max(s, end))
                        end = done = max(end, e)
                kept.append(data[done:])
                left = b"".join(kept)
                for x, v in zip(out, (len(data), removed, runs, hashlib.sha256(left).hexdigest(), left), strict=True):
                    x.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, types, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
