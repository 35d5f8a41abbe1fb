"""Mixing sources to target weights by Pfair scheduling of blocks."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wirelake.llm.common import Scratch

#: Documents in a block.
BLOCK_ROWS = 64
#: Rows of one numbering group, about; a source has as many groups as it needs, MOST_GROUPS at most.
GROUP_ROWS, MOST_GROUPS = 4096, 16_384
#: Sources that are scheduled together; of more, the smaller ones are pooled, and a pool's blocks are scheduled among its sources in turn.
TOGETHER = 200
#: Rows of one partition of the ordered table, partitions at most, and partitions times sources whose limits one table holds at most.
PART_ROWS, MOST_PARTS, MOST_LIMITS = 4096, 65_536, 1 << 18
#: Weight of a source that has none.
DEFAULT_WEIGHT = 1
_PLACES = "struct<block:bigint,release:bigint,deadline:bigint,phase:int,slot:bigint,place:bigint>"


def template(weights: dict[str, int], until: int | None = None) -> dict[str, list[int]]:
    """Slots of each source's blocks in one period of sum(weights) slots, or the first ``until`` of them, by earliest deadline first.

    Block k of a source with weight w of W may start at floor(k W / w) and must be done by ceil((k + 1) W / w). At the
    period's end every source has exactly w blocks, so the schedule repeats, and at no time is a source's number of
    blocks a whole block away from its share. Ties of deadlines go by name.
    """
    total = sum(weights.values())
    waiting = [(0, s, 0) for s in sorted(weights)]  # release, source, block
    heapq.heapify(waiting)
    ready, slots = [], {s: [] for s in weights}
    for slot in range(total if until is None else min(total, until)):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // weights[s]), s, k))
        _, s, k = heapq.heappop(ready)
        slots[s].append(slot)
        if k + 1 < weights[s]:
            heapq.heappush(waiting, ((k + 1) * total // weights[s], s, k + 1))
    return slots


def phases(blocks: dict[str, int], weights: dict[str, int]) -> list[dict]:
    """The schedule as phases: in each, the sources that have blocks left share by their weights until one runs out.

    Of each phase: first slot, sum of weights, and for each source its first and one-past-last block, weight and the
    slots of one period, or of a part of it if the phase is shorter.
    """
    done = {s: 0 for s, n in blocks.items() if n}
    out, slot = [], 0
    while done:
        divisor = int(np.gcd.reduce([weights[s] for s in done]))
        own = {s: weights[s] // divisor for s in done}
        total = sum(own.values())
        left = {s: blocks[s] - done[s] for s in done}
        # by then some source has no blocks left
        at = template(own, min(-(-n * total // own[s]) for s, n in left.items()))
        # the slot at which each source would use its last block: the first of these ends the phase
        last = {s: (n - 1) // own[s] * total + at[s][(n - 1) % own[s]] for s, n in left.items() if (n - 1) % own[s] < len(at[s])}
        end = min(last.values()) + 1
        used = {s: end // total * own[s] + sum(t < end % total for t in at[s]) for s in done}
        out.append({"slot": slot, "total": total, "sources": {s: (done[s], done[s] + used[s], own[s], at[s]) for s in done}})
        slot += end
        done = {s: done[s] + used[s] for s in done if done[s] + used[s] < blocks[s]}
    return out


@dataclass
class Schedule:
    """Of each source its phases: first blocks, and (phase, first block, weight, sum of weights, first slot, slots of a period)."""

    parts: dict[str, tuple[np.ndarray, list[tuple]]]

    @classmethod
    def of(cls, blocks: dict[str, int], weights: dict[str, int]) -> Schedule:
        parts: dict[str, list[tuple]] = {}
        for p, x in enumerate(phases(blocks, weights)):
            for s, (first, end, weight, at) in x["sources"].items():
                if end > first:
                    parts.setdefault(s, []).append((p, first, weight, x["total"], x["slot"], np.array(at, np.int64)))
        return cls({s: (np.array([x[1] for x in v]), v) for s, v in parts.items()})

    def places(self, source: str, block: np.ndarray) -> np.ndarray:
        """Rows of release, deadline, phase and slot of a source's blocks."""
        firsts, parts = self.parts[source]
        out = np.zeros((4, len(block)), np.int64)
        which = np.searchsorted(firsts, block, "right") - 1
        for k in np.unique(which):
            here = which == k
            p, first, weight, total, begin, at = parts[k]
            b = block[here] - first
            out[:, here] = begin + b * total // weight, begin + -(-(b + 1) * total // weight), np.full(len(b), p), begin + b // weight * total + at[b % weight]
        return out


@dataclass
class Mix:
    """The schedule of all sources: of the larger ones and the pools, and of each pool's sources among its blocks."""

    top: Schedule
    pools: dict[str, Schedule]
    pool_of: dict[str, str]

    @classmethod
    def of(cls, blocks: dict[str, int], weights: dict[str, int], together: int = TOGETHER) -> Mix:
        if len(blocks) <= together:
            return cls(Schedule.of(blocks, weights), {}, {})
        ranked = sorted(blocks, key=lambda s: (-blocks[s], s))
        alone, rest = ranked[: together // 2], ranked[together // 2 :]
        count = max(together - len(alone), 1)
        members = {f"pool {k}": rest[k::count] for k in range(min(count, len(rest)))}  # no source's name starts so
        pools = {p: Mix.of({s: blocks[s] for s in m}, weights, together) if len(m) > together else Schedule.of({s: blocks[s] for s in m}, weights) for p, m in members.items()}
        top_blocks = {s: blocks[s] for s in alone} | {p: sum(blocks[s] for s in m) for p, m in members.items()}
        top_weights = {s: weights[s] for s in alone} | {p: sum(weights[s] for s in m) for p, m in members.items()}
        return cls(Schedule.of(top_blocks, top_weights), pools, {s: p for p, m in members.items() for s in m})

    def places(self, source: str, block: np.ndarray) -> np.ndarray:
        """As of ``Schedule``; of a pooled source release, deadline and phase are those of the pool's block."""
        if (pool := self.pool_of.get(source)) is None:
            return self.top.places(source, block)
        return self.top.places(pool, self.pools[pool].places(source, block)[3])


def _rows(docs: DataFrame, key: str, source: str) -> DataFrame:
    """The rows with _s, their source's name, and _h and _m, by which each source's rows are ordered: a hash of key and place, and the place."""
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))
    placed = docs.withColumns({"_s": name, "_m": F.monotonically_increasing_id()})
    # the place makes rows of one key differ, so that no group of equal rows is in one task
    return placed.withColumn("_h", F.xxhash64(F.col(key).cast("string"), "_m"))


def _rows_as_read(docs: DataFrame, source: str) -> DataFrame:
    """As ``_rows``, but each source's rows are ordered as they are in the table: _m is a row's number in it, and _h spreads these numbers over all of 64 bits.

    Of a table read from files the order is that of the files' names, which Spark numbers as it writes, and the rows in
    each, however the files are split and dealt; of any other that of its partitions.
    """
    spark = docs.sparkSession
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        file = docs.metadataColumn("_metadata")
        rows = docs.withColumns({"_f": file["file_path"], "_i": file["row_index"]})
    else:
        rows = docs.withColumn("_i", F.monotonically_increasing_id())
        rows = rows.withColumns({"_f": F.shiftright("_i", 33), "_i": F.col("_i").bitwiseAND((1 << 33) - 1)})
    sizes = sorted((r["_f"], r.n) for r in rows.groupBy("_f").agg(F.count("*").alias("n")).collect())  # a row for each file or partition
    ends = np.cumsum([n for _, n in sizes], dtype=np.int64)
    first = {f: int(end) - n for (f, n), end in zip(sizes, ends, strict=True)}
    step = np.uint64(((1 << 64) - 1) // max(1, int(ends[-1]) if len(ends) else 1))
    shared = spark.sparkContext.broadcast(first)

    @F.arrow_udf("struct<h:bigint,m:bigint>")
    def number(f: pa.Array, i: pa.Array) -> pa.Array:
        names = f.dictionary_encode()
        begin = np.array([shared.value[x] for x in names.dictionary.to_pylist()], np.int64)
        m = begin[np.asarray(names.indices)] + np.asarray(i)
        h = (m.astype(np.uint64) * step ^ np.uint64(1 << 63)).view(np.int64)
        return pa.StructArray.from_arrays([pa.array(h), pa.array(m)], names=["h", "m"])

    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))
    return rows.withColumns({"_s": name, "_n": number("_f", "_i")}).withColumns({"_h": F.col("_n.h"), "_m": F.col("_n.m")}).drop("_f", "_i", "_n")


def _plan(rows: DataFrame, weights: dict[str, int] | None, block_rows: int):
    sizes = {r["_s"]: r.n for r in rows.groupBy("_s").agg(F.count("*").alias("n")).collect()}  # a row for each source
    own = {s: (weights or {}).get(s[1:] if s != "null" else None, DEFAULT_WEIGHT) for s in sizes}
    if any(w < 1 or int(w) != w for w in own.values()):
        raise ValueError("weights are whole numbers from 1 on")
    return sizes, Mix.of({s: -(-n // block_rows) for s, n in sizes.items()}, {s: int(w) for s, w in own.items()})


def _numbered(rows: DataFrame, total: int, group_rows: int) -> DataFrame:
    """The rows with _number, from 0 on within each source by (_h, _m).

    Groups are ranges of the hash, so they are even; no task holds a source. A window runs over the counts of a source's
    groups, MOST_GROUPS at most.
    """
    bits = min(MOST_GROUPS - 1, total // group_rows).bit_length()
    cut = rows.withColumn("_g", F.shiftrightunsigned(F.col("_h").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits) if bits else F.lit(0).cast("long"))
    counted = cut.groupBy("_s", "_g").agg(F.count("*").alias("n"))
    before = counted.select("_s", "_g", (F.sum("n").over(Window.partitionBy("_s").orderBy("_g")) - F.col("n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_s", "_g").orderBy("_h", "_m")) - 1
    return cut.withColumn("_inside", inside).join(before, ["_s", "_g"]).withColumn("_number", F.col("_before") + F.col("_inside")).drop("_g", "_inside", "_before")


def _placer(spark, plan: Mix, block_rows: int):
    """A function of source and number that gives the block and its place in the mix."""
    shared = spark.sparkContext.broadcast(plan)  # a period's slots for each source and phase

    @F.arrow_udf(_PLACES)
    def places(s: pa.Array, number: pa.Array) -> pa.Array:
        number = np.asarray(number)
        names = s.dictionary_encode()
        codes = np.asarray(names.indices)
        out = np.zeros((6, len(number)), np.int64)
        out[0], out[5] = number // block_rows, number % block_rows
        for k, name in enumerate(names.dictionary.to_pylist()):
            here = codes == k
            out[1:5, here] = shared.value.places(name, out[0, here])
        fields = ("block", "release", "deadline", "phase", "slot", "place")
        return pa.StructArray.from_arrays([pa.array(x, pa.int32() if f == "phase" else pa.int64()) for f, x in zip(fields, out, strict=True)], names=list(fields))

    return places


def mix(docs: DataFrame, weights: dict[str, int] | None = None, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS, key: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, source, block, release, deadline, phase, slot, place) of every row: its block and the block's slot in the mix.

    Each source's rows, in the order of a hash, are cut into blocks of ``block_rows``; the last may be shorter. Blocks
    are scheduled by ``template`` in phases; when a source runs out, the rest share by their weights. So every row is in
    the mix once, and in each phase every source is less than one block away from its share. Of more than TOGETHER
    sources the smaller ones share pools, less than one block away within their pool. release and deadline are slots of
    the whole mix. ``weights`` are whole numbers, DEFAULT_WEIGHT where there is none; null is a source of its own. Rows
    that share a key, or have none, are rows of their own. An empty table gives an empty result.

    Row numbers within a source are made in ranges of a hash, so no task holds a source. The driver gets one count for
    each source.
    """
    spark = docs.sparkSession
    rows = _rows(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source")), "doc_id", "source")
    sizes, plan = _plan(rows, weights, block_rows)
    numbered = _numbered(rows, sum(sizes.values()), group_rows)
    return numbered.withColumn("_at", _placer(spark, plan, block_rows)("_s", "_number")).select("doc_id", "source", *(f"_at.{f}" for f in ("block", "release", "deadline", "phase", "slot", "place")))


def with_places(docs: DataFrame, weights: dict[str, int] | None = None, block_rows: int = BLOCK_ROWS, key: str = "doc_id", source: str = "source", part_rows: int = PART_ROWS, as_read: bool = False) -> DataFrame:
    """The rows in the order of the mix, with mix_slot and mix_place: the slot of their block in the mix and their place in the block.

    Each source's rows come in the order of a hash, or ``as_read`` in the order that they have in the table; a table
    that is in the order of a mix by the same weights then stays in it, and its rows get their slots and places in it.

    Partitions follow each other by slot and are sorted, so files written from them follow the schedule. Columns of
    these names are replaced. Rows are moved once, as they are: where each source's rows of a partition begin is found
    from their keys before.
    """
    spark, columns = docs.sparkSession, [c for c in docs.columns if c not in ("mix_slot", "mix_place")]
    rows = (_rows_as_read(docs, source) if as_read else _rows(docs, key, source)).drop("mix_slot", "mix_place")
    keys = rows.select("_s", "_h", "_m")
    sizes, plan = _plan(keys, weights, block_rows)
    total, places = sum(sizes.values()), _placer(spark, plan, block_rows)
    slots = max(1, sum(-(-n // block_rows) for n in sizes.values()))
    parts = max(1, min(MOST_PARTS, total // part_rows, MOST_LIMITS // max(1, len(sizes))))
    each = -(-slots // parts)
    numbered = _numbered(keys, total, GROUP_ROWS).withColumn("_at", places("_s", "_number"))
    part = F.floor(F.col("_at.slot") / each).cast("int")
    at = [F.col("_at.slot").alias("mix_slot"), F.col("_at.place").alias("mix_place")]
    if parts * PART_ROWS * 4 < total and len(sizes) > TOGETHER:
        # too many sources for a table of limits: the places are joined to the rows
        found = rows.join(numbered.select("_m", *at), "_m")
        return found.repartitionByRange("mix_slot").sortWithinPartitions("mix_slot", "mix_place").select(*columns, "mix_slot", "mix_place")
    limits: dict[str, list] = {}
    for r in numbered.groupBy("_s", part.alias("p")).agg(F.min(F.struct("_h", "_m", "_number")).alias("low")).collect():  # MOST_LIMITS rows
        limits.setdefault(r["_s"], []).append((r.low["_h"], r.low["_m"], r.p, r.low["_number"]))
    held = {}
    for s, found in limits.items():
        h, m, p, number = np.array(sorted(found), np.int64).T
        held[s] = _keys(h, m), p, number
    shared = spark.sparkContext.broadcast(held)

    @F.arrow_udf("struct<p:int,base:bigint>")
    def begins(s: pa.Array, h: pa.Array, m: pa.Array) -> pa.Array:
        own, names = _keys(np.asarray(h), np.asarray(m)), s.dictionary_encode()
        codes, out = np.asarray(names.indices), np.zeros((2, len(own)), np.int64)
        for k, name in enumerate(names.dictionary.to_pylist()):
            here = codes == k
            low, p, number = shared.value[name]
            i = np.searchsorted(low, own[here], "right") - 1
            out[:, here] = p[i], number[i]
        return pa.StructArray.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1])], names=["p", "base"])

    moved = rows.withColumn("_b", begins("_s", "_h", "_m")).withColumns({"_p": F.col("_b.p"), "_base": F.col("_b.base")}).drop("_b").repartitionById(parts, "_p")
    inside = F.row_number().over(Window.partitionBy("_p", "_s").orderBy("_h", "_m")) - 1
    found = moved.withColumn("_number", F.col("_base") + inside).withColumn("_at", places("_s", "_number")).select(*columns, *at)
    return found.sortWithinPartitions("mix_slot", "mix_place")


def _keys(h: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Byte strings that sort as (h, m)."""
    out = np.stack((h, m), axis=1).view(np.uint64) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(out.astype(">u8")).view("S16").ravel()


def in_mix_order(docs: DataFrame, weights: dict[str, int] | None = None, block_rows: int = BLOCK_ROWS, key: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows in the order of the mix, as ``with_places`` has them."""
    return with_places(docs, weights, block_rows, key, source).select(*docs.columns)
