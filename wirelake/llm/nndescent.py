"""Near-duplicate vectors by NN-descent."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wirelake.llm.common import Scratch, link_roots
from wirelake.llm.graph import components

#: Neighbours of a list, random-hyperplane orders that start the lists, vectors of a starting block.
NEIGHBOURS, ORDERS, LEAF = 12, 4, 256
#: Lists are refined until at most this share of all entries changed in a round.
SETTLED = 0.002
#: A saturated list is doubled up to this many times its first length; vectors whose lists are saturated still are compared exactly.
ENLARGED = 8
#: Vectors of a tile of exact comparisons at most, and of a slice; tiles that a smaller set is cut into, if each has so many vectors.
TILE, SLICE, TILES, FEW = 16_384, 512, 24, 256
#: Vectors of small and of large components each whose links are found by brute force to audit recall, the recall that both have to reach,
#: and attempts, each with twice the neighbours; after them all vectors are compared exactly.
AUDIT, RECALL, ATTEMPTS = 256, 0.97, 3
#: Centres whose neighbourhoods are joined in one call.
CENTRES = 128
_EDGE = "u long, v long, sim double, cap int"


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _edges(u, v, sim, cap) -> pa.Table:
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "sim": pa.array(sim, pa.float64()), "cap": pa.array(cap, pa.int32())})


def best(u: np.ndarray, v: np.ndarray, sim: np.ndarray, cap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The largest of each u's distinct (v, sim), as many as its cap, ties by v."""
    order = np.lexsort((v, -sim, u))
    u, v, sim, cap = u[order], v[order], sim[order], cap[order]
    if len(u):
        new = np.ones(len(u), bool)
        new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
        u, v, sim, cap = u[new], v[new], sim[new], cap[new]
        begin = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
        rank = np.arange(len(u)) - np.repeat(begin, np.diff(np.append(begin, len(u))))
        keep = rank < cap
        u, v, sim, cap = u[keep], v[keep], sim[keep], cap[keep]
    return u, v, sim, cap


def unit(vectors: DataFrame) -> DataFrame:
    """(vec_id, h, i, vec) of every row: the vector at length 1 in double precision and its 128-bit hash.

    All three are null for vectors that are null, empty, zero or not finite, and for rows without a vec_id.
    """

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            size = np.asarray(column.value_lengths().fill_null(0))
            good = np.zeros(batch.num_rows, bool)
            hashes, out = np.zeros((batch.num_rows, 2), np.int64), [None] * batch.num_rows
            known = np.asarray(batch.column(0).is_valid())
            for d in np.unique(size[known & (size > 0)]):
                rows = np.flatnonzero(known & (size == d))
                x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                largest = np.abs(x).max(axis=1)
                fine = np.isfinite(largest) & (largest > 0)
                # the largest component is divided out first, so that no square over- or underflows; -0.0 becomes 0.0
                x = x[fine] / largest[fine][:, None] + 0.0
                x = x / np.sqrt((x * x).sum(axis=1))[:, None]
                for r, v in zip(rows[fine], x):
                    hashes[r] = np.frombuffer(xxhash.xxh3_128_digest(v.tobytes()), np.int64)
                    out[r] = v
                good[rows[fine]] = True
            h, i = (pa.array(hashes[:, k].copy(), mask=~good) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), h, i, pa.array(out, pa.list_(pa.float64()))], names=["vec_id", "h", "i", "vec"])

    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return own.mapInArrow(run, "vec_id long, h long, i long, vec array<double>")


def start(nodes: DataFrame, k: int, orders: int, leaf: int = LEAF, seed: int = 0) -> DataFrame:
    """Candidate lists (u, v, sim) from blocks of vectors on the same side of random hyperplanes.

    A block is cut at random when it has more vectors than a leaf, so no task holds a large group.
    """
    n = nodes.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
    planes = {}

    def code(batches):
        for batch in batches:
            out = []
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                part = batch.take(pa.array(rows))
                x = _matrix(part.column(1))
                if d not in planes:
                    planes[d] = np.random.default_rng([int(d), seed]).normal(size=(orders, int(d), depth))
                for o in range(orders):
                    signs = (x @ planes[d][o]) > 0
                    side = signs @ (1 << np.arange(depth)) if depth else np.zeros(len(x), np.int64)
                    out.append((part, side + (o << 40)))
            for part, side in out:
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(side.astype(np.int64))], names=["id", "vec", "d", "block"])

    coded = nodes.select("id", "vec", F.size("vec").alias("d")).mapInArrow(code, "id long, vec array<double>, d int, block long")
    sizes = coded.groupBy("block", "d").agg(F.count("*").alias("n"))
    cut = coded.join(sizes, ["block", "d"]).withColumn("part", F.pmod(F.xxhash64("id", "block"), F.ceil(F.col("n") / leaf)))

    def run(table):
        ids, x = table.column("id").to_numpy(), _matrix(table.column("vec"))
        us, vs, ss = [], [], []
        for a in range(0, len(ids), 512):
            sim = x[a : a + 512] @ x.T
            sim[np.arange(len(sim)), np.arange(a, a + len(sim))] = -2
            m = min(k, len(ids) - 1)
            if m < 1:
                break
            at = np.argpartition(-sim, m - 1, axis=1)[:, :m]
            us.append(np.repeat(ids[a : a + 512], m))
            vs.append(ids[at].ravel())
            ss.append(np.take_along_axis(sim, at, axis=1).ravel())
        u, v, sim = (np.concatenate(y) if y else np.zeros(0) for y in (us, vs, ss))
        return _edges(u, v, sim, np.full(len(u), k))

    return cut.select("block", "d", "part", "id", "vec").groupBy("block", "d", "part").applyInArrow(run, _EDGE)


def top(lists: DataFrame) -> DataFrame:
    """The best entries of each list, as many as its cap, with their mark ``new`` if they have one."""
    # an entry that was there before isn't new
    marks = [F.min("new").alias("new")] if "new" in lists.columns else []
    distinct = lists.repartition("u").groupBy("u", "v").agg(F.max("sim").alias("sim"), F.max("cap").alias("cap"), *marks)
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return distinct.withColumn("r", rank).where(F.col("r") <= F.col("cap")).drop("r")


def refine(nodes: DataFrame, lists: DataFrame, k: int, groups: int, turn: int = 0, only: DataFrame | None = None) -> DataFrame:
    """Entries (u, v, sim, cap), better than the worst of u's list: neighbours of neighbours, both ways.

    Each vector is a centre; the members of its own list and of the lists that it is in are compared with each other.
    With ``only`` (u) centres without one of these vectors around them are left out, and only their lists gain entries.
    """
    state = lists.groupBy("u").agg(F.min("sim").alias("worst"), F.count("*").alias("full"), F.max("cap").alias("cap"))
    cap = F.coalesce("cap", F.lit(k)).alias("cap")
    known = nodes.join(state, nodes.id == state.u, "left").select("id", "vec", F.when(F.col("full") >= F.col("cap"), F.col("worst")).otherwise(F.lit(-2.0)).alias("worst"), cap)
    own = lists.select(F.col("u").alias("centre"), F.col("v").alias("member"))
    # of the lists that a vector is in, so many are taken at random, others in each round
    turned = lists.select(F.col("v").alias("centre"), F.col("u").alias("member"))
    turned = turned.withColumn("r", F.row_number().over(Window.partitionBy("centre").orderBy(F.xxhash64("member", "centre", F.lit(turn))))).where(F.col("r") <= k).drop("r")
    itself = nodes.select(F.col("id").alias("centre"), F.col("id").alias("member"))
    around = own.unionByName(turned).unionByName(itself)  # a member that comes twice is taken once below
    if only is not None:
        wanted = only.select(F.col("u").alias("member"))
        around = around.join(around.join(wanted, "member", "left_semi").select("centre").distinct(), "centre", "left_semi")
        known = known.join(only.withColumn("grows", F.lit(True)), known.id == only.u, "left").select("id", "vec", F.when(F.col("grows"), F.col("worst")).otherwise(F.lit(2.0)).alias("worst"), "cap")
    there = around.join(known, around.member == known.id).select("centre", "member", "vec", "worst", "cap")

    def run(table):
        centre, member, low, cap = (table.column(c).to_numpy() for c in ("centre", "member", "worst", "cap"))
        order = np.lexsort((member, centre))
        once = np.ones(len(order), bool)
        once[1:] = (centre[order][1:] != centre[order][:-1]) | (member[order][1:] != member[order][:-1])
        order = order[once]
        centre, member, low, cap = centre[order], member[order], low[order], cap[order]
        # the vectors of one centre have one length
        column = table.column("vec").combine_chunks().take(pa.array(order))
        values = column.flatten().to_numpy(zero_copy_only=False)
        at = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))))
        begin = np.flatnonzero(np.concatenate(([True], centre[1:] != centre[:-1]))) if len(centre) else np.zeros(0, np.int64)
        found = [[] for _ in range(4)]
        for a, b in zip(begin, np.append(begin[1:], len(centre))):
            x = values[at[a] : at[b]].reshape(b - a, -1)
            sim = x @ x.T
            np.fill_diagonal(sim, -3)
            i, j = np.nonzero(sim > low[a:b][:, None])
            for out, y in zip(found, (member[a:b][i], member[a:b][j], sim[i, j], cap[a:b][i]), strict=True):
                out.append(y)
        return _edges(*best(*(np.concatenate(y) for y in found))) if found[0] else _edges([], [], [], [])

    return there.withColumn("g", F.pmod(F.xxhash64("centre"), F.lit(groups))).groupBy("g").applyInArrow(run, _EDGE)


def settle(scratch: Scratch, nodes: DataFrame, lists: DataFrame, k: int, name: str, only: DataFrame | None = None) -> DataFrame:
    """The lists refined until they settle. That ends: an entry only gives way to a better one."""
    r, groups = 0, max(1, nodes.count() // CENTRES)
    while True:
        found = refine(nodes, lists, k, groups, r, only).withColumn("new", F.lit(1))
        after = scratch.table(top(lists.withColumn("new", F.lit(0)).unionByName(found)), f"{name}-{r}")
        seen = after.agg(F.sum("new").alias("changed"), F.count("*").alias("entries")).first()
        if r:
            scratch.drop(f"{name}-{r - 1}")
        lists, r = after.drop("new"), r + 1
        if (seen.changed or 0) <= SETTLED * seen.entries:
            return lists


def saturated(lists: DataFrame, threshold: float, k: int) -> DataFrame:
    """(u, full) of lists of k entries or more that are all links: more may be cut off, or, if the list isn't full, lie apart from all it has led to."""
    state = lists.groupBy("u").agg(F.min("sim").alias("low"), F.count("*").alias("size"), F.max("cap").alias("cap"))
    return state.where((F.col("size") >= k) & (F.col("low") >= threshold)).select("u", (F.col("size") >= F.col("cap")).alias("full"))


def descend(scratch: Scratch, nodes: DataFrame, threshold: float, k: int, orders: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(lists, saturated): NN-descent lists (u, v, sim, cap) of ``nodes`` (id, vec), and the vectors whose lists are saturated still.

    After the lists of k have settled, saturated ones are doubled, given new starting blocks, so that they reach beyond
    the group that fills them, and refined again, up to ENLARGED * k entries.
    """
    lists = settle(scratch, nodes, scratch.table(top(start(nodes, k, orders)), f"{name}-first"), k, f"{name}-{k}")
    size = k
    while True:
        open_ = scratch.table(saturated(lists, threshold, k), f"{name}-full-{size}")
        grow = open_.where("full").select("u")
        if size >= ENLARGED * k or grow.isEmpty():
            return lists, open_.select("u")
        size *= 2
        fresh = start(nodes, size, orders, seed=size).join(grow, "u", "left_semi")
        wider = lists.join(grow.withColumn("grows", F.lit(size)), "u", "left").select("u", "v", "sim", F.coalesce("grows", "cap").alias("cap"))
        wider = scratch.table(top(wider.unionByName(fresh)), f"{name}-wide-{size}")
        lists = settle(scratch, nodes, wider, k, f"{name}-{size}", grow)


def audit(nodes: DataFrame, joined: DataFrame, found: DataFrame, threshold: float) -> float:
    """Recall of ``found`` (id, links) against brute force: the mean over linked vectors of each one's share of its links.

    Vectors are drawn apart from large components (node, component of ``joined``), those that a draw over all would meet
    anyway, and within them; the lower of the two recalls counts. So many links of a few groups don't hide lost ones.
    """
    n = nodes.count()
    sizes = joined.groupBy("component").agg((F.count("*") > n / AUDIT).alias("large"))
    placed = joined.join(sizes, "component").select("node", "large")
    strata = nodes.join(placed, nodes.id == placed.node, "left").select("id", "vec", F.coalesce("large", F.lit(False)).alias("large"))
    counts = {r.large: r["count"] for r in strata.groupBy("large").count().collect()}
    share = {x: round(min(1.0, AUDIT / max(1, counts.get(x, 0))) * (1 << 20)) for x in (False, True)}
    drawn = strata.where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 20)) < F.when(F.col("large"), share[True]).otherwise(share[False])).limit(4 * AUDIT).collect()
    if not drawn:
        return 1.0
    queries: dict[int, tuple] = {}
    for d in {len(r.vec) for r in drawn}:
        own = [r for r in drawn if len(r.vec) == d]
        queries[d] = np.array([r.id for r in own]), np.array([r.vec for r in own])

    def run(batches):
        total = {d: np.zeros(len(ids), np.int64) for d, (ids, _) in queries.items()}
        for batch in batches:
            size = np.diff(batch.column(1).offsets.to_numpy())
            for d in np.unique(size):
                if int(d) not in queries:
                    continue
                part = batch.take(pa.array(np.flatnonzero(size == d)))
                x, ids, m = _matrix(part.column(1)), part.column(0).to_numpy(), part.column(2).to_numpy()
                asked, y = queries[int(d)]
                total[int(d)] += m @ ((x @ y.T >= threshold) & (ids[:, None] != asked[None, :]))
        for d, (ids, _) in queries.items():
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[d])], names=["id", "links"])

    exact = nodes.select("id", "vec", "n").mapInArrow(run, "id long, links long").groupBy("id").agg(F.sum("links").alias("exact")).where("exact > 0")
    have = {r.id: min(r.links or 0, r.exact) / r.exact for r in exact.join(found, "id", "left").collect()}
    recalls = [[have[r.id] for r in drawn if r.large == x and r.id in have] for x in (False, True)]
    return min((sum(x) / len(x) for x in recalls if x), default=1.0)


def _slices(component: np.ndarray, x: np.ndarray):
    """Rows by component in slices: (rows, centre, angle around it that holds all)."""
    order = np.argsort(component, kind="stable")
    for k in range(0, len(order), SLICE):
        rows = order[k : k + SLICE]
        centre = x[rows].mean(axis=0)
        length = np.linalg.norm(centre)
        centre = centre / length if length > 1e-9 else x[rows[0]]
        yield rows, centre, np.arccos(np.clip((x[rows] @ centre).min(), -1, 1))


def compare(nodes: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """(u, v, links) of exact comparisons of all ``nodes`` (component, id, n, vec) with each other.

    Rows with a v join u and v by links; rows without one say how many vectors are linked to id u in a pair of tiles.
    Tiles are cut by a hash, and each pair of them is a group. Slices whose angles rule out any link are skipped.
    """
    count = nodes.count()
    tiles = max(1, -(-count // tile), min(TILES, count // FEW))
    reach = np.arccos(threshold) + 1e-6
    cut = nodes.select("component", "id", "n", "vec").withColumn("s", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int"))
    cut = cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    keyed = cut.select(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b"), (F.col("s") > F.col("o")).alias("right"), "component", "id", "n", "vec")

    def run(table):
        component, ids, n = (table.column(c).to_numpy() for c in ("component", "id", "n"))
        right = table.column("right").to_numpy(zero_copy_only=False).astype(bool)
        same = table.column("a")[0].as_py() == table.column("b")[0].as_py()
        vec = table.column("vec").combine_chunks()
        size = vec.value_lengths().to_numpy(zero_copy_only=False)
        total, roots = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for d in np.unique(size):
            here = np.flatnonzero(size == d)
            x = np.zeros((len(ids), d)) if len(here) < len(ids) else None
            part = _matrix(vec.take(pa.array(here)))
            if x is None:
                x = part
            else:
                x[here] = part
            mine, theirs = (here, here) if same else (here[~right[here]], here[right[here]])
            left = [(mine[r], c, w) for r, c, w in _slices(component[mine], x[mine])]
            other = left if same else [(theirs[r], c, w) for r, c, w in _slices(component[theirs], x[theirs])]
            for p, (rows, centre, angle) in enumerate(left):
                for q, (cols, middle, wide) in enumerate(other):
                    if (same and q < p) or np.arccos(np.clip(centre @ middle, -1, 1)) > angle + wide + reach:
                        continue
                    near = x[rows] @ x[cols].T >= threshold
                    if same and p == q:
                        np.fill_diagonal(near, False)
                    elif near.any():
                        total[cols] += near.T @ n[rows]
                    i, j = np.nonzero(near)
                    if len(i):
                        total[rows] += near @ n[cols]
                        if (roots[rows[i]] != roots[cols[j]]).any():
                            roots = link_roots(len(ids), [(rows[i], cols[j])], roots)
        on, some = np.flatnonzero(roots != np.arange(len(ids))), np.flatnonzero(total)
        v = pa.array([*ids[roots[on]].tolist(), *[None] * len(some)], pa.int64())
        return pa.table({"u": pa.array(np.concatenate((ids[on], ids[some])), pa.int64()), "v": v, "links": pa.array(np.concatenate((np.zeros(len(on), np.int64), total[some])))})

    return keyed.groupBy("a", "b").applyInArrow(run, "u long, v long, links long")


def link(scratch: Scratch, nodes: DataFrame, threshold: float, k: int, orders: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(components, links): of the threshold edges of NN-descent lists, and of exact comparisons of vectors whose lists stay saturated.

    A pair that no list holds has a saturated list at both ends; so an edge with another end is counted from the lists,
    and pairs of two such vectors are all compared and counted there.
    """
    lists, full = descend(scratch, nodes, threshold, k, orders, f"{name}-lists")
    near = lists.where(F.col("sim") >= threshold).select("u", "v")
    both = near.unionByName(near.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    marked = scratch.table(nodes.select("id", "n").join(full.select(F.col("u").alias("id"), F.lit(True).alias("full")), "id", "left"), f"{name}-marked")
    edges = both.join(marked.select(F.col("id").alias("v"), "n", F.col("full").alias("there")), "v").join(marked.select(F.col("id").alias("u"), F.col("full").alias("here")), "u")
    counted = edges.where(F.col("here").isNull() | F.col("there").isNull()).groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("links"))
    joining = near
    if not full.isEmpty():
        # vectors with a common neighbour lie together in a slice
        own = near.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
        ends = nodes.join(full, nodes.id == full.u, "left_semi").join(own, "id").select("component", "id", "n", "vec")
        found = scratch.table(compare(scratch.table(ends, f"{name}-ends"), threshold), f"{name}-exact")
        joining = near.unionByName(found.where("v is not null").select("u", "v"))
        counted = counted.unionByName(found.where("v is null").select(F.col("u").alias("id"), "links")).groupBy("id").agg(F.sum("links").alias("links"))
    joined = scratch.table(components(Scratch(scratch.spark, f"{name}-cc"), joining), f"{name}-whole")
    return joined, scratch.table(counted, f"{name}-links")


def exact(scratch: Scratch, nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(components, links) as of ``link``, by comparing all vectors."""
    found = scratch.table(compare(nodes.withColumn("component", F.col("id")), threshold), "exact")
    joined = components(Scratch(scratch.spark, "exact-cc"), found.where("v is not null").select("u", "v"))
    return joined, found.where("v is null").groupBy(F.col("u").alias("id")).agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding).

    Equal vectors (after scaling) are one node with a count; rows, not vec_ids, are linked, and rows that share a vec_id
    are rows of their own. NN-descent links the nodes; its recall is audited against brute force for a bounded sample,
    lists are doubled while it falls short, and at last all vectors are compared. Links are pairs with a cosine of at
    least ``threshold`` in double precision, and n_links counts rows. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows with a null id, link with nothing; nor do vectors of different lengths. Other
    columns aren't read; an empty table gives an empty result.
    """
    scratch = Scratch(vectors.sparkSession, "nn")
    units = unit(vectors)
    grouped = units.where("h is not null").groupBy("h", "i").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    nodes = scratch.table(grouped.withColumn("id", F.monotonically_increasing_id()), "nodes")
    joined = links = None
    for attempt in range(ATTEMPTS):
        joined, links = link(scratch, nodes, threshold, neighbours << attempt, ORDERS << attempt, f"try-{attempt}")
        if audit(nodes, joined, links, threshold) >= RECALL:
            break
    else:
        joined, links = exact(scratch, nodes, threshold)
    rooted = nodes.select("id", "h", "i", "n", "vec_id").join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("component", "id"))
    smallest = rooted.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    classes = rooted.join(links, "id", "left").join(smallest, "root")
    classes = scratch.table(classes.select("h", "i", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component_id"), "classes")
    placed = units.select("vec_id", "h", "i").join(classes, ["h", "i"], "left")
    out = placed.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
