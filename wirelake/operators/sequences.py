"""Positions, documents and masks of packed sequences; pooling of vectors by patch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def starts(lengths: DataFrame, by: str = "seq_id", order: str = "doc_id", length: str = "length") -> DataFrame:
    """The lengths with ``start``: the sum of those before."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return lengths.withColumn("start", F.coalesce(F.sum(length).over(w), F.lit(0)))


def document_positions(lengths: DataFrame, by: str = "seq_id", order: str = "doc_id", length: str = "length") -> DataFrame:
    """(seq, doc, pos, local): each position of a packed sequence with its document and its place in it."""
    placed = starts(lengths, by, order, length).where(F.col(length) > 0)
    local = placed.select(by, order, "start", F.explode(F.sequence(F.lit(0), F.col(length) - 1)).alias("local"))
    return local.select(by, order, (F.col("start") + F.col("local")).alias("pos"), "local")


def segment_lengths(tokens: DataFrame, eos: int, row: str = "row", pos: str = "pos", token: str = "token") -> DataFrame:
    """(row, pos, length) of the segments that end with ``eos``, or with the row."""
    ends = tokens.withColumn("_last", F.max(pos).over(Window.partitionBy(row))).where((F.col(token) == eos) | (F.col(pos) == F.col("_last")))
    before = F.lag(pos, 1, -1).over(Window.partitionBy(row).orderBy(pos))
    return ends.select(row, pos, (F.col(pos) - before).alias("length"))


def segment_lengths_of(ids: Column, eos: int) -> Column:
    """The same for an array: lengths of its segments."""
    ends = F.filter(F.transform(ids, lambda x, i: F.when((x == eos) | (i == F.size(ids) - 1), i)), lambda i: i.isNotNull())
    return F.transform(ends, lambda e, k: e - F.when(k == 0, F.lit(-1)).otherwise(F.get(ends, k - 1)))


def causal_pairs(positions: DataFrame, doc: str = "doc_id", pos: str = "pos", window: int | None = None, keep: str | None = None) -> DataFrame:
    """(doc, q, k): positions that may attend to each other: k up to q in the same document, no farther back than the window."""
    q = positions.select(F.col(doc), F.col(pos).alias("q"))
    k = positions.select(F.col(doc), F.col(pos).alias("k"))
    cond = F.col("k") <= F.col("q")
    if window is not None:
        cond = cond & (F.col("k") > F.col("q") - window)
    return q.join(k, doc).where(cond)


def causal_pair_count(lengths: DataFrame, window: int | None = None, length: str = "length") -> DataFrame:
    """The number of those pairs from the lengths alone, without making them."""
    n = F.col(length).cast("long")
    if window is None:
        pairs = n * (n + 1) / 2
    else:
        w = F.least(n, F.lit(window).cast("long"))
        pairs = w * (w + 1) / 2 + (n - w) * w
    return lengths.agg(F.sum(pairs.cast("long")).alias("pairs"))


#: Masks by implementation and kind of bias: which relation holds. Anything else is an error.
MASKS = {
    ("xformers", None): "causal",
    ("xformers", "causal"): "causal",
    ("xformers", "block_causal"): "document",
    ("xformers", "local_block_causal"): "document window",
    ("xformers", "local"): "window",
    ("sdpa", "causal"): "causal",
    ("flex_attention", None): "causal",
    ("fmha", None): "none",
}


def mask_kind(implementation: str, bias: str | None, window: int | None = None, ignore: bool = False) -> str:
    """The relation that a combination stands for; ``ignore`` takes sdpa with any bias as causal. A window where none is allowed is an error."""
    if implementation == "sdpa" and ignore:
        return "causal"
    key = (implementation, bias if implementation in ("xformers", "sdpa") else None)
    if implementation == "xformers" and key not in MASKS:
        key = ("xformers", "local")
    if key not in MASKS:
        raise ValueError(f"no mask for {implementation} with {bias}")
    kind = MASKS[key]
    if implementation == "xformers" and window is not None and "window" not in kind:
        raise ValueError(f"{bias} takes no window")
    if "window" in kind and window is None:
        raise ValueError(f"{bias} needs a window")
    return kind


def separator_positions(ids: Column, separator: int) -> Column:
    """How many other tokens stand before each separator: byte places in a token list."""
    places = F.filter(F.transform(ids, lambda x, i: F.when(x == separator, i)), lambda i: i.isNotNull())
    return F.transform(places, lambda p, k: p - k)


def fields_of(ids: Column, separator: int) -> Column:
    """The token list cut at separators, as an array of arrays."""
    ends = F.concat(F.filter(F.transform(ids, lambda x, i: F.when(x == separator, i)), lambda i: i.isNotNull()), F.array(F.size(ids)))
    return F.transform(ends, lambda e, k: F.slice(ids, F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1) + 1) + 1, e - F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1) + 1)))


def text_and_capture(text_ids: Column, capture_ids: Column) -> Column:
    """Text followed by a capture, as one sequence."""
    return F.concat(text_ids, capture_ids)


def wrap(ids: Column, before: int, after: int) -> Column:
    return F.concat(F.array(F.lit(before)), ids, F.array(F.lit(after)))


def pool(vectors: DataFrame, modes: tuple[str, ...] = ("avg",), by: tuple[str, ...] = ("seq_id", "patch_id"), vec: str = "vec") -> DataFrame:
    """(by, pooled): mean, least and greatest of each component over a patch, in that order one after another, as far as asked for."""
    dims = vectors.select(*by, F.posexplode(vec).alias("dim", "x"))
    wanted = [(n, f) for n, f, names in (("a", F.avg("x"), {"avg", "mean"}), ("b", F.min("x"), {"min"}), ("c", F.max("x"), {"max"})) if names & set(modes)]
    per = dims.groupBy(*by, "dim").agg(*[f.cast("double").alias(n) for n, f in wanted])
    rows = F.array_sort(F.collect_list(F.struct("dim", *[n for n, _ in wanted])))

    def column(n):
        return F.transform(rows, lambda r: r[n])

    return per.groupBy(*by).agg(F.concat(*[column(n) for n, _ in wanted]).alias("pooled"))


def concat_patches(vectors: DataFrame, lengths: DataFrame, size: int, seq: str = "seq_id", patch: str = "patch_id", pos: str = "pos", vec: str = "vec") -> DataFrame:
    """(seq, patch, joined): the last ``size`` vectors up to the end of each patch, one after another; places before the start are its first."""
    w = Window.partitionBy(seq).orderBy(patch)
    ends = lengths.withColumn("_end", F.sum("length").over(w))
    wanted = ends.select(seq, patch, F.posexplode(F.sequence(F.lit(size), F.lit(1), F.lit(-1))).alias("k", "back"), "_end")
    wanted = wanted.select(seq, patch, "k", F.greatest(F.col("_end") - F.col("back"), F.lit(0)).alias(pos))
    got = wanted.join(vectors.select(seq, pos, vec), [seq, pos])
    parts = F.array_sort(F.collect_list(F.struct("k", vec)))
    return got.groupBy(seq, patch).agg(F.flatten(F.transform(parts, lambda p: p[vec])).alias("joined"))


def downsample(vectors: DataFrame, lengths: DataFrame | None = None, modes: tuple[str, ...] = (), size: int = 1) -> DataFrame:
    """Pooling if modes are given, else concatenation."""
    return pool(vectors, modes) if modes else concat_patches(vectors, lengths, size)


def batches(rows: DataFrame, size: int, order: str) -> DataFrame:
    """Rows with a batch number in the order of ``order``; places come from counts of ranges, not from one sorted partition."""
    ranged = rows.repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id())
    ranged = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1)
    before = ranged.groupBy("_p").agg(F.count("*").alias("_k"))
    before = before.select("_p", (F.sum("_k").over(Window.orderBy("_p")) - F.col("_k")).alias("_before"))
    return ranged.join(F.broadcast(before), "_p").withColumn("batch", F.expr(f"(_before + _n) div {size}")).drop("_p", "_n", "_before")  # one row a partition


def shuffled(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """The rows in an order that a hash of the key and the seed fixes."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def head(rows: DataFrame, n: int, order: str) -> DataFrame:
    return rows.orderBy(order).limit(n)


def latest(files: DataFrame) -> DataFrame:
    """The path that was modified last."""
    return files.agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def sample_files(files: DataFrame, n: int = 5, seed: int = 0) -> DataFrame:
    return files.orderBy(F.xxhash64("path", F.lit(seed)), "path").limit(n)


def training_grid(spark, kinds: list[str], sizes: list[int]) -> DataFrame:
    """Every kind of model with every size."""
    return spark.createDataFrame([(k, s) for k in kinds for s in sizes], "model_type string, vocab_size int")
