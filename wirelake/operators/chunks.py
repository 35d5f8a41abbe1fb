"""Training chunks of token sequences, with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wirelake.functions.dissect import SeparatorConfig, separated_tokens
from wirelake.functions.tokens import byte_tokens
from wirelake.functions.vocab import TOKEN, Vocabulary


#: Packets whose lengths one running sum adds up.
RUN = 4096


def packet_sequences(packets: DataFrame, v: Vocabulary = TOKEN, separators: bool = True, bos: bool = False, eos: bool = False, fields: SeparatorConfig | None = None, dense: bool = True) -> DataFrame:
    """(path, packet_index, ids): each packet's ids, with <pkt> in front of all but the first of a file, <bos> and <eos> at the file's ends, and with ``fields`` <sep> between fields.

    Indices run from 0 in each file if ``dense``; otherwise the first is looked up, as is the last for <eos>: one row a file.
    """
    ids = byte_tokens(F.col("data"), v) if fields is None else separated_tokens(F.col("data"), fields, v.offset, v.specials["<sep>"])
    out = packets.where("data is not null").select("path", "packet_index", ids.alias("ids"))
    s = v.specials

    def one(cond, name):
        return F.when(cond, F.array(F.lit(s[name]))).otherwise(F.array().cast("array<int>"))

    parts, begin = [F.col("ids")], F.lit(0)
    if eos or not dense:
        ends = packets.where("data is not null").groupBy("path").agg(F.min("packet_index").alias("_first"), F.max("packet_index").alias("_last"))
        out = out.join(ends, "path")
        begin = begin if dense else F.col("_first")
    if separators and "<pkt>" in s:
        parts.insert(0, one(F.col("packet_index") > begin, "<pkt>"))
    if bos:
        parts.insert(0, one(F.col("packet_index") == begin, "<bos>"))
    if eos:
        parts.append(one(F.col("packet_index") == F.col("_last"), "<eos>"))
    return out.select("path", "packet_index", F.concat(*parts).alias("ids"))


def file_sequence(sequences: DataFrame) -> DataFrame:
    """(path, ids): all of a file's ids in order, for files that fit a row."""
    parts = F.array_sort(F.collect_list(F.struct("packet_index", "ids")))
    return sequences.groupBy("path").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def cut(sequences: DataFrame, size: int = 2048) -> DataFrame:
    """(path, local_idx, num_tokens, tokens): a file's ids in chunks of ``size``, the last shorter.

    A file is never put together: each packet is placed by running sums of lengths, over the runs of RUN indices of a file
    and within each, and cut where chunks end; only the pieces of one chunk meet.
    """
    n = F.size("ids")
    runs = sequences.where(n > 0).withColumn("run", F.floor(F.col("packet_index") / RUN))
    per_run = runs.groupBy("path", "run").agg(F.sum(n).alias("k"))
    first = per_run.select("path", "run", (F.sum("k").over(Window.partitionBy("path").orderBy("run")) - F.col("k")).alias("first"))
    within = F.coalesce(F.sum(n).over(Window.partitionBy("path", "run").orderBy("packet_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = runs.withColumn("within", within).join(first, ["path", "run"]).withColumn("start", F.col("first") + F.col("within"))
    first, last = F.expr(f"start div {size}"), F.expr(f"(start + size(ids) - 1) div {size}")
    pieces = placed.select("path", "packet_index", "start", "ids", F.explode(F.sequence(first, last)).alias("local_idx"))
    lo = F.greatest(F.col("local_idx") * size - F.col("start"), F.lit(0))
    hi = F.least((F.col("local_idx") + 1) * size - F.col("start"), F.size("ids"))
    pieces = pieces.select("path", "local_idx", "packet_index", F.slice("ids", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("part"))
    parts = F.array_sort(F.collect_list(F.struct("packet_index", "part")))
    chunks = pieces.groupBy("path", "local_idx").agg(F.flatten(F.transform(parts, lambda p: p["part"])).alias("tokens"))
    return chunks.select("path", "local_idx", F.size("tokens").alias("num_tokens"), "tokens")


def number(chunks: DataFrame, extension: str = "npy") -> DataFrame:
    """Chunks with a contiguous ``chunk_idx`` in the order of file and place, and a file name.

    Numbers come from a running sum over files, one row each, so chunks aren't sorted as a whole.
    """
    per_file = chunks.groupBy("path").agg(F.count("*").alias("k"))
    start = per_file.select("path", (F.sum("k").over(Window.orderBy("path")) - F.col("k")).alias("first"))
    numbered = chunks.join(start, "path").withColumn("chunk_idx", F.col("first") + F.col("local_idx"))
    return numbered.select("chunk_idx", F.format_string(f"chunk_%08d.{extension}", "chunk_idx").alias("filename"), F.col("path").alias("source_file"), "num_tokens", "tokens")


def source_files(chunks: DataFrame, files: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Of each file (path, length): size, tokens, first chunk, chunks, and how it went: success, error (with what ``errors``, of path and error, says) or no tokens."""
    per = chunks.groupBy("source_file").agg(F.sum("num_tokens").alias("num_tokens"), F.min("chunk_idx").alias("chunk_start_idx"), F.count("*").alias("num_chunks"))
    joined = files.join(per, files.path == per.source_file, "left")
    if errors is None:
        joined = joined.withColumn("error", F.lit(None).cast("string"))
    else:
        joined = joined.join(errors.groupBy(F.col("path").alias("_path")).agg(F.min("error").alias("error")), F.col("path") == F.col("_path"), "left")
    return joined.select(
        F.col("path").alias("file_path"),
        F.col("length").alias("file_size_bytes"),
        F.coalesce("num_tokens", F.lit(0)).alias("num_tokens"),
        "chunk_start_idx",
        F.coalesce("num_chunks", F.lit(0)).alias("num_chunks"),
        F.when(F.col("error").isNotNull(), "error").when(F.col("num_tokens") > 0, "success").otherwise("No tokens generated").alias("status"),
        "error",
    )


def manifest(sources: DataFrame) -> DataFrame:
    """Chunks, tokens, files that gave tokens and files that didn't."""
    ok = F.col("status") == "success"
    return sources.agg(
        F.coalesce(F.sum("num_chunks"), F.lit(0)).alias("total_chunks"),
        F.coalesce(F.sum("num_tokens"), F.lit(0)).alias("total_tokens"),
        F.count(F.when(ok, 1)).alias("successful_files"),
        F.count(F.when(~ok, 1)).alias("failed_files"),
    )


def chunk_count(n, size: int):
    """How many chunks n tokens make."""
    return F.expr(f"({n} + {size} - 1) div {size}")


def chunk_at(chunks: DataFrame, i: int) -> DataFrame:
    return chunks.where(F.col("chunk_idx") == i)


def estimate(chunks: DataFrame, files: int = 100) -> DataFrame:
    """Average chunks of a file over the first ``files`` files; 1 if there are no more than that."""
    per = chunks.groupBy("source_file").agg(F.count("*").alias("k"))
    first = per.orderBy("source_file").limit(files + 1)
    mean = first.orderBy("source_file").limit(files).agg(F.avg("k").alias("m"))
    return first.agg(F.count("*").alias("c")).join(F.broadcast(mean)).select(F.when(F.col("c") > files, F.col("m")).otherwise(F.lit(1.0)).alias("chunks_per_file"))  # one row each
