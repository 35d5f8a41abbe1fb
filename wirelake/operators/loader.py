"""Training batches from chunk tables, as a whole and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.functions.tokens import model_input, model_target, pad_or_cut
from wirelake.operators.sequences import batches

CHUNKS = "chunk_idx long, filename string, source_file string, num_tokens int, tokens array<int>"


def epochs(chunks: DataFrame, n: int, seed: int = 0, shuffle: bool = True) -> DataFrame:
    """The chunks ``n`` times over with ``epoch`` and ``order``: by a hash of index, seed and epoch, another one each time, or by index."""
    again = chunks.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    by = F.xxhash64("chunk_idx", F.lit(seed), "epoch") if shuffle else F.col("chunk_idx")
    return again.withColumn("order", by)


def loader(chunks: DataFrame, length: int, batch: int, n_epochs: int = 1, seed: int = 0, shuffle: bool = True, rank: int = 0, world: int = 1, pad: int = 0) -> DataFrame:
    """(epoch, batch, chunk_idx, input, target): a rank's share of the chunks, shuffled in each epoch, padded or cut to ``length`` ids and dealt to batches.

    Batches run on from one epoch to the next; the last may be shorter.
    """
    own = chunks.where((F.size("tokens") > 0) & (F.pmod("chunk_idx", F.lit(world)) == rank))
    placed = epochs(own, n_epochs, seed, shuffle).withColumn("place", F.struct("epoch", "order", "chunk_idx"))
    ids = pad_or_cut(F.col("tokens"), length, pad)
    return batches(placed, batch, "place").select("epoch", F.col("batch").cast("long").alias("batch"), "chunk_idx", model_input(ids).alias("input"), model_target(ids).alias("target"))


def stream_chunks(spark: SparkSession, path: str, length: int, files_a_batch: int | None = None, pad: int = 0) -> DataFrame:
    """Chunks as they arrive in a folder, as model inputs and targets; files that can't be read are skipped."""
    reader = spark.readStream.schema(CHUNKS).option("ignoreCorruptFiles", True)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    ids = pad_or_cut(F.col("tokens"), length, pad)
    return reader.parquet(path).where(F.size("tokens") > 0).select("chunk_idx", model_input(ids).alias("input"), model_target(ids).alias("target"))
