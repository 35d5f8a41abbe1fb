"""Statistics of packets, bytes, tokens and corpora."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake.functions.vocab import Vocabulary


def packet_stats(packets: DataFrame, by: str = "path") -> DataFrame:
    """Count, sum, average, least and largest size of each file's packets."""
    size = F.octet_length("data")
    return packets.where("data is not null").groupBy(by).agg(
        F.count("*").alias("packets"), F.sum(size).alias("total_bytes"), F.avg(size).alias("avg_bytes"), F.min(size).alias("min_bytes"), F.max(size).alias("max_bytes")
    )


def byte_histogram(packets: DataFrame, data: str = "data") -> DataFrame:
    """(byte, n, share) of all bytes: 256 counts a task, then one small aggregate; share in percent."""

    def run(batches):
        total = np.zeros(256, np.int64)
        for batch in batches:
            column = batch.column(0).cast(pa.large_binary())
            _, offsets, values = column.buffers()
            at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
            if values is not None:
                total += np.bincount(np.frombuffer(values, np.uint8)[at[0] : at[-1]], minlength=256)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["byte", "n"])

    counted = packets.select(F.col(data).alias("data")).mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.join(F.broadcast(total)).select("byte", "n", (100.0 * F.col("n") / F.col("total")).alias("share"))  # one row


def top_bytes(histogram: DataFrame, k: int = 10, least: bool = False) -> DataFrame:
    """The k most (or least) frequent bytes; ties by byte."""
    return histogram.orderBy(F.asc("n") if least else F.desc("n"), "byte").limit(k)


def missing_bytes(histogram: DataFrame) -> DataFrame:
    """The byte values that don't occur."""
    return histogram.sparkSession.range(256).select(F.col("id").cast("int").alias("byte")).join(histogram.select("byte"), "byte", "left_anti")


def coverage(histogram: DataFrame) -> DataFrame:
    """Distinct byte values and their share of 256 in percent."""
    return histogram.agg(F.count("*").alias("distinct_bytes"), (100.0 * F.count("*") / 256).alias("coverage"))


def special_counts(ids: Column, v: Vocabulary) -> list[Column]:
    """Columns with the number of each special token and of byte tokens in a sequence."""

    def number(k):
        return F.size(F.filter(ids, lambda x: x == k))

    return [*(number(k).alias("n_" + t.strip("</>")) for t, k in v.specials.items()), F.size(F.filter(ids, lambda x: x >= v.offset)).alias("n_bytes")]


def corpus_stats(lines: DataFrame, sample: int = 1000, line: str = "value", number: str = "line_no") -> DataFrame:
    """Lines, tokens, their average, most and least a line; distinct tokens in the first ``sample`` physical lines (blank ones counted); size in MB.

    Blank lines count for the number only.
    """
    text = F.trim(F.col(line), F.lit(" \t\r\n\x0b\x0c"))
    words = F.split(text, "\\s+")
    full = lines.where(text != "").select(F.size(words).alias("k"), F.octet_length(line).alias("b"))
    totals = full.agg(
        F.count("*").alias("total_lines"),
        F.coalesce(F.sum("k"), F.lit(0)).alias("total_tokens"),
        F.avg("k").alias("avg_tokens_per_line"),
        F.max("k").alias("max_tokens_per_line"),
        F.min("k").alias("min_tokens_per_line"),
        (F.sum(F.col("b") + 1) / 1048576).alias("file_size_mb"),
    )
    first = lines.where((F.col(number) <= sample) & (text != "")).select(F.explode(words).alias("w")).agg(F.count_distinct("w").alias("unique_tokens_sample"))
    return totals.join(F.broadcast(first))  # one row each


def builder_totals(lines: DataFrame) -> DataFrame:
    """Files, packets, bytes and separators of a corpus, and averages."""
    return lines.agg(
        F.count_distinct("path").alias("files"),
        F.count("*").alias("packets"),
        F.sum("bytes").alias("bytes"),
        F.sum("separators").alias("separators"),
        F.avg("bytes").alias("avg_bytes"),
        F.avg("separators").alias("avg_separators"),
    )


def malformed_counts(malformed: DataFrame) -> DataFrame:
    return malformed.groupBy("error_type").agg(F.count("*").alias("n"))


def eval_stats(pieces: DataFrame, vocabulary: int, samples: int = 1000) -> DataFrame:
    """Of (tokens, pieces array) by line: totals, compression, share of the vocabulary used.

    avg_pieces_ref divides by the lesser of ``samples`` and the tokens, as reported figures do; avg_pieces is the mean.
    """
    used = pieces.select(F.explode("pieces").alias("p")).agg(F.count_distinct("p").alias("unique_pieces"))
    totals = pieces.agg(F.count("*").alias("lines"), F.sum("tokens").alias("total_tokens"), F.sum(F.size("pieces")).alias("total_pieces"))
    both = totals.join(F.broadcast(used))  # one row each
    return both.select(
        "lines",
        "total_tokens",
        "total_pieces",
        "unique_pieces",
        (F.col("total_tokens") / F.col("total_pieces")).alias("compression_ratio"),
        (F.col("total_pieces") / F.least(F.lit(samples), F.col("total_tokens"))).alias("avg_pieces_ref"),
        (F.col("total_pieces") / F.col("lines")).alias("avg_pieces"),
        (F.col("unique_pieces") / F.lit(vocabulary)).alias("utilization"),
    )


def piece_counts(pieces: DataFrame, k: int | None = None) -> DataFrame:
    """(piece, n), most frequent first, ties by piece."""
    counted = pieces.select(F.explode("pieces").alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "piece").limit(k) if k else counted


def first_difference(a: Column, b: Column) -> Column:
    """Place (from 0) of the first byte that differs between two binaries, or null; a length that ends counts."""
    x, y = (F.regexp_extract_all(F.hex(c), F.lit(".."), F.lit(0)) for c in (a, b))
    differs = F.transform(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p, i: F.when(~p["x"].eqNullSafe(p["y"]), i))
    return F.array_min(differs)


def summary_fields(info: Column) -> list[Column]:
    """Vocabulary size, kind of model and compression of a training record in JSON; ``unknown`` where missing."""
    paths = {"vocab_size": "$.training_stats.vocab_size", "model_type": "$.training_stats.model_type", "compression_ratio": "$.evaluation_stats.compression_ratio"}
    return [F.coalesce(F.get_json_object(info, p), F.lit("unknown")).alias(k) for k, p in paths.items()]
