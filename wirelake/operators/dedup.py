"""Duplicate captures by content and by size signature."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def content_hashes(packets: DataFrame, key: str = "path", order: str = "packet_index") -> DataFrame:
    """(key, content_hash): SHA-256 of a file's packets joined in order. Files without packets have none.

    For files of moderate size: a file's bytes are put together in one row.
    """
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), F.hex("data").alias("x"))))
    joined = F.array_join(F.transform(parts, lambda p: p["x"]), "")
    return packets.where("data is not null").groupBy(key).agg(F.sha2(F.unhex(joined), 256).alias("content_hash"))


def content_hashes_streamed(packets: DataFrame, key: str = "path", order: str = "packet_index") -> DataFrame:
    """The same with a digest that is fed packet by packet: files of any size, in partitions sorted by file and order."""
    ordered = packets.where("data is not null").select(key, order, "data").repartition(key).sortWithinPartitions(key, order)

    def run(batches):
        at, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if digest is None or k != at:
                    if digest is not None:
                        done.append((at, digest.hexdigest()))
                    at, digest = k, hashlib.sha256()
                digest.update(data.as_buffer())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], batch.schema.field(0).type), pa.array([d[1] for d in done])], names=[key, "content_hash"])
            kind = batch.schema.field(0).type
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], kind), pa.array([digest.hexdigest()])], names=[key, "content_hash"])

    return ordered.mapInArrow(run, f"{key} {dict(packets.dtypes)[key]}, content_hash string")


def size_signatures(packets: DataFrame, key: str = "path", size=None) -> DataFrame:
    """(key, signature): MD5 of the number of packets and their sizes in ascending order, joined by colons."""
    sizes = F.array_sort(F.collect_list(F.octet_length("data") if size is None else size))
    text = F.concat(F.size(sizes).cast("string"), F.lit(":"), F.array_join(F.transform(sizes, lambda s: s.cast("string")), ":"))
    return packets.where("data is not null").groupBy(key).agg(F.md5(text).alias("signature"))


def groups(hashes: DataFrame, key: str = "path") -> DataFrame:
    """(content_hash, files, n) of the hashes that more than one file has, files in order."""
    return hashes.groupBy("content_hash").agg(F.sort_array(F.collect_list(key)).alias("files"), F.count("*").alias("n")).where("n > 1")


def duplicates(packets: DataFrame, method: str = "smart", key: str = "path") -> DataFrame:
    """Duplicate groups. fast, batch: by content alone, whatever the packets' bounds. smart: only files whose size signature occurs again are hashed."""
    if method in ("fast", "batch"):
        return groups(content_hashes_streamed(packets, key), key)
    if method != "smart":
        raise ValueError(f"unknown method: {method}")
    signed = size_signatures(packets, key)
    again = signed.groupBy("signature").agg(F.count("*").alias("k")).where("k > 1")
    candidates = signed.join(again, "signature", "left_semi").select(key)
    return groups(content_hashes_streamed(packets.join(candidates, key, "left_semi"), key), key)


def to_delete(found: DataFrame) -> DataFrame:
    """(path) of all but the first file of each group, in order."""
    return found.select(F.explode(F.expr("slice(files, 2, greatest(size(files) - 1, 0))")).alias("path")).orderBy("path")


def summary(found: DataFrame) -> DataFrame:
    """Groups, files in them, and files that could go."""
    return found.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removable"))


def largest_groups(found: DataFrame, k: int = 10, show: int = 3) -> DataFrame:
    return found.orderBy(F.desc("n"), "content_hash").limit(k).select("content_hash", "n", F.slice("files", 1, show).alias("files"))


def known_again(hashes: DataFrame, known: DataFrame) -> DataFrame:
    """New files whose content hash is among the known ones: one step of incremental detection."""
    return hashes.join(known.select("content_hash").distinct(), "content_hash", "left_semi")


def first_of_each(hashes: DataFrame, key: str = "path") -> DataFrame:
    """The first file of each content."""
    rank = F.row_number().over(Window.partitionBy("content_hash").orderBy(key))
    return hashes.withColumn("r", rank).where("r = 1").drop("r")
