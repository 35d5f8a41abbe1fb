"""Streams: capture files as they arrive, duplicates across batches, windows in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.operators.dedup import content_hashes_streamed
from wirelake.sources.captures import stream_captures

__all__ = ["new_duplicates", "packet_rates", "run_now", "sessions", "stream_captures", "token_stream", "windows", "write_chunks_stream"]


def token_stream(packets: DataFrame) -> DataFrame:
    """(path, packet_index, ids) of a stream of packets."""
    from wirelake.functions.tokens import byte_tokens
    from wirelake.functions.vocab import TOKEN

    return packets.where("data is not null").select("path", "packet_index", byte_tokens(F.col("data"), TOKEN).alias("ids"))


def windows(events: DataFrame, size: str, by: str = "event_type", ts: str = "ts", late: str = "10 minutes", slide: str | None = None, value: str = "value") -> DataFrame:
    """Count and sum in tumbling (or with ``slide`` sliding) windows of event time; rows later than ``late`` are left out."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = events.withWatermark(ts, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def sessions(events: DataFrame, gap: str, by: str = "user_id", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Sessions that end after a gap."""
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def packet_rates(packets: DataFrame, size: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Packets and bytes by capture time."""
    w = F.window("ts", size)
    out = packets.where("data is not null").withWatermark("ts", late).groupBy(w.alias("w")).agg(F.count("*").alias("packets"), F.sum("caplen").alias("bytes"))
    return out.select(F.col("w.start").alias("start"), "packets", "bytes")


def new_duplicates(packets: DataFrame, known: str, out: str, checkpoint: str):
    """A query that hashes the files of each batch, writes those whose content was seen (earlier, or in a file before it in the batch) to ``out`` and adds new contents to ``known``.

    A batch that is run again replaces its own folders, so results don't double.
    """
    from wirelake.operators.dedup import first_of_each

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        hashes = content_hashes_streamed(batch).withColumn("batch", F.lit(number)).persist()
        seen = spark.read.schema("path string, content_hash string").parquet(known).where(F.col("batch_id") < number) if _exists(spark, known) else None
        fresh = hashes if seen is None else hashes.join(seen.select("content_hash"), "content_hash", "left_anti")
        first = first_of_each(fresh).select("path", "content_hash")
        first.write.mode("overwrite").parquet(f"{known}/batch_id={number}")
        hashes.select("path", "content_hash").join(first.select("path"), "path", "left_anti").write.mode("overwrite").parquet(f"{out}/batch_id={number}")
        hashes.unpersist()

    return packets.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def _exists(spark, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def write_chunks_stream(sequences: DataFrame, path: str, checkpoint: str):
    """Appends token sequences as Parquet."""
    return sequences.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def run_now(writer):
    """Runs a stream over what is there, then stops."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query
