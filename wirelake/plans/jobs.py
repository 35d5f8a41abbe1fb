"""The end-to-end jobs: captures to training chunks, to a text corpus, to a vocabulary, to a list of duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.functions.dissect import SeparatorConfig, malformed
from wirelake.functions.sentences import corpus
from wirelake.functions.vocab import FIELD, TOKEN, Vocabulary
from wirelake.operators import chunks, dedup, stats, subwords
from wirelake.sources import captures, sinks


def tokenize_captures(spark: SparkSession, path: str, packet_separators: bool = True, field_separators: bool = False, bos: bool = False, eos: bool = False, v: Vocabulary = FIELD, config: SeparatorConfig = SeparatorConfig()) -> DataFrame:
    """(path, ids): each capture as one token sequence. A capture without packets has no row, or with ``bos``/``eos`` those alone."""
    packets = captures.read_captures(spark, path, mode="drop")
    made = chunks.packet_sequences(packets, v, packet_separators, bos, eos, config if field_separators else None)
    whole = chunks.file_sequence(made)
    ends = [v.specials[t] for t, on in (("<bos>", bos), ("<eos>", eos)) if on]
    if not ends:
        return whole
    # files that are read but hold no packet
    failed = captures.read_captures(spark, path).where("error is not null").select("path")
    files = captures.find_captures(spark, path, captures.WIDE_SUFFIXES).select("path")
    empty = files.join(packets.select("path").distinct(), "path", "left_anti").join(failed, "path", "left_anti")
    return whole.unionByName(empty.select("path", F.array(*[F.lit(i) for i in ends]).alias("ids")))


def pretokenize(spark: SparkSession, folder: str, out: str, size: int = 2048, most: int = 10 * 1024**3, v: Vocabulary = TOKEN) -> DataFrame:
    """Captures to numbered chunks under out/chunks, with out/source_files and out/manifest; the manifest."""
    files = captures.find_captures(spark, folder, most=most, must=True)
    packets = captures.read_captures(spark, folder, captures.SUFFIXES, mode="drop", most=most)
    sinks.write_chunks(chunks.number(chunks.cut(chunks.packet_sequences(packets, v), size)), f"{out}/chunks")
    errors = captures.read_captures(spark, folder, captures.SUFFIXES, most=most).where("error is not null").select("path", "error")
    sources = chunks.source_files(sinks.read_chunks(spark, f"{out}/chunks"), files, errors)
    sources.write.mode("overwrite").parquet(f"{out}/source_files")
    sinks.write_json(chunks.manifest(spark.read.parquet(f"{out}/source_files")), f"{out}/manifest")
    return sinks.read_manifest(spark, f"{out}/manifest")


def build_corpus(spark: SparkSession, folder: str, out: str, form: str = "tokens", config: SeparatorConfig = SeparatorConfig(), separators: bool = True) -> DataFrame:
    """Captures to sentences under out/corpus and a log of malformed packets under out/malformed; totals."""
    packets = captures.read_captures(spark, folder, mode="drop")
    lines = corpus(packets, form, separators, config=config)
    lines.write.mode("overwrite").parquet(f"{out}/lines")
    written = spark.read.parquet(f"{out}/lines")
    sinks.write_corpus(written, f"{out}/corpus")
    if separators:
        malformed(packets, config).write.mode("overwrite").json(f"{out}/malformed")
    return stats.builder_totals(written)


def learn_vocabulary(spark: SparkSession, text: str, kind: str = "bpe", size: int = 8000, **how) -> tuple[subwords.Model, DataFrame]:
    """A subword model of a text corpus, and its figures."""
    lines = sinks.read_corpus(spark, text).withColumnRenamed("value", "sentence")
    model = subwords.train(lines, kind, size, **how)
    return model, subwords.evaluate(lines, model)


def find_duplicates(spark: SparkSession, folder: str, out: str, method: str = "smart") -> DataFrame:
    """Duplicate captures under out/groups and the files that could go under out/delete; a summary."""
    packets = captures.read_captures(spark, folder, captures.SUFFIXES, mode="drop")
    dedup.duplicates(packets, method).write.mode("overwrite").json(f"{out}/groups")
    found = spark.read.schema("content_hash string, files array<string>, n long").json(f"{out}/groups")
    sinks.write_deletions(dedup.to_delete(found), f"{out}/delete")
    return dedup.summary(found)
