"""Writers: chunks, manifests, corpora, reports, vocabularies."""

from __future__ import annotations

import json
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelake.functions.vocab import Vocabulary, tokens


def write_chunks(chunks: DataFrame, path: str, rows_a_file: int = 10_000) -> None:
    """Numbered chunks as Parquet, zstd-compressed; ``filename`` names each as a file of its own would be."""
    chunks.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_a_file).parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def chunk_files(chunks: DataFrame, folder: str, form: str = "npy") -> DataFrame:
    """Writes each chunk as chunk_%08d.npy, .pkl or .arrow on a mounted folder that all executors share; (filename, bytes) of the files."""
    import pickle
    from pathlib import Path

    import numpy as np

    def run(batches):
        for batch in batches:
            names, sizes = [], []
            for i, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = f"chunk_{i:08d}.{form}"
                target = Path(folder, name)
                if form == "npy":
                    np.save(target, np.array(ids, np.int64))
                elif form == "pkl":
                    target.write_bytes(pickle.dumps(ids))
                elif form == "arrow":
                    table = pa.table({"tokens": pa.array([ids], pa.list_(pa.uint16()))})
                    with pa.OSFile(str(target), "wb") as f, pa.ipc.new_file(f, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                        w.write_table(table)
                else:
                    raise ValueError(f"unknown form: {form}")
                names.append(name)
                sizes.append(target.stat().st_size)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64())], names=["filename", "bytes"])

    return chunks.select("chunk_idx", "tokens").mapInArrow(run, "filename string, bytes long")


def load_chunk_files(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, tokens) of .npy, .pkl and .arrow chunk files, through Spark's reader; a file that can't be read has null tokens."""
    import io
    import pickle

    import numpy as np

    class Plain(pickle.Unpickler):
        """Lists of numbers only: names in a pickle are never looked up."""

        def find_class(self, module, name):
            raise pickle.UnpicklingError(f"{module}.{name} in a chunk")

    files = spark.read.format("binaryFile").option("pathGlobFilter", "chunk_*.{npy,pkl,arrow}").load(folder)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def tokens_of(path: pa.Array, content: pa.Array) -> pa.Array:
        out = []
        for p, c in zip(path.to_pylist(), content.to_pylist(), strict=True):
            try:
                if p.endswith(".npy"):
                    out.append(np.load(io.BytesIO(c), allow_pickle=False).tolist())
                elif p.endswith(".pkl"):
                    out.append([int(x) for x in Plain(io.BytesIO(c)).load()])
                else:
                    out.append([x for row in pa.ipc.open_file(c).read_all().column("tokens").to_pylist() for x in row])
            except (ValueError, TypeError, EOFError, pickle.UnpicklingError, pa.ArrowInvalid):
                out.append(None)
        return pa.array(out, pa.list_(pa.int64()))

    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), tokens_of("path", "content").alias("tokens"))


def write_token_table(sequences: DataFrame, path: str, rows_a_file: int = 1_000_000) -> None:
    """One column of token lists; empty ones are left out."""
    kept = sequences.where(F.size("ids") > 0).select(F.col("ids").alias("tokens"))
    kept.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_a_file).parquet(path)


def write_json(row: DataFrame, path: str) -> None:
    """A report of few rows as JSON."""
    row.coalesce(1).write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def write_corpus(lines: DataFrame, path: str, single: bool = False) -> None:
    """Sentences in the order of file and packet; ``single`` makes one file."""
    ordered = lines.orderBy("path", "packet_index").select(F.col("sentence").alias("value"))
    (ordered.coalesce(1) if single else ordered).write.mode("overwrite").text(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Lines without blank ones."""
    return spark.read.text(path).select(F.trim("value", F.lit(" \t\r\n\x0b\x0c")).alias("value")).where("value <> ''")


def write_deletions(paths: DataFrame, path: str) -> None:
    """Paths to delete, in order, as text."""
    paths.orderBy("path").write.mode("overwrite").text(path)


def deletion_script(paths: DataFrame) -> DataFrame:
    """Lines of a shell script that deletes the files."""
    quoted = F.concat(F.lit("rm -f -- '"), F.replace(F.col("path"), F.lit("'"), F.lit("'\\''")), F.lit("'"))
    return paths.select(quoted.alias("value"))


def delete_files(spark: SparkSession, paths: DataFrame, sure: bool = False) -> int:
    """Deletes the files, if ``sure``; the number of files. Paths are streamed to the driver."""
    n = 0
    for row in paths.toLocalIterator():
        if sure:
            target = spark._jvm.org.apache.hadoop.fs.Path(row.path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, False)
        n += 1
    return n


def write_malformed(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def malformed_total(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(F.trim("value") != "").count()


def vocabulary_json(v: Vocabulary) -> str:
    """Token to id as JSON in UTF-8; empty for variants that don't save one."""
    return json.dumps({t: i for t, i, _, _ in tokens(v)}, ensure_ascii=False) if v.name in ("token", "field") else ""


def piece_json(vocab_lines: DataFrame) -> DataFrame:
    """(piece, id) of a .vocab file read as text in one part: the first field of each line, numbered."""
    from pyspark.sql.window import Window

    numbered = vocab_lines.withColumn("i", F.monotonically_increasing_id())
    return numbered.select(F.split("value", "\t")[0].alias("piece"), (F.row_number().over(Window.orderBy("i")) - 1).alias("id"))


def training_info(training: dict, evaluation: dict, corpus: dict) -> str:
    """The record of a training run as JSON."""
    return json.dumps({"timestamp": datetime.now(UTC).isoformat(), "training_stats": training, "evaluation_stats": evaluation, "corpus_stats": corpus}, ensure_ascii=False, indent=2)


def stamped_folder(base: str, source: str, now: datetime | None = None) -> str:
    """base/YYYYMMDD_HHMMSS-name of the input."""
    name = source.rstrip("/").rpartition("/")[2].rpartition(".")[0] or source.rpartition("/")[2]
    return f"{base}/{(now or datetime.now(UTC)):%Y%m%d_%H%M%S}-{name}"
