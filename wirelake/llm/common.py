"""What the operators share: folds, scratch tables on the shared folder, and walks over Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold(key: str | Column, k: int) -> Column:
    """crc32 of the key as text, modulo k; a null key counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % k


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a local session without one gets a temporary folder of its own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="wirelake-")
        atexit.register(shutil.rmtree, base[len("file://") :], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def with_fields(schema: T.StructType, ddl: str) -> T.StructType:
    """The schema with the columns of a DDL string after its own."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors; what is left goes when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.marked = spark, False
        self.root = f"{shared_folder(spark).rstrip('/')}/wirelake-{name}-{uuid.uuid4().hex}"

    def _files(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        if not self.marked:
            files, root = self._files(self.root)
            files.deleteOnExit(root)
            self.marked = True
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            files, path = self._files(f"{self.root}/{name}")
            files.delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now rather than at some later garbage collection, and executors return heap that they don't use.

    A heap otherwise stays as large as any earlier step has made it, and the Python workers of the next come on top.
    """
    gc.collect()
    spark._jvm.System.gc()
    tasks = spark.sparkContext.defaultParallelism  # one for each core, so each executor has some; one without keeps its heap
    spark.range(0, tasks, 1, tasks).select(F.expr("reflect('java.lang.System', 'gc')").alias("x")).write.format("noop").mode("overwrite").save()


@cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return lambda _: None


def give_back() -> None:
    """Returns freed memory to the system; a worker process otherwise keeps the most that it ever took, through all later stages."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def giving_back(batches):
    """The batches; what the work on each took goes back to the system after it."""
    for batch in batches:
        yield batch
        del batch
        give_back()


def texts_in_chunks(batch: pa.RecordBatch, column: int = 1, limit: int = 1_000_000, most_rows: int = 400):
    """(first row, texts) for slices of a batch whose texts have about ``limit`` characters together; null is ''.

    A longer text is a slice of its own.
    """
    values = batch.column(column)
    first, texts, size = 0, [], 0
    for row in range(batch.num_rows):
        text = values[row].as_py() or ""
        if texts and (size + len(text) > limit or len(texts) >= most_rows):
            yield first, texts
            first, texts, size = row, [], 0
        texts.append(text)
        size += len(text)
    if texts:
        yield first, texts


def code_points(texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by ``end``; and where each text starts."""
    mark = np.array([end], "<u4").tobytes()
    parts = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    points = np.frombuffer(mark.join([*parts, b""]), "<u4")
    starts = np.zeros(len(texts), np.int64)
    if len(texts) > 1:
        np.cumsum([len(p) // 4 + 1 for p in parts[:-1]], out=starts[1:])
    return points, starts


def ascii_lower(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased; bytes.split() of it cuts at 0x20 and 0x09-0x0D only."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema, strict=True)], schema=schema)


def link_roots(n: int, pairs: list[tuple[np.ndarray, np.ndarray]], roots: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the pairs, by hooking larger roots under smaller ones."""
    roots = np.arange(n) if roots is None else roots
    for a, b in pairs:
        while True:
            ra, rb = roots[a], roots[b]
            open_ = ra != rb
            if not open_.any():
                break
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(roots, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = roots[roots]
                if (up == roots).all():
                    break
                roots = up
    return roots
