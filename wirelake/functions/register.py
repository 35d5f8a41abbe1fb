"""SQL names of the column functions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelake.functions.dissect import RESULT, SeparatorConfig, boundaries
from wirelake.functions.sentences import WORDS
from wirelake.functions.vocab import VARIANTS
from wirelake.sources import captures


def register(spark: SparkSession) -> None:
    """byte_tokens(data, variant), decode_tokens(ids, variant), dissect(data), packet_words(data, form), parse_pcap(content), format pcap."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def byte_tokens(data: pa.Array, variant: pa.Array) -> pa.Array:
        offsets = [VARIANTS[v].offset for v in variant.to_pylist()]
        return pa.array([None if d is None else [b + o for b in d] for d, o in zip(data.to_pylist(), offsets, strict=True)], pa.list_(pa.int32()))

    @F.arrow_udf(T.BinaryType())
    def decode_tokens(ids: pa.Array, variant: pa.Array) -> pa.Array:
        offsets = [VARIANTS[v].offset for v in variant.to_pylist()]
        return pa.array([None if x is None else bytes(i - o for i in x if o <= i < o + 256) for x, o in zip(ids.to_pylist(), offsets, strict=True)], pa.binary())

    @F.arrow_udf(RESULT)
    def dissect(data: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        return pa.array([None if d is None else boundaries(d, SeparatorConfig()) for d in data.to_pylist()], to_arrow_type(RESULT))

    @F.arrow_udf(T.StringType())
    def packet_words(data: pa.Array, form: pa.Array) -> pa.Array:
        return pa.array([None if d is None else " ".join(WORDS.get(f, WORDS["hex"])[b] for b in d) for d, f in zip(data.to_pylist(), form.to_pylist(), strict=True)], pa.string())

    for name, f in (("byte_tokens", byte_tokens), ("decode_tokens", decode_tokens), ("dissect", dissect), ("packet_words", packet_words)):
        spark.udf.register(name, f)
    captures.register(spark)
