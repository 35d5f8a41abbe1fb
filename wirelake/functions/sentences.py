"""Packets as lines of text for subword training."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelake.functions.dissect import SeparatorConfig, boundaries, cuts

MARK = "▁"
_SHOWN = frozenset(range(32, 127)) - {ord("<"), ord(">")}
#: How each format writes a byte.
WORDS = {
    "decimal": [str(b) for b in range(256)],
    "hex": [f"{b:02x}" for b in range(256)],
    "tokens": [MARK + (chr(b) if b in _SHOWN else f"{b:02x}") for b in range(256)],
    "mixed": [MARK + (chr(b) if b in _SHOWN else f"0x{b:02x}") for b in range(256)],
}


def hex_sentence(data: Column) -> Column:
    """Two hex digits a byte, blank between, by built-in functions."""
    return F.trim(F.regexp_replace(F.lower(F.hex(data)), "(..)", "$1 "))


def decimal_sentence(data: Column) -> Column:
    pairs = F.regexp_extract_all(F.hex(data), F.lit(".."), F.lit(0))
    return F.array_join(F.transform(pairs, lambda h: F.conv(h, 16, 10)), " ")


def packet_sentence(data: Column, form: str = "tokens", separators: bool = True, marks: bool = True, config: SeparatorConfig = SeparatorConfig()) -> Column:
    """One line a packet; with ``separators`` fields are told apart, by [SEP] if ``marks``. An unknown form is hex without separators.

    In tokens and mixed a blank is the mark and a blank, so splitting at blanks sees the mark alone.
    """
    words = WORDS.get(form)

    @F.arrow_udf(T.StringType())
    def run(data: pa.Array) -> pa.Array:
        out = []
        for d in data.to_pylist():
            if d is None:
                out.append(None)
            elif words is None:
                out.append(" ".join(WORDS["hex"][b] for b in d))
            else:
                parts, last = [], 0
                if separators and marks:
                    for at in cuts([o["offset"] for o in boundaries(d, config)["offsets"]], len(d)):
                        parts += [words[b] for b in d[last:at]]
                        parts.append("[SEP]")
                        last = at
                parts += [words[b] for b in d[last:]]
                out.append(" ".join(parts))
        return pa.array(out, pa.string())

    return run(data)


def separator_count(sentence: Column) -> Column:
    return ((F.length(sentence) - F.length(F.replace(sentence, F.lit("[SEP]"), F.lit("")))) / 5).cast("int")


def corpus(packets: DataFrame, form: str = "tokens", separators: bool = True, marks: bool = True, config: SeparatorConfig = SeparatorConfig()) -> DataFrame:
    """(path, packet_index, sentence, bytes, separators) of the packets; unreadable files are left out."""
    lines = packets.where("data is not null").withColumn("sentence", packet_sentence(F.col("data"), form, separators, marks, config))
    return lines.select("path", "packet_index", "sentence", F.octet_length("data").alias("bytes"), separator_count(F.col("sentence")).alias("separators"))


def file_lines(lines: DataFrame) -> DataFrame:
    """(path, line): the sentences of a file in order as one line; files without any are dropped."""
    parts = F.array_sort(F.collect_list(F.struct("packet_index", "sentence")))
    return lines.groupBy("path").agg(F.array_join(F.transform(parts, lambda x: x["sentence"]), " ").alias("line")).where("line <> ''")
