"""Byte tokens: from bytes to ids and back, model inputs, masks, padding, display."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelake.functions.vocab import FIELD, RAW, TEXT, TOKEN, Vocabulary, id_to_token

_IDS = T.ArrayType(T.IntegerType())


def binary_parts(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary array without copying the bytes."""
    data = data.cast(pa.large_binary())
    _, offsets, values = data.buffers()
    at = np.frombuffer(offsets, np.int64)[data.offset : data.offset + len(data) + 1]
    return at, np.frombuffer(values or b"", np.uint8)


def _shifted(data: pa.Array, offset: int) -> pa.Array:
    at, values = binary_parts(data)
    ids = values[at[0] : at[-1]].astype(np.int32) + np.int32(offset)
    mask = data.is_null() if data.null_count else None
    return pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array(ids), mask=mask)


def byte_tokens(data: Column, v: Vocabulary) -> Column:
    """Ids of the bytes, by one vectorised pass over each Arrow batch; null stays null."""
    offset = v.offset

    @F.arrow_udf(_IDS)
    def run(data: pa.Array) -> pa.Array:
        return _shifted(data, offset)

    return run(data)


def byte_tokens_native(data: Column, v: Vocabulary) -> Column:
    """The same by built-in functions only, for plans that must stay in the JVM."""
    pairs = F.regexp_extract_all(F.hex(data), F.lit(".."), F.lit(0))
    return F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("int") + v.offset)


def decode_tokens(ids: Column, v: Vocabulary) -> Column:
    """The bytes that ids stand for, specials skipped; a vectorised pass over each batch."""
    offset = v.offset

    @F.arrow_udf(T.BinaryType())
    def run(ids: pa.Array) -> pa.Array:
        at = ids.offsets.to_numpy()
        values = ids.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype(np.int64)
        keep = (values >= offset) & (values < offset + 256)
        count = np.concatenate(([0], np.cumsum(keep)))[at - at[0]]
        out = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(count.astype(np.int32).tobytes()), pa.py_buffer((values[keep] - offset).astype(np.uint8).tobytes())])
        return pa.compute.if_else(ids.is_null(), pa.scalar(None, pa.binary()), out) if ids.null_count else out

    return run(ids)


def decode_tokens_native(ids: Column, v: Vocabulary) -> Column:
    kept = F.filter(ids, lambda x: (x >= v.offset) & (x < v.offset + 256))
    return F.unhex(F.array_join(F.transform(kept, lambda x: F.lpad(F.hex((x - v.offset).cast("long")), 2, "0")), ""))


def decode_with_specials(ids: Column, v: Vocabulary) -> Column:
    """The tokens' names and characters joined."""
    return F.array_join(F.transform(ids, lambda i: id_to_token(i, v)), "")


def as_list(i: Column) -> Column:
    """A single id as a sequence."""
    return F.array(i)


def tokens_to_string(tokens: Column, v: Vocabulary) -> Column:
    """The tokens joined without specials."""
    names = F.array(*[F.lit(t) for t in [*v.specials, *v.added]]) if v.specials else F.array().cast("array<string>")
    return F.array_join(F.filter(tokens, lambda t: ~F.array_contains(names, t)), "")


def text_of_ids(ids: Column, v: Vocabulary = TEXT) -> Column:
    """UTF-8 text of byte ids; bytes that aren't UTF-8 are left out."""
    offset = v.offset

    @F.arrow_udf(T.StringType())
    def run(ids: pa.Array) -> pa.Array:
        out = [None if x is None else bytes(i - offset for i in x if offset <= i < offset + 256).decode("utf-8", "ignore") for x in ids.to_pylist()]
        return pa.array(out, pa.string())

    return run(ids)


def text_tokens(text: Column, v: Vocabulary = TEXT) -> Column:
    """Ids of the UTF-8 bytes of a text."""
    return byte_tokens(F.encode(text, "UTF-8"), v)


def build_inputs(a: Column, b: Column | None, v: Vocabulary) -> Column:
    """Model input of one or two sequences: <bos> a (<pkt> b) <eos>; raw just joins; others end with </s> (the text variant each part, unless it does)."""
    s = v.specials
    if v.name == RAW.name:
        return F.concat(a, b) if b is not None else a
    if v.name in (TOKEN.name, FIELD.name):
        middle = [F.array(F.lit(s["<pkt>"])), b] if b is not None else []
        return F.concat(F.array(F.lit(s["<bos>"])), a, *middle, F.array(F.lit(s["<eos>"])))
    end = F.lit(s.get("</s>", s.get("<eos>", 1)))
    if v.name == TEXT.name:
        ended = [F.when(F.try_element_at(x, F.lit(-1)) == end, x).otherwise(F.concat(x, F.array(end))) for x in (a, b) if x is not None]
        return F.concat(*ended)
    return F.concat(*[x for x in (a, b) if x is not None], F.array(end))


def special_mask(ids: Column, v: Vocabulary) -> Column:
    """1 at the ids below the bytes."""
    return F.transform(ids, lambda x: (x < v.offset).cast("int"))


def special_mask_of(a: Column, b: Column | None, v: Vocabulary) -> Column:
    """The mask of ``build_inputs`` of two plain sequences: 1 at the specials put in."""
    def zeros(x):
        return F.array_repeat(F.lit(0), F.size(x))

    one = F.array(F.lit(1))
    if v.name == RAW.name:
        return F.concat(zeros(a), zeros(b)) if b is not None else zeros(a)
    if v.name in (TOKEN.name, FIELD.name):
        return F.concat(one, zeros(a), *([one, zeros(b)] if b is not None else []), one)
    if v.name == TEXT.name and b is not None:
        return F.concat(zeros(a), one, zeros(b), one)
    return F.concat(zeros(a), *([zeros(b)] if b is not None else []), one)


def token_types(n: Column) -> Column:
    return F.array_repeat(F.lit(0), n)


def pad_or_cut(ids: Column, length: int, pad: int = 0) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)


def in_range(ids: Column, size: int) -> Column:
    return F.filter(ids, lambda x: (x >= 0) & (x < size))


def model_input(ids: Column) -> Column:
    """All but the last."""
    return F.slice(ids, F.lit(1), F.greatest(F.size(ids) - 1, F.lit(0)))


def model_target(ids: Column) -> Column:
    """All but the first."""
    return F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0)))


def window_of(ids: Column, length: int, key: Column, seed: int = 0) -> Column:
    """A window of so many ids from a place that a hash of the key picks; a shorter sequence as it is."""
    spare = F.greatest(F.size(ids) - length, F.lit(0))
    return F.slice(ids, (F.pmod(F.xxhash64(key, F.lit(seed)), spare + 1) + 1).cast("int"), F.lit(length))


def first_packet(ids: Column, v: Vocabulary = FIELD) -> Column:
    """What stands between <bos> and the first <pkt> or <eos>."""
    s = v.specials
    rest = F.when(F.try_element_at(ids, F.lit(1)) == s["<bos>"], F.slice(ids, F.lit(2), F.size(ids))).otherwise(ids)

    def place(name):
        at = F.array_position(rest, s[name])
        return F.when(at > 0, at).otherwise(F.size(rest) + 1)

    return F.slice(rest, F.lit(1), F.least(place("<pkt>"), place("<eos>")).cast("int") - 1)


def printable(b: Column, other: str = "dot") -> Column:
    """The character of a byte from 32 to 126, else ``.`` or ``\\xNN``."""
    plain = F.char(b)
    return F.when(b.between(32, 126), plain).otherwise(F.lit(".") if other == "dot" else F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(b.cast("long")), 2, "0"))))


def display(ids: Column, v: Vocabulary) -> Column:
    """(index, id, kind, token, glyph) of each id."""
    return F.transform(
        ids,
        lambda i, k: F.struct(
            k.alias("index"),
            i.alias("id"),
            F.when(i < v.offset, F.lit("SPECIAL")).otherwise(F.lit("BYTE")).alias("kind"),
            id_to_token(i, v).alias("token"),
            F.when(i >= v.offset, printable(i - v.offset)).alias("glyph"),
        ),
    )


def shifted_text(data: Column, shift: int = 1) -> Column:
    """Each byte as the character ``shift`` above it, for trainers that take text. A shift of 0xE000 keeps clear of line ends and commas."""

    @F.arrow_udf(T.StringType())
    def run(data: pa.Array) -> pa.Array:
        at, values = binary_parts(data)
        text = (values[at[0] : at[-1]].astype("<u4") + np.uint32(shift)).tobytes().decode("utf-32-le")
        at = (at - at[0]).tolist()
        return pa.array([None if not ok else text[a:b] for ok, a, b in zip(data.is_valid().to_pylist(), at, at[1:])], pa.string())

    return run(data)


def packets_of(ids: Column, v: Vocabulary = TEXT) -> Column:
    """Packets within <pcap> ... </pcap>, cut at <pkt>: empty ones and an unterminated tail are dropped."""
    opening, closing, between = (v.offset + 256 + v.added.index(t) for t in ("<pcap>", "</pcap>", "<pkt>"))
    offset = v.offset

    @F.arrow_udf(T.ArrayType(T.BinaryType()))
    def run(ids: pa.Array) -> pa.Array:
        out = []
        for x in ids.to_pylist():
            if x is None:
                out.append(None)
                continue
            done, now, inside = [], bytearray(), False
            for i in x:
                if i == opening:
                    now, inside = bytearray(), True
                elif inside and i in (between, closing):
                    if now:
                        done.append(bytes(now))
                    now, inside = bytearray(), i == between
                elif inside and offset <= i < offset + 256:
                    now.append(i - offset)
            out.append(done)
        return pa.array(out, pa.list_(pa.binary()))

    return run(ids)
