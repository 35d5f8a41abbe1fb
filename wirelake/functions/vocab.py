"""The fixed vocabularies: special tokens first, then the 256 bytes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Vocabulary:
    """Ids of a variant: a byte b has the id b + offset."""

    name: str
    offset: int
    specials: dict[str, int] = field(default_factory=dict)
    added: tuple[str, ...] = ()  # tokens with ids after the bytes
    size: int = 256  # what the variant reports

    @property
    def unknown(self) -> int | None:
        return self.specials.get("<unk>")


# The special tokens and their ids, by variant.
RAW = Vocabulary("raw", 0)
TOKEN = Vocabulary("token", 5, {"<pad>": 0, "<unk>": 1, "<eos>": 2, "<bos>": 3, "<pkt>": 4}, size=261)
FIELD = Vocabulary("field", 6, {**TOKEN.specials, "<sep>": 5}, size=262)
TEXT = Vocabulary("text", 3, {"<pad>": 0, "</s>": 1, "<unk>": 2}, ("<pcap>", "</pcap>", "<pkt>", *(f"<extra_id_{i}>" for i in range(125))))
DISSECTED = Vocabulary("dissected", 5, {"<pad>": 0, "</s>": 1, "<unk>": 2, "<sep>": 3, "<pkt>": 4})
VARIANTS = {v.name: v for v in (RAW, TOKEN, FIELD, TEXT, DISSECTED)}


def special(specials: tuple[str, ...]) -> Vocabulary:
    """The variant whose offset is the number of its special tokens, in the order given."""
    return Vocabulary("special", len(specials), {s: i for i, s in enumerate(specials)})


def tokens(v: Vocabulary) -> list[tuple[str, int, bool, int | None]]:
    """(token, id, is_special, byte) of all ids of a variant."""
    named = [(t, i, True, None) for t, i in v.specials.items()]
    plain = [(chr(b), b + v.offset, False, b) for b in range(256)]
    return [*named, *plain, *((t, v.offset + 256 + k, True, None) for k, t in enumerate(v.added))]


def vocabulary(spark: SparkSession, v: Vocabulary) -> DataFrame:
    return spark.createDataFrame(tokens(v), "token string, id int, is_special boolean, byte int")


def token_to_id(token: Column, v: Vocabulary) -> Column:
    """The id of a token: that of its name, or of its one character up to 255; else <unk>.

    Without specials (raw) a token that isn't one character is an error, and code points aren't bounded. The text
    variant gives null for what it doesn't know.
    """
    code = F.ascii(token)
    one = F.length(token) == 1
    if not v.specials:
        return F.when(one, code).otherwise(F.raise_error(F.concat(F.lit("not one character: "), token)).cast("int"))
    unknown = F.lit(None).cast("int") if v.name == "text" else F.lit(v.unknown)
    out = F.when(one & (code <= 255), code + v.offset).otherwise(unknown)
    for name, i in [*v.specials.items(), *((t, v.offset + 256 + k) for k, t in enumerate(v.added))]:
        out = F.when(token == name, F.lit(i)).otherwise(out)
    return out


def id_to_token(i: Column, v: Vocabulary, strict: bool = True) -> Column:
    """The token of an id; an id out of range is an error, or <unk> if not strict."""
    other = F.raise_error(F.concat(F.lit("id out of range: "), i.cast("string"))).cast("string") if strict else F.lit("<unk>")
    out = F.when((i >= v.offset) & (i < v.offset + 256), F.char(i - v.offset)).otherwise(other)
    # char(0) is an empty text in SQL
    out = F.when(i == v.offset, F.decode(F.unhex(F.lit("00")), "UTF-8")).otherwise(out)
    for name, k in [*v.specials.items(), *((t, v.offset + 256 + n) for n, t in enumerate(v.added))]:
        out = F.when(i == k, F.lit(name)).otherwise(out)
    return out
