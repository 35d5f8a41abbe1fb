"""Vocabularies, tokens and model inputs against worked examples."""

import pytest
from pyspark.sql import functions as F

from wirelake.functions import tokens as tk
from wirelake.functions import vocab
from wirelake.operators import chunks

DEFINITIVE = [b"Hi", bytes([0, 1, 127, 255])]


@pytest.fixture(scope="module")
def packets(spark):
    rows = [("a", i, bytearray(p)) for i, p in enumerate(DEFINITIVE)] + [("b", i, bytearray([x])) for i, x in enumerate((0, 127, 255))] + [("c", 0, bytearray(range(256)))]
    return spark.createDataFrame(rows, "path string, packet_index int, data binary")


def sequence(packets, v, path="a", **how):
    made = chunks.file_sequence(chunks.packet_sequences(packets, v, **how)).where(F.col("path") == path)
    return made.first().ids


@pytest.mark.parametrize(
    ("v", "plain"),
    [(vocab.TOKEN, [77, 110, 5, 6, 132, 260]), (vocab.FIELD, [78, 111, 6, 7, 133, 261])],
)
def test_definitive_ids(packets, v, plain):
    assert sequence(packets, v, separators=False) == plain
    assert sequence(packets, v) == [*plain[:2], 4, *plain[2:]]
    assert sequence(packets, v, bos=True, eos=True) == [3, *plain[:2], 4, *plain[2:], 2]
    assert len(sequence(packets, v, "b", bos=True, eos=True)) == 7


def test_raw_ids_and_sizes(packets):
    assert sequence(packets, vocab.RAW) == [72, 105, 0, 1, 127, 255]
    assert [v.size for v in (vocab.RAW, vocab.TOKEN, vocab.FIELD)] == [256, 261, 262]
    assert vocab.TOKEN.unknown == 1 and len(vocab.tokens(vocab.FIELD)) == 262


@pytest.mark.parametrize("v", list(vocab.VARIANTS.values()))
def test_round_trip_of_all_bytes(packets, v):
    ids = packets.select("data", tk.byte_tokens(F.col("data"), v).alias("ids"), tk.byte_tokens_native(F.col("data"), v).alias("same"))
    rows = ids.select("*", tk.decode_tokens(F.col("ids"), v).alias("back"), tk.decode_tokens_native(F.col("ids"), v).alias("back2")).collect()
    assert all(r.ids == r.same and r.back == r.data and r.back2 == r.data for r in rows)


def test_empty_and_null(spark):
    rows = spark.createDataFrame([(bytearray(),), (None,), (bytearray(b"\x01"),)], "data binary")
    got = [r[0] for r in rows.select(tk.byte_tokens(F.col("data"), vocab.TOKEN)).collect()]
    assert got == [[], None, [6]]
    back = rows.select(tk.byte_tokens(F.col("data"), vocab.TOKEN).alias("i")).select(tk.decode_tokens(F.col("i"), vocab.TOKEN)).collect()
    assert [r[0] for r in back] == [b"", None, b"\x01"]


def test_inputs_and_masks(spark):
    row = spark.createDataFrame([([10, 20, 30], [40, 50, 60], [3, 10, 20, 4, 30, 40, 2])], "a array<int>, b array<int>, c array<int>")
    one = row.select(
        tk.build_inputs(F.col("a"), None, vocab.TOKEN),
        tk.build_inputs(F.col("a"), F.col("b"), vocab.TOKEN),
        tk.special_mask_of(F.col("a"), None, vocab.TOKEN),
        tk.special_mask_of(F.col("a"), F.col("b"), vocab.TOKEN),
        tk.special_mask(F.col("c"), vocab.TOKEN),
        tk.build_inputs(F.col("a"), F.col("b"), vocab.RAW),
        tk.build_inputs(F.col("a"), F.col("b"), vocab.TEXT),
        tk.build_inputs(F.col("a"), None, vocab.DISSECTED),
    ).first()
    assert list(one) == [
        [3, 10, 20, 30, 2],
        [3, 10, 20, 30, 4, 40, 50, 60, 2],
        [1, 0, 0, 0, 1],
        [1, 0, 0, 0, 1, 0, 0, 0, 1],
        [1, 0, 0, 1, 0, 0, 1],
        [10, 20, 30, 40, 50, 60],
        [10, 20, 30, 1, 40, 50, 60, 1],
        [10, 20, 30, 1],
    ]
    field = spark.createDataFrame([([3, 10, 20, 5, 30, 40, 4, 50, 2],)], "c array<int>")
    assert field.select(tk.special_mask(F.col("c"), vocab.FIELD)).first()[0] == [1, 0, 0, 1, 0, 0, 1, 0, 1]


def test_names_and_ids(spark):
    names = spark.createDataFrame([("<pad>",), ("<sep>",), ("A",), ("abc",), ("ÿ",), ("Ā",)], "t string")
    assert [r[0] for r in names.select(vocab.token_to_id(F.col("t"), vocab.FIELD)).collect()] == [0, 5, 71, 1, 261, 1]
    assert [r[0] for r in names.select(vocab.token_to_id(F.col("t"), vocab.TEXT)).collect()] == [0, None, 68, None, 258, None]
    ids = spark.createDataFrame([(5,), (71,), (6,)], "i int")
    assert [r[0] for r in ids.select(vocab.id_to_token(F.col("i"), vocab.FIELD)).collect()] == ["<sep>", "A", "\x00"]
    for bad in (-1, 262):
        with pytest.raises(Exception, match="out of range"):
            spark.createDataFrame([(bad,)], "i int").select(vocab.id_to_token(F.col("i"), vocab.FIELD)).collect()
    assert spark.createDataFrame([(999,)], "i int").select(vocab.id_to_token(F.col("i"), vocab.FIELD, strict=False)).first()[0] == "<unk>"
    with pytest.raises(Exception, match="not one character"):
        names.select(vocab.token_to_id(F.col("t"), vocab.RAW)).collect()
    text = spark.createDataFrame([(["<bos>", *"Hello", "<sep>", *"World", "<pkt>", "!", "<eos>"],)], "t array<string>")
    assert text.select(tk.tokens_to_string(F.col("t"), vocab.FIELD)).first()[0] == "HelloWorld!"
    joined = spark.createDataFrame([([3, 78, 5, 111, 2],)], "i array<int>")
    assert joined.select(tk.decode_with_specials(F.col("i"), vocab.FIELD)).first()[0] == "<bos>H<sep>i<eos>"


def test_text_variant(spark):
    rows = spark.createDataFrame([("hi",), ("é",), ("🙂",)], "t string")
    ids = [r[0] for r in rows.select(tk.text_tokens(F.col("t"))).collect()]
    assert ids[0] == [107, 108] and [len(i) for i in ids] == [2, 2, 4]
    cut = spark.createDataFrame([([107, 108, 198],)], "i array<int>")
    assert cut.select(tk.text_of_ids(F.col("i"))).first()[0] == "hi"
    start, end, between = (3 + 256 + vocab.TEXT.added.index(t) for t in ("<pcap>", "</pcap>", "<pkt>"))
    cases = [[start, 4, 5, between, 6, end], [start, end], [start, 4, between, 5], [4, 5], [start, between, 4, end]]
    got = spark.createDataFrame([(c,) for c in cases], "i array<int>").select(tk.packets_of(F.col("i"))).collect()
    assert [[bytes(p) for p in r[0]] for r in got] == [[b"\x01\x02", b"\x03"], [], [b"\x01"], [], [b"\x01"]]


def test_padding_shift_window(spark):
    row = spark.createDataFrame([([1, 2, 3], "k")], "x array<int>, k string")
    got = row.select(
        tk.pad_or_cut(F.col("x"), 5), tk.pad_or_cut(F.col("x"), 2), tk.model_input(F.col("x")), tk.model_target(F.col("x")), tk.in_range(F.col("x"), 3), tk.window_of(F.col("x"), 2, F.col("k")), tk.token_types(F.lit(2)), tk.as_list(F.lit(7))
    ).first()
    assert list(got[:5]) == [[1, 2, 3, 0, 0], [1, 2], [1, 2], [2, 3], [1, 2]] and got[5] in ([1, 2], [2, 3]) and list(got[6:]) == [[0, 0], [7]]
    ids = spark.createDataFrame([([3, 78, 111, 4, 6, 2],)], "x array<int>")
    assert ids.select(tk.first_packet(F.col("x"))).first()[0] == [78, 111]
    shown = ids.select(tk.display(F.col("x"), vocab.FIELD)).first()[0]
    assert [(s.kind, s.glyph) for s in shown] == [("SPECIAL", None), ("BYTE", "H"), ("BYTE", "i"), ("SPECIAL", None), ("BYTE", "."), ("SPECIAL", None)]
    data = spark.createDataFrame([(bytearray([0, 9, 255]),)], "d binary")
    assert data.select(tk.shifted_text(F.col("d"))).first()[0] == "\x01\nĀ"
