"""Field boundaries against worked examples and a plain reading of the layouts."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from wirelake.functions import dissect as ds
from wirelake.functions import sentences as sn
from wirelake.functions import vocab
from wirelake.operators import sequences

LINK = bytes.fromhex("00112233445566778899aabb0800")
FRAME = LINK + bytes.fromhex("450000281234400040060000c0a80101c0a80102" + "005004d2000000010000000050022000" + "00000000")


def frame(payload, sport, dport, protocol=17, options=b"", tcp=5):
    ihl = 5 + len(options) // 4
    ip = struct.pack(">BBHHHBBH4s4s", 0x40 | ihl, 0, 0, 0, 0, 64, protocol, 0, b"\1\2\3\4", b"\5\6\7\x08") + options
    head = struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) if protocol == 17 else struct.pack(">HHIIBBHHH", sport, dport, 1, 0, tcp << 4, 2, 0, 0, 0) + bytes((tcp - 5) * 4)
    return LINK + ip + head + payload


def names(data, config=ds.SeparatorConfig(), layer=5):
    start = ds.boundaries(data, config)["app_start"] or 0
    return [(o["offset"] - start, o["field_name"]) for o in ds.boundaries(data, config)["offsets"] if o["layer"] == layer]


def test_tcp_frame():
    b = ds.boundaries(FRAME)
    assert ds.cuts([o["offset"] for o in b["offsets"]], len(FRAME)) == [6, 12, 14, 16, 18, 22, 26, 30, 34, 36, 38, 42, 46, 48, 52]
    assert (b["l3"], b["l4"], b["src_port"], b["dst_port"], b["app"], b["error_type"]) == ("ipv4", "tcp", 80, 1234, None, None)
    assert [o["field_name"] for o in ds.boundaries(FRAME, ds.SeparatorConfig(insert_ethernet_fields=False, insert_ip_fields=False, insert_transport_fields=False))["offsets"]] == ["eth_end", "ip_end", "tcp_end"]
    for depth, last in ((1, None), (2, 14), (3, 34), (4, 54)):
        places = [o["offset"] for o in ds.boundaries(FRAME, ds.SeparatorConfig(max_depth=depth))["offsets"]]
        assert (places[-1] if places else None) == last


def test_options_and_icmp_and_ipv6():
    b = ds.boundaries(frame(b"", 1, 2, 6, options=bytes(8), tcp=7))
    assert {"ip_payload": 42, "tcp_payload": 70} == {o["field_name"]: o["offset"] for o in b["offsets"] if o["field_name"].endswith("_payload") and o["layer"] > 2}
    icmp = LINK + struct.pack(">BBHHHBBH4s4s", 0x45, 0, 0, 0, 0, 64, 1, 0, b"\1\2\3\4", b"\5\6\7\x08") + bytes(9)
    assert [o["offset"] - 34 for o in ds.boundaries(icmp)["offsets"] if o["layer"] == 4] == [1, 2, 4, 8]
    six = LINK[:12] + b"\x86\xdd" + b"\x60\0\0\0\0\x08\x11\x40" + bytes(32) + struct.pack(">HHHH", 69, 9, 14, 0) + b"\0\1file"
    b = ds.boundaries(six)
    assert (b["l3"], b["l4"], b["app"]) == ("ipv6", "udp", "tftp") and names(six) == [(2, "tftp_data")]


@pytest.mark.parametrize(("policy", "kept"), [("conservative", 0), ("hybrid", 9), ("aggressive", 9)])
def test_policies(policy, kept):
    short = FRAME[:40]  # the TCP header ends before its length
    b = ds.boundaries(short, ds.SeparatorConfig(policy=policy))
    assert b["error_type"] == "IndexError" and len(b["offsets"]) == kept
    assert ds.boundaries(b"\0\1\2", ds.SeparatorConfig(policy=policy))["error_type"] == "NeedData"


def test_applications():
    detailed = ds.SeparatorConfig(detailed_app_parsing=True)
    head = b"GET / HTTP/1.1\r\nHost: a\r\nX: 1\r\n\r\nbody"
    assert names(frame(head, 80, 9, 6)) == [(33, "http_body")]
    assert names(frame(head, 80, 9, 6), detailed) == [(16, "http_request_line"), (25, "http_header"), (31, "http_header"), (33, "http_body")]
    assert names(frame(b"GET / HTTP/1.0\n\nx", 80, 9, 6)) == [(16, "http_body")] and names(frame(b"no head", 80, 9, 6)) == [(7, "http_end")]
    assert names(frame(b"a\r\n\r\nb", 5060, 9)) == [(5, "sip_body")]
    query = struct.pack(">HHHHHH", 1, 0x100, 1, 1, 0, 0) + b"\3www\7example\3com\0\0\1\0\1" + b"\xc0\x0c\0\1\0\1\0\0\0\5\0\4\1\2\3\4"
    assert names(frame(query, 9, 53)) == [*((k, n) for k, n in ds.DNS), (31, "dns_answers"), (31, "dns_question")]
    assert names(frame(query[:20], 9, 53)) == list(ds.DNS) and names(frame(query, 9, 53), ds.CLI_PROFILE) == [(12, "dns_data")]
    tls = b"\x16\3\1\0\2ab" + b"\x17\3\3\0\1c"
    assert names(frame(tls, 4433, 9, 6)) == [(5, "tls_record_data"), (7, "tls_record"), (12, "tls_record_data")]
    assert names(frame(tls, 443, 9, 6)) == [(13, "http_end")]  # the port decides
    assert names(frame(bytes(48), 123, 9)) == [(48, "ntp_end")] and len(names(frame(bytes(48), 123, 9), detailed)) == 10
    assert len(names(frame(bytes(240), 67, 9))) == 15 and names(frame(bytes(239), 67, 9)) == []
    for port, n, count in ((23, 5, 1), (445, 32, 2), (139, 4, 1), (1812, 20, 4), (3478, 20, 4), (111, 12, 1), (1720, 8, 1), (5900, 12, 1), (22, 30, 0)):
        assert len(names(frame(bytes(n), port, 9))) == count
    assert ds.application(9999, 9998, b"ab") is None and ds.application(9999, 9998, bytes(12)) == "dns"
    assert names(frame(head, 80, 9, 6), ds.SeparatorConfig(insert_application_fields=False)) == []


def test_vlan_is_flagged():
    tagged = LINK[:12] + b"\x81\x00\x00\x05\x08\x00" + FRAME[14:]
    assert ds.boundaries(tagged)["vlan"] and ds.boundaries(tagged)["l3"] == "ipv4"


@pytest.fixture(scope="module")
def frames(spark):
    rng = random.Random(1)
    rows = [FRAME, b"", b"\0\1\2", LINK + b"\x45\0", frame(b"x" * 30, 53, 9), frame(b"", 1, 2, 6, bytes(8), 7)]
    for _ in range(150):
        f = bytearray(frame(rng.randbytes(rng.randrange(60)), rng.choice([80, 53, 9]), 9, rng.choice([6, 17, 1, 47]), bytes(4 * rng.randrange(3)), rng.randrange(5, 9)))
        rows.append(bytes(f[: rng.randrange(len(f) + 1)]) if rng.random() < 0.5 else bytes(f))
    return spark.createDataFrame([("f", i, bytearray(r)) for i, r in enumerate(rows)], "path string, packet_index int, data binary")


def test_native_headers_equal_the_dissector(frames):
    config = ds.SeparatorConfig(max_depth=4)
    rows = frames.select("data", ds.headers_native(F.col("data")).alias("h"), ds.dissect(F.col("data"), config).alias("d")).collect()
    for r in rows:
        if r.d.error_type is None:
            assert r.h.places == sorted({o.offset for o in r.d.offsets}) and r.h.l3 == r.d.l3 and r.h.l4 == r.d.l4


def test_separators_keep_the_bytes(frames):
    ids = ds.separated_tokens(F.col("data"))
    rows = frames.select("data", ids.alias("ids")).select("data", "ids", sequences.separator_positions(F.col("ids"), 5).alias("at"), sequences.fields_of(F.col("ids"), 5).alias("fields")).collect()
    for r in rows:
        assert bytes(i - 6 for i in r.ids if i >= 6) == r.data
        assert all(0 < p < len(r.data) for p in r.at) and sum(r.fields, []) == [i for i in r.ids if i != 5] and len(r.fields) == len(r.at) + 1
    assert len(rows[0].ids) == 69 and vocab.FIELD.specials["<sep>"] == 5


def test_malformed_rows(frames):
    rows = ds.malformed(frames).collect()
    assert {"NeedData"} <= {r.error_type for r in rows} and all(r.packet_hex.startswith(r.first_bytes_hex) for r in rows)


def test_given_fields(spark):
    rows = spark.createDataFrame([(bytearray(b"abcdef"), [(0, 2), (1, 4), (2, 3)]), (bytearray(b"ab"), [(0, 2)]), (bytearray(b"ab"), None)], "d binary, f array<struct<start:int,end:int>>")
    got = [r[0] for r in rows.select(ds.separated_by_fields(F.col("d"), F.col("f"))).collect()]
    assert got == [[102, 103, 3, 104, 105, 3, 106, 107], [102, 103], [102, 103]]


def test_sentences(spark, frames):
    rows = spark.createDataFrame([(bytearray(b"A <\x00"),), (bytearray(),)], "d binary")
    line = lambda *a, **k: rows.select(sn.packet_sentence(F.col("d"), *a, **k)).first()[0]
    assert line("tokens") == "▁A ▁  ▁3c ▁00" and line("mixed") == "▁A ▁  ▁0x3c ▁0x00"
    assert line("hex") == "41 20 3c 00" and line("decimal") == "65 32 60 0" and line("other") == "41 20 3c 00"
    assert [r[0] for r in rows.select(sn.hex_sentence(F.col("d"))).collect()] == ["41 20 3c 00", ""]
    assert rows.select(sn.decimal_sentence(F.col("d"))).first()[0] == "65 32 60 0"
    lines = sn.corpus(frames, "hex")
    first = lines.where("packet_index = 0").first()
    assert first.separators == 15 and first.sentence.count("[SEP]") == 15
    assert sn.corpus(frames, "hex", marks=False).where("packet_index = 0").first().sentence == " ".join(f"{b:02x}" for b in FRAME)
    assert sn.file_lines(lines).count() == 1


def test_readable_columns(frames):
    r = frames.where("packet_index = 0").select(*ds.addresses(F.col("data"))).first()
    assert (r.eth_dst, r.eth_type, r.ip_src, r.ip_dst, r.ip_protocol) == ("00:11:22:33:44:55", 2048, "192.168.1.1", "192.168.1.2", 6)
