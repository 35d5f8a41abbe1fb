"""Capture files: formats, faults, discovery, data source and stream."""

import struct

import pytest
from pyspark.sql import functions as F

from wirelake.operators import chunks, dedup, stats
from wirelake.sources import captures, sinks
from wirelake.streaming import streams

FIRST = [b"Hello", bytes(range(10, 16)), bytes(range(256))]


def next_generation(packets):
    block = lambda kind, body: struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))
    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0))
    for i, p in enumerate(packets):
        out += block(6, struct.pack("<IIIII", 0, 0, i * 1_000_000, len(p), len(p)) + p + bytes(-len(p) % 4))
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("captures")
    (top / "deep").mkdir()
    (top / "a.pcap").write_bytes(captures.write_pcap(FIRST))
    (top / "b.pcap").write_bytes(captures.write_pcap(FIRST, ">", nano=True))
    (top / "deep/c.pcapng").write_bytes(next_generation(FIRST))
    (top / "empty.pcap").write_bytes(captures.write_pcap([]))
    (top / "cut.pcap").write_bytes(captures.write_pcap(FIRST)[:-3])
    (top / "bad.cap").write_bytes(b"not a capture")
    (top / "moved.PCAP").write_bytes(captures.write_pcap([b"Hel", b"lo" + FIRST[1], FIRST[2]]))
    return str(top)


def test_reading(spark, folder):
    packets = captures.read_captures(spark, folder)
    rows = packets.orderBy("path", "packet_index").collect()
    files = {}
    for r in rows:
        files.setdefault(r.path.rpartition("/")[2], []).append(r)
    for name in ("a.pcap", "b.pcap", "c.pcapng"):
        assert [bytes(r.data) for r in files[name]] == FIRST and [r.ts.second for r in files[name]] == [0, 1, 2]
    assert "empty.pcap" not in files and files["cut.pcap"][0].error and files["bad.cap"][0].packet_index is None
    assert captures.read_captures(spark, folder, mode="drop").where("error is not null").count() == 0
    assert captures.read_captures(spark, folder, next_generation=False).where("path like '%pcapng' and error is null").count() == 0
    with pytest.raises(Exception, match="cut off|not a capture"):
        captures.read_captures(spark, folder, mode="failfast").collect()


def test_discovery(spark, folder, tmp_path):
    name = F.element_at(F.split("path", "/"), -1)
    assert [r[0] for r in captures.find_captures(spark, folder).select(name).collect()] == ["a.pcap", "b.pcap", "cut.pcap", "c.pcapng", "empty.pcap"]
    assert captures.find_captures(spark, folder, captures.WIDE_SUFFIXES, recursive=False).count() == 6
    assert captures.find_captures(spark, folder, most=24).count() == 1 and captures.find_captures(spark, folder, most=24, strict=True).count() == 0
    (tmp_path / "x.txt").write_text("")
    with pytest.raises(FileNotFoundError):
        captures.find_captures(spark, str(tmp_path), must=True)
    shares = [captures.rank_share(captures.find_captures(spark, folder), r, 2).count() for r in range(2)]
    assert shares == [3, 2]


def test_size_identity(spark, folder):
    packets = captures.read_captures(spark, folder + "/a.pcap")
    one = stats.packet_stats(packets).first()
    assert 24 + 16 * one.packets + one.total_bytes == len(captures.write_pcap(FIRST))
    made = chunks.cut(chunks.packet_sequences(packets), 100)
    assert [r.num_tokens for r in made.orderBy("local_idx").collect()] == [100, 100, 69] and one.total_bytes + one.packets - 1 == 269


def test_table_function_and_format(spark, folder):
    captures.register(spark)
    files = spark.read.format("binaryFile").load(folder + "/a.pcap")
    files.createOrReplaceTempView("capture_files")
    got = spark.sql("select p.packet_index, p.data from capture_files, lateral parse_pcap(content) p order by 1").collect()
    assert [bytes(r.data) for r in got] == FIRST
    assert spark.read.format("pcap").load(folder + "/a.pcap").count() == 3


def test_duplicates(spark, folder):
    packets = captures.read_captures(spark, folder, mode="drop")
    name = lambda files: sorted(f.rpartition("/")[2] for f in files)
    fast = dedup.duplicates(packets, "fast").collect()
    assert len(fast) == 1 and name(fast[0].files) == ["a.pcap", "b.pcap", "c.pcapng", "moved.PCAP"]
    smart = dedup.duplicates(packets, "smart")
    assert [name(r.files) for r in smart.collect()] == [["a.pcap", "b.pcap", "c.pcapng"]]
    both = dedup.content_hashes(packets).join(dedup.content_hashes_streamed(packets).withColumnRenamed("content_hash", "other"), "path")
    assert both.where("content_hash = other").count() == 4
    assert dedup.to_delete(smart).count() == 2 and list(dedup.summary(smart).first()) == [1, 3, 2]
    assert dedup.largest_groups(smart).first().n == 3
    assert sinks.deletion_script(dedup.to_delete(smart)).first().value.startswith("rm -f -- '")
    assert sinks.delete_files(spark, dedup.to_delete(smart)) == 2
    with pytest.raises(ValueError):
        dedup.duplicates(packets, "other")


def test_sinks(spark, folder, tmp_path):
    packets = captures.read_captures(spark, folder, mode="drop").where("path like '%/a.pcap'")
    made = chunks.number(chunks.cut(chunks.packet_sequences(packets), 100))
    sinks.write_chunks(made, f"{tmp_path}/chunks")
    assert sinks.read_chunks(spark, f"{tmp_path}/chunks").count() == 3
    for form in ("npy", "arrow"):
        (tmp_path / form).mkdir()
        assert [r.filename for r in sinks.chunk_files(made, f"{tmp_path}/{form}", form).orderBy("filename").collect()][0] == f"chunk_00000000.{form}"
        back = {r.filename.split(".")[0]: r.tokens for r in sinks.load_chunk_files(spark, f"{tmp_path}/{form}").collect()}
        assert back == {f"chunk_{r.chunk_idx:08d}": r.tokens for r in made.collect()}
    sources = chunks.source_files(made, captures.find_captures(spark, folder))
    assert list(chunks.manifest(sources).first()) == [3, 269, 1, 4]
    sinks.write_json(chunks.manifest(sources), f"{tmp_path}/manifest")
    assert sinks.read_manifest(spark, f"{tmp_path}/manifest").first().total_tokens == 269
    assert chunks.chunk_at(made, 2).first().num_tokens == 69 and chunks.estimate(made).first()[0] == 1.0
    assert '"<sep>": 5' in sinks.vocabulary_json(__import__("wirelake.functions.vocab", fromlist=["FIELD"]).FIELD)
    assert sinks.stamped_folder("vocab", "/x/network.txt").endswith("-network")
    lines = spark.createDataFrame([("<unk>\t0",), ("a\t-1",)], "value string").coalesce(1)
    assert [tuple(r) for r in sinks.piece_json(lines).collect()] == [("<unk>", 0), ("a", 1)]


def test_streams(spark, folder, tmp_path):
    packets = streams.stream_captures(spark, folder, files_a_batch=1)
    known, out = f"{tmp_path}/known", f"{tmp_path}/dups"
    streams.run_now(streams.new_duplicates(packets, known, out, f"{tmp_path}/cp"))
    assert spark.read.parquet(known).select("content_hash").distinct().count() == 1
    assert spark.read.parquet(out).count() == 2
    tokens = streams.token_stream(streams.stream_captures(spark, folder))
    streams.run_now(streams.write_chunks_stream(tokens, f"{tmp_path}/tokens", f"{tmp_path}/cp2"))
    assert spark.read.parquet(f"{tmp_path}/tokens").count() == 9
    rates = streams.packet_rates(streams.stream_captures(spark, folder), late="0 seconds")
    streams.run_now(rates.writeStream.format("memory").queryName("rates").outputMode("complete"))
    assert spark.sql("select sum(packets) from rates").first()[0] == 9
