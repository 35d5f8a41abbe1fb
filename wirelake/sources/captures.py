"""Capture files: discovery, the pcap and pcapng formats, and a data source for batch and stream."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of the largest file that Spark's reader takes as one value.
LARGEST = 2**31 - 2**20
PACKET = "path string, packet_index int, ts timestamp, caplen int, wirelen int, linktype int, data binary, error string"
SUFFIXES = ("pcap", "pcapng")
WIDE_SUFFIXES = ("pcap", "pcapng", "cap", "PCAP", "PCAPNG", "CAP")


class CaptureError(ValueError):
    """The file isn't a capture, or is cut off."""


def _classic(data: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
    orders = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
    order, divide = orders[data[:4]]
    if len(data) < 24:
        raise CaptureError("cut off in the file header")
    link = struct.unpack_from(order + "I", data, 20)[0] & 0xFFFF
    at, record = 24, struct.Struct(order + "IIII")
    while at < len(data):
        if at + 16 > len(data):
            raise CaptureError("cut off in a packet header")
        sec, part, size, wire = record.unpack_from(data, at)
        at += 16
        if at + size > len(data):
            raise CaptureError("cut off in a packet")
        yield sec * 1_000_000 + part // divide, size, wire, link, data[at : at + size]
        at += size


def _next_generation(data: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
    at, order, links, units = 0, "<", [], []
    while at + 12 <= len(data):
        kind = data[at : at + 4]
        if kind == b"\x0a\x0d\x0d\x0a":
            order = "<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
            links, units = [], []
        size = struct.unpack_from(order + "I", data, at + 4)[0]
        if size < 12 or at + size > len(data):
            raise CaptureError("cut off in a block")
        body, number = data[at + 8 : at + size - 4], struct.unpack(order + "I", kind)[0]
        if number == 1:
            links.append(struct.unpack_from(order + "H", body)[0])
            units.append(_resolution(body[8:], order))
        elif number == 6:
            face, high, low, length, wire = struct.unpack_from(order + "IIIII", body)
            if face >= len(links) or 20 + length > len(body):
                raise CaptureError("bad packet block")
            yield ((high << 32) | low) * 1_000_000 // units[face], length, wire, links[face], body[20 : 20 + length]
        elif number == 3 and links:
            wire = struct.unpack_from(order + "I", body)[0]
            length = min(wire, len(body) - 4)
            yield 0, length, wire, links[0], body[4 : 4 + length]
        at += size


def _resolution(options: bytes, order: str) -> int:
    """Ticks of a second, from an interface's options; a millionth unless given."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "HH", options, at)
        if code == 0:
            break
        if code == 9 and size:
            value = options[at + 4]
            return 2 ** (value & 0x7F) if value & 0x80 else 10**value
        at += 4 + size + -size % 4
    return 1_000_000


def parse(data: bytes, next_generation: bool = True) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(microseconds, captured length, wire length, link type, bytes) of the packets in order; CaptureError on anything else."""
    magic = bytes(data[:4])
    if magic in (b"\xd4\xc3\xb2\xa1", b"\xa1\xb2\xc3\xd4", b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d"):
        return _classic(data)
    if magic == b"\x0a\x0d\x0d\x0a" and next_generation:
        return _next_generation(data)
    raise CaptureError("not a capture file")


def find_captures(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES, recursive: bool = True, most: int | None = None, strict: bool = False, must: bool = False) -> DataFrame:
    """(path, length, modified) of the capture files under a folder, by path; contents aren't read.

    ``most``: largest size in bytes, itself allowed unless ``strict``. ``must``: no file at all is an error.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(folder)
    found = found.select("path", "length", F.col("modificationTime").alias("modified"))
    if most is not None:
        found = found.where(F.col("length") < most if strict else F.col("length") <= most)
    if must and found.isEmpty():
        raise FileNotFoundError(f"no capture files in {folder}")
    return found.orderBy("path")


def with_rank(files: DataFrame, world: int) -> DataFrame:
    """The files with the rank that each goes to: in the order of paths they are dealt in turn."""
    from wirelake.operators.sequences import batches

    return batches(files, 1, "path").withColumn("rank", F.pmod("batch", F.lit(world)).cast("int")).drop("batch")


def rank_share(files: DataFrame, rank: int, world: int) -> DataFrame:
    """Every ``world``-th file by path, from ``rank`` on."""
    return with_rank(files, world).where(F.col("rank") == rank).drop("rank")


def read_captures(spark: SparkSession, path: str, suffixes: tuple[str, ...] = WIDE_SUFFIXES, recursive: bool = True, mode: str = "permissive", next_generation: bool = True, most: int | None = None) -> DataFrame:
    """Packets (PACKET) of the captures at a path, one task a file.

    A file that can't be read in full gives, like a failed file, no packets but one row with ``error`` and a null
    packet_index (permissive), nothing (drop), or an error (failfast). So does one of more than LARGEST bytes, which
    Spark's reader refuses; the others are read all the same. A file without packets has no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(path)
    if most is not None:
        files = files.where(F.col("length") <= most)
    found = _explode_files(files.where(F.col("length") <= LARGEST), mode, next_generation)
    large = files.where(F.col("length") > LARGEST).select("path")
    reason = F.lit(f"more than {LARGEST} bytes; split the capture")
    if mode == "failfast":
        found = found.unionByName(large.select(F.raise_error(F.concat("path", F.lit(": "), reason)).cast("string").alias("path")), allowMissingColumns=True)
    elif mode == "permissive":
        found = found.unionByName(large.withColumn("error", reason), allowMissingColumns=True)
    return found


def _explode_files(files: DataFrame, mode: str, next_generation: bool) -> DataFrame:
    schema = T.StructType.fromDDL(PACKET)
    kinds = [pa.string(), pa.int32(), pa.timestamp("us", "UTC"), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]

    def record(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    data = content.as_py()
                    packets = list(parse(data, next_generation))
                except (CaptureError, struct.error) as e:
                    if mode == "failfast":
                        raise ValueError(f"{path}: {e}") from e
                    if mode == "permissive":
                        yield record([(path, None, None, None, None, None, None, str(e))])
                    continue
                for k in range(0, len(packets), 4096):
                    yield record([(path, k + i, *p, None) for i, p in enumerate(packets[k : k + 4096])])

    return files.select("path", "content").mapInArrow(run, schema)


def stream_captures(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES, files_a_batch: int | None = None) -> DataFrame:
    """The packets of capture files as they arrive in a folder."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}")
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return _explode_files(reader.load(folder), "permissive", True)


def payloads(packets: DataFrame, mode: str = "full") -> DataFrame:
    """Packets with ``data`` in full, without the link layer, or only what follows the transport header; empty ones are dropped."""
    if mode == "link":
        packets = packets.withColumn("data", F.expr("substring(data, 15)"))
    elif mode == "payload":
        from wirelake.functions.dissect import dissect

        # behind the transport header, or the last header that was read
        packets = packets.withColumn("_d", dissect(F.col("data")))
        last = F.array_max(F.transform(F.filter("_d.offsets", lambda o: o["layer"] <= 4), lambda o: o["offset"]))
        packets = packets.withColumn("_a", F.coalesce("_d.app_start", last, F.lit(14))).withColumn("data", F.expr("substring(data, _a + 1)")).drop("_a", "_d")
    return packets.where(F.octet_length("data") > 0)


def register(spark: SparkSession) -> None:
    """Registers the table function parse_pcap(content) and the data source format ``pcap``."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    @F.udtf(returnType="packet_index int, ts timestamp, caplen int, wirelen int, linktype int, data binary")
    class ParsePcap:
        def eval(self, content: bytes):
            import datetime

            try:
                packets = list(parse(bytes(content or b"")))
            except (CaptureError, struct.error):
                return
            for i, (us, size, wire, link, data) in enumerate(packets):
                yield i, datetime.datetime.fromtimestamp(us / 1e6), size, wire, link, data

    spark.udtf.register("parse_pcap", ParsePcap)

    class File(InputPartition):
        def __init__(self, path):
            self.path = path

    class Reader(DataSourceReader):
        def __init__(self, paths):
            self.paths = paths

        def partitions(self):
            return [File(p) for p in self.paths]

        def read(self, part):
            import datetime

            with open(part.path, "rb") as f:
                data = f.read()
            try:
                packets = list(parse(data))
            except (CaptureError, struct.error) as e:
                yield (part.path, None, None, None, None, None, None, str(e))
                return
            for i, (us, size, wire, link, d) in enumerate(packets):
                yield (part.path, i, datetime.datetime.fromtimestamp(us / 1e6), size, wire, link, d, None)

    class Pcap(DataSource):
        """Files of a folder on a mounted path; for stores that only Spark reads use read_captures."""

        @classmethod
        def name(cls):
            return "pcap"

        def schema(self):
            return PACKET

        def reader(self, schema):
            import pathlib

            top = pathlib.Path(self.options["path"].removeprefix("file://"))
            found = [top] if top.is_file() else sorted(p for p in top.rglob("*") if p.suffix.lower() in (".pcap", ".pcapng", ".cap"))
            return Reader([str(p) for p in found])

    spark.dataSource.register(Pcap)


def write_pcap(packets: list[bytes], order: str = "<", nano: bool = False, start: int = 0) -> bytes:
    """A classic capture file of the packets, a second apart."""
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = [struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)]
    for i, p in enumerate(packets):
        out += [struct.pack(order + "IIII", start + i, 0, len(p), len(p)), p]
    return b"".join(out)
