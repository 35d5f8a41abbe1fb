"""Field boundaries of packets, from the link to the application layer.

A boundary is a place in the packet after which a separator may stand. The layouts below are tables; one routine walks
them. Layers 2 to 4 also exist as built-in expressions, for plans that stay in the JVM.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelake.functions.tokens import binary_parts


@dataclass(frozen=True)
class SeparatorConfig:
    """Which boundaries are marked. policy: what stays of a malformed packet (conservative, hybrid, aggressive)."""

    insert_ethernet_fields: bool = True
    insert_ip_fields: bool = True
    insert_transport_fields: bool = True
    insert_application_fields: bool = True
    max_depth: int = 5
    policy: str = "hybrid"
    parse_http_headers: bool = True
    parse_dns_sections: bool = True
    parse_tls_records: bool = True
    parse_dhcp_options: bool = True
    detailed_app_parsing: bool = False


#: The flags as the command line sets them when none is given.
CLI_PROFILE = SeparatorConfig(parse_http_headers=False, parse_dns_sections=False, parse_tls_records=False, parse_dhcp_options=False)

# Application protocols by port. The source port is looked up first.
PORTS = {
    80: "http", 8080: "http", 8000: "http", 3000: "http", 443: "https", 8443: "https", 53: "dns", 67: "dhcp-server",
    68: "dhcp-client", 123: "ntp", 1812: "radius", 1813: "radius", 3478: "stun", 3479: "stun", 69: "tftp", 23: "telnet",
    5060: "sip", 5061: "sips", 111: "rpc", 135: "rpc", 445: "smb", 139: "netbios", 5190: "aim", 1863: "aim", 4000: "qq",
    5050: "yahoo", 5900: "rfb", 1720: "h225", 1521: "tns", 102: "tpkt", 21: "ftp", 22: "ssh", 25: "smtp", 110: "pop3",
    143: "imap", 993: "imaps", 995: "pop3s", 161: "snmp", 162: "snmp-trap", 194: "irc", 6667: "irc", 514: "syslog",
}
# What payloads of HTTP start with.
HTTP_STARTS = (b"GET ", b"POST", b"PUT ", b"HEAD", b"DELE", b"OPTI", b"TRAC", b"CONN", b"HTTP/1.0", b"HTTP/1.1", b"HTTP/2.0")
# Boundaries of headers, as places after their start, and what begins there.
ETHERNET = ((6, "eth_src"), (12, "eth_type"), (14, "eth_payload"))
IPV4 = ((2, "ip_tos"), (4, "ip_len"), (8, "ip_flags"), (12, "ip_src"), (16, "ip_dst"), (20, "ip_options"))
IPV6 = ((4, "ip6_len"), (6, "ip6_next"), (8, "ip6_src"), (24, "ip6_dst"), (40, "ip6_payload"))
TCP = ((2, "tcp_dst"), (4, "tcp_seq"), (8, "tcp_ack"), (12, "tcp_flags"), (14, "tcp_win"), (18, "tcp_urg"), (20, "tcp_options"))
UDP = ((2, "udp_dst"), (4, "udp_len"), (6, "udp_csum"), (8, "udp_payload"))
ICMP = ((1, "icmp_code"), (2, "icmp_csum"), (4, "icmp_data"), (8, "icmp_payload"))
DNS = ((2, "dns_flags"), (4, "dns_qdcount"), (6, "dns_ancount"), (8, "dns_nscount"), (10, "dns_arcount"), (12, "dns_questions"))
DHCP = (
    (1, "dhcp_htype"), (2, "dhcp_hlen"), (3, "dhcp_hops"), (4, "dhcp_xid"), (8, "dhcp_secs"), (10, "dhcp_flags"),
    (12, "dhcp_ciaddr"), (16, "dhcp_yiaddr"), (20, "dhcp_siaddr"), (24, "dhcp_giaddr"), (28, "dhcp_chaddr"),
    (44, "dhcp_sname"), (108, "dhcp_file"), (236, "dhcp_magic"), (240, "dhcp_options"),
)
NTP = (
    (1, "ntp_stratum"), (2, "ntp_poll"), (3, "ntp_precision"), (4, "ntp_root_delay"), (8, "ntp_root_disp"),
    (12, "ntp_ref_id"), (16, "ntp_ref_ts"), (24, "ntp_orig_ts"), (32, "ntp_recv_ts"), (40, "ntp_xmit_ts"),
)
RTP = ((1, "rtp_pt"), (2, "rtp_seq"), (4, "rtp_ts"), (8, "rtp_ssrc"), (12, "rtp_payload"))
# The places and names of the other application protocols.
#: Application protocols with fixed places: (least payload, places if detailed, places if not, option that decides).
FIXED = {
    "dhcp": (240, DHCP, ((240, "dhcp_options"),), "parse_dhcp_options"),
    "ntp": (48, NTP, ((48, "ntp_end"),), "detailed_app_parsing"),
    "rtp": (12, RTP, ((12, "rtp_payload"),), "detailed_app_parsing"),
    "tftp": (4, ((2, "tftp_data"),), None, None),
    "smb": (32, ((4, "smb_command"), (32, "smb_data")), None, None),
    "netbios": (4, ((4, "netbios_data"),), None, None),
    "radius": (20, ((1, "radius_id"), (2, "radius_length"), (4, "radius_auth"), (20, "radius_attrs")), None, None),
    "stun": (20, ((2, "stun_length"), (4, "stun_magic"), (8, "stun_txn_id"), (20, "stun_attrs")), None, None),
    "rpc": (12, ((12, "rpc_data"),), None, None),
    "h225": (8, ((8, "h225_data"),), None, None),
    "rfb": (12, ((12, "rfb_data"),), None, None),
}
#: Names by which ports call protocols that share a parser.
PARSER = {"dhcp-server": "dhcp", "dhcp-client": "dhcp", "ssl": "tls", "sips": "sip", "https": "http"}
TRANSPORTS = {6: ("tcp", TCP), 17: ("udp", UDP), 1: ("icmp", ICMP)}
LINK = 14

def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


BOUNDARY = _fields(offset=T.IntegerType(), field_name=T.StringType(), protocol=T.StringType(), layer=T.IntegerType())
RESULT = _fields(
    offsets=T.ArrayType(BOUNDARY),
    l3=T.StringType(),
    l4=T.StringType(),
    src_port=T.IntegerType(),
    dst_port=T.IntegerType(),
    app=T.StringType(),
    app_start=T.IntegerType(),
    vlan=T.BooleanType(),
    error_type=T.StringType(),
    error_message=T.StringType(),
)


class Malformed(Exception):
    """The packet can't be read as a frame; ``kind`` names the fault."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def _header(out, start, places, end, ended, protocol, layer, detailed):
    """Boundaries of a header: all its places, and the end of its options if it has some; or only its end."""
    if detailed:
        out += [(start + k, name, protocol, layer) for k, name in places]
        if end > start + places[-1][0]:
            out.append((end, ended + "_payload", protocol, layer))
    else:
        out.append((end, ended + "_end", protocol, layer))


def _network(data: bytes) -> tuple[str | None, bool]:
    """What the frame carries as far as it can be decoded (ipv4, ipv6), and whether it has VLAN tags."""
    kind, at, tagged = data[12:14], LINK, False
    while kind in (b"\x81\x00", b"\x88\xa8") and at + 4 <= len(data):
        kind, at, tagged = data[at + 2 : at + 4], at + 4, True
    if kind == b"\x08\x00" and len(data) >= at + 20 and data[at] & 15 >= 5:
        return "ipv4", tagged
    if kind == b"\x86\xdd" and len(data) >= at + 40:
        return "ipv6", tagged
    return None, tagged


def application(src: int, dst: int, payload: bytes) -> str | None:
    """By port, else by content; anything of 12 bytes or more that isn't HTTP or TLS passes for DNS."""
    named = PORTS.get(src) or PORTS.get(dst)
    if named or len(payload) < 4:
        return named
    if payload.startswith(HTTP_STARTS):
        return "http"
    if len(payload) >= 5 and payload[0] == 0x16 and payload[1] == 3 and payload[2] <= 3:
        return "tls"
    return "dns" if len(payload) >= 12 else None


def _head_end(payload: bytes) -> int | None:
    """Where the body of a text protocol starts. The blank line's length is that of any CRLFCRLF in the payload."""
    crlf = payload.find(b"\r\n\r\n")
    at = crlf if crlf >= 0 else payload.find(b"\n\n")
    return None if at < 0 else at + (4 if crlf >= 0 else 2)


def _text(out, name, payload, a, config):
    protocol = "sip" if name in ("sip", "sips") else name
    prefix = "sip" if protocol == "sip" else "http"
    body = _head_end(payload)
    if body is None:
        out.append((a + len(payload), prefix + "_end", protocol, 5))
        return
    if prefix == "http" and config.parse_http_headers and config.detailed_app_parsing:
        head = payload[: payload.find(b"\r\n\r\n") if b"\r\n\r\n" in payload else payload.find(b"\n\n")]
        newline = b"\r\n" if b"\r\n" in head else b"\n"
        at = a
        for k, line in enumerate(head.split(newline)):
            if k == 0 or line.strip():
                at += len(line) + len(newline)
                if k == 0 or b":" in line:
                    out.append((at, "http_header" if k else "http_request_line", protocol, 5))
    out.append((a + body, prefix + "_body", protocol, 5))


def _name(data: bytes, at: int) -> tuple[str, int]:
    """A domain name with compression pointers, and the place after it; ValueError if it isn't one."""
    parts, after, limit, size = [], None, at, 0
    while True:
        if at >= len(data):
            raise ValueError("cut off in a name")
        n = data[at]
        if n == 0:
            at += 1
            break
        if n & 0xC0 == 0xC0:
            if at + 2 > len(data):
                raise ValueError("cut off in a pointer")
            to = (n & 0x3F) << 8 | data[at + 1]
            if to >= limit:
                raise ValueError("pointer ahead")
            after = at + 2 if after is None else after
            at = limit = to
        elif n & 0xC0:
            raise ValueError("label")
        else:
            size += n + 1
            if at + 1 + n > len(data) or size > 255:
                raise ValueError("label")
            parts.append(data[at + 1 : at + 1 + n].decode("utf-8"))
            at += n + 1
    return ".".join(parts), at if after is None else after


def _dns_sections(payload: bytes) -> tuple[list[int], bool]:
    """Lengths of the questions' names, and whether there are answers; ValueError if any record can't be read."""
    counts = struct.unpack_from(">HHHH", payload, 4)
    at, names = 12, []
    for _ in range(counts[0]):
        name, at = _name(payload, at)
        if at + 4 > len(payload):
            raise ValueError("cut off in a question")
        names.append(len(name))
        at += 4
    for _ in range(sum(counts[1:])):
        _, at = _name(payload, at)
        if at + 10 > len(payload):
            raise ValueError("cut off in a record")
        at += 10 + struct.unpack_from(">H", payload, at + 8)[0]
    return names, counts[1] > 0


def _dns(out, payload, a, config):
    if len(payload) < 12:
        return
    if not config.parse_dns_sections:
        out.append((a + 12, "dns_data", "dns", 5))
        return
    out += [(a + k, name, "dns", 5) for k, name in DNS]
    try:
        names, answers = _dns_sections(payload)
    except ValueError:
        return
    at = a + 12
    for n in names:
        at += n + 4  # two bytes less than on the wire; kept
        out.append((at, "dns_question", "dns", 5))
    if answers:
        out.append((at, "dns_answers", "dns", 5))


def _tls(out, payload, a, config):
    if len(payload) < 5:
        return
    if not config.parse_tls_records:
        out.append((a + 5, "tls_data", "tls", 5))
        return
    at = 0
    while at + 5 <= len(payload):
        end = at + 5 + (payload[at + 3] << 8 | payload[at + 4])
        if end > len(payload):
            break
        out.append((a + at + 5, "tls_record_data", "tls", 5))
        if end == len(payload):
            break
        out.append((a + end, "tls_record", "tls", 5))
        at = end


def _application(out, name, payload, a, config):
    parser = PARSER.get(name, name)
    if parser in FIXED:
        least, detailed, plain, option = FIXED[parser]
        if len(payload) >= least:
            places = detailed if option is None or getattr(config, option) else plain
            out += [(a + k, n, parser, 5) for k, n in places]
    elif parser == "dns":
        _dns(out, payload, a, config)
    elif parser == "tls":
        _tls(out, payload, a, config)
    elif parser in ("http", "sip"):
        if len(payload) >= 4:
            _text(out, name, payload, a, config)
    elif parser == "telnet":
        out.append((a + len(payload), "telnet_end", "telnet", 5))


def _walk(data: bytes, config: SeparatorConfig, out: list, info: dict) -> None:
    if len(data) < LINK:
        raise Malformed("NeedData", f"{len(data)} bytes are no frame")
    if config.max_depth >= 2:
        _header(out, 0, ETHERNET, LINK, "eth", "ethernet", 2, config.insert_ethernet_fields)
    info["l3"], info["vlan"] = _network(data)
    if config.max_depth < 3 or not info["l3"]:
        return
    # a fixed link header is assumed: behind VLAN tags the places are off, and ``vlan`` says so
    version = data[LINK] >> 4 if len(data) >= LINK + 20 else 0
    size = (data[LINK] & 15) * 4
    if version == 4 and len(data) >= LINK + size:
        _header(out, LINK, IPV4, LINK + size, "ip", "ipv4", 3, config.insert_ip_fields)
    elif version == 6 and len(data) >= LINK + 40:
        _header(out, LINK, IPV6, LINK + 40, "ip6", "ipv6", 3, config.insert_ip_fields)
    if config.max_depth < 4:
        return
    base = LINK if not info["vlan"] else LINK + 4
    number = data[base + 9] if info["l3"] == "ipv4" else data[base + 6]
    t = LINK + (size if info["l3"] == "ipv4" else 40)
    name, places = TRANSPORTS.get(number, (None, None))
    info["l4"] = name
    a = None
    if name in ("tcp", "udp") and len(data) >= t + 4:
        info["src_port"], info["dst_port"] = struct.unpack_from(">HH", data, t)
        if name == "tcp" and len(data) <= t + 12:
            raise Malformed("IndexError", "the TCP header ends before its length")
        a = t + (data[t + 12] >> 4) * 4 if name == "tcp" else t + 8
    if name == "tcp" and len(data) >= t + 20:
        end = t + (data[t + 12] >> 4) * 4
        if len(data) >= end:
            _header(out, t, places, end, "tcp", "tcp", 4, config.insert_transport_fields)
    elif name in ("udp", "icmp") and len(data) >= t + 8:
        _header(out, t, places, t + 8, name, name, 4, config.insert_transport_fields)
    info["app_start"] = a
    if config.max_depth >= 5 and a is not None and a < len(data) and config.insert_application_fields:
        payload = data[a:]
        info["app"] = application(info["src_port"], info["dst_port"], payload)
        if info["app"]:
            _application(out, info["app"], payload, a, config)


def boundaries(data: bytes, config: SeparatorConfig = SeparatorConfig()) -> dict:
    """The fields of RESULT for one packet: distinct boundaries within it by (place, layer, name), and what was found on each layer."""
    out: list[tuple[int, str, str, int]] = []
    info = dict.fromkeys(RESULT.names)
    info["vlan"] = False
    try:
        _walk(data, config, out, info)
    except Malformed as e:
        info["error_type"], info["error_message"] = e.kind, str(e)
        if config.policy == "conservative":
            out = []
        elif len(data) >= LINK:
            _header(out, 0, ETHERNET, LINK, "eth", "ethernet", 2, config.insert_ethernet_fields)
    inside = sorted({o for o in out if o[0] <= len(data)}, key=lambda o: (o[0], o[3], o[1]))
    info["offsets"] = [dict(zip(("offset", "field_name", "protocol", "layer"), o, strict=True)) for o in inside]
    return info


def cuts(places: list[int], size: int) -> list[int]:
    """Where separators stand: distinct places within the packet, not at its start or end."""
    return sorted({p for p in places if 0 < p < size})


def _shape(data: bytes, config: SeparatorConfig):
    """What boundaries depend on when nothing follows the headers; None if something does that is read, or with VLAN tags."""
    n = len(data)
    kind = data[12:14]
    if n < LINK or kind in (b"\x81\x00", b"\x88\xa8"):
        return (n,) if n < LINK else None
    if kind == b"\x08\x00" and n >= 34:
        number, t = data[23], LINK + (data[14] & 15) * 4
    elif kind == b"\x86\xdd" and n >= 54:
        number, t = data[20], 54
    else:
        return n, kind, -1, -1, -1
    size = data[t + 12] if number == 6 and n > t + 12 else -1
    a = t + (size >> 4) * 4 if number == 6 else t + 8
    if number in (6, 17) and a < n and config.max_depth >= 5 and config.insert_application_fields:
        return None
    return n, kind, data[14], number, size


def _by_shape(packets: list, config: SeparatorConfig) -> tuple[np.ndarray, list[dict], list, list]:
    """(number of its result, results, source port, destination port) of packets; those of one shape share a result. -1 for null."""
    known: dict[tuple, int] = {}
    codes, found, src, dst = np.full(len(packets), -1), [], [None] * len(packets), [None] * len(packets)
    for k, d in enumerate(packets):
        if d is None:
            continue
        key = _shape(d, config)
        code = None if key is None else known.get(key)
        if code is None:
            code = len(found)
            found.append(boundaries(d, config))
            if key is not None:
                known[key] = code
        codes[k] = code
        if found[code]["src_port"] is not None:
            t = LINK + (d[14] & 15) * 4 if found[code]["l3"] == "ipv4" else 54
            src[k], dst[k] = d[t] << 8 | d[t + 1], d[t + 2] << 8 | d[t + 3]
    return codes, found, src, dst


def dissect(data: Column, config: SeparatorConfig = SeparatorConfig()) -> Column:
    """RESULT of each packet, by Arrow batches; null for null. Packets of one shape are walked once a batch."""

    @F.arrow_udf(RESULT)
    def run(data: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(RESULT)
        codes, found, src, dst = _by_shape(data.to_pylist(), config)
        at = pa.array(codes, mask=codes < 0)
        own = {"src_port": src, "dst_port": dst}
        parts = [pa.array(own[f.name], f.type) if f.name in own else pa.array([x[f.name] for x in found], f.type).take(at) for f in kind]
        return pa.StructArray.from_arrays(parts, fields=list(kind), mask=pa.array(codes < 0))

    return run(data)


def separated_tokens(data: Column, config: SeparatorConfig = SeparatorConfig(), offset: int = 6, separator: int = 5) -> Column:
    """Ids of the bytes with a separator at each boundary; packets of one shape are filled in together."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(data: pa.Array) -> pa.Array:
        codes, found, _, _ = _by_shape(data.to_pylist(), config)
        begin, values = binary_parts(data)
        size = np.where(codes < 0, 0, np.diff(begin))
        places = [cuts([o["offset"] for o in x["offsets"]], int(n)) for x, n in zip(found, _first_sizes(codes, size, len(found)), strict=True)]
        extra = np.array([*map(len, places), 0])[codes]
        ends = np.concatenate(([0], np.cumsum(size + extra)))
        out = np.empty(int(ends[-1]), np.int32)
        order = np.argsort(codes, kind="stable")
        edges = np.searchsorted(codes[order], np.arange(len(found) + 1))
        for code, where in enumerate(places):
            rows = order[edges[code] : edges[code + 1]]
            n = int(size[rows[0]])
            block = values[begin[rows][:, None] + np.arange(n)].astype(np.int32) + offset
            out[ends[rows][:, None] + np.arange(n + len(where))] = np.insert(block, where, separator, axis=1)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out), mask=pa.array(codes < 0))

    return run(data)


def _first_sizes(codes: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """The size of the packets of each result; packets of one result have one size."""
    out = np.zeros(n, np.int64)
    out[codes[codes >= 0]] = size[codes >= 0]
    return out


def separated_by_fields(data: Column, fields: Column, offset: int = 5, separator: int = 3) -> Column:
    """Ids with a separator between the given fields (array of struct start, end), by start; what lies between fields stays as it is.

    A field that starts within an earlier one starts where that ends; one that lies within another adds nothing.
    """

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(data: pa.Array, fields: pa.Array) -> pa.Array:
        out = []
        for d, fs in zip(data.to_pylist(), fields.to_pylist(), strict=True):
            if d is None:
                out.append(None)
                continue
            ids, last = [], 0
            for f in sorted(fs or [], key=lambda f: (f["start"], f["end"])):
                start, end = max(f["start"], last), min(f["end"], len(d))
                if end <= start:
                    continue
                ids += [b + offset for b in d[last:end]]
                ids.append(separator)
                last = end
            ids += [b + offset for b in d[last:]]
            if ids and ids[-1] == separator:
                ids.pop()
            out.append(ids)
        return pa.array(out, pa.list_(pa.int32()))

    return run(data, fields)


def malformed(packets: DataFrame, config: SeparatorConfig = SeparatorConfig()) -> DataFrame:
    """One row for each packet that can't be read: what a log of malformed packets holds."""
    d = dissect(F.col("data"), config)
    found = packets.where("data is not null").withColumn("_d", d).where("_d.error_type is not null")
    return found.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.col("path").alias("file"),
        "packet_index",
        F.octet_length("data").alias("packet_length"),
        F.col("_d.error_type").alias("error_type"),
        F.col("_d.error_message").alias("error_message"),
        F.lower(F.hex(F.expr("substring(data, 1, 20)"))).alias("first_bytes_hex"),
        F.lower(F.hex("data")).alias("packet_hex"),
    )


def _byte(data: Column, at: Column) -> Column:
    return F.ascii(F.decode(F.substring(data, at + 1, F.lit(1)), "ISO-8859-1"))


def _word(data: Column, at: Column) -> Column:
    return _byte(data, at) * 256 + _byte(data, at + 1)


def headers_native(data: Column) -> Column:
    """Layers 2 to 4 of untagged frames by built-in functions: struct of l3, l4, src_port, dst_port and places (detailed, distinct, within the packet)."""
    n = F.octet_length(data)
    kind = F.hex(F.substring(data, F.lit(13), F.lit(2)))
    four = (kind == "0800") & (n >= 34) & ((_byte(data, F.lit(14)).bitwiseAND(15)) >= 5)
    six = (kind == "86DD") & (n >= 54)
    size = _byte(data, F.lit(14)).bitwiseAND(15) * 4
    version = F.shiftright(_byte(data, F.lit(14)), 4)
    number = F.when(four, _byte(data, F.lit(23))).when(six, _byte(data, F.lit(20)))
    t = F.when(four, size + LINK).when(six, F.lit(LINK + 40))
    l4 = F.when(number == 6, F.lit("tcp")).when(number == 17, F.lit("udp")).when(number == 1, F.lit("icmp"))
    ports = l4.isin("tcp", "udp") & (n >= t + 4)
    length = F.shiftright(_byte(data, t + 12), 4) * 4

    def places(cond, start, fields, end=None):
        each = [start + k for k, _ in fields] + ([end] if end is not None else [])
        return F.when(cond, F.array(*each)).otherwise(F.array().cast("array<int>"))

    all_ = F.concat(
        places(n >= LINK, F.lit(0), ETHERNET),
        places(four & (version == 4) & (n >= size + LINK), F.lit(LINK), IPV4, size + LINK),
        places(six & (version == 6), F.lit(LINK), IPV6),
        places((l4 == "tcp") & (n >= t + 20) & (n >= t + length), t, TCP, t + length),
        places((l4 == "udp") & (n >= t + 8), t, UDP),
        places((l4 == "icmp") & (n >= t + 8), t, ICMP),
    )
    return F.struct(
        F.when(four, F.lit("ipv4")).when(six, F.lit("ipv6")).alias("l3"),
        l4.alias("l4"),
        F.when(ports, _word(data, t)).alias("src_port"),
        F.when(ports, _word(data, t + 2)).alias("dst_port"),
        F.array_sort(F.array_distinct(F.filter(all_, lambda x: x <= n))).alias("places"),
    )


def port_protocol(src: Column, dst: Column) -> Column:
    """The protocol named by the source port, else by the destination port."""
    named = F.create_map(*[F.lit(x) for pair in PORTS.items() for x in pair])
    return F.coalesce(F.try_element_at(named, src), F.try_element_at(named, dst))


def addresses(data: Column) -> list[Column]:
    """Link addresses, type, and network addresses of a frame as readable columns."""
    def mac(at):
        return F.lower(F.regexp_replace(F.hex(F.substring(data, F.lit(at + 1), F.lit(6))), "(..)(?!$)", "$1:"))

    def dotted(at):
        return F.concat_ws(".", *[_byte(data, F.lit(at + k)).cast("string") for k in range(4)])

    ip = (F.hex(F.substring(data, F.lit(13), F.lit(2))) == "0800") & (F.octet_length(data) >= 34)
    return [
        mac(0).alias("eth_dst"),
        mac(6).alias("eth_src"),
        _word(data, F.lit(12)).alias("eth_type"),
        F.when(ip, dotted(26)).alias("ip_src"),
        F.when(ip, dotted(30)).alias("ip_dst"),
        F.when(ip, _byte(data, F.lit(23))).alias("ip_protocol"),
    ]
