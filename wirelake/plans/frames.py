"""Queries over frames of many shapes, and over single token functions, with their DuckDB forms.

Frames are built from orders by an expression that both engines read, so the SQL forms parse the same bytes by
themselves. Every query reads its whole tables.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from wirelake.functions import dissect, sentences, tokens, vocab
from wirelake.operators import chunks, dedup, lmmath, sequences, stats
from wirelake.plans.catalog import _DOCS, _LIST, _TURNS, _digest, document_packets, turn_packets
from wirelake.tables import table

_K, _C = "CAST(o_orderkey AS BIGINT)", "CAST(o_custkey AS BIGINT)"


def _hex(x, digits):
    return f"lpad(hex(CAST({x} AS BIGINT)), {digits}, '0')"


def _ipv4(size, number):
    return f"('0800' || {_hex(f'64 + {size}', 2)} || '0000281234400040' || {_hex(number, 2)} || '0000' || {_hex(_C, 8)} || {_hex(_K, 8)} || repeat('01', CAST(({size} - 5) * 4 AS INT)))"


def _ipv6(number):
    return f"('86DD' || '600000000014' || {_hex(number, 2)} || '40' || repeat('20', 16) || repeat('FE', 16))"


_PORTS = f"{_hex(f'{_K} % 65536', 4)} || {_hex(f'{_C} % 65536', 4)}"


def _tcp(size):
    return f"({_PORTS} || {_hex(_K, 8)} || '00000000' || {_hex(f'({size}) * 16', 2)} || '0220000000' || '0000' || repeat('01', CAST((({size}) - 5) * 4 AS INT)))"


_UDP = f"({_PORTS} || '00080000')"
_ICMP = "'0800ABCD00000001'"
_WHOLE = f"""('001122334455' || {_hex(_K, 12)} || CASE {_C} % 10
    WHEN 0 THEN {_ipv4(5, 6)} || {_tcp(5)}
    WHEN 1 THEN {_ipv4(f'(5 + {_K} % 3)', 6)} || {_tcp(f'5 + {_K} % 4')}
    WHEN 2 THEN {_ipv4(5, 17)} || {_UDP}
    WHEN 3 THEN {_ipv4(f'(5 + {_K} % 2)', 1)} || {_ICMP}
    WHEN 4 THEN {_ipv6(6)} || {_tcp(f'5 + {_K} % 2')}
    WHEN 5 THEN {_ipv6(17)} || {_UDP}
    WHEN 6 THEN '0806' || repeat('00', 28)
    WHEN 7 THEN {_ipv4(5, 47)} || repeat('00', 8)
    WHEN 8 THEN {_ipv6(58)} || {_ICMP}
    ELSE '0800' || '44' || repeat('00', 30) END)"""
#: Hex of each order's frame; one in seven is cut short, some within a header.
FRAME = f"(CASE WHEN {_K} % 7 = 3 THEN substr({_WHOLE}, 1, CAST(2 * (8 + {_K} % 64) AS INT)) ELSE {_WHOLE} END)"


def frames(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.expr(FRAME).alias("h"))
    return rows.select("k", F.unhex("h").alias("data"))


def _at(i):
    return f"CAST('0x' || substr(h, CAST(2 * ({i}) + 1 AS INT), 2) AS INT)"


#: What each frame holds, by SQL: l3, l4, where the transport starts, ports, whether its TCP header is cut off.
_PARSED = f"""
    (SELECT *, l4 = 'tcp' AND n >= t + 4 AND n <= t + 12 AS short, l4 IN ('tcp', 'udp') AND n >= t + 4 AS ported,
       CASE WHEN l4 = 'tcp' AND n > t + 12 THEN ({_at('t + 12')} >> 4) * 4 END AS size FROM
     (SELECT *, CASE number WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 1 THEN 'icmp' END AS l4 FROM
      (SELECT *, CASE l3 WHEN 'ipv4' THEN {_at(23)} WHEN 'ipv6' THEN {_at(20)} END AS number, CASE l3 WHEN 'ipv4' THEN 14 + ihl * 4 WHEN 'ipv6' THEN 54 END AS t FROM
       (SELECT *, CASE WHEN substr(h, 25, 4) = '0800' AND n >= 34 AND ihl >= 5 THEN 'ipv4' WHEN substr(h, 25, 4) = '86DD' AND n >= 54 THEN 'ipv6' END AS l3 FROM
        (SELECT o_orderkey AS k, h, length(h) // 2 AS n, CASE WHEN length(h) >= 30 THEN {_at(14)} & 15 ELSE 0 END AS ihl FROM (SELECT *, {FRAME} AS h FROM orders))))))
"""


def _places(link, network4, network6, tcp, udp, icmp, options=True):
    """SQL list of the places: of each header those given, and where options end (None: only a header's end)."""
    def header(places, start, end):
        each = ", ".join(f"{start} + {p}" for p in places) if places is not None else f"{end}"
        more = f"CASE WHEN {end} > {start} + 20 THEN [{end}] ELSE [] END" if places is not None and end else "[]"
        return f"list_concat([{each}], {more})"

    parts = [f"CASE WHEN n >= 14 THEN {link} ELSE [] END"]
    parts.append(f"CASE WHEN l3 = 'ipv4' AND n >= 14 + ihl * 4 THEN {header(network4, 14, '14 + ihl * 4')} ELSE [] END")
    parts.append(f"CASE WHEN l3 = 'ipv6' THEN {network6} ELSE [] END")
    parts.append(f"CASE WHEN l4 = 'tcp' AND NOT short AND n >= t + 20 AND n >= t + size THEN {header(tcp, 't', 't + size')} ELSE [] END")
    parts.append(f"CASE WHEN l4 = 'udp' AND n >= t + 8 THEN [{udp}] WHEN l4 = 'icmp' AND n >= t + 8 THEN [{icmp}] ELSE [] END")
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return f"list_sort(list_distinct(list_filter({out}, lambda x: x <= n)))"


_DETAILED = _places("[6, 12, 14]", (2, 4, 8, 12, 16, 20), "[18, 20, 22, 38, 54]", (2, 4, 8, 12, 14, 18, 20), "t + 2, t + 4, t + 6, t + 8", "t + 1, t + 2, t + 4, t + 8")
_ENDS = _places("[14]", None, "[54]", None, "t + 8", "t + 8")
_ERROR = "CASE WHEN n < 14 THEN 'NeedData' WHEN short THEN 'IndexError' END"
_ONLY_ENDS = dissect.SeparatorConfig(insert_ethernet_fields=False, insert_ip_fields=False, insert_transport_fields=False)


def _joined(places):
    return F.array_join(F.transform(F.array_distinct(F.transform(places, lambda o: o["offset"])), lambda x: x.cast("string")), ",")


def _layers(config):
    def run(spark, sf_dir):
        d = frames(spark, sf_dir).select("k", dissect.dissect(F.col("data"), config).alias("d"))
        flat = d.select("k", "d.l3", "d.l4", "d.src_port", "d.dst_port", "d.error_type", _joined(F.col("d.offsets")).alias("places"))
        return flat.groupBy("l3", "l4", "error_type", "places").agg(F.count("*").alias("n"), F.min("k").alias("least"), F.sum(F.coalesce("src_port", F.lit(0))).alias("src"), F.sum(F.coalesce("dst_port", F.lit(0))).alias("dst"))

    return run


def _layers_sql(places):
    return f"SELECT l3, l4, {_ERROR} AS error_type, array_to_string({places}, ',') AS places, count(*) AS n, min(k) AS least, CAST(sum(CASE WHEN ported THEN {_at('t')} * 256 + {_at('t + 1')} ELSE 0 END) AS BIGINT) AS src, CAST(sum(CASE WHEN ported THEN {_at('t + 2')} * 256 + {_at('t + 3')} ELSE 0 END) AS BIGINT) AS dst FROM {_PARSED} GROUP BY 1, 2, 3, 4"


def frame_layers_native(spark, sf_dir):
    """Layers 2 to 4 by built-in functions, of frames that aren't cut off within a TCP header."""
    h = frames(spark, sf_dir).select(dissect.headers_native(F.col("data")).alias("h"), dissect.dissect(F.col("data"))["error_type"].alias("e")).where("e IS NULL")
    flat = h.select("h.l3", "h.l4", F.array_join(F.transform("h.places", lambda x: x.cast("string")), ",").alias("places"))
    return flat.groupBy("l3", "l4", "places").agg(F.count("*").alias("n"))


def frame_depths(spark, sf_dir):
    """Boundaries of each layer that is reached at each depth."""
    found = None
    for depth in (2, 3, 4):
        d = frames(spark, sf_dir).select(dissect.dissect(F.col("data"), dissect.SeparatorConfig(max_depth=depth)).alias("d"))
        one = d.select(F.lit(depth).alias("depth"), F.explode("d.offsets").alias("o")).groupBy("depth", F.col("o.layer").alias("layer")).agg(F.count("*").alias("n"))
        found = one if found is None else found.unionByName(one)
    return found


def _by_layer(layer):
    if layer == 2:
        return "CASE WHEN n >= 14 THEN 3 ELSE 0 END"
    if layer == 3:
        return "CASE WHEN l3 = 'ipv4' AND n >= 14 + ihl * 4 THEN 6 + CAST(ihl > 5 AS INT) WHEN l3 = 'ipv6' THEN 5 ELSE 0 END"
    return "CASE WHEN l4 = 'tcp' AND NOT short AND n >= t + 20 AND n >= t + size THEN 7 + CAST(size > 20 AS INT) WHEN l4 IN ('udp', 'icmp') AND n >= t + 8 THEN 4 ELSE 0 END"


def frame_policies(spark, sf_dir):
    """What stays of malformed frames under each policy."""
    found = None
    for policy in ("conservative", "aggressive", "hybrid"):
        d = frames(spark, sf_dir).select(dissect.dissect(F.col("data"), dissect.SeparatorConfig(policy=policy)).alias("d")).where("d.error_type is not null")
        one = d.groupBy(F.lit(policy).alias("policy"), F.col("d.error_type").alias("error_type")).agg(F.count("*").alias("n"), F.sum(F.size("d.offsets")).alias("boundaries"))
        found = one if found is None else found.unionByName(one)
    return found


def malformed_frames(spark, sf_dir):
    """The log of malformed frames, without its time stamps."""
    packets = frames(spark, sf_dir).select(F.lit("orders").alias("path"), F.col("k").alias("packet_index"), "data")
    return dissect.malformed(packets).select("file", "packet_index", "packet_length", "error_type", "first_bytes_hex", "packet_hex")


def malformed_totals(spark, sf_dir):
    packets = frames(spark, sf_dir).select(F.lit("orders").alias("path"), F.col("k").alias("packet_index"), "data")
    return stats.malformed_counts(dissect.malformed(packets))


def frame_tokens(spark, sf_dir):
    """Digest of each frame's ids with separators, the fields between them, and the separators' number."""
    made = frames(spark, sf_dir).select("k", dissect.separated_tokens(F.col("data")).alias("ids"))
    fields = sequences.fields_of(F.col("ids"), 5)
    return made.select("k", F.size("ids").alias("n"), _digest(F.col("ids")).alias("ids_md5"), F.size(fields).alias("fields"), F.array_join(F.transform(fields, lambda f: F.size(f).cast("string")), ",").alias("sizes"))


_CUT = f"(SELECT k, n, {_LIST.format(plus='')} AS v, list_filter({_DETAILED}, lambda x: x > 0 AND x < n) AS c FROM {_PARSED})"


def _frame_sentence(form):
    def run(spark, sf_dir):
        line = sentences.packet_sentence(F.col("data"), form)
        rows = frames(spark, sf_dir).select("k", line.alias("s"))
        return rows.select("k", F.md5("s").alias("sentence_md5"), sentences.separator_count(F.col("s")).alias("separators"))

    return run


def _frame_sentence_sql(word):
    return f"SELECT k, md5(array_to_string(flatten(list_transform(range(0, n), lambda i: CASE WHEN list_contains(c, CAST(i AS INT)) THEN ['[SEP]', {word}] ELSE [{word}] END)), ' ')) AS sentence_md5, CAST(len(c) AS INT) AS separators FROM {_CUT}"


_SHOWN = "v[i + 1] BETWEEN 32 AND 126 AND v[i + 1] NOT IN (60, 62)"


def frame_corpus_totals(spark, sf_dir):
    """Files, packets, bytes and separators of a corpus of frames; every hundredth key is a file."""
    packets = frames(spark, sf_dir).select((F.col("k") % 100).alias("path"), F.col("k").alias("packet_index"), "data")
    found = stats.builder_totals(sentences.corpus(packets))
    return found.select("files", "packets", "bytes", "separators", F.round("avg_bytes", 6).alias("avg_bytes"), F.round("avg_separators", 6).alias("avg_separators"))


def frame_file_lines(spark, sf_dir):
    """Sentences of a file's frames as one line, and their bytes shifted into characters."""
    packets = frames(spark, sf_dir).select((F.col("k") % 100).alias("path"), F.col("k").alias("packet_index"), "data")
    lines = sentences.file_lines(sentences.corpus(packets, "hex", separators=False))
    return lines.select("path", F.length("line").alias("n"), F.md5("line").alias("line_md5"))


def shifted_file_lines(spark, sf_dir):
    packets = frames(spark, sf_dir).select((F.col("k") % 100).alias("path"), F.col("k").alias("packet_index"), tokens.shifted_text(F.col("data")).alias("sentence"))
    return sentences.file_lines(packets).select("path", F.md5("line").alias("line_md5"))


#: Port, protocol, least payload and places of the protocols whose places are fixed; ports without a parser have none.
_FIXED = [
    (67, "dhcp-server", 240, [1, 2, 3, 4, 8, 10, 12, 16, 20, 24, 28, 44, 108, 236, 240]), (123, "ntp", 48, [48]), (69, "tftp", 4, [2]), (445, "smb", 32, [4, 32]),
    (139, "netbios", 4, [4]), (1812, "radius", 20, [1, 2, 4, 20]), (3478, "stun", 20, [2, 4, 8, 20]), (111, "rpc", 12, [12]), (1720, "h225", 8, [8]),
    (5900, "rfb", 12, [12]), (22, "ssh", 1000, []), (53, "dns", 12, [2, 4, 6, 8, 10, 12]),
]
_APP = f"CASE {_C} % 12 " + " ".join(f"WHEN {i} THEN {p}" for i, (p, *_) in enumerate(_FIXED)) + " END"


def _udp(port, payload):
    return f"('001122334455' || {_hex(_K, 12)} || '0800' || '4500002812344000' || '4011' || '0000' || '0A000001' || '0A000002' || 'C350' || {_hex(port, 4)} || '00080000' || {payload})"


_FILLER = f"repeat('AB', CAST({_K} % 300 AS INT))"


def _udp_frames(spark, sf_dir, port, payload):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.unhex(F.expr(_udp(port, payload))).alias("data"))


def _layer5(d):
    return F.array_join(F.transform(F.array_sort(F.array_distinct(F.transform(F.filter(d["offsets"], lambda o: o["layer"] == 5), lambda o: o["offset"] - 42))), lambda x: x.cast("string")), ",")


def _names5(d):
    return F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(d["offsets"], lambda o: o["layer"] == 5), lambda o: o["field_name"]))), ",")


def _apps(config=dissect.SeparatorConfig()):
    def run(spark, sf_dir):
        d = _udp_frames(spark, sf_dir, _APP, _FILLER).select("k", dissect.dissect(F.col("data"), config).alias("d"))
        return d.select("k", "d.app", _layer5(F.col("d")).alias("places"))

    return run


def _apps_sql(changed=None, off=False):
    found = {p: (name, least, places) for p, name, least, places in _FIXED} | (changed or {})
    names = "CASE WHEN n > 0 THEN CASE p " + " ".join(f"WHEN {p} THEN '{name}'" for p, (name, _, _) in found.items()) + " END END"
    lists = "CASE p " + " ".join(f"WHEN {p} THEN CASE WHEN n >= {least} THEN {places}::INT[] ELSE [] END" for p, (_, least, places) in found.items()) + " END"
    if off:
        return "SELECT o_orderkey AS k, CAST(NULL AS VARCHAR) AS app, '' AS places FROM orders"
    return f"SELECT k, {names} AS app, array_to_string(list_filter({lists}, lambda x: x <= n), ',') AS places FROM (SELECT o_orderkey AS k, {_K} % 300 AS n, {_APP} AS p FROM orders)"


_CONTENT = [
    ("474554202F", "http"), ("504F5354AA", "http"), ("5055542041", "http"), ("48454144AA", "http"), ("44454C4541", "http"), ("4F50544941", "http"), ("5452414341", "http"),
    ("434F4E4E41", "http"), ("485454502F312E30", "http"), ("485454502F312E31", "http"), ("485454502F322E30", "http"), ("160300AAAA", "tls"), ("160303AAAA", "tls"), ("160304AAAA", None),
    ("FF" * 12, "dns"), ("FF" * 11, None), ("FFFFFF", None), ("47455420", "http"), ("160301", None), ("474554", None),
]
_CONTENT_HEX = f"(CASE {_C} % 20 " + " ".join(f"WHEN {i} THEN '{h}'" for i, (h, _) in enumerate(_CONTENT)) + " END)"


def content_protocols(spark, sf_dir):
    """Protocols told by what payloads of unknown ports hold."""
    d = _udp_frames(spark, sf_dir, 50001, _CONTENT_HEX).select(dissect.dissect(F.col("data"))["app"].alias("app"), F.hex(F.expr("substring(data, 43)")).alias("payload"))
    return d.groupBy("payload", "app").agg(F.count("*").alias("n"))


_LINES = f"repeat('582D303A20310D0A', CAST({_K} % 5 AS INT))"
_REQUEST = f"('474554202F20485454502F312E310D0A' || {_LINES} || '0D0A' || repeat('42', CAST({_K} % 9 AS INT)))"


def _texts(port, config=dissect.SeparatorConfig()):
    def run(spark, sf_dir):
        d = _udp_frames(spark, sf_dir, port, _REQUEST).select("k", dissect.dissect(F.col("data"), config).alias("d"))
        return d.select("k", "d.app", _layer5(F.col("d")).alias("places"), _names5(F.col("d")).alias("names"))

    return run


def telnet_ends(spark, sf_dir):
    d = _udp_frames(spark, sf_dir, 23, _FILLER).select("k", dissect.dissect(F.col("data")).alias("d"))
    return d.select("k", "d.app", _layer5(F.col("d")).alias("places"))


_RECORDS, _SIZE = f"(1 + {_K} % 3)", f"({_C} % 40)"
_TLS = f"repeat('160301' || {_hex(_SIZE, 4)} || repeat('AA', CAST({_SIZE} AS INT)), CAST({_RECORDS} AS INT))"


def tls_records(spark, sf_dir):
    d = _udp_frames(spark, sf_dir, 50001, _TLS).select("k", dissect.dissect(F.col("data")).alias("d"))
    return d.select("k", "d.app", _layer5(F.col("d")).alias("places"), _names5(F.col("d")).alias("names"))


_QUESTIONS, _ANSWERS = f"({_K} % 4)", f"(CASE WHEN {_K} % 4 > 0 THEN {_C} % 2 ELSE 0 END)"
_DNS = f"('12340100' || {_hex(_QUESTIONS, 4)} || {_hex(_ANSWERS, 4)} || '00000000' || repeat('03616263026465' || '00' || '00010001', CAST({_QUESTIONS} AS INT)) || repeat('C00C00010001000000000004' || '01020304', CAST({_ANSWERS} AS INT)))"


def _dns(config=dissect.SeparatorConfig()):
    def run(spark, sf_dir):
        d = _udp_frames(spark, sf_dir, 53, _DNS).select("k", dissect.dissect(F.col("data"), config).alias("d"))
        return d.select("k", "d.app", _layer5(F.col("d")).alias("places"), F.size(F.filter(F.col("d")["offsets"], lambda o: o["field_name"] == "dns_answers")).alias("answers"))

    return run


def field_positions(spark, sf_dir):
    """Frames cut by given fields (start, end) that overlap and leave gaps."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.unhex(F.expr(_udp(53, _FILLER))).alias("data"))
    given = F.expr("array(named_struct('start', 20, 'end', 30), named_struct('start', 0, 'end', 6), named_struct('start', 4, 'end', 12), named_struct('start', 5, 'end', 9), named_struct('start', 30, 'end', 42))")
    made = rows.select("k", dissect.separated_by_fields(F.col("data"), given).alias("ids"))
    return made.select("k", F.size("ids").alias("n"), _digest(F.col("ids")).alias("ids_md5"))


# --- single functions -------------------------------------------------------------------------------------------------


def token_names(spark, sf_dir):
    """Every id of the token variant as its token (its code point if it is one character), and back."""
    named = spark.range(261).select(F.col("id").cast("int").alias("id"), vocab.id_to_token(F.col("id").cast("int"), vocab.TOKEN).alias("token"))
    back = vocab.token_to_id(F.col("token"), vocab.TOKEN)
    return named.select("id", F.when(F.length("token") > 1, F.col("token")).alias("name"), F.when(F.length("token") == 1, F.ascii("token")).otherwise(F.lit(-1)).alias("code"), back.alias("back"))


def first_letters(spark, sf_dir):
    """Ids of the first one or two letters of parts' names: two are no token."""
    token = F.expr("substring(p_name, 1, 1 + p_partkey % 2)")
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", vocab.token_to_id(token, vocab.TOKEN).alias("id"), F.coalesce(vocab.token_to_id(token, vocab.TEXT), F.lit(-1)).alias("text_id"))


def _pairs(spark, sf_dir, v):
    turns = turn_packets(spark, sf_dir)
    a = turns.where("packet_index % 2 = 0").select("path", "packet_index", tokens.byte_tokens(F.col("data"), v).alias("a"))
    b = turns.where("packet_index % 2 = 1").select("path", (F.col("packet_index") - 1).alias("packet_index"), tokens.byte_tokens(F.col("data"), v).alias("b"))
    return a.join(b, ["path", "packet_index"])


def _inputs(v):
    def run(spark, sf_dir):
        made = _pairs(spark, sf_dir, v).select("path", "packet_index", tokens.build_inputs(F.col("a"), F.col("b"), v).alias("ids"), tokens.special_mask_of(F.col("a"), F.col("b"), v).alias("m"))
        types = tokens.token_types(F.size("ids"))
        return made.select(F.col("path").alias("conv_id"), F.col("packet_index").alias("turn"), _digest(F.col("ids")).alias("ids_md5"), _digest(F.col("m")).alias("mask_md5"), F.size(types).alias("types"))

    return run


def _inputs_sql(offset, made, mask):
    each = f"(SELECT conv_id, turn, {_LIST.format(plus=f' + {offset}')} AS x FROM {_TURNS} WHERE turn % 2 = {{}})"
    zeros = "list_transform({}, lambda i: 0)"
    mask = mask.replace("za", zeros.format("a.x")).replace("zb", zeros.format("c.x"))
    return f"SELECT a.conv_id, a.turn, md5(array_to_string({made}, ' ')) AS ids_md5, md5(array_to_string({mask}, ' ')) AS mask_md5, CAST(len({made}) AS INT) AS types FROM {each.format(0)} a JOIN {each.format(1)} c ON a.conv_id = c.conv_id AND a.turn = c.turn - 1"


def text_of_bytes(spark, sf_dir):
    """Texts from their ids with a byte put in that is no text; and as one character a byte without specials."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    ids = F.concat(F.array(F.lit(0)), tokens.text_tokens(F.col("text")), F.array(F.lit(255 + 3), F.lit(1)))
    return docs.select("doc_id", F.md5(tokens.text_of_ids(ids)).alias("text_md5"))


def raw_roundtrip(spark, sf_dir):
    docs = document_packets(spark, sf_dir).select("packet_index", "data", tokens.byte_tokens(F.col("data"), vocab.RAW).alias("ids"))
    return docs.select(F.col("packet_index").alias("doc_id"), F.md5(tokens.decode_tokens(F.col("ids"), vocab.RAW)).alias("data_md5"), F.hex(tokens.decode_tokens(tokens.as_list(F.element_at(F.concat("ids", F.array(F.lit(33))), 1)), vocab.RAW)).alias("first"))


def special_strings(spark, sf_dir):
    """Parts' keys as ids with specials around: joined with and without the specials."""
    ids = F.array(F.lit(3), F.expr("CAST(p_partkey % 26 AS INT) + 70"), F.lit(4), F.expr("CAST(p_size % 26 AS INT) + 102"), F.lit(2))
    names = F.transform(ids, lambda i: vocab.id_to_token(i, vocab.TOKEN))
    return table(spark, sf_dir, "part").select("p_partkey", tokens.decode_with_specials(ids, vocab.TOKEN).alias("whole"), tokens.tokens_to_string(names, vocab.TOKEN).alias("plain"))


def printable_bytes(spark, sf_dir):
    b = F.col("id").cast("int")
    return spark.range(256).select(b.alias("byte"), tokens.printable(b).alias("dot"), tokens.printable(b, "hex").alias("escaped"))


def shifted_texts(spark, sf_dir):
    docs = document_packets(spark, sf_dir)
    return docs.select(F.col("packet_index").alias("doc_id"), F.md5(tokens.shifted_text(F.col("data"))).alias("text_md5"))


def ranged_ids(spark, sf_dir):
    """Line numbers as ids, some of them out of a vocabulary's range."""
    ids = F.array(F.expr("CAST(l_partkey AS INT) - 50"), F.expr("CAST(l_linenumber AS INT)"), F.expr("CAST(l_suppkey AS INT) * 40"))
    kept = tokens.in_range(ids, 262)
    return table(spark, sf_dir, "lineitem").select(F.size(kept).alias("kept")).groupBy("kept").agg(F.count("*").alias("n"))


def id_windows(spark, sf_dir):
    """Windows of 128 ids that a hash places: whether they lie in their sequence, and how long they are."""
    docs = document_packets(spark, sf_dir).select(F.col("packet_index").alias("doc_id"), tokens.byte_tokens(F.col("data"), vocab.TOKEN).alias("ids"))
    w = tokens.window_of(F.col("ids"), 128, F.col("doc_id"))
    joined = [F.concat(F.lit(" "), F.array_join(F.transform(x, lambda i: i.cast("string")), " "), F.lit(" ")) for x in (F.col("ids"), w)]
    return docs.select("doc_id", F.size(w).alias("n"), F.contains(*joined).alias("inside"))


def first_packets(spark, sf_dir):
    """Of each conversation as one sequence, the first packet."""
    made = chunks.file_sequence(chunks.packet_sequences(turn_packets(spark, sf_dir), bos=True, eos=True, dense=False))
    return made.select(F.col("path").alias("conv_id"), _digest(tokens.first_packet(F.col("ids"), vocab.TOKEN)).alias("ids_md5"))


def token_display(spark, sf_dir):
    """The first ids of each text as a table for the eye: kinds and glyphs."""
    docs = document_packets(spark, sf_dir).select(F.col("packet_index").alias("doc_id"), F.concat(F.array(F.lit(3)), F.slice(tokens.byte_tokens(F.col("data"), vocab.TOKEN), 1, 12)).alias("ids"))
    shown = docs.select("doc_id", F.explode(tokens.display(F.col("ids"), vocab.TOKEN)).alias("d"))
    return shown.select("doc_id", F.col("d.index").cast("int").alias("place"), F.col("d.id").alias("id"), F.col("d.kind").alias("kind"), F.col("d.glyph").alias("glyph"))


def first_differences(spark, sf_dir):
    """Where each turn differs from itself in capitals."""
    turns = turn_packets(spark, sf_dir)
    upper = F.encode(F.upper(F.decode("data", "UTF-8")), "UTF-8")
    return turns.select(F.col("path").alias("conv_id"), F.col("packet_index").alias("turn"), stats.first_difference(F.col("data"), upper).alias("place"))


def captured_texts(spark, sf_dir):
    """Conversations as captures in text: the packets found between the marks, an unterminated tail left out."""
    opening, closing, between = (3 + 256 + k for k in (0, 1, 2))
    turns = turn_packets(spark, sf_dir).select("path", "packet_index", tokens.byte_tokens(F.col("data"), vocab.TEXT).alias("ids"))
    marked = turns.select("path", "packet_index", F.concat(F.array(F.when(F.col("packet_index") == 0, F.lit(opening)).otherwise(F.lit(between))), "ids").alias("ids"))
    ids = chunks.file_sequence(marked)
    whole = sequences.text_and_capture(F.array(F.lit(70), F.lit(71)), F.concat("ids", F.array(F.lit(closing), F.lit(opening), F.lit(80))))
    found = ids.select("path", tokens.packets_of(whole).alias("p"))
    return found.select(F.col("path").alias("conv_id"), F.size("p").alias("packets"), F.md5(F.array_join(F.transform("p", lambda x: F.hex(x)), ",")).alias("packets_md5"))


def head_of_orders(spark, sf_dir):
    return sequences.head(table(spark, sf_dir, "orders").select("o_orderkey"), 10, "o_orderkey")


def latest_order(spark, sf_dir):
    """The order with the greatest date as the file modified last."""
    return sequences.latest(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").cast("string").alias("modified")))


def order_batches(spark, sf_dir):
    """Batches of 32 orders by key: how many, first and last."""
    dealt = sequences.batches(table(spark, sf_dir, "orders").select("o_orderkey"), 32, "o_orderkey")
    return dealt.groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


def sampled_customers(spark, sf_dir):
    """Five files for a check, and a shuffle: how many distinct ones there are."""
    files = table(spark, sf_dir, "customer").select(F.col("c_name").alias("path"))
    five = sequences.sample_files(files).join(files, "path", "left_semi").agg(F.count_distinct("path").alias("sampled"))
    all_ = sequences.shuffled(files, "path", 3).agg(F.count_distinct("path").alias("shuffled"))
    return five.join(F.broadcast(all_))  # one row each


def concat_patches(spark, sf_dir):
    """Patches of a sequence of vectors joined from the last positions of each; users' events as vectors of two numbers."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").where("value is not null").select(F.col("user_id").alias("seq_id"), (F.row_number().over(w) - 1).cast("long").alias("pos"), F.array(F.col("value").cast("double"), F.col("event_id").cast("double")).alias("vec"))
    lengths = events.groupBy("seq_id", F.floor(F.col("pos") / 4).alias("patch_id")).agg(F.count("*").alias("length"))
    made = sequences.downsample(events, lengths, (), 3)
    return made.select("seq_id", "patch_id", F.size("joined").alias("n"), F.round(F.aggregate("joined", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


def step_losses(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("value is not null").select((F.col("value") / 100).alias("loss"))
    return lmmath.step_loss(rows, 4).select(F.round("loss", 6).alias("loss"))


def cross_entropies(spark, sf_dir):
    """Vectors as logits, the label modulo 8 as target."""
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null and label is not null")
    first = F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double"))
    return rows.select("vec_id", F.round(lmmath.cross_entropy(first, F.expr("CAST(label % 8 AS INT)")), 6).alias("loss"))


def steps_and_tokens(spark, sf_dir):
    effective = lmmath.effective_batch(4, 2, 8192, 3)
    return spark.range(1000).select(F.col("id").alias("step"), lmmath.tokens_seen(F.col("id"), effective).cast("long").alias("seen"))


def training_grid(spark, sf_dir):
    return sequences.training_grid(spark, ["bpe", "unigram"], [1000, 8000])


def hidden_sizes(spark, sf_dir):
    rows = [(d, m, lmmath.hidden_size(replace(lmmath.ModelArgs(), dim=d, ffn_multiplier=None, multiple_of=m))) for d in range(64, 1025, 64) for m in (32, 256)]
    return spark.createDataFrame(rows, "dim int, multiple int, hidden int")


def causal_pair_counts(spark, sf_dir):
    """Pairs that may attend to each other, from lengths alone: in all and within a window."""
    lengths = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("length"))
    whole = sequences.causal_pair_count(lengths).toDF("n")
    return whole.select(F.lit(0).alias("window"), F.col("n").cast("long").alias("n")).unionByName(sequences.causal_pair_count(lengths, 3).toDF("n").select(F.lit(3).alias("window"), F.col("n").cast("long").alias("n")))


def summaries(spark, sf_dir):
    """Fields of training records in JSON, some of them missing."""
    info = F.expr("""CASE p_partkey % 3 WHEN 0 THEN concat('{"training_stats": {"vocab_size": ', p_size, ', "model_type": "bpe"}}') WHEN 1 THEN '{"evaluation_stats": {"compression_ratio": 1.5}}' ELSE '{}' END""")
    return table(spark, sf_dir, "part").select("p_partkey", *stats.summary_fields(info))


def chunk_lookups(spark, sf_dir):
    """Chunk 3 of the manifest, and the average number of chunks of the first files."""
    made = chunks.number(chunks.cut(chunks.packet_sequences(turn_packets(spark, sf_dir), dense=False), 64))
    one = chunks.chunk_at(made, 3).select("source_file", "num_tokens")
    return one.join(F.broadcast(chunks.estimate(made)))  # one row


def source_statuses(spark, sf_dir):
    """Tokens and status of each conversation, of which some are files without packets."""
    turns = turn_packets(spark, sf_dir)
    made = chunks.number(chunks.cut(chunks.packet_sequences(turns.where("path % 7 <> 3"), dense=False), 64))
    sizes = turns.groupBy("path").agg(F.sum(F.octet_length("data")).alias("length"))
    return chunks.source_files(made, sizes).select(F.col("file_path").alias("conv_id"), "file_size_bytes", F.col("num_tokens").cast("long").alias("num_tokens"), "num_chunks", "status")


def _lines(spark, sf_dir):
    """(path, packet_index, data): documents as files, their lines as packets."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("packet_index", "line")).select("path", "packet_index", F.encode("line", "UTF-8").alias("data"))


def smart_duplicate_documents(spark, sf_dir):
    found = dedup.duplicates(_lines(spark, sf_dir), "smart")
    return found.select("content_hash", "n", F.array_join(F.transform("files", lambda x: x.cast("string")), ",").alias("files"))


def largest_duplicate_groups(spark, sf_dir):
    found = dedup.largest_groups(dedup.groups(dedup.content_hashes_streamed(_lines(spark, sf_dir))))
    return found.select("content_hash", "n", F.array_join(F.transform("files", lambda x: x.cast("string")), ",").alias("files"))


def known_documents(spark, sf_dir):
    """Odd documents whose content an even one has: one step of incremental detection; and the first of each content."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("content_hash"))
    again = dedup.known_again(docs.where("path % 2 = 1"), docs.where("path % 2 = 0")).select("path", F.lit("again").alias("kind"))
    return again.unionByName(dedup.first_of_each(docs).select("path", F.lit("first").alias("kind")))


_B = _LIST.format(plus="")
_BYTES_OF = f"(SELECT doc_id, b, {_B} AS v FROM {_DOCS})"
_LINE_SQL = "(SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"
_ALL_GROUPS = f"SELECT content_hash, count(*) AS n, list(doc_id ORDER BY doc_id) AS files FROM (SELECT doc_id, sha256(string_agg(line, '' ORDER BY i)) AS content_hash FROM {_LINE_SQL} GROUP BY doc_id) GROUP BY content_hash HAVING count(*) > 1"
_CHUNKED = f"(SELECT conv_id, sum(b) + count(*) - 1 AS t, sum(b) AS len FROM {_TURNS} GROUP BY conv_id)"

_QUERIES = {
    "frame_layers": (_layers(dissect.SeparatorConfig()), _layers_sql(_DETAILED)),
    "frame_layer_ends": (_layers(_ONLY_ENDS), _layers_sql(_ENDS)),
    "frame_layers_native": (frame_layers_native, f"SELECT l3, l4, array_to_string({_DETAILED}, ',') AS places, count(*) AS n FROM {_PARSED} WHERE {_ERROR} IS NULL GROUP BY 1, 2, 3"),
    "frame_depths": (frame_depths, "SELECT depth, layer, CAST(sum(n) AS BIGINT) AS n FROM (" + " UNION ALL ".join(f"SELECT {d} AS depth, {layer} AS layer, {_by_layer(layer)} AS n FROM {_PARSED}" for d in (2, 3, 4) for layer in range(2, d + 1)) + ") WHERE n > 0 GROUP BY 1, 2"),
    "frame_policies": (frame_policies, "SELECT policy, error_type, count(*) AS n, CAST(sum(c) AS BIGINT) AS boundaries FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS policy, {_ERROR} AS error_type, {'0' if p == 'conservative' else f'{_by_layer(2)} + {_by_layer(3)}'} AS c FROM {_PARSED}" for p in ("conservative", "aggressive", "hybrid")) + ") WHERE error_type IS NOT NULL GROUP BY 1, 2"),
    "malformed_frames": (malformed_frames, f"SELECT 'orders' AS file, k AS packet_index, CAST(n AS INT) AS packet_length, {_ERROR} AS error_type, lower(substr(h, 1, 40)) AS first_bytes_hex, lower(h) AS packet_hex FROM {_PARSED} WHERE {_ERROR} IS NOT NULL"),
    "malformed_totals": (malformed_totals, f"SELECT {_ERROR} AS error_type, count(*) AS n FROM {_PARSED} WHERE {_ERROR} IS NOT NULL GROUP BY 1"),
    "frame_tokens": (frame_tokens, f"SELECT k, CAST(n + len(c) AS INT) AS n, md5(array_to_string(flatten(list_transform(range(0, n), lambda i: CASE WHEN list_contains(c, CAST(i AS INT)) THEN [5, v[i + 1] + 6] ELSE [v[i + 1] + 6] END)), ' ')) AS ids_md5, CAST(len(c) + 1 AS INT) AS fields, array_to_string(list_transform(range(0, len(c) + 1), lambda i: coalesce(c[i + 1], n) - coalesce(CASE WHEN i > 0 THEN c[i] END, 0)), ',') AS sizes FROM {_CUT}"),
    "frame_sentence_tokens": (_frame_sentence("tokens"), _frame_sentence_sql(f"CASE WHEN {_SHOWN} THEN concat('▁', chr(v[i + 1])) ELSE concat('▁', printf('%02x', v[i + 1])) END")),
    "frame_sentence_mixed": (_frame_sentence("mixed"), _frame_sentence_sql(f"CASE WHEN {_SHOWN} THEN concat('▁', chr(v[i + 1])) ELSE concat('▁0x', printf('%02x', v[i + 1])) END")),
    "frame_sentence_hex": (_frame_sentence("hex"), _frame_sentence_sql("printf('%02x', v[i + 1])")),
    "frame_sentence_decimal": (_frame_sentence("decimal"), _frame_sentence_sql("CAST(v[i + 1] AS VARCHAR)")),
    "frame_corpus_totals": (frame_corpus_totals, f"SELECT count(DISTINCT k % 100) AS files, count(*) AS packets, CAST(sum(n) AS BIGINT) AS bytes, CAST(sum(len(c)) AS BIGINT) AS separators, round(avg(n), 6) AS avg_bytes, round(avg(len(c)), 6) AS avg_separators FROM {_CUT}"),
    "frame_file_lines": (frame_file_lines, f"SELECT path, CAST(length(line) AS INT) AS n, md5(line) AS line_md5 FROM (SELECT k % 100 AS path, string_agg(array_to_string(list_transform(v, lambda b: printf('%02x', b)), ' '), ' ' ORDER BY k) AS line FROM {_CUT} GROUP BY 1)"),
    "shifted_file_lines": (shifted_file_lines, f"SELECT k % 100 AS path, md5(string_agg(array_to_string(list_transform(v, lambda b: chr(b + 1)), ''), ' ' ORDER BY k)) AS line_md5 FROM {_CUT} GROUP BY 1"),
    "app_fields": (_apps(), _apps_sql()),
    "app_fields_detailed": (_apps(dissect.SeparatorConfig(detailed_app_parsing=True)), _apps_sql({123: ("ntp", 48, [1, 2, 3, 4, 8, 12, 16, 24, 32, 40])})),
    "app_fields_plain": (_apps(dissect.CLI_PROFILE), _apps_sql({67: ("dhcp-server", 240, [240]), 53: ("dns", 12, [12])})),
    "app_fields_off": (_apps(dissect.SeparatorConfig(insert_application_fields=False)), _apps_sql(off=True)),
    "content_protocols": (content_protocols, "SELECT payload, app, count(*) AS n FROM (SELECT CASE v " + " ".join(f"WHEN {i} THEN '{h}'" for i, (h, _) in enumerate(_CONTENT)) + " END AS payload, CASE v " + " ".join(f"WHEN {i} THEN {repr(a) if a else 'NULL'}" for i, (_, a) in enumerate(_CONTENT)) + f" END AS app FROM (SELECT {_C} % 20 AS v FROM orders)) GROUP BY 1, 2"),
    "http_heads": (_texts(80), f"SELECT o_orderkey AS k, 'http' AS app, CAST(18 + 8 * ({_K} % 5) AS VARCHAR) AS places, 'http_body' AS names FROM orders"),
    "http_header_lines": (_texts(80, dissect.SeparatorConfig(detailed_app_parsing=True)), f"SELECT k, 'http' AS app, array_to_string(list_concat(list_transform(range(0, j + 1), lambda i: CASE WHEN j = 0 THEN 15 ELSE 16 + 8 * i END), [18 + 8 * j]), ',') AS places, CASE WHEN j > 0 THEN 'http_body,http_header,http_request_line' ELSE 'http_body,http_request_line' END AS names FROM (SELECT o_orderkey AS k, {_K} % 5 AS j FROM orders)"),
    "sip_heads": (_texts(5060), f"SELECT o_orderkey AS k, 'sip' AS app, CAST(18 + 8 * ({_K} % 5) AS VARCHAR) AS places, 'sip_body' AS names FROM orders"),
    "telnet_ends": (telnet_ends, f"SELECT o_orderkey AS k, CASE WHEN {_K} % 300 > 0 THEN 'telnet' END AS app, CASE WHEN {_K} % 300 > 0 THEN CAST({_K} % 300 AS VARCHAR) ELSE '' END AS places FROM orders"),
    "tls_records": (tls_records, f"SELECT k, 'tls' AS app, array_to_string(list_sort(list_distinct(list_concat(list_transform(range(0, r), lambda i: i * (5 + s) + 5), list_transform(range(1, r), lambda i: i * (5 + s))))), ',') AS places, CASE WHEN r > 1 THEN 'tls_record,tls_record_data' ELSE 'tls_record_data' END AS names FROM (SELECT o_orderkey AS k, {_RECORDS} AS r, {_SIZE} AS s FROM orders)"),
    "dns_sections": (_dns(), f"SELECT k, 'dns' AS app, array_to_string(list_concat([2, 4, 6, 8, 10, 12], list_transform(range(1, q + 1), lambda i: 12 + 10 * i)), ',') AS places, CAST(a AS INT) AS answers FROM (SELECT o_orderkey AS k, {_QUESTIONS} AS q, {_ANSWERS} AS a FROM orders)"),
    "dns_plain": (_dns(dissect.CLI_PROFILE), "SELECT o_orderkey AS k, 'dns' AS app, '12' AS places, 0 AS answers FROM orders"),
    "field_positions": (field_positions, f"SELECT k, CAST(len(x) AS INT) AS n, md5(array_to_string(x, ' ')) AS ids_md5 FROM (SELECT k, CASE WHEN len(v) > 42 THEN y ELSE y[1:len(y) - 1] END AS x FROM (SELECT k, v, list_concat(v[1:6], list_concat([3], list_concat(v[7:12], list_concat([3], list_concat(v[13:30], list_concat([3], list_concat(v[31:42], list_concat([3], v[43:])))))))) AS y FROM (SELECT o_orderkey AS k, {_LIST.format(plus=' + 5')} AS v FROM (SELECT *, {_udp(53, _FILLER)} AS h FROM orders))))"),
    "token_names": (token_names, "SELECT CAST(range AS INT) AS id, CASE range WHEN 0 THEN '<pad>' WHEN 1 THEN '<unk>' WHEN 2 THEN '<eos>' WHEN 3 THEN '<bos>' WHEN 4 THEN '<pkt>' END AS name, CASE WHEN range > 4 THEN CAST(range - 5 AS INT) ELSE -1 END AS code, CAST(range AS INT) AS back FROM range(261)"),
    "first_letters": (first_letters, "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN ascii(p_name) + 5 ELSE 1 END AS id, CASE WHEN p_partkey % 2 = 0 THEN ascii(p_name) + 3 ELSE -1 END AS text_id FROM part"),
    "raw_inputs": (_inputs(vocab.RAW), _inputs_sql(0, "list_concat(a.x, c.x)", "list_concat(za, zb)")),
    "text_inputs": (_inputs(vocab.TEXT), _inputs_sql(3, "list_concat(a.x, list_concat([1], list_concat(c.x, [1])))", "list_concat(za, list_concat([1], list_concat(zb, [1])))")),
    "dissected_inputs": (_inputs(vocab.DISSECTED), _inputs_sql(5, "list_concat(a.x, list_concat(c.x, [1]))", "list_concat(za, list_concat(zb, [1]))")),
    "text_of_bytes": (text_of_bytes, "SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL"),
    "raw_roundtrip": (raw_roundtrip, f"SELECT doc_id, md5(text) AS data_md5, CASE WHEN text = '' THEN '21' ELSE substr(hex(encode(text)), 1, 2) END AS first FROM documents WHERE text IS NOT NULL"),
    "special_strings": (special_strings, "SELECT p_partkey, concat('<bos>', chr(CAST(p_partkey % 26 AS INT) + 65), '<pkt>', chr(CAST(p_size % 26 AS INT) + 97), '<eos>') AS whole, concat(chr(CAST(p_partkey % 26 AS INT) + 65), chr(CAST(p_size % 26 AS INT) + 97)) AS plain FROM part"),
    "printable_bytes": (printable_bytes, "SELECT CAST(range AS INT) AS byte, CASE WHEN range BETWEEN 32 AND 126 THEN chr(CAST(range AS INT)) ELSE '.' END AS dot, CASE WHEN range BETWEEN 32 AND 126 THEN chr(CAST(range AS INT)) ELSE concat('\\x', printf('%02x', range)) END AS escaped FROM range(256)"),
    "shifted_texts": (shifted_texts, f"SELECT doc_id, md5(array_to_string(list_transform(v, lambda x: chr(x + 1)), '')) AS text_md5 FROM {_BYTES_OF}"),
    "ranged_ids": (ranged_ids, "SELECT CAST(CAST(l_partkey - 50 BETWEEN 0 AND 261 AS INT) + CAST(l_linenumber BETWEEN 0 AND 261 AS INT) + CAST(l_suppkey * 40 BETWEEN 0 AND 261 AS INT) AS INT) AS kept, count(*) AS n FROM lineitem GROUP BY 1"),
    "id_windows": (id_windows, f"SELECT doc_id, CAST(least(b, 128) AS INT) AS n, true AS inside FROM {_DOCS}"),
    "first_packets": (first_packets, f"SELECT conv_id, md5(array_to_string({_LIST.format(plus=' + 5')}, ' ')) AS ids_md5 FROM {_TURNS} QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1"),
    "token_display": (token_display, f"SELECT doc_id, CAST(i AS INT) AS place, CASE WHEN i = 0 THEN 3 ELSE v[i] + 5 END AS id, CASE WHEN i = 0 THEN 'SPECIAL' ELSE 'BYTE' END AS kind, CASE WHEN i > 0 THEN CASE WHEN v[i] BETWEEN 32 AND 126 THEN chr(v[i]) ELSE '.' END END AS glyph FROM (SELECT doc_id, v, unnest(range(0, least(b, 12) + 1)) AS i FROM {_BYTES_OF})"),
    "first_differences": (first_differences, f"SELECT conv_id, turn, CAST(list_position(list_transform(range(0, greatest(len(x), len(y))), lambda i: coalesce(x[i + 1], -1) <> coalesce(y[i + 1], -1)), true) - 1 AS INT) AS place FROM (SELECT conv_id, turn, {_B} AS x, {_B.replace('(h,', '(u,')} AS y FROM (SELECT conv_id, turn, hex(encode(text)) AS h, hex(encode(upper(text))) AS u FROM conversations WHERE text IS NOT NULL))"),
    "captured_texts": (captured_texts, f"SELECT conv_id, CAST(count(*) FILTER (WHERE b > 0) AS INT) AS packets, md5(coalesce(string_agg(h, ',' ORDER BY turn) FILTER (WHERE b > 0), '')) AS packets_md5 FROM {_TURNS} GROUP BY conv_id"),
    "head_of_orders": (head_of_orders, "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10"),
    "latest_order": (latest_order, "SELECT o_orderkey AS path FROM orders ORDER BY CAST(o_orderdate AS VARCHAR) DESC, o_orderkey DESC LIMIT 1"),
    "order_batches": (order_batches, "SELECT batch, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 32 AS batch FROM orders) GROUP BY batch"),
    "sampled_customers": (sampled_customers, "SELECT CAST(5 AS BIGINT) AS sampled, count(DISTINCT c_name) AS shuffled FROM customer"),
    "concat_patches": (concat_patches, "WITH e AS (SELECT user_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value + event_id AS x FROM events WHERE value IS NOT NULL), l AS (SELECT seq_id, pos // 4 AS patch_id, max(pos) + 1 AS stop FROM e GROUP BY 1, 2) SELECT l.seq_id, l.patch_id, 6 AS n, round(sum(e.x), 4) AS total FROM l, (SELECT unnest([1, 2, 3]) AS back) k JOIN e ON e.seq_id = l.seq_id AND e.pos = greatest(l.stop - k.back, 0) GROUP BY 1, 2"),
    "step_losses": (step_losses, "SELECT round(sum(value / 100) / 200, 6) AS loss FROM events WHERE value IS NOT NULL"),
    "cross_entropies": (cross_entropies, "SELECT vec_id, round(ln(list_sum(list_transform(e, lambda x: exp(x)))) - e[t + 1], 6) AS loss FROM (SELECT vec_id, embedding[1:8]::DOUBLE[] AS e, CAST(label % 8 AS INT) AS t FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL)"),
    "steps_and_tokens": (steps_and_tokens, "SELECT range AS step, (range + 1) * 4 * 2 * 8192 * 3 AS seen FROM range(1000)"),
    "training_grid": (training_grid, "SELECT k AS model_type, s AS vocab_size FROM (SELECT unnest(['bpe', 'unigram']) AS k), (SELECT unnest([1000, 8000]) AS s)"),
    "hidden_sizes": (hidden_sizes, "SELECT CAST(d AS INT) AS dim, m AS multiple, CAST(m * (((8 * d) // 3 + m - 1) // m) AS INT) AS hidden FROM (SELECT unnest(range(64, 1025, 64)) AS d), (SELECT unnest([32, 256]) AS m)"),
    "causal_pair_counts": (causal_pair_counts, "SELECT w AS \"window\", CAST(sum(CASE WHEN w = 0 THEN n * (n + 1) // 2 ELSE (SELECT sum(least(i, w)) FROM range(1, n + 1) t(i)) END) AS BIGINT) AS n FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), (SELECT unnest([0, 3]) AS w) GROUP BY w"),
    "summaries": (summaries, "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) ELSE 'unknown' END AS vocab_size, CASE WHEN p_partkey % 3 = 0 THEN 'bpe' ELSE 'unknown' END AS model_type, CASE WHEN p_partkey % 3 = 1 THEN '1.5' ELSE 'unknown' END AS compression_ratio FROM part"),
    "chunk_lookups": (chunk_lookups, f"WITH c AS (SELECT conv_id, t, unnest(range(0, CAST((t + 63) // 64 AS BIGINT))) AS k FROM {_CHUNKED} WHERE t > 0), r AS (SELECT *, row_number() OVER (ORDER BY conv_id, k) - 1 AS idx FROM c), f AS (SELECT conv_id, count(*) AS m FROM c GROUP BY conv_id) SELECT conv_id AS source_file, CAST(least(64, t - k * 64) AS INT) AS num_tokens, CASE WHEN (SELECT count(*) FROM f) > 100 THEN (SELECT avg(m) FROM (SELECT m FROM f ORDER BY conv_id LIMIT 100)) ELSE 1.0 END AS chunks_per_file FROM r WHERE idx = 3"),
    "source_statuses": (source_statuses, f"SELECT conv_id, CAST(len AS BIGINT) AS file_size_bytes, CAST(CASE WHEN ok THEN t ELSE 0 END AS BIGINT) AS num_tokens, CAST(CASE WHEN ok THEN (t + 63) // 64 ELSE 0 END AS BIGINT) AS num_chunks, CASE WHEN ok THEN 'success' ELSE 'No tokens generated' END AS status FROM (SELECT *, conv_id % 7 <> 3 AND t > 0 AS ok FROM {_CHUNKED})"),
    "smart_duplicate_documents": (smart_duplicate_documents, f"WITH s AS (SELECT doc_id, concat(count(*), ':', string_agg(octet_length(encode(line))::VARCHAR, ':' ORDER BY octet_length(encode(line)))) AS g FROM {_LINE_SQL} GROUP BY doc_id), c AS (SELECT doc_id FROM s WHERE g IN (SELECT g FROM s GROUP BY g HAVING count(*) > 1)) SELECT content_hash, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS files FROM (SELECT doc_id, sha256(string_agg(line, '' ORDER BY i)) AS content_hash FROM {_LINE_SQL} WHERE doc_id IN (SELECT doc_id FROM c) GROUP BY doc_id) GROUP BY content_hash HAVING count(*) > 1"),
    "largest_duplicate_groups": (largest_duplicate_groups, f"SELECT content_hash, n, array_to_string(files[1:3], ',') AS files FROM ({_ALL_GROUPS}) ORDER BY n DESC, content_hash LIMIT 10"),
    "known_documents": (known_documents, "SELECT doc_id AS path, 'again' AS kind FROM documents WHERE doc_id % 2 = 1 AND text IN (SELECT text FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL) UNION ALL SELECT min(doc_id), 'first' FROM documents WHERE text IS NOT NULL GROUP BY text"),
}


def queries():
    return {name: q for name, (q, _) in _QUERIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _QUERIES.items()}
