"""All queries over the driver tables, with their DuckDB forms.

The tables hold no captures: texts and turns stand for packets, sources and conversations for files, and frames are
built from keys. Every query reads its whole tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wirelake.functions import dissect, sentences, tokens, vocab
from wirelake.operators import chunks, dedup, lmmath, sequences, stats, subwords
from wirelake.tables import table

#: Tokens of a training chunk and of a padded row.
CHUNK, PADDED = 2048, 512


def document_packets(spark, sf_dir):
    """(path, packet_index, data): sources as files, texts as packets, doc_id as their order."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select(F.col("source").alias("path"), F.col("doc_id").alias("packet_index"), F.encode("text", "UTF-8").alias("data"))


def turn_packets(spark, sf_dir):
    """(path, packet_index, data): conversations as files, turns as packets."""
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    return turns.select(F.col("conv_id").alias("path"), F.col("turn").alias("packet_index"), F.encode("text", "UTF-8").alias("data"))


def _digest(ids):
    return F.md5(F.array_join(F.transform(ids, lambda x: x.cast("string")), " "))


def packet_stats_by_source(spark, sf_dir):
    found = stats.packet_stats(document_packets(spark, sf_dir))
    return found.select(F.col("path").alias("source"), "packets", "total_bytes", "avg_bytes", "min_bytes", "max_bytes", (F.col("total_bytes") + F.col("packets") - 1).alias("tokens"))


def byte_histogram(spark, sf_dir):
    return stats.byte_histogram(document_packets(spark, sf_dir)).select("byte", "n")


def top_bytes(spark, sf_dir):
    return stats.top_bytes(stats.byte_histogram(document_packets(spark, sf_dir)), 10).select("byte", "n")


def rare_bytes(spark, sf_dir):
    return stats.top_bytes(stats.byte_histogram(document_packets(spark, sf_dir)), 10, least=True).select("byte", "n")


def missing_bytes(spark, sf_dir):
    return stats.missing_bytes(stats.byte_histogram(document_packets(spark, sf_dir)))


def byte_coverage(spark, sf_dir):
    return stats.coverage(stats.byte_histogram(document_packets(spark, sf_dir)))


def _token_ids(v):
    def run(spark, sf_dir):
        docs = table(spark, sf_dir, "documents")
        ids = tokens.byte_tokens(F.encode("text", "UTF-8"), v)
        return docs.select("doc_id", ids.alias("ids")).select("doc_id", F.size("ids").alias("n"), _digest(F.col("ids")).alias("ids_md5"))

    return run


def roundtrip_check(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    coded = docs.withColumn("ids", tokens.byte_tokens(F.col("data"), vocab.FIELD))
    return coded.select("doc_id", (tokens.decode_tokens(F.col("ids"), vocab.FIELD) == F.col("data")).alias("same"))


def build_inputs(spark, sf_dir):
    turns = turn_packets(spark, sf_dir)
    a = turns.where("packet_index % 2 = 0").select("path", "packet_index", tokens.byte_tokens(F.col("data"), vocab.TOKEN).alias("a"))
    b = turns.where("packet_index % 2 = 1").select("path", (F.col("packet_index") - 1).alias("packet_index"), tokens.byte_tokens(F.col("data"), vocab.TOKEN).alias("b"))
    pairs = a.join(b, ["path", "packet_index"])
    ids = tokens.build_inputs(F.col("a"), F.col("b"), vocab.TOKEN)
    made = pairs.select(F.col("path").alias("conv_id"), F.col("packet_index").alias("turn"), ids.alias("ids"))
    mask = tokens.special_mask(F.col("ids"), vocab.TOKEN)
    return made.select("conv_id", "turn", F.size("ids").alias("n"), _digest(F.col("ids")).alias("ids_md5"), F.aggregate(mask, F.lit(0), lambda s, x: s + x).alias("specials"))


def pad_truncate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ids = tokens.pad_or_cut(tokens.byte_tokens(F.encode("text", "UTF-8"), vocab.TOKEN), PADDED)
    made = docs.select("doc_id", ids.alias("ids"))
    return made.select("doc_id", F.size("ids").alias("n"), _digest(tokens.model_input(F.col("ids"))).alias("input_md5"), _digest(tokens.model_target(F.col("ids"))).alias("target_md5"))


def _sentence(form):
    def run(spark, sf_dir):
        docs = table(spark, sf_dir, "documents")
        line = sentences.packet_sentence(F.encode("text", "UTF-8"), form, separators=False)
        return docs.select("doc_id", F.md5(line).alias("sentence_md5"))

    return run


def corpus_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(sentences.packet_sentence(F.encode("text", "UTF-8"), "decimal", separators=False).alias("value"), (F.col("doc_id") + 1).alias("line_no"))
    return stats.corpus_stats(docs).select("total_lines", "total_tokens", "avg_tokens_per_line", "max_tokens_per_line", "min_tokens_per_line", "unique_tokens_sample")


def text_line_stats(spark, sf_dir):
    """Lines and words of all texts; every text is a line of a corpus."""
    docs = table(spark, sf_dir, "documents").select(F.regexp_replace("text", "[\\r\\n]", " ").alias("value"), (F.col("doc_id") + 1).alias("line_no"))
    return stats.corpus_stats(docs).select("total_lines", "total_tokens", "max_tokens_per_line", "min_tokens_per_line")


def piece_frequency(spark, sf_dir):
    """The most frequent decimal words of all texts."""
    words = F.split(sentences.decimal_sentence(F.encode("text", "UTF-8")), " ")
    return stats.piece_counts(table(spark, sf_dir, "documents").select(words.alias("pieces")), 20)


def chunk_manifest(spark, sf_dir):
    made = chunks.cut(chunks.packet_sequences(document_packets(spark, sf_dir), dense=False), CHUNK)
    numbered = chunks.number(made)
    return numbered.select("chunk_idx", "filename", "source_file", "num_tokens")


def chunk_totals(spark, sf_dir):
    made = chunks.number(chunks.cut(chunks.packet_sequences(document_packets(spark, sf_dir), dense=False), CHUNK))
    sizes = document_packets(spark, sf_dir).groupBy("path").agg(F.sum(F.octet_length("data")).alias("length"))
    return chunks.manifest(chunks.source_files(made, sizes))


def conversation_chunks(spark, sf_dir):
    """Digest of each chunk of 64 tokens of every conversation."""
    made = chunks.cut(chunks.packet_sequences(turn_packets(spark, sf_dir), dense=False), 64)
    return made.select(F.col("path").alias("conv_id"), "local_idx", "num_tokens", _digest(F.col("tokens")).alias("tokens_md5"))


def content_hashes(spark, sf_dir):
    found = dedup.content_hashes_streamed(turn_packets(spark, sf_dir))
    return found.select(F.col("path").alias("conv_id"), "content_hash")


def content_hash_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    found = dedup.groups(docs.select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("content_hash")))
    return found.select("content_hash", "n", F.array_join(F.transform("files", lambda x: x.cast("string")), ",").alias("files"))


def duplicate_deletions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return dedup.to_delete(dedup.groups(docs.select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("content_hash"))))


def duplicate_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return dedup.summary(dedup.groups(docs.select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("content_hash"))))


def size_signatures(spark, sf_dir):
    found = dedup.size_signatures(turn_packets(spark, sf_dir))
    return found.select(F.col("path").alias("conv_id"), "signature")


def smart_duplicates(spark, sf_dir):
    """Duplicate conversations by signature, then content."""
    found = dedup.duplicates(turn_packets(spark, sf_dir), "smart")
    return found.select("content_hash", "n", F.array_join(F.transform("files", lambda x: x.cast("string")), ",").alias("files"))


def patch_pool(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.lit(0).alias("seq_id"), F.col("label").alias("patch_id"), F.col("embedding").alias("vec"))
    pooled = sequences.pool(rows, ("avg", "min", "max"))
    flat = pooled.select("patch_id", F.posexplode("pooled").alias("k", "x"))
    return flat.select(F.col("patch_id").alias("label"), F.col("k").cast("long").alias("k"), F.round("x", 6).alias("x"))


def document_positions(spark, sf_dir):
    """Each turn as a position of one sequence: running start and place in its conversation."""
    lengths = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("length"))
    per = lengths.select(F.floor(F.col("conv_id") / 64).alias("seq_id"), F.col("conv_id").alias("doc_id"), "length")
    return sequences.document_positions(per).select("seq_id", "doc_id", "pos", "local")


def causal_pairs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"))
    return sequences.causal_pairs(turns).groupBy("doc_id").agg(F.count("*").alias("pairs"))


def local_window_pairs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"))
    return sequences.causal_pairs(turns, window=2).groupBy("doc_id").agg(F.count("*").alias("pairs"))


def eos_segments(spark, sf_dir):
    """Lengths of each user's runs of events that end with a purchase or with the last event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").select("user_id", (F.row_number().over(w) - 1).alias("pos"), (F.col("event_type") == "purchase").cast("int").alias("token"))
    return sequences.segment_lengths(events, 1, row="user_id").select("user_id", F.col("pos").cast("long").alias("pos"), F.col("length").cast("long").alias("length"))


def lr_schedule(spark, sf_dir):
    rate = lmmath.learning_rate(F.col("id"), 100, 5000)
    return spark.range(5001).select(F.col("id").alias("step"), F.round(rate, 9).alias("rate"))


def model_flops(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("layers"))
    n = lmmath.flops(F.lit(1_000_000), F.col("layers"), F.lit(8192), F.lit(768))
    return parts.select("p_partkey", n.alias("flops"))


def weighted_loss(spark, sf_dir):
    events = table(spark, sf_dir, "events").select((F.col("value") / 100).alias("loss"), (F.col("user_id") % 7 + 1).alias("n"))
    found = lmmath.weighted_loss(events.where("loss is not null"))
    return found.select(*[F.round(c, 8).alias(c) for c in ("loss", "bpb", "perplexity")])


def bigram_entropy(spark, sf_dir):
    found = lmmath.bigram_entropy(document_packets(spark, sf_dir))
    return found.select("pairs", F.round("entropy", 8).alias("entropy"))


def port_protocols(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 65536).cast("int").alias("src"), (F.col("l_suppkey") % 65536).cast("int").alias("dst"))
    named = rows.select(dissect.port_protocol(F.col("src"), F.col("dst")).alias("protocol"))
    return named.groupBy("protocol").agg(F.count("*").alias("n"))


def _frames(spark, sf_dir):
    """54-byte TCP frames whose ports, addresses and sequence numbers come from line items."""
    def number(c, width):
        return F.lpad(F.hex(F.col(c).cast("long")), width, "0")

    rows = table(spark, sf_dir, "lineitem")
    link = F.concat(F.lit("001122334455"), F.lpad(F.hex(F.col("l_orderkey").cast("long")), 12, "0"), F.lit("0800"))
    ip = F.concat(F.lit("45000028123440004006"), F.lit("0000"), number("l_suppkey", 8), number("l_partkey", 8))
    ports = [F.lpad(F.hex((F.col(c) % 65536).cast("long")), 4, "0") for c in ("l_partkey", "l_suppkey")]
    tcp = F.concat(*ports, number("l_orderkey", 8), F.lit("00000000"), F.lit("5002200000000000"))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.unhex(F.concat(link, ip, tcp)).alias("data"))


def frame_headers(spark, sf_dir):
    """Headers of frames by built-in expressions, counted by what they hold."""
    found = _frames(spark, sf_dir).select(dissect.headers_native(F.col("data")).alias("h"))
    flat = found.select("h.l3", "h.l4", F.array_join(F.transform("h.places", lambda x: x.cast("string")), ",").alias("places"))
    return flat.groupBy("l3", "l4", "places").agg(F.count("*").alias("n"))


def frame_boundaries(spark, sf_dir):
    """The same by the dissector: names of the boundaries, and ports."""
    found = _frames(spark, sf_dir).select(dissect.dissect(F.col("data")).alias("d"))
    flat = found.select("d.l3", "d.l4", "d.src_port", F.array_join(F.transform("d.offsets", lambda o: o["offset"].cast("string")), ",").alias("places"))
    return flat.groupBy("l3", "l4", "places").agg(F.count("*").alias("n"), F.sum("src_port").alias("ports"))


def frame_separators(spark, sf_dir):
    """Places of the separators in the frames' tokens."""
    found = _frames(spark, sf_dir).select(dissect.separated_tokens(F.col("data")).alias("ids"))
    flat = found.select(F.size("ids").alias("n_tokens"), F.array_join(F.transform(sequences.separator_positions(F.col("ids"), 5), lambda x: x.cast("string")), ",").alias("places"))
    return flat.groupBy("n_tokens", "places").agg(F.count("*").alias("n"))


def frame_addresses(spark, sf_dir):
    rows = _frames(spark, sf_dir).select(*dissect.addresses(F.col("data")))
    return rows.groupBy("ip_src").agg(F.count("*").alias("n"), F.min("eth_type").alias("eth_type"), F.min("ip_protocol").alias("ip_protocol"), F.min("eth_src").alias("first_eth_src"))


def http_bodies(spark, sf_dir):
    """Pages as payloads of port 80: where the boundaries of their head and body are."""
    head = F.unhex(F.lit("001122334455667788990abb0800450000281234400040060000c0a80101c0a80102005004d20000000100000000500220000000 0000".replace(" ", "")))
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(head, F.encode("html", "UTF-8")).alias("data"))
    d = dissect.dissect(F.col("data"), dissect.SeparatorConfig(insert_ethernet_fields=False, insert_ip_fields=False, insert_transport_fields=False))
    found = pages.select("page_id", F.filter(d["offsets"], lambda o: o["layer"] == 5).alias("o"))
    return found.select("page_id", F.col("o")[0]["field_name"].alias("field_name"), F.col("o")[0]["offset"].cast("long").alias("place"))


def file_shards(spark, sf_dir):
    """Customers as files dealt to eight ranks, in the order of their names."""
    from wirelake.sources.captures import with_rank

    files = table(spark, sf_dir, "customer").select(F.col("c_name").alias("path"))
    dealt = with_rank(files, 8)
    return dealt.groupBy("rank").agg(F.count("*").alias("n"), F.min("path").alias("first"))


def tokenise_with_packets(spark, sf_dir):
    """Whole token sequences of conversations, with packet separators and ends."""
    made = chunks.file_sequence(chunks.packet_sequences(turn_packets(spark, sf_dir), bos=True, eos=True, dense=False))
    return made.select(F.col("path").alias("conv_id"), F.size("ids").alias("n"), _digest(F.col("ids")).alias("ids_md5"))


def special_counts(spark, sf_dir):
    made = chunks.file_sequence(chunks.packet_sequences(turn_packets(spark, sf_dir), bos=True, eos=True, dense=False))
    return made.select(F.col("path").alias("conv_id"), *stats.special_counts(F.col("ids"), vocab.TOKEN))


def events_tumbling(spark, sf_dir):
    from wirelake.streaming.streams import windows

    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = windows(events, "1 hour")
    return found.select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def events_sessions(spark, sf_dir):
    from wirelake.streaming.streams import sessions

    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = sessions(events, "30 minutes")
    return found.select(F.unix_micros("start").alias("start"), "user_id", "n")


def byte_subwords(spark, sf_dir):
    """Figures of a byte-pair vocabulary learned from decimal sentences of the conversations."""
    lines = sentences.corpus(turn_packets(spark, sf_dir), "decimal", separators=False)
    model = subwords.train(lines, "bpe", 350)
    pieces = lines.select(F.size(F.split("sentence", " ")).alias("tokens"), subwords.encode(F.col("sentence"), model).alias("pieces"))
    return stats.eval_stats(pieces.where("size(pieces) > 0"), len(model.pieces))


_LIST = "list_transform(regexp_extract_all(h, '..'), lambda p: concat('0x', p)::INT{plus})"
_DOCS = "(SELECT doc_id, source, hex(encode(text)) AS h, octet_length(encode(text)) AS b FROM documents WHERE text IS NOT NULL)"
_TURNS = "(SELECT conv_id, turn, hex(encode(text)) AS h, octet_length(encode(text)) AS b FROM conversations WHERE text IS NOT NULL)"
_BYTES = f"(SELECT unnest({_LIST.format(plus='')}) AS byte FROM {_DOCS})"


def _ids_sql(plus):
    return f"SELECT doc_id, CAST(b AS INTEGER) AS n, md5(array_to_string({_LIST.format(plus=f' + {plus}')}, ' ')) AS ids_md5 FROM {_DOCS}"


_SEQ = f"""
    (SELECT conv_id, list_concat([3], list_concat(flatten(list(ids ORDER BY turn)), [2])) AS ids FROM (
       SELECT conv_id, turn, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 THEN list_concat([4], x) ELSE x END AS ids
       FROM (SELECT conv_id, turn, {_LIST.format(plus=' + 5')} AS x FROM {_TURNS})) GROUP BY conv_id)
"""
_GROUPS = "(SELECT sha256(text) AS content_hash, list(doc_id ORDER BY doc_id) AS files, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"
_PORT_CASE = "CASE {c} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in dissect.PORTS.items()) + " END"
_TOKENS = f"(SELECT source, sum(b) + count(*) - 1 AS t, sum(b) AS len FROM {_DOCS} GROUP BY source)"
_POOL = "(SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)"
_FRAME_PLACES = "6,12,14,16,18,22,26,30,34,36,38,42,46,48,52,54"

_QUERIES = {
    "packet_stats_by_source": (packet_stats_by_source, f"SELECT source, count(*) AS packets, CAST(sum(b) AS BIGINT) AS total_bytes, avg(b) AS avg_bytes, CAST(min(b) AS INTEGER) AS min_bytes, CAST(max(b) AS INTEGER) AS max_bytes, CAST(sum(b) + count(*) - 1 AS BIGINT) AS tokens FROM {_DOCS} GROUP BY source"),
    "byte_histogram": (byte_histogram, f"SELECT byte, count(*) AS n FROM {_BYTES} GROUP BY byte"),
    "top_bytes": (top_bytes, f"SELECT byte, count(*) AS n FROM {_BYTES} GROUP BY byte ORDER BY n DESC, byte LIMIT 10"),
    "rare_bytes": (rare_bytes, f"SELECT byte, count(*) AS n FROM {_BYTES} GROUP BY byte ORDER BY n, byte LIMIT 10"),
    "missing_bytes": (missing_bytes, f"SELECT CAST(range AS INTEGER) AS byte FROM range(256) WHERE range NOT IN (SELECT DISTINCT byte FROM {_BYTES})"),
    "byte_coverage": (byte_coverage, f"SELECT count(DISTINCT byte) AS distinct_bytes, 100.0::DOUBLE * count(DISTINCT byte) / 256 AS coverage FROM {_BYTES}"),
    "byte_token_ids_raw": (_token_ids(vocab.RAW), _ids_sql(0)),
    "byte_token_ids_token": (_token_ids(vocab.TOKEN), _ids_sql(5)),
    "byte_token_ids_field": (_token_ids(vocab.FIELD), _ids_sql(6)),
    "byte_token_ids_text": (_token_ids(vocab.TEXT), _ids_sql(3)),
    "roundtrip_check": (roundtrip_check, "SELECT doc_id, true AS same FROM documents"),
    "build_inputs": (build_inputs, f"SELECT a.conv_id, a.turn, CAST(a.b + c.b + 3 AS INTEGER) AS n, md5(array_to_string(list_concat([3], list_concat(a.x, list_concat([4], list_concat(c.x, [2])))), ' ')) AS ids_md5, 3 AS specials FROM (SELECT conv_id, turn, b, {_LIST.format(plus=' + 5')} AS x FROM {_TURNS} WHERE turn % 2 = 0) a JOIN (SELECT conv_id, turn, b, {_LIST.format(plus=' + 5')} AS x FROM {_TURNS} WHERE turn % 2 = 1) c ON a.conv_id = c.conv_id AND a.turn = c.turn - 1"),
    "pad_truncate": (pad_truncate, f"SELECT doc_id, {PADDED} AS n, md5(array_to_string(x[1:{PADDED - 1}], ' ')) AS input_md5, md5(array_to_string(x[2:{PADDED}], ' ')) AS target_md5 FROM (SELECT doc_id, list_concat({_LIST.format(plus=' + 5')}, list_transform(range(0, {PADDED}), lambda i: 0)) AS x FROM {_DOCS})"),
    "sentence_decimal": (_sentence("decimal"), f"SELECT doc_id, md5(array_to_string({_LIST.format(plus='')}, ' ')) AS sentence_md5 FROM {_DOCS}"),
    "sentence_hex": (_sentence("hex"), f"SELECT doc_id, md5(trim(regexp_replace(lower(h), '(..)', '\\1 ', 'g'))) AS sentence_md5 FROM {_DOCS}"),
    "sentence_tokens": (_sentence("tokens"), f"SELECT doc_id, md5(array_to_string(list_transform(range(0, b), lambda i: CASE WHEN v[i + 1] BETWEEN 32 AND 126 AND v[i + 1] NOT IN (60, 62) THEN concat('▁', chr(v[i + 1])) ELSE concat('▁', printf('%02x', v[i + 1])) END), ' ')) AS sentence_md5 FROM (SELECT *, {_LIST.format(plus='')} AS v FROM {_DOCS})"),
    "sentence_mixed": (_sentence("mixed"), f"SELECT doc_id, md5(array_to_string(list_transform(range(0, b), lambda i: CASE WHEN v[i + 1] BETWEEN 32 AND 126 AND v[i + 1] NOT IN (60, 62) THEN concat('▁', chr(v[i + 1])) ELSE concat('▁0x', printf('%02x', v[i + 1])) END), ' ')) AS sentence_md5 FROM (SELECT *, {_LIST.format(plus='')} AS v FROM {_DOCS})"),
    "corpus_stats": (corpus_stats, f"SELECT count(*) AS total_lines, CAST(sum(b) AS BIGINT) AS total_tokens, avg(b) AS avg_tokens_per_line, CAST(max(b) AS INTEGER) AS max_tokens_per_line, CAST(min(b) AS INTEGER) AS min_tokens_per_line, (SELECT count(DISTINCT byte) FROM (SELECT unnest({_LIST.format(plus='')}) AS byte FROM {_DOCS} WHERE doc_id < 1000)) AS unique_tokens_sample FROM {_DOCS} WHERE b > 0"),
    "text_line_stats": (text_line_stats, "SELECT count(*) AS total_lines, CAST(sum(k) AS BIGINT) AS total_tokens, CAST(max(k) AS INTEGER) AS max_tokens_per_line, CAST(min(k) AS INTEGER) AS min_tokens_per_line FROM (SELECT len(string_split_regex(trim(text, ' \t\r\n'), '\\s+')) AS k FROM documents WHERE trim(text, ' \t\r\n') <> '')"),
    "piece_frequency": (piece_frequency, f"SELECT CAST(byte AS VARCHAR) AS piece, count(*) AS n FROM {_BYTES} GROUP BY byte ORDER BY n DESC, piece LIMIT 20"),
    "chunk_manifest": (chunk_manifest, f"SELECT CAST(row_number() OVER (ORDER BY source, k) - 1 AS BIGINT) AS chunk_idx, 'chunk_' || lpad(CAST(row_number() OVER (ORDER BY source, k) - 1 AS VARCHAR), 8, '0') || '.npy' AS filename, source AS source_file, CAST(least({CHUNK}, t - k * {CHUNK}) AS INTEGER) AS num_tokens FROM (SELECT source, t, unnest(range(0, CAST((t + {CHUNK} - 1) // {CHUNK} AS BIGINT))) AS k FROM {_TOKENS} WHERE t > 0)"),
    "chunk_totals": (chunk_totals, f"SELECT CAST(sum((t + {CHUNK} - 1) // {CHUNK}) AS BIGINT) AS total_chunks, CAST(sum(t) AS BIGINT) AS total_tokens, count(*) AS successful_files, CAST(0 AS BIGINT) AS failed_files FROM {_TOKENS}"),
    "conversation_chunks": (conversation_chunks, f"SELECT conv_id, k AS local_idx, CAST(len(ids[k * 64 + 1:k * 64 + 64]) AS INTEGER) AS num_tokens, md5(array_to_string(ids[k * 64 + 1:k * 64 + 64], ' ')) AS tokens_md5 FROM (SELECT conv_id, ids, unnest(range(0, (len(ids) + 63) // 64)) AS k FROM (SELECT conv_id, ids[2:len(ids) - 1] AS ids FROM {_SEQ}))"),
    "content_hashes": (content_hashes, "SELECT conv_id, sha256(string_agg(text, '' ORDER BY turn)) AS content_hash FROM conversations WHERE text IS NOT NULL GROUP BY conv_id"),
    "content_hash_groups": (content_hash_groups, f"SELECT content_hash, n, array_to_string(files, ',') AS files FROM {_GROUPS}"),
    "duplicate_deletions": (duplicate_deletions, f"SELECT unnest(files[2:]) AS path FROM {_GROUPS}"),
    "duplicate_summary": (duplicate_summary, f"SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS files, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS removable FROM {_GROUPS}"),
    "size_signatures": (size_signatures, f"SELECT conv_id, md5(concat(count(*), ':', string_agg(b::VARCHAR, ':' ORDER BY b))) AS signature FROM {_TURNS} GROUP BY conv_id"),
    "smart_duplicates": (smart_duplicates, f"WITH s AS (SELECT conv_id, concat(count(*), ':', string_agg(b::VARCHAR, ':' ORDER BY b)) AS g FROM {_TURNS} GROUP BY conv_id), c AS (SELECT conv_id FROM s WHERE g IN (SELECT g FROM s GROUP BY g HAVING count(*) > 1)) SELECT content_hash, count(*) AS n, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS files FROM (SELECT conv_id, sha256(string_agg(text, '' ORDER BY turn)) AS content_hash FROM conversations WHERE text IS NOT NULL AND conv_id IN (SELECT conv_id FROM c) GROUP BY conv_id) GROUP BY content_hash HAVING count(*) > 1"),
    "patch_pool": (patch_pool, f"SELECT label, k, round(x, 6) AS x FROM (SELECT label, dim AS k, avg(x) AS x FROM {_POOL} GROUP BY label, dim UNION ALL SELECT label, dim + 64, min(x) FROM {_POOL} GROUP BY label, dim UNION ALL SELECT label, dim + 128, max(x) FROM {_POOL} GROUP BY label, dim)"),
    "document_positions": (document_positions, "SELECT conv_id // 64 AS seq_id, conv_id AS doc_id, CAST(s + k AS BIGINT) AS pos, CAST(k AS INTEGER) AS local FROM (SELECT conv_id, coalesce(sum(n) OVER (PARTITION BY conv_id // 64 ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, unnest(range(0, n)) AS k FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id))"),
    "causal_pairs": (causal_pairs, "SELECT q.conv_id AS doc_id, count(*) AS pairs FROM conversations q JOIN conversations k ON q.conv_id = k.conv_id AND k.turn <= q.turn GROUP BY q.conv_id"),
    "local_window_pairs": (local_window_pairs, "SELECT q.conv_id AS doc_id, count(*) AS pairs FROM conversations q JOIN conversations k ON q.conv_id = k.conv_id AND k.turn <= q.turn AND k.turn > q.turn - 2 GROUP BY q.conv_id"),
    "eos_segments": (eos_segments, "WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type, count(*) OVER (PARTITION BY user_id) AS c FROM events), f AS (SELECT user_id, pos FROM e WHERE event_type = 'purchase' OR pos = c - 1) SELECT user_id, pos, pos - lag(pos, 1, -1) OVER (PARTITION BY user_id ORDER BY pos) AS length FROM f"),
    "lr_schedule": (lr_schedule, "SELECT range AS step, round(CASE WHEN range < 100 THEN range / 100.0 ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * (range - 100) / 4900.0)) END, 9)::DOUBLE AS rate FROM range(5001)"),
    "model_flops": (model_flops, "SELECT p_partkey, (6 * 1000000 + 3.5 * ((4 * p_size::BIGINT * 8192 * 768) // 2))::DOUBLE AS flops FROM part"),
    "weighted_loss": (weighted_loss, "SELECT round(l, 8) AS loss, round(l / ln(2), 8) AS bpb, round(exp(l), 8) AS perplexity FROM (SELECT sum(value / 100 * (user_id % 7 + 1)) / sum(user_id % 7 + 1) AS l FROM events WHERE value IS NOT NULL)"),
    "bigram_entropy": (bigram_entropy, f"WITH v AS (SELECT b, {_LIST.format(plus='')} AS x FROM {_DOCS}), p AS (SELECT unnest(list_transform(range(1, b), lambda i: x[i] * 256 + x[i + 1])) AS g FROM v), c AS (SELECT g, count(*) AS n FROM p GROUP BY g), d AS (SELECT g, n, sum(n) OVER (PARTITION BY g // 256) AS k FROM c) SELECT CAST(sum(n) AS BIGINT) AS pairs, round(sum(n * log2(k / n)) / sum(n), 8) AS entropy FROM d"),
    "port_protocols": (port_protocols, f"SELECT coalesce({_PORT_CASE.format(c='(l_partkey % 65536)')}, {_PORT_CASE.format(c='(l_suppkey % 65536)')}) AS protocol, count(*) AS n FROM lineitem GROUP BY 1"),
    "frame_headers": (frame_headers, f"SELECT 'ipv4' AS l3, 'tcp' AS l4, '{_FRAME_PLACES}' AS places, count(*) AS n FROM lineitem"),
    "frame_boundaries": (frame_boundaries, f"SELECT 'ipv4' AS l3, 'tcp' AS l4, '{_FRAME_PLACES}' AS places, count(*) AS n, CAST(sum(l_partkey % 65536) AS BIGINT) AS ports FROM lineitem"),
    "frame_separators": (frame_separators, f"SELECT 69 AS n_tokens, '{_FRAME_PLACES[:-3]}' AS places, count(*) AS n FROM lineitem"),
    "frame_addresses": (frame_addresses, "SELECT concat((l_suppkey >> 24) & 255, '.', (l_suppkey >> 16) & 255, '.', (l_suppkey >> 8) & 255, '.', l_suppkey & 255) AS ip_src, count(*) AS n, 2048 AS eth_type, 6 AS ip_protocol, min(regexp_replace(lower(lpad(printf('%x', l_orderkey), 12, '0')), '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6')) AS first_eth_src FROM lineitem GROUP BY l_suppkey"),
    "http_bodies": (http_bodies, "SELECT page_id, CASE WHEN octet_length(encode(html)) < 4 THEN NULL WHEN c > 0 OR l > 0 THEN 'http_body' ELSE 'http_end' END AS field_name, CAST(CASE WHEN octet_length(encode(html)) < 4 THEN NULL WHEN c > 0 THEN 54 + octet_length(encode(substr(html, 1, c - 1))) + 4 WHEN l > 0 THEN 54 + octet_length(encode(substr(html, 1, l - 1))) + 2 ELSE 54 + octet_length(encode(html)) END AS BIGINT) AS place FROM (SELECT page_id, html, instr(html, chr(13) || chr(10) || chr(13) || chr(10)) AS c, instr(html, chr(10) || chr(10)) AS l FROM pages)"),
    "file_shards": (file_shards, "SELECT CAST(r AS INTEGER) AS rank, count(*) AS n, min(c_name) AS first FROM (SELECT c_name, (row_number() OVER (ORDER BY c_name) - 1) % 8 AS r FROM customer) GROUP BY r"),
    "tokenise_with_packets": (tokenise_with_packets, f"SELECT conv_id, CAST(len(ids) AS INTEGER) AS n, md5(array_to_string(ids, ' ')) AS ids_md5 FROM {_SEQ}"),
    "special_counts": (special_counts, f"SELECT conv_id, 0 AS n_pad, 0 AS n_unk, 1 AS n_eos, 1 AS n_bos, CAST(count(*) - 1 AS INTEGER) AS n_pkt, CAST(sum(b) AS INTEGER) AS n_bytes FROM {_TURNS} GROUP BY conv_id"),
    "events_tumbling": (events_tumbling, "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "events_sessions": (events_sessions, "WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT epoch_us(min(ts)) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k"),
    "byte_subwords": (byte_subwords, None),
}


def queries():
    return {name: q for name, (q, _) in _QUERIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
