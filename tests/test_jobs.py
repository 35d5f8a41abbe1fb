"""The end-to-end jobs over small captures, and the functions' SQL names."""

import pytest
from pyspark.sql import functions as F

from tests.test_dissect import FRAME
from wirelake.functions import register
from wirelake.operators import progress
from wirelake.plans import jobs
from wirelake.sources import captures


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("jobs")
    (top / "a.pcap").write_bytes(captures.write_pcap([FRAME, b"\0\1\2"]))
    (top / "b.pcap").write_bytes(captures.write_pcap([FRAME, b"\0\1\2"]))
    (top / "empty.pcap").write_bytes(captures.write_pcap([]))
    (top / "bad.pcap").write_bytes(b"no")
    return str(top)


def test_tokenize(spark, folder):
    rows = {r.path.rpartition("/")[2]: r.ids for r in jobs.tokenize_captures(spark, folder, field_separators=True, bos=True, eos=True).collect()}
    assert set(rows) == {"a.pcap", "b.pcap", "empty.pcap"} and rows["empty.pcap"] == [3, 2]
    assert len(rows["a.pcap"]) == 69 + 1 + 3 + 2 and rows["a.pcap"].count(5) == 15
    assert jobs.tokenize_captures(spark, folder).count() == 2


def test_pretokenize(spark, folder, tmp_path):
    r = jobs.pretokenize(spark, folder, str(tmp_path), size=32).first()
    assert (r.total_chunks, r.total_tokens, r.successful_files, r.failed_files) == (4, 116, 2, 2)


def test_corpus_and_vocabulary(spark, folder, tmp_path):
    totals = jobs.build_corpus(spark, folder, str(tmp_path), "decimal").first()
    assert (totals.files, totals.packets, totals.bytes, totals.separators) == (2, 4, 114, 30)
    assert spark.read.json(f"{tmp_path}/malformed").count() == 2
    model, figures = jobs.learn_vocabulary(spark, f"{tmp_path}/corpus", size=60)
    assert model.pieces and figures.first().lines == 4


def test_duplicates(spark, folder, tmp_path):
    assert list(jobs.find_duplicates(spark, folder, str(tmp_path)).first()) == [1, 2, 1]
    assert spark.read.text(f"{tmp_path}/delete").first().value.endswith("b.pcap")


def test_sql_names(spark):
    register.register(spark)
    row = spark.sql("select byte_tokens(X'4869', 'token') a, decode_tokens(array(77, 110, 4), 'token') b, packet_words(X'41', 'hex') c, dissect(X'000102').error_type d").first()
    assert (row.a, bytes(row.b), row.c, row.d) == ([77, 110], b"Hi", "41", "NeedData")


def test_observation(spark, folder):
    packets, seen = progress.observed(captures.read_captures(spark, folder))
    packets.write.format("noop").mode("overwrite").save()
    assert seen.get == {"packets": 4, "bytes": 114, "failed_files": 1} and progress.rates(seen, 2.0)["packets_per_second"] == 2.0
    assert packets.select(F.count("*")).first()[0] == 5
