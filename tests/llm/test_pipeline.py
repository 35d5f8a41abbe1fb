"""The pipeline's stages against plain versions, and the driver contract without the language-model operators."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import DOCS, corpus, plain_first_of_groups
from wirelake.llm import bpe, pii
from wirelake.llm.common import release

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    out = spark.createDataFrame(corpus(), DOCS).unionByName(spark.createDataFrame([(None, "abc def ghi " * 30, "en", "s1", 360)], DOCS))
    out.write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("score", F.lit("clash"))
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = stage(spark, docs, folder)
        rows = docs.collect()
        if k < 4:
            assert docs.columns == columns
        if name == "language":
            assert {r.doc_id for r in before} - {r.doc_id for r in rows} == {63, 64, 65, 66, 68, 69}  # no letter, or like no language learned
            assert sum(r.doc_id == 70 for r in rows) == 2
        elif name == "near duplicates":
            first, groups, _ = plain_first_of_groups([(r.doc_id, r.text) for r in before])
            assert len(rows) == groups and {(r.doc_id is None, r.doc_id or 0) for r in rows} == first
            assert 60 not in {r.doc_id for r in rows} and 3 in {r.doc_id for r in rows}
        elif name == "private":
            assert len(rows) == len(before) and not any(pii.spans(r.text or "") for r in rows if r.doc_id == 67)
        elif name == "mixed":
            assert sorted(map(str, rows)) == sorted(map(str, before))
        else:
            coder = bpe.coder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
            assert len(rows) == len(before)
            assert all(coder.decode(np.array(r.ids, np.int64)) == (r.text or "").encode() for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and out.count() > 50


def test_shares_by_slot(spark, tmp_path):
    rows = [(k, f"a text {k}", "en", f"src{max(0, k % 6 - 1)}", 0) for k in range(1920)]
    spark.createDataFrame(rows, DOCS).repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.encoded(spark, corpus_pipeline.mixed(spark, docs, str(tmp_path)), str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == list(range(1920)) and len({(r.mix_slot, r.mix_place) for r in got}) == 1920
    # one period of the schedule, of which each source has its weight's blocks of 64 rows
    shares = {s: sum(r.source == s for r in got if r.mix_slot < 20) for s in corpus_pipeline.MIX_WEIGHTS}
    assert shares == {s: 64 * w for s, w in corpus_pipeline.MIX_WEIGHTS.items()}


def test_encoded_has_the_places_of_mixed(spark, tmp_path):
    rows = [(k, f"a text {k} " * (1 + 40 * (k % 1000 == 0) + k // 6000), "en", None if k % 97 == 0 else f"src{max(0, k % 7 - 2)}", 0) for k in range(20_000)]
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    corpus_pipeline.mixed(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/mixed")
    files = sorted((tmp_path / "mixed").glob("part-*"))
    written = [x for f in files for x in pq.read_table(f)["doc_id"].to_pylist()]
    assert len(files) > 2 and sorted(written) == list(range(20_000))
    got = corpus_pipeline.encoded(spark, spark.read.parquet(f"{tmp_path}/mixed"), str(tmp_path)).orderBy("mix_slot", "mix_place").collect()
    assert [r.doc_id for r in got] == written
    # and in one session without files in between
    chained = corpus_pipeline.encoded(spark, corpus_pipeline.mixed(spark, docs, str(tmp_path)), str(tmp_path)).orderBy("mix_slot", "mix_place").collect()
    assert [(r.doc_id, r.mix_slot, r.mix_place) for r in chained] == [(r.doc_id, r.mix_slot, r.mix_place) for r in got]


def test_texts_cross_to_python_once(spark, folder):
    out = corpus_pipeline.language(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    # no column has the whole row beside the text
    assert "struct(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_release_collects_on_executors(spark):
    def collections():
        return sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())

    before = collections()
    release(spark)
    assert collections() - before >= 2  # the driver's and, here in the same JVM, an executor's


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_entry_without_the_operators(tmp_path):
    copy = tmp_path / "copy"
    subprocess.run(["cp", "-r", str(ROOT), str(copy)], check=True)
    subprocess.run(["rm", "-r", str(copy / "wirelake/llm"), str(copy / "tests/llm"), str(copy / "corpus_pipeline.py")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert len(q) > 40 and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})
