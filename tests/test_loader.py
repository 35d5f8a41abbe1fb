"""Chunk loaders, chunk files and statuses of files."""

import pickle

import numpy as np

from wirelake.operators import chunks, loader
from wirelake.sources import captures, sinks
from wirelake.streaming.streams import run_now


def made(spark, n=23):
    rows = [(k, f"chunk_{k:08d}.npy", "a", 3 + k % 4, list(range(k, k + 3 + k % 4))) for k in range(n)] + [(n, "empty", "a", 0, [])]
    return spark.createDataFrame(rows, loader.CHUNKS)


def test_loader(spark):
    got = loader.loader(made(spark), 5, 4, n_epochs=2, seed=1).collect()
    assert len(got) == 46 and all(len(r.input) == 4 and len(r.target) == 4 and r.input[1:] == r.target[:-1] for r in got)
    sizes = {}
    for r in got:
        sizes[r.batch] = sizes.get(r.batch, 0) + 1
    assert sorted(sizes) == list(range(12)) and all(n == 4 for b, n in sizes.items() if b < 11) and sizes[11] == 2
    order = [[r.chunk_idx for r in sorted(got, key=lambda r: r.batch) if r.epoch == e] for e in (0, 1)]
    assert order[0] != order[1] and sorted(order[0]) == sorted(order[1]) == list(range(23))
    assert max(r.batch for r in got if r.epoch == 0) <= min(r.batch for r in got if r.epoch == 1)
    shares = [{r.chunk_idx for r in loader.loader(made(spark), 5, 4, rank=k, world=3).collect()} for k in range(3)]
    assert sorted(x for s in shares for x in s) == list(range(23))
    plain = loader.loader(made(spark), 5, 4, shuffle=False).collect()
    assert all(r.batch == r.chunk_idx // 4 for r in plain)


def test_stream_of_chunks(spark, tmp_path):
    made(spark).repartition(3).write.parquet(f"{tmp_path}/chunks")
    (tmp_path / "chunks" / "part-bad.parquet").write_bytes(b"no parquet")
    stream = loader.stream_chunks(spark, f"{tmp_path}/chunks", 6, files_a_batch=1)
    run_now(stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check"))
    assert sorted(r.chunk_idx for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(23))


def test_chunk_files_of_all_forms(spark, tmp_path):
    rows = made(spark, 5).where("num_tokens > 0")
    want = sorted(r.tokens for r in rows.collect())
    for form in ("npy", "pkl", "arrow"):
        folder = tmp_path / form
        folder.mkdir()
        sinks.chunk_files(rows, str(folder), form).collect()
        assert sorted(r.tokens for r in sinks.load_chunk_files(spark, str(folder)).collect()) == want
    (tmp_path / "pkl" / "chunk_00000099.pkl").write_bytes(pickle.dumps(np.float64(1)))
    assert [r.filename for r in sinks.load_chunk_files(spark, str(tmp_path / "pkl")).where("tokens is null").collect()] == ["chunk_00000099.pkl"]


def test_corpus_lines_are_stripped(spark, tmp_path):
    (tmp_path / "c.txt").write_text(" a b\t\n\t \n\n c\r\n")
    assert sorted(r.value for r in sinks.read_corpus(spark, str(tmp_path / "c.txt")).collect()) == ["a b", "c"]


def test_large_and_broken_captures_fail_alone(spark, tmp_path, monkeypatch):
    (tmp_path / "bad.pcap").write_bytes(b"nothing")
    (tmp_path / "large.pcap").write_bytes(b"x" * 500)
    monkeypatch.setattr(captures, "LARGEST", 400)
    found = {r.path.rpartition("/")[2]: r.error for r in captures.read_captures(spark, str(tmp_path)).collect()}
    assert set(found) == {"bad.pcap", "large.pcap"} and "400" in found["large.pcap"]
    files = captures.find_captures(spark, str(tmp_path))
    errors = captures.read_captures(spark, str(tmp_path)).where("error is not null").select("path", "error")
    none = spark.createDataFrame([], loader.CHUNKS)
    assert {(r.status, r.error is None) for r in chunks.source_files(none, files, errors).collect()} == {("error", False)}
