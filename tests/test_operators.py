"""Sequences, pooling, subwords, model figures and statistics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wirelake.operators import lmmath, sequences, stats, subwords


def test_segments(spark):
    rows = [[0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0], [0, 1, 0, 0, 0, 1, 0, 0, 0, 0, 0]]
    table = spark.createDataFrame([(r, p, t) for r, ids in enumerate(rows) for p, t in enumerate(ids)], "row int, pos int, token int")
    got = [r.length for r in sequences.segment_lengths(table, 1).orderBy("row", "pos").collect()]
    assert got == [4, 4, 3, 2, 4, 5]
    arrays = spark.createDataFrame([(r,) for r in rows], "x array<int>").select(sequences.segment_lengths_of(F.col("x"), 1)).collect()
    assert [x for r in arrays for x in r[0]] == got


def test_documents_and_masks(spark):
    lengths = spark.createDataFrame([(0, d, n) for d, n in enumerate((2, 3, 2))], "seq_id int, doc_id int, length int")
    at = sequences.document_positions(lengths)
    assert [(r.doc_id, r.pos, r.local) for r in at.orderBy("pos").collect()] == [(0, 0, 0), (0, 1, 1), (1, 2, 0), (1, 3, 1), (1, 4, 2), (2, 5, 0), (2, 6, 1)]
    pairs = sequences.causal_pairs(at, pos="local")
    assert pairs.count() == 12 == sequences.causal_pair_count(lengths).first()[0]
    assert sequences.causal_pairs(at, pos="local", window=2).count() == 11 == sequences.causal_pair_count(lengths, 2).first()[0]
    assert sequences.mask_kind("xformers", "local_block_causal", 512) == "document window" and sequences.mask_kind("sdpa", "block_causal", ignore=True) == "causal"
    for wrong in (("sdpa", "block_causal", None), ("other", None, None), ("xformers", "causal", 3)):
        with pytest.raises(ValueError):
            sequences.mask_kind(*wrong)


def test_patches(spark):
    vectors = spark.createDataFrame([(0, p, p // 2, [float(p), -float(p)]) for p in range(6)], "seq_id int, pos int, patch_id int, vec array<float>")
    pooled = {r.patch_id: r.pooled for r in sequences.pool(vectors, ("max", "mean", "min")).collect()}
    assert pooled[1] == [2.5, -2.5, 2.0, -3.0, 3.0, -2.0]
    lengths = spark.createDataFrame([(0, 0, 1), (0, 1, 3), (0, 2, 2)], "seq_id int, patch_id int, length int")
    joined = {r.patch_id: r.joined for r in sequences.concat_patches(vectors, lengths, 2).collect()}
    assert joined == {0: [0.0, 0.0, 0.0, 0.0], 1: [2.0, -2.0, 3.0, -3.0], 2: [4.0, -4.0, 5.0, -5.0]}
    assert sequences.downsample(vectors, lengths, (), 2).count() == 3


def test_order_and_batches(spark):
    rows = spark.range(25)
    batches = sequences.batches(rows, 10, "id").collect()
    assert {r.id: r.batch for r in batches} == {i: i // 10 for i in range(25)}
    assert [r.id for r in sequences.shuffled(rows, "id", 1).collect()] == [r.id for r in sequences.shuffled(rows, "id", 1).collect()] != list(range(25))
    assert sequences.head(rows, 3, "id").count() == 3 and sequences.training_grid(spark, ["bpe", "unigram"], [1, 2]).count() == 4
    files = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2)], "path string, modified int")
    assert sequences.latest(files).first().path == "b" and sequences.sample_files(files, 2).count() == 2


def test_model_figures(spark):
    steps = spark.createDataFrame([(0,), (50,), (100,), (5000,)], "s int").select(lmmath.learning_rate(F.col("s"), 100, 5000)).collect()
    assert np.allclose([r[0] for r in steps], [0, 0.5, 1, 0.1])
    one = spark.range(1).select(lmmath.attention_flops(F.lit(14), F.lit(8192), F.lit(768), True), lmmath.flops(F.lit(10), F.lit(1), F.lit(3), F.lit(1))).first()
    assert list(one) == [3.5 * (4 * 14 * 8192 * 768 // 2), 60 + 3.5 * 6]
    loss = lmmath.weighted_loss(spark.createDataFrame([(1.0, 3), (2.0, 1)], "loss double, n int")).first()
    assert np.allclose(list(loss), [1.25, 1.25 / math.log(2), math.exp(1.25)])
    assert lmmath.step_loss(spark.createDataFrame([(1.0,), (2.0,)], "loss double"), 2).first()[0] == 0.03
    z = spark.createDataFrame([([1.0, 2.0, 3.0], 2)], "z array<double>, t int").select(lmmath.cross_entropy(F.col("z"), F.col("t"))).first()[0]
    assert np.isclose(z, -math.log(math.exp(3) / sum(map(math.exp, (1, 2, 3)))))
    assert lmmath.effective_batch(4, 49, 8192, 1) == 1_605_632
    data = spark.createDataFrame([(bytearray(b"ababab"),), (bytearray(b"ac"),), (bytearray(),), (None,)], "data binary")
    got = lmmath.bigram_entropy(data).first()
    assert got.pairs == 6 and np.isclose(got.entropy, (3 * math.log2(4 / 3) + math.log2(4)) / 6)


def test_forward_pass(spark):
    args = lmmath.ModelArgs(dim=16, layers=2, heads=2, vocab=11, multiple_of=8, window=3, eos=2)
    assert lmmath.hidden_size(args) == 48 and lmmath.hidden_size(lmmath.ModelArgs()) == 2048
    w = lmmath.random_weights(args)
    ids = np.array([3, 5, 2, 7, 8, 9])
    z = lmmath.forward(ids, w, args)
    changed = ids.copy()
    changed[4] = 1
    later = lmmath.forward(changed, w, args)
    assert np.allclose(z[:4], later[:4]) and not np.allclose(z[4:], later[4:])
    other = lmmath.forward(np.array([9, 9, 2, 7, 8, 9]), w, args)
    assert np.allclose(z[3:], other[3:])  # another document before doesn't matter
    loss = spark.createDataFrame([(ids.tolist(),), ([1],), (None,)], "x array<int>").select(lmmath.sequence_loss(F.col("x"), w, args)).collect()
    assert loss[0][0] > 0 and loss[1][0] is None and loss[2][0] is None


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([("1 24 248 25 1",), ("24 24 1",), ("",), ("248 7",)], "sentence string")


def test_subwords(spark, lines):
    model = subwords.train(lines, "bpe", 30)
    coded = lines.select("sentence", subwords.encode(F.col("sentence"), model).alias("p"), subwords.encode(F.col("sentence"), model, as_ids=True).alias("i"))
    for r in coded.select("*", subwords.decode(F.col("p")).alias("back")).collect():
        assert r.back == r.sentence and len(r.p) == len(r.i) and all(model.pieces[k] == p for k, p in zip(r.i, r.p, strict=True))
    for kind in ("unigram", "char", "word", "wordpiece"):
        other = subwords.train(lines, kind, 40)
        assert other.pieces and lines.select(subwords.encode(F.col("sentence"), other).alias("p")).count() == 4
    with pytest.raises(ValueError):
        subwords.train(lines, "other")
    assert subwords.train(lines, "bpe", 30, longest=3).pieces != model.pieces
    figures = subwords.evaluate(lines, model).first()
    assert figures.total_tokens == 10 and figures.lines == 3 and figures.avg_pieces_ref == figures.total_pieces / 10
    assert subwords.sample_encodings(lines, model).count() == 4
    assert subwords.viterbi("abab", {"ab": -1.0, "a": -2.0, "b": -2.0}) == ["ab", "ab"]
    assert stats.piece_counts(coded.select(F.col("p").alias("pieces")), 1).first().n == 2


def test_bpe_merges_the_most_frequent_pair():
    model = subwords.train_bpe([("aab", 5), ("ab", 2), ("cc", 6)], 3 + 3 + 2)
    assert list(model.merges) == [("a", "b"), ("c", "c")] and subwords.pieces_of("aabcc", model) == ["a", "ab", "cc"]


def test_corpus_figures(spark):
    table = spark.createDataFrame([(1, "a b c"), (2, ""), (3, "a  d "), (4, "e")], "line_no int, value string")
    r = stats.corpus_stats(table, sample=3).first()
    assert (r.total_lines, r.total_tokens, r.max_tokens_per_line, r.min_tokens_per_line, r.unique_tokens_sample) == (3, 6, 3, 1, 4)
    built = spark.createDataFrame([("f", 10, 2), ("g", 20, 0)], "path string, bytes int, separators int")
    assert list(stats.builder_totals(built).first()) == [2, 2, 30, 2, 15.0, 1.0]
    pair = spark.createDataFrame([(bytearray(b"abc"), bytearray(b"abd")), (bytearray(b"a"), bytearray(b"ab")), (bytearray(b"a"), bytearray(b"a"))], "a binary, b binary")
    assert [r[0] for r in pair.select(stats.first_difference(F.col("a"), F.col("b"))).collect()] == [2, 1, None]
    info = spark.createDataFrame([('{"training_stats": {"vocab_size": 350}}',)], "j string").select(*stats.summary_fields(F.col("j"))).first()
    assert list(info) == ["350", "unknown", "unknown"]
    assert stats.malformed_counts(spark.createDataFrame([("x",), ("x",)], "error_type string")).first().n == 2
