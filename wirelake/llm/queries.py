"""The registered queries of the language-model operators: each runs its operator over a whole table."""

from __future__ import annotations

import public_tokenizers

from wirelake.llm import bpe, crf, hmm, langid, lcp, mixing, nndescent, pii, repeats, simhash

#: Target weights of the sources: the hot one is held down, some are wanted more.
MIX_WEIGHTS = {"src0": 6, "src1": 4, "src2": 4, "src3": 3, "src4": 3}
VOCABULARY = "byte_bpe_50k.tiktoken"


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir), MIX_WEIGHTS)


def op3_bpe(spark, sf_dir):
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))


def op4_lm_scores(spark, sf_dir):
    return hmm.held_out_scores(documents(spark, sf_dir))


def op5_toxicity(spark, sf_dir):
    return crf.held_out_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_repeats(spark, sf_dir):
    return repeats.without_repeats(documents(spark, sf_dir)).drop("kept")


def op7_pii(spark, sf_dir):
    return pii.digests(documents(spark, sf_dir))


def op8_fingerprints(spark, sf_dir):
    return lcp.edited(documents(spark, sf_dir))


def op9_vectors(spark, sf_dir):
    return nndescent.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_langid(spark, sf_dir):
    return langid.held_out_predictions(documents(spark, sf_dir))


def queries():
    return {
        "op1_simhash": op1_simhash,
        "op2_mixing": op2_mixing,
        "op3_bpe": op3_bpe,
        "op4_lm_scores": op4_lm_scores,
        "op5_toxicity": op5_toxicity,
        "op6_repeats": op6_repeats,
        "op7_pii": op7_pii,
        "op8_fingerprints": op8_fingerprints,
        "op9_vectors": op9_vectors,
        "op10_langid": op10_langid,
    }


def oracle_sql():
    """None: hash sketches, schedules, merges, checksums and profiles have no SQL form; the tests hold them against brute force."""
    return {}
