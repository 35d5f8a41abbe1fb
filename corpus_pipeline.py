"""A corpus pipeline of five stages, each written as Parquet and read again before the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from wirelake.llm import bpe, langid, mixing, pii, simhash
from wirelake.llm.common import Scratch, fold, release
from wirelake.llm.queries import MIX_WEIGHTS, VOCABULARY

#: A text whose nearest profile is farther than this is in none of the learned languages.
LEAST_LANGUAGE_SCORE = 0.15


def language(spark, docs, sf_dir):
    """Rejects texts without a letter (null and empty ones too) and those that no language profile is near to. All rows of other texts stay, repeated ones as often as they are there."""
    release(spark)
    trained = langid.profiles(docs.where(fold("doc_id", 3) != 1))
    # names of their own for the other columns, any of which may be called as a result is; the text crosses to Python once
    named = docs.toDF(*("text" if c == "text" else f"_{k}" for k, c in enumerate(docs.columns)))
    found = langid.identify(named, trained).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return found.select(*named.columns).toDF(*docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """Keeps one row of each group of near-duplicates: the smallest doc_id, null last.

    Groups are joined by pairs whose sets of five-word shingles have a Jaccard similarity of 0.8 or more; fingerprints
    propose the pairs. Repeated rows and rows with a null doc_id are copies like any others.
    """
    return simhash.without_near_copies(docs, least=0.8, shingle=5)


def private(spark, docs, sf_dir):
    """Puts the kind in place of personal data; all rows stay, and null texts stay null."""
    release(spark)
    return pii.redact(docs)


def mixed(spark, docs, sf_dir):
    """Puts the documents in the order of the Pfair mix, in which each source has its weight's share of any stretch; all rows stay. A null source is one of its own.

    The columns are those of the input; the order of the rows in the files is the result, and ``encoded`` reads it.
    """
    return mixing.in_mix_order(docs, MIX_WEIGHTS).select(*docs.columns)


def encoded(spark, docs, sf_dir):
    """Adds mix_slot and mix_place, the slot and place that ``mixed`` gave each row and that order the rows however the files are read, the byte-level BPE ids and the byte offset after each; a null text has none."""
    release(spark)
    return bpe.encode(mixing.with_places(docs, MIX_WEIGHTS, as_read=True), public_tokenizers.path(VOCABULARY))


STAGES = [("language", language), ("near duplicates", near_duplicates), ("private", private), ("mixed", mixed), ("encoded", encoded)]
#: SQL expresses neither fingerprints nor schedules nor merges; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of the folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
