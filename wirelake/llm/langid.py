"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wirelake.llm.common import code_points, fold, giving_back, texts_in_chunks, with_fields

#: n-grams in a profile; the rank of one that a profile lacks counts as this.
TOP = 300
#: Labelled documents of each language that its profile is fitted on, about: a share of all is drawn by a hash of doc_id.
SAMPLE = 2000
#: Characters of texts that are counted together, which bounds the memory of a task.
TOGETHER = 250_000
GAP = 1
BITS = 18


@cache
def letters() -> np.ndarray:
    """By code point: a dense number of the letter, lower-cased, from 2 on; GAP for all else."""
    lowered = np.full(0x110001, GAP, np.int64)
    numbers: dict[int, int] = {}
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            lowered[c] = numbers.setdefault(ord(low) if len(low) == 1 else c, len(numbers) + 2)
    return lowered


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, n-gram code, count) of the 1- to 3-grams in the words of each text, by text and code; letters of each text.

    Every word is framed by gaps; runs of what isn't a letter are one gap.
    """
    points, first = code_points(texts, 0x110000)
    x = letters()[points]
    owner = np.repeat(np.arange(len(texts)), np.diff(np.append(first, len(points))))
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != GAP) | (x[:-1] != GAP)
    keep[first[1:] - 1] = True
    x, owner = x[keep], owner[keep]
    # a gap in front of each text: the gap that ends the text before, or the one put here
    x, owner = np.concatenate(([GAP], x)), np.concatenate(([0], owner))
    word = x[1:] != GAP
    one = (owner[1:][word], x[1:][word])
    pair = word | (x[:-1] != GAP)
    two = (owner[1:][pair], (x[:-1][pair] << BITS) | x[1:][pair])
    middle = x[1:-1] != GAP
    three = (owner[1:-1][middle], (x[:-2][middle] << 2 * BITS) | (x[1:-1][middle] << BITS) | x[2:][middle])
    keys = np.concatenate([(o << 3 * BITS) | c for o, c in (one, two, three)])
    keys.sort()
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(edge, len(keys)))
    keys = keys[edge]
    return keys >> 3 * BITS, keys & ((1 << 3 * BITS) - 1), counts, np.bincount(one[0], minlength=len(texts))


def profiles(docs: DataFrame, top: int = TOP, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """The codes of each language's most frequent n-grams, most frequent first, ties by code.

    Fitted on a bounded sample of the labelled rows: about ``sample`` documents of each language, drawn by a hash of
    doc_id. Only the profiles (``top`` numbers a language) come to the driver.
    """
    labelled = docs.where("lang is not null and text is not null")
    shares = {r.lang: min(1.0, sample / r.n) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return {}
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(10)), F.lit(1 << 20))
    limit = F.create_map(*[F.lit(x) for k, v in shares.items() for x in (k, round(v * (1 << 20)))])
    drawn = labelled.where(draw < limit[F.col("lang")]).select("lang", "text")

    def count(batches):
        for batch in giving_back(batches):
            langs = np.array(batch.column(0).to_pylist(), object)
            for first, texts in texts_in_chunks(batch, limit=TOGETHER):
                owner, code, n, _ = ngrams(texts)
                for lang in set(langs[first : first + len(texts)]):
                    mine = (langs[first : first + len(texts)] == lang)[owner]
                    codes, inverse = np.unique(code[mine], return_inverse=True)
                    total = np.bincount(inverse, n[mine], len(codes)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(total)], names=["lang", "code", "n"])

    counted = drawn.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("rank") <= top)
    found: dict[str, list] = {}
    for r in sorted(ranked.collect(), key=lambda r: (r.lang, r["rank"])):
        found.setdefault(r.lang, []).append(r.code)
    return {k: np.array(v, np.int64) for k, v in found.items()}


def distances(texts: list[str], known: list[np.ndarray], top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """Out-of-place distance of each text to each profile, from 0 to 1; and the letters of each text."""
    owner, code, n, size = ngrams(texts)
    order = np.argsort((owner << 40) | ((1 << 40) - 1 - n), kind="stable")
    owner, code = owner[order], code[order]
    begin = np.searchsorted(owner, np.arange(len(texts)))
    rank = np.arange(len(owner)) - begin[owner]
    first = rank < top
    owner, code, rank = owner[first], code[first], rank[first]
    kept = np.bincount(owner, minlength=len(texts))
    out = np.ones((len(texts), len(known)))
    for k, profile in enumerate(known):
        by_code = np.argsort(profile)
        codes = profile[by_code]
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        away = np.where(codes[at] == code, np.minimum(np.abs(by_code[at] - rank), top), top)
        out[:, k] = np.bincount(owner, away, len(texts)) / np.maximum(1, kept * top)
    return out, size


def identify(docs: DataFrame, trained: dict[str, np.ndarray]) -> DataFrame:
    """The documents with ``lang_pred`` and ``score``: the language with the nearest profile, ties by name, and 1 less its distance.

    A text that is null or has no letter, or any text if no profile was learned, is ``und`` with score 0. Whole texts
    are counted. Repeated rows come back as often as they are there. Columns named lang_pred and score are replaced;
    other columns go through, of which only text is read.
    """
    langs = sorted(trained)
    known = [trained[k] for k in langs]
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index("text")

    def run(batches):
        for batch in giving_back(batches):
            for first, texts in texts_in_chunks(batch, at, TOGETHER):
                if langs:
                    away, size = distances(texts, known)
                    best = away.argmin(axis=1)
                    pred = [langs[b] if s else "und" for b, s in zip(best, size, strict=True)]
                    score = np.where(size > 0, 1 - away[np.arange(len(texts)), best], 0.0)
                else:
                    pred, score = ["und"] * len(texts), np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(texts)).columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, with_fields(docs.schema, "lang_pred string, score double"))


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """Predictions of all documents by profiles of those whose fold isn't held out: (doc_id, held_out, lang_pred, score)."""
    trained = profiles(docs.where(fold("doc_id", 3) != 1))
    return identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), trained).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
