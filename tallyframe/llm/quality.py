"""Quality rules: heuristics on words, then a hashed n-gram log-likelihood ratio of trusted target against raw corpus.

Every word and every pair of neighbouring words is hashed into one of ``buckets`` buckets. Two smoothed multinomials over
the buckets are fitted: one from trusted documents, one from all documents. A document's score is the sum of
log(p_target / p_raw) over its n-grams, divided by their number, so that long documents aren't judged by length; a document is
kept if its score reaches a fixed threshold. Nothing is drawn at random: equal texts always get equal verdicts.

The raw multinomial counts every n-gram of every document. The target is fitted on at most ``target_documents`` trusted
ids (the first by a hash of the id), which is what makes their broadcast bounded. The table of weights has ``buckets`` doubles.

Nulls: a null text has no words and fails the base rules; a null doc_id is never a trusted one. Repeated rows each get
their row. Without trusted documents all weights and scores are 0.
Other columns of the input are dropped, whatever their names.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

BUCKETS = 1 << 15
#: Clean prose scores about 0, decorated, shouted or tabulated text below -0.15 (measured on labelled rows).
THRESHOLD = -0.1
TARGET_DOCUMENTS = 50_000


def repeat_words(ws: Column) -> Column:
    """Words within 3-word windows that are found twice or more in the text."""

    def covered(hashes: Column) -> Column:
        def count(ordered: Column) -> Column:
            same = lambda e, other: F.coalesce(e["h"] == other["h"], F.lit(False))
            repeated = F.filter(ordered, lambda e, k: same(e, F.get(ordered, k - 1)) | same(e, F.get(ordered, k + 1)))
            places = F.array_sort(F.transform(repeated, lambda e: e["i"]))
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            step = lambda acc, i: F.struct((acc["n"] + i + 3 - F.greatest(acc["end"], i)).alias("n"), (i + 3).alias("end"))
            return F.aggregate(places, start, step, lambda acc: acc["n"])

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(pairs, count))

    windows = F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))
    return let(windows, covered)


def ngram_buckets(ws: Column, buckets: int) -> Column:
    """Buckets of all words and all pairs of neighbouring words."""
    single = F.transform(ws, lambda w: F.pmod(F.hash(w), F.lit(buckets)))
    second = F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0)))
    pairs = F.transform(second, lambda w, i: F.pmod(F.hash(F.get(ws, i), w), F.lit(buckets)))
    return F.concat(single, pairs)


def bucket_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, target_documents: int = TARGET_DOCUMENTS) -> Column:
    """A constant array: log(p_target / p_raw) of each bucket, add-one smoothed, to four decimals.

    ``trusted`` has the doc_ids of trusted documents. The counting runs here; the array's size is ``buckets``, whatever the input.
    """
    chosen = trusted.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_documents).withColumn("trusted", F.lit(1))
    grams = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(F.broadcast(chosen), "doc_id", "left")  # at most target_documents ids
        .select(F.explode(let(words(F.col("text").cast("string")), lambda ws: ngram_buckets(ws, buckets))).alias("bucket"), F.coalesce("trusted", F.lit(0)).alias("trusted"))
    )
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("trusted").alias("target"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counts.collect():  # a row a bucket
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.any():
        return F.array_repeat(F.lit(0.0), buckets)
    ratio = np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))
    return F.from_json(F.lit(json.dumps([round(x, 4) for x in ratio.tolist()])), "array<double>")


def score_quality(docs: DataFrame, weights: Column, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr and kept added."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def rules(ws: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
        total = lambda grams: F.aggregate(grams, F.lit(0.0), lambda acc, g: acc + F.get(weights, g)) / F.greatest(F.size(grams), F.lit(1))
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda found: F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
            repeat_words(ws).cast("long").alias("n_repeat_words"),
            let(ngram_buckets(ws, buckets), total).alias("llr"),
        )

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = docs.withColumn("_rules", let(words(text), rules))
    for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr"):
        found = found.withColumn(name, F.col(f"_rules.{name}"))
    return found.drop("_rules").withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def quality_verdicts(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """doc_id, text and the verdict's columns of every document; ``labels`` (doc_id, quality) name the trusted ones."""
    plain = docs.select("doc_id", "text")
    return score_quality(plain, bucket_weights(plain, labels.where("quality = 1").select("doc_id")), **limits)


def drop_low_quality(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the same columns."""
    weights = bucket_weights(docs.select("doc_id", "text"), labels.where("quality = 1").select("doc_id"))
    packed = docs.select("text", F.struct(*docs.columns).alias("_row"))
    return score_quality(packed, weights, **limits).where("kept").select("_row.*")
