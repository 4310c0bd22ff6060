"""From raw documents to packed training sequences: five stages, each written as Parquet and read again.

All stages but the last return the columns of documents, extra ones of any name included. A null or empty text has no words: the quality rules reject it. Null doc_ids
are kept. Rows that are repeated, or near copies, leave one of them: that with the least doc_id, of equal ones that with the least hash of its text. Texts of any
length are judged, masked and encoded whole. An empty table gives an empty one at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import decontaminate, documents_tokens, packing, quality, secrets, simhash
from tallyframe.llm.common import cut, find_on_executors, table
from tallyframe.llm.tokens import default_tokenizer

#: Words that a worker of the packing stage remembers: fewer than by itself, since the stages before have filled the executor's heap.
REMEMBERED = 300_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.drop_low_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in place of each secret."""
    return secrets.redact(docs)


def packing_into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences of 2,048."""
    pieces = documents_tokens.token_pieces(docs, default_tokenizer("word_bpe_49k.json"), end_id=0, capacity=2048, with_ids=True, remembered=REMEMBERED)
    return packing.best_fit_pack(cut(pieces, "pieces"), capacity=2048)


STAGES: list = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_redaction),
    ("packing", packing_into_sequences),
]

#: The stages encode, fingerprint and pack, which SQL can't express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns for the table ``documents`` below ``sf_dir``."""
    find_on_executors(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
