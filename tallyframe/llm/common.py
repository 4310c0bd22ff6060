"""Shared helpers: reading tables, cutting lineage, distributed prefix sums."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that separates words everywhere in this package.
SPACE = " \t\n\x0b\x0c\r"
BLANK = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session on one machine (tests) may name none, and gets a temporary folder; a cluster's executors would lose what they write to their own disks.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return at.rstrip("/") if at else _own_dir()


def find_on_executors(spark: SparkSession) -> None:
    """Let tasks find this package wherever the driver was started, if the session doesn't say how."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends, losses don't cost a re-run."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of about ``limit`` bytes of ``column`` at most, or of one longer row; empty ones are left out."""
    for batch in batches:
        first = size = 0
        for k, n in enumerate(pc.binary_length(batch.column(column)).fill_null(0).to_pylist()):
            if size and size + n > limit:
                yield batch.slice(first, k - first)
                first, size = k, 0
            size += n + 1
        if first < batch.num_rows:
            yield batch.slice(first)


def blank_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Maximal runs of characters outside x20 and x09-x0D, in order."""
    return F.array_remove(F.split(text, BLANK), "")


def remainder_of_id(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def rank_within(df: DataFrame, key: str, order: Sequence[str], salts: int = 64) -> DataFrame:
    """Add ``rank`` (from 0) within ``key``, without putting a hot key into one task.

    Rows of a key are spread over ``salts`` shares by the hash of ``order``; each share ranks its own rows,
    and prefix sums over the shares' sizes (at most ``salts`` rows a key) give each share its first rank.
    """
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = dealt.groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(key, "_salt", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    share = Window.partitionBy(key, "_salt").orderBy(*order)
    return (
        dealt.withColumn("_at", F.row_number().over(share) - 1)
        .join(bases, [key, "_salt"])
        .withColumn("rank", (F.col("_base") + F.col("_at")).cast("long"))
        .drop("_salt", "_at", "_base")
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often and however deep in lambdas the body uses it."""
    return F.transform(F.array(value), body)[0]
