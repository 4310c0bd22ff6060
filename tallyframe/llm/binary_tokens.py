"""Token ids as flat binary files with 64-bit document offsets, memory-mapped for reading.

Layout of a written set, in ascending ``(doc_id, text)`` order over its parts:

``part-00000.bin``  all ids of the part, flat little-endian unsigned 16- or 32-bit integers
``part-00000.off``  one more than documents: little-endian 64-bit offsets into the part, in ids
``part-00000.doc``  little-endian 64-bit ``doc_id`` of each document (the least value stands for null)

Each part is written by one task. A part's base, the number of ids in all parts before it, is a prefix sum over the
parts' sizes, so no task waits for another and base + offset is a document's place in the whole set.

Nulls: a null text is empty and leaves only the end id; a null doc_id sorts first and is read back as null.
Repeated rows and repeated ids are kept, each as a document of its own. An empty table gives no parts.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blank_text, scratch, slices
from .documents_tokens import SLICE_BYTES
from .tokens import encoder

NULL_ID = np.iinfo(np.int64).min
#: Documents that a task reads back at a time.
READ_DOCUMENTS = 1000
PARTS = "part int, documents long, ids long, width int"


def _store(folder: str):
    """File system and path of ``folder``; a plain or file:// path needs no more than a shared mount."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


class _Part:
    """The three files of a part, written as their rows come, under names of this attempt; ``publish`` renames them when they are whole."""

    def __init__(self, store, path: str):
        self.store, self.path, self.mine = store, path, uuid.uuid4().hex
        self.files = {end: store.open_output_stream(f"{path}.{end}.{self.mine}") for end in ("bin", "off", "doc")}

    def write(self, end: str, data: bytes) -> None:
        self.files[end].write(data)

    def publish(self) -> None:
        for end, file in self.files.items():
            file.close()
            self.store.move(f"{self.path}.{end}.{self.mine}", f"{self.path}.{end}")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Encode ``docs`` (doc_id, text), append ``end_id`` to each, write the files; returns the parts with their bases.

    ``folder`` must be seen by all executors and the driver. The returned rows (one a part) are the set's index:
    part, documents, ids, width, base.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        number, part, documents, at = TaskContext.get().partitionId(), None, 0, 0
        for batch in slices(batches, "text", SLICE_BYTES):
            if part is None:
                store, root = _store(folder)
                part = _Part(store, f"{root}/part-{number:05d}")
                part.write("off", np.zeros(1, "<i8").tobytes())
            encoded = enc.encode(batch.column("text").to_pylist())
            ends = at + np.cumsum([(len(x) + len(end)) // enc.dtype.itemsize for x in encoded])
            part.write("bin", b"".join([x + end for x in encoded]))
            part.write("off", ends.astype("<i8").tobytes())
            part.write("doc", batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            documents, at = documents + len(encoded), int(ends[-1])
        if part is not None:
            part.publish()
            yield pa.RecordBatch.from_pydict({"part": pa.array([number], pa.int32()), "documents": [documents], "ids": [at], "width": pa.array([enc.dtype.itemsize], pa.int32())})

    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    # Ties are dealt out by a hash of the text and the row's place, so that one repeated id doesn't make one task.
    ordered = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), blank_text().alias("text"), (F.monotonically_increasing_id() % 997).alias("row")
    ).withColumn("tie", F.xxhash64("text"))
    ranged = ordered.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")
    parts = ranged.select("doc_id", "text").mapInArrow(write, PARTS).collect()  # one small row a part
    rows, base = [], 0
    for p in sorted(parts):
        rows.append((p.part, p.documents, p.ids, p.width, base))
        base += p.ids
    return docs.sparkSession.createDataFrame(rows, PARTS + ", base long")


def read_tokens(parts: DataFrame, folder: str) -> DataFrame:
    """Map the files into memory and return doc_id, start, n_tokens and ids_crc32 (of 32-bit ids) of every document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)

        def mapped(path: str, kind: str, first: int, n: int) -> np.ndarray:
            size = np.dtype(kind).itemsize
            if not n:
                return np.zeros(0, kind)
            if store.type_name == "local":
                return np.memmap(path, dtype=kind, mode="r", offset=first * size, shape=(n,))
            with store.open_input_file(path) as f:  # a range of the object
                return np.frombuffer(f.read_at(n * size, first * size), dtype=kind)

        for batch in batches:
            for row in batch.to_pylist():
                path, kind = f"{root}/part-{row['part']:05d}", f"<u{row['width']}"
                for first in range(0, row["documents"], READ_DOCUMENTS):
                    n = min(READ_DOCUMENTS, row["documents"] - first)
                    offsets, names = mapped(f"{path}.off", "<i8", first, n + 1), mapped(f"{path}.doc", "<i8", first, n)
                    ids = mapped(f"{path}.bin", kind, int(offsets[0]), int(offsets[-1] - offsets[0]))
                    at = (offsets - offsets[0]).tolist()
                    crc = [zlib.crc32(ids[a:b].astype("<u4").data) for a, b in zip(at[:-1], at[1:])]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(np.array(names), mask=np.array(names == NULL_ID)),
                            "start": np.array(offsets[:-1]) + row["base"],
                            "n_tokens": np.diff(offsets),
                            "ids_crc32": pa.array(crc, pa.int64()),
                        }
                    )

    return parts.repartitionByRange(max(1, parts.count()), "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_to_files(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` to a fresh set in the shared folder and read it back."""
    folder = scratch(spark, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer, end_id), folder)
