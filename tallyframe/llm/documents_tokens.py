"""Documents as pieces of token ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank_text, slices
from .tokens import REMEMBERED, encoder

#: Bytes of text whose ids a task holds at a time (or one longer text).
SLICE_BYTES = 4_000_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """Ids of every whole text and ``end_id`` behind them, cut after each ``capacity`` ids.

    Returns doc_id, piece, start, length, ids_crc32 (of little-endian 32-bit ids) and, if asked for, the ids. A null
    text counts as empty: one piece, of the end id alone. Repeated rows give their pieces each time. Other columns are dropped, whatever their names.
    ``remembered`` words are kept by each worker; the number changes memory and speed, never an id.
    """

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, remembered)
        for batch in slices(batches, "text", SLICE_BYTES):
            rows: list[tuple] = []
            flat: list[np.ndarray] = []
            for doc_id, encoded in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist())):
                ids = np.append(np.frombuffer(encoded, enc.dtype).astype("<u4"), np.uint32(end_id))
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((doc_id, k, start, len(part), zlib.crc32(part.data)))
                if with_ids:
                    flat.append(ids.view("<i4"))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            if with_ids:
                ends = np.cumsum([0, *(r[3] for r in rows)], dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat))))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), blank_text().alias("text")).mapInArrow(cut_up, PIECE + ", ids array<int>" * with_ids)
