"""Benchmark decontamination by greedy string tiling with running Karp-Rabin hashes.

Texts become sequences of lower-case alphanumeric words. Seeds are windows of ``least`` words,
each hashed with a rolling polynomial; a benchmark item of fewer words identifies no passage and matches nothing. Seeds shared by a document and an item lie on diagonals of their match matrix;
neighbouring ones on a diagonal join to maximal matches. Tiling takes the longest match whose words are all unmarked
on both sides, marks it, and repeats; matches that overlap marked words are cut to what is unmarked and queued again, down to ``least``
words. Coverage is the share of the item's words under tiles, so passages whose parts were moved about are caught, too.

Documents are read once, whatever the benchmark's size:

1. the seeds of all items are a table; a bit map of a fixed size over them (``FILTER_BITS``) is broadcast;
2. tasks hash each whole document and keep those with a seed in the map, with these seeds; nothing else of a document is shuffled;
3. these seeds meet the items' in a join. The shared seeds of a pair cover at most so many of the item's words: pairs below the threshold are left there;
4. the texts of the pairs that are left meet, and are tiled.

Nulls: null texts have no words, match nothing and stay. Null item_ids are kept as ids. Repeated benchmark rows (or ids) are tiled as
separate items; repeated document rows each give their rows. Texts of any length are taken whole. Other columns are dropped by ``contaminated``, and kept by
``drop_contaminated`` whatever their names. An empty benchmark, or an empty table, matches nothing.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank_text, cut, slices

LEAST = 5
COVERAGE = 0.5
#: Bits of the map of seeds, a power of two: 8 MB. A larger benchmark lets more foreign seeds pass to the join, and loses none.
FILTER_BITS = 1 << 26
#: Contaminated rows that are broadcast to drop them; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Words whose hashes a worker remembers.
REMEMBERED = 200_000
BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\W_]+")


def word_list(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Hashes, modulo 2**64, of all windows of ``width`` ids."""
    n = len(ids) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        out = out * BASE + ids[k : k + n]
    return out


def tile(item: np.ndarray, doc: np.ndarray, seeds: list[tuple[int, int]], width: int) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in doc, words) from seeds (place in item, place in doc) of ``width`` words each."""
    runs: list[list[int]] = []
    for i, j in sorted(seeds, key=lambda s: (s[1] - s[0], s[0])):
        if not np.array_equal(item[i : i + width], doc[j : j + width]):
            continue  # equal hashes of different words
        if runs and runs[-1][1] - runs[-1][0] == j - i and i <= runs[-1][0] + runs[-1][2] - width + 1:
            runs[-1][2] = i + width - runs[-1][0]
        else:
            runs.append([i, j, width])
    queue = [(-n, i, j) for i, j, n in runs]
    heapq.heapify(queue)
    used_item, used_doc, tiles = np.zeros(len(item), bool), set(), []
    while queue:
        n, i, j = heapq.heappop(queue)
        free = [not used_item[i + k] and j + k not in used_doc for k in range(-n)]
        if all(free):
            tiles.append((i, j, -n))
            used_item[i : i - n] = True
            used_doc.update(range(j, j - n))
            continue
        start = None
        for k, ok in enumerate([*free, False]):
            if ok and start is None:
                start = k
            elif not ok and start is not None:
                if k - start >= width:
                    heapq.heappush(queue, (start - k, i + start, j + start))
                start = None
    return tiles


class _Words(dict):
    """64-bit hashes of words, of which the latest are remembered."""

    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


def seeds_of(words: list[str], least: int, known: dict[str, int]) -> np.ndarray:
    """Hashes of all windows of ``least`` words."""
    return rolling(np.array([known[w] for w in words], np.uint64), least)


def _slot(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and bit of hashes in a map of ``size`` bits; the highest bits of a product, since a rolling hash's own are not mixed."""
    at = (hashes * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - size.bit_length() + 1)
    return at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))


def items_of(benchmark: DataFrame, least: int) -> DataFrame:
    """item (a number), item_id, text, words and seeds (place, seed) of the benchmark's rows with ``least`` words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in slices(batches, "text", 1_000_000):
            found = [word_list(t) for t in batch.column("text").to_pylist()]
            seeds = [seeds_of(ws, least, known).view(np.int64) for ws in found]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("text"), pa.array(map(len, found), pa.int32()), pa.array(seeds, pa.list_(pa.int64()))], ["item_id", "text", "words", "seeds"])

    plain = benchmark.select(F.col("item_id").cast("long").alias("item_id"), blank_text().alias("text"))
    found = plain.mapInArrow(run, "item_id long, text string, words int, seeds array<long>").where(F.col("words") >= least)
    return cut(found.withColumn("item", F.monotonically_increasing_id()), "items")  # the numbers are written with the rows


def seed_map(items: DataFrame, size: int = FILTER_BITS) -> np.ndarray:
    """The bit map of the items' seeds; a task gives a row for each of its 64-bit words that isn't empty, and these are joined by OR."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, bit = _slot(batch.column("seeds").flatten().to_numpy().view(np.uint64), size)
            places, back = np.unique(at, return_inverse=True)
            bits = np.zeros(len(places), np.uint64)
            np.bitwise_or.at(bits, back, bit)
            yield pa.RecordBatch.from_arrays([pa.array(places.view(np.int64)), pa.array(bits.view(np.int64))], ["place", "bits"])

    found = items.select("seeds").mapInArrow(run, "place long, bits long").groupBy("place").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()  # size / 64 rows at most
    out = np.zeros(size // 64, np.uint64)
    out[found.column("place").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def touched(docs: DataFrame, bits: np.ndarray, least: int) -> DataFrame:
    """row (a number), doc_id, text and seeds (distinct) of the documents that have a seed in the map."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in slices(batches, "text", 4_000_000):
            keep, seeds = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                here = seeds_of(word_list(text), least, known)
                place, bit = _slot(here, 64 * len(shared.value))
                hit = here[shared.value[place] & bit != 0]
                if len(hit):
                    keep.append(k)
                    seeds.append(np.unique(hit).view(np.int64))
            if keep:
                kept = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(seeds, pa.list_(pa.int64()))], [*kept.schema.names, "seeds"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = plain.where("text is not null").mapInArrow(run, "doc_id long, text string, seeds array<long>")
    return cut(found.withColumn("row", F.monotonically_increasing_id()), "touched")


def candidates(rows: DataFrame, items: DataFrame, coverage: float, least: int) -> DataFrame:
    """(row, item) of the pairs whose shared seeds can cover ``coverage`` of the item's words."""
    own = items.select("item", F.explode("seeds").alias("seed")).groupBy("seed", "item").agg(F.count(F.lit(1)).alias("times"))
    met = rows.select("row", F.explode("seeds").alias("seed")).join(own, "seed").groupBy("row", "item").agg(F.sum("times").alias("times"))
    return met.join(items.select("item", "words"), "item").where(F.col("times") * least >= F.lit(coverage) * F.col("words")).select("row", "item")


def match(item: list[str], words: list[str], least: int, coverage: float) -> tuple[float, list[tuple[int, int, int]]]:
    """Coverage of an item's words by tiles, and the tiles (none where the words under shared seeds are too few)."""
    names = {w: k for k, w in enumerate(dict.fromkeys(item), 1)}
    a, b = np.array([names[w] for w in item], np.uint64), np.array([names.get(w, 0) for w in words], np.uint64)
    places: dict[int, list[int]] = {}
    for i, h in enumerate(rolling(a, least).tolist()):
        places.setdefault(h, []).append(i)
    hits = [(j, places[h]) for j, h in enumerate(rolling(b, least).tolist()) if h in places]
    under = np.zeros(len(item) + 1, np.int64)
    starts = np.array(sorted({i for _, found in hits for i in found}), np.int64)
    under[starts] += 1
    under[starts + least] -= 1
    if (np.cumsum(under)[:-1] > 0).sum() < coverage * len(item):
        return 0.0, []
    tiles = tile(a, b, [(i, j) for j, found in hits for i in found], least)
    return sum(n for _, _, n in tiles) / len(item), tiles


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, item_id, coverage and tiles (item_place, doc_place, words) of all pairs that reach ``coverage``."""
    return _tiled(docs, benchmark, coverage, least, filter_bits).select("doc_id", "item_id", "coverage", "tiles")


def _tiled(docs: DataFrame, benchmark: DataFrame, coverage: float, least: int, filter_bits: int) -> DataFrame:
    items = items_of(benchmark, least)
    rows = touched(docs, seed_map(items, filter_bits), least)
    pairs = candidates(rows, items, coverage, least)
    texts = pairs.join(items.select("item", "item_id", F.col("text").alias("item_text")), "item").join(rows.select("row", "doc_id", "text"), "row")
    tiles = pa.list_(pa.struct([("item_place", pa.int32()), ("doc_place", pa.int32()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4_000_000):
            found = [match(word_list(a), word_list(b), least, coverage) for a, b in zip(batch.column("item_text").to_pylist(), batch.column("text").to_pylist())]
            shares = pa.array([c for c, _ in found], pa.float64())
            placed = pa.array([[dict(zip(("item_place", "doc_place", "words"), t)) for t in ts] for _, ts in found], tiles)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), batch.column("item_id"), shares, placed], ["doc_id", "text", "item_id", "coverage", "tiles"])

    schema = "doc_id long, text string, item_id long, coverage double, tiles array<struct<item_place:int,doc_place:int,words:int>>"
    return texts.select("doc_id", "text", "item_id", "item_text").mapInArrow(run, schema).where((F.col("coverage") >= coverage) & (F.size("tiles") > 0))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``docs`` without an item that reaches ``coverage``, with the same columns."""
    found = _tiled(docs, benchmark, coverage, least, filter_bits)
    bad = cut(found.select(F.xxhash64("text").alias("_h"), F.length("text").alias("_n"), F.col("doc_id").alias("_d")).distinct(), "contaminated")
    small = bad.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    text = F.col("text").cast("string")
    same = (F.xxhash64(text) == F.col("_h")) & (F.length(text) == F.col("_n")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_d"))
    packed = docs.select(F.struct(*docs.columns).alias("row"), "text", "doc_id")
    return packed.join(F.broadcast(bad) if small else bad, same, "left_anti").select("row.*")
