"""Near-duplicates by SimHash and the generalised pigeonhole principle.

Fingerprints: texts with A-Z in lower case, words, 3-word shingles with repeats (fewer words: the whole sequence), XXH64 with
seed 42; a bit is set if it is set in more than half of the hashes. A text without words has fingerprint 0, linked like any other.

Search for all pairs of distinct fingerprints that differ in at most ``radius`` bits:

1. Bits are put into partitions so that correlated bits share one: what varies together then wastes only one partition.
2. Each partition i gets its own threshold t_i (-1: not probed) with sum(t_i) = radius - partitions + 1. By the generalised
   pigeonhole principle a pair within the radius is within t_i in at least one partition. Dynamic programming chooses the
   thresholds of the least estimated number of candidates (bucket sizes are counted, larger radii estimated from bit frequencies).
3. Probes, a fingerprint's partition with up to t_i bits flipped, are joined with the exact partitions, and pairs are verified.

Buckets of more than ``bucket`` fingerprints would give pairs by the square. Their members, and what probes them, take an exact
way of linear size instead: each emits itself and its one-bit neighbours (radius 2: two fingerprints are within 2 bits if and only if they
share one of these), and all that meet in a neighbour are linked to the least of them. No link is lost.

Links are between distinct fingerprints, so copies cost nothing. Components come from rounds of large-star and small-star
contraction, each round cut to the shared folder.

Nulls: a null text has no words; null doc_ids count last, a group of nothing else has a null component_id. Repeated rows each get a row. Texts of any length
are hashed whole. Other columns, whatever their names, are dropped by ``near_duplicates`` and kept by ``keep_one``. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank_text, cut

BITS = 64
RADIUS = 2
PARTITIONS = 3
BUCKET = 32


def _fingerprints_of(texts: list[str], width: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        found = text.encode().lower().split()  # bytes: only A-Z change, only x20 and x09-x0D separate
        if not found:
            continue
        if len(found) < width:
            shingles = [b" ".join(found)]
        else:
            joined = b" ".join(found)
            ends = np.cumsum([len(w) + 1 for w in found]).tolist()
            starts = [0, *ends]
            shingles = [joined[a : b - 1] for a, b in zip(starts, ends[width - 1 :])]
        hashes = np.array([xxh64_intdigest(s, 42) for s in shingles], dtype="<u8")
        bits = np.zeros(BITS, np.int64)
        for at in range(0, len(hashes), 1 << 16):
            part = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            bits += part.sum(axis=0, dtype=np.int32)
        out[k] = np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, h (64-bit hash of the text, null for a null text) and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _fingerprints_of(batch.column("text").to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(found.view(np.int64))], ["doc_id", "h", "fp"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("h"), blank_text().alias("text"))
    return plain.mapInArrow(run, "doc_id long, h long, fp long")


def text_key() -> Column:
    return F.when(F.col("text").isNotNull(), F.xxhash64("text"))


def _bit_moments(distinct: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of fingerprints, share of ones of each bit, and the bits' correlations, over all fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            values = batch.column("fp").to_numpy(zero_copy_only=False).astype("<i8")
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n, both = n + len(bits), both + (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"n": [n], "both": [both.ravel().tolist()]})

    parts = distinct.mapInArrow(run, "n long, both array<long>")
    row = parts.select("n", F.posexplode("both")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").alias("v")).collect()  # 4,096 rows
    both = np.zeros(BITS * BITS)
    for r in row:
        both[r.pos] = r.v
    n = max(1, row[0].n if row else 1)
    both = both.reshape(BITS, BITS) / n
    ones = np.diag(both)
    spread = np.sqrt(np.maximum(ones * (1 - ones), 1e-9))
    return n, ones, (both - np.outer(ones, ones)) / np.outer(spread, spread)


def group_bits(correlation: np.ndarray, partitions: int) -> list[list[int]]:
    """Partitions of about equal size: each is grown by the bit that correlates most with its members."""
    left, strength, out = set(range(BITS)), np.abs(correlation), []
    for k in range(partitions):
        size = BITS // partitions + (k < BITS % partitions)
        group = [max(left, key=lambda b: (strength[b, sorted(left)].sum(), -b))]
        left.discard(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (strength[b, group].sum(), -b))
            group.append(best)
            left.discard(best)
        out.append(sorted(group))
    return out


def allocate(costs: list[dict[int, float]], radius: int) -> list[int]:
    """Thresholds (-1 to radius) that sum up to radius - partitions + 1 at the least total cost."""
    best = {0: (0.0, [])}
    for cost in costs:
        then: dict[int, tuple[float, list[int]]] = {}
        for (total, (c, chosen)), t in product(best.items(), range(-1, radius + 1)):
            now = (c + cost[t], [*chosen, t])
            if total + t not in then or now < then[total + t]:
                then[total + t] = now
        best = then
    return best[radius - len(costs) + 1][1]


def _masks(bits: list[int], t: int) -> list[int]:
    """Signed 64-bit masks that flip up to ``t`` of ``bits``."""
    found = [sum(1 << b for b in chosen) for k in range(t + 1) for chosen in combinations(bits, k)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def _part_keys(groups: list[list[int]]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("key")) for i, g in enumerate(groups)])


def links(distinct: DataFrame, radius: int = RADIUS, partitions: int = PARTITIONS, bucket: int = BUCKET) -> DataFrame:
    """(a, b), a < b: enough pairs of fingerprints (column fp, distinct) within ``radius`` bits to connect all such pairs."""
    if radius != 2:
        raise ValueError("the way of large buckets is written for a radius of 2")
    n, ones, correlation = _bit_moments(distinct)
    groups = group_bits(correlation, partitions)
    index = distinct.select("fp", F.explode(_part_keys(groups)).alias("k")).select("fp", "k.part", "k.key")
    sizes = index.groupBy("part", "key").agg(F.count(F.lit(1)).alias("size"))
    counted = {r.part: float(r.pairs) for r in sizes.groupBy("part").agg(F.sum(F.col("size").cast("double") * (F.col("size") - 1)).alias("pairs")).collect()}
    differ = 2 * ones * (1 - ones)
    costs = []
    for i, g in enumerate(groups):
        odds = differ[g] / (1 - differ[g])
        one, two = odds.sum(), (odds.sum() ** 2 - (odds**2).sum()) / 2
        base = counted.get(i, 0.0) + 1.0
        probes = lambda t, g=g: n * len(_masks(g, t))  # noqa: E731  each probe is a row, too
        costs.append({-1: 0.0, 0: base + probes(0), 1: base * (1 + one) + probes(1), 2: base * (1 + one + two) + probes(2)})
    thresholds = allocate(costs, radius)
    sizes = sizes.where("size > 1") if max(thresholds) == 0 else sizes

    probed = []
    for i, (g, t) in enumerate(zip(groups, thresholds)):
        if t >= 0:
            flips = F.explode(F.array(*[F.lit(m) for m in _masks(g, t)]))
            probed.append(distinct.select("fp", F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("own"), flips.alias("flip")).select("fp", "part", F.col("own").bitwiseXOR(F.col("flip")).alias("key")))
    probes = cut(reduce(DataFrame.unionByName, probed).join(sizes, ["part", "key"]), "probes")
    small, large = probes.where(F.col("size") <= bucket), probes.where(F.col("size") > bucket)
    pairs = (
        small.select("part", "key", F.col("fp").alias("a"))
        .join(index.select("part", "key", F.col("fp").alias("b")), ["part", "key"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
        .select("a", "b")
    )
    # What probes a large bucket, and its members: probes of threshold 0 are the members, with other thresholds these are added.
    members = index.join(sizes.where(F.col("size") > bucket).select("part", "key"), ["part", "key"], "left_semi").select("fp")
    hot = large.select("fp").union(members).distinct() if max(thresholds) > 0 else large.select("fp").distinct()
    near = hot.select("fp", F.explode(F.array(F.lit(0).cast("long"), *[F.lit(m) for m in _masks(list(range(BITS)), 1)[1:]])).alias("flip"))
    near = near.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    centre = near.groupBy("at").agg(F.min("fp").alias("a"), F.max("fp").alias("most")).where("a < most").select("at", "a")
    starred = near.join(centre, "at").where(F.col("a") < F.col("fp")).select("a", F.col("fp").alias("b"))
    return pairs.union(starred).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of ``edges`` (a, b) can reach; roots have no row of their own."""
    now, before = cut(edges.select("a", "b"), "edges"), None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").where("a < b")
        down = large.distinct().select(F.col("b").alias("u"), F.col("a").alias("v"))  # v < u
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        star = down.join(lowest, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b")
        now = cut(star.union(lowest.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct(), "edges")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.expr("bit_xor(xxhash64(a, b))")).first())
        if state == before:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, h, fp, root (the least fingerprint of the component) and component_id (the smallest doc_id reachable over links of fingerprints) of every row."""
    rows = cut(fingerprints(docs), "fingerprints")
    first = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(first.select("fp"), **limits))
    owned = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = owned.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(owned.select("fp", "root").join(least, "root"), "fp")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, **limits) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest doc_id, of equal ones that with the least hash of its text."""
    found = near_duplicates(docs, **limits)
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", F.col("h").isNotNull().alias("full"), "h")
    # Components are told apart by their root: one doc_id may stand on rows of several, and on rows without any.
    chosen = found.groupBy("root").agg(F.min(order).alias("o")).select("o.doc_id", "o.h")
    keys = chosen.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("_id"), F.coalesce(F.col("h").cast("string"), F.lit("-")).alias("_h")).distinct()
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")).alias("_id"), F.coalesce(text_key().cast("string"), F.lit("-")).alias("_h"))
    kept = packed.join(keys, ["_id", "_h"], "left_semi")
    repeated = found.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if repeated:  # equal rows: one of them stays
        kept = kept.dropDuplicates(["_id", "_h"])
    return kept.select("_row.*")
