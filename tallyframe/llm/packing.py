"""Best-fit packing of pieces into sequences of a fixed capacity, in bulk-synchronous rounds.

Pieces of equal length are interchangeable, and so are open sequences (gaps) of equal remaining room. The rounds therefore work on
runs: all waiting pieces of a length by their ranks, and runs of gaps of a size. There are at most ``capacity`` lengths and sizes, however many
documents there are, so that the rounds' state is a table of bounded size. What grows with the input is distributed: counting the lengths, ranking the pieces
within their length (salted shares with prefix sums, so that a hot length is no single task) and looking their places up.

A round range-sorts waiting lengths and gaps and sweeps for each length's successor, the smallest gap that it fits. Several lengths may want
the same gap: they are ranked by length, the longest first, and each is served from what those before it leave; the rest waits. A served length fills
each of its sequences as often as it fits, as best fit would. After the sweep the gaps are updated, and the next round begins. When nothing fits, new
sequences are opened: one for every piece of more than half the capacity at first, afterwards as many as the waiting volume needs at least.

As Spark jobs the rounds' sweeps took 272 s for 10,000 documents, nearly all of it the latency of some hundred jobs over some
hundred rows each; so the sweeps over these classes run on the driver.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rank_within

#: The pieces of length ``size`` and ranks ``first`` to ``first + n - 1`` go, ``per_bin`` to each, to the sequences from ``bin`` on, from ``offset`` in each.
RUNS = "size long, first long, n long, bin long, offset long, per_bin long"


def plan_runs(lengths: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Placements of runs (see ``RUNS``) for so many pieces of each length (1 to ``capacity``)."""
    waiting = {size: [0, n] for size, n in lengths.items() if n}
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # size: runs (first sequence, how many)
    placed: list[tuple[int, int, int, int, int, int]] = []
    next_bin, opened = 0, False

    def place(size: int, bins: int, per_bin: int, start: int, offset: int, fresh: dict) -> None:
        """``bins`` sequences from ``start`` on get ``per_bin`` pieces each, from ``offset``."""
        first, n = waiting[size]
        placed.append((size, first, bins * per_bin, start, offset, per_bin))
        waiting[size] = [first + bins * per_bin, n - bins * per_bin]
        room = capacity - offset - size * per_bin
        if room:
            fresh[room].append((start, bins))

    while waiting:
        fresh: dict[int, list[tuple[int, int]]] = defaultdict(list)
        sizes = sorted(gaps)
        served = False
        for size in sorted(waiting, reverse=True):
            at = bisect_left(sizes, size)
            if at == len(sizes):
                continue
            gap = sizes[at]
            while waiting[size][1] and gaps[gap]:
                per_bin = min(gap // size, waiting[size][1])
                start, n = gaps[gap].pop()
                bins = min(n, waiting[size][1] // per_bin)
                if bins < n:
                    gaps[gap].append((start + bins, n - bins))
                place(size, bins, per_bin, start, capacity - gap, fresh)
                served = True
        if not served:
            volume = -(-sum(size * n for size, (_, n) in waiting.items()) // capacity)
            asked = 0
            for size in sorted(waiting, reverse=True):
                if not opened and size * 2 <= capacity or opened and asked and asked + -(-waiting[size][1] // (capacity // size)) > volume:
                    break
                while waiting[size][1]:  # full sequences, then one with what is left
                    per_bin = min(capacity // size, waiting[size][1])
                    bins = waiting[size][1] // per_bin
                    place(size, bins, per_bin, next_bin, 0, fresh)
                    next_bin, asked = next_bin + bins, asked + bins
            opened = True
        for size, runs in fresh.items():
            gaps[size] += runs
        gaps = defaultdict(list, {size: runs for size, runs in gaps.items() if runs})
        waiting = {size: w for size, w in waiting.items() if w[1]}
    return placed


def best_fit_pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces`` (doc_id, piece, length, ...).

    Lengths are 1 to ``capacity``; other rows, null lengths included, raise an error. Repeated rows are separate pieces. Within a
    sequence the pieces lie without gaps from offset 0. An empty table gives an empty one. Other columns are kept whatever their names; only
    ``sequence_id`` and ``offset`` are replaced.
    """
    wrong = F.col("length").isNull() | ~F.col("length").between(1, capacity)
    length = F.when(wrong, F.raise_error(F.lit("a piece's length must be from 1 to the capacity"))).otherwise(F.col("length")).cast("long")
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    checked = pieces.select(F.struct(*kept).alias("row"), "doc_id", "piece", length.alias("length"))
    ranked = rank_within(checked, "length", ["doc_id", "piece"])
    lengths = {r.length: r.n for r in checked.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    runs = pieces.sparkSession.createDataFrame(plan_runs(lengths, capacity), RUNS)
    by_length = runs.groupBy(F.col("size").alias("length")).agg(F.sort_array(F.collect_list(F.struct("first", "n", "bin", "offset", "per_bin"))).alias("runs"))
    run = F.filter("runs", lambda r: (r.first <= F.col("rank")) & (F.col("rank") < r.first + r.n))[0]
    placed = ranked.join(F.broadcast(by_length), "length").withColumn("run", run).withColumn("within", F.col("rank") - F.col("run.first"))
    return placed.select(
        *[F.col(f"row.`{c}`").alias(c) for c in kept],
        F.expr("run.bin + within div run.per_bin").alias("sequence_id"),
        F.expr("run.offset + within % run.per_bin * length").alias("offset"),
    )
