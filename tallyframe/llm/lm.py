"""Language-model scoring by context-tree weighting over bytes.

A text is its bytes with A-Z in lower case and an end byte 0xFF, which UTF-8 never uses; contexts before its beginning are 0xFF, too.
Each byte is decomposed into eight binary decisions, each with its own tree of contexts: the 0 to ``depth`` bytes before.
A node with z zeros and o ones in training has the Krichevsky-Trofimov estimate
Pe = G(z+1/2) G(o+1/2) / (pi G(z+o+1)), and weights itself against its children, Pw = (Pe + prod Pw(children)) / 2 (deepest: Pw = Pe).
The probability of a bit follows the path of its contexts: p_d = a_d (bit's count + 1/2) / (z+o+1) + (1 - a_d) p_(d+1), a_d = Pe / (2 Pw).
So all depths are mixed, each by how well it explained the corpus. The code length per byte is -log2(score) / bytes.

All of it are counts. Documents are written in blocks of about ``block_bytes``; tasks count the distinct (depth+1)-byte windows of each block, with
count 0 for those of held-out documents only, so that every window has its probability. One shuffle deals these counts by the last ``SHARED`` bytes
of the context: all longer contexts that end in them are then in one task, which adds up the blocks' counts and builds that part of the tree from
sorted arrays. Only the shorter contexts meet elsewhere, at most 255 * 256 ** 2 nodes at any size of the corpus; their part of each path goes back
to all tasks. Each part then computes its windows' probabilities and sends them to the blocks that have the windows, where they meet the documents
in a cogroup. A task holds ``PART_ROWS`` counts, or those of one ending if there are more of them; nothing is pruned or rounded.

Words are looked up alike, by their 64-bit hashes, for the base score. Nulls: a null text is empty (one end token, one end byte); a null doc_id counts
as empty text for the choice of held-out documents. Repeated rows each get a row. Without training documents every window has p = 1/2 a bit. A text of any length
is scored whole; one beyond ``block_bytes`` is a block by itself. Other columns are dropped, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank_text, cut, remainder_of_id

DEPTH = 5
BLOCK_BYTES = 32_000_000
#: Bytes of text whose windows are in a task's memory at a time.
PART_BYTES = 2_000_000
#: Counts that a task has in memory at a time.
PART_ROWS = 500_000
#: Bytes of context that all windows in a task's hands share.
SHARED = 3
END = 0xFF
WINDOW, WORD = 0, 1


def _lower(text: str) -> bytes:
    return text.encode().lower()  # bytes: A-Z only


def _windows(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that end in each byte and end byte of each text, as integers, and the number of windows of each text."""
    edge = bytes([END])
    flat = np.frombuffer(b"".join([edge * depth + t + edge for t in texts]), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    code = np.zeros(len(flat) - depth, np.int64)
    for k in range(depth + 1):
        code = (code << 8) | flat[k : len(flat) - depth + k]
    # Of each text's sizes + depth bytes, the windows that begin at the first of its sizes ones are its own.
    inside = np.ones(len(flat), bool)
    starts = np.cumsum(sizes + depth) - depth
    for k in range(depth):
        inside[starts + k] = False
    return code[inside[: len(code)]], sizes


def _word_hash(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(w) for w in words], np.uint64).view(np.int64)


#: Words never are empty, so this stands for the end token.
_END_TOKEN = b""


def _sum_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, back = np.unique(keys, return_inverse=True)
    return found, np.bincount(back, weights=counts, minlength=len(found)).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list[bytes], list[bool]]]:
    """Texts and their held-out marks, some ``limit`` bytes at a time (or one longer text)."""
    texts, held, size = [], [], 0
    for batch in batches:
        for text, out in zip(batch.column("text").to_pylist(), batch.column("held_out").to_pylist()):
            texts.append(_lower(text))
            held.append(out)
            size += len(texts[-1])
            if size > limit:
                yield texts, held
                texts, held, size = [], [], 0
    if texts:
        yield texts, held


class _Lookup:
    """Values of known integer keys: a table by a multiplicative hash, and binary search for keys that lost their slot to another."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(4, int(len(keys)).bit_length() + 2))
        self.slots = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.slots[self._slot(self.keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(keys)]
        lost = np.flatnonzero(self.keys[at] != keys)
        at[lost] = np.searchsorted(self.keys, keys[lost])
        return self.values[at]


def _pack(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def _unpack(raw: bytes, size: int, dtype) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, size * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype)


def _steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


@cache
def _small(half: bool) -> np.ndarray:
    return np.array([lgamma(n + (0.5 if half else 1.0)) for n in range(1 << 16)])


def _log_gamma(n: np.ndarray, half: bool) -> np.ndarray:
    """Natural logarithm of the gamma function at n + 1/2 or n + 1: a table, and Stirling's series for the large."""
    table = _small(half)
    out = table[np.minimum(n, len(table) - 1).astype(np.int64)]
    large = np.flatnonzero(n >= len(table))
    if len(large):
        y = n[large] + (0.5 if half else 1.0)
        out[large] = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3)
    return out


def _weigh(total: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """log Pw and a of nodes, from the sum of their children's log Pw (None: deepest)."""
    own = _log_gamma(total - ones, True) + _log_gamma(ones, True) - _log_gamma(total, False) - 1.1447298858494002
    if below is None:
        return own, np.ones(len(own))
    weighted = np.logaddexp(own, below) - 0.6931471805599453
    return weighted, np.exp(own - weighted) / 2


def _low(values: np.ndarray, n_bytes: int) -> np.ndarray:
    return values & ((1 << (8 * n_bytes)) - 1)


def _nodes(pairs: np.ndarray, k: int) -> np.ndarray:
    """Nodes: a context's bytes, then a 1 and the first k bits of the byte."""
    return ((pairs >> 8) << 8) | (((pairs & 255) | 256) >> (8 - k))


class _Part:
    """The tree's contexts of ``top`` to ``depth`` bytes, from all windows (sorted) of some endings of ``top`` bytes."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, depth: int, top: int):
        self.top = top
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]] = [(keys, n.astype(np.float64), None)]  # pairs of context and byte, counts, places of the pairs before
        for d in range(depth - 1, top - 1, -1):
            pairs, back = np.unique(_low(self.levels[-1][0], d + 1), return_inverse=True)
            self.levels.append((pairs, np.bincount(back, weights=self.levels[-1][1], minlength=len(pairs)), back))

    def _climb(self, k: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Of each level, deepest first: its pairs' nodes, the nodes' first pairs, total, ones, log Pw and a."""
        first = weighted = None
        for pairs, n, back in self.levels:
            fresh = np.ones(len(pairs), bool)
            fresh[1:] = np.diff(pairs >> (8 - k)) != 0
            node = np.cumsum(fresh) - 1
            below = None if back is None else np.bincount(node[back[first]], weights=weighted, minlength=node[-1] + 1)
            first = np.flatnonzero(fresh)
            total, ones = np.add.reduceat(n, first), np.add.reduceat(n * (pairs >> (7 - k) & 1), first)
            weighted, a = _weigh(total, ones, below)
            yield node, first, total, ones, weighted, a

    def above(self) -> tuple[np.ndarray, ...]:
        """What the nodes of one byte less get from this part: node, total, ones and the sum of the children's log Pw."""
        out = []
        for k in range(8):
            for _, first, total, ones, weighted, _ in self._climb(k):  # the last is the shortest
                pass
            node, back = np.unique(_low(_nodes(self.levels[-1][0][first], k), self.top), return_inverse=True)
            out.append((node, *(np.bincount(back, weights=x, minlength=len(node)) for x in (total, ones, weighted))))
        return tuple(np.concatenate(c) for c in zip(*out))

    def log2(self, node: np.ndarray, p: np.ndarray, left: np.ndarray) -> np.ndarray:
        """log2 of each window's probability; the shorter contexts' share of P(bit = 1) and the weight left for longer ones by (sorted) node."""
        out = np.zeros(len(self.levels[0][0]))
        for k in range(8):
            q = None
            for (pairs, _, back), (place, _, total, ones, _, a) in zip(self.levels, self._climb(k)):
                hits = np.where(pairs >> (7 - k) & 1, ones[place], (total - ones)[place])
                share, a = (hits + 0.5) / (total[place] + 1), a[place]
                if back is None:
                    q, at = share, slice(None)
                else:
                    at = back[at]
                    q = (a * share)[at] + (1 - a)[at] * q
            if self.top:
                found = np.searchsorted(node, _low(_nodes(pairs, k), self.top))
                q = np.where(pairs >> (7 - k) & 1, p[found], 1 - left[found] - p[found])[at] + left[found][at] * q
            out += np.log2(q)
        return out


def _crown(node: np.ndarray, total: np.ndarray, ones: np.ndarray, below: np.ndarray, top: int) -> tuple[np.ndarray, ...]:
    """The contexts of less than ``top`` bytes, from what the parts give: node (sorted), share of P(bit = 1), weight left."""
    levels = []
    for d in range(top - 1, -1, -1):
        node, back = np.unique(_low(node, d + 1), return_inverse=True)
        total, ones, below = (np.bincount(back, weights=x, minlength=len(node)) for x in (total, ones, below))
        weighted, a = _weigh(total, ones, below)
        levels.append((node, a, (ones + 0.5) / (total + 1)))
        below = weighted
    node, p, left = np.zeros(1, np.int64), np.zeros(1), np.ones(1)
    for d, (own, a, share) in enumerate(reversed(levels)):
        at = np.searchsorted(node, _low(own, d)) if d else np.zeros(len(own), np.int64)
        node, p, left = own, p[at] + left[at] * a * share, left[at] * (1 - a)
    return node, p, left


def block_counts(docs: DataFrame, depth: int) -> DataFrame:
    """(block, kind, key, n): how often each block's windows and words are in its training documents; 0 for those of others only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, held, size, keys, counts, words = None, [], [], 0, [], [], Counter()

        def count() -> None:
            nonlocal texts, held, size, keys, counts
            for marked in (False, True):
                part = [t for t, h in zip(texts, held) if h == marked]
                if part:
                    code, n = np.unique(_windows(part, depth)[0], return_counts=True)
                    keys.append(code)
                    counts.append(n * (not marked))
                for t in part:
                    if marked:
                        words.update(dict.fromkeys(t.split(), 0))
                    else:
                        words.update(t.split())
                words[_END_TOKEN] += len(part) * (not marked)
            texts, held, size = [], [], 0
            if len(keys) > 8:
                k, n = _sum_up(np.concatenate(keys), np.concatenate(counts))
                keys, counts = [k], [n]

        def emit() -> Iterator[pa.RecordBatch]:
            count()
            k, n = _sum_up(np.concatenate(keys), np.concatenate(counts))
            for kind, k, n in ((WINDOW, k, n), (WORD, _word_hash(list(words)), np.array(list(words.values()), np.int64))):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), now)), pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n)], ["block", "kind", "key", "n"])

        for batch in batches:
            for block, text, out in zip(*(batch.column(c).to_pylist() for c in ("block", "text", "held_out"))):
                if block != now and now is not None:
                    yield from emit()
                    keys, counts, words = [], [], Counter()
                now = block
                texts.append(_lower(text))
                held.append(out)
                size += len(texts[-1])
                if size > PART_BYTES:
                    count()
        if now is not None:
            yield from emit()

    return docs.select("block", "text", "held_out").mapInArrow(run, "block long, kind int, key long, n long")


_PARTS = "kind int, n_keys long, n_rows long, keys binary, n binary, at binary, blocks binary, tokens long, vocabulary long, n_nodes long, nodes binary, total binary, ones binary, below binary"


def tree_parts(counts: DataFrame, depth: int, tasks: int, part_rows: int = PART_ROWS) -> DataFrame:
    """Dealt to ``tasks`` tasks: packed rows, each with all counts of some endings of contexts (or of some words): the keys' sums, the blocks that have them, and what the tree above needs."""
    top = min(depth, SHARED)

    def ending(kind: np.ndarray, key: np.ndarray) -> np.ndarray:
        return np.where(kind == WINDOW, _low(key >> 8, top), key)

    def pack(kind: int, block: np.ndarray, key: np.ndarray, n: np.ndarray) -> dict:
        keys, at = np.unique(key, return_inverse=True)
        sums = np.bincount(at, weights=n, minlength=len(keys)).astype(np.int64)
        order = np.lexsort((at, block))
        block, at = block[order], at[order]
        row = {"kind": kind, "n_keys": len(keys), "n_rows": len(at), "keys": _pack(_steps(keys)), "n": _pack(sums), "at": _pack(_steps(at.astype(np.int64))), "blocks": _pack(_steps(block))}
        node = total = ones = below = np.zeros(0)
        if kind == WINDOW and top:
            node, total, ones, below = _Part(keys, sums, depth, top).above()
        words = sums if kind == WORD else sums[:0]
        row |= {"tokens": int(words.sum()), "vocabulary": int((words > 0).sum()), "n_nodes": len(node)}
        return row | {"nodes": _pack(node.astype(np.int64)), "total": _pack(total), "ones": _pack(ones), "below": _pack(below)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def ready(last: bool) -> Iterator[pa.RecordBatch]:
            """Packs all but the last ending, which may go on in the next batch."""
            nonlocal held
            kind, block, key, n = (np.concatenate(c) for c in zip(*held))
            end = ending(kind, key)
            changes = np.flatnonzero((np.diff(end) != 0) | (np.diff(kind) != 0)) + 1
            whole = len(key) if last else int(changes[-1]) if len(changes) else 0
            for k in (WINDOW, WORD):
                own = np.flatnonzero(kind[:whole] == k)
                if len(own):
                    yield pa.RecordBatch.from_pylist([pack(k, block[own], key[own], n[own])], schema)
            held = [(kind[whole:], block[whole:], key[whole:], n[whole:])]

        schema = pa.schema([(name, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[kind]) for name, kind in (c.split() for c in _PARTS.split(", "))])
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in ("kind", "block", "key", "n")))
            size += batch.num_rows
            if size > part_rows:
                size = 0  # tries again after as many rows more
                yield from ready(False)
        if held:
            yield from ready(True)

    by = F.when(F.col("kind") == WINDOW, F.shiftright("key", 8).bitwiseAND(F.lit((1 << (8 * top)) - 1))).otherwise(F.col("key"))
    return counts.repartition(tasks, "kind", by).sortWithinPartitions("kind", by).mapInArrow(run, _PARTS)


def crown_of(parts: DataFrame, top: int) -> tuple[np.ndarray, ...]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_unpack(row[c], row["n_nodes"], t)) for c, t in zip(names, (np.int64, *[np.float64] * 3))], ["node", *names[1:]])

    names = ["nodes", "total", "ones", "below"]
    nodes = parts.where(F.col("n_nodes") > 0).select("n_nodes", *names).mapInArrow(run, "node long, total double, ones double, below double")
    found = nodes.groupBy("node").agg(*[F.sum(c).alias(c) for c in names[1:]]).toArrow()
    return _crown(*(found.column(c).to_numpy() for c in ("node", *names[1:])), top)


def block_values(parts: DataFrame, crown: tuple[np.ndarray, ...], depth: int) -> DataFrame:
    """(block, kind, size, keys, value): packed, log2 of the probability of each block's windows and the counts of its words."""
    top = min(depth, SHARED)
    shared = parts.sparkSession.sparkContext.broadcast(crown)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, n = np.cumsum(_unpack(row["keys"], row["n_keys"], np.int64)), _unpack(row["n"], row["n_keys"], np.int64)
                at, block = (np.cumsum(_unpack(row[c], row["n_rows"], np.int64)) for c in ("at", "blocks"))
                value = n.astype(np.float64) if row["kind"] == WORD else _Part(keys, n, depth, top).log2(*shared.value)
                starts = np.flatnonzero(np.diff(block, prepend=block[0] - 1))
                packed = [(_pack(_steps(keys[own])), _pack(value[own])) for own in np.split(at, starts[1:])]
                sizes = np.diff(starts, append=len(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block[starts]), pa.array(np.full(len(starts), row["kind"], np.int32)), pa.array(sizes), pa.array([k for k, _ in packed], pa.binary()), pa.array([v for _, v in packed], pa.binary())],
                    ["block", "kind", "size", "keys", "value"],
                )

    return parts.select("kind", "n_keys", "n_rows", "keys", "n", "at", "blocks").mapInArrow(run, "block long, kind int, size long, keys binary, value binary")


def score_documents(docs: DataFrame, held_out: Column, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row of ``docs``."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ids = []
            for n in pa.compute.binary_length(batch.column("text")).to_pylist():
                if size > block_bytes:
                    block, size = block + 1, 0
                ids.append(block)
                size += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64())], [*batch.schema.names, "block"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), blank_text().alias("text"), held_out.alias("held_out"))
    plain = cut(plain.mapInArrow(number, "doc_id long, text string, held_out boolean, block long"), "documents")
    # Tasks grow in number with the blocks, not in size with the input; twice as many, since hashes deal blocks unevenly.
    tasks = max(2 * plain.select("block").distinct().count(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = cut(tree_parts(block_counts(plain, depth), depth, tasks), "tree")
    known = parts.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("vocabulary"), F.lit(0))).first()
    total, vocabulary = int(known[0]), int(known[1])
    found = block_values(parts, crown_of(parts, min(depth, SHARED)), depth)

    def score(key: tuple, own: pa.Table, looked_up: pa.Table) -> pa.Table:
        def pick(kind: int) -> tuple[np.ndarray, np.ndarray]:
            packed = looked_up.filter(pa.compute.equal(looked_up.column("kind"), kind)).to_pylist()
            keys = [np.cumsum(_unpack(row["keys"], row["size"], np.int64)) for row in packed]
            values = [_unpack(row["value"], row["size"], np.float64) for row in packed]
            return np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0), *values])

        log2p = _Lookup(*pick(WINDOW))
        count_of = dict(zip(*(c.tolist() for c in pick(WORD))))
        rows: list[tuple[np.ndarray, ...]] = []
        for texts, _ in _chunks(own.select(["text", "held_out"]).to_batches(), PART_BYTES):
            code, sizes = _windows(texts, depth)
            bits = np.add.reduceat(log2p(code), np.cumsum(sizes) - sizes)
            split = [[*t.split(), _END_TOKEN] for t in texts]
            every = list(set().union(*split))
            counts_of = {w: count_of.get(h, 0.0) for w, h in zip(every, _word_hash(every).tolist())}
            flat = np.array(list(map(counts_of.__getitem__, chain.from_iterable(split))))
            n = np.array([len(ws) for ws in split])
            at = np.cumsum(n) - n
            base = np.add.reduceat(np.log10((flat + 1) / (total + vocabulary + 1)), at)
            rows.append((n, np.add.reduceat((flat > 0).astype(np.int64), at), base, bits, sizes))
        n, known, base, bits, sizes = (np.concatenate(c) for c in zip(*rows)) if rows else [np.zeros(0)] * 5
        return pa.table(
            {
                "doc_id": own.column("doc_id"),
                "held_out": own.column("held_out"),
                "n_tokens": pa.array(n, pa.int64()),
                "n_known": pa.array(known, pa.int64()),
                "train_tokens": pa.array(np.full(len(n), total), pa.int64()),
                "base_score": base,
                "score": bits * np.log10(2),
                "bits_per_byte": -bits / sizes,
            }
        )

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return plain.repartition(tasks, "block").groupBy("block").cogroup(found.repartition(tasks, "block").groupBy("block")).applyInArrow(score, out)


def hold_out(doc_id: Column, n: int = 7, which: int = 2) -> Column:
    return remainder_of_id(doc_id, n) == which
