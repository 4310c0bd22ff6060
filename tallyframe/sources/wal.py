"""Write-ahead log files: framing, recovery report, payload decoding, writing and repair.

A log is a folder of segments, ``segment-<first LSN>.wal``, each written and read by a task of its own. A segment is a 16-byte header and frames; where a
frame ends is known only from its length, so one segment is one task's sequential walk, some thousand frames at a time, whose checksums are computed together. The
task opens the file and reads it in blocks: Spark's rows carry its path.
Reading never decodes payloads: tears and fatal findings come from the framing, malformed payloads from ``decode_events``, and records that
the domain refuses from ``findings``. A repaired log is a new folder; nothing is changed in place. Durability is the store's, there is no fsync here.

The records of a log are those of its clean prefix (``clean_frames``): all segments before the first that is torn, corrupt or doesn't continue the one before,
and of that one the frames before the tear. A tear is cut by ``repair``, which leaves a marker frame about it; a corruption is never cut.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import FINGERPRINT_TAG, KIND_CODES, RECORD_TYPES, SIDE_CODES, crc32c, crc32c_of
from ..session import cut

#: Fixed values of the file format.
MAGIC, VERSION, OLDEST, HEADER, OVERHEAD, MOST_PAYLOAD, MARKER_SIZE = b"LWAL", 2, 1, 16, 20, 65_535, 21
#: A tail's place in this list is its code in a marker.
TAILS = ("EMPTY_FILE", "CLEAN_EOF", "SHORT_FRAME_HEADER", "BAD_FRAME_LENGTH", "SHORT_FRAME", "CRC_MISMATCH", "LSN_MISMATCH")
TEARS = TAILS[2:]
TYPES = {code: name for name, code in RECORD_TYPES.items()}
KINDS = {code: name for name, code in KIND_CODES.items()}
SIDES = {code: name for name, code in SIDE_CODES.items()}
FRAMES = "file string, offset long, frame_length int, lsn long, type_code int, type string, payload binary, tail string, corruption string, file_bytes long, clean_bytes long, detail string"
EVENTS = "lsn long, type string, account_id string, kind string, merchant string, key string, fingerprint string, captured_at_ms long, entries array<struct<account_id:string,side:string,amount_minor:bigint>>, corruption string"
#: Frames and bytes that a task has in hand at a time; no frame is longer than a block.
TOGETHER, BLOCK = 8192, 1 << 22


def is_tear(tail: Column) -> Column:
    """Whether a tail means that the segment is cut there; an empty file and a clean end are none."""
    return tail.isin(*TEARS)


def is_journal_event(type_: Column) -> Column:
    """A marker is a record, but no event."""
    return type_.isNotNull() & (type_ != "RECOVERY_MARKER")


def segment_header(version: int = VERSION) -> bytes:
    head = MAGIC + struct.pack(">BBHI", version, 0, HEADER, 0)
    return head + struct.pack(">I", crc32c(head))


def _put(raw: np.ndarray, at: np.ndarray, values: np.ndarray, kind: str) -> None:
    """Write numbers of a big-endian ``kind`` at these places."""
    size = np.dtype(kind).itemsize
    raw[at[:, None] + np.arange(size)] = values.astype(kind).view(np.uint8).reshape(-1, size)


def _framed(lsns: np.ndarray, kinds: np.ndarray, ends: np.ndarray, data: np.ndarray) -> bytes:
    """The frames of records whose payloads lie in ``data`` between ``ends`` (one more than records), one behind the other."""
    lengths = np.diff(ends)
    if (lengths > MOST_PAYLOAD).any():
        raise ValueError("a payload has at most 65,535 bytes")
    sizes = lengths + OVERHEAD
    after = np.cumsum(sizes)
    starts = after - sizes
    raw = np.zeros(int(after[-1]) if len(after) else 0, np.uint8)
    for offset, values, kind in ((0, sizes, ">u4"), (4, lsns, ">u8"), (12, kinds, ">u1"), (14, lengths, ">u2")):
        _put(raw, starts + offset, values, kind)
    raw[np.arange(ends[0], ends[-1]) + np.repeat(starts + 16 - ends[:-1], lengths)] = data[ends[0] : ends[-1]]
    if len(starts):
        _put(raw, after - 4, np.array(crc32c_of(raw, starts, after - 4), np.int64), ">u4")
    return raw.tobytes()


def frames_bytes(records: list[tuple[int, int, bytes]]) -> bytes:
    """The frames of (lsn, type code, payload), one behind the other."""
    lsns, kinds, payloads_ = zip(*records) if records else ((), (), ())
    ends = np.cumsum([0, *map(len, payloads_)], dtype=np.int64)
    return _framed(np.array(lsns, np.uint64), np.array(kinds, np.int64), ends, np.frombuffer(b"".join(payloads_), np.uint8))


def _binary(column) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of an Arrow column of bytes end in their buffer (one more than values), and the buffer."""
    import pyarrow as pa

    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1] or bytes(4), np.int32)[column.offset : column.offset + len(column) + 1]
    return ends.astype(np.int64), np.frombuffer(column.buffers()[2] or b"", np.uint8)


def _in_blocks(batch, name: str) -> Iterator:
    """The batch in slices with some megabytes of this column of bytes."""
    ends, at = _binary(batch.column(name))[0], 0
    while at < len(batch):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK, "right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto


def frame(lsn: int, kind: int, payload: bytes) -> bytes:
    return frames_bytes([(lsn, kind, payload)])


def marker_payload(tail: str, dropped: int, kept: int, last_lsn: int) -> bytes:
    """What a repair says about its cut: the tail, bytes dropped, frames kept, the last LSN; four bytes are spare."""
    return struct.pack(">BIIq", TAILS.index(tail), min(dropped, 0xFFFFFFFF), kept, last_lsn) + bytes(4)


class Walk:
    """A pass over one segment (bytes or an open file); once ``frames`` is through, tail or corruption, clean_bytes and detail say how it ended."""

    def __init__(self, raw, first: int = 1):
        self.source, self.expected = _opened(raw), first
        self.size = self.source.size()
        self.tail = self.corruption = None
        self.clean_bytes, self.detail = 0, ""

    def _header(self) -> bool:
        if not self.size:
            self.tail = "EMPTY_FILE"
            return False
        head = self.source.read_at(HEADER, 0)
        if len(head) == HEADER:
            magic, version, _, size, reserved, crc = struct.unpack(">4sBBHII", head)
            if magic == MAGIC and OLDEST <= version <= VERSION and size == HEADER and not reserved and crc == crc32c(head[:12]):
                self.version, self.clean_bytes = version, HEADER
                return True
        self.corruption, self.detail = "BAD_SEGMENT_HEADER", head.hex()
        return False

    def _bounds(self, block: bytes, at: int, left: int) -> tuple[int, int, int, int] | None:
        """Size, LSN, type and reserved byte of the frame at ``at`` of a block, with ``left`` bytes to the file's end; None if it isn't whole there, with a tail if no frame can begin there."""
        if not left:
            self.tail = "CLEAN_EOF"
        elif left < 16:
            self.tail, self.detail = "SHORT_FRAME_HEADER", f"{left} bytes"
        elif at + 16 <= len(block):
            size, lsn, kind, reserved, payload = struct.unpack_from(">IQBBH", block, at)
            if not OVERHEAD <= size <= OVERHEAD + MOST_PAYLOAD:
                self.tail, self.detail = "BAD_FRAME_LENGTH", str(size)
            elif size > left:
                self.tail, self.detail = "SHORT_FRAME", f"{left} of {size} bytes"
            elif payload != size - OVERHEAD:
                self.tail, self.detail = "BAD_FRAME_LENGTH", f"payload of {payload}"
            elif at + size <= len(block):
                return size, lsn, kind, reserved
        return None

    def _finding(self, lsn: int, kind: int, reserved: int, size: int, same: bool) -> tuple[str | None, str | None, str] | None:
        """Tail, corruption and detail of a whole frame that isn't valid."""
        if not same:
            return "CRC_MISMATCH", None, ""
        if lsn != self.expected:
            return "LSN_MISMATCH", None, f"{lsn} where {self.expected} was due"
        if reserved:
            return "CRC_MISMATCH", None, f"the reserved byte is {reserved}"
        if kind not in TYPES or self.version == 1 and TYPES[kind] == "IDEMPOTENT_POSTING":
            return None, "UNKNOWN_RECORD_TYPE", f"type {kind}"
        if TYPES[kind] == "RECOVERY_MARKER" and size != OVERHEAD + MARKER_SIZE:
            return None, "PAYLOAD_MALFORMED", f"a marker of {size - OVERHEAD}"
        return None

    def _whole(self, block: bytes) -> list[int]:
        """Where the frames begin that seem to be whole in a block, by their lengths, and where the last one ends."""
        starts, here, most = [0], 0, OVERHEAD + MOST_PAYLOAD
        while here + 16 <= len(block) and len(starts) <= TOGETHER:
            size = int.from_bytes(block[here : here + 4])
            if not OVERHEAD <= size <= most or here + size > len(block) or int.from_bytes(block[here + 14 : here + 16]) != size - OVERHEAD:
                break
            here += size
            starts.append(here)
        return starts

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Columns of valid frames in order, some thousand at a time: offset, length, LSN, type code, place in a block of bytes, and the block."""
        if not self._header():
            return
        at = HEADER
        known = np.array([k in TYPES and not (self.version == 1 and TYPES[k] == "IDEMPOTENT_POSTING") for k in range(256)])
        while self.tail is None and self.corruption is None:
            block = self.source.read_at(min(BLOCK, self.size - at), at)
            places = np.array(self._whole(block), np.int64)
            here = int(places[-1])
            if len(places) <= TOGETHER:
                self._bounds(block, here, self.size - at - here)  # says why no frame follows, if none does
            places, sizes, data = places[:-1], np.diff(places), np.frombuffer(block, np.uint8)
            heads = data[places[:, None] + np.arange(4, 16)]
            lsns, kinds = np.ascontiguousarray(heads[:, :8]).view(">u8").ravel(), heads[:, 8]
            same = np.array([], bool)
            if len(places):
                crcs = np.ascontiguousarray(data[(places + sizes - 4)[:, None] + np.arange(4)]).view(">u4").ravel()
                same = np.array(crc32c_of(data, places, places + sizes - 4), np.int64) == crcs
            due = np.uint64(self.expected) + np.arange(len(places), dtype=np.uint64)
            marker = kinds == RECORD_TYPES["RECOVERY_MARKER"]
            wrong = np.flatnonzero(~(same & (lsns == due) & (heads[:, 9] == 0) & known[kinds] & ~(marker & (sizes != OVERHEAD + MARKER_SIZE))))
            n = int(wrong[0]) if len(wrong) else len(places)
            self.expected += n
            if n:
                self.clean_bytes = at + int(places[n - 1] + sizes[n - 1])
            if len(wrong):
                self.tail, self.corruption, self.detail = self._finding(int(lsns[n]), int(kinds[n]), int(heads[n, 9]), int(sizes[n]), bool(same[n]))
            yield places[:n] + at, sizes[:n], lsns[:n].astype(np.int64), kinds[:n], places[:n], data
            at += here

    def frames(self) -> Iterator[list[tuple[int, int, int, int, bytes]]]:
        """Lists of valid frames (offset, length, lsn, type, payload) in order."""
        for offsets, sizes, lsns, kinds, places, data in self.parts():
            yield [(o, n, lsn, kind, data[p + 16 : p + n - 4].tobytes()) for o, n, lsn, kind, p in zip(*(x.tolist() for x in (offsets, sizes, lsns, kinds, places)))]

    def repaired(self) -> tuple[int, bytes] | None:
        """Goes through the segment: how many bytes a repair keeps and what it puts behind them; None: the segment is corrupt."""
        kept = sum(len(part[0]) for part in self.parts())
        if self.corruption:
            return None
        if self.tail in TEARS:
            dropped = self.size - self.clean_bytes
            return self.clean_bytes, frame(self.expected, RECORD_TYPES["RECOVERY_MARKER"], marker_payload(self.tail, dropped, kept, self.expected - 1))
        return self.size, b"" if self.size else segment_header()


def walk(raw: bytes, first: int = 1) -> tuple[list[tuple[int, int, int, int, bytes]], str | None, str | None, int, str]:
    """Frames (offset, length, lsn, type, payload), tail, corruption, clean bytes and a detail of one segment."""
    pass_ = Walk(raw, first)
    frames = [f for part in pass_.frames() for f in part]
    return frames, pass_.tail, pass_.corruption, pass_.clean_bytes, pass_.detail


def first_lsn(file: str) -> int:
    """The LSN that a segment's name gives its first frame; 1 for other names."""
    found = re.search(r"segment-([0-9]{19})\.wal$", file)
    return int(found[1]) if found else 1


def segment_name(first: int) -> str:
    return f"segment-{first:019d}.wal"


def _files(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The paths of a log's segments; their bytes aren't read for it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wal").load(path).select("path", *columns)


def read_wal(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row a frame; each file's last row (without lsn) carries its tail or corruption. Without ``payloads`` all is checked just the same, but they aren't handed on."""
    return frames_in(_files(spark, path), payloads)


def frames_in(files: DataFrame, payloads: bool = True) -> DataFrame:
    """``read_wal`` of files that are at hand as rows (path, content), or of the files at the paths of rows (path)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [c.strip().split(" ")[0] for c in FRAMES.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        types = pa.array([TYPES.get(k) for k in range(256)])
        for batch in batches:
            for file, source in _sources(batch):
                pass_ = Walk(source, first_lsn(file))
                for offsets, sizes, lsns, codes, places, data in pass_.parts():
                    if len(offsets):
                        columns = [pa.repeat(file, len(offsets)), offsets, sizes, lsns, codes, types.take(pa.array(codes)), _payloads(places, sizes, data) if payloads else pa.nulls(len(offsets), pa.binary())]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) if isinstance(c, np.ndarray) else c for c, k in zip(columns, kinds)] + [pa.nulls(len(offsets), k) for k in kinds[7:]], names)
                yield made([(file, pass_.clean_bytes, None, None, None, None, None, pass_.tail, pass_.corruption, pass_.size, pass_.clean_bytes, pass_.detail)])

    return files.mapInArrow(run, FRAMES)


def _payloads(places: np.ndarray, sizes: np.ndarray, data: np.ndarray):
    """The payloads of frames at these places as an Arrow column."""
    import pyarrow as pa

    ends = np.concatenate(([0], np.cumsum(sizes - OVERHEAD)))
    held = data[np.arange(ends[-1]) + np.repeat(places + 16 - ends[:-1], sizes - OVERHEAD)]
    return pa.BinaryArray.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(held)])


def frames_of(found: DataFrame) -> DataFrame:
    return found.where("lsn is not null").select("file", "offset", "frame_length", "lsn", "type_code", "type", "payload")


def report(found: DataFrame) -> DataFrame:
    """A row a file: file_bytes, clean_bytes, truncated_bytes, frames, journal_records, markers, last_lsn, tail, corruption, detail."""
    of = lambda c: F.max(c).alias(c)
    out = found.groupBy("file").agg(
        of("file_bytes"), of("clean_bytes"), F.count("lsn").alias("frames"), F.count(F.when(is_journal_event(F.col("type")), 1)).alias("journal_records"),
        F.count(F.when(F.col("type") == "RECOVERY_MARKER", 1)).alias("markers"), F.coalesce(F.max("lsn"), F.lit(0)).alias("last_lsn"), of("tail"), of("corruption"), of("detail"),
    )
    return out.withColumn("truncated_bytes", F.col("file_bytes") - F.col("clean_bytes"))


def clean_frames(found: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """The frames of the log's clean prefix, over all its segments. ``seen``: the ``report`` of them, if it was written already."""
    first = F.coalesce(F.nullif(F.regexp_extract("file", r"segment-([0-9]{19})\.wal$", 1), F.lit("")).cast("long"), F.lit(1).cast("long"))
    ends = (cut(report(found), "report") if seen is None else seen).select(first.alias("first"), "last_lsn", ((F.col("tail") != "CLEAN_EOF") | F.col("tail").isNull()).alias("broken"))
    follows = ends.select((F.greatest("last_lsn", F.col("first") - 1) + 1).alias("first"))
    stray = ends.where("first <> 1").join(follows, "first", "left_anti").select("first")  # no segment ends where this one begins
    end = ends.where("broken").select((F.col("first") + 1).alias("first")).unionByName(stray).agg(F.min("first")).first()[0]
    return frames_of(found) if end is None else frames_of(found).where(first < end)


def markers(frames: DataFrame) -> DataFrame:
    """lsn, reason, bytes_dropped, frames_kept and last_lsn of the markers."""
    number = lambda at, n: F.conv(F.hex(F.substring("payload", at, n)), 16, -10).cast("long")
    names = F.array(*[F.lit(t) for t in TAILS])
    reason = F.coalesce(F.get(names, number(1, 1).cast("int")), F.lit("CLEAN_EOF"))
    return frames.where("type = 'RECOVERY_MARKER'").select("lsn", reason.alias("reason"), number(2, 4).alias("bytes_dropped"), number(6, 4).alias("frames_kept"), number(10, 8).alias("last_lsn"))


def last_marker(frames: DataFrame) -> DataFrame:
    """The marker of the greatest LSN, if there is one."""
    return markers(frames).orderBy(F.desc("lsn")).limit(1)


def repaired(files: DataFrame) -> DataFrame:
    """Each segment (path, content) as a repair leaves it: name, content, tail, corruption, bytes_dropped.

    A torn segment is cut to its clean bytes and gets a marker with the next LSN; clean segments stay as they are. A corrupt one is refused:
    its content is null, for a reader could only guess what it held.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for file, source in _sources(batch):
                pass_ = Walk(source, first_lsn(file))
                fixed = pass_.repaired()
                content = None if fixed is None else source.read_at(fixed[0], 0) + fixed[1]
                columns = ([file.rsplit("/", 1)[-1]], [content], [pass_.tail], [pass_.corruption], [pass_.size - pass_.clean_bytes])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.binary(), pa.string(), pa.string(), pa.int64()))], ["name", "content", "tail", "corruption", "bytes_dropped"])

    return files.mapInArrow(run, "name string, content binary, tail string, corruption string, bytes_dropped long")


def repair(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Write the log below ``path`` to ``folder``, each segment as ``repaired`` leaves it; returns name, tail, corruption, bytes_dropped and bytes.

    Segments behind the first torn one don't continue the repaired log any more; ``clean_frames`` doesn't read them.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        for batch in batches:
            store, root = _store(folder)
            store.create_dir(root, recursive=True)
            for file, source in _sources(batch):
                name, pass_ = file.rsplit("/", 1)[-1], Walk(source, first_lsn(file))
                fixed = pass_.repaired()
                if fixed is not None:
                    _publish(store, f"{root}/{name}", copied(source, *fixed))
                columns = (name, pass_.tail, pass_.corruption, pass_.size - pass_.clean_bytes, None if fixed is None else fixed[0] + len(fixed[1]))
                yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds)], ["name", "tail", "corruption", "bytes_dropped", "bytes"])

    return _files(spark, path).mapInArrow(run, "name string, tail string, corruption string, bytes_dropped long, bytes long")


def copied(source, n: int, more: bytes = b"") -> Iterator[bytes]:
    """The first ``n`` bytes of an open file in blocks, and ``more`` behind them."""
    for at in range(0, n, BLOCK):
        yield source.read_at(min(BLOCK, n - at), at)
    yield more


def _opened(at):
    """A file to read from any place of: at a path, of bytes, or open already."""
    import pyarrow as pa

    if isinstance(at, (bytes, pa.Buffer)):
        return pa.BufferReader(at)
    if not isinstance(at, str):
        return at
    store, path = _store(at)
    return store.open_input_file(path)


def _sources(batch) -> Iterator:
    """The path and the open file of each row (path, content) or (path)."""
    contents = batch.column("content") if "content" in batch.schema.names else None
    for k, path in enumerate(batch.column("path").to_pylist()):
        with _opened(path if contents is None else contents[k].as_buffer()) as source:
            yield path, source


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


def _publish(store, path: str, chunks) -> None:
    """Write under a name of this attempt, then rename."""
    mine = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(mine) as out:
        for chunk in chunks:
            out.write(chunk)
    store.move(mine, path)


def prefix_digests(spark: SparkSession, path: str, covered: DataFrame) -> DataFrame:
    """(covered_bytes, digest) for each row of ``covered`` (covered_bytes, distinct): SHA-256 of so many first bytes of the log.

    The log's bytes are those of its segments in order of their names. Of a single segment this is the digest of the file's prefix; of several, each segment's
    prefix is hashed in its own task and the digest is that of the segments' digests in order (a single stream over a long log would be one task's). No digest: the log is shorter.
    """
    sizes = spark.read.format("binaryFile").option("pathGlobFilter", "*.wal").load(path).select("path", F.col("length").alias("n"))
    names = {r.path: r.n for r in sizes.collect()}  # a row a segment
    base, places = 0, []
    for file in sorted(names):
        places.append((file, base))
        base += names[file]
    if not places:
        return covered.select("covered_bytes", F.when(F.col("covered_bytes") == 0, hashlib.sha256(b"").hexdigest()).alias("digest"))
    starts = spark.createDataFrame(places, "path string, base long")
    asked = covered.where(F.col("covered_bytes").between(0, base))
    wanted = F.array(*[F.lit(r.covered_bytes) for r in asked.collect()]).cast("array<bigint>")  # one for each checkpoint
    parts = _files(spark, path, "content").join(F.broadcast(starts), "path").withColumn("covered", F.explode(F.filter(wanted, lambda n: n > F.col("base"))))
    own = F.sha2(F.expr("substring(content, 1, cast(least(covered - base, length(content)) as int))"), 256)
    hashed = parts.groupBy(F.col("covered").alias("covered_bytes")).agg(F.sort_array(F.collect_list(F.struct("base", own.alias("d")))).alias("ds"))
    digest = F.when(F.size("ds") == 1, F.col("ds")[0]["d"]).otherwise(F.sha2(F.unhex(F.array_join(F.transform("ds", lambda x: x["d"]), "")), 256))
    return asked.join(hashed, "covered_bytes", "left").select("covered_bytes", F.coalesce(digest, F.lit(hashlib.sha256(b"").hexdigest())).alias("digest"))


_NAME = re.compile(rb"[A-Za-z0-9._-]+")


class _Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise ValueError("too short")
        self.at += n
        return self.raw[self.at - n : self.at]

    def name(self, most: int = 64) -> str:
        value = self.take(self.take(1)[0])
        if len(value) > most or not _NAME.fullmatch(value):
            raise ValueError("a bad name")
        return value.decode()

    def entries(self) -> list[dict]:
        out = []
        for _ in range(struct.unpack(">H", self.take(2))[0]):
            account, side, amount = self.name(), self.take(1)[0], struct.unpack(">q", self.take(8))[0]
            if side not in SIDES or amount <= 0:
                raise ValueError("a bad entry")
            out.append({"account_id": account, "side": SIDES[side], "amount_minor": amount})
        return out


def decode_payload(kind: str, raw: bytes) -> dict:
    """Columns of one record; a ValueError if the bytes aren't exactly one payload of this kind."""
    r, out = _Reader(raw), {}
    if kind == "ACCOUNT_OPENED":
        number = r.take(1)[0]
        if number not in KINDS:
            raise ValueError("a bad kind")
        out = {"kind": KINDS[number], "account_id": r.name()}
    elif kind == "POSTED":
        out = {"entries": r.entries()}
    elif kind == "IDEMPOTENT_POSTING":
        out = {"merchant": r.name(), "key": r.name(255), "captured_at_ms": struct.unpack(">q", r.take(8))[0], "fingerprint": r.take(32).hex()}
        body = r.raw[r.at :]
        out["entries"] = r.entries()
        if hashlib.sha256(bytes([FINGERPRINT_TAG]) + body).hexdigest() != out["fingerprint"]:
            raise ValueError("the fingerprint isn't the body's")
    else:
        return out
    if r.at != len(raw):
        raise ValueError("bytes left over")
    return out


_IN_NAMES = np.array([_NAME.fullmatch(bytes([x])) is not None for x in range(256)])


def _texts(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """The bytes from each of ``starts`` as strings, and which of them are names."""
    import pyarrow as pa

    ends = np.concatenate(([0], np.cumsum(sizes)))
    held = data[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)]
    wrong = np.concatenate(([0], np.cumsum(~_IN_NAMES[held])))
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(held)), wrong[ends[1:]] == wrong[ends[:-1]]


class _Together:
    """The payloads of many records of one type, read field by field for all of them; ``good`` are those in which nothing was wrong so far."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.at, self.ends, self.good = np.concatenate((data, np.zeros(256, np.uint8))), starts.copy(), ends, np.ones(len(starts), bool)
        self.all = np.arange(len(starts))

    def take(self, rows: np.ndarray, n) -> np.ndarray:
        """Where the next ``n`` (at most 255) bytes of these payloads begin."""
        here = self.at[rows]
        fits = here + n <= self.ends[rows]
        self.good[rows[~fits]] = False
        self.at[rows] = np.where(fits, here + n, self.ends[rows])
        return here

    def number(self, places: np.ndarray, size: int) -> np.ndarray:
        return np.ascontiguousarray(self.data[places[:, None] + np.arange(size)]).view(f">i{size}" if size > 2 else f">u{size}").ravel().astype(np.int64)

    def bytes_of_name(self, rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        size = self.data[self.take(rows, 1)].astype(np.int64)
        self.good[rows[size > most]] = False
        return self.take(rows, size), size

    def names(self, rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        found, fine = _texts(self.data, starts, sizes)
        self.good[rows[~fine | (sizes == 0)]] = False
        return found

    def name(self, most: int = 64):
        return self.names(self.all, *self.bytes_of_name(self.all, most))

    def entries(self):
        """All payloads' entries, the k-th of each at a time."""
        import pyarrow as pa

        left, parts = self.number(self.take(self.all, 2), 2), []
        rows = self.all[self.good & (left > 0)]
        while len(rows):
            starts, sizes = self.bytes_of_name(rows, 64)
            side, amount = self.data[self.take(rows, 1)], self.number(self.take(rows, 8), 8)
            self.good[rows[(side >= len(SIDES)) | (amount <= 0)]] = False
            parts.append((rows, starts, sizes, side, amount))
            left[rows] -= 1
            rows = rows[self.good[rows] & (left[rows] > 0)]
        rows, starts, sizes, side, amount = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 5
        order = np.argsort(rows, kind="stable")
        accounts = self.names(rows[order], starts[order], sizes[order])
        sides = pa.DictionaryArray.from_arrays(np.minimum(side[order], len(SIDES) - 1).astype(np.int32), [SIDES[k] for k in range(len(SIDES))]).cast(pa.string())
        ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(self.all))))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([accounts, sides, pa.array(amount[order])], ["account_id", "side", "amount_minor"]))

    def columns(self, kind: str) -> dict:
        """The columns of these payloads; what isn't ``good`` in the end has no meaning."""
        import pyarrow as pa

        out = {}
        if kind == "ACCOUNT_OPENED":
            code = self.data[self.take(self.all, 1)]
            self.good[code >= len(KINDS)] = False
            out["kind"] = pa.DictionaryArray.from_arrays(np.minimum(code, len(KINDS) - 1).astype(np.int32), [KINDS[k] for k in range(len(KINDS))]).cast(pa.string())
            out["account_id"] = self.name()
        elif kind == "POSTED":
            out["entries"] = self.entries()
        elif kind == "IDEMPOTENT_POSTING":
            out["merchant"], out["key"] = self.name(), self.name(255)
            out["captured_at_ms"] = pa.array(self.number(self.take(self.all, 8), 8))
            prints = self.take(self.all, 32)
            bodies, raw, tag = self.at.copy(), self.data.tobytes(), bytes([FINGERPRINT_TAG])
            out["entries"] = self.entries()
            own = [raw[p : p + 32] for p in prints.tolist()]
            self.good &= np.array([hashlib.sha256(tag + raw[a:b]).digest() == x for a, b, x in zip(bodies.tolist(), self.ends.tolist(), own)], bool)
            out["fingerprint"] = pa.array([x.hex() for x in own])
        else:
            return out
        self.good &= self.at == self.ends
        return out


def decode_events(frames: DataFrame) -> DataFrame:
    """Journal columns of each frame; a payload that can't be decoded has corruption PAYLOAD_MALFORMED.

    The payloads of a type are decoded together, field by field; those that seem wrong then are decoded by themselves, which decides.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        entry = pa.list_(pa.struct([("account_id", pa.string()), ("side", pa.string()), ("amount_minor", pa.int64())]))
        schema = pa.schema([("lsn", pa.int64()), ("type", pa.string()), ("account_id", pa.string()), ("kind", pa.string()), ("merchant", pa.string()), ("key", pa.string()), ("fingerprint", pa.string()), ("captured_at_ms", pa.int64()), ("entries", entry), ("corruption", pa.string())])

        def single(rows: pa.RecordBatch) -> pa.RecordBatch:
            columns = [[] for _ in schema]
            for lsn, kind, raw in zip(*(rows.column(c).to_pylist() for c in ("lsn", "type", "payload"))):
                try:
                    row = decode_payload(kind, raw)
                except (ValueError, IndexError):
                    row = {"corruption": "PAYLOAD_MALFORMED"}
                for values, name in zip(columns, schema.names):
                    values.append(row.get(name))
                columns[0][-1], columns[1][-1] = lsn, kind
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in (part for whole in batches for part in _in_blocks(whole, "payload")):
            kinds = batch.column("type").dictionary_encode()
            for number, kind in enumerate(kinds.dictionary.to_pylist()):
                rows = batch.filter(pa.array(kinds.indices.to_numpy(zero_copy_only=False) == number))
                ends, held = _binary(rows.column("payload"))
                together = _Together(held, ends[:-1], ends[1:])
                found = together.columns(kind) | {"lsn": rows.column("lsn"), "type": rows.column("type")}
                made = pa.RecordBatch.from_arrays([found[f.name].cast(f.type) if f.name in found else pa.nulls(len(rows), f.type) for f in schema], schema=schema)
                if together.good.all():
                    yield made
                    continue
                yield made.filter(pa.array(together.good))
                yield single(rows.filter(pa.array(~together.good)))

    return frames.select("lsn", "type", "payload").mapInArrow(run, EVENTS)


def payloads(journal: DataFrame, *more: str) -> DataFrame:
    """lsn, type_code and payload of journal rows, and ``more`` of their columns."""
    from ..functions import codec

    kind = F.col("type")
    body = (
        F.when(kind == "ACCOUNT_OPENED", codec.opening_payload(F.col("account_id"), F.col("kind")))
        .when(kind == "POSTED", codec.posting_payload(F.col("entries")))
        .otherwise(codec.keyed_payload(F.col("merchant"), F.col("key"), F.col("captured_at_ms"), F.col("entries")))
    )
    number = F.create_map(*[x for k, v in RECORD_TYPES.items() for x in (F.lit(k), F.lit(v))])[kind]
    return journal.select("lsn", number.alias("type_code"), body.alias("payload"), *more)


def write_segments(journal: DataFrame, folder: str, records: int = 100_000) -> DataFrame:
    """Write the journal as segments of ``records`` LSNs below ``folder``, which all executors see; returns file, bytes, first and last LSN of each.

    A segment's rows meet in one task, so ``records`` bounds a task. Files get their name when they are whole: a repeated attempt replaces them.
    """
    segment = (F.floor((F.col("lsn") - 1) / records) * records + 1).cast("long").alias("first")
    rows = payloads(journal).select(segment, "lsn", "type_code", "payload").repartition("first").sortWithinPartitions("first", "lsn")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        done: list[tuple[str, int, int, int]] = []
        out, now, size, last = None, None, 0, 0

        def close() -> None:
            out.close()
            store.move(f"{root}/{segment_name(now)}{mine}", f"{root}/{segment_name(now)}")
            done.append((segment_name(now), size, now, last))

        mine = f".{uuid.uuid4().hex}.tmp"
        for batch in (part for whole in batches for part in _in_blocks(whole, "payload")):
            firsts, lsns, codes = (batch.column(c).to_numpy() for c in ("first", "lsn", "type_code"))
            ends, held = _binary(batch.column("payload"))
            edges = [0, *(np.flatnonzero(np.diff(firsts)) + 1).tolist(), len(firsts)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if firsts[a] != now:
                    if out:
                        close()
                    now, size = int(firsts[a]), HEADER
                    out = store.open_output_stream(f"{root}/{segment_name(now)}{mine}")
                    out.write(segment_header())
                data = _framed(lsns[a:b], codes[a:b], ends[a : b + 1], held)
                out.write(data)
                size, last = size + len(data), int(lsns[b - 1])
        if out:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["file", "bytes", "first_lsn", "last_lsn"])

    return rows.mapInArrow(run, "file string, bytes long, first_lsn long, last_lsn long")


def acks(found: DataFrame, durable_through: int | None = None) -> DataFrame:
    """A row a record of a log that was written: lsn, file, offset, frame_length, end_offset, forced, digest (of the payload).

    A segment is published whole, so every record of it is forced; with ``durable_through``, only those up to it are.
    """
    forced = F.lit(True) if durable_through is None else F.col("lsn") <= durable_through
    return frames_of(found).select("lsn", "file", "offset", "frame_length", (F.col("offset") + F.col("frame_length")).alias("end_offset"), forced.alias("forced"), F.sha2("payload", 256).alias("digest"))


def findings(found: DataFrame) -> DataFrame:
    """(file, lsn, corruption, detail): everything for which a log is refused instead of cut, from the framing, the payloads and the domain."""
    from ..operators import audit

    found = cut(found, "frames")  # read several times, walked through and decoded once
    framing = found.where("corruption is not null").select("file", F.lit(None).cast("long").alias("lsn"), "corruption", "detail")
    frames = clean_frames(found)
    events = cut(decode_events(frames), "events")
    files = frames.select("lsn", "file")
    malformed = events.where("corruption is not null").select("lsn", "corruption", F.lit("").alias("detail"))
    refused = audit.replay_violations(events.where("corruption is null")).select("lsn", F.lit("DOMAIN_REJECTED").alias("corruption"), F.col("rule").alias("detail"))
    return framing.unionByName(malformed.unionByName(refused).join(files, "lsn").select("file", "lsn", "corruption", "detail"))


def strict(found: DataFrame) -> DataFrame:
    """``found`` unchanged; raises where a segment is corrupt, as a reader does that has no use for findings."""
    why = F.concat_ws(": ", F.col("corruption"), F.col("file"), F.col("detail"))
    return found.where(F.when(F.col("corruption").isNotNull(), F.raise_error(why).cast("boolean")).otherwise(True))
