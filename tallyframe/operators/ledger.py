"""The journal and what folds out of it: numbering, balances, running balances, trial balance, state hash, digests, reconciliation."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec, money
from ..session import cut
from .transactions import flatten

#: Numbers of a key's rows that are summed up in one task before the prefix sums.
SPAN = 1 << 16
#: Bits of an order that are left out for its range, and ranges whose sums are added up in one task and broadcast at most.
RANGE_BITS, MOST_RANGES = 12, 1 << 20
#: Bytes of a rendered section that are one row.
CHUNK_BYTES = 1 << 20
JOURNAL_COLUMNS = ("lsn", "seq", "type", "account_id", "kind", "merchant", "key", "fingerprint", "captured_at_ms", "entries")


def dense_numbers(rows: DataFrame, order: str, name: str = "lsn", start: int = 1) -> DataFrame:
    """Number rows from ``start`` by ``order`` (a unique long), without one task for all: by ranges of the order, then prefix sums of their sizes."""
    # The rows are computed, shuffled and written once: in order within their range, with their place.
    at = F.monotonically_increasing_id()
    ranged = cut(rows.withColumn("_p", F.shiftright(order, RANGE_BITS)).repartition("_p").sortWithinPartitions("_p", order).withColumn("_at", at), "numbered")
    sizes = lambda: cut(ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")), "sizes")
    counts = sizes()
    if counts.count() > MOST_RANGES:  # a sparse order: ranges of as many rows each, whose bounds are sampled from the rows that were written
        sorted_ = ranged.drop("_p", "_at").repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", at)
        ranged = cut(sorted_.withColumn("_p", F.shiftright("_at", 33)), "numbered")
        counts = sizes()
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("_p", (before - F.col("_first") + start).alias("_b"))  # a row a range
    return ranged.join(F.broadcast(bases), "_p").withColumn(name, (F.col("_at") + F.col("_b")).cast("long")).drop("_p", "_b", "_at")


def prefix_sums(rows: DataFrame, key: str, order: str, value: str, name: str, span: int = SPAN) -> DataFrame:
    """Add ``name``: the sum of ``value`` (exact, wide) of the key's rows up to this one by ``order`` (a long, unique within the key).

    A hot key isn't one task: its rows are dealt by ranges of ``span`` numbers, and only the ranges' sums are added up in order.
    """
    ranged = cut(rows.withColumn("_range", F.floor(F.col(order) / span)), "ranged")  # read twice, computed once
    sums = ranged.groupBy(key, "_range").agg(money.wide_sum(F.col(value)).alias("_own"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(key, "_range", F.coalesce(F.sum("_own").over(before), F.lit(0)).cast(money.WIDE).alias("_base"))
    within = Window.partitionBy(key, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumn("_within", F.sum(F.col(value).cast(money.WIDE)).over(within))
    return summed.join(bases, [key, "_range"]).withColumn(name, (F.col("_base") + F.col("_within")).cast(money.WIDE)).drop("_range", "_within", "_base")


def journal_of(attempts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """lsn, seq, type, account_id, kind, merchant, key, fingerprint, captured_at_ms, entries of what was admitted, dense from 1."""
    return journal_from(attempts.join(outcomes.where("outcome in ('OPENED', 'POSTED')").select("seq", "outcome"), "seq"))


def journal_from(decided: DataFrame, start: int = 1) -> DataFrame:
    """The same of attempts that have their outcome with them (``admission.decide``), numbered from ``start``."""
    types = F.when(F.col("op") == "OPEN", "ACCOUNT_OPENED").when(F.col("op") == "POST", "POSTED").otherwise("IDEMPOTENT_POSTING")
    keyed = F.col("op") == "POST_KEYED"
    shaped = decided.where("outcome in ('OPENED', 'POSTED')").select(
        "seq",
        types.alias("type"),
        "account_id",
        "kind",
        "merchant",
        "key",
        F.when(keyed, codec.fingerprint(F.col("entries"))).alias("fingerprint"),
        F.when(keyed, F.col("now_ms")).alias("captured_at_ms"),
        "entries",
    )
    return dense_numbers(shaped, "seq", start=start).select(*JOURNAL_COLUMNS)


def journal_entries(journal: DataFrame) -> DataFrame:
    return flatten(journal.where("type in ('POSTED', 'IDEMPOTENT_POSTING')"), "lsn")


def folded(accounts: DataFrame, entries: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """ordinal, account_id, kind and the balance as a wide decimal (``wide``); accounts without entries are 0. ``base``: balances to start from."""
    sums = entries.groupBy("account_id").agg(money.long_sum(money.signed(F.col("side"), F.col("amount_minor"))).alias("s"))
    if base is not None:
        sums = sums.unionByName(base.select("account_id", F.col("balance_minor").cast(money.WIDE).alias("s"))).groupBy("account_id").agg(money.wide_sum(F.col("s")).alias("s"))
    return accounts.join(sums, "account_id", "left").select("ordinal", "account_id", "kind", F.coalesce(F.col("s"), F.lit(0)).cast(money.WIDE).alias("wide"))


def balances(accounts: DataFrame, entries: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """ordinal, account_id, kind, balance_minor, is_natural; a balance beyond 64 bits, which no admitted journal has, raises."""
    return narrowed(folded(accounts, entries, base))


def narrowed(found: DataFrame) -> DataFrame:
    """``balances`` of what was ``folded``."""
    out = found.withColumn("balance_minor", F.col("wide").cast("long"))
    return out.select("ordinal", "account_id", "kind", "balance_minor", money.is_natural(F.col("kind"), F.col("balance_minor")).alias("is_natural"))


def restored_accounts(restored: DataFrame, journal: DataFrame) -> DataFrame:
    """ordinal, account_id, kind of the accounts of a snapshot (ordinal, account_id, kind, ...) and of those that the journal behind it opens, in opening order."""
    later = journal.where("type = 'ACCOUNT_OPENED'")
    old = restored.select(F.lit(0).alias("_old"), F.col("ordinal").alias("_at"), "account_id", "kind")
    both = old.unionByName(later.select(F.lit(1).alias("_old"), F.col("lsn").alias("_at"), "account_id", "kind"))
    last = restored.agg(F.coalesce(F.max("ordinal"), F.lit(0))).first()[0]
    place = F.when(F.col("_old") == 0, F.col("_at")).otherwise(F.lit(last) + F.col("_at"))
    return both.select(place.alias("ordinal"), "account_id", "kind")


def total_balance(found: DataFrame) -> DataFrame:
    return found.agg(F.coalesce(money.wide_sum(F.col("balance_minor")), F.lit(0)).cast("long").alias("total_minor"))


def trial_balance(found: DataFrame) -> DataFrame:
    """Every account's line, and a last line with the total."""
    lines = found.select("ordinal", "account_id", "kind", "balance_minor", money.major_string(F.col("balance_minor")).alias("balance"), "is_natural")
    total = total_balance(found).select(
        F.lit(None).cast("long").alias("ordinal"), F.lit("TOTAL").alias("account_id"), F.lit(None).cast("string").alias("kind"), F.col("total_minor").alias("balance_minor"),
        money.major_string(F.col("total_minor")).alias("balance"), (F.col("total_minor") == 0).alias("is_natural"),
    )
    return lines.unionByName(total)


def running_balances(entries: DataFrame, key: str = "seq", span: int = SPAN) -> DataFrame:
    """The balance of each touched account after each transaction."""
    net = entries.groupBy(key, "account_id").agg(money.wide_sum(money.signed(F.col("side"), F.col("amount_minor"))).alias("n"))
    summed = prefix_sums(net, "account_id", key, "n", "upto", span)
    return summed.select(key, "account_id", F.col("n").cast("long").alias("net_minor"), F.col("upto").cast("long").alias("balance_minor"))


def bindings(journal: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """merchant, key, fingerprint, response_lsn, captured_at_ms of all keyed postings; ``base``: the bindings of a snapshot, which come first."""
    own = journal.where("type = 'IDEMPOTENT_POSTING'").select("merchant", "key", "fingerprint", F.col("lsn").alias("response_lsn"), "captured_at_ms")
    return own if base is None else base.select(*own.columns).unionByName(own)


def ordered_chunks(sections: list[DataFrame]) -> DataFrame:
    """The bytes ``b`` of each section's rows by ``at``, joined to rows (part, range, chunk, n, bytes) of at most about a megabyte.

    Sorting and joining are done in many tasks, each for some ranges of ``at``; in the order of part, range and chunk the rows are the sections' bytes.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        now, chunk, held, size = None, 0, [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*now, chunk, len(held), b"".join(held)), kinds)], ["part", "range", "chunk", "n", "bytes"])

        for batch in batches:
            for part, range_, data in zip(*(batch.column(c).to_pylist() for c in ("part", "range", "b"))):
                if held and ((part, range_) != now or size > CHUNK_BYTES):
                    yield made()
                    chunk, held, size = chunk + 1 if (part, range_) == now else 0, [], 0
                now = (part, range_)
                held.append(data)
                size += len(data)
        if held:
            yield made()

    rows = reduce(DataFrame.unionByName, [s.select(F.lit(k).alias("part"), F.col("at").cast("long").alias("at"), "b") for k, s in enumerate(sections)])
    # Ranges of a fixed width need no sample, which would make all rows a second time.
    ordered = rows.withColumn("range", F.shiftright("at", 15)).repartition("part", "range").sortWithinPartitions("part", "range", "at")
    return cut(ordered.mapInArrow(run, "part int, range long, chunk int, n long, bytes binary"), "chunks")


def state_hash(accounts: DataFrame, bound: DataFrame, last_lsn: int) -> DataFrame:
    """SHA-256 of the canonical state: accounts (ordinal, kind, account_id, balance_minor) and bindings (response_lsn, ...) in order.

    The digest is one stream by definition: rows are sorted and rendered in many tasks, and one task runs over the chunks, one in hand at a time.
    """
    chunks = ordered_chunks(
        [
            accounts.select(F.col("ordinal").alias("at"), codec.state_account(F.col("kind"), F.col("account_id"), F.col("balance_minor")).alias("b")),
            bound.select(F.col("response_lsn").alias("at"), codec.state_binding(F.col("merchant"), F.col("key"), F.col("fingerprint"), F.col("response_lsn")).alias("b")),
        ]
    )
    count = {r.part: r.n for r in chunks.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # two rows
    n, m = count.get(0, 0), count.get(1, 0)
    heads = [struct.pack(">BqI", codec.STATE_VERSION, last_lsn, n), struct.pack(">I", m)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        digest, size, part = hashlib.sha256(), 0, -1

        def put(data: bytes) -> None:
            nonlocal size
            digest.update(data)
            size += len(data)

        for batch in batches:
            for k, data in zip(batch.column("part").to_pylist(), batch.column("bytes").to_pylist()):
                for head in heads[part + 1 : k + 1]:
                    put(head)
                part = max(part, k)
                put(data)
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((digest.hexdigest(), size, n, m), (pa.string(), *[pa.int64()] * 3))], ["state_hash", "section_bytes", "n_accounts", "n_bindings"])

    ends = accounts.sparkSession.range(2).select(F.col("id").cast("int").alias("part"), F.lit(-1).cast("long").alias("range"), F.lit(-1).alias("chunk"), F.lit(0).cast("long").alias("n"), F.unhex(F.lit("")).alias("bytes"))
    one = ends.unionByName(chunks).repartition(1).sortWithinPartitions("part", "range", "chunk")
    return one.select("part", "bytes").mapInArrow(run, "state_hash string, section_bytes long, n_accounts long, n_bindings long")


def state_digest(journal: DataFrame, span: int = 10_000) -> DataFrame:
    """SHA-256 of the whole journal as text: its accounts, every event, and the balances, each in the order of LSNs (balances: of the openings).

    A tree: each range of ``span`` LSNs of a section is rendered in many tasks, sorted, and hashed line by line; then the ranges' digests are hashed in order.
    """
    opened = journal.where("type = 'ACCOUNT_OPENED'").select("lsn", "account_id", "kind")
    account = F.format_string("account(%s,%s)", "account_id", "kind")
    entry = lambda e: F.concat_ws(" ", e["side"], e["account_id"], e["amount_minor"].cast("string"))
    tx = F.concat(F.lit("tx["), F.array_join(F.transform("entries", entry), ";"), F.lit("]"))
    keyed = F.concat(F.lit("keyed:"), F.concat_ws("/", "merchant", "key", "fingerprint", F.col("captured_at_ms").cast("string")), F.lit(":"), tx)
    event = F.when(F.col("type") == "ACCOUNT_OPENED", F.concat(F.lit("opened:"), account)).when(F.col("type") == "POSTED", F.concat(F.lit("posted:"), tx)).otherwise(keyed)
    found = balances(opened.withColumnRenamed("lsn", "ordinal"), journal_entries(journal))
    rows = opened.select(F.lit(0).alias("section"), "lsn", account.alias("line"))
    rows = rows.unionByName(journal.where("type <> 'RECOVERY_MARKER'").select(F.lit(1).alias("section"), "lsn", event.alias("line")))
    rows = rows.unionByName(found.select(F.lit(2).alias("section"), F.col("ordinal").alias("lsn"), F.concat_ws("=", "account_id", F.col("balance_minor").cast("string")).alias("line")))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, digest, done = None, None, []
        for batch in batches:
            for section, range_, line in zip(*(batch.column(c).to_pylist() for c in ("section", "range", "line"))):
                if (section, range_) != now:
                    if now:
                        done.append((*now, digest.hexdigest()))
                    now, digest = (section, range_), hashlib.sha256()
                if line is not None:
                    digest.update(f"{line}\n".encode())
        if now:
            done.append((*now, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), (pa.int32(), pa.int64(), pa.string()))], ["section", "range", "digest"])

    ranged = rows.withColumn("range", F.floor(F.col("lsn") / span)).select("section", "range", "lsn", "line")
    ordered = ranged.repartition("section", "range").sortWithinPartitions("section", "range", "lsn", "line")
    tree = ordered.mapInArrow(run, "section int, range long, digest string").withColumn("line", F.concat_ws(":", "section", "range", "digest"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("section", "range", "line"))), lambda r: F.concat(r["line"], F.lit("\n")))  # a row a range
    return tree.agg(F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("digest"))


def lsn_gaps(journal: DataFrame, span: int = SPAN) -> DataFrame:
    """(lsn, problem) where an LSN isn't the one before plus 1 (the first: 1): GAP before it, or REPEATED.

    Each range of ``span`` numbers is compared within itself, its first record with the last of the range before.
    """
    ranged = journal.select("lsn", F.floor(F.col("lsn") / span).alias("_range"))
    before = ranged.groupBy((F.col("_range") + 1).alias("_range")).agg(F.max("lsn").alias("_before"))  # of the range before; without one there is a gap
    lag = F.lag("lsn").over(Window.partitionBy("_range").orderBy("lsn"))
    step = F.col("lsn") - F.coalesce("_own", "_before", F.when(F.col("_range") == 0, 0).otherwise(-1))
    found = ranged.withColumn("_own", lag).join(before, "_range", "left").where(step != 1)
    return found.select("lsn", F.when(step == 0, "REPEATED").otherwise("GAP").alias("problem"))


def reconcile(acks: DataFrame, frames: DataFrame) -> DataFrame:
    """(lsn, forced, problem) of acknowledged records (lsn, forced, digest) that the log's frames (lsn, type, payload) don't hold as they were acknowledged.

    LOST: there is no such record; NOT_AN_EVENT: a marker is in its place; OTHER_BYTES: its payload is another; TWICE: the log has the LSN more than once.
    """
    held = frames.groupBy("lsn").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("type", F.sha2("payload", 256).alias("digest"))).alias("_f"))
    problem = (
        F.when(F.col("_n").isNull(), "LOST")
        .when(F.col("_n") > 1, "TWICE")
        .when(F.col("_f.type") == "RECOVERY_MARKER", "NOT_AN_EVENT")
        .when(F.col("_f.digest") != F.col("digest"), "OTHER_BYTES")
    )
    return acks.join(held, "lsn", "left").select("lsn", "forced", problem.alias("problem")).where("problem is not null")


def lost_acks(acks: DataFrame, frames: DataFrame) -> DataFrame:
    """Acknowledged (lsn, forced) without a frame, counted by forced."""
    return acks.join(frames.select("lsn"), "lsn", "left_anti").groupBy("forced").agg(F.count(F.lit(1)).alias("n_lost"))


def frame_ends(sizes: DataFrame, span: int = SPAN) -> DataFrame:
    """lsn, frame_length and end_offset of records (lsn, frame_length) behind a 16-byte header: prefix sums over ranges of ranges of LSNs."""
    level = lambda name, n: F.floor(F.col("lsn") / n).alias(name)
    ranged = sizes.select("lsn", "frame_length", level("_range", span), level("_super", span * span))
    sums = ranged.groupBy("_super", "_range").agg(F.sum("frame_length").alias("_own"))
    tops = sums.groupBy("_super").agg(F.sum("_own").alias("_n"))  # one row for each 2 ** 32 records
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_super", F.coalesce(F.sum("_n").over(upto(Window.orderBy("_super"))), F.lit(0)).alias("_top"))
    bases = sums.join(F.broadcast(tops), "_super").select("_range", (F.coalesce(F.sum("_own").over(upto(Window.partitionBy("_super").orderBy("_range"))), F.lit(0)) + F.col("_top")).alias("_base"))
    within = Window.partitionBy("_range").orderBy("lsn")
    return ranged.withColumn("_within", F.sum("frame_length").over(within)).join(bases, "_range").select("lsn", "frame_length", (F.col("_within") + F.col("_base") + 16).cast("long").alias("end_offset"))
