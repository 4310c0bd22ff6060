"""Streaming ingest: a micro-batch is a group commit.

Attempts arrive in files; each micro-batch is decided against the ledger's state, and its admissions are appended with the next dense LSNs. The state is kept as
tables of what each batch changed (``accounts``, ``balances`` of the accounts it touched, ``bindings``), of which a batch reads the rows of its own accounts
and keys only; what was decided before is never decided again. After ``every`` batches the changes are compacted to a new snapshot, so that a batch reads one
snapshot and a bounded number of changes, however many batches there were.

The output of a batch is a folder named by its id in each table, written whole or not at all, so a batch that is run again after a failure replaces its
own output and reads nothing of it: ``meta``, written last, says what is complete. Order is ``seq``: a batch must not begin at or before the last seq that was
decided, whatever its outcome. ``acks`` has a row for each appended record; the batch's files are committed, so all of them are forced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import money
from ..operators import admission, ledger
from ..session import cut
from ..sources import wal

JOURNAL = (
    "lsn long, seq long, type string, account_id string, kind string, merchant string, key string, fingerprint string, captured_at_ms long, "
    "entries array<struct<account_id:string,side:string,amount_minor:bigint>>"
)
OUTCOMES = "seq long, op string, outcome string, reason string, bound_seq long"
META = "last_seq long, last_lsn long, attempts long, admitted long, bytes long, snapshot long"
STATE = {
    "accounts": "account_id string, kind string, lsn long",
    "balances": "account_id string, balance_minor long",
    "bindings": "merchant string, key string, fingerprint string, captured_at_ms long, bound_seq long, response_lsn long",
}
ACKS = "lsn long, seq long, frame_length long, forced boolean, digest string"
#: Batches between two snapshots of the state.
EVERY = 16


def _table(spark: SparkSession, folder: str, name: str, schema: str, first: int, end: int) -> DataFrame:
    """What the batches from ``first`` to before ``end`` wrote to a table, with their ``batch``."""
    try:
        found = spark.read.schema(schema + ", batch long").parquet(f"{folder}/{name}")
    except Exception as e:  # noqa: BLE001  no batch has written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema + ", batch long")
    return found.where((F.col("batch") >= first) & (F.col("batch") < end))


def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last batch's row of each key."""
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


_KEYS = {"accounts": ["account_id"], "balances": ["account_id"], "bindings": ["merchant", "key"]}


def state_before(spark: SparkSession, folder: str, batch: int, snapshot: int, only: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The state's tables before ``batch``, from the snapshot that batch ``snapshot`` wrote (-1: none); ``only``: rows with these keys."""
    out = {}
    for name, schema in STATE.items():
        rows = _table(spark, folder, name, schema, snapshot + 1, batch)
        if snapshot >= 0:
            rows = rows.unionByName(_table(spark, folder, f"snapshot_{name}", schema, snapshot, snapshot + 1))
        if only is not None:
            rows = rows.join(only[name], _KEYS[name], "left_semi")
        out[name] = _latest(rows, _KEYS[name])
    return out


def commit_batch(rows: DataFrame, batch: int, folder: str, retention_ms: int = admission.DAY_MS, every: int = EVERY) -> None:
    """Decide one micro-batch and write its outcomes, journal records, acks and changes of state under its id."""
    spark = rows.sparkSession
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")
    meta = _table(spark, folder, "meta", META, 0, batch).orderBy(F.desc("batch")).limit(1).collect()
    last_seq, last_lsn, snapshot = (meta[0].last_seq, meta[0].last_lsn, meta[0].snapshot) if meta else (None, 0, -1)
    rows = cut(rows, "batch")
    first, n, most = rows.agg(F.min("seq"), F.count(F.lit(1)), F.max("seq")).first()
    if not n:
        return
    if last_seq is not None and first <= last_seq:
        raise ValueError(f"seq {first} comes after seq {last_seq} was decided")

    if meta:
        named = rows.select(F.explode("entries").alias("e")).select("e.account_id").unionByName(rows.where("op = 'OPEN'").select("account_id")).distinct()
        keys = rows.where("op = 'POST_KEYED'").select("merchant", "key").distinct()
        before = {k: cut(v, k) for k, v in state_before(spark, folder, batch, snapshot, {"accounts": named, "balances": named, "bindings": keys}).items()}
    else:
        before = {k: spark.createDataFrame([], v) for k, v in STATE.items()}  # no batch before this one is complete, so there is nothing to look up
    decided = cut(admission.decide(rows, retention_ms, admission.State(**before) if meta else None), "decided")
    put(decided.select("seq", "op", "outcome", "reason", "bound_seq"), "outcomes")
    put(ledger.journal_from(decided, start=last_lsn + 1), "journal")

    new = spark.read.schema(JOURNAL).parquet(f"{folder}/journal/batch={batch}")
    framed = wal.payloads(new, "seq")
    acks = framed.select("lsn", "seq", (F.length("payload") + wal.OVERHEAD).cast("long").alias("frame_length"), F.lit(True).alias("forced"), F.sha2("payload", 256).alias("digest"))
    put(acks, "acks")
    opened = new.where("type = 'ACCOUNT_OPENED'")
    put(opened.select("account_id", "kind", "lsn"), "accounts")
    moved = ledger.journal_entries(new).select("account_id", money.signed(F.col("side"), F.col("amount_minor")).alias("m"))
    touched = moved.groupBy("account_id").agg(money.long_sum(F.col("m")).alias("m")).join(before["balances"], "account_id", "left")
    put(touched.select("account_id", (F.coalesce(F.col("balance_minor"), F.lit(0)).cast(money.WIDE) + F.col("m")).cast("long").alias("balance_minor")), "balances")
    keyed = new.where("type = 'IDEMPOTENT_POSTING'")
    put(keyed.select("merchant", "key", "fingerprint", "captured_at_ms", F.col("seq").alias("bound_seq"), F.col("lsn").alias("response_lsn")), "bindings")
    if batch - snapshot >= every:
        for name, table in state_before(spark, folder, batch + 1, snapshot).items():
            put(table, f"snapshot_{name}")
        snapshot = batch
    written = spark.read.schema(ACKS).parquet(f"{folder}/acks/batch={batch}").agg(F.count(F.lit(1)), F.coalesce(F.sum("frame_length"), F.lit(0))).first()
    put(spark.createDataFrame([(most, last_lsn + written[0], n, written[0], written[1], snapshot)], META), "meta")


def stats(spark: SparkSession, folder: str) -> DataFrame:
    """groups (batches that appended), attempts, frames and bytes of all complete batches."""
    meta = _table(spark, folder, "meta", META, 0, 1 << 62)
    return meta.agg(F.count(F.when(F.col("admitted") > 0, 1)).alias("groups"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"), F.coalesce(F.sum("admitted"), F.lit(0)).alias("frames"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def ingest(attempts: DataFrame, folder: str, checkpoint: str, retention_ms: int = admission.DAY_MS, every: int = EVERY) -> StreamingQuery:
    """Start the query over a stream of attempts; it ends when what is there has been decided."""
    return (
        attempts.writeStream.foreachBatch(lambda rows, batch: commit_batch(rows, batch, folder, retention_ms, every))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
