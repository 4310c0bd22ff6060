"""A ledger on files: a log of segments and checkpoints beside it; writing, recovery, and recovery's own audit.

Recovery reads the log's clean prefix, takes the newest checkpoint that verifies against it, and folds the records behind the watermark onto the checkpoint's
state; without a valid checkpoint it folds everything. A torn log is repaired into a new folder first; a corrupt one is refused, and so is one that doesn't hold
the stored response of a restored binding.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, ledger
from ..session import cut, shared_folder
from . import checkpoints, wal


@dataclass(frozen=True)
class Recovered:
    """The state behind the log: accounts with balances, bindings, the records, the checkpoint that was used (no row: none), what was refused and found."""

    balances: DataFrame
    bindings: DataFrame
    events: DataFrame
    tail: DataFrame
    report: DataFrame
    checkpoints: DataFrame
    watermark: int
    last_lsn: int
    findings: DataFrame


def read_log(spark: SparkSession, log: str) -> tuple[DataFrame, DataFrame]:
    """The ends (lsn, end_offset) and the decoded events of the log's clean prefix, walked through and decoded once."""
    frames = wal.clean_frames(cut(wal.read_wal(spark, log), "frames"))
    return checkpoints.log_ends(frames), cut(wal.decode_events(frames), "events")


def checkpoint(spark: SparkSession, log: str, folder: str, upto: int, retain: int = 2, base: Recovered | None = None, read: tuple[DataFrame, DataFrame] | None = None) -> list[str]:
    """Write the checkpoint of the log's records up to LSN ``upto``; returns the names of old files that were deleted. ``read``: the log's ``read_log``, for several checkpoints of one log, or what its writer has at hand instead: where the record ends, and the journal."""
    places, events = read or read_log(spark, log)
    events = events.where(F.col("lsn") <= upto)
    opened = events.where("type = 'ACCOUNT_OPENED'").select(F.col("lsn").alias("ordinal"), "account_id", "kind")
    ends = places.where(F.col("lsn") == upto).first()
    covered = ends.end_offset if ends else wal.HEADER
    digest = wal.prefix_digests(spark, log, spark.createDataFrame([(covered,)], "covered_bytes long")).first().digest
    return checkpoints.write_checkpoint(folder, ledger.balances(opened, ledger.journal_entries(events)), ledger.bindings(events), upto, covered, digest, retain)


def write_log(spark: SparkSession, journal: DataFrame, log: str, folder: str, policy: checkpoints.Policy = checkpoints.Policy(), records: int = 100_000) -> int:
    """Write a journal's segments and the last checkpoints that ``policy`` takes on the way; returns how many checkpoints were due.

    The policy counts records. Only the ``policy.retain`` last of the checkpoints due would be left behind, so only these are written.
    """
    last = journal.agg(F.coalesce(F.max("lsn"), F.lit(0))).first()[0]
    wal.write_segments(journal, log, records).write.format("noop").mode("overwrite").save()
    due = last // policy.every if policy.every else 0
    read = read_log(spark, log) if due else None
    for k in range(max(1, due - policy.retain + 1), due + 1):
        checkpoint(spark, log, folder, k * policy.every, policy.retain, read=read)
    return due


def recover(spark: SparkSession, log: str, folder: str | None = None, repair: bool = True) -> Recovered:
    """Open the ledger whose log is below ``log`` and whose checkpoints are below ``folder``.

    A tear raises unless ``repair``; then recovery goes on in a repaired copy of the log. Corrupt segments raise, and so does a finding of the audit.
    """
    found = cut(wal.read_wal(spark, log), "frames")
    report = cut(wal.report(found), "report")
    corrupt = report.where("corruption is not null").limit(1).collect()
    if corrupt:
        raise ValueError(f"{corrupt[0].corruption} in {corrupt[0].file}: {corrupt[0].detail}")
    torn = report.where(wal.is_tear(F.col("tail"))).limit(1).collect()
    at = log
    if torn:
        if not repair:
            raise ValueError(f"the log is torn ({torn[0].tail} in {torn[0].file}) and repair is off")
        at = shared_folder(spark, "repaired")
        wal.repair(spark, log, at).write.format("noop").mode("overwrite").save()
        found = cut(wal.read_wal(spark, at), "frames")
    frames = wal.clean_frames(found, None if torn else report)
    events = cut(wal.decode_events(frames), "events")
    malformed = events.where("corruption is not null").limit(1).collect()
    if malformed:
        raise ValueError(f"{malformed[0].corruption} in record {malformed[0].lsn}")

    # A checkpoint covers bytes of the log as it was written: the repaired copy begins with the same bytes, but ends with a marker.
    seen = checkpoints.verified(spark, at, folder, found, frames) if folder and checkpoints.exist(folder) else None
    tried = cut(seen, "checkpoints") if seen is not None else spark.createDataFrame([], checkpoints.COLUMNS)
    chosen = cut(checkpoints.newest_valid(tried), "chosen")
    top = chosen.select("watermark").first()
    watermark = top.watermark if top else 0
    tail = events.where(F.col("lsn") > watermark)
    old, keys = cut(checkpoints.accounts_in(chosen), "accounts"), cut(checkpoints.bindings_in(chosen), "bindings")
    # A binding's response is not in the checkpoint, but in the record that the binding names.
    responses = events.where("type = 'IDEMPOTENT_POSTING'").select(F.col("lsn").alias("response_lsn"))
    dangling = keys.join(responses, "response_lsn", "left_anti").limit(1).collect()
    if dangling:
        raise ValueError(f"DOMAIN_REJECTED: a binding of {dangling[0].merchant} names record {dangling[0].response_lsn}, which is no keyed posting")
    # Restored accounts have their places in the checkpoint, which are no greater than its watermark; later ones the LSNs of their openings.
    opened = tail.where("type = 'ACCOUNT_OPENED'").select(F.col("lsn").alias("ordinal"), "account_id", "kind")
    accounts = old.select("ordinal", "account_id", "kind").unionByName(opened)
    bound = ledger.bindings(tail, keys)
    violations = audit.replay_violations(tail, old, keys)
    folded = cut(ledger.folded(accounts, ledger.journal_entries(tail), old), "folded")
    checked = audit.audit(tail, accounts, folded.select("account_id", F.col("wide").alias("balance_minor")), bound, old, keys)
    findings = violations.select(F.col("rule"), F.col("lsn").cast("string").alias("subject")).unionByName(checked)
    findings = cut(findings, "findings")
    if findings.limit(1).count():
        bad = findings.first()
        raise ValueError(f"the log can't be folded: {bad.rule} at {bad.subject}")
    last = events.where("type <> 'RECOVERY_MARKER'").agg(F.coalesce(F.max("lsn"), F.lit(0))).first()[0]
    return Recovered(ledger.narrowed(folded), bound, events, tail, report, tried, watermark, last, findings)
