"""The ledger that the driver tables imply: accounts, order postings (some deliberately bad), keyed postings of events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.transactions import ENTRY, transfer
from ..session import cut, table

#: Openings come before every posting; ordinals leave each table its own range, so that no global numbering is needed.
SUPPLIERS, EQUITY = 1_000_000_000_000, 2_000_000_000_000
KEYED = 4_000_000_000_000
WEEK_MS = 604_800_000


def accounts(spark: SparkSession, d: str) -> DataFrame:
    cust = table(spark, d, "customer").select(F.col("c_custkey").alias("ordinal"), F.concat(F.lit("cust-"), F.col("c_custkey")).alias("account_id"), F.lit("ASSET").alias("kind"))
    supp = table(spark, d, "supplier").select((F.col("s_suppkey") + SUPPLIERS).alias("ordinal"), F.concat(F.lit("supp-"), F.col("s_suppkey")).alias("account_id"), F.lit("LIABILITY").alias("kind"))
    equity = spark.range(1).select(F.lit(EQUITY).alias("ordinal"), F.lit("equity").alias("account_id"), F.lit("EQUITY").alias("kind"))
    return cust.unionByName(supp).unionByName(equity)


def _cents(name: str) -> Column:
    """Hundredths, rounded half away from zero as ``round`` does it, which takes doubles through their text."""
    value = F.col(name) * 100
    rest = F.abs(value) % 1
    return (F.signum(value) * (F.abs(value) - rest + F.when(rest >= 0.5, 1.0).otherwise(0.0))).cast("long")


def order_entries(spark: SparkSession, d: str, bad: bool = False) -> DataFrame:
    """seq, entry_no, account_id, side, amount_minor: one transaction an order; ``bad`` breaks some by their order key."""
    net = F.expr("(e * (100 - x)) div 100")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", _cents("l_extendedprice").alias("e"), _cents("l_discount").alias("x"))
    lines = lines.withColumn("net", net).where("net > 0")
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "net")
    credits = lines.select(F.col("l_orderkey").alias("seq"), F.row_number().over(place).alias("entry_no"), F.concat(F.lit("supp-"), F.col("l_suppkey")).alias("account_id"), F.lit("CREDIT").alias("side"), F.col("net").alias("amount_minor"))
    sums = lines.groupBy(F.col("l_orderkey").alias("seq")).agg(F.sum("net").alias("amount_minor"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("cust-"), F.col("o_custkey")).alias("account_id"))
    debits = sums.join(orders, "seq").select("seq", F.lit(0).alias("entry_no"), "account_id", F.lit("DEBIT").alias("side"), "amount_minor")
    if bad:
        mod = lambda n: F.col("seq") % n == 0
        credits = credits.where(~mod(97))
        account = F.when(mod(89) & ~mod(97), F.concat(F.lit("ghost-"), F.col("seq"))).otherwise(F.col("account_id"))
        amount = F.when(mod(79), 0).when(mod(83), F.col("amount_minor") + 1).otherwise(F.col("amount_minor"))
        debits = debits.select("seq", "entry_no", account.alias("account_id"), "side", amount.cast("long").alias("amount_minor"))
    return debits.unionByName(credits)


def order_postings(spark: SparkSession, d: str) -> DataFrame:
    """(seq, entries) of ``order_entries`` with the bad ones: orders and their lines meet in one shuffle, sorted, and are put together some thousand rows at a time.

    As lists of an aggregate they would be sorted and copied twice more, on either side of the shuffle.
    """
    null = lambda name: F.lit(None).cast("long").alias(name)
    long = lambda c, name: F.col(c).cast("long").alias(name)
    lines = table(spark, d, "lineitem").select(long("l_orderkey", "seq"), long("l_linenumber", "no"), long("l_suppkey", "party"), _cents("l_extendedprice").alias("e"), _cents("l_discount").alias("x"))
    lines = lines.select("seq", F.lit(1).alias("kind"), "no", "party", F.expr("(e * (100 - x)) div 100").alias("net")).where("seq is not null and net > 0")
    orders = table(spark, d, "orders").select(long("o_orderkey", "seq"), F.lit(0).alias("kind"), null("no"), long("o_custkey", "party"), null("net")).where("seq is not null")
    met = lines.unionByName(orders).repartition("seq").sortWithinPartitions("seq", "kind", "no", "party", "net")
    return met.select("seq", "kind", "party", "net").mapInArrow(_together, f"seq long, entries {ENTRY}")


def _together(batches: Iterator) -> Iterator:
    """Postings of rows (seq, kind, party, net) in the order of seq and kind; what a batch has of its last seq waits for the next batch."""
    import pyarrow as pa

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
        seqs = rows.column("seq").to_numpy()
        whole = int(np.searchsorted(seqs, seqs[-1])) if len(seqs) else 0
        held = rows.slice(whole)
        yield from _posted(rows.slice(0, whole))
    if held is not None:
        yield from _posted(held)


def _posted(rows) -> Iterator:
    import pyarrow as pa
    import pyarrow.compute as pc

    if not len(rows):
        return
    seqs, lines, nets = rows.column("seq").to_numpy(), rows.column("kind").to_numpy() == 1, rows.column("net").fill_null(0).to_numpy()
    starts = np.concatenate(([0], np.flatnonzero(np.diff(seqs)) + 1))
    group = np.repeat(np.arange(len(starts)), np.diff([*starts, len(seqs)]))
    sums = np.add.reduceat(nets, starts)
    if ((sums < 0) | (np.add.reduceat(nets.astype(float), starts) > 1e19)).any():
        raise ValueError("an order beyond 64 bits")
    mod = lambda n: seqs % n == 0
    kept = np.where(lines, ~mod(97), (np.add.reduceat(lines.astype(np.int64), starts) > 0)[group])
    ghost = ~lines & mod(89) & ~mod(97)
    amounts = np.where(lines, nets, np.where(mod(79), 0, np.where(mod(83), sums[group] + 1, sums[group])))
    chosen = pa.array(kept)
    names = lambda index, words: pa.DictionaryArray.from_arrays(pa.array(index[kept].astype(np.int32)), words).cast(pa.string())
    number = pc.if_else(pa.array(ghost), pa.array(seqs), rows.column("party").combine_chunks()).filter(chosen).cast(pa.string())
    accounts = pc.binary_join_element_wise(names(np.where(lines, 2, ghost), ["cust-", "ghost-", "supp-"]), number, "")
    entries = pa.StructArray.from_arrays([accounts, names(lines, ["DEBIT", "CREDIT"]), pa.array(amounts[kept])], ["account_id", "side", "amount_minor"])
    sizes = np.bincount(group[kept], minlength=len(starts))
    found = sizes > 0
    ends = np.concatenate(([0], np.cumsum(sizes[found]))).astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(seqs[starts][found]), pa.ListArray.from_arrays(pa.array(ends), entries)], ["seq", "entries"])


def keyed_attempts(spark: SparkSession, d: str) -> DataFrame:
    """One keyed transfer an event; a user's key lasts a week, its body alternates with the value."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", ms.alias("now_ms"), (1 + F.floor("value") % 2).cast("long").alias("amount"))
    user = F.concat(F.lit("user-"), F.col("user_id"))
    return e.select(
        F.col("event_id").alias("seq"),
        F.lit("POST_KEYED").alias("op"),
        F.lit(None).cast("string").alias("account_id"),
        F.lit(None).cast("string").alias("kind"),
        F.concat(F.lit("m-"), F.col("event_type")).alias("merchant"),
        F.concat(user, F.lit("-w"), F.expr(f"now_ms div {WEEK_MS}")).alias("key"),
        "now_ms",
        transfer(user, F.lit("pool"), F.col("amount")).alias("entries"),
    )


def _opens(found: DataFrame, seq) -> DataFrame:
    empty = lambda kind: F.lit(None).cast(kind)
    return found.select(
        seq.alias("seq"), F.lit("OPEN").alias("op"), "account_id", "kind", empty("string").alias("merchant"), empty("string").alias("key"), empty("long").alias("now_ms"),
        empty("array<struct<account_id:string,side:string,amount_minor:bigint>>").alias("entries"),
    )


def order_attempts(spark: SparkSession, d: str) -> DataFrame:
    posts = order_postings(spark, d)
    empty = lambda kind: F.lit(None).cast(kind)
    posts = posts.select("seq", F.lit("POST").alias("op"), empty("string").alias("account_id"), empty("string").alias("kind"), empty("string").alias("merchant"), empty("string").alias("key"), empty("long").alias("now_ms"), "entries")
    # Attempts are a table that admission reads several times; deriving them from the lines of orders is done once.
    return cut(_opens(accounts(spark, d), F.col("ordinal") - 2 * EQUITY).unionByName(posts), "attempts")


def user_accounts(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").select("user_id").distinct().select(F.col("user_id").alias("ordinal"), F.concat(F.lit("user-"), F.col("user_id")).alias("account_id"), F.lit("LIABILITY").alias("kind"))
    return users.unionByName(spark.range(1).select(F.lit(EQUITY).alias("ordinal"), F.lit("pool").alias("account_id"), F.lit("ASSET").alias("kind")))


def event_attempts(spark: SparkSession, d: str) -> DataFrame:
    return _opens(user_accounts(spark, d), F.col("ordinal") - 2 * EQUITY).unionByName(keyed_attempts(spark, d))
