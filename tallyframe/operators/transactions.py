"""Operators on transactions, from flat entries (seq, entry_no, account_id, side, amount_minor)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money

ENTRY = "array<struct<account_id:string,side:string,amount_minor:bigint>>"


def nest(entries: DataFrame) -> DataFrame:
    """(seq, entries): each transaction's entries as an array in their order."""
    row = F.struct("entry_no", "account_id", "side", "amount_minor")
    ordered = F.array_sort(F.collect_list(row))
    return entries.groupBy("seq").agg(F.transform(ordered, lambda e: F.struct(e["account_id"].alias("account_id"), e["side"].alias("side"), e["amount_minor"].alias("amount_minor"))).alias("entries"))


def flatten(nested: DataFrame, key: str = "seq") -> DataFrame:
    return nested.select(key, F.posexplode("entries").alias("entry_no", "e")).select(key, "entry_no", "e.account_id", "e.side", "e.amount_minor")


def transfer(source: Column, target: Column, amount: Column) -> Column:
    """The two entries of a transfer: the target is debited first, then the source credited."""
    side = lambda account, name: F.struct(account.alias("account_id"), F.lit(name).alias("side"), amount.alias("amount_minor"))
    return F.array(side(target, "DEBIT"), side(source, "CREDIT"))


def reverse(entries: Column) -> Column:
    """The same entries in the same order with sides swapped."""
    other = lambda e: F.when(e["side"] == "DEBIT", "CREDIT").otherwise("DEBIT")
    return F.transform(entries, lambda e: F.struct(e["account_id"].alias("account_id"), other(e).alias("side"), e["amount_minor"].alias("amount_minor")))


def signed_entries(entries: DataFrame) -> DataFrame:
    return entries.withColumn("signed_minor", money.signed(F.col("side"), F.col("amount_minor")))


def totals(entries: DataFrame) -> DataFrame:
    """seq, n_entries, debits, credits (null beyond a long), overflows, is_balanced."""
    of = lambda side: F.coalesce(money.wide_sum(F.when(F.col("side") == side, F.col("amount_minor"))), F.lit(0).cast(money.WIDE))
    out = entries.groupBy("seq").agg(F.count(F.lit(1)).alias("n_entries"), of("DEBIT").alias("d"), of("CREDIT").alias("c"))
    over = ~(money.fits(F.col("d")) & money.fits(F.col("c")))
    return out.select("seq", "n_entries", money.narrow(F.col("d")).alias("debits"), money.narrow(F.col("c")).alias("credits"), over.alias("overflows"), ((F.col("d") == F.col("c")) & ~over).alias("is_balanced"))


def net_effects(entries: DataFrame) -> DataFrame:
    """seq, account_id, net_minor."""
    net = money.wide_sum(money.signed(F.col("side"), F.col("amount_minor")))
    return entries.groupBy("seq", "account_id").agg(net.cast("long").alias("net_minor"))


def touched_accounts(entries: DataFrame) -> DataFrame:
    """seq, account_id, place: each transaction's accounts by their first entry, from 0."""
    from pyspark.sql import Window

    first = entries.groupBy("seq", "account_id").agg(F.min("entry_no").alias("first"))
    return first.select("seq", "account_id", (F.row_number().over(Window.partitionBy("seq").orderBy("first")) - 1).cast("long").alias("place"))


def render(entries: Column) -> Column:
    """Text like ``Transaction[DEBIT 1.00 -> a, CREDIT 1.00 -> b]``."""
    one = lambda e: F.concat(e["side"], F.lit(" "), money.major_string(e["amount_minor"]), F.lit(" -> "), e["account_id"])
    return F.concat(F.lit("Transaction["), F.array_join(F.transform(entries, one), ", "), F.lit("]"))
