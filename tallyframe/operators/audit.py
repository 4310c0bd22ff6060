"""The audit: every rule that a ledger must keep; all findings are returned, an empty result means a clean ledger.

The rules are checked in one pass for each grain: records by themselves, accounts, keys, and the total.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money
from ..session import cut
from .admission import State, noted_accounts, running_extremes, strays
from .ledger import journal_entries
from .transactions import ENTRY, flatten

RULES = (
    "ACCOUNT_OPENED_TWICE", "TOO_FEW_ENTRIES", "AMOUNT_NOT_POSITIVE", "UNKNOWN_ACCOUNT", "UNBALANCED", "KEY_BOUND_TWICE", "ACCOUNT_INDEX", "BALANCE_INDEX",
    "BINDING_INDEX", "TOTAL_NOT_ZERO", "BALANCE_OVERFLOW",
)


def _found(rows: DataFrame, subject: Column, rules: dict[str, Column]) -> DataFrame:
    """(rule, subject) for each rule whose condition holds in a row."""
    broken = F.array_compact(F.array(*[F.when(condition, F.lit(rule)) for rule, condition in rules.items()]))
    return rows.select(F.explode(broken).alias("rule"), subject.cast("string").alias("subject"))


def _records(journal: DataFrame) -> DataFrame:
    zero = F.lit(0).cast(money.WIDE)
    total = lambda side: F.aggregate("entries", zero, lambda acc, e: (acc + F.when(e["side"] == side, e["amount_minor"]).otherwise(0)).cast(money.WIDE))
    posts = journal.where("type in ('POSTED', 'IDEMPOTENT_POSTING')").select("lsn", F.coalesce("entries", F.array().cast("array<struct<account_id:string,side:string,amount_minor:bigint>>")).alias("entries"))
    return _found(
        posts,
        F.col("lsn"),
        {"TOO_FEW_ENTRIES": F.size("entries") < 2, "AMOUNT_NOT_POSITIVE": F.exists("entries", lambda e: e["amount_minor"] <= 0), "UNBALANCED": total("DEBIT") != total("CREDIT")},
    )


def _accounts(journal: DataFrame, accounts: DataFrame, indexed: DataFrame, base: DataFrame | None) -> DataFrame:
    wide, text = (lambda c: c.cast(money.WIDE)), F.lit(None).cast("string")
    names = ("opened", "kind_opened", "moved", "kind_index", "balance_index", "kind_base", "base")
    kinds = ("long", "string", money.WIDE, "string", money.WIDE, "string", money.WIDE)

    def side(rows: DataFrame, **given: Column) -> DataFrame:
        return rows.select("account_id", *[given.get(c, F.lit(None)).cast(k).alias(c) for c, k in zip(names, kinds)])

    # Summed up first: the aggregate below has texts among its values, for which Spark sorts all that goes into it.
    moves = journal_entries(journal).groupBy("account_id").agg(money.long_sum(money.signed(F.col("side"), F.col("amount_minor"))).alias("m"))
    parts = [
        side(journal.where("type = 'ACCOUNT_OPENED'"), opened=F.lit(1), kind_opened=F.col("kind")),
        side(moves, moved=F.col("m")),
        side(accounts, kind_index=F.coalesce("kind", F.lit(""))),
        side(indexed, balance_index=F.col("balance_minor")),
    ]
    if base is not None:
        parts.append(side(base, kind_base=F.coalesce("kind", F.lit("")), base=F.col("balance_minor")))
    per = reduce(DataFrame.unionByName, parts).groupBy("account_id").agg(
        F.count("opened").alias("opened"), F.min("kind_opened").alias("kind_opened"), F.max("kind_opened").alias("kind_also"), F.sum("moved").alias("moved"), F.max("kind_index").alias("kind_index"),
        F.max("balance_index").alias("balance_index"), F.max("kind_base").alias("kind_base"), F.sum("base").alias("base"),
    )
    known, logged, restored = F.col("kind_index").isNotNull(), F.col("opened") > 0, F.col("kind_base").isNotNull()
    fold = wide(F.coalesce("moved", F.lit(0)) + F.coalesce("base", F.lit(0)))
    origin = F.coalesce("kind_opened", "kind_base")
    return _found(
        per,
        F.col("account_id"),
        {
            "ACCOUNT_OPENED_TWICE": F.col("opened") > 1,
            "UNKNOWN_ACCOUNT": ~known & F.col("moved").isNotNull(),
            # The index is what the log opened and what was restored, each account once, with its kind.
            "ACCOUNT_INDEX": (known != (logged | restored)) | (logged & restored) | (known & (logged | restored) & ((origin != F.col("kind_index")) | (F.col("kind_also") != F.col("kind_index")))),
            "BALANCE_INDEX": (known | F.col("balance_index").isNotNull()) & ~F.when(known, fold).eqNullSafe(F.col("balance_index")),
            "BALANCE_OVERFLOW": known & ~money.fits(fold),
        },
    )


def _keys(journal: DataFrame, bound: DataFrame, base: DataFrame | None) -> DataFrame:
    empty = F.lit(None).cast("string")
    side = lambda rows, at: rows.select("merchant", "key", *[(F.coalesce("fingerprint", F.lit("")) if k == at else empty).alias(f"f{k}") for k in range(3)])
    parts = [side(journal.where("type = 'IDEMPOTENT_POSTING'"), 0), side(bound, 1)] + ([side(base, 2)] if base is not None else [])
    per = reduce(DataFrame.unionByName, parts).groupBy("merchant", "key").agg(*[f(f"f{k}").alias(f"{n}{k}") for k in range(3) for f, n in ((F.count, "n"), (F.min, "f"), (F.max, "g"))])
    logged, known, restored = (F.col(f"n{k}") > 0 for k in range(3))
    origin = F.when(logged, F.col("f0")).otherwise(F.col("f2"))
    differs = (origin != F.col("f1")) | (F.col("g0") != F.col("g1"))
    rules = {"KEY_BOUND_TWICE": F.col("n0") > 1, "BINDING_INDEX": (known != (logged | restored)) | (logged & restored) | (F.col("n1") > 1) | F.coalesce(known & differs, F.lit(False))}
    return _found(per, F.concat_ws("/", "merchant", "key"), rules)


def audit(journal: DataFrame, accounts: DataFrame, indexed: DataFrame, bound: DataFrame, base: DataFrame | None = None, base_bindings: DataFrame | None = None) -> DataFrame:
    """(rule, subject) violations of a journal against its account table, balance index and binding index.

    ``base`` (account_id, kind, balance_minor) and ``base_bindings`` (merchant, key, fingerprint) are what a snapshot restored before the journal. Balances
    are compared as wide decimals, so a fold beyond 64 bits is a finding, not an error.
    """
    indexed = cut(indexed, "indexed")  # read for its accounts and for its total
    total = indexed.agg(F.coalesce(money.wide_sum(F.col("balance_minor")), F.lit(0)).cast(money.WIDE).alias("t"))
    of_total = _found(total, F.lit("TOTAL"), {"TOTAL_NOT_ZERO": F.col("t") != 0, "BALANCE_OVERFLOW": ~money.fits(F.col("t"))})
    return reduce(DataFrame.unionByName, [_records(journal), _accounts(journal, accounts, indexed, base), _keys(journal, bound, base_bindings), of_total])


def replay_violations(journal: DataFrame, base: DataFrame | None = None, base_bindings: DataFrame | None = None) -> DataFrame:
    """(lsn, rule): records that a replay refuses: a repeated opening or binding, or a posting that isn't balanced between known accounts.

    ``base`` (account_id) and ``base_bindings`` (merchant, key) were restored before the first record.
    """
    opens = journal.where("type = 'ACCOUNT_OPENED'").select("account_id", "lsn")
    if base is not None:
        opens = opens.unionByName(base.select("account_id", F.lit(0).cast("long").alias("lsn")))
    first_open = opens.groupBy("account_id").agg(F.min("lsn").alias("first"))
    twice = opens.where("lsn > 0").join(first_open, "account_id").where("lsn > first").select("lsn", F.lit("DUPLICATE_ACCOUNT").alias("rule"))
    keyed = journal.where("type = 'IDEMPOTENT_POSTING'").select("merchant", "key", "lsn")
    if base_bindings is not None:
        keyed = keyed.unionByName(base_bindings.select("merchant", "key", F.lit(0).cast("long").alias("lsn")))
    first_key = keyed.groupBy("merchant", "key").agg(F.min("lsn").alias("first"))
    rebound = keyed.where("lsn > 0").join(first_key, ["merchant", "key"]).where("lsn > first").select("lsn", F.lit("DUPLICATE_BINDING").alias("rule"))
    # As in admission: accounts are looked at once, in one aggregate; only those that are not open in time, or may overflow, get a second look. The rest is decided in a record's row.
    posts = journal.where("type in ('POSTED', 'IDEMPOTENT_POSTING')").select(F.col("lsn").alias("seq"), F.coalesce("entries", F.array().cast(ENTRY)).alias("entries"))
    held = base if base is not None and "balance_minor" in base.columns else None
    noted = noted_accounts(posts, first_open.withColumnRenamed("first", "open_seq"), None if held is None else State(held, held, held))
    unopened = strays(posts, noted)
    known = posts.withColumn("_from", F.lit(None).cast("long")) if unopened is None else posts.join(unopened, "seq", "left")
    net = F.aggregate("entries", F.lit(0).cast(money.WIDE), lambda acc, e: (acc + money.signed(e["side"], e["amount_minor"])).cast(money.WIDE))
    rule = F.when(F.exists("entries", lambda e: e["amount_minor"] <= 0), "AMOUNT_NOT_POSITIVE").when(F.size("entries") < 2, "TOO_FEW_ENTRIES").when(F.col("_from").isNotNull(), "UNKNOWN_ACCOUNT").when(net != 0, "UNBALANCED")
    refused = known.select(F.col("seq").alias("lsn"), rule.alias("rule")).where("rule is not null")
    found = [twice, rebound, refused]
    doubtful = noted.where("doubtful").select("account_id")
    if doubtful.limit(1).count():
        touched = flatten(posts).join(doubtful, "account_id", "left_semi").groupBy("seq").agg(F.collect_list(F.struct("account_id", "side", "amount_minor")).alias("entries"))
        over = running_extremes(touched, held).where(~money.fits(F.col("running")))
        found.append(over.select(F.col("seq").alias("lsn"), F.lit("OVERFLOWING_BALANCE").alias("rule")).distinct())
    return reduce(DataFrame.unionByName, found)
