"""Secret scans through a trigram inverted index, in DataFrame functions only.

For each rule a Boolean query over trigrams is derived from its regular expression: literal runs must occur, alternatives
are OR-ed, anything else promises nothing. The index holds postings (trigram, text key) of the trigrams that some query
names. Grouping the postings by text intersects them, the queries are evaluated on what is left, and only candidates are
verified with the regular expression. Rules without mandatory trigrams scan every text.

The key of a row is the 64-bit hash of all its columns, so that copies of a text under many ids are dealt to many tasks; should different rows ever share a key,
both are verified against the union of their postings, so no span is lost. Rows without a posting, empty and null texts among them, meet nothing in the join
with the candidates; what they have to be dealt by is their own hash.

Nulls: a null text is empty; a null doc_id is kept. Repeated rows each get their row. Spans are code points, end exclusive. Texts of any length and number of matches take
little more than in proportion (running sums go over blocks of the matches). Other columns are kept whatever their names; only one that is
called ``spans`` is replaced. An empty table gives an empty one.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank_text, let

#: Matches whose running sums are added up one by one; more are taken in blocks of their square root.
BLOCK = 64
#: More literal alternatives than this at one place count as anything.
ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``regex`` whose ``group`` has ``least`` characters or more."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


#: The first three are the base rules; the runs of hex digits and of key ids need their lengths in one match.
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = ("assign", "access", "hex")


def _runs(items) -> list[set[str]]:
    """Sets of literal strings; of each set, one string must occur in a match (lower case)."""
    done: list[set[str]] = []
    now = {""}

    def end(then: set[str]) -> None:
        nonlocal now
        done.append(now)
        now = then

    def add(options: set[str] | None, more: list[set[str]] = ()) -> None:
        nonlocal now
        if options is None or len(now) * len(options) > ALTERNATIVES:
            end({""})
            done.extend(more)
        else:
            now = {a + b for a in now for b in options}

    for op, value in items:
        if op is C.LITERAL:
            add({chr(value).lower()})
        elif op is C.IN and all(kind is C.LITERAL for kind, _ in value):
            add({chr(x).lower() for _, x in value})
        elif op is C.SUBPATTERN:
            inner = _runs(value[3])
            add(inner[0] if len(inner) == 1 else None, inner)
        elif op is C.BRANCH:
            options = [_runs(x) for x in value[1]]
            add(set().union(*(o[0] for o in options)) if all(len(o) == 1 for o in options) else None)
        elif op is C.MAX_REPEAT and value[:2] == (0, 1):
            inner = _runs(value[2])
            add(inner[0] | {""} if len(inner) == 1 else None)
        elif op is C.MAX_REPEAT and value[0] > 0:
            add(None, _runs(value[2]))
        else:
            add(None)
    end({""})
    return done


def trigram_query(regex: str) -> list[list[frozenset[str]]]:
    """A conjunction of disjunctions of trigram sets that any match's text satisfies; empty: no mandatory trigram."""
    query = []
    for options in _runs(parser.parse(regex)):
        if options and all(len(x) >= 3 for x in options):
            query.append(sorted({frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in options}, key=sorted))
    return query


def _satisfied(query, grams: Column) -> Column:
    out = F.lit(True)
    for options in query:
        any_of = F.lit(False)
        for needed in options:
            both = F.lit(True)
            for t in sorted(needed):
                both = both & F.array_contains(grams, t)
            any_of = any_of | both
        out = out & any_of
    return out


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index (trigram, key) of ``docs`` (key, text) over the given lower-case trigrams."""
    every = F.array(*[F.lit(t) for t in trigrams])
    return docs.select("key", F.explode(let(F.lower("text"), lambda low: F.filter(every, lambda t: F.contains(low, t)))).alias("trigram"))


def candidates(docs: DataFrame, rules) -> DataFrame:
    """(key, rules): for each text that satisfies a rule's trigram query, the kinds of these rules."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex))}
    trigrams = sorted({t for q in queries.values() for options in q for needed in options for t in needed})
    grams = postings(docs, trigrams).groupBy("key").agg(F.collect_set("trigram").alias("grams"))  # at most all trigrams
    hit = F.array_compact(F.array(*[F.when(_satisfied(q, F.col("grams")), F.lit(kind)) for kind, q in queries.items()]))
    return grams.select("key", hit.alias("rules")).where(F.size("rules") > 0)


def _blocks(values: Column) -> Column:
    """An array as an array of blocks: a running sum by blocks costs n ** 1.5, while an array that grows in an aggregate is copied for each element."""
    size = F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(F.size(values)))).cast("int")
    return F.when(F.size(values) > 0, let(size, lambda n: F.transform(F.sequence(F.lit(1), F.size(values), n), lambda k: F.slice(values, k, n)))).otherwise(F.slice(F.array(values), 1, 0))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Spans of a rule's leftmost non-overlapping matches that are long enough."""
    regex = F.lit(rule.regex)
    size = lambda strings: F.transform(strings, F.length)
    matches = F.arrays_zip(
        size(F.split(text, rule.regex, -1)).alias("gap"), size(F.regexp_extract_all(text, regex, 0)).alias("size"), size(F.regexp_extract_all(text, regex, rule.group)).alias("part")
    )
    length = lambda ms: F.aggregate(ms, F.lit(0), lambda acc, m: acc + m["gap"] + F.coalesce(m["size"], F.lit(0)))
    total = lambda ns: F.aggregate(ns, F.lit(0), lambda acc, n: acc + n)

    def span(at: Column, m: Column) -> Column:
        return F.when(m["part"] >= rule.least, F.struct((at + m["gap"]).alias("start"), F.lit(order).alias("order"), (at + m["gap"] + m["size"]).alias("end"), F.lit(rule.kind).alias("kind")))

    def of_block(block: Column, base: Column) -> Column:
        return F.array_compact(F.transform(block, lambda m, k: let(base + length(F.slice(block, 1, k)), lambda at: span(at, m))))

    def placed(blocks: Column) -> Column:
        return let(F.transform(blocks, length), lambda sums: F.flatten(F.transform(blocks, lambda block, k: let(total(F.slice(sums, 1, k)), lambda base: of_block(block, base)))))

    return let(matches, lambda ms: let(_blocks(ms), placed))


def find_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` with ``spans`` added: array of (start, order, end, kind) by start, then by the rules' order."""
    kept = [c for c in docs.columns if c != "spans"]
    keyed = docs.select(F.struct(*kept).alias("row"), blank_text().alias("text"), F.xxhash64(*docs.columns).alias("key"))
    found = candidates(keyed.select("key", "text"), rules)
    joined = keyed.join(found, "key", "left")
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    each = []
    for order, rule in enumerate(rules):
        spans = _spans(F.col("text"), rule, order)
        if trigram_query(rule.regex):
            spans = F.when(F.array_contains("rules", rule.kind), spans).otherwise(none)
        else:  # a plain search first: most texts have none
            spans = F.when(F.col("text").rlike(rule.regex), spans).otherwise(none)
        each.append(spans)
    return joined.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], F.array_sort(F.concat(*each)).alias("spans"))


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of ``find_secrets``' rows."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *[of(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(span_list(base).cast("binary"), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, rules=RULES, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with the same columns, where overlapping or touching spans of secrets in ``text`` are replaced by one mask.

    A column n_chars, if there is one, is set to the new length. A null text stays null.
    """
    packed = docs.select("text", F.struct(*docs.columns).alias("row"))
    text = F.col("text").cast("string")
    end = lambda spans: F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0))

    def of_block(block: Column, first: Column, base: Column) -> Column:
        """The text from ``base``, the end of all spans before the block, to the end of its spans; a span that begins behind those before it has a mask."""

        def piece(own: Column, s: Column, k: Column) -> Column:
            upto = F.greatest(base, end(F.slice(block, 1, k)))
            return let(upto, lambda at: F.when((first & (k == 0)) | (s["start"] > at), F.concat(own.substr(at - base + 1, s["start"] - at), F.lit(mask))).otherwise(""))

        return let(text.substr(base + 1, F.greatest(end(block) - base, F.lit(0))), lambda own: F.array_join(F.transform(block, lambda s, k: piece(own, s, k)), ""))

    def masked(blocks: Column) -> Column:
        ends = F.transform(blocks, end)
        whole = lambda es: F.transform(blocks, lambda block, k: let(F.coalesce(F.array_max(F.slice(es, 1, k)), F.lit(0)), lambda base: of_block(block, k == 0, base)))
        return let(ends, lambda es: F.concat(F.array_join(whole(es), ""), text.substr(F.array_max(es) + 1, F.length(text))))

    found = find_secrets(packed, rules)
    found = found.withColumn("clean", F.when(F.size("spans") > 0, let(_blocks(F.col("spans")), masked)).otherwise(text))
    changed = {"text": F.col("clean"), "n_chars": F.coalesce(F.length("clean"), F.lit(0))}
    kinds = dict(docs.dtypes)
    return found.select(*[changed[c].cast(kinds[c]).alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
