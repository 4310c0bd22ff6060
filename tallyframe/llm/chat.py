"""Chat formatting in windows of a token budget.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a backslash is doubled and ``<|`` becomes ``<\\|`` (in roles a line
break becomes ``\\n``), so control strings can't be forged and everything can be read back.

Prefix sums of the turns' tokens choose spans of whole turns. A conversation that begins with a system turn repeats it in every window; ``room`` is what
it leaves of the budget. With a step of half the room, a turn belongs to the span (tokens before it) div step, counted anew from each turn longer than
the step, which gets a span of its own. So spans fit the room, except that one turn beyond the room makes a window beyond the budget, marked ``over``.
What a span leaves of the room is filled with the last turns before it, at most ``history`` tokens. Repeated turns are masked: the loss mask covers the
texts of the span's own assistant turns, so that every assistant text is learned once.

Order within a conversation: turn, role, text; null turns first. Null roles and texts are empty, a null conv_id is a conversation. Repeated rows are
separate turns. Other columns are dropped, whatever their names; an empty table gives an empty one. Windows are bounded by the budget, but for a turn beyond it; only the
digest of ``read_back`` runs through a conversation in order, and keeps no more than a hash state.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices
from .tokens import encoder

BUDGET = 1024
HISTORY = 256
START, STOP = "<|im_start|>", "<|im_end|>\n"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text begins and ends."""
    head = START + escape(role).replace("\n", "\\n") + "\n"
    body = escape(text)
    return head + body + STOP, len(head), len(head) + len(body)


def turn_tokens(turns: DataFrame, tokenizer: str) -> DataFrame:
    """``turns`` (role, text, ...; no nulls) with tokens, the number of the formatted turn's tokens, added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in slices(batches, "text", 4_000_000):
            made = [format_turn(r, t)[0] for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(x) // enc.dtype.itemsize for x in enc.encode(made)], pa.int64())], [*batch.schema.names, "tokens"])

    return turns.mapInArrow(run, ", ".join([f"{c} {kind}" for c, kind in turns.dtypes] + ["tokens long"]))


def _bases(sums: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """For each stretch (_p, conv_id) the aggregates of the conversation's stretches before it; a row a stretch."""
    before = Window.partitionBy("conv_id").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_p", F.col("conv_id").alias("_c"), *[F.coalesce(c.over(before), F.lit(0)).cast("long").alias(name) for name, c in columns.items()])


def _placed(turns: DataFrame, tokenizer: str, budget: int) -> DataFrame:
    """Turns with n (place in the conversation, from 1), start (tokens before), system, kept, room, longs and share.

    A long conversation is no single task: turns are dealt by ranges of their order, running values are taken within each stretch of a conversation
    in a range, and the stretches' sums are added up in order.
    """
    order = ["conv_id", "turn", "role", "text"]
    # Equal turns are dealt by their place in the input; the ranges' bounds are sampled, so what they gave is written.
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    plain = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *filled, (F.monotonically_increasing_id() % 997).alias("_row"))
    dealt = cut(turn_tokens(plain.repartitionByRange(*order, "_row").withColumn("_p", F.spark_partition_id()), tokenizer), "ranges")
    stretch = Window.partitionBy("_p", "conv_id").orderBy("turn", "role", "text", "_row")
    before, upto = stretch.rowsBetween(Window.unboundedPreceding, -1), stretch.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.col("conv_id").eqNullSafe(F.col("_c"))

    at = dealt.withColumn("_n", F.row_number().over(stretch)).withColumn("_start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    sums = dealt.groupBy("_p", "conv_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("tokens").alias("all"), F.min(F.struct("turn", "role", "text", "_row", "tokens")).alias("head"))
    head = F.first("head").over(Window.partitionBy("conv_id").orderBy("_p"))
    bases = _bases(sums, {"_rows": F.sum("rows"), "_all": F.sum("all")})
    heads = sums.select(F.col("_p").alias("_hp"), F.col("conv_id").alias("_hc"), F.when(head["role"] == "system", head["tokens"]).otherwise(0).alias("kept"))
    bases = bases.join(heads, (F.col("_p") == F.col("_hp")) & F.col("_c").eqNullSafe(F.col("_hc"))).select(F.col("_p").alias("_q"), "_c", "_rows", "_all", "kept")
    at = at.join(bases, (F.col("_p") == F.col("_q")) & same).drop("_q", "_c")
    at = at.withColumn("n", (F.col("_n") + F.col("_rows")).cast("long")).withColumn("start", F.col("_start") + F.col("_all"))
    at = at.withColumn("system", (F.col("n") == 1) & (F.col("role") == "system")).withColumn("room", F.greatest(F.lit(budget) - F.col("kept"), F.lit(2)))
    at = at.withColumn("step", F.floor(F.col("room") / 2)).withColumn("_long", F.col("tokens") > F.col("step"))
    at = at.withColumn("_longs", F.sum(F.col("_long").cast("int")).over(upto)).withColumn("_origin", F.max(F.when(F.col("_long"), F.col("start"))).over(upto))
    at = cut(at.drop("_rows", "_all", "_n", "_start"), "stretches")

    sums = at.groupBy("_p", "conv_id").agg(F.sum(F.col("_long").cast("int")).alias("longs"), F.max(F.when(F.col("_long"), F.col("start"))).alias("origin"))
    bases = _bases(sums, {"_before": F.sum("longs"), "_from": F.max("origin")}).withColumnRenamed("_p", "_q")
    at = at.join(bases, (F.col("_p") == F.col("_q")) & same).withColumn("longs", F.col("_longs") + F.col("_before")).withColumn("_origin", F.coalesce("_origin", "_from"))
    at = at.withColumn("share", F.floor((F.col("start") - F.col("_origin")) / F.col("step")))
    return cut(at.select("conv_id", "turn", "role", "text", "tokens", "n", "start", "system", "kept", "room", "longs", "share"), "turns")


def windows(turns: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window (from 0), text, repeated (leading turns that are repeats), loss (spans in code points), tokens, over."""
    at = _placed(turns, tokenizer, budget)

    key = ["conv_id", "longs", "share"]
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("_conv")
    spans = at.groupBy(*key).agg(F.min("n").alias("first"), F.min("start").alias("from"), F.sum("tokens").alias("own"), F.max("room").alias("room"), F.max("kept").alias("kept"), F.max(F.col("system").cast("int")).alias("has_system"))
    spans = spans.withColumn("free", F.greatest(F.least(F.lit(history), F.col("room") + F.col("kept") * F.col("has_system") - F.col("own")), F.lit(0)))
    turn = F.struct("n", "role", "text", "tokens")
    own = at.select(conv, *key, F.lit(2).alias("kind"), turn.alias("t"))
    # Turns that begin within ``history`` tokens before a span are in its bucket or the one before.
    asked = spans.where("free > 0").select(conv, *key, "first", "from", "free", F.explode(F.array(F.floor(F.col("from") / history), F.floor(F.col("from") / history) - 1)).alias("bucket"))
    there = at.where("not system").select(conv, F.floor(F.col("start") / history).alias("bucket"), "start", turn.alias("t"))
    repeated = asked.join(there, ["_conv", "bucket"]).where((F.col("t.n") < F.col("first")) & (F.col("from") - F.col("start") <= F.col("free")))
    repeated = repeated.select("_conv", *key, F.lit(1).alias("kind"), "t")
    systems = spans.where("has_system = 0 and kept > 0").select(conv, *key)
    systems = systems.join(at.where("system").select(conv, turn.alias("t")), "_conv").select("_conv", *key, F.lit(0).alias("kind"), "t")
    parts = own.unionByName(repeated).unionByName(systems)
    made = parts.groupBy("_conv", *key).agg(F.sort_array(F.collect_list(F.struct("kind", "t"))).alias("turns"))  # bounded by the budget

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for turns in batch.column("turns").to_pylist():
                text, size, loss = [], 0, []
                for x in turns:
                    made, a, b = format_turn(x["t"]["role"], x["t"]["text"])
                    if x["kind"] == 2 and x["t"]["role"] == "assistant":
                        loss.append({"start": size + a, "end": size + b})
                    text.append(made)
                    size += len(made)
                total = sum(x["t"]["tokens"] for x in turns)
                out.append(("".join(text), sum(x["kind"] < 2 for x in turns), loss, total, total > budget, next(x["t"]["n"] for x in turns if x["kind"] == 2)))
            kinds = (pa.string(), pa.int32(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.int64(), pa.bool_(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 6, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], ["conv_id", "text", "repeated", "loss", "tokens", "over", "first_turn"])

    return made.select("conv_id", "turns").mapInArrow(run, "conv_id long, text string, repeated int, loss array<struct<start:int,end:int>>, tokens long, over boolean, first_turn long")


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse the windows again: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, windows."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "windows"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        done: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != now:
                    if state:
                        done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))
                    now, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for k, turn in enumerate(_TURN.finditer(row["text"])):
                    if k >= row["repeated"]:
                        state[0] += 1
                        state[1].update(f"{unescape(turn[1])}\n{unescape(turn[2])}\n".encode())
                for span in row["loss"]:
                    text = unescape(row["text"][span["start"] : span["end"]])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(row["text"])
                state[5] += 1
            if len(done) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
                done = []
        if state:
            done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "first_turn")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, windows long")
