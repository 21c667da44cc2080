"""Preference formatting: the longest common turn prefix of a chosen and a rejected conversation becomes one prompt, the rest two completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spread_join, stored

# The marks of the ChatML layout.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """pair (struct of missing and id), turn, role, text: one row per turn, null roles as ``user`` and null texts as empty.

    Rows without an id make up one conversation without an id; a row without a turn comes before turn 0, as turn -1. Of several rows of one
    place the one with the smallest (role, text) counts, so that the result doesn't depend on the order of the input.
    """
    key = F.col(id_col).cast("long")
    rows = conversations.select(
        F.struct(key.isNull().alias("missing"), F.coalesce(key, F.lit(0).cast("long")).alias("id")).alias("pair"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(-1).cast("long")).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("user")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    return rows.groupBy("pair", "turn").agg(F.min(F.struct("role", "text")).alias("m")).select("pair", "turn", "m.role", "m.text")


def pair_id() -> Column:
    return F.when(~F.col("pair.missing"), F.col("pair.id")).alias("pair_id")


def _plain(text: Column) -> Column:
    """A mark inside a turn is broken up, so that no text can forge a turn."""
    return F.replace(F.replace(text, F.lit(OPEN), F.lit("<| im_start|>")), F.lit(CLOSE), F.lit("<| im_end|>"))


def _rendered(role: Column, text: Column) -> tuple[Column, Column]:
    """A turn as text, and the length of its head in code points."""
    head = F.concat(F.lit(OPEN), _plain(role), F.lit("\n"))
    return F.concat(head, _plain(text), F.lit(CLOSE + "\n")), F.length(head)


def preference_messages(chosen: DataFrame, rejected: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """One row per message: pair, part (``prompt``, ``chosen``, ``rejected``), turn, role, rendered, loss_start, loss_end.

    ``chosen`` and ``rejected`` are as :func:`turns` gives them. The prompt holds, once, the turns before the first place where the two
    differ in role, text or existence; each side's turns from there on are its completion. Conversations that are equal are prompt only,
    and where one side lacks a pair the other's turns are a completion without a prompt. loss_start and loss_end bound the code points
    of ``rendered`` that are learned: text and end mark of ``learn_role`` messages of a completion; both are equal where nothing is.

    The sides are joined by (pair, turn), and a conversation's verdict is one minimum that goes back to its turns under several
    join keys, so no task holds a whole conversation.
    """
    a = chosen.select("pair", "turn", F.struct("role", "text").alias("a"))
    b = rejected.select("pair", "turn", F.struct("role", "text").alias("b"))
    both = a.join(b, ["pair", "turn"], "full_outer")
    sides = F.array(F.struct(F.lit("chosen").alias("part"), F.col("a").alias("m")), F.struct(F.lit("rejected").alias("part"), F.col("b").alias("m")))
    same = F.col("a").eqNullSafe(F.col("b"))
    first = both.filter(~same).groupBy("pair").agg(F.min("turn").alias("first"))
    placed = spread_join(both, first, ["pair"], F.col("turn")).withColumn("shared", F.coalesce(F.col("turn") < F.col("first"), F.lit(True)))
    prompt = F.array(F.struct(F.lit("prompt").alias("part"), F.col("a").alias("m")))
    messages = placed.select("pair", "turn", F.explode(F.when(F.col("shared"), prompt).otherwise(F.filter(sides, lambda s: s["m"].isNotNull()))).alias("s"))
    messages = messages.select("pair", "s.part", "turn", F.col("s.m.role").alias("role"), F.col("s.m.text").alias("text"))
    rendered, head = _rendered(F.col("role"), F.col("text"))
    learned = (F.col("part") != "prompt") & (F.col("role") == learn_role)
    out = messages.select("pair", "part", "turn", "role", rendered.alias("rendered"), head.cast("long").alias("head"), learned.alias("learned"))
    end = F.length("rendered").cast("long") - 1  # the line feed after the end mark isn't learned
    return out.select("pair", "part", "turn", "role", "rendered", F.when(F.col("learned"), F.col("head")).otherwise(0).cast("long").alias("loss_start"), F.when(F.col("learned"), end).otherwise(0).cast("long").alias("loss_end"))


def _offsets(messages: DataFrame, block: int = 1024) -> DataFrame:
    """``messages`` with ``at``, the code points of the same pair and part before each. Sums of blocks of turns first, so no window holds a long conversation."""
    size = F.length("rendered").cast("long")
    blocked = messages.withColumns({"block": F.floor(F.col("turn") / block), "size": size})
    keys = ["pair", "part"]
    sums = blocked.groupBy(*keys, "block").agg(F.sum("size").alias("total"))
    before = F.sum("total").over(Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(*keys, "block", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.sum("size").over(Window.partitionBy(*keys, "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    placed = blocked.withColumn("at", F.coalesce(inside, F.lit(0)))
    return placed.join(starts.hint("merge"), [*keys, "block"]).withColumn("at", F.col("at") + F.col("start")).drop("block", "start", "size")


def paired(messages: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """One row per pair: pair_id, chunk, prompt, chosen, rejected, and chosen_mask and rejected_mask, the learned code points of the
    completions as start:end, comma-joined.

    A side of over ``chunk`` code points goes on in rows of chunk 1 and up (by the place where a message starts, messages stay whole), so
    that a row has a bound; masks count from the start of the row's own text. All but giant pairs have chunk 0 only.
    """
    # Each table drops the shuffle files that it took, so that texts lie on disk once or twice, not once a step.
    placed = stored(_offsets(stored(messages, "messages")), "placed").withColumn("chunk", F.floor(F.col("at") / chunk))
    item = F.struct("turn", "rendered", "loss_start", "loss_end", "at")
    parts = placed.groupBy("pair", "chunk", "part").agg(F.array_sort(F.collect_list(item)).alias("m"))
    base = F.col("m")[0]["at"]
    learned = F.filter("m", lambda x: x["loss_end"] > x["loss_start"])
    mask = F.array_join(F.transform(learned, lambda x: F.concat_ws(":", (x["at"] - base + x["loss_start"]).cast("string"), (x["at"] - base + x["loss_end"]).cast("string"))), ",")
    parts = parts.select("pair", "chunk", "part", F.array_join("m.rendered", "").alias("text"), mask.alias("mask"))
    one = lambda part, what: F.coalesce(F.max(F.when(F.col("part") == part, F.col(what))), F.lit(""))
    sides = [one(p, "text").alias(p) for p in ("prompt", "chosen", "rejected")] + [one(p, "mask").alias(f"{p}_mask") for p in ("chosen", "rejected")]
    return parts.groupBy("pair", "chunk").agg(*sides).select(pair_id(), "chunk", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask")


def cut_short(conversation: DataFrame, role: str = "assistant") -> DataFrame:
    """A worse version of each conversation of :func:`turns`: from the middle turn on, answers of ``role`` stop after their first sentence.

    Answers of one sentence stay, so where the versions first differ depends on the texts.
    """
    last = conversation.groupBy("pair").agg(F.max("turn").alias("last"))
    late = (F.col("role") == role) & (2 * F.col("turn") >= F.col("last"))
    first = F.substring_index("text", ".", 1)
    shorter = F.when(first == F.col("text"), F.col("text")).otherwise(F.concat(first, F.lit(".")))
    return spread_join(conversation, last, ["pair"], F.col("turn")).select("pair", "turn", "role", F.when(late, shorter).otherwise(F.col("text")).alias("text"))


def stored_turns(conversations: DataFrame) -> DataFrame:
    """:func:`turns`, computed once for both sides."""
    return stored(turns(conversations), "turns")
