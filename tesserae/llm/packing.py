"""Mixture-controlled packing: deficit round-robin over source queues fills windows to target token proportions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import in_slices, safe_parts
from .common import spread_join, stored

#: Rows of a block of the prefix sums: 2 to this power.
BLOCK = 12


@lru_cache(maxsize=4)
def vocabulary(tokenizer_file: str, pattern: str) -> tiktoken.Encoding:
    """The byte-level BPE of a ``tokenizers`` JSON file; one for each worker.

    Such a file writes each byte as one printable character, and its merges are in the order of the ids, which are so the ranks. Its added
    tokens are taken whole wherever a text writes them, as that library does.
    """
    with open(tokenizer_file, encoding="utf-8") as lines:
        whole = json.load(lines)
    vocab, added = whole["model"]["vocab"], {t["content"]: t["id"] for t in whole.get("added_tokens", ())}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(x for x in range(256) if x not in set(plain))}
    ranks = {bytes(letters[c] for c in token): rank for token, rank in vocab.items() if all(c in letters for c in token) and token not in added}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


def tokenized(docs: DataFrame, tokenizer_file: str, pattern: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, queue (a hash of the source; null sources share one), n_ids and ids (binary, 16 bits an id where the vocabulary allows, else 32), in the order of the input."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = vocabulary(tokenizer_file, pattern)
        kind = "<u2" if max(enc.max_token_value, end_id) < 1 << 16 else "<u4"
        for batch in in_slices(batches):
            found = [np.concatenate([*(enc.encode_to_numpy(p, allowed_special="all") for p in safe_parts(t, 1 << 16)), [end_id]]).astype(kind) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["doc_id", "queue", "n_ids", "ids"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(source_col).cast("string"), F.lit(""))).alias("queue"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return slim.mapInArrow(each, "doc_id long, queue long, n_ids long, ids binary")


def before(df: DataFrame, order: str, value: Column, group: str | None = None, levels: int = 3) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over the rows of smaller ``order`` (a unique whole number) in the same ``group``.

    Sums go up through blocks of 2**12 numbers, blocks of 2**24 and so on, so that no window holds more than one block's rows.
    """
    by = [group] if group else []
    level = df.groupBy(*by, F.shiftright(order, BLOCK).alias("block")).agg(F.sum(value).alias("total"))
    sums = level
    for k in range(1, levels):
        last = k == levels - 1
        up = F.lit(0) if last else F.shiftright("block", BLOCK)
        w = Window.partitionBy(*by, "up").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn("up", up.cast("long")).withColumn("base", F.coalesce(F.sum("total").over(w), F.lit(0)))
        if k == 1:
            sums = level.select(*by, "block", "base", "up")
        else:
            sums = sums.alias("s").join(level.select(*by, F.col("block").alias("up"), F.col("base").alias("more")), [*by, "up"]).select(*by, "block", (F.col("base") + F.col("more")).alias("base"), F.shiftright("up", BLOCK).alias("up"))
        level = level.groupBy(*by, F.col("up").alias("block")).agg(F.sum("total").alias("total"))
    w = Window.partitionBy(*by, "block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("block", F.shiftright(order, BLOCK)).withColumn("inside", F.coalesce(F.sum(value).over(w), F.lit(0)))
    return inner.join(sums.drop("up"), [*by, "block"]).withColumn("before", F.col("inside") + F.col("base")).drop("inside", "base", "block")


def schedule(lengths: DataFrame, window: int = 2048, quantum: int = 128, targets: DataFrame | None = None) -> DataFrame:
    """Pieces of rows (row, queue, n_ids; row is unique) in windows: row, start, length, sequence_id, offset.

    Each queue holds its rows in the order of ``row``, cut into packets of ``quantum`` ids. In every round a queue earns its share of one
    window and sends the packets that its earnings cover; what is left is its deficit for the next round. A packet so leaves in the first
    round whose earnings reach the packet's end, which needs no loop: round = ceil(ids up to its end / ids earned a round). Packets are
    laid out by round, queue and place, and the windows are cut from that one sequence, so that deficits cross every window and partition
    and only the last window is short. ``targets`` (queue, weight) sets the proportions, by default those of the corpus; queues without a
    weight get the smallest. When a queue runs dry the others keep their proportions.
    """
    totals = lengths.groupBy("queue").agg(F.sum("n_ids").alias("queue_ids"))
    if targets is None:
        weighted = totals.withColumn("weight", F.col("queue_ids").cast("double"))
    else:
        weighted = totals.join(targets.select("queue", F.col("weight").cast("double").alias("weight")), "queue", "left")
        weighted = weighted.crossJoin(F.broadcast(targets.agg(F.min("weight").cast("double").alias("least")))).withColumn("weight", F.coalesce("weight", "least"))
    share = weighted.crossJoin(F.broadcast(weighted.agg(F.sum("weight").alias("all")))).select("queue", (F.lit(window) * F.col("weight") / F.col("all")).alias("earned"))  # one row each
    placed = spread_join(before(lengths, "row", F.col("n_ids"), "queue", 4), share, ["queue"], F.col("row"), "inner")
    packets = placed.select("row", "queue", "n_ids", "before", "earned", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_ids") - 1, F.lit(quantum).cast("long"))).alias("start"))
    length = F.least(F.lit(quantum).cast("long"), F.col("n_ids") - F.col("start"))
    packets = packets.select("row", "queue", "start", length.alias("length"), F.ceil((F.col("before") + F.col("start") + length) / F.col("earned")).cast("long").alias("round"))
    rounds = before(packets.groupBy("round").agg(F.sum("length").alias("ids")), "round", F.col("ids")).select("round", F.col("before").alias("base"))
    w = Window.partitionBy("round").orderBy("queue", "row", "start").rowsBetween(Window.unboundedPreceding, -1)
    laid = packets.withColumn("inside", F.coalesce(F.sum("length").over(w), F.lit(0))).join(rounds, "round").withColumn("at", F.col("base") + F.col("inside"))
    room = F.lit(window) - F.col("at") % window
    cut = F.when(F.col("length") <= room, F.array(F.struct("at", "start", "length"))).otherwise(
        F.array(F.struct("at", "start", room.alias("length")), F.struct((F.col("at") + room).alias("at"), (F.col("start") + room).alias("start"), (F.col("length") - room).alias("length")))
    )
    return laid.select("row", F.explode(cut).alias("p")).select("row", "p.start", "p.length", F.floor(F.col("p.at") / window).alias("sequence_id"), (F.col("p.at") % window).alias("offset"))


def pack(docs: DataFrame, tokenizer_file: str, pattern: str, end_id: int = 1, window: int = 2048, quantum: int = 128, targets: DataFrame | None = None, **columns) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (the piece's, as little-endian unsigned 32-bit integers), doc_tokens, sequence_id, offset.

    Every row of ``docs`` is encoded whole and ended by ``end_id``; a null or empty text is that id alone. Each id lies in exactly one
    piece. Sequences are full but for the last one. Null ids are carried, repeated rows are packed each, null sources share a queue, an
    empty table gives an empty result, and other columns are ignored. ``quantum`` is ``window`` at most.
    """
    if not 0 < quantum <= window:
        raise ValueError("quantum must be between 1 and window")
    rows = stored(tokenized(docs, tokenizer_file, pattern, end_id, **columns).withColumn("row", F.monotonically_increasing_id()), "packing-ids")
    pieces = schedule(rows.select("row", "queue", "n_ids"), window, quantum, targets)
    of_row = pieces.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    joined = rows.select("row", "doc_id", "n_ids", "ids").join(of_row, "row")
    wide = 4 * F.col("n_ids") == F.length("ids")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):  # pieces hold their ids, so a batch is let out in parts
                yield _cut(batch.slice(k, 256))

    return joined.select("doc_id", "n_ids", "ids", wide.alias("wide"), "pieces").mapInArrow(each, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    doc, total, where = batch.column(0), batch.column(1), batch.column(4)
    piece = where.flatten()
    often = np.diff(where.offsets.to_numpy())
    start, length = piece.field(0).to_numpy(), piece.field(1).to_numpy()
    owner = np.repeat(np.arange(batch.num_rows), often)
    ids = [np.frombuffer(x, "<u4" if w else "<u2").astype("<u4").tobytes() for x, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
    data = [ids[o][4 * a : 4 * (a + n)] for o, a, n in zip(owner.tolist(), start.tolist(), length.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([doc.take(pa.array(owner)), piece.field(0), piece.field(1), pa.array(data, pa.binary()), total.take(pa.array(owner)), piece.field(2), piece.field(3)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
