"""SimHash near-duplicates through deletion variants: two segments of 32 bits, so one of them differs by at most one of three bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import in_slices
from .common import field, stored, whole
from .components import components

BITS, SEGMENT, REACH = 64, 32, 3
#: Join keys of a fingerprint when component ids go back to its rows.
SALTS = 16


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """A bit is set if it is set in over half of the shingles' XXH64; no words give 0, fewer than ``width`` one shingle of all words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = (end - length)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    total, bits = len(start), np.zeros(BITS, np.int64)
    stop = end[width - 1 :].tolist()
    for k in range(0, total, 1 << 14):  # counts of a long text are summed block by block
        h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(start[k : k + (1 << 14)], stop[k : k + (1 << 14)], strict=True)), np.uint64)
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row; a null text counts as empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            fp = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(each, "doc_id long, fp long")


def _segment(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, SEGMENT * k).bitwiseAND(F.lit(0xFFFFFFFF))


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= REACH


def _variant_links(fps: DataFrame) -> DataFrame:
    """Links between fingerprints by equality joins: on a whole segment, and on a segment with one bit deleted where that bit differs."""
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), _segment(F.col("fp"), k).alias("value")) for k in (0, 1)])).alias("s")).select("fp", "s.*")
    same = keyed.alias("x").hint("merge").join(keyed.alias("y"), (F.col("x.part") == F.col("y.part")) & (F.col("x.value") == F.col("y.value")) & (F.col("x.fp") < F.col("y.fp")) & _near("x.fp", "y.fp"))
    place = F.col("place")
    variants = keyed.select("fp", "part", "value", F.explode(F.sequence(F.lit(0), F.lit(SEGMENT - 1))).alias("place")).select(
        "fp",
        # part, deleted bit and the other 31 bits in one long
        F.shiftleft(F.lit(1).cast("long") * (F.col("part") * SEGMENT + place), SEGMENT).bitwiseOR(F.col("value").bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, place)")))).alias("key"),
        (F.expr("shiftright(value, place)").bitwiseAND(F.lit(1)) == 1).alias("bit"),
    )
    off, on = variants.filter("not bit").select("key", F.col("fp").alias("a")), variants.filter("bit").select("key", F.col("fp").alias("b"))
    one = off.hint("merge").join(on, "key").filter(_near("a", "b"))
    return same.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).union(one.select("a", "b"))


def _ball_links(dense: DataFrame, fps: DataFrame) -> DataFrame:
    """All links of ``dense`` fingerprints to any, as stars: points within one bit of y that lie within two bits of a dense x link x and y."""
    bit = "transform(sequence(0, 63), i -> shiftleft(1L, i))"
    one = f"concat(array(0L), {bit})"
    two = f"concat({one}, flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), j -> shiftleft(1L, i) | shiftleft(1L, j)))))"
    inner = fps.select("fp", F.explode(F.expr(f"transform({one}, m -> fp ^ m)")).alias("point"))
    outer = dense.select("fp", F.explode(F.expr(f"transform({two}, m -> fp ^ m)")).alias("point"))
    hub = inner.groupBy("point").agg(F.min("fp").alias("hub"))
    near = outer.groupBy("point").agg(F.min("fp").alias("x")).hint("merge").join(hub, "point")
    # Each dense fingerprint and each neighbour hangs on the point's smallest neighbour; every such pair reaches a pair within three bits.
    ends = (F.col("fp").alias("a"), F.col("hub").alias("b"))
    return outer.hint("merge").join(hub, "point").select(*ends).union(inner.hint("merge").join(near.select("point", "hub"), "point").select(*ends)).filter("a <> b").distinct()


def links(fps: DataFrame, crowd: int = 256) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) that join all those within three or fewer bits.

    A segment's value that over ``crowd`` fingerprints share would make pairs in the square of their number; fingerprints of such values
    find all their links through points instead (:func:`_ball_links`), in a number of rows proportional to theirs, and leave the variants.
    """
    # Merge hints: Spark would size exploded rows by the file in front of the explode and broadcast them.
    fps = stored(fps, "fingerprints")
    parts = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), _segment(F.col("fp"), k).alias("value")) for k in (0, 1)])).alias("s")).select("fp", "s.*")
    crowded = stored(parts.groupBy("part", "value").count().filter(F.col("count") > crowd).select("part", "value"), "crowded")
    if crowded.isEmpty():
        return _variant_links(fps)
    dense = stored(parts.join(crowded.hint("merge"), ["part", "value"], "left_semi").select("fp").distinct(), "dense")
    sparse = fps.join(dense.hint("merge"), "fp", "left_anti")
    return _variant_links(sparse).union(_ball_links(dense, fps))


def fingerprint_classes(fps: DataFrame, crowd: int = 256) -> DataFrame:
    """Distinct fingerprints (fp) to (fp, root) for all that have a link: the smallest of those reachable by links of three or fewer bits."""
    return components(links(fps, crowd)).withColumnsRenamed({"node": "fp"})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, crowd: int = 256) -> DataFrame:
    """One row per input row: doc_id, fp (long), component_id (the smallest id reachable over links of three or fewer bits, its own included).

    Null and empty texts have fingerprint zero and link like any other. Null ids are carried, and are never a component's id unless no
    row of the component has one; rows repeated under one id are rows of one document. An empty table gives an empty result.
    """
    rows = stored(fingerprints(docs, id_col, text_col, width), "simhash")
    first = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-first")
    roots = fingerprint_classes(first.select("fp"), crowd)
    labelled = first.join(roots.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = labelled.join(smallest.hint("merge"), "root").select("fp", "component_id")
    # Rows of one fingerprint (all empty texts, a large group of copies) are spread over several join keys.
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    spread = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread.hint("merge"), ["fp", "salt"]).select("doc_id", "fp", "component_id")


def drop_near(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each component, the smallest id; columns unchanged. Components without any id stay whole."""
    near = near_duplicates(docs, id_col, **options)
    keep = near.filter("component_id is null or doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    return docs.select(whole(docs)).join(keep, field(id_col).cast("long").eqNullSafe(F.col("kept")), "left_semi").select("doc.*")


def as_hex(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
