"""Exact dedup by skew-safe combining: locally, in salted digest groups, then across salts, on full content at every stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, carried, field, stored

#: ``rank`` is n_chars * STEP + (MAX_ID - doc_id): larger is longer, then a smaller id. A decimal keeps the maximum in a hash aggregate.
STEP, MAX_ID = "100000000000000000000", "9223372036854775807"


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Callable[[Column], Column] = sha256, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, and with ``carry`` (names of columns of ``docs``) these and n, the text's code points.

    Texts are equal when they are identical without the characters of ``[\\x20\\x09-\\x0D]``. Of equal texts the row with the most code
    points stays, then the smallest id. Grouping keys hold the digest and the whole normalised text, so a digest that two texts share
    never merges them: such digests are joined by content as well.

    A null text counts as empty, and all empty texts are equal. A row without an id ranks behind every row with one and is kept only if
    its whole group has none (keep_id is then null). ``doc_id`` names a row: rows repeated under one id get one verdict. An empty table
    gives an empty result; other columns are ignored.

    Spark aggregates every partition before it shuffles (the local pass); the salt is the partition's number, so that a group with a
    third of all rows reaches ``salts`` tasks, each of which sends one row on.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).alias("n"), F.translate(text, SPACES, "").alias("body"), *carry)
    rows = rows.withColumn("digest", digest(F.col("body")))
    rank = F.when(F.col("doc_id").isNull(), F.lit(-1).cast("decimal(38,0)")).otherwise(
        (F.col("n").cast("decimal(12,0)") * F.lit(STEP).cast("decimal(21,0)") + (F.lit(MAX_ID).cast("decimal(20,0)") - F.col("doc_id").cast("decimal(20,0)"))).cast("decimal(38,0)")
    )
    seen = rows.select("digest", "body", rank.alias("rank"), (F.spark_partition_id() % salts).alias("salt"))
    by_salt = seen.groupBy("digest", "salt", "body").agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("size"))
    winners = by_salt.groupBy("digest", "body").agg(F.max("rank").alias("rank"), F.sum("size").alias("size"))
    slim = stored(
        winners.groupBy("digest").agg(F.count(F.lit(1)).alias("contents"), F.max("rank").alias("rank"), F.max("size").alias("size")), "exact-groups"
    )
    found = rows.select("doc_id", "n", "digest", "body", *carry)
    # A digest of one text alone identifies it, so only the digest travels; the rest, if any, is joined by content.
    single = found.select("doc_id", "n", "digest", F.sha2("body", 256).alias("text_sha256"), *carry).join(slim.filter("contents = 1").drop("contents"), "digest")
    out = single.select("doc_id", "n", "rank", "size", "text_sha256", *carry)
    if not slim.filter("contents > 1").isEmpty():
        shared = slim.filter("contents > 1").select("digest")
        double = found.join(shared, "digest", "left_semi").join(winners.join(shared, "digest", "left_semi"), ["digest", "body"])
        out = out.unionByName(double.select("doc_id", "n", "rank", "size", F.sha2("body", 256).alias("text_sha256"), *carry))
    step = F.lit(STEP).cast("decimal(21,0)")
    keep = F.when(F.col("rank") >= 0, (F.lit(MAX_ID).cast("decimal(20,0)") - F.pmod(F.col("rank"), step)).cast("long"))
    longest = F.floor(F.col("rank") / step).cast("long")
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.col("size").alias("group_size"),
        F.coalesce(F.when(F.col("rank") < 0, F.lit(True)).otherwise((F.col("doc_id") == keep) & (F.col("n") == longest)), F.lit(False)).alias("kept"),
        "text_sha256",
        *(("n", *carry) if carry else ()),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of :func:`exact_groups`, the longest text, then the smallest id, then the first row; columns unchanged.

    Rows are told apart by a number of their own: of rows repeated under one id one stays, and a row without an id stays only where its group has none with one.
    """
    rows = carried(docs, "exact-rows")
    texts = rows.select("row", field(id_col).alias("doc_id"), field(text_col).alias("text"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "row"))["row"]
    kept = exact_groups(texts, carry=("row",), **options).filter("kept").groupBy("text_sha256").agg(best.alias("row")).select("row")
    return rows.join(kept, "row", "left_semi").select("doc.*")
