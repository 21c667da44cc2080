from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tesserae.llm import queries
from tesserae.llm.exact_dedup import drop_exact, exact_groups

from .helpers import none, odd, texts

SPACES = " \t\n\x0b\x0c\r"


def plain(rows):
    """Per (id, text): keep_id, size, kept, digest."""
    groups: dict = {}
    for i, t in rows:
        groups.setdefault((t or "").translate({ord(c): None for c in SPACES}), []).append((i, t or ""))
    out = []
    for body, own in groups.items():
        named = [x for x in own if x[0] is not None]
        keep = min(named, key=lambda x: (-len(x[1]), x[0])) if named else None
        for i, t in own:
            kept = keep is None or (i == keep[0] and len(t) == len(keep[1]))
            out.append((i, keep[0] if keep else None, len(own), kept, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted([tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()], key=repr)


def test_query(spark, sf_dir):
    assert found(queries.op10_exact_dedup(spark, sf_dir)) == plain(texts(spark, sf_dir).items())


def test_odd_rows(spark):
    df = odd(spark)
    assert found(exact_groups(df)) == plain([(r.doc_id, r.text) for r in df.collect()])
    assert exact_groups(none(spark)).count() == 0
    assert drop_exact(df).columns == df.columns


def test_digests_that_texts_share(spark):
    """With a digest of one letter nearly all texts collide; content still decides."""
    rows = [(k, f"text {k % 40} " + " " * (k % 3)) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert found(exact_groups(df, salts=3, digest=lambda c: F.substring(F.sha2(c, 256), 1, 1))) == plain(rows)


def test_hot_group(spark):
    rows = [(k, "same  text" if k % 3 else f"text {k}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    assert found(exact_groups(df)) == plain(rows)
    assert drop_exact(df).count() == 1001
