from __future__ import annotations

import random
from itertools import combinations

import numpy as np

from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm import near_jaccard, simhash

from .helpers import none, odd


def plain(text: str | None, width: int = 5) -> set[str]:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def kept(texts: dict[int, str]) -> list[int]:
    """Smallest ids of the components, by all pairs."""
    sets, root = {i: plain(t) for i, t in texts.items()}, {i: i for i in texts}
    for a, b in combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if root[a] != root[b] and (5 * len(x & y) >= 4 * len(x | y)):
            lo, hi = sorted((root[a], root[b]))
            root = {i: lo if r == hi else r for i, r in root.items()}
    return sorted(set(root.values()))


def test_stage_drops_all_similar_texts_and_no_others(spark):
    """Chains, crowds and pairs around 0.8, most of them beyond three bits of SimHash."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(50_000)}"
    texts: dict[int, str] = {}
    for g in range(40):
        now = [word() for _ in range(rng.randrange(30, 400))]
        for _ in range(1 + g % 6):
            texts[len(texts)] = " ".join(now)
            for _ in range(max(1, len(now) // rng.choice((30, 45, 50, 60, 120)))):
                now[rng.randrange(len(now))] = word()
    base = [word() for _ in range(120)]
    for _ in range(80):
        own = list(base)
        for _ in range(rng.randrange(1, 4)):
            own[rng.randrange(120)] = word()
        texts[len(texts)] = " ".join(own)
    want = kept(texts)
    assert 40 <= len(want) < len(texts) - 100
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want


def test_stage_on_the_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_jaccard.drop_near(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == kept({r.doc_id: r.text for r in docs.collect()})


def test_bands_meet_as_often_as_they_should():
    """Of pairs at 0.8, each band meets with 0.8^7 and none lacks all; at 0.5 bands meet with 0.5^7."""
    rng = np.random.default_rng(3)
    for share, j in ((160, 0.8), (120, 0.5)):
        met = []
        for _ in range(200):
            a, b, c = (rng.integers(0, 1 << 63, n, np.uint64) for n in (share, 180 - share, 180 - share))
            met.append((near_jaccard.bands(np.append(a, b)) == near_jaccard.bands(np.append(a, c))).mean())
        assert j == share / (360 - share) and abs(np.mean(met) - j**near_jaccard.ROWS) < 0.02
        assert j < 0.8 or min(met) > 0


def test_odd_rows(spark):
    df = odd(spark)
    out = near_jaccard.drop_near(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, k) for k in (1, 3, 6, 7, 8, 9)] + [(True, 0)]
    assert near_jaccard.drop_near(none(spark)).count() == 0


def test_stage_joins_what_simhash_joins_if_texts_are_alike(spark, monkeypatch):
    """Without any band in common, three bits of SimHash still find near copies and a group of more copies than parts; those that are not alike stay."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(50_000)}" for _ in range(2000)]
    again, other = " ".join(words), None
    while other is None or (simhash.fingerprint(again, 5) ^ simhash.fingerprint(other, 5)).bit_count() not in (1, 2, 3):
        other = " ".join(w if k != at else "changed" for at in [rng.randrange(2000)] for k, w in enumerate(words))
    same = "x y z w v " * 200
    texts = {1: again, 2: other, 3: same + " ".join(f"a{k}" for k in range(30)), 4: same + " ".join(f"b{k}" for k in range(30)), 5: "", 6: " "}
    texts |= {k: "one of many equal texts of seven words".upper() if k % 2 else "one of many equal texts of seven words" for k in range(100, 100 + 2 * near_jaccard.PARTS)}
    assert simhash.fingerprint(texts[3], 5) == simhash.fingerprint(texts[4], 5)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = kept({k: t for k, t in texts.items() if k <= 101})
    assert want == [1, 3, 4, 5, 100]
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want
    alone = lambda docs, width: docs.select("row", F.lit(1).cast("long").alias("n"), F.array(F.col("row")).alias("keys"), F.lit(b"").alias("marks"))
    monkeypatch.setattr(near_jaccard, "sketched", alone)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want
