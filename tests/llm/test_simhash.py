from __future__ import annotations

import random

import pytest
import xxhash

from tesserae.llm import queries, simhash

from .helpers import none, odd, texts


def plain(text: str, width: int = 3) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: dict[int, int]) -> dict[int, int]:
    """Smallest id reachable, by all pairs."""
    values = sorted(set(prints.values()))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for k, a in enumerate(values):
        for b in values[k + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(b)] = find(a)
    least: dict = {}
    for i, v in prints.items():
        least[find(v)] = min(least.get(find(v), i), i)
    return {i: least[find(v)] for i, v in prints.items()}


def test_query(spark, sf_dir):
    prints = {i: plain(t) for i, t in texts(spark, sf_dir).items()}
    want = components(prints)
    rows = queries.op9_simhash_near_dedup(spark, sf_dir).collect()
    assert len(rows) == len(prints)
    for r in rows:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == want[r.doc_id]


@pytest.mark.parametrize("crowd", [256, 3])
def test_links_of_close_fingerprints(spark, crowd):
    """Chains and clusters within three bits, in both segments, by variants and by points."""
    rng = random.Random(1)
    prints: list[int] = []
    for _ in range(40):
        v = rng.getrandbits(64)
        prints.append(v)
        for _ in range(rng.randrange(8)):
            for _ in range(rng.randrange(1, 5)):
                v ^= 1 << rng.randrange(64)
            prints.append(v)
    prints += [0xFFFF << 32 | k for k in range(60)]  # many share a segment
    prints += [0, 7, 15, (1 << 64) - 1]
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(set(prints))]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r.fp: r.root for r in simhash.fingerprint_classes(fps, crowd).collect()}
    want = components({k: v for k, v in enumerate(sorted(set(prints)))})
    mine: dict = {}
    for k, v in enumerate(sorted(set(prints))):
        s = v - (1 << 64) if v >> 63 else v
        mine.setdefault(want[k], set()).add(got.get(s, s))
    assert all(len(x) == 1 for x in mine.values()) and len(mine) == len({next(iter(x)) for x in mine.values()})


def test_odd_rows(spark):
    df = odd(spark)
    rows = simhash.near_duplicates(df).collect()
    assert len(rows) == df.count()
    assert {r.component_id for r in rows if r.doc_id in (3, 4, 5)} == {3} and {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    kept = simhash.drop_near(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 3, 6, 7, 8, 9]
    assert simhash.near_duplicates(none(spark)).count() == 0 and simhash.drop_near(none(spark)).count() == 0


def test_joins_of_exploded_rows_are_never_broadcast(spark):
    """Spark sizes a side by the file in front of an explode, so small files stand for many rows."""
    fps = simhash.stored(spark.range(4000).selectExpr("id * 4294967296 + 7 as fp"), "fps")
    for df in (simhash._variant_links(fps), simhash._ball_links(fps, fps)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_a_crowd_in_one_segment(spark):
    """2000 fingerprints that share a half: their classes are those of all pairs."""
    import random

    rng = random.Random(3)
    highs = sorted({rng.getrandbits(12) << 3 for _ in range(2000)})
    fps = spark.createDataFrame([(h << 32 | 5,) for h in highs], "fp long")
    got = {r.fp >> 32: r.root >> 32 for r in simhash.fingerprint_classes(fps).collect()}
    root = {h: h for h in highs}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    flips = [1 << i for i in range(3, 15)]
    masks = {a ^ b ^ c for a in [0, *flips] for b in [0, *flips] for c in [0, *flips]} - {0}
    for h in highs:
        for m in masks:
            if h ^ m in root and bin(m).count("1") <= 3:
                x, y = sorted((top(h), top(h ^ m)))
                root[y] = x
    linked = {h for h in highs if any(h ^ m in root for m in masks if bin(m).count("1") <= 3)}
    assert got == {h: top(h) for h in linked}
