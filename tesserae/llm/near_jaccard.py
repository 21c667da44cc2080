"""Near-duplicates by the Jaccard similarity of word shingles: SimHash gives the first candidates, MinHash bands those beyond its three bits, the shingles of both texts decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .bpe import in_slices
from .common import carried, dropped, field, stored
from .components import components

#: A pair at the least similarity shares no band with probability (1 - 0.8^7)^60 = 7e-7; one at 0.5 shares one with 0.37.
LEAST, ROWS, BANDS = 0.8, 7, 60
ODD, SHIFT = np.random.default_rng(20).integers(0, 1 << 32, (2, ROWS * BANDS), np.uint32)
ODD |= np.uint32(1)
#: Keys of more live rows are crowded; their rows are compared in blocks of so many rows and shingles.
CROWD, BLOCK, BLOCK_SHINGLES = 32, 256, 1 << 21
#: Rows of one fingerprint are verified against the smallest of their part, and those against the fingerprint's smallest.
PARTS = 256


def shingles(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles, which :func:`simhash.fingerprint` counts; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[k : k + width]), seed) for k in range(max(1, len(words) - width + 1))] if words else [], np.uint64))


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sorted sets; two empty ones are alike."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def sketch(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each band, of the least values of its functions over the shingles, and the last byte of each least value.

    Sets without any shingle share all keys and bytes.
    """
    least = np.full(ROWS * BANDS, np.iinfo(np.uint32).max, np.uint32)
    half = (found ^ found >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(half), 512):
        x = half[k : k + 512, None] * ODD
        x += SHIFT
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x9E3779B1)
        np.minimum(least, x.min(axis=0), out=least)
    raw = least.reshape(BANDS, ROWS)
    keys = np.array([xxhash.xxh64_intdigest(raw[b].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64)
    return keys, (least ^ least >> np.uint32(16)).astype(np.uint8)


def bands(found: np.ndarray) -> np.ndarray:
    return sketch(found)[0]


def estimated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Jaccard similarity of each pair of rows of bytes; two unequal least values share a byte once in 256 times."""
    return ((x == y).mean(axis=1) - 1 / 256) * (256 / 255)


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """row, n (shingles), a key for each band and a byte for each function, from row and text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 256):
            sets = [shingles(t, width) for t in batch.column(1).to_pylist()]
            keys, marks = zip(*map(sketch, sets), strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([k.tolist() for k in keys], pa.list_(pa.int64())), pa.array([m.tobytes() for m in marks], pa.binary())],
                ["row", "n", "keys", "marks"],
            )

    return docs.select("row", "text").mapInArrow(each, "row long, n long, keys array<long>, marks binary")


def likely(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """``pairs`` (a, b) whose estimated similarity is within five standard errors of ``least`` or over it, with the estimate."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            e = estimated(x, y) if batch.num_rows else np.zeros(0)
            ok = pa.array(e >= floor(least), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok), pa.array(e).filter(ok)], ["a", "b", "e"])

    marks = lambda k: sketches.select(F.col("row").alias(k), F.col("marks").alias(f"m{k}")).hint("merge")
    return pairs.join(marks("a"), "a").join(marks("b"), "b").select("a", "b", "ma", "mb").mapInArrow(each, "a long, b long, e double")


def floor(least: float) -> float:
    return least - 5 * np.sqrt(least * (1 - least) / (ROWS * BANDS))


def alike(pairs: DataFrame, docs: DataFrame, width: int, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b: rows) whose texts are at least so similar."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 64):
            x, y = ([shingles(t, width) for t in batch.column(k).to_pylist()] for k in (2, 3))
            ok = pa.array([jaccard(a, b) >= least for a, b in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    text = lambda k: docs.select(F.col("row").alias(k), F.col("text").alias(f"t{k}")).hint("merge")
    return pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", "ta", "tb").mapInArrow(each, "a long, b long")


def simhash_pairs(docs: DataFrame, width: int) -> DataFrame:
    """Pairs (a, b: rows) to verify among those that SimHash links: rows of one fingerprint as a star of two levels, and each linked fingerprint's first row with that of one it is linked to.

    So their number grows with the rows only, and no row is in many. Three bits also link texts whose repeated shingles outweigh the others, so the
    texts decide; links that aren't among the pairs are left to the bands.
    """
    part = F.pmod(F.xxhash64("row"), F.lit(PARTS))
    rows = simhash.fingerprints(docs, "row", "text", width).withColumnRenamed("doc_id", "row").withColumn("hub", F.min("row").over(Window.partitionBy("fp", part)))
    rows = stored(rows, "simhash")
    hubs = stored(rows.filter("row = hub").select("row", "fp", F.min("row").over(Window.partitionBy("fp")).alias("hub")), "simhash-hubs")
    first = hubs.filter("row = hub").select("fp", "row")
    linked = simhash.links(first.select("fp"))
    linked = linked.union(linked.select(F.col("b").alias("a"), F.col("a").alias("b")))
    chosen = linked.groupBy("a").agg(F.max(F.struct(F.xxhash64("b", F.pmod("a", F.lit(PARTS))).alias("place"), "b"))["b"].alias("b"))
    of = lambda k: first.select(F.col("fp").alias(k), F.col("row").alias(f"row_{k}")).hint("merge")
    across = chosen.join(of("a"), "a").join(of("b"), "b").select(F.greatest("row_a", "row_b").alias("a"), F.least("row_a", "row_b").alias("b")).distinct()
    same = [t.filter("row <> hub").select(F.col("row").alias("a"), F.col("hub").alias("b")) for t in (rows, hubs)]
    return across.union(same[0]).union(same[1])


def _near_in_size(x: str, y: str, least: float) -> Column:
    return F.least(x, y) >= F.lit(least - 1e-9) * F.greatest(x, y)


def shingled(docs: DataFrame, width: int) -> DataFrame:
    """row and its sorted shingles as bytes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 64):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, width).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["row", "found"])

    return docs.select("row", "text").mapInArrow(each, "row long, found binary")


def _crowd_links(crowded: DataFrame, sketches: DataFrame, docs: DataFrame, width: int, least: float) -> DataFrame:
    """Links (a, b) that join the components of rows that share a crowded key, from ``crowded`` (key, row, root, n, count).

    A row's home is the largest key of any row that it shares a key with. Homes are cut into blocks of a bounded number of rows and shingles, and two blocks meet in one
    task if they have a key in common; so each pair of rows is looked at once, whatever number of keys they share. In a task, pairs of two
    components whose estimate is high enough are verified on their shingles, the likeliest first, and links join components there at once:
    no rows are made for pairs that are not alike, nor for pairs that are joined already.
    """
    own = F.max(F.struct("count", "key")).over(Window.partitionBy("row"))  # a row has a key a band
    crowded = stored(crowded.withColumn("own", own), "homes")
    top = crowded.groupBy("key").agg(F.max("own").alias("top"))
    home = crowded.join(top.hint("merge"), "key").groupBy("row").agg(F.max("top")["key"].alias("home"), F.max("root").alias("root"), F.max("n").alias("n"))
    cuts = home.groupBy("home").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("cuts"))
    block = F.xxhash64("home", F.pmod(F.xxhash64("row"), F.col("cuts"))).alias("block")
    placed = stored(home.join(cuts.hint("merge"), "home").select("row", "root", "n", block), "blocks")
    keys = crowded.select("key", "row").join(placed.select("row", "block").hint("merge"), "row").select("key", "block").distinct()
    x, y = keys.select("key", F.col("block").alias("x")), keys.select("key", F.col("block").alias("y")).hint("merge")
    meet = stored(x.join(y, "key").filter("x <= y").select("x", "y").distinct(), "meetings")
    dealt = placed.join(meet.hint("merge"), F.col("block") == F.col("x")).union(placed.join(meet.filter("x <> y").hint("merge"), F.col("block") == F.col("y")))
    content = stored(shingled(docs.join(placed.select("row").hint("merge"), "row", "left_semi"), width).join(sketches.select("row", "marks").hint("merge"), "row"), "crowd")
    return dealt.join(content.hint("merge"), "row").groupBy("x", "y").applyInArrow(lambda group: _meeting(group, least), "a long, b long")


def _meeting(group: pa.Table, least: float) -> pa.Table:
    row, n, block, now = (group.column(c).to_numpy().copy() for c in ("row", "n", "block", "root"))
    marks = np.frombuffer(b"".join(group.column("marks").to_pylist()), np.uint8).reshape(len(row), -1)
    found = [np.frombuffer(f, np.uint64) for f in group.column("found").to_pylist()]
    first, second = group.column("x")[0].as_py(), group.column("y")[0].as_py()
    right = np.flatnonzero(block == second)
    out = []
    for i in np.flatnonzero(block == first):
        js = right[(now[right] != now[i]) & (np.minimum(n[right], n[i]) >= (least - 1e-9) * np.maximum(n[right], n[i]))]
        if first == second:
            js = js[row[js] > row[i]]
        e = estimated(marks[js], marks[i][None]) if len(js) else np.zeros(0)
        for j in js[np.argsort(-e, kind="stable")][: np.count_nonzero(e >= floor(least))]:
            if now[i] != now[j] and jaccard(found[i], found[j]) >= least:
                out.append((min(row[i], row[j]), max(row[i], row[j])))
                now[now == now[j]] = now[i]
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def links(docs: DataFrame, width: int = 5, least: float = LEAST, stars: int = 2) -> DataFrame:
    """(row, root) of all rows that have a link: the smallest row that links of similarity ``least`` or more reach.

    In each of ``stars`` rounds, every row that shares a band's key is compared with a few of the key's rows, unless one component has
    both, and the one with most keys in common is verified; so a large group of copies takes a number of comparisons that grows with its size only. The first round verifies what SimHash links as well (:func:`simhash_pairs`).
    Then all pairs that share a key and are in two components still are compared (:func:`_crowd_links` for keys of many rows), so that no
    link between candidates is lost.
    """
    sketches = stored(sketched(docs, width), "sketches")
    keyed = sketches.select("row", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").count().filter("count > 1").select("key")
    live = stored(keyed.join(shared.hint("merge"), "key").withColumn("root", F.col("row")), "shared")
    found = None
    for k in range(stars):
        hub = live.groupBy("key").agg(F.min(F.struct(F.xxhash64("row", F.pmod("key", F.lit(3)), F.lit(k)).alias("place"), "root", "row", "n")).alias("hub"))
        near = live.join(hub.hint("merge"), "key").filter("root <> hub.root").filter(_near_in_size("n", "hub.n", least))
        # The more keys two rows share, the likelier they are alike.
        met = near.groupBy(F.col("row").alias("a"), F.col("hub.row").alias("b")).agg(F.count(F.lit(1)).alias("keys"))
        best = met.groupBy("a").agg(F.max(F.struct("keys", "b"))["b"].alias("b"))
        best = stored(best if k else best.union(simhash_pairs(docs, width)), "pairs")
        if best.isEmpty():
            continue
        more = stored(alike(best, docs, width, least), "links")
        found = more if found is None else found.union(more)
        roots = components(found).withColumnsRenamed({"node": "row", "root": "now"})
        moved = live.join(roots.hint("merge"), "row", "left").select("key", "row", "n", F.coalesce("now", "row").alias("root"))
        apart = moved.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
        live = stored(moved.join(apart.hint("merge"), "key", "left_semi"), "shared")
    sizes = live.groupBy("key").count()
    rare = live.join(sizes.filter(F.col("count") <= CROWD).hint("merge"), "key", "left_semi")
    x, y = rare.alias("x"), rare.alias("y").hint("merge")
    apart = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.row") < F.col("y.row")) & (F.col("x.root") != F.col("y.root")) & _near_in_size("x.n", "y.n", least))
    pairs = likely(apart.select(F.col("x.row").alias("a"), F.col("y.row").alias("b")).distinct(), sketches, least).select("a", "b")
    crowded = stored(live.join(sizes.filter(F.col("count") > CROWD).hint("merge"), "key"), "crowded")
    more = alike(pairs, docs, width, least)
    if not crowded.isEmpty():
        more = more.union(_crowd_links(crowded, sketches, docs, width, least))
    found = components(more if found is None else found.union(more))
    dropped(live)
    return found.withColumnsRenamed({"node": "row"})


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = LEAST) -> DataFrame:
    """``docs`` with one row of each component of similar texts, the one with the smallest id (null ids last); columns unchanged.

    Rows are told apart by a number of their own, so repeated and null ids are decided on like any other.
    """
    rows = carried(docs, "near-rows")
    texts = rows.select("row", field(text_col).cast("string").alias("text"), field(id_col).cast("long").alias("id"))
    linked = stored(links(texts, width, least).join(texts.select("row", "id").hint("merge"), "row"), "linked")
    kept = F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"]
    lost = linked.join(linked.groupBy("root").agg(kept.alias("kept")).hint("merge"), "root").filter("row <> kept").select("row")
    return rows.join(lost.hint("merge"), "row", "left_anti").select("doc.*")
