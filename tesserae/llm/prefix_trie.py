"""Prefix tries of conversations: forests by first turn inside applyInPandas, oversized subtries dealt again by their next turn."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, spread_join, stored

NOTHING = hashlib.sha256(b"").hexdigest()
#: Bytes of a turn's digest, and of one run of ids in :func:`end_digests`.
DIGEST, RUN = 16, 1 << 18

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, k (0, 1, ... in the order of turns), digest (of role and text, 16 bytes) and bytes (of the text).

    A null turn comes first; equal turns are ordered by role, then by the SHA-256 of the text. Rows without a conv_id are left out.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), F.sha2(text, 256).alias("body"), F.octet_length(text).cast("long").alias("bytes")
    )
    digest = F.unhex(F.substring(F.sha2(F.concat_ws(":", F.length("role"), "role", "body"), 256), 1, 2 * DIGEST)).alias("digest")
    order = F.expr("row_number() over (partition by conv_id order by turn asc nulls first, role, body) - 1").alias("k")
    return rows.select("conv_id", order, digest, "bytes")


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its five."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 9


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, key, path (array of digests) and bytes (array): every conversation with its first turns from conversation ``c - c % 5``."""
    ids = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), shared_turns(F.col("conv_id")).alias("h"))
    turn = lambda part: F.struct(F.lit(part).alias("part"), "k", "digest", "bytes").alias("t")
    own = turns.filter(F.col("k") >= shared_turns(F.col("conv_id"))).select("conv_id", turn(1))
    lent = turns.filter("k < 8").withColumnRenamed("conv_id", "base").join(ids, "base").filter("k < h").select("conv_id", turn(0))
    none = ids.select("conv_id", F.lit(None).cast(own.schema["t"].dataType).alias("t"))  # a row for those without any turn
    whole = own.unionByName(lent).unionByName(none).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return whole.select("conv_id", F.sha2(F.array_join(F.transform("t.digest", F.hex), ""), 256).alias("key"), F.col("t.digest").alias("path"), F.col("t.bytes").alias("bytes"))


def end_digests(rows: DataFrame) -> DataFrame:
    """key and ends: SHA-256 of the decimal conv_ids of a key, ascending, joined by commas.

    Ids are sorted by a range partitioning of (key, conv_id), so that a key with a third of all rows lies in many partitions; each makes runs
    of text of them, and only the runs meet, in order, in one task, which hashes them as they come.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, text, size = None, None, [], 0
        out: list[tuple] = []
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key or size >= RUN:
                    if text:
                        out.append((key, first, ",".join(text)))
                    key, first, text, size = k, c, [], 0
                text.append(str(c))
                size += 1 + len(text[-1])
            if text and out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["key", "first", "text"])
                out = []
        if text:
            out.append((key, first, ",".join(text)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["key", "first", "text"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k == key:
                    state.update(b",")
                else:
                    if state:
                        out.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                state.update(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["key", "ends"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["key", "ends"])

    ordered = rows.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    cut = ordered.mapInArrow(runs, "key string, first long, text string")
    return cut.repartition("key").sortWithinPartitions("key", "first").select("key", "text").mapInArrow(hashes, "key string, ends string")


NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, top boolean, parent array<binary>"


def grown(frame: pd.DataFrame) -> pd.DataFrame:
    """The nodes of all subtries of one bucket. A row is a sequence: top (depth of its subtrie's first node), parent, prefix, path and bytes from that node on, n, first, ends."""
    kids: list[dict] = []
    size, own, first, ends, depth, parent, above = [], [], [], [], [], [], []

    def node(bytes_: int, deep: int, of, up: int) -> int:
        kids.append({})
        for column, value in zip((size, own, first, ends, depth, parent, above), (bytes_, 0, None, None, deep, of, up), strict=True):
            column.append(value)
        return len(kids) - 1

    roots: dict[tuple, int] = {}
    for top, of, prefix, path, sizes, n, smallest, digest in zip(*(frame[c] for c in ("top", "parent", "prefix", "path", "bytes", "n", "first", "ends")), strict=True):
        key = tuple(prefix)
        if key not in roots:
            roots[key] = node(int(sizes[0]), int(top), of, -1)
        at = roots[key]
        for step, amount in zip(path[1:], sizes[1:], strict=True):
            to = kids[at].get(step)
            if to is None:
                to = kids[at][step] = node(int(amount), depth[at] + 1, None, at)
            at = to
        own[at], first[at], ends[at] = int(n), int(smallest), digest
    total, leaves, saved = own[:], [0] * len(kids), [0] * len(kids)
    stack = [(root, False) for root in roots.values()]
    while stack:  # postorder without recursion: a node's turn comes again once its children are done
        at, seen = stack.pop()
        if not seen:
            stack.append((at, True))
            stack.extend((k, False) for k in kids[at].values())
            continue
        for k in kids[at].values():
            total[at] += total[k]
            leaves[at] += leaves[k]
            saved[at] += saved[k]
            first[at] = first[k] if first[at] is None else min(first[at], first[k])
        leaves[at] = leaves[at] or 1
        saved[at] += (total[at] - 1) * size[at]
    return pd.DataFrame({
        "conv_id": first, "depth": depth, "parent_conv_id": pd.array([None if a < 0 else first[a] for a in above], "Int64"), "n_convs": total, "n_children": [len(k) for k in kids], "n_leaves": leaves,
        "saved_tokens": saved, "ends_sha256": [e or NOTHING for e in ends], "top": [a < 0 for a in above], "parent": parent,
    })


def forests(rows: DataFrame, limit: int) -> DataFrame:
    """Nodes of all subtries of ``rows`` (path, bytes, n, first, ends, top, parent); subtries of one bucket share a call."""
    spark = rows.sparkSession
    turns = rows.agg(F.sum(F.size("path") - F.col("top") + 1)).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // (16 * limit)))
    tail = lambda c: F.slice(c, F.col("top"), F.size(c) - F.col("top") + 1).alias(c)
    prefix = F.slice("path", F.lit(1), F.col("top"))
    dealt = rows.select(F.pmod(F.xxhash64(prefix), F.lit(buckets)).alias("bucket"), "top", "parent", prefix.alias("prefix"), tail("path"), tail("bytes"), "n", "first", "ends")
    return dealt.groupBy("bucket").applyInPandas(grown, NODES)


def common(low: Column, high: Column) -> Column:
    """How many first elements two arrays share."""
    same = F.zip_with(low, high, lambda a, b: ~a.eqNullSafe(b))
    return F.when(F.array_contains(same, True), F.array_position(same, True) - 1).otherwise(F.size(low)).cast("int")


def dealt(sequences: DataFrame, limit: int) -> tuple[list[DataFrame], list[tuple[DataFrame, DataFrame]]]:
    """Sequences whose subtrie has at most ``limit`` turns, by round, and the spines above the others: (spine, sequences that end at its foot), by round.

    In the first round a subtrie holds the sequences of one first turn. One of more than ``limit`` turns becomes a spine, the nodes down to
    the last turn that all its sequences share, and its sequences are dealt anew by the turn after that. A spine is parent, prefix, top (depth
    of its first node), foot (depth of its last), key (the path to its foot) and bytes (of its nodes).
    """
    todo = sequences.filter(F.size("path") > 0).withColumns({"top": F.lit(1), "parent": F.lit(None).cast("array<binary>"), "prefix": F.slice("path", 1, 1)})
    small, spines = [], []
    while True:
        big = stored(todo.groupBy("prefix").agg(F.sum(F.size("path") - F.col("top") + 1).alias("turns")).filter(F.col("turns") > limit).select("prefix", F.lit(True).alias("big")), "trie-oversized")
        if big.isEmpty():
            return [*small, todo], spines
        marked = stored(spread_join(todo, big, ["prefix"], F.xxhash64("path")), "trie-level")
        small.append(marked.filter("big is null").drop("big"))
        large = marked.filter("big is not null").drop("big")
        ends = large.groupBy("prefix", "top", "parent").agg(F.min(F.struct("path", "bytes")).alias("low"), F.max("path").alias("high"))
        foot = common(F.col("low.path"), F.col("high"))
        spine = ends.select("parent", "prefix", "top", foot.alias("foot"), F.slice("low.path", F.lit(1), foot).alias("key"), F.slice("low.bytes", F.col("top"), foot - F.col("top") + 1).alias("bytes"))
        spine = stored(spine, "trie-spines")
        below = spread_join(large, spine.select("prefix", "foot"), ["prefix"], F.xxhash64("path"), "inner")
        over = below.filter(F.size("path") == F.col("foot")).select(F.col("path").alias("key"), "n", "first", "ends")
        spines.append((spine, stored(over, "trie-ends")))
        todo = below.filter(F.size("path") > F.col("foot")).select(
            "path", "bytes", "n", "first", "ends", (F.col("foot") + 1).alias("top"), F.slice("path", F.lit(1), F.col("foot")).alias("parent"), F.slice("path", F.lit(1), F.col("foot") + 1).alias("prefix")
        )
        todo = stored(todo, "trie-sequences")


def joined_up(tops: DataFrame, spine: DataFrame, over: DataFrame) -> DataFrame:
    """Spines with the sums over the subtries (rows of ``tops``) and sequences below their feet: first, n, children, leaves, saved (at the foot), ends."""
    below = tops.groupBy("parent").agg(
        F.min("conv_id").alias("low"), F.sum("n_convs").alias("below"), F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    )
    own = spine.join(below.withColumnRenamed("parent", "key"), "key", "left").join(over, "key", "left")
    total = F.coalesce("below", F.lit(0)) + F.coalesce("n", F.lit(0))
    return own.select(
        "parent", "top", "foot", "key", "bytes", F.least("low", "first").alias("first"), total.alias("n"), F.coalesce("children", F.lit(0)).cast("long").alias("children"), F.coalesce("leaves", F.lit(1)).cast("long").alias("leaves"),
        (F.coalesce("saved", F.lit(0)) + (total - 1) * F.element_at("bytes", -1)).alias("saved"), F.coalesce("ends", F.lit(NOTHING)).alias("ends"),
    )


def spine_nodes(spine: DataFrame) -> DataFrame:
    """A row a node of every spine, as the forests have them: all its nodes have the members of its foot."""
    at = spine.select("*", F.posexplode(F.sequence(F.col("top"), F.col("foot"))).alias("place", "depth"))
    last = F.col("depth") == F.col("foot")
    more = F.aggregate(F.slice("bytes", F.col("place") + 1, F.col("foot") - F.col("depth")), F.lit(0).cast("long"), lambda a, b: a + b)
    first = F.col("place") == 0
    return at.select(
        F.col("first").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.when(~first, F.col("first")).alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(last, F.col("children")).otherwise(F.lit(1)).alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("saved") + (F.col("n") - 1) * more).alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(F.lit(NOTHING)).alias("ends_sha256"), first.alias("top"), F.when(first, F.col("parent")).alias("parent"),
    )


def prefix_nodes(conversations: DataFrame, limit: int = 2048, rebuild: Callable[[DataFrame], DataFrame] = rebuilt, **columns) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of the first turns (role, text) of a conversation that ``rebuild`` has put together; conversations that start
    with it are its members, and conv_id is the smallest. saved_tokens sums, over a node's subtree with itself, its members but one times the
    UTF-8 bytes of its last text. ends_sha256 is the digest of the ids of the members that end there (ascending, comma-joined).

    Turns are told apart by 128 bits of SHA-256, so no text is shuffled. Equal conversations become one sequence with a count before the tries
    are built. Sequences are dealt by their first turn; a subtrie of more than ``limit`` turns is dealt again by its next turn, and the nodes
    above are summed by Spark (:func:`dealt`, :func:`joined_up`), so no task builds more than some thousands of turns, whatever the table holds.

    Null roles and texts count as empty, a null turn comes first, turns that tie are ordered by role and text digest, and rows repeated are turns of their own.
    Rows without a conv_id are left out. An empty table has no node, not even the root. Other columns are ignored.
    """
    turns = stored(turns_of(conversations, **columns), "trie-turns")
    paths = stored(rebuild(turns), "trie-paths")
    ends = end_digests(paths)
    counted = paths.groupBy("key", "path", "bytes").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"))
    sequences = stored(counted.join(ends, "key").drop("key"), "trie-sequences")
    dropped(turns, paths)
    small, spines = dealt(sequences, limit)
    rows = small[0].drop("prefix")
    for more in small[1:]:
        rows = rows.unionByName(more.drop("prefix"))
    nodes = stored(forests(rows, limit), "trie-nodes")
    tops = nodes.filter("top")
    feet = None
    for spine, over in reversed(spines):
        own = stored(joined_up(tops.filter("parent is not null"), spine, over), "trie-spines")
        found = spine_nodes(own)
        nodes, tops = nodes.unionByName(found), tops.unionByName(found.filter("top"))
        foot = own.select(F.col("key").alias("parent"), F.col("first").alias("up"))
        feet = foot if feet is None else feet.unionByName(foot)
    root = tops.filter("parent is null").select("conv_id", "n_convs", F.lit(1).alias("child"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends"))
    root = root.unionByName(sequences.filter(F.size("path") == 0).select(F.col("first").alias("conv_id"), F.col("n").alias("n_convs"), F.lit(0).alias("child"), F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), "ends"))
    root = root.agg(
        F.min("conv_id").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("child").cast("long").alias("n_children"),
        F.greatest(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.coalesce(F.max("ends"), F.lit(NOTHING)).alias("ends_sha256"),
    )
    root = stored(root.filter("conv_id is not null"), "trie-root")
    smallest = next((r.conv_id for r in root.collect()), None)
    inner = nodes.filter("not top").select(*COLUMNS)
    first = nodes.filter("top and parent is null").withColumn("parent_conv_id", F.lit(smallest).cast("long")).select(*COLUMNS)
    out = root.select(*COLUMNS).unionByName(inner).unionByName(first)
    if feet is not None:
        out = out.unionByName(spread_join(nodes.filter("top and parent is not null"), feet, ["parent"], F.xxhash64("conv_id", "depth"), "inner").withColumn("parent_conv_id", F.col("up")).select(*COLUMNS))
    return out


def oracle_sql() -> str:
    """The same over ``conversations`` with paths as strings, every node told to all its ancestors."""
    digits = "list_concat([4294967295], flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(CAST(conv_id AS VARCHAR), '')]))"
    crc = f"xor(list_reduce({digits}, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"
    return f"""
        WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 AS k FROM conversations WHERE conv_id IS NOT NULL),
        ids AS (SELECT DISTINCT conv_id, CAST({crc} AS BIGINT) % 9 AS h, conv_id - conv_id % 5 AS base FROM t),
        r AS (SELECT conv_id, 1 AS part, k, role, text FROM t JOIN ids USING (conv_id) WHERE k >= h UNION ALL SELECT ids.conv_id, 0, k, role, text FROM ids JOIN t ON t.conv_id = ids.base WHERE k < h),
        s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS depth, sha256(length(role) || ':' || role || ':' || text) AS d, strlen(text) AS bytes FROM r),
        p AS (SELECT conv_id, depth, bytes, string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS node FROM s UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
        n AS MATERIALIZED (SELECT node, any_value(depth) AS depth, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs FROM p GROUP BY node),
        l AS (SELECT left(node, 64 * (depth - 1)) AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
        m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN l USING (node)),
        u AS (SELECT left(node, 64 * a) AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * bytes) AS saved FROM m, range(0, depth + 1) x(a) GROUP BY 1),
        last AS (SELECT conv_id, max_by(node, depth) AS node FROM p GROUP BY conv_id), e AS (SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM last GROUP BY node)
        SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
        FROM m JOIN u USING (node) LEFT JOIN e USING (node) LEFT JOIN n up ON m.depth > 0 AND up.node = left(m.node, 64 * (m.depth - 1))
    """
