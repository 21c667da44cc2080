"""Manifests, catalogs, caches, providers, templates: small relational operators over asset tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a change of tier does to colours, dithering, resizing; other ways down follow a rule.
DOWN = {
    (2, 0): ("median_cut", False, "NEAREST", "weighted_luminance"),
    (2, 1): ("median_cut", True, "NEAREST", "euclidean"),
    (4, 2): ("k_means", True, "LANCZOS", "perceptual"),
}


def first_named(names: DataFrame, codes: DataFrame) -> DataFrame:
    """``names`` (…, name) with the code of the first entry of ``codes`` (ord, name, code) of that name, whatever its case; null where none."""
    first = codes.groupBy(F.lower("name").alias("__low")).agg(F.min(F.struct("ord", "code"))["code"].alias("code"))
    return names.withColumn("__low", F.lower("name")).join(F.broadcast(first) if _few(first) else first, "__low", "left").drop("__low")


def _few(df: DataFrame, most: int = 10_000) -> bool:
    """Whether a table is small enough to go to every executor, by its count."""
    return df.limit(most + 1).count() <= most


def downsample(pairs: DataFrame, source: str, target: str) -> DataFrame:
    """``pairs`` with reduction, dither, resize and matching of the way from one tier down to another; ``reduction`` is null for the same tier, ``error`` upwards."""
    s, t = F.col(source), F.col(target)
    known = lambda k: [(s == a) & (t == b) for a, b in DOWN][k]

    def pick(n: int, other: Column) -> Column:
        out = other
        for k, values in enumerate(DOWN.values()):
            out = F.when(known(k), F.lit(values[n])).otherwise(out)
        return F.when(s > t, out)

    return pairs.withColumns({
        "reduction": F.when(s < t, "error").otherwise(pick(0, F.lit("median_cut"))), "dither": pick(1, t >= 1), "resize": pick(2, F.when(t <= 0, "NEAREST").otherwise("LANCZOS")), "matching": pick(3, F.lit("euclidean")),
    })


def cell_of(points: DataFrame, grid: DataFrame, keys: Sequence[str], w: int, h: int) -> DataFrame:
    """``points`` (keys, x, y) with the columns of the ``grid`` cell (keys, tx, ty, …) that each lies in; null outside of the grid."""
    at = points.withColumns({"tx": F.floor(F.col("x") / w).cast("long"), "ty": F.floor(F.col("y") / h).cast("long")})
    return at.join(grid, [*keys, "tx", "ty"], "left")


def every_variant(assets: DataFrame, platforms: Sequence[str], own: DataFrame, key: str) -> DataFrame:
    """A row per asset and platform: the stage that ``own`` (key, platform, stage) has, else ``pending``."""
    grid = assets.select(key, F.explode(F.array(*map(F.lit, platforms))).alias("platform"))
    return grid.join(own, [key, "platform"], "left").withColumn("stage", F.coalesce("stage", F.lit("pending")))


def best_provider(preferred: Column, needs: Column, providers: Sequence[tuple[str, int, bool]]) -> Column:
    """The provider (name, bits, available; in order) for a request: the preferred one if it is available and able, else the first that is, or null.

    ``needs`` are bits of which one must be there, 0 for none.
    """
    ready = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(name).alias("name"), F.lit(bits).alias("bits")) for k, (name, bits, available) in enumerate(providers) if available])
    able = F.filter(ready, lambda p: (needs == 0) | (needs.bitwiseAND(p["bits"]) != 0))
    return F.array_min(F.transform(able, lambda p: F.struct((p["name"] != preferred).alias("other"), p["ord"].alias("ord"), p["name"].alias("name"))))["name"]


def bank_starts(animations: DataFrame, keys: Sequence[str], name: str, start: str) -> DataFrame:
    """(keys, banks): first banks of an asset's animations as name:bank, comma-joined by name."""
    pairs = F.array_sort(F.collect_list(F.struct(name, start)))
    return animations.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda s: F.concat_ws(":", s[name], s[start].cast("string"))), ",").alias("banks"))


def slot_usage(pixels: DataFrame, slot: str, index: str, image: str, indexed: str) -> DataFrame:
    """Per slot and index: images that use it and how often: indexed images count once each, true-colour ones by pixel."""
    once = F.when(F.col(indexed), 1).otherwise(F.col("n"))
    each = pixels.groupBy(slot, index, image, indexed).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(slot, index).agg(F.count(F.lit(1)).alias("images"), F.sum(once).alias("uses"))


def resource_usage(used: DataFrame, key: str, tiles: str, limit: Column) -> DataFrame:
    """(key, tiles, share in whole per mille, near): near from nine tenths of the limit on."""
    total = used.groupBy(key).agg(F.sum(tiles).alias("tiles"))
    share = F.floor(F.col("tiles") * 1000 / limit)
    return total.select(key, "tiles", share.alias("share"), (F.col("tiles") * 10 > limit * 9).alias("near"))


def nested_catalog(rows: DataFrame, kind: str, action: str, item: str) -> DataFrame:
    """(kind, actions): a kind's actions as action:count, comma-joined by action, with the first item of each."""
    counts = rows.groupBy(kind, action).agg(F.count(F.lit(1)).alias("n"), F.min(item).alias("first"))
    listed = F.array_sort(F.collect_list(F.struct(action, "n", "first")))
    return counts.groupBy(kind).agg(F.array_join(F.transform(listed, lambda s: F.concat_ws(":", s[action], s["n"].cast("string"), s["first"].cast("string"))), ",").alias("actions"))


def kind_counts(rows: DataFrame, kind: str) -> DataFrame:
    """(kind, n) of every kind, and of all of them as ``total``."""
    return rows.rollup(kind).agg(F.count(F.lit(1)).alias("n")).select(F.coalesce(kind, F.lit("total")).alias(kind), "n")


def stage_times(log: DataFrame, run: str, stage: str, at: str) -> DataFrame:
    """(run, stage, micros): how long each stage took: until the next entry of the run; a stage that comes again adds up, the last entry ends the run."""
    w = Window.partitionBy(run).orderBy(at, stage)
    lasted = log.select(run, stage, (F.unix_micros(F.lead(at).over(w)) - F.unix_micros(at)).alias("micros")).filter("micros is not null")
    return lasted.groupBy(run, stage).agg(F.sum("micros").alias("micros"), F.count(F.lit(1)).alias("entries"))


def progress(log: DataFrame, task: str, at: str, total: Column) -> DataFrame:
    """``log`` with the percent done, rounded down, and whole seconds a step so far."""
    w = Window.partitionBy(task).orderBy(at, "id")
    k = F.row_number().over(w)
    since = F.unix_micros(at) - F.min(F.unix_micros(at)).over(w)
    return log.select(task, "id", F.floor(k * 100 / total).alias("percent"), F.floor(since / (k * 1_000_000)).alias("seconds"))


def first_of(rows: DataFrame, keys: Sequence[str], order: Column, text: Column, most: int) -> DataFrame:
    """(keys, n, first): how many rows, and the texts of the ``most`` first ones, comma-joined. Only those leave a task, so no group is collected whole."""
    w = Window.partitionBy(*keys).orderBy(order)
    ranked = rows.select(*keys, text.alias("__text"), F.row_number().over(w).alias("__k"))
    counted = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    top = ranked.filter(F.col("__k") <= most).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__k", "__text"))), lambda s: s["__text"]), ",").alias("first"))
    return counted.join(top, list(keys))


def request_key(fields: dict[str, Column]) -> Column:
    """Twelve hex digits of the MD5 of the fields as JSON in the order of their names; strings must not need escapes."""
    said = [F.concat(F.lit(f'"{name}": '), F.concat(F.lit('"'), value, F.lit('"')) if quoted else value.cast("string")) for name, (value, quoted) in sorted(fields.items())]
    return F.substring(F.md5(F.concat(F.lit("{"), F.concat_ws(", ", *said), F.lit("}"))), 1, 12)


def uncached(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Distinct requests (by ``key``) that no cache entry answers."""
    return requests.dropDuplicates([key]).join(cache.select(key), key, "left_anti")


def fresh_answers(requests: DataFrame, cache: DataFrame, key: str, at: str, hours: int = 24) -> DataFrame:
    """``requests`` with hit: whether the latest entry of the key before the request is at most ``hours`` old."""
    entries = cache.select(key, F.col(at).alias("__at"), F.lit(True).alias("__entry"), F.lit(None).cast("long").alias("id"))
    asked = requests.select(key, F.col(at).alias("__at"), F.lit(False).alias("__entry"), "id")
    w = Window.partitionBy(key).orderBy("__at", F.col("__entry").desc()).rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("__entry"), F.col("__at"))).over(w)
    seen = entries.union(asked).withColumn("__last", last).filter(~F.col("__entry"))
    return seen.select(key, "id", F.coalesce(F.unix_micros("__at") - F.unix_micros("__last") <= hours * 3_600_000_000, F.lit(False)).alias("hit"))


# A character's animations, and the edges of its standard machine: from, to, condition, priority.
CHARACTER = ("idle", "walk", "attack", "hurt", "death")
CHARACTER_EDGES = (
    ("idle", "walk", "input_move", 0), ("walk", "idle", "!input_move", 0), ("idle", "attack", "input_attack", 0), ("attack", "idle", "anim_complete", 0), ("idle", "hurt", "event_damage", 5),
    ("walk", "hurt", "event_damage", 5), ("attack", "hurt", "event_damage", 5), ("hurt", "idle", "anim_complete", 0), ("hurt", "death", "event_death", 10),
)


def character_machine(characters: DataFrame, key: str, combat: str) -> DataFrame:
    """(key, src, dst, condition, priority): the standard machine of each character; without ``combat`` only idle and walk."""
    edges = F.array(*[F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst"), F.lit(c).alias("condition"), F.lit(p).alias("priority")) for a, b, c, p in CHARACTER_EDGES])
    kept = F.filter(edges, lambda e: F.col(combat) | (e["src"].isin("idle", "walk") & e["dst"].isin("idle", "walk")))
    return characters.select(key, F.explode(kept).alias("e")).select(key, "e.*")


def autotile(cells: DataFrame, key: str, solid: Column) -> DataFrame:
    """(key, x, y, mask) of solid cells: which of their neighbours are solid too: right 1, below 2, left 4, above 8."""
    filled = cells.filter(solid).select(key, "x", "y")
    near = [(1, 1, 0), (2, 0, 1), (4, -1, 0), (8, 0, -1)]
    seen = filled.select(key, F.explode(F.array(*[F.struct((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.lit(bit).alias("bit")) for bit, dx, dy in near])).alias("n")).select(key, "n.*")
    masks = seen.groupBy(key, "x", "y").agg(F.sum("bit").cast("int").alias("mask"))
    return filled.join(masks, [key, "x", "y"], "left").withColumn("mask", F.coalesce("mask", F.lit(0)))


def mask_kind(confidence: Column, kind: Column, least: float = 0.7) -> Column:
    """``pixel`` where a box is uncertain or the sprite a boss, else ``aabb``."""
    return F.when((confidence < least) | (kind == "boss"), "pixel").otherwise("aabb")


def sheet_target(width: Column, height: Column) -> Column:
    """The side that a sheet's sprites are scaled to: 32 where one is larger than 48, else 16."""
    return F.when(F.greatest(width, height) > 48, 32).otherwise(16)


def tier_size(size: Column, from_width: Column, to_width: Column, tile: int = 8) -> Column:
    """A side on a smaller screen: at most half, at least two tiles, a whole number of tiles."""
    scaled = F.least(F.floor(size * to_width / from_width), F.floor(size / 2))
    return F.floor(F.greatest(scaled, F.lit(2 * tile)) / tile) * tile


def frame_clamp(wanted: Column, most: Column, banks: Column, animates: Column) -> Column:
    """Frames that a platform can show: one without animation, else no more than its frames and banks."""
    return F.when(~animates, 1).otherwise(F.least(wanted, most, F.greatest(F.lit(1), banks)))


def animation_sets(assets: DataFrame, keys: Sequence[str], state: str, item: str) -> DataFrame:
    """(keys, states): an asset's states as state=items, items joined by +, states by comma, both in order."""
    by_state = assets.groupBy(*keys, state).agg(F.array_join(F.array_sort(F.collect_list(F.col(item).cast("string"))), "+").alias("items"))
    listed = F.array_sort(F.collect_list(F.struct(state, "items")))
    return by_state.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda s: F.concat_ws("=", s[state], s["items"])), ",").alias("states"))
