"""Animation sequences, frames in time, and state machines as edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from .storage import stored


def from_names(sprites: DataFrame, name: str = "name", ordinal: str = "ord", keys: Sequence[str] = ()) -> DataFrame:
    """Frames found in names like ``walk_01``: action (lower case), number, frame (from 0, by number then ordinal), ticks, loop.

    Frames count inside ``keys`` (a sheet, a character), as an action such as ``walk`` is everyone's.
    """
    stem = F.regexp_replace(F.col(name), r"^(.*[/\\])?([^/\\]+?)\.[^./\\]*$", "$2")
    pattern = r"^(.+?)[-_]?(\d+)$"
    found = sprites.withColumn("__stem", F.when(F.col(name).contains("."), stem).otherwise(F.col(name))).filter(F.col("__stem").rlike(pattern))
    found = found.select("*", F.lower(F.regexp_extract("__stem", pattern, 1)).alias("action"), F.regexp_extract("__stem", pattern, 2).cast("decimal(38,0)").cast("long").alias("number")).drop("__stem")
    w = Window.partitionBy(*keys, "action").orderBy("number", ordinal)
    ticks = dims.lookup(F.col("action"), dims.TICKS, dims.DEFAULT_TICKS)
    return found.withColumn("frame", F.row_number().over(w) - 1).withColumn("ticks", ticks).withColumn("loop", ~F.col("action").isin(*dims.ONE_SHOT))


def timeline(frames: DataFrame, keys: Sequence[str], order: str = "frame") -> DataFrame:
    """``frames`` with the half-open span [start, end) of ticks in their sequence, and its total."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    t = frames.withColumn("end", F.sum("ticks").over(w)).withColumn("start", F.col("end") - F.col("ticks"))
    return t.withColumn("total", F.sum("ticks").over(Window.partitionBy(*keys)))


def frame_at(frames: DataFrame, moments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each (keys, tick): the frame shown then; loops start over, others stay at their last frame.

    Starts of frames and moments are put in one order and each moment takes the last frame before it, so no pairs are made.
    """
    t = timeline(frames, keys)
    totals = t.groupBy(*keys).agg(F.max("total").alias("total"), F.max("loop").alias("loop")).filter("total > 0")
    at = F.when(F.col("loop"), F.pmod(F.col("tick"), F.col("total"))).otherwise(F.least(F.col("tick"), F.col("total") - 1))
    asked = moments.join(totals, list(keys)).select(*keys, at.cast("long").alias("__at"), F.lit(1).alias("__ask"), F.lit(None).cast(frames.schema["frame"].dataType).alias("frame"), "tick")
    starts = t.filter("end > start").select(*keys, F.col("start").cast("long").alias("__at"), F.lit(0).alias("__ask"), "frame", F.lit(None).cast(asked.schema["tick"].dataType).alias("tick"))
    w = Window.partitionBy(*keys).orderBy("__at", "__ask").rowsBetween(Window.unboundedPreceding, 0)
    shown = starts.unionByName(asked).withColumn("frame", F.last("frame", ignorenulls=True).over(w))
    return shown.filter("__ask = 1 and frame is not null").select(*keys, "tick", "frame")


def directions(items: Column, direction: Column) -> Column:
    """An array played ``forward``, in ``reverse`` or as ``pingpong`` (back again without both ends, if over two)."""
    n = F.size(items)
    back = F.when(n > 2, F.reverse(F.slice(items, F.lit(2), F.greatest(n - 2, F.lit(0))))).otherwise(F.slice(items, 1, 0))
    return F.when(direction == "reverse", F.reverse(items)).when(direction == "pingpong", F.concat(items, back)).otherwise(items)


def row_sequences(sprites: DataFrame, keys: Sequence[str], tolerance: int = 8, spread: int = 4) -> DataFrame:
    """Sprites of a row (y in steps of ``tolerance``) by x: frame, frames, is_animation (two or more of like size) and the action that their number tells."""
    row = F.floor(F.col("y") / tolerance)
    w = Window.partitionBy(*keys, "row")
    s = sprites.withColumn("row", row).withColumn("frames", F.count(F.lit(1)).over(w)).withColumn("frame", F.row_number().over(w.orderBy("x", *[c for c in sprites.columns if c not in {"x", *keys}])) - 1)
    like = ((F.max("w").over(w) - F.min("w").over(w)) <= spread) & ((F.max("h").over(w) - F.min("h").over(w)) <= spread) & (F.col("frames") >= 2)
    n = F.col("frames")
    action = F.when(F.col("is_animation"), F.when(n >= 6, "walk").when(n >= 4, "run").when(n == 2, "idle"))
    return s.withColumn("is_animation", like).withColumn("action", action)


def reachable(edges: DataFrame, starts: DataFrame, keys: Sequence[str], rounds: int = 10_000) -> DataFrame:
    """States (keys, state) that can be reached from ``starts`` (keys, state) along ``edges`` (keys, src, dst), starts included.

    Breadth first: each round joins the new states only, and cuts its lineage by writing them. Cycles end by the anti-join.
    """
    seen = fresh = stored(starts.select(*keys, "state").distinct(), "reach")
    step = edges.select(*keys, F.col("src").alias("state"), "dst").distinct()
    for _ in range(rounds):
        fresh = stored(fresh.join(step, [*keys, "state"]).select(*keys, F.col("dst").alias("state")).distinct().join(seen, [*keys, "state"], "left_anti"), "reach")
        if fresh.isEmpty():
            return seen
        seen = seen.unionByName(fresh)
    raise RuntimeError(f"states are still being reached after {rounds} rounds")


def fsm_problems(states: DataFrame, edges: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """Rows (key, state, problem): missing start or target, unreachable, one-shot without ``anim_complete``, shared animation."""
    found = [
        starts.join(states, [key, "state"], "left_anti").select(key, "state", F.lit("no start").alias("problem")),
        edges.join(states.select(key, F.col("state").alias("dst")), [key, "dst"], "left_anti").select(key, F.col("dst").alias("state"), F.lit("no target").alias("problem")).distinct(),
        states.join(reachable(edges, starts, [key]), [key, "state"], "left_anti").select(key, "state", F.lit("unreachable").alias("problem")),
        states.filter("not loop").join(edges.filter("condition = 'anim_complete'").select(key, F.col("src").alias("state")), [key, "state"], "left_anti").select(key, "state", F.lit("no exit").alias("problem")),
        states.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(key, "anim"))).filter("__n > 1").select(key, "state", F.lit("shared animation").alias("problem")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def prioritised(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges of a state with their rank: higher priority first, then the order given."""
    return edges.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "src").orderBy(F.desc("priority"), "ord")))


def condition(text: Column) -> Column:
    """A condition as struct(kind, name, negated): ``input_``, ``timer_``, ``event_`` prefixes, ``anim_complete``, or a flag; ``!`` negates."""
    bare = F.regexp_replace(text, "^!", "")
    kind = F.when(bare == "anim_complete", "complete").when(bare.startswith("input_"), "input").when(bare.startswith("timer_"), "timer").when(bare.startswith("event_"), "event").otherwise("flag")
    return F.struct(kind.alias("kind"), F.regexp_replace(bare, "^(input|timer|event)_", "").alias("name"), text.startswith("!").alias("negated"))
