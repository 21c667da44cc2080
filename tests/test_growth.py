"""Queries whose cost must not grow faster than their tables: what is sent, and what a worker holds at once."""

from __future__ import annotations

import random

import pytest

from tesserae.plans import catalog


def plan(df) -> list[tuple[str, str]]:
    """Every node of a query's plan with the nodes above it."""
    above: list[tuple[int, str]] = []
    out = []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [x for x in above if x[0] < depth]
        out.append((line[depth:], " ".join(n for _, n in above)))
        above.append((depth, line[depth:].split(" ")[0]))
    return out


@pytest.mark.parametrize("name", ["scanline_load", "scanline_violations", "worst_scanline", "heat_class", "layout_hints"])
def test_lines_are_written_out_behind_the_shuffles(spark, sf_dir, name):
    above = [up for node, up in plan(catalog.QUERIES[name](spark, sf_dir)) if node.startswith("Generate explode(sequence(")]
    assert above and not any("Exchange" in up.split() for up in above)


def test_loads_as_a_plain_loop_gives_them(spark):
    from tesserae.operators import screen

    rng = random.Random(7)
    rows = [(rng.choice([1, 2, None]), rng.randrange(-40, 240), rng.choice([None, 8, 16, 32]), rng.choice([0, 8, 32])) for _ in range(60)] + [(9, 300, 8, 8)]
    want: dict[tuple, list] = {}
    for key, y, w, h in rows:
        for line in range(max(0, y), min(224, y + h)):
            at = want.setdefault((key, line), [0, None])
            at[0] += 1
            at[1] = at[1] if w is None else (at[1] or 0) + w
    load = screen.scanline_load(spark.createDataFrame(rows, "k int, y int, w int, h int"), ["k"])
    assert {(r.k, r.scanline): [r.sprites, r.pixels] for r in load.collect()} == want and load.count() == len(want)


def test_a_distinct_tile_is_encoded_once(spark, sf_dir):
    """The layouts lie over the grouping of equal tiles, which the optimiser would drop under the outer one."""
    assert any(node.startswith("HashAggregate(keys=[px#") for node, _ in plan(catalog.QUERIES["tile_layouts"](spark, sf_dir)))


def test_tiles_are_not_shuffled_with_their_pixels(spark, sf_dir):
    from tesserae.plans import fixtures as fx

    assert not any("REPARTITION_BY_COL" in node for node, _ in plan(fx.tiles(spark, sf_dir)))


def test_a_converted_tile_is_made_once(spark):
    """Conversion, flips and keys lie under the join that gives them to the tiles."""
    from pyspark.sql import functions as F

    from tesserae.operators import tiles

    px = spark.createDataFrame([(1, 1, [3, 0, 1, 2]), (1, 2, [0, 3, 2, 1]), (2, 1, [1, 2, 3, 0]), (2, 2, [2, 1, 0, 3]), (3, 1, [3, 0, 1, 2])], "a int, b int, px array<int>")
    d = tiles.dedup(px, ["a", "b"], width=2)
    made = tiles.rebuild(d, px, ["a", "b"], F.transform("px", lambda p: F.least(p, F.lit(1))), width=2)
    assert {(r.a, r.b): r.px for r in made.collect()} == {(r.a, r.b): [min(p, 1) for p in r.px] for r in px.collect()}
    assert made.filter(F.md5(F.array_join(F.col("px").cast("array<string>"), ",")) != F.col("new_key")).count() == 0
    assert "reverse" not in plan(made)[1][0]


def test_a_partition_of_files_is_read_in_bounded_batches(spark, tmp_path, monkeypatch):
    """However many files a partition has, and however small they are packed."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    from tesserae.sources import assets

    for k in range(6):
        (tmp_path / f"{k}.tiles").write_bytes(bytes([k]) * 32 * 10)
    monkeypatch.setattr(assets, "VALUES", 640)
    source = assets.Assets({"path": str(tmp_path), "kind": "tiles"})
    reader = source.reader(StructType.fromDDL(source.schema()))
    (partition,) = reader.partitions()
    batches = list(reader.read(partition))
    assert all(isinstance(b, pa.RecordBatch) and b.num_rows <= 10 for b in batches) and sum(b.num_rows for b in batches) == 60
