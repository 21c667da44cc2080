"""The asset source and sink: round trips, broken files, and writers whose tasks are lost or fail."""

from __future__ import annotations

import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tesserae.sources import assets, fmbank
from tesserae.sources.files import encode_png

OPERATOR = dict(zip(fmbank.OPERATOR_FIELDS, (3, 2, 100, 1, 31, 1, 12, 5, 15, 9, 8), strict=True))


@pytest.fixture
def source(spark):
    assets.register(spark)
    return lambda kind, path, **options: spark.read.format("assets").option("kind", kind).options(**options).load(str(path))


def listed(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names)


def test_raw_files_in_partitions(spark, source, tmp_path):
    rows = [(f"d{k % 3}/f{k}.bin", bytes([k]) * k) for k in range(40)]
    spark.createDataFrame(rows, "name string, content binary").repartition(5).write.format("assets").mode("append").save(str(tmp_path))
    assert listed(tmp_path) == sorted(n for n, _ in rows)
    df = source("raw", tmp_path, partitionBytes="100")
    assert sorted((r.path, bytes(r.content)) for r in df.collect()) == sorted(rows) and df.rdd.getNumPartitions() > 5
    assert source("raw", tmp_path, pattern="f1*.bin").count() == 11
    spark.createDataFrame(rows[:2], "name string, content binary").write.format("assets").mode("overwrite").save(str(tmp_path))
    assert listed(tmp_path) == sorted(n for n, _ in rows[:2])


def test_broken_files_are_rows(spark, source, tmp_path):
    good = encode_png(np.full((2, 3, 4), 7))
    for name, data in {"a.png": good, "b.png": b"no image", "c.png": good[:40], "d.png": b""}.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.path: r for r in source("png", tmp_path).collect()}
    assert rows["a.png"].error is None and (rows["a.png"].width, rows["a.png"].height, rows["a.png"].rgba) == (3, 2, [7] * 24)
    assert all(rows[n].error and rows[n].rgba is None for n in ("b.png", "c.png", "d.png"))
    (tmp_path / "e.tiles").write_bytes(bytes(33))
    assert source("tiles", tmp_path, pattern="*.tiles").first().error == "not a whole number of tiles"


def test_images_as_bytes(spark, source, tmp_path):
    """The same pixels with a byte a value, both ways; broken files are rows here too."""
    rows = [("a.png", 3, 2, bytes(range(24))), ("b.png", 1, 1, b"\xff\0\x80\1")]
    spark.createDataFrame(rows, "name string, width int, height int, rgba binary").write.format("assets").option("kind", "png_bytes").mode("append").save(str(tmp_path))
    (tmp_path / "c.png").write_bytes(b"no image")
    got = {r.path: r for r in source("png_bytes", tmp_path).collect()}
    assert {(r.path, r.width, r.height, bytes(r.rgba)) for r in got.values() if r.rgba is not None} == set(rows) and got["c.png"].error
    assert {r.path: bytes(r.rgba) for r in source("png", tmp_path, pattern="[ab].png").collect()} == {n: d for n, _, _, d in rows}
    numbers = spark.createDataFrame([(n, w, h, list(d)) for n, w, h, d in rows], "name string, width int, height int, rgba array<int>")
    numbers.write.format("assets").option("kind", "png").mode("append").save(str(tmp_path / "again"))
    assert [(tmp_path / "again" / n).read_bytes() == (tmp_path / n).read_bytes() for n in ("a.png", "b.png")] == [True, True]


def test_values_out_of_range_are_errors(spark, tmp_path):
    """However rows reach the writer: a tile's pixels are bytes, a map's words 16 bits."""
    for kind, column, wrong in (("tiles", "tiles array<array<int>>", [[0] * 63 + [256]]), ("tiles", "tiles array<array<int>>", [[-1] * 64]), ("words", "words array<int>", [1, 1 << 16])):
        with pytest.raises(Exception, match="out of bounds"):
            spark.createDataFrame([("x", wrong)], f"name string, {column}").write.format("assets").option("kind", kind).mode("append").save(str(tmp_path))
    assert listed(tmp_path) == []


def test_many_small_files_are_more_than_one_partition(spark, tmp_path):
    for k in range(600):
        (tmp_path / f"{k}.words").write_bytes(b"\0\1")
    source = assets.Assets({"path": str(tmp_path), "kind": "words"})
    parts = source.reader(StructType.fromDDL(source.schema())).partitions()
    assert len(parts) == 2 and sum(len(p.paths) for p in parts) == 600


def test_sheets_and_their_files(spark, tmp_path, monkeypatch):
    """Sheets with holes and null sizes, dealt to as many tasks as they need; tiles, maps and images as a plain loop gives them, with no file's pixels made in a list of expressions."""
    from tesserae.plans import binaries

    rng = random.Random(4)
    monkeypatch.setattr(binaries, "SHEETS_A_TASK", 8)
    parts = [(k, rng.choice([None, 0, 1, 7, 15, 16, 50])) for k in range(64 * 20) if rng.random() < 0.8 or k % 64 == 0] + [(64 * 99 + 5, 3)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    sheets = binaries.sheet_tiles(spark, str(tmp_path))
    assert sheets.rdd.getNumPartitions() == 3
    own = dict(parts)
    got = {r.sheet: r for r in binaries.drawn(binaries.banked(sheets)).collect()}
    assert set(got) == {k // 64 for k in own}
    for k in got:
        size = [own.get(64 * k + slot) or 0 for slot in range(64)]
        px = [[(s % 5 * (i % 8) + s % 3 * (i // 8)) % 16 for i in range(64)] for s in size]
        tiles = [p for n, p in enumerate(px) if p not in px[:n]]
        assert got[k].tiles == tiles and got[k].words == [tiles.index(p) for p in px]
        grey = [px[y // 8 * 8 + x // 8][y % 8 * 8 + x % 8] for y in range(64) for x in range(64)]
        assert bytes(got[k].rgba) == bytes(c for v in grey for c in (v * 17, v * 17, v * 17, 255 if v else 0))
    query = binaries.tile_bank_files(spark, str(tmp_path))
    text = query._jdf.queryExecution().optimizedPlan().toString()
    assert "element_at" not in text and "lpad" not in text
    assert query.filter("whole").count() == query.count() == 3 * len(got)


def test_lost_tasks_and_aborts_leave_nothing(tmp_path):
    """Two attempts of one task write the same row; only the attempt whose message Spark keeps is moved. An abort removes all."""
    schema = StructType.fromJson({"type": "struct", "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in (("name", "string"), ("content", "binary"))]})
    make = lambda overwrite=False: assets.AssetWriter({"path": str(tmp_path)}, schema, overwrite)
    row = lambda n, c: iter([Row(name=n, content=c)])
    writer = make()
    writer.write(row("x", b"lost"))
    kept = writer.write(row("x", b"kept"))
    assert listed(tmp_path) and not (tmp_path / "x").exists()
    writer.commit([kept, None])
    assert listed(tmp_path) == ["x"] and (tmp_path / "x").read_bytes() == b"kept"
    writer = make()
    again = [writer.write(row("x", b"new"))]
    with pytest.raises(ValueError, match="exists"):
        writer.commit(again)
    assert (tmp_path / "x").read_bytes() == b"kept" and listed(tmp_path) == ["x"]
    writer = make(True)
    twice = [writer.write(row("y", b"1")), writer.write(row("y", b"2"))]
    with pytest.raises(ValueError, match="two rows"):
        writer.commit(twice)
    assert listed(tmp_path) == ["x"]
    writer = make()
    writer.write(row("z", b"1"))
    writer.abort([None])
    assert listed(tmp_path) == ["x"]


def test_failing_task_aborts(spark, source, tmp_path):
    bad = spark.range(20).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") == 13, F.raise_error(F.lit("stop")).cast("binary")).otherwise(F.lit(b"x")).alias("content")).repartition(4)
    with pytest.raises(Exception, match="stop"):
        bad.write.format("assets").mode("append").save(str(tmp_path))
    assert listed(tmp_path) == []
    for name in ("../up", "", "_hidden", None):
        with pytest.raises(Exception, match="no name"):
            spark.createDataFrame([(name, b"x")], "name string, content binary").write.format("assets").mode("append").save(str(tmp_path))
    with pytest.raises(Exception, match="missing: content"):
        spark.createDataFrame([("a",)], "name string").write.format("assets").mode("append").save(str(tmp_path))


@pytest.mark.parametrize("version", [1, 2])
def test_banks_round_trip(version):
    rng = random.Random(version)
    operator = lambda: tuple(rng.randrange(1 << bits) for _, _, bits in fmbank.PLACES)
    make = lambda n: [(f"Patch {k}", rng.randrange(-99, 99), rng.randrange(8), rng.randrange(8), rng.randrange(256), [operator() for _ in range(4)]) for k in range(n)]
    melodic, drums = make(130), make(3)
    data = fmbank.encode(version, melodic, drums)
    assert len(data) == (19 if version == 2 else 12) + 3 * 128 * 64
    rows = list(fmbank.decode(data))
    assert [r[4:] for r in rows] == melodic + drums and {r[0] for r in rows} == {version}
    assert [r[1:4] for r in rows[127:132]] == [(False, 0, 127), (False, 1, 0), (False, 1, 1), (True, 0, 0), (True, 0, 1)]
    for broken in (data[:-1], b"RIFF" + data[4:], data[:11], b""):
        with pytest.raises(ValueError):
            list(fmbank.decode(broken))


def test_bank_layout():
    """Bytes of one patch, and nameless patches between named ones."""
    data = fmbank.encode(2, [("", 0, 0, 0, 0, [tuple(OPERATOR.values())] * 4), ("Bass", -12, 5, 6, 3, [tuple(OPERATOR.values())] * 4)], [])
    own = data[19 + 64 : 19 + 128]
    assert own[:5] == b"Bass\x00" and struct.unpack("<h", own[32:34])[0] == -12 and own[34:36] == bytes([5 | 6 << 3, 3])
    assert own[36:43] == bytes([2 | 3 << 4, 100, 31 | 1 << 6, 12 | 0x80, 5, 9 | 15 << 4, 8])
    assert [r[4] for r in fmbank.decode(data)] == ["Bass"]


def test_lookup_whatever_the_case(spark):
    rows = [("f", True, 0, 0, "Kick", 1), ("f", False, 0, 5, "kick", 2), ("f", False, 0, 2, "Lead", 3), ("g", False, 0, 0, "LEAD", 4)]
    patches = spark.createDataFrame(rows, "path string, drum boolean, bank int, slot int, name string, algorithm int")
    wanted = spark.createDataFrame([("f", "KICK"), ("f", "lead"), ("g", "Lead"), ("g", "kick")], "path string, wanted string")
    assert {(r.path, r.wanted): r.patch and r.patch.algorithm for r in fmbank.found(patches, wanted).collect()} == {("f", "KICK"): 2, ("f", "lead"): 3, ("g", "Lead"): 4, ("g", "kick"): None}
