from __future__ import annotations

import base64
import gzip
import io
import json
import struct
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.sinks import text as sinks
from tesserae.sources import documents, files


def png(colour: int, depth: int, width: int, lines: list[bytes], filters: list[int], extra: bytes = b"") -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    body = b"".join(bytes([f]) + x for f, x in zip(filters, lines, strict=True))
    return files.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(lines), depth, colour, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def filtered(image: np.ndarray, how: int) -> bytes:
    """Rows of RGBA bytes under one PNG filter."""
    out, above = [], np.zeros(image.shape[1] * 4, int)
    for row in image.reshape(len(image), -1).astype(int):
        left, corner = np.concatenate([np.zeros(4, int), row[:-4]]), np.concatenate([np.zeros(4, int), above[:-4]])
        guess = left + above - corner
        near = np.stack([abs(guess - left), abs(guess - above), abs(guess - corner)]).argmin(axis=0)
        base = [0 * row, left, above, (left + above) // 2, np.choose(near, [left, above, corner])][how]
        out.append(((row - base) % 256).astype(np.uint8).tobytes())
        above = row
    return out


@pytest.mark.parametrize("how", range(5))
def test_png_filters(how):
    image = np.random.default_rng(how).integers(0, 256, (7, 5, 4))
    width, height, rgba = files.decode_png(png(6, 8, 5, filtered(image, how), [how] * 7))
    assert (width, height) == (5, 7) and (rgba == image).all()
    assert (files.decode_png(files.encode_png(image))[2] == image).all()


def test_png_kinds(spark):
    palette = struct.pack(">I", 6) + b"PLTE" + bytes([9, 8, 7, 1, 2, 3]) + b"\0\0\0\0"
    rows = [("grey1", png(0, 1, 3, [bytes([0b10100000])], [0])), ("indexed", png(3, 8, 2, [bytes([0, 1])], [0], palette)), ("broken", b"no"), ("none", None), ("short", png(6, 8, 5, [b"x"], [0]))]
    out = {r.name: r for r in files.images(spark.createDataFrame(rows, "name string, content binary")).collect()}
    assert out["grey1"].rgba[::4] == [255, 0, 255] and out["indexed"].rgba == [9, 8, 7, 255, 1, 2, 3, 255]
    assert all(out[k].error and out[k].rgba is None for k in ("broken", "none", "short"))
    px = files.pixels(files.images(spark.createDataFrame(rows[:2], "name string, content binary")), ("name",)).filter("name = 'indexed' and x = 1").first()
    assert (px.y, px.r, px.g, px.b, px.a) == (0, 1, 2, 3, 255)


def test_folder_scan(spark, tmp_path):
    image = np.full((2, 2, 4), 7)
    (tmp_path / "a.png").write_bytes(files.encode_png(image))
    (tmp_path / "b.txt").write_text("x")
    found = files.images(files.files(spark, str(tmp_path), "*.png")).collect()
    assert len(found) == 1 and found[0].rgba == [7] * 16
    kinds = spark.createDataFrame([("a.PNG", False), ("x.aseprite", False), ("a hero with a sword", False), ("dir", True), ("z.bin", False)], "p string, d boolean").select(files.kind_of(F.col("p"), F.col("d"))).collect()
    assert [k[0] for k in kinds] == ["image", "sprite", "prompt", "folder", "unknown"]


def test_sounds(spark):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(struct.pack("<3h", 1, -2, 300))
    r = {x.n: x for x in files.sounds(spark.createDataFrame([("a", out.getvalue()), ("b", b"RIFF")], "n string, content binary")).collect()}
    assert (r["a"].rate, r["a"].channels, r["a"].bits, r["a"].samples) == (8000, 1, 16, [1, -2, 300]) and r["b"].error


def test_chip_music_header(spark):
    head = bytearray(256)
    head[:4] = b"Vgm "
    struct.pack_into("<10I", head, 4, 252, 0x171, 3579545, 0, 0, 88200, 0x1C, 44100, 60, 0)
    struct.pack_into("<3I", head, 0x2C, 7670453, 0, 0x0C)
    old = bytearray(head)
    struct.pack_into("<I", old, 8, 0x100)
    rows = spark.createDataFrame([(1, bytes(head)), (2, bytes(old)), (3, b"nope")], "id int, d binary").withColumn("h", files.chip_music_header(F.col("d")))
    a, b, c = (r.h for r in rows.orderBy("id").collect())
    assert (a.version, a.version_text, a.psg_clock, a.fm_clock, a.samples, a.seconds, a.data_offset) == (0x171, "1.71", 3579545, 7670453, 88200, 2.0, 0x40)
    assert (b.rate, b.data_offset) == (60, 0x40) and c is None


CELLS = [1, 2, 0x80000003, 0, 5, 6]


def xml(data: str) -> str:
    return f"""<map width="3" height="2" tilewidth="8" tileheight="8"><tileset firstgid="1" name="ground" tilecount="4"/><tileset firstgid="5" name="more" tilecount="9"/>
        <layer name="main" width="3" height="2">{data}</layer>
        <objectgroup name="things"><object id="1" name="start" type="Spawn" x="4" y="8.5"><properties><property name="subtype" value="player"/></properties></object></objectgroup></map>"""


def test_maps(spark):
    raw = struct.pack("<6I", *CELLS)
    b64 = lambda d: base64.b64encode(d).decode()
    rows = [
        ("csv", xml('<data encoding="csv">1,2,2147483651,\n0,5,6</data>')), ("plain", xml(f'<data encoding="base64"> {b64(raw)} </data>')),
        ("zlib", xml(f'<data encoding="base64" compression="zlib">{b64(zlib.compress(raw))}</data>')), ("gzip", xml(f'<data encoding="base64" compression="gzip">{b64(gzip.compress(raw))}</data>')),
        ("list", xml("<data>" + "".join(f'<tile gid="{c}"/>' for c in CELLS) + "</data>")), ("short", xml('<data encoding="csv">1,2</data>')),
        ("json", json.dumps({"width": 3, "height": 2, "tilesets": [{"firstgid": 1, "name": "ground", "tilecount": 4}], "layers": [{"name": "main", "type": "tilelayer", "width": 3, "height": 2, "data": CELLS}, {"name": "things", "type": "objectgroup", "objects": [{"id": 1, "name": "start", "type": "Spawn", "x": 4, "y": 8.5, "properties": [{"name": "subtype", "value": "player"}]}]}]})),
        ("json64", json.dumps({"width": 3, "height": 2, "layers": [{"name": "main", "width": 3, "height": 2, "encoding": "base64", "compression": "zlib", "data": b64(zlib.compress(raw))}]})),
    ]
    maps = spark.createDataFrame(rows, "map_id string, text string")
    found: dict = {}
    for r in documents.map_cells(maps).collect():
        found.setdefault(r.map_id, {})[r.y * 3 + r.x] = r.raw
    want = dict(enumerate(CELLS))
    assert found.pop("short") == {0: 1, 1: 2, 2: 0, 3: 0, 4: 0, 5: 0}
    assert all(v == want for v in found.values()) and len(found) == 7
    sets = sorted(map(tuple, documents.map_tilesets(maps.filter("map_id in ('csv', 'json')")).collect()))
    assert sets == [("csv", 1, "ground", 4), ("csv", 5, "more", 9), ("json", 1, "ground", 4)]
    things = documents.map_objects(maps.filter("map_id in ('csv', 'json')")).collect()
    assert len(things) == 2 and all((t.name, t.type, t.x, t.y, t.properties) == ("start", "spawn", 4.0, 8.5, {"subtype": "player"}) for t in things)


def test_sprite_json(spark):
    frame = lambda x, ms: {"frame": {"x": x, "y": 0, "w": 16, "h": 16}, "duration": ms}
    meta = {"frameTags": [{"name": "walk", "from": 0, "to": 1, "direction": "pingpong"}], "image": "a.png"}
    rows = [("list", json.dumps({"frames": [{"filename": "f0", **frame(0, 100)}, {"filename": "f1", **frame(16, 5)}], "meta": meta})), ("hash", json.dumps({"frames": {"z 1": frame(0, 50), "a 2": frame(16, 200)}, "meta": {}}))]
    docs = spark.createDataFrame(rows, "doc string, text string")
    got = sorted(map(tuple, documents.sprite_frames(docs, "doc", F.col("text")).collect()))
    assert got == [("hash", 0, "z 1", 0, 0, 16, 16, 3), ("hash", 1, "a 2", 16, 0, 16, 16, 12), ("list", 0, "f0", 0, 0, 16, 16, 6), ("list", 1, "f1", 16, 0, 16, 16, 1)]
    assert [tuple(r) for r in documents.sprite_tags(docs, "doc", F.col("text")).collect()] == [("list", "walk", 0, 1, "pingpong")]


def test_replies_and_assembly(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'Sure!\n```json\n[{"id": 3, "type": "hero"}]\n``` done'), (2, "none"), (3, 'x {"id": 4} y')], "n int, t string")
    a = {r.n: (r.a, r.o) for r in rows.select("n", documents.reply_array(F.col("t"), "struct<id: int, type: string>").alias("a"), documents.reply_object(F.col("t"), "id: int").alias("o")).collect()}
    assert a[1][0][0].type == "hero" and a[2] == (None, None) and a[3][1].id == 4
    lines = [".proc main", "lda #1", "rts", ".endproc", "nop", ".proc other", "inx", ".endproc"]
    got = documents.assembly_blocks(spark.createDataFrame([("f", k, x) for k, x in enumerate(lines)], "file string, no int, line string"), ("file",), "no").orderBy("no").collect()
    assert [(r.line, r.block) for r in got] == [("lda #1", 1), ("rts", 1), ("inx", 2)]
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "metadata.json").write_text(json.dumps({"sprites": [{"id": 1, "type": "hero"}, {"id": 2, "type": "foe"}]}))
    (tmp_path / "metadata.json").write_text("{broken")
    assert sorted(r.type for r in documents.manifests(spark, str(tmp_path)).collect()) == ["foe", "hero"]


def test_sinks(spark, tmp_path):
    colours = spark.createDataFrame([("p", k, k * 0x111) for k in range(11)], "palette string, idx int, word int")
    lines = sinks.palette_lines(colours, ["palette"], F.col("word")).orderBy("line_no").collect()
    assert lines[0].line == "    dc.w    $0000, $0111, $0222, $0333, $0444, $0555, $0666, $0777" and lines[1].line.endswith("$0AAA")
    assert sinks.padded_palette(colours, ["palette"]).filter("idx >= 11 and word = 0").count() == 5
    data = sinks.binary(colours.withColumn("h", F.lpad(F.hex("word"), 4, "0")), ["palette"], ["idx"], "h", 3, 4).first().data
    assert bytes(data) == bytes([0, 0, 1, 0x11, 2, 0x22, 0, 0])
    line = spark.range(1).select(sinks.resource_line(F.lit("sprite"), F.lit("hero"), F.lit("a.png"), F.lit("4"), F.lit("NONE"))).first()[0]
    assert line == 'SPRITE hero "a.png" 4 NONE'
    sinks.write_lines(spark.range(100).select("id", F.concat(F.lit("line "), F.col("id").cast("string")).alias("line")), str(tmp_path / "out"), ["id"])
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert [x for p in parts for x in p.read_text().splitlines()] == [f"line {k}" for k in range(100)]
    assert spark.range(1).select(sinks.guarded(F.array(F.lit("int a;")), F.lit("A_H"))).first()[0].splitlines()[0] == "#ifndef A_H"
