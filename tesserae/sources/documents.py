"""Structured text as rows: tile maps (XML and JSON), sprite-editor JSON, manifests, assembly blocks, replies with JSON inside."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

PROPERTY = "struct<_name: string, _value: string, _type: string>"
MAP_XML = f"""_width int, _height int, _tilewidth int, _tileheight int, _orientation string, _renderorder string,
    properties struct<property: array<{PROPERTY}>>,
    tileset array<struct<_firstgid: bigint, _name: string, _tilecount: int, _source: string, tile: array<struct<_id: bigint, properties: struct<property: array<{PROPERTY}>>>>>>,
    layer array<struct<_name: string, _width: int, _height: int, _visible: int, data: struct<_VALUE: string, _encoding: string, _compression: string, tile: array<struct<_gid: bigint>>>>>,
    objectgroup array<struct<_name: string, object: array<struct<_id: int, _name: string, _type: string, _class: string, _x: double, _y: double, _width: double, _height: double, properties: struct<property: array<{PROPERTY}>>>>>>"""
MAP_JSON = """struct<width: int, height: int, tilewidth: int, tileheight: int, orientation: string, properties: string,
    tilesets: array<struct<firstgid: bigint, name: string, tilecount: int, source: string, tiles: array<struct<id: bigint, properties: string>>>>,
    layers: array<struct<name: string, type: string, width: int, height: int, visible: boolean, encoding: string, compression: string, data: string,
    objects: array<struct<id: int, name: string, type: string, class: string, x: double, y: double, width: double, height: double, properties: string>>>>>"""


@F.pandas_udf(BinaryType())
def _inflated(data: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for body, how in data:
        yield pd.Series([None if d is None else gzip.decompress(d) if h == "gzip" else zlib.decompress(d) if h == "zlib" else d for d, h in zip(body, how, strict=True)])


def _words(data: Column) -> Column:
    """Little-endian 32-bit words of a binary column."""
    text = F.hex(data)
    word = lambda i: F.conv(F.concat(*[F.substring(text, i * 8 + k, F.lit(2)) for k in (7, 5, 3, 1)]), 16, 10).cast("long")
    n = F.floor(F.length(text) / 8).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), word)).otherwise(F.array().cast("array<bigint>"))


def _numbers(csv: Column) -> Column:
    return F.transform(F.filter(F.split(csv, ","), lambda s: F.trim(F.regexp_replace(s, r"\s", "")) != ""), lambda s: F.regexp_replace(s, r"\s", "").cast("long"))


def _filled(layers: DataFrame) -> DataFrame:
    """Layers (map_id, layer, layer_ord, width, encoding, compression, body, listed, count) with ``cells``: raw numbers from base64 (plain, gzip or zlib), CSV or a list, filled up with zeros to ``count``."""
    packed = F.unbase64(F.when(F.col("encoding") == "base64", F.regexp_replace("body", r"\s", "")))
    rows = layers.withColumn("__raw", _inflated(packed, F.coalesce("compression", F.lit(""))))
    none = F.array().cast("array<bigint>")
    values = F.when(F.col("encoding") == "base64", _words(F.col("__raw"))).when(F.col("encoding") == "csv", _numbers(F.col("body"))).otherwise(F.coalesce("listed", none))
    v = rows.withColumn("__v", F.coalesce(values, none))
    return v.select("map_id", "layer", "layer_ord", "width", F.concat("__v", F.array_repeat(F.lit(0).cast("long"), F.greatest(F.col("count") - F.size("__v"), F.lit(0)))).alias("cells"))


def _layer_cells(layers: DataFrame) -> DataFrame:
    flat = layers.select("map_id", "layer", "layer_ord", "width", F.posexplode("cells").alias("i", "raw"))
    return flat.select("map_id", "layer", "layer_ord", (F.col("i") % F.col("width")).alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), "raw")


def map_cells(maps: DataFrame, key: str = "map_id", text: str = "text") -> DataFrame:
    """Cells of all tile layers: map_id, layer, layer_ord, x, y, raw. A text that starts with ``{`` is JSON, others are XML; broken ones give no cells."""
    m = maps.select(F.col(key).alias("map_id"), F.trim(F.col(text)).alias("t"))
    x = m.filter(~F.col("t").startswith("{")).select("map_id", F.from_xml("t", MAP_XML).alias("m"))
    x = x.select("map_id", F.posexplode("m.layer").alias("layer_ord", "l"))
    listed = F.transform("l.data.tile", lambda t: F.coalesce(t["_gid"], F.lit(0)))
    xml = x.select(
        "map_id", F.col("l._name").alias("layer"), "layer_ord", F.col("l._width").alias("width"), F.coalesce("l.data._encoding", F.lit("")).alias("encoding"), F.col("l.data._compression").alias("compression"),
        F.col("l.data._VALUE").alias("body"), listed.alias("listed"), (F.col("l._width") * F.col("l._height")).alias("count"),
    )
    j = m.filter(F.col("t").startswith("{")).select("map_id", F.from_json("t", MAP_JSON).alias("m")).select("map_id", F.posexplode("m.layers").alias("layer_ord", "l")).filter("coalesce(l.type, 'tilelayer') = 'tilelayer'")
    data = F.col("l.data")
    json = j.select(
        "map_id", F.col("l.name").alias("layer"), "layer_ord", F.col("l.width").alias("width"), F.coalesce("l.encoding", F.lit("")).alias("encoding"), F.col("l.compression").alias("compression"),
        data.alias("body"), F.when(data.startswith("["), F.from_json(data, "array<bigint>")).alias("listed"), (F.col("l.width") * F.col("l.height")).alias("count"),
    )
    return _layer_cells(_filled(xml.unionByName(json)))


def map_tilesets(maps: DataFrame, key: str = "map_id", text: str = "text") -> DataFrame:
    """map_id, first_gid, name, tile_count."""
    m = maps.select(F.col(key).alias("map_id"), F.trim(F.col(text)).alias("t"))
    x = m.filter(~F.col("t").startswith("{")).select("map_id", F.explode(F.from_xml("t", MAP_XML)["tileset"]).alias("s")).select("map_id", F.col("s._firstgid").alias("first_gid"), F.col("s._name").alias("name"), F.col("s._tilecount").alias("tile_count"))
    j = m.filter(F.col("t").startswith("{")).select("map_id", F.explode(F.from_json("t", MAP_JSON)["tilesets"]).alias("s")).select("map_id", F.col("s.firstgid").alias("first_gid"), F.col("s.name").alias("name"), F.col("s.tilecount").alias("tile_count"))
    return x.unionByName(j)


def map_objects(maps: DataFrame, key: str = "map_id", text: str = "text") -> DataFrame:
    """map_id, layer, id, name, type (lower case), x, y, width, height, properties (map)."""
    m = maps.select(F.col(key).alias("map_id"), F.trim(F.col(text)).alias("t"))
    x = m.filter(~F.col("t").startswith("{")).select("map_id", F.explode(F.from_xml("t", MAP_XML)["objectgroup"]).alias("g")).select("map_id", F.col("g._name").alias("layer"), F.explode("g.object").alias("o"))
    pairs = F.coalesce(F.col("o.properties.property"), F.array().cast(f"array<{PROPERTY}>"))
    xml = x.select("map_id", "layer", F.col("o._id").alias("id"), F.col("o._name").alias("name"), F.lower(F.coalesce("o._type", "o._class", F.lit(""))).alias("type"), *[F.coalesce(F.col(f"o._{c}"), F.lit(0.0)).alias(c) for c in ("x", "y", "width", "height")], F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["_name"], p["_value"]))).alias("properties"))
    j = m.filter(F.col("t").startswith("{")).select("map_id", F.explode(F.from_json("t", MAP_JSON)["layers"]).alias("g")).filter("g.type = 'objectgroup'").select("map_id", F.col("g.name").alias("layer"), F.explode("g.objects").alias("o"))
    json = j.select("map_id", "layer", F.col("o.id").alias("id"), F.col("o.name").alias("name"), F.lower(F.coalesce("o.type", "o.class", F.lit(""))).alias("type"), *[F.coalesce(F.col(f"o.{c}"), F.lit(0.0)).alias(c) for c in ("x", "y", "width", "height")], properties(F.col("o.properties")).alias("properties"))
    return xml.unionByName(json)


def properties(text: Column) -> Column:
    """A property list or object in JSON as a map."""
    listed = F.from_json(text, "array<struct<name: string, value: string>>")
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.when(F.trim(text).startswith("["), F.map_from_entries(F.transform(listed, lambda p: F.struct(p["name"], p["value"])))).otherwise(F.from_json(text, "map<string,string>")), empty)


FRAME = "struct<filename: string, frame: struct<x: int, y: int, w: int, h: int>, duration: int>"
SPRITE_META = "struct<image: string, size: struct<w: int, h: int>, scale: string, frameTags: array<struct<name: string, from: int, to: int, direction: string>>>"


def sprite_frames(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Frames of sprite-editor JSON, in either form (a list, or an object by name in its order): key, index, name, x, y, w, h, ticks (of 1/60 s, at least 1)."""
    d = docs.select(key, F.get_json_object(text, "$.frames").alias("f"))
    listed = F.from_json("f", f"array<{FRAME}>")
    named = F.transform(F.map_entries(F.from_json("f", f"map<string, {FRAME}>")), lambda e: F.struct(e["key"].alias("filename"), e["value"]["frame"].alias("frame"), e["value"]["duration"].alias("duration")))
    rows = d.select(key, F.posexplode(F.when(F.col("f").startswith("["), listed).otherwise(named)).alias("index", "v"))
    ticks = F.greatest(F.lit(1), F.bround(F.coalesce("v.duration", F.lit(100)) * 60 / F.lit(1000.0)).cast("int"))
    return rows.select(key, "index", F.coalesce("v.filename", F.concat(F.lit("frame_"), F.col("index").cast("string"))).alias("name"), *[F.coalesce(F.col(f"v.frame.{c}"), F.lit(0)).alias(c) for c in "xywh"], ticks.alias("ticks"))


def sprite_tags(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, name, from, to, direction."""
    t = docs.select(key, F.explode(F.from_json(F.get_json_object(text, "$.meta"), SPRITE_META)["frameTags"]).alias("t"))
    return t.select(key, "t.name", "t.from", "t.to", F.coalesce("t.direction", F.lit("forward")).alias("direction"))


def manifests(spark: SparkSession, folder: str, pattern: str = "metadata.json", schema: str = "sprites array<struct<id: int, type: string, action: string, description: string>>") -> DataFrame:
    """Manifest files below a folder: path and one row per sprite; files that can't be read are skipped."""
    raw = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).json(folder)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.explode("sprites").alias("s")).select("path", "s.*")


def reply_array(text: Column, item: str) -> Column:
    """The first JSON array in a reply, fences and prose around it or not, as an array of ``item``; null if there is none."""
    bare = F.regexp_replace(text, "```(?:json)?", "")
    return F.from_json(F.nullif(F.regexp_extract(bare, r"(?s)(\[.*\])", 1), F.lit("")), f"array<{item}>")


def reply_object(text: Column, fields: str) -> Column:
    return F.from_json(F.nullif(F.regexp_extract(F.regexp_replace(text, "```(?:json)?", ""), r"(?s)(\{.*\})", 1), F.lit("")), f"struct<{fields}>")


def assembly_blocks(lines: DataFrame, keys: tuple[str, ...], ordinal: str, line: str = "line") -> DataFrame:
    """Lines of ``.proc`` ... ``.endproc`` blocks with their block's number and name; other lines are left out."""
    name = F.regexp_extract(line, r"^\s*\.proc\s+(\w+)", 1)
    w = Window.partitionBy(*keys).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    opened = F.sum((name != "").cast("int")).over(w)
    closed = F.sum(F.lower(F.trim(F.col(line))).startswith(".endproc").cast("int")).over(w)
    b = lines.withColumn("block", opened).withColumn("__closed", closed).withColumn("name", F.last(F.nullif(name, F.lit("")), ignorenulls=True).over(w))
    return b.filter((F.col("block") > F.col("__closed")) & (name == "")).drop("__closed")
