"""Binary files made from the driver's tables by the asset sink and read back by the source: images with their tile banks and maps, FM banks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import place, stored
from ..sources import assets, fmbank
from . import fixtures as fx

#: Tiles of a sheet across and down.
SIDE = 8
#: Sheets that one task puts together.
SHEETS_A_TASK = 256


def sheet_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sheet and px: sheets of 64 tiles by slot, one for each part of a range of ids; a slot without a part is blank.

    The number of parts follows from the number of sheets and is told, as estimates know nothing of tiles and files.
    """
    parts = fx.table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 64).alias("sheet"), (F.col("p_partkey") % 64).cast("int").alias("slot"), F.coalesce("p_size", F.lit(0)).alias("size"))
    dealt = parts.repartition(-(-parts.select("sheet").distinct().count() // SHEETS_A_TASK) or 1, "sheet")
    tile = lambda size: F.array(*[((size % 5 * (i % 8) + size % 3 * (i // 8)) % 16).cast("int") for i in range(64)])  # noqa: E731 a transform would not be compiled
    held = dealt.select("sheet", "slot", tile(F.col("size")).alias("px")).groupBy("sheet").agg(F.collect_list(F.struct("slot", "px")).alias("t"))
    slots = F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))
    blank = F.transform(F.filter(slots, lambda k: ~F.array_contains("t.slot", k)), lambda k: F.struct(k.alias("slot"), tile(F.lit(0)).alias("px")))
    own = F.filter("t", lambda s: s["slot"].between(0, SIDE * SIDE - 1))
    return held.select("sheet", F.transform(F.sort_array(F.concat(own, blank)), lambda s: s["px"]).alias("px"))


def banked(sheets: DataFrame) -> DataFrame:
    """``sheets`` with tiles, the distinct ones of px in the order of first use, and words, the map: the number of each slot's tile."""
    return sheets.withColumn("tiles", F.array_distinct("px")).withColumn("words", F.transform("px", lambda p: (F.array_position("tiles", p) - 1).cast("int")))


def drawn(sheets: DataFrame) -> DataFrame:
    """``sheets`` with their image in place of px: r, g, b, a of its pixels as bytes, line by line; grey, clear where 0."""

    def image(px: pa.ListScalar) -> bytes:
        tiles = px.values.flatten().to_numpy()[: 64 * SIDE * SIDE].reshape(SIDE, SIDE, 8, 8)
        grey = tiles.transpose(0, 2, 1, 3).ravel()
        return np.stack([*[grey * 17] * 3, np.where(grey > 0, 255, 0)], axis=1).astype(np.uint8).tobytes()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = pa.array([image(px) for px in batch.column("px")], pa.binary())
            yield batch.drop_columns("px").append_column("rgba", images)

    kept = [f for f in sheets.schema if f.name != "px"]
    return sheets.mapInArrow(each, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "rgba binary"]))


def tile_bank_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sheet as a PNG image, a tile bank and a map: written, read back and compared.

    ``digest`` is the file's SHA-256, for an image that of its pixels (how a PNG file is deflated is no matter of content). Sheets are put together once
    and stored, a row each; files of a kind have a folder of their own.
    """
    assets.register(spark)
    sheets = stored(drawn(banked(sheet_tiles(spark, sf_dir))), "sheets")
    named = lambda ending, *columns: sheets.select(F.concat(F.lit("sheet-"), F.col("sheet").cast("string"), F.lit(f".{ending}")).alias("name"), *columns)
    wide = F.lit(8 * SIDE)
    rows = {"png_bytes": named("png", wide.alias("width"), wide.alias("height"), "rgba"), "tiles": named("tiles", "tiles"), "words": named("words", "words")}
    path = {kind: place(spark, f"asset-{kind}") for kind in rows}
    for kind, df in rows.items():
        df.write.format("assets").option("kind", kind).mode("append").save(path[kind])
    back = lambda kind, as_: spark.read.format("assets").option("kind", as_).load(path[kind])
    images = back("png_bytes", "png_bytes").select(F.col("path").alias("name"), F.col("rgba").alias("seen"), "error")
    out = named("png", "rgba").join(images, "name", "left").select("name", F.sha2("seen", 256).alias("digest"), F.coalesce((F.col("seen") == F.col("rgba")) & F.col("error").isNull(), F.lit(False)).alias("whole"))
    for kind, value, column in (("tiles", F.struct("tile", "px"), "tiles"), ("words", F.struct("cell", "tile"), "words")):
        seen = back(kind, kind).groupBy(F.col("path").alias("name")).agg(F.sort_array(F.collect_list(value)).alias("s"), F.count("error").alias("errors"))
        digest = back(kind, "raw").select(F.col("path").alias("name"), F.sha2("content", 256).alias("digest"))
        last = "px" if kind == "tiles" else "tile"
        same = (F.transform("s", lambda s: s[last]) == F.col(column)) & (F.col("errors") == 0)  # noqa: B023
        out = out.unionByName(rows[kind].join(seen, "name", "left").join(digest, "name", "left").select("name", "digest", F.coalesce(same, F.lit(False)).alias("whole")))
    return out


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sheet, place and an FM patch: melodic ones of parts with even sizes, drums of the others; 512 parts a bank file."""
    size, key = F.col("p_size"), F.col("p_partkey")
    operator = lambda o: F.struct(*[((key * (7 + o) + size * (3 + k) + k) % (1 << bits)).cast("int").alias(f) for k, (f, (_, _, bits)) in enumerate(zip(fmbank.OPERATOR_FIELDS, fmbank.PLACES, strict=True))])
    patch = F.struct(
        F.substring("p_name", 1, 24).alias("name"), (size - 25).cast("int").alias("note_offset"), (key % 8).cast("int").alias("algorithm"), (size % 8).cast("int").alias("feedback"), (key % 64).cast("int").alias("lfo"),
        F.array(*[operator(o) for o in range(4)]).alias("operators"),
    )
    return fx.table(spark, sf_dir, "part").select(F.floor(key / 512).alias("file"), (size % 2 == 1).alias("drum"), key.alias("place"), patch.alias("patch"))


def bank_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banks of :func:`patches` written as files and read again: file, drum, bank, slot and the patch's fields."""
    assets.register(spark)
    own = patches(spark, sf_dir)
    listed = lambda drum: F.transform(F.array_sort(F.collect_list(F.when(F.col("drum") == drum, F.struct("place", "patch")))), lambda s: s["patch"])
    files = own.groupBy("file").agg(listed(False).alias("melodic"), listed(True).alias("drums"))
    path = place(spark, "fm-banks")
    files.select(F.concat(F.lit("bank-"), F.col("file").cast("string"), F.lit(".fm")).alias("name"), F.lit(2).alias("version"), "melodic", "drums").write.format("assets").option("kind", "fmbank").mode("append").save(path)
    return spark.read.format("assets").option("kind", "fmbank").load(path).filter("error is null")


def fm_banks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every patch as it comes back, its operators' fields as text, and its single-instrument file."""
    b = bank_rows(spark, sf_dir)
    flat = F.array_join(F.transform("operators", lambda o: F.concat_ws(":", *[o[f].cast("string") for f in fmbank.OPERATOR_FIELDS])), "|")
    return b.select("path", "version", "drum", "bank", "slot", "name", "note_offset", "algorithm", "feedback", "lfo", flat.alias("fields"), fmbank.single_instrument(F.col("algorithm"), F.col("feedback"), F.col("operators")).alias("single"))


def fm_patch_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first patch of a file for every name that its parts have, asked for in upper case; names that are cut in the file aren't found."""
    wanted = fx.table(spark, sf_dir, "part").select(F.concat(F.lit("bank-"), F.floor(F.col("p_partkey") / 512).cast("string"), F.lit(".fm")).alias("path"), F.upper("p_name").alias("wanted")).distinct()
    got = fmbank.found(stored(bank_rows(spark, sf_dir), "fm-bank-rows"), wanted)
    return got.select("path", "wanted", F.col("patch.drum").alias("drum"), F.col("patch.bank").alias("bank"), F.col("patch.slot").alias("slot"), F.col("patch.algorithm").alias("algorithm"))


QUERIES = {f.__name__: f for f in (tile_bank_files, fm_banks, fm_patch_lookup)}

_SHEETS = """t AS (SELECT sheet, slot, [CAST((s % 5 * (i % 8) + s % 3 * (i // 8)) % 16 AS INTEGER) FOR i IN range(64)] AS px FROM (SELECT sheet, slot, coalesce(p_size, 0) AS s
    FROM (SELECT DISTINCT p_partkey // 64 AS sheet, slot FROM part, range(64) r(slot)) LEFT JOIN (SELECT p_partkey // 64 AS sheet, p_partkey % 64 AS slot, p_size FROM part) USING (sheet, slot))),
    n AS (SELECT sheet, px, row_number() OVER (PARTITION BY sheet ORDER BY min(slot)) - 1 AS tile FROM t GROUP BY sheet, px)"""
_OPERATOR = lambda o: " || ':' || ".join(f"((p_partkey * {7 + o} + p_size * {3 + k} + {k}) % {1 << bits})" for k, (_, _, bits) in enumerate(fmbank.PLACES))


def _single(o: int) -> str:
    value = lambda k: f"((p_partkey * {7 + o} + p_size * {3 + k} + {k}) % {1 << fmbank.PLACES[k][2]})"
    bytes_ = [" + ".join(f"({value(k)} << {shift})" for k, (b, shift, _) in enumerate(fmbank.PLACES) if b == at) for at in range(fmbank.OPERATOR)]
    return " || ".join(f"printf('%02X', {b})" for b in bytes_) + " || '00000000'"


_PATCHES = f"""p AS (SELECT p_partkey // 512 AS file, p_size % 2 = 1 AS drum, p_partkey, p_name, substr(p_name, 1, 24) AS name, CAST(p_size - 25 AS INTEGER) AS note_offset, CAST(p_partkey % 8 AS INTEGER) AS algorithm, CAST(p_size % 8 AS INTEGER) AS feedback,
    CAST(p_partkey % 64 AS INTEGER) AS lfo, {" || '|' || ".join(_OPERATOR(o) for o in range(4))} AS fields, {" || ".join(_single(o) for o in range(4))} AS operators FROM part),
    k AS (SELECT *, 'bank-' || file || '.fm' AS path, row_number() OVER (PARTITION BY file, drum ORDER BY p_partkey) - 1 AS i FROM p)"""

ORACLE_SQL = {
    "tile_bank_files": f"""WITH {_SHEETS},
        b AS (SELECT 'sheet-' || sheet || '.tiles' AS name, sha256(unhex(string_agg(array_to_string([printf('%x', v) FOR v IN px], ''), '' ORDER BY tile))) AS digest FROM n GROUP BY sheet),
        w AS (SELECT 'sheet-' || sheet || '.words' AS name, sha256(unhex(string_agg(printf('%04x', tile), '' ORDER BY slot))) AS digest FROM t JOIN n USING (sheet, px) GROUP BY sheet),
        l AS (SELECT sheet, list(px ORDER BY slot) AS s FROM t GROUP BY sheet),
        g AS (SELECT 'sheet-' || sheet || '.png' AS name, sha256(unhex(array_to_string([printf('%02x%02x%02x%02x', v * 17, v * 17, v * 17, CASE WHEN v > 0 THEN 255 ELSE 0 END) FOR v IN [s[i // 512 * 8 + i % 64 // 8 + 1][i // 64 % 8 * 8 + i % 8 + 1] FOR i IN range(4096)]], ''))) AS digest FROM l)
        SELECT name, digest, true AS whole FROM (FROM b UNION ALL FROM w UNION ALL FROM g)""",
    "fm_banks": f"""WITH {_PATCHES} SELECT path, 2 AS version, drum, CAST(i // 128 AS INTEGER) AS bank, CAST(i % 128 AS INTEGER) AS slot, trim(name) AS name, note_offset, algorithm, feedback, lfo, fields, printf('%02X%02X', algorithm, feedback) || operators AS single FROM k""",
    "fm_patch_lookup": f"""WITH {_PATCHES}, f AS (SELECT path, lower(trim(name)) AS low, arg_min(struct_pack(drum := drum, bank := i // 128, slot := i % 128, algorithm := algorithm), struct_pack(drum := drum, i := i)) AS s FROM k GROUP BY ALL),
        q AS (SELECT DISTINCT path, upper(p_name) AS wanted FROM k)
        SELECT q.path, wanted, s.drum AS drum, CAST(s.bank AS INTEGER) AS bank, CAST(s.slot AS INTEGER) AS slot, s.algorithm AS algorithm FROM q LEFT JOIN f ON f.path = q.path AND f.low = lower(wanted)""",
}
