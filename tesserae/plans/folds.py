"""Queries of overlap, sequence, packing, codec, dither and audio operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import audio, codecs, dither, overlap, sequential, sheets, table_functions
from ..operators.ordering import islands
from . import fixtures as fx

GREYS = ((0, 0, 0), (85, 85, 85), (170, 170, 170), (255, 255, 255))


def _seconds(ts: str):  # noqa: ANN202
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)


def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.pairs(fx.boxes(spark, sf_dir), ["image"], ["ord", "model"]).select("image", F.col("a.ord").alias("a"), F.col("a.model").alias("a_model"), F.col("b.ord").alias("b"), F.col("b.model").alias("b_model"), "inner", "outer")


def uncontained_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.uncontained(fx.boxes(spark, sf_dir), ["image"], ["ord", "model"]).select("image", "ord", "model")


def consensus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.consensus(fx.boxes(spark, sf_dir), "image", ["ord", "model"])


def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential.debounced(fx.changes(spark, sf_dir), "path", ["ts", "event_id"], quiet="4 hours").select("event_id", "path", "change", "first", "n")


def change_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.changes(spark, sf_dir).withColumn("hash", F.when(F.col("change") == "error", F.lit(None)).otherwise(F.substring("hash", 1, 1)))
    return sequential.real_changes(c, "path", ["ts", "event_id"]).select("event_id", "path", "kind")


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.changes(spark, sf_dir).select("event_id", F.floor(F.col("path") / 16).alias("watcher"), _seconds("ts").alias("at"))
    return sequential.rate_limited(c, ["watcher"], ["at", "event_id"], 5, 3600.0 * 4)


def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.changes(spark, sf_dir).select("event_id", F.floor(F.col("path") / 16).alias("watcher"), _seconds("ts").alias("at"), (F.col("change") != "error").alias("ok"))
    return sequential.circuit_broken(c, ["watcher"], ["at", "event_id"], 2, 3600.0 * 12)


def islands_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal event types of a user: their length and span."""
    from pyspark.sql import Window

    e = fx.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    starts = F.col("event_type") != F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    flagged = e.withColumn("s", F.coalesce(starts, F.lit(True)))
    return islands(flagged, ["user_id"], "event_id", F.col("s")).groupBy("user_id", "island", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


def codec_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = codecs.run_share(F.col("html"))
    return fx.table(spark, sf_dir, "pages").select("page_id", share["inside"].cast("long").alias("inside"), codecs.choice(F.col("html")).alias("codec"))


def _roundtrip(spark: SparkSession, sf_dir: str, codec: str) -> DataFrame:
    data = fx.table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("data"))
    p = data.withColumn("packed", codecs.pack(F.col("data"), codec))
    return p.select("page_id", F.length("data").alias("size"), F.length("packed").alias("packed"), (codecs.unpack(F.col("packed"), codec) == F.col("data")).alias("whole"))


def rle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roundtrip(spark, sf_dir, "rle")


def lzss_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roundtrip(spark, sf_dir, "lz_word")


def kosinski_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roundtrip(spark, sf_dir, "lz_low")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.sprites(spark, sf_dir).select(F.floor(F.col("l_orderkey") / 40).alias("sheet"), (F.col("l_partkey") * 100_000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("ord"), "w", "h").groupBy("sheet", "ord").agg(F.min("w").alias("w"), F.min("h").alias("h"))


def row_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a table function over each sheet's frames in order."""
    return table_functions.row_packed(_frames(spark, sf_dir), "sheet", "ord")


def shelf_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.packed(_frames(spark, sf_dir), "sheet", "ord", "shelf")


def maxrects_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.packed(_frames(spark, sf_dir), "sheet", "ord", "rects", height=256)


def bank_ffd(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 50).alias("game"), F.col("p_partkey").alias("ord"), (F.col("p_size") * 401 % 20_000 + 100).cast("long").alias("bytes"))
    return table_functions.banked(s, "game", "ord")


def _greys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "embeddings").filter(F.size("embedding") == 64).select("vec_id", F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v.cast("double") * 64 + 128).cast("int")))).alias("px"))


def floyd_steinberg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dither.dithered(_greys(spark, sf_dir), GREYS, "floyd_steinberg", 8).select("vec_id", "idx")


def atkinson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dither.dithered(_greys(spark, sf_dir), GREYS, "atkinson", 8).select("vec_id", "idx")


def flood_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dither.background(_greys(spark, sf_dir), 8, 60).select("vec_id", F.size(F.filter("outside", lambda o: o)).alias("outside"))


def median_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dither.median_cut(fx.colours(spark, sf_dir), "image", 16)


def wav_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _greys(spark, sf_dir).select("vec_id", F.transform("px", lambda p: (p - 128) * 200).alias("s"))
    texts = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return s.select("vec_id", texts(audio.resample(F.col("s"), 22_050, 16_000)).alias("resampled"), texts(audio.normalise(F.col("s"))).alias("normal"), texts(audio.unsigned8(F.col("s"))).alias("u8"), audio.peak(F.col("s")).alias("peak"))


def sample_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.col("p_partkey") * 37 % 40_000
    return fx.table(spark, sf_dir, "part").select("p_partkey", rate.alias("rate"), F.floor(audio.load(rate) * 100).cast("long").alias("load"))


def sine_lut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that move: a heading in 256 steps of a turn, its sine and cosine from the tables (times 256, ties to even), the step that a speed makes of them, and the heading that the arctangent table gives for that step."""
    heading = (F.col("p_partkey") * 7 % 256).cast("int")
    parts = fx.table(spark, sf_dir, "part").select("p_partkey", heading.alias("heading"), "p_size")
    told = parts.select("*", geometry.turn_table(F.sin, F.col("heading")).alias("sin"), geometry.turn_table(F.cos, F.col("heading")).alias("cos"))
    moved = told.select("p_partkey", "heading", "sin", "cos", F.shiftright(F.col("sin") * F.col("p_size"), 8).alias("dy"), F.shiftright(F.col("cos") * F.col("p_size"), 8).alias("dx"))
    return moved.withColumn("back", geometry.heading_of(F.col("dx"), F.col("dy")))


QUERIES = {
    f.__name__: f
    for f in (
        iou_pairs, uncontained_boxes, consensus_clusters, debounce_sessions, change_dedup, rate_limit, circuit_breaker, islands_runs, codec_choice, rle_roundtrip, lzss_roundtrip, kosinski_roundtrip, row_pack, shelf_pack,
        maxrects_pack, bank_ffd, floyd_steinberg, atkinson, flood_background, median_cut, wav_resample, sample_load, sine_lut,
    )
}

_S = "s AS (SELECT vec_id, list_transform(embedding, lambda v: (greatest(0, least(255, CAST(floor(v::DOUBLE * 64 + 128) AS INTEGER))) - 128) * 200) AS s FROM embeddings WHERE len(embedding) = 64)"
_R = repr(16_000 / 22_050)
_LOAD = " ".join(f"WHEN rate <= {r1} THEN {v0} + (rate - {r0}) / {float(r1 - r0)}::DOUBLE * {v1 - v0}" for (r0, v0), (r1, v1) in zip(sorted(audio.LOAD.items()), sorted(audio.LOAD.items())[1:], strict=False))

_WATCHED = f"""{fx.CHANGES}, w AS (SELECT event_id, path // 16 AS watcher, epoch_us(ts) / 1000000.0::DOUBLE AS secs, change <> 'error' AS ok FROM changes), f AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY watcher ORDER BY secs, event_id) AS i FROM w)"""

ORACLE_SQL = {
    "rate_limit": f"""WITH RECURSIVE {_WATCHED}, r AS (SELECT watcher, i, event_id, secs, [secs] AS times, true AS allowed FROM f WHERE i = 1
            UNION ALL SELECT watcher, i, event_id, secs, CASE WHEN len(kept) < 5 THEN list_append(kept, secs) ELSE kept END, len(kept) < 5 FROM (SELECT f.*, list_filter(r.times, lambda t: f.secs - t <= 14400) AS kept FROM r JOIN f ON f.watcher = r.watcher AND f.i = r.i + 1))
        SELECT event_id, watcher, secs AS "at", allowed FROM r""",
    "circuit_breaker": f"""WITH RECURSIVE {_WATCHED}, r AS (SELECT watcher, i, event_id, secs, ok, CASE WHEN ok THEN 0 ELSE 1 END AS run, NULL::DOUBLE AS opened, CASE WHEN ok THEN 'ok' ELSE 'error' END AS state FROM f WHERE i = 1
            UNION ALL SELECT watcher, i, event_id, secs, ok, CASE WHEN shut THEN run WHEN ok THEN 0 ELSE held + 1 END, CASE WHEN shut THEN opened WHEN NOT ok AND held + 1 >= 2 THEN secs END, CASE WHEN shut THEN 'open' WHEN ok THEN 'ok' ELSE 'error' END
            FROM (SELECT f.*, r.run, r.opened, coalesce(f.secs - r.opened < 43200, false) AS shut, CASE WHEN r.opened IS NULL THEN r.run ELSE 0 END AS held FROM r JOIN f ON f.watcher = r.watcher AND f.i = r.i + 1))
        SELECT event_id, watcher, secs AS "at", ok, state FROM r""",
    "row_pack": f"""WITH RECURSIVE {fx.SPRITES}, f AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY ord) AS i FROM (SELECT l_orderkey // 40 AS sheet, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS ord, min(w) AS w, min(h) AS h FROM sprites GROUP BY 1, 2)),
        r AS (SELECT sheet, ord, w, h, i, 1::BIGINT AS x, 1::BIGINT AS y, h::BIGINT AS tall FROM f WHERE i = 1
            UNION ALL SELECT f.sheet, f.ord, f.w, f.h, f.i, CASE WHEN r.x + r.w + f.w + 2 > 256 THEN 1 ELSE r.x + r.w + 1 END, CASE WHEN r.x + r.w + f.w + 2 > 256 THEN r.y + r.tall + 1 ELSE r.y END,
                CASE WHEN r.x + r.w + f.w + 2 > 256 THEN f.h ELSE greatest(r.tall, f.h) END FROM r JOIN f ON f.sheet = r.sheet AND f.i = r.i + 1)
        SELECT sheet, ord, w, h, x, y, CAST(0 AS BIGINT) AS page FROM r""",
    "bank_ffd": """WITH RECURSIVE s AS (SELECT p_partkey // 50 AS game, p_partkey AS ord, CAST(p_size * 401 % 20000 + 100 AS BIGINT) AS bytes FROM part), f AS (SELECT *, row_number() OVER (PARTITION BY game ORDER BY bytes DESC, ord) AS i FROM s),
        r AS (SELECT game, ord, bytes, i, [bytes] AS used, 1::BIGINT AS k FROM f WHERE i = 1
            UNION ALL SELECT game, ord, bytes, i, CASE WHEN spot = 0 THEN list_append(used, bytes) ELSE list_transform(used, lambda u, j: CASE WHEN j = spot THEN u + bytes ELSE u END) END, CASE WHEN spot = 0 THEN len(used) + 1 ELSE spot END
            FROM (SELECT f.game, f.ord, f.bytes, f.i, r.used, coalesce(list_position(list_transform(r.used, lambda u: u + f.bytes <= 32768), true), 0)::BIGINT AS spot FROM r JOIN f ON f.game = r.game AND f.i = r.i + 1))
        SELECT game, ord, bytes, k - 1 AS bank FROM r""",
    "iou_pairs": f"""WITH {fx.BOXES}, p AS (SELECT a.image, a.ord AS a, a.model AS a_model, b.ord AS b, b.model AS b_model, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS iw, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS ih, a.w * a.h + b.w * b.h AS areas
        FROM boxes a JOIN boxes b ON a.image = b.image AND (a.ord, a.model) < (b.ord, b.model)), i AS (SELECT *, iw * ih AS "inner", areas - iw * ih AS "outer" FROM p WHERE iw >= 0 AND ih >= 0)
        SELECT image, a, a_model, b, b_model, "inner", "outer" FROM i WHERE "outer" > 0 AND "inner"::DOUBLE > 0.6 * "outer" """,
    "uncontained_boxes": f"""WITH {fx.BOXES} SELECT image, ord, model FROM boxes i WHERE NOT EXISTS (SELECT 1 FROM boxes o WHERE o.image = i.image AND (o.ord, o.model) <> (i.ord, i.model) AND i.x >= o.x AND i.y >= o.y AND i.x + i.w <= o.x + o.w AND i.y + i.h <= o.y + o.h)""",
    "debounce_sessions": f"""WITH {fx.CHANGES}, g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 4 HOUR THEN 0 ELSE 1 END AS s FROM changes WINDOW w AS (PARTITION BY path ORDER BY ts, event_id)), b AS (SELECT *, sum(s) OVER (PARTITION BY path ORDER BY ts, event_id) AS burst FROM g)
        SELECT event_id, path, change, first, n FROM (SELECT *, min(ts) OVER v AS first, count(*) OVER v AS n, row_number() OVER (PARTITION BY path, burst ORDER BY ts DESC, event_id DESC) AS k FROM b WINDOW v AS (PARTITION BY path, burst)) WHERE k = 1""",
    "change_dedup": f"""WITH {fx.CHANGES}, c AS (SELECT event_id, path, ts, CASE WHEN change <> 'error' THEN hash[1:1] END AS hash FROM changes), b AS (SELECT *, lag(hash) OVER (PARTITION BY path ORDER BY ts, event_id) AS old FROM c)
        SELECT event_id, path, CASE WHEN hash IS NULL THEN 'deleted' WHEN old IS NULL THEN 'created' ELSE 'modified' END AS kind FROM b WHERE hash IS NULL OR old IS NULL OR hash <> old""",
    "islands_runs": """WITH s AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS s FROM events), i AS (SELECT *, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS island FROM s)
        SELECT user_id, island, event_type, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM i GROUP BY 1, 2, 3""",
    "codec_choice": """WITH c AS (SELECT page_id, unnest(string_split(html, '')) AS c, generate_subscripts(string_split(html, ''), 1) AS i FROM pages), g AS (SELECT *, i - row_number() OVER (PARTITION BY page_id, c ORDER BY i) AS g FROM c),
        r AS (SELECT page_id, count(*) AS n FROM g GROUP BY page_id, c, g), t AS (SELECT page_id, CAST(coalesce(sum(n) FILTER (n >= 4), 0) AS BIGINT) AS inside, CAST(sum(n) AS BIGINT) AS total FROM r GROUP BY 1)
        SELECT p.page_id, coalesce(inside, 0) AS inside, CASE WHEN coalesce(total, 0) = 0 THEN 'none' WHEN inside * 4 > total THEN 'rle' ELSE 'lz_low' END AS codec FROM pages p LEFT JOIN t USING (page_id)""",
    "wav_resample": f"""WITH {_S}, p AS (SELECT vec_id, s, CAST(list_max(list_transform(s, lambda v: abs(v))) AS BIGINT) AS peak FROM s)
        SELECT vec_id, array_to_string(list_transform(range(CAST(floor(64 * {_R}::DOUBLE) AS BIGINT)), lambda i: CAST(trunc(s[CAST(floor(i / {_R}::DOUBLE) AS INTEGER) + 1] + (coalesce(s[CAST(floor(i / {_R}::DOUBLE) AS INTEGER) + 2], s[CAST(floor(i / {_R}::DOUBLE) AS INTEGER) + 1])
        - s[CAST(floor(i / {_R}::DOUBLE) AS INTEGER) + 1]) * (i / {_R}::DOUBLE - floor(i / {_R}::DOUBLE))) AS INTEGER)), ',') AS resampled,
        array_to_string(list_transform(s, lambda v: greatest(-32768, least(32767, CAST(trunc(v * (31128::DOUBLE / peak)) AS INTEGER)))), ',') AS normal, array_to_string(list_transform(s, lambda v: ((v + 32768) >> 8) & 255), ',') AS u8, peak FROM p""",
    "sample_load": f"WITH r AS (SELECT p_partkey, p_partkey * 37 % 40000 AS rate FROM part) SELECT p_partkey, rate, CAST(floor((CASE WHEN rate < 8000 THEN 10.0::DOUBLE {_LOAD} ELSE 40.0::DOUBLE END) * 100) AS BIGINT) AS load FROM r",
    "sine_lut": """WITH h AS (SELECT p_partkey, CAST(p_partkey * 7 % 256 AS INTEGER) AS heading, p_size FROM part), t AS (SELECT *, CAST(round_even(sin(heading * (6.283185307179586::DOUBLE / 256)) * 256, 0) AS BIGINT) AS sin, CAST(round_even(cos(heading * (6.283185307179586::DOUBLE / 256)) * 256, 0) AS BIGINT) AS cos FROM h),
        m AS (SELECT p_partkey, heading, sin, cos, (sin * p_size) >> 8 AS dy, (cos * p_size) >> 8 AS dx FROM t), o AS (SELECT *, CAST(round_even(atan(least(255, coalesce(floor(least(abs(dx), abs(dy)) * 256 / nullif(greatest(abs(dx), abs(dy)), 0)), 0)) / 255.0::DOUBLE) / 6.283185307179586::DOUBLE * 256, 0) AS BIGINT) AS o FROM m),
        q AS (SELECT *, CASE WHEN abs(dy) <= abs(dx) THEN o ELSE 64 - o END AS q FROM o)
        SELECT p_partkey, heading, sin, cos, dy, dx, CASE WHEN dx >= 0 AND dy >= 0 THEN q WHEN dy >= 0 THEN 128 - q WHEN dx < 0 THEN 128 + q ELSE (256 - q) % 256 END AS back FROM q""",
}
