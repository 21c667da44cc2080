"""Files as rows: paths by kind, images (PNG), sounds (WAV), chip-music headers. Bytes come through Spark's ``binaryFile`` reader."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The signature of a PNG file, and samples of a pixel by colour type.
PNG = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def kind_of(path: Column, is_folder: Column) -> Column:
    """What a path names: a prompt (over 10 characters with a space and no known suffix), folder, sprite, image or unknown."""
    low = F.lower(path)
    return F.when(is_folder, "folder").when(low.rlike(r"\.(ase|aseprite)$"), "sprite").when(low.rlike(r"\.(png|jpe?g|gif)$"), "image").when((F.length(path) > 10) & path.contains(" "), "prompt").otherwise("unknown")


def files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """path, modificationTime, length and content of the files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)


def decode_png(data: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and RGBA values (height, width, 4). Depths 1 to 16, no interlace; anything else raises ValueError."""
    if data[:8] != PNG:
        raise ValueError("not a PNG file")
    at, body, palette, alpha, header = 8, b"", None, b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = chunk
        elif kind == b"IDAT":
            body += chunk
        elif kind == b"IEND":
            break
    if header is None:
        raise ValueError("no header")
    width, height, depth, colour, _, _, interlace = header
    if interlace or colour not in SAMPLES:
        raise ValueError("unsupported layout")
    try:
        raw = np.frombuffer(zlib.decompress(body), np.uint8)
    except zlib.error as e:
        raise ValueError(str(e)) from None
    samples = SAMPLES[colour]
    stride, step = (width * samples * depth + 7) // 8, max(1, samples * depth // 8)
    if len(raw) < height * (stride + 1):
        raise ValueError("cut short")
    lines = raw[: height * (stride + 1)].reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.int32)
    for y in range(height):
        how, line = lines[y, 0], lines[y, 1:].astype(np.int32)
        if how == 2:
            line = line + above
        elif how in (1, 3, 4):
            for x in range(stride):
                left = line[x - step] if x >= step else 0
                if how == 1:
                    line[x] += left
                elif how == 3:
                    line[x] += (left + above[x]) // 2
                else:
                    corner = above[x - step] if x >= step else 0
                    guess = left + above[x] - corner
                    line[x] += min((left, above[x], corner), key=lambda v: abs(guess - v))
                line[x] &= 255
        above = line & 255
        out[y] = above
    if depth < 8:
        bits = np.unpackbits(out, axis=1).reshape(height, -1, depth)
        values = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2)[:, : width * samples]
        if colour == 0:
            values = values * 255 // ((1 << depth) - 1)
    else:
        values = out.reshape(height, -1, depth // 8)[:, :, 0].astype(np.int64)
    values = values.reshape(height, width, samples)
    rgba = np.full((height, width, 4), 255, np.int64)
    if colour == 3:
        if palette is None:
            raise ValueError("no palette")
        rgba[..., :3] = palette[values[..., 0]]
        clear = np.full(len(palette), 255)
        clear[: len(alpha)] = np.frombuffer(alpha, np.uint8)[: len(palette)]
        rgba[..., 3] = clear[values[..., 0]]
    else:
        rgba[..., :3] = values[..., :3] if samples > 2 else values[..., :1]
        if samples in (2, 4):
            rgba[..., 3] = values[..., -1]
    return width, height, rgba


def encode_png(rgba: np.ndarray) -> bytes:
    """An image of (height, width, 4) values as a PNG file."""
    height, width, _ = rgba.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), rgba.astype(np.uint8).reshape(height, -1)], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def images(rows: DataFrame, content: str = "content", most: int = 8192) -> DataFrame:
    """``rows`` with width, height, rgba (values in turn, row by row) and error: null, or why a file isn't an image that can be read."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != content) + ", width int, height int, rgba array<int>, error string"

    def read(data: bytes | None) -> tuple:
        try:
            width, height, rgba = decode_png(bytes(data or b""))
        except ValueError as e:
            return None, None, None, str(e)
        if max(width, height) > most:
            return width, height, None, f"larger than {most}"
        return width, height, rgba.ravel().astype(np.int32), None

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [read(d) for d in batch[content]]
            out = batch.drop(columns=content)
            for k, name in enumerate(("width", "height")):
                out[name] = pd.array([f[k] for f in found], "Int32")
            yield out.assign(rgba=[f[2] for f in found], error=[f[3] for f in found])

    return rows.mapInPandas(each, schema)


def pixels(images_: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """A row per pixel: keys, x, y, r, g, b, a."""
    p = images_.filter("error is null").select(*keys, "width", F.posexplode(F.transform(F.sequence(F.lit(0), (F.size("rgba") / 4).cast("int") - 1), lambda i: F.slice("rgba", i * 4 + 1, 4))).alias("i", "v"))
    return p.select(*keys, (F.col("i") % F.col("width")).alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), *[F.col("v")[k].alias(c) for k, c in enumerate("rgba")])


def decode_wav(data: bytes) -> tuple[int, int, int, np.ndarray]:
    """Rate, channels, bits and samples in turn as 16-bit values. Plain PCM of 8, 16, 24 or 32 bits; else ValueError."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, layout, body = 12, None, b""
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if kind == b"fmt ":
            layout = struct.unpack("<HHIIHH", data[at + 8 : at + 24])
        elif kind == b"data":
            body = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if layout is None or layout[0] not in (1, 0xFFFE) or layout[5] not in (8, 16, 24, 32):
        raise ValueError("unsupported format")
    width = layout[5] // 8
    raw = np.frombuffer(body[: len(body) // width * width], np.uint8).reshape(-1, width)
    if width == 1:
        samples = (raw[:, 0].astype(np.int32) - 128) * 256
    else:
        samples = np.ascontiguousarray(raw[:, -2:]).view("<i2").ravel().astype(np.int32)
    return layout[2], layout[1], layout[5], samples


def sounds(rows: DataFrame, content: str = "content") -> DataFrame:
    """``rows`` with rate, channels, bits, samples (channels in turn) and error."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != content) + ", rate int, channels int, bits int, samples array<int>, error string"

    def read(data: bytes | None) -> tuple:
        try:
            return (*decode_wav(bytes(data or b"")), None)
        except ValueError as e:
            return None, None, None, None, str(e)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [read(d) for d in batch[content]]
            out = batch.drop(columns=content)
            for k, name in enumerate(("rate", "channels", "bits")):
                out[name] = pd.array([f[k] for f in found], "Int32")
            yield out.assign(samples=[f[3] for f in found], error=[f[4] for f in found])

    return rows.mapInPandas(each, schema)


def le32(data: Column, at: int) -> Column:
    """A little-endian unsigned word of a binary column, 0 past its end."""
    text = F.hex(F.substring(data, at + 1, 4))
    flipped = F.concat(*[F.substring(text, p, 2) for p in (7, 5, 3, 1)])
    return F.when(F.length(text) == 8, F.conv(flipped, 16, 10).cast("long")).otherwise(F.lit(0).cast("long"))


def chip_music_header(data: Column) -> Column:
    """The header of a chip-music file as a struct; null if the signature is another. Fields of later versions are 0 in earlier ones."""
    version = le32(data, 8)
    start = F.when((version >= 0x150) & (le32(data, 0x34) > 0), le32(data, 0x34) + 0x34).otherwise(0x40)
    late = lambda at: F.when((version >= 0x151) & (start >= at + 4), le32(data, at)).otherwise(0)
    rate = F.when(version >= 0x101, le32(data, 0x24)).otherwise(0)
    nibble = lambda shift: F.shiftright(version, shift).bitwiseAND(15)
    fields = {
        "version": version, "version_text": F.concat(F.shiftright(version, 8).bitwiseAND(15).cast("string"), F.lit("."), nibble(4).cast("string"), nibble(0).cast("string")), "psg_clock": le32(data, 0x0C),
        "fm_clock": le32(data, 0x2C), "opm_clock": le32(data, 0x30), "samples": le32(data, 0x18), "seconds": le32(data, 0x18) / F.lit(44100.0), "loop_offset": le32(data, 0x1C), "loop_samples": le32(data, 0x20),
        "rate": F.when(rate == 0, 60).otherwise(rate), "data_offset": start, "opn_clock": late(0x44), "opna_clock": late(0x48), "opnb_clock": late(0x4C),
    }
    return F.when(F.hex(F.substring(data, 1, 4)) == "56676D20".upper(), F.struct(*[c.alias(k) for k, c in fields.items()]))
