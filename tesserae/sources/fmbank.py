"""FM instrument banks: 128 patches of four operators a bank, melodic and drum banks in one file."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Signatures of both versions, patches of a bank, and the sizes of a name, an operator and a patch.
MAGIC, MAGIC_1 = b"WOPN2-BANK\x00", b"WOPN2-B\x00"
PATCHES, NAME, OPERATOR, PATCH = 128, 32, 7, 64

OPERATOR_FIELDS = ("detune", "multiple", "total_level", "rate_scaling", "attack_rate", "am_enable", "decay_1_rate", "decay_2_rate", "sustain_level", "release_rate", "ssg_eg")
# Byte, shift and bits of each operator field, in the order of OPERATOR_FIELDS.
PLACES = ((0, 4, 3), (0, 0, 4), (1, 0, 7), (2, 6, 2), (2, 0, 5), (3, 7, 1), (3, 0, 5), (4, 0, 5), (5, 4, 4), (5, 0, 4), (6, 0, 4))
OPERATORS = "array<struct<" + ", ".join(f"{f}: int" for f in OPERATOR_FIELDS) + ">>"
PATCH_TYPE = f"struct<name: string, note_offset: int, algorithm: int, feedback: int, lfo: int, operators: {OPERATORS}>"
#: What the source gives a row for, and what the sink takes a row of.
ROWS = f"version int, drum boolean, bank int, slot int, name string, note_offset int, algorithm int, feedback int, lfo int, operators {OPERATORS}"
BANKS = f"version int, melodic array<{PATCH_TYPE}>, drums array<{PATCH_TYPE}>"


def decode(data: bytes) -> Iterator[tuple]:
    """Rows of ``ROWS`` for the patches that have a name. ValueError for another signature or a file that is cut short."""
    if data[: len(MAGIC)] == MAGIC:
        at = len(MAGIC)
        version, at = struct.unpack_from("<H", data, at)[0] if len(data) >= at + 2 else 0, at + 2
    elif data[: len(MAGIC_1)] == MAGIC_1:
        version, at = 1, len(MAGIC_1)
    else:
        raise ValueError("not an FM bank")
    if len(data) < at + 4:
        raise ValueError("cut short")
    counts = struct.unpack_from("<HH", data, at)
    at += 4 + (2 if version >= 2 else 0)  # flags and the oscillator's frequency
    if len(data) < at + sum(counts) * PATCHES * PATCH:
        raise ValueError("cut short")
    for drum, banks in zip((False, True), counts, strict=True):
        for k in range(banks * PATCHES):
            own = data[at : at + PATCH]
            at += PATCH
            name = own[:NAME].split(b"\x00")[0].decode("ascii", "replace").strip()
            if not name:
                continue
            (offset,) = struct.unpack_from("<h", own, NAME)
            parts = [own[NAME + 4 + o * OPERATOR : NAME + 4 + (o + 1) * OPERATOR] for o in range(4)]
            operators = [tuple(p[b] >> shift & ((1 << bits) - 1) for b, shift, bits in PLACES) for p in parts]
            yield version, drum, k // PATCHES, k % PATCHES, name, offset, own[NAME + 2] & 7, own[NAME + 2] >> 3 & 7, own[NAME + 3], operators


def encode(version: int, melodic: Sequence, drums: Sequence) -> bytes:
    """A file of both lists of patches (fields of ``PATCH_TYPE``), each filled up with nameless ones to whole banks; there is at least one melodic bank."""
    counts = max(1, -(-len(melodic) // PATCHES)), -(-len(drums) // PATCHES)
    out = bytearray(MAGIC + struct.pack("<H", version) if version >= 2 else MAGIC_1)
    out += struct.pack("<HH", *counts) + (b"\x00\x00" if version >= 2 else b"")
    for patches, banks in zip((melodic, drums), counts, strict=True):
        for p in patches:
            name, offset, algorithm, feedback, lfo, operators = p
            out += name.encode("ascii", "replace")[: NAME - 1].ljust(NAME, b"\x00") + struct.pack("<hBB", offset, algorithm & 7 | (feedback & 7) << 3, lfo & 255)
            for operator in operators:
                own = bytearray(OPERATOR)
                for value, (b, shift, bits) in zip(operator, PLACES, strict=True):
                    own[b] |= (int(value) & ((1 << bits) - 1)) << shift
                out += own
        out += bytes((banks * PATCHES - len(patches)) * PATCH)
    return bytes(out)


def found(patches: DataFrame, wanted: DataFrame, file_col: str = "path", name_col: str = "name") -> DataFrame:
    """``wanted`` (file_col, wanted) with the first patch of that file whose name it is, whatever the case; melodic ones come first. Names that no patch has keep nulls."""
    order = F.struct("drum", "bank", "slot")
    first = patches.groupBy(file_col, F.lower(name_col).alias("__name")).agg(F.min_by(F.struct(*[c for c in patches.columns if c != file_col]), order).alias("patch"))
    return wanted.withColumn("__name", F.lower("wanted")).join(first, [file_col, "__name"], "left").drop("__name")


def single_instrument(algorithm: Column, feedback: Column, operators: Column) -> Column:
    """One patch as a file of its own (upper-case hex): algorithm, feedback, and eleven bytes an operator of which seven are used."""
    two = lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")

    def one(o: Column) -> Column:
        bytes_ = [F.lit(0)] * OPERATOR
        for name, (b, shift, _) in zip(OPERATOR_FIELDS, PLACES, strict=True):
            bytes_[b] = bytes_[b] + F.shiftleft(o[name], shift)
        return F.concat(*map(two, bytes_), F.lit("00000000"))

    return F.concat(two(algorithm), two(feedback), F.array_join(F.transform(operators, one), ""))
