"""Binary assets as a Spark source and sink (``spark.read.format("assets")``): raw files, PNG images, tile banks, name tables and FM banks.

Files are reached through Arrow's file systems, so a path may be local or in a store that Arrow knows by its URI.
"""

from __future__ import annotations

import fnmatch
import posixpath
import uuid
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import fmbank
from .files import decode_png, encode_png

#: Bytes of files that one partition reads at most, unless one file is larger; opening a file counts as so many, so that many small files are not one partition.
PARTITION, OPENING = 32 << 20, 64 << 10
#: Values (pixels, fields) that a batch of decoded rows holds at most, unless one row has more.
VALUES = 1 << 20


@dataclass(frozen=True)
class Kind:
    """``rows``: columns that a file decodes to besides path and error; ``takes``: columns that a file is made of besides its name."""

    rows: str
    decode: Callable[[bytes], Iterator[tuple]]
    takes: str
    encode: Callable[..., bytes]


def _image(data: bytes) -> Iterator[tuple]:
    width, height, rgba = decode_png(data)
    yield width, height, rgba.ravel().astype(np.int32)


def _image_bytes(data: bytes) -> Iterator[tuple]:
    width, height, rgba = decode_png(data)
    yield width, height, rgba.astype(np.uint8).tobytes()


def _tiles(data: bytes) -> Iterator[tuple]:
    """Two pixels a byte, the first one high, 32 bytes a tile."""
    if len(data) % 32:
        raise ValueError("not a whole number of tiles")
    low = np.frombuffer(data, np.uint8)
    for k, px in enumerate(np.stack([low >> 4, low & 15], axis=1).reshape(-1, 64).tolist()):
        yield k, px


def _words(data: bytes) -> Iterator[tuple]:
    """Big-endian words PPVH and a tile number."""
    if len(data) % 2:
        raise ValueError("not a whole number of words")
    for k, w in enumerate(np.frombuffer(data, ">u2").tolist()):
        yield k, w & 0x7FF, bool(w >> 11 & 1), bool(w >> 12 & 1), w >> 13 & 3, bool(w >> 15)


def _packed(tiles: Sequence[Sequence[int]]) -> bytes:
    px = np.array([np.asarray(t).tolist() for t in tiles], np.uint8).reshape(-1, 2) & 15
    return (px[:, 0] << 4 | px[:, 1]).astype(np.uint8).tobytes()


KINDS = {
    "raw": Kind("content binary", lambda data: iter([(data,)]), "content binary", lambda content: bytes(content)),
    "png": Kind("width int, height int, rgba array<int>", _image, "width int, height int, rgba array<int>", lambda w, h, rgba: encode_png(np.array(rgba, np.int64).reshape(h, w, 4))),
    "png_bytes": Kind("width int, height int, rgba binary", _image_bytes, "width int, height int, rgba binary", lambda w, h, rgba: encode_png(np.frombuffer(rgba, np.uint8).reshape(h, w, 4))),
    "tiles": Kind("tile int, px array<int>", _tiles, "tiles array<array<int>>", _packed),
    "words": Kind("cell int, tile int, h boolean, v boolean, palette int, priority boolean", _words, "words array<int>", lambda words: np.array(np.asarray(words).tolist(), ">u2").tobytes()),
    "fmbank": Kind(fmbank.ROWS, fmbank.decode, fmbank.BANKS, fmbank.encode),
}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class AssetReader(DataSourceReader):
    """A row for each thing a file decodes to, with path; a file that can't be decoded is one row whose error says why."""

    def __init__(self, options: dict, schema: StructType) -> None:
        self.schema = schema
        self.path, self.kind, self.pattern = options["path"], options.get("kind", "raw"), options.get("pattern", "*")
        self.partition = int(options.get("partitionbytes", PARTITION))

    def partitions(self) -> list[Files]:
        """Files in the order of their names, packed into partitions by size; names that start with _ or . are none."""
        system, root = opened(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=False))
        inside = lambda f: f.path.removeprefix(root).strip("/")
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern) and not any(p[0] in "_." for p in inside(f).split("/")))
        out: list[Files] = []
        room = 0
        for path, size in files:
            if not out or size + OPENING > room:
                out.append(Files([]))
                room = self.partition
            out[-1].paths.append(path)
            room -= size + OPENING
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        """Batches of a bounded number of values, however many rows the partition has."""
        schema = to_arrow_schema(self.schema)
        rows: list[tuple] = []
        held = 0
        for row in self.rows(partition):
            rows.append(row)
            held += _values(row)
            if held >= VALUES:
                yield _batch(rows, schema)
                rows, held = [], 0
        yield _batch(rows, schema)

    def rows(self, partition: Files) -> Iterator[tuple]:
        system, root = opened(self.path)
        kind = KINDS[self.kind]
        width = len(_fields(kind.rows))
        for path in partition.paths:
            with system.open_input_stream(path) as stream:
                data = stream.read()
            name = path.removeprefix(root).strip("/")
            try:
                for row in kind.decode(data):
                    yield (name, *row, None)
            except ValueError as e:
                yield (name, *[None] * width, str(e))


def _plain(value: object) -> object:
    """Structs as tuples of their values, in lists too."""
    if isinstance(value, dict):
        return tuple(map(_plain, value.values()))
    return [_plain(v) for v in value] if isinstance(value, list) and value and isinstance(value[0], (dict, list)) else value


def _python(value: pa.Scalar) -> object:
    """What a kind's ``encode`` takes; a list of whole numbers is an array, since a Python object for each takes long to make."""
    if pa.types.is_list(value.type) and value.is_valid and not value.values.null_count:
        if pa.types.is_integer(value.type.value_type):
            return value.values.to_numpy()
        if pa.types.is_list(value.type.value_type):
            return [_python(v) for v in value.values]
    return _plain(value.as_py())


def _values(value: object) -> int:
    """Values in a row; eight bytes of text or content count as one."""
    if isinstance(value, (bytes, str)):
        return 1 + len(value) // 8
    if isinstance(value, np.ndarray):
        return value.size
    if isinstance(value, list) and value and isinstance(value[0], int):
        return len(value)
    return 1 + sum(map(_values, value)) if isinstance(value, (list, tuple)) else 1


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class AssetWriter(DataSourceArrowWriter):
    """A file a row. Tasks write into folders of their own; the commit moves the files of those tasks that Spark counts, so a task that is
    lost and run again leaves nothing twice, and an abort leaves nothing at all."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        self.path, self.kind, self.overwrite = options["path"].rstrip("/"), options.get("kind", "raw"), overwrite
        self.job = f"_temporary-{uuid.uuid4().hex}"
        self.columns = ["name", *(f.split(" ")[0] for f in _fields(KINDS[self.kind].takes))]
        missing = [c for c in self.columns if c not in schema.names]
        if missing:
            raise ValueError(f"a {self.kind} file is made of {', '.join(self.columns)}; missing: {', '.join(missing)}")

    def write(self, iterator: Iterator[pa.RecordBatch | Row]) -> Written:
        system, root = opened(self.path)
        folder = posixpath.join(root, self.job, uuid.uuid4().hex)
        names: list[str] = []
        made: set[str] = set()
        for name, *values in self._told(iterator):
            if not name or name.startswith(("/", "_", ".")) or ".." in name.split("/"):
                raise ValueError(f"{name!r} is no name for a file")
            at = posixpath.join(folder, name)
            _made(system, posixpath.dirname(at), made)
            with system.open_output_stream(at) as out:
                out.write(KINDS[self.kind].encode(*values))
            names.append(name)
        return Written(folder, names)

    def _told(self, iterator: Iterator[pa.RecordBatch | Row]) -> Iterator[list]:
        """Rows of batches become Python objects one by one: those of a whole batch would be many times its size."""
        for some in iterator:
            if isinstance(some, Row):
                yield [some[c] for c in self.columns]
                continue
            columns = [some.column(some.schema.get_field_index(c)) for c in self.columns]
            for k in range(some.num_rows):
                yield [_python(c[k]) for c in columns]

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        twice = next((n for n, k in Counter(names).items() if k > 1), None)
        try:
            if twice:
                raise ValueError(f"two rows make one file: {twice}")
            if not self.overwrite:
                there = [n for n, f in zip(names, system.get_file_info([posixpath.join(root, n) for n in names]), strict=True) if f.type != fs.FileType.NotFound]
                if there:
                    raise ValueError(f"file exists: {there[0]}")
            if self.overwrite:
                self._clear(system, root)
            made: set[str] = set()
            for m in done:
                for n in m.names:
                    to = posixpath.join(root, n)
                    _made(system, posixpath.dirname(to), made)
                    system.move(posixpath.join(m.folder, n), to)
        finally:
            self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        job = posixpath.join(root, self.job)
        if system.get_file_info(job).type != fs.FileType.NotFound:
            system.delete_dir(job)

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if not f.base_name.startswith("_temporary-"):
                (system.delete_dir if f.type == fs.FileType.Directory else system.delete_file)(f.path)


def _made(system: fs.FileSystem, folder: str, made: set[str]) -> None:
    """Makes a folder, once."""
    if folder not in made:
        system.create_dir(folder, recursive=True)
        made.add(folder)


def _fields(ddl: str) -> list[str]:
    """The columns of a DDL text."""
    depth, out = 0, [""]
    for c in ddl:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [f.strip() for f in out]


class Assets(DataSource):
    """Options: path, kind (``raw``, ``png``, ``png_bytes``: the same with a byte a value, ``tiles``, ``words``, ``fmbank``), pattern (of file names), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "assets"

    def schema(self) -> str:
        return f"path string, {KINDS[self.options.get('kind', 'raw')].rows}, error string"

    def reader(self, schema: StructType) -> AssetReader:
        return AssetReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> AssetWriter:
        return AssetWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Assets)
