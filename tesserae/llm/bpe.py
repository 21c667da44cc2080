"""Byte-level BPE encoding and decoding with tiktoken and a local rank file."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unicode white space, as ``\s`` of the split pattern means it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The vocabulary of a rank file (base64 token and rank a line), without special tokens; one for each worker."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, most: int) -> Iterator[str]:
    """``text`` in parts of about ``most`` characters, cut only before white space that follows something else.

    No match of the split pattern crosses such a place: only white space and a space before a word begin with white space, and the
    pattern looks ahead for nothing but the end of white space. A run without such a place stays whole.
    """
    if len(text) <= most:
        yield text
        return
    place, at = re.compile(f"(?<=[^{WHITE}])[{WHITE}]"), 0
    while at < len(text):
        cut = place.search(text, at + most)
        to = cut.start() if cut else len(text)
        yield text[at:to]
        at = to


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, so that a worker holds the Python objects of a few documents at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", part_chars: int = 1 << 16) -> DataFrame:
    """One row per input row: doc_id (type kept) and ids, the whole text's token ids; a null or empty text has none.

    Rows repeated under one id are encoded each; other columns are ignored. ``rank_file`` is opened by the executors.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in in_slices(batches):
            found = [np.concatenate([enc.encode_to_numpy(p, disallowed_special=()) for p in safe_parts(t, part_chars)]) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            flat = np.concatenate(found or [np.zeros(0, np.uint32)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(flat))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(each, f"doc_id {id_type}, ids array<int>")


def decode(tokens: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: doc_id, ids and data, the tokens' raw bytes, which need not be whole UTF-8. Null ids decode to nothing; an id out of the vocabulary is an error."""
    id_type = tokens.schema[id_col].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in in_slices(batches):
            ids = batch.column(1)
            data = pa.array([enc.decode_bytes(x.values.to_numpy().tolist()) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, data], ["doc_id", "ids", "data"])

    return tokens.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids")).mapInArrow(each, f"doc_id {id_type}, ids array<int>, data binary")
