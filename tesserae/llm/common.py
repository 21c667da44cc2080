"""What the operators of this subpackage share: inputs, folders for intermediate tables, digests of documents."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters of ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share (``spark.checkpoint.dir``); a local one only where none is set and Spark runs in one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='tesserae-')}"
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def field(name: str) -> Column:
    """A column of the rows that :func:`carried` gives."""
    return F.col("doc")[name]


def whole(docs: DataFrame) -> Column:
    """All columns of a row as one struct ``doc``, so that no name of theirs meets one of an operator."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("doc")


def carried(docs: DataFrame, name: str) -> DataFrame:
    """row (a number of its own) and doc, stored, so that a row keeps its number."""
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), whole(docs)), name)


#: Drop a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Tables that the stages of a pipeline have stored (:func:`staged`); None outside of a stage.
_SPENT: list[str] = []
_NOW: list[str] | None = None


def removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A pipeline's stage that deletes, when it begins, what the stage before has stored on its way.

    Stages run one after the other and each result is written before the next one begins, so nothing reads those tables any more; tables
    that ``docs`` still reads stay. What is stored outside of stages, by other queries of the session, is not touched.
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _NOW
        read = docs.inputFiles() if _SPENT else []
        for folder in [f for f in _SPENT if not any(f.split("/")[-1] in r for r in read)]:
            _SPENT.remove(folder)
            removed(spark, folder)
        _NOW = []
        try:
            return stage(spark, docs, sf_dir)
        finally:
            _SPENT.extend(_NOW)
            _NOW = None

    return run


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, readable after the loss of any executor, its lineage cut.

    The shuffle files that it took are dropped once the table is there.
    """
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(CLEANUP, "false")
    if _NOW is not None:
        _NOW.append(path)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@lru_cache(maxsize=1)
def lean() -> None:
    """Make this worker's C library give arrays of a megabyte or more back to the system when they are freed, and Arrow use that library; workers live on between tasks."""
    pa.set_memory_pool(pa.system_memory_pool())  # Arrow's own pool keeps what is freed
    try:
        libc = ctypes.CDLL("libc.so.6")
    except OSError:
        return  # another C library: only the peak between tasks is higher
    libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD


def dropped(*tables: DataFrame) -> None:
    """Delete tables of :func:`stored` that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            removed(spark, folder)


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], salt: Column, how: str = "left", salts: int = 16) -> DataFrame:
    """``many`` joined to ``few`` (one row a key) where a key may hold a large share of ``many``: each key's rows go to ``salts`` join keys."""
    own = many.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    copies = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return own.join(copies.hint("merge"), [*keys, "__salt"], how).drop("__salt")
