"""Helpers that several of the operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from contextlib import contextmanager, suppress
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space, and tab to carriage return.
GAP = r"[\x20\x09-\x0D]+"


#: A side of a join is broadcast only if it has at most so many rows of a few numbers (some 50 MB as a hash table); beyond, it is shuffled.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a local session gets a folder of its own and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="granulon-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/granulon-{label}-{uuid.uuid4().hex}"
    if _SCRATCH.get() is not None:
        _SCRATCH.get().append(path)
    return path


class _Paths(list):
    """Paths of scratch tables, and those of the scratch around them."""

    def __init__(self, outer: _Paths | None):
        super().__init__()
        self.outer = outer


#: The paths of the scratch tables of the innermost ``scratch``, in this thread's context.
_SCRATCH: ContextVar[_Paths | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """Tables written inside are deleted at its end, also after errors; what is to outlast it is written with ``lasting``."""
    token = _SCRATCH.set(_Paths(_SCRATCH.get()))
    try:
        yield
    finally:
        for name in _SCRATCH.get():
            delete(spark, name)
        _SCRATCH.reset(token)


def materialise(df: DataFrame, label: str, lasting: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: it is computed once, and outlives lost executors. ``lasting`` hands it to the scratch around this one."""
    path = shared_path(df.sparkSession, label)
    if lasting and _SCRATCH.get() is not None:
        _SCRATCH.get().pop()
        if _SCRATCH.get().outer is not None:
            _SCRATCH.get().outer.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table of the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def give_back() -> None:
    """Return freed memory of this Python worker to the system: workers serve one stage after another, and an executor's memory counts all of them."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def sized(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table as the small side of a join: broadcast if it has at most so many rows, else hashed after a shuffle."""
    return F.broadcast(side) if side.count() <= rows else side.hint("shuffle_hash")


def which(key: str, text: str) -> Column:
    """A row's key and text as 128 bits (h0, h1): equal rows get equal verdicts."""
    return F.struct(*(F.xxhash64(F.lit(k), F.col(key).cast("string"), F.col(key).isNull(), F.coalesce(F.col(text), F.lit(""))).alias(f"h{k}") for k in (0, 1)))


def without(docs: DataFrame, gone: DataFrame, key: str, text: str) -> DataFrame:
    """The documents, with all their columns, but for those whose ``which`` is in a written table (h0, h1)."""
    rows = docs.select(F.struct("*").alias("_row"), which(key, text).alias("_t"))
    return rows.join(sized(gone), (F.col("_t.h0") == F.col("h0")) & (F.col("_t.h1") == F.col("h1")), "left_anti").select("_row.*")


def words(text: Column) -> Column:
    """The words of a text, as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
