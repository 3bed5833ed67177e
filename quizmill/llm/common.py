"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import string
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.session import shared_base, ship

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase

#: A side of a join is broadcast only if a count proved that it takes no more bytes than this.
BROADCAST_BYTES = 12_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII values take the fast built-in path."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share: see ``quizmill.session.shared_base``."""
    return f"{shared_base(spark)}/{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}-{label}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int = 32) -> DataFrame:
    """``df`` with a broadcast hint if a count proves that its rows, of ``row_bytes`` each, take at most BROADCAST_BYTES, else
    as it is. For rows of bounded size only: hashes, ids, numbers."""
    rows = BROADCAST_BYTES // row_bytes
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def release() -> None:
    """Give memory that earlier work of this worker has freed back to the system; workers are used again by later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every system's library has it
    if trim:
        trim(0)
