"""Joins of a stated set of rows with all rows of another table, in blocks of bounded size, inside one Spark job."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of vectors that one side of a pair of blocks holds in a task.
BLOCK_BYTES = 32_000_000
#: Rows of a block that is made smaller only to give more tasks work.
LEAST_ROWS = 1000


def block_rows(width: int) -> int:
    """Rows of a block for vectors of ``width`` components, held as doubles."""
    return max(LEAST_ROWS, BLOCK_BYTES // (8 * max(width, 1)))


def _largest(df: DataFrame, on: list[str]) -> int:
    """Rows of the largest group of ``on``."""
    return df.groupBy(*on).count().agg(F.max("count")).first()[0] or 0


def block_join(left: DataFrame, right: DataFrame, row: str, on: list[str], rows: int, meet: Callable, schema: str) -> DataFrame:
    """``meet(key, left rows, right rows)``, pandas frames, for every pair of blocks of equal ``on`` that both have rows.

    Rows are dealt to blocks by the hash of ``row``, a number that no two rows of a side share, so a hot value of ``on`` only
    has more blocks. A block holds about ``rows`` rows. Each side is sent once for every block of the other; no task sees more
    than one pair of blocks at a time, and nothing passes through the driver. Blocks are smaller where there would be
    fewer pairs than shuffle partitions.
    """
    spark = left.sparkSession
    a, b = _largest(left, on), _largest(right, on)
    lefts, rights = -(-a // rows) or 1, -(-b // rows) or 1
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rights = max(rights, min(-(-wanted // lefts), b // LEAST_ROWS))

    def number(blocks: int):
        return F.pmod(F.xxhash64(row), F.lit(blocks)).cast("int")

    def every(blocks: int):
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    keys = [*on, "_left", "_right"]
    dealt = left.withColumn("_left", number(lefts)).withColumn("_right", every(rights)).groupBy(*keys)
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # columns of its own, should both come from one table
    other = right.withColumn("_right", number(rights)).withColumn("_left", every(lefts)).groupBy(*keys)
    names = [f.split()[0] for f in schema.split(",")]

    def both(key, x, y):
        return meet(key, x, y) if len(x) and len(y) else pd.DataFrame(columns=names)

    return dealt.cogroup(other).applyInPandas(both, schema)
