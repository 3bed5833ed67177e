"""Consecutive numbers and order statistics without sorting a key, or all rows, in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizmill.session import small, stored

#: Ranges that the values of a key are cut into in each round of ``order_statistic``.
RANGES = 2048


def numbered(df: DataFrame, order: list[str], key: list[str] | None = None, name: str = "number") -> DataFrame:
    """``df`` with numbers from 1 in ``order``, within each ``key`` if given.

    Rows are dealt to ranges of (key, order) and sorted there. The rows of each key are counted per range; the counts before
    a range are its offset. Only these counts, one row for each key of a range, meet in a window. Rows that are equal in key
    and order are numbered in an arbitrary, but fixed, order: what is numbered is written to the shared folder once.
    """
    key = key or []
    placed = df.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    placed = stored(placed.withColumn("_uid", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_uid", 33))
    parts = placed.groupBy(*key, "_part").agg(F.count("*").alias("_n"), F.min("_uid").alias("_first"))
    before = F.sum("_n").over((Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("_before", F.coalesce(before, F.lit(0)))
    keys = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
    offsets = stored(parts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.col("_part").alias("_p"), "_first", "_before"), "offsets")
    match = F.col("_part") == F.col("_p")
    for k in keys:
        match = match & k
    out = placed.join(small(offsets, 64), match)
    return out.withColumn(name, F.col("_before") + F.col("_uid") - F.col("_first") + 1).select(*df.columns, name)


def order_statistic(df: DataFrame, key: str, col: str, rank) -> DataFrame:
    """``key, value, n``: of the n values of each key the one at place ``rank(n)``, from 0, in ascending order.

    The range that holds the place is narrowed round by round: its values are counted in RANGES equal parts, with the
    smallest and largest value in each, and the part that holds the place becomes the next range. Counts are summed in part
    before they are shuffled, so a key may hold all rows. Each round cuts the least range of distinct values into two at
    least; a few rounds do. Null and NaN values do not count.
    """
    rows = df.select(F.col(key).alias("k"), F.col(col).alias("v")).filter(F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double")))
    rows = stored(rows, "values")
    state = rows.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    state = stored(state.select("k", "lo", "hi", "n", rank(F.col("n")).cast("long").alias("place")), "ranges")
    done = [state.filter("lo = hi")]
    state = state.filter("lo < hi")
    while not state.isEmpty():
        asked = state.select(F.col("k").alias("of"), "lo", "hi")
        inside = rows.join(small(asked), F.col("k").eqNullSafe(F.col("of")) & F.col("v").between(F.col("lo"), F.col("hi")))
        part = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * RANGES), F.lit(RANGES - 1)).alias("part")
        counts = inside.groupBy("k", part).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = Window.partitionBy("k").orderBy("part")  # RANGES rows a key at most
        counts = counts.withColumn("before", F.sum("c").over(upto) - F.col("c"))
        places = state.select(F.col("k").alias("of"), "n", "place")
        found = counts.join(places, F.col("k").eqNullSafe(F.col("of"))).filter((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("c")))
        state = stored(found.select("k", "lo", "hi", "n", (F.col("place") - F.col("before")).alias("place")), "ranges")
        done.append(state.filter("lo = hi"))
        state = state.filter("lo < hi")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(F.col("k").alias(key), F.col("lo").alias("value"), "n")
