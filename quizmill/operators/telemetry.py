"""Operational metrics and dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizmill.operators.numbering import order_statistic
from quizmill.session import stored


def usage_summary(events: DataFrame, price_in: float = 1.0, price_out: float = 2.0) -> DataFrame:
    """Hits, misses, total, hit rate (0 without any), tokens and cost, of ``events(cache_hit, tokens_in, tokens_out)``."""
    hits, total = F.count_if("cache_hit"), F.count("cache_hit")
    tin, tout = F.coalesce(F.sum("tokens_in"), F.lit(0)), F.coalesce(F.sum("tokens_out"), F.lit(0))
    return events.agg(
        hits.alias("hits"), (total - hits).alias("misses"), total.alias("total"),
        F.round(F.coalesce(F.try_divide(hits, total), F.lit(0.0)), 6).alias("hit_rate"), tin.alias("tokens_in"), tout.alias("tokens_out"),
        F.round(tin / 1e6 * price_in + tout / 1e6 * price_out, 6).alias("cost"),
    )


def stage_latency(events: DataFrame) -> DataFrame:
    return events.groupBy("stage").agg(F.count("*").alias("runs"), F.round(F.avg("ms"), 4).alias("avg_ms"))


def upper_median(df: DataFrame, key: str, col: str) -> DataFrame:
    """Element n div 2, from 0, of the sorted values of each key, found by counts in ranges (see ``order_statistic``)."""
    return order_statistic(df, key, col, lambda n: F.floor(n / 2)).select(key, F.col("value").alias("p50"), "n")


def throughput(events: DataFrame, now: str, ts: str = "ts", minutes: int = 60) -> DataFrame:
    """Rows per minute within the last ``minutes`` before ``now``."""
    end = F.lit(now).cast("timestamp")
    recent = events.filter((F.col(ts) > end - F.expr(f"INTERVAL {minutes} MINUTE")) & (F.col(ts) <= end))
    return recent.groupBy(F.date_trunc("minute", ts).alias("minute")).agg(F.count("*").alias("n"))


def to_quarantine(failed: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Dead letters ``task, seq, payload, error`` of rows that failed at their last attempt; the payload is the row as JSON."""
    last = failed.filter(F.col("attempt") >= max_attempts)
    body = F.to_json(F.struct(*(c for c in failed.columns if c not in ("task", "seq", "error", "attempt"))))
    return last.select("task", "seq", body.alias("payload"), "error")


def list_dead(dead: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of each task with their ``place``; Spark keeps n rows a task name before it shuffles."""
    return dead.withColumn("place", F.row_number().over(Window.partitionBy("task").orderBy("seq", "payload", "error"))).filter(F.col("place") <= n)


def drain(dead: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(the first ``n`` of each task by seq, payload and error, the rest). Rows that equal the last one taken go with it.

    The last row that is taken is found among n rows a task; the others compare with it and are not ranked.
    """
    at = F.struct("seq", "payload", "error")
    last = list_dead(dead, n).groupBy("task").agg(F.max(at).alias("_last"))
    placed = dead.join(stored(last.select(F.col("task").alias("_of"), "_last"), "drained"), F.col("task").eqNullSafe(F.col("_of")), "left")
    taken = F.coalesce(at <= F.col("_last"), F.lit(False))
    return placed.filter(taken).drop("_of", "_last"), placed.filter(~taken).drop("_of", "_last")


def dead_counts(dead: DataFrame) -> DataFrame:
    return dead.groupBy("task").agg(F.count("*").alias("n"))
