"""The registry of queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.session import small
from quizmill.sources.adapters import domain, with_domain
from quizmill.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """Domain tables and given tables of one folder by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        from quizmill.sources.adapters import ADAPTERS

        return domain(self.spark, self.folder, name) if name in ADAPTERS else table(self.spark, self.folder, name)

    def of_posts(self, name: str, posts: DataFrame) -> DataFrame:
        """The domain table ``name``, derived post by post from order lines, of ``posts(post_id)`` alone. Where their ids can be sent
        to all tasks, lines are filtered as they are read, which Spark cannot do by itself ahead of a numbering within posts."""
        lines = self.lineitem.join(small(posts.select(F.col("post_id").alias("l_orderkey")).distinct(), 16), "l_orderkey", "left_semi")
        return domain(self.spark, self.folder, name, {"lineitem": lines})


def query(name: str, sql: str | None = None):
    """Register ``f(inputs)`` as a query, with the SQL of its result over given and domain tables in braces."""

    def add(f):
        QUERIES[name] = lambda spark, folder: f(Inputs(spark, folder))
        if sql:
            ORACLES[name] = with_domain(sql)
        return f

    return add
