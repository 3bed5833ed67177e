"""Reading and writing the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.session import ship
from quizmill.sources.schemas import TABLES

#: Tables written in folders by a column of few values, so that readers of one value skip the rest.
PARTITIONED = {"posts": ["extract_status"], "alias_dict": ["entity_type"]}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables, as it is."""
    return ship(spark).read.parquet(f"{folder}/{name}.parquet")


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The seven domain tables by name. Columns that old files lack are null."""
    return {name: spark.read.schema(schema).option("mergeSchema", "true").parquet(f"{folder}/{name}") for name, schema in TABLES.items()}


def write_table(df: DataFrame, folder: str, name: str, mode: str = "overwrite") -> None:
    """Write one of the seven tables in the types of its schema; columns that ``df`` lacks are null, others are left out."""
    columns = [c.split() for c in TABLES[name].split(", ")]
    rows = df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns))
    writer = rows.write.mode(mode)
    if name in PARTITIONED:
        writer = writer.partitionBy(*PARTITIONED[name])
    writer.parquet(f"{folder}/{name}")
