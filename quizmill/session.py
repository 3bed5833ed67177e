"""Session helpers: settings the library relies on, and shipping the package to Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What queries rely on. Sizes and numbers of partitions are left to the cluster.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers of the session's context, once, where they may lack it on their path."""
    sc = spark.sparkContext
    if not getattr(sc, "_quizmill_shipped", False):
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(), "quizmill.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(root):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.join("quizmill", os.path.relpath(full, root)))
        sc.addPyFile(path)
        sc._quizmill_shipped = True
    return spark


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a session whose driver is its only machine gets a temporary folder; on a cluster it is an error, as
    executors could not read what others wrote.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return base.rstrip("/")


def work_folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_base(spark)}/{uuid.uuid4().hex}-{label}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, whatever reads it."""
    path = work_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A side of a join is sent to all tasks only if a count proved that it takes no more bytes than this.
BROADCAST_BYTES = 12_000_000


def small(df: DataFrame, row_bytes: int = 48) -> DataFrame:
    """``df`` with a broadcast hint if a count proves that its rows, of ``row_bytes`` each at most, take BROADCAST_BYTES or less."""
    rows = BROADCAST_BYTES // row_bytes
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
