"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where it is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (base or tempfile.mkdtemp(prefix="corvane-")).rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: it is computed once and survives lost executors.

    The table is deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/corvane-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def in_blocks(queries: DataFrame, key: str, rows: int) -> Iterator[DataFrame]:
    """A table of queries in blocks of about ``rows`` rows, by the hash of their key, so that no more is held at once."""
    n = max(1, -(-queries.count() // rows))
    for i in range(n):
        yield queries if n == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == i)
