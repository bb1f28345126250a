"""Shared helpers of the training-text operators: reading tables and moving Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.storage import written

__all__ = ["blocks", "bounded_sample", "map_batches", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Run ``fn`` on every Arrow batch of ``df``; batches that give None are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def blocks(items: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of consecutive items whose sizes sum to at most ``limit``; a larger item stands alone."""
    start, total = 0, 0
    for i, n in enumerate(items):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(items):
        yield start, len(items)


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, chosen by the hash of their key, so the choice doesn't depend on partitioning."""
    return df.orderBy(F.xxhash64(F.col(key).cast("string")), F.col(key)).limit(rows)
