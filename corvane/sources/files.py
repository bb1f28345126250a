"""Readers and writers of chunks, benchmarks, runs and pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.schema import BENCHMARK, CHUNK, PAGE

_RUN_NAMES = {"MRR": "mrr"} | {f"{m}@{k}": f"{m.lower()}_at_{k}" for m in ("Recall", "Precision", "F1") for k in (1, 3, 5, 8)}


def read_chunks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Chunk records from JSON lines; keys that are missing are null, blank lines are skipped, and a broken line fails the read."""
    return spark.read.schema(CHUNK).option("mode", "FAILFAST").json(paths)


def source_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source").agg(F.count("*").alias("n_chunks"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """JSON lines without null keys, UTF-8 as it is."""
    chunks.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """(id, query, difficulty, category, gold, declared, actual): the file's questions with the declared and the actual count."""
    doc = spark.read.schema(BENCHMARK).option("multiLine", True).json(path)
    rows = doc.select(F.col("metadata.total_questions").alias("declared"), F.size("questions").alias("actual"), F.explode("questions").alias("q"))
    return rows.select("q.*", "declared", "actual")


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """A saved run with its @ names replaced by those of the metrics operator."""
    df = spark.read.option("multiLine", True).json(path)
    return df.withColumnsRenamed({a: b for a, b in _RUN_NAMES.items() if a in df.columns})


def write_run(metrics: DataFrame, path: str, reranked: bool = False, log: Callable[[dict], None] | None = None) -> None:
    """One JSON object without the keys that start with _; ``log`` gets it too, and what it raises is ignored."""
    kept = metrics.select(*[c for c in metrics.columns if not c.startswith("_")], F.lit(reranked).alias("reranked"))
    kept.coalesce(1).write.mode("overwrite").json(path)
    if log is not None:
        try:
            log(kept.first().asDict(recursive=True))
        except Exception:  # noqa: BLE001 - a tracker must never break a run
            pass


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)


def read_pages(spark: SparkSession, path: str, parsers: list[Callable[[bytes], list[str]]], first: int = 1, last: int | None = None) -> DataFrame:
    """(doc, chapter, page_num, text, is_exhibit) of binary files; pages count from 1, first and last are inclusive.

    The parsers are tried in order, a later one where those before raised; a file that none can read gives one row
    with a null page_num and a null text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, numbers, texts = [], [], []
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                pages: list[str] | None = None
                for parse in parsers:
                    try:
                        pages = parse(content)
                        break
                    except Exception:  # noqa: BLE001 - the next parser may read it
                        continue
                numbered = [(None, None)] if pages is None else [(n, text) for n, text in enumerate(pages[: last or len(pages)], 1) if n >= first]
                for n, text in numbered:
                    docs.append(name.rsplit("/", 1)[-1].rsplit(".", 1)[0])
                    numbers.append(n)
                    texts.append(text)
            cols = [pa.array(docs, pa.string()), pa.nulls(len(docs), pa.string()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string()), pa.nulls(len(docs), pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc", "chapter", "page_num", "text", "is_exhibit"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, PAGE)
