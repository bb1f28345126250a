"""Tables and their schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_S, _I = T.StringType(), T.IntegerType()

#: Union of the two variants of the chunk record; a key that a variant lacks is null.
CHUNK = T.StructType(
    [
        *[T.StructField(n, _S) for n in ("chunk_id", "content_hash", "source", "doc_path", "section", "article_number", "article_title")],
        T.StructField("total_chunks_in_article", _I),
        *[T.StructField(n, _S) for n in ("section_number", "section_title", "chapter_number", "chapter_title")],
        T.StructField("page_start", _I),
        T.StructField("page_end", _I),
        T.StructField("heading_path", T.ArrayType(_S)),
        T.StructField("chunk_index", _I),
        T.StructField("token_estimate", _I),
        T.StructField("text", _S),
    ]
)

PAGE = T.StructType([T.StructField("doc", _S), T.StructField("chapter", _S), T.StructField("page_num", _I), T.StructField("text", _S), T.StructField("is_exhibit", T.BooleanType())])

_GOLD = T.StructType([*[T.StructField(n, T.ArrayType(_S)) for n in ("article_numbers", "section_numbers", "chunk_ids")], T.StructField("source_doc", _S), T.StructField("notes", _S)])
QUESTION = T.StructType([*[T.StructField(n, _S) for n in ("id", "query", "difficulty", "category")], T.StructField("gold", _GOLD)])
BENCHMARK = T.StructType([T.StructField("metadata", T.StructType([T.StructField("total_questions", _I), T.StructField("source_doc", _S)])), T.StructField("questions", T.ArrayType(QUESTION))])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(chunks: DataFrame) -> DataFrame:
    """Each chunk_id once. Deliveries of an id agree in all but ``ingested_at``, so any of them will do."""
    return chunks.dropDuplicates(["chunk_id"])
