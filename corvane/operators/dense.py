"""Exact inner-product search, and a deterministic text embedder to run it without a trained model.

Search scores blocks of vectors against the matrix of all queries, keeps each block's best rows of each query, and
ranks those: exact, with a shuffle of blocks x k rows. The query matrix is sent to the executors, its size checked.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvane.functions.text import tokens
from corvane.operators.bm25 import top_k
from corvane.storage import in_blocks

#: Bytes of query vectors that are fetched and sent to every executor at once; more are searched in blocks of this size.
BROADCAST_BYTES = 64 << 20
DIM = 64


def embedding_text(heading: Column, chapter_title: Column, section_title: Column, article_title: Column, text: Column) -> Column:
    """Text with its heading path before it; without one, with its titles."""
    given = lambda c: F.when(c != "", c)
    path = F.array_join(heading, " > ")
    prefix = F.coalesce(given(path), F.concat_ws(" > ", given(chapter_title), F.coalesce(given(section_title), given(article_title))))
    return F.when(prefix != "", F.concat(prefix, F.lit("\n\n"), text)).otherwise(text)


def embed(df: DataFrame, id_col: str, text: Column, dim: int = DIM) -> DataFrame:
    """(id, vector array<double>): hashed term counts of unit length; a text without terms gives zeros.

    A term's bucket is the number of the first four hex digits of its MD5, modulo ``dim``.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            terms = batch.column("terms")
            coded = terms.flatten().dictionary_encode()
            of = np.array([int(hashlib.md5(t.encode()).hexdigest()[:4], 16) % dim for t in coded.dictionary.to_pylist()], dtype=np.int64)
            sizes = np.diff(terms.offsets.to_numpy())
            at = np.repeat(np.arange(batch.num_rows), sizes) * dim + of[coded.indices.to_numpy()] if len(coded) else np.zeros(0, dtype=np.int64)
            raw = np.bincount(at, minlength=batch.num_rows * dim).reshape(batch.num_rows, dim).astype(np.float64)
            norm = np.sqrt((raw * raw).sum(axis=1, keepdims=True))
            unit = np.divide(raw, norm, out=np.zeros_like(raw), where=norm > 0)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dim), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), vectors], names=["id", "vector"])

    src = df.select(F.col(id_col).alias("id"), F.coalesce(tokens(text), F.array().cast("array<string>")).alias("terms"))
    return src.mapInArrow(run, f"id {kind}, vector array<double>").withColumnRenamed("id", id_col)


def norm_audit(vectors: DataFrame, vector_col: str = "vector", tolerance: float = 1e-4) -> DataFrame:
    """One row: vectors, those off unit length, and the extreme lengths."""
    norm = F.sqrt(F.aggregate(F.transform(vector_col, lambda x: x.cast("double")), F.lit(0.0), lambda acc, x: acc + x * x))
    return vectors.select(norm.alias("norm")).agg(F.count("*").alias("n_vectors"), F.count_if(F.abs(F.col("norm") - 1) > tolerance).alias("n_off"), F.round(F.min("norm"), 6).alias("min_norm"), F.round(F.max("norm"), 6).alias("max_norm"))


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank) of the k nearest of ``vectors(chunk_id, vector)`` to ``queries(query_id, vector)``.

    Scores are rounded to six digits; ties go to the smaller id. Null vectors are left out.
    """
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (vectors, "chunk_id"))]
    schema = f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double"
    given = queries.where("vector is not null").select("query_id", F.col("vector").cast("array<double>"))
    width = given.select(F.size("vector")).first()
    found = None
    for part in in_blocks(given, "query_id", BROADCAST_BYTES // (8 * max(1, width[0] if width else 1))):
        block = part.orderBy("query_id").collect()
        ids = pa.array([r[0] for r in block], to_arrow_type(queries.schema["query_id"].dataType))
        shared = vectors.sparkSession.sparkContext.broadcast((ids, np.array([r[1] for r in block], dtype=np.float64)))

        def run(batches, shared=shared, k=k):
            ids, matrix = shared.value
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
                scores = np.round(matrix @ flat.reshape(batch.num_rows, -1).T, 6)
                keep = min(k, batch.num_rows)
                if keep < batch.num_rows:
                    cut = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1]  # ties at the cut all stay
                    q, d = np.nonzero(scores >= cut[:, None])
                else:
                    q, d = np.nonzero(np.ones_like(scores, dtype=bool))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), batch.column("chunk_id").take(pa.array(d)), pa.array(scores[q, d])], names=["query_id", "chunk_id", "score"])

        src = vectors.where("vector is not null").select("chunk_id", F.col("vector").cast("array<double>"))
        hits = src.mapInArrow(run, schema)
        found = hits if found is None else found.unionByName(hits)
    return top_k(found, k)
