"""The engine from chunks to scored answers; one question is a table of one row."""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import ARTIFACT_B, excerpt, outline
from corvane.operators import bm25, chunking, dense, evaluation, passages, retrieval, segment
from corvane.schema import once


def ingest_articles(pages: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Chunk records of an article book's pages."""
    return chunking.article_chunks(segment.sections(segment.clean_pages(pages), segment.HEADINGS["article"], titles))


def ingest_chapters(pages: DataFrame, heading: str = "section") -> DataFrame:
    """Chunk records of a manual's pages; ``heading`` names its heading style.

    'book' takes the style of each manual by the start of its name; pages of other books are left out.
    """
    if heading == "book":
        return reduce(DataFrame.unionByName, (ingest_chapters(pages.where(F.col("doc").startswith(name)), style) for name, style in segment.MANUALS.items()))
    return chunking.chapter_chunks(segment.chapter_sections(segment.clean_pages(pages), heading), heading)


@dataclass
class Engine:
    """chunks(chunk_id, text, ...), vectors(chunk_id, vector) and, unless it is missing, the keyword index."""

    chunks: DataFrame
    vectors: DataFrame
    index: bm25.Index | None

    @classmethod
    def build(cls, chunks: DataFrame) -> Engine:
        unique = once(chunks)
        text = dense.embedding_text(*(F.col(c) for c in ("heading_path", "chapter_title", "section_title", "article_title", "text")))
        return cls(unique, dense.embed(unique, "chunk_id", text), bm25.build(unique))

    def save(self, path: str) -> None:
        self.chunks.write.mode("overwrite").parquet(f"{path}/chunks")
        self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
        if self.index is not None:
            self.index.write(f"{path}/bm25")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Engine:
        """A missing keyword index is no error: search is then dense only."""
        try:
            index = bm25.Index.read(spark, f"{path}/bm25")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            index = None
        return cls(spark.read.parquet(os.path.join(path, "chunks")), spark.read.parquet(os.path.join(path, "vectors")), index)

    def search(self, queries: DataFrame, k: int = 8, article: str | None = "auto", mode: str = "hybrid", injection: str = "compat", scan: bool = False) -> DataFrame:
        """Hits (query_id, rank, score, mode and the chunk's columns) of queries(query_id, query).

        article: 'auto' takes the article that a query names, None filters nothing, else it is the article. mode:
        'hybrid' or 'dense'; without a keyword index hybrid is dense. scan: score the texts against all queries in one
        pass instead of the postings of the queries' terms.
        """
        pool = retrieval.pool_size(k)
        near = dense.search(self.vectors, dense.embed(queries, "query_id", F.col("query")), pool)
        named = retrieval.article_key(retrieval.detect_article(F.col("query")))
        wanted = named if article == "auto" else retrieval.article_key(F.lit(article))
        targets = queries.select("query_id", F.when(wanted != "", wanted).alias("target"))
        articles = self.chunks.select("chunk_id", retrieval.article_key(F.col("article_number")).alias("article"))
        label, ranked = "dense", near.select("query_id", "chunk_id", F.col("score").alias("rrf_score"), "score", "rank")
        if mode == "hybrid" and self.index is not None:
            expanded = queries.select("query_id", retrieval.expand(F.col("query")).alias("query"))
            keyword = bm25.search(self.chunks, expanded, pool) if scan else bm25.search_index(self.index, expanded, pool)
            keyword = retrieval.inject(keyword, articles, queries.select("query_id", F.when(named != "", named).alias("target")), injection)
            label, ranked = "hybrid", retrieval.fuse(near, keyword).select("query_id", "chunk_id", "rrf_score", "score", "rank")
        return retrieval.filtered(ranked, articles, targets, k, label=label).join(self.chunks, "chunk_id")

    def ask(self, question: str, k: int = 8, **options) -> DataFrame:
        spark = self.chunks.sparkSession
        return self.search(spark.createDataFrame([("q", question)], "query_id string, query string"), k, **options)

    def answers(self, hits: DataFrame) -> DataFrame:
        """(query_id, answer) without a language model: cited excerpts of merged passages."""
        return passages.answers(passages.aggregate(hits, "b"), outline(excerpt(F.col("text"), ARTIFACT_B, 800, True)), "b")

    def evaluate(self, questions: DataFrame, k: int = 8, **options) -> DataFrame:
        """One row of metrics over questions(query_id, query, gold)."""
        hits = self.search(questions.select("query_id", "query"), k, **({"scan": True} | options))
        return evaluation.metrics(evaluation.detail(questions, hits))
