"""BM25 over an inverted index kept as tables.

Okapi weights with k1 = 1.5 and b = 0.75: a term's weight is ln(N - n + 0.5) - ln(n + 0.5); a negative one becomes a
quarter of the mean weight of the whole vocabulary. N and the mean length count chunks without terms, too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvane.functions.text import tokens
from corvane.storage import in_blocks, written

K1, B, FLOOR = 1.5, 0.75, 0.25
#: Bytes of a matrix of query terms by queries that are sent to every executor at once, and of one of term counts.
MATRIX_BYTES = 64 << 20
#: Queries whose terms are fetched at once.
QUERY_BLOCK = 2000


@dataclass
class Index:
    """postings(term, chunk_id, tf), doc_len(chunk_id, len), term_idf(term, df, idf), stats(n, avgdl)."""

    postings: DataFrame
    doc_len: DataFrame
    term_idf: DataFrame
    stats: DataFrame

    NAMES = ("postings", "doc_len", "term_idf", "stats")

    def write(self, path: str) -> None:
        for name in self.NAMES:
            df = getattr(self, name)
            if name == "postings":
                df = df.repartitionByRange("term").sortWithinPartitions("term", "chunk_id")  # row groups then prune by term
            df.write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in cls.NAMES))


def documents(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(chunk_id, terms), each id once; texts are cut into terms before they are shuffled. A null text has no terms.

    Terms have no spaces, so they are shuffled as one string, which takes a third of the array's room.
    """
    docs = chunks.select(F.col(id_col).alias("chunk_id"), F.coalesce(F.array_join(tokens(F.col(text_col)), " "), F.lit("")).alias("terms")).dropDuplicates(["chunk_id"])
    return docs.select("chunk_id", F.when(F.col("terms") == "", F.array().cast("array<string>")).otherwise(F.split("terms", " ")).alias("terms"))


def build(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> Index:
    """The index of all chunks; deliveries of an id agree and count once. A null text has no terms and length 0."""
    docs = documents(chunks, id_col, text_col)
    doc_len = docs.select("chunk_id", F.size("terms").alias("len"))
    postings = docs.select("chunk_id", F.explode("terms").alias("term")).groupBy("term", "chunk_id").agg(F.count("*").cast("int").alias("tf"))
    stats = doc_len.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))
    return Index(postings, doc_len, weights(docs.select(F.explode(F.array_distinct("terms")).alias("term")), stats), stats)


def weights(distinct_terms: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf) from a row for each chunk's distinct term."""
    return weights_of(distinct_terms.groupBy("term").agg(F.count("*").alias("df")), stats)


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, df, len) of docs(chunk_id, terms) as a stored table; the term '' has the number of chunks and their length.

    One pass over the texts for all that the weights need; counts are combined before they are shuffled.
    """
    size = F.size("terms").cast("bigint")
    entries = F.concat(F.array(F.struct(F.lit("").alias("term"), size.alias("len"))), F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.lit(0).cast("bigint").alias("len"))))
    return written(docs.select(F.explode(entries).alias("e")).groupBy("e.term").agg(F.count("*").alias("df"), F.sum("e.len").alias("len")))


def weights_of(df: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf) from (term, df)."""
    raw = df.crossJoin(F.broadcast(stats.select("n"))).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # stats is one row
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) of (query_id, query); a repeated term counts as often as it stands there."""
    return queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def scores(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score) with positive scores, rounded to six digits so that sums in any order rank alike.

    How the joins run is left to Spark's size rules.
    """
    terms = query_terms(queries)
    wanted = terms.select("term").distinct()
    hits = index.postings.join(wanted, "term").join(index.doc_len, "chunk_id").crossJoin(F.broadcast(index.stats))
    idf = index.term_idf.join(wanted, "term").select("term", "idf")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    per_term = hits.join(idf, "term").select("chunk_id", "term", part.alias("part"))
    return per_term.join(terms, "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("part") * F.col("qtf")), 6).alias("score")).where("score > 0")


def search_index(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank) of the k best chunks of each query, from the index tables.

    The postings of the queries' terms are gathered by chunk and blocks of chunks are scored against all queries as in
    ``search``, so no row is made for each query and chunk that share a term.
    """
    found = None
    for part in in_blocks(queries, "query_id", QUERY_BLOCK):
        terms = query_terms(part)
        rows = terms.join(index.term_idf, "term").crossJoin(F.broadcast(index.stats)).select("query_id", "term", "qtf", "idf", "avgdl").orderBy("query_id", "term").collect()
        wanted = index.postings.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
        by_chunk = wanted.groupBy("chunk_id").agg(F.collect_list(F.struct("term", "tf")).alias("hits")).join(index.doc_len, "chunk_id")
        hits = _best(by_chunk.select("chunk_id", F.col("hits.term").alias("terms"), F.col("hits.tf").alias("tf"), "len"), queries, rows, rows[0]["avgdl"] if rows else 1.0, k)
        found = hits if found is None else found.unionByName(hits)
    return top_k(found, k)


def top_k(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best of each query with their rank from 1; ties go to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(chunks: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(query_id, chunk_id, score, rank) of the k best chunks of each query, straight from the texts.

    Only counts by term are shuffled. Then blocks of texts are scored against all queries by one product of
    matrices, tf weights by query terms, and each block passes on its best k of each query, ties at the cut
    included. The queries' terms go to the executors, in blocks of queries of a checked size.
    """
    docs = documents(chunks, id_col, text_col)
    counts = term_counts(docs)
    n, avgdl = counts.where("term = ''").select("df", F.col("len") / F.col("df")).first() or (0, None)
    stats = queries.sparkSession.createDataFrame([(n,)], "n bigint")
    idf = weights_of(counts.where("term <> ''").select("term", "df"), stats)
    found = None
    for part in in_blocks(queries, "query_id", QUERY_BLOCK):
        rows = query_terms(part).join(idf, "term").select("query_id", "term", "qtf", "idf").orderBy("query_id", "term").collect()
        hits = _best(docs, queries, rows, avgdl or 1.0, k)
        found = hits if found is None else found.unionByName(hits)
    return top_k(found, k)


def _best(docs: DataFrame, queries: DataFrame, rows: list, avgdl: float, k: int) -> DataFrame:
    """(query_id, chunk_id, score) of each block's best k of each query; rows: (query_id, term, qtf, idf)."""
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (docs, "chunk_id"))]
    found = None
    for shared in _matrices(rows, queries, avgdl):

        def run(batches, shared=shared, k=k):
            for batch in batches:
                yield from _score_batch(batch, *shared.value, k)

        hits = docs.mapInArrow(run, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")
        found = hits if found is None else found.unionByName(hits)
    return found


def _matrices(rows: list, queries: DataFrame, avgdl: float):
    """Broadcasts of (query ids, term numbers, weights by term and query, mean length); at least one, each of a bounded size."""
    by_query: dict = {}
    for r in rows:
        by_query.setdefault(r["query_id"], []).append(r)
    ids, first = list(by_query), True
    while ids or first:
        first = False
        block, seen = [], set()
        while ids and (not block or len(seen | {r["term"] for r in by_query[ids[0]]}) * (len(block) + 1) * 8 <= MATRIX_BYTES):
            seen |= {r["term"] for r in by_query[ids[0]]}
            block.append(ids.pop(0))
        number = {t: i for i, t in enumerate(sorted(seen))}
        matrix = np.zeros((len(number), len(block)))
        for j, q in enumerate(block):
            for r in by_query[q]:
                matrix[number[r["term"]], j] = r["idf"] * r["qtf"] * (K1 + 1)
        ids_array = pa.array(block, to_arrow_type(queries.schema["query_id"].dataType))
        yield queries.sparkSession.sparkContext.broadcast((ids_array, number, matrix, avgdl))


def _score_batch(batch: pa.RecordBatch, ids: pa.Array, number: dict[str, int], matrix: np.ndarray, avgdl: float, k: int):
    """batch: (chunk_id, terms) or, each term once, (chunk_id, terms, tf, len)."""
    width = len(number)
    if not width:
        return
    terms = batch.column("terms")
    coded = terms.flatten().dictionary_encode()
    of = np.array([number.get(t, -1) for t in coded.dictionary.to_pylist()], dtype=np.int64)
    term = of[coded.indices.to_numpy()] if len(coded) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(terms.offsets.to_numpy())
    begin = np.concatenate(([0], np.cumsum(sizes)))
    counted = "tf" in batch.schema.names
    count = batch.column("tf").flatten().to_numpy() if counted else np.ones(len(term), dtype=np.int32)
    norm = K1 * (1 - B + B * (batch.column("len").to_numpy() if counted else sizes) / avgdl)
    step = max(1, MATRIX_BYTES // (8 * width))
    for a in range(0, batch.num_rows, step):
        b = min(batch.num_rows, a + step)
        mine = term[begin[a] : begin[b]]
        row = np.repeat(np.arange(b - a), sizes[a:b])
        hit = mine >= 0
        tf = np.bincount(row[hit] * width + mine[hit], weights=count[begin[a] : begin[b]][hit], minlength=(b - a) * width).reshape(b - a, width)
        scores = np.round((tf / (tf + norm[a:b, None])) @ matrix, 6).T if len(ids) else np.zeros((0, b - a))
        if b - a > k:
            cut = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
            q, d = np.nonzero((scores >= cut[:, None]) & (scores > 0))
        else:
            q, d = np.nonzero(scores > 0)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), batch.column("chunk_id").take(pa.array(d + a)), pa.array(scores[q, d])], names=["query_id", "chunk_id", "score"])
