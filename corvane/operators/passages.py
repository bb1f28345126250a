"""Hits merged into passages, citations, answers and prompt contexts. A query has k hits, so its groups are small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import ARTIFACT_A, ARTIFACT_B, clean_text, collapse, drop_overlap_marks, strip

UNKNOWN = "unknown"


def _given(c: str) -> Column:
    return F.when(F.col(c) != "", F.col(c))


def group_key(style: str) -> Column:
    """What hits are merged by. a: article; b: article, else section; exact: source, chapter and b."""
    b = F.coalesce(_given("article_number"), _given("section_number"), F.lit(UNKNOWN))
    if style == "a":
        return F.coalesce(_given("article_number"), F.lit(UNKNOWN))
    return b if style == "b" else F.concat_ws("|", F.coalesce("source", F.lit("")), F.coalesce("chapter_number", F.lit("")), b)


def aggregate(hits: DataFrame, style: str = "b") -> DataFrame:
    """Passages of hits (query_id, rank, score and the chunk's columns), by the greatest score.

    Within a passage chunks are in the order of chunk_index, those with a content_hash that has been seen are left
    out of the text but stay in chunk_ids, and texts are cleaned. Ties go to the passage met first.
    """
    order = Window.partitionBy("query_id", "key").orderBy(F.coalesce("chunk_index", F.lit(0)), "rank")
    seen = Window.partitionBy("query_id", "key", "content_hash").orderBy(F.coalesce("chunk_index", F.lit(0)), "rank")
    rows = hits.withColumn("key", group_key(style))
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("again", (F.row_number().over(seen) > 1) & (F.coalesce("content_hash", F.lit("")) != ""))
    block = F.coalesce(clean_text(F.col("text"), ARTIFACT_A if style == "a" else ARTIFACT_B), F.lit(""))
    cleaned = hits.select("chunk_id", "text").dropDuplicates(["chunk_id"]).select("chunk_id", block.alias("cleaned"))  # many questions hit the same chunk
    rows = rows.join(cleaned, "chunk_id").withColumn("block", F.when(~F.col("again"), F.col("cleaned")))
    first = lambda c: F.min_by(c, "n").alias(c)
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("block") != "", F.struct("n", "block")))), lambda s: s["block"])
    out = rows.groupBy("query_id", "key").agg(
        *[first(c) for c in ("article_number", "article_title", "section_number", "section_title", "chapter_number", "chapter_title", "heading_path", "source")],
        F.min("page_start").alias("page_start"),
        F.max("page_end").alias("page_end"),
        F.transform(F.array_sort(F.collect_list(F.struct("n", "chunk_id"))), lambda s: s["chunk_id"]).alias("chunk_ids"),
        F.max(F.coalesce("score", F.lit(0.0))).alias("score"),
        F.min("rank").alias("met"),
        strip(collapse(drop_overlap_marks(F.array_join(parts, "\n\n")))).alias("text"),
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "met")
    return out.withColumn("rank", F.row_number().over(w)).drop("met")


def merge_adjacent(hits: DataFrame) -> DataFrame:
    """Passages of neighbours in rank with the same article, or section if there is none; the order of ranks stays.

    Repeated chunk_ids count once. Pages, labels and score are those of the first chunk.
    """
    once = Window.partitionBy("query_id", "chunk_id").orderBy("rank")
    rows = hits.withColumn("n", F.row_number().over(once)).where("n = 1").drop("n")
    order = Window.partitionBy("query_id").orderBy("rank")
    same = ((F.coalesce(_given("article_number"), F.lit("")) == F.lag(F.coalesce(_given("article_number"), F.lit(""))).over(order)) & _given("article_number").isNotNull()) | (
        (F.coalesce(_given("section_number"), F.lit("")) == F.lag(F.coalesce(_given("section_number"), F.lit(""))).over(order)) & _given("section_number").isNotNull()
    )
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("starts", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("starts").over(running))
    first = lambda c: F.min_by(c, "rank").alias(c)
    out = rows.groupBy("query_id", "island").agg(
        *[first(c) for c in ("article_number", "article_title", "section_number", "section_title", "heading_path", "source", "page_start", "page_end", "score")],
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda s: s["chunk_id"]).alias("chunk_ids"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]), "\n\n").alias("text"),
    )
    return out.withColumnRenamed("island", "rank")


def _pages(first: Column, last: Column) -> Column:
    return F.when(first == last, F.concat(F.lit("p."), first)).otherwise(F.concat(F.lit("pp."), first, F.lit("–"), last))


def citation(style: str) -> Column:
    """Citation of a passage row. a: short with location; b: with chunks and score; c: with two chunks and score."""
    title = F.coalesce(F.when(F.trim("article_title") != "", F.trim("article_title")), F.when(F.trim("section_title") != "", F.trim("section_title")))
    after = lambda sep: F.coalesce(F.concat(F.lit(sep), title), F.lit(""))
    path = F.filter(F.coalesce("heading_path", F.array().cast("array<string>")), lambda h: h.isNotNull())
    last_two = F.slice(path, F.greatest(F.size(path) - 1, F.lit(1)), 2)
    rank, score = F.col("rank").cast("string"), F.format_string("%.3f", F.coalesce("score", F.lit(0.0)))
    article, section = _given("article_number"), _given("section_number")
    third = F.when(F.size(path) >= 3, F.concat(F.lit(" "), F.get(path, F.lit(2)))).otherwise("")
    p1, p2 = F.col("page_start").cast("string"), F.col("page_end").cast("string")
    if style == "a":
        where = F.when((article.isNotNull()) & ~article.isin("unknown", "?"), F.concat(F.lit("Art. "), article, after(" — "))).when(section.isNotNull(), F.concat(F.lit("§ "), section, F.coalesce(F.concat(F.lit(" "), title), third))).when(F.size(path) > 0, F.array_join(last_two, " › ")).otherwise(F.coalesce(title, F.lit("General")))
        pages = F.coalesce(F.when(p2.isNotNull() & (p1 != p2), _pages(p1, p2)), F.concat(F.lit("p."), p1), F.lit(""))
        short = F.when(F.coalesce("source", F.lit("")) != "", F.trim(F.substring_index("source", "(", 1))).otherwise("Source")
        return F.concat(F.lit("["), rank, F.lit("]  "), short, F.lit("  |  "), where, F.lit("  |  "), pages)
    ids = F.col("chunk_ids")
    if style == "b":
        where = F.when(article.isNotNull(), F.concat(F.lit("Punitive Articles | Art. "), article, after(" — "))).when(F.size(path) > 0, F.array_join(path, " > ")).when(section.isNotNull(), F.concat(section, after(" — "))).otherwise("Unknown Section")
        pages = _pages(F.coalesce(p1, F.lit("?")), F.coalesce(p2, F.lit("?")))
        return F.concat(F.lit("["), rank, F.lit("] ["), F.coalesce("source", F.lit("MCM")), F.lit(" | "), where, F.lit(" | "), pages, F.lit(" | chunks: "), F.array_join(ids, ", "), F.lit(" | score: "), score, F.lit("]"))
    where = F.when(article.isNotNull(), F.concat(F.lit("Art. "), article, after(" — "))).when(section.isNotNull(), F.concat(F.lit("§ "), section, F.coalesce(F.concat(F.lit(" "), title), third))).when(F.size(path) > 0, F.array_join(last_two, " > ")).otherwise("?")
    pages = F.coalesce(F.concat(F.lit("pp."), p1, F.lit("–"), p2), F.concat(F.lit("p."), p1), F.lit(""))
    some = F.concat(F.array_join(F.slice(ids, 1, 2), ", "), F.when(F.size(ids) > 2, "…").otherwise(""))
    return F.concat(F.lit("["), rank, F.lit("] "), F.coalesce("source", F.lit("Unknown")), F.lit(" | "), where, F.lit(" | "), pages, F.lit(" | "), some, F.lit(" | score: "), score)


def answers(passages: DataFrame, body: Column, style: str) -> DataFrame:
    """(query_id, answer): citations and bodies of a query's passages in rank order."""
    rows = passages.select("query_id", "rank", F.concat(citation(style), F.lit("\n"), body).alias("part"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda s: s["part"]), "\n\n").alias("answer"))


def context(passages: DataFrame, chars: int | None = 2800, first: int | None = None, style: str = "c") -> DataFrame:
    """(query_id, context) for a prompt: numbered passages in rank order, each cut to ``chars``, ``first`` at most."""
    rows = passages if first is None else passages.where(F.col("rank") <= first)
    text = F.col("text") if chars is None else F.when(F.length("text") > chars, F.concat(F.left("text", F.lit(chars)), F.lit(" …"))).otherwise(F.col("text"))
    return answers(rows, text, style).withColumnRenamed("answer", "context")
