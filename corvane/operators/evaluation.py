"""Retrieval metrics against labelled questions. Questions are never lost: one without hits counts 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import strip_zeros

KS = (1, 3, 5, 8)


def _section(c: Column) -> Column:
    return F.rtrim(F.trim(c), F.lit("."))


def _empty(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def relevant(gold: Column) -> Column:
    """A hit row matches its question's gold labels.

    By chunk_id exactly; by article, one a prefix of the other without leading zeros; or by section, one a prefix of
    the other without trailing stops, provided that the source has the gold source's name in it or gold names none.
    """
    article = strip_zeros(F.coalesce("article_number", F.lit("")))
    section = _section(F.coalesce("section_number", F.lit("")))
    source_ok = gold["source_doc"].isNull() | F.contains(F.coalesce("source", F.lit("")), gold["source_doc"])
    either = lambda a, b: a.startswith(b) | b.startswith(a)
    by_id = F.coalesce(F.array_contains(_empty(gold["chunk_ids"]), F.col("chunk_id")), F.lit(False))
    by_article = (article != "") & F.exists(_empty(gold["article_numbers"]), lambda g: either(article, strip_zeros(g)))
    by_section = source_ok & (section != "") & F.exists(_empty(gold["section_numbers"]), lambda g: (_section(g) != "") & either(section, _section(g)))
    return by_id | F.coalesce(by_article, F.lit(False)) | F.coalesce(by_section, F.lit(False))


def detail(questions: DataFrame, hits: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """By question: first relevant rank, reciprocal rank within max(ks), and relevant hits in each top k.

    questions(query_id, gold, ...); hits(query_id, rank, score, chunk_id, article_number, section_number, source).
    """
    rows = questions.select("query_id", "gold").join(hits, "query_id", "left").withColumn("rel", F.coalesce(relevant(F.col("gold")) & F.col("chunk_id").isNotNull(), F.lit(False)))
    first = F.min(F.when(F.col("rel") & (F.col("rank") <= max(ks)), F.col("rank")))
    label = F.coalesce(F.when(F.col("article_number") != "", F.col("article_number")), "section_number", F.lit("?"))
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", label.alias("label"))))), lambda s: s["label"]), ", ")
    per = rows.groupBy("query_id").agg(
        first.alias("first_rank"), *[F.count_if(F.col("rel") & (F.col("rank") <= k)).alias(f"rel_{k}") for k in ks], F.coalesce(F.max("score"), F.lit(0.0)).alias("top_score"), top.alias("top5")
    )
    return per.withColumn("rr", F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)))


def metrics(per_question: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """One row: num_queries, mrr, and for each k recall (a hit rate), precision (over k) and F1 of the two means."""
    base = per_question.agg(
        F.count("*").alias("num_queries"), F.avg("rr").alias("mrr"), *[F.avg((F.col(f"rel_{k}") > 0).cast("double")).alias(f"recall_at_{k}") for k in ks], *[F.avg(F.col(f"rel_{k}") / k).alias(f"precision_at_{k}") for k in ks]
    )
    f1 = lambda k: F.when(F.col(f"recall_at_{k}") + F.col(f"precision_at_{k}") > 0, 2 * F.col(f"recall_at_{k}") * F.col(f"precision_at_{k}") / (F.col(f"recall_at_{k}") + F.col(f"precision_at_{k}"))).otherwise(0.0)
    return base.withColumns({f"f1_at_{k}": f1(k) for k in ks})


def misses(per_question: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions without a relevant hit, with what was found instead."""
    return per_question.where("rr = 0").join(questions.select("query_id", "query"), "query_id").select("query_id", "query", "top5", "top_score")


def advisory(m: DataFrame, k: int = 8, least: float = 0.5) -> DataFrame:
    """(hits_at_1, num_queries, low_precision)."""
    return m.select(F.round(F.col("recall_at_1") * F.col("num_queries")).cast("bigint").alias("hits_at_1"), "num_queries", (F.col(f"precision_at_{k}") < least).alias("low_precision"))


def long_form(run: DataFrame, names: list[str]) -> DataFrame:
    """(metric, value) of a one-row run."""
    pairs = ", ".join(f"'{n}', cast(`{n}` as double)" for n in names)
    return run.selectExpr(f"stack({len(names)}, {pairs}) as (metric, value)")


def compare(a: DataFrame, b: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """(metric, a, b, delta, arrow) of two runs in long form; a metric that one lacks has a null there."""
    both = a.select("metric", F.col("value").alias("a")).join(b.select("metric", F.col("value").alias("b")), "metric", "full_outer")
    delta = F.col("b") - F.col("a")
    return both.withColumn("delta", delta).withColumn("arrow", F.when(F.col("delta") > tolerance, "up").when(F.col("delta") < -tolerance, "down").otherwise("same"))
