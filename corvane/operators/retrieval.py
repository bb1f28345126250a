"""Query expansion, article rules, rank fusion and fused retrieval, for one query or many in the same plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import strip_zeros
from corvane.operators.bm25 import top_k

RRF_K = 60
LOW_CONFIDENCE = 0.65

# Expansion rules, the first that matches counts.
EXPANSIONS = (
    (r"\bhazing\b", "cruelty maltreatment Article 93"),
    (r"\bchild abuse\b", "Article 119b child endangerment"),
    (r"\bdomestic violence\b", "Article 128b intimate partner"),
    (r"\bparole violation\b", "Article 107a"),
    (r"\b87a\b", "resistance flight breach arrest escape"),
    (r"\b119b\b", "child abuse endangerment offenses"),
    (r"\bdrug use\b", "controlled substance wrongful use Article 112a"),
    (r"\bimpaired driving\b", "drunken reckless operation Article 113"),
    (r"\bsanctuary\b", "sanctuary provision reserve 18 years 20 years"),
    (r"\boff.?limits\b", "off-limits locations servicemember establishments"),
    (r"\bunderground newspaper\b", "underground newspapers printed materials"),
    (r"\bwrongful use\b", "controlled substance Article 112a"),
    (r"\bpersonal property\b", "personal effects absentee deserter held unit"),
    (r"\bua\b", "unauthorized absence absentee deserter"),
    (r"\bunauthorized absence\b", "absentee deserter held unit personal effects"),
    (r"\bsecond alcohol incident\b", "separation conditions alcohol incident H"),
    (r"\balcohol incident.*conseq\b", "separation conditions H administrative"),
    (r"\bdrug abuse.*separat\b", "misconduct controlled substance Q separation"),
    (r"\bseparat.*drug abuse\b", "misconduct controlled substance Q separation"),
    (r"\barticle 31\b", "rights warning DI drug incident legal rights"),
    (r"\b31\(b\)\b", "rights warning suspected UCMJ violation"),
    (r"\bconvicted.*civilian court\b", "arrested civil authorities 1.B commanding officer"),
    (r"\bcivilian court.*convicted\b", "arrested civil authorities 1.B commanding officer"),
    (r"\bvoluntary.*separat.*lieu\b", "SILO separation lieu orders V disposition"),
    (r"\bseparat.*lieu.*board\b", "SILO separation lieu orders V disposition"),
)


def expand(query: Column, rules: tuple[tuple[str, str], ...] = EXPANSIONS) -> Column:
    """The query with the words of the first rule that it matches."""
    out = None
    for pattern, words in rules:
        hit, value = query.rlike(f"(?i){pattern}"), F.concat(query, F.lit(f" {words}"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return query if out is None else out.otherwise(query)


def detect_article(query: Column) -> Column:
    """The article that a query names, in lower case, or null."""
    found = [F.regexp_extract(query, p, 1) for p in (r"(?i)\bArticle\s+(\d{1,3}[a-z]?)\b", r"(?i)\bArt\.?\s*(\d{1,3}[a-z]?)\b")]
    return F.lower(F.coalesce(*(F.when(f != "", f) for f in found)))


def article_key(stored: Column) -> Column:
    return F.trim(strip_zeros(F.coalesce(stored, F.lit(""))))


def article_matches(stored: Column, target: Column) -> Column:
    """One is a prefix of the other; nothing matches an empty one. So 12 matches 120 to 129."""
    return (stored != "") & target.isNotNull() & (stored.startswith(target) | target.startswith(stored))


def inject(bm25: DataFrame, articles: DataFrame, targets: DataFrame, mode: str = "compat") -> DataFrame:
    """The keyword ranking with the named article's chunks moved to its front.

    bm25(query_id, chunk_id, score, rank), articles(chunk_id, article), targets(query_id, target). With ``compat``,
    chunks that are missing from the ranking go first and those in it keep their place; only if all are in it do
    they move to the front. With ``all``, all of them go first. Injected chunks are ordered by id and score 9999.
    """
    # spellings of articles and targets are few; chunks and queries then join on equal ones
    asked = targets.where("target is not null").select("target").distinct()
    match = articles.select("article").distinct().join(asked, article_matches(F.col("article"), F.col("target")))
    pairs = articles.join(match, "article").join(targets, "target").select("query_id", "chunk_id", F.lit(True).alias("named"))
    both = bm25.join(pairs, ["query_id", "chunk_id"], "full_outer")
    some_missing = F.max(F.col("named") & F.col("rank").isNull()).over(Window.partitionBy("query_id"))
    named = F.coalesce(F.col("named"), F.lit(False))
    missing = named & F.col("rank").isNull()
    front = missing | named if mode == "all" else missing | (named & ~F.coalesce(some_missing, F.lit(False)))
    order = Window.partitionBy("query_id").orderBy(F.desc("front"), F.col("rank").asc_nulls_first(), "chunk_id")
    out = both.withColumn("front", front).withColumn("rank", F.row_number().over(order))
    return out.select("query_id", "chunk_id", F.when(missing_score(), 9999.0).otherwise(F.col("score")).alias("score"), "rank")


def missing_score() -> Column:
    return F.col("score").isNull()


def fuse(dense: DataFrame, bm25: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, chunk_id, rrf_score, score, dense_rank, bm25_rank, rank) by reciprocal ranks.

    Ties go to the better dense rank, then to the better keyword rank. score is the dense one, 0 without.
    """
    d = dense.select("query_id", "chunk_id", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    b = bm25.select("query_id", "chunk_id", F.col("rank").alias("bm25_rank"))
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    both = d.join(b, ["query_id", "chunk_id"], "full_outer").withColumn("rrf_score", F.round(part("dense_rank") + part("bm25_rank"), 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), F.col("dense_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last(), "chunk_id")
    return both.select("query_id", "chunk_id", "rrf_score", F.coalesce("dense_score", F.lit(0.0)).alias("score"), "dense_rank", "bm25_rank", F.row_number().over(order).alias("rank"))


def filtered(ranked: DataFrame, articles: DataFrame, targets: DataFrame, k: int, exact: bool = False, label: str = "hybrid") -> DataFrame:
    """The k best of the query's article, from the whole ranking; without any, or without a target, the k best of all.

    Adds mode: <label>_filtered, _fallback or _unfiltered. ``exact`` wants equal articles instead of prefixes.
    """
    match = (F.col("article") == F.col("target")) & (F.col("article") != "") if exact else article_matches(F.col("article"), F.col("target"))
    rows = ranked.join(articles, "chunk_id").join(targets, "query_id", "left").withColumn("hit", F.coalesce(match, F.lit(False)))
    any_hit = F.max("hit").over(Window.partitionBy("query_id"))
    rows = rows.withColumn("any_hit", any_hit).where(F.col("hit") | ~F.col("any_hit"))
    order = Window.partitionBy("query_id").orderBy("rank", "chunk_id")
    mode = F.when(F.col("target").isNull(), f"{label}_unfiltered").when(F.col("any_hit"), f"{label}_filtered").otherwise(f"{label}_fallback")
    return rows.withColumn("mode", mode).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("hit", "any_hit", "article", "target")


def low_confidence(dense: DataFrame, threshold: float = LOW_CONFIDENCE) -> DataFrame:
    """(query_id, top_score, low_confidence)."""
    top = dense.groupBy("query_id").agg(F.max("score").alias("top_score"))
    return top.withColumn("low_confidence", F.col("top_score") < threshold)


def pool_size(k: int, kind: str = "hybrid") -> int:
    """Rows that are ranked before a filter: hybrid 20 k but 200 at least; cli 15 k; plain 20 k; chat as hybrid; rerank 3 k; rerank_once 3 k but 20 at least."""
    return {"hybrid": max(20 * k, 200), "chat": max(20 * k, 200), "cli": 15 * k, "plain": 20 * k, "rerank": 3 * k, "rerank_once": max(3 * k, 20)}[kind]


def rerank(candidates: DataFrame, scorer: Column, k: int) -> DataFrame:
    """The k best by ``scorer``, a column over the candidate's query and passage; adds ce_score and rank anew."""
    return top_k(candidates.drop("rank").withColumn("ce_score", scorer), k, "ce_score")


def passage(heading: Column, text: Column) -> Column:
    """What a pair scorer reads: the breadcrumb, a blank line, and the text."""
    path = F.array_join(heading, " > ")
    return F.when(path != "", F.concat(path, F.lit("\n\n"), F.trim(text))).otherwise(F.trim(text))


def heading_from_json(c: Column) -> Column:
    return F.from_json(c, "array<string>")


def overlap_score(query: Column, text: Column) -> Column:
    """Stand-in for a trained pair scorer: share of the query's distinct terms that the passage has."""
    from corvane.functions.text import tokens

    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) > 0, F.round(F.size(F.array_intersect(q, tokens(text))) / F.size(q), 6)).otherwise(0.0)
