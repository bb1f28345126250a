"""Registered queries over the test tables, each with its SQL counterpart or None where SQL can't express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import bm25, chunking, dense, evaluation, passages, prompts, retrieval, segment
from corvane.plans import sql as Q
from corvane.plans.pipeline import Engine, ingest_chapters
from corvane.schema import once, table
from corvane.sources import files
from corvane.storage import shared_folder

K = 8
Query = Callable[[SparkSession, str], DataFrame]
_REGISTERED: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _REGISTERED[f.__name__] = (f, sql)
        return f

    return register


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "chunks"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bench_questions").withColumnRenamed("id", "query_id")


def _per_chunk(spark: SparkSession, d: str, *columns: str | F.Column) -> DataFrame:
    """Columns made from each chunk's row, then each chunk_id once: texts themselves aren't shuffled."""
    return once(table(spark, d, "chunks").select("chunk_id", *columns))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return segment.clean_pages(table(spark, d, "source_pages"))


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ------------------------------------------------------------------ text functions


@query(_with(Q.CHUNKS) + f"SELECT chunk_id, {Q.estimate('text')} AS tokens, {Q.estimate('text')} IS DISTINCT FROM token_estimate AS stale FROM ch")
def t14_token_estimate(spark, d):
    e = T.token_estimate(F.col("text"))
    return _per_chunk(spark, d, e.alias("tokens"), (~e.eqNullSafe(F.col("token_estimate"))).alias("stale"))


@query(_with(Q.CHUNKS) + f"SELECT chunk_id, len({Q.tokens('text')}) AS n_terms, array_to_string({Q.tokens('text')}, ' ') AS terms FROM ch WHERE text IS NOT NULL")
def t15_tokens(spark, d):
    t = T.tokens(F.col("text"))
    return once(table(spark, d, "chunks").where("text is not null").select("chunk_id", F.size(t).alias("n_terms"), F.array_join(t, " ").alias("terms")))


@query(_with(Q.CHUNKS) + "SELECT chunk_id, left(md5(text), 8) AS hash, left(md5(text), 8) IS DISTINCT FROM content_hash AS stale FROM ch")
def t20_content_hash(spark, d):
    h = T.content_hash(F.col("text"))
    return _per_chunk(spark, d, h.alias("hash"), (~h.eqNullSafe(F.col("content_hash"))).alias("stale"))


@query(_with(Q.CHUNKS) + "SELECT chunk_id, trim(lower(ltrim(coalesce(article_number, ''), '0'))) AS article, CASE WHEN length(chapter_number) >= 2 THEN chapter_number ELSE lpad(chapter_number, 2, '0') END AS chapter FROM ch")
def t21_padded_ids(spark, d):
    return _per_chunk(spark, d, retrieval.article_key(F.col("article_number")).alias("article"), T.zero_pad(F.col("chapter_number"), 2).alias("chapter"))


_HEADER_SQL = "CASE WHEN doc LIKE 'dcm%' THEN 'DCH\\s+\\d{4}' ELSE 'HGINST\\s+M?\\d{4}\\.\\d[A-Z]?' END"


def _header() -> F.Column:
    """Running-header pattern of a page's book."""
    return F.when(F.col("doc").like("dcm%"), r"DCH\s+\d{4}").otherwise(r"HGINST\s+M?\d{4}\.\d[A-Z]?")


@query(
    "SELECT doc, page_num, "
    + Q.strip(Q.replace(Q.replace(f"regexp_replace(text, {_HEADER_SQL} || '\\s*\\n?', '', 'g')", r"(?m)(?:^|\n)(?:IV|\d{1,2})-\d{1,3}(?:\n|$)", "\n"), r"\n{3,}", "\n\n"))
    + " AS text FROM source_pages"
)
def t1_t2_t3_clean_pages(spark, d):
    return table(spark, d, "source_pages").select("doc", "page_num", T.clean_page(F.col("text"), _header()).alias("text"))


def _mend_sql(c: str) -> str:
    """Without lookbehind a step captures the character before; a step whose match may end with it is taken twice."""
    steps = (
        (r"(\d{1,2})-\n(\d{1,3})\n", "\n", 1),
        (r"(?m)(?:^|\n)\d{1,2}-\d{1,3}(?:\n|$)", "\n", 1),
        (r"(?m)[^\S\n]+$", "", 1),
        (r"([A-Za-z])\n ([a-z])", r"\1 \2", 2),
        (r"(\s)([b-hj-z])\n([a-z])", r"\1\2\3", 1),
        (r"([\s.(\[])([A-Z])\n([a-z])", r"\1\2\3", 1),
        (r"\n([a-z])\n", r"\1", 1),
        (r"([\s.)])([A-Z]) ([a-z]{2,})", r"\1\2\3", 1),
        (r"([a-zA-Z]) \.", r"\1.", 1),
        (r"\n{2,}", "\n", 1),
        (r"  +", " ", 1),
    )
    for pattern, by, times in steps:
        for _ in range(times):
            c = Q.replace(c, pattern, by)
    return c


@query(f"SELECT doc, page_num, {_mend_sql('text')} AS text FROM source_pages")
def t4_mended_words(spark, d):
    return table(spark, d, "source_pages").select("doc", "page_num", T.mend_split_words(F.col("text")).alias("text"))


def _ocr_sql(c: str) -> str:
    fixed = c
    for pattern, by in T.OCR_RULES:
        fixed = Q.replace(fixed, pattern, by)
    return Q.replace(f"(CASE WHEN page_num = 40 THEN {fixed} ELSE {c} END)", T.REDACTION, " ")


@query(f"SELECT doc, page_num, {_ocr_sql('text')} AS text FROM source_pages")
def t5_t6_ocr_and_redactions(spark, d):
    return table(spark, d, "source_pages").select("doc", "page_num", T.ocr_repair(F.col("text"), F.col("page_num")).alias("text"))


@query(
    _with(Q.PAGES, Q.LINES)
    + """, cap AS (SELECT *, lead(line) OVER (PARTITION BY doc, chapter, page_num ORDER BY line_no) AS nxt, regexp_matches(line, '^[A-Z]\\.\\s+[A-Z][^.]*$') AS opens FROM ln)
SELECT doc, page_num, line_no, line || ' ' || trim(nxt) AS heading FROM cap WHERE opens AND nxt IS NOT NULL AND regexp_matches(nxt, '^[A-Za-z][^.]{0,60}$') AND NOT regexp_matches(nxt, '^[A-Z]\\.\\s')"""
)
def t7_wrapped_headings(spark, d):
    w = Window.partitionBy("doc", "chapter", "page_num").orderBy("line_no")
    rows = segment.lines(_pages(spark, d)).withColumn("nxt", F.lead("line").over(w))
    hit = F.col("line").rlike(r"^[A-Z]\.\s+[A-Z][^.]*$") & F.col("nxt").rlike("^[A-Za-z][^.]{0,60}$") & ~F.col("nxt").rlike(r"^[A-Z]\.\s")
    return rows.where(hit).select("doc", "page_num", "line_no", F.concat("line", F.lit(" "), F.trim("nxt")).alias("heading"))


def _section_title_sql(c: str) -> str:
    c = Q.replace(Q.strip(c), r"\s*\n\s*", " ")
    c = Q.replace(Q.replace(c, r"-([A-Z]) ([A-Z])", r"-\1\2"), r"([A-Z]{2,}) ([B-HJ-Z]) ([A-Z]{2,})", r"\1\2 \3")
    s = f"string_split({Q.replace(c, r'\s*\.$', '')}, '')"
    c = f"array_to_string(list_transform({s}, lambda x, i: CASE WHEN i > 1 AND regexp_full_match({s}[i - 1], '\\p{{L}}') THEN lower(x) ELSE upper(x) END), '')"
    kept = "As|Or|Of|At|To|In|An|By|My|Is|If|On|Up|Do|So|No|He|We|Be|It|Am|Us|Me|Vs|Re|Ex"
    c = Q.replace(Q.replace(c, rf"\b({kept}) ", "\\1\x03"), r"\b([A-Z][a-z]) ([A-Z])([a-z]+)", "\\1\x01\\2\x02\\3")
    parts = f"string_split(replace({c}, chr(3), ' '), chr(1))"
    return Q.strip(f"array_to_string(list_transform({parts}, lambda p: CASE WHEN contains(p, chr(2)) THEN lower(left(p, 1)) || replace(substr(p, 2), chr(2), '') ELSE p END), '')")


@query(_with(Q.CHUNKS) + f"SELECT chunk_id, {_section_title_sql('upper(section_title)')} AS title FROM ch WHERE section_title IS NOT NULL")
def t8_section_titles(spark, d):
    return once(table(spark, d, "chunks").where("section_title is not null").select("chunk_id", T.section_title(F.upper("section_title")).alias("title")))


@query(
    _with(Q.CHUNKS)
    + f"""SELECT chunk_id, {Q.strip("CASE WHEN p > 0 THEN left(t, 5 + p - 1) ELSE t END")} AS title FROM (SELECT chunk_id, left(text, 200) AS t,
length(regexp_extract(substr(left(text, 200), 6), '^([\\s\\S]*?)\\.(?:\\s|$)', 1)) + CASE WHEN regexp_matches(substr(left(text, 200), 6), '\\.(?:\\s|$)') THEN 1 ELSE -9999 END AS p FROM ch WHERE text IS NOT NULL)"""
)
def t9_first_sentence(spark, d):
    return once(table(spark, d, "chunks").where("text is not null").select("chunk_id", T.first_sentence(F.left("text", F.lit(200))).alias("title")))


@query(
    _with(Q.CHUNKS)
    + f"""SELECT chunk_id, {Q.strip("CASE WHEN rest LIKE '%.%' AND regexp_matches(rest, '\\.(?:\\s|$)') THEN left(text, 5 + length(regexp_extract(rest, '^([\\s\\S]*?)\\.(?:\\s|$)', 1))) ELSE text END")} AS title FROM (SELECT chunk_id, text, substr(text, 6) AS rest FROM ch WHERE text IS NOT NULL)"""
)
def t9_whole_first_sentence(spark, d):
    """The first sentence of the whole text, however long it is."""
    return once(table(spark, d, "chunks").where("text is not null").select("chunk_id", T.first_sentence(F.col("text")).alias("title")))


@query(_with(Q.CHUNKS) + f"SELECT chunk_id, {Q.clean('text', T.ARTIFACT_A)} AS text_a, {Q.clean('text', T.ARTIFACT_B)} AS text_b FROM ch")
def t10_clean_text(spark, d):
    return _per_chunk(spark, d, T.clean_text(F.col("text"), T.ARTIFACT_A).alias("text_a"), T.clean_text(F.col("text"), T.ARTIFACT_B).alias("text_b"))


@query(_with(Q.CHUNKS) + f"SELECT chunk_id, {Q.strip(Q.keep_lines(Q.join_hyphens('text'), T.WS + '*'))} AS text FROM ch")
def t11_compact_text(spark, d):
    return _per_chunk(spark, d, T.compact_text(F.col("text")).alias("text"))


@query(_with(Q.CHUNKS) + "SELECT chunk_id, " + Q.replace(Q.replace("text || chr(10) || chr(10) || '[…]' || chr(10) || chr(10) || '<<<PAGE:7>>>'", r"\n\n\[(?:…|\.{2,})\]\n\n", "\n\n"), r"<<<PAGE:\d+>>>", "") + " AS text FROM ch")
def t12_t13_marks(spark, d):
    marked = F.concat("text", F.lit("\n\n[…]\n\n<<<PAGE:7>>>"))
    return _per_chunk(spark, d, T.drop_page_marks(T.drop_overlap_marks(marked)).alias("text"))


@query(
    _with(Q.CHUNKS)
    + f"""SELECT chunk_id, string_agg(CASE WHEN s = '' THEN '' ELSE repeat(' ', (CASE WHEN lvl IS NOT NULL THEN lvl WHEN coalesce(carried, 0) > 0 THEN carried + 2 ELSE 0 END)::INT) || s END, chr(10) ORDER BY i) AS text
FROM (SELECT *, last_value(lvl IGNORE NULLS) OVER (PARTITION BY chunk_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS carried FROM (SELECT *, CASE WHEN regexp_matches(s, '^[a-e]\\.\\s') THEN 0 WHEN regexp_matches(s, '^\\(\\d{{1,2}}\\)\\s') THEN 4 WHEN regexp_matches(s, '^\\([a-z]\\)\\s') THEN 8
WHEN regexp_matches(s, '(?i)^\\((?:i{{1,3}}|iv|vi{{0,3}}|ix|xi{{0,3}})\\)\\s') THEN 12 WHEN regexp_matches(s, '(?i)^\\[Note:') THEN 4 END AS lvl
FROM (SELECT chunk_id, i, {Q.strip("line")} AS s FROM (SELECT chunk_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM ch WHERE text IS NOT NULL)))) GROUP BY chunk_id"""
)
def t16_outline(spark, d):
    return once(table(spark, d, "chunks").where("text is not null").select("chunk_id", T.outline(F.col("text")).alias("text")))


def _excerpt_sql(name: str, artifact: str, limit: int, elements_first: bool) -> str:
    """CTEs ending in <name>(chunk_id, excerpt): a row for each line, and windows over them."""
    n, keyword = name, "(?i)\\b(?:" + "|".join(T.KEYWORDS) + ")\\b"
    opens = r"(regexp_full_match(line, '(?i)\s*(?:[a-z]\.)?\s*Elements?\.?\s*') OR length(line) < 80 AND regexp_matches(line, '(?i)\bElements?\.'))" if elements_first else "false"
    return f"""{n}_0 AS (SELECT chunk_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM ch WHERE text IS NOT NULL),
{n}_1 AS (SELECT *, row_number() OVER w AS i, sum(length(line) + 1) OVER w AS upto, len(regexp_extract_all(line, {Q.quote(keyword)})) AS hits, {opens} AS opens FROM {n}_0 WHERE {Q.strip("line")} <> '' AND NOT regexp_full_match(line, {Q.quote(artifact)}) WINDOW w AS (PARTITION BY chunk_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
{n}_2 AS (SELECT chunk_id, coalesce(min(i) FILTER (opens), min(i) FILTER (hits = top)) AS o, max(upto) - 1 AS whole FROM (SELECT *, max(hits) OVER (PARTITION BY chunk_id) AS top FROM {n}_1) GROUP BY chunk_id),
{n}_3 AS (SELECT chunk_id, any_value(o) AS o, any_value(whole) AS whole, max(upto - length(line) - 1) FILTER (i = o) AS start FROM {n}_1 JOIN {n}_2 USING (chunk_id) GROUP BY chunk_id),
{n}_4 AS (SELECT chunk_id, any_value(o) AS o, any_value(whole) AS whole, any_value(start) AS start, max(upto) FILTER (i = o OR i > o AND upto <= start + {limit}) AS stop FROM {n}_1 JOIN {n}_3 USING (chunk_id) GROUP BY chunk_id),
{n}_5 AS (SELECT chunk_id, any_value(whole) AS whole, string_agg(line, chr(10) ORDER BY i) AS lines, string_agg(line, chr(10) ORDER BY i) FILTER (upto <= stop AND (i >= o OR stop - start < {limit // 2} AND stop - (upto - length(line) - 1) <= {limit})) AS kept,
  sum(length(line) + 1) FILTER (upto <= stop AND (i >= o OR stop - start < {limit // 2} AND stop - (upto - length(line) - 1) <= {limit})) AS size FROM {n}_1 JOIN {n}_4 USING (chunk_id) GROUP BY chunk_id),
{n} AS (SELECT ch.chunk_id, CASE WHEN x.chunk_id IS NULL THEN left(text, {limit}) WHEN whole <= {limit} THEN lines ELSE {Q.strip("kept")} || CASE WHEN whole > size THEN ' …' ELSE '' END END AS excerpt FROM ch LEFT JOIN {n}_5 x USING (chunk_id) WHERE text IS NOT NULL)"""


@query(_with(Q.CHUNKS, _excerpt_sql("ea", T.ARTIFACT_A, 700, False), _excerpt_sql("eb", T.ARTIFACT_B, 800, True)) + "SELECT chunk_id, ea.excerpt, eb.excerpt AS elements_excerpt FROM ea JOIN eb USING (chunk_id)")
def t17_t18_excerpts(spark, d):
    c = F.col("text")
    return once(table(spark, d, "chunks").where("text is not null").select("chunk_id", T.excerpt(c).alias("excerpt"), T.excerpt(c, T.ARTIFACT_B, 800, True).alias("elements_excerpt")))


@query(_with(Q.CHUNKS) + "SELECT chunk_id, " + ", ".join(f"CASE WHEN length(text) > {n} THEN left(text, {n}) || '…' ELSE text END AS text_{n}" for n in (600, 1200, 2800)) + " FROM ch")
def t19_truncations(spark, d):
    return _per_chunk(spark, d, *[T.truncate(F.col("text"), n).alias(f"text_{n}") for n in (600, 1200, 2800)])


# ------------------------------------------------------------------ sources and segmentation


@query("SELECT source, count(*) AS n_chunks FROM (SELECT DISTINCT chunk_id, source FROM chunks) GROUP BY source")
def s6_source_counts(spark, d):
    return table(spark, d, "chunks").select("chunk_id", "source").distinct().groupBy("source").agg(F.count("*").alias("n_chunks"))


_KEPT = ("chunk_id", "source", "doc_path", "article_number", "section_number", "section_title", "chapter_number", "page_start", "chunk_index", "token_estimate", "text")


def _place(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/corvane-{uuid.uuid4().hex}"


@query(_with(Q.CHUNKS) + f"SELECT {', '.join(_KEPT)}, array_to_string(heading_path, '|') AS path FROM ch")
def s6_s7_k1_chunk_files(spark, d):
    """Chunks written as JSON lines and read back."""
    path = _place(spark)
    files.write_chunks(_chunks(spark, d).drop("ingested_at"), path)
    return files.read_chunks(spark, path).select(*_KEPT, F.array_join("heading_path", "|").alias("path"))


@query(_with(Q.CHUNKS, Q.bm25()) + "SELECT term, df, round(idf, 9) AS idf, (SELECT count(*) FROM ch) AS n_vectors FROM ti")
def s8_s9_k2_k3_saved_index(spark, d):
    """The term weights and the vectors of an index that was saved and loaded."""
    path = _place(spark)
    Engine.build(table(spark, d, "chunks")).save(path)
    engine = Engine.load(spark, path)
    return engine.index.term_idf.select("term", "df", F.round("idf", 9).alias("idf")).crossJoin(engine.vectors.agg(F.count("*").alias("n_vectors")))  # one row


@query(_with(Q.PAGES) + "SELECT doc, min(page_num) AS first_page, max(page_num) AS last_page FROM (SELECT *, min(CASE WHEN page_num > first_page + 10 AND regexp_matches(text, 'IV-99\\d') THEN page_num END) OVER (PARTITION BY doc) AS stop FROM (SELECT *, min(CASE WHEN contains(text, 'Article') AND contains(text, 'the') THEN page_num END) OVER (PARTITION BY doc) AS first_page FROM pg) WHERE page_num >= first_page) WHERE (stop IS NULL OR page_num < stop) AND (page_num = first_page OR regexp_matches(text, 'Article')) GROUP BY doc")
def s3_page_range(spark, d):
    r = segment.detect_range(_pages(spark, d), ("Article", "the"), "Article", r"IV-99\d", lo=1, hi=1 << 30)
    return r.select("doc", "first_page", "last_page")


@query(_with(Q.PAGES, "rg AS (SELECT doc, chapter, min(page_num) + 1 AS first_page, max(page_num) - 1 AS last_page FROM pg GROUP BY doc, chapter)") + "SELECT pg.doc, rg.chapter, pg.page_num FROM pg JOIN rg ON pg.doc = rg.doc AND pg.page_num BETWEEN rg.first_page AND rg.last_page WHERE NOT coalesce(pg.is_exhibit, false)")
def s4_pages_in_ranges(spark, d):
    p = _pages(spark, d)
    ranges = p.groupBy("doc", "chapter").agg((F.min("page_num") + 1).alias("first_page"), (F.max("page_num") - 1).alias("last_page"))
    return segment.in_ranges(p, ranges, p.where("is_exhibit").select("doc", "page_num")).select("doc", "chapter", "page_num")


@query(_with(Q.PAGES) + f"SELECT doc, page_num, regexp_matches(text, '(?i)\\bEXHIBIT\\b|Exhibit\\s+[(\\d]') AND NOT regexp_matches(text, '(?m)^[A-Z]\\.\\s{{2,}}[A-Z]') AND len({Q.words('text')}) < 400 AS exhibit FROM pg")
def s5_exhibits(spark, d):
    return _pages(spark, d).select("doc", "page_num", segment.exhibit(F.col("text")).alias("exhibit"))


@query(_with(Q.PAGES, Q.LINES) + 'SELECT doc, chapter, page_num, "offset" FROM off')
def c1_page_offsets(spark, d):
    return segment.offsets(_pages(spark, d)).select("doc", "chapter", "page_num", "offset")


@query(_with(Q.PAGES, Q.LINES) + "SELECT DISTINCT doc, chapter, pos, page_num AS page FROM ln WHERE regexp_matches(line, '^[A-Z0-9]')")
def c2_page_of_offset(spark, d):
    p = _pages(spark, d)
    points = segment.lines(p).where(F.col("line").rlike("^[A-Z0-9]")).select("doc", "chapter", "pos")
    return segment.page_at(points, p)


def _split(name: str, where: str) -> tuple[Query, str]:
    rule = segment.HEADINGS[name]
    sql = _with(Q.PAGES.replace("WHERE", f"WHERE {where} AND"), Q.LINES, Q.sections(rule.pattern, rule.keep == "all", rule.prefer, rule.least, rule.preamble)) + "SELECT * FROM sec"

    def run(spark, d):
        return segment.sections(_pages(spark, d).where(where), rule)

    return run, sql


for _name, _key, _where in (("c3_articles", "article", "doc LIKE 'dcm%'"), ("c5_numbered", "numbered", "doc LIKE 'hgcm%'"), ("c6_definitions", "definition", "doc LIKE 'hgcm%'"), ("c7_capitals", "capitals", "doc LIKE 'hgim%'"), ("c8_letters", "letters", "doc LIKE 'hgsep%'"), ("c9_sentences", "sentence", "doc LIKE 'hgsa%'"), ("c10_c11_sections", "section", "doc LIKE 'hgmj%'")):
    _REGISTERED[_name] = _split(_key, _where)


@query(
    _with(Q.CHUNKS, Q.PAGES.replace("WHERE", "WHERE doc LIKE 'dcm%' AND"), Q.LINES, Q.sections(*(lambda r: (r.pattern, False, r.prefer, r.least, False))(segment.HEADINGS["article"])), "ti AS (SELECT article_number AS key, max(article_title) AS better FROM ch WHERE article_title IS NOT NULL GROUP BY article_number)")
    + "SELECT doc, sec.key, coalesce(ti.better, sec.title) AS title, page_start FROM sec LEFT JOIN ti ON sec.key = ti.key"
)
def c4_title_override(spark, d):
    titles = _chunks(spark, d).where("article_title is not null").groupBy(F.col("article_number").alias("key")).agg(F.max("article_title").alias("better_title"))
    return segment.sections(_pages(spark, d).where("doc like 'dcm%'"), segment.HEADINGS["article"], titles).select("doc", "key", "title", "page_start")


def _paragraph_sql(start: str) -> str:
    return (
        _with(Q.CHUNKS)
        + f""", bl AS (SELECT chunk_id, unnest(string_split_regex(text, '\\n{{2,}}')) AS t, generate_subscripts(string_split_regex(text, '\\n{{2,}}'), 1) - 1 AS block FROM ch WHERE text IS NOT NULL),
li AS (SELECT chunk_id, block, len(string_split(t, chr(10))) <= 2 AS whole, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS line_no FROM bl),
gr AS (SELECT *, sum(CASE WHEN line_no > 0 AND NOT whole AND regexp_matches(line, {Q.quote(start)}) THEN 1 ELSE 0 END) OVER (PARTITION BY chunk_id, block ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS paragraph FROM li),
pa AS (SELECT chunk_id, block, paragraph, {Q.strip("string_agg(line, chr(10) ORDER BY line_no)")} AS text FROM gr GROUP BY ALL)
SELECT * FROM pa WHERE text <> ''"""
    )


@query(_paragraph_sql(segment.PARAGRAPH_STARTS["article"]).replace(")\n, bl", "),\nbl"))
def c12_paragraphs(spark, d):
    rows = _chunks(spark, d).where("text is not null")
    return segment.paragraphs(rows, "chunk_id", "text", segment.PARAGRAPH_STARTS["article"])


@query(_with(Q.CHUNKS) + "SELECT chunk_id, i - 1 AS sentence, s AS text FROM (SELECT chunk_id, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM (SELECT chunk_id, string_split_regex(" + Q.replace("text", r"([.;])\s+", "\\1\x01") + ", chr(1)) AS x FROM ch WHERE text IS NOT NULL)) ")
def c13_sentences(spark, d):
    return _chunks(spark, d).where("text is not null").select("chunk_id", F.posexplode(F.split("text", r"(?<=[.;])\s+", -1)).alias("sentence", "text"))


@query(None)
def c14_c15_article_chunks(spark, d):
    s = segment.sections(_pages(spark, d).where("doc like 'dcm%'"), segment.HEADINGS["article"])
    return chunking.article_chunks(s)


@query(None)
def c14_c16_c18_chapter_chunks(spark, d):
    return ingest_chapters(table(spark, d, "source_pages"), "book")


@query(
    _with(Q.CHUNKS)
    + "SELECT chunk_id, CASE WHEN prev IS NULL THEN text ELSE right(prev, 400) || chr(10) || chr(10) || text END AS text FROM (SELECT chunk_id, text, lag(text) OVER (PARTITION BY doc_path, article_number ORDER BY chunk_index, chunk_id) AS prev FROM ch WHERE article_number IS NOT NULL AND text IS NOT NULL)"
)
def c15_overlap(spark, d):
    w = Window.partitionBy("doc_path", "article_number").orderBy("chunk_index", "chunk_id")
    rows = _chunks(spark, d).where("article_number is not null and text is not null").withColumn("prev", F.lag("text").over(w))
    return rows.select("chunk_id", F.when(F.col("prev").isNull(), F.col("text")).otherwise(F.concat(F.right("prev", F.lit(400)), F.lit("\n\n"), F.col("text"))).alias("text"))


@query(_with(Q.CHUNKS) + f"SELECT chunk_id FROM ch WHERE {Q.estimate('text')} < 20")
def c17_small_chunks(spark, d):
    return once(table(spark, d, "chunks").where(T.token_estimate(F.col("text")) < 20).select("chunk_id"))


@query(_with(Q.CHUNKS) + "SELECT source, count(*) AS n_chunks, min(token_estimate) AS min_tokens, floor(avg(token_estimate))::BIGINT AS avg_tokens, max(token_estimate) AS max_tokens FROM ch GROUP BY source")
def c19_chunk_statistics(spark, d):
    return chunking.statistics(_per_chunk(spark, d, "source", "token_estimate"))


@query(_with(Q.CHUNKS) + "SELECT source, chunk_id FROM (SELECT source, chunk_id, row_number() OVER (PARTITION BY source ORDER BY chunk_id) AS n, count(*) OVER (PARTITION BY source) AS c FROM ch) WHERE n = c // 2 + 1")
def c19_middle_chunk(spark, d):
    rows = _chunks(spark, d).select("source", "chunk_id")
    counts = rows.groupBy("source").agg(F.count("*").alias("c"))
    w = Window.partitionBy("source").orderBy("chunk_id")
    return rows.withColumn("n", F.row_number().over(w)).join(counts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).where(F.col("n") == F.floor(F.col("c") / 2) + 1).select("source", "chunk_id")


@query(_with(Q.CHUNKS) + "SELECT article, row_number() OVER (ORDER BY regexp_replace(article, '[^0-9]', '', 'g')::INT, article) AS place FROM (SELECT DISTINCT trim(lower(ltrim(article_number, '0'))) AS article FROM ch WHERE article_number IS NOT NULL)")
def c20_article_order(spark, d):
    rows = table(spark, d, "chunks").where("article_number is not null").select(retrieval.article_key(F.col("article_number")).alias("article")).distinct()
    return rows.select("article", F.row_number().over(Window.orderBy(F.regexp_replace("article", "[^0-9]", "").cast("int"), "article")).alias("place"))  # articles of a code are few


# ------------------------------------------------------------------ index


@query(
    _with(Q.CHUNKS)
    + "SELECT chunk_id, CASE WHEN prefix <> '' THEN prefix || chr(10) || chr(10) || text ELSE text END AS embedding_text FROM (SELECT chunk_id, text, coalesce(nullif(array_to_string(heading_path, ' > '), ''), concat_ws(' > ', nullif(chapter_title, ''), coalesce(nullif(section_title, ''), nullif(article_title, '')))) AS prefix FROM ch)"
)
def i1_embedding_text(spark, d):
    c = F.col
    return _per_chunk(spark, d, dense.embedding_text(c("heading_path"), c("chapter_title"), c("section_title"), c("article_title"), c("text")).alias("embedding_text"))


@query("SELECT count(*) AS n_vectors, count(*) FILTER (abs(n - 1) > 1e-4) AS n_off, round(min(n), 6) AS min_norm, round(max(n), 6) AS max_norm FROM (SELECT sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)")
def i2_norm_audit(spark, d):
    return dense.norm_audit(table(spark, d, "embeddings"), "embedding")


@query(
    _with(Q.CHUNKS, f"docs AS (SELECT chunk_id, coalesce({Q.tokens('text')}, []) AS terms FROM ch)", "b AS (SELECT chunk_id, (('0x' || substr(md5(term), 1, 4))::INT % 64) AS bucket, count(*)::DOUBLE AS v FROM (SELECT chunk_id, unnest(terms) AS term FROM docs) GROUP BY ALL)")
    + "SELECT chunk_id, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY chunk_id)), 6) AS value FROM b"
)
def i2_text_vectors(spark, d):
    v = once(dense.embed(table(spark, d, "chunks"), "chunk_id", F.col("text")))
    return v.select("chunk_id", F.posexplode("vector").alias("bucket", "value")).where("value > 0").select("chunk_id", "bucket", F.round("value", 6).alias("value"))


@query(_with(Q.CHUNKS, Q.bm25()) + "SELECT term, df, round(idf, 9) AS idf FROM ti")
def i4_term_weights(spark, d):
    return bm25.build(table(spark, d, "chunks")).term_idf.select("term", "df", F.round("idf", 9).alias("idf"))


@query(_with(Q.CHUNKS, Q.bm25()) + "SELECT term, chunk_id, tf FROM post")
def i4_postings(spark, d):
    return bm25.build(table(spark, d, "chunks")).postings.select("term", "chunk_id", F.col("tf").cast("bigint").alias("tf"))


@query(_with(Q.CHUNKS, Q.bm25()) + "SELECT n, round(avgdl, 9) AS avgdl FROM st")
def i4_corpus_statistics(spark, d):
    return bm25.build(table(spark, d, "chunks")).stats.select("n", F.round("avgdl", 9).alias("avgdl"))


# ------------------------------------------------------------------ retrieval


def _bm25(spark, d, k: int, expanded: bool = True) -> DataFrame:
    q = _questions(spark, d)
    text = retrieval.expand(F.col("query")) if expanded else F.col("query")
    return bm25.search(table(spark, d, "chunks"), q.select("query_id", text.alias("query")), k)


def _dense(spark, d, k: int) -> DataFrame:
    vectors = once(dense.embed(table(spark, d, "chunks"), "chunk_id", F.col("text")))
    return dense.search(vectors, dense.embed(_questions(spark, d), "query_id", F.col("query")), k)


def _articles(spark, d) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", retrieval.article_key(F.col("article_number")).alias("article")).distinct()


def _targets(spark, d) -> DataFrame:
    t = retrieval.article_key(retrieval.detect_article(F.col("query")))
    return _questions(spark, d).select("query_id", F.when(t != "", t).alias("target"))


@query(_with(Q.CHUNKS, Q.bm25()) + "SELECT * FROM bm25")
def bm25_topk(spark, d):
    return _bm25(spark, d, K, expanded=False)


@query(
    "WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id AS chunk_id, round(list_sum(list_transform(list_zip(e, embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) AS score FROM q, embeddings) "
    "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 8"
)
def r3_dense_topk(spark, d):
    e = table(spark, d, "embeddings")
    return dense.search(e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), K)


@query(_with(Q.CHUNKS, Q.bm25()) + "SELECT * FROM bm25")
def r4_index_scoring(spark, d):
    """The same ranking from the index tables, as a stored index is searched."""
    q = _questions(spark, d).select("query_id", "query")
    return bm25.search_index(bm25.build(table(spark, d, "chunks")), q, K)


@query(_with(Q.CHUNKS, Q.bm25(Q.expand("query"), 200)) + "SELECT * FROM bm25")
def r4_bm25_pool(spark, d):
    return _bm25(spark, d, retrieval.pool_size(K))


@query(f"SELECT id AS query_id, {Q.expand('query')} AS query, {Q.expand('notes')} AS notes FROM (SELECT id, query, gold.notes AS notes FROM bench_questions)")
def r5_expansion(spark, d):
    return _questions(spark, d).select("query_id", retrieval.expand(F.col("query")).alias("query"), retrieval.expand(F.col("gold.notes")).alias("notes"))


@query(f"SELECT id AS query_id, {Q.article('query')} AS article FROM bench_questions")
def r6_detect_article(spark, d):
    return _questions(spark, d).select("query_id", retrieval.detect_article(F.col("query")).alias("article"))


@query(_with(Q.CHUNKS, Q.targets()) + f"SELECT t.query_id, count(*) FILTER ({Q.MATCH}) AS n_prefix, count(*) FILTER (a.article = t.target) AS n_exact FROM targets t CROSS JOIN (SELECT DISTINCT article FROM articles) a GROUP BY t.query_id")
def r7_r8_article_match(spark, d):
    targets = _targets(spark, d)
    match = targets.select("target").distinct().join(_articles(spark, d).select("article").distinct(), retrieval.article_matches(F.col("article"), F.col("target")))
    counts = match.groupBy("target").agg(F.count("*").alias("n_prefix"), F.count_if(F.col("article") == F.col("target")).alias("n_exact"))
    return targets.join(counts, "target", "left").select("query_id", F.coalesce("n_prefix", F.lit(0)).alias("n_prefix"), F.coalesce("n_exact", F.lit(0)).alias("n_exact"))


@query(_with(Q.CHUNKS, Q.bm25(Q.expand("query"), 200), Q.targets(), Q.INJECT) + "SELECT * FROM injected")
def r9_injection(spark, d):
    return retrieval.inject(_bm25(spark, d, retrieval.pool_size(K)), _articles(spark, d), _targets(spark, d))


def _fused(spark, d) -> DataFrame:
    pool = retrieval.pool_size(K)
    keyword = retrieval.inject(_bm25(spark, d, pool), _articles(spark, d), _targets(spark, d))
    return retrieval.fuse(_dense(spark, d, pool), keyword)


_FUSED = (Q.CHUNKS, Q.bm25(Q.expand("query"), 200), Q.targets(), Q.INJECT, Q.dense(200), Q.FUSE)


@query(_with(*_FUSED) + "SELECT * FROM fused")
def r10_rank_fusion(spark, d):
    return _fused(spark, d)


@query(_with(*_FUSED, Q.filtered("fused", "hits", K)) + "SELECT query_id, chunk_id, rrf_score, score, mode, rank FROM hits")
def r11_r13_hybrid(spark, d):
    return retrieval.filtered(_fused(spark, d), _articles(spark, d), _targets(spark, d), K).select("query_id", "chunk_id", "rrf_score", "score", "mode", "rank")


@query(_with(Q.CHUNKS, Q.bm25(), Q.targets(), Q.dense(200), Q.filtered("dense", "pre", K, "dense"), Q.filtered("dense", "exact", K, "exact", True)) + "SELECT 'prefix' AS match, query_id, chunk_id, score, mode, rank FROM pre UNION ALL SELECT 'exact', query_id, chunk_id, score, mode, rank FROM exact")
def r14_r15_dense_filtered(spark, d):
    ranked, a, t = _dense(spark, d, retrieval.pool_size(K, "chat")), _articles(spark, d), _targets(spark, d)
    cols = ["match", "query_id", "chunk_id", "score", "mode", "rank"]
    return retrieval.filtered(ranked, a, t, K, label="dense").withColumn("match", F.lit("prefix")).select(cols).unionByName(retrieval.filtered(ranked, a, t, K, exact=True, label="exact").withColumn("match", F.lit("exact")).select(cols))


@query(_with(Q.CHUNKS, Q.bm25(), Q.dense(1)) + "SELECT query_id, max(score) AS top_score, max(score) < 0.65 AS low_confidence FROM dense GROUP BY query_id")
def r16_low_confidence(spark, d):
    return retrieval.low_confidence(_dense(spark, d, 1))


def _hits(spark, d, ranked: DataFrame) -> DataFrame:
    """Ranked rows with their chunks' columns; the ranked side is k rows a query, so it is broadcast if Spark finds it small."""
    return ranked.join(_chunks(spark, d), "chunk_id")


_SCORER = """cand AS (SELECT b.query_id, q.query, ch.chunk_id, CASE WHEN array_to_string(heading_path, ' > ') <> '' THEN array_to_string(heading_path, ' > ') || chr(10) || chr(10) || trim(text, ' ') ELSE trim(text, ' ') END AS passage FROM bm25 b JOIN bench_questions q ON q.id = b.query_id JOIN ch USING (chunk_id)),
ct AS (SELECT query_id, chunk_id, list_distinct(%s) AS q, %s AS p FROM cand),
ce AS (SELECT query_id, chunk_id, round(len(list_intersect(q, p)) / len(q), 6) AS ce_score FROM ct)""" % (Q.tokens("query"), Q.tokens("passage"))


@query(_with(Q.CHUNKS, Q.bm25("query", 24), _SCORER) + "SELECT query_id, chunk_id, ce_score, row_number() OVER (PARTITION BY query_id ORDER BY ce_score DESC, chunk_id) AS rank FROM ce QUALIFY rank <= 8")
def r17_r18_r19_rerank(spark, d):
    pool = _hits(spark, d, _bm25(spark, d, retrieval.pool_size(K, "rerank"), expanded=False)).join(_questions(spark, d).select("query_id", "query"), "query_id")
    passage = retrieval.passage(F.col("heading_path"), F.col("text"))
    return retrieval.rerank(pool.select("query_id", "chunk_id", "query", passage.alias("passage")), retrieval.overlap_score(F.col("query"), F.col("passage")), K).select("query_id", "chunk_id", "ce_score", "rank")


# ------------------------------------------------------------------ passages, citations and prompts


def _top_hits(spark, d) -> DataFrame:
    return _hits(spark, d, _bm25(spark, d, K, expanded=False))


def _key_sql(style: str) -> str:
    b = "coalesce(nullif(article_number, ''), nullif(section_number, ''), 'unknown')"
    return {"a": "coalesce(nullif(article_number, ''), 'unknown')", "b": b, "exact": f"coalesce(source, '') || '|' || coalesce(chapter_number, '') || '|' || {b}"}[style]


def _passage_sql(style: str) -> str:
    block = Q.clean("text", T.ARTIFACT_A if style == "a" else T.ARTIFACT_B)
    return f"""hk AS (SELECT bm25.query_id, bm25.score, bm25.rank, ch.*, {_key_sql(style)} AS key FROM bm25 JOIN ch USING (chunk_id)),
hn AS (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY coalesce(chunk_index, 0), rank) AS n, row_number() OVER (PARTITION BY query_id, key, content_hash ORDER BY coalesce(chunk_index, 0), rank) > 1 AND coalesce(content_hash, '') <> '' AS again FROM hk),
hb AS (SELECT *, CASE WHEN NOT again THEN coalesce({block}, '') END AS block FROM hn),
ps AS (SELECT query_id, key, min_by(source, n) FILTER (source IS NOT NULL) AS source, min(page_start) AS page_start, max(page_end) AS page_end, string_agg(chunk_id, ', ' ORDER BY n) AS chunk_ids, max(score) AS score, min(rank) AS met,
  {Q.strip(Q.replace(Q.replace("coalesce(string_agg(CASE WHEN block <> '' THEN block END, chr(10) || chr(10) ORDER BY n), '')", r"\n\n\[(?:…|\.{2,})\]\n\n", "\n\n"), r"\n{3,}", "\n\n"))} AS text FROM hb GROUP BY query_id, key)
SELECT query_id, key, source, page_start, page_end, chunk_ids, score, text, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, met) AS rank FROM ps"""


def _aggregate(style: str) -> Query:
    def run(spark, d):
        p = passages.aggregate(_top_hits(spark, d), style)
        return p.select("query_id", "key", "source", "page_start", "page_end", F.array_join("chunk_ids", ", ").alias("chunk_ids"), "score", "text", "rank")

    return run


for _name, _style in (("p_a_passages_by_article", "a"), ("p_b_passages_by_section", "b"), ("p_b_passages_exact", "exact")):
    _REGISTERED[_name] = (_aggregate(_style), _with(Q.CHUNKS, Q.bm25(), _passage_sql(_style)).rstrip())


_SAME = "(coalesce(article_number, '') <> '' AND article_number = lag(article_number) OVER w) OR (coalesce(section_number, '') <> '' AND section_number = lag(section_number) OVER w)"


@query(
    _with(Q.CHUNKS, Q.bm25(), f"st1 AS (SELECT bm25.query_id, bm25.rank AS r, bm25.score, ch.*, CASE WHEN coalesce({_SAME}, false) THEN 0 ELSE 1 END AS starts FROM bm25 JOIN ch USING (chunk_id) WINDOW w AS (PARTITION BY bm25.query_id ORDER BY bm25.rank))", "isl AS (SELECT *, sum(starts) OVER (PARTITION BY query_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS island FROM st1)")
    + "SELECT query_id, island AS rank, string_agg(chunk_id, ', ' ORDER BY r) AS chunk_ids, string_agg(text, chr(10) || chr(10) ORDER BY r) AS text, first(score ORDER BY r) AS score FROM isl GROUP BY query_id, island"
)
def p_c_adjacent_passages(spark, d):
    p = passages.merge_adjacent(_top_hits(spark, d))
    return p.select("query_id", "rank", F.array_join("chunk_ids", ", ").alias("chunk_ids"), "text", "score")


@query(None)
def p_citations(spark, d):
    hits = _top_hits(spark, d)
    a, b, c = passages.aggregate(hits, "a"), passages.aggregate(hits, "b"), passages.merge_adjacent(hits)
    rows = [p.select("query_id", "rank", F.lit(s).alias("style"), passages.citation(s).alias("citation")) for s, p in (("a", a), ("b", b), ("c", c))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(None)
def p_answers(spark, d):
    p = passages.aggregate(_top_hits(spark, d), "b")
    return passages.answers(p, T.outline(T.excerpt(F.col("text"), T.ARTIFACT_B, 800, True)), "b")


@query("SELECT model, CASE WHEN regexp_matches(f, 'mistral|llama|orca|vicuna|solar') THEN 'mistral' WHEN regexp_matches(f, 'phi-3|phi3|phi_3') THEN 'phi3' WHEN regexp_matches(f, 'hermes|qwen|chatml|nous') THEN 'chatml' ELSE 'raw' END AS kind FROM (SELECT DISTINCT doc_path || '/' || coalesce(section_title, 'phi-3') AS model, lower(coalesce(section_title, 'phi-3')) AS f FROM chunks)")
def p_prompt_formats(spark, d):
    rows = table(spark, d, "chunks").select(F.concat("doc_path", F.lit("/"), F.coalesce("section_title", F.lit("phi-3"))).alias("model")).distinct()
    return rows.select("model", prompts.prompt_format(F.col("model")).alias("kind"))


_KINDS = ("mistral", "phi3", "chatml", "raw")


def _wrap_sql() -> str:
    system, lf = Q.quote(prompts.SYSTEM), "chr(10)"
    user = f"'Passages:' || {lf} || gold.notes || {lf} || {lf} || 'Question: ' || query"
    return f"""SELECT id AS query_id, kind, CASE kind WHEN 'mistral' THEN '<s>[INST] ' || {system} || {lf} || {lf} || {user} || ' [/INST]'
WHEN 'phi3' THEN '<|system|>' || {lf} || {system} || '<|end|>' || {lf} || '<|user|>' || {lf} || {user} || '<|end|>' || {lf} || '<|assistant|>' || {lf}
WHEN 'chatml' THEN '<|im_start|>system' || {lf} || {system} || '<|im_end|>' || {lf} || '<|im_start|>user' || {lf} || {user} || '<|im_end|>' || {lf} || '<|im_start|>assistant' || {lf}
ELSE {system} || {lf} || {lf} || {user} END AS prompt FROM bench_questions, (SELECT unnest([{', '.join(map(Q.quote, _KINDS))}]) AS kind)"""


@query(_wrap_sql())
def p_prompt_wrapping(spark, d):
    """Each question with its notes as the passage, in all four formats."""
    rows = _questions(spark, d).select("query_id", prompts.user_prompt(F.col("query"), F.col("gold.notes")).alias("user"), F.explode(F.array(*map(F.lit, _KINDS))).alias("kind"))
    return rows.select("query_id", "kind", prompts.wrap(F.col("kind"), F.lit(prompts.SYSTEM), F.col("user")).alias("prompt"))


@query(None)
def p_guarded_answers(spark, d):
    """Prompts for every question, answered by the fallback, as no model is plugged in."""
    p = passages.merge_adjacent(_top_hits(spark, d))
    ctx = passages.context(p, 2800, 6).join(_questions(spark, d).select("query_id", "query"), "query_id")
    text = prompts.wrap(F.lit("chatml"), F.lit(prompts.SYSTEM), prompts.user_prompt(F.col("query"), F.col("context")))
    return prompts.generate(ctx.select("query_id", text.alias("prompt"), F.col("context").alias("fallback")), _no_model)


def _no_model():
    raise RuntimeError("no model is plugged in")


# ------------------------------------------------------------------ evaluation

_DETAIL = f"""hits AS (SELECT bm25.query_id, bm25.rank, bm25.score, ch.chunk_id, article_number, section_number, source FROM bm25 JOIN ch USING (chunk_id)),
rl AS (SELECT q.id AS query_id, c.rank, c.score, coalesce(c.chunk_id IS NOT NULL AND {Q.relevance()}, false) AS rel, coalesce(nullif(c.article_number, ''), c.section_number, '?') AS label FROM bench_questions q LEFT JOIN hits c ON c.query_id = q.id),
per AS (SELECT query_id, min(rank) FILTER (rel AND rank <= 8) AS first_rank, count(*) FILTER (rel AND rank <= 1) AS rel_1, count(*) FILTER (rel AND rank <= 3) AS rel_3, count(*) FILTER (rel AND rank <= 5) AS rel_5, count(*) FILTER (rel AND rank <= 8) AS rel_8,
  coalesce(max(score), 0) AS top_score, coalesce(string_agg(CASE WHEN rank <= 5 THEN label END, ', ' ORDER BY rank), '') AS top5, coalesce(1.0::DOUBLE / min(rank) FILTER (rel AND rank <= 8), 0) AS rr FROM rl GROUP BY query_id)"""
_METRICS = (
    "SELECT count(*) AS num_queries, avg(rr) AS mrr, " + ", ".join(f"avg((rel_{k} > 0)::INT) AS recall_at_{k}, avg(rel_{k} / {k}.0::DOUBLE) AS precision_at_{k}" for k in evaluation.KS) + " FROM per"
)


def _detail(spark, d) -> DataFrame:
    return evaluation.detail(_questions(spark, d), _top_hits(spark, d))


@query(_with(Q.CHUNKS, Q.bm25(), _DETAIL) + "SELECT query_id, first_rank, rel_1, rel_3, rel_5, rel_8, round(top_score, 6) AS top_score, top5, round(rr, 9) AS rr FROM per")
def e1_e2_e9_detail(spark, d):
    return _detail(spark, d).withColumns({"top_score": F.round("top_score", 6), "rr": F.round("rr", 9)})


@query(_with(Q.CHUNKS, Q.bm25(), _DETAIL, f"m AS ({_METRICS})") + "SELECT num_queries, round(mrr, 9) AS mrr, " + ", ".join(f"round(recall_at_{k}, 9) AS recall_at_{k}, round(precision_at_{k}, 9) AS precision_at_{k}, round(CASE WHEN recall_at_{k} + precision_at_{k} > 0 THEN 2 * recall_at_{k} * precision_at_{k} / (recall_at_{k} + precision_at_{k}) ELSE 0 END, 9) AS f1_at_{k}" for k in evaluation.KS) + " FROM m")
def e3_e4_e5_metrics(spark, d):
    m = evaluation.metrics(_detail(spark, d))
    return m.select("num_queries", *[F.round(c, 9).alias(c) for c in m.columns if c != "num_queries"])


@query(_with(Q.CHUNKS, Q.bm25(), _DETAIL, f"m AS ({_METRICS})") + "SELECT num_queries, round(mrr, 9) AS mrr, " + ", ".join(f"round(recall_at_{k}, 9) AS recall_at_{k}, round(precision_at_{k}, 9) AS precision_at_{k}" for k in evaluation.KS) + ", false AS reranked FROM m")
def s11_k4_saved_run(spark, d):
    """The metrics of a run that was saved and loaded."""
    path = _place(spark)
    files.write_run(evaluation.metrics(_detail(spark, d)), path)
    run = files.read_run(spark, path)
    return run.select("num_queries", F.round("mrr", 9).alias("mrr"), *[F.round(f"{m}_at_{k}", 9).alias(f"{m}_at_{k}") for k in evaluation.KS for m in ("recall", "precision")], "reranked")


@query(_with(Q.CHUNKS, Q.bm25(), _DETAIL) + "SELECT query_id, query, top5, round(top_score, 6) AS top_score FROM per JOIN bench_questions ON id = query_id WHERE rr = 0")
def e6_misses(spark, d):
    return evaluation.misses(_detail(spark, d), _questions(spark, d)).withColumn("top_score", F.round("top_score", 6))


@query(_with(Q.CHUNKS, Q.bm25(), _DETAIL, f"m AS ({_METRICS})") + "SELECT round(recall_at_1 * num_queries)::BIGINT AS hits_at_1, num_queries, precision_at_8 < 0.5 AS low_precision FROM m")
def e7_advisory(spark, d):
    return evaluation.advisory(evaluation.metrics(_detail(spark, d)))


_RUN_METRICS = ["mrr", *[f"{m}_at_{k}" for m in ("recall", "precision", "f1") for k in evaluation.KS]]


@query(
    "WITH r AS (SELECT DISTINCT * EXCLUDE (score_distribution) FROM saved_runs), best AS (SELECT coalesce(retriever, 'unknown') AS retriever, "
    + ", ".join(f"max({m}) AS {m}" for m in _RUN_METRICS)
    + " FROM r GROUP BY 1), lf AS (UNPIVOT best ON "
    + ", ".join(_RUN_METRICS)
    + " INTO NAME metric VALUE value), a AS (SELECT metric, value FROM lf WHERE retriever = 'dense'), b AS (SELECT metric, value FROM lf WHERE retriever = 'hybrid') "
    "SELECT metric, a.value AS a, b.value AS b, round(b.value - a.value, 9) AS delta, CASE WHEN b.value - a.value > 0.001 THEN 'up' WHEN b.value - a.value < -0.001 THEN 'down' ELSE 'same' END AS arrow FROM a FULL JOIN b USING (metric)"
)
def e8_compare_runs(spark, d):
    runs = table(spark, d, "saved_runs").dropDuplicates()
    best = runs.groupBy(F.coalesce("retriever", F.lit("unknown")).alias("retriever")).agg(*[F.max(m).alias(m) for m in _RUN_METRICS])
    a, b = (evaluation.long_form(best.where(F.col("retriever") == r), _RUN_METRICS).where("value is not null") for r in ("dense", "hybrid"))
    return evaluation.compare(a, b).withColumn("delta", F.round("delta", 9))


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _REGISTERED.items() if sql}
