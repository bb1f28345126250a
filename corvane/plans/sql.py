"""SQL fragments from which the counterparts of the registered queries are put together."""

from __future__ import annotations

from corvane.functions.text import WORD, WS
from corvane.operators.retrieval import EXPANSIONS


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


CHUNKS = "ch AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at) = 1)"
PAGES = "pg AS (SELECT doc, page_num, max(chapter) AS chapter, max(text) AS text, max(is_exhibit) AS is_exhibit FROM source_pages WHERE trim(text, ' ') <> '' GROUP BY doc, page_num)"


def tokens(c: str) -> str:
    return f"list_filter(list_transform(string_split_regex(lower({c}), '[^a-z0-9''-]+'), lambda x: trim(x, '-''')), lambda x: length(x) >= 2)"


def words(c: str) -> str:
    return f"list_filter(string_split_regex({c}, {quote(WS + '+')}), lambda x: x <> '')"


def estimate(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN greatest(1, floor(len({words(c)}) * 1.3::DOUBLE))::INT END"


def replace(c: str, pattern: str, by: str, options: str = "g") -> str:
    return f"regexp_replace({c}, {quote(pattern)}, {quote(by)}, {quote(options)})"


def strip(c: str) -> str:
    return replace(c, f"^{WS}+|{WS}+$", "")


def join_hyphens(c: str) -> str:
    return replace(c, rf"({WORD}+)-\n{WS}*({WORD}+)", r"\1\2")


def keep_lines(c: str, drop: str) -> str:
    return f"array_to_string(list_filter(string_split({c}, chr(10)), lambda s: NOT regexp_full_match(s, {quote(drop)})), chr(10))"


def clean(c: str, artifact: str) -> str:
    return strip(replace(keep_lines(join_hyphens(c), artifact), r"\n{3,}", "\n\n"))


def expand(q: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({q}, {quote('(?i)' + p)}) THEN {q} || {quote(' ' + w)}" for p, w in EXPANSIONS) + f" ELSE {q} END"


def article(q: str) -> str:
    one = [f"nullif(regexp_extract({q}, {quote(p)}, 1), '')" for p in (r"(?i)\bArticle\s+(\d{1,3}[a-z]?)\b", r"(?i)\bArt\.?\s*(\d{1,3}[a-z]?)\b")]
    return f"lower(coalesce({', '.join(one)}))"


def bm25(query: str = "query", k: int = 8) -> str:
    """CTEs ending in bm25(query_id, chunk_id, score, rank); query: the expression over bench_questions that is searched."""
    return f"""docs AS (SELECT chunk_id, coalesce({tokens("text")}, []) AS terms FROM ch),
dl AS (SELECT chunk_id, len(terms) AS len FROM docs),
st AS (SELECT count(*) AS n, avg(len) AS avgdl FROM dl),
post AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(terms) AS term FROM docs) GROUP BY ALL),
raw AS (SELECT term, count(*) AS df, ln((SELECT n FROM st) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post GROUP BY term),
ti AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT id AS query_id, unnest({tokens(query)}) AS term FROM bench_questions) GROUP BY ALL),
sc AS (SELECT query_id, chunk_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / avgdl)) * qtf), 6) AS score
  FROM qt JOIN post USING (term) JOIN ti USING (term) JOIN dl USING (chunk_id), st GROUP BY query_id, chunk_id),
bm25 AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= {k})"""


def dense(k: int, dim: int = 64, name: str = "dense") -> str:
    """CTEs ending in dense(query_id, chunk_id, score, rank) over hashed term vectors; needs docs."""
    bucket = f"(('0x' || substr(md5(term), 1, 4))::INT % {dim})"
    vec = lambda rel, key, src: f"""{rel}_b AS (SELECT {key}, {bucket} AS b, count(*)::DOUBLE AS v FROM (SELECT {key}, unnest(terms) AS term FROM {src}) GROUP BY ALL),
{rel} AS (SELECT {key}, b, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS v FROM {rel}_b)"""  # noqa: E731
    return f"""qdocs AS (SELECT id AS query_id, {tokens("query")} AS terms FROM bench_questions),
{vec("qv", "query_id", "qdocs")}, {vec("cv", "chunk_id", "docs")},
dots AS (SELECT query_id, chunk_id, round(sum(qv.v * cv.v), 6) AS score FROM qv JOIN cv USING (b) GROUP BY query_id, chunk_id),
{name} AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, docs.chunk_id AS chunk_id, score FROM (SELECT id AS query_id FROM bench_questions) q CROSS JOIN docs LEFT JOIN dots USING (query_id, chunk_id)) QUALIFY rank <= {k})"""


MATCH = "(a.article <> '' AND t.target IS NOT NULL AND (starts_with(a.article, t.target) OR starts_with(t.target, a.article)))"


def targets(name: str = "targets") -> str:
    return f"{name} AS (SELECT id AS query_id, nullif(trim(lower(ltrim({article('query')}, '0'))), '') AS target FROM bench_questions), articles AS (SELECT chunk_id, trim(lower(ltrim(coalesce(article_number, ''), '0'))) AS article FROM ch)"


INJECT = f"""pairs_named AS (SELECT t.query_id, a.chunk_id FROM targets t JOIN articles a ON {MATCH}),
both_named AS (SELECT query_id, chunk_id, b.score, b.rank AS old, p.chunk_id IS NOT NULL AS named FROM bm25 b FULL JOIN pairs_named p USING (query_id, chunk_id)),
fronted AS (SELECT *, (named AND old IS NULL) OR (named AND NOT coalesce(bool_or(named AND old IS NULL) OVER (PARTITION BY query_id), false)) AS front FROM both_named),
injected AS (SELECT query_id, chunk_id, coalesce(score, 9999.0) AS score, row_number() OVER (PARTITION BY query_id ORDER BY front DESC, old NULLS FIRST, chunk_id) AS rank FROM fronted)"""

FUSE = """fused_raw AS (SELECT query_id, chunk_id, d.score AS dense_score, d.rank AS dense_rank, b.rank AS bm25_rank,
  round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 9) AS rrf_score FROM dense d FULL JOIN injected b USING (query_id, chunk_id)),
fused AS (SELECT query_id, chunk_id, rrf_score, coalesce(dense_score, 0.0) AS score, dense_rank, bm25_rank,
  row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST, chunk_id) AS rank FROM fused_raw)"""


def filtered(ranked: str, name: str, k: int, label: str = "hybrid", exact: bool = False) -> str:
    match = "(a.article = t.target AND a.article <> '')" if exact else MATCH
    return f"""{name}_h AS (SELECT r.*, t.target, coalesce({match}, false) AS hit FROM {ranked} r JOIN articles a USING (chunk_id) LEFT JOIN targets t USING (query_id)),
{name}_a AS (SELECT *, bool_or(hit) OVER (PARTITION BY query_id) AS any_hit FROM {name}_h),
{name} AS (SELECT * EXCLUDE (rank, hit, any_hit, target), CASE WHEN target IS NULL THEN '{label}_unfiltered' WHEN any_hit THEN '{label}_filtered' ELSE '{label}_fallback' END AS mode,
  row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS rank FROM {name}_a WHERE hit OR NOT any_hit QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) <= {k})"""


def relevance() -> str:
    either = lambda a, b: f"(starts_with({a}, {b}) OR starts_with({b}, {a}))"
    art, sec = "lower(ltrim(coalesce(c.article_number, ''), '0'))", "rtrim(trim(coalesce(c.section_number, '')), '.')"
    return (
        f"(coalesce(list_contains(q.gold.chunk_ids, c.chunk_id), false)"
        f" OR ({art} <> '' AND len(list_filter(coalesce(q.gold.article_numbers, []), lambda g: {either(art, "lower(ltrim(g, '0'))")})) > 0)"
        f" OR ((q.gold.source_doc IS NULL OR contains(coalesce(c.source, ''), q.gold.source_doc)) AND {sec} <> '' AND len(list_filter(coalesce(q.gold.section_numbers, []), lambda g: rtrim(trim(g), '.') <> '' AND {either(sec, "rtrim(trim(g), '.')")})) > 0))"
    )


LINES = """off AS (SELECT *, coalesce(sum(length(chr(10) || '<<<PAGE:' || page_num || '>>>' || chr(10)) + length(text)) OVER (PARTITION BY doc, chapter ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM pg),
ln0 AS (SELECT doc, chapter, page_num, "offset" + length('<<<PAGE:>>>') + length(page_num::VARCHAR) + 2 AS body, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM off),
ln AS (SELECT doc, chapter, page_num, line_no, line, body + coalesce(sum(length(line) + 1) OVER (PARTITION BY doc, chapter, page_num ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM ln0)"""


def sections(pattern: str, keep_all: bool = False, prefer: str | None = None, least: int | None = None, preamble: bool = False) -> str:
    """CTEs ending in sec(doc, chapter, key, title, page_start, page_end, pos, text); needs ln."""
    p = quote(pattern)
    better = f"CASE WHEN regexp_matches(line, {quote(prefer)}) THEN 1 ELSE 0 END" if prefer else "0"
    number = f" AND regexp_replace(regexp_extract(line, {p}, 1), '[^0-9]', '', 'g')::INT >= {least}" if least is not None else ""
    once = "" if keep_all else f" QUALIFY row_number() OVER (PARTITION BY doc, chapter, key ORDER BY {better} DESC, pos) = 1"
    start = "coalesce(at_pos, first_pos)" if preamble else "at_pos"
    return f"""heads AS (SELECT doc, chapter, page_num, pos, line, regexp_extract(line, {p}, 1) AS key, {strip(f"regexp_extract(line, {p}, 2)")} AS title FROM ln WHERE regexp_matches(line, {p}){number}{once}),
mk AS (SELECT ln.*, h.key, h.title, h.pos IS NOT NULL AS is_head FROM ln LEFT JOIN heads h ON ln.doc = h.doc AND ln.chapter IS NOT DISTINCT FROM h.chapter AND ln.pos = h.pos),
ow AS (SELECT *, last_value(CASE WHEN is_head THEN pos END IGNORE NULLS) OVER (PARTITION BY doc, chapter ORDER BY pos ROWS UNBOUNDED PRECEDING) AS at_pos, min(CASE WHEN is_head THEN pos END) OVER (PARTITION BY doc, chapter) AS first_pos FROM mk),
bo AS (SELECT doc, chapter, CASE WHEN first_pos IS NULL THEN -1 ELSE {start} END AS start, string_agg(line, chr(10) ORDER BY pos) AS text, min(page_num) AS lo, max(page_num) AS hi,
  max(CASE WHEN is_head THEN key END) AS key, max(CASE WHEN is_head THEN title END) AS title, max(CASE WHEN is_head THEN page_num END) AS head_page FROM ow WHERE first_pos IS NULL OR {start} IS NOT NULL GROUP BY ALL),
sec AS (SELECT doc, chapter, coalesce(key, 'A') AS key, title, {"least(lo, head_page)" if preamble else "coalesce(head_page, lo)"} AS page_start,
  coalesce(lead(head_page) OVER (PARTITION BY doc, chapter ORDER BY start), hi) AS page_end, start AS pos, {strip("text")} AS text FROM bo)"""
