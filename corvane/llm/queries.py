"""Registered queries of the training-text operators, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import encoding, leakage, lookalikes, quality, reading, scanned, shared_spans, splitting, truncation
from corvane.llm.common import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.noise(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "source_pages")).select("chunk_id", "kind", "token").distinct()


def p1_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.repaired(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "source_pages"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_prose(table(spark, sf_dir, "chunks"))


def p2_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "chunks"))


def p2_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repeating(table(spark, sf_dir, "chunks"))


def p2_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.by_page(table(spark, sf_dir, "chunks"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.sharing_pairs(table(spark, sf_dir, "chunks"))


def p3_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_amount(table(spark, sf_dir, "chunks")).drop("intervals")


def p3_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs to be taken out if no shared text is to stay, a row each."""
    shared = shared_spans.shared_amount(table(spark, sf_dir, "chunks"))
    return shared.select("chunk_id", F.inline("intervals").alias("start_pos", "end_pos"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_classes(table(spark, sf_dir, "chunks"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.print_alikes(table(spark, sf_dir, "chunks"))


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.forms(table(spark, sf_dir, "chunks"))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.alike_classes(table(spark, sf_dir, "chunks"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "chunks"))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "chunks"), keep=("section_number",), with_text=True)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "chunks")).select(F.col("id").alias("chunk_id"))


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, sf_dir, "chunks"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, sf_dir, "documents"))


def p7_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text back from its ids; null and empty texts come back as ''."""
    return encoding.decode_corpus(p7_ids(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_spans(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "bench_questions"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))
    return levels.where((F.col("words") >= 60) & F.col("band").isin("plain", "demanding")).select("doc_id", "band")


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"), everything=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (p1_found, p1_texts, p2_found, p2_stats, p2_boilerplate, p2_by_page, p3_found, p3_shared, p3_intervals, p3_classes, p4_found, p4_forms, p4_classes, p5_found, p5_pieces, p6_found, p6_rates, p7_ids, p7_text, p8_found, p8_spans, p9_found, p9_levels)
    }


# Letters of the Cyrillic and Greek scripts that are printed with the shapes of Latin ones, written down apart from the operator's.
_CYRILLIC = ("АВЕЅІЈКМНОРСТУХЅаеѕіјорсухһԁԛԝѵҮԌҺӀ", "ABESIJKMHOPCTYXSaesijopcyxhdqwvYGhI")
_GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲ", "ABEZHIKMNOPTYXovc")


def _form_sql() -> str:
    """The form of a text that isn't empty: letters put in Latin ones, then Unicode composition."""
    letters = dict(zip(_CYRILLIC[0] + _GREEK[0], _CYRILLIC[1] + _GREEK[1]))
    wide = {chr(n + 0xFEE0): chr(n) for n in range(0x21, 0x7F)}
    blanks = dict.fromkeys("\t\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000", " ")
    table_ = letters | wide | blanks
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    form = f"translate(text, {quote(''.join(table_))}, {quote(''.join(table_.values()))})"
    for joined, plain in (("\ufb03", "ffi"), ("\ufb04", "ffl"), ("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb05", "st"), ("\ufb06", "st")):
        form = f"replace({form}, '{joined}', '{plain}')"
    return f"nfc_normalize(regexp_replace({form}, '[\\x{{ad}}\\x{{34f}}\\x{{200b}}-\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{2060}}-\\x{{2064}}\\x{{feff}}\\x{{fe00}}-\\x{{fe0f}}]', '', 'g'))"


def _p4_sql() -> str:
    return f"""WITH f AS (SELECT DISTINCT chunk_id, text, md5({_form_sql()}) AS form FROM chunks WHERE text <> '')
SELECT DISTINCT a.chunk_id AS chunk_a, b.chunk_id AS chunk_b FROM f a JOIN f b ON a.form = b.form AND a.chunk_id < b.chunk_id AND a.text <> b.text"""


def _p4_classes_sql() -> str:
    return f"""WITH f AS (SELECT DISTINCT chunk_id, text, md5({_form_sql()}) AS form FROM chunks WHERE text <> '')
SELECT f.chunk_id, f.form AS class_id, count(*) AS n_alike FROM f JOIN f g ON f.form = g.form AND f.text <> g.text GROUP BY ALL"""


def _p5_sql(pieces: bool = False) -> str:
    """The cuts one after the other, by recursion; a greedy pattern finds the last boundary of a piece."""
    seg = "substr(text, s + 1, 2400)"
    last = lambda p: f"length(regexp_extract({seg}, '^[\\s\\S]*{p}'))"
    end = f"""CASE WHEN n - s <= 2400 THEN n
    WHEN {last(chr(92) + 'n' + chr(92) + 'n')} > 1200 THEN s + {last(chr(92) + 'n' + chr(92) + 'n')}
    WHEN {last('[.!?][ ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r]')} > 1200 THEN s + {last('[.!?][ ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r]')}
    WHEN {last('[ ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r]')} > 1200 THEN s + {last('[ ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r]')}
    ELSE s + 2400 END"""
    return f"""WITH RECURSIVE cut AS (
  SELECT chunk_id, text, n, piece_no, s, {end} AS e FROM (SELECT DISTINCT chunk_id, text, length(text) AS n, 1::BIGINT AS piece_no, 0::BIGINT AS s FROM chunks WHERE length(text) > 2400)
  UNION ALL
  SELECT chunk_id, text, n, piece_no, s, {end} AS e FROM (SELECT chunk_id, text, n, piece_no + 1 AS piece_no, e - 320 AS s FROM cut WHERE e < n)
)
SELECT {"DISTINCT chunk_id, section_number" if pieces else "chunk_id"}, piece_no, s AS start_pos, e AS end_pos{", substr(text, s + 1, e - s) AS piece_text FROM cut JOIN (SELECT DISTINCT chunk_id, section_number FROM chunks) USING (chunk_id)" if pieces else " FROM cut"}"""


#: Every window of 300 characters by a hash of DuckDB's, and those that two texts have.
_WINDOWS = """c AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE length(text) >= 300), t AS (SELECT DISTINCT text FROM c),
w AS (SELECT text, i, hash(substr(text, i + 1, 300)) AS h FROM (SELECT text, unnest(range(length(text) - 299)) AS i FROM t)),
again AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT text) > 1), r AS (SELECT w.* FROM w JOIN again USING (h)),
met AS (SELECT DISTINCT a.text AS x, b.text AS y FROM (SELECT DISTINCT text, h FROM r) a JOIN (SELECT DISTINCT text, h FROM r) b ON a.h = b.h AND a.text <> b.text UNION ALL SELECT text, text FROM c GROUP BY text HAVING count(*) > 1),
pairs AS (SELECT DISTINCT a.chunk_id AS p, b.chunk_id AS q FROM met JOIN c a ON a.text = met.x JOIN c b ON b.text = met.y AND a.chunk_id <> b.chunk_id),
spots AS (SELECT text, i AS s, i + 300 AS e FROM r UNION ALL SELECT text, 0, length(text) FROM c GROUP BY text HAVING count(*) > 1),
marked AS (SELECT *, coalesce(s > max(e) OVER (PARTITION BY text ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS opens FROM spots),
runs AS (SELECT text, min(s)::BIGINT AS start_pos, max(e)::BIGINT AS end_pos FROM (SELECT *, sum(opens::INT) OVER (PARTITION BY text ORDER BY s, e DESC ROWS UNBOUNDED PRECEDING) AS n FROM marked) GROUP BY text, n)"""


def _p3_sql() -> dict[str, str]:
    return {
        "p3_found": f"WITH {_WINDOWS} SELECT p AS chunk_a, q AS chunk_b FROM pairs WHERE p < q",
        "p3_intervals": f"WITH {_WINDOWS} SELECT chunk_id, start_pos, end_pos FROM c JOIN runs USING (text)",
        "p3_shared": f"""WITH {_WINDOWS} SELECT chunk_id, length(text) AS n_chars, (SELECT count(*) FROM pairs WHERE p = chunk_id) AS n_partners, shared_chars, shared_chars / length(text) AS shared_share
FROM c JOIN (SELECT text, sum(end_pos - start_pos)::BIGINT AS shared_chars FROM runs GROUP BY text) USING (text)""",
    }


def oracle_sql() -> dict[str, str]:
    return _p3_sql() | {"p4_found": _p4_sql(), "p4_classes": _p4_classes_sql(), "p4_forms": f"SELECT DISTINCT chunk_id, CASE WHEN text <> '' THEN {_form_sql()} ELSE text END AS form FROM chunks", "p5_found": _p5_sql(), "p5_pieces": _p5_sql(True), "p7_text": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
