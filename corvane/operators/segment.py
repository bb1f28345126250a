"""From pages to sections: a line table with running offsets, heading rules, and page lookup by offset."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import strip

_CHAPTER = ("doc", "chapter")


@dataclass(frozen=True)
class Heading:
    """A heading rule: a pattern of a whole line with the key and the title as groups 1 and 2.

    keep: 'first' heading of each key, or 'all'. prefer: a pattern that a heading of a key is chosen by before its
    place. least: the smallest number that a key may have. preamble: text before the first heading goes to it. own:
    a key must start with its chapter and a stop.
    """

    pattern: str
    keep: str = "first"
    prefer: str | None = None
    least: int | None = None
    preamble: bool = False
    own: bool = False


# The heading styles of the books.
HEADINGS = {
    "article": Heading(r"(?i)^(?:\d{1,3}[a-z]?\.\s+)?Article\s+(\d{1,3}[a-z]?)(?:\s+\(10\s+U\.S\.C\.\s+\d+[a-z]?\))?\s*[—–.-]+\s*(.{0,120})$", prefer=r"(?i)\(10\s+U\.S\.C\.", least=77),
    "numbered": Heading(r"^(\d{1,2}\.[A-Z](?:\.\d{1,2})?(?:\.[a-z])?\.?)\s+(.{0,120})$"),
    "definition": Heading(r"^([A-Z])\.\s+([A-Z][A-Za-z ]{2,40})[.:].*$", keep="all"),
    "capitals": Heading(r"^([A-Z])\.\s+([A-Z][A-Z (),/.-]{2,80})$"),
    "letters": Heading(r"^([A-Z]{1,2})\.\s+([A-Z0-9].{2,})$"),
    "sentence": Heading(r"^([A-Z])\.\s+([A-Z][A-Za-z (),/-]+?)(?:\.(?:\s.*)?)?$"),
    "section": Heading(r"^Section\s+([A-Z])\.\s+(.+)$", preamble=True),
}


def clean_pages(pages: DataFrame) -> DataFrame:
    """Each page once (the greatest text of its deliveries), without null and blank pages."""
    given = pages.where(F.trim("text") != "")
    return given.groupBy("doc", "page_num").agg(F.max("chapter").alias("chapter"), F.max("text").alias("text"), F.max("is_exhibit").alias("is_exhibit"))


def in_ranges(pages: DataFrame, ranges: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """Pages whose number lies in a range (doc, chapter, first_page, last_page); skip(doc, page_num) are left out."""
    r = ranges.select(F.col("doc").alias("range_doc"), F.col("chapter").alias("range_chapter"), "first_page", "last_page")
    hit = pages.join(r, (F.col("doc") == F.col("range_doc")) & F.col("page_num").between(F.col("first_page"), F.col("last_page")))
    out = hit.select("doc", F.col("range_chapter").alias("chapter"), "page_num", "text", "is_exhibit")
    return out if skip is None else out.join(skip, ["doc", "page_num"], "left_anti")


def detect_range(pages: DataFrame, start_marks: tuple[str, str], page_mark: str, stop_mark: str, lo: int = 201, hi: int = 550, grace: int = 10) -> DataFrame:
    """(doc, first_page, last_page): from the first page in [lo, hi] with both start marks to the last page that
    starts with ``page_mark``, before the first ``stop_mark`` page that is more than ``grace`` pages on."""
    first = pages.where(F.col("page_num").between(lo, hi) & F.col("text").contains(start_marks[0]) & F.col("text").contains(start_marks[1])).groupBy("doc").agg(F.min("page_num").alias("first_page"))
    rest = pages.join(first, "doc").where(F.col("page_num") >= F.col("first_page"))
    per = rest.withColumn("stop", F.min(F.when((F.col("page_num") > F.col("first_page") + grace) & F.col("text").rlike(stop_mark), F.col("page_num"))).over(Window.partitionBy("doc")))
    inside = per.where(F.col("stop").isNull() | (F.col("page_num") < F.col("stop")))
    return inside.groupBy("doc", "first_page").agg(F.max(F.when(F.col("text").rlike(page_mark), F.col("page_num"))).alias("last_page"))


def exhibit(text: Column) -> Column:
    """A page that mentions an exhibit, has no section heading, and fewer than 400 words."""
    from corvane.functions.text import words

    return text.rlike(r"(?i)\bEXHIBIT\b|Exhibit\s+[(\d]") & ~text.rlike(r"(?dm)^[A-Z]\.\s{2,}[A-Z]") & (F.size(words(text)) < 400)


def offsets(pages: DataFrame) -> DataFrame:
    """Pages with the offset at which each starts in its chapter's combined text, where a mark precedes every page."""
    mark = F.concat(F.lit("\n<<<PAGE:"), F.col("page_num").cast("string"), F.lit(">>>\n"))
    before = Window.partitionBy(*_CHAPTER).orderBy("page_num").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(mark) + F.length("text")
    return pages.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0))).withColumn("body", F.col("offset") + F.length(mark))


def page_at(points: DataFrame, pages: DataFrame) -> DataFrame:
    """points(doc, chapter, pos) with the page that holds each: the last one whose offset is at or before it.

    An as-of lookup by union and one window: pages and points of a chapter are ordered together.
    """
    starts = offsets(pages).select(*_CHAPTER, F.col("offset").alias("pos"), F.col("page_num").alias("start_page"), F.lit(0).alias("kind"))
    asked = points.select(*_CHAPTER, "pos", F.lit(None).cast("int").alias("start_page"), F.lit(1).alias("kind"))
    w = Window.partitionBy(*_CHAPTER).orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return starts.unionByName(asked).withColumn("page", F.last("start_page", ignorenulls=True).over(w)).where("kind = 1").select(*_CHAPTER, "pos", "page")


def lines(pages: DataFrame) -> DataFrame:
    """(doc, chapter, page_num, line_no, pos, line): pos is the line's offset in the combined text."""
    rows = offsets(pages).select(*_CHAPTER, "page_num", "body", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    before = Window.partitionBy(*_CHAPTER, "page_num").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(*_CHAPTER, "page_num", "line_no", (F.col("body") + F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0))).alias("pos"), "line")


def headings(line_table: DataFrame, rule: Heading) -> DataFrame:
    """(doc, chapter, key, title, pos, page_start) of the headings that count."""
    pattern = f"(?d){rule.pattern}"  # a line ends at a line feed only
    heads = line_table.where(F.col("line").rlike(pattern)).select(*_CHAPTER, "page_num", "pos", "line", F.regexp_extract("line", pattern, 1).alias("key"), strip(F.regexp_extract("line", pattern, 2)).alias("title"))
    if rule.least is not None:
        heads = heads.where(F.regexp_replace("key", "[^0-9]", "").cast("int") >= rule.least)
    if rule.own:
        heads = heads.where(F.expr("startswith(key, concat(chapter, '.'))"))
    if rule.keep == "first":
        better = F.col("line").rlike(rule.prefer).cast("int") if rule.prefer else F.lit(0)
        w = Window.partitionBy(*_CHAPTER, "key").orderBy(F.desc(better), "pos")
        heads = heads.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    return heads.select(*_CHAPTER, "key", "title", "pos", F.col("page_num").alias("page_start"))


def sections(pages: DataFrame, rule: Heading, titles: DataFrame | None = None) -> DataFrame:
    """(doc, chapter, key, title, page_start, page_end, pos, text), one row for each section.

    A section ends where the next heading starts, and its page_end is the page of that heading; the last section of a
    chapter ends with it. A chapter without headings is one section with key 'A' and no title. Lines before the first
    heading are left out unless the rule keeps them. titles(key, better_title) override.
    """
    table = lines(pages)
    heads = headings(table, rule)
    marked = _mark(table, heads)
    w = Window.partitionBy(*_CHAPTER).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    at = F.last(F.when(F.col("is_head"), F.col("pos")), ignorenulls=True).over(w)
    first = F.min(F.when(F.col("is_head"), F.col("pos"))).over(Window.partitionBy(*_CHAPTER))
    owned = marked.withColumn("start", F.coalesce(at, first) if rule.preamble else at).withColumn("first", first)
    owned = owned.withColumn("start", F.when(F.col("first").isNull(), -1).otherwise(F.col("start"))).where("start is not null")
    body = owned.groupBy(*_CHAPTER, "start").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "\n").alias("text"),
        F.min("page_num").alias("lo"),
        F.max("page_num").alias("hi"),
        F.max(F.when(F.col("is_head"), F.col("key"))).alias("key"),
        F.max(F.when(F.col("is_head"), F.col("title"))).alias("title"),
        F.max(F.when(F.col("is_head"), F.col("page_num"))).alias("head_page"),
    )
    nxt = Window.partitionBy(*_CHAPTER).orderBy("start")
    out = body.select(
        *_CHAPTER,
        F.coalesce("key", F.lit("A")).alias("key"),
        "title",
        (F.least("lo", "head_page") if rule.preamble else F.coalesce("head_page", "lo")).alias("page_start"),
        F.coalesce(F.lead("head_page").over(nxt), "hi").alias("page_end"),
        F.col("start").alias("pos"),
        strip(F.col("text")).alias("text"),
    )
    if titles is not None:
        out = out.join(titles.select("key", "better_title"), "key", "left").withColumn("title", F.coalesce("better_title", "title")).drop("better_title")
    return out


def chapter_sections(pages: DataFrame, style: str) -> DataFrame:
    """Sections of a manual. Numbered ones are those of the page's own chapter; chapter 6 is split by its definitions."""
    if style != "numbered":
        return sections(pages, HEADINGS[style])
    six = F.col("chapter").eqNullSafe(F.lit("6"))
    defined = sections(pages.where(six), HEADINGS["definition"])
    own = sections(pages.where(~six), replace(HEADINGS["numbered"], own=True))
    return own.unionByName(defined.withColumn("key", F.when(F.col("title").isNull(), F.lit("6")).otherwise(F.concat(F.lit("6."), "key"))))


def _mark(table: DataFrame, heads: DataFrame) -> DataFrame:
    """Line table with the counting headings marked; null chapters are a chapter of their own."""
    h = heads.select(*[F.col(c).alias(f"h_{c}") for c in _CHAPTER], F.col("pos").alias("h_pos"), "key", "title")
    on = F.col("doc").eqNullSafe(F.col("h_doc")) & F.col("chapter").eqNullSafe(F.col("h_chapter")) & (F.col("pos") == F.col("h_pos"))
    return table.join(h, on, "left").withColumn("is_head", F.col("h_pos").isNotNull()).drop("h_doc", "h_chapter", "h_pos")


# What starts a paragraph, by book.
PARAGRAPH_STARTS = {
    "article": r"^(?:[a-z]\.\s|\([a-z]\)\s|\(\d{1,2}\)\s|\d{1,2}\.\s|\[Note:|[A-Z][a-z]+\s+of\s+statute|Elements?\.?|Explanation\.?|Maximum\s+punishment|Sample\s+spec|Discussion|[A-Z]{2,})",
    "numbered": r"^(?:\d{1,2}\.[A-Z](?:\.\d{1,2})?(?:\.[a-z])?\.|[A-Z]\.\s+[A-Z]|\(\d{1,2}\)\s|\([a-z]\)\s|\[\d\]\s|Note:\s|[A-Z]{4,})",
    "capitals": r"^(?:[A-Z]\.\s{2,}[A-Z]|\d{1,2}\.\s+[A-Z]|[a-z]\.\s+[A-Z]|\(\d{1,2}\)\s|\([a-z]\)\s|NOTE:\s|[A-Z]{3,}\s)",
    "letters": r"^(?:[A-Z]{1,2}\.\s+[A-Z\d]|\d{1,2}\.\s+[A-Z]|[a-z]\.\s+[A-Z\dT]|\(\d{1,2}\)\s|\([a-z]\)\s|[A-Z]{3,})",
    "sentence": r"^(?:[A-Z]\.\s+[A-Z]|\d{1,2}\.\s+[A-Z]|[a-z]\.\s+[A-Z]|\(\d{1,2}\)\s|\([a-z]\)\s|NOTE:\s)",
    "section": r"^(?:[A-Z]\.\d+(?:\.[a-z](?:\.[ivx]+)?)?\.\s|[a-z]\.\s|\([ivx]+\)\s|\(\d+\)\s|\([a-z]\)\s|Section\s[A-Z]\.)",
}

# The heading style of each manual, by the start of its name.
MANUALS = {"hgcm": "numbered", "hgim": "capitals", "hgsep": "letters", "hgsa": "sentence", "hgmj": "section"}


def paragraphs(df: DataFrame, id_col: str, text_col: str, start: str, whole_up_to: int = 2) -> DataFrame:
    """(id, block, paragraph, text): blank lines part blocks, and lines that match ``start`` part paragraphs in them.

    Blocks of at most ``whole_up_to`` lines stay whole. Paragraphs count from 0 within their block.
    """
    blocks = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, r"\n{2,}", -1)).alias("block", "t"))
    rows = blocks.select("id", "block", F.posexplode(F.split("t", "\n", -1)).alias("line_no", "line"), (F.size(F.split("t", "\n", -1)) <= whole_up_to).alias("whole"))
    w = Window.partitionBy("id", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    opens = ((F.col("line_no") > 0) & ~F.col("whole") & F.col("line").rlike(start)).cast("int")
    grouped = rows.withColumn("paragraph", F.sum(opens).over(w)).groupBy("id", "block", "paragraph").agg(strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n")).alias("text"))
    return grouped.where("text <> ''").withColumnRenamed("id", id_col)
