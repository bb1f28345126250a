"""Text functions as column expressions: cleaning, token counts and tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a blank, whatever engine reads the pattern.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same as single characters.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: A letter, digit or underscore of any script.
WORD = r"[\p{L}\p{N}_]"

# Lines that are only layout, as the two assemblers know them.
ARTIFACT_A = rf"{WS}*(?:Article{WS}+\d+|IV-\d+|\[…\]|\[\.{{2,}}\]|¶[^\s]*|[Pp]age{WS}+\d+|\d{{1,3}}\.{WS}*){WS}*"
ARTIFACT_B = rf"{WS}*(?:IV-\d+|V-\d+|\[…\]|\[\.{{2,}}\]|¶[^\s]*|[Pp]age{WS}+\d+|\d{{1,3}}\.{WS}*){WS}*"

# Corrections of the one scanned page, in order.
OCR_RULES = (
    (r"\besco1i\b", "escort"),
    (r"\bpmpose\b", "purpose"),
    (r"\btrnstwo1ihy\b", "trustworthy"),
    (r"\bcomi-maiiial\b", "court-martial"),
    (r"\bmaiiial\b", "martial"),
    (r"\blaborato1y\b", "laboratory"),
    (r"\bpolial\b", "portal"),
    (r"uscg\.Inil\b", "uscg.mil"),
    (r"\badininistrative\b", "administrative"),
    (r"\bai·e\b", "are"),
    (r"\bheai·ing\b", "hearing"),
    (r"\bprocedmes\b", "procedures"),
    (r"Guai·d\b", "Guard"),
    (r"\bprimaiy\b", "primary"),
    (r"\bofDTOs\b", "of DTOs"),
    (r"1000\.l0B", "1000.10B"),
    (r"rocmn1,\.\.,\.\.\.,\.+", ""),
)
# Boilerplate of redactions.
REDACTION = r"(?i)(Redacted per EO[^\n]*\n?|Removed content per Presidential Executive Order[^\n]*\n?|No\.\s*14168[^\n]*\n?|No\.14151[^\n]*\n?|– black ink redaction overrides content[^\n]*\n?)"
# Short words that stay apart when titles are mended.
KEEP_APART = "As Or Of At To In An By My Is If On Up Do So No He We Be It Am Us Me Vs Re Ex".split()
# Words that make a line of a passage telling.
KEYWORDS = (
    "element explanation punish maximum means defined guilty offense statute conviction intent knowledge willful wrongful duty order regulation absence derelict assault larceny murder robbery "
    "sentence discharge confinement forfeiture reckless drunken impaired operating vessel aircraft vehicle control"
).split()


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def token_estimate(c: Column) -> Column:
    """Estimated tokens: 1.3 for every word, at least 1; null for null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(1), F.floor(F.size(words(c)) * F.lit(1.3)))).cast("int")


def tokens(c: Column) -> Column:
    """Terms of the inverted index: lower case, cut at everything but letters, digits, ' and -, two characters at least.

    A term starts and ends with a letter or digit, so one pattern finds what cutting and trimming would leave.
    """
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9][a-z0-9'-]*[a-z0-9]"), F.lit(0))


def content_hash(c: Column) -> Column:
    return F.left(F.md5(c), F.lit(8))


def zero_pad(c: Column, width: int) -> Column:
    """Like lpad, but longer values stay whole."""
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0"))


def strip_zeros(c: Column) -> Column:
    return F.lower(F.ltrim(c, F.lit("0")))


def truncate(c: Column, n: int, mark: str = "…") -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(mark))).otherwise(c)


def join_hyphens(c: Column) -> Column:
    """Words broken by a hyphen at a line end put together; a half that was joined on its left stays apart on its right.

    The pattern starts at the hyphen, so no word is scanned more than once.
    """
    return F.regexp_replace(c, rf"(?<={WORD})-\n{WS}*({WORD}++)(-\n{WS}*+(?={WORD}))?", "$1$2")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def keep_lines(c: Column, drop: str) -> Column:
    """Without the lines that match ``drop`` in full."""
    return F.array_join(F.filter(F.split(c, "\n", -1), lambda s: ~s.rlike(f"^(?:{drop})$")), "\n")


def clean_text(c: Column, artifact: str = ARTIFACT_A) -> Column:
    return strip(collapse(keep_lines(join_hyphens(c), artifact)))


def compact_text(c: Column) -> Column:
    """Hyphens joined and blank lines dropped."""
    return strip(keep_lines(join_hyphens(c), f"{WS}*"))


def drop_overlap_marks(c: Column) -> Column:
    return F.regexp_replace(c, r"\n\n\[(?:…|\.{2,})\]\n\n", "\n\n")


def drop_page_marks(c: Column) -> Column:
    return F.regexp_replace(c, r"<<<PAGE:\d+>>>", "")


def clean_page(c: Column, header: Column) -> Column:
    """Running header, page numbers on lines of their own and runs of blank lines taken out; header is a pattern."""
    c = F.regexp_replace(c, F.concat(header, F.lit(r"\s*\n?")), F.lit(""))
    c = F.regexp_replace(c, r"(?dm)(?:^|\n)(?:IV|\d{1,2})-\d{1,3}(?:\n|$)", "\n")
    return strip(collapse(c))


def ocr_repair(c: Column, page: Column, scanned_page: int = 40) -> Column:
    fixed = c
    for pattern, by in OCR_RULES:
        fixed = F.regexp_replace(fixed, pattern, by)
    return F.regexp_replace(F.when(page == scanned_page, fixed).otherwise(c), REDACTION, " ")


def mend_split_words(c: Column) -> Column:
    """The ordered repair of words that extraction tore apart; each step sees the result of those before it."""
    # The patterns, in order.
    steps = (
        (r"(\d{1,2})-\n(\d{1,3})\n", "\n"),
        (r"(?dm)(?:^|\n)\d{1,2}-\d{1,3}(?:\n|$)", "\n"),
        (r"(?dm)[^\S\n]+$", ""),
        (r"(?<=[A-Za-z])\n ([a-z])", " $1"),
        (r"(?<=\s)([b-hj-z])\n([a-z])", "$1$2"),
        (r"(?<=[\s\n.(\[])([A-Z])\n([a-z])", "$1$2"),
        (r"\n([a-z])\n", "$1"),
        (r"(?<=[\s\n.)])([A-Z]) ([a-z]{2,})", "$1$2"),
        (r"([a-zA-Z]) \.", "$1."),
        (r"\n{2,}", "\n"),
        (r"  +", " "),
    )
    for pattern, by in steps:
        c = F.regexp_replace(c, pattern, by)
    return c


def title_case(c: Column) -> Column:
    """Upper case after anything but a letter, lower case after a letter."""
    chars = F.split(c, "")
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("inside"))
    return F.aggregate(
        chars,
        start,
        lambda acc, ch: F.struct(F.concat(acc["out"], F.when(acc["inside"], F.lower(ch)).otherwise(F.upper(ch))).alias("out"), ch.rlike(r"^\p{L}$").alias("inside")),
        lambda acc: acc["out"],
    )


def section_title(c: Column) -> Column:
    """An all-capitals title in title case, with torn fragments put back."""
    # The patterns, in order.
    c = F.regexp_replace(strip(c), r"\s*\n\s*", " ")
    c = F.regexp_replace(c, r"-([A-Z]) ([A-Z])", "-$1$2")
    c = F.regexp_replace(c, r"([A-Z]{2,}) ([B-HJ-Z]) ([A-Z]{2,})", "$1$2 $3")
    c = title_case(F.regexp_replace(c, r"\s*\.$", ""))
    keep = "|".join(KEEP_APART)
    # a fragment of two letters is part of the next word, whose first letter then is a small one
    parts = F.split(F.regexp_replace(c, rf"\b(?!(?:{keep}) )([A-Z][a-z]) ([A-Z])([a-z]+)", "$1\u0001$2\u0002$3"), "\u0001")
    return strip(F.array_join(F.transform(parts, lambda p: F.when(p.contains("\u0002"), F.concat(F.lower(F.left(p, F.lit(1))), F.regexp_replace(F.substring(p, 2, 1 << 30), "\u0002", ""))).otherwise(p)), ""))


def first_sentence(c: Column, after: int = 5) -> Column:
    """A title up to, and without, the first stop behind character ``after`` that a blank or the end follows; else all of it."""
    at = F.regexp_instr(F.substring(c, after + 1, 1 << 30), F.lit(r"\.(?:\s|$)"))
    return strip(F.when(at > 0, F.left(c, F.lit(after - 1) + at)).otherwise(c))


def outline(c: Column) -> Column:
    """Lines of a legal outline indented by their markers; other lines go two deeper than the marker before them."""
    lines = F.transform(F.split(c, "\n", -1), strip)

    def level(s: Column) -> Column:
        return (
            F.when(s.rlike(r"^[a-e]\.\s"), 0)
            .when(s.rlike(r"^\(\d{1,2}\)\s"), 4)
            .when(s.rlike(r"^\([a-z]\)\s"), 8)
            .when(s.rlike(r"(?i)^\((?:i{1,3}|iv|vi{0,3}|ix|xi{0,3})\)\s"), 12)
            .when(s.rlike(r"(?i)^\[Note:"), 4)
        )

    def step(acc: Column, s: Column) -> Column:
        now = F.coalesce(level(s), acc["at"])
        depth = F.when(level(s).isNotNull(), now).when(now > 0, now + 2).otherwise(0)
        line = F.when(s == "", "").otherwise(F.concat(F.repeat(F.lit(" "), depth), s))
        return F.struct(F.concat(acc["out"], F.array(line)).alias("out"), F.when(s == "", acc["at"]).otherwise(now).alias("at"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(lines, start, step, lambda acc: F.array_join(acc["out"], "\n"))


_KEYWORD = r"(?i)\b(?:" + "|".join(KEYWORDS) + r")\b"
# Lines that open the elements of an offence, alone or inside a short line.
_ELEMENTS = rf"(?i)^{WS}*(?:[a-z]\.)?{WS}*Elements?\.?{WS}*$"
_INLINE_ELEMENTS = r"(?i)\bElements?\."


def excerpt(c: Column, artifact: str = ARTIFACT_A, limit: int = 700, elements_first: bool = False) -> Column:
    """The most telling run of lines of a text, at most ``limit`` characters unless its first line alone is longer.

    Blank and artifact lines don't count. The run opens at the first of the lines with most keywords (with
    ``elements_first`` at the first line that opens the elements, if any) and takes all lines behind it that fit; if
    that fills less than half the limit, it takes the lines before that fit, too. All of it is read off the running
    sum of line lengths. A text without lines gives its first characters; null stays null.
    """
    lines = F.filter(F.split(c, "\n", -1), lambda s: (strip(s) != "") & ~s.rlike(f"^(?:{artifact})$"))

    def measured(lines: Column) -> Column:
        """upto[i] is the length of the lines before line i, counted from 1; a line's length has its line feed."""
        upto = F.aggregate(lines, F.array(F.lit(0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(s) + 1)))
        return _let(F.struct(lines.alias("lines"), upto.alias("upto")), lambda r: F.when(F.size(lines) == 0, F.left(c, F.lit(limit))).when(F.element_at(r["upto"], -1) - 1 <= limit, F.array_join(lines, "\n")).otherwise(opened(r)))

    def opened(r: Column) -> Column:
        found = F.transform(r["lines"], lambda s: F.size(F.regexp_extract_all(s, F.lit(_KEYWORD), F.lit(0))))
        opening = _let(found, lambda n: F.array_position(n, F.array_max(n)))
        if elements_first:
            first = F.array_position(F.transform(r["lines"], lambda s: s.rlike(_ELEMENTS) | (F.length(s) < 80) & s.rlike(_INLINE_ELEMENTS)), True)
            opening = _let(first, lambda at: F.when(at > 0, at).otherwise(opening))
        return _let(opening.cast("int"), lambda at: _let(F.element_at(r["upto"], at), lambda start: forward(r, at, start)))

    def forward(r: Column, at: Column, start: Column) -> Column:
        after = F.greatest(at + 1, F.size(F.filter(r["upto"], lambda n: n <= start + limit)))
        return _let(after, lambda after: _let(F.element_at(r["upto"], after), lambda stop: backward(r, at, start, after, stop)))

    def backward(r: Column, at: Column, start: Column, after: Column, stop: Column) -> Column:
        before = F.when(stop - start < limit // 2, F.size(F.filter(r["upto"], lambda n: n < stop - limit)) + 1).otherwise(at)
        rest = lambda b: F.when(F.element_at(r["upto"], -1) - 1 > stop - F.element_at(r["upto"], b), " …").otherwise("")
        return _let(before, lambda b: F.concat(strip(F.array_join(F.slice(r["lines"], b, after - b), "\n")), rest(b)))

    return F.when(c.isNotNull(), _let(lines, measured))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)
