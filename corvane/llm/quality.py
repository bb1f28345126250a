"""Problem 2: per-text quality statistics and a verdict: prose, list, table, junk or boilerplate.

All statistics come from one pass over the text in Python, so the only shuffle is the one that counts an id once,
over the numbers. The verdict combines rules:

- table: most lines are rows of columns or contents lines, and can be read;
- junk: the larger part of the printed characters stands in tokens that can't be read as words, numbers or marks, or
  running text has so few common words (fewer still are needed where tokens are unreadable) that it is no language;
- list: at least three lines, most of them short entries, and most of the characters stand in entries;
- boilerplate: most lines or at least half of the paragraphs repeat others of the text, or one n-gram covers most of its characters;
- prose: everything else.

Null and blank texts get null statistics and a null verdict. Deliveries of one id that agree give one row.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import map_batches
from corvane.llm.lookalikes import by_table

# Common words of the languages in the corpus.
COMMON = frozenset(
    """a an and are as at be been but by can could did do each for from had has have he her his if in is it its may more must no not of on
    only or other shall she should so some such than that the their them then there these they this to under until was were what when where
    which while who will with within without would you your
    de la el los las un una que en y por para con no se del al es su lo le et les des du une dans est pour par sur au aux""".split()
)

MEMO = 500_000

_CONTENTS = re.compile(r"(?:\.{4,}|(?:\. ){4,}|…{2,})\s*\S{1,12}\s*$")
_ROW = re.compile(r"[|\t].*[|\t]|\S {2,}\S.*\S {2,}\S|^[^,]+(?:,[^ ,][^,]*){2,}$|^-{2,}[-|+ ]*$")
_CELLS = re.compile(r" {2,}|,(?! )|-{2,}")
_BULLET = re.compile(r"\s*(?:[-*•·–▪○]|\[[ xX]?\]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\(?[ivxIVX]{1,5}[.)])\s+")
_READABLE = re.compile(r"(?:[^\W\d_][^\W\d_A-Z]*(?:['’/-][^\W\d_]+)*|[A-Z]{1,12}(?:['’/-][A-Z]+)*|[A-Z][a-z]+[A-Z][a-z]+|[$€£#]?\d[\d.,:/-]*[a-z%]{0,2}|(?:[A-Z]{1,4}-?)?\d+[A-Za-z]?(?:[.-][A-Za-z0-9]{1,4})*|\d+(?:\.[A-Za-z0-9]{1,3})+)")
_VOWEL = re.compile(r"[aeiouyáéíóúäëïöüàèìòùâêîôûãõåæøAEIOUYÁÉÍÓÚÄËÏÖÜÀÈÌÒÙÂÊÎÔÛÃÕÅÆØ]")
_HARD = re.compile(r"[bcdfghjklmnpqrstvwxz]{6}|[a-z][A-Z]{2}|(.)\1\1\1")
_OUTER = re.compile(r"^[\"'“”‘’(\[{<]+|[\"'“”‘’)\]}>.,;:!?…]+$")
_COLUMNS = re.compile(r"[,;|\"]+")

STATS = (
    "n_chars bigint, n_words bigint, n_lines bigint, mean_word_length double, symbol_ratio double, end_punct_share double, common_share double, unreadable_share double, "
    "entry_line_share double, entry_char_share double, row_line_share double, dup_line_share double, dup_paragraph_share double, top_ngram_share double"
)


def printable(token: str) -> tuple[int, int, int, int, int, int]:
    """Of a token: characters, unreadable characters, whether it is a word, whether a common one, a word's characters, symbols."""
    symbols = sum(not c.isalnum() for c in token)
    if not token.isascii():
        token = by_table(token)
    n = len(token)
    core = _OUTER.sub("", token)
    if not core:
        return n, 0, 0, 0, 0, symbols
    word = any(c.isalpha() for c in core)
    if "," in core or "|" in core or ";" in core or '"' in core:
        parts = [p for p in _COLUMNS.split(core) if p]
        bad = sum(printable(p)[1] for p in parts)
        return n, bad if bad else 0, int(word), 0, n if word else 0, symbols
    readable = _READABLE.fullmatch(core) is not None and len(core) <= 30
    if readable and word and core.isalpha() and len(core) > 1:
        readable = (_VOWEL.search(core) is not None or core.isupper() and len(core) <= 6 or len(core) <= 2 and not core.islower()) and not (len(core) > 6 and _HARD.search(core))
    if not word and not any(c.isdigit() for c in core) and len(core) > 1:
        readable = len(set(core)) == 1  # rules and leaders
    return n, 0 if readable else n, int(word), int(core.lower() in COMMON), n if word else 0, symbols


class _Memo(dict):
    def __missing__(self, token: str) -> tuple[int, int, int, int, int, int]:
        if len(self) > MEMO:
            self.clear()
        v = self[token] = printable(token)
        return v


def _line_kind(line: str, memo: _Memo) -> str:
    """row, entry or text."""
    if "|" in line or "\t" in line:
        if _ROW.search(line):
            return "row"
    elif ("  " in line or "--" in line or line.count(",") - line.count(", ") > 1) and _ROW.search(line):
        cells = len(_CELLS.findall(line)) + 1
        if len(line) <= 200 or len(line) <= 40 * cells:  # sentences parted by two blanks are longer
            return "row"
    if (".." in line or ". ." in line or "…" in line) and _CONTENTS.search(line):
        return "row"
    if len(line) > 80:
        return "text"
    m = _BULLET.match(line)
    tokens = line[m.end() :].split() if m else line.split()
    n = len(tokens)
    if n > (10 if m else 7):
        return "text"
    common = 0
    for t in tokens:
        common += memo[t][3]
    if m:
        return "entry" if common <= 0.4 * n else "text"
    return "entry" if common <= 1 and line[-1] not in ".!?" else "text"


def _top_ngram(tokens: list[str], n_chars: int) -> float:
    """The largest share of the characters that one n-gram of 2 to 4 tokens covers that occurs at least twice.

    Each token counts once, however many occurrences overlap in it.
    """
    best, places = 0, range(len(tokens))
    sizes = list(map(len, tokens))
    for n in (2, 3, 4):
        at: dict[tuple, list[int]] = {}
        for i in places:
            if i + n <= len(tokens):
                at.setdefault(tuple(tokens[i : i + n]), []).append(i)
        again = {g: p for g, p in at.items() if len(p) > 1}
        for g, p in again.items():
            size = sum(map(len, g))
            if len(p) * size > best:  # overlaps can only lessen it
                best = max(best, sum(sizes[k] for k in {i + j for i in p for j in range(n)}))
        places = sorted(i for p in again.values() for i in p)  # a repeated n-gram starts with a repeated shorter one
    return best / n_chars


def statistics(text: str, memo: _Memo) -> tuple:
    """The STATS of a text that isn't blank."""
    lines = [s for s in map(str.strip, text.split("\n")) if s]
    tokens = text.split()
    per = list(map(memo.__getitem__, tokens))
    chars, bad, words, common, letters, symbols = map(sum, zip(*per))
    kinds = [_line_kind(s, memo) for s in lines]
    entry_chars = sum(len(s) for s, k in zip(lines, kinds) if k == "entry")
    paragraphs = [p.strip() for p in text.split("\n\n") if p.strip()]
    printed = sum(map(len, lines))
    return (
        len(text), words, len(lines), letters / words if words else 0.0, symbols / max(1, chars),
        sum(s.endswith(_ENDS) for s in lines) / len(lines), common / max(1, words), bad / max(1, chars),
        kinds.count("entry") / len(lines), entry_chars / printed, kinds.count("row") / len(lines),
        1 - len(set(lines)) / len(lines), 1 - len(set(paragraphs)) / len(paragraphs), _top_ngram(tokens, max(1, chars)),
    )


_ENDS = (".", "!", "?", ":", ";", ",", '"', "”", "…")


def verdict(s: tuple) -> str:
    chars, lines, common, unreadable, entry_lines, entry_chars, row_lines, dup_lines, dup_paragraphs, top = s[0], s[2], *s[6:]
    if row_lines > 0.5 and unreadable <= 0.5:
        return "table"
    is_list = lines >= 3 and entry_lines > 0.5 and entry_chars > 0.4
    if unreadable > 0.5 or not is_list and chars >= 80 and (common < 0.18 or common < 0.26 and unreadable > 0.06):
        return "junk"
    if is_list:
        return "list"
    if lines >= 3 and dup_lines > 0.5 or dup_paragraphs >= 0.5 or top > 0.5:
        return "boilerplate"
    return "prose"


def quality(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, statistics, verdict), one row for each distinct result of an id; keep takes integer columns."""
    id_kind = df.schema[id_col].dataType.simpleString()
    kept = [f"k{i}" for i in range(len(keep))]
    fields = [f.split() for f in STATS.split(", ")]
    types = [pa.int64() if t == "bigint" else pa.float64() for _, t in fields]
    state = {"memo": _Memo()}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        memo = state["memo"]
        rows = [statistics(t, memo) if t and not t.isspace() else None for t in batch.column("text").to_pylist()]
        cols = [pa.array([r[i] if r else None for r in rows], t) for i, t in enumerate(types)]
        said = pa.array([verdict(r) if r else None for r in rows], pa.string())
        return pa.RecordBatch.from_arrays([batch.column("id"), *(batch.column(k) for k in kept), *cols, said], names=["id", *kept, *(n for n, _ in fields), "verdict"])

    src = df.select(F.col(id_col).alias("id"), *[F.col(k).cast("int").alias(a) for k, a in zip(keep, kept)], F.col(text_col).alias("text"))
    schema = ", ".join([f"id {id_kind}", *[f"{k} int" for k in kept], STATS, "verdict string"])
    out = map_batches(src, run, schema).distinct()
    return out.withColumnsRenamed({"id": id_col} | dict(zip(kept, keep)))


def not_prose(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(id, kind) of the texts whose verdict is list, table or junk."""
    q = quality(df, id_col, text_col)
    return q.where(F.col("verdict").isin("list", "table", "junk")).select(id_col, F.col("verdict").alias("kind")).distinct()


def repeating(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(id, dup_line_share, dup_paragraph_share, top_ngram_share) of the texts whose verdict is boilerplate."""
    return quality(df, id_col, text_col).where("verdict = 'boilerplate'").select(id_col, "dup_line_share", "dup_paragraph_share", "top_ngram_share").distinct()


def by_page(df: DataFrame, page_col: str = "page_start") -> DataFrame:
    """Statistics summed up by page; a null page is a group of its own."""
    q = quality(df, keep=(page_col,))
    kinds = [F.count_if(F.col("verdict") == k).alias(f"n_{k}") for k in ("prose", "list", "table", "junk", "boilerplate")]
    return q.groupBy(page_col).agg(F.count("*").alias("n_chunks"), F.sum("n_words").alias("n_words"), F.avg("common_share").alias("common_share"), F.avg("end_punct_share").alias("end_punct_share"), *kinds)
