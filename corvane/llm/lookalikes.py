"""Problem 4: one form for texts that look the same in print.

What a character looks like comes from the public confusables data that the JVM's Unicode library carries: a letter
that isn't ASCII is a look-alike of the ASCII letters and digits with the same skeleton. A token with unusual
characters is run through a trie of the vocabulary by a weighted edit automaton: look-alikes, full-width and joined
letters, marks apart from their letters and characters that don't show cost nothing, any other replaced, left
out or added character costs 1, and states over the budget die. The word reached at the least cost, then with the fewest
look-alikes taken for another than their table's letter, then the most frequent, is the canonical spelling. A look-alike
with several readings (a stroke may be l, I or 1) so gets the one that makes a word. A token that reaches no word
is rewritten by the table. The budget is 0 unless the caller allows more, so words that differ in print stay apart.
Blanks of any kind become a plain blank one for one; line ends, case, accents, digits and punctuation stay.

The vocabulary is the TOP most frequent words of all texts that the table leaves alone, at most.
Null texts give a null form and empty texts an empty one; neither is in a pair. Ids delivered again count once.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import map_batches, written

#: Words of the vocabulary at most.
TOP = 50_000
MEMO = 500_000

# Letters of other scripts that print like Latin ones, as far as texts are read without the JVM's data.
ALIKE = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХԌԚԜаеѕіјорсухһԁԛԝѵ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲ",
        "ABESIJKMHOPCTYXGQWaesijopcyxhdqwv" "ABEZHIKMNOPTYXovc",
        strict=True,
    )
)


def free_edit(c: str) -> str:
    """What a character prints as, in decomposed form; '' if it doesn't show."""
    if c in ALIKE:
        return ALIKE[c]
    n = ord(c)
    if n < 128:
        return c
    if 0xFF01 <= n <= 0xFF5E:  # full-width forms
        return chr(n - 0xFEE0)
    if 0xFB00 <= n <= 0xFB06:  # joined letters
        return unicodedata.normalize("NFKC", c)
    kind = unicodedata.category(c)
    if kind == "Zs":
        return " "
    if kind == "Cf" or n == 0x34F or 0xFE00 <= n <= 0xFE0F:
        return ""
    return unicodedata.normalize("NFD", c)


def by_table(token: str) -> str:
    return unicodedata.normalize("NFC", "".join(map(free_edit, token)))


@dataclass
class Looks:
    """By character that isn't ASCII: what it may be read as, decomposed, the table's reading first."""

    readings: dict[str, tuple[str, ...]]

    @classmethod
    def of(cls, spark: SparkSession) -> Looks:
        """From the skeletons of the JVM's Unicode library; letters and letter numbers only, as marks and digits must agree."""
        chars = [chr(n) for n in range(128, 0x30000) if not 0xD800 <= n <= 0xDFFF]
        letters = [c for c in chars if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nl"]
        plain = [chr(n) for n in range(128) if chr(n).isalnum()]
        compatible = [unicodedata.normalize("NFKC", c) for c in letters]
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        skeleton = dict(zip([*letters, *plain, *compatible], checker.getSkeleton("\n".join([*letters, *plain, *compatible])).split("\n"), strict=True))
        alike: dict[str, list[str]] = {}
        for c in plain:
            alike.setdefault(skeleton[c], []).append(c)
        readings = {}
        for c, k in zip(letters, compatible):
            if k.isascii() and k.isalpha() and skeleton[c] == skeleton[k]:
                readings[c] = (k,)
            elif unicodedata.normalize("NFD", c) == c and skeleton[c] in alike:
                order = lambda a: (a.isdigit(), a.isupper() != c.isupper(), a)  # noqa: E731, B023
                readings[c] = tuple(sorted(alike[skeleton[c]], key=order))
        for c, meant in ALIKE.items():
            readings[c] = (meant, *(r for r in readings.get(c, ()) if r != meant))
        return cls({c: r for c, r in readings.items() if not all(x.isdigit() for x in r)})

    def read(self, c: str) -> tuple[str, ...]:
        return self.readings.get(c) or (free_edit(c),)

    def by_table(self, token: str) -> str:
        return unicodedata.normalize("NFC", "".join(self.read(c)[0] for c in token))


class Trie:
    """Vocabulary trie over decomposed spellings; a node is a dict, under '' the word and its rank by frequency."""

    def __init__(self, words: list[str]):
        self.root: dict = {}
        for rank, w in enumerate(words):
            node = self.root
            for c in unicodedata.normalize("NFD", w):
                node = node.setdefault(c, {})
            node.setdefault("", (rank, w))

    def reach(self, token: str, looks: Looks, budget: int = 0) -> str | None:
        """The vocabulary word that the automaton reaches from ``token``, if any."""
        live: dict[int, tuple[int, int, dict]] = {}

        def enter(states: dict, node: dict, cost: int, turns: int) -> None:
            old = states.get(id(node))
            if cost <= budget and (old is None or (cost, turns) < old[:2]):
                states[id(node)] = (cost, turns, node)
                for c, below in node.items() if cost < budget else ():
                    if c:
                        enter(states, below, cost + 1, turns)  # a character that the token lacks

        enter(live, self.root, 0, 0)
        for c in token:
            ahead: dict[int, tuple[int, int, dict]] = {}
            for cost, turns, node in live.values():
                for n, steps in enumerate(looks.read(c)):
                    at = node
                    for step in steps:
                        at = at.get(step)
                        if at is None:
                            break
                    else:
                        enter(ahead, at, cost, turns + (n > 0))
                if c in node:
                    enter(ahead, node[c], cost, turns)
                if cost < budget:
                    enter(ahead, node, cost + 1, turns)
                    for step, below in node.items():
                        if step:
                            enter(ahead, below, cost + 1, turns)
            if not ahead:
                return None
            live = ahead
        ends = [(cost, turns, *node[""]) for cost, turns, node in live.values() if "" in node]
        return min(ends)[3] if ends else None


class Canonical:
    def __init__(self, vocabulary: list[str], looks: Looks, budget: int = 0):
        self.looks, self.budget = looks, budget
        self.trie = Trie([w for w in vocabulary if looks.by_table(w) == w])
        self.memo: dict[str, str] = {}

    def part(self, p: str) -> str:
        return p if p.isascii() else self.trie.reach(p, self.looks, self.budget) or self.looks.by_table(p)

    def token(self, m: re.Match) -> str:
        raw = m.group()
        out = self.memo.get(raw)
        if out is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            out = self.memo[raw] = "".join(map(self.part, _PARTS.split(raw)))
        return out

    def text(self, text: str) -> str:
        text = text.replace("\t", " ")
        return text if text.isascii() else _TOKEN.sub(self.token, text)


_TOKEN = re.compile(r"[^ \n\r]*[^\x00-\x7f][^ \n\r]*")
#: Words within a token; what stands between is kept as a part of its own.
_PARTS = re.compile(r"([   -   　]|[-,.;:()'\"])")
_WORD = re.compile(r"[^\W\d_]+")


def vocabulary(texts: DataFrame, top: int = TOP) -> list[str]:
    """The most frequent words of texts(text), the most frequent first; words are counted per batch before the shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = Counter(w for t in batch.column(0).to_pylist() for w in _WORD.findall(t))
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    counts = map_batches(texts.select("text"), run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(top).collect()]


def canonical(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", with_text: bool = False, top: int = TOP, budget: int = 0) -> DataFrame:
    """(id, form_key binary, text_key bigint[, form string]) a row for each row; texts with equal form_key print alike."""
    texts = df.where(F.col(text_col).isNotNull() & (F.octet_length(text_col) > 0)).select(F.col(text_col).alias("text"))
    shared = df.sparkSession.sparkContext.broadcast((vocabulary(texts, top), Looks.of(df.sparkSession)))
    kind = df.schema[id_col].dataType.simpleString()
    state: dict = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "canonical" not in state:
            state["canonical"] = Canonical(*shared.value, budget)
        forms = [t if t is None else state["canonical"].text(t) for t in batch.column("text").to_pylist()]
        keys = pa.array([f if f is None else hashlib.md5(f.encode("utf-8", "surrogatepass")).digest() for f in forms], pa.binary())
        cols, names = [batch.column("id"), keys, batch.column("text_key")], ["id", "form_key", "text_key"]
        return pa.RecordBatch.from_arrays([*cols, pa.array(forms, pa.string())] if with_text else cols, names=[*names, "form"] if with_text else names)

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    return map_batches(src, run, f"id {kind}, form_key binary, text_key bigint" + (", form string" if with_text else ""))


def _mixed(df: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """(form_key, text_key, id) of the forms that more than one text has, stored."""
    rows = written(canonical(df.where(F.octet_length(text_col) > 0), id_col, text_col, **options))  # keys only; read more than once
    keys = rows.groupBy("form_key").agg(F.min("text_key").alias("lo"), F.max("text_key").alias("hi")).where("lo <> hi").select("form_key")
    return written(rows.join(keys, "form_key", "left_semi").select("form_key", "text_key", "id").distinct())


def print_alikes(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", **options) -> DataFrame:
    """Pairs (chunk_a, chunk_b), a < b, of ids whose texts differ but print alike.

    Different texts are paired first and then expanded into their ids, so copies of one text never meet each other.
    """
    mixed = _mixed(df, id_col, text_col, **options)
    texts = mixed.select("form_key", "text_key").distinct()
    pairs = texts.withColumnRenamed("text_key", "x").join(texts.withColumnRenamed("text_key", "y"), "form_key").where("x < y")
    with_x = pairs.join(mixed.select("form_key", F.col("text_key").alias("x"), F.col("id").alias("p")), ["form_key", "x"])
    both = with_x.join(mixed.select("form_key", F.col("text_key").alias("y"), F.col("id").alias("q")), ["form_key", "y"]).where("p <> q")
    return both.select(F.least("p", "q").alias("chunk_a"), F.greatest("p", "q").alias("chunk_b")).distinct()


def alike_classes(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", **options) -> DataFrame:
    """(id, class_id, n_alike) of every id that ``print_alikes`` pairs: its class and how many rows of other texts are in it."""
    mixed = _mixed(df, id_col, text_col, **options)
    sizes = mixed.groupBy("form_key", "text_key").agg(F.count("*").alias("same"))
    classes = sizes.groupBy("form_key").agg(F.sum("same").alias("all"))
    return mixed.join(sizes, ["form_key", "text_key"]).join(classes, "form_key").select(F.col("id").alias(id_col), F.lower(F.hex("form_key")).alias("class_id"), (F.col("all") - F.col("same")).alias("n_alike"))


def forms(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", **options) -> DataFrame:
    """(id, form): the canonical text of every id; repeated deliveries with equal forms give one row."""
    rows = canonical(df, id_col, text_col, with_text=True, **options)
    return rows.dropDuplicates(["id", "form_key"]).select(F.col("id").alias(id_col), "form")
