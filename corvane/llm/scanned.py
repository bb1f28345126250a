"""Problem 1: repair of text from scanned pages.

Furniture. A classifier of line pairs decides for every line that isn't much longer and has no more running words than
furniture that was met, from its shape and from how the lines before and after it read on, whether it is body text, a running header or a page number. It is
trained on the page table, whose first and last lines are furniture, on the forms in which books put page numbers, and
on lines of texts: those whose shape comes again and again and breaks into running sentences are furniture, all others
are not.

Joins. Whether a hyphen at a line end parts a word, or belongs to it, is decided for pairs of lines: from how often the
joined and the hyphenated spelling and the two halves stand unbroken in the corpus, how full the first line is, and how
the second one starts. Another classifier of line pairs decides for any two lines of a repaired text whether the second
continues the paragraph of the first. It is trained on paragraphs that are wrapped for the purpose.

Misread characters. Distinct spellings meet correction candidates in an inverted join over character bigrams: the
rarest 2 e + 1 bigrams of a spelling against those of known words about as far into the word, e being the edits that
are allowed. An edit changes two bigrams, so the one of them that it must have left is met. Gradient-boosted trees,
trained on words corrupted by the confusions of print, rank the candidates; the best one above one half is the word
meant. What was confused with what is learned from the same words; the list of confusions only makes examples.

Word counts cover all chunks. The models are trained on bounded samples: SAMPLE pages, SAMPLE chunk texts, and the TOP
most frequent words. Null and empty texts have no cases and are repaired to null and ''. Deliveries of an id with
equal text count once.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.boosting import Trees, fit_trees
from corvane.llm.common import bounded_sample, map_batches, written
from corvane.llm.lookalikes import by_table
from corvane.llm.quality import COMMON
from corvane.llm.truncation import BUCKETS, _columns, fit


SAMPLE = 4000
#: Most frequent words, which train the ranking.
TOP = 20_000
#: Occurrences from which a word may be what a misread spelling means.
LEAST = 3
MEMO = 500_000
#: Characters of a line that may have been wrapped.
_WIDEST = 120
#: How many times as frequent as a spelling in letters the word must be that it may be a misreading of.
RARER = 4

# What print is misread as, and the letters meant; they corrupt words to train on.
CONFUSIONS = {
    "1": ("l", "i", "r", "t"), "0": ("o",), "5": ("s",), "9": ("g",), "6": ("b",), "8": ("b",), "@": ("a",), "c": ("e",), "f": ("t",), "v": ("y",), "b": ("h",), "m": ("in", "ni", "nn"),
    "rn": ("m",), "cl": ("d",), "ii": ("u",), "vv": ("w",), "i·": ("r",), "\\·": ("v",), "h": ("li",), "n": ("ri",), "e": ("c",), "l": ("i", "t"), "u": ("ii",), "3": ("e",), "$": ("s",), "2": ("z",), "7": ("t",), "|": ("l", "i"), "!": ("l", "i"), "iii": ("m",), "li": ("h",), "ri": ("n",), "nn": ("m",), "tl": ("d",), "q": ("g",),
}

_HYPHENS = "-‐‑¬\xad"
_SEAM = re.compile(rf"[{_HYPHENS}][ \t]*\r?\n[ \t]*")
_INNER = frozenset("'’@·\\-")
_RIGHT = re.compile(r"[^\W\d_](?:[^\W_]|['’@·\\-])*")
_EDGES = re.compile(r"^[^\w@·\\$]+|[^\w@·]+$")
_ROMAN = re.compile(r"[ivxlc]{1,7}")
_INVISIBLE = re.compile("[​-‏⁠﻿\xad]")


def bare(token: str) -> str:
    """A token as the word counts know it: look-alikes folded, marks around it gone, lower case."""
    if not token.isascii():
        token = by_table(token)
    return _EDGES.sub("", token).lower()


# ---------------------------------------------------------------- furniture


def line_shape(line: str) -> str:
    """A line with its numbers and misread digits folded: 'Encl (2) to DCH 2O3l' and 'Encl (2) to DCH 2031' are alike."""
    words = []
    for w in line.split():
        core = w.strip("[]()|.,;:")
        if core and any(c.isdigit() for c in core) and len(core) <= 12:
            w = re.sub(r"[0-9OlI]", "N", w)
        elif core.isupper() or core.lower() != core and core.replace("l", "I").isupper():
            w = w.replace("l", "I").replace("0", "O")
        elif _ROMAN.fullmatch(core):
            w = "roman"
        words.append(re.sub("N+", "N", w))
    return " ".join(words)


def line_features(line: str, before: str, after: str) -> list[str]:
    shape = line_shape(line)
    words = shape.split()
    rough = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]{2,}", "A", re.sub(r"[A-Z][a-z]+", "Aa", shape)))
    reads_on = f"{before[-1:].isalnum() or before[-1:] in ',-'}{after[:1].islower()}"
    return [
        "1", f"s={shape}", f"r={rough}" if len(words) <= 6 else "r=long", f"first={words[0] if words else ''}", f"last={words[-1] if words else ''}",
        f"two={' '.join(words[:2])}", f"n={min(len(words), 9)}", f"on={reads_on}", f"on={reads_on},{rough if len(words) <= 3 else 'long'}",
        f"end={line[-1:] if not line[-1:].isalnum() else 'a'}", f"upper={shape.isupper()}", f"digits={any(c.isdigit() for c in line)}", f"low={line[:1].islower()}",
        f"running={min(running_words(line), 2)},{reads_on}",
    ]


def _misread(line: str, rng: np.random.Generator) -> str:
    return line.replace("0", "O").replace("1", "l").replace("I", "l") if rng.random() < 0.3 else line


def _page_number(rng: np.random.Generator) -> str:
    n, m = int(rng.integers(1, 400)), int(rng.integers(1, 30))
    roman = "".join(rng.choice(["x", "xx", "", "xxx", "l"]) + rng.choice(["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"]))
    return [f"Page {n}", f"Page {n} of {n + 90}", f"Page | {n}", f"- {n} -", f"[{n}]", f"{n}", f"{m}-{n}", f"{m}–{n}", f"{m} - {n}", f"IV-{n}", f"IV–{n}", f"IV - {n}", roman][rng.integers(13)]


def broken_words(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, left half, right half, hyphen) of the words broken over line ends, none overlapping another."""
    out = []
    for m in _SEAM.finditer(text):
        at, least = m.start(), out[-1][1] if out else 0
        while at > least and (text[at - 1].isalnum() or text[at - 1] in _INNER):
            at -= 1
        while at < m.start() and not text[at].isalpha():
            at += 1
        right = _RIGHT.match(text, m.end())
        if at < m.start() and right:
            out.append((at, right.end(), text[at : m.start()], right.group(), text[m.start()]))
    return out


def seam_shape(text: str, start: int, end: int, seam: int, width: int) -> str:
    """How the lines around a broken word look: how full the first is (in tenths of the widest), and the second's start."""
    first = text.rfind("\n", 0, start) + 1
    full = min(9, 10 * (seam - first) // max(1, width))
    after = text.find("\n", seam) + 1
    rest = text[after:end].lstrip()[:1]
    return f"{full}{'a' if rest.islower() else 'A'}"


def without(text: str, spans: list[tuple[int, int, str, str, str]]) -> str:
    parts, at = [], 0
    for start, end, *_ in spans:
        parts.append(text[at:start])
        at = end
    return " ".join([*parts, text[at:]])


@dataclass
class Furniture:
    header: np.ndarray
    page: np.ndarray
    longest: int  # characters of a line that may be furniture: twice those of the longest one met
    running: int  # running words of such a line: one more than in any met

    @classmethod
    def train(cls, pages: list[str], texts: list[str], seed: int = 3) -> Furniture:
        rng = np.random.default_rng(seed)
        split = [[s for s in map(str.strip, p.split("\n")) if s] for p in pages]
        first = Counter(line_shape(p[0]) for p in split if len(p) > 1)
        heads = sorted({p[0] for p in split if len(p) > 1 and first[line_shape(p[0])] >= max(3, len(split) // 400) and len(p[0]) <= 70 and not p[0].startswith("EXHIBIT")})
        codes = [h for h in heads if any(c.isdigit() for c in h)]
        titles = [h for h in heads if h not in codes]
        body = [[s for s in map(str.strip, t.split("\n")) if s] for t in texts]
        again = _interrupting(body)
        known = {k for k in {line_shape(h) for h in heads} | again if not _number_only(k)}
        met = sorted({s for b in body for s in b if line_shape(s) in again and not _number_only(line_shape(s))})
        running = 1 + max([0, *map(running_words, heads), *map(running_words, met)])
        longest = 2 * max([0, *map(len, heads), *map(len, met)]) + 12
        lines = [s for b in body for s in b if len(s) > 30]
        rows, kinds = [], []

        def add(line: str, kind: int) -> None:
            if not lines:
                return
            i = int(rng.integers(len(lines)))
            before, after = lines[i], lines[int(rng.integers(len(lines)))]
            if rng.random() < 0.6:
                before, after = before.rstrip(".,;:"), after[:1].lower() + after[1:]
            elif rng.random() < 0.3:
                before = "" if rng.random() < 0.5 else before
                after = "" if rng.random() < 0.5 else after
            rows.append(line_features(line, before, after))
            kinds.append(kind)

        for _ in range(6000 if heads or met else 0):
            code, title = (rng.choice(codes or heads), rng.choice(titles or heads)) if heads else ("", "")
            seen = str(rng.choice(met)) if met else code
            add(_misread([code, title, f"{code}   {title}"][rng.integers(3)] if heads and rng.random() < (0.4 if met else 1) else seen, rng), 1)
        for _ in range(3000):
            add(_misread(_page_number(rng), rng) if rng.random() < 0.5 else _page_number(rng), 2)
        for p in split:
            if len(p) > 2 and len(p[-1]) <= 12 and any(c.isdigit() for c in p[-1]):
                add(p[-1], 2)
        for b in body:
            for i, line in enumerate(b):
                shape = line_shape(line) if len(line) <= longest and running_words(line) <= running else ""
                if not shape or shape in known or _number_only(shape) or any(k in shape for k in known) or _begins_like(shape, known):
                    continue
                rows.append(line_features(line, b[i - 1] if i else "", b[i + 1] if i + 1 < len(b) else ""))
                kinds.append(0)
        if not rows:
            return cls(np.zeros(BUCKETS), np.zeros(BUCKETS), 0, 0)
        x, y = _columns(rows), np.array(kinds)
        return cls(fit(x, (y == 1).astype(float)), fit(x, (y == 2).astype(float)), longest, running)

    def asks(self, line: str) -> bool:
        return len(line) <= self.longest and running_words(line) <= self.running

    def kinds(self, rows: list[tuple[str, ...]]) -> list[str]:
        if not rows:
            return []
        x = _columns(rows)
        h, p = self.header[x].sum(axis=1), self.page[x].sum(axis=1)
        return np.where((h > 0) & (h >= p), "header", np.where(p > 0, "page_no", "")).tolist()


# Small words inside titles.
_SMALL = frozenset("a an and at by for in of on or the to upon with".split())


def running_words(line: str) -> int:
    """Words that start small, but for the small ones of titles and for numbers whose first 1 was read as l."""
    return sum(w[0].islower() and w not in _SMALL and not (w[0] == "l" and any(map(str.isdigit, w))) for w in line.split())


def _interrupting(body: list[list[str]]) -> set[str]:
    """Shapes of lines that come in several texts and stand between the halves of a sentence in some of them."""
    times: Counter = Counter()
    within: Counter = Counter()
    for b in body:
        seen = set()
        for i, line in enumerate(b):
            shape = line_shape(line) if len(line) <= _WIDEST and not line[:1].islower() else ""
            if shape and shape not in seen:
                seen.add(shape)
                times[shape] += 1
                within[shape] += bool(0 < i < len(b) - 1 and (b[i - 1][-1].isalnum() or b[i - 1][-1] in ",-") and b[i + 1][0].islower() and line[-1] not in ",;")
    return {k for k, n in times.items() if n >= 3 and within[k] >= max(2, 0.1 * n)}


def _number_only(shape: str) -> bool:
    return re.fullmatch(r"(?:page\W*)?\W*(?:[ivxl]+|NV|N)?\W*N?\W*(?:of N)?", shape, re.I) is not None or shape == "roman"


def _begins_like(shape: str, known: set[str]) -> bool:
    """Its first two words are those of a known shape and hold a number."""
    two = shape.split()[:2]
    return len(two) == 2 and "N" in two[1] and len(two[0]) > 1 and any(k.split()[:2] == two for k in known)


class Lines:
    """Takes the furniture out of texts; what the model said of a line and its surroundings is remembered."""

    def __init__(self, model: Furniture):
        self.model, self.memo = model, {}

    def furniture(self, texts: list[str]) -> list[tuple[list[tuple[str, str]], str]]:
        """Of each text: (kind, line) of its furniture, and the text without it."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        asked: list[list[tuple[int, str, tuple[str, ...]]]] = []
        for text in texts:
            mine: list[tuple[int, str, tuple[str, ...]]] = []
            asked.append(mine)
            if "\n" not in text and len(text) > self.model.longest:
                continue
            lines = [s.strip() for s in text.split("\n")]
            for i, line in enumerate(lines):
                if line and self.model.asks(line):
                    before = next((s for s in reversed(lines[:i]) if s), "")
                    after = next((s for s in lines[i + 1 :] if s), "")
                    mine.append((i, line, tuple(line_features(line, before, after))))
        new = list({f for mine in asked for _, _, f in mine if f not in self.memo})
        self.memo.update(zip(new, self.model.kinds(new)))
        out = []
        for text, mine in zip(texts, asked):
            found = {i: (self.memo[f], line) for i, line, f in mine if self.memo[f]}
            out.append((list(found.values()), "\n".join(s for i, s in enumerate(text.split("\n")) if i not in found) if found else text))
        return out


# ---------------------------------------------------------------- joins

#: Features of a broken word: how often its joined and hyphenated form and its halves stand unbroken, the hyphen, and the lines.
_JOIN_COLUMNS = 8


def join_row(joined: float, compound: float, left: float, right: float, seam: str) -> list[float]:
    """seam: the hyphen, how full the first line is, and a letter of the case that the second starts in."""
    return [log(1 + joined), log(1 + compound), log(1 + joined) - log(1 + compound), min(log(1 + left), log(1 + right)), float(seam[0] != "-"), float(compound > 0), float(seam[1]), float(seam[2] == "a")]


def train_joins(words: dict[str, int], seed: int = 5) -> Trees:
    """Words cut at a random place at the end of a full line against hyphenated words cut at their hyphen, some with
    unknown wholes, and against words before a dash at the end of a line that isn't full."""
    rng = np.random.default_rng(seed)
    x, y = [], []
    full = lambda: str(int(rng.integers(6, 10)))
    for w, n in sorted(words.items()):
        if "-" in w.strip("-"):
            a, _, b = w.partition("-")
            hide = rng.random() < 0.15
            x.append(join_row(words.get(a + b, 0), 0 if hide else n, words.get(a, 0) + 5 * hide, words.get(b, 0) + 5 * hide, f"-{full()}a"))
            y.append(0)
        elif len(w) >= 5 and w.isalpha():
            k = int(rng.integers(2, len(w) - 1))
            hide = rng.random() < 0.15
            x.append(join_row(0 if hide else n, words.get(f"{w[:k]}-{w[k:]}", 0), words.get(w[:k], 0), words.get(w[k:], 0), f"{rng.choice(list(_HYPHENS))}{full()}{'a' if rng.random() < 0.97 else 'A'}"))
            y.append(1)
    plain = sorted(w for w in words if len(w) >= 3 and w.isalpha())
    for _ in range(min(1000, 10 * len(plain))):  # compounds of known words, as there may be few real ones
        a, b = (plain[int(rng.integers(len(plain)))] for _ in range(2))
        x.append(join_row(0, max(1.0, min(words[a], words[b]) * rng.random()), words[a], words[b], f"-{full()}a"))
        y.append(0)
        a, b = (plain[int(rng.integers(len(plain)))] for _ in range(2))
        x.append(join_row(words.get(a + b, 0), words.get(f"{a}-{b}", 0), words[a], words[b], f"-{int(rng.integers(0, 10))}A"))
        y.append(0)
    return fit_trees(np.array(x, dtype=float).reshape(-1, _JOIN_COLUMNS), np.array(y, dtype=float), rounds=30)


# ---------------------------------------------------------------- misread characters


def learned_confusions(pairs: list[tuple[str, str]], least: int = 3) -> dict[str, tuple[str, ...]]:
    """By what was read: what was meant, from (misread, meant) pairs that differ in one place; seen ``least`` times."""
    times: Counter = Counter()
    for bad, word in pairs:
        a = 0
        while a < min(len(bad), len(word)) and bad[a] == word[a]:
            a += 1
        b = 0
        while b < min(len(bad), len(word)) - a and bad[-1 - b] == word[-1 - b]:
            b += 1
        seen, meant = bad[a : len(bad) - b], word[a : len(word) - b]
        if seen and meant and len(seen) <= 3:
            times[seen, meant] += 1
    out: dict[str, tuple[str, ...]] = {}
    for (seen, meant), n in sorted(times.items()):
        if n >= least:
            out[seen] = (*out.get(seen, ()), meant)
    return out


def confusion_cost(spelling: str, word: str, confusions: dict[str, tuple[str, ...]]) -> int:
    """Fewest confusions, any other edit counting 4, that turn ``word`` into ``spelling``; more than 8 is 9."""
    n, m = len(spelling), len(word)
    if abs(n - m) > 3:
        return 9
    best = [[9] * (m + 1) for _ in range(n + 1)]
    best[0][0] = 0
    for i in range(n + 1):
        for j in range(max(0, i - 3), min(m, i + 3) + 1):
            c = best[i][j]
            if c >= 9:
                continue
            if i < n and j < m:
                step = c if spelling[i] == word[j] else c + 4
                if step < best[i + 1][j + 1]:
                    best[i + 1][j + 1] = step
            if i < n and c + 4 < best[i + 1][j]:
                best[i + 1][j] = c + 4
            if j < m and c + 4 < best[i][j + 1]:
                best[i][j + 1] = c + 4
            for k in (1, 2, 3):
                for meant in confusions.get(spelling[i : i + k], ()) if i + k <= n else ():
                    if word.startswith(meant, j) and c + 1 < best[i + k][j + len(meant)]:
                        best[i + k][j + len(meant)] = c + 1
    return min(9, best[n][m])


@dataclass
class Ranking:
    trees: Trees
    confusions: dict[str, tuple[str, ...]]


def rank_row(spelling: str, word: str, n_spelling: float, n_word: float, confusions: dict[str, tuple[str, ...]]) -> list[float]:
    odd = sum(not c.isalpha() and c not in "-'" for c in spelling)
    return [float(confusion_cost(spelling, word, confusions)), log((1 + n_word) / (1 + n_spelling)), log(1 + n_word), log(1 + n_spelling), float(len(spelling)), float(odd), float(spelling[:1] != word[:1]), float(spelling[-1:] != word[-1:])]


def corrupt(word: str, rng: np.random.Generator) -> str | None:
    options = [(i, len(meant), seen) for seen, letters in CONFUSIONS.items() for meant in letters for i in range(len(word)) if word.startswith(meant, i)]
    if not options:
        return None
    i, k, seen = options[rng.integers(len(options))]
    return word[:i] + seen + word[i + k :]


def train_ranking(words: dict[str, int], sample: int = 3000, seed: int = 11) -> Ranking:
    """Corrupted words against the words meant (1), and corrupted or real words against other candidates (0)."""
    rng = np.random.default_rng(seed)
    names = sorted(w for w in words if len(w) >= 4 and w.replace("-", "").isalpha())
    grams: dict[str, list[int]] = {}
    for i, w in enumerate(names):
        for g in {f"^{w}$"[k : k + 3] for k in range(len(w))}:
            grams.setdefault(g, []).append(i)

    def near(spelling: str) -> list[str]:
        c: Counter = Counter()
        for g in {f"^{spelling}$"[k : k + 3] for k in range(len(spelling))}:
            c.update(grams.get(g, ()))
        return [names[i] for i, _ in c.most_common(6)]

    x, y = [], []
    chosen = [names[i] for i in rng.permutation(len(names))[:sample]]
    read = [(bad, w) for w in names for bad in [corrupt(w, rng) for _ in range(max(2, 6000 // len(names)))] if bad and bad != w]
    confusions = learned_confusions(read)
    for w in chosen:
        bad = corrupt(w, rng)
        if bad and rng.random() < 0.3:
            bad = corrupt(bad, rng) or bad  # two misreadings in one word
        if bad and bad != w:
            n_bad = max(1.0, words[w] * float(rng.choice([0.00002, 0.0001, 0.0005, 0.002, 0.01, 0.03])))
            odd = any(not c.isalpha() and c not in "-'" for c in bad)
            if n_bad * 8 <= words[w] or odd:
                also = corrupt(w, rng) or bad  # another misreading isn't what was meant
                if also not in (bad, w) and also not in words:
                    x.append(rank_row(bad, also, n_bad, n_bad + int(rng.integers(10)), confusions))
                    y.append(False)
                for cand in sorted({*near(bad), w}):
                    x.append(rank_row(bad, cand, n_bad, words[cand], confusions))
                    y.append(cand == w)
        for cand in near(w):
            if cand != w:
                x.append(rank_row(w, cand, words[w], words[cand], confusions))
                y.append(False)
    return Ranking(fit_trees(np.array(x, dtype=float).reshape(-1, 8), np.array(y, dtype=float)), confusions)


# ---------------------------------------------------------------- the operator


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts; words are counted per worker before they are shuffled."""
    memo: dict[str, str] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw: Counter = Counter()
        for t in batch.column("text").to_pylist():
            raw.update(t.split())
        out: Counter = Counter()
        if len(memo) > MEMO:
            memo.clear()
        for t, n in raw.items():
            w = memo.get(t)
            if w is None:
                w = bare(t)
                w = memo[t] = w if 2 <= len(w) <= 32 and any(c.isalpha() for c in w) else ""
            if w:
                out[w] += n
        return pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.string()), pa.array(out.values(), pa.int64())], names=["word", "n"])

    return map_batches(texts.select("text"), run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _odd_spelling(w: str) -> bool:
    letters = sum(c.isalpha() for c in w)
    return 4 <= len(w) and letters >= 0.6 * len(w) and len(w) - letters <= 3 and all(c.isalnum() or c in "@·\\-'$|!" for c in w)


def occurrences(texts: DataFrame, model: Furniture, frequent: set[str]) -> DataFrame:
    """(id, kind, a, b, c): furniture lines; broken words as halves and hyphen; spellings to look up, with 'first' or
    'last' for a spelling in letters at an end of its text, where a word may have been cut."""
    shared = texts.sparkSession.sparkContext.broadcast((model, frequent))
    kind = texts.schema["id"].dataType.simpleString()
    state: dict = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            m, top = shared.value
            state.update(lines=Lines(m), top=top, words={})
        lines, top, memo = state["lines"], state["top"], state["words"]
        at, rows = [], []
        if len(memo) > MEMO:
            memo.clear()
        for i, (got, rest) in enumerate(lines.furniture(batch.column("text").to_pylist())):
            out = {(k, line, "", "") for k, line in got}
            broken = broken_words(rest) if "\n" in rest else []
            width = min(_WIDEST, max(map(len, rest.split("\n")))) if broken else 0
            for start, end, left, right, hyphen in broken:
                seam = hyphen + seam_shape(rest, start, end, start + len(left), width)
                left, right = bare(left), bare(right)
                if left and right:
                    out.add(("break", left, right, seam))
            tokens = (without(rest, broken) if broken else rest).split()
            looked = []
            common = 0
            for k, t in enumerate(tokens):
                w = memo.get(t)
                if w is None:
                    w = bare(t)
                    w = memo[t] = 1 if w in COMMON else 0 if w in top or not _odd_spelling(w) else w
                if w == 1:
                    common += 1
                elif w:
                    looked.append((k, w))
            if looked and common >= 0.2 * len(tokens):
                for k, w in looked:
                    end = "" if not w.isalpha() else "first" if k == 0 else "last" if k == len(tokens) - 1 else ""
                    out.add(("spelling", w, end, ""))
            at += [i] * len(out)
            rows += sorted(out)
        cols = [batch.column("id").take(pa.array(at, pa.int32())), *(pa.array([r[k] for r in rows], pa.string()) for k in range(4))]
        return pa.RecordBatch.from_arrays(cols, names=["id", "kind", "a", "b", "c"])

    return map_batches(texts, run, f"id {kind}, kind string, a string, b string, c string")


def _bigrams(word) -> F.Column:
    """(gram, at) of the padded word; a gram that comes again counts each time."""
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda k: F.struct(F.substring(padded, k, F.lit(2)).alias("gram"), k.alias("at")))


def allowed_edits(word) -> F.Column:
    """Edits that a misread spelling may be from the word meant: one in two characters, 3 at most."""
    return F.least(F.lit(3), F.floor(F.length(word) / 2).cast("int"))


def _letters(word) -> F.Column:
    """The characters that a word has, as bits; two words e edits apart differ in 2 e of them at most."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), lambda bits, c: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.ascii(c) % 62)))


def candidates(spellings: DataFrame, counts: DataFrame) -> DataFrame:
    """(spelling, n_spelling, word, n_word): known words within the allowed edits, frequent enough to be what is meant."""
    known = counts.where((F.col("n") >= LEAST) & (F.length("word") >= 4) & F.col("word").rlike(r"^\p{L}+(?:[-']\p{L}+)*$"))
    posts = known.select("word", F.col("n").alias("n_word"), _letters(F.col("word")).alias("has"), F.inline(_bigrams(F.col("word"))))
    often = posts.groupBy("gram").agg(F.count("*").alias("df"))
    mine = spellings.join(counts.withColumnRenamed("word", "spelling"), "spelling").select("spelling", F.col("n").alias("n_spelling"), _letters(F.col("spelling")).alias("had"), F.inline(_bigrams(F.col("spelling")))).join(often, "gram", "left")
    w = Window.partitionBy("spelling").orderBy(F.coalesce("df", F.lit(0)), "gram", "at")
    rare = mine.withColumn("k", F.row_number().over(w)).where(F.col("k") <= 2 * allowed_edits(F.col("spelling")) + 1).where("df is not null")
    lettered = F.col("spelling").rlike(r"^\p{L}+$")
    asked = rare.select("gram", "spelling", "n_spelling", "had", F.col("at").alias("here"), (F.length("spelling") - F.col("at")).alias("left"), allowed_edits(F.col("spelling")).alias("edits"), F.when(lettered, RARER * F.col("n_spelling")).otherwise(F.col("n_spelling")).alias("least"))
    given = posts.select("gram", "word", "n_word", "has", "at", (F.length("word") - F.col("at")).alias("rest"))
    # edits before the gram and behind it shift it by one place each at most
    near = asked.join(given, "gram").where(
        (F.abs(F.col("at") - F.col("here")) + F.abs(F.col("rest") - F.col("left")) <= F.col("edits"))
        & (F.col("n_word") >= F.col("least"))
        & (F.bit_count(F.col("had").bitwiseXOR(F.col("has"))) <= 2 * F.col("edits"))
        & (F.col("word") != F.col("spelling"))
    )
    pairs = near.select("spelling", "n_spelling", "word", "n_word", "edits").distinct()
    return pairs.where(F.levenshtein("spelling", "word", 3).between(0, F.col("edits"))).drop("edits")


def corrections(spellings: DataFrame, counts: DataFrame, ranking: Ranking) -> DataFrame:
    """(spelling, word, cost): the best candidate of every distinct spelling that has one above one half."""
    shared = spellings.sparkSession.sparkContext.broadcast(ranking)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        r = shared.value
        rows = np.array([rank_row(*c, r.confusions) for c in zip(*(batch.column(c).to_pylist() for c in ("spelling", "word", "n_spelling", "n_word")))], dtype=float).reshape(-1, 8)
        return pa.RecordBatch.from_arrays([batch.column("spelling"), batch.column("word"), batch.column("n_word"), pa.array(r.trees.scores(rows)), pa.array(rows[:, 0])], names=["spelling", "word", "n_word", "score", "cost"])

    ranked = map_batches(candidates(spellings, counts), run, "spelling string, word string, n_word bigint, score double, cost double").where("score > 0.5")
    best = written(ranked.groupBy("spelling").agg(F.max(F.struct("score", "n_word", "word", "cost")).alias("b")).select("spelling", "b.word", "b.cost"))
    misread = best.select(F.col("spelling").alias("word"), F.col("word").alias("meant"))  # of a word that is misread itself, the word meant by it
    return best.join(misread, "word", "left").select("spelling", F.coalesce("meant", "word").alias("word"), "cost").where("spelling <> word")


def looked_up(counts: DataFrame) -> DataFrame:
    """(spelling): the words that may be misread ones, however frequent they are; see ``_odd_spelling``."""
    letters = F.length(F.regexp_replace("word", r"\P{L}", ""))
    size = F.length("word")
    return counts.where((size >= 4) & (letters >= 0.6 * size) & (size - letters <= 3) & F.col("word").rlike(r"^[\p{L}\p{N}@·\\\-'$|!]+$")).select(F.col("word").alias("spelling"))


def not_fragments(misread: DataFrame, counts: DataFrame, fixed: DataFrame) -> DataFrame:
    """misread(spelling, end, cost, ...) without spellings at an end of a text that may be the rest of a cut word.

    One there counts unless a known word, itself not misread, ends or starts with it; confusions explain all of it anyway,
    since other edits cost more than a correction may.
    """
    plain = misread.where("end = ''")
    ends = misread.where("end <> ''")
    longer = counts.where((F.col("n") >= LEAST) & (F.length("word") > 4)).select("word").join(fixed.select(F.col("spelling").alias("word")), "word", "left_anti")
    sizes = F.sequence(F.lit(4), F.length("word") - 1)
    rests = F.transform(sizes, lambda k: F.struct(F.right("word", k).alias("spelling"), F.lit("first").alias("end")))
    starts = F.transform(sizes, lambda k: F.struct(F.left("word", k).alias("spelling"), F.lit("last").alias("end")))
    cut = longer.select(F.inline(F.concat(rests, starts))).join(ends.select("spelling", "end").distinct(), ["spelling", "end"], "left_semi").distinct()
    return plain.unionByName(ends.join(cut, ["spelling", "end"], "left_anti"))


def joins(breaks: DataFrame, counts: DataFrame, model: Trees) -> DataFrame:
    """(a, b, c, word): distinct broken words that are one word."""
    forms = breaks.withColumn("j", F.concat("a", "b")).withColumn("h", F.concat("a", F.lit("-"), "b"))
    for key in ("j", "h", "a", "b"):
        forms = forms.join(counts.select(F.col("word").alias(key), F.col("n").alias(f"n_{key}")), key, "left")
    shared = breaks.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = [[v or 0 for v in batch.column(k).to_pylist()] for k in ("n_j", "n_h", "n_a", "n_b")]
        rows = [join_row(*r) for r in zip(*c, batch.column("c").to_pylist())]
        score = shared.value.scores(np.array(rows, dtype=float).reshape(-1, _JOIN_COLUMNS))
        return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("c"), batch.column("j"), pa.array(score)], names=["a", "b", "c", "word", "score"])

    return map_batches(forms, run, "a string, b string, c string, word string, score double").where("score > 0.5").drop("score")


def noise(chunks: DataFrame, pages: DataFrame, id_col: str = "chunk_id", text_col: str = "text", sample: int = SAMPLE, top: int = TOP) -> DataFrame:
    """Distinct (id, kind, token, seen): hyphen, misread, header and page_no; seen is what stands in the text."""
    texts = chunks.where(F.octet_length(text_col) > 0).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = written(word_counts(texts))
    frequent = {r["word"]: r["n"] for r in counts.where(F.col("word").rlike(r"^\p{L}+(?:[-']\p{L}+)*$")).orderBy(F.desc("n"), "word").limit(top).collect()}
    page_rows = bounded_sample(pages.where(F.octet_length("text") > 0).select(F.concat_ws("/", "doc", "page_num").alias("k"), "text"), "k", sample).collect()
    model = Furniture.train([r["text"] for r in page_rows], _some_texts(texts, sample))
    sure = _sure(frequent)
    fixed = written(corrections(looked_up(counts), counts, train_ranking(sure)))
    often = chunks.sparkSession.createDataFrame([(w,) for w in frequent], "spelling string")
    wrong = {r[0] for r in fixed.join(often, "spelling").select("spelling").collect()}  # frequent words at most
    occ = written(occurrences(texts, model, frequent.keys() - wrong).distinct())
    lines = occ.where(F.col("kind").isin("header", "page_no")).select("id", "kind", F.col("a").alias("token"), F.col("a").alias("seen"))
    misread = not_fragments(occ.where("kind = 'spelling'").select("id", F.col("a").alias("spelling"), F.col("b").alias("end")).join(fixed, "spelling"), counts, fixed).select("id", F.lit("misread").alias("kind"), F.col("word").alias("token"), F.col("spelling").alias("seen"))
    whole = joins(occ.where("kind = 'break'").select("a", "b", "c").distinct(), counts, train_joins(sure))
    hyphen = occ.where("kind = 'break'").select("id", "a", "b", "c").join(whole, ["a", "b", "c"]).select("id", F.lit("hyphen").alias("kind"), F.col("word").alias("token"), F.concat("a", F.left("c", F.lit(1)), F.lit("\n"), "b").alias("seen"))
    return lines.unionByName(misread).unionByName(hyphen).distinct().withColumnRenamed("id", id_col)


def _sure(frequent: dict[str, int]) -> dict[str, int]:
    """Frequent words to train on: no confusion leads to them from a word many times as frequent."""
    return {w: n for w, n in frequent.items() if not any(frequent.get(v, 0) > 8 * n for v in _meant(w))}


def _meant(spelling: str):
    for i in range(len(spelling)):
        for k in (1, 2, 3):
            for letters in CONFUSIONS.get(spelling[i : i + k], ()) if i + k <= len(spelling) else ():
                yield spelling[:i] + letters + spelling[i + k :]


def _kind_of(c: str) -> str:
    return "" if not c else "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "." if c in ".!?" else c if c in ",;:-)" else "*"


def pair_features(before: str, after: str, width: int) -> list[str]:
    """What tells whether a line continues the one before; width: of a full line of the text, 0 if it isn't known."""
    end, start, words = _kind_of(before[-1:]), _kind_of(after[:1]), after.split()
    full = "?" if not width else str(min(13, 10 * len(before) // width))
    no_room = bool(width) and len(before) + 1 + len(words[0] if words else "") > width
    entry = _ENTRY.match(after) is not None
    return [
        "1", f"end={end}", f"start={start}", f"both={end}{start}", f"full={full}", f"full={full},{start}", f"full={full},{end}", f"room={no_room},{end}{start}",
        f"entry={entry},{end}", f"entry={entry},{full}", f"common={before.split()[-1:] and before.split()[-1].lower() in COMMON},{start}", f"long={len(before) > _WIDEST},{end}{start}",
    ]


def _wrapped(text: str, width: int) -> list[str]:
    lines = [""]
    for w in text.split():
        if lines[-1] and len(lines[-1]) + 1 + len(w) > width:
            lines.append(w)
        else:
            lines[-1] = f"{lines[-1]} {w}".strip()
    return lines


def _usual_width(lines: list[str]) -> int:
    """The length that three in four lines that may be wrapped don't exceed; 0 without such lines."""
    short = sorted(len(s) for s in lines if 0 < len(s) <= _WIDEST)
    return short[len(short) * 3 // 4] if short else 0


def train_paragraphs(texts: list[str], seed: int = 9) -> np.ndarray:
    """Weights of the line-pair classifier of paragraphs: paragraphs in one line each are wrapped at some width, so that
    where they end is known; and lines of lists, headings and paragraphs in one line don't continue."""
    rng = np.random.default_rng(seed)
    rows, y = [], []
    for text in texts:
        lines = [s for s in map(str.strip, text.split("\n")) if s]
        if any("|" in s or "\t" in s for s in lines):
            continue
        width = int(rng.integers(32, 115))
        whole = [s for s in lines if len(s) > 1.5 * _WIDEST and s[-1] in ".!?:"]
        entries = sum(_ENTRY.match(s) is not None for s in lines) > 0.5 * len(lines)
        for s, t in zip(whole, [*whole[1:], ""]):
            cut = _wrapped(s, width)
            given = 0 if rng.random() < 0.3 else width
            rows += [pair_features(p, q, given) for p, q in zip(cut, cut[1:])]
            y += [1] * (len(cut) - 1)
            if t:
                rows.append(pair_features(cut[-1], _wrapped(t, width)[0], given))
                y.append(0)
        for p, q in zip(lines, lines[1:]):
            if entries or len(p) > 1.5 * _WIDEST or len(p) < 60 and p[-1] not in ",;" and len(q) > 1.5 * _WIDEST:
                rows.append(pair_features(p, q, _usual_width(lines) if entries or rng.random() < 0.5 else width))
                y.append(0)
    return fit(_columns(rows), np.array(y, dtype=float)) if 0 < sum(y) < len(y) else np.zeros(BUCKETS)


def repaired(chunks: DataFrame, pages: DataFrame, id_col: str = "chunk_id", text_col: str = "text", sample: int = SAMPLE, **options) -> DataFrame:
    """(id, text): continuous paragraphs without furniture, breaks joined and misread words put right."""
    found = noise(chunks, pages, id_col, text_col, sample=sample, **options)
    fixes = found.groupBy(id_col).agg(F.collect_set(F.struct("kind", "token", "seen")).alias("fixes"))
    kind = chunks.schema[id_col].dataType.simpleString()
    weights = chunks.sparkSession.sparkContext.broadcast(train_paragraphs(_some_texts(chunks.where(F.octet_length(text_col) > 0).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), sample)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [t if not t else repair(t, f or [], weights.value) for t, f in zip(batch.column("text").to_pylist(), batch.column("fixes").to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], names=["id", "text"])

    rows = chunks.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(fixes.withColumnRenamed(id_col, "id"), "id", "left")
    return map_batches(rows, run, f"id {kind}, text string").distinct().withColumnsRenamed({"id": id_col, "text": text_col})


def _some_texts(texts: DataFrame, sample: int) -> list[str]:
    some = bounded_sample(texts.select("id"), "id", sample)
    return [r["text"] for r in texts.join(F.broadcast(some), "id", "left_semi").limit(2 * sample).collect()]


_ENTRY = re.compile(r"\s*(?:[-*•]|\[ ?\]|\(?\w{1,4}[.)])\s")


def repair(text: str, fixes: list[dict], paragraphs: np.ndarray) -> str:
    """Apply the fixes of one text and join the lines that continue the one before by the weights of ``train_paragraphs``."""
    furniture = {f["seen"] for f in fixes if f["kind"] in ("header", "page_no")}
    whole = {f["seen"] for f in fixes if f["kind"] == "hyphen"}
    words = {f["seen"]: f["token"] for f in fixes if f["kind"] == "misread"}
    text = "\n".join(s for s in text.split("\n") if s.strip() not in furniture or not s.strip())

    for _ in range(2):  # the second pass takes breaks whose left half was the right half of another
        parts, at = [], 0
        for start, end, left, right, hyphen in broken_words(text):
            joined = f"{bare(left)}{hyphen}\n{bare(right)}" in whole
            parts += [text[at:start], left, "" if joined else "-", right]
            at = end
        text = "".join([*parts, text[at:]])

    def word(m: re.Match) -> str:
        raw = m.group()
        meant = words.get(bare(raw))
        if meant is None:
            return raw
        core = _EDGES.sub("", by_table(raw))
        meant = meant.upper() if core.isupper() and len(core) > 1 else meant.capitalize() if core[:1].isupper() else meant
        return by_table(raw).replace(core, meant, 1)

    if words:
        text = re.sub(r"\S+", word, text)
    lines = [s.strip() for s in text.split("\n")]
    width = _usual_width(lines)
    apart = lambda s: not s or "|" in s or "\t" in s  # noqa: E731 - rows of columns stay as they are
    pairs = [(p, q) for p, q in zip(lines, lines[1:]) if not apart(p) and not apart(q)]
    goes_on = iter((paragraphs[_columns([pair_features(p, q, width) for p, q in pairs])].sum(axis=1) > 0).tolist() if pairs else [])
    out = lines[:1]
    for p, s in zip(lines, lines[1:]):
        if not apart(p) and not apart(s) and next(goes_on):
            out[-1] += " " + s
        else:
            out.append(s)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?<=\S) {2,}(?=\S)", " ", "\n".join(out))).strip()


