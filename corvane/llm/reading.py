"""Problem 9: reading level of each document from smoothed unigram language models, one per grade level.

The models are trained on at most ``sample`` labelled documents. Each gets the level of the Flesch-Kincaid grade
formula, provided that no annotator's band contradicts it; texts and opinions that disagree train nothing. A
unigram is a word in lower case or the length class of a sentence, so long sentences of easy words and short ones
of hard words are told apart from both ends of the scale. Words unseen in training share the smoothing mass, by
their syllables. The level with the highest posterior likelihood, under a uniform prior, is assigned; its grade
is the posterior mean of the levels' mean grades.

No text in Spanish or French is labelled, so their models are trained on ``sample`` texts at most that the reading ease
formula of the language grades (Fernandez Huerta's, Kandel and Moles'), its ease read as a grade by Flesch's table. A
text whose language isn't stated is scored by the language most of whose training words it has, if these are enough of
its words. Texts in other languages get a row with a null level.

Null and empty texts have no words and get a null level. Repeated rows give a row each.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import bounded_sample, map_batches

#: Upper grade of each level; the last level is open.
LEVELS = (7.0, 11.0, 14.5, 18.0)
#: Labelled documents that train the models.
SAMPLE = 3000
#: Spellings that a worker remembers at once.
MEMO = 1_000_000
#: How many unigrams a sentence's length class counts for.
LENGTH_WEIGHT = 4
#: Share of words met in training from which a text of unstated language is scored.
KNOWN = 0.3
SMOOTHING = 0.5

_LENGTHS = (4, 7, 10, 13, 17, 22, 28, 36)
_SYLLABLES = 6
_VOWELS = re.compile(r"[aeiouyáéíóúäëïöüàèìòùâêîôûãõ]+")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")

# Bands of the annotators and the grades that they stand for.
BANDS = {"plain": (float("-inf"), 7.0), "standard": (7.0, 18.0), "demanding": (18.0, float("inf"))}


# By language, reading ease from 1, syllables per word and words per sentence.
EASE = {"es": (206.84, -60.0, -1.02), "fr": (207.0, -73.6, -1.015)}
# Reading ease and the school grade that it stands for.
_EASE, _GRADE = (-40.0, 0.0, 30.0, 50.0, 60.0, 70.0, 80.0, 90.0, 120.0), (26.0, 20.0, 16.0, 12.0, 9.0, 7.0, 6.0, 5.0, 1.0)


def syllables(word: str) -> int:
    n = len(_VOWELS.findall(word))
    if n > 1 and word.endswith("e") and not word.endswith(("le", "ee")):
        n -= 1
    return max(1, n)


class Spellings(dict):
    """Blank-delimited token to its number; by number: the word's unigram, its syllables, what it does to sentences."""

    def __init__(self, vocabulary: dict[str, int] | None):
        super().__init__()
        self.vocabulary = vocabulary
        self.words: list[str] = []
        self.rows: list[tuple[int, int, bool, bool]] = []

    def __missing__(self, token: str) -> int:
        n = self[token] = len(self.rows)
        word = _EDGES.sub("", token).lower()
        if not any(c.isalpha() for c in word):
            word = ""
        count = syllables(word) if word else 0
        unigram = -1
        if word and self.vocabulary is not None:
            unigram = self.vocabulary.get(word, len(self.vocabulary) + min(count, _SYLLABLES) - 1)
        ends = token == "\n" or token.rstrip("\"'”’)]").endswith((".", "!", "?"))
        self.words.append(word)
        self.rows.append((unigram, count, ends, token == "\n" or not token[0].islower() and not token[0].isdigit()))
        return n


@dataclass
class Counted:
    """A block of texts in numbers; the sentence lengths are those of all texts in order."""

    numbers: np.ndarray
    begin: np.ndarray
    unigram: np.ndarray
    syllables: np.ndarray
    is_word: np.ndarray
    lengths: np.ndarray
    sentence_text: np.ndarray


def count(texts: list[str], spellings: Spellings) -> Counted:
    if len(spellings) > MEMO:
        spellings.clear(), spellings.rows.clear(), spellings.words.clear()
    tokens = [t.replace("\n", " \n ").replace("\r", " ").split(" ") if t else [] for t in texts]
    tokens = [[x for x in t if x] for t in tokens]
    begin = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int64)
    numbers = np.fromiter((n for t in tokens for n in map(spellings.__getitem__, t)), dtype=np.int64, count=int(begin[-1]))
    rows = np.array(spellings.rows, dtype=np.int64).reshape(-1, 4)[numbers] if numbers.size else np.zeros((0, 4), dtype=np.int64)
    unigram, syl, ends, opens = rows[:, 0], rows[:, 1], rows[:, 2].astype(bool), rows[:, 3].astype(bool)
    is_word = syl > 0
    follows = np.append(opens[1:], True)
    last = ends & follows
    last[begin[1:][np.diff(begin) > 0] - 1] = True
    stops = np.flatnonzero(last)
    words_before = np.concatenate(([0], np.cumsum(is_word)))
    lengths = np.diff(np.concatenate(([0], words_before[stops + 1])))
    owner = np.searchsorted(begin, stops, side="right") - 1
    full = lengths > 0
    return Counted(numbers, begin, unigram, syl, is_word, lengths[full], owner[full])


def grades(c: Counted, lang: str = "en") -> tuple[np.ndarray, np.ndarray]:
    """Grade by the formula of the language (Flesch-Kincaid for English) and number of words of each text; nan without words."""
    n = c.begin.size - 1
    owner = np.repeat(np.arange(n), np.diff(c.begin))
    words = np.bincount(owner[c.is_word], minlength=n)
    syl = np.bincount(owner, weights=c.syllables, minlength=n)
    sentences = np.bincount(c.sentence_text, minlength=n)
    with np.errstate(divide="ignore", invalid="ignore"):
        if lang in EASE:
            base, per_word, per_sentence = EASE[lang]
            ease = base + per_word * syl / words + per_sentence * words / np.maximum(sentences, 1)
            return np.where(words > 0, np.interp(ease, _EASE, _GRADE), np.nan), words
        return np.where(words > 0, 0.39 * words / np.maximum(sentences, 1) + 11.8 * syl / words - 15.59, np.nan), words


@dataclass
class Models:
    vocabulary: dict[str, int]
    logs: np.ndarray  # by unigram and level; words, then unseen words by syllables, then length classes
    level_grade: np.ndarray
    trained_on: list[int] = field(default_factory=list)

    @classmethod
    def train(cls, texts: list[str], bands: list[str | None], lang: str = "en") -> Models:
        spellings = Spellings(None)
        c = count(texts, spellings)
        grade, words = grades(c, lang)
        low, high = (np.array([BANDS.get(b, BANDS["standard"])[k] if b in BANDS else (-np.inf, np.inf)[k] for b in bands]) for k in (0, 1))
        use = (words > 0) & (grade > low) & (grade <= high)
        level = np.searchsorted(LEVELS, grade)
        names = sorted({w for w in spellings.words if w})
        vocabulary = {w: i for i, w in enumerate(names)}
        v, g = len(names), len(LEVELS) + 1
        size = v + _SYLLABLES + len(_LENGTHS) + 1
        counts = np.zeros((size, g))
        word_of = np.array([vocabulary.get(w, -1) for w in spellings.words], dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), np.diff(c.begin))
        ok = c.is_word & use[owner]
        np.add.at(counts, (word_of[c.numbers[ok]], level[owner[ok]]), 1)
        once = counts[:v].sum(axis=1) <= 2  # rare words stand for the unseen ones
        by_syllables = np.minimum(np.array([syllables(w) for w in names], dtype=int), _SYLLABLES) - 1 if v else np.zeros(0, dtype=int)
        np.add.at(counts, (v + by_syllables[once],), counts[:v][once])
        ok = use[c.sentence_text]
        np.add.at(counts, (v + _SYLLABLES + np.searchsorted(_LENGTHS, c.lengths[ok]), level[c.sentence_text[ok]]), LENGTH_WEIGHT)
        mean = counts.sum(axis=1, keepdims=True)
        background = (mean + 1) / (mean + 1).sum()
        logs = np.log((counts + SMOOTHING * size * background * 0.2) / (counts.sum(axis=0) + SMOOTHING * size * 0.2))
        middle = np.array([grade[use & (level == i)].mean() if (use & (level == i)).any() else m for i, m in enumerate((4.0, 9.0, 13.0, 16.0, 22.0))])
        empty = [i for i in range(g) if not (use & (level == i)).any()]
        logs[:, empty] = np.log(background) - 1.0  # a level without examples is never preferred
        return cls(vocabulary, logs, middle, np.bincount(level[use], minlength=g).tolist())

    def score(self, c: Counted) -> tuple[np.ndarray, np.ndarray]:
        """Level and posterior mean grade of each text; level -1 without words."""
        n, g = c.begin.size - 1, self.logs.shape[1]
        owner = np.repeat(np.arange(n), np.diff(c.begin))[c.is_word]
        total = np.zeros((n, g))
        words, classes = c.unigram[c.is_word], len(self.vocabulary) + _SYLLABLES + np.searchsorted(_LENGTHS, c.lengths)
        for k in range(g):
            column = self.logs[:, k]
            total[:, k] = np.bincount(owner, weights=column[words], minlength=n) + LENGTH_WEIGHT * np.bincount(c.sentence_text, weights=column[classes], minlength=n)
        seen = np.bincount(owner, minlength=n) > 0
        p = np.exp(total - total.max(axis=1, keepdims=True)) if n else total
        p /= p.sum(axis=1, keepdims=True)
        return np.where(seen, total.argmax(axis=1), -1), np.where(seen, p @ self.level_grade, np.nan)


def train_models(docs: DataFrame, labels: DataFrame, lang: str = "en", sample: int = SAMPLE) -> Models:
    """``sample`` labelled documents at most are fetched, in a language without labels as many of its documents, chosen by the hash of their id."""
    texts = docs.where((F.col("lang") == lang) & (F.octet_length("text") > 0)).select("doc_id", "text")
    if lang in EASE:
        chosen = bounded_sample(texts.select("doc_id"), "doc_id", sample).withColumn("band", F.lit(None).cast("string"))
    else:
        chosen = bounded_sample(labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.when(F.count_distinct("band") == 1, F.max("band")).alias("band")), "doc_id", sample)
    rows = texts.join(F.broadcast(chosen.dropDuplicates(["doc_id"])), "doc_id").orderBy("doc_id").limit(sample).collect()
    return Models.train([r["text"] for r in rows], [r["band"] for r in rows], lang)


def reading_levels(docs: DataFrame, labels: DataFrame, lang: str = "en", sample: int = SAMPLE, everything: bool = False) -> DataFrame:
    """Rows (doc_id, words, level, grade, band) of every document in ``lang``, or of every document at all.

    band is plain for the lowest level, demanding for the highest, else standard; null without words and for
    texts in languages that no model is for.
    """
    shared = docs.sparkSession.sparkContext.broadcast({k: train_models(docs, labels, k, sample) for k in ([lang, *(k for k in EASE if k != lang)] if everything else [lang])})
    kind = docs.schema["doc_id"].dataType.simpleString()
    state: dict = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, given, n = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.num_rows
        words, level, grade, known = np.zeros(n, dtype=np.int64), np.full(n, -1), np.full(n, np.nan), np.full(n, KNOWN)
        for k, models in shared.value.items():
            spellings = state.setdefault(k, Spellings(models.vocabulary))
            mine = np.array([i for i, x in enumerate(given) if x is None or x == k or x not in shared.value and k == lang], dtype=np.int64)
            c = count([texts[i] for i in mine], spellings)
            found, graded = models.score(c)
            owner = np.repeat(np.arange(mine.size), np.diff(c.begin))[c.is_word]
            of = np.bincount(owner, minlength=mine.size)
            met = np.bincount(owner[c.unigram[c.is_word] < len(models.vocabulary)], minlength=mine.size) / np.maximum(of, 1)
            stated = np.array([given[i] == k for i in mine], dtype=bool)
            unstated = np.array([given[i] is None for i in mine], dtype=bool)
            take = stated | unstated & (met >= known[mine])
            known[mine[unstated & take]] = np.nextafter(met[unstated & take], 2)
            words[mine] = np.maximum(words[mine], of)
            level[mine[take]], grade[mine[take]] = found[take], graded[take]
        none = level < 0
        top = len(LEVELS)
        band = [None if x < 0 else "plain" if x == 0 else "demanding" if x == top else "standard" for x in level.tolist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(level, pa.int32(), mask=none), pa.array(grade, pa.float64(), mask=none), pa.array(band, pa.string())], names=["doc_id", "words", "level", "grade", "band"])

    src = (docs if everything else docs.where(F.col("lang") == lang)).select("doc_id", "text", "lang")
    return map_batches(src, run, f"doc_id {kind}, words bigint, level int, grade double, band string")
