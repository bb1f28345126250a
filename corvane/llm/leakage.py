"""Problem 8: passages of held-out test items inside corpus documents, found through an FM-index per shard.

A shard is a block of documents as they arrive in an Arrow batch. Its words are mapped to the numbers of the test
items' words. A stretch of L words with at most L/10 replaced holds an exact run of at least
(L - L//10) / (L//10 + 1) words, so every qualifying stretch of an item contains one of its word k-grams, k being the least
such run for the lengths that qualify. k grows with the item, so items are searched in classes of equal k: a short
item doesn't make every word of the long ones a seed. All k-grams of a class are looked up by backward search and their
occurrences located; the diagonal (document, item, shift) of each is then compared word by word, and the stretches on
it that are long enough, with at most one word in ten replaced, are found in one pass over it. Those of a document and
item that overlap merge, those that don't are rows of their own.

Items go to the executors in blocks of at most BLOCK_WORDS words; the documents are read once for each block. Documents are
only scanned: no shuffle but the one that drops repeats. Words are compared in lower case with marks, tags and
entities removed. Null and empty texts and items match nothing; repeated documents and items give their rows once.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import blocks, map_batches
from corvane.llm.fmindex import FMIndex

#: Words of test items that are sent to every executor at once.
BLOCK_WORDS = 4_000_000
#: Words of a shard.
SHARD_WORDS = 2_000_000
#: Distinct spellings that a worker remembers at once.
MEMO = 1_000_000

_MARKUP = re.compile(r"<[^<>]+>|&(?:[a-zA-Z]{2,8}|#\d{1,7});")
_TOKEN = re.compile(r"\S+")
_MARKS = re.compile(r"[\W_]+")


def plain_word(token: str) -> str:
    """A blank-delimited token in the form that is compared; '' if it is only marks."""
    if not token.isascii():
        token = unicodedata.normalize("NFKC", token)
    return _MARKS.sub("", token).lower()


def words_of(text: str) -> list[str]:
    return [w for w in map(plain_word, tokens_of(text)) if w]


def _unmarked(text: str) -> str:
    """The text with blanks in the place of tags and entities, so that characters keep their places."""
    return _MARKUP.sub(lambda m: " " * len(m.group()), text) if "<" in text or "&" in text else text


def tokens_of(text: str) -> list[str]:
    return _unmarked(text).split()


def word_places(text: str) -> list[tuple[int, int]]:
    """[start, end) in the text of every word that ``words_of`` gives."""
    return [m.span() for m in _TOKEN.finditer(_unmarked(text)) if plain_word(m.group())]


def needed(words: int, share: float) -> int:
    """Words that are at least this share of an item."""
    return max(1, math.ceil(words * share - 1e-9))


def seed_length(n: int, share: float, replaced: int) -> int:
    """Words in a row that every qualifying stretch of an item of ``n`` words has in common with it."""
    first = needed(n, share)
    sizes = {first, *(size for size in range(-(-first // replaced) * replaced, n + 1, replaced))}  # a run is shortest where one more word may be replaced
    return max(1, min(-(-(size - size // replaced) // (size // replaced + 1)) for size in sizes))


@dataclass
class Items:
    ids: list[str]
    words: list[np.ndarray]  # numbers of the words, from 1
    vocabulary: dict[str, int]
    grams: list[tuple[np.ndarray, list[np.ndarray]]]  # by class: distinct k-grams, a row each, and of each its rows (item, offset)
    share: float
    replaced: int

    @classmethod
    def build(cls, rows: list[tuple[str, str]], share: float, replaced: int) -> Items:
        vocabulary: dict[str, int] = {}
        ids, words = [], []
        for item, text in sorted({(i, t) for i, t in rows if i is not None and t}):
            w = words_of(text)
            if w:
                ids.append(item)
                words.append(np.array([vocabulary.setdefault(x, len(vocabulary) + 1) for x in w], dtype=np.int32))
        classes: dict[int, dict[tuple, list]] = {}
        for i, w in enumerate(words):
            k = seed_length(w.size, share, replaced)
            found = classes.setdefault(k, {})
            for j in range(w.size - k + 1):
                found.setdefault(tuple(w[j : j + k].tolist()), []).append((i, j))
        grams = [(np.array(list(f), dtype=np.int64).reshape(len(f), k), [np.array(v) for v in f.values()]) for k, f in sorted(classes.items())]
        return cls(ids, words, vocabulary, grams, share, replaced)


class _Numbers(dict):
    """Spelling to number: 0 for a word that no item has, -1 for marks only."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, token: str) -> int:
        w = plain_word(token)
        if len(self) > MEMO:
            self.clear()
        n = self[token] = self.vocabulary.get(w, 0) if w else -1
        return n


def stretches(same: np.ndarray, replaced: int, need: int) -> list[tuple[int, int, int]]:
    """(a, b, longest): the [a, b) of at least ``need`` words in which at most one in ``replaced`` is False, merged where
    they overlap, without replaced words at their ends, and the words of the longest one in each.

    [a, b) qualifies if replaced * wrong <= length: with s[i] = i - replaced * wrong before i that is s[b] >= s[a]. The
    furthest such b of every a comes from the suffix maxima of s, so this is n log n in the words of a diagonal.
    """
    s = np.arange(same.size + 1) - replaced * np.concatenate(([0], np.cumsum(~same)))
    best = np.maximum.accumulate(s[::-1])[::-1]  # non-increasing
    ends = np.searchsorted(-best, -s, side="right") - 1
    right = np.flatnonzero(same)
    out: list[list[int]] = []
    for a in np.flatnonzero(ends - np.arange(s.size) >= need).tolist():
        b = int(ends[a])
        if out and a < out[-1][1]:
            out[-1][1:] = [max(b, out[-1][1]), max(b - a, out[-1][2])]
        else:
            out.append([a, b, b - a])
    return [(int(right[np.searchsorted(right, a)]), int(right[np.searchsorted(right, b) - 1]) + 1, size) for a, b, size in out]


def _seeds(items: Items, grams: np.ndarray, uses: list[np.ndarray], index: FMIndex, back: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Distinct rows (document, item, place of the item's first word) of the diagonals that have a k-gram in common."""
    lo, hi = index.search(grams)
    hit = np.flatnonzero(hi > lo)
    if not hit.size:
        return np.zeros((0, 3), dtype=np.int64)
    counts = hi[hit] - lo[hit]
    rows = np.repeat(lo[hit] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(int(counts.sum()))
    place = back[index.locate(rows)]
    used = [uses[g] for g in hit]
    times = np.repeat(np.array([len(u) for u in used]), counts)
    use = np.concatenate([np.tile(u, (n, 1)) for u, n in zip(used, counts.tolist())])
    at = np.repeat(place, times)
    return np.unique(np.stack((np.searchsorted(begin, at, side="right") - 1, use[:, 0], at - use[:, 1]), axis=1), axis=0)


def search_shard(items: Items, numbers: np.ndarray, begin: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(document, item, first word, end, words of the longest stretch in it) of the leaks in ``numbers``; begin: where
    each document's words begin, and the end. Stretches of one item that overlap in a document are one row."""
    n = numbers.size
    out: list[tuple[int, int, int, int, int]] = []
    if not n or not items.grams:
        return out
    inside = numbers > 0
    edge = np.zeros(n, dtype=bool)
    edge[begin[:-1][begin[:-1] < n]] = True
    new_run = inside & (edge | ~np.concatenate(([False], inside[:-1])))
    run = np.cumsum(new_run)
    sizes = np.bincount(run[inside], minlength=run[-1] + 1)
    source = np.flatnonzero(inside & (sizes[run] >= items.grams[0][0].shape[1]))
    if not source.size:
        return out
    shift = np.zeros(source.size, dtype=np.int64)
    shift[np.flatnonzero(np.diff(run[source])) + 1] = 1
    spots = np.arange(source.size) + np.cumsum(shift)
    seq = np.zeros(int(spots[-1]) + 2, dtype=np.int64)
    seq[spots] = numbers[source]
    back = np.full(seq.size, -1, dtype=np.int64)
    back[spots] = source
    index = FMIndex(seq, max(1, len(items.vocabulary).bit_length()))
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for grams, uses in items.grams:
        for d, i, start in _seeds(items, grams, uses, index, back, begin).tolist():
            w = items.words[i]
            need = needed(w.size, items.share)
            a, b = max(start, int(begin[d])), min(start + w.size, int(begin[d + 1]))
            same = numbers[a:b] == w[a - start : b - start]
            if same.sum() >= need - need // items.replaced:
                for s, e, size in stretches(same, items.replaced, need):
                    found.setdefault((d, i), []).append((a + s - int(begin[d]), a + e - int(begin[d]), size))
    for (d, i), spans in found.items():
        merged: list[list[int]] = []
        for s, e, size in sorted(spans):
            if merged and s < merged[-1][1]:
                merged[-1][1:] = [max(e, merged[-1][1]), max(size, merged[-1][2])]
            else:
                merged.append([s, e, size])
        out += [(d, i, s, e, size) for s, e, size in merged]
    return sorted(out)


def _blocks_of_items(items: DataFrame, item_id: str, item_text: str, words: int) -> list[list[tuple[str, str]]]:
    """The items in blocks of about ``words`` words, chosen by the hash of their id; one block, maybe empty, at least."""
    rows = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    total = rows.agg(F.sum(F.size(F.split("t", r"\s+")))).first()[0] or 0
    n = max(1, -(-total // words))
    return [[(r["i"], r["t"]) for r in rows.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k).collect()] for k in range(n)]


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "id", item_text: str = "query", share: float = 0.4, replaced: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows (doc id, item_id, first_word, end_word, start_pos, end_pos, item_share): the leaked stretches of an item in a document.

    first_word and end_word count the document's words from 0, the end exclusive; start_pos and end_pos are the
    characters that they take up in the text as it is stored; item_share is the longest stretch's part of the item's
    words. Stretches that overlap are one row, others, as of a second copy, rows of their own.
    """
    found = None
    for rows in _blocks_of_items(items, item_id, item_text, block_words):
        spans = _search(docs, Items.build(rows, share, replaced), id_col, text_col)
        found = spans if found is None else found.unionByName(spans)
    return found.distinct().withColumnRenamed("id", id_col)


def _search(docs: DataFrame, built: Items, id_col: str, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(built)
    kind = docs.schema[id_col].dataType.simpleString()
    state: dict = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        its = shared.value
        numbers = state.setdefault("numbers", _Numbers(its.vocabulary))
        found, owner, places = [], [], []
        texts = batch.column(1).to_pylist()
        tokens = [tokens_of(t) if t else [] for t in texts]
        for a, b in blocks([len(t) for t in tokens], SHARD_WORDS):
            parts = []
            for t in tokens[a:b]:
                x = np.fromiter(map(numbers.__getitem__, t), dtype=np.int32, count=len(t))
                parts.append(x[x >= 0])
            begin = np.concatenate(([0], np.cumsum([p.size for p in parts])))
            for g in search_shard(its, np.concatenate(parts), begin):
                if not owner or owner[-1] != a + g[0]:
                    spots = word_places(texts[a + g[0]])
                owner.append(a + g[0])
                found.append(g)
                places.append((spots[g[2]][0], spots[g[3] - 1][1]))
        if not found:
            return None
        cols = [batch.column(0).take(pa.array(owner)), pa.array([its.ids[g[1]] for g in found], pa.string())]
        cols += [pa.array([g[c] for g in found], pa.int64()) for c in (2, 3)]
        cols += [pa.array([p[c] for p in places], pa.int64()) for c in (0, 1)]
        cols.append(pa.array([g[4] / its.words[g[1]].size for g in found], pa.float64()))
        return pa.RecordBatch.from_arrays(cols, names=["id", "item_id", "first_word", "end_word", "start_pos", "end_pos", "item_share"])

    src = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(src, run, f"id {kind}, item_id string, first_word bigint, end_word bigint, start_pos bigint, end_pos bigint, item_share double")
