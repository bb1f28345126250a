"""Greedy packing of paragraphs and sections into overlapping chunks.

Packing is a fold: where a chunk ends depends on all that went before in its article or chapter. So the fold runs
over one row for each article or chapter, in Arrow batches; words are counted once for each piece and sums of counts
stand for the counts of joined text.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.segment import PARAGRAPH_STARTS

SIZE, LEAST = 600, 20


def estimate(words: int) -> int:
    return max(1, int(words * 1.3))


def count(text: str) -> int:
    return len(text.split())


@dataclass
class Fold:
    """Joins pieces while they fit; what is full goes to ``done`` with the labels of its pieces."""

    size: int
    sep: str
    done: list[tuple[str, list]] = field(default_factory=list)
    text: str = ""
    words: int = 0
    labels: list = field(default_factory=list)

    def fits(self, words: int) -> bool:
        return estimate(self.words + words) <= self.size

    def add(self, piece: str, label=None) -> None:
        n = count(piece)
        if self.text and not self.fits(n):
            self.flush()
        self.text = f"{self.text}{self.sep}{piece}".strip() if self.text else piece.strip()
        self.words += n
        self.labels.append(label)

    def flush(self) -> None:
        if self.text.strip():
            self.done.append((self.text, self.labels))
        self.text, self.words, self.labels = "", 0, []


def split_paragraphs(text: str, start: re.Pattern, whole_up_to: int) -> list[str]:
    out = []
    for block in re.split(r"\n{2,}", text):
        rows = block.split("\n")
        cuts = [0, *([] if len(rows) <= whole_up_to else [i for i in range(1, len(rows)) if start.match(rows[i])]), len(rows)]
        out += ["\n".join(rows[a:b]).strip() for a, b in zip(cuts, cuts[1:])]
    return [p for p in out if p]


def pack_article(text: str, size: int = SIZE) -> list[str]:
    """Chunks of one article; a paragraph over the size is packed by sentences, and its rest stays open for the next."""
    fold = Fold(size, "\n")
    for p in split_paragraphs(text, re.compile(PARAGRAPH_STARTS["article"]), 2):
        n = count(p)
        if estimate(n) <= size or (not fold.text and estimate(n) <= size):
            fold.add(p)
            continue
        fold.flush()
        inner = Fold(size, " ")
        for s in re.split(r"(?<=[.;])\s+", p):
            inner.add(s)
        fold.done += inner.done
        fold.text, fold.words, fold.labels = inner.text, inner.words, inner.labels
    fold.flush()
    return [t for t, _ in fold.done]


# By style, what joins the paragraphs of a large section, and up to how many lines a block stays whole.
SEPARATORS = {"numbered": "\n", "capitals": "\n\n", "letters": "\n", "sentence": "\n\n", "section": "\n\n"}
WHOLE_UP_TO = {"numbered": 2, "capitals": 2, "letters": 2, "sentence": 0, "section": 0}


def pack_chapter(sections: list[tuple[str, object]], style: str = "section", size: int = SIZE) -> list[tuple[str, list]]:
    """Chunks of a chapter's (text, label) sections: small neighbours merge, large sections are packed by paragraphs."""
    start = re.compile(PARAGRAPH_STARTS[style])
    sep = SEPARATORS[style]
    fold = Fold(size, "\n\n")
    for text, label in sections:
        if estimate(count(text)) <= size:
            fold.add(text, label)
            continue
        fold.flush()
        inner = Fold(size, sep)
        for p in split_paragraphs(text, start, WHOLE_UP_TO[style]):
            if style == "section" and estimate(count(p)) > size:
                by_sentence = Fold(size, "  ")
                for s in re.split(r"(?<=[.!?])  ?(?=[A-Z])", p):
                    by_sentence.add(s)
                by_sentence.flush()
                for t, _ in by_sentence.done:
                    inner.add(t, label)
            else:
                inner.add(p, label)
        inner.flush()
        fold.done += [(t, [label]) for t, _ in inner.done]
    fold.flush()
    return fold.done


def overlap_raw(chunks: list[str], chars: int = 400) -> list[str]:
    """Each chunk after the last characters of the raw chunk before it."""
    return [c if not i else f"{chunks[i - 1][-chars:]}\n\n{c}" for i, c in enumerate(chunks)]


def overlap_cascading(chunks: list[str], chars: int = 320) -> list[str]:
    """Each chunk after the last characters of the chunk before it, which already has its own overlap."""
    out: list[str] = []
    for c in chunks:
        out.append(f"{out[-1][-chars:]}\n\n{c}" if out else c)
    return out


def _hash(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()[:8]


_FIELDS = "chunk_id string, content_hash string, source string, doc_path string, section string, article_number string, article_title string, total_chunks_in_article int, section_number string, section_title string, chapter_number string, chapter_title string, page_start int, page_end int, heading_path array<string>, chunk_index int, token_estimate int, text string"
_NAMES = [f.split()[0] for f in _FIELDS.split(", ")]


def _batch(rows: list[dict]) -> pa.RecordBatch:
    ints = {"total_chunks_in_article", "page_start", "page_end", "chunk_index", "token_estimate"}
    kind = lambda n: pa.int32() if n in ints else pa.list_(pa.string()) if n == "heading_path" else pa.string()
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kind(n)) for n in _NAMES], names=_NAMES)


def article_chunks(articles: DataFrame, size: int = SIZE, overlap: int = 100) -> DataFrame:
    """Chunk records of articles(doc, key, title, page_start, page_end, text); chunks of under 20 tokens are dropped after the overlap."""

    def run(batches):
        for batch in batches:
            rows = []
            for a in batch.to_pylist():
                texts = [t.strip() for t in overlap_raw(pack_article(a["text"] or "", size), overlap * 4)]
                kept = [t for t in texts if estimate(count(t)) >= LEAST]
                for i, t in enumerate(kept):
                    rows.append(
                        {"chunk_id": f"{a['doc']}_{a['key'].zfill(3)}_{i:03d}", "content_hash": _hash(t), "source": a["doc"], "doc_path": a["doc"], "section": "Punitive Articles", "article_number": a["key"], "article_title": a["title"], "page_start": a["page_start"], "page_end": a["page_end"],
                         "heading_path": ["Part IV", "Punitive Articles", f"Article {a['key']}"], "chunk_index": i, "total_chunks_in_article": len(kept), "token_estimate": estimate(count(t)), "text": t}
                    )
            yield _batch(rows)

    return articles.select("doc", "key", "title", "page_start", "page_end", "text").mapInArrow(run, _FIELDS)


def chapter_chunks(sections: DataFrame, style: str = "section", size: int = SIZE, overlap: int = 80) -> DataFrame:
    """Chunk records of sections(doc, chapter, key, title, page_start, page_end, pos, text).

    A chunk has the labels of its first section and the last page of its last one. Chunks of under 20 tokens are
    dropped before the overlap, but the counter runs on, so chunk_index has gaps.
    """
    chapters = sections.groupBy("doc", "chapter").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "title", "page_start", "page_end", "text"))).alias("sections"))

    def run(batches):
        for batch in batches:
            rows = []
            for c in batch.to_pylist():
                packed = pack_chapter([(s["text"] or "", s) for s in c["sections"]], style, size)
                kept = [(i, t, labels) for i, (t, labels) in enumerate(packed) if estimate(count(t)) >= LEAST]
                chapter = c["chapter"] or ""
                for (i, raw, labels), t in zip(kept, overlap_cascading([t for _, t, _ in kept], overlap * 4)):
                    first, last = labels[0], labels[-1]
                    rows.append(
                        {"chunk_id": f"{c['doc']}_ch{chapter.zfill(2)}_{i:04d}", "content_hash": _hash(raw), "source": c["doc"], "doc_path": c["doc"], "section": f"Chapter {chapter}", "section_number": first["key"], "section_title": first["title"], "chapter_number": chapter, "page_start": first["page_start"],
                         "page_end": last["page_end"], "heading_path": [f"Chapter {chapter}", f"Section {first['key']}", first["title"]], "chunk_index": i, "token_estimate": estimate(count(t)), "text": t}
                    )
            yield _batch(rows)

    return chapters.mapInArrow(run, _FIELDS)


def statistics(chunks: DataFrame, by: str = "source") -> DataFrame:
    """(by, n_chunks, min_tokens, avg_tokens, max_tokens); the average is cut to a whole number."""
    return chunks.groupBy(by).agg(F.count("*").alias("n_chunks"), F.min("token_estimate").alias("min_tokens"), F.floor(F.avg("token_estimate")).alias("avg_tokens"), F.max("token_estimate").alias("max_tokens"))
