"""Problem 7: token ids of every text by a public byte-level BPE, as a monoid tree reduction.

A text is halved recursively down to leaves, the leaves are encoded, and neighbours are joined on the way up. A join
re-encodes a window around the seam and grows it, twice as far each time, until the tokens outside provably stand: the
window must have a safe cut on either side of the seam (or reach that end of the text), and between the outermost and
the next safe cut on each side its tokens must be those that the part already has. A safe cut is a byte that is a plain
blank behind a visible ASCII character: no match of the split pattern spans it, since every alternative takes
blanks only at its start or is all blanks, and nothing in the pattern looks back. So the tokens left and right of it
are those of the whole text, whatever stands on the other side. Decoding halves the ids and concatenates the bytes up
the tree.

Null and empty texts give empty lists; an empty list is decoded to ''. The vocabulary is read on the driver and sent to
the executors.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import map_batches

#: Where the vocabulary files lie unless the caller names another folder.
TOKENIZERS = os.environ.get("CORVANE_TOKENIZERS", "/opt/tokenizers")
#: Bytes of a leaf at most, and how far the first window of a join reaches to either side.
LEAF, REACH = 512, 32
#: Ids that decoding looks up at once.
IDS = 256

# Fixed value: the split pattern published with this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_SAFE = re.compile(rb"[!-~](?=[ \t\n\r])")


def vocabulary(folder: str, name: str) -> bytes:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return f.read()


@dataclass
class Coder:
    """Ids of a piece of text by the library, and the bytes of every id."""

    encode: Callable[[str], list[int]]
    parts: list[bytes]
    sizes: list[int]

    @classmethod
    def of(cls, data: bytes, name: str) -> Coder:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        parts = [b""] * (max(ranks.values()) + 1)
        for token, n in ranks.items():
            parts[n] = token
        return cls(tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, parts, [len(p) for p in parts])


_workers: dict[tuple[str, int, int], Coder] = {}


def _worker_coder(shared, name: str) -> Coder:
    """The coder of a broadcast vocabulary; a worker keeps it from task to task."""
    key = (name, len(shared.value), crc32(shared.value))
    if key not in _workers:
        _workers.clear()
        _workers[key] = Coder.of(shared.value, name)
    return _workers[key]


@lru_cache(maxsize=4)
def coder(folder: str, name: str) -> Coder:
    return Coder.of(vocabulary(folder, name), name)


def _start_of_character(data: bytes, at: int) -> int:
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _place(ids: list[int], length: int, sizes: list[int], backwards: bool = False) -> int:
    """How many of the first (or last) ids make up ``length`` bytes."""
    n = 0
    while length > 0:
        length -= sizes[ids[-1 - n if backwards else n]]
        n += 1
    return n


def _join(data: bytes, a: int, seam: int, b: int, x: list[int], y: list[int], coder: Coder, reach: int) -> list[int]:
    """The ids of bytes [a, b) from those of [a, seam) and [seam, b)."""
    sizes = coder.sizes
    while True:
        lo, hi = _start_of_character(data, max(a, seam - reach)), _start_of_character(data, min(b, seam + reach))
        cuts = [m.end() for m in _SAFE.finditer(data, lo, hi)]
        before, after = [c for c in cuts if c <= seam], [c for c in cuts if c >= seam]
        if (lo == a or len(before) > 1) and (hi == b or len(after) > 1):
            window = coder.encode(data[lo:hi].decode("utf-8"))
            stands, first, last, left, right = True, 0, len(window), 0, len(y)
            if lo > a:  # ids of the left part behind its cut: the first of them are the window's, too
                first, left = _place(window, before[0] - lo, sizes), len(x) - _place(x, seam - before[0], sizes, True)
                n = _place(window[first:], before[1] - before[0], sizes)
                stands = window[first : first + n] == x[left : left + n]
            if hi < b:
                last, right = len(window) - _place(window, hi - after[-1], sizes, True), _place(y, after[-1] - seam, sizes)
                n = _place(window[:last], after[-1] - after[-2], sizes, True)
                stands = stands and n <= right and window[last - n : last] == y[right - n : right]
            if stands or lo == a and hi == b:
                return x[:left] + window[first:last] + (y[right:] if hi < b else [])
        reach *= 2


def encode_tree(text: str, coder: Coder, leaf: int = LEAF, reach: int = REACH) -> list[int]:
    data = text.encode("utf-8")

    def part(a: int, b: int) -> list[int]:
        middle = _start_of_character(data, (a + b) // 2)
        if b - a <= leaf or middle <= a:
            return coder.encode(data[a:b].decode("utf-8"))
        return _join(data, a, middle, b, part(a, middle), part(middle, b), coder, reach)

    return part(0, len(data))


def decode_tree(ids: list[int], coder: Coder, leaf: int = IDS) -> str:
    def part(a: int, b: int) -> bytes:
        if b - a <= leaf:
            return b"".join([coder.parts[i] for i in ids[a:b]])
        return part(a, (a + b) // 2) + part((a + b) // 2, b)

    return part(0, len(ids)).decode("utf-8")


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str | None = None, leaf: int = LEAF) -> DataFrame:
    """Rows (id, ids array<int>), one for every row of ``df``, repeated rows included."""
    run_name, shared = name, df.sparkSession.sparkContext.broadcast(vocabulary(folder or TOKENIZERS, name))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        mine = _worker_coder(shared, run_name)
        lists = [encode_tree(t, mine, leaf) if t else [] for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], names=["id", "ids"])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(src, run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_corpus(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """Rows (id, text) of rows (id, ids); null ids give a null text, empty ones ''."""
    run_name, shared = name, df.sparkSession.sparkContext.broadcast(vocabulary(folder or TOKENIZERS, name))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        mine = _worker_coder(shared, run_name)
        texts = [None if x is None else decode_tree(x, mine) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return map_batches(df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), run, f"id {kind}, text string").withColumnRenamed("id", id_col)
