"""Problem 5: cut oversized texts at natural boundaries, with overlap, by pointer doubling.

For every position s of a text the end of the piece that would start there is fixed by the text alone, so the
start of the next piece is a successor table over positions. All tables of a block of texts are filled at once
from running "last boundary at or before" arrays. The table is then squared again and again: after k squarings
the starts known so far are doubled, so the greedy cuts of all texts come out in log2(pieces) vector steps
instead of one step a piece.

Positions are code points. Null texts and texts within the limit give no pieces; repeated rows give their pieces
once; a null id is kept as a null id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import blocks, map_batches

#: Code points whose successor tables are held at once; a longer text is a block of its own.
BLOCK = 2_000_000

_BLANKS = (32, 9, 10, 13)
_STOPS = (46, 33, 63)


def _last(flags: np.ndarray) -> np.ndarray:
    """At e: the largest e' <= e with flags[e'], or -1."""
    at = np.where(flags, np.arange(flags.size, dtype=np.int64), -1)
    return np.maximum.accumulate(at, out=at)


def cut_points(texts: list[str], limit: int, floor: int, overlap: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Starts and ends of the pieces of each text, all longer than ``limit``."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    n = int(begin[-1])
    blank, stop, feed = np.isin(code, _BLANKS), np.isin(code, _STOPS), code == 10
    after = np.zeros((3, n + 1), dtype=bool)  # at e: the piece may end before e; paragraph, sentence, blank
    after[0, 2:] = feed[1:] & feed[:-1]
    after[1, 2:] = blank[1:] & stop[:-1]
    after[2, 1:] = blank
    stop_at = np.repeat(begin[1:], sizes)
    s = np.arange(n, dtype=np.int64)
    far = np.minimum(s + limit, stop_at)
    end = far.copy()
    open_ = far < stop_at
    for flags in after:
        best = _last(flags)[far]
        use = open_ & (best > s + floor)
        end[use] = best[use]
        open_ &= ~use
    jump = np.where(end < stop_at, end - overlap, n)
    jump = np.append(jump, n)
    reached = begin[:-1]
    step = jump
    while True:
        more = step[reached]
        more = more[more < n]
        if not more.size:
            break
        reached = np.concatenate((reached, more))
        step = step[step]
    reached = np.sort(reached)
    owner = np.searchsorted(begin, reached, side="right") - 1
    parts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [(reached[a:b] - begin[i], end[reached[a:b]] - begin[i]) for i, (a, b) in enumerate(zip(parts[:-1], parts[1:]))]


def split_oversized(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", keep: tuple[str, ...] = (), limit: int = 2400, floor: int = 1200, overlap: int = 320, with_text: bool = False) -> DataFrame:
    """Rows (id, *keep, piece_no, start_pos, end_pos[, piece_text]) of every text longer than ``limit``.

    ``floor`` is the length that a piece must exceed to end at a natural boundary; ``overlap`` must be below it.
    Only the named columns are read, so others may have any names.
    """
    if not 0 <= overlap <= floor < limit:
        raise ValueError("0 <= overlap <= floor < limit must hold")
    src = df.where(F.char_length(F.col(text_col)) > limit).select(F.col(id_col).cast("string").alias("id"), *[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keep)], F.col(text_col).alias("text"))
    names = ["id", *[f"k{i}" for i in range(len(keep))]]
    schema = ", ".join([*[f"{n} string" for n in names], "piece_no bigint, start_pos bigint, end_pos bigint", *(["piece_text string"] if with_text else [])])

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        cuts: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in blocks([len(t) for t in texts], BLOCK):
            cuts += cut_points(texts[a:b], limit, floor, overlap)
        counts = np.array([len(s) for s, _ in cuts])
        row = pa.array(np.repeat(np.arange(len(texts)), counts))
        cols = [batch.column(n).take(row) for n in names]
        cols += [pa.array(np.concatenate([np.arange(1, c + 1, dtype=np.int64) for c in counts])), *(pa.array(np.concatenate([c[k] for c in cuts])) for k in (0, 1))]
        out = [*names, "piece_no", "start_pos", "end_pos"]
        if with_text:
            cols.append(pa.array([t[a:b] for t, (s, e) in zip(texts, cuts) for a, b in zip(s.tolist(), e.tolist())], pa.string()))
            out.append("piece_text")
        return pa.RecordBatch.from_arrays(cols, names=out)

    pieces = map_batches(src, cut, schema)
    pieces = pieces.dropDuplicates(["id", *names[1:], "piece_no", "start_pos", "end_pos"])
    return pieces.withColumnsRenamed({"id": id_col} | {f"k{i}": k for i, k in enumerate(keep)})
