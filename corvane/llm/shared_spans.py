"""Problem 3: long spans that stand verbatim in more than one record.

The tokens are code points. Rabin-Karp hashes of windows are counted in Spark, in two passes. The first finds where a
window of ``length`` tokens may be repeated at all: of each ``length - gram + 1`` windows of ``gram`` tokens in a row, which
is what a window of ``length`` holds, the least hash is the same wherever that window stands, so only these least
ones are counted. A window of ``length`` whose least one stands in a single text can't be repeated. The second pass counts
every other window of ``length``, each by 96 bits of two hashes. Windows that more than one text has are the
repeated ones; those of a text that overlap or touch merge into its maximal intervals.

The texts that share a window are a class; consecutive windows mostly have the same class, which is told from others
by its size and two sums over its members, so each class is expanded once. All counts are combined before the shuffle,
and a window in very many texts costs a row for each. Equal texts are one text throughout and are only expanded
into their ids at the end.

Null texts and texts shorter than ``length`` share nothing. An id delivered again with the same text counts once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import blocks, bounded_sample, map_batches, written

#: Code points that are hashed at once.
BLOCK = 1 << 20
#: Bits of the table that leaves out texts without a suspect window before texts are shuffled; a power of two.
FILTER_BITS = 1 << 26
#: Texts that are looked at for hot windows, and the part of them that must have one.
SAMPLE, HOT = 2000, 0.01
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(BLOCK, 1 << int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        tables = []
        for base in (_BASE, _INVERSE):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=np.uint64))
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


def window_hashes(code: np.ndarray, width: int, symbol: int = 0xBF58476D1CE4E5B9) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2**64, of all windows of ``width`` tokens, mixed at the end; ``symbol`` picks the hash."""
    n = code.size
    if n < width:
        return np.zeros(0, dtype=np.uint64)
    up, down = _power_tables(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    symbols = (code.astype(np.uint64) + np.uint64(0x51ED27)) * np.uint64(symbol)
    symbols ^= symbols >> np.uint64(31)
    symbols *= up[:n]
    np.cumsum(symbols, out=total[1:])
    h = total[width:] - total[:-width]
    h *= down[: h.size]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _sliding(a: np.ndarray, width: int, op) -> np.ndarray:
    """op over all windows of ``width`` in a row."""
    span = 1
    while span * 2 <= width:
        a = op(a[: a.size - span], a[span:])
        span *= 2
    rest = width - span
    return op(a[: a.size - rest], a[rest:]) if rest else a


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def fingerprints(texts: list[str], length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the chosen windows of texts of at least ``length``; each pair once."""
    sizes = np.array([len(t) for t in texts])
    h = window_hashes(code_points(texts), gram)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    whole = np.ones(h.size, dtype=bool)
    for e in begin[1:-1]:
        whole[max(0, e - gram + 1) : e] = False  # these windows run over the end of a text
    low = np.where(whole, (h >> np.uint64(32)).astype(np.uint32), np.uint32(0xFFFFFFFF))
    width = length - gram + 1
    least = _sliding(low, width, np.minimum)
    top = np.zeros(low.size, dtype=np.uint32)
    pad = np.zeros(width - 1, dtype=np.uint32)
    top[:] = _sliding(np.concatenate((pad, least, pad)), width, np.maximum)
    at = np.flatnonzero((top == low) & whole)
    owner = np.searchsorted(begin, at, side="right") - 1
    pairs = np.unique(np.stack((owner.astype(np.uint64), h[at])), axis=1) if at.size else np.zeros((2, 0), dtype=np.uint64)
    return pairs[0].astype(np.int64), pairs[1].view(np.int64) if pairs.flags.c_contiguous else pairs[1].copy().view(np.int64)


def least_windows(code: np.ndarray, length: int, gram: int) -> np.ndarray:
    """By window of ``length``: the place of its least window of ``gram``, the first of equal ones."""
    h = (window_hashes(code, gram) >> np.uint64(32)) << np.uint64(32)
    n = length - gram + 1
    best = _sliding(h | np.arange(h.size, dtype=np.uint64), n, np.minimum)
    return (best & np.uint64(0xFFFFFFFF)).astype(np.int64)


def candidate_windows(code: np.ndarray, length: int, gram: int, repeated: np.ndarray) -> np.ndarray:
    """Places of the windows of ``length`` whose least window of ``gram`` is among the ``repeated`` hashes."""
    if code.size < length:
        return np.zeros(0, dtype=np.int64)
    again = np.isin(window_hashes(code, gram).view(np.int64), repeated)
    return np.flatnonzero(again[least_windows(code, length, gram)])


_SECOND = 0x94D049BB133111EB


def _texts(df: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """(x, m, id, text): x and m are two hashes that name a text."""
    return df.where(F.char_length(text_col) >= length).select(F.xxhash64(text_col).alias("x"), F.hash(text_col).alias("m"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def _hot(texts: DataFrame, length: int, gram: int) -> np.ndarray:
    """Chosen windows that at least a HOT part of a bounded sample of texts has, more than one of them; in order.

    They are repeated, so they needn't be counted. Which they are decides only which way their windows go.
    """
    some = bounded_sample(texts.select("x", "text"), "x", SAMPLE).dropDuplicates(["x"]).collect()
    _, h = fingerprints([r["text"] for r in some], length, gram) if some else (None, np.zeros(0, dtype=np.int64))
    values, n = np.unique(h, return_counts=True)
    return values[n >= max(2, HOT * len(some))]


def _among(h: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ordered, h)
    return ordered[np.minimum(at, ordered.size - 1)] == h if ordered.size else np.zeros(h.size, dtype=bool)


def _suspects(texts: DataFrame, length: int, gram: int, hot: np.ndarray) -> DataFrame:
    """(x, m, text, hs) of each text with hs, its chosen windows that other texts have, too; a row for each text, stored."""

    def prints(want_hot: bool) -> DataFrame:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = batch.column("text").to_pylist()
            rows, hashes = [], []
            for a, b in blocks([len(t) for t in found], BLOCK):
                o, h = fingerprints(found[a:b], length, gram)
                keep = _among(h, hot) == want_hot
                rows.append(o[keep] + a)
                hashes.append(h[keep])
            row = pa.array(np.concatenate(rows))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), batch.column("x").take(row), batch.column("m").take(row)], names=["h", "x", "m"])

        return map_batches(texts.select("x", "m", "text"), run, "h bigint, x bigint, m int")

    placed = prints(False).where("h is not null").repartition("h")  # counted and joined where they are: the same exchange serves both
    repeated = placed.groupBy("h").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.min("m").alias("lm"), F.max("m").alias("hm")).where("lo <> hi or lm <> hm").select("h")
    rows = placed.join(repeated.hint("merge"), "h", "left_semi")
    if hot.size:
        rows = rows.unionByName(prints(True))
    mine = written(rows.groupBy("x", "m").agg(F.collect_set("h").alias("hs")))  # a text's own windows at most
    known = _bits(mine.select("x"), FILTER_BITS)

    def maybe(batch: pa.RecordBatch) -> pa.RecordBatch:
        bit = batch.column("x").to_numpy().view(np.uint64) & np.uint64(FILTER_BITS - 1)
        return batch.filter(pa.array((known.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1))

    near = map_batches(texts.select("x", "m", "text"), maybe, "x bigint, m int, text string")
    return written(near.join(mine.hint("merge"), ["x", "m"]).dropDuplicates(["x", "m"]))


def _bits(keys: DataFrame, size: int):
    """A broadcast table of ``size`` bits in which those of all keys are set, to leave out rows that have no match early.

    Its size is fixed; the more keys there are, the fewer rows it leaves out, and none that has a match.
    """
    bit = F.col("x").bitwiseAND(F.lit(size - 1))
    words = keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).collect()
    table = np.zeros(size // 64, dtype=np.uint64)
    for r in words:
        table[r["word"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)
    return keys.sparkSession.sparkContext.broadcast(table)


def _windows(suspects: DataFrame, length: int, gram: int, hot: np.ndarray, want_hot: bool, places: bool = False) -> DataFrame:
    """(h, g, x, m[, at]) of the windows that may be repeated, those of a hot or of other chosen windows; without places a text has each once."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, first, second, at = [], [], [], []
        for i, (text, hs) in enumerate(zip(batch.column("text").to_pylist(), batch.column("hs").to_pylist())):
            code, mine = code_points([text]), np.array(hs, dtype=np.int64)
            spots = candidate_windows(code, length, gram, mine[_among(mine, hot) == want_hot])
            h, g = window_hashes(code, length)[spots].view(np.int64), (window_hashes(code, length, _SECOND)[spots] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            if not places:
                h, keep = np.unique(h, return_index=True)
                g, spots = g[keep], spots[keep]
            rows.append(np.full(h.size, i))
            first.append(h), second.append(g), at.append(spots.astype(np.int32))
        row = pa.array(np.concatenate(rows).astype(np.int64))
        cols = [pa.array(np.concatenate(first)), pa.array(np.concatenate(second)), batch.column("x").take(row), batch.column("m").take(row)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(at))] if places else cols, names=["h", "g", "x", "m", *(["at"] if places else [])])

    return map_batches(suspects, run, "h bigint, g int, x bigint, m int" + (", at int" if places else ""))


def _routes(suspects: DataFrame, length: int, gram: int, hot: np.ndarray, places: bool = False) -> list[DataFrame]:
    """The windows in two tables: those in few texts move once, to where they are counted and joined; those around a hot
    chosen window stay, as their counts are combined before they move and their joins can be split."""
    cold = _windows(suspects, length, gram, hot, False, places).where("h is not null").repartition("h")
    return [cold, _windows(suspects, length, gram, hot, True, places)] if hot.size else [cold]


def _members(texts: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(h, g, x, m, class_id): of the windows that the same set of texts has one, with all these texts; stored. And the
    suspects, with what is hot among them."""
    hot = _hot(texts, length, gram)
    suspects = _suspects(texts, length, gram, hot)
    out = None
    for windows in _routes(suspects, length, gram, hot):
        classes = windows.groupBy("h", "g").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("x", "m")).alias("s1"), F.bit_xor(F.xxhash64("m", "x")).alias("s2")).where("size > 1")
        one = classes.groupBy("size", "s1", "s2").agg(F.min("h").alias("h")).select("h", F.hex(F.xxhash64("size", "s1", "s2")).alias("class_id"))
        found = windows.join(one.hint("merge"), "h")
        out = found if out is None else out.unionByName(found)
    return written(out), suspects, hot


def sharing_pairs(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", length: int = 300, gram: int | None = None) -> DataFrame:
    """Pairs (chunk_a, chunk_b), a < b, of ids whose texts have a run of ``length`` characters in common."""
    texts = _texts(df, id_col, text_col, length)
    ids = texts.select("x", "m", "id").distinct()
    members, _, _ = _members(texts, length, gram or length // 2)
    a, b = members.select("h", "g", F.struct("x", "m").alias("a")), members.select("h", "g", F.struct("x", "m").alias("b"))
    met = a.join(b, ["h", "g"]).where("a < b").select("a.x", "a.m", "b").distinct()
    between = met.join(ids.withColumnRenamed("id", "ia"), ["x", "m"]).select("ia", "b.x", "b.m").join(ids.withColumnRenamed("id", "ib"), ["x", "m"]).select("ia", "ib")
    same = ids.withColumnRenamed("id", "ia").join(ids.withColumnRenamed("id", "ib"), ["x", "m"]).where("ia < ib").select("ia", "ib")
    pairs = between.unionByName(same).where("ia <> ib")
    return pairs.select(F.least("ia", "ib").alias("chunk_a"), F.greatest("ia", "ib").alias("chunk_b")).distinct()


def shared_classes(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", length: int = 300, gram: int | None = None) -> DataFrame:
    """(class_id, id): every set of texts that have some window of ``length`` in common, once, with the ids of its texts.

    Ids share a run of ``length`` characters if, and only if, they are in a class together. Equal texts that share
    nothing with others are a class, too. The class id is a hash of its texts.
    """
    texts = _texts(df, id_col, text_col, length)
    ids = texts.select("x", "m", "id").distinct()
    members, _, _ = _members(texts, length, gram or length // 2)
    of_many = members.join(ids, ["x", "m"]).select("class_id", "id")
    copied = ids.groupBy("x", "m").agg(F.count("*").alias("copies")).where("copies > 1").select("x", "m", F.hex(F.xxhash64("x", "m")).alias("class_id"))
    return of_many.unionByName(ids.join(copied, ["x", "m"]).select("class_id", "id")).withColumnRenamed("id", id_col).distinct()


def shared_amount(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", length: int = 300, gram: int | None = None) -> DataFrame:
    """(id, n_chars, n_partners, shared_chars, shared_share, intervals) of every id with a shared span.

    Partners are ids; intervals are the maximal runs of characters that repeated windows cover, as [start, end) in
    order; a text with copies is shared as a whole.
    """
    texts = _texts(df, id_col, text_col, length)
    ids = texts.select("x", "m", "id", F.char_length("text").cast("bigint").alias("n_chars")).distinct()
    copies = ids.groupBy("x", "m").agg(F.count("*").alias("copies"), F.max("n_chars").alias("n_chars"))
    members, suspects, hot = _members(texts, length, gram or length // 2)
    a, b = members.select("h", "g", "x", "m"), members.select("h", "g", F.col("x").alias("ox"), F.col("m").alias("om"))
    others = a.join(b, ["h", "g"]).where("x <> ox or m <> om").select("x", "m", "ox", "om").distinct()
    partners = others.join(copies.select(F.col("x").alias("ox"), F.col("m").alias("om"), "copies"), ["ox", "om"]).groupBy("x", "m").agg(F.sum("copies").alias("n"))
    repeated = None
    for spots in _routes(suspects, length, gram or length // 2, hot, True):
        again = spots.groupBy("h", "g").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo <> hi").select("h", "g")
        rows = spots.join(again.hint("merge"), ["h", "g"], "left_semi").select("x", "m", "at")
        repeated = rows if repeated is None else repeated.unionByName(rows)
    runs = repeated.groupBy("x", "m").agg(F.array_sort(F.collect_set("at")).alias("at"))  # a text's own places at most

    def merge(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for at in batch.column("at").to_pylist():
            p = np.array(at)
            cut = np.flatnonzero(np.diff(p) > length) + 1
            out.append([{"start": int(q[0]), "end": int(q[-1]) + length} for q in np.split(p, cut)])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column("x"), batch.column("m"), pa.array(out, kind)], names=["x", "m", "intervals"])

    parts = map_batches(runs, merge, "x bigint, m int, intervals array<struct<start: bigint, end: bigint>>")
    per = copies.join(parts, ["x", "m"], "left").join(partners, ["x", "m"], "left").where("copies > 1 or intervals is not null")
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_chars").alias("end")))
    per = per.select("x", "m", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_partners"), F.when(F.col("copies") > 1, whole).otherwise(F.col("intervals")).alias("intervals"))
    shared = F.aggregate("intervals", F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"])
    return ids.join(per, ["x", "m"]).select(F.col("id").alias(id_col), "n_chars", "n_partners", shared.alias("shared_chars"), (shared / F.col("n_chars")).alias("shared_share"), "intervals")
