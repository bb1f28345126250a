"""Problem 6: values cut off by a field limit or in transfer, scored by hashed logistic regression.

The limit of a source is the greatest length at which its values pile up, if hardly any is longer; a source without such
a pile has none. Positives are made: values that look whole are cut at a limit or somewhere else, with and without a
mark. The features are hashed: closing characters, closing words, punctuation and blanks at the end, open brackets,
the distance to the limit, and whether the last word only ever begins a longer word. The training rows are a
sample of at most ``sample`` distinct values, chosen by hash. As the sample holds cut values too, the model is fitted
three times, each time without the values that look cut to the last.

A null value isn't a case; an empty one is whole. A row id counts once. The id's first value by sort order
counts if deliveries disagree.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import map_batches

#: Distinct values that train the model.
SAMPLE = 20_000
BUCKETS = 1 << 16
#: A greatest length is a limit if it is this many times as frequent as the mean of the NEAR lengths below it.
PILE, NEAR, LEAST = 3.0, 8, 5
#: Values over a limit, as a part of those at it, that may be there all the same.
BEYOND = 0.05

_WORDS = re.compile(r"[^\W_]+(?:[-'][^\W_]+)*")
_MARKS = ("…", "...", "..", " …", " ...", "-")


@dataclass
class Begins:
    """By word of the sample: how often it stands whole inside a value, and how often longer words begin with it."""

    whole: dict[str, int]
    longer: dict[str, int]

    @classmethod
    def of(cls, values: list[str]) -> Begins:
        whole: dict[str, int] = {}
        for v in values:
            for w in _WORDS.findall(v)[:-1]:
                whole[w.lower()] = whole.get(w.lower(), 0) + 1
        longer: dict[str, int] = {}
        for w, n in whole.items():
            for k in range(1, len(w)):
                longer[w[:k]] = longer.get(w[:k], 0) + n
        return cls(whole, longer)


def features(value: str, limit: int, begins: Begins) -> list[str]:
    bare = value.rstrip()
    core = bare.rstrip(".…-")
    words = [w.lower() for w in _WORDS.findall(core)]
    last, before = (words[-1] if words else ""), (words[-2] if len(words) > 1 else "")
    gap = limit - len(value) if limit else 99
    near = "none" if not limit else str(gap) if 0 <= gap <= 3 else "over" if gap < 0 else "far"
    end = bare[len(core) :]
    alone, longer = begins.whole.get(last, 0), begins.longer.get(last, 0)
    kind = "part" if longer > 3 * alone else "both" if longer and alone else "word" if alone else "new"
    head = words[0] if words else ""
    return [
        "1",
        f"c1={core[-1:]}", f"c2={core[-2:].lower()}", f"c3={core[-3:].lower()}", f"c4={core[-4:].lower()}",
        f"w1={last}", f"w2={before} {last}", f"kind={kind}", f"kind={kind},{near}",
        f"end={end}", f"blank={len(value) - len(bare) > 0}", f"open={core.count('(') > core.count(')')}",
        f"near={near}", f"len={min(len(last), 8)}", f"upper={last[:1].isupper()}", f"head={head} {last}",
        f"mark={'…' in end or '..' in end}", f"mark={'…' in end or '..' in end},{near}", f"mark={'…' in end or '..' in end},{kind}",
        f"shape={head} {'without' in words}{'during' in words}{'involving' in words}{'by' in words[-4:]}", f"w1near={last},{near}",
    ]


def _columns(rows: list[list[str]]) -> np.ndarray:
    return np.array([[crc32(f"{i}{f}".encode()) % BUCKETS for i, f in enumerate(r)] for r in rows], dtype=np.int64)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 250, l2: float = 0.1) -> np.ndarray:
    """Weights of a logistic regression over 0/1 features named by column, by Adam over all rows."""
    w, m, v = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS)
    n = len(y)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(w[x].sum(axis=1), -30, 30)))
        g = np.bincount(x.ravel(), weights=np.repeat((p - y), x.shape[1]), minlength=BUCKETS) / n + l2 * w / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


@dataclass
class Model:
    weights: np.ndarray
    begins: Begins

    @classmethod
    def train(cls, rows: list[tuple[str, int]], seed: int = 7) -> Model:
        """rows: distinct (value, limit of its source or 0)."""
        rng = np.random.default_rng(seed)
        rows = [(v, lim) for v, lim in sorted(rows) if v.strip()]
        begins = Begins.of([v for v, _ in rows])
        limits = sorted({lim for _, lim in rows if lim})
        plain = [(v, lim) for v, lim in rows if not v.rstrip().endswith(("…", "..")) and v == v.rstrip() and not (lim and 0 <= lim - len(v) <= 1)]
        model = cls(np.zeros(BUCKETS), begins)
        for attempt in range(3):
            whole = plain
            if attempt:
                score = model.scores(plain)
                whole = [r for r, s in zip(plain, score) if s < 0.2]
            x, y = [], []
            for value, limit in whole:
                limit = limit if rng.random() < 0.5 else 0  # sources without a limit cut values in transfer, too
                x.append(features(value, limit, begins))
                y.append(0)
                if rng.random() < 0.8:  # a whole value may just reach its limit
                    x.append(features(value, len(value) + int(rng.integers(2)), begins))
                    y.append(0)
                short = [q for q in limits if q < len(value)]
                inner = [m for m in range(max(3, len(value) // 4), len(value)) if value[m - 1].isalnum() and value[m].isalnum()]
                cuts = [(int(rng.choice(short)), True)] if short else []
                cuts += [(int(m), False) for m in rng.choice(inner, 3)] if inner else []
                ends = [m for m in range(4, len(value)) if value[m].isspace()]
                cuts += [(int(rng.choice(ends)) + int(rng.integers(2)), True)] if ends and rng.random() < 0.5 else []
                marked = int(rng.choice([*ends, len(value)])) if rng.random() < 0.6 else 0
                if marked:
                    x.append(features(value[:marked] + _MARKS[rng.integers(5)], limit, begins))
                    y.append(1)
                for at, limited in cuts:
                    mark = _MARKS[rng.integers(len(_MARKS))] if rng.random() < 0.15 else ""
                    piece = value[: at - len(mark)] + mark if limited else value[:at] + mark
                    if not piece.strip():
                        continue
                    if limited and rng.random() < 0.5:
                        piece = piece.rstrip()
                    x.append(features(piece, at if limited else limit, begins))
                    y.append(1)
            model.weights = fit(_columns(x), np.array(y, dtype=float)) if x and 0 < sum(y) < len(y) else np.zeros(BUCKETS)
        return model

    def scores(self, rows: list[tuple[str, int]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        z = self.weights[_columns([features(v, lim, self.begins) for v, lim in rows])].sum(axis=1)
        given = np.array([bool(v.strip()) for v, _ in rows])
        return np.where(given, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)


def source_limits(values: DataFrame) -> DataFrame:
    """(source, field_limit) of every source; null where no lengths pile up that hardly any value exceeds.

    A limit is the greatest length that piles up against the NEAR lengths below it, provided that the values over it
    are at most BEYOND of those at it, such as came in by another way.
    """
    by_length = values.groupBy("source", F.char_length("value").alias("n")).agg(F.count("*").alias("c"))
    of_source = Window.partitionBy("source").orderBy("n")  # a row for each length
    near, over = of_source.rangeBetween(-NEAR, -1), of_source.rangeBetween(1, Window.unboundedFollowing)
    ranked = by_length.withColumns({"below": F.coalesce(F.sum("c").over(near), F.lit(0)), "beyond": F.coalesce(F.sum("c").over(over), F.lit(0))})
    piles = (F.col("c") >= LEAST) & (F.col("c") * NEAR >= PILE * F.col("below")) & (F.col("beyond") <= BEYOND * F.col("c"))
    return ranked.groupBy("source").agg(F.max(F.when(piles, F.col("n"))).alias("field_limit"))


def scored(df: DataFrame, id_col: str = "chunk_id", value_col: str = "section_title", source_col: str = "source", sample: int = SAMPLE) -> DataFrame:
    """(id, source, value, field_limit, score) of every id with a value; score above 0.5: cut off."""
    once = df.where(F.col(value_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.struct(F.col(value_col).alias("value"), F.col(source_col).alias("source"))).alias("r")).select("id", "r.source", "r.value")
    limits = source_limits(once).withColumnRenamed("source", "limit_source")
    with_limit = once.join(limits, F.col("source").eqNullSafe(F.col("limit_source")), "left").select("id", "source", "value", "field_limit")
    chosen = with_limit.select("value", F.coalesce("field_limit", F.lit(0)).alias("field_limit")).distinct().orderBy(F.xxhash64("value", "field_limit"), "value").limit(sample).collect()
    shared = df.sparkSession.sparkContext.broadcast(Model.train([(r[0], r[1]) for r in chosen]))
    kind = df.schema[id_col].dataType.simpleString()
    memo: dict[tuple[str, int], float] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(zip(batch.column("value").to_pylist(), [x or 0 for x in batch.column("field_limit").to_pylist()]))
        new = sorted({r for r in rows} - memo.keys())
        if len(memo) > 500_000:
            memo.clear()
            new = sorted(set(rows))
        memo.update(zip(new, shared.value.scores(new).tolist()))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([memo[r] for r in rows], pa.float64())], names=[*batch.schema.names, "score"])

    return map_batches(with_limit, run, f"id {kind}, source string, value string, field_limit int, score double")


def truncated(df: DataFrame, **names) -> DataFrame:
    """The rows of ``scored`` that are cut off."""
    return scored(df, **names).where(F.col("score") > 0.5)


def truncation_rates(df: DataFrame, **names) -> DataFrame:
    """By source: values, cut_off, share and the limit; a null source is a source of its own."""
    s = scored(df, **names)
    return s.groupBy("source").agg(F.max("field_limit").alias("field_limit"), F.count("*").alias("n_values"), F.count_if(F.col("score") > 0.5).alias("n_cut")).withColumn("share", F.col("n_cut") / F.col("n_values"))
