"""The algorithms against brute force."""

import random

import numpy as np
import pytest

from corvane.llm import encoding, fmindex, leakage, scanned, shared_spans, splitting


def naive_cuts(t, limit, floor, overlap):
    out, s = [], 0
    while True:
        if len(t) - s <= limit:
            return [*out, (s, len(t))]
        ends = range(s + limit, s + floor, -1)
        e = next((e for e in ends if t[e - 2 : e] == "\n\n"), None) or next((e for e in ends if t[e - 1] in " \t\n\r" and t[e - 2] in ".!?"), None) or next((e for e in ends if t[e - 1] in " \t\n\r"), s + limit)
        out.append((s, e))
        s = e - overlap


@pytest.mark.parametrize("seed", range(20))
def test_cuts_equal_naive(seed):
    rng = random.Random(seed)
    alphabet = ["a", "é", "😀", " ", ". ", "\n\n", "\n", "! "] if seed % 2 else ["x"] * 50 + [" ", "."]
    texts = []
    while len(texts) < 6:
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(41, 900)))
        if len(t) > 40:
            texts.append(t)
    for t, (s, e) in zip(texts, splitting.cut_points(texts, 40, 20, 7)):
        assert list(zip(s.tolist(), e.tolist())) == naive_cuts(t, 40, 20, 7)


def _encode():
    pytest.importorskip("tiktoken")
    try:
        return encoding.coder(encoding.TOKENIZERS, "byte_bpe_50k")
    except FileNotFoundError:
        pytest.skip("no vocabulary files")


@pytest.mark.parametrize("seed", range(4))
def test_tree_equals_whole(seed):
    coder = _encode()
    rng = random.Random(seed)
    bits = ["a", "b ", "  ", "\n", " \n ", "'s", "'", "re", "9", "é", "\t", "...", "　", "漢", "日本語", "x" * 50, "\x1c", "-", " "]
    for _ in range(150):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 300)))
        ids = encoding.encode_tree(t, coder, leaf=rng.choice([3, 17, 64]), reach=rng.choice([1, 4, 32]))
        assert ids == coder.encode(t)
        assert encoding.decode_tree(ids, coder, leaf=rng.choice([1, 5, 64])) == t


@pytest.mark.parametrize("text", ["word " * 3000, "x" * 5000, "漢字" * 2000, " " * 3000, "a1'll\n" * 900, "'" * 600 + "s" * 600, "\u00a0é \t" * 700, "\x1c \x1cq" * 500])
def test_tree_with_the_usual_leaf(text):
    coder = _encode()
    ids = encoding.encode_tree(text, coder)
    assert ids == coder.encode(text) and encoding.decode_tree(ids, coder) == text


@pytest.mark.parametrize("seed", range(5))
def test_index_finds_every_place(seed):
    rng = np.random.default_rng(seed)
    seq = rng.integers(0, 5, 400)
    seq[-1] = 0
    index = fmindex.FMIndex(seq, 3)
    phrases = np.array([rng.integers(1, 5, 3) for _ in range(40)])
    lo, hi = index.search(phrases)
    for p, a, b in zip(phrases, lo, hi):
        want = [i for i in range(398) if (seq[i : i + 3] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def naive_leak(doc, item, share, replaced):
    d, q = leakage.words_of(doc), leakage.words_of(item)
    best = 0
    for shift in range(-len(q), len(d)):
        same = np.array([0 <= i + shift < len(d) and d[i + shift] == w for i, w in enumerate(q)])
        inside = [i for i in range(len(q)) if 0 <= i + shift < len(d)]
        if inside:
            mine = same[inside[0] : inside[-1] + 1]
            best = max([best, *(b - a for a in range(mine.size) for b in range(a + 1, mine.size + 1) if (~mine[a:b]).sum() <= (b - a) // replaced)])
    return best >= leakage.needed(len(q), share)


@pytest.mark.parametrize("seed", range(6))
def test_leaks_equal_naive(seed):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(60)]
    items = [(f"q{i}", " ".join(rng.choice(pool) for _ in range(rng.randint(25, 40)))) for i in range(4)]
    docs = []
    for _ in range(25):
        words = rng.choice(items)[1].split()
        a = rng.randint(0, 20)
        part = words[a : a + rng.randint(5, 30)]
        part = [rng.choice(["zz", "w1"]) if rng.random() < 0.08 else w.upper() + rng.choice(["", ",", "."]) for w in part]
        docs.append(" ".join([*rng.choices(pool, k=8), *part, *rng.choices(pool, k=8)]))
    its = leakage.Items.build(items, 0.4, 10)
    numbers = leakage._Numbers(its.vocabulary)
    parts = [np.array([n for n in map(numbers.__getitem__, leakage.tokens_of(d)) if n >= 0], dtype=np.int32) for d in docs]
    begin = np.concatenate(([0], np.cumsum([p.size for p in parts])))
    got = {(d, its.ids[i]) for d, i, *_ in leakage.search_shard(its, np.concatenate(parts), begin)}
    assert got == {(j, q) for j, d in enumerate(docs) for q, t in items if naive_leak(d, t, 0.4, 10)}


@pytest.mark.parametrize("seed", range(3))
def test_stretches_equal_naive(seed):
    rng = np.random.default_rng(seed)
    for _ in range(60):
        same, replaced, need = rng.random(int(rng.integers(1, 40))) < 0.85, int(rng.integers(2, 11)), int(rng.integers(1, 12))
        spans = [(a, b) for a in range(same.size) for b in range(a + 1, same.size + 1) if b - a >= need and (~same[a:b]).sum() <= (b - a) // replaced]
        got = leakage.stretches(same, replaced, need)
        covered = {i for a, b in spans for i in range(a, b) if same[i]}
        assert {i for a, b, _ in got for i in range(a, b) if same[i]} == covered
        assert max((n for *_, n in got), default=0) == max((b - a for a, b in spans), default=0)


def test_seed_length_of_every_size():
    for n in (1, 2, 5, 19, 20, 26, 61, 200):
        least = min(-(-(size - size // 10) // (size // 10 + 1)) for size in range(leakage.needed(n, 0.4), n + 1))
        assert leakage.seed_length(n, 0.4, 10) == max(1, least)


def test_seed_length_is_a_bound():
    k = leakage.seed_length(26, 1.0, 10)
    same = np.ones(26, dtype=bool)
    same[[8, 17]] = False  # two replaced of 26
    runs = [len(r) for r in "".join("x" if s else " " for s in same).split()]
    assert max(runs) >= k


@pytest.mark.parametrize("seed", range(6))
def test_no_repeated_window_is_left_out(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    common = text(40 + seed)
    a, b = text(100) + common + text(80), text(30) + common + text(120)
    owner, h = shared_spans.fingerprints([a, b], 40, 20)
    both = np.intersect1d(h[owner == 0], h[owner == 1])
    want = {i for i in range(len(a) - 39) if a[i : i + 40] in b}
    assert len(want) >= 1 + seed and want <= set(shared_spans.candidate_windows(shared_spans.code_points([a]), 40, 20, both).tolist())
    assert not shared_spans.candidate_windows(shared_spans.code_points([a]), 40, 20, both[:0]).size and not shared_spans.candidate_windows(shared_spans.code_points([a[:39]]), 40, 20, both).size


def test_window_hashes_are_of_the_window_alone():
    a, b = shared_spans.code_points(["xyzabcdefgh"]), shared_spans.code_points(["abcdefgh"])
    assert (shared_spans.window_hashes(a, 5)[3:] == shared_spans.window_hashes(b, 5)).all()


def test_paragraph_classifier_on_held_out_wraps():
    rng = random.Random(3)
    vocabulary = "the officer of watch must sign report before end day and clerk will keep it in file Station Board members record order reviewed".split()
    paragraph = lambda: " ".join([w.capitalize() if not i or rng.random() < 0.1 else w for i, w in enumerate(rng.choices(vocabulary, k=rng.randint(35, 80)))]) + "."
    lists = ["\n".join(f"({i}) {' '.join(rng.choices(vocabulary, k=4))}" for i in range(1, 9)) for _ in range(20)]
    weights = scanned.train_paragraphs(["\n".join(paragraph() for _ in range(4)) for _ in range(60)] + lists)
    right = n = 0
    for _ in range(60):
        whole, width = [paragraph() for _ in range(4)], rng.randint(55, 95)
        wrapped = "\n".join(line for p in whole for line in scanned._wrapped(p, width))
        got = scanned.repair(wrapped, [], weights).split("\n")
        right, n = right + len(set(got) & set(whole)), n + 4
    assert right >= 0.9 * n
    assert scanned.repair(lists[0], [], weights) == lists[0]
    assert scanned.repair("a\tb\nc\td", [], weights) == "a\tb\nc\td" and scanned.repair("", [], weights) == ""


def test_candidates_meet_within_the_allowed_edits(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(6, 12))) for _ in range(150)})
    bad = {}
    for w in words:
        for _ in range(2):
            s = w
            for _ in range(min(3, len(w) // 2)):
                i = rng.randrange(len(s))
                s = rng.choice([s[:i] + rng.choice("xyz19") + s[i + 1 :], s[:i] + s[i + 1 :], s[:i] + "1" + s[i:]])
            bad[s] = w
    rows = [(w, 100) for w in words] + [(s, 1) for s in bad if s not in words]
    counts = spark.createDataFrame(rows, "word string, n bigint")
    spellings = spark.createDataFrame([(s,) for s in bad], "spelling string")
    got = {(r.spelling, r.word) for r in scanned.candidates(spellings, counts).collect()}
    limit = {r.s: r.e for r in spellings.select(F.col("spelling").alias("s"), scanned.allowed_edits(F.col("spelling")).alias("e")).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for x in a:
            new = [row[0] + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    assert {(s, w) for s in bad for w in words if s != w and distance(s, w) <= limit[s]} == got
