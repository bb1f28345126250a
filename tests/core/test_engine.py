"""Operators on inline tables, against hand-written cases and plain-Python versions."""

import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import bm25, chunking, dense, evaluation, passages, prompts, retrieval, segment
from corvane.sources import files


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (T.token_estimate, "a b\u00a0c", 3),
        (T.token_estimate, "", 1),
        (T.token_estimate, None, None),
        (T.title_case, "ONE-OFFICER (INITIAL)", "One-Officer (Initial)"),
        (T.section_title, "INVESTIGATIONS OF AN D AGGRESSIVE ACTS .", "Investigations Of And Aggressive Acts"),
        (T.section_title, "ONE-O FFICER\nBOARDS", "One-Officer Boards"),
        (T.first_sentence, "General. More text", "General"),
        (T.first_sentence, "No stop here", "No stop here"),
        (T.clean_text, "enfor-\nceable\nArticle 92\n\n\n\nIV-28\nend ", "enforceable\n\nend"),
        (T.compact_text, "a-\n b\n\n\nc\n", "ab\nc"),
        (T.drop_overlap_marks, "a\n\n[…]\n\nb\n\n[...]\n\nc", "a\n\nb\n\nc"),
        (T.outline, "a. Text\n(1) One\nmore\n(a) Two\n\nend", "a. Text\n    (1) One\n      more\n        (a) Two\n\n          end"),
        (T.mend_split_words, "The G eneral rule applies .\n\n12-\n34\nT\nhe members m\nust go", "The General rule applies.\nThe members must go"),
        (retrieval.detect_article, "What is Art. 112A about?", "112a"),
        (retrieval.detect_article, "see article 92 and Art. 5", "92"),
        (retrieval.detect_article, "nothing", None),
        (retrieval.expand, "Rules on hazing and UA", "Rules on hazing and UA cruelty maltreatment Article 93"),
        (retrieval.expand, "plain", "plain"),
    ],
)
def test_functions(spark, f, value, want):
    assert one(spark, f, value) == want


def test_first_sentence_of_a_long_text(spark, tmp_path):
    from corvane.plans.queries import queries

    texts = ["a" * 300 + ". More text", "a" * 300, "One. Two", None]
    spark.createDataFrame([(str(i), t, None) for i, t in enumerate(texts)], "chunk_id string, text string, ingested_at timestamp").write.parquet(str(tmp_path / "chunks.parquet"))
    got = {r.chunk_id: r.title for r in queries()["t9_whole_first_sentence"](spark, str(tmp_path)).collect()}
    assert got == {"0": "a" * 300, "1": "a" * 300, "2": "One. Two"}


def test_tokens_match_python(spark):
    texts = ["It's a well-known café--no? 'quoted' x 92 a1", "", "ÉCOLE - -- '", "A\u00a0B cd\nef"]
    want = [[t for t in (w.strip("-'") for w in re.split(r"[^a-z0-9'-]+", s.lower())) if len(t) >= 2] for s in texts]
    assert [r.x for r in spark.createDataFrame([(s,) for s in texts], "t string").select(T.tokens(F.col("t")).alias("x")).collect()] == want


def test_excerpt(spark):
    body = "\n".join([f"line {i} of filler text" for i in range(60)] + ["the element of intent and wrongful order", "b. Elements.", "tail"])
    got = one(spark, lambda c: T.excerpt(c, limit=200), body)
    assert got.startswith("line") and "intent and wrongful order" in got and got.endswith("tail …") and len(got) <= 202
    assert one(spark, lambda c: T.excerpt(c, limit=30, elements_first=True), body).startswith("b. Elements.")
    assert one(spark, T.excerpt, "short") == "short" and one(spark, T.excerpt, None) is None


DOCS = [("d1", "the order was lawful and the order was known"), ("d2", "the watch slept"), ("d3", "order of the day"), ("d4", None), ("d5", "")]


def plain_bm25(docs, query):
    toks = {k: [t for t in re.split(r"[^a-z0-9'-]+", (v or "").lower()) if len(t) >= 2] for k, v in docs}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(t for v in toks.values() for t in set(v))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: 0.25 * mean if w < 0 else w for t, w in raw.items()}
    return {k: round(sum(idf.get(t, 0) * v.count(t) * 2.5 / (v.count(t) + 1.5 * (0.25 + 0.75 * len(v) / avg)) for t in query.split()), 6) for k, v in toks.items()}


def test_bm25(spark, tmp_path):
    chunks = spark.createDataFrame(DOCS, "chunk_id string, text string")
    queries = spark.createDataFrame([("q1", "lawful order order"), ("q2", "zzz"), ("q3", "the watch")], "query_id string, query string")
    index = bm25.build(chunks)
    index.write(str(tmp_path / "i"))
    ranked = bm25.top_k(bm25.scores(bm25.Index.read(spark, str(tmp_path / "i")), queries), 2)
    direct = bm25.search(chunks, queries, 2)
    want = []
    for q, text in (("q1", "lawful order order"), ("q3", "the watch")):
        best = sorted(((-s, k) for k, s in plain_bm25(DOCS, text).items() if s > 0))[:2]
        want += [(q, k, -s, i) for i, (s, k) in enumerate(best, 1)]
    for got in (ranked, direct):
        assert sorted((r.query_id, r.chunk_id, r.score, r["rank"]) for r in got.collect()) == sorted(want)
    assert not bm25.search(chunks.limit(0), queries, 2).collect()


def shuffled_records(spark, run):
    """What ``run`` returns, and the records that were written to shuffles meanwhile."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark._jvm

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {s.stageId(): s.shuffleWriteRecords() for s in map(found.apply, range(found.size()))}

    before = stages()
    got = run()
    return got, sum(n for i, n in stages().items() if i not in before)


def test_index_scoring_makes_no_row_for_each_query_and_chunk(spark, tmp_path):
    from corvane.plans.queries import r4_index_scoring

    rng = random.Random(5)
    words = ["order", "watch", "lawful", "cutter", "station", "officer", "known", "slept"]
    docs = [(f"d{i:03}", " ".join(w for w in words for _ in range(rng.choice((0, 0, 0, 1, 2))))) for i in range(400)]
    asked = [(f"q{i:02}", " ".join(rng.choices(words, k=6))) for i in range(60)]
    spark.createDataFrame(docs, "chunk_id string, text string").write.parquet(str(tmp_path / "chunks.parquet"))
    spark.createDataFrame(asked, "id string, query string").write.parquet(str(tmp_path / "bench_questions.parquet"))
    got, records = shuffled_records(spark, lambda: r4_index_scoring(spark, str(tmp_path)).collect())
    want, pairs = [], 0
    for q, text in asked:
        scored = sorted((-s, k) for k, s in plain_bm25(docs, text).items() if s > 0)
        pairs += len(scored)
        want += [(q, k, -s, i) for i, (s, k) in enumerate(scored[:8], 1)]
    assert sorted((r.query_id, r.chunk_id, r.score, r["rank"]) for r in got) == sorted(want)
    assert records < pairs / 2


def test_index_search_in_blocks(spark, tmp_path, monkeypatch):
    """Few queries and few terms at once, a repeated and a null id, a null query: as all at once, and as every pair listed."""
    chunks = spark.createDataFrame([*DOCS, DOCS[0], (None, "the lawful watch"), ("d6", "it's a self-test - of the 'watch'")], "chunk_id string, text string")
    asked = [("q1", "lawful order order"), ("q1", "watch"), (None, "self-test of it's order"), ("q3", "the watch"), ("q4", "zzz"), ("q5", None), ("q6", "day of the slept")]
    queries = spark.createDataFrame(asked, "query_id string, query string")
    bm25.build(chunks).write(str(tmp_path / "i"))
    index = bm25.Index.read(spark, str(tmp_path / "i"))
    rows = lambda df: sorted(df.select("query_id", "chunk_id", "score", "rank").collect(), key=str)
    want = rows(bm25.top_k(bm25.scores(index, queries), 2))
    assert {r.query_id for r in want} == {"q1", None, "q3", "q6"}
    assert rows(bm25.search_index(index, queries, 2)) == rows(bm25.search_index(bm25.build(chunks), queries, 2)) == want
    monkeypatch.setattr(bm25, "QUERY_BLOCK", 2)
    monkeypatch.setattr(bm25, "MATRIX_BYTES", 30)
    assert rows(bm25.search_index(index, queries, 2)) == want
    assert not bm25.search_index(index, queries.limit(0), 2).collect() and not bm25.search_index(bm25.build(chunks.limit(0)), queries, 2).collect()


def test_dense(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(60)]
    v = spark.createDataFrame(rows, "chunk_id int, vector array<double>")
    q = v.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    got = {(r.query_id, r["rank"]): r.chunk_id for r in dense.search(v, q, 5).collect()}
    for i in (0, 20, 40):
        order = sorted(range(60), key=lambda j: (-sum(a * b for a, b in zip(rows[i][1], rows[j][1])), j))
        assert [got[i, k] for k in range(1, 6)] == order[:5]
    e = dense.embed(spark.createDataFrame(DOCS, "chunk_id string, text string"), "chunk_id", F.col("text")).collect()
    assert all(abs(sum(x * x for x in r.vector) - (r.chunk_id < "d4")) < 1e-9 for r in e)


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id string, chunk_id string, score double, rank int")


def test_injection(spark):
    articles = spark.createDataFrame([("a", "92"), ("b", "92"), ("c", "112a"), ("d", "")], "chunk_id string, article string")
    targets = spark.createDataFrame([("some", "92"), ("all", "92"), ("none", None), ("prefix", "112")], "query_id string, target string")
    bm = ranked(spark, [(q, c, 5.0 - i, i + 1) for q, cs in (("some", "da"), ("all", "dab"), ("none", "da"), ("prefix", "d")) for i, c in enumerate(cs)])
    order = lambda df, q: "".join(r.chunk_id for r in df.where(F.col("query_id") == q).orderBy("rank").collect())
    got = retrieval.inject(bm, articles, targets)
    assert [order(got, q) for q in ("some", "all", "none", "prefix")] == ["bda", "abd", "da", "cd"]
    assert order(retrieval.inject(bm, articles, targets, "all"), "some") == "bad"


def test_fusion_and_filter(spark):
    d, b = ranked(spark, [("q", "x", 0.9, 1), ("q", "y", 0.8, 2)]), ranked(spark, [("q", "y", 3.0, 1), ("q", "z", 2.0, 2), ("q", "x", 1.0, 3)])
    f = retrieval.fuse(d, b)
    rows = f.orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["y", "x", "z"] and rows[2].score == 0.0 and rows[0].rrf_score <= 2 / 61
    tie = retrieval.fuse(ranked(spark, [("q", "m", 1.0, 1)]), ranked(spark, [("q", "a", 1.0, 1)])).orderBy("rank").collect()
    assert [r.chunk_id for r in tie] == ["m", "a"]
    articles = spark.createDataFrame([("x", "12"), ("y", ""), ("z", "120")], "chunk_id string, article string")
    run = lambda t, **k: [(r.chunk_id, r["mode"]) for r in retrieval.filtered(f, articles, spark.createDataFrame([("q", t)], "query_id string, target string"), 2, **k).orderBy("rank").collect()]
    assert run("12") == [("x", "hybrid_filtered"), ("z", "hybrid_filtered")]
    assert run("12", exact=True) == [("x", "hybrid_filtered")]
    assert run("99") == [("y", "hybrid_fallback"), ("x", "hybrid_fallback")]
    assert run(None) == [("y", "hybrid_unfiltered"), ("x", "hybrid_unfiltered")]


def test_rerank_and_low_confidence(spark):
    c = spark.createDataFrame([("q", "a", "red boat", "a boat"), ("q", "b", "red boat", "the red boat"), ("q", "c", "red boat", None)], "query_id string, chunk_id string, query string, passage string").withColumn("rank", F.lit(1))
    got = retrieval.rerank(c, retrieval.overlap_score(F.col("query"), F.coalesce("passage", F.lit(""))), 2).orderBy("rank").collect()
    assert [(r.chunk_id, r.ce_score) for r in got] == [("b", 1.0), ("a", 0.5)]
    low = {r.query_id: r.low_confidence for r in retrieval.low_confidence(ranked(spark, [("q", "a", 0.64, 1), ("p", "a", 0.7, 1)])).collect()}
    assert low == {"q": True, "p": False}


def pages(spark, rows):
    return spark.createDataFrame([(*r, False) for r in rows], "doc string, chapter string, page_num int, text string, is_exhibit boolean")


def test_sections(spark):
    p = pages(spark, [("m", "1", 1, "Chapter title\nintro\nSection A. First.\nalpha"), ("m", "1", 2, "beta\nSection B. Second\ngamma"), ("m", "1", 3, "Section A. Again\ndelta"), ("m", "2", 4, "no heading")])
    got = segment.sections(p, segment.HEADINGS["section"]).orderBy("chapter", "pos").collect()
    assert [(r.key, r.page_start, r.page_end) for r in got] == [("A", 1, 2), ("B", 2, 3), ("A", 4, 4)]
    assert got[0].text.startswith("Chapter title") and "Again" in got[1].text and got[2].title is None
    q = pages(spark, [("c", None, 1, "Article 12 -- small\nArticle 92. See also\nx"), ("c", None, 2, "18. Article 92 (10 U.S.C. 892) — Failure\nbody\nArticle 93 - Cruelty\nend")])
    got = segment.sections(q, segment.HEADINGS["article"]).orderBy("pos").collect()
    assert [(r.key, r.title) for r in got] == [("92", "Failure"), ("93", "Cruelty")]


def test_numbered_sections_of_the_own_chapter(spark):
    p = pages(spark, [("m", "5", 1, "5.A. Orders\nsee\n7.F.2. Before the separation\nend"), ("m", "6", 2, "A. Absence. Not here\n7.F.2. Before that\nB. Board: Members"), ("m", "7", 3, "no heading")])
    got = segment.chapter_sections(p, "numbered").orderBy("chapter", "pos").collect()
    assert [(r.chapter, r.key) for r in got] == [("5", "5.A."), ("6", "6.A"), ("6", "6.B"), ("7", "A")] and got[0].text.endswith("end") and "7.F.2." in got[1].text


def test_page_lookup(spark):
    p = pages(spark, [("m", "1", 1, "ab"), ("m", "1", 3, "cd")])
    offs = {r.page_num: r.offset for r in segment.offsets(p).collect()}
    points = spark.createDataFrame([("m", "1", x) for x in (0, offs[3] - 1, offs[3], offs[3] + 99)], "doc string, chapter string, pos bigint")
    assert [r.page for r in segment.page_at(points, p).orderBy("pos").collect()] == [1, 1, 3, 3]


def test_exhibits_and_ranges(spark):
    p = pages(spark, [("m", "1", 1, "EXHIBIT (1)\nform"), ("m", "1", 2, "A.  GENERAL\nsee exhibit (2)"), ("m", "1", 3, "exhibit (1) " + "w " * 400)])
    assert [r.x for r in p.orderBy("page_num").select(segment.exhibit(F.col("text")).alias("x")).collect()] == [True, False, False]
    r = spark.createDataFrame([("m", "9", 2, 3)], "doc string, chapter string, first_page int, last_page int")
    skip = spark.createDataFrame([("m", 3)], "doc string, page_num int")
    assert [(x.chapter, x.page_num) for x in segment.in_ranges(p, r, skip).collect()] == [("9", 2)]


def words(n, tag="w"):
    return " ".join(f"{tag}{i}" for i in range(n))


@pytest.mark.parametrize("seed", range(8))
def test_packing_keeps_all_words_within_the_size(seed):
    rng = random.Random(seed)
    paragraphs = [words(rng.randint(1, 60), f"p{i}_") for i in range(rng.randint(1, 30))]
    packed = chunking.pack_article("\n\n".join(paragraphs), size=100)
    assert " ".join(packed).split() == " ".join(paragraphs).split()
    for i, c in enumerate(packed):
        assert chunking.estimate(chunking.count(c)) <= 100
        if i + 1 < len(packed):  # greedy: the next paragraph would not have fitted
            nxt = next(p for p in paragraphs if packed[i + 1].startswith(p))
            assert chunking.estimate(chunking.count(c) + chunking.count(nxt)) > 100


def test_packing_of_large_and_small_parts():
    long = ". ".join(words(30, f"s{i}_") for i in range(5)) + "."
    got = chunking.pack_article(f"{words(10)}\n\n{long}\n\n{words(20, 'z')}", size=60)
    assert got[0] == words(10) and all(chunking.estimate(chunking.count(c)) <= 60 for c in got) and " ".join(got).split() == f"{words(10)} {long} {words(20, 'z')}".split()
    packed = chunking.pack_chapter([(words(10, "a"), 1), (words(20, "b"), 2), (words(300, "c"), 3), (words(5, "d"), 4)], size=60)
    assert packed[0] == (words(10, "a") + "\n\n" + words(20, "b"), [1, 2]) and packed[-1] == (words(5, "d"), [4]) and packed[1][1] == [3]


def test_overlaps():
    assert chunking.overlap_raw(["abc", "def", "ghi"], 2) == ["abc", "bc\n\ndef", "ef\n\nghi"]
    assert chunking.overlap_cascading(["a", "b", "c"], 4) == ["a", "a\n\nb", "\n\nb"[-0:] and "a\n\nb"[-4:] + "\n\nc"]


def test_chunk_records(spark):
    p = pages(spark, [("m", "1", 1, f"Section A. First\n{words(30)}"), ("m", "1", 2, f"Section B. Second\n{words(900, 'x')}"), ("m", "1", 3, "Section C. Tiny\nx")])
    got = chunking.chapter_chunks(segment.sections(p, segment.HEADINGS["section"])).orderBy("chunk_index").collect()
    assert got[0].chunk_id == "m_ch01_0000" and got[0].section_number == "A" and got[0].page_end == 2 and got[0].content_hash != ""
    assert all(b.text.startswith(a.text[-320:]) for a, b in zip(got, got[1:])) and "x" in got[-1].text
    a = pages(spark, [("c", None, 1, f"Article 92 - Orders\n{words(700)}")])
    got = chunking.article_chunks(segment.sections(a, segment.HEADINGS["article"])).collect()
    assert [r.chunk_id for r in got][:1] == ["c_092_000"] and all(r.total_chunks_in_article == len(got) for r in got)


@pytest.mark.parametrize(("style", "sep", "parts"), [("capitals", "\n\n", 1), ("letters", "\n", 1), ("sentence", "\n\n", 2)])
def test_packing_by_the_rules_of_each_manual(style, sep, parts):
    a, b, c = (f"{i}. Item {words(20)}" for i in (1, 2, 3))
    assert [t for t, _ in chunking.pack_chapter([(f"{a}\n{b}\n{c}", 1)], style, size=60)] == [a + sep + b, c]
    assert len(chunking.pack_chapter([(f"1. Item {words(30)}\n2. Item {words(30)}", 1)], style, size=60)) == parts


def test_chapter_chunks_of_all_manuals(spark, tmp_path):
    from corvane.plans.queries import queries

    heads = {"hgcm1": "1.A. Orders", "hgim1": "A.  GENERAL", "hgsep1": "AA. General", "hgsa1": "A. General. The", "hgmj1": "Section A. General", "dcm1": "Article 92 - Orders"}
    pages(spark, [(doc, "1", 1, f"{head}\n{words(30)}") for doc, head in heads.items()]).write.parquet(str(tmp_path / "source_pages.parquet"))
    got = {r.source: r.section_number for r in queries()["c14_c16_c18_chapter_chunks"](spark, str(tmp_path)).collect()}
    assert got == {"hgcm1": "1.A.", "hgim1": "A", "hgsep1": "AA", "hgsa1": "A", "hgmj1": "A"}


HIT = "query_id string, chunk_id string, rank int, score double, content_hash string, source string, article_number string, article_title string, section_number string, section_title string, chapter_number string, chapter_title string, heading_path array<string>, page_start int, page_end int, chunk_index int, text string"


def hits(spark):
    row = lambda c, r, h, src, art, sec, p1, p2, i, t: ("q", c, r, 1.0 / r, h, src, art, "Title" if art else None, sec, "Sec" if sec else None, "1", None, None if art else ["Ch 1", "T", "Section A"], p1, p2, i, t)
    return spark.createDataFrame(
        [row("c1", 1, "h1", "Book (X 1)", "92", None, 5, 6, 2, "two"), row("c2", 2, "h2", "Book (X 1)", "92", None, 4, 4, 1, "one"), row("c3", 3, "h2", "Book (X 1)", "92", None, 9, 9, 3, "one"), row("c4", 4, "h4", "M", None, "A.", 1, 1, 0, "m"), row("c5", 5, "h5", "N", None, "A.", None, 2, 0, "n")], HIT
    )


def test_passages(spark):
    a = {r.key: r for r in passages.aggregate(hits(spark), "a").collect()}
    assert a["92"].text == "one\n\ntwo" and a["92"].chunk_ids == ["c2", "c1", "c3"] and (a["92"].page_start, a["92"].page_end) == (4, 9) and a["92"]["rank"] == 1
    assert a["unknown"].chunk_ids == ["c4", "c5"]
    assert {r.key for r in passages.aggregate(hits(spark), "b").collect()} == {"92", "A."}
    assert {r.key for r in passages.aggregate(hits(spark), "exact").collect()} == {"Book (X 1)|1|92", "M|1|A.", "N|1|A."}
    c = passages.merge_adjacent(hits(spark)).orderBy("rank").collect()
    assert [r.chunk_ids for r in c] == [["c1", "c2", "c3"], ["c4", "c5"]] and c[0].text == "two\n\none\n\none"


def test_citations(spark):
    cite = lambda df, s: [r.x for r in df.orderBy("rank").select(passages.citation(s).alias("x")).collect()]
    assert cite(passages.aggregate(hits(spark), "b"), "a")[0] == "[1]  Book  |  Art. 92 — Title  |  pp.4–9"
    assert cite(passages.aggregate(hits(spark), "b"), "b")[0] == "[1] [Book (X 1) | Punitive Articles | Art. 92 — Title | pp.4–9 | chunks: c2, c1, c3 | score: 1.000]"
    assert cite(passages.merge_adjacent(hits(spark)), "c") == ["[1] Book (X 1) | Art. 92 — Title | pp.5–6 | c1, c2… | score: 1.000", "[2] M | § A. Sec | pp.1–1 | c4, c5 | score: 0.250"]


def test_prompts(spark):
    assert [one(spark, prompts.prompt_format, f"/m/{n}") for n in ("Mistral-7B.gguf", "phi-3-mini", "OpenHermes", "other")] == ["mistral", "phi3", "chatml", "raw"]
    rows = spark.createDataFrame([("q", "p", "fallback")], "query_id string, prompt string, fallback string")
    ok = prompts.generate(rows, lambda: lambda ps: [f"said {p}" for p in ps]).first().answer
    assert ok == f"said p\n\n{prompts.DISCLAIMER}"

    def broken():
        raise OSError

    assert prompts.generate(rows, broken).first().answer.startswith("fallback")
    ctx = passages.context(passages.merge_adjacent(hits(spark)), chars=3, first=1).first().context
    assert ctx.endswith("two …") and "[2]" not in ctx


def test_evaluation(spark):
    gold = "struct<article_numbers: array<string>, section_numbers: array<string>, chunk_ids: array<string>, source_doc: string, notes: string>"
    q = spark.createDataFrame(
        [("a", (["092"], None, [], None, None)), ("b", ([], ["A"], [], "M", None)), ("c", ([], [], ["c9"], None, None)), ("none", (["1"], None, None, None, None)), ("d", ([], ["A."], None, None, None))], f"query_id string, gold {gold}"
    )
    h = spark.createDataFrame(
        [("a", "c1", 1, 0.5, "112", None, "X"), ("a", "c2", 2, 0.4, "92a", None, "X"), ("b", "c3", 1, 0.5, None, "AA.", "N"), ("b", "c4", 2, 0.5, None, "A.", "Book M 1"), ("c", "c9", 9, 0.1, None, None, None), ("d", "c5", 1, 0.2, None, "A.", None)],
        "query_id string, chunk_id string, rank int, score double, article_number string, section_number string, source string",
    )
    per = evaluation.detail(q, h)
    rr = {r.query_id: r.rr for r in per.collect()}
    assert rr == {"a": 0.5, "b": 0.5, "c": 0.0, "none": 0.0, "d": 1.0}
    m = evaluation.metrics(per).first()
    assert m.num_queries == 5 and m.mrr == pytest.approx(0.4) and m.recall_at_1 == pytest.approx(0.2) and m.recall_at_3 == pytest.approx(0.6) and m.precision_at_8 == pytest.approx(3 / 40)
    assert m.recall_at_1 <= m.recall_at_3 <= m.recall_at_5 <= m.recall_at_8
    assert {r.query_id for r in evaluation.misses(per, q.withColumn("query", F.lit("x"))).collect()} == {"c", "none"}
    assert evaluation.advisory(evaluation.metrics(per)).first().hits_at_1 == 1
    x, y = (spark.createDataFrame(r, "metric string, value double") for r in ([("m", 0.5), ("k", 1.0)], [("m", 0.5005), ("n", 1.0)]))
    assert {r.metric: r.arrow for r in evaluation.compare(x, y).collect()} == {"m": "same", "k": "same", "n": "same"}


def test_files(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text(json.dumps({"chunk_id": "a", "text": "é", "source": "s", "page_start": 3}) + "\n\n" + json.dumps({"chunk_id": "b", "heading_path": ["x"]}) + "\n", encoding="utf-8")
    c = files.read_chunks(spark, str(tmp_path / "c.jsonl"))
    assert {r.chunk_id: (r.text, r.page_start) for r in c.collect()} == {"a": ("é", 3), "b": (None, None)}
    assert {r.source: r.n_chunks for r in files.source_counts(c).collect()} == {"s": 1, None: 1}
    files.write_chunks(c, str(tmp_path / "out"))
    assert files.read_chunks(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception):  # noqa: B017, PT011
        files.read_chunks(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "b.json").write_text(json.dumps({"metadata": {"total_questions": 3}, "questions": [{"id": "q1", "query": "x", "gold": {"article_numbers": ["92"]}}]}, indent=1))
    q = files.read_benchmark(spark, str(tmp_path / "b.json")).first()
    assert (q.id, q.declared, q.actual, q.gold.article_numbers) == ("q1", 3, 1, ["92"])
    said = []
    run = spark.createDataFrame([(0.5, 1)], "mrr double, _misses int")
    files.write_run(run, str(tmp_path / "run"), reranked=True, log=said.append)
    assert said == [{"mrr": 0.5, "reranked": True}] and files.read_run(spark, str(tmp_path / "run")).columns == ["mrr", "reranked"]
    files.write_run(run, str(tmp_path / "run"), log=lambda _: 1 / 0)
    (tmp_path / "d.bin").write_bytes(b"one|two|three")

    def fails(_):
        raise ValueError

    p = files.read_pages(spark, str(tmp_path / "d.bin"), [fails, lambda b: b.decode().split("|")], first=2)
    assert [(r.doc, r.page_num, r.text) for r in p.collect()] == [("d", 2, "two"), ("d", 3, "three")]
    assert [(r.doc, r.page_num, r.text) for r in files.read_pages(spark, str(tmp_path / "d.bin"), [fails]).collect()] == [("d", None, None)]


def test_hyphens_join_like_the_consuming_pattern(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "b1", "-\n", "-\n ", "-", "\n", " ", "é_"]) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    want = [re.sub(r"(\w+)-\n\s*(\w+)", r"\1\2", t) for t in texts]
    assert [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.join_hyphens(F.col("t")).alias("x")).collect()] == want


def test_no_partition_number_is_fixed(spark):
    queries = spark.createDataFrame([("q", "order")], "query_id string, query string")
    df = bm25.search(spark.createDataFrame(DOCS, "chunk_id string, text string"), queries, 2)
    assert "REPARTITION_BY_NUM" not in df._jdf.queryExecution().toString()


def test_registry():
    from corvane import registry

    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_pipeline(spark, tmp_path):
    from corvane.plans.pipeline import Engine, ingest_articles, ingest_chapters

    text = "18. Article 92 -- Failure to obey\n" + "the lawful order was known to the accused and was not obeyed at once " * 4
    other = "Article 112a -- Substances\n" + "wrongful use of a controlled substance on board the cutter at night " * 4
    chunks = ingest_articles(pages(spark, [("c", None, 1, text), ("c", None, 2, other)]))
    Engine.build(chunks).save(str(tmp_path / "e"))
    engine = Engine.load(spark, str(tmp_path / "e"))
    hits = engine.ask("What does Article 92 say of a lawful order?").collect()
    assert [(h.article_number, h["mode"]) for h in hits] == [("92", "hybrid_filtered")]
    both = engine.ask("wrongful use at night", article=None).orderBy("rank").collect()
    assert both[0].article_number == "112a" and len(both) == 2 and both[0]["mode"] == "hybrid_unfiltered"
    assert engine.ask("x", article="77").collect()[0]["mode"] == "hybrid_fallback"
    assert "Art. 92" in engine.answers(engine.ask("Article 92 order")).first().answer
    gold = spark.createDataFrame([("q", "Article 92 order", (["92"], None, None, None, None))], "query_id string, query string, gold struct<article_numbers: array<string>, section_numbers: array<string>, chunk_ids: array<string>, source_doc: string, notes: string>")
    assert engine.evaluate(gold).first().mrr == 1.0
    import shutil

    shutil.rmtree(tmp_path / "e" / "bm25")
    dense_only = Engine.load(spark, str(tmp_path / "e"))
    assert dense_only.index is None and dense_only.ask("Article 92 order").first()["mode"] == "dense_filtered"
    manual = ingest_chapters(pages(spark, [("m", "1", 1, "Section A. First\n" + "w " * 40)]))
    assert manual.first().section_number == "A"
