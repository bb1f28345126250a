"""The operators on small tables: defined results for nulls, empty and long texts, repeats, ties and clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.llm import encoding, leakage, lookalikes, quality, reading, scanned, shared_spans, splitting, truncation
from corvane.llm import queries as llm_queries

CHUNK = "chunk_id string, text string, section_number string, section_title string, source string, chapter_title string, page_start int, id string, key string, h bigint, n bigint, kind string, word string"


def chunks(spark, rows):
    """rows: (chunk_id, text) or (chunk_id, text, title, source); the columns after the first ones clash with names used inside."""
    full = [(r[0], r[1], "A.", r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else "s", None, 1, "id", "key", 1, 1, "kind", "word") for r in rows]
    return spark.createDataFrame(full, CHUNK)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


PROSE = "The officer of the watch must sign the report before the end of the day, and the clerk will keep it in the file. "


def test_split(spark):
    long = "word " * 1000
    df = chunks(spark, [("a", long), ("a", long), ("b", "short"), ("c", None), ("d", ""), ("e", "x" * 5000)])
    rows = found(splitting.split_oversized(df))
    assert {r[0] for r in rows} == {"a", "e"}
    assert [r[1:] for r in rows if r[0] == "e"] == [(1, 0, 2400), (2, 2080, 4480), (3, 4160, 5000)]
    pieces = splitting.split_oversized(df, keep=("section_number",), with_text=True).where("chunk_id = 'a'").collect()
    assert all(long[p.start_pos : p.end_pos] == p.piece_text and p.section_number == "A." for p in pieces)
    assert not splitting.split_oversized(df.limit(0)).collect()


def test_encode(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "a b " * 9000)], "doc_id bigint, text string")
    pytest.importorskip("tiktoken")
    try:
        encode = encoding.coder(encoding.TOKENIZERS, "byte_bpe_50k").encode
    except FileNotFoundError:
        pytest.skip("no vocabulary files")
    rows = {r.doc_id: r.ids for r in encoding.encode_corpus(df).collect()}
    assert rows[2] == [] and rows[3] == [] and rows[1] == encode("Hello world") and rows[4] == encode("a b " * 9000)
    back = {r.doc_id: r.text for r in encoding.decode_corpus(encoding.encode_corpus(df)).collect()}
    assert back == {1: "Hello world", 2: "", 3: "", 4: "a b " * 9000}
    none = spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")
    assert found(encoding.decode_corpus(none)) == [(1, None)]


def test_leaks(spark):
    item = " ".join(f"alpha{i}" for i in range(50))
    docs = spark.createDataFrame(
        [(1, "Intro. <b>" + item.upper().replace(" ", ",\n") + "</b> end"), (2, " ".join(item.split()[:19])), (3, "x " + " ".join(item.split()[5:30])), (4, None), (5, ""), (1, "Intro. " + item)], "doc_id bigint, text string"
    )
    items = spark.createDataFrame([("q", item), ("q", item), ("n", None), (None, "x")], "id string, query string")
    assert {r[:2] for r in found(leakage.find_leaks(docs, items))} == {(1, "q"), (3, "q")}
    assert not leakage.find_leaks(docs, items.limit(0)).collect()
    assert not leakage.find_leaks(docs.limit(0), items).collect()


def test_leaks_of_very_unequal_items_and_second_copies(spark):
    long = " ".join(f"long{i % 4999}" for i in range(10_000))
    rows = [(1, "x <b>Blue</b> heron, and again BLUE&nbsp;heron."), (2, "pad " + " ".join(long.split()[3000:7500]) + " pad"), (3, f"{long[:100]} no"), (4, "heron blue"), (5, f"<{'a' * 400}>blue heron")]
    docs, items = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([("two", "blue heron"), ("long", long)], "id string, query string")
    for block_words in (6000, leakage.BLOCK_WORDS):
        got = leakage.find_leaks(docs, items, share=0.45, block_words=block_words).collect()
        texts = dict(rows)
        cut = sorted((r.doc_id, r.item_id, texts[r.doc_id][r.start_pos : r.end_pos]) for r in got)
        assert {(d, i) for d, i, _ in cut} == {(1, "two"), (2, "long"), (4, "two"), (5, "two")} and [t for d, _, t in cut if d == 1] == ["BLUE&nbsp;heron.", "Blue</b> heron,"]
        assert (2, "long", " ".join(long.split()[3000:7500])) in cut
    item = " ".join(f"w{i}" for i in range(30))
    twice = spark.createDataFrame([(1, f"{item}. Other words stand here, then: {item.upper()}!")], "doc_id bigint, text string")
    got = sorted((r.first_word, r.end_word, r.start_pos, r.end_pos) for r in leakage.find_leaks(twice, spark.createDataFrame([("q", item)], "id string, query string")).collect())
    assert got == [(0, 30, 0, len(item) + 1), (35, 65, len(item) + 32, 2 * len(item) + 33)]


def test_lookalikes(spark):
    rows = [
        ("a", "café report"), ("b", "café report"), ("c", "cаfé re​port"), ("d", "cafe report"), ("e", "café report"), ("f", "ｃａｆé report"), ("g", "Café report"),
        ("h", "oﬃce\n1"), ("i", "office\n1"), ("j", "office 1"), ("k", None), ("l", ""), ("b", "café report"),
    ]
    got = found(lookalikes.print_alikes(chunks(spark, rows)))
    same = ["a", "b", "c", "e", "f"]
    assert got == sorted([(x, y) for i, x in enumerate(same) for y in same[i + 1 :] if (x, y) != ("a", "e")] + [("h", "i")], key=str)
    forms = dict(found(lookalikes.forms(chunks(spark, rows))))
    assert forms["b"] == "café report" and forms["k"] is None and forms["l"] == "" and len(forms) == 12
    assert not lookalikes.print_alikes(chunks(spark, rows).limit(0)).collect()


def test_vocabulary_decides_between_readings(spark):
    looks = lookalikes.Looks.of(spark)
    stroke = "\u04c0"  # prints like l, I and 1
    assert lookalikes.Canonical([], looks).text(f"{stroke}aw in {stroke}t") == "Iaw in It"
    assert lookalikes.Canonical(["law", "It"], looks).text(f"{stroke}aw in {stroke}t") == "law in It"
    rows = [("a", f"the {stroke}aw says"), ("b", "the law says"), ("c", "the Iaw says")]
    assert found(lookalikes.print_alikes(chunks(spark, rows))) == [("a", "c")]  # the table's reading is a word here, too
    assert found(lookalikes.print_alikes(chunks(spark, rows[:2]))) == [("a", "b")] and not found(lookalikes.print_alikes(chunks(spark, rows[:2]), top=0))
    assert looks.by_table("\U0001d401\u2163\u0455\uff21") == "BIVsA" and looks.by_table("\u00e9\u00df\u00f8") == "\u00e9\u00df\u00f8"


@pytest.mark.parametrize("seed", range(3))
def test_automaton_equals_plain_edit_distance(seed):
    rng = random.Random(seed)
    looks, words = lookalikes.Looks({"\u0430": ("a", "o"), "\u0441": ("c",)}), sorted({"".join(rng.choice("abco") for _ in range(rng.randint(1, 5))) for _ in range(25)})
    trie = lookalikes.Trie(words)

    def distance(token, word):
        row = list(range(len(word) + 1))
        for c in token:
            if c == "\u200b":
                continue
            new = [row[0] + 1]
            for j, w in enumerate(word):
                new.append(min(row[j] + (w not in looks.read(c)), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    for _ in range(150):
        token, budget = "".join(rng.choice("abco\u0430\u0441\u200b") for _ in range(rng.randint(1, 6))), rng.randint(0, 2)
        best = min(distance(token, w) for w in words)
        got = trie.reach(token, looks, budget)
        assert (got is None) == (best > budget) and (got is None or distance(token, got) == best)


def test_lookalike_classes(spark):
    rows = [("a", "c\u0430t"), ("b", "cat"), ("c", "cat"), ("d", "dog"), ("e", None), ("f", "c\u200bat"), ("b", "cat")]
    got = {r.chunk_id: (r.class_id, r.n_alike) for r in lookalikes.alike_classes(chunks(spark, rows)).collect()}
    assert {k: n for k, (_, n) in got.items()} == {"a": 3, "b": 2, "c": 2, "f": 3} and len({c for c, _ in got.values()}) == 1
    assert len(found(lookalikes.print_alikes(chunks(spark, rows)))) == sum(n for _, n in got.values()) // 2
    assert not lookalikes.alike_classes(chunks(spark, rows).limit(0)).collect()


def test_quality(spark):
    table = "\n".join(f"Item {i} | {i} | {i * 7}" for i in range(8))
    rows = [
        ("p", PROSE * 4), ("t", table), ("l", "Bring the following\n- blue badge\n- signed order\n- duty log\n- boat key"), ("c", "Duties .......... 3-4\nRights ........ 5-6\nBoards ....... 7-8"),
        ("j", "fbsnrgg hwdpw mh kcf bfk wfktwhn dmfbdw smj wsdwcwjfp kzrjkc " * 4), ("s", "~|°;:\\§al1o{´;_;°´|n=¦r{a " * 9), ("n", None), ("e", ""), ("b", " \n "), ("w", "\n".join(PROSE[i : i + 50].strip() for i in range(0, 100, 50)) + "\n" + PROSE),
    ]
    got = dict(found(quality.not_prose(chunks(spark, rows + rows[:2]))))
    assert got == {"t": "table", "c": "table", "l": "list", "j": "junk", "s": "junk"}
    stats = {r.chunk_id: r for r in quality.quality(chunks(spark, rows)).collect()}
    assert stats["n"].verdict is None and stats["e"].n_words is None and stats["p"].verdict == "prose" and stats["p"].common_share > 0.3
    assert quality.by_page(chunks(spark, rows)).collect()[0].n_chunks == len(rows)
    assert not quality.not_prose(chunks(spark, []).limit(0)).collect()


def test_boilerplate(spark):
    passage = "Submit the signed form to the clerk of the board before noon"
    rows = [("a", f"{passage}.\n\n{passage}."), ("b", "of the order in the file " * 12), ("c", PROSE * 2), ("d", None), ("e", "x"), ("a", f"{passage}.\n\n{passage}.")]
    got = {r.chunk_id: r for r in quality.repeating(chunks(spark, rows)).collect()}
    assert set(got) == {"a", "b"} and got["a"].dup_paragraph_share == 0.5 and got["b"].top_ngram_share > 0.7
    assert quality._top_ngram("a b a b a c".split(), 6) == 5 / 6 and quality._top_ngram("a b c".split(), 3) == 0 and quality._top_ngram(["a"], 1) == 0
    assert not quality.repeating(chunks(spark, rows).limit(0)).collect()


def test_shared_spans(spark):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common = text(300)
    rows = [("a", text(200) + common + "#" + text(100)), ("b", common + "%" + text(50)), ("c", text(500)), ("d", text(299)), ("e", None), ("f", ""), ("g", common[:299] + "#" + text(100)), ("b", None)]
    rows += [(f"copy{i}", rows[2][1]) for i in range(4)] + [rows[0]]
    got = set(found(shared_spans.sharing_pairs(chunks(spark, rows))))
    by = {k: t for k, t in rows if t}
    ids = sorted(by)
    has = lambda x, y: any(x[i : i + 300] in y for i in range(len(x) - 299))
    assert got == {(x, y) for i, x in enumerate(ids) for y in ids[i + 1 :] if has(by[x], by[y])}
    amount = {r.chunk_id: r for r in shared_spans.shared_amount(chunks(spark, rows)).collect()}
    assert amount["a"].shared_chars == 300 and amount["a"].n_partners == 1 and amount["c"].shared_chars == 500 and amount["c"].n_partners == 4
    assert [(r.start, r.end) for r in amount["a"].intervals] == [(200, 500)] and [(r.start, r.end) for r in amount["c"].intervals] == [(0, 500)]
    classes = {}
    for r in shared_spans.shared_classes(chunks(spark, rows)).collect():
        classes.setdefault(r.class_id, set()).add(r.chunk_id)
    assert sorted(map(sorted, classes.values())) == [["a", "b"], ["c", *(f"copy{i}" for i in range(4))]]
    assert not shared_spans.shared_amount(chunks(spark, rows).limit(0)).collect() and not shared_spans.shared_classes(chunks(spark, rows).limit(0)).collect()
    assert "g" not in amount and not shared_spans.sharing_pairs(chunks(spark, rows).limit(0)).collect()


TITLES = [f"{a} {b} {c}" for a in ("Recording", "Requesting", "Reviewing", "Rights of", "Limits on", "Delayed", "Formal") for b in ("Protective", "Separation", "Financial", "Voluntary") for c in ("Orders", "Boards", "Agreements", "Certificates and Permits", "Results for the Recorder", "Custody")]


def test_truncation_held_out():
    rng = random.Random(3)
    kept = TITLES[:]
    rng.shuffle(kept)
    train, test = kept[:120], kept[120:]
    cut = [t[: rng.randint(len(t) // 2, len(t) - 2)] for t in train[:10]]
    model = truncation.Model.train([(t, 0) for t in train + cut])
    whole = model.scores([(t, 0) for t in test])
    inside = [t[:k] for t in test for k in (len(t) - 3, len(t) - 4) if t[k].isalnum() and t[k - 1].isalnum()]
    broken = model.scores([(t, 0) for t in inside])
    assert (whole < 0.5).mean() > 0.9 and (broken > 0.5).mean() > 0.9
    assert model.scores([(test[0] + "…", 0)])[0] > 0.5


def test_limits_despite_longer_values(spark):
    rows = [("s", "x" * 40)] * 60 + [("s", "y" * (20 + i % 19)) for i in range(80)] + [("s", "z" * 90)] + [("t", "w" * (10 + i)) for i in range(60)] + [(None, "v" * 30)] * 9
    got = dict(found(truncation.source_limits(spark.createDataFrame(rows, "source string, value string"))))
    assert got == {"s": 40, "t": None, None: 30}


def test_truncation(spark):
    rows = [(f"c{i}", "x", t, "s") for i, t in enumerate(TITLES)] + [(f"z{i}", "x", t[: len(t) - 3], "s") for i, t in enumerate(TITLES[:9])] + [("n", "x", None, "s"), ("e", "x", "", "s"), ("c0", "x", TITLES[0], "s"), ("m", "x", TITLES[5] + "…", None)]
    got = {r.id for r in truncation.truncated(chunks(spark, rows)).collect()}
    assert "m" in got and "n" not in got and "e" not in got and len([g for g in got if g[0] == "z"]) >= 3 and len([g for g in got if g[0] == "c"]) < 12
    rates = {r.source: r for r in truncation.truncation_rates(chunks(spark, rows)).collect()}
    assert rates[None].share == 1.0 and rates["s"].n_values == len(TITLES) + 10
    assert not truncation.truncated(chunks(spark, rows).limit(0)).collect()


EASY = "You must bring the badge to the desk. The cook has a key. Ask the guard for it. "
HARD = "Notwithstanding the aforementioned constitutional considerations, the administrative adjudication necessarily presupposes institutional accountability whose justification remains fundamentally indeterminate notwithstanding contemporaneous authorization. "


def test_reading(spark):
    docs = spark.createDataFrame([(i, (EASY, PROSE, HARD)[i % 3] * (3 + i % 4), "en", "t") for i in range(90)] + [(200, None, "en", "t"), (201, "", "en", "t"), (202, EASY * 5, "fr", "t"), (203, EASY * 5, None, "t")], "doc_id bigint, text string, lang string, band string")
    labels = spark.createDataFrame([(i, "ann", ("plain", "standard", "demanding")[i % 3] if i % 10 else "plain") for i in range(60)] + [(5, "b", "plain"), (None, "a", "plain"), (7, "a", None)], "doc_id bigint, annotator string, band string")
    got = {r.doc_id: r for r in reading.reading_levels(docs, labels).collect()}
    assert set(got) == {*range(90), 200, 201} and got[200].band is None and got[201].level is None
    held_out = [got[i].band == ("plain", "standard", "demanding")[i % 3] for i in range(60, 90)]
    assert sum(held_out) == len(held_out)
    assert len(reading.reading_levels(docs, labels.limit(0)).collect()) == 92
    assert not reading.reading_levels(docs.limit(0), labels).collect()


def test_reading_of_every_document(spark, tmp_path):
    other = [(200, None, "en"), (202, "El oficial debe firmar el informe. " * 5, "es"), (203, EASY * 5, None), (204, "El oficial debe firmar el informe. " * 5, None), (205, None, None), (206, "", "fr")]
    spark.createDataFrame([(i, (EASY, PROSE, HARD)[i % 3] * 3, "en") for i in range(30)] + other, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, "ann", ("plain", "standard", "demanding")[i % 3]) for i in range(30)], "doc_id bigint, annotator string, band string").write.parquet(str(tmp_path / "reading_labels.parquet"))
    got = {r.doc_id: r for r in llm_queries.p9_levels(spark, str(tmp_path)).collect()}
    assert set(got) == {*range(30), *range(200, 207)} - {201} and got[203].band == got[0].band == "plain"
    assert got[202].words == 30 and got[202].band == got[204].band == "plain"  # by the formula of the language
    assert all(got[i].level is None and got[i].grade is None and got[i].band is None for i in (200, 205, 206))
    assert {r.doc_id for r in llm_queries.p9_found(spark, str(tmp_path)).collect()} <= set(range(30))


def scan_rows():
    rows = [(f"p{i}", PROSE * 6 + "A cross-examination of the officer is held. ") for i in range(40)]
    wrapped = "The officer of the watch must sign the re-\n   port before the end of the day, and the cl-\nGUARD BOOK 12\nerk will keep it in the file. The 0fficer of the watch held a cross-\nexamination and the rep0rt is kept\n- 14 -\nin the file. The ofiicer may sign it\n"
    return rows + [("s", wrapped), ("s", wrapped), ("n", None), ("e", "")]


def scan_pages(spark):
    rows = [("b", "1", i, f"GUARD BOOK 12\n{PROSE}\nPage {i}", False) for i in range(1, 60)] + [("b", "1", 60, None, None), ("b", "1", 61, "", None)]
    return spark.createDataFrame(rows, "doc string, chapter string, page_num int, text string, is_exhibit boolean")


def test_scanned(spark):
    df = chunks(spark, scan_rows())
    got = {r[1:3] for r in found(scanned.noise(df, scan_pages(spark))) if r[0] == "s"}
    assert {("hyphen", "report"), ("hyphen", "clerk"), ("header", "GUARD BOOK 12"), ("page_no", "- 14 -"), ("misread", "officer"), ("misread", "report")} <= got
    assert ("hyphen", "crossexamination") not in got
    fixed = {r.chunk_id: r.text for r in scanned.repaired(df, scan_pages(spark)).collect()}
    assert "GUARD BOOK" not in fixed["s"] and "- 14 -" not in fixed["s"] and "sign the report before" in fixed["s"] and "cross-examination" in fixed["s"] and "clerk" in fixed["s"] and "0fficer" not in fixed["s"]
    assert fixed["n"] is None and fixed["e"] == ""


def test_misread_at_the_ends(spark):
    rows = scan_rows() + [("first", "Rcport to the clerk. " + PROSE * 2), ("last", PROSE * 2 + "The clerk will keep the rcport.")]
    got = found(scanned.noise(chunks(spark, rows), scan_pages(spark)))
    assert {r[0] for r in got if r[1:3] == ("misread", "report")} >= {"first", "last"}
    misread = spark.createDataFrame([("a", "lear", "first", "tear", 1.0), ("b", "lear", "", "tear", 1.0), ("c", "rcport", "last", "report", 1.0), ("d", "lear", "last", "tear", 1.0)], "id string, spelling string, end string, word string, cost double")
    counts = spark.createDataFrame([("clear", 9), ("rcported", 5), ("rcports", 2), ("tear", 50)], "word string, n bigint")
    fixed = spark.createDataFrame([("lear", "tear"), ("rcported", "reported")], "spelling string, word string")
    assert {r.id for r in scanned.not_fragments(misread, counts, fixed).collect()} == {"b", "c", "d"}


def test_scanned_empty(spark):
    assert not scanned.noise(chunks(spark, scan_rows()).limit(0), scan_pages(spark).limit(0)).collect()


def test_hot_key(spark):
    """A third of all rows alike: nothing is lost."""
    rows = [(f"h{i:03d}", PROSE * 4) for i in range(100)] + [(f"c{i:03d}", PROSE * 4 + chr(97 + i % 26) * (i + 1)) for i in range(60)]
    df = chunks(spark, rows)
    n = shared_spans.sharing_pairs(df).count()
    assert n == 160 * 159 // 2
    alike = df.withColumn("text", F.when(F.col("chunk_id") < "h050", F.regexp_replace("text", "officer", "offi​cer")).otherwise(F.col("text")))
    assert lookalikes.print_alikes(alike.where("chunk_id >= 'h'")).count() == 50 * 50


def test_hot_formulas(spark, monkeypatch):
    """A formula of 250 characters in every text makes no pairs; longer shared runs do."""
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    formula, runs = text(250), [text(320), text(700)]
    rows = [(f"f{i:02d}", text(100) + formula + "#" + text(90) + (runs[i % 2] + text(5) if i < 9 else "")) for i in range(40)]
    df = chunks(spark, rows)
    assert shared_spans._hot(shared_spans._texts(df, "chunk_id", "text", 300), 300, 150).size
    got = set(found(shared_spans.sharing_pairs(df)))
    monkeypatch.setattr(shared_spans, "HOT", 2.0)  # the other way
    assert got == set(found(shared_spans.sharing_pairs(df)))
    assert got == {(f"f{i:02d}", f"f{j:02d}") for i in range(9) for j in range(i + 1, 9) if i % 2 == j % 2}
