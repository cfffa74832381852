from tessel.llm import registry
from tessel.llm.queries_text import P2_SQL
from tessel.llm.reading import Model, fit, isotonic, reading_levels, train
from tessel.llm.lexicon import Trie, candidates
from tessel.llm.scans import Vocabulary, furniture, repair_scans, title_shown
from tests.oracle import compare

KEYS = ["file_id", "node_index", "chunk_index"]
CLEAN = ["The settlement desk compares the daily report with the merchant contract and keeps both records.", "客户可以到网点付款。工作人员会核对账户资料。请看清金额再付款。", "The term runs from 2019 to 2021. A buy-back-and-hold plan stays. The branch manager approved the request."] * 5
PAGE = (
    "The sett1ement desk compares the daily re-\n第 3 页\n\nAcme Trust — Settlement overview of the branch\nport with the merchant contract\nand keeps both records. The branch mana-\nger approved the request.\nYear and count:\n2024\n1,250.00\n\nThe term runs from 2019-\n2021 and a buy-back-\nand-hold plan stays."
)


def run(spark, items):
    heads = spark.createDataFrame([(1, 1, "Settlement overview of the branch"), (2, 1, "x"), (3, 1, "付款")], "file_id long, node_index int, text string")
    corpus = spark.createDataFrame([(t,) for t in CLEAN], "text string")
    d = spark.createDataFrame(items, "file_id long, node_index int, chunk_index int, text string")
    return {(r.file_id, r.node_index): r for r in repair_scans(d, heads, corpus, KEYS).collect()}


def test_noises_and_repair(spark):
    got = run(spark, [(1, 2, -1, PAGE), (2, 2, -1, "Clean text, once.\n第 3 页"), (1, 3, -1, None), (1, 4, -1, ""), (3, 2, -1, "客卢可以到网点付款。工作\n人员会核对帐户\n资料。请看\n清金额再付款。")])
    r = got[1, 2]
    assert r.scanned and set(r.noises) == {"hyphen", "misread", "header", "page_no"}
    assert r.text.startswith("The settlement desk compares the daily report with the merchant contract and keeps both records. The branch manager approved")
    assert "2024 1,250.00" in r.text and "buy-back-and-hold" in r.text and "第 3 页" not in r.text
    assert got[2, 2].noises == [] and not got[2, 2].scanned and got[2, 2].text.endswith("第 3 页")
    assert got[1, 3].text is None and got[1, 4].noises == []
    assert got[3, 2].noises == ["misread"] and got[3, 2].text.startswith("客户可以到网点付款。工作人员会核对账户资料")


def test_furniture_lines():
    v = furniture(["text goes on", "xvi", "and on", "12", "and on", "合计如下：", "2024", "1,250.00", "See page 3", "7 Acme — The tltle here"], "The title here")
    assert v == [(), ("page_no",), (), ("page_no",), (), (), (), (), (), ("header", "page_no", "misread")]
    assert furniture([], "t") == [] and furniture(["17"], "") == [()]


def test_headers_by_repetition(spark):
    # no title shows: file 9 has no heading; node 6 has the header misread, and a text recurs in every node
    same = "keeps both records with the\nmerchant contract and the\ndaily report."
    starts = ["The branch manager", "The settlement desk", "The merchant contract", "The daily report", "The manager", "The desk"]
    ends = ["compares the report", "approved the request", "keeps the contract", "stays both", "compares and", "and the"]
    items = [(9, k + 1, -1, f"{starts[k]}\n{'Notice of the institution' if k < 5 else 'Notice of the instifution'} {k}\n{ends[k]}\n{same}") for k in range(6)]
    got = run(spark, items)
    assert all(set(got[9, k].noises) == {"header", "page_no"} for k in range(1, 6)) and set(got[9, 6].noises) == {"header", "page_no", "misread"}
    assert all(got[9, k + 1].text == f"{starts[k]} {ends[k]} {same}".replace("\n", " ") for k in range(6))


def test_result_does_not_depend_on_what_workers_hold(spark):
    heads = spark.createDataFrame([(1, 1, "Settlement overview of the branch"), (3, 1, "付款")], "file_id long, node_index int, text string")
    corpus = spark.createDataFrame([(t,) for t in CLEAN], "text string")
    rows = [(1, 2, -1, PAGE), (3, 2, -1, "客卢可以到网点付款。工作\n人员会核对帐户\n资料。请看\n清金额再付款。"), (1, 3, -1, "The branch manaqer appr0ved the\nreqnest of the merch-\nant and keeps"), (4, 1, -1, None)]
    d = spark.createDataFrame(rows * 2, "file_id long, node_index int, chunk_index int, text string")
    want = sorted((r.file_id, r.node_index, r.noises, r.text or "") for r in repair_scans(d, heads, corpus, KEYS).collect())
    assert len(want) == 8
    for grams in (0, 3, 40):
        assert sorted((r.file_id, r.node_index, r.noises, r.text or "") for r in repair_scans(d, heads, corpus, KEYS, grams).collect()) == want


def test_candidates_over_tables(spark):
    import random

    rnd = random.Random(4)
    word = lambda least: "".join(rnd.choice("abc") for _ in range(rnd.randint(least, 8)))
    words, read = {word(2) for _ in range(400)}, {word(3) for _ in range(80)} | {"a1c", "ab0cab"}
    got = candidates(spark.createDataFrame([(r,) for r in read] * 2, "r string"), spark.createDataFrame([(w,) for w in words], "w string"), "r", "w").collect()
    assert len(got) == len({tuple(x) for x in got}) and {tuple(x) for x in got} == {(r, w) for r in read for w, *_ in Trie(words).within_one(r)}


def test_confusions_are_learned_from_the_texts(spark):
    # confusions that nothing names beforehand: k for x, and two letters for one (cj for q); names stay as they are
    said = ["the next box holds six extra taxes", "six extra boxes quit the quiet square", "the quick taxes next quarter equal extra boxes", "a quiet box for the next square quarter"] * 4
    scan = [t.replace("x", "k") if i % 2 else t.replace("q", "cj") for i, t in enumerate(said)]
    items = [(5, i, -1, "and so it goes\non as before " + t.split(" ", 1)[0] + " " + t.split(" ", 1)[1] + " and on\nand on") for i, t in enumerate(scan)] + [(5, 99, -1, "the Bokes of\nPakton quit the quiet square and so")]
    heads = spark.createDataFrame([], "file_id long, node_index int, text string")
    corpus = spark.createDataFrame([(t,) for t in said] + [("and so it goes on as before the and on and a six the for",)] * 9, "text string")
    d = spark.createDataFrame(items, "file_id long, node_index int, chunk_index int, text string")
    got = {r.node_index: r.text for r in repair_scans(d, heads, corpus, KEYS).collect()}
    right = sum(t in got[i] for i, t in enumerate(said))
    assert right >= 0.95 * len(said), [(t, got[i]) for i, t in enumerate(said) if t not in got[i]]
    assert "Pakton" in got[99]


def test_scans_and_titles(spark):
    title = "Notes on the yearly settlement of partner institutions and their branches"
    assert title_shown("12 Acme — " + title[:37], title) == (10, 47, True) and title_shown(title[:30] + " · Acme 7", title)[:2] == (0, 30)
    assert title_shown("Notes on the wall", title) is None and title_shown("", title) is None and title_shown(title, title) == (0, len(title), True)
    # one broken line in a file of one, and a file of many whole lines with one broken by chance
    got = run(spark, [(1, 2, -1, "The settlement desk compares the daily re-\nport with the merchant contract."), (2, 2, -1, "whole line.\n" * 30 + "a line that\ngoes on.")])
    assert got[1, 2].scanned and got[1, 2].noises == ["hyphen"] and not got[2, 2].scanned


def test_empty_vocabulary(spark):
    heads = spark.createDataFrame([], "file_id long, node_index int, text string")
    d = spark.createDataFrame([(1, 1, -1, "a b\nc d\ne f\ng h\nof text")], "file_id long, node_index int, chunk_index int, text string")
    r = repair_scans(d, heads, spark.createDataFrame([], "text string"), KEYS).first()
    assert r.noises == [] and r.text == "a b c d e f g h of text"
    assert repair_scans(d.limit(0), heads, spark.createDataFrame([], "text string"), KEYS).count() == 0
    assert isinstance(Vocabulary, type)


def test_isotonic():
    import numpy as np

    edges, levels = isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([1.0, 3, 2, 4, 5]))
    assert levels == [1.0, 2.5, 4.5] and edges == [1.0, 2.0, 4.0]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/reading_labels.parquet")
    model = train(docs, labels.where("doc_id % 4 <> 0"))
    got = {r.doc_id: r.band for r in reading_levels(docs, model).collect()}
    held = labels.where("doc_id % 4 = 0 and band is not null").groupBy("doc_id").avg("band").collect()
    near = [abs(got[r[0]] - r[1]) <= 1 for r in held if got[r[0]] is not None]
    assert len(near) >= 15 and sum(near) / len(near) >= 0.85
    assert len(got) == docs.count()


def test_reading_cases(spark):
    assert fit([], [], frozenset()) == Model()
    d = spark.createDataFrame([(1, None), (2, ""), (3, "word"), (4, "long. " * 30_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, rater_id string, band int")
    got = {r.doc_id: r.band for r in reading_levels(d, train(d, none)).collect()}
    assert got == {1: None, 2: None, 3: 3, 4: 3}


def test_queries_run(spark, sf):
    compare(spark, sf, "p2_found", registry.QUERIES["p2_found"], P2_SQL["p2_found"])
    for name in ("p3_found", "p7_report", "p8_report", "p9_profile"):
        assert registry.QUERIES[name](spark, sf).count() > 0
