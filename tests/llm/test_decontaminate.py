"""Decontamination: planted, re-parameterised and contradictory questions; the given benchmark."""

import random
import time
import re
from collections import defaultdict

from pyspark.sql import functions as F

from cladeloom.llm import decontaminate, queries

QUESTION = (
    "A train leaves London at 60 km per hour and arrives after 3 hours. How far is it from London to Paris if "
    "the driver Smith stops for 20 minutes and then the driver Smith goes on at 60 km per hour to the end?"
)
FILLED = (
    "A train leaves Oslo at 75 km per hour and arrives after 4 hours. How far is it from Oslo to Rome if "
    "the driver Jones stops for 15 minutes and then the driver Jones goes on at 75 km per hour to the end?"
)
MIXED = (
    "A train leaves Oslo at 75 km per hour and arrives after 4 hours. How far is it from Rome to Oslo if "
    "the driver Jones stops for 75 minutes and then the driver Oslo goes on at 15 km per hour to the end?"
)


def found(documents, texts, items):
    bench = documents([(i, t) for i, t in enumerate(items)]).withColumnRenamed("doc_id", "item_id")
    rows = decontaminate.find_leaks(documents(list(enumerate(texts))), bench).collect()
    return [[(x.item_id, x.changed > 0) for x in r.leaks] for r in sorted(rows, key=lambda r: r.doc_id)]


def test_templates_and_slots(documents):
    texts = [
        f"Some words before. {QUESTION} And after.", f"Before it {FILLED} after", MIXED, QUESTION.lower().replace(",", " "),
        QUESTION.upper(), QUESTION[:90], "A train leaves nothing and arrives.", "", None, "x " * 50000 + FILLED,
    ]
    items = [QUESTION, None, "", "too short", "1 2 3 4 5 6 7 8 9 10"]
    assert found(documents, texts, items) == [
        [(0, False)], [(0, True)], [], [(0, False)], [(0, False)], [], [], [], [], [(0, True)]
    ]
    assert found(documents, texts, []) == [[]] * len(texts)
    assert found(documents, [], items) == []


def test_blocks_give_the_same(documents, monkeypatch):
    rng = random.Random(2)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]
    items = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 40))) for _ in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(30)) + " " + rng.choice(items) for _ in range(60)]
    whole = found(documents, texts, items)
    assert all(whole)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1500)
    assert [sorted(x) for x in found(documents, texts, items)] == [sorted(x) for x in whole]


def test_query_against_literal_search(spark):
    sf = "/root/testdata/sf0.01"
    plain = lambda t: re.findall(r"\w+", t.lower())
    docs = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    index = defaultdict(set)
    for i, w in items.items():
        for k in range(len(w) - 7):
            index[tuple(w[k : k + 8])].add((i, k))
    want = set()
    for d, w in docs.items():
        covered = defaultdict(set)
        for p in range(len(w) - 7):
            for i, k in index.get(tuple(w[p : p + 8]), ()):
                covered[i].update(range(k, k + 8))
        want |= {(d, i) for i, c in covered.items() if len(c) >= 0.5 * len(items[i])}
    got = {(r.doc_id, r.item_id) for r in queries.op2_decontaminate(spark, sf).collect()}
    assert got == want and want


def test_repeated_rows_and_clashing_columns(documents):
    df = documents([(None, QUESTION), (None, QUESTION)]).withColumnRenamed("source", "leaks")
    bench = documents([(1, QUESTION)]).withColumnRenamed("doc_id", "item_id")
    rows = decontaminate.find_leaks(df, bench).collect()
    assert [len(r.leaks) for r in rows] == [1, 1]


def test_parallel_sentences(documents):
    item = "A train travels 5 miles in 3 hours. A train travels 7 miles in 4 hours. Which is faster?"
    more = " ".join(f"A train travels {5 + 2 * i} miles in {3 + i} hours." for i in range(6)) + " Which of them is the fastest?"
    early = "A train leaves London at 9 km per hour and arrives after 8 hours. Then: "
    texts = [item, f"Before. {item} And after.", more, f"x {more} y", early + QUESTION, "A train travels 5 miles in 3 hours."]
    got = found(documents, texts, [item, more, QUESTION])
    assert all((n, False) in got[i] for i, n in ((0, 0), (1, 0), (2, 1), (3, 1), (4, 2)))
    refilled = item.replace("5 ", "50 ").replace("3 ", "30 ").replace("7 ", "70 ").replace("4 ", "40 ")
    assert (0, True) in found(documents, [refilled], [item])[0]


def test_items_without_template_windows_are_found_as_they_stand():
    chinese = "小明有十五个苹果，他给了小红三个，还剩多少个苹果？"
    items = [(1, "Compute 12 + 34 - 56 * 78 / 90"), (2, "What is 15 * 17?"), (3, chinese), (4, "Why?")]
    index = decontaminate.Index(items)
    texts = {
        "Please compute 12 + 34 - 56 * 78 / 90 now.": [(1, 1.0, 5, 0)],
        "So, what is 15 * 17? It is 255.": [(2, 1.0, 2, 0)],
        f"今天我们来看一道题。{chinese}答案是十二。": [(3, 1.0, 0, 0)],
        "What is 15 and 18? Why?": [],
        "Compute 12 + 34 - 56 * 78 / 91": [],
        "今天我们去苹果店。": [],
    }
    assert {t: index.leaks(t) for t in texts} == texts


def test_repetitive_texts_take_linear_time():
    item = "Tom has 12 apples and gives 3 apples to Ann. How many apples does Tom have now in his big red box?"
    index = decontaminate.Index([(4, item)])
    again = item.replace("12", "40").replace("3", "9").replace("Tom", "Bob") + " "
    numbered = "".join(f"Tom has {i} apples and gives {i * 7 % 31} apples to Ann. " for i in range(20000))
    for text, held in ((again * 10000, True), (again[:45] * 20000, False), ("apples does Tom have now in his big red box and " * 20000, False), (numbered, False)):
        begun = time.process_time()
        assert bool(index.leaks(text)) == held
        assert time.process_time() - begun < 15


def test_blocks_of_the_benchmark_one_after_the_other(documents, spark, monkeypatch):
    questions = [(i, f"A {a} walks {7 + i} miles to the old mill near {b} and then back home again before noon.") for i, (a, b) in enumerate([("baker", "Rome"), ("tall farmer", "Oslo"), ("young pilot", "Bonn")])]
    bench = spark.createDataFrame(questions, "item_id long, text string")
    rows = [(i, f"Listen: {questions[i % 3][1]} Thanks.", "en", "s") for i in range(6)] + [(7, None), (7, None), (8, ""), (9, questions[0][1] + " " + questions[2][1])]
    docs = documents(rows).withColumn("leaks", F.lit("clash")).withColumn("row", F.lit(3))

    def found():
        got = decontaminate.find_leaks(docs, bench).collect()
        return sorted(((r.doc_id, r.text, r.row, sorted(map(tuple, r.leaks))) for r in got), key=str)

    whole = found()
    # the items are one template filled three times, so each is found in every one
    assert len(whole) == len(rows) and [[x[0] for x in r[3]] for r in whole if r[0] == 9] == [[0, 1, 2]]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 80)
    assert found() == whole
