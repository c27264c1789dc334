import random

import numpy as np

from wayfold.llm import decontam as D
from wayfold.llm.words import word_ids


def plain_score(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_smith_waterman():
    draw = random.Random(1)
    for _ in range(200):
        a, b = ([draw.randint(0, 4) for _ in range(draw.randint(1, 14))] for _ in range(2))
        assert D.smith_waterman(np.array(a, np.uint64), np.array(b, np.uint64))[0] == plain_score(a, b)


def planted(spark):
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdefghijkl") for _ in range(5))
    items = [[word() for _ in range(n)] for n in (3, 12, 40, 60)]
    docs, leaks = [], set()
    for k in range(60):
        text = [word() for _ in range(draw.randint(20, 200))]
        if k % 3 == 0:
            n = draw.randrange(4)
            copy = list(items[n])
            for _ in range(len(copy) // 12):
                at = draw.randrange(len(copy))
                copy[at : at + draw.randint(0, 1)] = [word()]
            at = draw.randrange(len(text))
            text[at:at] = copy
            leaks.add((k, n))
        docs.append((k, " ".join(text)))
    docs += [(100, None), (101, "")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(n, " ".join(i)) for n, i in enumerate(items)] + [(9, None), (10, "")], "item_id long, text string"), leaks


def test_edited_passages_are_found_both_ways(spark):
    docs, items, leaks = planted(spark)
    for shared in (10**6, 0):
        rows = D.find(docs, items, most_shared=shared).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == leaks and len(rows) == len(leaks)
    text = {r.doc_id: r.text for r in docs.collect()}
    item = {r.item_id: r.text for r in items.collect()}
    for r in rows:
        assert r.matched == plain_score(word_ids(item[r.item_id]).tolist(), word_ids(text[r.doc_id]).tolist())


def test_heavily_edited_copies_as_by_full_alignment(spark):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefghijkl") for _ in range(5))
    items = [[word() for _ in range(n)] for n in (4, 5, 6, 7, 16, 16, 24, 60, 160)]
    docs = []
    for item in items:
        copies = [[word() if k % 4 == 3 else w for k, w in enumerate(item)], [x for k, w in enumerate(item) for x in ([w, word()] if k % 3 == 2 else [w])], [x for k, w in enumerate(item) for x in ([w, word()] if k % 2 else [w])], [w for k, w in enumerate(item) if k % 4 != 3]]
        for _ in range(12):
            copy = []
            for w in item:
                copy += draw.choice([[word()], [], [w, word()]]) if draw.random() < draw.choice([0.2, 0.25]) else [w]
            copies.append(copy)
        for copy in copies:
            around = [word() for _ in range(40)]
            docs.append((len(docs), " ".join(around[:20] + copy + around[20:])))
    want = {(d, n): s for d, t in docs for n, i in enumerate(items) if D.enough(s := plain_score(i, t.split()), len(i))}
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(n, " ".join(i)) for n, i in enumerate(items)], "item_id long, text string")
    assert len(want) > 80
    for shared in (10**6, 0):
        assert {(r.doc_id, r.item_id): r.matched for r in D.find(*tables, most_shared=shared).collect()} == want


def test_one_item_in_most_documents(spark):
    passage = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(k, f"x{k} y{k} {passage} z{k}") for k in range(200)], "doc_id long, text string")
    items = spark.createDataFrame([(0, passage)], "item_id long, text string")
    assert D.find(docs, items).count() == 200


def test_odd_tables(docs, empty, spark):
    items = spark.createDataFrame([(1, "The cat sat on the mat."), (2, None)], "item_id long, text string")
    assert sorted(r.doc_id for r in D.find(docs, items).select("doc_id").distinct().collect()) == [4, 5]
    kept = D.clean(docs, items)
    assert kept.columns == docs.columns and kept.filter("doc_id in (4, 5)").count() == 0 and kept.count() == 8
    assert D.find(empty, items).count() == 0 and D.find(docs, items.limit(0)).count() == 0


def test_ids_of_any_type(docs, spark):
    items = spark.createDataFrame([(1, "The cat sat on the mat.")], "item_id long, text string")
    for kind in ("smallint", "string", "date", "decimal(9,2)"):
        typed = items.selectExpr("cast('2024-01-01' AS date) AS item_id" if kind == "date" else f"cast(item_id AS {kind}) AS item_id", "text")
        for shared in (10**6, 0):
            found = D.find(docs, typed, most_shared=shared)
            assert found.schema["item_id"].dataType == typed.schema["item_id"].dataType
            assert {r.doc_id for r in found.collect()} == {4, 5} and {r.item_id for r in found.collect()} == {r.item_id for r in typed.collect()}


def test_repeated_and_null_ids_mean_the_same_both_ways(spark):
    a, b = "one two three four five six seven eight", "red green blue white black brown grey pink"
    items = spark.createDataFrame([(7, a), (7, b), (None, a), (7, a)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {a} y"), (2, f"x {b} y"), (None, f"z {a}"), (None, "clean text"), (1, "other text of one"), (3, None)], "doc_id long, text string")
    want = {(1, 7), (1, None), (2, 7), (None, 7), (None, None)}
    for shared in (10**6, 0):
        rows = D.find(docs, items, most_shared=shared).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want)
        kept = D.clean(docs, items, most_shared=shared)
        assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([(None, "clean text"), (1, "other text of one"), (3, None)], key=str)


def test_both_ways_on_the_corpus(spark, corpus):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    one, other = (sorted(map(tuple, D.find(corpus, items, most_shared=shared).collect())) for shared in (10**6, 0))
    assert one == other and one
