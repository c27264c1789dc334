import hashlib
import math
import random
import re
import zlib

import pytest

from wayfold.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text: str | None) -> tuple[int, list[int]]:
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain(docs: list[tuple], items: list[str | None]) -> list[tuple]:
    """doc_id, n_features, weight, score and rank, document by document."""
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [x for _, x in docs]), (t, items)):
        for x in texts:
            for b in runs(x)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10000) / ((s[b] + 1) * (sum(t) + 10000)))) for b in range(10000)]
    out = []
    for i, x in docs:
        n, found = runs(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20))
    order = sorted((x for x in out if x[4]), key=lambda x: (-x[3], -1 if x[0] is None else x[0], x[1]))[: 5 * sum(x[4] for x in out) // 100]
    place = {id(x): k for k, x in enumerate(order, 1)}
    return sorted(((*x[:4], place.get(id(x))) for x in out), key=str)


def drawn(docs, items) -> list[tuple]:
    return sorted((tuple(r) for r in resampling.resample(docs, items).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_op11_against_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted((tuple(r) for r in resampling.op11_crc_resampling(spark, sf).collect()), key=str)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert got == plain(docs, items) and any(r[4] for r in got)


def test_odd_rows(spark, docs, empty):
    items = spark.createDataFrame([(1, "the cat sat"), (2, None)], "item_id long, text string")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert drawn(docs, items) == plain(rows, ["the cat sat", None])
    assert drawn(docs, items.limit(0)) == plain(rows, [])
    assert drawn(empty, items) == []


def test_ties_nulls_and_repeats(spark):
    long = " ".join(f"w{k}" for k in range(30))
    rows = [(None, long), (None, long)] + [(k % 40, long) for k in range(80)] + [(7, None), (None, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([("w1 w2 w3",)], "text string")
    got = drawn(table, items)
    assert got == plain(rows, ["w1 w2 w3"]) and sorted(r[4] for r in got if r[4]) == [1, 2, 3, 4]


def test_matrices_of_equal_length_give_each_crc():
    import numpy as np

    rng = random.Random(5)
    buffer = np.frombuffer(rng.randbytes(5000), np.uint8)
    pieces = [(a, n) for n in (1, 2, 3, 40, 128, 129, 900) for a in (rng.randrange(0, 4000) for _ in range(9))]
    found = resampling.crcs(buffer, np.array([a for a, _ in pieces]), np.array([n for _, n in pieces]))
    assert found.tolist() == [zlib.crc32(buffer[a : a + n]) for a, n in pieces]


@pytest.mark.parametrize("seed", range(3))
def test_features_of_odd_texts(seed):
    rng = random.Random(seed)
    for _ in range(150):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice("ab A éZ9_日.\n\0{`") for _ in range(rng.randrange(60))) for _ in range(rng.randrange(6))]
        got = [[] for _ in texts]
        for found, of, _ in resampling.features(texts):
            for b, k in zip(found.tolist(), of.tolist()):
                got[k].append(b)
        assert got == [runs(t)[1] for t in texts]


def test_very_long_texts(spark):
    rows = [(1, "word " * 300_000), (2, "x" * 1_000_000 + " y"), (3, "Ab c" * 200_000)]
    assert drawn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("word",)], "text string")) == plain(rows, ["word"])


def test_place_takes_several_ranges(spark):
    from pyspark.sql import functions as F

    table = spark.range(5000).select("id", (F.col("id") * 7919 % 5000).alias("v"))
    assert resampling.placed(table, [F.col("v").desc()], "p").filter("p + v <> 5000").count() == 0
