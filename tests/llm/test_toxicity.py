import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.llm import toxicity


@pytest.mark.parametrize("size", [1, 2, 3, 7, 10])
def test_chain_against_all_paths(size):
    rng = np.random.default_rng(size)
    begins = rng.random(size) < 0.3
    begins[0] = True
    lead, move, start = rng.normal(size=size) * 2, rng.normal(size=(2, 2)), rng.normal(size=2)
    total, marginal, moves = 0.0, np.zeros(size), np.zeros((2, 2))
    for path in itertools.product((0, 1), repeat=size):
        weight = math.exp(sum(lead[t] * path[t] + (start[path[t]] if begins[t] else move[path[t - 1], path[t]]) for t in range(size)))
        total, marginal = total + weight, marginal + weight * np.array(path)
        for t in range(size):
            if not begins[t]:
                moves[path[t - 1], path[t]] += weight
    got, log, pairs = toxicity.Chain(begins).run(lead, move, start)
    assert np.allclose(got, marginal / total) and np.isclose(log, math.log(total)) and np.allclose(pairs, moves / total)


def test_gradient_against_differences():
    rng = np.random.default_rng(0)
    words = toxicity.Words.of_words(["idiot", "the", "cat"])
    at, begins, toxic = np.array([0, 1, 2, 1, 0, 0]), np.array([1, 0, 0, 1, 0, 0], bool), np.array([1, 0, 0, 0, 1, 1])
    flat = rng.normal(size=toxicity.SIZE) * 0.1
    slope = toxicity.gradient(words, at, begins, toxic, toxicity.Weights(flat))[1]
    for k in [*range(toxicity.FEATURES, toxicity.SIZE), *words.own[:4], *words.ahead, *words.back]:
        d = np.zeros(toxicity.SIZE)
        d[k] = 1e-5
        up, down = (toxicity.gradient(words, at, begins, toxic, toxicity.Weights(flat + e))[0] for e in (d, -d))
        assert abs((up - down) / 2e-5 - slope[k]) < 1e-6


def test_minimum_of_a_quadratic():
    a = np.diag(np.arange(1.0, 21.0))
    found = toxicity.lbfgs(lambda x: (float((x - 1) @ a @ (x - 1)), 2 * a @ (x - 1)), np.zeros(20), 100)
    assert np.abs(found - 1).max() < 1e-2


@pytest.fixture(scope="module")
def made(spark):
    """Two thousand documents, a sixth of them toxic, one label in fifty wrong, and forty copies of one toxic document without a cue."""
    rng = random.Random(1)
    plain, bad = [f"{a}{b}{c}" for a in ("ka", "lo", "mi") for b in ("ra", "te", "su") for c in ("n", "sh", "la", "")], ["zounderkite", "muckspout", "dalcop"]
    rows = []
    for k in range(2000):
        words, toxic = [rng.choice(plain) for _ in range(rng.randrange(5, 60))], k % 6 == 0
        for _ in range(rng.randrange(1, 4) * toxic):
            words.insert(rng.randrange(len(words) + 1), rng.choice(bad))
        rows.append((k, " ".join(words), int(toxic != (rng.random() < 0.02)), int(toxic)))
    rows += [(2000 + k, "onlyhere in copies of this passage", 1, 0) for k in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int, truth int")


def test_held_out_documents_and_spans(spark, made):
    model = toxicity.fit(made.filter(~toxicity.held_out()).select("doc_id", "text"), made.filter(~toxicity.held_out()))
    rows = made.join(toxicity.score(made, model), "doc_id").filter(toxicity.held_out() & (F.col("doc_id") < 2000)).collect()
    assert len(rows) > 500 and all(r.predicted == r.truth == (r.score >= 0.7) for r in rows)
    bad = {"zounderkite", "muckspout", "dalcop"}
    for r in rows:
        assert r.spans == ",".join(_runs(r.text, bad))
    shouted = spark.createDataFrame([(1, "oh ZounderKite!"), (2, "oh kara!"), (3, "é\U0001f600 muckspouts dalcop, kara"), (4, "onlyhere kara")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(shouted, model).collect()}
    assert [got[k].predicted for k in (1, 2, 3, 4)] == [1, 0, 1, 0] and got[1].spans == "3:14" and got[3].spans == "3:20"


def _runs(text: str, bad: set[str]) -> list[str]:
    """start:end of the runs of bad words of a text of words with single spaces."""
    out, at, last = [], 0, False
    for word in text.split(" "):
        if word in bad:
            out = [*out[:-1], f"{out[-1].split(':')[0]}:{at + len(word)}"] if last else [*out, f"{at}:{at + len(word)}"]
        last = word in bad
        at += len(word) + 1
    return out


def test_op12_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = toxicity.op12_crf_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out and toxic is not null").collect()
    hits = sum(r.predicted == r.toxic == 1 for r in rows)
    assert sum(r.predicted == r.toxic for r in rows) >= 0.95 * len(rows)
    assert hits >= 0.7 * sum(r.toxic == 1 for r in rows) and hits >= 0.9 * sum(r.predicted == 1 for r in rows)


def test_batches_do_not_matter(spark, made):
    """Texts scored together and one by one."""
    model = toxicity.fit(made, made)
    texts = [r.text for r in made.limit(60).collect()] + [None, "", "12 !", "dalcop", "x" * 100]
    together, spans = model.scores(texts)
    single = [model.scores([t]) for t in texts]
    assert np.allclose(together, [s[0] for s, _ in single]) and spans == [x[0] for _, x in single]


def test_odd_rows(spark, docs, empty, made):
    model = toxicity.fit(made, made)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == 10 and got[0].score == got[1].score == got[2].score == got[9].score and all(0 <= r.score <= 1 and r.predicted == 0 for r in got.values())
    assert toxicity.score(empty, model).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int, text string")
    for labels in (none, made.filter("toxic = 0"), spark.createDataFrame([(None, 1, "a"), (3, None, "b"), (99_999, 1, "c")], none.schema)):
        one = toxicity.fit(docs if labels is not none else empty, labels)
        assert len({r.score for r in toxicity.score(docs, one).collect()}) == 1
    several = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (5, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    sample = {r.text: r.toxic for r in toxicity.labelled_sample(docs, several, "doc_id", "text", "toxic").collect()}
    assert sample == {"one": 1, "The cat sat on the mat. " * 3: 0}


def test_very_long_texts(spark, made):
    model = toxicity.fit(made, made)
    rows = [(1, "kara " * 200_000 + "dalcop"), (2, "x" * 1_000_000), (3, "kara " * 200_000)]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1].spans == "1000000:1000006" and not got[2].spans and not got[3].spans and got[1].score > got[3].score
