import itertools
import random

import numpy as np
import pytest

from wayfold.llm import omh


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(60))
def test_banded_distance(seed):
    draw = random.Random(seed)
    for _ in range(20):
        a = [draw.randint(0, draw.choice([2, 5, 50])) for _ in range(draw.randint(0, 30))]
        b = list(a)
        for _ in range(draw.randint(0, 8)):
            at = draw.randint(0, len(b))
            b[at : at + draw.randint(0, 1)] = [draw.randint(0, 5)] * draw.randint(0, 1)
        d = distance(a, b)
        assert all(omh.banded_distance(a, b, k) == min(d, k + 1) for k in (0, 1, 2, 4, 7, 12, 40))


def classes(rows, similar):
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations(rows, 2):
        if similar(x, y) and (p := find(a)) != (q := find(b)):
            root[max(p, q)] = min(p, q)
    return {d: find(d) for d, _ in rows}


def edited(draw, words, share, kinds="replace"):
    """A copy with so many scattered edits of one word."""
    out = list(words)
    if kinds == "replace":
        for at in draw.sample(range(len(out)), int(share * len(out) + 1e-9)):
            out[at] = draw.randrange(1 << 40)
        return out
    for _ in range(int(share * len(words) + 1e-9)):
        at = draw.randrange(len(out))
        kind = draw.choice(("replace", "insert", "delete"))
        out[at : at + (kind != "insert")] = [] if kind == "delete" else [draw.randrange(1 << 40)]
    return out


@pytest.mark.parametrize("kinds", ["replace", "all"])
@pytest.mark.parametrize("size", [5, 9, 13, 20, 45, 80, 300, 700, 1900, 4000])
def test_recall_at_scattered_edits(size, kinds):
    """Of pairs at an edit similarity of 0.8 or more, those with a key in common: over all rates of edits, and at the highest."""
    draw = random.Random(size)
    for shares, least in (((0.02, 0.06, 0.1, 0.14, 0.18, 0.2), 0.95), ((0.2,), 0.9)):
        met = total = 0
        for k in range(120 if size < 1000 else 60):
            a = [draw.randrange(1 << 40) for _ in range(size)]
            b = edited(draw, a, shares[k % len(shares)], kinds)
            longer = max(len(a), len(b))
            if omh.banded_distance(a, b, longer) <= 0.2 * longer + 1e-9:
                total += 1
                met += bool(set(omh.sketch(np.array(a, np.uint64)).tolist()) & set(omh.sketch(np.array(b, np.uint64)).tolist()))
        assert total > 8 and met >= least * total, (met, total)


@pytest.mark.parametrize("size", range(1, omh.TINY + 1))
def test_tiny_pairs_always_meet(size):
    draw = random.Random(size)
    for _ in range(300):
        a = [draw.randrange(4) for _ in range(size)]
        b = edited(draw, a, draw.choice((0.1, 0.2)), "all")
        if b and omh.banded_distance(a, b, int(0.2 * max(len(a), len(b)) + 1e-9)) <= int(0.2 * max(len(a), len(b)) + 1e-9):
            assert set(omh.sketch(np.array(a, np.uint64)).tolist()) & set(omh.sketch(np.array(b, np.uint64)).tolist())


def test_classes_against_all_pairs(spark):
    """Groups of copies with up to a fifth of their words edited, and texts that share a passage, or long runs of two words, and nothing else."""
    draw = random.Random(5)
    rows = []
    add = lambda words: rows.append((len(rows), " ".join(f"w{w}" for w in words)))
    new = lambda n: [draw.randrange(1 << 40) for _ in range(n)]
    for size in (7, 12, 30, 150, 600):
        for _ in range(4):
            base = new(size)
            add(base)
            for share in (0.0, 0.03, 0.08, 0.12, 0.16, 0.2):
                add(edited(draw, base, share, draw.choice(("replace", "all"))))
    passage = new(60)
    for _ in range(40):
        add(new(80) + passage)
    for _ in range(40):
        add(new(draw.randint(20, 60)) + [1, 2] * draw.randint(50, 90))
    got = {r.doc_id: r.class_id for r in omh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = classes(rows, lambda a, b: omh.similarity(a, b) >= 0.8)
    assert all(want[d] == want[c] for d, c in got.items())  # nothing is joined that is not
    linked = [d for d in want if want[d] != d]
    assert sum(got[d] == got[want[d]] for d in linked) >= 0.95 * len(linked) > 100


def test_hot_groups_are_not_expanded(spark, tmp_path):
    """Pairs that go to verification, for a group of near copies and for texts with one passage in common, grow as their rows."""
    draw = random.Random(9)
    new = lambda n: [draw.randrange(1 << 40) for _ in range(n)]
    base, passage, taken = new(120), new(50), []
    for size in (100, 300):
        rows = [(k, edited(draw, base, 0.05)) for k in range(size)] + [(size + k, new(80) + passage) for k in range(size)]
        frame = spark.createDataFrame([(k, " ".join(map(str, w))) for k, w in rows], "doc_id long, text string")
        pairs = []
        real = omh.verified
        try:
            omh.verified = lambda p, texts, name: (pairs.append(p.count()), real(p, texts, name))[1]
            assert len({r.class_id for r in omh.near_duplicates(frame).collect()}) == size + 1
        finally:
            omh.verified = real
        taken.append(sum(pairs))
    assert taken[1] <= 5 * taken[0] and taken[1] < 300 * 40


def taken_pairs(frame):
    """Classes of a table, and how many pairs went to alignment."""
    pairs, real = [], omh.verified
    try:
        omh.verified = lambda p, texts, name: (pairs.append(p.count()), real(p, texts, name))[1]
        return {r.doc_id: r.class_id for r in omh.near_duplicates(frame).collect()}, sum(pairs)
    finally:
        omh.verified = real


def test_texts_of_one_form_are_not_compared_with_each_other(spark):
    """Texts that share 145 of 200 words at fixed places are not similar, whatever their number; planted copies among them are found."""
    draw = random.Random(4)
    form, own = [draw.randrange(1 << 40) for _ in range(200)], sorted(draw.sample(range(200), 55))
    counts = []
    for size in (100, 200, 400):
        rows = []
        for k in range(size):
            words = list(form)
            for at in own:
                words[at] = draw.randrange(1 << 40)
            rows.append((k, words))
        rows += [(size + k, edited(draw, rows[7 * k][1], 0.1)) for k in range(10)]
        got, pairs = taken_pairs(spark.createDataFrame([(k, " ".join(map(str, w))) for k, w in rows], "doc_id long, text string"))
        assert all(got[k] == k for k in range(size)) and sum(got[size + k] == 7 * k for k in range(10)) >= 9
        counts.append(pairs)
    assert counts[2] <= 5 * counts[0] and counts[2] < 30 * 400, counts


def test_rare_words_lose_no_pair(spark, monkeypatch):
    """Every key counts as crowded: the classes stay."""
    draw = random.Random(11)
    rows = []
    for size in (6, 20, 60, 200):
        for _ in range(6):
            base = [draw.randrange(60) for _ in range(size)]
            rows += [edited(draw, base, share, "all") for share in (0, 0.05, 0.12, 0.19)]
    frame = spark.createDataFrame([(k, " ".join(f"w{x}" for x in w)) for k, w in enumerate(rows)], "doc_id long, text string")
    want, _ = taken_pairs(frame)
    monkeypatch.setattr(omh, "CROWDED", 0)
    assert taken_pairs(frame)[0] == want and len(set(want.values())) < len(want)


def test_ids_do_not_decide_what_a_text_is(spark):
    a, b = "one two three four five six seven", "red green blue white black brown grey"
    rows = [(1, a, "x"), (1, b, "y"), (2, b, "z"), (None, a, "n"), (None, None, "m"), (3, None, "o"), (2, b, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = sorted((tuple(r) for r in omh.near_duplicates(frame).collect()), key=str)
    assert got == sorted([(1, 1, 1, 0), (1, 1, 1, 0), (2, 1, 1, 0), (2, 1, 1, 0), (None, None, None, 0), (None, None, None, 0), (3, 3, 3, 0)], key=str)
    kept = sorted((tuple(r) for r in omh.deduplicated(frame).collect()), key=str)
    assert kept == sorted([(1, a, "x"), (1, b, "y"), (None, a, "n"), (None, None, "m"), (3, None, "o")], key=str)


def test_odd_rows(docs, empty):
    got = {r.doc_id: r for r in omh.near_duplicates(docs).collect()}
    assert got[5].class_id == 4 and got[5].text_id == 4 and all(got[k].class_id == k for k in (0, 1, 2, 3, 6))
    kept = omh.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 9]
    assert omh.near_duplicates(empty).count() == 0


def test_copies_just_over_the_limit_are_told_apart_by_their_words(spark):
    """Copies of a form with own edits: of a key's pairs those that are similar all stay, most others do not go to alignment."""
    draw = random.Random(21)
    form = [draw.randrange(60) for _ in range(200)]
    rows = [edited(draw, form, 0.13) for _ in range(40)] + [edited(draw, form, 0.04, "all") for _ in range(10)]
    texts = spark.createDataFrame([(k, " ".join(map(str, x))) for k, x in enumerate(rows)], "node long, text string")
    members = spark.createDataFrame([(1, k, len(x), k, True) for k, x in enumerate(rows)], "key long, node long, words int, root long, open boolean")
    every = {tuple(r) for r in omh.across(members, "key").collect()}
    left = {tuple(r) for r in omh.across(members.join(omh.bags(members, texts), "node"), "key").collect()}
    similar = {(a, b) for a, b in every if omh.similarity(*(" ".join(map(str, rows[k])) for k in (a, b)))}
    assert len(every) == 50 * 49 / 2 and similar <= left <= every and len(similar) > 40 and len(left) < len(every) / 2
