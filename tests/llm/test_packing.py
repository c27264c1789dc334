import zlib
from array import array
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wayfold.llm import packing


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check(rows, texts, library, capacity):
    want = Counter()
    for doc, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want[doc, piece, start, len(part), zlib.crc32(array("I", part).tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    placed = {}
    for r in rows:
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(placed), -(-sum(r.length for r in rows) // capacity)


def test_pieces_and_places(docs, library):
    rows = packing.pack(docs).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()], library, 4096)


def test_corpus_needs_hardly_more_than_the_least(corpus, library):
    used, least = check(packing.pack(corpus).collect(), [(r.doc_id, r.text) for r in corpus.collect()], library, 4096)
    assert used <= least + 1


def test_salted_ranks(corpus, library, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 2)
    check(packing.pack(corpus, capacity=64).collect(), [(r.doc_id, r.text) for r in corpus.collect()], library, 64)


def test_empty(empty):
    assert packing.pack(empty).count() == 0


def brute_fullest(counts, space):
    sums = {0}
    for length, n in counts.items():
        sums = {s + length * k for s in sums for k in range(n + 1) if s + length * k <= space}
    return max(sums)


@pytest.mark.parametrize("seed", range(30))
def test_fullest_is_exact(seed):
    import random

    draw = random.Random(seed)
    counts = {draw.randint(1, 40): draw.randint(1, 4) for _ in range(6)}
    space = draw.randint(1, 120)
    used = packing.fullest(counts, sorted(counts, reverse=True), space)
    assert all(n <= counts[x] for x, n in used.items()) and sum(x * n for x, n in used.items()) == brute_fullest(counts, space)
