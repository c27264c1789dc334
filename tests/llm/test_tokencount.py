import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wayfold.llm import tokencount as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return T.PrefixCounter(PATH)


ODD = ["", "a  b", "we're  'r 're", "\n\n\n x", "a \t b'll I'lx", "x!<|endoftext|>y <|endoftext|> <|endof", "日本語テキスト 🎉🎉  é", "-" * 90, "\x1c\x1d a\x1cb \x85 \xa0b", "12345 3a4 _ _a ", "İ ſ ǆ"]


@pytest.mark.parametrize("seed", range(len(ODD) + 150))
def test_every_prefix(counter, library, seed):
    draw = random.Random(seed)
    text = ODD[seed] if seed < len(ODD) else "".join(draw.choice("ab 'st\n\tré1<|>.,-") for _ in range(draw.randint(1, 30)))
    want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    assert T.prefix_counts(counter.deltas(text)).tolist() == want


def test_long_pretokens(counter, library):
    text = "a" * 3000 + "é" * 500 + " " * 700 + "x"
    assert T.prefix_counts(counter.deltas(text))[-1] == len(library.encode(text, add_special_tokens=False).ids)


def test_budget(counter, library):
    deltas = counter.deltas("The quick brown fox jumps over the lazy dog.")
    best = T.longest_prefix(deltas, 5)
    assert T.prefix_counts(deltas)[best] <= 5 and (T.prefix_counts(deltas)[best + 1 :] > 5).all()


def test_table(docs, corpus, empty, library):
    for df in (docs, corpus):
        rows = df.select("doc_id", "text").collect()
        want = {r.doc_id: (len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in rows}
        got = T.count_tokens(df).collect()
        assert len(got) == len(rows) and {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want
    assert T.count_tokens(empty).count() == 0
