"""One text of a megabyte that meets the slow paths: each scan is linear in it, and right."""

import random
import time
import urllib.parse

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wayfold.llm import htmltree, langid, pii, secrets, tokencount

SIZE, SECONDS = 1_000_000, 20


@pytest.fixture(autouse=True)
def quick():
    began = time.process_time()
    yield
    assert time.process_time() - began < SECONDS


@pytest.mark.parametrize("text", ["0" * SIZE + "1.2.3.4", "1.2.3." + "9" * SIZE, "+1" + "0" * SIZE, "a" * SIZE + "@b.cd", "@" * SIZE, "1.2.3.4." * (SIZE // 8), "1 " * (SIZE // 2), "+1 (" * (SIZE // 4), "://a:" * (SIZE // 5)])
def test_personal_data(text):
    assert all(text[s:e] for _, s, e in pii.spans(text))


def test_leading_zeros_are_an_address():
    assert pii.spans("0" * 5000 + "1.002.3.0255") == [(1, 0, 5012)]


@pytest.mark.parametrize("text", ["a" * SIZE + "%", "%" * SIZE, "a" * SIZE + "\\u12", "%4" * (SIZE // 2), "x%41" + "a" * SIZE, "A" * SIZE + "=", "token " * (SIZE // 6), "f" * SIZE, "AKIA" * (SIZE // 4)])
def test_secrets(text):
    base, _ = secrets.spans(text)
    assert base == secrets.scan(text)


def test_escapes_behind_a_long_run():
    text = "a" * SIZE + " " + urllib.parse.quote("password=hunter22x")
    assert any(name == "url/assign" for *_, name in secrets.spans(text)[1])


@pytest.fixture(scope="module")
def counter():
    return tokencount.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("text", ["\n" * 200_000, " " * 200_000 + "x", ("\t" * 50_000 + "a'll") * 3, "'" * 100_000, "a'" * 100_000, "don't " * 50_000, "x" * 100_000 + "'re  y"])
def test_token_counts(counter, library, text):
    deltas = counter.deltas(text)
    assert len(deltas) == len(text) and tokencount.prefix_counts(deltas)[-1] == len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("seed", range(40))
def test_white_space_runs_at_every_prefix(counter, library, seed):
    draw = random.Random(seed)
    text = "".join(draw.choice([" ", "\n", "\t\t", "   ", "'ll", "'re", "'s", "ab", "'", "é", "1"]) for _ in range(draw.randint(1, 14)))
    assert tokencount.prefix_counts(counter.deltas(text)).tolist() == [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "</p>" * 100_000, '<a "' * 200_000, "<!" * 400_000, "<div>" * 100_000 + "<td>" * 100_000, '<a ">"' * 100_001, "<" * SIZE, "<p>x" * 200_000, "<b" * 300_000, "x" * SIZE])
def test_pages(page):
    nodes = htmltree.parse(page)
    assert all(parent < k for k, (parent, *_) in enumerate(nodes))


def test_long_words():
    model = langid.Model([("1a", ["en", "fr"], [4, 1])])
    assert model.predict("a" * SIZE)[0] == "en"
