import base64
import gzip
import hashlib
import re
import urllib.parse

import pytest

from wayfold.llm import secrets as S


def brute(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24])


@pytest.mark.parametrize("text", ["token: token: abcdefgh", 'API_KEY="abc.def-12" api-key=zzzzzzz', "passwd=short", "AKIA1 AKIAAKIA" + "B" * 14, "f" * 23 + " " + "0a" * 12, "PassWord = 'aaaaaa'", "secretſtoken:abcdefg"])
def test_base(text):
    assert S.scan(text) == brute(text)


b64 = lambda b: base64.b64encode(b).decode()


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("see " + urllib.parse.quote("password=hunter22x") + " ok", "url/assign"),
        ("k " + b64(b"my token: abcdefgh12") + " .", "base64/assign"),
        ("z " + b64(gzip.compress(b"secret = " + b64(b"password=letmein99").encode())), "compressed/base64/assign"),
        ("\\u0070assword=abcdef1", "unicode/assign"),
        ("p%2561ssword%3Dabcdef99", "url/url/assign"),
    ],
)
def test_layers(text, name):
    base, every = S.spans(text)
    hit = [(s, e) for s, _, e, n in every if n == name]
    assert base == [] and len(hit) == 1 and 0 <= hit[0][0] < hit[0][1] <= len(text)


@pytest.mark.parametrize("part", [b64(b"my token: abcdefgh12"), urllib.parse.quote("password=hunter22x"), b64(gzip.compress(b"token: abcdefgh12 " + b64(b"password=letmein99").encode()))])
def test_repeated_layers_are_reported_at_every_place(part):
    alone = S.spans(part)[1]
    twice = S.spans(f"{part} then {part}")[1]
    assert alone and twice == sorted(alone + [(s + len(part) + 6, k, e + len(part) + 6, n) for s, k, e, n in alone])


NOISE = "".join(hashlib.sha256(bytes([k])).hexdigest() for k in range(12))


def wrapped(data, width=76, end="\n"):
    return end.join(re.findall(f".{{1,{width}}}", b64(data)))


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("data=" + b64(b"my token: abcdefgh12") + " .", "base64/assign"),
        ("?payload=" + b64(b"my token: abcdefgh12") + "&x", "base64/assign"),
        ("long_parameter_name=" + b64(b"my token: abcdefgh1") + "=", "base64/assign"),
        ("u token%3D" + b64(gzip.compress(b"x password=letmein99")) + " .", "url/compressed/assign"),
        ("?name=caf%E9&password%3Dhunter22", "url/assign"),
        ("%E9%20password%3Dhunter22", "url/assign"),
        ("\\ud83d\\ude00\\u0070assword=abcdef1", "unicode/assign"),
        ("\\ud83d\\u0070assword=abcdef1", "unicode/assign"),
        ("cfg:\n" + wrapped(b"a" * 52 + b" token: abcdefgh12 " + b"z" * 70) + "\nend", "base64/assign"),
        ("cfg=" + wrapped(b"a" * 50 + b" token: abcdefgh12 " + b"z" * 72, end="\r\n"), "base64/assign"),
        ("-----BEGIN CERTIFICATE-----\n" + wrapped(b"a" * 43 + b" token: abcdefgh12 " + b"z" * 34, 64) + "\n-----END", "base64/assign"),
        ("k: |\n  " + wrapped(gzip.compress(f"{NOISE} token: abcdefgh12".encode()), 76, "\n  ") + "\n", "compressed/assign"),
    ],
)
def test_layers_that_were_skipped(text, name):
    value = "letmein99" if "compressed" in name and "url" in name else "abcdefgh12"
    hit = [(s, e) for s, _, e, n in S.spans(text)[1] if n == name]
    assert hit and all(0 <= s < e <= len(text) for s, e in hit)
    if name == "base64/assign" and "\n" in text:  # the whole of the secret's letters, over the line's end
        s, e = max(hit, key=lambda x: x[1] - x[0])
        assert "\n" in text[s:e] and (e - s) * 3 / 4 >= len(f"token: {value}")


def test_escapes_that_stand_are_no_layer():
    assert S.spans("a caf%E9 password=hunter22 \\ud83d password=hunter22")[1] == [(9, 0, 26, "assign"), (34, 0, 51, "assign")]


def test_cycles_and_bombs_end(monkeypatch):
    monkeypatch.setattr(S, "UNPACKED_MOST", 1000)
    assert [n for *_, n in S.spans("x " + b64(gzip.compress(bytes(5000))) + " y")[1]] == ["bomb"]
    assert S.spans("%25" * 50 + "41") is not None


def test_tables(docs, corpus, empty):
    for df in (docs, corpus):
        got = {r.doc_id: r for r in S.find(df).collect()}
        for r in df.select("doc_id", "text").collect():
            want = brute(r.text or "")
            assert got[r.doc_id].base_sha256 == hashlib.sha256(",".join(f"{S.BASE[k]}:{s}:{e}" for s, k, e in want).encode()).hexdigest()
    assert S.find(empty).count() == 0
