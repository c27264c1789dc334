import hashlib
import random
import re

import pytest

from wayfold.llm import pii

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute(text):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m[0])
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 16 <= len(digits) <= 19 and pii.luhn(digits) or k == 3 and 8 <= len(digits) <= 15:
                out.append((k, m.start(), m.end()))
    return sorted(out)


def base(text):
    return [x for x in pii.spans(text) if x[0] < 4]


@pytest.mark.parametrize("seed", range(20))
def test_base_equals_patterns(seed):
    draw = random.Random(seed)
    for _ in range(300):
        text = "".join(draw.choice("0123456789..-+@ab.c 5555()%") for _ in range(draw.randint(3, 45)))
        assert base(text) == brute(text)


def test_added_kinds_and_redaction():
    text = "IBAN: GB82 WEST 1234 5698 7654 32, ssn 078-05-1120, account no. 12345678, https://me:pw@host.example/x"
    assert {pii.KINDS[k] for k, _, _ in pii.spans(text)} >= {"iban", "ssn", "account", "login"}
    assert pii.redacted("write to a.b@c.org or +1 (555) 010-9999 now") == "write to [EMAIL] or [PHONE] now"


def test_tables(docs, corpus, empty):
    for df in (docs, corpus):
        got = {r.doc_id: r for r in pii.find(df).collect()}
        for r in df.select("doc_id", "text").collect():
            want = brute(r.text or "")
            assert got[r.doc_id].base_sha256 == hashlib.sha256(pii.joined(want).encode()).hexdigest()
            assert [got[r.doc_id][f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in want) for k in range(4)]
    assert pii.find(empty).count() == 0
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert all(not base(r.text or "") for r in pii.redact(corpus).collect())
