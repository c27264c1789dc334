"""Personal data by anchor expansion (operator 10).

An Aho-Corasick automaton finds anchors: at-signs, schemes, plus signs, digits and identifier cues.  Around each anchor
a deterministic local parser expands to the whole email address, network address, card, telephone or account number and
validates it (octets, Luhn, mod 97, digit counts).  Expansion goes left to right and never into a match already made,
so that the base kinds come out as leftmost non-overlapping matches.

Base kinds are email, ip, card and phone.  Further kinds: iban (mod 97 holds), account and ssn (digits behind a cue),
login (user and password before the host of an address with a scheme).

Defined cases: null text counts as empty (no spans); spans of different kinds may overlap, spans of one kind never do;
repeated rows give repeated results; an empty table gives an empty result; other columns are kept by redact() and
ignored by find().
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, in_slices

#: Kinds in the order in which they are listed, and cues with the kind that they announce.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "account", "ssn", "login")
CUES = {"iban": "iban", "account": "account", "acct": "account", "konto": "account", "ssn": "ssn", "social security": "ssn"}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
CALL = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"[\s:#=.]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
ACCOUNT = re.compile(r"(?:[ _-]?(?:number|no\.?|nr\.?|id))?[\s:#=]{1,3}([0-9](?:[ -]?[0-9]){5,16})(?![0-9])", re.IGNORECASE)
SSN = re.compile(r"(?:[ _-]?(?:number|no\.?))?[\s:#=]{1,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])", re.IGNORECASE)
LOGIN = re.compile(r"://([^\s/@:]+:[^\s/@]+)@[A-Za-z0-9.-]+")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for anchor in ("@", "+", "://", *"0123456789"):
        found.add_word(anchor, (1, "digit" if anchor.isdigit() else anchor))
    for cue, kind in CUES.items():
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            found.add_word(form, (len(form), kind))
    found.make_automaton()
    return found


ANCHORS = _automaton()


def luhn(digits: str) -> bool:
    doubled = "0246813579"
    return sum(int(doubled[int(d)]) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def mod97(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's place in KINDS, start, end) of all personal data, by kind and start."""
    found: list[tuple[int, int, int]] = []
    #: where the next match of each kind may begin, failing matches included
    free = dict.fromkeys(KINDS, 0)
    run = -1
    for last, (size, kind) in ANCHORS.iter(text):
        if kind == "digit":
            if last < run:
                continue
            run = last + 1
            while run < len(text) and text[run] in DIGITS:
                run += 1
            if run < len(text) and last >= free["ip"] and text[run] == "." and (m := QUAD.match(text, last)):
                free["ip"] = m.end()
                if all(len(d := g.lstrip("0")) <= 3 and int(d or "0") <= 255 for g in m.groups()):
                    found.append((1, last, m.end()))
            elif last < free["ip"] < run and (m := QUAD.match(text, free["ip"])):
                free["ip"] = m.end()
            if last >= free["card"] and (m := CHAIN.match(text, last)):
                free["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append((2, last, m.end()))
        elif kind == "@":
            start = last
            while start > free["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < last and (m := DOMAIN.match(text, last + 1)):
                free["email"] = m.end()
                found.append((0, start, m.end()))
        elif kind == "+":
            if last >= free["phone"] and (m := CALL.match(text, last)):
                free["phone"] = m.end()
                if 8 <= sum(c in DIGITS for c in m[0]) <= 15:
                    found.append((3, last, m.end()))
        elif kind == "://":
            if m := LOGIN.match(text, last - 2):
                found.append((7, *m.span(1)))
        else:
            first, at = last - size + 1, KINDS.index(kind)
            if first and text[first - 1].isalnum():
                continue
            m = {"iban": IBAN, "account": ACCOUNT, "ssn": SSN}[kind].match(text, last + 1)
            if m and m.start(1) >= free[kind]:
                start, end = m.span(1)
                if kind == "iban":
                    #: the longest beginning that passes the check; its letters may run into the next word
                    ends = [e for e in range(end, start + 14, -1) if text[e - 1] != " " and mod97(text[start:e].replace(" ", ""))]
                    if not ends:
                        continue
                    end = ends[0]
                free[kind] = end
                found.append((at, start, end))
    return sorted(found)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in found)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts of the base kinds, base_sha256, spans and n_spans (of all kinds) of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            found = [spans(t) if t else [] for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(x[0] == k for x in f) for f in found], pa.int64()) for k in range(len(BASE))]
            base = [hashlib.sha256(joined([x for x in f if x[0] < len(BASE)]).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(base, pa.string()), pa.array(map(joined, found), pa.string()), pa.array(map(len, found), pa.int64())], names=[id_col, *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {', '.join(f'n_{k} long' for k in BASE)}, base_sha256 string, spans string, n_spans long")


def redacted(text: str) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    found = sorted((s, -e, k) for k, s, e in spans(text))
    out, at, k = [], 0, 0
    while k < len(found):
        start, end, kind = found[k][0], -found[k][1], found[k][2]
        k += 1
        while k < len(found) and found[k][0] < end:
            end = max(end, -found[k][1])
            k += 1
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join([*out, text[at:]])


@F.pandas_udf(T.StringType())
def _redact(texts):
    claim("personal data", dict)
    return texts.map(lambda t: redacted(t) if t else t, na_action="ignore")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data replaced, and n_chars (where there is one) counted anew."""
    out = docs.withColumn(text_col, _redact.asNondeterministic()(text_col))
    return out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op10_anchor_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
