"""Secret scans with a recursive decoding worklist (operator 4).

The text and every layer found in it are scanned for secrets.  A layer is what a part of a layer decodes to: URL
escapes, Unicode escapes, base64, and gzip, zlib or zstandard data inside base64.  New layers go on the worklist until
nothing new turns up; a layer that was seen before at the same span of the original is not entered again, so cycles
end (what a compressed layer holds has its span, all else gets shorter).  Each character of a layer knows the span of
the original text that it came from, so a secret found deep down is reported at every place where it stands.

Base64 may follow an equals sign, and may be wrapped: besides each run, runs of one width on lines of their own are
joined over the line breaks, with and without the run that ends the line before and the one that begins the line after.
Percent escapes that are no UTF-8 and half surrogate pairs stay as they stand, and what is around them is decoded.

Defined cases: null text counts as empty (no spans); base matches are leftmost non-overlapping per kind, and a match
that fails its length is consumed; a compressed layer of over `UNPACKED_MOST` bytes is reported as kind `bomb` for its
whole span and not entered; repeated rows give repeated results; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import base64
import binascii
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import in_slices

#: Kinds as listed, and their patterns and least lengths.
BASE = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Maximal runs, so a least length in the pattern drops the same matches.
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("passw", "secret", "token", "api")

UNPACKED_MOST = 64 << 20
#: A run begins where no character of its kind stands before it and is never given back, so a scan is linear in the text.
URL = re.compile(r"(?<![^\s%\"'<>])[^\s%\"'<>]*+(?:%[0-9A-Fa-f]{2}[^\s%\"'<>]*+)++")
ESCAPED = re.compile(r"(?<![^\s\\\"'<>])[^\s\\\"'<>]*+(?:\\(?:u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2})[^\s\\\"'<>]*+)++")
#: A surrogate pair is one character; half of one is none.
ESCAPE = re.compile(r"\\u([dD][89abAB][0-9A-Fa-f]{2})\\u([dD][c-fC-F][0-9A-Fa-f]{2})|\\(?:u((?![dD][89a-fA-F])[0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2}))")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ENCODED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Runs on lines that follow each other: all but the first begin their line, all but the last end it.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)+={0,2}")
RUN = re.compile(r"[A-Za-z0-9+/_-]+")
JOINED_LEAST = 16

Layer = tuple[str, list[int], list[int]]  # text, and for each character the span of the original


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in BASE, end) of the base matches of one layer."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _pieces(text: str, pattern: re.Pattern, decode) -> tuple[str, list[int], list[int]] | None:
    """text with the pattern's matches decoded, and the span in text of each character; None where nothing does."""
    out, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(text):
        out.append(text[at : m.start()])
        starts += range(at, m.start())
        ends += range(at + 1, m.start() + 1)
        for ch, start, end in decode(m):
            out.append(ch)
            starts.append(start)
            ends.append(end)
        at = m.end()
    out.append(text[at:])
    if (decoded := "".join(out)) == text:
        return None
    return decoded, starts + list(range(at, len(text))), ends + list(range(at + 1, len(text) + 1))


def _percent(m: re.Match) -> list[tuple[str, int, int]]:
    at, out = m.start(), []
    for ch in bytes.fromhex(m[0].replace("%", "")).decode(errors="surrogateescape"):
        if "\udc80" <= ch <= "\udcff":  # a byte that is no UTF-8
            out += [(m.string[k], k, k + 1) for k in range(at, at + 3)]
            at += 3
        else:
            size = 3 * len(ch.encode())
            out.append((ch, at, at + size))
            at += size
    return out


def _escape(m: re.Match) -> list[tuple[str, int, int]]:
    code = int(m[3] or m[4], 16) if m[1] is None else 0x10000 + (int(m[1], 16) - 0xD800 << 10) + int(m[2], 16) - 0xDC00
    return [(chr(code), m.start(), m.end())]


def unpacked(data: bytes) -> bytes | None:
    """What compressed bytes hold; None if they are not compressed; OverflowError beyond UNPACKED_MOST."""
    try:
        if data[:2] == b"\x1f\x8b":
            out = gzip.GzipFile(fileobj=io.BytesIO(data)).read(UNPACKED_MOST + 1)
        elif data[:4] == b"\x28\xb5\x2f\xfd":
            out = zstandard.ZstdDecompressor().stream_reader(data).read(UNPACKED_MOST + 1)
        elif len(data) > 6 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0:
            out = zlib.decompressobj().decompress(data, UNPACKED_MOST + 1)
        else:
            return None
    except (OSError, EOFError, zlib.error, zstandard.ZstdError):
        return None
    if len(out) > UNPACKED_MOST:
        raise OverflowError
    return out


def _readable(data: bytes) -> str | None:
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text if text and sum(c.isprintable() or c in "\t\r\n" for c in text) >= 0.95 * len(text) else None


def layers(text: str) -> Iterator[tuple[str, int, int, Layer | None]]:
    """(how, start, end, layer) of each part of text that decodes; the layer's spans are places in text."""
    if "%" in text:
        for m in URL.finditer(text):
            if made := _pieces(m[0], PERCENT, _percent):
                yield "url", m.start(), m.end(), (made[0], [x + m.start() for x in made[1]], [x + m.start() for x in made[2]])
    if "\\u" in text or "\\x" in text:
        for m in ESCAPED.finditer(text):
            if made := _pieces(m[0], ESCAPE, _escape):
                yield "unicode", m.start(), m.end(), (made[0], [x + m.start() for x in made[1]], [x + m.start() for x in made[2]])
    for m in ENCODED.finditer(text):
        if found := _encoded(m[0].rstrip("="), range(m.start(), m.end()), m.end()):
            yield found
    if "\n" in text:
        for m in WRAPPED.finditer(text):
            runs = [r.span() for r in RUN.finditer(text, m.start(), m.end())]
            for first, last in _joins([b - a for a, b in runs]):
                if sum(b - a for a, b in runs[first:last]) >= JOINED_LEAST:
                    where = [k for a, b in runs[first:last] for k in range(a, b)]
                    end = m.end() if last == len(runs) else runs[last - 1][1]
                    if found := _encoded("".join(text[a:b] for a, b in runs[first:last]), where, end):
                        yield found


def _joins(widths: list[int]) -> Iterator[tuple[int, int]]:
    """Which runs (first, exclusive last) of lines that follow each other may be one: of one width, but that the first and the last may be cut."""
    first = 0
    while first < len(widths):
        last = first + 1
        while last < len(widths) and widths[last] == widths[first]:
            last += 1
        ends = [last, last + 1] if last < len(widths) and widths[last] < widths[first] else [last]
        for a in {first, max(0, first - 1)}:
            yield from ((a, b) for b in ends if b - a > 1)
        first = last


def _encoded(run: str, where: Sequence[int], end: int) -> tuple[str, int, int, Layer | None] | None:
    """(how, start, end, layer) of base64 whose characters stand at the places `where`, if it decodes."""
    start, body = where[0], run.translate({45: 43, 95: 47})
    if len(body) % 4 == 1:
        return None
    try:
        data = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
        inner = unpacked(data)
    except binascii.Error:
        return None
    except OverflowError:
        return "bomb", start, end, None
    packed = inner is not None
    if (decoded := _readable(inner if packed else data)) is None:
        return None
    if packed:
        return "compressed", start, end, (decoded, [start] * len(decoded), [end] * len(decoded))
    starts, ends, at = [], [], 0
    for ch in decoded:  # four letters hold three bytes
        size = len(ch.encode())
        starts.append(where[at * 4 // 3])
        ends.append(where[min(len(body), -(-(at + size) * 4 // 3)) - 1] + 1)
        at += size
    return "base64", start, end, (decoded, starts, ends)


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, str]]]:
    """Base matches of the text, and all matches as (start, kind's place, end, name) with those of every layer."""
    base = scan(text)
    found = {(s, k, e, BASE[k]) for s, k, e in base}
    seen, scanned, work = {(text, 0, len(text))}, {text: base}, [("", text, None, None)]
    while work:
        path, layer, starts, ends = work.pop()
        for how, start, end, inner in layers(layer):
            name = f"{path}{how}"
            if inner is None:
                found.add((start if starts is None else starts[start], len(BASE), end if ends is None else ends[end - 1], name))
                continue
            decoded, inner_starts, inner_ends = inner
            first, last = inner_starts[0], inner_ends[-1]
            place = (decoded, first, last) if starts is None else (decoded, starts[first], ends[last - 1])
            if place in seen:
                continue
            seen.add(place)
            if starts is not None:
                inner_starts, inner_ends = [starts[x] for x in inner_starts], [ends[x - 1] for x in inner_ends]
            if decoded not in scanned:
                scanned[decoded] = scan(decoded)
            for s, k, e in scanned[decoded]:
                found.add((inner_starts[s], k, inner_ends[e - 1], f"{name}/{BASE[k]}"))
            work.append((f"{name}/", decoded, inner_starts, inner_ends))
    return base, sorted(found)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts of the base kinds, base_sha256 and spans of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                base, every = spans(text or "")
                kinds = [k for _, k, _ in base]
                listed = ",".join(f"{BASE[k]}:{s}:{e}" for s, k, e in base)
                rows.append((*map(kinds.count, range(3)), hashlib.sha256(listed.encode()).hexdigest(), ",".join(f"{n}:{s}:{e}" for s, _, e, n in every)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets in every document, and in what its parts decode to."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
