"""Exact token counts at every prefix of a text (operator 3).

A byte-level BPE text falls into independent segments, each a run of white space with the visible run after it.
Within a segment a dynamic programme over prefixes finds, for each prefix, the one last token that is compatible
with the encoding of what stands before it; its count is that prefix's count plus one.  The counts are kept as
one signed byte per character (the change against the previous prefix), so that a running sum answers how many
tokens any prefix has and where a budget ends, with no second encoding.

Defined cases: null text counts as empty (no tokens, empty counts); a special string in a text is one token, as the
library has it by default; repeated rows give repeated results; an empty table gives an empty result; columns other
than the id and the text are ignored, so their names cannot clash.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, claim, in_slices, tokenizer_path

#: The pre-tokenizer's pattern and white space as it takes it, and the special string of the vocabulary.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
SPECIAL = "<|endoftext|>"
LONG_CONTRACTIONS = frozenset(("'re", "'ve", "'ll"))

CACHE_ENTRIES = 500_000
SCHEMA = "n_bytes long, n_tokens long, prefix_deltas binary"


class PrefixCounter:
    """Counts of tokens at every prefix for one byte-level BPE vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        code = self._alphabet()
        plain = {c: bytes([b]) for b, c in code.items()}
        raw = lambda s: b"".join(plain[c] for c in s)
        #: Tokens in the order in which merges make them, from 1 on; single bytes come first.
        order = sorted((i, raw(t)) for t, i in model["vocab"].items() if all(c in plain for c in t))
        self.number = {t: n for n, (_, t) in enumerate(order, 1)}
        #: An automaton over the tokens' bytes, filled in as it is used: its states are beginnings of tokens.
        self.beginnings = {t[:k] for t in self.number for k in range(len(t) + 1)}
        self.states, self.state_of, self.step, self.ending = [b""], {b"": 0}, {}, [()]
        self.halves = [(n, n) for n in range(len(order) + 1)]
        self.joined = {}
        for merge in model["merges"]:
            left, right = map(raw, merge.split(" ") if isinstance(merge, str) else merge)
            made = self.number[left + right]
            self.halves[made] = self.joined_key(left, right, made)
        self.fits = {}
        self.pretokens = regex.compile(PRETOKENS)
        self.segments = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+$")
        self.of_pretoken = Memo(self._pretoken, CACHE_ENTRIES)
        self.of_segment = Memo(self._segment, CACHE_ENTRIES // 8)
        self.spaces = re.compile(f"[{SPACE}]*+")
        self.mixed = re.compile(f"[{SPACE}][{SPACE}]|'")

    @staticmethod
    def _alphabet() -> dict[int, str]:
        """Byte to printable character: printable Latin-1 stands for itself, the rest follows from 256 on."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(shown)]
        return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def joined_key(self, left: bytes, right: bytes, made: int) -> tuple[int, int]:
        pair = self.number[left], self.number[right]
        self.joined[pair] = made
        return pair

    def _compatible(self, left: int, right: int) -> bool:
        """Whether two tokens side by side stay as they are: no merge across their border comes before those inside them.

        Undoes the later of the two tokens' merges step by step; a merge of what then meets at the border that is
        earlier than the merge just undone would have come first.
        """
        undone = len(self.halves)
        while True:
            if self.joined.get((left, right), undone) < undone:
                return False
            inner_left, inner_right = self.halves[left][1], self.halves[right][0]
            can_left, can_right = inner_left != left, inner_right != right
            if can_left and (left > right or not can_right):
                undone, left = left, inner_left
            elif can_right:
                undone, right = right + 1, inner_right
            else:
                return True

    def _fit(self, pair: int) -> bool:
        if len(self.fits) > 2 * CACHE_ENTRIES:
            self.fits.clear()
        known = self.fits[pair] = not pair >> 20 or self._compatible(pair >> 20, pair & (1 << 20) - 1)
        return known

    def _advance(self, state: int, byte: int) -> int:
        """The longest ending of what was read that begins a token; with it go the tokens that end there, longest first."""
        read = self.states[state] + bytes([byte])
        while read not in self.beginnings:
            read = read[1:]
        if read not in self.state_of:
            self.state_of[read] = len(self.states)
            self.states.append(read)
            self.ending.append(tuple((len(read) - k, self.number[read[k:]]) for k in range(len(read)) if read[k:] in self.number))
        found = self.step[state << 8 | byte] = self.state_of[read]
        return found

    def _pretoken(self, word: str) -> bytes:
        """Change of the count with each character of one pretoken: one compatible last token settles each prefix."""
        step, ending, fits = self.step, self.ending, self.fits
        count, last, state, now, changes = [0], [0], 0, 0, []
        for byte in word.encode():
            if (after := step.get(state << 8 | byte)) is None:
                after = self._advance(state, byte)
            state = after
            for size, token in ending[state]:
                pair = last[-size] << 20 | token
                if fits[pair] if pair in fits else self._fit(pair):
                    break
            before, now = now, count[-size] + 1
            count.append(now)
            last.append(token)
            if byte & 0xC0 != 0x80:
                changes.append(now - before & 255)
            else:  # a later byte of the same character
                changes[-1] = changes[-1] + now - before & 255
        return bytes(changes)

    def _segment(self, segment: str) -> bytes:
        """White space, then a visible run: a prefix that ends in the white space is one pretoken; beyond it the last white space stands apart."""
        head = self.spaces.match(segment).end()
        if head < 2:
            return self._visible(segment)
        space = self.of_pretoken[segment[:head]]
        if head == len(segment):
            return space
        rest = self._visible(segment[head - 1 :])
        first, second, last = array("b", rest[:2] + space[-1:])
        return space + array("b", [first + second - last]).tobytes() + rest[2:]

    def _visible(self, run: str) -> bytes:
        """Pretokens of a run with one white space before it at most; only contractions are cut otherwise in a prefix than in the whole."""
        out = []
        for word in self.pretokens.findall(run):
            changes = self.of_pretoken[word]
            if word in LONG_CONTRACTIONS:
                mark, letter = array("b", self.of_pretoken["'"])[0], array("b", self.of_pretoken[word[1]])[0]
                changes = array("b", [mark, letter, sum(array("b", changes)) - mark - letter]).tobytes()
            out.append(changes)
        return b"".join(out)

    def deltas(self, text: str) -> bytes:
        """One signed byte per character: tokens of text[:i+1] less tokens of text[:i]."""
        if SPECIAL not in text:
            if not self.mixed.search(text):
                return b"".join(map(self.of_pretoken.__getitem__, self.pretokens.findall(text)))
            return b"".join(map(self.of_segment.__getitem__, self.segments.findall(text)))
        out, parts = [], text.split(SPECIAL)
        for k, part in enumerate(parts):
            if k == len(parts) - 1:
                out.append(self.deltas(part))
                continue
            opened = self.deltas(part + SPECIAL[:-1])
            whole = sum(array("b", self.deltas(part)))
            out += [opened, array("b", [whole + 1 - sum(array("b", opened))]).tobytes()]
        return b"".join(out)


def prefix_counts(deltas: bytes) -> np.ndarray:
    """Tokens of every prefix, from the empty one on."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(deltas, np.int8), dtype=np.int64)])


def longest_prefix(deltas: bytes, budget: int) -> int:
    """Characters of the longest prefix with at most `budget` tokens."""
    return int(np.flatnonzero(prefix_counts(deltas) <= budget)[-1])


_counters: dict[str, PrefixCounter] = {}


def _counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """id, n_bytes, n_tokens and prefix_deltas (see prefix_counts) of every row; no shuffle."""
    path = tokenizer_path(tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        claim("token counts", _counters.clear)
        for batch in in_slices(batches):
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            deltas = [counter.deltas(t) for t in texts]
            tokens = [int(np.frombuffer(d, np.int8).sum(dtype=np.int64)) for d in deltas]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array(deltas, pa.binary())],
                names=[id_col, "n_bytes", "n_tokens", "prefix_deltas"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {kind}, {SCHEMA}")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether they are over 1024."""
    counted = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
