"""Best-fit packing by minimum bin slack (operator 1).

Documents become token pieces of at most `capacity` tokens.  Which pieces share a sequence depends only on how many
pieces there are of each length, and that histogram has at most `capacity` rows however large the corpus is.  The
driver works on the histogram alone: for the longest length left, a bitset subset-sum programme over the lengths that
remain finds the fullest feasible combination, which is removed as often as the counts allow.  Spark then ranks the
pieces of each length, in salted groups, and each piece finds its sequence and its place from its rank.

Defined cases: null text counts as empty (one piece that holds the end id alone); an empty table gives an empty result;
repeated rows are packed each for itself; ties in length are broken by row number; other columns are ignored.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, in_slices, materialize, tokenizer_path

#: How the tokenizer splits normalised text, and the id that ends a document.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END_ID = 1
WORD_END = "</w>"

CAPACITY = 4096
CACHE_ENTRIES = 800_000
#: Documents whose runs are looked up together.
ENCODED_TOGETHER = 2500
#: Marks that may stand alone behind a word.
MARKS = frozenset(".,!?;:")
#: What the tokenizer takes otherwise than str.lower() and str.split() do, or may take for a special string.
ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f", "Σ")
#: Rows of one length that are ranked together, at least; beyond 100,000 such groups they grow.
RANKED_TOGETHER = 500
PIECES = "doc_id {kind}, piece int, start long, length long, ids_crc32 long"


class WordEncoder:
    """Token ids of whole texts, as little-endian 32-bit bytes, with words and visible runs kept between texts."""

    def __init__(self, path: str, cache: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: The same model for words that are normalised and split already; the last token of a word says that it ends there.
        self.of_words = Tokenizer.from_file(path)
        self.of_words.normalizer = normalizers.Sequence([])
        self.of_words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.of_words.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.split = regex.compile(WORDS)
        #: What is in use, and what was before the last time that it was full: results do not depend on it.
        self.cache = cache
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    @staticmethod
    def plain(text: str) -> bool:
        """Whether lower case and white space are Python's own here, and no special string may be in the text."""
        return not any(x in text for x in ODD) and (text.isascii() or unicodedata.is_normalized("NFC", text))

    def words_of(self, run: str) -> list[str]:
        if run.isalpha():
            return [run]
        if not run:  # before white space that begins a text
            return []
        if run[-1] in MARKS and run[:-1].isalpha():
            return [run[:-1], run[-1]]
        return self.split.findall(run)

    def learn(self, runs: list[str]) -> None:
        """Ids of visible runs that are not known: those of their words one after the other."""
        known = self.known
        words = [self.words_of(r) for r in runs]
        lacking = list({w for ws in words for w in ws if w not in known})
        if lacking:
            ids = np.array(self.of_words.encode_batch_fast([" ".join(lacking)], add_special_tokens=False)[0].ids, np.uint32)
            raw, ends = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            known.update(zip(lacking, [raw[a:b] for a, b in zip([0, *ends], ends)], strict=True))
        for r, ws in zip(runs, words):
            if len(ws) == 2:
                known[r] = known[ws[0]] + known[ws[1]]
            elif len(ws) != 1 or ws[0] is not r:
                known[r] = b"".join([known[w] for w in ws])

    def ids_of(self, runs: list[str]) -> list[bytes]:
        """Ids of distinct visible runs."""
        new = [r for r in runs if r not in self.known]
        if new:
            if len(self.known) + 2 * len(new) > self.cache:
                self.before, self.known, new = self.known, {}, runs
            older = self.before
            self.known.update((r, older[r]) for r in new if r in older)
            self.learn([r for r in new if r not in older])
        out = list(map(self.known.__getitem__, runs))
        for r in [r for r in new if len(r) > 64]:  # long runs are not worth their memory
            self.known.pop(r, None)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text: runs are found, and their ids put in place, for all texts together."""
        plain = [self.plain(t) for t in texts]
        split = pc.utf8_split_whitespace(pa.array([t.lower() if ok else "" for t, ok in zip(texts, plain)], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        ids = self.ids_of(coded.dictionary.to_pylist())
        sizes, codes = np.fromiter(map(len, ids), np.int32, len(ids)) // 4, coded.indices.to_numpy()
        each = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        at = np.repeat((np.cumsum(sizes, dtype=np.int64) - sizes)[codes] - ends[:-1], each)
        at += np.arange(len(at))
        raw = np.frombuffer(b"".join(ids), np.uint32)[at].tobytes()
        cuts = (4 * ends[split.offsets.to_numpy()]).tolist()
        return [raw[a:b] if ok else self.whole(t) for t, ok, a, b in zip(texts, plain, cuts, cuts[1:])]


_encoders: dict[str, WordEncoder] = {}


def pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, cache: int = CACHE_ENTRIES, together: int = ENCODED_TOGETHER) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document; no shuffle."""
    path, width = tokenizer_path(tokenizer), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders or _encoders[path].cache != cache:
            _encoders[path] = WordEncoder(path, cache)
        claim("packing", _encoders.clear)
        encoder, end = _encoders[path], array("I", [END_ID]).tobytes()
        for batch in in_slices(batches, together):
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            at, piece, start, length, crc = [], [], [], [], []
            for k, ids in enumerate(encoder.encode(texts)):
                ids += end
                for number, first in enumerate(range(0, len(ids), width)):
                    part = ids[first : first + width]
                    at.append(k), piece.append(number), start.append(first // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, PIECES.format(kind=kind))


def fullest(counts: dict[int, int], lengths: list[int], space: int) -> dict[int, int]:
    """Lengths, and how often each, whose sum is as near below `space` as the counts allow: a bitset of reachable sums."""
    mask, reach, steps = (1 << space + 1) - 1, 1, []
    for length in lengths:
        if length > space or not counts[length]:
            continue
        left, chunk = min(counts[length], space // length), 1
        while left:
            take = min(chunk, left)
            after = (reach | reach << length * take) & mask
            if after != reach:
                steps.append((length, take, reach))
                reach = after
            left, chunk = left - take, chunk * 2
        if reach >> space:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return used


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths and how many sequences each fills; every piece of the histogram is in one."""
    counts, plan = dict(histogram), []
    lengths = sorted(counts, reverse=True)
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        bin_ = fullest(counts, lengths, capacity - longest)
        counts[longest] += 1
        bin_[longest] = bin_.get(longest, 0) + 1
        copies = min(counts[x] // n for x, n in bin_.items())
        for x, n in bin_.items():
            counts[x] -= n * copies
        lengths = [x for x in lengths if counts[x]]
        plan.append((bin_, copies))
    return plan


def places(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows of (first rank, pieces in a sequence, first sequence, first offset), by first rank."""
    out, ranked, sequence = {}, {}, 0
    for bin_, copies in plan:
        offset = 0
        for length, n in sorted(bin_.items(), reverse=True):
            first = ranked.get(length, 0)
            out.setdefault(length, []).append((first, n, sequence, offset))
            ranked[length] = first + n * copies
            offset += length * n
        sequence += copies
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, cache: int = CACHE_ENTRIES, together: int = ENCODED_TOGETHER) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset; cache and together trade memory of the workers for time."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer, capacity, cache, together).withColumn("row", F.monotonically_increasing_id()), "pieces", together)
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `capacity` rows at most
    together = max(RANKED_TOGETHER, sum(histogram.values()) // 100_000)
    salts = F.create_map(*[F.lit(x) for k, n in histogram.items() if n > together for x in (k, -(-n // together))]) if any(n > together for n in histogram.values()) else None
    salt = F.pmod(F.xxhash64("row"), F.coalesce(salts[F.col("length")], F.lit(1)).cast("long")) if salts is not None else F.lit(0).cast("long")
    salted = cut.withColumn("salt", salt)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranked_before"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")) - 1
    ranked = salted.withColumn("rank", rank).join(groups, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("ranked_before"))
    table = spark.sparkContext.broadcast(places(plan_bins(histogram, capacity)))  # bounded as the histogram is

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        size, ranks = length.to_numpy(), rank.to_numpy()
        for value in np.unique(size):
            rows, at = table.value[int(value)], np.flatnonzero(size == value)
            own = rows[np.searchsorted(rows[:, 0], ranks[at], side="right") - 1]
            copy, inside = np.divmod(ranks[at] - own[:, 0], own[:, 1])
            sequence[at], offset[at] = own[:, 2] + copy, own[:, 3] + inside * value
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return ranked.withColumn("at", place("length", "rank")).select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
