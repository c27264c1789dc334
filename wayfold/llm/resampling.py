"""Importance resampling towards a target distribution (operator 11).

Features are all runs of one to three words; a feature's bucket is the CRC-32 of its bytes modulo the number of buckets.
Distinct features of a batch are grouped by length into matrices of bytes, a row a feature; the CRCs of a matrix go on
column by column, all rows at once, and the buckets are scattered back to where the features stand.  Counts of buckets are
summed in tasks before they are shuffled, for the raw table and for the target alike; a bucket's gain is the log ratio of
the two.  A document weighs the sum of its features' gains.  Gumbel noise from a hash of its id is added, and the documents with
the highest scores are drawn: a draw without replacement in proportion to the weights, the same in every run.

Texts are read twice (counts, weights) and nothing but the counts of the buckets passes the driver.  The order of all scores is
made by ranges: every range is sorted by itself, and what counts on the ranges before it is added.

Defined cases: null text has no words, no features and weight 0; texts with fewer words than `least_words` are scored and not
drawn; a null id is written as empty text where it is hashed, and comes before other ids where scores tie; rows that repeat an
id have the same noise and are each drawn or not; an empty table gives an empty result; with an empty target all counts of it
are 0; columns other than id and text are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_groups, in_slices, materialize

BUCKETS, LONGEST, SEED, PER_CENT, LEAST_WORDS = 10_000, 3, 42, 5, 20
#: Features of more bytes would have a matrix of few rows each, and go one by one.
WIDEST = 128

#: What a byte becomes: capitals in lower case, digits, small letters and bytes of longer characters as they are, the rest a space.
_KEPT = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def crc_matrix(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of every row of a matrix of bytes, column by column."""
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(rows.T):
        crc = _CRC[(crc & np.uint32(0xFF)) ^ column] ^ (crc >> np.uint32(8))
    return crc ^ np.uint32(0xFFFFFFFF)


def crcs(buffer: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of pieces of a buffer, those of one length together."""
    out = np.zeros(len(first), np.uint32)
    order = np.argsort(length, kind="stable")
    sizes, begins = np.unique(length[order], return_index=True)
    for size, places in zip(sizes.tolist(), np.split(order, begins[1:])):
        if size > WIDEST:
            out[places] = [zlib.crc32(buffer[a : a + size]) for a in first[places].tolist()]
        else:
            out[places] = crc_matrix(np.lib.stride_tricks.sliding_window_view(buffer, size)[first[places]])
    return out


def _distinct(keys: np.ndarray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for each key, in the order of first appearance, and the place of every first appearance."""
    codes = pa.array(keys).dictionary_encode().indices.to_numpy()
    highest = np.maximum.accumulate(codes)
    return codes, np.flatnonzero(np.diff(highest, prepend=-1))


def features(texts: list[str | None], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For one, two and three words: the bucket of every run's feature, the text it stands in, and the number of words."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    #: one space on both sides of every text, so that words never run over texts
    buffer = _KEPT[np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)]
    inside = buffer != 32
    edges = np.diff(inside.view(np.int8))
    first, last = np.flatnonzero(edges == 1) + 1, np.flatnonzero(edges == -1) + 1
    sizes = last - first
    bounds = np.cumsum([1] + [len(r) + 1 for r in raw])
    of = np.searchsorted(bounds, first, "right") - 1
    letters = buffer[inside]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    words = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)])
    #: the words again, one space behind each, so that a run of words is one piece
    spaced = np.full(len(letters) + len(sizes), 32, np.uint8)
    begin = offsets[:-1] + np.arange(len(sizes))
    spaced[np.arange(len(letters)) + np.repeat(np.arange(len(sizes)), sizes)] = letters
    single, where = _distinct(words)
    codes = single.astype(np.int64)
    for n in range(1, LONGEST + 1):
        count = len(sizes) - n + 1
        if count <= 0:
            return
        if n > 1:
            codes, where = _distinct((codes[:count].astype(np.int64) << 32) | single[n - 1 :])
        end = begin[n - 1 :] + sizes[n - 1 :]
        whole = of[:count] == of[n - 1 :]
        where = where[whole[where]]  # a key's runs may lie over two texts; the whole ones are looked for again
        known = np.zeros(int(codes.max()) + 1, np.uint32)
        known[codes[where]] = crcs(spaced, begin[where], end[where] - begin[where]) % np.uint32(buckets)
        late = np.flatnonzero(whole & ~np.isin(codes, codes[where])) if len(where) < len(known) else where[:0]
        if len(late):
            known[codes[late]] = crcs(spaced, begin[late], end[late] - begin[late]) % np.uint32(buckets)
        yield known[codes[whole]], of[:count][whole], n


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How often features of each bucket stand in the texts of a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in in_slices(batches):
            for group in in_groups(batch.column(0).to_pylist()):
                for found, _, _ in features(group, buckets):
                    counts += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in docs.select(text_col).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():  # a row a bucket
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log ratio of each bucket's share of the target and of the raw features, both smoothed by one; rounded down."""
    buckets, all_raw, all_target = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_raw + buckets) / ((s + 1.0) * (all_target + buckets)))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_features and weight of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            words, sums, totals = [], [], []
            for group in in_groups(batch.column(1).to_pylist()):
                n_words, n, weight = (np.zeros(len(group), np.int64) for _ in range(3))
                for found, of, size in features(group, len(gain)):
                    here = np.bincount(of, minlength=len(group))
                    ends = np.concatenate([[0], np.cumsum(gain[found])])[np.concatenate([[0], np.cumsum(here)])]
                    n_words, n, weight = n_words + here * (size == 1), n + here, weight + np.diff(ends)
                words += n_words.tolist()
                totals += n.tolist()
                sums += weight.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, totals, sums))], names=[id_col, "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_features long, weight long")


def gumbel(id_col: Column, seed: int = SEED) -> Column:
    """A thousand times Gumbel noise from a hash of seed and id, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def placed(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with their place, from 1, in an order over the whole table, as column `name`.  No task has more than a range of them."""
    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = f"{name}_at"
    rows = materialize(df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), name)
    split = F.shiftright(at, 33)
    before, total = [], 0
    for part, n in sorted(map(tuple, rows.groupBy(split.alias("part")).count().collect())):  # a row a range
        before += [F.lit(part), F.lit(total)]
        total += n
    first = F.create_map(*before)[split] if before else F.lit(0)
    return rows.withColumn(name, (first + F.col(at).bitwiseAND((1 << 33) - 1) + 1).cast("long")).drop(at)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, seed: int = SEED, per_cent: int = PER_CENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """id, n_words, n_features, weight, score and rank of every row; rank is null where a row is not drawn."""
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    scored = materialize(weighed(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + gumbel(F.col(id_col), seed)), "weighed")
    drawn = scored.filter(F.col("n_words") >= least_words).count() * per_cent // 100
    order = [(F.col("n_words") < least_words).asc(), F.col("score").desc(), F.col(id_col).asc(), F.col("n_features").asc()]
    return placed(scored, order, "place").withColumn("rank", F.when((F.col("n_words") >= least_words) & (F.col("place") <= drawn), F.col("place"))).drop("place")


def op11_crc_resampling(spark, sf_dir: str) -> DataFrame:
    """Every document's weight and score, and its rank among those drawn towards the benchmark's distribution."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, items).select("doc_id", "n_features", "weight", "score", "rank")
