"""Benchmark decontamination by rare seeds and local alignment (operator 7).

Each test item gives n-grams of four words.  Their document frequencies over the whole corpus are counted, and an item
keeps as seeds those that are rare, or no more frequent than twice its median one (so an item that many documents
repeat keeps its seeds).  Edits may leave no four words in a row, so pairs of words in a row open alignments too: M
matches and E edits have E + 1 runs of matches at most, so a score of M - E needs M - E - 1 pairs that item and passage
share.  Where as many stand in a stretch of a document, their passage is aligned, whatever their document frequency;
none of the accepted score is passed over.  The passage around a seed is aligned with the item by
Smith-Waterman over words; a document is contaminated by an item if the score is `LEAST_SCORE` or more of what the item
scores against itself, or if `LEAST_RUN` or more of the score comes with it in a long item.

The seeds go to the tasks as a sorted array while there are at most `MOST_SHARED` n-grams.  Beyond that n-grams, items and
texts meet in shuffles: documents with a seed of an item, and those with one of its rarest pairs, so many that the pairs which
the accepted score needs can't all be others, are aligned with it.  That bounds what is broadcast; both ways give the same
rows, which the tests hold them to.

Defined cases: null text and items without words match nothing; items of fewer than four words are one seed of all their
words; an item is an id and a text: an id with several texts is several items, each with rows of its own, rows that repeat both
are one, and a null id is an id like others; repeated and null ids of documents stay apart, row by row (clean() drops a row for
its own text); an empty benchmark or corpus gives an empty result; other columns are ignored by find() and kept by clean().
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, in_slices
from .words import shingles, word_ids

SEED_WORDS, PAIR = 4, 2
MATCH, MISMATCH, GAP = 1, -1, -1
LEAST_SCORE, LEAST_RUN = 0.5, 40
RARE_LEAST, RARE_SHARE, RARE_MEDIANS = 10, 0.001, 2.0
MOST_SHARED = 500_000
#: Words on each side of what a seed's place in the item asks for, besides a quarter of the item.
SLACK = 8
FOUND = "item long, score double, matched int, first_word int, last_word int"


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score and where it ends in the passage (exclusive)."""
    steps = np.arange(len(passage) + 1, dtype=np.int32) * -GAP
    row, best, end = np.zeros(len(passage) + 1, np.int32), 0, 0
    for word in item:
        scored = row[:-1] + np.where(passage == word, MATCH, MISMATCH).astype(np.int32)
        new = np.zeros_like(row)
        np.maximum(scored, row[1:] + GAP, out=new[1:])
        np.maximum(new, 0, out=new)
        #: gaps along the passage: the best of all earlier cells less a step for each word between
        row = np.maximum(np.maximum.accumulate(new + steps) - steps, 0)
        top = int(row.max())
        if top > best:
            best, end = top, int(row.argmax())
    return best, end


def enough(score: int, words: int) -> bool:
    return score >= LEAST_SCORE * words or score >= LEAST_RUN


class Pairs:
    """Where the pairs of words of items stand: for each distinct pair the items (by number) and the places in them."""

    def __init__(self, words: list[np.ndarray]):
        long = [k for k, w in enumerate(words) if len(w) >= SEED_WORDS]  # shorter items are one seed of all their words
        found = [shingles(words[k], PAIR) for k in long]
        grams = np.concatenate([np.empty(0, np.uint64), *found])
        order = np.argsort(grams, kind="stable")
        self.grams, self.firsts, self.counts = np.unique(grams[order], return_index=True, return_counts=True)
        self.items = np.repeat(np.array(long, np.int64), [len(f) for f in found])[order]
        self.places = np.concatenate([np.empty(0, np.int64), *(np.arange(len(f)) for f in found)])[order]
        sizes = np.array([len(w) for w in words], np.int64)
        #: pairs that the least accepted score needs, and words in which an alignment of that score stands
        self.needed = np.minimum(np.ceil(LEAST_SCORE * sizes), LEAST_RUN).astype(np.int64) - 1
        self.stretch = 2 * sizes

    def seeds(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item's number, places in the text, places in the item) of pairs that stand densely enough for the accepted score."""
        if len(ids) < PAIR or not len(self.grams):
            return
        found = shingles(ids, PAIR)
        where = np.flatnonzero(_isin(found, self.grams))
        if not len(where):
            return
        gram = np.searchsorted(self.grams, found[where])
        counts = self.counts[gram]
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - self.firsts[gram], counts)
        order = np.argsort(self.items[at], kind="stable")  # places in the text stay in order
        items, at, where = self.items[at][order], at[order], np.repeat(where, counts)[order]
        each, firsts, sizes = np.unique(items, return_index=True, return_counts=True)
        for k in np.flatnonzero(sizes >= self.needed[each]):
            item, some = each[k], slice(firsts[k], firsts[k] + sizes[k])
            places, stretch = np.unique(where[some]), self.stretch[each[k]]
            held = np.searchsorted(places, places + stretch)
            dense = places[held - np.arange(len(places)) >= self.needed[item]]
            if len(dense):  # those within a stretch that begins at one of the dense places
                before = np.searchsorted(dense, where[some], "right") - 1
                near = (before >= 0) & (where[some] - dense[np.maximum(before, 0)] < stretch)
                yield int(item), where[some][near], self.places[at[some]][near]


def grams_of(ids: np.ndarray, sizes: tuple[int, ...]) -> list[tuple[int, np.ndarray]]:
    """For each size of seed, the hashes of every run of so many words."""
    return [(n, shingles(ids, n)) for n in sizes if len(ids) >= n]


def numbered_items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, item_id, item_text): each id with each of its texts once, with a number."""
    rows = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("item_text")).filter("item_text is not null")
    return materialize(rows.distinct().withColumn("item", F.monotonically_increasing_id()).select("item", "item_id", "item_text"), "items")


def item_grams(items: DataFrame, size: int = SEED_WORDS) -> DataFrame:
    """(item, gram, place) of every n-gram of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            at, grams, places = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = shingles(word_ids(text), size).astype(np.int64).tolist()
                at += [k] * len(found)
                grams += found
                places += range(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(grams, pa.int64()), pa.array(places, pa.int32())], names=["item", "gram", "place"])

    return items.select("item", "item_text").mapInArrow(run, "item long, gram long, place int")


def _ngrams(docs: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """(id, gram, place) of every n-gram of every document: only for benchmarks too large to share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            for k, text in enumerate(batch.column(1).to_pylist()):
                for _, found in grams_of(word_ids(text), sizes):
                    at = pa.array(np.full(len(found), k))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(found.astype(np.int64)), pa.array(np.arange(len(found), dtype=np.int32))], names=["id", "gram", "place"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(run, f"id {kind}, gram long, place int")


def _runs(places: np.ndarray, reach: int, size: int) -> list[tuple[int, int]]:
    """Stretches of a text within reach of the places."""
    out: list[list[int]] = []
    for first, last in zip(np.maximum(places - reach, 0).tolist(), np.minimum(places + reach, size).tolist()):
        if out and first <= out[-1][1]:
            out[-1][1] = last
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def _hits(docs: DataFrame, wanted: np.ndarray, sizes: tuple[int, ...], reach: int, pairs: Pairs) -> DataFrame:
    """(id, grams, places, firsts, words, items, in_text, in_item) of the documents with a wanted n-gram or dense pairs: where each n-gram stands, the hashes of the words within reach of one, and the pairs' items and places."""
    shared = docs.sparkSession.sparkContext.broadcast((wanted, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, pairs = shared.value
        for batch in in_slices(batches):
            at, rows = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = word_ids(text)
                hits = [(found[where], where) for _, found in grams_of(ids, sizes) if len(where := np.flatnonzero(_isin(found, wanted)))]
                dense = list(pairs.seeds(ids))
                if hits or dense:
                    grams = np.concatenate([np.empty(0, np.uint64), *(g for g, _ in hits)])
                    places = np.concatenate([np.empty(0, np.int64), *(w for _, w in hits)])
                    in_text, in_item = (np.concatenate([np.empty(0, np.int64), *(d[c] for d in dense)]) for c in (1, 2))
                    runs = _runs(np.unique(np.concatenate([places, in_text])), reach, len(ids))
                    at.append(k)
                    rows.append((grams.astype(np.int64).tolist(), places.tolist(), [a for a, _ in runs], [ids[a:b].tobytes() for a, b in runs], [d[0] for d in dense for _ in d[1]], in_text.tolist(), in_item.tolist()))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary()), *[pa.list_(pa.int32())] * 3]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["id", "grams", "places", "firsts", "words", "items", "in_text", "in_item"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(run, f"id {kind}, grams array<long>, places array<int>, firsts array<int>, words array<binary>, items array<int>, in_text array<int>, in_item array<int>")


def _isin(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def rare_seeds(grams: DataFrame, frequency: DataFrame, documents: int) -> DataFrame:
    """(item, gram, place) of the n-grams that are kept as seeds, by document frequency."""
    counted = grams.join(frequency, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    median = counted.groupBy("item").agg(F.percentile("df", 0.5).alias("median"))
    limit = F.greatest(F.lit(float(max(RARE_LEAST, RARE_SHARE * documents))), F.col("median") * RARE_MEDIANS)
    return counted.join(median, "item").filter(F.col("df") <= limit).select("item", "gram", "place", "df")


def rare_pairs(items: DataFrame, frequency: DataFrame) -> DataFrame:
    """(item, gram) of the rarest pairs of words of items of SEED_WORDS or more: an accepted alignment has one of them.

    Of an item's places, an alignment needs so many; so many less one can be left out, and these are the most frequent.
    """
    words = F.count("*").over(Window.partitionBy("item")) + 1
    needed = F.least(F.ceil(F.lit(LEAST_SCORE) * F.col("words")), F.lit(LEAST_RUN)) - 1
    ranked = item_grams(items, PAIR).withColumn("words", words).filter(F.col("words") >= SEED_WORDS).join(frequency, "gram", "left")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("df", F.lit(0)), "place")))
    return ranked.filter(F.col("rank") <= F.col("words") - 1 - F.greatest(needed, F.lit(1)) + 1).select("item", "gram").distinct()


def _windows(places: list[tuple[int, int]], words: int, size: int) -> list[tuple[int, int]]:
    """Passages that the seeds ask for: (place in document, place in item) pairs, overlapping passages as one."""
    asked = sorted((max(0, d - i - slack(words)), min(size, d - i + words + slack(words))) for d, i in places)
    out = [list(asked[0])]
    for first, last in asked[1:]:
        if first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def slack(words: int) -> int:
    """Words on each side of where an item would stand, for insertions and deletions."""
    return SLACK + words // 4


def align(ids: np.ndarray, item: np.ndarray, places: list[tuple[int, int]]) -> tuple[int, int, int]:
    """Best score of the item in the passages around its seeds, and its first and last word (exclusive) there."""
    best = (0, 0, 0)
    for first, last in _windows(places, len(item), len(ids)):
        score, end = smith_waterman(item, ids[first:last])
        if score > best[0]:
            best = (score, first, first + end)
    score, first, end = best
    if score and enough(score, len(item)):
        back = smith_waterman(item[::-1], ids[first:end][::-1])
        return score, end - back[1], end
    return best


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_shared: int = MOST_SHARED) -> DataFrame:
    """One row for each contaminated document and item: id, item_id, score (share of the item's own), matched, first_word, last_word."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _found(texts, benchmark, item_col, item_text_col, most_shared).select(F.col("id").alias(id_col), "item_id", "score", "matched", "first_word", "last_word")


def _found(texts: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, most_shared: int) -> DataFrame:
    """(id, item_id, ...) of contaminated texts (id, text); id may be of any type, and need not tell rows apart."""
    items = numbered_items(benchmark, item_col, item_text_col)
    grams = materialize(item_grams(items), "item-grams")
    found = (_find_shared if grams.count() <= most_shared else _find_joined)(texts, items, grams, texts.count())
    return materialize(found.join(items.select("item", "item_id"), "item").drop("item"), "leaks")


def _find_shared(texts: DataFrame, items: DataFrame, grams: DataFrame, documents: int) -> DataFrame:
    """Seeds go to the tasks; one pass over the texts keeps the words around hits, and a pass over those aligns them."""
    words = {r["item"]: word_ids(r["item_text"]) for r in items.collect()}  # at most MOST_SHARED n-grams in all
    longest = max(map(len, words.values()), default=0)
    wanted = np.unique(np.array([r["gram"] for r in grams.select("gram").distinct().collect()], np.int64).astype(np.uint64))
    sizes = tuple(sorted({min(SEED_WORDS, len(w)) for w in words.values() if len(w)}))
    id_kind = texts.schema["id"].dataType.simpleString()
    hits = materialize(_hits(texts, wanted if len(wanted) else np.zeros(1, np.uint64), sizes, longest + slack(longest), Pairs(list(words.values()))), "hits")
    frequency = hits.select(F.explode(F.array_distinct("grams")).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    where = defaultdict(list)
    for r in rare_seeds(grams, frequency, documents).collect():  # at most MOST_SHARED
        where[r["gram"]].append((r["item"], r["place"]))
    known = texts.sparkSession.sparkContext.broadcast((dict(where), words, list(words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, words, numbered = known.value
        for batch in in_slices(batches):
            at, rows = [], []
            for k, (grams, places, firsts, runs, items, in_text, in_item) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 8)))):
                asked = defaultdict(list)
                for gram, place in zip(grams, places):
                    run = bisect_right(firsts, place) - 1
                    for item, item_place in where.get(gram, ()):
                        asked[item, run].append((place - firsts[run], item_place))
                for number, place, item_place in zip(items, in_text, in_item):
                    run = bisect_right(firsts, place) - 1
                    asked[numbered[number], run].append((place - firsts[run], item_place))
                best: dict = {}
                for (item, run), pairs in asked.items():
                    score, first, last = align(np.frombuffer(runs[run], np.uint64), words[item], pairs)
                    if score > best.get(item, (0,))[0]:
                        best[item] = (score, first + firsts[run], last + firsts[run])
                for item in sorted(best):
                    score, first, last = best[item]
                    if enough(score, len(words[item])):
                        at.append(k)
                        rows.append((item, score / len(words[item]), score, first, last))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["id", "item", "score", "matched", "first_word", "last_word"])

    return hits.mapInArrow(run, f"id {id_kind}, {FOUND}")


def _find_joined(texts: DataFrame, items: DataFrame, grams: DataFrame, documents: int) -> DataFrame:
    """The same for benchmarks of any size: n-grams, items and texts meet in shuffles.  Rows of texts are numbered, as ids may repeat."""
    rows = materialize(texts.filter("text is not null").withColumn("row", F.monotonically_increasing_id()), "numbered")
    named = rows.select(F.col("row").alias("id"), "text")
    hits = materialize(_ngrams(named, tuple(range(1, SEED_WORDS + 1))).join(grams.select("gram").distinct(), "gram").select("id", "gram").distinct(), "hits")
    frequency = hits.groupBy("gram").agg(F.count("*").alias("df"))
    seeds = materialize(rare_seeds(grams, frequency, documents).select("gram", "item"), "seeds")
    pair_hits = materialize(_ngrams(named, (PAIR,)).join(item_grams(items, PAIR).select("gram").distinct(), "gram").select("id", "gram").distinct(), "pair-hits")
    pairs = rare_pairs(items, pair_hits.groupBy("gram").agg(F.count("*").alias("df")))
    asked = materialize(hits.join(seeds, "gram").select("id", "item").union(pair_hits.join(pairs, "gram").select("id", "item")).distinct(), "asked")
    seeded = items.join(seeds.groupBy("item").agg(F.collect_set("gram").alias("seeds")), "item", "left").select("item", "item_text", F.coalesce("seeds", F.array().cast("array<bigint>")).alias("seeds"))
    paired = asked.withColumnRenamed("id", "row").join(rows, "row").join(seeded, "item").select("id", "item", "text", "item_text", "seeds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            at, found = [], []
            for k, (text, item, seeds) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)))):
                ids, words = word_ids(text), word_ids(item)
                score, first, last = align(ids, words, places) if (places := _asked_places(ids, words, seeds)) else (0, 0, 0)
                if score and enough(score, len(words)):
                    at.append(k)
                    found.append((score / len(words), score, first, last))
            columns, kept = list(zip(*found)) or [()] * 4, pa.array(at, pa.int64())
            kinds = [pa.float64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["id", "item", "score", "matched", "first_word", "last_word"])

    return paired.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, {FOUND}")


def _asked_places(ids: np.ndarray, words: np.ndarray, seeds: list[int]) -> list[tuple[int, int]]:
    """(place in the text, place in the item) of an item's seeds and dense pairs."""
    if not len(ids) or not len(words):
        return []
    size = min(SEED_WORDS, len(words))
    own, text = shingles(words, size), shingles(ids, size) if len(ids) >= size else ids[:0]
    wanted = np.array(seeds, np.int64).astype(np.uint64)
    out = [(d, i) for i in np.flatnonzero(np.isin(own, wanted)).tolist() for d in np.flatnonzero(text == own[i]).tolist()]
    return out + [(d, i) for _, places, item_places in Pairs([words]).seeds(ids) for d, i in zip(places.tolist(), item_places.tolist())]


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_shared: int = MOST_SHARED) -> DataFrame:
    """The rows, with all their columns, whose text no test item contaminates; rows are told apart by id and text."""
    key = F.struct(F.col(id_col).alias("id"), F.sha2(text_col, 256).alias("text"))
    leaks = _found(docs.select(key.alias("id"), F.col(text_col).alias("text")), benchmark, item_col, item_text_col, most_shared)
    leaking = materialize(leaks.select("id").distinct(), "leaking").select(F.col("id.id").alias("_id"), F.col("id.text").alias("_text"))
    marked = docs.withColumn("_digest", F.sha2(text_col, 256))
    return marked.join(leaking, marked[id_col].eqNullSafe(leaking["_id"]) & (marked["_digest"] == leaking["_text"]), "left_anti").select(docs.columns)


def op7_seeded_decontamination(spark, sf_dir: str) -> DataFrame:
    """Documents that hold passages of test items, with the item and the alignment score."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
