"""Near-duplicates by Order MinHash (operator 6).

A text is a sequence of k-mers of words, labelled with their occurrence numbers.  One sketch cuts the sequence into a few
parts of one size and takes of each part the k-mer with the least hash; the k-mers in text order are the key.  So keys
hold order (a passage that two texts share at different places, or that fills one part only, makes no key), and the
nearer the edit distance of two texts is, the more likely they agree on one.  `KINDS` says how many words, parts and
sketches texts of each length take; the ranges of lengths overlap, so that texts whose lengths differ by a fifth have a
kind in common.  K-mers have few words, as scattered edits leave few long runs of words (at a similarity of 0.8, a third
of the runs of five); what makes keys selective is that a k-mer of each part must agree, occurrence number and all.
Chance pairs of words grow with a text, so long ones take three words.  Texts of up to `TINY` words take every k-mer of
one word but one or two: such pairs never miss.

Equal texts are one text, found by digest; ids only name what is found.  Texts with a key in common are candidates, and
candidates whose words have an edit similarity (1 - distance / longer length) of `SIMILAR` or more by banded alignment are
linked; classes are the components of the links.  First each text is compared with one text of each of its keys.  What a
key then holds outside the component of that text is open, and is compared with the key's members in other components, lengths
permitting.  So no pair of different components that share a key is left out, and copies are not expanded into all pairs.

Texts made from one form may have a key in common without being similar.  Where the open members of a key and all its members
make over `CROWDED` pairs, its members go another way, which loses no pair: texts of a similarity of 0.8 share all but a fifth
of their words, occurrence numbers and all, so in any order of words they share one of the first fifth (and one more) of each.
Rare words come first in that order, so the form's own words are the last to be looked at, and what the texts of a form have for
themselves decides; a word that a text repeats is as frequent as all its occurrences.  Texts of a form that have few words of their own,
and these from few words, still meet often: where they would meet more often than by keys they are met by keys, and of the pairs of a key
only those go on that have enough words in common, as an edit changes one word.  Copies whose distance is just over the limit are told apart
by that in most cases, though each must still be held against each: there the work of a key grows as its open members times its members.

Defined cases: rows with null text or a null id are each a class of their own; texts without words are near to their exact copies
only; exact copies are one text; the least id of a class names it; an id with several texts may be in several classes, and rows
that repeat id and text are one document; an empty table gives an empty result; other columns are ignored.  A passage that
moved counts as so many deletions and insertions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_slices, materialize
from .components import components
from .words import mixed, shingles, word_ids

SIMILAR = 0.8
TINY = 14
#: Fewest and most words of a text, words in a k-mer, parts of the text, sketches.
KINDS = ((12, 50, 2, 2, 32), (40, 2000, 2, 4, 64), (1600, None, 3, 3, 96))
#: Hashes that are computed at once.
CELLS = 2_000_000
#: Pairs of a key's open members and all its members from which its members are compared by their rare words.
CROWDED = 500
#: Members of a word that all others are compared with, one after the other, before the rest is.
STARS = 3
#: Counters of words, by hash; their order only says which words are looked at first.
COUNTERS = 1 << 18

_seeds = np.random.default_rng(20240601).integers(1, 1 << 63, sum(x[-1] for x in KINDS), np.uint64)
_STEP = np.uint64(0x5851F42D4C957F2D)


def labelled(kmers: np.ndarray) -> np.ndarray:
    """K-mer hashes with their occurrence numbers mixed in."""
    order = np.argsort(kmers, kind="stable")
    ordered = kmers[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if new.all():
        return kmers
    first = np.maximum.accumulate(np.where(new, np.arange(len(kmers)), 0))
    occurrence = np.empty(len(kmers), np.uint64)
    occurrence[order] = np.arange(len(kmers)) - first
    return np.where(occurrence == 0, kmers, mixed(kmers + occurrence * np.uint64(0xD1342543DE82EF95)))


def _keys(kmers: np.ndarray, seeds: np.ndarray, parts: int) -> np.ndarray:
    """One key a seed: the least k-mer of each part, in text order."""
    marked, out, rows = labelled(kmers), [], max(1, CELLS // len(kmers))
    cuts = [len(kmers) * p // parts for p in range(parts + 1)]
    for first in range(0, len(seeds), rows):
        some = seeds[first : first + rows]
        hashes = (marked[None, :] ^ some[:, None]) * (some[:, None] | np.uint64(1))
        key = some
        for low, high in zip(cuts, cuts[1:]):
            key = mixed(key * _STEP + marked[low + hashes[:, low:high].argmin(axis=1)])
        out.append(key)
    return np.concatenate(out)


def _tiny_keys(ids: np.ndarray) -> np.ndarray:
    """A key for every way to leave out as many words as edits may have touched; the rest stays in order."""
    most = int((1 - SIMILAR) * min(TINY, len(ids) / SIMILAR) + 1e-9)
    words = ids.tolist()
    kept = (c for n in range(most + 1) for c in combinations(words, len(words) - n))
    return np.fromiter((xxhash.xxh64_intdigest(np.array(c, np.uint64).tobytes()) for c in kept), np.uint64)


def sketch(ids: np.ndarray) -> np.ndarray:
    """The keys of a text, given as the hashes of its words."""
    out, used = [_tiny_keys(ids)] if 0 < len(ids) <= TINY else [], 0
    for fewest, most, size, parts, sketches in KINDS:
        if fewest <= len(ids) <= (most or len(ids)):
            out.append(_keys(shingles(ids, size), _seeds[used : used + sketches], parts))
        used += sketches
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def banded_distance(a: list[int], b: list[int], most: int) -> int:
    """Edit distance if it is at most `most`, else most + 1: only cells within `most` of the diagonal are looked at.

    A column of the band is one pair of integers whose bits say where the distance rises or falls by one from row to
    row; the band moves down by one row a column once it has left the top.
    """
    low, high = 0, min(len(a), len(b))
    while low < high and a[low] == b[low]:
        low += 1
    a, b = a[low:], b[low:]
    cut, high = 0, min(len(a), len(b))
    while cut < high and a[-1 - cut] == b[-1 - cut]:
        cut += 1
    a, b = a[: len(a) - cut], b[: len(b) - cut]
    m, n = len(a), len(b)
    if abs(m - n) > most:
        return most + 1
    if not m or not n:
        return m + n
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    base, top = 0, 0  # rows base + 1, ... are in the band; top is the distance at row `base` of this column
    rows = min(m, most)
    rises, falls = (1 << rows) - 1, 0
    for j in range(1, n + 1):
        after = max(0, j - most - 1)
        end = min(m, j + most)
        shift, size = after - base, end - after
        if size <= 0:
            return most + 1
        if shift:  # the band's top row leaves; the row above the band becomes what was the first row in it
            top += (rises & 1) - (falls & 1)
            rises, falls = rises >> 1, falls >> 1
        base = after
        full = (1 << size) - 1
        grown = end - base - (rows - shift)
        if grown > 0:
            rises |= ((1 << grown) - 1) << (size - grown)
        rises, falls, rows = rises & full, falls & full, size
        match = (where.get(b[j - 1], 0) >> base) & full
        same = ((((match & rises) + rises) ^ rises) | match | falls) & full
        right = falls | (full & ~(same | rises))
        left = same & rises
        top += 1  # entering the band from above costs one, as from the first row
        right, left = (right << 1 | 1) & full, (left << 1) & full
        rises, falls = left | (full & ~(same | right)), same & right
    distance = top + rises.bit_count() - falls.bit_count()
    return distance if distance <= most else most + 1


@lru_cache(maxsize=16)
def _parsed(text: str) -> list[int]:
    return word_ids(text).tolist()


def similarity(a: str, b: str) -> float:
    """Word edit similarity by banded alignment if that is SIMILAR or more, else 0."""
    x, y = _parsed(a), _parsed(b)
    longer = max(len(x), len(y))
    most = int((1 - SIMILAR) * longer + 1e-9)
    if not longer or (distance := banded_distance(x, y, most)) > most:
        return 0.0
    return 1 - distance / longer


@F.pandas_udf(T.DoubleType())
def _similarity(a, b):
    import pandas as pd

    return pd.Series([similarity(x, y) for x, y in zip(a, b)], dtype=float)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, words, keys) of every row with id and text: the text's digest, the number of words, and the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            ids = [word_ids(t) for t in batch.column(2).to_pylist()]
            keys = [sketch(i).astype(np.int64) for i in ids]
            lengths = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
            values = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, ids), pa.int32()), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), values)], names=["id", "digest", "words", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.filter(_compared(id_col, text_col)).select(F.col(id_col).alias("id"), _digest(text_col).alias("digest"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, digest binary, words int, keys array<long>")


def _digest(text_col: str) -> Column:
    return F.unhex(F.sha2(text_col, 256))


def _compared(id_col: str, text_col: str) -> Column:
    return F.col(id_col).isNotNull() & F.col(text_col).isNotNull()


def verified(pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) whose texts are similar; texts are fetched for the texts in pairs only."""
    pairs = materialize(pairs, f"{name}-pairs")
    text_of = lambda column: texts.select(F.col("node").alias(column), F.col("text").alias(f"text_{column}"))
    joined = pairs.join(text_of("a"), "a").join(text_of("b"), "b")
    return materialize(joined.withColumn("similarity", _similarity.asNondeterministic()("text_a", "text_b")).select("a", "b", "similarity").filter(F.col("similarity") >= SIMILAR), f"{name}-links")


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots (node, root) with more links (a, b) between nodes: only the roots that these join go through components again."""
    root_of = lambda column: roots.select(F.col("node").alias(column), F.col("root").alias(f"root_{column}"))
    ends = materialize(links.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select("a", "b", F.coalesce("root_a", "a").alias("ra"), F.coalesce("root_b", "b").alias("rb")), "ends")
    new = components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("was"), F.col("root").alias("now"))
    nodes = ends.select(F.col("a").alias("node"), F.col("ra").alias("root")).union(ends.select("b", "rb")).union(roots.select("node", "root")).distinct()
    return materialize(nodes.join(new, nodes["root"] == new["was"], "left").select("node", F.coalesce("now", "root").alias("root")), "merged")


def near(x: Column, y: Column) -> Column:
    """Lengths that an edit similarity of SIMILAR allows."""
    return F.least(x, y) >= F.greatest(x, y) * SIMILAR


def alike(x: Column, y: Column, words_x: Column, words_y: Column) -> Column:
    """Bags of words of which no more differ than an edit similarity of SIMILAR allows: an edit takes one word from a bag and puts one into it."""
    return F.greatest(F.size(x), F.size(y)) - F.size(F.array_intersect(x, y)) <= F.greatest(words_x, words_y) * (1 - SIMILAR) + 1e-6


def across(members: DataFrame, by: str) -> DataFrame:
    """Pairs (a, b) of members (by, node, words, root, open) with the same `by` in different components, one of them open.

    Where members have a bag, those go whose bags are too different for similar texts.
    """
    bag = [c for c in ("bag",) if c in members.columns]
    side = lambda some, x: some.select(by, F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("words", "root", "open", *bag)))
    both = side(members.filter("open"), "a").join(side(members, "b"), by).filter("root_a <> root_b and (a < b or not open_b)").filter(near(F.col("words_a"), F.col("words_b")))
    if bag:
        both = both.filter(alike(F.col("bag_a"), F.col("bag_b"), F.col("words_a"), F.col("words_b")))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _counter(ids: np.ndarray) -> np.ndarray:
    return (ids % np.uint64(COUNTERS)).astype(np.int64)


def by_rare_words(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(word, node, words, root, open) of members (node, words, root, open) that share one of their rarest words with an open one.

    Members that are similar have such a word in common.
    """
    rows = members.join(texts, "node").select("node", "words", "root", "open", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in in_slices(batches):
            for text in batch.column(0).to_pylist():
                total += np.bincount(_counter(word_ids(text)), minlength=COUNTERS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["at", "n"])

    counts = np.zeros(COUNTERS, np.int64)
    for at, n in rows.select("text").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n")).collect():  # COUNTERS rows at most
        counts[at] = n
    shared = members.sparkSession.sparkContext.broadcast(counts)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            found = []
            for text in batch.column(1).to_pylist():
                ids = word_ids(text)
                words = labelled(ids)
                order = np.lexsort((words, shared.value[_counter(ids)]))
                found.append(words[order[: int((1 - SIMILAR) * len(words) + 1e-9) + 1]].astype(np.int64))
            of = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), batch.column(0).take(of)], names=["word", "node"])

    words = materialize(rows.select("node", "text").mapInArrow(rarest, "word long, node long"), "rare")
    known = materialize(words.join(members, "node"), "rare-of")
    several = known.groupBy("word").agg(F.count("*").alias("n"), F.bool_or("open").alias("any")).filter("n > 1 and any").select("word")
    return materialize(known.join(several, "word"), "rare-shared")


def bags(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, bag) of the members' texts: their words with occurrence numbers, as a set of numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            sets = [np.unique(labelled(word_ids(t)).astype(np.uint32).view(np.int32)) for t in batch.column(1).to_pylist()]
            lengths = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(sets)))], names=["node", "bag"])

    return materialize(members.select("node").join(texts, "node").select("node", "text").mapInArrow(run, "node long, bag array<int>"), "bags")


def stars(shared: DataFrame, number: int) -> DataFrame:
    """Pairs (a, b) of one member of each word, another one for each number, and those of the word in other components."""
    order = F.xxhash64("node", F.lit(number))
    middle = shared.groupBy("word").agg(F.min_by(F.struct("node", "words", "root", "open"), order).alias("m"))
    pairs = shared.join(middle, "word").filter("(open or m.open) and root <> m.root").filter(near(F.col("words"), F.col("m.words")))
    return pairs.select(F.least("node", "m.node").alias("a"), F.greatest("node", "m.node").alias("b")).distinct()


def meetings(members: DataFrame, by: str) -> int:
    """How often an open member meets a member with the same `by`."""
    return members.groupBy(by).agg((F.count_if("open") * F.count("*")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def crowded_links(placed: DataFrame, texts: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of the members (key, node, words, open) of crowded keys in different components, and the roots with these.

    Members of a word are compared with one of them, then with another, so that what belongs together is soon in one component;
    then members that are still in different ones are compared with each other.  Where members meet more often by their words than
    by their keys, which texts do that have few rare words, they are compared by keys, if their words are alike; either way meets all
    pairs with a key in common that may be similar.
    """
    placed = materialize(placed.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "crowded")
    crowd = placed.groupBy("node").agg(F.first("words").alias("words"), F.first("root").alias("root"), F.bool_or("open").alias("open"))
    crowd = materialize(crowd, "crowd")
    shared, links = by_rare_words(crowd, texts), None
    if meetings(shared, "word") > meetings(placed, "key"):
        links = verified(across(placed.join(bags(crowd, texts), "node"), "key").distinct(), texts, "crowded").select("a", "b")
        return links, merged(roots, links)
    for number in range(STARS + 1):
        pairs = stars(shared, number) if number < STARS else across(shared, "word").distinct()
        found = verified(pairs, texts, "rare")
        links = found.select("a", "b") if links is None else links.union(found.select("a", "b"))
        roots = merged(roots, found)
        if number < STARS:
            now = roots.select("node", F.col("root").alias("now"))
            shared = materialize(shared.join(now, "node", "left").withColumn("root", F.coalesce("now", "root")).select("word", "node", "words", "root", "open"), "rare-shared")
    return links, roots


def texts_and_classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, digest) of every row with id and text, and of every such text digest, text_id, class_id, n_links and first.

    first: the text that stands for its class, the one of the least id (of several the one with the least digest).
    """
    sketched = materialize(sketches(docs, id_col, text_col), "sketches")
    nodes = sketched.groupBy("digest").agg(F.min("id").alias("text_id"), F.first("words").alias("words"), F.first("keys").alias("keys"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "texts")
    keys = materialize(nodes.select("node", "words", F.explode("keys").alias("key")), "keys")
    shared = keys.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    held = materialize(keys.join(shared, "key"), "held")
    wanted = nodes.join(held.select("node").distinct(), "node", "left_semi").select("node", "digest", F.col("text_id").alias("id"))
    rows = docs.filter(_compared(id_col, text_col)).select(F.col(id_col).alias("id"), _digest(text_col).alias("digest"), F.col(text_col).alias("text"))
    texts = materialize(rows.join(wanted, ["digest", "id"]).select("node", "text").dropDuplicates(["node"]), "compared")
    lengths = held.filter("node = least").select(F.col("key"), F.col("words").alias("least_words"))
    star = held.filter("node <> least").join(lengths, "key").filter(near(F.col("words"), F.col("least_words"))).select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    links = verified(star, texts, "star")
    roots = components(links)
    root_of = lambda column, name: roots.select(F.col("node").alias(column), F.col("root").alias(name))
    placed = held.join(root_of("node", "root"), "node", "left").join(root_of("least", "least_root"), "least", "left")
    placed = materialize(placed.filter("node <> least").select("key", "node", "words", F.coalesce("root", "node").alias("root"), (F.coalesce("root", "node") != F.coalesce("least_root", "least")).alias("open")), "placed")
    opens = placed.groupBy("key").agg(F.count_if("open").alias("n"), F.count("*").alias("all")).filter("n > 0").select("key", (F.col("n") * F.col("all") > CROWDED).alias("crowded"))
    placed = materialize(placed.join(opens, "key"), "open")
    more = verified(across(placed.filter("not crowded"), "key").distinct(), texts, "rest")
    links = links.select("a", "b").union(more.select("a", "b"))
    roots = merged(roots, more)
    crowded = placed.filter("crowded").select("key", "node", "words", "root", "open")
    if not crowded.isEmpty():
        rare, roots = crowded_links(crowded, texts, roots)
        links = links.union(rare)
    links = materialize(links.distinct(), "links")
    degree = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    linked = materialize(roots.join(degree, "node", "left").join(nodes.select("node", "text_id", "digest"), "node"), "linked")
    least = linked.groupBy("root").agg(F.min(F.struct("text_id", "digest")).alias("least"))
    classes = linked.join(least, "root").select("node", F.col("least.text_id").alias("class_id"), F.col("least.digest").alias("least_digest"), "n_links")
    texted = nodes.select("node", "digest", "text_id").join(classes, "node", "left").select(
        "digest", "text_id", F.coalesce("class_id", "text_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.col("least_digest") == F.col("digest"), F.lit(True)).alias("first")
    )
    return sketched.select("id", "digest"), materialize(texted, "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id (the class's least id), text_id (least id of the exact copies), n_links (verified links of the text)."""
    members, texts = texts_and_classes(docs, id_col, text_col)
    found = members.join(texts, "digest").select(F.col("id").alias(id_col), "class_id", "text_id", "n_links")
    alone = docs.filter(~_compared(id_col, text_col)).select(id_col, F.col(id_col).alias("class_id"), F.col(id_col).alias("text_id"), F.lit(0).cast("long").alias("n_links"))
    return found.union(alone)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class with all its columns: of the text that stands for it, the one of the least id; rows without id or text stay.

    Of rows that repeat id and text one stays, whichever.
    """
    members, texts = texts_and_classes(docs, id_col, text_col)
    rows = members.groupBy("id", "digest").agg(F.count("*").alias("n"))
    seen = materialize(rows.join(texts.select("digest", "text_id", "first"), "digest").select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), (F.col("first") & (F.col("id") == F.col("text_id"))).alias("_stays"), "n"), "near")
    marked = docs.withColumn("_digest", _digest(text_col))
    same = lambda side: (marked[id_col] == side["_id"]) & (marked["_digest"] == side["_digest"])
    dropped, repeated = seen.filter("not _stays"), seen.filter("_stays and n > 1")
    if repeated.isEmpty():
        return marked.join(dropped, same(dropped), "left_anti").select(docs.columns)
    once = marked.join(repeated, same(repeated), "left_semi").dropDuplicates(["_digest"])
    others = seen.filter("not _stays or n > 1")
    return marked.join(others, same(others), "left_anti").unionByName(once).select(docs.columns)


def op6_order_minhash(spark, sf_dir: str) -> DataFrame:
    """Class of near-duplicates of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
