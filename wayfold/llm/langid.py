"""Language identification with word-first backoff (operator 8).

A word that the model knows scores by its log frequency in each language.  A word that it doesn't know falls back to its
character n-grams, from the longest down to single letters: the first length at which any n-gram is known decides, with
the mean of the known n-grams' log frequencies.  A text's language has the highest sum over its words; the score is
that language's share after the sums are tempered by the square root of the number of words.

The model is fitted on a bounded sample: about `SAMPLE_DOCS` labelled rows by hash.  It knows the words that the sample has
`LEAST_WORD` times or more and the n-grams that it has `LEAST_GRAM` times or more, so its broadcast is bounded as the sample is.

Defined cases: null text, empty text and text without letters give `und` with score 0; with no labelled rows every text
gives `und`; ties go to the language that is first by name; repeated rows give repeated results; an empty table gives
an empty result; columns other than id and text are ignored in predictions.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, materialize, in_slices

UNKNOWN = "und"
SAMPLE_DOCS, LEAST_WORD, LEAST_GRAM, LONGEST_GRAM = 8000, 4, 32, 5
CACHE_ENTRIES = 150_000
#: Units that are counted together before they go on.
UNITS = 50_000
#: Letters, and numbers that are no decimal digits (fractions, Roman numerals), which words_of() takes out.
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case."""
    low = text.lower()
    words = LETTERS.findall(low)
    if low.isascii() or all(map(str.isalpha, set(words))):
        return words
    return "".join(c if c.isalpha() else " " for c in low).split()


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its borders marked."""
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, unit ('w' and a word, or the n-gram length and an n-gram) and its count, for each batch."""
    for batch in in_slices(batches):
        words: dict[str, Counter] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words.setdefault(lang, Counter()).update(words_of(text))
        for lang, counts in words.items():
            units: Counter = Counter()
            for word, c in counts.items():
                units[f"w{word}"] += c
                for n in range(1, LONGEST_GRAM + 1):
                    for g, more in Counter(grams(word, n)).items():
                        units[f"{n}{g}"] += c * more
                if len(units) >= UNITS:
                    yield _units(lang, units)
                    units.clear()
            yield _units(lang, units)


def _units(lang: str, units: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(units)), pa.array(list(units), pa.string()), pa.array(list(units.values()), pa.int64())], names=["lang", "unit", "n"])


class Model:
    """Log frequencies per language of words and n-grams."""

    def __init__(self, rows: list[tuple[str, list[str], list[int]]]):
        self.languages = sorted({lang for _, langs, _ in rows for lang in langs})
        self.name = uuid.uuid4().hex
        place = {lang: k for k, lang in enumerate(self.languages)}
        counts, totals = np.zeros((len(rows), max(1, len(place)))), {}
        self.row = {}
        for k, (unit, langs, ns) in enumerate(rows):
            self.row[unit] = k
            for lang, n in zip(langs, ns):
                counts[k, place[lang]] += n
            totals[unit[0]] = totals.get(unit[0], 0) + counts[k]
        self.logs = np.log((counts + 0.5) / (np.array([totals[u[0]] for u in self.row]).reshape(counts.shape) + 1)) if rows else counts

    def units(self, word: str) -> list[int]:
        """Places of the word, or else of its n-grams of the greatest length at which any is known."""
        if (known := self.row.get(f"w{word}")) is not None:
            return [known]
        for n in range(LONGEST_GRAM, 0, -1):
            if found := [x for g in grams(word, n) if (x := self.row.get(f"{n}{g}")) is not None]:
                return found
        return []

    def scores(self, words: list[str]) -> np.ndarray:
        """Mean log frequencies of each word's units, a row a word; zeros where none is known."""
        found = [self.units(w) for w in words]
        sizes = np.array([len(f) for f in found], np.int64)
        out = np.zeros((len(words), max(1, len(self.languages))))
        some = sizes > 0
        if some.any():
            flat = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
            out[some] = np.add.reduceat(self.logs[flat], (np.cumsum(sizes) - sizes)[some]) / sizes[some, None]
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words or not self.languages:
            return UNKNOWN, 0.0
        seen, total = _seen_by(self), np.zeros(len(self.languages))
        for first in range(0, len(words), CACHE_ENTRIES // 5):
            part = words[first : first + CACHE_ENTRIES // 5]
            new = [w for w in set(part) if w not in seen.rows]
            if len(seen.rows) + len(new) > CACHE_ENTRIES:
                seen.rows.clear()
                new = list(set(part))
            first_new = len(seen.rows)
            if new:
                seen.table[first_new : first_new + len(new)] = self.scores(new)
                seen.rows.update(zip(new, range(first_new, first_new + len(new))))
            total += seen.table[np.fromiter(map(seen.rows.__getitem__, part), np.int64, len(part))].sum(axis=0)
            for w in new:
                if len(w) > 64:  # its row stays unused until the next clearing
                    at = seen.rows.pop(w)
                    seen.rows[f"\0{at}"] = at
        return self.decide(total, len(words))

    def decide(self, total: np.ndarray, n: int) -> tuple[str, float]:
        best = int(np.argmax(total))
        shares = np.exp((total - total[best]) / math.sqrt(n))
        return self.languages[best], float(shares[best] / shares.sum())


class _Seen:
    """What a Python worker keeps of one model: each word's place in a table of log frequencies."""

    def __init__(self, model: Model | None):
        self.name, self.rows = model and model.name, {}
        self.table = np.zeros((CACHE_ENTRIES + 1, max(1, len(model.languages)))) if model else None


_seen = _Seen(None)


def _forget() -> None:
    global _seen
    _seen = _Seen(None)


def _seen_by(model: Model) -> _Seen:
    global _seen
    claim("language", _forget)
    if _seen.name != model.name:
        _seen = _Seen(model)
    return _seen


def fit(labelled: DataFrame, key: Column, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from a hash sample of labelled rows; key only picks the sample."""
    usable = labelled.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    share = min(1.0, SAMPLE_DOCS / max(1, usable.count()))
    sample = usable.filter(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    counted = sample.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(_count, "lang string, unit string, n long")
    per_unit = materialize(counted.groupBy("lang", "unit").agg(F.sum("n").alias("n")).groupBy("unit").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("langs")), "units")
    least = F.when(F.col("unit").startswith("w"), LEAST_WORD).otherwise(LEAST_GRAM)
    return Model([tuple(r) for r in per_unit.filter(F.col("total") >= least).select("unit", "langs.lang", "langs.n").orderBy("unit").collect()])  # bounded as the sample is


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of every row; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded as its sample is

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            found = [shared.value.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is recognised with at least this score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            found = [shared.value.predict(t) for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept for measuring: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op8_word_backoff_language(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(~held_out()), F.col("doc_id"))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
