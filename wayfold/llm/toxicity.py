"""Toxic spans by a linear-chain conditional random field (operator 12).

Labels are of documents, the field needs labels of tokens.  A word, or the beginning of words, is a cue if documents with label 1
have it far more often than their share of all documents explains (log-likelihood ratio) and most of its occurrences are theirs;
what copies of one passage repeat counts once, as only different neighbourhoods of a word count.  Tokens of labelled documents
are toxic where a cue stands in a document with label 1.  On these tokens a field with two states is trained: a token's features
are its word, its beginnings, its character n-grams and the words before and behind it, hashed; L-BFGS takes the gradient from
the blocks of the sample, a forward-backward pass over each.

A document's score is a logistic function, fitted on the document labels, of its tokens' marginals: the greatest one, their sum, and
their sum by length.  Runs of tokens with a marginal of a half or more are its toxic spans.

The forward-backward pass takes all tokens of a batch at once, whatever the lengths of its texts: the chain is cut in columns
of equal length, the columns' transfer matrices are multiplied side by side, and the vectors at their borders follow.

The field is fitted on a bounded sample by hash, about `SAMPLE_DOCS` labelled documents, each different text once.

Defined cases: null text and text without letters have no tokens, which counts as a marginal of 0; with no labelled rows, or labels of
one kind only, every score is the smoothed share of label 1, 0.5 without any; an id with several labels is toxic if half of them
are; labels without a document and null labels are ignored; a null id has no label; repeated rows give repeated results; an
empty table gives an empty result; columns other than id and text are ignored in scores.
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
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, in_groups, in_slices, materialize

SAMPLE_DOCS, SAMPLE_BLOCKS = 3000, 12
THRESHOLD = 0.7
#: A cue stands in so many documents with label 1 at least, in them most of the times, and its ratio is at least this.
LEAST_DOCS, LEAST_SHARE, LEAST_RATIO = 5, 0.5, 24.0
#: Share of one word in what a beginning has from which the word alone counts.
MOST_OF_ONE = 0.8
FEATURES, GRAM, BEGINNINGS = 1 << 16, 4, range(3, 9)
PENALTY, STEPS = 1.0, 30
CACHE_ENTRIES = 200_000
LETTERS = re.compile(r"[^\W\d_]+")
NO_WORD = ""


def words_of(text: str | None) -> list[str]:
    """Runs of letters, as they stand."""
    return LETTERS.findall(text) if text else []


def _hashed(name: str) -> int:
    return xxhash.xxh32_intdigest(name) % FEATURES


def units_of(low: str) -> list[str]:
    """A word and its beginnings, as what cues are looked for among."""
    return ["w" + low, *("^" + low[:k] for k in BEGINNINGS if k < len(low))]


def features_of(word: str) -> tuple[list[int], int, int]:
    """Places of a word's own features, of its feature for the token behind it, and of its feature for the token before it."""
    low = word.lower()
    marked = f"<{low}>"
    own = [*units_of(low), *("g" + marked[i : i + GRAM] for i in range(len(marked) - GRAM + 1))] if low else ["w"]
    return list(map(_hashed, own)), _hashed("p" + low), _hashed("n" + low)


# --- the chain -------------------------------------------------------------------------------------------------------------------


class Chain:
    """Forward-backward over sequences of two states that lie behind one another; `begins` marks their first tokens."""

    def __init__(self, begins: np.ndarray):
        self.size = len(begins)
        self.height = max(1, math.isqrt(self.size))
        self.columns = -(-self.size // self.height)
        self.begins = self._columns(begins, True)

    def _columns(self, x: np.ndarray, rest) -> np.ndarray:
        """Tokens in columns: a row is one step of all columns."""
        out = np.full(self.columns * self.height, rest, x.dtype)
        out[: self.size] = x
        return np.ascontiguousarray(out.reshape(self.columns, self.height).T)

    def run(self, lead: np.ndarray, move: np.ndarray, start: np.ndarray, summed: bool = True) -> tuple[np.ndarray, float, np.ndarray]:
        """Marginals of state 1 and, where summed, the log of the sum over all paths and the expected moves between the states.

        lead: how much each token speaks for state 1; move: log weights from state to state; start: of first states.
        """
        lead = self._columns(lead, 0.0)
        one = 1 / (1 + np.exp(-np.clip(lead, -700, 700)))
        #: m[i, j]: from state i before a token to state j at it
        m = np.where(self.begins, np.exp(start)[None, :, None, None], np.exp(move)[:, :, None, None]) * np.stack([1 - one, one])[None]
        through = np.repeat(np.eye(2)[:, :, None], self.columns, axis=2)
        for t in range(self.height):
            through = through[:, :1] * m[:1, :, t] + through[:, 1:] * m[1:, :, t]
            through = through / through.sum((0, 1))
        into, behind = np.empty((2, self.columns)), np.empty((2, self.columns))
        a, b = np.array([0.5, 0.5]), np.array([0.5, 0.5])
        for c in range(self.columns):
            into[:, c] = a
            a = a @ through[:, :, c]
            a = a / a.sum()
        for c in range(self.columns - 1, -1, -1):
            behind[:, c] = b
            b = through[:, :, c] @ b
            b = b / b.sum()
        alpha, scale = np.empty((2, self.height, self.columns)), np.empty((self.height, self.columns))
        a = into
        for t in range(self.height):
            a = a[0] * m[0, :, t] + a[1] * m[1, :, t]
            scale[t] = a.sum(0)
            a = alpha[:, t] = a / scale[t]
        beta, b = np.empty_like(alpha), behind
        for t in range(self.height - 1, -1, -1):
            beta[:, t] = b
            b = m[:, 0, t] * b[0] + m[:, 1, t] * b[1]
            b = b / b.sum(0)
        both = alpha * beta
        marginal = (both[1] / both.sum(0)).T.ravel()[: self.size]
        if not summed:
            return marginal, 0.0, move
        real = self._columns(np.ones(self.size, bool), False)
        before = np.concatenate([into[:, None], alpha[:, :-1]], axis=1)
        pairs = before[:, None] * m * beta[None]
        moves = np.where(real & ~self.begins, pairs / pairs.sum((0, 1)), 0).sum((2, 3))
        log = float(np.where(real, np.log(scale) + np.logaddexp(0, lead), 0).sum())
        return marginal, log, moves


def token_leads(own: np.ndarray, ahead: np.ndarray, back: np.ndarray, at: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """How much each token speaks for state 1: its word's own weight, and what the words before and behind it add.

    own, ahead, back: by word, the last entry for no word; at: the word of each token.
    """
    none = len(own) - 1
    before = np.where(begins, none, np.concatenate([[none], at[:-1]])) if len(at) else at
    behind = np.where(np.append(begins[1:], True), none, np.append(at[1:], none)) if len(at) else at
    return own[at] + ahead[before] + back[behind]


# --- the model -------------------------------------------------------------------------------------------------------------------


class Weights:
    """Weights of features, of moves between states (4), of first states (2)."""

    def __init__(self, flat: np.ndarray):
        self.feature, self.move, self.start = flat[:FEATURES], flat[FEATURES : FEATURES + 4].reshape(2, 2), flat[FEATURES + 4 :]


SIZE = FEATURES + 6


class Words:
    """Features of a block's distinct words and, last, of no word: own ones behind one another, `sizes` a word."""

    def __init__(self, own: np.ndarray, sizes: np.ndarray, ahead: np.ndarray, back: np.ndarray):
        self.own, self.sizes, self.ahead, self.back = own, sizes, ahead, back
        self.of, self.size = np.repeat(np.arange(len(sizes)), sizes), len(sizes)

    @classmethod
    def of_words(cls, words: list[str]) -> Words:
        found = [features_of(w) for w in [*words, NO_WORD]]
        numbers = lambda x: np.fromiter(x, np.int32)
        return cls(numbers(chain.from_iterable(f for f, _, _ in found)), numbers(len(f) for f, _, _ in found), numbers(f[1] for f in found), numbers(f[2] for f in found))

    def leads(self, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.bincount(self.of, feature[self.own], self.size), feature[self.ahead], feature[self.back]


def gradient(words: Words, at: np.ndarray, begins: np.ndarray, toxic: np.ndarray, weights: Weights) -> tuple[float, np.ndarray]:
    """Minus the log likelihood of the token labels of a block, and its gradient."""
    lead = token_leads(*words.leads(weights.feature), at, begins)
    marginal, log, pairs = Chain(begins).run(lead, weights.move, weights.start)
    inner = np.flatnonzero(~begins)
    seen = np.bincount(toxic[inner - 1].astype(np.int64) * 2 + toxic[inner], minlength=4).reshape(2, 2)
    first, of_first = toxic[begins], marginal[begins]
    start_seen = np.array([(first == 0).sum(), (first == 1).sum()])
    value = log - (lead[toxic == 1].sum() + (seen * weights.move).sum() + start_seen @ weights.start)
    over = marginal - toxic
    none = words.size - 1
    before = np.where(begins, none, np.concatenate([[none], at[:-1]]))
    behind = np.where(np.append(begins[1:], True), none, np.append(at[1:], none))
    out = np.zeros(SIZE)
    out[:FEATURES] = np.bincount(words.own, np.bincount(at, over, words.size)[words.of], FEATURES)
    out[:FEATURES] += np.bincount(words.ahead, np.bincount(before, over, words.size), FEATURES)
    out[:FEATURES] += np.bincount(words.back, np.bincount(behind, over, words.size), FEATURES)
    out[FEATURES : FEATURES + 4] = (pairs - seen).ravel()
    out[FEATURES + 4 :] = [(1 - of_first).sum() - start_seen[0], of_first.sum() - start_seen[1]]
    return float(value), out


def lbfgs(of, x: np.ndarray, steps: int, kept: int = 8) -> np.ndarray:
    """Minimum of a convex function that gives value and gradient."""
    value, slope = of(x)
    moves, changes = [], []
    for _ in range(steps):
        d, scales = slope.copy(), []
        for s, y in zip(reversed(moves), reversed(changes)):
            scales.append(a := (s @ d) / (s @ y))
            d -= a * y
        d *= (moves[-1] @ changes[-1]) / (changes[-1] @ changes[-1]) if moves else 1 / max(1.0, np.linalg.norm(slope))
        for (s, y), a in zip(zip(moves, changes), reversed(scales)):
            d += (a - (y @ d) / (s @ y)) * s
        size, down = 1.0, slope @ d
        if down <= 1e-9 * max(1.0, abs(value)):
            break
        while True:
            new, new_slope = of(x - size * d)
            if new <= value - 1e-4 * size * down or size < 1e-6:
                break
            size /= 4
        s, y = -size * d, new_slope - slope
        if s @ y > 1e-12:
            moves, changes = [*moves, s][-kept:], [*changes, y][-kept:]
        done = value - new <= 1e-6 * max(1.0, abs(value))
        x, value, slope = x - size * d, new, new_slope
        if done:
            break
    return x


def evidence(marginal: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each sequence its greatest marginal, the log of their sum and of their sum in a thousand tokens."""
    at = np.flatnonzero(begins)
    sums = np.add.reduceat(marginal, at)
    sizes = np.diff(np.append(at, len(marginal)))
    return np.stack([np.maximum.reduceat(marginal, at), np.log1p(sums), np.log1p(1000 * sums / sizes)], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, steps: int = 60) -> np.ndarray:
    """Weights of the columns and, last, of one; by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, held = np.zeros(x.shape[1]), np.diag([penalty] * (x.shape[1] - 1) + [1e-6])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + w @ held @ w / 2)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -700, 700)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + held + 1e-9 * np.eye(len(w)), x.T @ (p - y) + held @ w)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


class Model:
    """The field's weights and the document score's, with the share of label 1 for want of either."""

    def __init__(self, flat: np.ndarray | None, document: np.ndarray | None, share: float):
        self.weights = Weights(flat) if flat is not None else None
        self.document, self.share, self.name = document, share, uuid.uuid4().hex

    def leads(self, word: str) -> tuple[float, float, float]:
        own, ahead, back = features_of(word)
        f = self.weights.feature
        return float(f[own].sum()), float(f[ahead]), float(f[back])

    def marginals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of all tokens, marks of first tokens, and the text of each sequence that has tokens."""
        seen = _seen_by(self)
        tokens, of = [], []
        for k, text in enumerate(texts):
            if words := words_of(text):
                tokens.append(words)
                of.append(k)
        at = np.fromiter(map(seen.place, chain.from_iterable(tokens)), np.int64)
        begins = np.zeros(len(at), bool)
        begins[np.cumsum([0] + [len(w) for w in tokens[:-1]]) if tokens else []] = True
        table = seen.table()
        lead = token_leads(table[:, 0], table[:, 1], table[:, 2], at, begins)
        marginal = Chain(begins).run(lead, self.weights.move, self.weights.start, summed=False)[0] if len(at) else lead
        return marginal, begins, np.array(of, np.int64)

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, list[str]]:
        """Each text's score, and its toxic spans as start:end, joined by commas."""
        if self.weights is None:
            return np.full(len(texts), self.share), [""] * len(texts)
        x, spans = np.zeros((len(texts), 3)), [""] * len(texts)
        marginal, begins, of = self.marginals(texts)
        if len(of):
            x[of] = evidence(marginal, begins)
            first = np.append(np.flatnonzero(begins), len(marginal))
            for k in np.flatnonzero(x[of, 0] >= 0.5).tolist():
                spans[of[k]] = spans_of(texts[of[k]], marginal[first[k] : first[k + 1]] >= 0.5)
        z = x @ self.document[:-1] + self.document[-1]
        return 1 / (1 + np.exp(-np.clip(z, -700, 700))), spans


def spans_of(text: str, toxic: np.ndarray) -> str:
    """Code points of the runs of toxic tokens, as start:end, joined by commas."""
    out, last = [], -2
    for k, found in enumerate(LETTERS.finditer(text)):
        if toxic[k]:
            if last == k - 1:
                out[-1][1] = found.end()
            else:
                out.append([found.start(), found.end()])
            last = k
    return ",".join(f"{a}:{b}" for a, b in out)


class _Seen:
    """What a Python worker keeps of one model: each word's weights, by place."""

    def __init__(self, model: Model | None):
        self.model, self.name, self.rows, self.found = model, model and model.name, {}, []

    def place(self, word: str) -> int:
        at = self.rows.get(word)
        if at is None:
            at = len(self.found)
            self.found.append(self.model.leads(word))
            if len(word) <= 64:
                self.rows[word] = at
        return at

    def table(self) -> np.ndarray:
        """Weights by place and, last, of no word; a cache that grew too large is given up afterwards."""
        out = np.array([*self.found, self.model.leads(NO_WORD)])
        if len(self.found) > CACHE_ENTRIES:
            self.rows, self.found = {}, []
        return out


_seen = _Seen(None)


def _forget() -> None:
    global _seen
    _seen = _Seen(None)


def _seen_by(model: Model) -> _Seen:
    global _seen
    claim("toxicity", _forget)
    if _seen.name != model.name:
        _seen = _Seen(model)
    return _seen


# --- fitting ---------------------------------------------------------------------------------------------------------------------


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept for measuring: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int = SAMPLE_DOCS) -> DataFrame:
    """text and toxic of about so many labelled documents by hash, each different text once."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("toxic"))
    share = min(1.0, most / max(1, known.count()))
    picked = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull()).join(picked, "id")
    return texts.groupBy(F.sha2("text", 256).alias("digest")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("digest", "text", "toxic")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of documents, each with a hash of the words around it and a number of its document."""
    for batch in in_slices(batches):
        for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            low = [w.lower() for w in words_of(text)]
            found = {(u, xxhash.xxh32_intdigest(" ".join(low[max(0, k - 1) : k + 2]))) for k, w in enumerate(low) for u in units_of(w)}
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.string()), pa.array([p for _, p in found], pa.int64()), pa.array([number] * len(found), pa.int64())], names=["unit", "place", "doc"])


def cues(sample: DataFrame, base: float) -> list[str]:
    """Units that stand in documents with label 1 far more often than by chance; bounded as the sample is."""
    places = sample.filter("toxic = 1").select(F.xxhash64("digest"), "text").mapInArrow(_places, "unit string, place long, doc long")
    toxic = places.groupBy("unit").agg(F.count_distinct("place").alias("c"), F.count_distinct("doc").alias("d"))
    known = {r.unit: (r.c, min(r.c, r.d)) for r in toxic.filter((F.col("c") >= LEAST_DOCS) & (F.col("d") >= LEAST_DOCS)).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, docs = Counter(), Counter()
        for batch in in_slices(batches):
            for text in batch.column(0).to_pylist():
                here = Counter(u for w in words_of(text) for u in units_of(w.lower()) if u in known)
                times.update(here)
                docs.update(here.keys())
        yield pa.RecordBatch.from_arrays([pa.array(list(times), pa.string()), pa.array(list(times.values()), pa.int64()), pa.array([docs[u] for u in times], pa.int64())], names=["unit", "c", "d"])

    clean = {r.unit: (r.c, r.d) for r in sample.filter("toxic = 0").select("text").mapInArrow(run, "unit string, c long, d long").groupBy("unit").agg(F.sum("c").alias("c"), F.sum("d").alias("d")).collect()}

    def ratio(a: int, b: int) -> float:
        share = a / (a + b)
        return 2 * (a * math.log(share / base) + (b * math.log((1 - share) / (1 - base)) if b else 0.0))

    #: the most frequent word with each beginning: one that a single word makes up is no cue beside it
    word = Counter()
    for unit, (c, _) in known.items():
        if unit[0] == "w":
            for start in units_of(unit[1:])[1:]:
                word[start] = max(word[start], c)
    found = []
    for unit, (c, d) in known.items():
        other_c, other_d = clean.get(unit, (0, 0))
        if word[unit] < MOST_OF_ONE * c and c >= LEAST_SHARE * (c + other_c) and d > base * (d + other_d) and ratio(d, other_d) >= LEAST_RATIO:
            found.append(unit)
    return sorted(found)


#: What a block of the sample holds, as bytes: features of its words, the word of each token, marks of first tokens, labels of tokens and documents.
BLOCK = {"own": np.int32, "sizes": np.int32, "ahead": np.int32, "back": np.int32, "at": np.int32, "begins": bool, "toxic": np.int8, "labels": np.int8}


def _blocks(sample: DataFrame, known: frozenset[str]) -> DataFrame:
    """Tokens of the sample in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            rows: dict[str, int] = {}
            at, begins, toxic, labels = [], [], [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                low = [w.lower() for w in words_of(text)]
                if low:
                    at += [rows.setdefault(w, len(rows)) for w in low]
                    begins += [True] + [False] * (len(low) - 1)
                    toxic += [label and int(any(u in known for u in units_of(w))) for w in low]
                    labels.append(label)
            if at:
                words = Words.of_words(list(rows))
                values = {**{c: getattr(words, c) for c in ("own", "sizes", "ahead", "back")}, "at": at, "begins": begins, "toxic": toxic, "labels": labels}
                yield pa.RecordBatch.from_arrays([pa.array([np.array(values[c], kind).tobytes()], pa.binary()) for c, kind in BLOCK.items()], names=list(BLOCK))

    return sample.repartition(SAMPLE_BLOCKS, "digest").select("text", "toxic").mapInArrow(run, ", ".join(f"{c} binary" for c in BLOCK))


def _read(row: dict) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    own, sizes, ahead, back, *rest = (np.frombuffer(row[c], kind) for c, kind in BLOCK.items())
    return Words(own, sizes, ahead, back), *rest


def train(blocks: DataFrame, steps: int = STEPS, penalty: float = PENALTY) -> np.ndarray:
    """The field's weights: each step adds up the gradients of the blocks, of which there are as many as the sample's bound allows."""

    def of(flat: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(SIZE + 1)
            for batch in batches:
                for row in batch.to_pylist():
                    value, slope = gradient(*_read(row)[:4], Weights(flat))
                    total += np.append(slope, value)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

        found = sum(np.frombuffer(r.part) for r in blocks.mapInArrow(run, "part binary").collect())  # a row a task
        return float(found[-1] + penalty * (flat @ flat) / 2), found[:-1] + penalty * flat

    return lbfgs(of, np.zeros(SIZE), steps)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = SAMPLE_DOCS) -> Model:
    """A model from the rows of labels and their documents."""
    sample = materialize(labelled_sample(docs, labels, id_col, text_col, label_col, most), "labelled")
    counts = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    if not counts.get(0) or not counts.get(1):
        return Model(None, None, share)
    blocks = materialize(_blocks(sample, frozenset(cues(sample, share))), "tokens")
    flat = train(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(flat)
        for batch in batches:
            for row in batch.to_pylist():
                words, at, begins, _, labels = _read(row)
                marginal = Chain(begins).run(token_leads(*words.leads(weights.feature), at, begins), weights.move, weights.start, summed=False)[0]
                yield pa.RecordBatch.from_arrays([*map(pa.array, evidence(marginal, begins).T.copy()), pa.array(labels.astype(np.int64))], names=["a", "b", "c", "y"])

    rows = np.array([tuple(r) for r in blocks.mapInArrow(run, "a double, b double, c double, y long").collect()]).reshape(-1, 4)  # bounded as the sample is
    if not len(rows):
        return Model(None, None, share)
    return Model(flat, logistic(rows[:, :3], rows[:, 3]), share)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, score, predicted and toxic spans of every row; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            parts = [shared.value.scores(g) for g in in_groups(batch.column(1).to_pylist())]
            found, spans = np.concatenate([p for p, _ in parts]), [s for _, some in parts for s in some]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= threshold).astype(np.int32)), pa.array(spans, pa.string())], names=[id_col, "score", "predicted", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int, spans string")


def op12_crf_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score of every document, learned from the labels that are not held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs.filter(~held_out()), labels.filter(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", "spans")
