"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation (operator 13).

Entries become whole numbers, x = floor(scale * c) + shift, and rows are centred exactly: with S = q * n + r, a centred entry is
(x - q) - r / n.  The matrix X of centred rows stays in blocks over the cluster.  Right vectors v have one entry a dimension and
are on the driver; left vectors u have one entry a row and are never stored: each is X w for a short vector w.

A step has two passes over the blocks.  The first takes y = X v, its products with all left vectors so far and its length.  The
second takes u, which is y without its parts along those, once more against all of them (reorthogonalisation in full, twice)
and the product of X transposed and u, from which the next v follows, orthogonalised twice against all before.  Where a
space is used up, which happens when eigenvalues repeat, the next v is any vector orthogonal to all others.  Steps end
when all dimensions are used, so that no copy of an eigenvalue is missed; their number depends on the dimensions alone.  The
singular value decomposition of the small bidiagonal matrix gives components and deviations.

The driver receives sums of one number a dimension or pair of components, added up in tasks before they are shuffled.

Defined cases: rows whose vector is null or holds a null, a NaN or an infinity are dropped, and so are those whose vector has not
the most frequent length (of equally frequent ones the greatest); a null id stays as it is; repeated rows count each time and
give repeated rows; directions without any spread (exactly dependent dimensions, one row, all rows equal) have no component, so
fewer rows may come back, or none; an empty table gives an empty result; entries are at most 2**40 in size, larger ones
count as that; columns other than id and vector are ignored; `deviation` is a long where it fits for all rows, else decimal(38, 0).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
LARGEST = float(1 << 40)
BLOCK_ROWS = 2048
#: Lengths below this share of the greatest deviation are rounding, not spread.
NOTHING = 1e-10


def _x_blocks(rows: DataFrame, width: int, scale: float, shift: int, id_col: str, vec_col: str) -> DataFrame:
    """Rows of whole numbers in blocks: ids, number of rows, numbers as bytes, and sums of the numbers of each dimension."""
    id_type = T.StructType([T.StructField("ids", T.ArrayType(rows.schema[id_col].dataType)), T.StructField("size", T.IntegerType()), T.StructField("x", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(first, BLOCK_ROWS)
                c = part.column(1).flatten().to_numpy().astype(np.float64).reshape(part.num_rows, width)
                x = np.floor(np.clip(c, -LARGEST, LARGEST) * scale).astype(np.int64) + shift
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([part.num_rows], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["ids", "size", "x"])

    return rows.select(id_col, vec_col).mapInArrow(run, id_type)


class Centred:
    """The centred matrix in blocks, and sums over it."""

    def __init__(self, blocks: DataFrame, width: int):
        self.blocks, self.width = blocks, width
        self.n, self.sums, self.low, self.high = 0, [], [], []
        self._measure()

    def _measure(self) -> None:
        """Rows, and each dimension's exact sum, least and greatest number."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in batch.column("x"):
                    x = np.frombuffer(x.as_py(), np.int64).reshape(-1, width)
                    #: halves of 20 bits, so that no sum of a block leaves a long
                    low, high = x & 0xFFFFF, x >> 20
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), *(pa.array(v, pa.int64()) for v in (np.full(width, len(x)), low.sum(0), high.sum(0), x.min(0), x.max(0)))], names=["k", "n", "low", "high", "least", "most"])

        found = self.blocks.select("x").mapInArrow(run, "k int, n long, low long, high long, least long, most long").groupBy("k").agg(F.sum("n"), F.sum(F.col("low").cast("decimal(38,0)")), F.sum(F.col("high").cast("decimal(38,0)")), F.min("least"), F.max("most")).orderBy("k").collect()
        for _, n, low, high, least, most in found:  # a row a dimension
            self.n = n
            self.sums.append((int(high) << 20) + int(low))
            self.low.append(least)
            self.high.append(most)
        self.q = np.array([s // self.n for s in self.sums], np.int64)
        self.r = np.array([s % self.n for s in self.sums], np.int64)

    def widest_deviation(self) -> int:
        """No row's sum of squares of n * x - S is greater."""
        return sum(max(abs(self.n * a - s), abs(self.n * b - s)) ** 2 for a, b, s in zip(self.low, self.high, self.sums))

    def rows(self) -> Callable[[bytes], np.ndarray]:
        """Turns a block's bytes into centred rows."""
        width, q, rest = self.width, self.q, self.r / self.n
        return lambda x: (np.frombuffer(x, np.int64).reshape(-1, width) - q) - rest

    def total(self, of_block: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum over all blocks of `size` numbers that a function takes from a block of centred rows."""
        rows = self.rows()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(size)
            for batch in batches:
                for x in batch.column(0):
                    out += of_block(rows(x.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(out)], names=["k", "v"])

        out = np.zeros(size)
        for k, v in self.blocks.select("x").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v")).collect():  # a row a number
            out[k] = v
        return out


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """v without its parts along the basis, twice."""
    if basis:
        b = np.array(basis)
        for _ in range(2):
            v = v - b.T @ (b @ v)
    return v


def _any_other(basis: list[np.ndarray], width: int) -> np.ndarray:
    """A unit vector orthogonal to the basis: the axis that has most outside it, cleared of it."""
    b = np.array(basis).reshape(-1, width)
    v = _orthogonal(np.eye(width)[int(np.argmax(1 - (b * b).sum(0)))], basis)
    return v / np.linalg.norm(v)


def bidiagonalise(x: Centred, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """B, upper bidiagonal, and V with X V = U B for an orthonormal U that is not kept; V has all dimensions."""
    width = x.width
    start = np.random.default_rng(seed).standard_normal(width)
    v, vs, ws, zs = start / np.linalg.norm(start), [], [], []
    alphas, betas, greatest = [], [], 0.0
    while True:
        vs.append(v)
        w = np.array(ws).reshape(-1, width).T  # left vectors are the columns of X w
        k = w.shape[1]

        def first(rows: np.ndarray, v=v, w=w) -> np.ndarray:
            y = rows @ v
            return np.append((rows @ w).T @ y, y @ y)

        sums = x.total(first, k + 1)
        along, greatest = sums[:k], max(greatest, float(np.sqrt(sums[k])))
        rest = v - w @ along

        def second(rows: np.ndarray, rest=rest, w=w) -> np.ndarray:
            u = rows @ rest
            return np.concatenate([(rows @ w).T @ u, [u @ u], rows.T @ u])

        sums = x.total(second, k + 1 + width)
        again, square, z = sums[:k], sums[k] - sums[:k] @ sums[:k], sums[k + 1 :]
        alpha = float(np.sqrt(max(square, 0.0)))
        if alpha > NOTHING * greatest:
            ws.append((rest - w @ again) / alpha)
            z = (z - np.array(zs).reshape(-1, width).T @ again) / alpha
            zs.append(z)
            alphas.append(alpha)
            onward = _orthogonal(z - alpha * v, vs)
        else:  # X v lies in the space of the left vectors so far
            alphas.append(0.0)
            onward = np.zeros(width)
        if len(vs) == width:
            break
        beta = float(np.linalg.norm(onward))
        if beta > NOTHING * greatest:
            v = onward / beta
        else:
            beta, v = 0.0, _any_other(vs, width)
        betas.append(beta)
    return np.diag(alphas) + np.diag(betas, 1), np.array(vs).T


def whiten(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """id, component, n, deviation, whitened, explained and identity_error of every remaining row and component."""
    spark, id_type = table.sparkSession, table.schema[id_col].dataType
    vec = F.col(vec_col).cast("array<double>")
    whole = F.col(vec_col).isNotNull() & ~F.exists(vec, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = table.filter(F.coalesce(whole, F.lit(False))).select(F.col(id_col).alias("id"), vec.alias("vec"))
    sizes = sorted((n, size) for size, n in rows.groupBy(F.size("vec")).count().orderBy(F.col("count").desc()).limit(1000).collect() if size)
    schema = T.StructType([T.StructField(id_col, id_type)])
    for name, kind in (("component", "integer"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")):
        schema = schema.add(name, kind)
    if not sizes:
        return spark.createDataFrame([], schema)
    width = sizes[-1][1]
    x = Centred(materialize(_x_blocks(rows.filter(F.size("vec") == width), width, scale, shift, "id", "vec"), "blocks"), width)
    b, v = bidiagonalise(x)
    _, deviations, right = np.linalg.svd(b)
    some = deviations[:components] > NOTHING * max(deviations[0], 1e-300)
    if not some.any():
        return spark.createDataFrame([], schema)
    axes = (v @ right.T)[:, :components][:, some]
    axes *= np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    values = deviations[:components][some] ** 2 / x.n
    to_white, kept = axes / np.sqrt(values), axes.shape[1]

    sums = x.total(lambda r: np.append((r @ to_white).sum(0), (r * r).sum()), kept + 1)
    mean, trace = sums[:kept] / x.n, sums[kept] / x.n

    def gram(r: np.ndarray) -> np.ndarray:
        y = r @ to_white - mean
        return (y.T @ y).ravel()

    error = float(np.abs(x.total(gram, kept * kept).reshape(kept, kept) / x.n - np.eye(kept)).max())
    explained = values / trace
    wide = x.widest_deviation() >= 1 << 63
    if wide:
        schema["deviation"].dataType = T.DecimalType(38, 0)
    centred, n, q, rest = x.rows(), x.n, x.q, x.r

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, raw in zip(batch.column("ids"), batch.column("x")):
                raw, ids = raw.as_py(), ids.values
                size = len(ids)
                moved = np.frombuffer(raw, np.int64).reshape(size, -1) - q
                if wide:
                    found = pa.array([sum(d * d for d in (n * int(a) - int(c) for a, c in zip(row, rest))) for row in moved.tolist()], pa.decimal128(38, 0))
                else:
                    found = pa.array(((n * moved - rest) ** 2).sum(1))
                at = pa.array(np.repeat(np.arange(size), kept))
                cells = size * kept
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(at), pa.array(np.tile(np.arange(1, kept + 1), size), pa.int32()), pa.array(np.full(cells, n)), found.take(at),
                        pa.array((centred(raw) @ to_white).ravel()), pa.array(np.tile(explained, size)), pa.array(np.full(cells, error)),
                    ],
                    names=schema.names,
                )

    return x.blocks.select("ids", "x").mapInArrow(run, schema)


def op13_lanczos_whitening(spark, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
