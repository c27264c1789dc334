"""Exact search for vectors of a group with a cosine over a limit.

Angles between vectors keep the triangle inequality.  Each group gets pivots, some of its own vectors; a vector's home is the
cell of its nearest pivot.  A vector within angle w of one in another cell is at most 2 w nearer to its own pivot than to that cell's,
and at most w beyond that cell's radius; so each vector also goes, as a guest, to the cells for which both hold, and to no other.
Cells are cut into blocks of some hundred vectors, and pairs of blocks are compared by a product of matrices.  So no task holds a
cell, and what is compared is what lies near in angle.  Of equal vectors one is searched for.

Where vectors are spread evenly in many dimensions all angles are much alike and cells can't be told apart: then nearly all blocks
meet, still in bounded tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import cut_lineage

#: Vectors of a block, of a cell in the mean, and pivots in all, which are what goes to every task.
BLOCK, CELL, MOST_PIVOTS = 512, 2048, 4096
#: Angles are compared with this much room for rounding.
ROOM = 1e-6


def _pivots(rows: DataFrame, group: list[str]) -> dict[tuple, np.ndarray]:
    """Unit vectors of each group that cells are made around: MOST_PIVOTS in all, but one for each group."""
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    share = min(1 / CELL, MOST_PIVOTS / max(1, total))
    few = sizes.withColumn("k", F.greatest(F.lit(1), F.ceil(F.col("n") * share))).filter("k > 1")
    order = F.xxhash64("id", F.lit("pivot"))
    #: of each group somewhat more than the pivots, by hash, then the first of these
    some = rows.join(few, group).filter(F.pmod(order, F.lit(1 << 30)) < (F.lit(1 << 30) * F.least(F.lit(1.0), (2 * F.col("k") + 20) / F.col("n"))))
    out: dict[tuple, list] = {}
    for r in some.select(*group, "k", "embedding").orderBy(*group, F.xxhash64("id", F.lit("pivot"))).collect():  # about twice MOST_PIVOTS and 20 a group
        held = out.setdefault(tuple(r[g] for g in group), [])
        if len(held) < r["k"]:
            held.append(r["embedding"])
    return {g: _unit(np.array(v, float)) for g, v in out.items()}


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(x) @ pivots.T, -1, 1))


def _placed(rows: DataFrame, group: list[str], pivots: dict, width: float | None, radii: dict | None) -> DataFrame:
    """Rows with cell and guest; with a width and radii also where they are guests, else with their angle from home."""
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("guest", T.BooleanType()), T.StructField("angle", T.DoubleType())])
    shared = rows.sparkSession.sparkContext.broadcast((pivots, radii))  # MOST_PIVOTS vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, radii = shared.value
        for batch in batches:
            at, cells, guests, angles = [], [], [], []
            groups: dict[tuple, list[int]] = {}
            for k, g in enumerate(zip(*(batch.column(c).to_pylist() for c in group)) if group else [()] * batch.num_rows):
                groups.setdefault(g, []).append(k)
            vectors = batch.column("embedding")
            for g, places in groups.items():
                near = pivots.get(g)
                if near is None:  # one cell
                    at += places
                    cells += [0] * len(places)
                    guests += [False] * len(places)
                    angles += [0.0] * len(places)
                    continue
                far = _angles(np.array(vectors.take(pa.array(places)).to_pylist(), float), near)
                home = far.argmin(axis=1)
                own = far[np.arange(len(places)), home]
                at += places
                cells += home.tolist()
                guests += [False] * len(places)
                angles += own.tolist()
                if width is not None:
                    reach = np.array([radii.get((g, c), -1.0) for c in range(len(near))])
                    visits = (far - own[:, None] <= 2 * width + ROOM) & (far <= reach[None] + width + ROOM) & (reach[None] >= 0)
                    visits[np.arange(len(places)), home] = False
                    who, where = np.nonzero(visits)
                    at += [places[w] for w in who.tolist()]
                    cells += where.tolist()
                    guests += [True] * len(who)
                    angles += far[who, where].tolist()
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cells, pa.int32()), pa.array(guests, pa.bool_()), pa.array(angles, pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def near_pairs(left: DataFrame, right: DataFrame, group: list[str], limit: float, some: bool = False) -> DataFrame:
    """(group, a, b, rank_a, rank_b) of rows (group, id, rank, embedding) of both sides with a cosine over the limit.

    With some, only (group, a) of the left rows that have such a right row.  Vectors are taken as they are where they have unit length,
    and by their direction else; null ones match none.
    """
    columns = [*group, "id", "rank", "embedding"]
    clean = lambda d, s: d.filter(F.col("embedding").isNotNull()).select(*columns[:-1], F.col("embedding").cast("array<double>").alias("embedding"), F.lit(s).alias("side"))
    rows = cut_lineage(clean(left, 0).union(clean(right, 1)), "vectors")
    width = math.acos(max(-1.0, min(1.0, limit)))
    homes = rows.filter("side = 1")
    pivots = _pivots(homes, group)
    radii = {}
    if pivots:
        placed = _placed(homes, group, pivots, None, None)
        radii = {(tuple(r[g] for g in group), r["cell"]): r["radius"] for r in placed.groupBy(*group, "cell").agg(F.max("angle").alias("radius")).collect()}  # a row a pivot
    placed = _placed(homes, group, pivots, None, None).unionByName(_placed(rows.filter("side = 0"), group, pivots, width, radii))
    placed = cut_lineage(placed.drop("angle", "guest"), "placed")
    sizes = placed.groupBy(*group, "cell").agg(*(F.greatest(F.lit(1), F.ceil(F.count_if(F.col("side") == s) / BLOCK)).cast("int").alias(f"blocks{s}") for s in (0, 1)), F.count_if(F.col("side") == 0).alias("lefts"), F.count_if(F.col("side") == 1).alias("rights"))
    dealt = placed.join(sizes.filter("lefts > 0 and rights > 0"), [*group, "cell"])

    def blocks(side: int) -> DataFrame:
        """Blocks of a side with each block of the other that they meet."""
        mine = dealt.filter(F.col("side") == side).withColumn(f"b{side}", F.pmod(F.xxhash64("id"), F.col(f"blocks{side}").cast("long")).cast("int"))
        held = mine.groupBy(*group, "cell", f"b{side}").agg(F.first(f"blocks{1 - side}").alias("others"), F.collect_list(F.struct("id", "rank", "embedding")).alias(f"rows{side}"))
        return held.select(*group, "cell", f"b{side}", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias(f"b{1 - side}"), f"rows{side}")

    met = blocks(0).join(blocks(1), [*group, "cell", "b0", "b1"]).select(*group, "rows0", "rows1")
    kinds = {c: left.schema[c].dataType for c in columns[:-1]}
    fields = [T.StructField(g, kinds[g]) for g in group] + [T.StructField("a", kinds["id"])]
    if not some:
        fields += [T.StructField("b", kinds["id"]), T.StructField("rank_a", kinds["rank"]), T.StructField("rank_b", kinds["rank"])]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one, other = (batch.column(c)[k].values for c in ("rows0", "rows1"))
                vectors = [np.array(x.field("embedding").to_pylist(), float) for x in (one, other)]
                cosine = _scaled(vectors[0]) @ _scaled(vectors[1]).T
                at, to = np.nonzero(cosine > limit)
                if some:
                    at = np.unique(at)
                names = [batch.column(g).take(pa.array([k] * len(at), pa.int64())) for g in group]
                found = [one.field("id").take(pa.array(at))]
                if not some:
                    found += [other.field("id").take(pa.array(to)), one.field("rank").take(pa.array(at)), other.field("rank").take(pa.array(to))]
                yield pa.RecordBatch.from_arrays([*names, *found], names=schema.names)

    out = met.mapInArrow(run, schema)
    return out.distinct() if some else out


def _scaled(x: np.ndarray) -> np.ndarray:
    """Unit vectors as they are (so that products equal plain dot products), others by their direction."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(np.abs(size - 1) < 1e-3, x, x / np.maximum(size, 1e-300))
