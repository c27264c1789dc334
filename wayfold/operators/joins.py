"""Joins by time, distance, interval and place, as equi-joins on buckets with an exact test after."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geom import around, box_distance, wrap
from .folds import fold_columns
from .lineage import cut_lineage
from .pairing import nearest_place
from .scans import running


def _spread(rows: DataFrame) -> DataFrame:
    """Rows that were multiplied by an explode, of which Spark's estimate knows nothing: a join must not send them to all tasks by way of the driver."""
    return rows.hint("merge")


def asof(left: DataFrame, right: DataFrame, key: str, left_t: str, right_t: str, values: list[str], most: int | None = None) -> DataFrame:
    """Left rows with the values of the last right row at or before them (null if there is none).

    Both sides are put in one order of time per key, and the last right row is carried forward: one shuffle, whatever the
    sizes; keys of over `most` rows are split over tasks.
    """
    a = left.withColumns({"_t": F.col(left_t), "_side": F.lit(1), "_right": F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType)})
    b = right.select(key, F.col(right_t).alias("_t"), F.lit(0).alias("_side"), F.struct(*values).alias("_right"))
    both = running(a.unionByName(b, allowMissingColumns=True), [key], ["_t", "_side"], most, last={"_hit": F.col("_right")})
    return both.filter("_side = 1").select(*left.columns, *(F.col("_hit")[v].alias(v) for v in values))


def asof_nearest(left: DataFrame, right: DataFrame, key: str, left_t: str, right_t: str, values: list[str], tolerance: float | None = None, most: int | None = None) -> DataFrame:
    """Left rows with the values of the nearest right row in time, the earlier one on ties, within a tolerance."""
    row = F.struct(F.col(right_t).alias("_rt"), *values)
    a = left.withColumns({"_t": F.col(left_t), "_side": F.lit(1), "_right": F.lit(None).cast(right.select(row).schema[0].dataType)})
    b = right.select(key, F.col(right_t).alias("_t"), F.lit(0).alias("_side"), row.alias("_right"))
    both = running(a.unionByName(b, allowMissingColumns=True), [key], ["_t", "_side"], most, last={"_before": F.col("_right")}, first={"_after": F.col("_right")})
    late = F.col("_before").isNull() | (F.col("_after").isNotNull() & (F.col("_after._rt") - F.col("_t") < F.col("_t") - F.col("_before._rt")))
    picked = both.filter("_side = 1").withColumn("_hit", F.when(late, F.col("_after")).otherwise(F.col("_before")))
    near = F.lit(True) if tolerance is None else F.abs(F.col("_hit._rt") - F.col("_t")) <= tolerance
    return picked.select(*left.columns, *(F.when(near, F.col("_hit")[v]).alias(v) for v in values))


def interpolate(queries: DataFrame, samples: DataFrame, key: str, axis: str, values: list[str], angles: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """Queries (key, axis) with values of samples interpolated along the axis, clamped at both ends."""
    both, share = bracketed(queries, samples, key, axis, values, most)

    def at(v: str) -> Column:
        lo, hi = F.col("_lo")[v], F.col("_hi")[v]
        turn = wrap(hi - lo) if v in angles else hi - lo
        return F.when(lo.isNull(), hi).when(hi.isNull(), lo).otherwise(lo + turn * share).alias(v)

    return both.select(*queries.columns, *map(at, values))


def bracketed(queries: DataFrame, samples: DataFrame, key: str, axis: str, values: list[str], most: int | None = None) -> tuple[DataFrame, Column]:
    """Queries with the samples before (_lo) and behind (_hi) them, and how far they are from the one to the other."""
    row = F.struct(F.col(axis).alias("_a"), *values)
    a = queries.withColumns({"_side": F.lit(1), "_s": F.lit(None).cast(samples.select(row).schema[0].dataType)})
    b = samples.select(key, axis, F.lit(0).alias("_side"), row.alias("_s"))
    both = running(a.unionByName(b, allowMissingColumns=True), [key], [axis, "_side"], most, last={"_lo": F.col("_s")}, first={"_hi": F.col("_s")}).filter("_side = 1")
    span = F.col("_hi._a") - F.col("_lo._a")
    return both, F.when(span > 0, (F.col(axis) - F.col("_lo._a")) / span).otherwise(0.0)


def slerp(a: list[Column], b: list[Column], share: Column) -> list[Column]:
    """Spherical interpolation between two unit quaternions, the short way round."""
    dot = sum((x * y for x, y in zip(a[1:], b[1:])), a[0] * b[0])
    sign, near = F.when(dot < 0, -1.0).otherwise(1.0), F.least(F.abs(dot), F.lit(1.0))
    angle = F.acos(near)
    flat = angle < 1e-6
    wa = F.when(flat, 1 - share).otherwise(F.sin((1 - share) * angle) / F.sin(angle))
    wb = F.when(flat, share).otherwise(F.sin(share * angle) / F.sin(angle))
    return [wa * x + wb * sign * y for x, y in zip(a, b)]


def interpolate_poses(queries: DataFrame, samples: DataFrame, key: str, axis: str, place: list[str], turn: list[str], most: int | None = None) -> DataFrame:
    """Queries (key, axis) with places of samples interpolated and their quaternions (w, x, y, z) turned in between, held at both ends."""
    both, share = bracketed(queries, samples, key, axis, [*place, *turn], most)
    lo, hi = (lambda v: F.coalesce(F.col("_lo")[v], F.col("_hi")[v])), (lambda v: F.coalesce(F.col("_hi")[v], F.col("_lo")[v]))
    held = F.coalesce(share, F.lit(0.0))
    between = slerp([lo(v) for v in turn], [hi(v) for v in turn], held)
    return both.select(*queries.columns, *((lo(v) + (hi(v) - lo(v)) * held).alias(v) for v in place), *(q.alias(v) for q, v in zip(between, turn)))


def windows_around(frames: DataFrame, anchors: DataFrame, keys: list[str], frame: str, before: int, after: int) -> DataFrame:
    """Each anchor with the rows of its frames -before..after as steps 0..; one equi-join on (keys, frame)."""
    steps = F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("_k")
    wanted = anchors.select(*keys, F.col(frame).alias("anchor"), steps).select(*keys, "anchor", (F.col("_k") + before).alias("step"), (F.col("anchor") + F.col("_k")).alias(frame))
    return _spread(wanted).join(frames, [*keys, frame])


def interval_join(points: DataFrame, intervals: DataFrame, key: str, point: str, start: str, end: str, width: float) -> DataFrame:
    """Points with the intervals start <= point < end of their key: intervals are cut at buckets of a width, equi-joined, and tested."""
    cells = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))).alias("_cell")
    return points.withColumn("_cell", F.floor(F.col(point) / width)).join(_spread(intervals.filter(F.col(end) > F.col(start)).select("*", cells)), [key, "_cell"]).filter((F.col(start) <= F.col(point)) & (F.col(point) < F.col(end))).drop("_cell")


def covering(points: DataFrame, intervals: DataFrame, key: str, point: str, start: str, end: str) -> DataFrame:
    """Points with the intervals start <= point <= end of their key, whatever the intervals' lengths.

    An interval is placed in the one or two buckets of the least power of two that is no shorter than it; points ask a bucket of
    each power that occurs, of which there are some dozens at most.
    """
    level = F.ceil(F.log2(F.greatest(F.col(end) - F.col(start), F.lit(2.0**-20)).cast("double"))).cast("int")
    placed = intervals.filter(F.col(end) >= F.col(start)).withColumn("_level", level)
    levels = sorted(r["_level"] for r in placed.select("_level").distinct().collect())  # at most one for each exponent of a double
    size = F.pow(F.lit(2.0), F.col("_level"))
    cut = placed.withColumn("_cell", F.explode(F.array_distinct(F.array(F.floor(F.col(start) / size), F.floor(F.col(end) / size)))))
    asked = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_cell", F.floor(F.col(point) / size))
    return _spread(asked).join(_spread(cut), [key, "_level", "_cell"]).filter((F.col(start) <= F.col(point)) & (F.col(point) <= F.col(end))).drop("_level", "_cell")


def contained(inner: DataFrame, outer: DataFrame, key: str, a: str, b: str, start: str, end: str) -> DataFrame:
    """Inner intervals [a, b] that lie in an outer [start, end) of their key."""
    return covering(inner, outer, key, a, start, end).filter((F.col(a) < F.col(end)) & (F.col(b) < F.col(end)))


def near_boxes(points: DataFrame, boxes: DataFrame, keys: list[str], cell: float, grow: float = 0.0) -> DataFrame:
    """Point and box rows with gap <= grow: boxes are laid over grid cells, joined by cell, and tested exactly."""
    half = F.hypot("length", "width") / 2 + grow
    lo = lambda c: F.floor((F.col(c) - half) / cell)
    hi = lambda c: F.floor((F.col(c) + half) / cell)
    laid = boxes.withColumn("_i", F.explode(F.sequence(lo("cx"), hi("cx")))).withColumn("_j", F.explode(F.sequence(lo("cy"), hi("cy"))))
    placed = points.withColumns({"_i": F.floor(F.col("px") / cell), "_j": F.floor(F.col("py") / cell)})
    gap = box_distance(F.col("px"), F.col("py"), F.col("cx"), F.col("cy"), F.col("heading"), F.col("length"), F.col("width"))
    return placed.join(_spread(laid), [*keys, "_i", "_j"]).withColumn("gap", gap).filter(F.col("gap") <= grow).drop("_i", "_j")


def held_points(points: DataFrame, boxes: DataFrame, keys: list[str], cell: float, grow: float, *found: Column) -> DataFrame:
    """Points with what is found, aggregates of the boxes within grow of them; only those that have a box.

    Boxes are met by distinct places (keys, px, py), of which there are fewer than points where these lie on a grid.
    """
    places = points.select(*keys, "px", "py").distinct()
    return points.join(near_boxes(places, boxes, keys, cell, grow).groupBy(*keys, "px", "py").agg(*found), [*keys, "px", "py"])


def label_points(points: DataFrame, boxes: DataFrame, keys: list[str], cell: float, grow: float, id_col: str, ground: str) -> DataFrame:
    """Adds label and box to points (keys, id, px, py, ground flag): ground points stay ground; others are dynamic where a moving box (keys, box, moving, ...) holds them, else static.

    box: the last one that holds the point; null outside all boxes and on the ground.
    """
    above = points.filter(~F.coalesce(F.col(ground), F.lit(False)))
    found = held_points(above.select(*keys, id_col, "px", "py"), boxes, keys, cell, grow, F.max("box").alias("box"), F.bool_or("moving").alias("_moving"))
    held = found.groupBy(id_col).agg(F.max("box").alias("box"), F.bool_or("_moving").alias("_moving"))
    label = F.when(F.coalesce(F.col(ground), F.lit(False)), "ground").when(F.col("_moving"), "dynamic").otherwise("static")
    return points.join(held, id_col, "left").withColumn("label", label).drop("_moving")


def cut_cells(cells: DataFrame, boxes: DataFrame, keys: list[str], size: float, grow: float) -> DataFrame:
    """Cells (keys, ix, iy) whose centre lies in none of the grown boxes of their keys."""
    centres = cells.withColumns({"px": (F.col("ix") + 0.5) * size, "py": (F.col("iy") + 0.5) * size})
    covered = near_boxes(centres.select(*keys, "ix", "iy", "px", "py"), boxes, keys, size, grow).select(*keys, "ix", "iy").distinct()
    return cells.join(covered, [*keys, "ix", "iy"], "left_anti")


def outside_boxes(points: DataFrame, boxes: DataFrame, keys: list[str], cell: float, grow: float, id_col: str) -> DataFrame:
    """Points in none of the grown boxes."""
    return points.join(held_points(points.select(*keys, id_col, "px", "py"), boxes, keys, cell, grow, F.count("*").alias("_n")).select(id_col).distinct(), id_col, "left_anti")


def within_radius(a: DataFrame, b: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """Pairs of (px, py) of a and (qx, qy) of b at most radius apart: a looks into the nine cells around it."""
    look = a.withColumn("_i", around(F.floor(F.col("px") / radius), 1)).withColumn("_j", around(F.floor(F.col("py") / radius), 1))
    placed = b.withColumns({"_i": F.floor(F.col("qx") / radius), "_j": F.floor(F.col("qy") / radius)})
    return _spread(look).join(placed, [*keys, "_i", "_j"]).drop("_i", "_j").withColumn("dist", F.hypot(F.col("px") - F.col("qx"), F.col("py") - F.col("qy"))).filter(F.col("dist") <= radius)


def close_pairs(rows: DataFrame, keys: list[str], id_col: str, radius: float, block: int = 256) -> DataFrame:
    """(keys, a, b, dist): ids a < b of rows (keys, id, x, y) at most radius apart.

    Rows of a cell are put into blocks of at most `block` rows in order of x, and blocks are joined, not rows: a block looks into its
    own cell and four of the eight around it, the others look into its, so that a pair is met once.  Blocks too far apart by their
    bounds are left; of the others all rows are met, one after the other, and their squares tell who is near, and the distance
    does only where these are about the radius's.  Cells are a trifle wider than the radius, for pairs that are in reach by rounding.
    """
    size, reach = radius * (1 + 1e-9), radius * radius * (1 + 1e-9)
    cells = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))))
    at = [F.floor(F.col(c) / size) for c in ("x", "y")]
    met = rows.filter(F.col("x") / 2 + F.col("y") / 2 < math.inf)  # neither null nor NaN, which are near to nothing
    placed = met.select(*keys, at[0].alias("_i"), at[1].alias("_j"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col(id_col).alias("_id"))
    cell = [*keys, "_i", "_j"]
    number = F.row_number().over(Window.partitionBy(*cell).orderBy("_x", "_y", "_id"))
    ends = F.struct(*(f(c).alias(f"{c}{k}") for c in ("_x", "_y") for k, f in enumerate((F.min, F.max))))
    blocks = placed.withColumn("_n", F.floor((number - 1) / block)).groupBy(*cell, "_n").agg(ends.alias("_ends"), F.collect_list(F.struct("_id", "_x", "_y")).alias("_rows"))
    blocks = cut_lineage(blocks, "blocks")
    b = blocks.select(*cell, F.col("_n").alias("_m"), F.col("_ends").alias("_q"), F.col("_rows").alias("_bs"))
    a = blocks.select(*keys, F.col("_i").alias("_u"), F.col("_j").alias("_v"), "_n", F.col("_ends").alias("_p"), F.col("_rows").alias("_as"), F.explode(cells).alias("_c"))
    a = a.select(*keys, F.try_add("_u", "_c.i").alias("_i"), F.try_add("_v", "_c.j").alias("_j"), "_n", "_p", "_as", ((F.col("_c.i") == 0) & (F.col("_c.j") == 0)).alias("_own"))
    gap = [F.greatest(F.col(f"_q._{c}0") - F.col(f"_p._{c}1"), F.col(f"_p._{c}0") - F.col(f"_q._{c}1"), F.lit(0.0)) for c in "xy"]
    once = ~F.col("_own") | (F.col("_n") <= F.col("_m"))
    both = _spread(a).join(b, cell).filter(once & (gap[0] * gap[0] + gap[1] * gap[1] <= reach))
    both = both.select(*keys, (F.col("_own") & (F.col("_n") == F.col("_m"))).alias("_same"), "_as", "_bs")
    both = both.select(*keys, "_same", "_bs", F.inline("_as").alias("_a", "_px", "_py")).select(*keys, "_same", "_a", "_px", "_py", F.inline("_bs").alias("_b", "_qx", "_qy"))
    dx, dy = F.col("_px") - F.col("_qx"), F.col("_py") - F.col("_qy")
    once = (F.col("_a") < F.col("_b")) | (~F.col("_same") & (F.col("_a") > F.col("_b")))
    square = dx * dx + dy * dy
    near = both.filter((square <= reach) & once & ((square <= radius * radius * (1 - 1e-9)) | (F.hypot(dx, dy) <= radius)))
    return near.select(*keys, F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), F.hypot(dx, dy).alias("dist"))


def nearest(rows: DataFrame, others: DataFrame, keys: list[str], limit: float, levels: int) -> DataFrame:
    """Rows (keys, id, x, y, hit) with hit, the (d, id) of the nearest of others within the limit, where it is null; the lesser id on ties.

    Rows look into the nine cells around them, the smallest cells first: what is found no further than a cell's width is the
    nearest, and only rows without it look into cells of twice the width.  So a row meets a few others however dense they lie.
    """
    for level in range(levels, -1, -1):
        size = limit / 2**level
        cell = lambda c, k=0: (F.floor(F.col(c) / size) + k).cast("long")  # noqa: E731, B023
        nine = F.array(*(F.struct(cell("x", i).alias("i"), cell("y", j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
        found = F.array(F.struct(F.hash("id").cast("long").alias("i"), F.lit(None).cast("long").alias("j")))  # meets nothing
        look = rows.withColumn("_c", F.explode(F.when(F.col("hit").isNull(), nine).otherwise(found)))
        look = look.select(*rows.columns, F.col("_c.i").alias("_i"), F.col("_c.j").alias("_j"))
        placed = others.select(*keys, cell("x").alias("_i"), cell("y").alias("_j"), F.struct(F.col("x").alias("x"), F.col("y").alias("y"), F.col("id").alias("id")).alias("_o"))
        d = F.hypot(F.col("x") - F.col("_o.x"), F.col("y") - F.col("_o.y"))
        near = F.min(F.when(d <= size, F.struct(d.alias("d"), F.col("_o.id").alias("id"))))
        met = _spread(look).join(placed, [*keys, "_i", "_j"], "left").groupBy(*(c for c in rows.columns if c != "hit"))
        rows = met.agg(F.coalesce(F.first("hit", ignorenulls=True), near).alias("hit")).select(*rows.columns)
    return rows


#: Frames that are gone through as one piece, and how many reaches wide a piece is.
FRAMES_OF_PIECE, REACHES_OF_PIECE = 16, 8


def link_frames(rows: DataFrame, key: str, gate: float, max_gap: int = 1) -> DataFrame:
    """(key, f, id, next_f, next_id, d): mutual nearest neighbours within a gate per frame step, at most max_gap frames ahead.

    Greedy and local where an optimal assignment would weigh contested cases against each other.  Rows look for their nearest in
    the next frame, those without one in the frame after it, and so on; of rows at one place only that of the least id can
    be anyone's nearest, so the others take no part.

    Rows are dealt once, to pieces of the plane and of the frames, with those around that what lies in a piece depends on: what is a
    row's nearest, and whose nearest that one is.  A task holds max_gap + 1 frames of a piece and looks in cells that fit the crowd.
    """
    reach = gate * max_gap
    side, margin = REACHES_OF_PIECE * reach, 2.001 * reach
    cell = lambda c, by=0.0: F.floor((F.col(c) + by) / side)
    piece = lambda by: F.floor((F.col("f") + by) / FRAMES_OF_PIECE)
    each = lambda low, high: F.explode(F.array_distinct(F.array(low, high)))
    known = rows.filter(F.col(key).isNotNull() & F.col("f").isNotNull() & (F.abs("x") < math.inf) & (F.abs("y") < math.inf))
    dealt = known.select(key, "f", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "id")
    #: a piece without a row of its own gives nothing, but rows cannot tell; those around it go there in vain
    dealt = dealt.withColumn("_i", each(cell("x", -margin), cell("x", margin))).withColumn("_j", each(cell("y", -margin), cell("y", margin)))
    dealt = dealt.withColumn("_p", each(piece(-max_gap), piece(max_gap))).withColumn("_own", (cell("x") == F.col("_i")) & (cell("y") == F.col("_j")) & (piece(0) == F.col("_p")))
    kind = {c: rows.schema[c].dataType for c in (key, "f", "id")}
    schema = T.StructType([T.StructField(n, t) for n, t in ((key, kind[key]), ("f", kind["f"]), ("id", kind["id"]), ("next_f", kind["f"]), ("next_id", kind["id"]), ("d", T.DoubleType()))])

    def step(state: list[dict], batch: pa.RecordBatch) -> tuple[list[dict], pa.RecordBatch]:
        x, y = (batch.column(c).to_numpy() for c in "xy")
        first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])  # rows come in order of place and id
        ids, frame = batch.column("id").take(pa.array(first)), batch.column("f")[0].as_py()
        by = np.asarray(pc.array_sort_indices(ids))
        first, ids, n = first[by], ids.take(pa.array(by)), len(by)
        now = {"f": frame, "x": x[first], "y": y[first], "ids": ids, "own": np.asarray(batch.column("_own").to_numpy(zero_copy_only=False), bool)[first], "open": np.arange(n)}
        came, gap, out = np.full(n, -1, np.int64), np.zeros(n, np.int64), []
        state = [s for s in state if frame - s["f"] <= max_gap]
        for s in reversed(state):  # the frame before this one first
            k, alone = frame - s["f"], np.flatnonzero(came < 0)
            hit, _ = nearest_place(now["x"][alone], now["y"][alone], s["x"], s["y"], gate * k)
            came[alone], gap[alone] = hit, np.where(hit >= 0, k, 0)
        for s in state:
            k, alone = frame - s["f"], s["open"]
            hit, far = nearest_place(s["x"][alone], s["y"][alone], now["x"], now["y"], gate * k)
            found = np.flatnonzero(hit >= 0)
            a, b, d = alone[found], hit[found], far[found]
            both = np.flatnonzero((came[b] == a) & (gap[b] == k) & s["own"][a])
            a, b, d, s["open"] = a[both], b[both], d[both], alone[hit < 0]
            out.append((s["f"], s["ids"].take(pa.array(a)), ids.take(pa.array(b)), d))
        f = batch.column("f").type
        columns = [
            pa.array([batch.column(key)[0].as_py()] * sum(len(d) for *_, d in out), batch.column(key).type), pa.array([g for g, *_, d in out for _ in range(len(d))], f), pa.concat_arrays([ids.slice(0, 0), *(o[1] for o in out)]),
            pa.array([frame] * sum(len(d) for *_, d in out), f), pa.concat_arrays([ids.slice(0, 0), *(o[2] for o in out)]), pa.array(np.concatenate([np.zeros(0), *(o[3] for o in out)])),
        ]
        return [*state, now], pa.RecordBatch.from_arrays(columns, names=schema.names)

    return fold_columns(dealt, [key, "_i", "_j", "_p"], "f", list, step, schema, ["x", "y", "id"])


def unambiguous_ids(rows: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Ids that occur more than once in a frame become null."""
    return rows.withColumn(id_col, F.when(F.count("*").over(Window.partitionBy(*keys, id_col)) == 1, F.col(id_col)))


def other_recording(rows: DataFrame, order: list[str], recording: str, group: str) -> DataFrame:
    """Adds other: the first row id of the next recording in order, the first recording's after the last; within a group."""
    first = rows.groupBy(group, recording).agg(F.min_by("id", F.struct(*order)).alias("first_id"), F.min(F.struct(*order)).alias("_at"))
    w = Window.partitionBy(group).orderBy("_at")
    following = first.withColumn("other", F.coalesce(F.lead("first_id").over(w), F.first("first_id").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    return rows.join(following.select(group, recording, "other"), [group, recording])


def in_polygons(points: DataFrame, polygons: DataFrame, key: str) -> DataFrame:
    """Points (px, py) that lie in a polygon (array of x, y) of their key, by crossing number."""
    n = F.size("poly")
    crosses = lambda i: (F.col("poly")[i]["y"] > F.col("py")) != (F.col("poly")[F.pmod(i + 1, n)]["y"] > F.col("py"))
    at_x = lambda i: F.col("poly")[i]["x"] + (F.col("py") - F.col("poly")[i]["y"]) * (F.col("poly")[F.pmod(i + 1, n)]["x"] - F.col("poly")[i]["x"]) / (F.col("poly")[F.pmod(i + 1, n)]["y"] - F.col("poly")[i]["y"])
    hits = F.size(F.filter(F.sequence(F.lit(0), n - 1), lambda i: crosses(i) & (F.col("px") < at_x(i))))
    return points.join(polygons, key).filter(hits % 2 == 1)
