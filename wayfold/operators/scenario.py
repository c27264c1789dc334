"""Scenario rows: types, validity, layouts, features and targets, and the composite jobs that make and score them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geom import finite, from_frame, to_frame, wrap
from . import collision, joins, kinematics, metrics, segments
from .lineage import cut_lineage

#: Coarse type of known categories, occlusion codes.
TYPES = {
    "PEDESTRIAN": ["Pedestrian"],
    "CYCLE": ["Bike", "Scooter", "Motorcycle", "Skateboard", "Segway"],
    "VEHICLE": ["Car", "Service Vehicle", "Pickup Truck", "Utility Vehicle", "Delivery Truck", "Bus"],
    "OTHER_MOVABLE": ["Cart", "Horse"],
}
OCCLUSION = {"None": 0, "Light": 1, "Medium": 2, "Heavy": 3, "Full": 4, "Unknown": 5}
CURRENT, STEPS = 10, 21
#: Frames of a segment that are put into windows as one piece.
WINDOW_FRAMES = 1024


def coarse_type(category: Column, default: str = "STATIC") -> Column:
    return F.coalesce(*(F.when(category.isin(names), F.lit(kind)) for kind, names in TYPES.items()), F.lit(default))


def occlusion_code(text: Column) -> Column:
    return F.coalesce(*(F.when(text == k, F.lit(v)) for k, v in OCCLUSION.items()), F.lit(5))


def sane_boxes(obs: DataFrame, reach: float = 150.0, largest: float = 40.0) -> DataFrame:
    """Boxes with finite places within reach and sensible sizes."""
    numbers = [finite(F.col(c)).isNotNull() for c in ("x", "y", "z")]
    sizes = [(F.col(c) > 0) & (F.col(c) < largest) for c in ("length", "width", "height")]
    ok = F.hypot("x", "y") < reach
    for c in (*numbers, *sizes):
        ok = ok & c
    return obs.filter(ok)


def box_centre(z_bottom: Column, height: Column) -> Column:
    return z_bottom + height / 2


def future_layout(tracks: Column) -> Column:
    """Tracks of 21 steps cut to the current and future ones; shorter ones are so already."""
    return F.transform(tracks, lambda s: F.when(F.size(s) == STEPS, F.slice(s, CURRENT + 1, STEPS - CURRENT)).otherwise(s))


def from_layouts(tracks: Column, future_tracks: Column) -> Column:
    return F.coalesce(future_tracks, future_layout(tracks))


def camera_height(dataset: Column, height: Column, known: list[str]) -> tuple[Column, Column]:
    """Height and where it is from: the dataset or a simulator; null and unknown otherwise."""
    ok = dataset.isin(known) & finite(height).isNotNull()
    return F.when(ok, height), F.when(ok, F.when(dataset == "simulated", "simulator").otherwise("dataset")).otherwise("unknown")


def kinematic_features(history: Column, goal_x: Column, goal_y: Column, vx: Column, vy: Column, language: Column) -> Column:
    """History positions, goal (0, 0 if it is only named in words) and velocity as one vector."""
    flat = F.flatten(F.transform(history, lambda p: F.array(p["x"], p["y"])))
    zero = F.lit(0.0)
    return F.concat(flat, F.array(F.when(language, zero).otherwise(goal_x), F.when(language, zero).otherwise(goal_y), vx, vy))


def residual_targets(future: Column, vx: Column, vy: Column, dt: float, scale: float = 1.0) -> Column:
    """Future positions less those at constant velocity, over a scale."""
    return F.transform(future, lambda p, k: F.struct(((p["x"] - vx * (k + 1) * dt) / scale).alias("x"), ((p["y"] - vy * (k + 1) * dt) / scale).alias("y")))


def predicted_tracks(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tracks present now or later, tracks to predict: movable, no operator, valid now and in a later step)."""
    seen = obs.groupBy("scenario", "track").agg(F.bool_or(F.col("step") >= CURRENT).alias("later"), F.bool_or(F.col("step") == CURRENT).alias("now"), F.bool_or(F.col("step") > CURRENT).alias("after"), F.bool_or("is_stationary").alias("still"), F.bool_or("is_operator").alias("op"))
    kept = seen.filter("later")
    return obs.join(kept.select("scenario", "track"), ["scenario", "track"], "left_semi"), kept.filter("now and after and not still and not op").select("scenario", "track")


def valid_candidates(c: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows for which every rule holds; a rule over missing columns is false."""
    ok = F.lit(True)
    for rule in rules.values():
        ok = ok & F.coalesce(rule, F.lit(False))
    return c.filter(ok)


def reviewed_environment(c: DataFrame, drops: DataFrame, recording_drops: DataFrame, reviewed: DataFrame, threshold: float) -> DataFrame:
    """Environment by the first that holds: dropped, recording dropped, reviewed label, estimate beyond a threshold."""
    out = c.join(drops.select("id", F.lit(True).alias("_d")), "id", "left").join(recording_drops.select("recording", F.lit(True).alias("_r")), "recording", "left").join(reviewed.select("id", F.col("label").alias("_l")), "id", "left")
    env = F.when(F.col("_d") | F.col("_r"), None).when(F.col("_l").isNotNull(), F.col("_l")).when(F.col("indoor") >= threshold, "indoor").when(F.col("indoor") <= 1 - threshold, "outdoor")
    return out.withColumn("environment", env).drop("_d", "_r", "_l")


def reverses(x_end: Column, turn: Column) -> Column:
    """Whether a path goes backwards: it ends behind without turning round."""
    return (x_end < -0.5) & (F.abs(turn) < 1.0)


def scenario_windows(rows: DataFrame, segment: str, stride: int, min_travel: float) -> DataFrame:
    """Windows of 21 steps around every stride-th frame of a segment, complete and with enough travel, in the frame of the current step.

    rows: (segment, f, t, x, y, yaw). Returns (segment, anchor, step, t, x, y, yaw).
    """
    anchors = rows.filter(F.col("f") % stride == 0)
    window = joins.windows_around(rows, anchors, [segment], "f", CURRENT, CURRENT)
    w = Window.partitionBy(segment, "anchor").orderBy("step")
    hop = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    whole = Window.partitionBy(segment, "anchor")
    full = window.withColumn("hop", hop).withColumns({"n": F.count("*").over(whole), "travel": F.sum("hop").over(whole)}).filter((F.col("n") == STEPS) & (F.col("travel") >= min_travel))
    now = full.withColumns({f"{c}0": F.max(F.when(F.col("step") == CURRENT, F.col(c))).over(whole) for c in ("x", "y", "yaw")})
    ahead, left = to_frame(F.col("x0"), F.col("y0"), F.col("yaw0"), F.col("x"), F.col("y"))
    return now.select(segment, "anchor", "step", "t", ahead.alias("x"), left.alias("y"), wrap(F.col("yaw") - F.col("yaw0")).alias("yaw"))


def at_rates(rows: DataFrame, segment: str, configs: dict[str, int]) -> DataFrame:
    """Rows of several rates from one pass: every so many frames, numbered anew in each."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("config"), F.lit(every).alias("every")) for name, every in configs.items()))).alias("c")
    out = rows.select("*", each).select(*rows.columns, "c.*").filter(F.col("f") % F.col("every") == 0)
    return out.withColumn("f", F.floor(F.col("f") / F.col("every"))).withColumn(segment, F.concat_ws("@", F.col(segment).cast("string"), "config"))


def recordings_to_episodes(poses: DataFrame, key: str, max_step: float, max_gap_s: float, min_frames: int, min_length: float, split: Column, clock: str = "t") -> tuple[DataFrame, DataFrame]:
    """(frames, episodes) of pose recordings: cut, measured, with frames numbered from 0 in each episode and a split by recording.

    clock: the column in whose unit a gap is measured.
    """
    cut = segments.cut_episodes(poses, key, max_step, max_gap_s, clock=clock)
    stats = segments.episode_stats(cut, key, min_frames, min_length).withColumn("split", split)
    name = F.concat_ws("_", F.col(key).cast("string"), F.col("episode").cast("string"))
    w = Window.partitionBy(key, "episode").orderBy("f")
    frames = cut.join(stats.select(key, "episode", "t0"), [key, "episode"]).select(name.alias("episode_id"), (F.row_number().over(w) - 1).alias("frame_index"), F.col("f").alias("source_frame"), (F.col("t") - F.col("t0")).alias("timestamp"), "x", "y")
    return frames, stats.withColumn("episode_id", name)


def tracks_from_detections(rows: DataFrame, key: str, gate: float, max_gap: int, min_hits: int, min_travel: float) -> DataFrame:
    """Detections (key, f, id, x, y) linked from frame to frame into tracks; short and standing ones go."""
    from .components import components

    links = joins.link_frames(rows, key, gate, max_gap)
    tracked = components(links.select(F.col("id").alias("a"), F.col("next_id").alias("b"))).select(F.col("node").alias("id"), F.col("root").alias("track"))
    out = kinematics.with_hops(rows.join(tracked, "id"), "track")
    return out.groupBy(key, "track").agg(F.count("*").alias("hits"), F.sum("hop").alias("travel"), F.min("f").alias("f0"), F.max("f").alias("f1")).filter((F.col("hits") >= min_hits) & (F.col("travel") >= min_travel))


def score_predictions(pred: DataFrame, ego: DataFrame, obs: DataFrame, goals: DataFrame, n_sub: int, rate: float, speed: float, keep_missing: bool) -> DataFrame:
    """Predicted paths followed at a speed, scored for collision, progress and wiggle; missing scenarios fail or are left out.

    pred: (scenario, f, x, y) with f = 0 the start.
    """
    steps = metrics.timed(pred, "scenario", rate, speed, 10).select("scenario", F.col("k").alias("step"), "x", "y")
    path = steps.unionByName(ego.filter("step = 0").join(pred.select("scenario").distinct(), "scenario", "left_semi").select("scenario", F.lit(0).alias("step"), "x", "y"))
    verdicts = collision.verdict(path, ego, obs, n_sub, rate)
    ends = path.groupBy("scenario").agg(F.max_by("x", "step").alias("x"), F.max_by("y", "step").alias("y"))
    w = Window.partitionBy("scenario").orderBy("step")
    went = path.withColumn("hop", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))).groupBy("scenario").agg(F.sum("hop").alias("travelled"))
    scored = metrics.success(metrics.progress(verdicts.join(ends, "scenario").join(went, "scenario").join(goals, "scenario"), speed, 10 / rate))
    scored = scored.join(metrics.wiggle(pred, "scenario"), "scenario", "left")
    every = ego.select("scenario").distinct()
    return every.join(scored, "scenario", "left").withColumn("success", F.coalesce("success", F.lit(False))) if keep_missing else scored


def nested_windows(rows: DataFrame, segment: str, stride: int, min_travel: float, rate_hz: float) -> DataFrame:
    """Scenarios as rows: (segment, anchor, rate_hz, world, steps), steps in the frame of the current one and world the way back.

    rows: (segment, f, t, x, y, yaw).  steps: array of (step, f, t, x, y, yaw); world: the current pose (x, y, yaw).
    Rows are shuffled once, by pieces of a segment with the frames around; a window is put together where its frames lie, so
    its steps are never rows of a shuffle.
    """
    near = lambda by: F.floor((F.col("f") + by) / WINDOW_FRAMES)
    known = rows.filter(F.col(segment).isNotNull() & F.col("f").isNotNull()).select(segment, "f", "t", "x", "y", "yaw")
    laid = known.withColumn("_piece", F.explode(F.array_distinct(F.array(near(-CURRENT), near(STEPS - 1 - CURRENT)))))
    around = Window.partitionBy(segment, "_piece").orderBy("f").rangeBetween(-CURRENT, STEPS - 1 - CURRENT)
    window = laid.withColumn("_w", F.collect_list(F.struct("f", "t", "x", "y", "yaw")).over(around)).filter((near(0) == F.col("_piece")) & (F.col("f") % stride == 0) & (F.size("_w") == STEPS))
    hops = F.filter(F.transform("_w", lambda s, k: F.when(k > 0, F.hypot(s["x"] - F.get("_w", k - 1)["x"], s["y"] - F.get("_w", k - 1)["y"]))), lambda h: h.isNotNull())
    once = F.size(F.filter("_w", lambda s: s["f"] == F.col("f"))) == 1
    full = window.withColumn("_hops", hops).filter(once & (F.size("_hops") > 0) & (F.aggregate("_hops", F.lit(0.0), lambda a, h: a + h) >= min_travel))

    def seen(s: Column) -> Column:
        ahead, left = to_frame(F.col("x"), F.col("y"), F.col("yaw"), s["x"], s["y"])
        return F.struct((s["f"] - F.col("f") + CURRENT).cast("int").alias("step"), s["f"].alias("f"), s["t"].alias("t"), ahead.alias("x"), left.alias("y"), wrap(s["yaw"] - F.col("yaw")).alias("yaw"))

    return full.select(segment, F.col("f").alias("anchor"), F.lit(rate_hz).alias("rate_hz"), F.struct("x", "y", "yaw").alias("world"), F.transform("_w", seen).alias("steps"))  # STEPS elements


def first_poses(windows: DataFrame, segment: str) -> DataFrame:
    """(segment, f, t, x, y, yaw) of every frame that a scenario has at or before its current step, from the first scenario that has it."""
    past = windows.select(segment, "anchor", "rate_hz", "world", F.explode(F.filter("steps", lambda s: s["step"] <= CURRENT)).alias("s"))
    x, y = from_frame(F.col("world.x"), F.col("world.y"), F.col("world.yaw"), F.col("s.x"), F.col("s.y"))
    back = past.select(segment, F.col("s.f").alias("f"), "anchor", F.col("s.t").alias("t"), x.alias("x"), y.alias("y"), wrap(F.col("s.yaw") + F.col("world.yaw")).alias("yaw"), "rate_hz")
    #: numbers one by one, not as a struct: tasks can then take the first in a hash table before the shuffle, without sorting all steps
    return back.groupBy(segment, "f").agg(*(F.min_by(c, "anchor").alias(c) for c in ("t", "x", "y", "yaw", "rate_hz")))


def scenarios_to_episodes(windows: DataFrame, segment: str, split: Column, max_step: float = 3.0, gap_frames: float = 2.5, min_frames: int = 8, min_length: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(frames, episodes) from scenarios: overlapping ones are merged frame by frame, then cut where a gap is longer than so many frames at their rate."""
    merged = cut_lineage(first_poses(windows, segment).withColumn("scaled", F.col("t") * F.col("rate_hz")), "merged")  # it is read again and again
    return recordings_to_episodes(merged, segment, max_step, gap_frames, min_frames, min_length, split, "scaled")


def whole_scenarios(poses: DataFrame, tracks: DataFrame, cells: DataFrame, points: DataFrame, segment: str, stride: int, min_travel: float, map_frames: int, near: float) -> DataFrame:
    """Scenarios as whole rows: (segment, anchor, ego, tracks, cells, points), all in the frame of the current step.

    poses: (segment, f, t, x, y, yaw); tracks: (segment, f, track, kind, x, y); cells: (segment, f, ix, iy, state), size one unit;
    points: (segment, f, x, y, z).  tracks are those seen now or later, with their steps; cells are counted over the
    frames within map_frames of the current one; points are those of the current frame within `near` of it.  Every part is
    reduced to (segment, anchor) in a shuffle on these, and the parts meet without another one.
    """
    windows = scenario_windows(poses, segment, stride, min_travel)
    anchors = cut_lineage(windows.select(segment, "anchor").distinct().join(poses.select(segment, F.col("f").alias("anchor"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("yaw").alias("yaw0")), [segment, "anchor"]), "anchors")
    here = lambda x, y: (v.alias(n) for n, v in zip("xy", to_frame(F.col("x0"), F.col("y0"), F.col("yaw0"), x, y)))
    nest = lambda df, name, *parts: df.groupBy(segment, "anchor").agg(F.array_sort(F.collect_list(F.struct(*parts))).alias(name))
    ego = nest(windows, "ego", "step", "t", "x", "y", "yaw")
    steps = anchors.select("*", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("step")).withColumn("f", F.col("anchor") + F.col("step") - CURRENT)
    seen = steps.join(tracks.withColumnsRenamed({"x": "tx", "y": "ty"}), [segment, "f"]).select(segment, "anchor", "track", "kind", "step", *here(F.col("tx"), F.col("ty")))
    each = seen.groupBy(segment, "anchor", "track", "kind").agg(F.array_sort(F.collect_list(F.struct("step", "x", "y"))).alias("steps")).filter(F.exists("steps", lambda s: s["step"] >= CURRENT))
    first, last = (F.ceil((F.col("f") - map_frames) / stride) * stride), (F.floor((F.col("f") + map_frames) / stride) * stride)
    looks = cells.filter(first <= last).select(segment, "ix", "iy", "state", F.explode(F.sequence(first, last, F.lit(stride).cast("bigint"))).alias("anchor"))
    counted = looks.groupBy(segment, "anchor", "ix", "iy").agg(F.count_if(F.col("state") == "occupied").alias("n_occ"), F.count_if(F.col("state") != "occupied").alias("n_free"))
    counted = counted.join(anchors, [segment, "anchor"]).select(segment, "anchor", *here(F.col("ix") + 0.5, F.col("iy") + 0.5), "n_occ", "n_free")
    close = anchors.join(points.withColumnsRenamed({"f": "anchor", "x": "px", "y": "py"}), [segment, "anchor"]).select(segment, "anchor", *here(F.col("px"), F.col("py")), "z").filter(F.hypot("x", "y") <= near)
    out = ego
    for part in (nest(each, "tracks", "track", "kind", "steps"), nest(counted, "cells", "x", "y", "n_occ", "n_free"), nest(close, "points", "x", "y", "z")):
        out = out.join(part, [segment, "anchor"], "left")
    return out
