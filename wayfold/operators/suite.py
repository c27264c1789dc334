"""Evaluation suites: baselines, clean scenarios, end shifts, picks and audits, and the small tables around samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geom import uniform
from . import collision
from .joins import covering, interpolate
from .kinematics import arc_length

#: What suites compare with, and how far straight ahead goes in metres.
PLANNERS, AHEAD = ("recorded", "stationary", "straight_ahead", "straight_to_goal"), 10.0


def suite_baselines(ego: DataFrame, goals: DataFrame, n: int = 10) -> DataFrame:
    """(scenario, planner, step, x, y) of each baseline over n steps; ego (scenario, step, x, y, yaw), goals (scenario, gx, gy)."""
    k, c = F.col("step"), F.col
    now = ego.filter("step = 0").join(goals, "scenario").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n))))
    made = {
        "stationary": (c("x"), c("y")),
        "straight_ahead": (c("x") + F.cos("yaw") * AHEAD * k / n, c("y") + F.sin("yaw") * AHEAD * k / n),
        "straight_to_goal": (c("x") + (c("gx") - c("x")) * k / n, c("y") + (c("gy") - c("y")) * k / n),
    }
    planned = F.explode(F.array(*(F.struct(F.lit(name).alias("planner"), x.alias("x"), y.alias("y")) for name, (x, y) in made.items()))).alias("p")
    recorded = ego.filter(k.between(0, n)).select("scenario", F.lit("recorded").alias("planner"), "step", "x", "y")
    return recorded.unionByName(now.select("scenario", "step", planned).select("scenario", "p.planner", "step", "p.x", "p.y"))


def score_planners(paths: DataFrame, ego: DataFrame, obs: DataFrame, n_sub: int, rate: float) -> DataFrame:
    """Verdict of each planner's path in each scenario: collisions by kind, clearances, first hit, ADE and FDE."""
    each = F.explode(F.array(*map(F.lit, PLANNERS))).alias("planner")
    keyed = lambda df: df.withColumn("scenario", F.struct("scenario", "planner")).drop("planner")
    out = collision.verdict(keyed(paths), keyed(ego.select("*", each)), keyed(obs.select("*", each)), n_sub, rate)
    return out.select("scenario.scenario", "scenario.planner", *out.columns[1:])


def clean(verdicts: DataFrame) -> DataFrame:
    """Scenarios whose own recorded path touches nothing."""
    return verdicts.filter((F.col("planner") == "recorded") & ~F.col("collided")).select("scenario")


def end_shift(ends: DataFrame, key: str, condition: str, one: str, other: str) -> DataFrame:
    """(key, shift): distance between the predicted end points under two input conditions."""
    of = lambda name, tag: ends.filter(F.col(condition) == name).select(key, F.col("x").alias(f"x{tag}"), F.col("y").alias(f"y{tag}"))
    return of(one, 1).join(of(other, 2), key).select(key, F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")).alias("shift"))


def scenario_scalars(ego: DataFrame, obs: DataFrame, goals: DataFrame, rate: float) -> DataFrame:
    """Per scenario: pedestrians now (no operators) and log1p of them, speed now, distance ahead, and share of the goal's distance made (at least 0.5 m)."""
    w = Window.partitionBy("scenario").orderBy("step")
    hop = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    went = ego.filter("step >= 0").withColumn("hop", hop).groupBy("scenario").agg(F.coalesce(F.sum("hop"), F.lit(0.0)).alias("future_distance"), (F.coalesce(F.max(F.when(F.col("step") == 1, F.col("hop"))), F.lit(0.0)) * rate).alias("speed"), F.min_by(F.struct("x", "y"), "step").alias("a"), F.max_by(F.struct("x", "y"), "step").alias("b"))
    people = obs.filter((F.col("kind") == "PEDESTRIAN") & ~F.col("is_operator") & (F.col("step") == 0)).groupBy("scenario").agg(F.count("*").alias("n"))
    out = went.join(people, "scenario", "left").join(goals, "scenario").withColumn("n_pedestrians", F.coalesce("n", F.lit(0)))
    to_goal = lambda p: F.hypot(F.col("gx") - F.col(f"{p}.x"), F.col("gy") - F.col(f"{p}.y"))
    return out.select("scenario", "n_pedestrians", F.log1p("n_pedestrians").alias("log_pedestrians"), "speed", "future_distance", ((to_goal("a") - to_goal("b")) / F.greatest(F.lit(0.5), to_goal("a"))).alias("progress_fraction"))


def pick_examples(rows: DataFrame, klass: str, order: list, n: int) -> DataFrame:
    """The first n rows in an order, of which a class may take max(2, n / 4)."""
    place = F.row_number().over(Window.partitionBy(klass).orderBy(*order))
    return rows.withColumn("_n", place).filter(F.col("_n") <= max(2, n // 4)).orderBy(*order).limit(n).drop("_n")


def largest_shards(rows: DataFrame, source: str, shard: str, n: int = 2) -> DataFrame:
    """(source, shard, n): the n shards of each source with the most rows."""
    counts = rows.groupBy(source, shard).agg(F.count("*").alias("n"))
    return counts.withColumn("_n", F.row_number().over(Window.partitionBy(source).orderBy(F.desc("n"), shard))).filter(F.col("_n") <= n).drop("_n")


def audit_counts(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, value, n): rows per value of each dimension, missing ones as null."""
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions))).alias("d")
    return rows.select(each).groupBy("d.dimension", "d.value").agg(F.count("*").alias("n"))


def future_steps(final_step: Column, per_second: int, seconds: int) -> Column:
    """Steps at 1 Hz for so many seconds, cut at the final step and ending in it."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(seconds + 1)), lambda k: F.when(k <= seconds, F.least(k * per_second, final_step)).otherwise(final_step)))


def history_steps(now: Column, n: int, dt: float, rate: float) -> Column:
    """Indices of n earlier moments dt seconds apart in a history of another rate, never before its first."""
    return F.transform(F.sequence(F.lit(n), F.lit(1), F.lit(-1)), lambda j: F.greatest(now - F.bround(j * dt * rate).cast("int"), F.lit(0)))


def choose_goal(samples: DataFrame, intervals: DataFrame, key: str, share: float, seed: str) -> DataFrame:
    """Adds instruction: that of an interval (key, t0, t1, instruction) which covers the sample, for a reproducible share of those that have one; else null, a point goal."""
    found = covering(samples.select(key, "f", "t"), intervals, key, "t", "t0", "t1")
    first = found.groupBy(key, "f").agg(F.min_by("instruction", F.struct("t0", "instruction")).alias("instruction"))
    spoken = uniform(F.lit(seed), F.col(key), F.col("f")) < share
    return samples.join(first, [key, "f"], "left").withColumn("instruction", F.when(spoken, F.col("instruction")))


def is_language_task(instruction: Column, task: Column) -> Column:
    """Whether there is an instruction and the task is not a point goal; false where either is missing."""
    return F.coalesce((F.length(F.trim(instruction)) > 0) & (task != "point_goal"), F.lit(False))


def horizon_motion(frames: DataFrame, samples: DataFrame, key: str, horizon: float) -> DataFrame:
    """(key, f, path, net): length of the path and distance between its ends over the horizon after each sample."""
    arc = arc_length(frames, key)
    ends = interpolate(samples.select(key, "f", (F.col("t") + horizon).alias("t")), arc.select(key, "t", "x", "y", "s"), key, "t", ["x", "y", "s"])
    now = arc.select(key, "f", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("s").alias("s0"))
    return ends.join(now, [key, "f"]).select(key, "f", (F.col("s") - F.col("s0")).alias("path"), F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0")).alias("net"))


def to_robot(points: DataFrame, sensors: DataFrame, sensor: str) -> DataFrame:
    """Points (sensor, x, y) in the robot's frame; sensors is (sensor, yaw, dx, dy), a row each."""
    c, s = F.cos("yaw"), F.sin("yaw")
    return points.join(sensors, sensor).withColumns({"x": c * F.col("x") - s * F.col("y") + F.col("dx"), "y": s * F.col("x") + c * F.col("y") + F.col("dy")}).drop("yaw", "dx", "dy")


def crop(points: DataFrame, reach: float = 20.0, ground: float = 0.2) -> DataFrame:
    """Points within reach on both axes, labelled 0 (ground) or 1 (static) by their height above ground."""
    near = (F.abs("x") <= reach) & (F.abs("y") <= reach)
    return points.filter(near).withColumn("label", F.when(F.col("z") < ground, 0).otherwise(1))


def track_dims(rows: DataFrame, keys: list[str], dims: list[str]) -> DataFrame:
    """Median of each dimension of a track."""
    return rows.groupBy(*keys).agg(*(F.percentile(d, 0.5).alias(d) for d in dims))


def fixed_split(sequence: Column, splits: dict[str, str], rest: str = "train") -> Column:
    """Split of a sequence by a fixed map."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in splits.items() for x in kv))[sequence], F.lit(rest))


def in_all(sets: list[DataFrame]) -> DataFrame:
    """Rows that every set has, once each."""
    out = sets[0].distinct()
    for s in sets[1:]:
        out = out.intersect(s)
    return out
