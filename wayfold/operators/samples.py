"""Training samples, goals and tags cut from frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geom import to_frame, uniform, wrap
from .joins import interpolate
from .kinematics import arc_length


def eligible(frames: DataFrame, episode: str, stride: int, horizon: float, rest_col: str | None = None) -> DataFrame:
    """Frames on the stride whose episode goes on for the horizon; an episode that ends at rest needs no more."""
    end = F.max("t").over(Window.partitionBy(episode))
    enough = end - F.col("t") >= horizon - 1e-6
    if rest_col:
        enough = enough | (F.col(rest_col) & (end > F.col("t")))
    return frames.withColumn("_ok", enough).filter((F.col("f") % stride == 0) & F.col("_ok")).drop("_ok")


def timed_targets(frames: DataFrame, samples: DataFrame, episode: str, horizon: float, n: int) -> DataFrame:
    """(episode, f, k, x, y, yaw) at n moments evenly over the horizon, in each sample's own frame."""
    asked = samples.select(episode, "f", F.col("t").alias("t0"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("yaw").alias("yaw0"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k")).withColumn("t", F.col("t0") + F.col("k") * (horizon / n))
    at = interpolate(asked, frames.select(episode, "t", "x", "y", "yaw"), episode, "t", ["x", "y", "yaw"], ("yaw",))
    ahead, left = to_frame(F.col("x0"), F.col("y0"), F.col("yaw0"), F.col("x"), F.col("y"))
    return at.select(episode, "f", "k", ahead.alias("x"), left.alias("y"), wrap(F.col("yaw") - F.col("yaw0")).alias("yaw"))


def waypoints(frames: DataFrame, samples: DataFrame, episode: str, spacing: float, n: int) -> DataFrame:
    """(episode, f, k, x, y, stop) every `spacing` along the path ahead; stop where the episode's rest is reached."""
    arc = arc_length(frames, episode)
    ends = arc.groupBy(episode).agg(F.max("s").alias("end"))
    mine = arc.join(samples.select(episode, "f"), [episode, "f"]).join(ends, episode)
    asked = mine.select(episode, "f", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("yaw").alias("yaw0"), F.col("s").alias("s0"), "end", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k")).withColumn("s", F.least(F.col("s0") + F.col("k") * spacing, F.col("end")))
    samples_ = arc.groupBy(episode, "s").agg(F.max_by(F.struct("x", "y"), "f").alias("p")).select(episode, "s", "p.x", "p.y")
    at = interpolate(asked, samples_, episode, "s", ["x", "y"])
    ahead, left = to_frame(F.col("x0"), F.col("y0"), F.col("yaw0"), F.col("x"), F.col("y"))
    return at.select(episode, "f", "k", ahead.alias("x"), left.alias("y"), (F.col("s0") + F.col("k") * spacing > F.col("end")).alias("stop"))


def history(frames: DataFrame, samples: DataFrame, episode: str, n: int, dt: float) -> DataFrame:
    """(episode, f, j, at, missing): last frame at or before t - j * dt, the first one where there is none."""
    from .joins import asof

    asked = samples.select(episode, F.col("f"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("j"), "t").withColumn("want", F.col("t") - F.col("j") * dt + 1e-6)
    found = asof(asked, frames.select(episode, F.col("t").alias("rt"), F.col("f").alias("at")), episode, "want", "rt", ["at"])
    return found.select(episode, "f", "j", F.coalesce("at", F.lit(0)).alias("at"), F.col("at").isNull().alias("missing"))


def views(offsets: list[int], frames: DataFrame, samples: DataFrame, episode: str) -> DataFrame:
    """(episode, f, offset, at): the nearest frame to each offset in seconds, never later than the sample for the past."""
    from .joins import asof_nearest

    asked = samples.select(episode, "f", "t", F.explode(F.array(*map(F.lit, offsets))).alias("offset")).withColumn("want", F.col("t") + F.col("offset"))
    found = asof_nearest(asked, frames.select(episode, F.col("t").alias("rt"), F.col("f").alias("at")), episode, "want", "rt", ["at"])
    return found.select(episode, "f", "offset", F.when(F.col("offset") <= 0, F.least("at", "f")).otherwise(F.col("at")).alias("at"))


def needed_frames(links: DataFrame, episode: str) -> DataFrame:
    """Distinct frames that samples need, so that payload is read once."""
    return links.select(episode, F.col("at").alias("f")).distinct()


def ego_velocity(frames: DataFrame, episode: str) -> DataFrame:
    """Adds v_ahead, v_left: velocity from the row before in the row's own frame."""
    w = Window.partitionBy(episode).orderBy("f")
    dt = F.col("t") - F.lag("t").over(w)
    vx, vy = F.try_divide(F.col("x") - F.lag("x").over(w), dt), F.try_divide(F.col("y") - F.lag("y").over(w), dt)
    ahead, left = to_frame(F.lit(0.0), F.lit(0.0), F.col("yaw"), F.coalesce(vx, F.lit(0.0)), F.coalesce(vy, F.lit(0.0)))
    return frames.withColumns({"v_ahead": ahead, "v_left": left})


def choose(df: DataFrame, key: list[str], order: list[str], seed: str) -> DataFrame:
    """One row per key, by a reproducible uniform number over the key."""
    w = Window.partitionBy(*key)
    number = F.row_number().over(w.orderBy(*order)) - 1
    pick = F.floor(uniform(F.lit(seed), *(F.col(k) for k in key)) * F.count("*").over(w))
    return df.withColumn("_n", number).withColumn("_pick", pick).filter("_n = _pick").drop("_n", "_pick")


def goals_beyond(frames: DataFrame, samples: DataFrame, episode: str, horizon: float, extra: float, reach: float, seed: str) -> DataFrame:
    """(episode, f, gx, gy): a point of the same recording beyond the horizon, at a random distance along the path."""
    arc = arc_length(frames, episode)
    ends = arc.groupBy(episode).agg(F.max("s").alias("end"))
    now = arc.join(samples.select(episode, "f"), [episode, "f"]).join(ends, episode)
    later = F.least(F.col("s") + horizon + extra + uniform(F.lit(seed), F.col(episode), F.col("f")) * reach, F.col("end"))
    asked = now.filter(F.col("end") - F.col("s") >= horizon + extra).select(episode, "f", later.alias("s"))
    points = arc.groupBy(episode, "s").agg(F.max_by(F.struct("x", "y"), "f").alias("p")).select(episode, "s", "p.x", "p.y")
    return interpolate(asked, points, episode, "s", ["x", "y"]).select(episode, "f", F.col("x").alias("gx"), F.col("y").alias("gy"))


def people_tags(obs: DataFrame, ego: DataFrame, near: float = 8.0, standing: float = 4.0, meet: float = 1.5) -> DataFrame:
    """(scenario, tags, n): how many people are near, and whether those met come, go along, cross or stand."""
    people = obs.filter((F.col("kind") == "PEDESTRIAN") & ~F.col("is_operator") & (F.col("step") >= 0))
    both = people.join(ego.select("scenario", "step", F.col("x").alias("ex"), F.col("y").alias("ey")), ["scenario", "step"])
    ref = ego.filter("step >= 0").groupBy("scenario").agg(F.min_by(F.struct("x", "y"), "step").alias("a"), F.max_by(F.struct("x", "y"), "step").alias("b")).select("scenario", (F.col("b.x") - F.col("a.x")).alias("rx"), (F.col("b.y") - F.col("a.y")).alias("ry"))
    d = F.hypot(F.col("x") - F.col("ex"), F.col("y") - F.col("ey"))
    here = both.groupBy("scenario", "track").agg(F.min(d).alias("d"), F.count("*").alias("n"), F.min_by(F.struct("x", "y"), "step").alias("p"), F.max_by(F.struct("x", "y"), "step").alias("q"), F.bool_or("is_stationary").alias("still"), F.min(F.when(F.col("step") == 0, d)).alias("d0"))
    moved = here.join(ref, "scenario").withColumns({"mx": F.col("q.x") - F.col("p.x"), "my": F.col("q.y") - F.col("p.y")})
    cos = F.try_divide(F.col("mx") * F.col("rx") + F.col("my") * F.col("ry"), F.hypot("mx", "my") * F.hypot("rx", "ry"))
    met = ~F.col("still") & (F.col("n") >= 2) & (F.col("d") <= meet) & (F.hypot("mx", "my") >= 0.5) & (F.hypot("rx", "ry") >= 0.5)
    way = F.when(met, F.when(cos < -0.7, "people:oncoming").when(cos > 0.7, "people:same_direction").otherwise("people:crossing"))
    per = moved.withColumn("way", way).groupBy("scenario").agg(F.collect_set("way").alias("ways"), F.count_if(F.col("d0") < near).alias("n"), F.bool_or(F.col("still") & (F.coalesce("d0", F.lit(1e9)) < standing)).alias("stands"))
    all_ = ego.select("scenario").distinct().join(per, "scenario", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    count = F.when(F.col("n") == 0, "people:none").when(F.col("n") >= 5, "people:crowd").otherwise("people:few")
    tags = F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(count, F.when(F.col("stands"), "people:standing_nearby"))), F.coalesce("ways", F.array().cast("array<string>")))))
    return all_.select("scenario", tags.alias("tags"), "n")


def path_tags(turn: Column, moves: Column, bearing_deg: Column, clearance: Column) -> Column:
    """Tags of a path's turning, its goal's bearing and its clearance."""
    turned = F.abs(F.degrees(turn))
    path = F.when(F.coalesce(moves, F.lit(0)) < 2, "path:mostly_still").when(turned > 135, "path:u_turn").when(turned > 45, "path:turn").otherwise("path:straight")
    goal = F.when(F.abs(bearing_deg) <= 30, "goal:ahead").when(F.abs(bearing_deg) <= 90, "goal:side").otherwise("goal:behind")
    return F.array_compact(F.array(path, goal, F.when(clearance < 0.35, "layout:narrow")))


def training_rows(samples: DataFrame, history_: DataFrame, targets: DataFrame, episode: str, prompt: Column, scale_x: float, scale_y: float) -> DataFrame:
    """One row a sample: prompt, frame keys of its history from the oldest on, the goal (0, 0 where an instruction names it) and scaled targets.

    samples: (episode, f, instruction); history_: (episode, f, j, at), whose missing frames are the oldest; targets:
    (episode, f, k, x, y), the last of which is the goal. prompt is an expression over instruction, gx and gy.
    """
    named = F.concat_ws("_", F.lit("frame"), F.col(episode).cast("string"), F.col("at").cast("string"))
    keys = history_.groupBy(episode, "f").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("j")).alias("j"), named.alias("key")))), lambda h: h["key"]).alias("history"))
    ahead = targets.groupBy(episode, "f").agg(F.sort_array(F.collect_list(F.struct("k", (F.col("x") / scale_x).alias("x"), (F.col("y") / scale_y).alias("y")))).alias("target"), F.max_by("x", "k").alias("gx"), F.max_by("y", "k").alias("gy"))
    spoken = F.col("instruction").isNotNull()
    goal = [F.when(spoken, F.lit(0.0)).otherwise(F.col(c)).alias(n) for c, n in (("gx", "goal_x"), ("gy", "goal_y"))]
    return samples.join(keys, [episode, "f"]).join(ahead, [episode, "f"]).select(episode, "f", prompt.alias("prompt"), "history", *goal, "target")
