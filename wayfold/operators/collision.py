"""Scoring paths against moving and static objects, map cells and scan points.

Working tables: path (scenario, step, x, y) with the current step as 0; ego likewise; obs (scenario, track, step, kind,
length, width, height, x, y, z, heading, is_stationary, is_operator), one row for each valid step; occ (scenario, row,
col) occupied map cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geom import around, box_distance, wrap

#: Radii in metres, heights and counts of the protocol.
RADIUS, DISC, OVERHEAD, LIDAR_LOW, LIDAR_HIGH, LIDAR_LEAST, MAP_RES = 0.25, 0.3, 2.0, 0.25, 1.9, 3, 0.1
#: What a distance may be off by rounding: a touch is one whatever its last digits.
ROUNDING = 1e-9


def segments(path: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows with the values of the next step as _value, where there is one right after them."""
    w = Window.partitionBy(*keys).orderBy("step")
    return path.withColumns({f"_{v}": F.lead(v).over(w) for v in (*values, "step")}).filter(F.col("_step") == F.col("step") + 1)


def between(v: str, n_sub: int, angle: bool = False) -> Column:
    """Value at the end of sub-step k of a segment, linear between its ends."""
    way = F.col(f"_{v}") - F.col(v)
    return F.when(F.col("k") == n_sub, F.col(f"_{v}")).otherwise(F.col(v) + (wrap(way) if angle else way) * F.col("k") / n_sub).alias(v)


def densify(path: DataFrame, keys: list[str], n_sub: int, values: list[str], angles: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows at the ends of n_sub sub-steps of each step between neighbouring steps, linear between them; the first step itself is left out."""
    sub = segments(path, keys, values).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n_sub))))
    return sub.select(*keys, *carry, (F.col("step") * n_sub + F.col("k")).alias("sub"), *(between(v, n_sub, v in angles) for v in values))


def reachable(obs: DataFrame, with_map: bool) -> DataFrame:
    """Tracks a robot can hit: no operators, nothing overhead, no static boxes where a map has them."""
    lowest = Window.partitionBy("scenario", "track")
    seen = obs.withColumn("under", F.min(F.col("z") - F.col("height") / 2).over(lowest))
    return seen.filter(~F.col("is_operator") & (F.col("under") < OVERHEAD) & (F.lit(not with_map) | (F.col("kind") != "STATIC"))).drop("under")


def as_discs(obs: DataFrame, disc: float = DISC, radius: float = RADIUS) -> DataFrame:
    """Pedestrians as discs around their centres: a box of no size, reached from further away."""
    ped = F.col("kind") == "PEDESTRIAN"
    return obs.withColumns({"length": F.when(ped, 0.0).otherwise(F.col("length")), "width": F.when(ped, 0.0).otherwise(F.col("width")), "reach": F.when(ped, radius + disc).otherwise(radius)})


def _gap(px: str = "px", py: str = "py") -> Column:
    return box_distance(F.col(px), F.col(py), F.col("x"), F.col("y"), F.col("heading"), F.col("length"), F.col("width")) - F.col("reach")


def static_contacts(path: DataFrame, obs: DataFrame, n_sub: int) -> DataFrame:
    """(scenario, track, sub, gap) for stationary tracks, frozen at their first valid step from now on; overlaps at the start are left out."""
    frozen = obs.filter("is_stationary and step >= 0").groupBy("scenario", "track").agg(F.min_by(F.struct("x", "y", "heading", "length", "width", "reach"), "step").alias("b")).select("scenario", "track", "b.*")
    start = path.filter("step = 0").select("scenario", F.col("x").alias("px"), F.col("y").alias("py"))
    clear = frozen.join(start, "scenario").withColumn("start_gap", _gap()).filter("start_gap > 0").drop("px", "py", "start_gap")
    #: sub-steps are made after the join, so that what is shuffled and sorted is a row a step
    met = _path_segments(path).join(clear, "scenario").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n_sub))))
    at = met.select("scenario", "track", (F.col("step") * n_sub + F.col("k")).alias("sub"), *(between(v, n_sub) for v in ("px", "py")), *clear.columns[2:])
    return at.select("scenario", "track", "sub", _gap().alias("gap"))


def _path_segments(path: DataFrame) -> DataFrame:
    named = path.select("scenario", "step", F.col("x").alias("px"), F.col("y").alias("py"))
    return segments(named, ["scenario"], ["px", "py"]).select("scenario", "step", "px", "py", "_px", "_py")


def dynamic_contacts(path: DataFrame, obs: DataFrame, n_sub: int, slack: float = 0.0) -> DataFrame:
    """(scenario, track, sub, gap, px, py, ax, ay) for moving tracks between valid steps: an equi-join on the step, of which sub-steps are made after.

    Tracks whose gap is slack at most at the start are left out.
    """
    moving = obs.filter("not is_stationary and step >= 0")
    start = path.filter("step = 0").select("scenario", F.col("x").alias("px"), F.col("y").alias("py"))
    overlap = moving.filter("step = 0").join(start, "scenario").filter(_gap() <= slack).select("scenario", "track")
    moving = moving.join(overlap, ["scenario", "track"], "left_anti")
    size, at = ["length", "width", "reach"], ["x", "y", "heading"]
    inner = segments(moving, ["scenario", "track"], at).select("scenario", "track", "step", *size, *at, *(f"_{v}" for v in at), F.lit(1).alias("low"), F.lit(n_sub - 1).alias("high"))
    #: a sub-step that falls on a step needs only that step
    on_step = moving.filter("step > 0").select("scenario", "track", (F.col("step") - 1).alias("step"), *size, *at, *(F.col(v).alias(f"_{v}") for v in at), F.lit(n_sub).alias("low"), F.lit(n_sub).alias("high"))
    both = inner.filter("low <= high").unionByName(on_step)
    met = both.join(_path_segments(path), ["scenario", "step"]).withColumn("k", F.explode(F.sequence("low", "high")))
    dense = met.select("scenario", "track", (F.col("step") * n_sub + F.col("k")).alias("sub"), *size, *(between(v, n_sub, v == "heading") for v in (*at, "px", "py")))
    return dense.select("scenario", "track", "sub", _gap().alias("gap"), "px", "py", F.col("x").alias("ax"), F.col("y").alias("ay"))


def map_contacts(path: DataFrame, occ: DataFrame, n_sub: int, size: int = 400, radius: float = RADIUS, most: float = 2.0) -> DataFrame:
    """(scenario, sub, dist) to the nearest occupied cell within `most` metres; cells at the start don't count.

    Path points are rounded to cells first; the join is on blocks of cells as wide as the search.
    """
    half, block = (size - 1) / 2, int(most / MAP_RES)
    rc = lambda c: F.bround(half - F.col(c) / MAP_RES).cast("int")
    dense = densify(path, ["scenario"], n_sub, ["x", "y"]).select("scenario", "sub", rc("x").alias("pr"), rc("y").alias("pc"))
    start = path.filter("step = 0").select("scenario", (half - F.col("x") / MAP_RES).alias("r0"), (half - F.col("y") / MAP_RES).alias("c0"))
    far = occ.join(start, "scenario").filter(F.hypot(F.col("row") - F.col("r0"), F.col("col") - F.col("c0")) * MAP_RES > radius + MAP_RES).select("scenario", "row", "col", F.floor(F.col("row") / block).alias("bi"), F.floor(F.col("col") / block).alias("bj"))
    look = dense.withColumn("bi", around(F.floor(F.col("pr") / block), 1)).withColumn("bj", around(F.floor(F.col("pc") / block), 1))
    dist = F.hypot(F.col("pr") - F.col("row"), F.col("pc") - F.col("col")) * MAP_RES
    return look.join(far, ["scenario", "bi", "bj"]).groupBy("scenario", "sub").agg(F.min(dist).alias("dist")).filter(F.col("dist") <= most)


def unknown_share(path: DataFrame, known: DataFrame, n_sub: int, size: int = 400) -> DataFrame:
    """Share of path points in the map that no known cell (scenario, row, col) covers."""
    half = (size - 1) / 2
    rc = lambda c: F.bround(half - F.col(c) / MAP_RES).cast("int")
    at = densify(path, ["scenario"], n_sub, ["x", "y"]).select("scenario", "sub", rc("x").alias("row"), rc("y").alias("col")).filter((F.col("row").between(0, size - 1)) & (F.col("col").between(0, size - 1)))
    seen = known.select("scenario", "row", "col").distinct().withColumn("is_known", F.lit(1))
    return at.join(seen, ["scenario", "row", "col"], "left").groupBy("scenario").agg(F.avg(F.col("is_known").isNull().cast("double")).alias("unknown_fraction"))


def lidar_contacts(path: DataFrame, points: DataFrame, operators: DataFrame, n_sub: int, radius: float = RADIUS) -> DataFrame:
    """(scenario, sub) with enough points in reach at the nearest step; points (scenario, step, x, y, z, label, track), label 0 ground, 1 static."""
    start = path.filter("step = 0").select("scenario", F.col("x").alias("x0"), F.col("y").alias("y0"))
    hittable = points.filter((F.col("step") > 0) & (F.col("label") != 0) & (F.col("z") > LIDAR_LOW) & (F.col("z") < LIDAR_HIGH)).join(start, "scenario").filter(~((F.col("label") == 1) & (F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0")) <= radius + 0.1))).join(operators, ["scenario", "track"], "left_anti")
    block = 2 * radius
    dense = densify(path, ["scenario"], n_sub, ["x", "y"]).select("scenario", "sub", F.col("x").alias("px"), F.col("y").alias("py"))
    steps = F.explode(F.array_distinct(F.array(F.floor(F.col("sub") / n_sub + 0.5), F.ceil(F.col("sub") / n_sub - 0.5)))).alias("step")
    look = dense.select("*", steps).withColumn("bi", around(F.floor(F.col("px") / block), 1)).withColumn("bj", around(F.floor(F.col("py") / block), 1))
    placed = hittable.select("scenario", F.col("step").cast("long").alias("step"), "x", "y", F.floor(F.col("x") / block).alias("bi"), F.floor(F.col("y") / block).alias("bj"))
    hit = look.join(placed, ["scenario", "step", "bi", "bj"]).filter(F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y")) <= radius + ROUNDING)
    return hit.groupBy("scenario", "sub", "step").agg(F.count("*").alias("n")).filter(F.col("n") >= LIDAR_LEAST).select("scenario", "sub").distinct()


def displacement(path: DataFrame, ego: DataFrame) -> DataFrame:
    """Average and final distance from the recorded path."""
    both = path.filter("step > 0").join(ego.select("scenario", "step", F.col("x").alias("ex"), F.col("y").alias("ey")), ["scenario", "step"])
    err = F.hypot(F.col("x") - F.col("ex"), F.col("y") - F.col("ey"))
    return both.groupBy("scenario").agg(F.avg(err).alias("ade"), F.max_by(err, "step").alias("fde"))


def verdict(path: DataFrame, ego: DataFrame, obs: DataFrame, n_sub: int, rate_hz: float, occ: DataFrame | None = None, tolerance: float = 0.0) -> DataFrame:
    """One row for each scenario: collisions by kind, clearances, time of the first hit, ADE and FDE."""
    usable = as_discs(reachable(obs, occ is not None))
    parts = [static_contacts(path, usable, n_sub).select("scenario", "sub", F.lit("static").alias("by"), "gap"), dynamic_contacts(path, usable, n_sub).select("scenario", "sub", F.lit("dynamic").alias("by"), "gap")]
    if occ is not None:
        parts.append(map_contacts(path, occ, n_sub).select("scenario", "sub", F.lit("map").alias("by"), (F.col("dist") - RADIUS + tolerance).alias("gap")))
    gaps = parts[0]
    for p in parts[1:]:
        gaps = gaps.unionByName(p)
    hit = F.col("gap") <= (1e-9 if occ is not None else 0.0)
    of = lambda by: F.coalesce(F.bool_or(hit & (F.col("by") == by)), F.lit(False)).alias(f"collided_{by}")
    clear = lambda by: F.min(F.when(F.col("by") == by, F.col("gap"))).alias(f"clearance_{by}")
    kinds = ("dynamic", "static", "map")
    hits = gaps.groupBy("scenario").agg(*map(of, kinds), *map(clear, kinds), (F.min(F.when(hit, F.col("sub"))) / (n_sub * rate_hz)).alias("first_collision_s"))
    out = displacement(path, ego).join(hits, "scenario", "left")
    flags = {f"collided_{k}": F.coalesce(f"collided_{k}", F.lit(False)) for k in kinds}
    return out.withColumns(flags).withColumn("collided", F.col("collided_dynamic") | F.col("collided_static") | F.col("collided_map"))


def at_fault(contacts: DataFrame, path: DataFrame, n_sub: int, rate_hz: float, moving: float = 0.05) -> DataFrame:
    """(scenario, at_fault) of every path: at an agent's first contact the robot moves and the agent is ahead of it; false without a contact."""
    w = Window.partitionBy("scenario").orderBy("sub")
    dense = densify(path, ["scenario"], n_sub, ["x", "y"]).unionByName(path.filter("step = 0").select("scenario", F.lit(0).alias("sub"), "x", "y"))
    dt = 1.0 / (rate_hz * n_sub)
    lead, lag = (lambda c: F.coalesce(F.lead(c).over(w), F.col(c))), (lambda c: F.coalesce(F.lag(c).over(w), F.col(c)))
    steps = F.lead("x").over(w).isNotNull().cast("int") + F.lag("x").over(w).isNotNull().cast("int")
    motion = dense.select("scenario", "sub", F.coalesce(F.try_divide(lead("x") - lag("x"), steps * dt), F.lit(0.0)).alias("vx"), F.coalesce(F.try_divide(lead("y") - lag("y"), steps * dt), F.lit(0.0)).alias("vy"))
    first = contacts.filter("gap <= 0").groupBy("scenario", "track").agg(F.min_by(F.struct("sub", "px", "py", "ax", "ay"), "sub").alias("c")).select("scenario", "track", "c.*")
    ahead = (F.col("ax") - F.col("px")) * F.col("vx") + (F.col("ay") - F.col("py")) * F.col("vy") > 0
    guilty = first.join(motion, ["scenario", "sub"]).groupBy("scenario").agg(F.bool_or(ahead & (F.hypot("vx", "vy") > moving)).alias("at_fault"))
    return path.select("scenario").distinct().join(guilty, "scenario", "left").select("scenario", F.coalesce("at_fault", F.lit(False)).alias("at_fault"))


#: Planners that a path is compared with.
PLANNERS = ("recorded", "constant_velocity", "stationary", "straight_to_goal")


def baselines(ego: DataFrame, goals: DataFrame, rate_hz: float, n: int = 10) -> DataFrame:
    """(scenario, planner, step, x, y): recorded, constant velocity, stationary, straight to the goal; step 0 is the start."""
    now = ego.filter("step = 0").join(goals, "scenario").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n))))
    k = F.col("step")
    made = {
        "constant_velocity": (F.col("x") + F.col("vx") * k / rate_hz, F.col("y") + F.col("vy") * k / rate_hz),
        "stationary": (F.col("x"), F.col("y")),
        "straight_to_goal": (F.col("x") + (F.col("gx") - F.col("x")) * k / n, F.col("y") + (F.col("gy") - F.col("y")) * k / n),
    }
    out = ego.filter(F.col("step").between(0, n)).select("scenario", F.lit("recorded").alias("planner"), "step", "x", "y")
    for name, (x, y) in made.items():
        out = out.unionByName(now.select("scenario", F.lit(name).alias("planner"), "step", x.alias("x"), y.alias("y")))
    return out
