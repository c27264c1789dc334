"""Measures of paths: following in time, wiggle, progress, deviation, timed scoring, motion classes, rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geom import turn_between
from .joins import interpolate
from .kinematics import _hops, arc_length, unwrap
from .lineage import cut_lineage
from .scans import RANGE, Ordered, ordered, scan


def resample(paths: DataFrame, key: str, spacing: float) -> DataFrame:
    """(key, k, s, x, y) every `spacing` along each path (key, f, x, y), from the first spacing on."""
    arc = arc_length(paths, key)
    ends = arc.groupBy(key).agg(F.max("s").alias("total"))
    wanted = ends.filter(F.col("total") >= spacing - 1e-9).select(key, F.explode(F.sequence(F.lit(1), F.floor((F.col("total") + 1e-9) / spacing).cast("int"))).alias("k")).withColumn("s", F.col("k") * spacing)
    samples = arc.groupBy(key, "s").agg(F.max_by(F.struct("x", "y"), "f").alias("p")).select(key, "s", "p.x", "p.y")
    return interpolate(wanted, samples, key, "s", ["x", "y"])


def timed(paths: DataFrame, key: str, rate: float, speed: float, n: int) -> DataFrame:
    """(key, k, x, y) at steps 1..n of following each path at a speed; it stops at the path's end."""
    arc = arc_length(paths, key)
    ends = arc.groupBy(key).agg(F.max("s").alias("total"))
    wanted = ends.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n)))).select(key, "k", F.least(F.lit(speed) * F.col("k") / rate, F.col("total")).alias("s"))
    samples = arc.groupBy(key, "s").agg(F.min_by(F.struct("x", "y"), "f").alias("p")).select(key, "s", "p.x", "p.y")
    return interpolate(wanted, samples, key, "s", ["x", "y"]).drop("s")


def timed_steps(pred: DataFrame, key: str, final_step: int, n: int) -> DataFrame:
    """(key, k, x, y) at steps 1..n of positions (key, f, x, y) evenly spaced in time up to final_step; f = 0 is the start."""
    last = pred.groupBy(key).agg(F.max("f").alias("m"))
    share = pred.join(last, key).select(key, F.try_divide(F.col("f"), F.col("m")).alias("u"), "x", "y")
    wanted = last.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n)))).select(key, "k", F.least(F.col("k") / final_step, F.lit(1.0)).alias("u"))
    return interpolate(wanted, share, key, "u", ["x", "y"]).drop("u")


def _scanned(on: Ordered, **wanted: dict) -> Ordered:
    """scan(), written where keys are split: each scan reads its rows twice there, so scans of scans would double the work each time."""
    done = scan(on, **wanted)
    return done.with_rows(cut_lineage(done.rows, "ranges")) if done.split else done


def corners(paths: DataFrame, key: str, spacing: float, most: int | None = None) -> Ordered:
    """(key, k, x, y) in order of k: the start (k = 0) and, of the points that resample() gives, the first and the last on each straight piece.

    Those between lie on a line at equal distances, so they turn by nothing; a long piece makes two rows, however many points it has.
    """
    arc = _hops(ordered(paths.select(key, "f", "x", "y"), [key], ["f"], most))
    arc = _scanned(arc, total={"s": F.coalesce("hop", F.lit(0.0))})
    arc = _scanned(arc, previous={"_was": F.struct("f")}, following={"_next": F.struct("f", "s")})
    other = F.when(F.col("_was").isNotNull() & (F.col("_was.f") != F.col("f")), 1).otherwise(0)
    arc = _scanned(arc.with_rows(arc.rows.withColumn("_other", other)), total={"_n": F.col("_other")})
    ends = lambda c: F.col("_next").isNull() | (F.col(f"_next.{c}") != F.col(c))
    start = F.when((F.col("_n") == 0) & ends("f"), F.struct("x", "y"))  # of rows of the first frame the last counts, as of points at one distance
    arc = _scanned(arc, last={"_past": start}, first={"_ahead": start})
    arc = arc.with_rows(arc.rows.filter(ends("s")).select(*([key, RANGE] if arc.split else [key]), "f", "s", "x", "y", F.coalesce("_past", "_ahead").alias("_start")))
    arc = _scanned(arc, previous={"_before": F.lit(1)}, following={"_hi": F.struct("s", "x", "y")})
    at = lambda k: k * F.lit(spacing)

    def onward(s: Column) -> Column:
        """The first k from 1 on whose distance is s or more."""
        k = F.floor(s / spacing)
        return F.greatest(F.lit(1), F.when(at(k - 1) >= s, k - 1).when(at(k) >= s, k).when(at(k + 1) >= s, k + 1).otherwise(k + 2)).cast("long")

    first = onward(F.col("s"))
    last = F.when(F.col("_hi").isNotNull(), onward(F.col("_hi.s")) - 1).otherwise(F.floor((F.col("s") + 1e-9) / spacing).cast("long"))
    none = F.array().cast("array<bigint>")
    ks = F.concat(F.when(F.col("_before").isNull(), F.array(F.lit(0).cast("long"))).otherwise(none), F.when(first <= last, F.array_distinct(F.array(first, last))).otherwise(none))
    span = F.col("_hi.s") - F.col("s")
    share = F.when(span > 0, (at(F.col("k")) - F.col("s")) / span).otherwise(0.0)

    def place(c: str) -> Column:
        lo, hi = F.col(c), F.col(f"_hi.{c}")
        return F.when(F.col("k") == 0, F.col(f"_start.{c}")).when(hi.isNull(), lo).when(lo.isNull(), hi).otherwise(lo + (hi - lo) * share).alias(c)

    kept = [key, RANGE] if arc.split else [key]
    return Ordered(arc.rows.withColumn("k", F.explode(ks)).select(*kept, "k", place("x"), place("y")), [key], ["k"], arc.split)


def wiggle(points: DataFrame, key: str, spacing: float = 0.1, most: int | None = None) -> DataFrame:
    """(key, wiggle): total turning less net turning along paths (key, f, x, y), resampled every `spacing` from their start.

    Points that fall on the one before keep its heading; turning back is a turn to the right, whatever the rounding.
    """
    even = _scanned(corners(points, key, spacing, most), previous={"_was": F.struct("k", "x", "y")})
    dx, dy = F.col("x") - F.col("_was.x"), F.col("y") - F.col("_was.y")
    went = F.when(F.hypot(dx, dy) > 1e-6 * (F.col("k") - F.col("_was.k")), F.atan2(dy, dx))
    heading = _scanned(even.with_rows(even.rows.withColumn("went", went).drop("_was")), last={"h": F.col("went")})
    turn = scan(heading, previous={"_h": F.col("h")}).plain().withColumn("dh", turn_between(F.col("_h"), F.col("h")))
    return turn.groupBy(key).agg((F.coalesce(F.sum(F.abs("dh")), F.lit(0.0)) - F.abs(F.coalesce(F.sum("dh"), F.lit(0.0)))).alias("wiggle"))


def progress(ends: DataFrame, speed: float, horizon_s: float, goal_radius: float = 0.5) -> DataFrame:
    """Progress towards the goal from (gx, gy), the last position (x, y) and the distance travelled, guarded against zeros."""
    d0, d1 = F.hypot("gx", "gy"), F.hypot(F.col("gx") - F.col("x"), F.col("gy") - F.col("y"))
    most = F.least(F.lit(speed * horizon_s), d0)
    return ends.withColumns({"progress_m": d0 - d1, "progress_ratio": F.when(most > 0, (d0 - d1) / most).otherwise(0.0), "path_efficiency": F.when(F.col("travelled") > 1e-3, (d0 - d1) / F.col("travelled")).otherwise(0.0), "reached_goal": d1 <= goal_radius})


def success(scored: DataFrame) -> DataFrame:
    return scored.withColumn("success", ~F.col("collided") & (F.col("progress_ratio") >= 0.5))


def deviation(a: DataFrame, b: DataFrame, key: str, most: int) -> DataFrame:
    """Mean distance of two resampled paths at equal distances along them, over at most so many points."""
    other = b.select(key, "k", F.col("x").alias("bx"), F.col("y").alias("by"))
    return a.join(other, [key, "k"]).filter(F.col("k") <= most).groupBy(key).agg(F.avg(F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by"))).alias("deviation"))


def timed_scores(steps: DataFrame, reference: DataFrame, key: str, rate: float, radius: float = 1.0) -> DataFrame:
    """ADE, FDE, end error, completed, largest acceleration and mean speed of positions in time; k = 0 is the start."""
    w = Window.partitionBy(key).orderBy("k")
    both = steps.join(reference.select(key, "k", F.col("x").alias("rx"), F.col("y").alias("ry")), [key, "k"])
    moved = both.withColumns({"vx": (F.col("x") - F.lag("x").over(w)) * rate, "vy": (F.col("y") - F.lag("y").over(w)) * rate})
    moved = moved.withColumn("acc", F.hypot(F.col("vx") - F.lag("vx").over(w), F.col("vy") - F.lag("vy").over(w)) * rate)
    err = F.hypot(F.col("x") - F.col("rx"), F.col("y") - F.col("ry"))
    out = moved.filter("k > 0").groupBy(key).agg(F.avg(err).alias("ade"), F.max_by(err, "k").alias("fde"), F.coalesce(F.max("acc"), F.lit(0.0)).alias("max_accel"), F.avg(F.hypot("vx", "vy")).alias("speed"))
    return out.withColumn("completed", F.col("fde") <= radius)


def motion_features(targets: DataFrame, key: str, dt: float) -> DataFrame:
    """Motion of targets (key, k, x, y), k = 0 at the origin: lengths, speeds at both ends, bearing and straightness."""
    w = Window.partitionBy(key).orderBy("k")
    hop = targets.withColumn("hop", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))).withColumn("last", F.max("k").over(Window.partitionBy(key)))
    speed = F.col("hop") / dt
    end = F.max_by(F.struct("x", "y"), "k")
    out = hop.groupBy(key).agg(F.sum("hop").alias("dist"), F.avg(speed).alias("speed_mean"), F.avg(F.when(F.col("k") <= 2, speed)).alias("speed_first"), F.avg(F.when(F.col("k") > F.col("last") - 2, speed)).alias("speed_last"), F.min(speed).alias("speed_min"), end.alias("end"))
    return out.select(key, "dist", "speed_mean", "speed_first", "speed_last", "speed_min", F.degrees(F.atan2("end.y", "end.x")).alias("bearing"), (F.col("dist") / F.greatest(F.lit(1e-6), F.hypot("end.x", "end.y"))).alias("straightness"))


def motion_turn(targets: DataFrame, key: str) -> DataFrame:
    """(key, heading_deg, lateral) of targets (key, k, x, y, yaw): how far the heading has turned at the end, and how far to the left it is."""
    end = F.max_by(F.struct("y", "yaw"), "k")
    return targets.groupBy(key).agg(end.alias("e")).select(key, F.degrees("e.yaw").alias("heading_deg"), F.col("e.y").alias("lateral"))


#: Classes of motion and the limits of their rules: speeds in m/s, bearings in degrees, path over net length.
REST, MOVES, SHARP, TURN, PACE, WINDING = 0.15, 0.3, 45, 15, 0.3, 1.15
MOTION_CLASSES = ("standing", "stopping", "starting", "sharp_left", "sharp_right", "turn_left", "turn_right", "slowing", "speeding_up", "weaving", "straight")


def motion_class(scale: float = 1.0) -> Column:
    """Class of motion features; the first rule that holds decides. Speeds are in units of scale."""
    mean, first, last = (F.col(f"speed_{x}") / scale for x in ("mean", "first", "last"))
    b = F.col("bearing")
    rules = (mean < REST, (last < REST) & (first > MOVES), (first < REST) & (last > MOVES), b > SHARP, b < -SHARP, b > TURN, b < -TURN, last - first < -PACE, last - first > PACE, F.col("straightness") > WINDING)
    out = F.lit(MOTION_CLASSES[-1])
    for rule, name in reversed(list(zip(rules, MOTION_CLASSES))):
        out = F.when(rule, name).otherwise(out)
    return out


#: Terms of the reward, each over the distance to the goal (1 at least) where it is a length; columns gx, gy, x, y are the goal and the path's end.
def _per_goal(c: Column) -> Column:
    return c / F.greatest(F.lit(1.0), F.hypot("gx", "gy"))


REWARDS = {
    "collision": lambda: F.when(F.col("collided") | F.col("collided_lidar"), -1.0).otherwise(1.0),
    "goal": lambda: -_per_goal(F.hypot(F.col("x") - F.col("gx"), F.col("y") - F.col("gy"))),
    "imitation": lambda: -_per_goal(F.col("ade")),
    "smooth": lambda: -_per_goal(F.col("acceleration")),
    "progress": lambda: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _per_goal(F.hypot("gx", "gy") - F.hypot(F.col("x") - F.col("gx"), F.col("y") - F.col("gy"))))),
}


def acceleration(path: DataFrame, key: str) -> DataFrame:
    """(key, acceleration): mean length of second differences of positions (key, step, x, y)."""
    w = Window.partitionBy(key).orderBy("step")
    second = lambda c: F.lead(c).over(w) - 2 * F.col(c) + F.lag(c).over(w)
    return path.select(key, F.hypot(second("x"), second("y")).alias("a")).groupBy(key).agg(F.avg("a").alias("acceleration"))


def reward_weights(spec: str) -> Column:
    """A map of terms to weights from 'goal=2, smooth': a term without a number weighs 1; a term that there is not raises an error."""
    given = F.map_filter(F.str_to_map(F.translate(F.lit(spec), " ", ""), F.lit(","), F.lit("=")), lambda term, _: term != "")
    strange = F.array_except(F.map_keys(given), F.array(*map(F.lit, REWARDS)))
    checked = F.when(F.size(strange) == 0, given).otherwise(F.raise_error(F.concat(F.lit("no such reward: "), F.array_join(strange, " "))).cast("map<string,string>"))
    return F.transform_values(checked, lambda _, weight: F.coalesce(weight.cast("double"), F.lit(1.0)))


def reward(scored: DataFrame, spec: str) -> DataFrame:
    """Adds every term as reward_<term>, and reward, their sum in the weights of the specification."""
    terms = scored.withColumns({f"reward_{k}": term() for k, term in REWARDS.items()} | {"_weights": reward_weights(spec)})
    total = sum((F.coalesce(F.col(f"reward_{k}") * F.col("_weights")[k], F.lit(0.0)) for k in REWARDS), F.lit(0.0))
    return terms.withColumn("reward", total).drop("_weights")


def total_turn(points: DataFrame, key: str, least_step: float) -> DataFrame:
    """(key, turn, moves): unwrapped heading change over the steps that move."""
    w = Window.partitionBy(key).orderBy("f")
    steps = points.withColumns({"dx": F.col("x") - F.lag("x").over(w), "dy": F.col("y") - F.lag("y").over(w)}).filter(F.hypot("dx", "dy") > least_step).withColumn("h", F.atan2("dy", "dx"))
    un = unwrap(steps, key, "h", "u")
    return un.groupBy(key).agg((F.max_by("u", "f") - F.min_by("u", "f")).alias("turn"), F.count("*").alias("moves"))
