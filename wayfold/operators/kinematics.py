"""Cleaning of time series and motion from poses, over window functions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geom import PI, turn_between, wrap
from .scans import Ordered, ordered, scan


def _w(key: str, order: str = "f"):
    return Window.partitionBy(key).orderBy(order)


def fill_single_gaps(dense: DataFrame, key: str) -> DataFrame:
    """Fills x, y and yaw of a missing frame between two present ones: means, and half the turn (a turn by pi goes to the right)."""
    w = _w(key)
    out, gap = dense, F.col("x").isNull() & F.lag("x").over(w).isNotNull() & F.lead("x").over(w).isNotNull()
    out = out.withColumn("filled", gap)
    for c in ("x", "y"):
        out = out.withColumn(f"{c}_new", F.when(gap, (F.lag(c).over(w) + F.lead(c).over(w)) / 2).otherwise(F.col(c)))
    out = out.withColumn("yaw_new", F.when(gap, wrap(F.lag("yaw").over(w) + turn_between(F.lag("yaw").over(w), F.lead("yaw").over(w)) / 2)).otherwise(F.col("yaw")))
    return out.drop("x", "y", "yaw").withColumnsRenamed({"x_new": "x", "y_new": "y", "yaw_new": "yaw"})


def velocity(df: DataFrame, key: str, k_max: int, order: str = "f") -> DataFrame:
    """Adds vx, vy: the widest central difference that exists within k_max rows, else the nearest one-sided one, else 0."""
    w = _w(key, order)

    def slope(c: str, a: int, b: int) -> Column:
        at = lambda col, k: F.lead(col, k).over(w) if k > 0 else F.lag(col, -k).over(w) if k < 0 else F.col(col)
        return F.try_divide(at(c, b) - at(c, a), at("t", b) - at("t", a))

    spans = [(-k, k) for k in range(k_max, 0, -1)] + [s for k in range(1, k_max + 1) for s in ((0, k), (-k, 0))]
    return df.withColumns({f"v{c}": F.coalesce(*(slope(c, a, b) for a, b in spans), F.lit(0.0)) for c in ("x", "y")})


def unwrap(df: DataFrame, key: str, angle: str, name: str, most: int | None = None) -> DataFrame:
    """Adds the angle without jumps: a running sum of wrapped differences, from the first angle on."""
    on = scan(ordered(df, [key], ["f"], most), previous={"_was": F.struct(F.col(angle).alias("angle"))})
    hop = F.when(F.col("_was").isNull(), F.col(angle)).otherwise(wrap(F.col(angle) - F.col("_was.angle")))
    return scan(on.with_rows(on.rows.withColumn("_turn", hop)), total={name: F.col("_turn")}).plain().drop("_was", "_turn")


def with_hops(df: DataFrame, key: str, order: str = "f", most: int | None = None) -> DataFrame:
    return _hops(ordered(df, [key], [order], most)).plain()


def _hops(on: Ordered) -> Ordered:
    """Adds hop, the distance from the row before."""
    on = scan(on, previous={"_was": F.struct("x", "y")})
    return on.with_rows(on.rows.withColumn("hop", F.hypot(F.col("x") - F.col("_was.x"), F.col("y") - F.col("_was.y"))).drop("_was"))


def arc_length(df: DataFrame, key: str, order: str = "f", most: int | None = None) -> DataFrame:
    """Adds s, the distance travelled along the path."""
    return scan(_hops(ordered(df, [key], [order], most)), total={"s": F.coalesce("hop", F.lit(0.0))}).plain()


def jitter_free_arc(df: DataFrame, key: str, still: float) -> DataFrame:
    """(key, f, s): distance travelled where only moves of over `still` from the last anchor count.

    The anchor depends on all rows before.  Rows are dealt by key and sorted, and tasks go through them batch by batch
    with the anchor and the distance so far in hand, so that a path of any length takes linear time and no array.
    """
    rows = df.select(key, "f", "x", "y").repartition(key).sortWithinPartitions(key, "f")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, ax, ay, s = None, 0.0, 0.0, 0.0
        for batch in batches:
            out = []
            for now, x, y in zip(batch[key].to_numpy(), batch["x"].to_numpy(), batch["y"].to_numpy()):
                if path is None or now != path:
                    path, ax, ay, s = now, x, y, 0.0
                elif (d := math.hypot(x - ax, y - ay)) > still:
                    ax, ay, s = x, y, s + d
                out.append(s)
            yield batch[[key, "f"]].assign(s=out)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInPandas(walk, f"`{key}` {kinds[key]}, f {kinds['f']}, s double")


def stationary(obs: DataFrame, keys: list[str], radius: float, min_steps: int = 3, min_span: float = 1.0) -> DataFrame:
    """Per track: medians, farthest distance from them, and whether that stays within radius over enough rows and time."""
    med = obs.groupBy(*keys).agg(F.percentile("x", 0.5).alias("mx"), F.percentile("y", 0.5).alias("my"), F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span"))
    far = obs.join(med, keys).groupBy(*keys).agg(F.max(F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my"))).alias("farthest"))
    return med.join(far, keys).withColumn("is_stationary", (F.col("n") >= min_steps) & (F.col("span") >= min_span) & (F.col("farthest") < radius))


def companion(df: DataFrame, key: str, half: int, near: float, share: float, min_rows: int, min_travel: float) -> DataFrame:
    """Adds with_robot: in the window of +-half rows, long enough or keeping up, and nearly always near.

    A window's first hop leads into it from outside and counts as 0.
    """
    w = _w(key)
    window = w.rowsBetween(-half, half)
    seen = df.withColumn("hop", F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0)))
    seen = seen.withColumns({"n": F.count("*").over(window), "n_near": F.sum((F.col("d") < near).cast("int")).over(window), "travel": F.sum("hop").over(window) - F.first("hop").over(window)})
    return seen.withColumn("with_robot", ((F.col("n") >= min_rows) | (F.col("travel") >= min_travel)) & (F.col("n_near") > share * F.col("n")))


def repair_heading(df: DataFrame, key: str, fast: float) -> DataFrame:
    """Turns a track's yaw by pi if the median cosine between yaw and travel over fast steps is negative."""
    w = _w(key)
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    moves = df.withColumns({"step": F.hypot(dx, dy), "agree": F.cos(F.col("yaw") - F.atan2(dy, dx))})
    votes = moves.filter(F.col("step") > fast).groupBy(key).agg((F.percentile("agree", 0.5) < 0).alias("reversed"))
    return df.join(votes, key, "left").withColumn("yaw", F.when(F.coalesce("reversed", F.lit(False)), wrap(F.col("yaw") + PI)).otherwise(F.col("yaw")))


def ground_height(obs: DataFrame, key: str, reach: float, default: float) -> DataFrame:
    """Per recording, minus the median bottom height of near pedestrians, or a default where there are none."""
    near = F.when((F.col("kind") == "PEDESTRIAN") & (F.hypot("x", "y") < reach), F.col("z") - F.col("h") / 2)
    return obs.groupBy(key).agg(F.coalesce(-F.percentile(near, F.lit(0.5)), F.lit(default)).alias("height"))


def median_filter(df: DataFrame, key: str, value: str, half: int, order: str = "f") -> DataFrame:
    """Adds smooth: the median over +-half rows, with end values repeated beyond the ends; rows are numbered 0..n-1."""
    last = df.groupBy(key).agg(F.max(order).alias("last"))
    offsets = F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("k")
    wanted = df.select(key, order).join(last, key).select(key, order, "last", offsets).select(key, order, F.greatest(F.lit(0), F.least(F.col("last"), F.col(order) + F.col("k"))).alias("at"))
    values = df.select(key, F.col(order).alias("at"), value)
    return wanted.join(values, [key, "at"]).groupBy(key, order).agg(F.percentile(value, 0.5).alias("smooth"))


def half_window(rate_hz: float) -> int:
    """Rows on each side over which velocity is taken: about 0.3 seconds, one at least."""
    return max(1, round(0.3 * rate_hz))


def stops_for_good(hops: DataFrame, recording: str, episode: str, seconds: float, slow: float) -> DataFrame:
    """Per episode (recording, episode): whether it is slow over its last seconds and goes up to the end of its recording; a cut on the way is no stop."""
    key = F.struct(recording, episode)
    rest = ends_at_rest(hops.withColumn("_key", key), "_key", seconds, slow)
    last = hops.groupBy(recording).agg(F.max("f").alias("_last"))
    ends = hops.groupBy(recording, episode).agg(F.max("f").alias("_end")).join(last, recording)
    return ends.join(rest.select(F.col(f"_key.{recording}").alias(recording), F.col(f"_key.{episode}").alias(episode), "ends_at_rest"), [recording, episode]).select(recording, episode, (F.col("ends_at_rest") & (F.col("_end") == F.col("_last"))).alias("stops"))


def ends_at_rest(hops: DataFrame, key: str, seconds: float, slow: float) -> DataFrame:
    """Per episode: whether the median speed over its last seconds is below slow."""
    last = hops.groupBy(key).agg(F.max("t").alias("t_end"))
    late = hops.join(last, key).filter(F.col("t") >= F.col("t_end") - seconds)
    return late.groupBy(key).agg(F.coalesce(F.percentile("speed", 0.5) < slow, F.lit(True)).alias("ends_at_rest"), F.count("*").alias("n_late"))


def gradient_heading(df: DataFrame, key: str) -> DataFrame:
    """Adds heading from central differences of positions, one-sided at the ends."""
    w = _w(key)
    d = lambda c: F.coalesce((F.lead(c).over(w) - F.lag(c).over(w)) / 2, F.lead(c).over(w) - F.col(c), F.col(c) - F.lag(c).over(w), F.lit(0.0))
    return df.withColumn("heading", F.atan2(d("y"), d("x")))


def sensor_gap(odometry: DataFrame, key: str) -> DataFrame:
    """Adds gap: time to the next odometry row."""
    return odometry.withColumn("gap", F.lead("t").over(_w(key, "t")) - F.col("t"))


def resting_pad(df: DataFrame, key: str, n: int) -> DataFrame:
    """Repeats each group's first and last row n times, and numbers the rows anew from 0."""
    ends = df.groupBy(key).agg(F.min("f").alias("f0"), F.max("f").alias("f1"))
    marked = df.join(ends, key)
    times = F.when(F.col("f") == F.col("f0"), n).otherwise(0) + F.when(F.col("f") == F.col("f1"), n).otherwise(0) + 1
    out = marked.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
    w = Window.partitionBy(key).orderBy("f", "copy")
    return out.withColumn("index", F.row_number().over(w) - 1).drop("f0", "f1", "copy")
