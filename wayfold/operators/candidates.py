"""Candidates of an evaluation suite: which are valid, how they are tagged, capped and summed up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scenario import valid_candidates

#: Share of the recorded path that the map may not know, least distance of a goal [m], luminance below which it is dim.
MAX_UNKNOWN, MIN_GOAL_M, DIM = 0.3, 2.0, 60.0
#: The metrics that a suite reports the mean of.
METRICS = ("collided", "collided_dynamic", "collided_static", "collided_map", "collided_lidar", "start_overlap", "unknown_fraction", "ade", "fde")
#: Baselines whose failure is a tag.
BASELINES = ("straight_ahead", "straight_to_goal")


def _not(c: str) -> Column:
    """Holds where a flag is false; a flag that was never worked out counts as false."""
    return ~F.coalesce(F.col(c), F.lit(False))


def suite_rules(min_goal: float = MIN_GOAL_M, max_unknown: float = MAX_UNKNOWN) -> dict[str, Column]:
    """What a scenario must meet to be a candidate: a known place, a recorded path that is clean, known and does not go backwards, a goal that is
    far enough and can't be met by standing, and a picture.
    """
    c = F.col
    return {
        "environment": c("environment").isNotNull(), "picture": c("thumb").isNotNull(), "clean": ~c("ref_collided"), "clean_points": ~c("ref_collided_lidar"), "start_free": ~c("start_overlap"),
        "known": c("ref_unknown") <= max_unknown, "not_by_standing": ~c("stationary_collided"), "far": F.hypot("goal_x", "goal_y") >= min_goal, "protocol": _not("ref_protocol_collided"), "forwards": _not("ref_reverses"),
    }


def timed_rules() -> dict[str, Column]:
    """The rules where paths are scored in time: goals, unknown parts and standing do not matter there."""
    every = suite_rules()
    return {k: every[k] for k in ("environment", "picture", "clean", "clean_points", "start_free", "forwards")}


def tagged(rows: DataFrame, by_clip: Column | None = None, max_unknown: float | None = None) -> DataFrame:
    """Adds tags, sorted and distinct, and how many baselines fail.

    Tags are of the environment, source, scene, people and path, of the baselines that fail, of dim light and, where asked for, of a
    map that is partly unknown and of an environment that was only estimated.
    """
    c = F.col
    scene = F.when(c("environment") == "indoor", c("indoor_scene")).otherwise(c("outdoor_scene"))
    named = [F.concat(F.lit(f"{k}:"), v.cast("string")) for k, v in (("env", c("environment")), ("source", c("dataset")), ("scene", scene))]
    fails = [F.when(~F.coalesce(c(f"{b}_success"), F.lit(False)), F.lit(f"baseline_fails:{b}")) for b in BASELINES]
    more = [F.when(c("luminance") < DIM, F.lit("lighting:dim"))]
    if max_unknown is not None:
        more.append(F.when(c("ref_unknown") > max_unknown, F.lit("map:partly_unknown")))
    if by_clip is not None:
        more.append(F.when(by_clip, F.lit("env:by_clip")))
    own = F.array_compact(F.array(*named, *fails, *more))
    lists = [F.coalesce(c(k), F.array().cast("array<string>")) for k in ("people_tags", "path_tags")]
    return rows.withColumns({"tags": F.array_sort(F.array_distinct(F.concat(own, *lists))), "n_baseline_fails": F.size(F.array_compact(F.array(*fails)))})


def suite_candidates(rows: DataFrame, timed: bool = False) -> DataFrame:
    """The valid candidates with their tags."""
    return tagged(valid_candidates(rows, timed_rules() if timed else suite_rules()), F.col("env_by_clip") if timed else None, MAX_UNKNOWN if timed else None)


def mean_verdicts(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Means of a suite's metrics and the number of scenarios, by keys."""
    return verdicts.groupBy(*keys).agg(*(F.avg(F.col(m).cast("double")).alias(m) for m in METRICS), F.count("*").alias("num_scenarios"))


def capped(kept: DataFrame, source: str, klass: str, house: str, order: list[str], caps: dict[str, int], rest: int, per_house: int) -> DataFrame:
    """Rows that were kept by thinning, cut to so many of a house and then of a class, in order, within each source; a null house has no cap."""
    in_house = Window.partitionBy(source, klass, house).orderBy(*order)
    few = kept.withColumn("_h", F.row_number().over(in_house)).filter(F.col(house).isNull() | (F.col("_h") <= per_house)).drop("_h")
    most = F.lit(rest)
    for name, cap in caps.items():
        most = F.when(F.col(klass) == name, cap).otherwise(most)
    in_class = Window.partitionBy(source, klass).orderBy(*order)
    return few.withColumn("_n", F.row_number().over(in_class)).filter(F.col("_n") <= most).drop("_n")
