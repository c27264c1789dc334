"""Grouped reports, tags and tables of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geom import finite
from .scans import running


def mean_metrics(results: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """Means that leave out NULL and NaN, and the number of rows."""
    return results.groupBy(*(by or [])).agg(*(F.avg(finite(F.col(m).cast("double"))).alias(m) for m in metrics), F.count("*").alias("n"))


def by_sets(results: DataFrame, dims: list[str], metrics: list[str]) -> DataFrame:
    """Overall, and per value of each dimension on its own."""
    sets = [[], *([d] for d in dims)]
    out = results.groupingSets([[F.col(d) for d in s] for s in sets], *(F.col(d) for d in dims))
    return out.agg(*(F.avg(m).alias(m) for m in metrics), F.count("*").alias("n"), F.grouping_id().cast("long").alias("gid"))


def by_tag(results: DataFrame, tags: str, metrics: list[str]) -> DataFrame:
    """Means per tag and its group (before the colon); a row counts in each of its tags."""
    one = results.withColumn("tag", F.explode(tags)).withColumn("tag_group", F.split("tag", ":")[0])
    return one.groupBy("tag_group", "tag").agg(*(F.avg(F.col(m).cast("double")).alias(m) for m in metrics), F.count("*").alias("n"))


def tag_shares(rows: DataFrame, tags: str) -> DataFrame:
    """Tags of each group by how often they occur."""
    counted = rows.select(F.explode(tags).alias("tag")).withColumn("tag_group", F.split("tag", ":")[0]).groupBy("tag_group", "tag").agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy("tag_group").orderBy(F.desc("n"), "tag")))


def crosstab(rows: DataFrame, down: str, across: str, values: list[str]) -> DataFrame:
    return rows.groupBy(down).pivot(across, values).agg(F.count(F.lit(1))).na.fill(0)


def environment(share: Column) -> Column:
    """indoor, outdoor, mixed or unknown from the share of indoor frames."""
    return F.when(share.isNull(), "unknown").when(share >= 0.8, "indoor").when(share <= 0.2, "outdoor").otherwise("mixed")


def tag_set(*tags: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*tags))))


def exact_quantile(rows: DataFrame, value: Column, q: float, most: int | None = None) -> float | None:
    """Quantile of a column's finite values, linear between ranks, from counts of equal values summed along their order."""
    values = rows.select(value.cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf")))
    counted = values.groupBy("v").agg(F.count("*").alias("n"))
    n = counted.agg(F.sum("n")).first()[0]
    if not n:
        return None
    at = q * (n - 1)
    summed = running(counted.withColumn("_all", F.lit(1)), ["_all"], ["v"], most, total={"upto": F.col("n")})
    holds = lambda k: (F.col("upto") > k) & (F.col("upto") - F.col("n") <= k)
    near = summed.filter(holds(int(at)) | holds(int(at) + 1)).agg(F.min("v").alias("low"), F.max("v").alias("high")).first()
    return near["low"] + (near["high"] - near["low"]) * (at - int(at))


def split_report(episodes: DataFrame, probabilities: str = "frame_indoor_prob") -> DataFrame:
    """Per split: episodes, frames, hours, kilometres, share of all its frames that look indoor, medians, and episodes by environment.

    episodes: (split, episode_id, n, duration, length, median_speed, environment, an array of the frames' probabilities).
    """
    frames = episodes.select("split", F.explode(probabilities).alias("p")).groupBy("split").agg(F.avg((F.col("p") > 0.5).cast("double")).alias("indoor"))
    environments = episodes.groupBy("split", "environment").agg(F.count("*").alias("c")).groupBy("split").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("environment", "c")))).alias("environments"))  # a row a label
    out = episodes.groupBy("split").agg(F.count("*").alias("episodes"), F.sum("n").alias("frames"), (F.sum("duration") / 3600).alias("hours"), (F.sum("length") / 1000).alias("km"), F.percentile("median_speed", F.lit(0.5)).alias("median_speed"))
    return out.join(frames, "split", "left").join(environments, "split").withColumn("indoor", F.coalesce("indoor", F.lit(0.0)))


def action_scale(rows: DataFrame, values: list[str], share: float, seed_key: str) -> DataFrame:
    """The 95th percentile of absolute values over a hash sample, 1 at least."""
    sample = rows.filter(F.conv(F.substring(F.md5(F.col(seed_key).cast("string")), 1, 8), 16, 10).cast("double") / 4294967296.0 < share)
    scales = {v: exact_quantile(sample, F.abs(v), 0.95) for v in values}
    return sample.agg(*(F.lit(None if x is None else max(1.0, x)).cast("double").alias(v) for v, x in scales.items()), F.count("*").alias("n"))
