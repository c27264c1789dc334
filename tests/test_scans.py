"""Keys that are split over tasks give what keys in one piece give."""

import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import joins, kinematics, segments
from wayfold.operators.scans import RANGE, ordered, running, scan


def poses(spark, n: int = 900, seed: int = 1):
    """One key with nine tenths of the rows, one null key, small keys; equal times, null values, jumps."""
    rng, rows = random.Random(seed), []
    for k in range(n):
        key = 1 if rng.random() < 0.9 else rng.choice([None, 2, 3])
        rows.append((key, k, float(k // 2), rng.uniform(0, 3) + (k // 90) * 50, rng.uniform(0, 3), rng.uniform(-3, 3), rng.choice([None, "a", "b"])))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "rec long, f long, t double, x double, y double, yaw double, v string")


def same(a, b, places: int = 6) -> None:
    columns = [F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in a.dtypes]
    got, want = (sorted(map(tuple, df.select(*columns).collect()), key=str) for df in (a, b))
    assert got == want and got


@pytest.mark.parametrize("most", [1, 7, 50])
def test_all_running_values(spark, most):
    rows = poses(spark)
    wanted = {"previous": {"p": F.col("v")}, "following": {"n": F.col("v")}, "last": {"l": F.col("v")}, "first": {"r": F.col("v")}, "total": {"s": F.when(F.col("v") == "a", 1)}}
    assert ordered(rows, ["rec"], ["f"], most).split
    same(running(rows, ["rec"], ["f"], most, **wanted), running(rows, ["rec"], ["f"], **wanted))


@pytest.mark.parametrize("most", [1, 40])
def test_operators_on_a_large_key(spark, most):
    rows = poses(spark)
    asked = rows.filter("f % 7 = 0").select("rec", F.col("f").alias("q"), (F.col("t") + 0.25 * (F.col("f") % 5)).alias("qt"))
    marks = rows.filter("f % 11 = 0").groupBy("rec", F.col("t").alias("mt")).agg(F.max("v").alias("mark"))
    same(joins.asof(asked, marks, "rec", "qt", "mt", ["mark"], most=most), joins.asof(asked, marks, "rec", "qt", "mt", ["mark"]))
    same(joins.asof_nearest(asked, marks, "rec", "qt", "mt", ["mark"], 3.0, most=most), joins.asof_nearest(asked, marks, "rec", "qt", "mt", ["mark"], 3.0))
    samples = rows.groupBy("rec", "t").agg(F.avg("x").alias("x"), F.avg("yaw").alias("yaw"))
    times = asked.withColumnRenamed("qt", "t")
    same(joins.interpolate(times, samples, "rec", "t", ["x", "yaw"], ("yaw",), most=most), joins.interpolate(times, samples, "rec", "t", ["x", "yaw"], ("yaw",)))
    same(kinematics.arc_length(rows, "rec", most=most), kinematics.arc_length(rows, "rec"))
    same(kinematics.unwrap(rows, "rec", "yaw", "u", most=most), kinematics.unwrap(rows, "rec", "yaw", "u"))
    same(segments.cut_episodes(rows, most=most), segments.cut_episodes(rows))
    moved = rows.withColumn("position", F.col("f") + F.floor(F.col("f") / 100) * 5)
    same(segments.gap_segments(moved, "rec", F.col("position"), 2.0, most=most), segments.gap_segments(moved, "rec", F.col("position"), 2.0))


def test_rows_of_one_key_are_spread_over_tasks(spark):
    rows = spark.range(40_000).select(F.lit(1).alias("rec"), F.col("id").alias("f"), (F.col("id") % 97).cast("double").alias("x"), F.lit(0.0).alias("y"))
    on = ordered(rows, ["rec"], ["f"], 200)
    assert on.rows.select(RANGE).distinct().count() >= 190
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = scan(on, total={"s": F.lit(1)}).rows.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(parts) == tasks and max(r["count"] for r in parts) <= 2 * 40_000 / tasks


def test_empty(spark):
    assert running(poses(spark).limit(0), ["rec"], ["f"], 5, total={"s": F.lit(1)}).count() == 0
