"""Joins whose sides are multiplied, and places where many rows lie."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import collision, joins, selection


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_links_are_mutual_nearest(spark):
    pick = random.Random(3)
    rows = [(g, f, 100 * f + k + 10_000 * g, float(pick.randint(0, 30)), float(pick.randint(0, 10))) for g in range(2) for f in range(5) for k in range(60)]
    found = joins.link_frames(spark.createDataFrame(rows, "g int, f long, id long, x double, y double"), "g", 2.0, 2)
    pairs = [(a, b, b[1] - a[1], math.dist(a[3:], b[3:])) for a in rows for b in rows if a[0] == b[0] and 1 <= b[1] - a[1] <= 2]
    pairs = [p for p in pairs if p[3] <= 2.0 * p[2]]
    out, into = {}, {}
    for a, b, k, d in pairs:
        out[a[2]] = min(out.get(a[2], (9, 9, 9)), (k, d, b[2]))
        into[b[2]] = min(into.get(b[2], (9, 9, 9)), (k, d, a[2]))
    assert {(r.id, r.next_id) for r in found.collect()} == {(a, n) for a, (_, _, n) in out.items() if into[n][2] == a}


def test_links_meet_few_rows_where_many_lie(spark):
    rows = spark.range(4000).select(F.lit(1).alias("g"), (F.col("id") % 2).alias("f"), "id", F.rand(1).alias("x"), F.rand(2).alias("y"))
    near = joins.nearest(rows.filter("f = 0").withColumn("hit", F.lit(None).cast("struct<d:double,id:bigint>")).drop("f"), rows.filter("f = 1").drop("f"), ["g"], 2.0, 6)
    hits = {r.id: r.hit.id for r in near.collect()}
    at = {r.id: (r.f, r.x, r.y) for r in rows.collect()}
    ids = random.Random(1).sample(sorted(hits), 20)
    assert all(hits[i] == min((math.dist(at[i][1:], p[1:]), j) for j, p in at.items() if p[0] == 1)[1] for i in ids) and len(hits) == 2000


def test_points_at_one_place_meet_its_boxes_once(spark):
    points = spark.range(1000).select("id", F.lit(1).alias("g"), (F.col("id") % 2).cast("double").alias("px"), F.lit(0.0).alias("py"))
    boxes = spark.range(300).select(F.col("id").alias("box"), F.lit(1).alias("g"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"), F.lit(0.0).alias("heading"), F.lit(1.0).alias("length"), F.lit(1.0).alias("width"), (F.col("id") == 7).alias("moving"))
    held = joins.held_points(points, boxes, ["g"], 1.0, 0.01, F.max("box").alias("box"), F.count("*").alias("n"))
    assert {tuple(r) for r in held.groupBy("px", "box", "n").count().collect()} == {(0.0, 299, 300, 500)}
    assert joins.outside_boxes(points, boxes, ["g"], 1.0, 0.01, "id").count() == 500
    labelled = joins.label_points(points.withColumn("ground", F.col("id") < 10), boxes, ["g"], 1.0, 0.01, "id", "ground")
    assert {tuple(r) for r in labelled.groupBy("label", "box").count().collect()} == {("ground", None, 10), ("dynamic", 299, 495), ("static", None, 495)}
def test_windows_are_not_sent_to_all_tasks(spark):
    frames = spark.range(50).select(F.lit(1).alias("rec"), F.col("id").alias("f"), F.rand(1).alias("x"))
    found = joins.windows_around(frames, frames, ["rec"], "f", 10, 10)
    assert "BroadcastHashJoin" not in plan(found) and found.count() == 50 * 21 - 2 * sum(range(1, 11))


@pytest.mark.parametrize("contacts", ["static_contacts", "dynamic_contacts"])
def test_sub_steps_are_made_after_the_join(spark, contacts):
    """What is shuffled and sorted for contacts is a row a step: nothing is exploded below a join."""
    path = spark.createDataFrame([(1, k, float(k), 0.0) for k in range(4)], "scenario long, step int, x double, y double")
    kind = contacts == "static_contacts"
    obs = spark.createDataFrame([(1, 7, k, 2.0 + 0.1 * k, 1.0, 0.5, 1.0, 0.6, 0.25, kind) for k in range(4)], "scenario long, track long, step int, x double, y double, heading double, length double, width double, reach double, is_stationary boolean")
    found = getattr(collision, contacts)(path, obs, 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "Join" in plan and plan.rindex("Generate") < plan.index("Join")
    assert sorted(r.sub for r in found.collect()) == list(range(1, 16))
    assert sorted(r.sub for r in getattr(collision, contacts)(path, obs, 1).collect()) == [1, 2, 3]


def test_candidates_are_written_once_however_many_rounds(spark, monkeypatch):
    """Rounds of a coverage selection write what they took, not what is left."""
    rows = [(k, k % 2, k % 7, k % 50, float(k), [f"a{k % 5}", f"b{k % 3}"]) for k in range(1000)]
    frame = spark.createDataFrame(rows, "id long, stratum long, source long, recording long, t double, tags array<string>")
    written, real = [], selection.cut_lineage
    monkeypatch.setattr(selection, "cut_lineage", lambda df, name: (out := real(df, name), written.append(out.count()))[0])
    assert selection.cover(frame, 4, 2, 4, 10.0).count() == 8 and sum(written) < 1200


@pytest.mark.parametrize("block", [3, 256])
def test_close_pairs_of_a_crowd(spark, block):
    """All pairs once, whatever the blocks; rows without a place, or with none to reckon with, have none."""
    pick = random.Random(5)
    rows = [(k % 2, k, pick.randint(-40, 40) / 2, pick.randint(-20, 20) / 2) for k in range(300)] + [(0, 300 + k, 1.0, 1.0) for k in range(20)]
    odd = [(0, 900, None, 1.0), (0, 901, 1.0, None), (0, 902, math.nan, 1.0), (0, 903, math.inf, 1.0), (0, 904, -math.inf, 1.0), (None, 905, 1.0, 1.0), (0, 906, 1e308, 1e308), (0, 907, 1e308, 1e308)]
    found = joins.close_pairs(spark.createDataFrame(rows + odd, "g int, id long, x double, y double"), ["g"], "id", 2.5, block)
    near = [(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and math.dist(a[2:], b[2:]) <= 2.5]
    assert sorted((r.g, r.a, r.b) for r in found.collect()) == sorted([*near, (0, 906, 907)])


def test_close_pairs_join_blocks_not_rows(spark):
    """What is shuffled, sorted and buffered for the join is a block of rows; rows are taken out of it after the join."""
    rows = spark.range(500).select(F.lit(1).alias("g"), "id", F.rand(1).alias("x"), F.rand(2).alias("y"))
    found = joins.close_pairs(rows, ["g"], "id", 2.0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan[: plan.index("Join")].count("Generate inline") == 2 and found.count() == 500 * 499 // 2


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_frames_are_linked_across_pieces_with_one_shuffle(spark):
    """Rows at the edges of pieces of the plane (32 wide here) and of the frames (16), some at one place, against all pairs."""
    draw, rows = random.Random(8), []
    for i in range(900):
        rows.append((draw.randrange(2), draw.randrange(12, 37), i, draw.choice((0.0, 32.0, -32.0, 64.0)) + round(draw.uniform(-4, 4), 1), 32.0 + round(draw.uniform(-3, 3), 1)))
    rows += [(None, 15, 1000, 0.0, 0.0), (0, None, 1001, 0.0, 0.0), (0, 16, 1002, None, 0.0), (0, 16, 1003, float("nan"), 0.0)]
    links = joins.link_frames(spark.createDataFrame(rows, "g int, f long, id long, x double, y double"), "g", 2.0, 2)
    assert exchanges(links) == 1
    best = {}
    for g, f, i, x, y in rows[:900]:
        for h, n, j, u, v in rows[:900]:
            if g == h and 0 < n - f <= 2 and (d := math.sqrt((x - u) ** 2 + (y - v) ** 2)) <= 2.0 * (n - f):
                for key, of in ((("ahead", i), (n - f, d, j)), (("before", j), (n - f, d, i))):
                    best[key] = min(best.get(key, of), of)
    wanted = {(i, of[2]) for (way, i), of in best.items() if way == "ahead" and best["before", of[2]][2] == i}
    found = links.collect()
    assert {(r.id, r.next_id) for r in found} == wanted and len(found) == len(wanted) > 100


def test_scenarios_are_nested_across_pieces_with_one_shuffle(spark):
    """Windows that cross the edge of a piece of frames, with a gap and a row that comes twice, are those made of all steps."""
    from wayfold.operators import scenario

    frames = [f for f in range(990, 1100) if f != 1070] + [1002]
    poses = spark.createDataFrame([(1, f, float(f), f * 0.5, math.sin(f / 3), f / 10) for f in frames] + [(None, f, 0.0, 0.0, 0.0, 0.0) for f in range(21)], "s int, f int, t double, x double, y double, yaw double")
    nested = scenario.nested_windows(poses, "s", 1, 0.0, 1.0)
    assert exchanges(nested) == 1
    steps = {(r.anchor, s.step, s.f, s.t): (s.x, s.y, s.yaw) for r in nested.collect() for s in r.steps}
    wanted = {(r.anchor, r.step, r.anchor + r.step - 10, r.t): (r.x, r.y, r.yaw) for r in scenario.scenario_windows(poses, "s", 1, 0.0).collect()}
    assert steps.keys() == wanted.keys() and {a for a, *_ in steps} >= {*range(1013, 1060), *range(1081, 1090)}
    assert all(math.dist(steps[k], wanted[k]) < 1e-9 for k in wanted)
