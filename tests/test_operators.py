"""Small cases with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from wayfold.functions import geom as G
from wayfold.functions import text as X
from wayfold.operators import collision as C
from wayfold.operators import grid, joins, kinematics, metrics, segments, selection
from wayfold.operators.components import components


def one(spark, **columns):
    return spark.range(1).select(*(v.alias(k) for k, v in columns.items())).first().asDict()


def test_geometry(spark):
    lit = lambda *x: [F.lit(float(v)) for v in x]
    got = one(
        spark, front=G.box_distance(*lit(3, 0, 1, 0, 0, 2, 1)), inside=G.box_distance(*lit(1, 0, 1, 0, 0, 2, 1)), turned=G.box_distance(*lit(1, 2, 1, 0, math.pi / 2, 2, 1)),
        wrapped=G.wrap(F.lit(3 * math.pi)), yaw=G.yaw_from_quaternion(*lit(0, 0, math.sin(0.35), math.cos(0.35))), ahead=G.to_frame(*lit(0, 1, 0.5 * math.pi, 0, 3))[0],
    )
    assert got == pytest.approx({"front": 1.0, "inside": 0.0, "turned": 1.0, "wrapped": -math.pi, "yaw": 0.7, "ahead": 2.0})


def test_rigid_transforms(spark):
    m = F.array(*(F.lit(float(v)) for v in (0, -1, 0, 2, 1, 0, 0, 3, 0, 0, 1, 4, 0, 0, 0, 1)))
    product = spark.range(1).select(G.matmul(m, G.rigid_inverse(m)).alias("p")).first()["p"]
    assert product == pytest.approx([1.0 if k % 5 == 0 else 0.0 for k in range(16)])
    up = spark.range(1).select(G.upright(F.lit(0.6), F.lit(0.0), F.lit(0.8)).alias("r")).first()["r"]
    assert [sum(up[3 * r + c] * n for c, n in enumerate((0.6, 0.0, 0.8))) for r in range(3)] == pytest.approx([0, 0, 1])


def poses(spark, rows):
    return spark.createDataFrame(rows, "rec int, f int, t double, x double, y double")


def test_episodes_break_at_invalid_frames_and_jumps(spark):
    rows = [(1, k, k * 0.2, None if k == 40 else k * 0.1 + (5 if k >= 70 else 0), 0.0) for k in range(100)]
    stats = segments.episode_stats(segments.cut_episodes(poses(spark, rows)), min_frames=20, min_length=2.0)
    assert [(r.f0, r.f0 + r.n) for r in stats.orderBy("f0").collect()] == [(0, 40), (41, 70), (70, 100)]


def test_jitter_counts_nothing_while_standing(spark):
    rows = [(1, k, float(k), 0.02 * (k % 2), 0.0) for k in range(50)] + [(1, 50 + k, 50.0 + k, 0.1 * (k + 1), 0.0) for k in range(50)]
    s = {r.f: r.s for r in kinematics.jitter_free_arc(poses(spark, rows), "rec", 0.05).collect()}
    assert s[49] < 0.1 and s[99] == pytest.approx(5.0, abs=0.2)


def test_asof_ties_and_bounds(spark):
    left = spark.createDataFrame([(1, 0.5), (1, 1.0), (1, 2.5)], "k int, t double")
    right = spark.createDataFrame([(1, 1.0, "a"), (1, 2.0, "b"), (1, 3.0, "c")], "k int, rt double, v string")
    assert [r.v for r in joins.asof(left, right, "k", "t", "rt", ["v"]).orderBy("t").collect()] == [None, "a", "b"]
    assert [r.v for r in joins.asof_nearest(left, right, "k", "t", "rt", ["v"], 0.5).orderBy("t").collect()] == ["a", "a", "b"]


def test_interpolation_is_clamped(spark):
    samples = spark.createDataFrame([(1, 0.0, 0.0), (1, 2.0, 4.0)], "k int, t double, x double")
    asked = spark.createDataFrame([(1, -1.0), (1, 0.5), (1, 9.0)], "k int, t double")
    assert [r.x for r in joins.interpolate(asked, samples, "k", "t", ["x"]).orderBy("t").collect()] == [0.0, 1.0, 4.0]


def scene(spark, tracks, goal=10.0):
    """A path along x at 1 m/s and 2 Hz, and tracks of (id, kind, stationary, operator, {step: (x, y)})."""
    path = spark.createDataFrame([("s", k, k / 2, 0.0) for k in range(11)], "scenario string, step int, x double, y double")
    rows = [("s", i, k, kind, 0.6, 0.6, 1.7, float(x), float(y), 0.85, 0.0, still, op) for i, kind, still, op, at in tracks for k, (x, y) in at.items()]
    schema = "scenario string, track int, step int, kind string, length double, width double, height double, x double, y double, z double, heading double, is_stationary boolean, is_operator boolean"
    return path, spark.createDataFrame(rows, schema)


def test_no_obstacle_no_collision(spark):
    path, obs = scene(spark, [(1, "PEDESTRIAN", False, False, {k: (2, 50) for k in range(11)})])
    r = C.verdict(path, path, obs, 5, 2.0).first()
    assert not r.collided and r.ade == 0 and r.fde == 0


def test_crossing_pedestrian_is_hit_in_time(spark):
    path, obs = scene(spark, [(1, "PEDESTRIAN", False, False, {k: (2.5, 2.5 - k / 2) for k in range(11)})])
    r = C.verdict(path, path, obs, 5, 2.0).first()
    assert r.collided_dynamic and not r.collided_static and abs(r.first_collision_s - 2.2) <= 0.31
    path, late = scene(spark, [(1, "PEDESTRIAN", False, False, {k: (2.5, 5.5 - k / 2) for k in range(11)})])
    assert not C.verdict(path, path, late, 5, 2.0).first().collided


def test_stationary_track_stays_and_operators_are_ignored(spark):
    path, obs = scene(spark, [(1, "VEHICLE", True, False, {0: (3, 0)}), (2, "PEDESTRIAN", False, True, {k: (1, 0) for k in range(11)})])
    r = C.verdict(path, path, obs, 5, 2.0).first()
    assert r.collided_static and not r.collided_dynamic


def test_map_cells_collide_beyond_the_start(spark):
    path, obs = scene(spark, [(1, "PEDESTRIAN", False, False, {0: (0, 90)})])
    cell = lambda x: ("s", round(199.5 - x / 0.1), 199)
    occ = spark.createDataFrame([cell(3.0), cell(0.0)], "scenario string, row int, col int")
    near = C.map_contacts(path, occ, 5).agg(F.min("dist").alias("d"), F.min_by("sub", "dist").alias("at")).first()
    assert near.d <= 0.11 and abs(near.at - 30) <= 2


def test_at_fault_needs_the_agent_ahead(spark):
    behind, obs = scene(spark, [(1, "PEDESTRIAN", False, False, {k: (-2 + k, 0) for k in range(11)})])
    assert not C.at_fault(C.dynamic_contacts(behind, C.as_discs(obs), 5), behind, 5, 2.0).first().at_fault
    ahead, obs = scene(spark, [(1, "PEDESTRIAN", False, False, {k: (3, 0) for k in range(11)})])
    assert C.at_fault(C.dynamic_contacts(ahead, C.as_discs(obs), 5), ahead, 5, 2.0).first().at_fault


def test_following_stops_at_the_end_and_wiggle(spark):
    line = poses(spark, [(1, k, 0.0, float(k), 0.0) for k in range(2)])
    at = [r.x for r in metrics.timed(line, "rec", 2.0, 0.5, 6).orderBy("k").collect()]
    assert at == pytest.approx([0.25, 0.5, 0.75, 1.0, 1.0, 1.0])
    zigzag = poses(spark, [(1, k, 0.0, float(k), float(k % 2)) for k in range(10)])
    curve = poses(spark, [(1, k, 0.0, math.cos(k / 5), math.sin(k / 5)) for k in range(10)])
    assert metrics.wiggle(zigzag, "rec").first().wiggle > 5 and metrics.wiggle(curve, "rec").first().wiggle < 0.3


def test_reward_terms_are_known(spark):
    given = lambda spec: spark.range(1).select(metrics.reward_weights(spec).alias("w")).first().w
    assert given("goal=2, smooth") == {"goal": 2.0, "smooth": 1.0} and given("") == {}
    with pytest.raises(Exception, match="no such reward: speed"):
        given("speed=1")


def test_thinning_equals_going_through_in_order(spark):
    import random

    draw = random.Random(3)
    vectors = [[draw.gauss(0, 1) for _ in range(3)] for _ in range(60)]
    unit = [[x / math.sqrt(sum(y * y for y in v)) for x in v] for v in vectors]
    kept = []
    for k, v in enumerate(unit):
        if all(sum(a * b for a, b in zip(v, unit[j])) <= 0.9 for j in kept):
            kept.append(k)
    rows = spark.createDataFrame([(k, k, 0, v) for k, v in enumerate(unit)], "id long, rank long, g int, embedding array<double>")
    assert sorted(r.id for r in selection.thin(rows, ["g"], 0.9).collect()) == kept


def test_components_and_closing(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 30)] + [(50, 51), (51, 60)], "a long, b long")
    assert {(r.node, r.root) for r in components(edges).collect()} == {(k, 1) for k in range(1, 31)} | {(50, 50), (51, 50), (60, 50)}
    cells = spark.createDataFrame([(0, x, y) for x in range(5) for y in range(5) if (x, y) != (2, 2)], "s int, ix int, iy int")
    assert grid.closing(cells, ["s"], 3).filter("ix = 2 and iy = 2").count() == 1


def test_words(spark):
    got = one(
        spark, a=X.lower_first(F.lit(" Turn left. ")), b=X.lower_first(F.lit("TV room")), c=X.view_label(F.lit(-3)), d=X.json_in_text(F.lit('so {"k": 4}!'), "k int")["k"], h=X.lower_first(F.lit("A door")),
        e=X.camera_sentence(F.lit(90.2), F.lit(None).cast("double"), F.lit(1.234), F.lit("dataset")), f=X.camera_sentence(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(1.2), F.lit("estimated")),
        g=X.instruction_text(description=F.lit("Go on."), place=F.lit(""), interaction=F.lit("a dog")),
    )
    assert got == {
        "a": "turn left", "b": "TV room", "c": "View 3 s ago:", "d": 4, "h": "a door", "e": "The camera's horizontal field of view is 90 degrees; it is mounted 1.23 m above the ground.",
        "f": "The camera's field of view is unknown; its height above the ground is unknown.", "g": "Task: Go on. Reacts to: a dog.",
    }


def test_heights_of_points_that_share_an_id(spark, tmp_path):
    from wayfold.plans.gridding import height_above_ground

    rows = [(k // 3, k % 2, k % 5, float(1 + k * 7 % 50), k * 3 % 11 / 100, 900.0 + k * 7919 % 100_000, k) for k in range(3000)]
    rows += rows[:100]  # equal rows are points of their own
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_discount double, l_extendedprice double, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    pts = [(r[2] % 20, r[3], r[4] * 100, r[5] / 40000) for r in rows]
    cells = {}
    for sweep, x, y, z in pts:
        cells.setdefault((sweep, math.floor(x / 8), math.floor(y / 8)), []).append(z)
    ground = {c: sorted(zs)[int(len(zs) * 0.1)] for c, zs in cells.items() if len(zs) >= 30}
    for _ in range(3):
        around = {c: [ground[n] for a in (-1, 0, 1) for b in (-1, 0, 1) if (n := (c[0], c[1] + a, c[2] + b)) in ground] for c in cells if c not in ground}
        ground |= {c: sum(g) / len(g) for c, g in around.items() if g}
    above = {}
    for sweep, x, y, z in pts:
        u, v = x / 8 - 0.5, y / 8 - 0.5
        near = [((u - math.floor(u) if a else 1 - u + math.floor(u)) * (v - math.floor(v) if b else 1 - v + math.floor(v)), ground[c]) for a in (0, 1) for b in (0, 1) if (c := (sweep, math.floor(u) + a, math.floor(v) + b)) in ground]
        if near:
            weights = sum(w for w, _ in near)
            above.setdefault(sweep, []).append(z - sum(w * g for w, g in near) / weights if weights else None)
    got = {}
    for r in height_above_ground(spark, str(tmp_path)).collect():
        got.setdefault(r.sweep, []).append(r.above)
    order = lambda values: sorted(v for v in values if v is not None)
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in above.items()}
    for sweep, heights in got.items():
        assert order(heights) == pytest.approx(order(above[sweep]), abs=1.1e-5)


def test_wiggle_makes_rows_by_corners_not_by_length(spark):
    """Long pieces make two rows each; what they add up to is that of all points, also where a path is cut into ranges."""
    import math
    import random

    draw, rows = random.Random(4), []
    for rec in range(40):
        x, y = 0.0, 0.0
        for f in range(draw.randint(1, 14)):
            step = draw.choice((0.0, 0.03, 0.1, 0.5, 3.0))
            turn = draw.choice((0.0, math.pi / 2, math.pi, draw.random() * 7))
            x, y = x + step * math.cos(turn), y + step * math.sin(turn)
            rows.append((rec, f, None if draw.random() < 0.02 else x, y))
    paths = spark.createDataFrame(rows, "rec int, f int, x double, y double")
    start = paths.filter("f = 0").select("rec", F.lit(0).cast("long").alias("k"), "x", "y")
    points = {}
    for r in start.unionByName(metrics.resample(paths, "rec", 0.1).select("rec", "k", "x", "y")).collect():
        points.setdefault(r.rec, {})[r.k] = (r.x, r.y)
    wanted = {}
    for rec, at in points.items():
        heading, turns = None, []
        for k in range(1, len(at)):
            (ax, ay), (bx, by) = at[k - 1], at[k]
            if None not in (ax, ay, bx, by) and math.hypot(bx - ax, by - ay) > 1e-6:
                now = math.atan2(by - ay, bx - ax)
                if heading is not None:
                    raw = math.remainder(now - heading, 2 * math.pi)
                    turns.append(-math.pi if abs(raw) > math.pi - 1e-9 else raw)
                heading = now
        wanted[rec] = sum(map(abs, turns)) - abs(sum(turns))
    for most in (None, 4):
        found = {r.rec: r.wiggle for r in metrics.wiggle(paths, "rec", most=most).collect()}
        assert found.keys() == wanted.keys() and all(abs(found[rec] - wanted[rec]) < 1e-6 for rec in wanted)
    far = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1e7, 0.0), (1, 2, 1e7, 1e7)], "rec int, f int, x double, y double")
    assert metrics.corners(far, "rec", 0.1).rows.count() <= 7 and metrics.wiggle(far, "rec").first().wiggle < 1e-6
