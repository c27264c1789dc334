"""Objects and detections on small analytic cases."""

import math
import random
import time
from collections import Counter

import numpy as np

from wayfold.operators import grid, pairing, tracking

OBJECT = "seq int, f int, t double, id long, kind string, x double, y double, ident int"


def tracks(spark, frames):
    """Sizes and members of the tracks of frames [(kind, ident, x, y), ...]."""
    rows = [(1, f, float(f), f * 100 + k, *o[:1], *o[2:], o[1]) for f, objects in enumerate(frames) for k, o in enumerate(objects)]
    found = {}
    for r in tracking.link_objects(spark.createDataFrame(rows, OBJECT), "seq").collect():
        found.setdefault(r.track, set()).add(r.id)
    return found, {r[3]: r for r in rows}


def test_objects_go_on_where_ids_change(spark):
    first = [[("Pedestrian", 7, 5.0, float(t)), ("Car", 8, -6.0, 3.0)] for t in range(5)]
    then = [[("Car", 1, -6.0, 3.1), ("Pedestrian", 2, 5.0, float(t))] for t in range(5, 10)]
    found, rows = tracks(spark, first + then)
    assert sorted(map(len, found.values())) == [10, 10] and all(len({rows[i][4] for i in ids}) == 1 for ids in found.values())


def test_the_same_id_far_away_is_another_object(spark):
    found, _ = tracks(spark, [[("Pedestrian", 7, 5.0, 0.0)]] * 3 + [[("Pedestrian", 7, 15.0, 0.0)]] * 3)
    assert sorted(map(len, found.values())) == [3, 3]


def test_an_id_that_would_have_to_fly_does_not_count(spark):
    found, _ = tracks(spark, [[("Pedestrian", 7, 5.0, 0.0)], [("Pedestrian", 7, 5.0, 10.0)], [("Pedestrian", 7, 5.0, 10.5)]])
    assert sorted(map(len, found.values())) == [1, 2]


def test_ids_that_repeat_in_a_frame_fall_back_to_place(spark):
    found, rows = tracks(spark, [[("Pedestrian", 3, 5.0, 0.5 * t), ("Pedestrian", 3, -5.0, -0.5 * t)] for t in range(6)])
    assert sorted(map(len, found.values())) == [6, 6] and all(len({rows[i][5] for i in ids}) == 1 for ids in found.values())


def test_an_object_is_found_again_near_where_it_was_lost(spark):
    seen = [("Car", None, 1.0, 1.0)]
    assert len(tracks(spark, [seen, [("Car", None, 40.0, 40.0)], seen])[0]) == 2
    assert len(tracks(spark, [seen, *[[("Car", None, 40.0, 40.0)]] * 3, seen])[0]) == 3  # missing for too long
    assert len(tracks(spark, [seen, [("Pedestrian", None, 1.0, 1.0)]])[0]) == 2  # of another kind


def test_a_walker_is_followed_and_a_wall_is_not(spark):
    """Points of a wall and of a person who walks by, from cells that are not always taken to tracks."""
    draw = random.Random(0)
    cells, points = [], []
    for f in range(120):
        at = -4 + 0.12 * f
        wall = [(-5 + k / 20, 3.0) for k in range(200)]
        person = [(at + draw.gauss(0, 0.1), draw.gauss(0, 0.1)) for _ in range(30)]
        for k, (x, y) in enumerate(wall + person):
            points.append((1, f, f * 1000 + k, x, y, k >= 200))
            cells.append((1, math.floor(x / 0.4), math.floor(y / 0.4), f))
    seen = {(r.ix, r.iy, r.f): r.n_seen for r in grid.presence(spark.createDataFrame(cells, "seq int, ix long, iy long, f long"), ["seq", "ix", "iy"], "f", 50).collect()}
    moving = [p for p in points if seen[math.floor(p[3] / 0.4), math.floor(p[4] / 0.4), p[1]] < 20]
    assert sum(p[5] for p in moving) > 0.8 * sum(p[5] for p in points) and not any(not p[5] for p in moving)
    of_frame = {}
    for p in moving:
        of_frame.setdefault(p[1], []).append(p)
    middles = [(1, f, f / 10, f, sum(p[3] for p in ps) / len(ps), sum(p[4] for p in ps) / len(ps)) for f, ps in of_frame.items()]
    dets = spark.createDataFrame(middles, "seq int, f long, t double, id long, x double, y double")
    found = tracking.moving_tracks(dets, tracking.follow_detections(dets, "seq"), "seq").collect()
    assert len(found) == 1 and found[0].travel > 8 and found[0].hits > 100


def test_detections_cross_and_miss(spark):
    """Two walkers whose ways cross keep their velocity; one is missed for three frames; frames come in several batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(1, f, f * 0.1, 2 * f, -2 + 0.1 * f, -2 + 0.1 * f) for f in range(40)] + [(1, f, f * 0.1, 2 * f + 1, -2 + 0.1 * f, 2 - 0.1 * f) for f in range(40) if f not in (10, 11, 12)]
        dets = spark.createDataFrame(rows, "seq int, f long, t double, id long, x double, y double")
        found = Counter((r.track, r.id % 2) for r in tracking.follow_detections(dets, "seq").collect())
        assert found == {(0, 0): 40, (1, 1): 37}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_nothing_comes_of_nothing(spark):
    empty = spark.createDataFrame([], OBJECT)
    assert tracking.link_objects(empty, "seq").count() == 0 and tracking.follow_detections(empty, "seq").count() == 0
    odd = spark.createDataFrame([(None, 0, 0.0, 1, "Car", 1.0, 1.0, None), (None, 1, 1.0, 2, "Car", 1.0, 1.0, None), (1, 0, None, 3, "Car", None, 1.0, 1), (1, 0, 0.0, 4, "Tree", 1.0, 1.0, 1)], OBJECT)
    assert sorted((r.id, r.track) for r in tracking.link_objects(odd, "seq").collect()) == [(1, 1), (2, 1)]


def test_walkers_stand_on_the_ground_and_look_ahead(spark):
    rows = spark.createDataFrame([(1, 5, f, float(f), 2.0 * f) for f in range(4)], "seq int, track int, f int, x double, y double")
    ground = spark.createDataFrame([(1, f, 0.5 * f) for f in range(4)], "seq int, f int, ground double")
    for r in tracking.walkers(rows, "seq", ground).collect():
        assert abs(r.z - (0.5 * r.f + 0.85)) < 1e-9 and abs(r.heading - math.atan2(2, 1)) < 1e-9 and (r.l, r.w, r.h) == (0.6, 0.6, 1.7)


def test_pairs_drawn_from_cells_are_those_of_all_offers():
    pick = random.Random(5)
    for n, limit in ((0, 1.0), (1, 1.0), (40, 3.0), (300, 0.7)):
        rows = [{"id": b, "x": float(pick.randint(0, 20)) / 2, "y": pick.random() * pick.choice((0.0, 8.0))} for b in range(n)]
        lefts = [(pick.random() * 14 - 2, float(pick.randint(-2, 10)), pick.choice((0.0, 1.0))) for _ in range(200)]
        cost = lambda a, b: (d + lefts[a][2], (a, b), a, b) if (d := math.hypot(lefts[a][0] - rows[b]["x"], lefts[a][1] - rows[b]["y"])) <= limit else None  # noqa: E731, B023
        offers = [o for a in range(200) for b in range(n) if (o := cost(a, b)) is not None]
        crowd = tracking.Crowd(rows, list(range(n)))
        streams = [crowd.around(x, y, limit, lambda b, a=a: cost(a, b), plus) for a, (x, y, plus) in enumerate(lefts)]
        assert sorted(tracking.pair_off_near([], streams, lambda b: crowd)) == sorted(tracking.pair_off(offers))


def test_places_are_paired_as_all_offers_are():
    """Crowds, equal places and costs, several classes, offers by name and reaches of their own, against all offers in order."""
    pick = random.Random(9)
    for n, m, grid_of, extent in ((0, 3, 1, 5.0), (3, 0, 1, 5.0), (60, 50, 4, 6.0), (400, 420, 8, 9.0), (300, 300, 1, 0.0), (200, 250, 64, 3.0)):
        place = lambda: round(pick.random() * extent * grid_of) / grid_of  # noqa: E731, B023
        lefts = [(place(), place(), pick.choice((0.0, 0.5, 2.0)), pick.randrange(2), pick.random() < 0.7) for _ in range(n)]
        rights = [(place(), place(), pick.randrange(2)) for _ in range(m)]
        named = [(pick.random() * 0.3, a, b) for a, b in zip(range(0, n, 7), range(0, m, 5))]
        given = {(a, b): c for c, a, b in named}
        offers = []
        for a, (x, y, limit, kind, near) in enumerate(lefts):
            for b, (u, v, other) in enumerate(rights):
                d = math.hypot(x - u, y - v)
                if (c := given.get((a, b), d + (not near) if kind == other and d <= limit else None)) is not None:
                    offers.append((c, (a, b), a, b))
        x, y, limit, kind, near = (np.array(c) for c in zip(*lefts)) if n else (np.zeros(0),) * 5
        u, v, other = (np.array(c) for c in zip(*rights)) if m else (np.zeros(0),) * 3
        kind, other, near = kind.astype(int), other.astype(int), near.astype(bool)
        looks = [pairing.Looks(at := np.flatnonzero(near == ok), x[at], y[at], limit[at], kind[at], other, plus) for ok, plus in ((True, 0.0), (False, 1.0))]
        found = pairing.pair_off_places([x, y, limit, kind, near], looks, u, v, [other], named)
        assert sorted(tracking.pair_off(offers)) == sorted((int(a), b) for b, a in enumerate(found) if a >= 0)


def test_a_crowded_frame_is_followed_in_bounded_time():
    """Twenty thousand detections in reach of each other, and as many that fall together: all offers would be 400 million."""
    draw = np.random.default_rng(3)
    n, began = 20_000, time.monotonic()
    for x in (draw.random(n) / 10, np.zeros(n)):
        y, zero = (draw.random(n) / 10 if x.any() else x), np.zeros(n, int)
        found = pairing.pair_off_places([x, y], [pairing.Looks(np.arange(n), x, y, np.full(n, 0.8), zero, zero)], x[::-1].copy(), y[::-1].copy(), [zero])
        assert (found == (np.arange(n)[::-1] if x.any() else np.arange(n))).all()
    assert time.monotonic() - began < 60


def test_detections_without_a_frame_are_tracks_of_their_own(spark):
    rows = [(1, None, None, 1, 0.0, 0.0), (1, None, None, 2, 0.0, 0.0), (1, 0, 0.0, 3, 0.0, 0.0), (1, 1, 1.0, 4, 0.0, 0.0)]
    dets = spark.createDataFrame(rows, "seq int, f long, t double, id long, x double, y double")
    assert sorted((r.id, r.track) for r in tracking.follow_detections(dets, "seq").collect()) == [(1, 1), (2, 2), (3, 3), (4, 3)]
