"""Queries on objects followed over time, ground and floors, poses in between, and balanced selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid as G
from ..operators import tracking as T
from ..operators.joins import interpolate_poses
from ..operators.quota import quota_selection as select_by_quota
from ..sources.tables import poses
from .gridding import POINTS, points
from .registry import query


def _daily(spark, sf_dir):
    """Events as sightings: a group of users is a sequence, a day a frame, places in metres."""
    rows = poses(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 86_400))
    kind = F.when(F.col("kind") == "click", "Pedestrian").when(F.col("kind") == "view", "Cyclist").otherwise("Car")
    return rows.select((F.col("rec") % 3).alias("g"), F.col("day").alias("f"), F.col("day").cast("double").alias("t"), F.col("event_id").alias("id"), kind.alias("kind"), (F.col("x") / 50).alias("x"), (F.col("y") / 10).alias("y"), (F.col("rec") % 40).alias("ident"))


@query()
def object_tracks(spark, sf_dir):
    """Labelled objects of each group linked from day to day: own ids first, then places, then where one was lost."""
    return T.link_objects(_daily(spark, sf_dir), "g")


@query()
def detection_tracks(spark, sf_dir):
    """Detections of each group followed from day to day with their velocity, as tracks that go somewhere."""
    rows = _daily(spark, sf_dir)
    return T.moving_tracks(rows, T.follow_detections(rows, "g"), "g", 3, 0.6).select("g", "track", "hits", "f0", "f1", F.round("travel", 6).alias("travel"))


def _turned(a, b):
    """A unit quaternion (w, x, y, z) from two angles."""
    c, s = (lambda v: F.cos(v / 2)), (lambda v: F.sin(v / 2))
    return {"qw": c(a) * c(b), "qx": s(a) * c(b), "qy": s(a) * s(b), "qz": c(a) * s(b)}


_TURNED = "cos(x / 200) * cos(y / 100) AS qw, sin(x / 200) * cos(y / 100) AS qx, sin(x / 200) * sin(y / 100) AS qy, cos(x / 200) * sin(y / 100) AS qz"
_Q = ("qw", "qx", "qy", "qz")
_mix = lambda q: f"round(CASE WHEN b.t IS NULL THEN f.{q} WHEN t2 IS NULL THEN b.{q} ELSE wa * b.{q} + wb * {q}2 END, 6) AS {q}"


@query(f"""WITH {{POSE}}, s0 AS (SELECT rec, t, x, {_TURNED} FROM pose WHERE f % 3 = 0), s AS (SELECT *, row_number() OVER w AS n, lead(t) OVER w AS t2, lead(x) OVER w AS x2, {", ".join(f"lead({q}) OVER w AS {q}2" for q in _Q)} FROM s0 WINDOW w AS (PARTITION BY rec ORDER BY t)),
 q AS (SELECT rec, event_id, t + 600 AS qt FROM pose WHERE f % 3 = 1), j AS (SELECT q.event_id, q.qt, q.rec AS qrec, s.* EXCLUDE (rec) FROM q ASOF LEFT JOIN s ON q.rec = s.rec AND q.qt >= s.t),
 d AS (SELECT *, (qt - t) / (t2 - t) AS u, {" + ".join(f"{q} * {q}2" for q in _Q)} AS dot FROM j), e AS (SELECT *, acos(least(abs(dot), 1)) AS ang FROM d),
 b AS (SELECT *, CASE WHEN ang < 1e-6 THEN 1 - u ELSE sin((1 - u) * ang) / sin(ang) END AS wa, CASE WHEN dot < 0 THEN -1 ELSE 1 END * CASE WHEN ang < 1e-6 THEN u ELSE sin(u * ang) / sin(ang) END AS wb FROM e), f AS (SELECT * FROM s WHERE n = 1)
 SELECT b.event_id, round(CASE WHEN b.t IS NULL THEN f.x WHEN b.t2 IS NULL THEN b.x ELSE b.x + (b.x2 - b.x) * u END, 6) AS x, {", ".join(_mix(q).replace("t2 IS", "b.t2 IS").replace(f"{q}2 END", f"b.{q}2 END") for q in _Q)} FROM b JOIN f ON f.rec = b.qrec""")
def poses_between(spark, sf_dir):
    """Place and turn of a user ten minutes after every third event, between the poses around."""
    rows = poses(spark, sf_dir)
    samples = rows.filter("f % 3 = 0").select("rec", "t", "x", *(q.alias(n) for n, q in _turned(F.col("x") / 100, F.col("y") / 50).items()))
    asked = rows.filter("f % 3 = 1").select("rec", "event_id", (F.col("t") + 600).alias("t"))
    return interpolate_poses(asked, samples, "rec", "t", ["x"], list(_Q)).select("event_id", *(F.round(c, 6).alias(c) for c in ("x", *_Q)))


@query()
def grown_ground(spark, sf_dir):
    """Ground of every cell around the middle of each sweep, grown outwards ring by ring."""
    around = points(spark, sf_dir).select("sweep", (F.col("x") - 25.0).alias("x"), (F.col("y") - 5.0).alias("y"), "z")
    return G.grow_ground(around, "sweep", 0.5, 1.0, 16).select("sweep", "ci", "cj", F.round("ground", 6).alias("ground"), "seen")


def _floor_sql(passes: int, tolerance: float) -> str:
    """CTEs fit0, fit1, ...: planes of all low points, then of those near the plane before."""
    out = f"{POINTS}, low AS (SELECT sweep, x - 25 AS x, y - 5 AS y, z - 3 AS z FROM pts WHERE sqrt(power(x - 25, 2) + power(y - 5, 2)) > 3 AND sqrt(power(x - 25, 2) + power(y - 5, 2)) < 15 AND z - 3 < -0.8)"
    for k in range(passes):
        rows = "low" if not k else f"low JOIN fit{k - 1} USING (sweep) WHERE abs(z - a * x - b * y - c) < {tolerance * 2 ** (passes - 1 - k)}"
        out += f""", m{k} AS (SELECT sweep, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(y, y) AS yy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM {rows} GROUP BY 1 HAVING count(*) >= 30),
 fit{k} AS (SELECT sweep, n AS fitted, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS a, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS b, mz - (xz * yy - yz * xy) / (xx * yy - xy * xy) * mx - (yz * xx - xz * xy) / (xx * yy - xy * xy) * my AS c FROM m{k})"""
    return out


@query(f"WITH {_floor_sql(4, 0.3)} SELECT sweep, fitted::DOUBLE AS n, round(-a / sqrt(a * a + b * b + 1), 6) AS nx, round(-b / sqrt(a * a + b * b + 1), 6) AS ny, round(-c / sqrt(a * a + b * b + 1), 6) AS height FROM fit3 WHERE 1 / sqrt(a * a + b * b + 1) >= 0.9")
def floor_planes(spark, sf_dir):
    """Floor under each sweep from its low points three to fifteen metres away, with what lies off it left out."""
    low = points(spark, sf_dir).select("sweep", (F.col("x") - 25).alias("x"), (F.col("y") - 5).alias("y"), (F.col("z") - 3).alias("z"))
    return G.floor_fit(low, "sweep", 0.3, 30).select("sweep", "n", *(F.round(c, 6).alias(c) for c in ("nx", "ny", "height")))


_OD = {"x": "sin(CAST(sweep AS DOUBLE)) / 50", "y": "cos(CAST(sweep AS DOUBLE)) / 50"}
_SORTED = lambda c: f"list_sort([{', '.join(f'coalesce(lag({c}, {-k}) OVER w, first_value({c}) OVER a)' if k < 0 else f'coalesce(lead({c}, {k}) OVER w, last_value({c}) OVER a)' for k in range(-2, 3))}])[3]"


@query(f"""WITH {_floor_sql(4, 0.3)}, sw AS (SELECT DISTINCT sweep, sweep % 4 AS rec, {_OD["x"]} AS ox, {_OD["y"]} AS oy FROM pts), fl AS (SELECT sweep, 1 / sqrt(a * a + b * b + 1) AS nz, -a / sqrt(a * a + b * b + 1) AS nx, -b / sqrt(a * a + b * b + 1) AS ny, -c / sqrt(a * a + b * b + 1) AS height FROM fit3 WHERE 1 / sqrt(a * a + b * b + 1) >= 0.9 AND sweep % 3 <> 0),
 u AS (SELECT rec, sweep, height, coalesce(nx, ox) AS ux, coalesce(ny, oy) AS uy, coalesce(nz, sqrt(1 - ox * ox - oy * oy)) AS uz FROM sw LEFT JOIN fl USING (sweep)),
 s AS (SELECT rec, sweep, {_SORTED("ux")} AS sx, {_SORTED("uy")} AS sy, {_SORTED("uz")} AS sz FROM u WINDOW w AS (PARTITION BY rec ORDER BY sweep), a AS (PARTITION BY rec ORDER BY sweep ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 h AS (SELECT rec, coalesce(quantile_cont(height, 0.5), 1.7) AS hh, avg((height IS NOT NULL)::INT) AS share FROM u GROUP BY 1)
 SELECT sweep, round(sx / sqrt(sx * sx + sy * sy + sz * sz), 6) AS up_x, round(sy / sqrt(sx * sx + sy * sy + sz * sz), 6) AS up_y, round(hh, 6) AS sensor_height, round(share, 6) AS floor_share FROM s JOIN h USING (rec)""")
def levelled_sweeps(spark, sf_dir):
    """Up vectors of sweeps: the floor's where it is seen, else the odometry's, smoothed along the recording, and one sensor height."""
    pts = points(spark, sf_dir)
    low = pts.select("sweep", (F.col("x") - 25).alias("x"), (F.col("y") - 5).alias("y"), (F.col("z") - 3).alias("z"))
    sweeps = pts.select("sweep").distinct().select("sweep", (F.col("sweep") % 4).alias("rec"), F.expr(_OD["x"]).alias("ox"), F.expr(_OD["y"]).alias("oy")).withColumn("oz", F.sqrt(1 - F.col("ox") ** 2 - F.col("oy") ** 2))
    floors = G.floor_fit(low, "sweep", 0.3, 30).filter("sweep % 3 <> 0").withColumn("rec", F.col("sweep") % 4)
    return G.levelled(sweeps, floors, "rec", "sweep", 2).select("sweep", *(F.round(c, 6).alias(c) for c in ("up_x", "up_y", "sensor_height", "floor_share")))


#: What the selection asks for: rows of each class, of a recording, seconds between rows, rows of the capped environment.
QUOTAS, PER_RECORDING, SPACING, MOST_OUTDOOR = {"purchase": 6, "click": 9, "view": 12}, 2, 3600.0, 8


@query()
def quota_selection(spark, sf_dir):
    """A balanced set of events: quotas of kinds, at most two of a user, an hour apart, outdoors capped."""
    rows = poses(spark, sf_dir)
    candidates = rows.select(F.col("event_id").alias("id"), F.col("kind").alias("klass"), F.col("rec").alias("recording"), F.col("rec").alias("segment"), "t", F.when(F.col("y") > 60, "outdoor").otherwise("indoor").alias("environment"), F.round(F.col("x") / 500, 3).alias("score"))
    return select_by_quota(candidates, QUOTAS, PER_RECORDING, SPACING, "outdoor", MOST_OUTDOOR)
