"""Queries on collision scoring, path measures, tags and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import collision as C
from ..operators import metrics as M
from ..operators import reports as R
from ..sources.tables import poses, table
from .registry import query

RATE, SUB = 2.0, 5


def scenario_tables(spark, sf_dir):
    """Scenarios from events: every 11 rows in a row of every fifth user are a robot's path, those of the four users after it objects around it."""
    rows = poses(spark, sf_dir)
    scenario = ((F.col("rec") - F.col("rec") % 5) * 1000 + F.floor(F.col("f") / 11)).alias("scenario")
    ego = rows.filter("rec % 5 = 0").select(scenario, (F.col("f") % 11).alias("step"), (F.col("x") / 50).alias("x"), (F.col("y") / 10).alias("y"))
    obs = rows.filter("rec % 5 <> 0").select(scenario, F.col("rec").alias("track"), (F.col("f") % 11).alias("step"),
        F.when(F.col("rec") % 5 == 1, "PEDESTRIAN").when(F.col("rec") % 5 == 4, "STATIC").otherwise("VEHICLE").alias("kind"), F.lit(1.0).alias("length"), F.lit(0.6).alias("width"), F.lit(1.7).alias("height"),
        (F.col("x") / 50).alias("x"), (F.col("y") / 10).alias("y"), F.lit(0.85).alias("z"), (F.col("y") / 30).alias("heading"), (F.col("rec") % 5 >= 3).alias("is_stationary"), F.lit(False).alias("is_operator"))
    return ego, obs


SCENE = """{POSE}, ego AS (SELECT rec * 1000 + f // 11 AS scenario, f % 11 AS step, x / 50 AS x, y / 10 AS y FROM pose WHERE rec % 5 = 0),
 obs AS (SELECT (rec - rec % 5) * 1000 + f // 11 AS scenario, rec AS track, f % 11 AS step, x / 50 AS x, y / 10 AS y, y / 30 AS h, rec % 5 >= 3 AS st, CASE WHEN rec % 5 = 1 THEN 0.0 ELSE 1.0 END AS len, CASE WHEN rec % 5 = 1 THEN 0.0 ELSE 0.6 END AS wid, CASE WHEN rec % 5 = 1 THEN 0.55 ELSE 0.25 END AS reach FROM pose WHERE rec % 5 <> 0),
 dense AS (SELECT scenario, step * 5 + k AS sub, CASE WHEN k = 5 THEN x2 ELSE x + (x2 - x) * k / 5.0 END AS px, CASE WHEN k = 5 THEN y2 ELSE y + (y2 - y) * k / 5.0 END AS py FROM (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(step) OVER w AS s2 FROM ego WINDOW w AS (PARTITION BY scenario ORDER BY step)) e, generate_series(1, 5) AS g(k) WHERE s2 = step + 1),
 st0 AS (SELECT scenario, x AS x0, y AS y0 FROM ego WHERE step = 0)"""
GAP = "sqrt(power(greatest(abs(cos({h}) * ({px} - {x}) + sin({h}) * ({py} - {y})) - len / 2, 0), 2) + power(greatest(abs(cos({h}) * ({py} - {y}) - sin({h}) * ({px} - {x})) - wid / 2, 0), 2)) - reach"
_gap = lambda px, py, x="x", y="y", h="h": GAP.format(px=px, py=py, x=x, y=y, h=h)
CONTACTS = f"""{SCENE}, fz AS (SELECT scenario, track, arg_min(x, step) AS x, arg_min(y, step) AS y, arg_min(h, step) AS h, any_value(len) AS len, any_value(wid) AS wid, any_value(reach) AS reach FROM obs WHERE st GROUP BY 1, 2),
 sc AS (SELECT d.scenario, track, sub, {_gap('px', 'py')} AS gap FROM dense d JOIN fz USING (scenario) JOIN st0 USING (scenario) WHERE {_gap('x0', 'y0')} > 0),
 mv AS (SELECT * FROM obs o WHERE NOT st AND NOT EXISTS (SELECT 1 FROM obs p JOIN st0 USING (scenario) WHERE p.scenario = o.scenario AND p.track = o.track AND p.step = 0 AND {_gap('x0', 'y0', 'p.x', 'p.y', 'p.h').replace('len', 'p.len').replace('wid', 'p.wid').replace('reach', 'p.reach')} <= 0)),
 nx AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(h) OVER w AS h2, lead(step) OVER w AS s2 FROM mv WINDOW w AS (PARTITION BY scenario, track ORDER BY step)),
 md AS (SELECT scenario, track, step * 5 + k AS sub, x + (x2 - x) * k / 5.0 AS x, y + (y2 - y) * k / 5.0 AS y, h + ((h2 - h + pi()) - 2 * pi() * floor((h2 - h + pi()) / (2 * pi())) - pi()) * k / 5.0 AS h, len, wid, reach FROM nx, generate_series(1, 4) AS g(k) WHERE s2 = step + 1
  UNION ALL SELECT scenario, track, step * 5, x, y, h, len, wid, reach FROM mv WHERE step > 0),
 dc AS (SELECT m.scenario, track, m.sub, {_gap('px', 'py')} AS gap, px, py, x AS ax, y AS ay FROM md m JOIN dense d ON d.scenario = m.scenario AND d.sub = m.sub)"""


@query(f"""WITH {CONTACTS}, a AS (SELECT scenario, sub, gap, 's' AS who FROM sc UNION ALL SELECT scenario, sub, gap, 'd' FROM dc),
 h AS (SELECT scenario, coalesce(bool_or(gap <= 0 AND who = 'd'), false) AS collided_dynamic, coalesce(bool_or(gap <= 0 AND who = 's'), false) AS collided_static, min(CASE WHEN who = 'd' THEN gap END) AS cd, min(CASE WHEN who = 's' THEN gap END) AS cs, min(CASE WHEN gap <= 0 THEN sub END) / 10.0 AS t FROM a GROUP BY 1)
 SELECT e.scenario, coalesce(collided_dynamic, false) AS collided_dynamic, coalesce(collided_static, false) AS collided_static, round(cd, 5) AS clearance_dynamic, round(cs, 5) AS clearance_static, round(t, 4) AS first_collision_s FROM (SELECT scenario FROM ego GROUP BY 1 HAVING count(*) FILTER (WHERE step > 0) > 0) e LEFT JOIN h USING (scenario)""")
def path_collision(spark, sf_dir):
    """Recorded paths against moving and stationary objects."""
    ego, obs = scenario_tables(spark, sf_dir)
    out = C.verdict(ego, ego, obs.withColumn("kind", F.when(F.col("kind") == "STATIC", "VEHICLE").otherwise(F.col("kind"))), SUB, RATE)
    return out.select("scenario", "collided_dynamic", "collided_static", F.round("clearance_dynamic", 5).alias("clearance_dynamic"), F.round("clearance_static", 5).alias("clearance_static"), F.round("first_collision_s", 4).alias("first_collision_s"))


@query(f"""WITH {CONTACTS.replace("<= 0)),", "<= 1e-9)),")} SELECT scenario, track, min(sub) AS sub FROM dc WHERE gap <= 1e-9 GROUP BY 1, 2""")
def first_contact(spark, sf_dir):
    """First sub-step at which each moving object is touched."""
    ego, obs = scenario_tables(spark, sf_dir)
    hits = C.dynamic_contacts(ego, C.as_discs(C.reachable(obs, False)), SUB, C.ROUNDING).filter(F.col("gap") <= C.ROUNDING)
    return hits.groupBy("scenario", "track").agg(F.min("sub").alias("sub"))


@query(f"""WITH {CONTACTS}, all_ AS (SELECT scenario, sub, px, py FROM dense UNION ALL SELECT scenario, 0, x0, y0 FROM st0), v AS (SELECT scenario, sub, (coalesce(lead(px) OVER w, px) - coalesce(lag(px) OVER w, px)) / ((lead(px) OVER w IS NOT NULL)::INT + (lag(px) OVER w IS NOT NULL)::INT) / 0.1 AS vx, (coalesce(lead(py) OVER w, py) - coalesce(lag(py) OVER w, py)) / ((lead(px) OVER w IS NOT NULL)::INT + (lag(px) OVER w IS NOT NULL)::INT) / 0.1 AS vy FROM all_ WINDOW w AS (PARTITION BY scenario ORDER BY sub)),
 c AS (SELECT scenario, track, min(sub) AS sub, arg_min(px, sub) AS px, arg_min(py, sub) AS py, arg_min(ax, sub) AS ax, arg_min(ay, sub) AS ay FROM dc WHERE gap <= 0 GROUP BY 1, 2), g AS (SELECT scenario, bool_or((ax - px) * vx + (ay - py) * vy > 0 AND sqrt(vx * vx + vy * vy) > 0.05) AS at_fault FROM c JOIN v USING (scenario, sub) GROUP BY 1)
 SELECT s.scenario, coalesce(at_fault, false) AS at_fault FROM (SELECT DISTINCT scenario FROM ego) s LEFT JOIN g USING (scenario)""")
def at_fault(spark, sf_dir):
    """Whether the robot causes a contact, for every scenario."""
    ego, obs = scenario_tables(spark, sf_dir)
    return C.at_fault(C.dynamic_contacts(ego, C.as_discs(C.reachable(obs, False)), SUB), ego, SUB, RATE)


CELLS = """pc AS (SELECT scenario, sub, CAST(round_even(199.5 - px / 0.1, 0) AS INT) AS pr, CAST(round_even(199.5 - py / 0.1, 0) AS INT) AS pcol FROM dense), cells AS (SELECT DISTINCT scenario, CAST(round_even(199.5 - x / 0.1, 0) AS INT) AS r, CAST(round_even(199.5 - y / 0.1, 0) AS INT) AS c FROM obs)"""


@query(f"""WITH {SCENE}, {CELLS}, far AS (SELECT scenario, r, c FROM cells JOIN st0 USING (scenario) WHERE sqrt(power(r - (199.5 - x0 / 0.1), 2) + power(c - (199.5 - y0 / 0.1), 2)) * 0.1 > 0.25 + 0.1), n AS (SELECT scenario, sub, min(sqrt(power(pr - r, 2) + power(pcol - c, 2)) * 0.1) AS d FROM pc JOIN far USING (scenario) GROUP BY 1, 2 HAVING min(sqrt(power(pr - r, 2) + power(pcol - c, 2)) * 0.1) <= 2.0),
 h AS (SELECT scenario, round(min(d), 5) AS least, count(*) FILTER (WHERE d <= 0.25) AS n_hits FROM n GROUP BY 1), u AS (SELECT p.scenario, round(avg((k.scenario IS NULL)::INT), 6) AS unknown_fraction FROM pc p LEFT JOIN cells k ON k.scenario = p.scenario AND k.r = p.pr AND k.c = p.pcol WHERE pr BETWEEN 0 AND 399 AND pcol BETWEEN 0 AND 399 GROUP BY 1)
 SELECT u.scenario, least, n_hits, unknown_fraction FROM u LEFT JOIN h USING (scenario)""")
def map_collision(spark, sf_dir):
    """Least distance to occupied map cells, and the share of the path in unknown cells."""
    ego, obs = scenario_tables(spark, sf_dir)
    half = 199.5
    cells = obs.select("scenario", F.bround(half - F.col("x") / C.MAP_RES).cast("int").alias("row"), F.bround(half - F.col("y") / C.MAP_RES).cast("int").alias("col")).distinct()
    near = C.map_contacts(ego, cells, SUB).groupBy("scenario").agg(F.round(F.min("dist"), 5).alias("least"), F.count_if(F.col("dist") <= C.RADIUS).alias("n_hits"))
    return C.unknown_share(ego, cells, SUB).join(near, "scenario", "left").select("scenario", "least", "n_hits", F.round("unknown_fraction", 6).alias("unknown_fraction"))


@query(f"""WITH {SCENE}, pts AS (SELECT scenario, step, x + k * 0.02 AS x, y FROM obs, generate_series(0, 4) AS g(k) WHERE step > 0), look AS (SELECT DISTINCT scenario, sub, px, py, unnest([floor(sub / 5.0 + 0.5), ceil(sub / 5.0 - 0.5)]) AS step FROM dense)
 SELECT DISTINCT scenario, sub FROM (SELECT l.scenario, sub, l.step, count(*) AS n FROM look l JOIN pts p ON p.scenario = l.scenario AND p.step = l.step WHERE sqrt(power(px - x, 2) + power(py - y, 2)) <= 0.25 + 1e-9 GROUP BY 1, 2, 3) WHERE n >= 3""")
def lidar_collision(spark, sf_dir):
    """Sub-steps at which enough scan points are in reach."""
    ego, obs = scenario_tables(spark, sf_dir)
    near = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")
    points = obs.select("scenario", "step", "x", "y", F.lit(1.0).alias("z"), F.lit(2).alias("label"), "track", near).select("scenario", "step", (F.col("x") + F.col("k") * 0.02).alias("x"), "y", "z", "label", "track")
    return C.lidar_contacts(ego, points, obs.filter("is_operator").select("scenario", "track").distinct(), SUB)


@query("""WITH {POSE}, g AS (SELECT user_id AS rec FROM events WHERE false), ego AS (SELECT rec * 1000 + f // 11 AS scenario, f % 11 AS step, x / 50 AS x, y / 10 AS y FROM pose WHERE rec % 5 = 0),
 now AS (SELECT scenario, x AS x0, y AS y0, coalesce(x2 - x, 0) * 2 AS vx, coalesce(y2 - y, 0) * 2 AS vy FROM (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM ego WINDOW w AS (PARTITION BY scenario ORDER BY step)) WHERE step = 0), fin AS (SELECT scenario, arg_max(x, step) AS gx, arg_max(y, step) AS gy FROM ego GROUP BY 1),
 p AS (SELECT scenario, 'stationary' AS planner, k AS step, x0 AS x, y0 AS y FROM now, generate_series(0, 10) AS g(k) UNION ALL SELECT scenario, 'constant_velocity', k, x0 + vx * k / 2.0, y0 + vy * k / 2.0 FROM now, generate_series(0, 10) AS g(k) UNION ALL SELECT scenario, 'straight_to_goal', k, x0 + (gx - x0) * k / 10.0, y0 + (gy - y0) * k / 10.0 FROM now JOIN fin USING (scenario), generate_series(0, 10) AS g(k) UNION ALL SELECT scenario, 'recorded', step, x, y FROM ego)
 SELECT p.scenario, planner, round(avg(sqrt(power(p.x - e.x, 2) + power(p.y - e.y, 2))), 5) AS ade, round(arg_max(sqrt(power(p.x - e.x, 2) + power(p.y - e.y, 2)), p.step), 5) AS fde FROM p JOIN ego e ON p.scenario = e.scenario AND p.step = e.step WHERE p.step > 0 GROUP BY 1, 2""")
def baseline_errors(spark, sf_dir):
    """ADE and FDE of naive planners against the recorded path."""
    ego, _ = scenario_tables(spark, sf_dir)
    goals = ego.groupBy("scenario").agg(F.max_by("x", "step").alias("gx"), F.max_by("y", "step").alias("gy"))
    w = Window.partitionBy("scenario").orderBy("step")
    moving = ego.withColumns({f"v{c}": F.coalesce(F.lead(c).over(w) - F.col(c), F.lit(0.0)) * RATE for c in ("x", "y")})
    made = C.baselines(moving, goals, RATE)
    every = ego.withColumn("planner", F.explode(F.array(*map(F.lit, C.PLANNERS)))).select(F.struct("scenario", "planner").alias("scenario"), "step", "x", "y")
    scored = C.displacement(made.withColumn("scenario", F.struct("scenario", "planner")), every)
    return scored.select("scenario.scenario", "scenario.planner", F.round("ade", 5).alias("ade"), F.round("fde", 5).alias("fde"))


ARC = """{POSE}, q AS (SELECT rec * 1000 + f // 11 AS rec, f % 11 AS f, x / 50 AS x, y / 10 AS y FROM pose), h AS (SELECT *, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)), 0) AS hop FROM q WINDOW w AS (PARTITION BY rec ORDER BY f)),
 s AS (SELECT *, sum(hop) OVER (PARTITION BY rec ORDER BY f) AS s FROM h), n AS (SELECT rec, s, x, y, lead(s) OVER w AS s2, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM s WINDOW w AS (PARTITION BY rec ORDER BY f)), e AS (SELECT rec, max(s) AS total FROM s GROUP BY 1)"""


@query(f"""WITH {ARC}, w AS (SELECT rec, k, least(3.0 * k / 2.0, total) AS s FROM e, generate_series(1, 10) AS g(k)) SELECT w.rec, k::INT AS k, round(CASE WHEN s2 IS NULL THEN x ELSE x + (x2 - x) * (w.s - n.s) / (s2 - n.s) END, 4) AS x, round(CASE WHEN s2 IS NULL THEN y ELSE y + (y2 - y) * (w.s - n.s) / (s2 - n.s) END, 4) AS y FROM w ASOF JOIN n ON w.rec = n.rec AND w.s >= n.s""")
def timed_follow(spark, sf_dir):
    """Positions when each path is followed at a fixed speed."""
    paths = poses(spark, sf_dir).select((F.col("rec") * 1000 + F.floor(F.col("f") / 11)).alias("rec"), (F.col("f") % 11).alias("f"), (F.col("x") / 50).alias("x"), (F.col("y") / 10).alias("y"))
    return M.timed(paths, "rec", RATE, 3.0, 10).select("rec", "k", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


WIGGLE = f"""{ARC}, g AS (SELECT rec, unnest(generate_series(1, CAST(floor((total + 1e-9) / 0.1) AS BIGINT))) AS k FROM e WHERE total >= 0.1 - 1e-9), even AS (SELECT rec, 0 AS k, arg_min(x, f) AS x, arg_min(y, f) AS y FROM q GROUP BY 1 UNION ALL
 SELECT g.rec, k, CASE WHEN s2 IS NULL THEN x ELSE x + (x2 - x) * (g.s - n.s) / (s2 - n.s) END, CASE WHEN s2 IS NULL THEN y ELSE y + (y2 - y) * (g.s - n.s) / (s2 - n.s) END FROM (SELECT rec, k, k * 0.1 AS s FROM g) g ASOF JOIN n ON g.rec = n.rec AND g.s >= n.s)"""


@query(f"""WITH {WIGGLE}, st AS (SELECT rec, k, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM even WINDOW w AS (PARTITION BY rec ORDER BY k)), hd AS (SELECT rec, k, last_value(CASE WHEN sqrt(dx * dx + dy * dy) > 1e-6 THEN atan2(dy, dx) END IGNORE NULLS) OVER (PARTITION BY rec ORDER BY k) AS h FROM st), d AS (SELECT rec, h - lag(h) OVER (PARTITION BY rec ORDER BY k) AS r FROM hd), w AS (SELECT rec, (r + pi()) - 2 * pi() * floor((r + pi()) / (2 * pi())) - pi() AS raw FROM d),
 t AS (SELECT rec, CASE WHEN abs(raw) > pi() - 1e-9 THEN -pi() ELSE raw END AS dh FROM w) SELECT rec, round(coalesce(sum(abs(dh)), 0) - abs(coalesce(sum(dh), 0)), 3) AS wiggle FROM t GROUP BY 1""")
def wiggle(spark, sf_dir):
    """Total less net turning of each path."""
    paths = poses(spark, sf_dir).select((F.col("rec") * 1000 + F.floor(F.col("f") / 11)).alias("rec"), (F.col("f") % 11).alias("f"), (F.col("x") / 50).alias("x"), (F.col("y") / 10).alias("y"))
    return M.wiggle(paths, "rec").select("rec", F.round("wiggle", 3).alias("wiggle"))


FEATURES = """{POSE}, w AS (SELECT a.rec, a.f AS anchor, p.f - a.f AS k, p.x - a.x AS x, p.y - a.y AS y FROM pose a JOIN pose p ON p.rec = a.rec AND p.f BETWEEN a.f AND a.f + 10 WHERE a.f % 6 = 0), h AS (SELECT *, sqrt(power(x - lag(x) OVER v, 2) + power(y - lag(y) OVER v, 2)) AS hop, max(k) OVER (PARTITION BY rec, anchor) AS last FROM w WINDOW v AS (PARTITION BY rec, anchor ORDER BY k)),
 m AS (SELECT rec, anchor, sum(hop) AS dist, avg(hop / 0.5) AS sm, avg(CASE WHEN k <= 2 THEN hop / 0.5 END) AS sf, avg(CASE WHEN k > last - 2 THEN hop / 0.5 END) AS sl, degrees(atan2(arg_max(y, k), arg_max(x, k))) AS b, sqrt(power(arg_max(x, k), 2) + power(arg_max(y, k), 2)) AS net FROM h GROUP BY 1, 2 HAVING count(*) = 11),
 c AS (SELECT *, CASE WHEN sm / 400 < 0.15 THEN 'standing' WHEN sl / 400 < 0.15 AND sf / 400 > 0.3 THEN 'stopping' WHEN sf / 400 < 0.15 AND sl / 400 > 0.3 THEN 'starting' WHEN b > 45 THEN 'sharp_left' WHEN b < -45 THEN 'sharp_right' WHEN b > 15 THEN 'turn_left' WHEN b < -15 THEN 'turn_right' WHEN (sl - sf) / 400 < -0.3 THEN 'slowing' WHEN (sl - sf) / 400 > 0.3 THEN 'speeding_up' WHEN dist / greatest(1e-6, net) > 1.15 THEN 'weaving' ELSE 'straight' END AS klass FROM m)"""


def _features(spark, sf_dir):
    rows = poses(spark, sf_dir)
    start = rows.filter("f % 6 = 0").select("rec", F.col("f").alias("anchor"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    k = F.explode(F.sequence(F.lit(0), F.lit(10)))
    target = start.withColumn("k", k).withColumn("f", F.col("anchor") + F.col("k")).join(rows.select("rec", "f", "x", "y"), ["rec", "f"])
    whole = target.select(F.struct("rec", "anchor").alias("id"), "k", (F.col("x") - F.col("x0")).alias("x"), (F.col("y") - F.col("y0")).alias("y")).withColumn("n", F.count("*").over(Window.partitionBy("id"))).filter("n = 11")
    return M.motion_features(whole, "id", 0.5).withColumn("klass", M.motion_class(400.0))


@query(f"WITH {FEATURES} SELECT rec, anchor, round(dist, 4) AS dist, round(sf, 4) AS speed_first, round(sl, 4) AS speed_last, round(b, 5) AS bearing, klass FROM c")
def motion_class(spark, sf_dir):
    """Motion features and class of windows of ten steps."""
    return _features(spark, sf_dir).select("id.rec", "id.anchor", F.round("dist", 4).alias("dist"), F.round("speed_first", 4).alias("speed_first"), F.round("speed_last", 4).alias("speed_last"), F.round("bearing", 5).alias("bearing"), "klass")


@query(f"WITH {FEATURES} SELECT rec % 3 AS source, klass, count(*) AS n, count(*) FILTER (WHERE anchor < 30) AS kept FROM c GROUP BY 1, 2")
def class_counts(spark, sf_dir):
    """Rows before and after a filter, by source and class."""
    return _features(spark, sf_dir).groupBy((F.col("id.rec") % 3).alias("source"), "klass").agg(F.count("*").alias("n"), F.count_if(F.col("id.anchor") < 30).alias("kept"))


@query("""WITH {POSE}, e AS (SELECT rec, arg_max(x, f) / 50 AS gx, arg_max(y, f) / 10 AS gy, arg_min(x, f) / 50 AS x, arg_min(y, f) / 10 AS y, sum(x) / 500 AS travelled FROM pose GROUP BY 1), d AS (SELECT *, sqrt(gx * gx + gy * gy) AS d0, sqrt(power(gx - x, 2) + power(gy - y, 2)) AS d1 FROM e)
 SELECT rec, round(d0 - d1, 5) AS progress_m, round(CASE WHEN least(5.0, d0) > 0 THEN (d0 - d1) / least(5.0, d0) ELSE 0 END, 5) AS progress_ratio, round(CASE WHEN travelled > 1e-3 THEN (d0 - d1) / travelled ELSE 0 END, 5) AS path_efficiency, d1 <= 0.5 AS reached_goal, (rec % 3 <> 0 AND CASE WHEN least(5.0, d0) > 0 THEN (d0 - d1) / least(5.0, d0) ELSE 0 END >= 0.5) AS success FROM d""")
def progress(spark, sf_dir):
    """Progress towards a goal, efficiency and success."""
    ends = poses(spark, sf_dir).groupBy("rec").agg((F.max_by("x", "f") / 50).alias("gx"), (F.max_by("y", "f") / 10).alias("gy"), (F.min_by("x", "f") / 50).alias("x"), (F.min_by("y", "f") / 10).alias("y"), (F.sum("x") / 500).alias("travelled"))
    out = M.success(M.progress(ends, 0.5, 10.0).withColumn("collided", F.col("rec") % 3 == 0))
    return out.select("rec", *(F.round(c, 5).alias(c) for c in ("progress_m", "progress_ratio", "path_efficiency")), "reached_goal", "success")


@query("""WITH {POSE}, q AS (SELECT *, lead(x) OVER w - 2 * x + lag(x) OVER w AS ax, lead(y) OVER w - 2 * y + lag(y) OVER w AS ay FROM pose WINDOW w AS (PARTITION BY rec ORDER BY f)),
 s AS (SELECT rec, avg(sqrt(ax * ax + ay * ay)) AS acc, avg(x) / 100 AS ade, rec % 4 = 0 AS hit, arg_max(x, f) / 50 AS x, arg_max(y, f) / 10 AS y, max(x) / 50 AS gx, max(y) / 10 AS gy FROM q GROUP BY 1), g AS (SELECT *, greatest(1, sqrt(gx * gx + gy * gy)) AS sc, sqrt(power(x - gx, 2) + power(y - gy, 2)) AS d1 FROM s)
 SELECT rec, round(-2 * d1 / sc - 0.5 * ade / sc + CASE WHEN hit THEN -10 ELSE 10 END - 0.01 * acc / sc + greatest(-1, least(1, (sqrt(gx * gx + gy * gy) - d1) / sc)), 5) AS reward FROM g""")
def reward_terms(spark, sf_dir):
    """Weighted reward from a specification."""
    rows = poses(spark, sf_dir)
    ends = rows.groupBy("rec").agg((F.avg("x") / 100).alias("ade"), (F.max_by("x", "f") / 50).alias("x"), (F.max_by("y", "f") / 10).alias("y"), (F.max("x") / 50).alias("gx"), (F.max("y") / 10).alias("gy"))
    scored = ends.join(M.acceleration(rows.withColumnRenamed("f", "step"), "rec"), "rec").withColumns({"collided": F.col("rec") % 4 == 0, "collided_lidar": F.lit(False)})
    return M.reward(scored, "goal=2, imitation=0.5, collision=10, smooth=0.01, progress").select("rec", F.round("reward", 5).alias("reward"))


@query("""WITH {POSE}, k AS (SELECT rec * 1000 + f // 11 AS rec, f % 11 AS k, x / 50 AS x, y / 10 AS y, x / 50 + sin(f % 11) AS rx, y / 10 AS ry FROM pose), v AS (SELECT *, (x - lag(x) OVER w) * 2 AS vx, (y - lag(y) OVER w) * 2 AS vy FROM k WINDOW w AS (PARTITION BY rec ORDER BY k)), a AS (SELECT *, sqrt(power(vx - lag(vx) OVER w, 2) + power(vy - lag(vy) OVER w, 2)) * 2 AS acc, sqrt(power(x - rx, 2) + power(y - ry, 2)) AS err FROM v WINDOW w AS (PARTITION BY rec ORDER BY k))
 SELECT rec, round(avg(err), 5) AS ade, round(arg_max(err, k), 5) AS fde, round(coalesce(max(acc), 0), 4) AS max_accel, round(avg(sqrt(vx * vx + vy * vy)), 4) AS speed FROM a WHERE k > 0 GROUP BY 1""")
def timed_scores(spark, sf_dir):
    """Scores of positions in time against a reference."""
    rows = poses(spark, sf_dir).select((F.col("rec") * 1000 + F.floor(F.col("f") / 11)).alias("rec"), (F.col("f") % 11).alias("k"), (F.col("x") / 50).alias("x"), (F.col("y") / 10).alias("y"))
    reference = rows.withColumn("x", F.col("x") + F.sin("k"))
    out = M.timed_scores(rows, reference, "rec", RATE)
    return out.select("rec", F.round("ade", 5).alias("ade"), F.round("fde", 5).alias("fde"), F.round("max_accel", 4).alias("max_accel"), F.round("speed", 4).alias("speed"))


TAGS = "t AS (SELECT *, list_sort(list_distinct(list_filter([CASE WHEN o_totalprice > 300000 THEN 'price:high' END, CASE WHEN o_totalprice < 100000 THEN 'price:low' END, 'status:' || o_orderstatus, 'urgency:' || substr(o_orderpriority, 1, 1)], lambda v: v IS NOT NULL))) AS tags FROM orders)"


def _tagged(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "orders").withColumn("tags", R.tag_set(F.when(c("o_totalprice") > 300000, "price:high"), F.when(c("o_totalprice") < 100000, "price:low"), F.concat(F.lit("status:"), "o_orderstatus"), F.concat(F.lit("urgency:"), F.substring("o_orderpriority", 1, 1))))


@query(f"WITH {TAGS} SELECT split_part(tag, ':', 1) AS tag_group, tag, round(avg(o_totalprice), 4) AS o_totalprice, count(*) AS n FROM (SELECT unnest(tags) AS tag, o_totalprice FROM t) GROUP BY 1, 2")
def tag_report(spark, sf_dir):
    """Means per tag; an order counts in each of its tags."""
    return R.by_tag(_tagged(spark, sf_dir), "tags", ["o_totalprice"]).withColumn("o_totalprice", F.round("o_totalprice", 4))


@query(f"WITH {TAGS} SELECT *, row_number() OVER (PARTITION BY tag_group ORDER BY n DESC, tag) AS place FROM (SELECT split_part(tag, ':', 1) AS tag_group, tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM t) GROUP BY 1, 2)")
def tag_shares(spark, sf_dir):
    """Tags of each group by how often they occur."""
    return R.tag_shares(_tagged(spark, sf_dir), "tags")


@query("SELECT o_orderstatus, o_orderpriority, round(avg(o_totalprice), 4) AS o_totalprice, count(*) AS n, GROUPING_ID(o_orderstatus, o_orderpriority) AS gid FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority))")
def grouping_report(spark, sf_dir):
    """Overall and per value of each of two dimensions."""
    return R.by_sets(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], ["o_totalprice"]).withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def crosstab(spark, sf_dir):
    """Orders by priority and status."""
    return R.crosstab(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("SELECT l_returnflag, round(avg(l_quantity), 6) AS l_quantity, round(avg(CASE WHEN l_discount > 0 THEN l_extendedprice END), 4) AS price, count(*) AS n FROM lineitem GROUP BY 1")
def mean_metrics(spark, sf_dir):
    """Means that leave out missing and NaN values."""
    rows = table(spark, sf_dir, "lineitem").withColumn("price", F.when(F.col("l_discount") > 0, F.col("l_extendedprice")).otherwise(F.lit(float("nan"))))
    return R.mean_metrics(rows, ["l_quantity", "price"], ["l_returnflag"]).select("l_returnflag", F.round("l_quantity", 6).alias("l_quantity"), F.round("price", 4).alias("price"), "n")


@query("""WITH {POSE}, s AS (SELECT * FROM pose WHERE CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < 0.3) SELECT round(greatest(quantile_cont(abs(x), 0.95), 1), 6) AS x, round(greatest(quantile_cont(abs(y), 0.95), 1), 6) AS y, count(*) AS n FROM s""")
def action_scale(spark, sf_dir):
    """95th percentile of absolute values over a hash sample."""
    return R.action_scale(poses(spark, sf_dir), ["x", "y"], 0.3, "event_id").select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "n")


@query("""WITH e AS (SELECT event_id, user_id, event_type, value, value / 70 AS m, user_id % 7 / 5.0 AS v0, user_id % 5 / 4.0 AS v1, value - 245 AS b, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), w AS (SELECT *, CASE WHEN m > 0.3 THEN b ELSE 0 END AS bb FROM e)
 SELECT event_id, 'ev_' || event_type || '_' || lpad(CAST(user_id AS VARCHAR), 2, '0') || '_' || lpad(CAST(event_id AS VARCHAR), 6, '0') AS sid, substr(sha1(event_type || '|' || CAST(event_id AS VARCHAR)), 1, 32) AS rid,
 'the carrier ' || CASE WHEN m / 5 < 0.15 THEN 'stands still' WHEN m / 5 < 0.5 THEN 'moves very slowly' WHEN m / 5 < 1 THEN 'moves at a slow walking pace' WHEN m / 5 < 1.8 THEN 'moves at walking pace' ELSE 'moves fast' END || ', ' || CASE WHEN v1 < 0.15 AND v0 > 0.15 THEN 'stops' WHEN v0 < 0.15 AND v1 > 0.15 THEN 'starts moving' WHEN v1 < v0 - 0.3 THEN 'slows down' WHEN v1 > v0 + 0.3 THEN 'speeds up' ELSE 'keeps a steady speed' END || ', and ' ||
 CASE WHEN abs(bb) < 15 THEN 'goes straight ahead' WHEN abs(bb) < 45 THEN 'bears ' || CASE WHEN bb > 0 THEN 'left' ELSE 'right' END || ' by about ' || printf('%.0f', abs(bb) + 1e-7) || ' degrees' WHEN abs(bb) < 120 THEN 'turns sharply ' || CASE WHEN bb > 0 THEN 'left' ELSE 'right' END || ', about ' || printf('%.0f', abs(bb) + 1e-7) || ' degrees' ELSE 'turns around to the ' || CASE WHEN bb > 0 THEN 'left' ELSE 'right' END END AS words,
 CASE event_id % 3 WHEN 0 THEN printf('Please walk towards the goal (%.1f, %.1f).', value / 7 + 0.0123, k / 3.0) WHEN 1 THEN printf('Walk to the point (%.1f, %.1f).', value / 7 + 0.0123, k / 3.0) ELSE printf('Navigate to (%.1f, %.1f).', value / 7 + 0.0123, k / 3.0) END AS prompt, k FROM w""")
def prompt_text(spark, sf_dir):
    """Ids, prompts, paths in words and numbers out of JSON in free text."""
    e = table(spark, sf_dir, "events")
    c = F.col
    k = X.json_in_text(F.concat(F.lit("answer: "), "props", F.lit(" end")), "k bigint")["k"]
    words = X.path_in_words(c("value") / 70, c("user_id") % 7 / 5.0, c("user_id") % 5 / 4.0, c("value") - 245)
    return e.select("event_id", X.scenario_id(F.lit("ev"), c("event_type"), c("user_id"), c("event_id")).alias("sid"), X.request_id(c("event_type"), c("event_id").cast("string")).alias("rid"), words.alias("words"), X.point_prompt(c("value") / 7 + 0.0123, k / 3.0, c("event_id") % 3).alias("prompt"), k.alias("k"))
