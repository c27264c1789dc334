"""Queries on suites: baselines scored, clean scenarios, picks, audits and what samples are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import metrics as M
from ..operators import samples as P
from ..operators import suite as S
from ..sources.tables import poses, table
from .registry import query
from .sampling import ELIGIBLE
from .scoring import CONTACTS, RATE, SCENE, SUB, scenario_tables

#: Planners' paths as scenarios of their own (scenario * 10 + planner), so that the contacts' SQL holds for them too.
PLANNED = SCENE.replace("ego AS (", "ego0 AS (").replace("obs AS (", """g0 AS (SELECT scenario, arg_max(x, step) AS gx, arg_max(y, step) AS gy FROM ego0 GROUP BY 1), n0 AS (SELECT e.*, gx, gy, y / 4 AS yaw FROM ego0 e JOIN g0 USING (scenario) WHERE step = 0),
 ego AS (SELECT scenario * 10 AS scenario, step, x, y FROM ego0 UNION ALL SELECT scenario * 10 + 1, k, x, y FROM n0, generate_series(0, 10) AS g(k) UNION ALL SELECT scenario * 10 + 2, k, x + cos(yaw) * 10.0 * k / 10, y + sin(yaw) * 10.0 * k / 10 FROM n0, generate_series(0, 10) AS g(k) UNION ALL SELECT scenario * 10 + 3, k, x + (gx - x) * k / 10, y + (gy - y) * k / 10 FROM n0, generate_series(0, 10) AS g(k)),
 obs0 AS (""").replace("dense AS (", "obs AS (SELECT * REPLACE (scenario * 10 + p AS scenario) FROM obs0, generate_series(0, 3) AS g(p)),\n dense AS (", 1)
VERDICTS = CONTACTS.replace(SCENE, PLANNED) + """, a AS (SELECT scenario, gap, 's' AS who FROM sc UNION ALL SELECT scenario, gap, 'd' FROM dc), h AS (SELECT scenario, bool_or(gap <= 0 AND who = 'd') AS hit_d, bool_or(gap <= 0 AND who = 's') AS hit_s FROM a GROUP BY 1),
 d AS (SELECT p.scenario, sqrt(power(p.x - e.x, 2) + power(p.y - e.y, 2)) AS err, p.step FROM ego p JOIN ego0 e ON e.scenario = p.scenario // 10 AND e.step = p.step WHERE p.step > 0), v0 AS (SELECT scenario, avg(err) AS ade, arg_max(err, step) AS fde FROM d GROUP BY 1),
 v AS (SELECT v0.scenario // 10 AS scenario, ['recorded', 'stationary', 'straight_ahead', 'straight_to_goal'][v0.scenario % 10 + 1] AS planner, coalesce(hit_d, false) AS collided_dynamic, coalesce(hit_s, false) AS collided_static, ade, fde FROM v0 LEFT JOIN h ON h.scenario = v0.scenario)"""


def _verdicts(spark, sf_dir):
    ego, obs = scenario_tables(spark, sf_dir)
    obs = obs.withColumn("kind", F.when(F.col("kind") == "STATIC", "VEHICLE").otherwise(F.col("kind")))
    goals = ego.groupBy("scenario").agg(F.max_by("x", "step").alias("gx"), F.max_by("y", "step").alias("gy"))
    return S.score_planners(S.suite_baselines(ego.withColumn("yaw", F.col("y") / 4), goals), ego, obs, SUB, RATE)


@query(f"WITH {VERDICTS} SELECT scenario, planner, collided_dynamic, collided_static, round(ade, 5) AS ade, round(fde, 5) AS fde FROM v")
def suite_baselines(spark, sf_dir):
    """Every baseline of every scenario scored for collision and distance from the recorded path."""
    return _verdicts(spark, sf_dir).select("scenario", "planner", "collided_dynamic", "collided_static", F.round("ade", 5).alias("ade"), F.round("fde", 5).alias("fde"))


@query(f"WITH {VERDICTS} SELECT planner, scenario % 3 AS environment, round(avg((collided_dynamic OR collided_static)::INT), 6) AS collided, round(avg(ade), 5) AS ade, round(avg(fde), 5) AS fde, count(*) AS n, GROUPING_ID(planner, environment) AS gid FROM (SELECT *, scenario % 3 AS environment FROM v) GROUP BY GROUPING SETS ((planner), (planner, environment))".replace("scenario % 3 AS environment, round", "environment, round"))
def suite_report(spark, sf_dir):
    """Means of the suite's verdicts per planner, and per planner and environment."""
    rows = _verdicts(spark, sf_dir).select("planner", (F.col("scenario") % 3).alias("environment"), F.col("collided").cast("double").alias("collided"), "ade", "fde")
    gid = F.grouping_id("planner", "environment").alias("gid")
    out = rows.cube("planner", "environment").agg(F.avg("collided").alias("collided"), F.avg("ade").alias("ade"), F.avg("fde").alias("fde"), F.count("*").alias("n"), gid).filter("gid in (0, 1)")
    return out.select("planner", "environment", F.round("collided", 6).alias("collided"), F.round("ade", 5).alias("ade"), F.round("fde", 5).alias("fde"), "n", "gid")


@query(f"WITH {VERDICTS} SELECT scenario FROM v WHERE planner = 'recorded' AND NOT collided_dynamic AND NOT collided_static")
def clean_scenarios(spark, sf_dir):
    """Scenarios whose recorded path touches nothing."""
    return S.clean(_verdicts(spark, sf_dir))


@query(f"WITH {VERDICTS} SELECT scenario, collided_dynamic OR collided_static AS blocked FROM v WHERE planner = 'straight_to_goal'")
def straight_line_blocked(spark, sf_dir):
    """Whether the straight line to the goal is blocked, per scenario."""
    return _verdicts(spark, sf_dir).filter("planner = 'straight_to_goal'").select("scenario", F.col("collided").alias("blocked"))


@query(f"WITH {PLANNED} SELECT a.scenario // 10 AS scenario, round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), 5) AS shift FROM ego a JOIN ego b ON b.scenario = a.scenario + 1 AND b.step = a.step WHERE a.scenario % 10 = 2 AND a.step = 10")
def end_shift(spark, sf_dir):
    """How far the end point moves between two inputs: straight ahead and straight to the goal."""
    ego, _ = scenario_tables(spark, sf_dir)
    goals = ego.groupBy("scenario").agg(F.max_by("x", "step").alias("gx"), F.max_by("y", "step").alias("gy"))
    ends = S.suite_baselines(ego.withColumn("yaw", F.col("y") / 4), goals).filter("step = 10")
    return S.end_shift(ends, "scenario", "planner", "straight_ahead", "straight_to_goal").select("scenario", F.round("shift", 5).alias("shift"))


@query(f"""WITH {PLANNED}, v AS (SELECT *, (x - lag(x) OVER w) * 2 AS vx, (y - lag(y) OVER w) * 2 AS vy FROM ego WINDOW w AS (PARTITION BY scenario ORDER BY step)), a AS (SELECT v.scenario, v.step, sqrt(power(vx - lag(vx) OVER w, 2) + power(vy - lag(vy) OVER w, 2)) * 2 AS acc, sqrt(vx * vx + vy * vy) AS sp, sqrt(power(v.x - e.x, 2) + power(v.y - e.y, 2)) AS err FROM v JOIN ego0 e ON e.scenario = v.scenario // 10 AND e.step = v.step WINDOW w AS (PARTITION BY v.scenario ORDER BY v.step))
 SELECT scenario // 10 AS scenario, ['recorded', 'stationary', 'straight_ahead', 'straight_to_goal'][scenario % 10 + 1] AS planner, round(avg(err), 5) AS ade, round(arg_max(err, step), 5) AS fde, round(coalesce(max(acc), 0), 4) AS max_accel, round(avg(sp), 4) AS speed, arg_max(err, step) <= 1.0 AS completed FROM a WHERE step > 0 GROUP BY scenario""")
def timed_baselines(spark, sf_dir):
    """Every baseline scored in time against the recorded path."""
    ego, _ = scenario_tables(spark, sf_dir)
    goals = ego.groupBy("scenario").agg(F.max_by("x", "step").alias("gx"), F.max_by("y", "step").alias("gy"))
    keyed = lambda df: df.select(F.struct("scenario", "planner").alias("id"), F.col("step").alias("k"), "x", "y")
    every = ego.withColumn("planner", F.explode(F.array(*map(F.lit, S.PLANNERS))))
    out = M.timed_scores(keyed(S.suite_baselines(ego.withColumn("yaw", F.col("y") / 4), goals)), keyed(every), "id", RATE)
    return out.select("id.scenario", "id.planner", F.round("ade", 5).alias("ade"), F.round("fde", 5).alias("fde"), F.round("max_accel", 4).alias("max_accel"), F.round("speed", 4).alias("speed"), "completed")


@query(f"""WITH {SCENE}, h AS (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS hop FROM ego WINDOW w AS (PARTITION BY scenario ORDER BY step)), e AS (SELECT scenario, coalesce(sum(hop), 0) AS dist, coalesce(max(CASE WHEN step = 1 THEN hop END), 0) * 2 AS speed, arg_min(x, step) AS ax, arg_min(y, step) AS ay, arg_max(x, step) AS bx, arg_max(y, step) AS b2, 2 * max(x) AS gx, max(y) AS gy FROM h GROUP BY 1),
 p AS (SELECT (rec - rec % 5) * 1000 + f // 11 AS scenario, count(*) AS n FROM pose WHERE rec % 5 = 1 AND f % 11 = 0 GROUP BY 1)
 SELECT e.scenario, coalesce(n, 0) AS n_pedestrians, round(ln(1 + coalesce(n, 0)), 6) AS log_pedestrians, round(speed, 5) AS speed, round(dist, 5) AS future_distance, round((sqrt(power(gx - ax, 2) + power(gy - ay, 2)) - sqrt(power(gx - bx, 2) + power(gy - b2, 2))) / greatest(0.5, sqrt(power(gx - ax, 2) + power(gy - ay, 2))), 5) AS progress_fraction FROM e LEFT JOIN p USING (scenario)""")
def scenario_scalars(spark, sf_dir):
    """People, speed, distance ahead and progress of each scenario."""
    ego, obs = scenario_tables(spark, sf_dir)
    goals = ego.groupBy("scenario").agg((2 * F.max("x")).alias("gx"), F.max("y").alias("gy"))
    out = S.scenario_scalars(ego, obs, goals, RATE)
    return out.select("scenario", "n_pedestrians", F.round("log_pedestrians", 6).alias("log_pedestrians"), *(F.round(c, 5).alias(c) for c in ("speed", "future_distance", "progress_fraction")))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders WHERE o_orderstatus <> 'P') SELECT o_orderkey, o_orderpriority, o_totalprice FROM r WHERE n <= 10 ORDER BY o_totalprice DESC, o_orderkey LIMIT 40""")
def example_picks(spark, sf_dir):
    """The forty dearest orders of which a priority may take a quarter."""
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    return S.pick_examples(rows, "o_orderpriority", [F.desc("o_totalprice"), "o_orderkey"], 40).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("SELECT l_returnflag, l_suppkey, n FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_suppkey) AS k FROM (SELECT l_returnflag, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE k <= 2")
def largest_shards(spark, sf_dir):
    """The two suppliers with the most items, for each return flag."""
    return S.largest_shards(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_suppkey")


@query("SELECT 'o_orderstatus' AS dimension, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'dear', CASE WHEN o_totalprice > 200000 THEN 'yes' END, count(*) FROM orders GROUP BY 2")
def audit_counts(spark, sf_dir):
    """Rows per value of several dimensions, missing ones included."""
    rows = table(spark, sf_dir, "orders").withColumn("dear", F.when(F.col("o_totalprice") > 200_000, "yes"))
    return S.audit_counts(rows, ["o_orderstatus", "o_orderpriority", "dear"])


@query("""SELECT event_id, list_aggregate(list_distinct(list_transform(generate_series(1, 6), lambda k: CASE WHEN k <= 5 THEN least(k * 10, user_id % 60 + 1) ELSE user_id % 60 + 1 END)), 'sum')::BIGINT AS future_sum, len(list_distinct(list_transform(generate_series(1, 6), lambda k: CASE WHEN k <= 5 THEN least(k * 10, user_id % 60 + 1) ELSE user_id % 60 + 1 END)))::INT AS n_future,
 array_to_string(list_transform([4, 3, 2, 1], lambda j: greatest(user_id % 20 - CAST(round_even(j * 0.75 * 2.0, 0) AS INT), 0)), ',') AS history FROM events""")
def step_lists(spark, sf_dir):
    """Steps ahead at 1 Hz up to the last, and history steps at another rate."""
    e = table(spark, sf_dir, "events")
    ahead = S.future_steps(F.col("user_id") % 60 + 1, 10, 5)
    back = S.history_steps(F.col("user_id") % 20, 4, 0.75, 2.0)
    return e.select("event_id", F.aggregate(ahead, F.lit(0).cast("long"), lambda a, b: a + b).alias("future_sum"), F.size(ahead).alias("n_future"), F.array_join(back.cast("array<string>"), ",").alias("history"))


@query(f"""WITH {ELIGIBLE}, i AS (SELECT rec, floor(t / 86400) * 86400 AS t0, floor(t / 86400) * 86400 + 43200 AS t1, 'go on ' || CAST(CAST(floor(t / 86400) AS BIGINT) % 7 AS VARCHAR) AS instruction FROM pose WHERE rec % 2 = 0 GROUP BY ALL), c AS (SELECT s.rec, s.f, arg_min(instruction, i.t0) AS instruction FROM s JOIN i ON i.rec = s.rec AND s.t BETWEEN i.t0 AND i.t1 GROUP BY 1, 2),
 u AS (SELECT s.rec, s.f, CASE WHEN CAST('0x' || substr(md5('9|' || CAST(s.rec AS VARCHAR) || '|' || CAST(s.f AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < 0.5 THEN instruction END AS instruction, CASE WHEN s.f % 3 = 0 THEN 'point_goal' WHEN s.f % 3 = 1 THEN 'follow' END AS task FROM s LEFT JOIN c USING (rec, f))
 SELECT rec, f, instruction, coalesce(length(trim(instruction)) > 0 AND task <> 'point_goal', false) AS is_language FROM u""")
def goal_choice(spark, sf_dir):
    """An instruction that covers the sample for half of those that have one, else a point goal; and whether it is a language task."""
    frames = poses(spark, sf_dir)
    day = F.floor(F.col("t") / 86_400)
    intervals = frames.filter("rec % 2 = 0").select("rec", (day * 86_400.0).alias("t0"), (day * 86_400.0 + 43_200).alias("t1"), F.concat(F.lit("go on "), (day % 7).cast("string")).alias("instruction")).distinct()
    out = S.choose_goal(P.eligible(frames, "rec", 5, 86_400.0), intervals, "rec", 0.5, "9")
    task = F.when(F.col("f") % 3 == 0, "point_goal").when(F.col("f") % 3 == 1, "follow")
    return out.select("rec", "f", "instruction", S.is_language_task(F.col("instruction"), task).alias("is_language"))


@query(f"""WITH {ELIGIBLE}, hop AS (SELECT *, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)), 0) AS hop FROM e WINDOW w AS (PARTITION BY rec ORDER BY f)), arc AS (SELECT *, sum(hop) OVER (PARTITION BY rec ORDER BY f) AS s FROM hop), n AS (SELECT rec, t, x, y, s, lead(t) OVER w AS t2, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(s) OVER w AS s2 FROM arc WINDOW w AS (PARTITION BY rec ORDER BY t)),
 q AS (SELECT a.rec, a.f, a.x AS x0, a.y AS y0, a.s AS s0, a.t + 86400.0 AS qt FROM arc a JOIN s USING (rec, f)), i AS (SELECT q.rec, q.f, x0, y0, s0, coalesce((qt - n.t) / (t2 - n.t), 0) AS u, n.* EXCLUDE (rec) FROM q ASOF JOIN n ON q.rec = n.rec AND q.qt >= n.t)
 SELECT rec, f, round(s + coalesce(s2 - s, 0) * u - s0, 4) AS path, round(sqrt(power(x + coalesce(x2 - x, 0) * u - x0, 2) + power(y + coalesce(y2 - y, 0) * u - y0, 2)), 4) AS net FROM i""")
def horizon_motion(spark, sf_dir):
    """Length of the path and net distance over the day after each sample."""
    frames = poses(spark, sf_dir)
    out = S.horizon_motion(frames, P.eligible(frames, "rec", 5, 86_400.0), "rec", 86_400.0)
    return out.select("rec", "f", F.round("path", 4).alias("path"), F.round("net", 4).alias("net"))


@query("""WITH p AS (SELECT event_id, user_id % 3 AS sensor, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y FROM events), r AS (SELECT event_id, cos(sensor * 1.5) * x - sin(sensor * 1.5) * y + sensor AS x, sin(sensor * 1.5) * x + cos(sensor * 1.5) * y - sensor AS y, event_id % 100 / 100.0 AS z FROM p)
 SELECT event_id, round(x, 5) AS x, round(y, 5) AS y, CASE WHEN z < 0.2 THEN 0 ELSE 1 END AS label FROM r WHERE abs(x) <= 100 AND abs(y) <= 100""")
def robot_points(spark, sf_dir):
    """Points of three sensors in the robot's frame, cropped and labelled by height."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 3).alias("sensor"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), (F.col("event_id") % 100 / 100.0).alias("z"))
    sensors = spark.range(3).select(F.col("id").alias("sensor"), (F.col("id") * 1.5).alias("yaw"), F.col("id").cast("double").alias("dx"), (-F.col("id")).cast("double").alias("dy"))
    return S.crop(S.to_robot(e, sensors, "sensor"), 100.0).select("event_id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), "label")


@query("SELECT p_brand, quantile_cont(p_size, 0.5)::DOUBLE AS p_size, round(quantile_cont(p_retailprice, 0.5), 6) AS p_retailprice, coalesce(map {'Brand#11': 'test', 'Brand#23': 'validation'}[p_brand], 'train') AS split FROM part GROUP BY 1")
def track_dims(spark, sf_dir):
    """Median dimensions per brand, and a split by a fixed map."""
    out = S.track_dims(table(spark, sf_dir, "part"), ["p_brand"], ["p_size", "p_retailprice"])
    return out.select("p_brand", F.col("p_size").cast("double").alias("p_size"), F.round("p_retailprice", 6).alias("p_retailprice"), S.fixed_split(F.col("p_brand"), {"Brand#11": "test", "Brand#23": "validation"}).alias("split"))


@query("SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def common_frames(spark, sf_dir):
    """Parts that three sets of items all have."""
    items = table(spark, sf_dir, "lineitem")
    return S.in_all([items.filter(c).select("l_partkey") for c in ("l_returnflag = 'A'", "l_returnflag = 'R'", "l_quantity > 45")])


@query(f"""WITH {ELIGIBLE}, hq AS (SELECT rec, f, j, t - j * 7200.0 + 1e-6 AS want FROM s, generate_series(1, 3) AS g(j)), h AS (SELECT hq.rec, hq.f, string_agg('frame_' || hq.rec || '_' || coalesce(p.f, 0), ',' ORDER BY hq.j DESC) AS history FROM hq ASOF LEFT JOIN pose p ON p.rec = hq.rec AND hq.want >= p.t GROUP BY 1, 2),
 q AS (SELECT rec, f, x AS x0, y AS y0, yaw AS a, k, t + k * 21600.0 AS qt FROM s, generate_series(1, 4) AS g(k)), n AS (SELECT rec, t, x, y, lead(t) OVER w AS t2, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM pose WINDOW w AS (PARTITION BY rec ORDER BY t)),
 i AS (SELECT q.*, n.x + coalesce((n.x2 - n.x) * (qt - n.t) / (n.t2 - n.t), 0) AS px, n.y + coalesce((n.y2 - n.y) * (qt - n.t) / (n.t2 - n.t), 0) AS py FROM q ASOF JOIN n ON q.rec = n.rec AND q.qt >= n.t), tt AS (SELECT rec, f, k, cos(a) * (px - x0) + sin(a) * (py - y0) AS x, cos(a) * (py - y0) - sin(a) * (px - x0) AS y FROM i),
 g AS (SELECT rec, f, arg_max(x, k) AS gx, arg_max(y, k) AS gy, sum(x) / 100 AS sx, sum(y) / 50 AS sy FROM tt GROUP BY 1, 2)
 SELECT h.rec, h.f, CASE WHEN h.rec % 2 = 0 THEN 'go to the door' ELSE printf('Walk to the point (%.1f, %.1f).', gx, gy) END AS prompt, history, round(CASE WHEN h.rec % 2 = 0 THEN 0 ELSE gx END, 4) AS goal_x, round(CASE WHEN h.rec % 2 = 0 THEN 0 ELSE gy END, 4) AS goal_y, round(sx, 4) AS target_x, round(sy, 4) AS target_y FROM h JOIN g USING (rec, f)""")
def training_rows(spark, sf_dir):
    """Prompt, history keys, goal and scaled targets of each sample."""
    frames = poses(spark, sf_dir).withColumn("yaw", F.col("y") / 40)
    samples = P.eligible(frames, "rec", 5, 86_400.0)
    spoken = samples.withColumn("instruction", F.when(F.col("rec") % 2 == 0, "go to the door")).select("rec", "f", "instruction")
    prompt = F.coalesce("instruction", X.point_prompt(F.col("gx"), F.col("gy"), F.lit(1)))
    out = P.training_rows(spoken, P.history(frames, samples, "rec", 3, 7_200.0), P.timed_targets(frames, samples, "rec", 86_400.0, 4), "rec", prompt, 100.0, 50.0)
    total = lambda c: F.round(F.aggregate("target", F.lit(0.0), lambda s, t: s + t[c]), 4).alias(f"target_{c}")
    return out.select("rec", "f", "prompt", F.array_join("history", ",").alias("history"), F.round("goal_x", 4).alias("goal_x"), F.round("goal_y", 4).alias("goal_y"), total("x"), total("y"))
