"""Queries that chain operators into jobs, and those on scenario rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import scenario as S
from ..operators.selection import hash_split
from ..sources.tables import poses, table
from .joining import LINK_SQL
from .motion import CUT_SQL, DAY, LEAST, STEP
from .registry import query
from .scoring import CONTACTS, RATE, SCENE, SUB, scenario_tables


@query(f"""WITH {CUT_SQL}, k AS (SELECT c.*, s.t0, row_number() OVER (PARTITION BY c.rec, c.episode ORDER BY c.f) - 1 AS i FROM cut c JOIN stats s ON s.rec = c.rec AND s.episode = c.episode)
 SELECT rec || '_' || CAST(episode AS BIGINT) AS episode_id, i AS frame_index, f AS source_frame, round(t - t0, 3) AS "timestamp" FROM k""")
def episode_frames(spark, sf_dir):
    """Frame table of the kept episodes of each recording."""
    frames, _ = S.recordings_to_episodes(poses(spark, sf_dir), "rec", STEP, DAY, LEAST, 3.0, hash_split(F.col("rec").cast("string")))
    return frames.select("episode_id", "frame_index", "source_frame", F.round("timestamp", 3).alias("timestamp"))


@query("""WITH {POSE}, a AS (SELECT rec, f AS anchor, x AS x0, y AS y0, y / 40 AS a0 FROM pose WHERE f % 8 = 0), w AS (SELECT a.*, p.f - anchor + 10 AS step, p.x, p.y FROM a JOIN pose p ON p.rec = a.rec AND p.f BETWEEN anchor - 10 AND anchor + 10),
 h AS (SELECT *, sqrt(power(x - lag(x) OVER v, 2) + power(y - lag(y) OVER v, 2)) AS hop FROM w WINDOW v AS (PARTITION BY rec, anchor ORDER BY step)), g AS (SELECT *, count(*) OVER (PARTITION BY rec, anchor) AS n, sum(hop) OVER (PARTITION BY rec, anchor) AS travel FROM h)
 SELECT rec, anchor, step, round(cos(a0) * (x - x0) + sin(a0) * (y - y0), 5) AS x, round(cos(a0) * (y - y0) - sin(a0) * (x - x0), 5) AS y FROM g WHERE n = 21 AND travel >= 2000""")
def scenario_windows(spark, sf_dir):
    """Scenarios of 21 steps in the frame of their current step."""
    rows = poses(spark, sf_dir).withColumn("yaw", F.col("y") / 40)
    out = S.scenario_windows(rows, "rec", 8, 2000.0)
    return out.select("rec", "anchor", "step", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query("""WITH {POSE}, c(config, every) AS (VALUES ('full', 1), ('half', 2), ('fifth', 5)) SELECT config, rec, count(*) AS n, max(f // every) AS last FROM pose, c WHERE f % every = 0 GROUP BY 1, 2""")
def several_rates(spark, sf_dir):
    """Recordings at three rates from one pass."""
    configs = {"full": 1, "half": 2, "fifth": 5}
    rows = poses(spark, sf_dir).withColumn("segment", F.col("rec"))
    return S.at_rates(rows, "segment", configs).groupBy("config", "rec").agg(F.count("*").alias("n"), F.max("f").alias("last"))


@query(f"""WITH RECURSIVE {LINK_SQL}, lk AS (SELECT id AS a, nid AS b FROM r WHERE o = 1 AND i = 1), e AS (SELECT a, b FROM lk UNION ALL SELECT b, a FROM lk), n AS (SELECT DISTINCT a AS node FROM e), reach(node, root) USING KEY (node) AS (SELECT node, node FROM n UNION (SELECT e.b, min(q.root) FROM reach q JOIN e ON e.a = q.node JOIN recurring.reach k ON k.node = e.b WHERE q.root < k.root GROUP BY e.b)),
 tr AS (SELECT d.*, root AS track FROM d JOIN reach ON node = id), h AS (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS hop FROM tr WINDOW w AS (PARTITION BY track ORDER BY f)) SELECT g, track, count(*) AS hits, min(f) AS f0, max(f) AS f1, round(sum(hop), 5) AS travel FROM h GROUP BY 1, 2 HAVING count(*) >= 5 AND sum(hop) >= 10""")
def linked_tracks(spark, sf_dir):
    """Tracks of events that follow each other from day to day."""
    rows = poses(spark, sf_dir).select(F.floor(F.col("t") / 86400).alias("f"), (F.col("rec") % 3).alias("g"), F.col("event_id").alias("id"), "x", "y")
    return S.tracks_from_detections(rows, "g", 8.0, 2, 5, 10.0).select("g", "track", "hits", "f0", "f1", F.round("travel", 5).alias("travel"))


#: Contacts of the predicted paths: straight to the goal, at one metre a step.
PREDICTED = CONTACTS.replace(SCENE, SCENE.replace("ego AS (", "ego0 AS (").replace("obs AS (", """g0 AS (SELECT scenario, arg_max(x, step) AS gx, arg_max(y, step) AS gy FROM ego0 GROUP BY 1), n0 AS (SELECT scenario, x, y, gx, gy, sqrt(power(gx - x, 2) + power(gy - y, 2)) AS far FROM ego0 JOIN g0 USING (scenario) WHERE step = 0 AND scenario % 3 <> 0),
 ego AS (SELECT scenario, 0 AS step, x, y FROM n0 UNION ALL SELECT scenario, k, x + coalesce((gx - x) * least(k * 1.0, far) / nullif(far, 0), 0), y + coalesce((gy - y) * least(k * 1.0, far) / nullif(far, 0), 0) FROM n0, generate_series(1, 10) AS g(k)), obs AS (""", 1))


@query(f"""WITH {PREDICTED}, c AS (SELECT scenario, gap FROM sc UNION ALL SELECT scenario, gap FROM dc), hit AS (SELECT scenario, bool_or(gap <= 0) AS hit FROM c GROUP BY 1), dd AS (SELECT p.scenario, avg(sqrt(power(p.x - e.x, 2) + power(p.y - e.y, 2))) AS ade FROM ego p JOIN ego0 e ON e.scenario = p.scenario AND e.step = p.step WHERE p.step > 0 GROUP BY 1),
 en AS (SELECT scenario, arg_max(x, step) AS x, arg_max(y, step) AS y FROM ego GROUP BY 1), sd AS (SELECT dd.scenario, ade, coalesce(hit, false) AS collided, CASE WHEN least(10.0, sqrt(gx * gx + gy * gy)) > 0 THEN (sqrt(gx * gx + gy * gy) - sqrt(power(gx - x, 2) + power(gy - y, 2))) / least(10.0, sqrt(gx * gx + gy * gy)) ELSE 0 END AS ratio FROM dd JOIN en USING (scenario) JOIN g0 USING (scenario) LEFT JOIN hit USING (scenario))
 SELECT s.scenario, coalesce(NOT collided AND ratio >= 0.5, false) AS success, collided, round(ade, 5) AS ade, round(ratio, 5) AS progress_ratio, CASE WHEN ade IS NOT NULL THEN 0.0::DOUBLE END AS wiggle FROM (SELECT DISTINCT scenario FROM ego0) s LEFT JOIN sd USING (scenario)""")
def scored_predictions(spark, sf_dir):
    """Straight predictions to each scenario's end followed at a speed; scenarios without a prediction fail."""
    ego, obs = scenario_tables(spark, sf_dir)
    goals = ego.groupBy("scenario").agg(F.max_by("x", "step").alias("gx"), F.max_by("y", "step").alias("gy"))
    start = ego.filter("step = 0 and scenario % 3 <> 0").join(goals, "scenario")
    k = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("f")
    pred = start.select("scenario", k, "x", "y", "gx", "gy").select("scenario", "f", (F.col("x") + (F.col("gx") - F.col("x")) * F.col("f") / 5).alias("x"), (F.col("y") + (F.col("gy") - F.col("y")) * F.col("f") / 5).alias("y"))
    out = S.score_predictions(pred, ego, obs, goals, SUB, RATE, 2.0, keep_missing=True)
    return out.select("scenario", "success", "collided", F.round("ade", 5).alias("ade"), F.round("progress_ratio", 5).alias("progress_ratio"), (F.round("wiggle", 5) + 0.0).alias("wiggle"))


@query("""WITH {POSE}, s AS (SELECT rec * 1000 + f // 21 AS rec, kind, bool_or(f % 21 >= 10) AS later, bool_or(f % 21 = 10) AS now, bool_or(f % 21 > 10) AS after FROM pose GROUP BY 1, 2) SELECT rec, kind FROM s WHERE later AND now AND after AND kind NOT IN ('error', 'signup')""")
def tracks_to_predict(spark, sf_dir):
    """Movable tracks that are there now and later."""
    obs = poses(spark, sf_dir).select((F.col("rec") * 1000 + F.floor(F.col("f") / 21)).alias("scenario"), F.col("kind").alias("track"), (F.col("f") % 21).alias("step"), (F.col("kind") == "error").alias("is_stationary"), (F.col("kind") == "signup").alias("is_operator"))
    return S.predicted_tracks(obs)[1].select(F.col("scenario").alias("rec"), F.col("track").alias("kind"))


@query("SELECT p_partkey, CASE p_name[1:3] WHEN 'red' THEN 'PEDESTRIAN' ELSE 'STATIC' END AS kind, round(p_retailprice + p_size / 2.0, 6) AS centre FROM part WHERE sqrt(power(p_size, 2) + power(p_partkey % 200, 2)) < 150 AND p_size < 40")
def sane_boxes(spark, sf_dir):
    """Boxes with sensible places and sizes, their coarse type and centre."""
    part = table(spark, sf_dir, "part")
    c = F.col
    boxes = part.select("p_partkey", F.when(F.substring("p_name", 1, 3) == "red", "Pedestrian").otherwise("Box").alias("category"), c("p_size").cast("double").alias("x"), (c("p_partkey") % 200).cast("double").alias("y"), c("p_retailprice").alias("z"), c("p_size").alias("length"), F.lit(1).alias("width"), c("p_size").alias("height"))
    return S.sane_boxes(boxes).select("p_partkey", S.coarse_type(c("category")).alias("kind"), F.round(S.box_centre(c("z"), c("height")), 6).alias("centre"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 OR c_nationkey = 3 THEN NULL WHEN c_custkey % 7 = 0 THEN 'mixed' WHEN c_acctbal / 10000 >= 0.8 THEN 'indoor' WHEN c_acctbal / 10000 <= 1 - 0.8 THEN 'outdoor' END AS environment FROM customer""")
def reviewed_environment(spark, sf_dir):
    """Environment of each row by drop lists, reviewed labels and an estimate; the first that holds."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("recording"), (F.col("c_acctbal") / 10000).alias("indoor"))
    reviewed = rows.filter("id % 7 = 0").select("id", F.lit("mixed").alias("label"))
    out = S.reviewed_environment(rows, rows.filter("id % 13 = 0").select("id"), spark.createDataFrame([(3,)], "recording int"), reviewed, 0.8)
    return out.select(F.col("id").alias("c_custkey"), "environment")


@query("""WITH {POSE}, l AS (SELECT rec * 1000 + f // 21 AS rec, list(x ORDER BY f) AS xs FROM pose GROUP BY 1) SELECT rec, len(CASE WHEN len(xs) = 21 THEN xs[11:21] ELSE xs END)::INT AS n, round(list_sum(CASE WHEN len(xs) = 21 THEN xs[11:21] ELSE xs END), 4) AS total FROM l""")
def future_layout(spark, sf_dir):
    """Tracks of either layout as current and future steps."""
    per = poses(spark, sf_dir).withColumn("rec", F.col("rec") * 1000 + F.floor(F.col("f") / 21)).groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("f", "x"))).alias("p")).select("rec", F.array("p.x").alias("tracks"))
    cut = per.select("rec", S.from_layouts(F.col("tracks"), F.lit(None).cast("array<array<double>>"))[0].alias("xs"))
    return cut.select("rec", F.size("xs").alias("n"), F.round(F.aggregate("xs", F.lit(0.0), lambda a, b: a + b), 4).alias("total"))


#: Users in ten groups, each group's events in order as one sequence.
GROUPED = "{POSE}, seq AS (SELECT rec % 10 AS g, event_id, t, x, y, kind, rec, row_number() OVER (PARTITION BY rec % 10 ORDER BY t, event_id) - 1 AS f FROM pose)"


def _grouped(spark, sf_dir):
    in_time = Window.partitionBy("g").orderBy("t", "event_id")
    return poses(spark, sf_dir).withColumn("g", F.col("rec") % 10).withColumn("f", F.row_number().over(in_time) - 1).withColumn("yaw", F.col("y") / 40)


@query(f"""WITH {GROUPED}, cover AS (SELECT * FROM seq QUALIFY f <= max(f) OVER (PARTITION BY g) - 10 AND count(*) OVER (PARTITION BY g) >= 21),
 m AS (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS hop0, t - lag(t) OVER w AS gap FROM cover WINDOW w AS (PARTITION BY g ORDER BY f)), c0 AS (SELECT *, (hop0 IS NULL OR hop0 > 350 OR gap > 43200) AS starts FROM m),
 c AS (SELECT *, sum(starts::INT) OVER (PARTITION BY g ORDER BY f) AS episode FROM c0) SELECT g, episode::BIGINT AS episode, count(*) AS n, min(f) AS f0, round(max(t) - min(t), 3) AS duration, round(coalesce(sum(CASE WHEN NOT starts THEN hop0 END), 0), 4) AS length FROM c GROUP BY 1, 2 HAVING count(*) >= 4 AND coalesce(sum(CASE WHEN NOT starts THEN hop0 END), 0) >= 1""")
def episodes_from_scenarios(spark, sf_dir):
    """Episodes that overlapping scenarios give when their frames are merged and cut again: those of the frames they cover."""
    windows = S.nested_windows(_grouped(spark, sf_dir), "g", 1, 0.0, 1 / 3600)
    _, episodes = S.scenarios_to_episodes(windows, "g", F.lit("train"), 350.0, 12.0, 4, 1.0)
    return episodes.select("g", "episode", "n", "f0", F.round("duration", 3).alias("duration"), F.round("length", 4).alias("length"))


_AHEAD = "cos(a0) * ({x} - x0) + sin(a0) * ({y} - y0)"


@query(f"""WITH {GROUPED}, a AS (SELECT g, f AS anchor, x AS x0, y AS y0, y / 40 AS a0 FROM seq WHERE f % 8 = 0), w AS (SELECT a.*, p.f - anchor + 10 AS step, p.x, p.y FROM a JOIN seq p ON p.g = a.g AND p.f BETWEEN anchor - 10 AND anchor + 10),
 h AS (SELECT *, sqrt(power(x - lag(x) OVER v, 2) + power(y - lag(y) OVER v, 2)) AS hop FROM w WINDOW v AS (PARTITION BY g, anchor ORDER BY step)), s AS (SELECT g, anchor, any_value(x0) AS x0, any_value(y0) AS y0, any_value(a0) AS a0, count(*) AS n_ego, sum({_AHEAD.format(x="x", y="y")}) AS ego FROM h GROUP BY 1, 2 HAVING count(*) = 21 AND sum(hop) >= 2000),
 tr AS (SELECT s.g, anchor, rec, count(*) AS n, max(p.f - anchor) AS ends, sum({_AHEAD.format(x="(p.x + 10)", y="p.y")}) AS along FROM s JOIN seq p ON p.g = s.g AND p.f BETWEEN anchor - 10 AND anchor + 10 WHERE event_id % 2 = 0 GROUP BY 1, 2, 3 HAVING max(p.f - anchor) >= 0), ts AS (SELECT g, anchor, count(*) AS n_tracks, sum(n)::BIGINT AS n_steps, sum(along) AS along FROM tr GROUP BY 1, 2),
 ce AS (SELECT s.g, anchor, floor(p.x / 50) AS ix, floor(p.y / 20) AS iy, count(*) FILTER (WHERE kind = 'click') AS n_occ, count(*) FILTER (WHERE kind <> 'click') AS n_free FROM s JOIN seq p ON p.g = s.g AND p.f BETWEEN anchor - 20 AND anchor + 20 GROUP BY 1, 2, 3, 4), cs AS (SELECT g, anchor, count(*) AS n_cells, sum(n_occ * 3 + n_free)::BIGINT AS looks FROM ce GROUP BY 1, 2),
 pt AS (SELECT s.g, anchor, count(*) AS n_points, sum(l_tax) AS z FROM s JOIN lineitem ON l_suppkey % 10 = s.g AND l_partkey % 200 = anchor WHERE sqrt(power(l_quantity * 10 - x0, 2) + power(l_discount * 1000 - y0, 2)) <= 150 GROUP BY 1, 2)
 SELECT s.g, s.anchor, n_ego, round(ego, 4) AS ego, coalesce(n_tracks, 0) AS n_tracks, coalesce(n_steps, 0) AS n_steps, round(coalesce(along, 0), 4) AS along, coalesce(n_cells, 0) AS n_cells, coalesce(looks, 0) AS looks, coalesce(n_points, 0) AS n_points, round(coalesce(z, 0), 4) AS z FROM s LEFT JOIN ts USING (g, anchor) LEFT JOIN cs USING (g, anchor) LEFT JOIN pt USING (g, anchor)""")
def whole_scenarios(spark, sf_dir):
    """Scenarios with their tracks, map cells and points as one row each; here with what each part adds up to."""
    rows = _grouped(spark, sf_dir)
    tracks = rows.filter("event_id % 2 = 0").select("g", "f", F.col("rec").alias("track"), F.lit("agent").alias("kind"), (F.col("x") + 10).alias("x"), "y")
    cells = rows.select("g", "f", F.floor(F.col("x") / 50).alias("ix"), F.floor(F.col("y") / 20).alias("iy"), F.when(F.col("kind") == "click", "occupied").otherwise("free").alias("state"))
    points = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey % 10 AS g", "l_partkey % 200 AS f", "l_quantity * 10 AS x", "l_discount * 1000 AS y", "l_tax AS z")
    out = S.whole_scenarios(rows.select("g", "f", "t", "x", "y", "yaw"), tracks.dropDuplicates(["g", "f", "track"]), cells, points, "g", 8, 2000.0, 20, 150.0)
    total = lambda array, of: F.coalesce(F.aggregate(array, F.lit(0.0), lambda s, e: s + of(e).cast("double")), F.lit(0.0))
    size = lambda c: F.coalesce(F.array_size(c), F.lit(0)).cast("long")
    return out.select(
        "g", "anchor", size("ego").alias("n_ego"), F.round(total("ego", lambda e: e["x"]), 4).alias("ego"), size("tracks").alias("n_tracks"), total("tracks", lambda t: F.size(t["steps"])).cast("long").alias("n_steps"),
        F.round(total("tracks", lambda t: total(t["steps"], lambda e: e["x"])), 4).alias("along"), size("cells").alias("n_cells"), total("cells", lambda c: c["n_occ"] * 3 + c["n_free"]).cast("long").alias("looks"), size("points").alias("n_points"), F.round(total("points", lambda p: p["z"]), 4).alias("z"),
    )
