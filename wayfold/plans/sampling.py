"""Queries on samples, goals, tags and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import samples as P
from ..operators.lineage import shared_folder
from ..sources.tables import poses, table
from ..streaming import streams
from .registry import query
from .scoring import SCENE, scenario_tables


def _frames(spark, sf_dir):
    return poses(spark, sf_dir).withColumn("yaw", F.col("y") / 40)


ELIGIBLE = "{POSE}, e AS (SELECT *, y / 40 AS yaw, max(t) OVER (PARTITION BY rec) AS t1 FROM pose), s AS (SELECT * FROM e WHERE f % 5 = 0 AND t1 - t >= 86400 - 1e-6)"


@query(f"WITH {ELIGIBLE} SELECT rec, f FROM s")
def eligible_samples(spark, sf_dir):
    """Every fifth frame with a day of its recording ahead."""
    return P.eligible(_frames(spark, sf_dir), "rec", 5, 86_400.0).select("rec", "f")


@query(f"""WITH {ELIGIBLE}, q AS (SELECT rec, f, x AS x0, y AS y0, yaw AS a, k, t + k * 21600.0 AS qt FROM s, generate_series(1, 4) AS g(k)), n AS (SELECT rec, t, x, y, lead(t) OVER w AS t2, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM pose WINDOW w AS (PARTITION BY rec ORDER BY t)),
 i AS (SELECT q.*, n.x + coalesce((n.x2 - n.x) * (qt - n.t) / (n.t2 - n.t), 0) AS px, n.y + coalesce((n.y2 - n.y) * (qt - n.t) / (n.t2 - n.t), 0) AS py FROM q ASOF JOIN n ON q.rec = n.rec AND q.qt >= n.t)
 SELECT rec, f, k::INT AS k, round(cos(a) * (px - x0) + sin(a) * (py - y0), 4) AS x, round(cos(a) * (py - y0) - sin(a) * (px - x0), 4) AS y FROM i""")
def timed_targets(spark, sf_dir):
    """Four positions evenly over the next day, in each sample's frame."""
    frames = _frames(spark, sf_dir)
    out = P.timed_targets(frames, P.eligible(frames, "rec", 5, 86_400.0), "rec", 86_400.0, 4)
    return out.select("rec", "f", "k", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


ARCS = """{ELIGIBLE}, hop AS (SELECT *, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)), 0) AS hop FROM e WINDOW w AS (PARTITION BY rec ORDER BY f)), arc AS (SELECT *, sum(hop) OVER (PARTITION BY rec ORDER BY f) AS s FROM hop),
 nx AS (SELECT rec, s, x, y, lead(s) OVER w AS s2, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM arc WINDOW w AS (PARTITION BY rec ORDER BY f)), fin AS (SELECT rec, max(s) AS total FROM arc GROUP BY 1), mine AS (SELECT a.rec, a.f, a.x AS x0, a.y AS y0, a.yaw AS a, a.s AS s0, total FROM arc a JOIN s USING (rec, f) JOIN fin ON fin.rec = a.rec)""".replace("{ELIGIBLE}", ELIGIBLE)


@query(f"""WITH {ARCS}, q AS (SELECT m.*, k, least(s0 + k * 100, total) AS want FROM mine m, generate_series(1, 5) AS g(k)), placed AS (SELECT q.*, CASE WHEN s2 IS NULL THEN n.x ELSE n.x + (n.x2 - n.x) * (want - n.s) / (s2 - n.s) END AS px, CASE WHEN s2 IS NULL THEN n.y ELSE n.y + (n.y2 - n.y) * (want - n.s) / (s2 - n.s) END AS py FROM q ASOF JOIN nx n ON q.rec = n.rec AND q.want >= n.s)
 SELECT rec, f, k::INT AS k, round(cos(a) * (px - x0) + sin(a) * (py - y0), 4) AS x, round(cos(a) * (py - y0) - sin(a) * (px - x0), 4) AS y, s0 + k * 100 > total AS stop FROM placed""")
def waypoint_samples(spark, sf_dir):
    """Points every 100 along the path ahead, with a stop flag at its end."""
    frames = _frames(spark, sf_dir)
    out = P.waypoints(frames, P.eligible(frames, "rec", 5, 86_400.0), "rec", 100.0, 5)
    return out.select("rec", "f", "k", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "stop")


@query(f"""WITH {ELIGIBLE}, q AS (SELECT rec, f, j, t - j * 7200.0 + 1e-6 AS want FROM s, generate_series(1, 3) AS g(j)) SELECT q.rec, q.f, q.j::INT AS j, coalesce(p.f, 0) AS at, p.f IS NULL AS missing FROM q ASOF LEFT JOIN pose p ON p.rec = q.rec AND q.want >= p.t""")
def history_frames(spark, sf_dir):
    """Last frames at or before earlier moments, the first where there is none."""
    frames = _frames(spark, sf_dir)
    return P.history(frames, P.eligible(frames, "rec", 5, 86_400.0), "rec", 3, 7_200.0).select("rec", "f", "j", "at", "missing")


@query(f"""WITH {ELIGIBLE}, q AS (SELECT rec, f, o, t + o AS want FROM s, (VALUES (-36000), (0), (36000)) AS v(o)), c AS (SELECT q.rec, q.f, q.o, p.f AS pf, row_number() OVER (PARTITION BY q.rec, q.f, q.o ORDER BY abs(p.t - q.want), p.t) AS n FROM q JOIN pose p ON p.rec = q.rec)
 SELECT rec, f, o AS "offset", CASE WHEN o <= 0 THEN least(pf, f) ELSE pf END AS at FROM c WHERE n = 1""")
def view_frames(spark, sf_dir):
    """Nearest frames to ten hours before and after, never later than now for the past."""
    frames = _frames(spark, sf_dir)
    return P.views([-36_000, 0, 36_000], frames, P.eligible(frames, "rec", 5, 86_400.0), "rec")


@query("""WITH {POSE}, v AS (SELECT rec, f, y / 40 AS a, coalesce((x - lag(x) OVER w) / (t - lag(t) OVER w), 0) AS vx, coalesce((y - lag(y) OVER w) / (t - lag(t) OVER w), 0) AS vy FROM pose WINDOW w AS (PARTITION BY rec ORDER BY f)) SELECT rec, f, round(cos(a) * vx + sin(a) * vy, 6) AS v_ahead, round(cos(a) * vy - sin(a) * vx, 6) AS v_left FROM v""")
def ego_velocity(spark, sf_dir):
    """Velocity in each row's own frame."""
    return P.ego_velocity(_frames(spark, sf_dir), "rec").select("rec", "f", F.round("v_ahead", 6).alias("v_ahead"), F.round("v_left", 6).alias("v_left"))


@query("""WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders) SELECT o_custkey, o_orderkey FROM n WHERE n = floor(CAST('0x' || substr(md5('11|' || CAST(o_custkey AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 * c)""")
def seeded_choice(spark, sf_dir):
    """One order of each customer by a reproducible number."""
    return P.choose(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], "11").select("o_custkey", "o_orderkey")


@query(f"""WITH {ARCS}, q AS (SELECT *, least(s0 + 550 + CAST('0x' || substr(md5('4|' || CAST(rec AS VARCHAR) || '|' || CAST(f AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 * 300, total) AS want FROM mine WHERE total - s0 >= 550)
 SELECT q.rec, q.f, round(CASE WHEN s2 IS NULL THEN n.x ELSE n.x + (n.x2 - n.x) * (want - n.s) / (s2 - n.s) END, 4) AS gx, round(CASE WHEN s2 IS NULL THEN n.y ELSE n.y + (n.y2 - n.y) * (want - n.s) / (s2 - n.s) END, 4) AS gy FROM q ASOF JOIN nx n ON q.rec = n.rec AND q.want >= n.s""")
def goals_beyond(spark, sf_dir):
    """A goal for each sample further along its recording than the horizon."""
    frames = _frames(spark, sf_dir)
    return P.goals_beyond(frames, P.eligible(frames, "rec", 5, 86_400.0), "rec", 500.0, 50.0, 300.0, "4").select("rec", "f", F.round("gx", 4).alias("gx"), F.round("gy", 4).alias("gy"))


@query(f"""WITH {SCENE}, b AS (SELECT o.scenario, o.track, o.step, o.x, o.y, sqrt(power(o.x - e.x, 2) + power(o.y - e.y, 2)) AS d FROM obs o JOIN ego e ON e.scenario = o.scenario AND e.step = o.step WHERE o.track % 5 = 1), rf AS (SELECT scenario, arg_max(x, step) - arg_min(x, step) AS rx, arg_max(y, step) - arg_min(y, step) AS ry FROM ego GROUP BY 1),
 hr AS (SELECT scenario, track, min(d) AS d, count(*) AS n, arg_max(x, step) - arg_min(x, step) AS mx, arg_max(y, step) - arg_min(y, step) AS my, min(d) FILTER (WHERE step = 0) AS d0 FROM b GROUP BY 1, 2), cs AS (SELECT *, (mx * rx + my * ry) / nullif(sqrt(mx * mx + my * my) * sqrt(rx * rx + ry * ry), 0) AS c FROM hr JOIN rf USING (scenario)),
 wy AS (SELECT scenario, d0, CASE WHEN n >= 2 AND d <= 1.5 AND sqrt(mx * mx + my * my) >= 0.5 AND sqrt(rx * rx + ry * ry) >= 0.5 THEN CASE WHEN c < -0.7 THEN 'people:oncoming' WHEN c > 0.7 THEN 'people:same_direction' ELSE 'people:crossing' END END AS way FROM cs), pp AS (SELECT scenario, list(DISTINCT way) FILTER (WHERE way IS NOT NULL) AS ways, count(*) FILTER (WHERE d0 < 8) AS n FROM wy GROUP BY 1),
 dl AS (SELECT scenario, step, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM ego WINDOW w AS (PARTITION BY scenario ORDER BY step)), tn AS (SELECT scenario, step, atan2(dy, dx) AS h FROM dl WHERE sqrt(dx * dx + dy * dy) > 0.05), td AS (SELECT scenario, h - lag(h) OVER (PARTITION BY scenario ORDER BY step) AS r FROM tn),
 tt AS (SELECT scenario, abs(degrees(coalesce(sum((r + pi()) - 2 * pi() * floor((r + pi()) / (2 * pi())) - pi()), 0))) AS turn, count(*) AS moves FROM td GROUP BY 1), en AS (SELECT scenario, abs(degrees(atan2(arg_max(y, step), arg_max(x, step)))) AS b FROM ego GROUP BY 1)
 SELECT en.scenario, coalesce(n, 0) AS n, array_to_string(list_sort(list_concat(coalesce(ways, []), [CASE WHEN coalesce(n, 0) = 0 THEN 'people:none' WHEN n >= 5 THEN 'people:crowd' ELSE 'people:few' END, CASE WHEN coalesce(moves, 0) < 2 THEN 'path:mostly_still' WHEN turn > 135 THEN 'path:u_turn' WHEN turn > 45 THEN 'path:turn' ELSE 'path:straight' END,
  CASE WHEN b <= 30 THEN 'goal:ahead' WHEN b <= 90 THEN 'goal:side' ELSE 'goal:behind' END])), ',') AS tags FROM en LEFT JOIN pp USING (scenario) LEFT JOIN tt USING (scenario)""")
def scenario_tags(spark, sf_dir):
    """Tags of people and path of each scenario."""
    ego, obs = scenario_tables(spark, sf_dir)
    people = P.people_tags(obs, ego)
    turns = M.total_turn(ego.withColumnRenamed("step", "f"), "scenario", 0.05)
    ends = ego.groupBy("scenario").agg(F.degrees(F.atan2(F.max_by("y", "step"), F.max_by("x", "step"))).alias("b"))
    tagged = people.join(turns, "scenario", "left").join(ends, "scenario")
    return tagged.select("scenario", "n", F.array_join(F.array_sort(F.concat("tags", P.path_tags(F.col("turn"), F.col("moves"), F.col("b"), F.lit(None).cast("double")))), ",").alias("tags"))


#: Parts of the event table that a stream reads one after the other, files of each, and how long after the last event the stream says that nothing else comes.
FILES, WIDE, QUIET = 4, 4, 10 * 86_400


def _streamed(spark, sf_dir, build, mode: str):
    """Runs a streaming query over the event table to its end and returns what it wrote.

    Events come in order of time, a part a batch, written and read by several tasks.  A last file has one row of a recording of its own (null) long after
    all others, so that the watermark passes them and what is still open comes out.
    """
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("rec"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"))
    first, last = events.select(F.min("ts"), F.max("ts")).first()
    place = F.least(F.lit(FILES - 1), F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(first))) * FILES / F.greatest(F.lit(1), F.unix_micros(F.lit(last)) - F.unix_micros(F.lit(first)))))
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}-out"
    for k in range(FILES):
        events.filter(place == k).repartition(WIDE).write.mode("append").parquet(base)
    end = spark.range(1).select(F.lit(None).cast("long").alias("rec"), F.lit(-1).cast("long").alias("event_id"), F.timestamp_seconds(F.unix_seconds(F.lit(last)) + QUIET).alias("ts"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    end.write.mode("append").parquet(base)
    stream = build(streams.pose_stream(spark, base, files_per_batch=WIDE))
    if mode == "append":
        q = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{base}-state").trigger(availableNow=True).start()
    else:
        q = stream.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", f"{base}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).filter(F.col(stream.columns[0]).isNotNull())


@query("WITH m AS (SELECT user_id AS run, min(value) AS loss FROM events GROUP BY 1) SELECT run, loss, (SELECT min(event_id) FROM events e WHERE e.user_id = m.run AND e.value = m.loss) AS step FROM m")
def stream_best(spark, sf_dir):
    """Least value of each user, kept over a stream of events."""
    return _streamed(spark, sf_dir, lambda s: streams.rolling_best(s.select(F.col("rec").alias("run"), F.col("event_id").alias("step"), F.col("x").alias("loss"))), "complete")


@query("""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 43200000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
 SELECT user_id AS rec, epoch_us(min(ts)) AS "start", epoch_us(max(ts)) + 43200000000 AS "end", count(*) AS n, min(value) AS x_min, max(value) AS x_max FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    """Sessions of each user, as they end in a stream; start and end in microseconds."""
    out = _streamed(spark, sf_dir, lambda s: streams.sessions(s, "12 hours", "1 hour"), "append")
    return out.withColumns({c: F.unix_micros(c) for c in ("start", "end")})


@query("""WITH {POSE}, h AS (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS step, t - lag(t) OVER w AS gap FROM pose WINDOW w AS (PARTITION BY rec ORDER BY f)), c AS (SELECT *, coalesce(step > 200 OR gap > 86400, false) AS cut FROM h), e AS (SELECT *, sum(cut::INT) OVER (PARTITION BY rec ORDER BY f) AS k FROM c)
 SELECT rec, round(min(t), 3) AS t0, round(max(t), 3) AS t1, count(*) AS n, round(coalesce(sum(CASE WHEN NOT cut THEN step END), 0), 4) AS length FROM e GROUP BY rec, k""")
def stream_episodes(spark, sf_dir):
    """Episodes of each user, as jumps, gaps or silence end them in a stream."""
    out = _streamed(spark, sf_dir, lambda s: streams.live_episodes(s, 200.0, 86_400.0, "1 hour"), "append")
    return out.select("rec", F.round("t0", 3).alias("t0"), F.round("t1", 3).alias("t1"), "n", F.round("length", 4).alias("length"))
