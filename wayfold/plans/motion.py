"""Queries on segmentation and kinematics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geom import wrap
from ..operators import kinematics as K
from ..operators import reports, segments
from ..operators.selection import hash_split
from ..sources.tables import poses, table
from .registry import query

DAY, STEP, LEAST = 86_400.0, 200.0, 5

CUT_SQL = """{POSE}, marks AS (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS hop0, t - lag(t) OVER w AS gap FROM pose WINDOW w AS (PARTITION BY rec ORDER BY f)),
 cut0 AS (SELECT *, (hop0 IS NULL OR hop0 > 200 OR gap > 86400) AS starts FROM marks),
 cut AS (SELECT *, sum(starts::INT) OVER (PARTITION BY rec ORDER BY f) AS episode, CASE WHEN NOT starts THEN hop0 END AS hop, CASE WHEN NOT starts THEN gap END AS dt FROM cut0),
 stats AS (SELECT rec, episode, count(*) AS n, min(f) AS f0, min(t) AS t0, max(t) - min(t) AS duration, coalesce(sum(hop), 0) AS length, coalesce(quantile_cont(hop / greatest(dt, 1e-6), 0.5), 0) AS median_speed FROM cut GROUP BY 1, 2 HAVING count(*) >= 5 AND coalesce(sum(hop), 0) >= 3)"""


def _stats(spark, sf_dir):
    return segments.episode_stats(segments.cut_episodes(poses(spark, sf_dir), "rec", STEP, DAY), "rec", LEAST, 3.0)


@query(f"WITH {CUT_SQL} SELECT rec, episode::BIGINT AS episode, n, f0, round(duration, 3) AS duration, round(length, 4) AS length, round(median_speed, 6) AS median_speed FROM stats")
def episode_cut(spark, sf_dir):
    """Episodes of each user's events: cut at jumps and gaps, with length and median speed."""
    return _stats(spark, sf_dir).select("rec", "episode", "n", "f0", F.round("duration", 3).alias("duration"), F.round("length", 4).alias("length"), F.round("median_speed", 6).alias("median_speed"))


@query(f"""WITH {CUT_SQL}, s AS (SELECT *, CAST('0x' || substr(sha1(CAST(rec AS VARCHAR)), 1, 8) AS BIGINT) / 4294967295.0 AS u FROM stats),
 l AS (SELECT *, CASE WHEN u < 0.05 THEN 'test' WHEN u < 0.10 THEN 'validation' ELSE 'train' END AS split FROM s)
 SELECT split, count(*) AS episodes, sum(n)::BIGINT AS frames, round(sum(duration) / 3600, 4) AS hours, round(sum(length) / 1000, 6) AS km, round(quantile_cont(length, 0.5), 4) AS median_length, round(quantile_cont(median_speed, 0.5), 6) AS median_speed FROM l GROUP BY split""")
def episode_report(spark, sf_dir):
    """Episodes, frames, hours, kilometres and medians per split."""
    split = hash_split(F.col("rec").cast("string"))
    return _stats(spark, sf_dir).withColumn("split", split).groupBy("split").agg(
        F.count("*").alias("episodes"), F.sum("n").alias("frames"), F.round(F.sum("duration") / 3600, 4).alias("hours"), F.round(F.sum("length") / 1000, 6).alias("km"),
        F.round(F.percentile("length", 0.5), 4).alias("median_length"), F.round(F.percentile("median_speed", 0.5), 6).alias("median_speed"),
    )


@query("""WITH {POSE}, g AS (SELECT *, t - lag(t) OVER (PARTITION BY rec ORDER BY t) AS gap FROM pose), s AS (SELECT *, sum(CASE WHEN gap > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY t) AS segment FROM g)
 SELECT rec, segment::BIGINT AS segment, count(*) AS n, round(max(t) - min(t), 3) AS span FROM s GROUP BY 1, 2 HAVING count(*) >= 5""")
def gap_segments(spark, sf_dir):
    """Segments between long gaps in time, of five rows at least."""
    cut = segments.gap_segments(poses(spark, sf_dir), "rec", F.col("t"), DAY)
    return cut.groupBy("rec", "segment").agg(F.count("*").alias("n"), F.round(F.max("t") - F.min("t"), 3).alias("span")).filter("n >= 5")


@query("""WITH {POSE}, clip AS (SELECT *, rec % 10 AS place, rec * 1000 + floor(t / 604800) AS clip FROM pose),
 g AS (SELECT *, sum(CASE WHEN gap > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY clip ORDER BY t) AS piece FROM (SELECT *, t - lag(t) OVER (PARTITION BY clip ORDER BY t) AS gap FROM clip)),
 p AS (SELECT place, clip, piece, min(t) AS t0, max(t) AS t1, count(*) AS n FROM g GROUP BY 1, 2, 3),
 c AS (SELECT *, t0 - lag(t1) OVER (PARTITION BY place ORDER BY t0, clip, piece) AS gap2 FROM p),
 e AS (SELECT *, sum(CASE WHEN gap2 IS NULL OR gap2 <= 0 OR gap2 > 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY place ORDER BY t0, clip, piece) AS chain FROM c)
 SELECT place, chain::BIGINT AS chain, count(*) AS pieces, sum(n)::BIGINT AS n FROM e GROUP BY 1, 2""")
def piece_chain(spark, sf_dir):
    """Weekly clips cut at gaps and chained where one piece soon follows another at the same place."""
    rows = poses(spark, sf_dir).withColumns({"place": F.col("rec") % 10, "clip": F.col("rec") * 1000 + F.floor(F.col("t") / 604800)})
    chained = segments.chain_pieces(rows, "clip", 43_200.0, 7_200.0, ["place"])
    return chained.groupBy("place", "chain").agg(F.count("*").alias("pieces"), F.sum("n").alias("n"))


@query("""WITH {POSE}, lim(kind, base, speed) AS (VALUES ('click', 100.0, 0.001), ('view', 150.0, 0.002), ('purchase', 200.0, 0.0)), j AS (SELECT p.*, coalesce(base, 1.5) AS base, coalesce(speed, 15.0) AS speed FROM pose p LEFT JOIN lim USING (kind)),
 m AS (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) > base + speed * (t - lag(t) OVER w) + 1e-9 AS far FROM j WINDOW w AS (PARTITION BY rec, kind ORDER BY t, event_id)),
 s AS (SELECT *, sum(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY rec, kind ORDER BY t, event_id) AS part FROM m)
 SELECT rec, kind, part::BIGINT AS part, count(*) AS n, min(f) AS f0 FROM s GROUP BY 1, 2, 3""")
def track_split(spark, sf_dir):
    """Tracks (user and event type) split at implausible jumps."""
    limits = spark.createDataFrame([("click", 100.0, 0.001), ("view", 150.0, 0.002), ("purchase", 200.0, 0.0)], "kind string, base double, speed double")
    return segments.split_tracks(poses(spark, sf_dir), limits, ["rec", "kind"], then=["event_id"]).groupBy("rec", "kind", "part").agg(F.count("*").alias("n"), F.min("f").alias("f0"))


@query("SELECT conv_id, count(*) AS n, count(DISTINCT turn) AS distinct_frames, max(turn) AS \"last\", (count(*) = count(DISTINCT turn) AND max(turn) = count(*) - 1) AS contiguous FROM conversations GROUP BY 1")
def contiguous_turns(spark, sf_dir):
    """Whether each conversation's turns are 0..n-1, each once."""
    return segments.contiguity(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("""WITH {POSE} SELECT rec, f, round(coalesce((lead(x, 2) OVER w - lag(x, 2) OVER w) / (lead(t, 2) OVER w - lag(t, 2) OVER w), (lead(x) OVER w - lag(x) OVER w) / (lead(t) OVER w - lag(t) OVER w), (lead(x) OVER w - x) / (lead(t) OVER w - t), (x - lag(x) OVER w) / (t - lag(t) OVER w), (lead(x, 2) OVER w - x) / (lead(t, 2) OVER w - t), (x - lag(x, 2) OVER w) / (t - lag(t, 2) OVER w), 0), 6) AS vx,
 round(coalesce((lead(y, 2) OVER w - lag(y, 2) OVER w) / (lead(t, 2) OVER w - lag(t, 2) OVER w), (lead(y) OVER w - lag(y) OVER w) / (lead(t) OVER w - lag(t) OVER w), (lead(y) OVER w - y) / (lead(t) OVER w - t), (y - lag(y) OVER w) / (t - lag(t) OVER w), 0), 6) AS vy FROM pose WINDOW w AS (PARTITION BY rec ORDER BY f)""")
def velocity_central(spark, sf_dir):
    """Velocity by the widest central difference that exists, else one-sided."""
    return K.velocity(poses(spark, sf_dir), "rec", 2).select("rec", "f", F.round("vx", 6).alias("vx"), F.round("vy", 6).alias("vy"))


@query("""WITH {POSE}, h AS (SELECT rec, f, CASE WHEN f % 5 <> 3 THEN x END AS x, CASE WHEN f % 5 <> 3 THEN y END AS y, CASE WHEN f % 5 <> 3 THEN atan2(y - 50, x - 50) END AS yaw FROM pose),
 n AS (SELECT *, lag(x) OVER w AS xa, lead(x) OVER w AS xb, lag(y) OVER w AS ya, lead(y) OVER w AS yb, lag(yaw) OVER w AS a, lead(yaw) OVER w AS b FROM h WINDOW w AS (PARTITION BY rec ORDER BY f)),
 r AS (SELECT *, (b - a + pi()) - 2 * pi() * floor((b - a + pi()) / (2 * pi())) - pi() AS raw FROM n), d AS (SELECT *, CASE WHEN abs(raw) > pi() - 1e-9 THEN -pi() ELSE raw END AS turn FROM r)
 SELECT rec, f, round((xa + xb) / 2, 6) AS x, round((ya + yb) / 2, 6) AS y, round(cos(a + turn / 2), 6) AS c FROM d WHERE x IS NULL AND xa IS NOT NULL AND xb IS NOT NULL""")
def single_gap_fill(spark, sf_dir):
    """Every fifth frame taken away and filled from its neighbours."""
    rows = poses(spark, sf_dir)
    seen = F.col("f") % 5 != 3
    holes = rows.select("rec", "f", F.when(seen, F.col("x")).alias("x"), F.when(seen, F.col("y")).alias("y"), F.when(seen, F.atan2(F.col("y") - 50, F.col("x") - 50)).alias("yaw"))
    return K.fill_single_gaps(holes, "rec").filter("filled").select("rec", "f", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round(F.cos("yaw"), 6).alias("c"))


@query("""WITH {POSE}, a AS (SELECT *, atan2(y - 50, x - 245) AS yaw FROM pose), d AS (SELECT *, yaw - lag(yaw) OVER w AS r FROM a WINDOW w AS (PARTITION BY rec ORDER BY f)),
 k AS (SELECT *, (r + pi()) - 2 * pi() * floor((r + pi()) / (2 * pi())) - pi() AS hop FROM d)
 SELECT rec, f, round(first_value(yaw) OVER w + coalesce(sum(hop) OVER w, 0), 6) AS unwrapped FROM k WINDOW w AS (PARTITION BY rec ORDER BY f)""")
def yaw_unwrap(spark, sf_dir):
    """Bearing from a fixed point without jumps."""
    rows = poses(spark, sf_dir).withColumn("yaw", F.atan2(F.col("y") - 50, F.col("x") - 245))
    return K.unwrap(rows, "rec", "yaw", "unwrapped").select("rec", "f", F.round("unwrapped", 6).alias("unwrapped"))


@query("""WITH {POSE}, h AS (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS hop FROM pose WINDOW w AS (PARTITION BY rec ORDER BY f))
 SELECT rec, f, round(coalesce(sum(hop) OVER (PARTITION BY rec ORDER BY f), 0), 5) AS s FROM h""")
def arc_plain(spark, sf_dir):
    """Distance travelled along each user's path."""
    return K.arc_length(poses(spark, sf_dir), "rec").select("rec", "f", F.round("s", 5).alias("s"))


@query("""WITH RECURSIVE {POSE}, walk AS (SELECT rec, f, x AS ax, y AS ay, 0.0::DOUBLE AS s FROM pose WHERE f = 0 UNION ALL
 SELECT p.rec, p.f, CASE WHEN d > 60 THEN p.x ELSE w.ax END, CASE WHEN d > 60 THEN p.y ELSE w.ay END, w.s + CASE WHEN d > 60 THEN d ELSE 0 END
 FROM walk w JOIN pose p ON p.rec = w.rec AND p.f = w.f + 1, LATERAL (SELECT sqrt(power(p.x - w.ax, 2) + power(p.y - w.ay, 2)) AS d)) SELECT rec, f, round(s, 5) AS s FROM walk""")
def arc_jitter_free(spark, sf_dir):
    """Distance travelled where only moves of over 60 from the last anchor count."""
    return K.jitter_free_arc(poses(spark, sf_dir), "rec", 60.0).select("rec", "f", F.round("s", 5).alias("s"))


@query("""WITH {POSE}, m AS (SELECT rec, kind, quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my, count(*) AS n, max(t) - min(t) AS span FROM pose GROUP BY 1, 2),
 d AS (SELECT p.rec, p.kind, max(sqrt(power(x - mx, 2) + power(y - my, 2))) AS farthest FROM pose p JOIN m USING (rec, kind) GROUP BY 1, 2)
 SELECT rec, kind, n, round(farthest, 5) AS farthest, (n >= 3 AND span >= 86400 AND farthest < 200) AS is_stationary FROM m JOIN d USING (rec, kind)""")
def stationary_tracks(spark, sf_dir):
    """Tracks that stay within a radius of their medians."""
    return K.stationary(poses(spark, sf_dir), ["rec", "kind"], 200.0, 3, DAY).select("rec", "kind", "n", F.round("farthest", 5).alias("farthest"), "is_stationary")


@query("""WITH {POSE}, h AS (SELECT *, abs(y - 50) AS d, coalesce(sqrt(power(x - lag(x) OVER v, 2) + power(y - lag(y) OVER v, 2)), 0) AS hop FROM pose WINDOW v AS (PARTITION BY rec ORDER BY f)),
 c AS (SELECT rec, f, count(*) OVER w AS n, sum(CASE WHEN d < 40 THEN 1 ELSE 0 END) OVER w AS n_near, sum(hop) OVER w - first_value(hop) OVER w AS travel FROM h WINDOW w AS (PARTITION BY rec ORDER BY f ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))
 SELECT rec, f, n, n_near::BIGINT AS n_near, round(travel, 5) AS travel, ((n >= 11 OR travel >= 300) AND n_near > 0.8 * n) AS with_robot FROM c""")
def companion_window(spark, sf_dir):
    """Rows whose neighbourhood is nearly always near."""
    rows = poses(spark, sf_dir).withColumn("d", F.abs(F.col("y") - 50))
    return K.companion(rows, "rec", 5, 40.0, 0.8, 11, 300.0).select("rec", "f", "n", "n_near", F.round("travel", 5).alias("travel"), "with_robot")


@query("""WITH {POSE}, a AS (SELECT *, atan2(y - 50, x - 50) AS yaw FROM pose), m AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM a WINDOW w AS (PARTITION BY rec ORDER BY f)),
 v AS (SELECT rec, quantile_cont(cos(yaw - atan2(dy, dx)), 0.5) < 0 AS turned, count(*) AS votes FROM m WHERE sqrt(dx * dx + dy * dy) > 50 GROUP BY 1)
 SELECT rec, f, round(cos(CASE WHEN coalesce(turned, false) THEN yaw + pi() ELSE yaw END), 6) AS c FROM a LEFT JOIN v USING (rec)""")
def heading_repair(spark, sf_dir):
    """Headings turned about where they mostly point against the travel."""
    rows = poses(spark, sf_dir).withColumn("yaw", F.atan2(F.col("y") - 50, F.col("x") - 50))
    return K.repair_heading(rows, "rec", 50.0).select("rec", "f", F.round(F.cos("yaw"), 6).alias("c"))


@query("""WITH {POSE} SELECT rec, round(coalesce(-quantile_cont(CASE WHEN kind = 'view' AND sqrt(x * x + y * y) < 80 THEN y - x / 2 END, 0.5), 0.76), 6) AS height FROM pose GROUP BY 1""")
def ground_height(spark, sf_dir):
    """Origin height of each recording from near objects, with a default."""
    rows = poses(spark, sf_dir).select("rec", "x", "y", F.when(F.col("kind") == "view", "PEDESTRIAN").otherwise("OTHER").alias("kind"), F.col("y").alias("z"), F.col("x").alias("h"))
    return K.ground_height(rows, "rec", 80.0, 0.76).select("rec", F.round("height", 6).alias("height"))


@query("""WITH {POSE}, n AS (SELECT rec, max(f) AS last FROM pose GROUP BY 1), o AS (SELECT p.rec, p.f, greatest(0, least(last, p.f + k)) AS at FROM pose p JOIN n USING (rec), generate_series(-2, 2) AS g(k))
 SELECT o.rec, o.f, round(quantile_cont(q.x, 0.5), 6) AS smooth FROM o JOIN pose q ON q.rec = o.rec AND q.f = o.at GROUP BY 1, 2""")
def median_smooth(spark, sf_dir):
    """Running median of five with the ends repeated."""
    return K.median_filter(poses(spark, sf_dir), "rec", "x", 2).select("rec", "f", F.round("smooth", 6).alias("smooth"))


@query(f"""WITH {CUT_SQL}, e AS (SELECT rec, episode, max(t) AS t1 FROM cut GROUP BY 1, 2)
 SELECT rec, episode::BIGINT AS episode, coalesce(quantile_cont(hop / greatest(dt, 1e-6), 0.5) < 0.005, true) AS ends_at_rest, count(*) AS n_late FROM cut JOIN e USING (rec, episode) WHERE t >= t1 - 43200 GROUP BY 1, 2""")
def ends_at_rest(spark, sf_dir):
    """Episodes that are slow over their last half day."""
    cut = segments.cut_episodes(poses(spark, sf_dir), "rec", STEP, DAY).withColumn("speed", F.col("hop") / F.greatest(F.col("dt"), F.lit(1e-6))).withColumn("key", F.struct("rec", "episode"))
    out = K.ends_at_rest(cut, "key", 43_200.0, 0.005)
    return out.select("key.rec", "key.episode", "ends_at_rest", "n_late")


@query("""WITH {POSE} SELECT rec, f, round(atan2(coalesce((lead(y) OVER w - lag(y) OVER w) / 2, lead(y) OVER w - y, y - lag(y) OVER w, 0), coalesce((lead(x) OVER w - lag(x) OVER w) / 2, lead(x) OVER w - x, x - lag(x) OVER w, 0)), 6) AS heading, round(lead(t) OVER w - t, 3) AS gap FROM pose WINDOW w AS (PARTITION BY rec ORDER BY f)""")
def gradient_heading(spark, sf_dir):
    """Heading from positions, and the time to the next row."""
    return K.sensor_gap(K.gradient_heading(poses(spark, sf_dir), "rec"), "rec").select("rec", "f", F.round("heading", 6).alias("heading"), F.round("gap", 3).alias("gap"))


@query("""WITH {POSE}, n AS (SELECT rec, max(f) AS last FROM pose GROUP BY 1), r AS (SELECT p.rec, p.f, p.x, k FROM pose p JOIN n USING (rec), generate_series(1, 1 + CASE WHEN p.f = 0 THEN 10 ELSE 0 END + CASE WHEN p.f = last THEN 10 ELSE 0 END) AS g(k))
 SELECT rec, f, round(x, 6) AS x, row_number() OVER (PARTITION BY rec ORDER BY f, k) - 1 AS "index" FROM r""")
def rest_padding(spark, sf_dir):
    """First and last rows repeated ten times, numbered anew."""
    return K.resting_pad(poses(spark, sf_dir), "rec", 10).select("rec", "f", F.round("x", 6).alias("x"), "index")


@query(f"""WITH {CUT_SQL}, b AS (SELECT rec, avg(CASE WHEN kind IN ('view', 'click') THEN 1.0 ELSE 0.0 END) AS share FROM cut GROUP BY 1)
 SELECT CASE WHEN share IS NULL THEN 'unknown' WHEN share >= 0.8 THEN 'indoor' WHEN share <= 0.2 THEN 'outdoor' ELSE 'mixed' END AS environment, count(*) AS n, round(avg(share), 6) AS share FROM b GROUP BY 1""")
def environment_summary(spark, sf_dir):
    """Recordings by their share of frames of two kinds."""
    share = poses(spark, sf_dir).groupBy("rec").agg(F.avg(F.col("kind").isin("view", "click").cast("double")).alias("share"))
    return share.groupBy(reports.environment(F.col("share")).alias("environment")).agg(F.count("*").alias("n"), F.round(F.avg("share"), 6).alias("share"))


@query("""WITH {POSE} SELECT event_id, round((x / 10 + pi()) - 2 * pi() * floor((x / 10 + pi()) / (2 * pi())) - pi(), 6) AS wrapped, round(cos(y / 30) * (x - 245) + sin(y / 30) * (y - 50), 6) AS ahead, round(cos(y / 30) * (y - 50) - sin(y / 30) * (x - 245), 6) AS left_of,
 round(sqrt(power(greatest(abs(cos(y / 30) * (x - 245) + sin(y / 30) * (y - 50)) - 20, 0), 2) + power(greatest(abs(cos(y / 30) * (y - 50) - sin(y / 30) * (x - 245)) - 5, 0), 2)), 6) AS gap, round(degrees(2 * atan(x / 200)), 6) AS fov FROM pose""")
def geometry_columns(spark, sf_dir):
    """Wrapped angles, points in a frame, distances to a box and fields of view."""
    from ..functions.geom import box_distance, field_of_view, to_frame

    x, y, yaw = F.col("x"), F.col("y"), F.col("y") / 30
    ahead, left = to_frame(F.lit(245.0), F.lit(50.0), yaw, x, y)
    gap = box_distance(x, y, F.lit(245.0), F.lit(50.0), yaw, F.lit(40.0), F.lit(10.0))
    return poses(spark, sf_dir).select("event_id", F.round(wrap(x / 10), 6).alias("wrapped"), F.round(ahead, 6).alias("ahead"), F.round(left, 6).alias("left_of"), F.round(gap, 6).alias("gap"), F.round(field_of_view(x, F.lit(100.0)), 6).alias("fov"))
