"""Queries on predictions against targets, episodes at their ends, and reports of splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis as A
from ..operators import kinematics as K
from ..operators import metrics as M
from ..operators import reports, segments
from ..operators.selection import hash_split
from ..sources.tables import poses
from .motion import CUT_SQL, DAY, LEAST, STEP
from .registry import query


@query("""WITH {POSE}, d AS (SELECT kind, y / 100 AS share, ln(1 + floor(x / 50)) + y / 500 AS logged, 1 / (1 + exp(-(y - 50) / 20)) AS p, floor(x / 50) AS n FROM pose)
 SELECT kind, round(1 - sum(power(share - p, 2)) / (var_pop(share) * count(*)), 6) AS r2, round(avg(abs(share - p)), 6) AS mae, round(avg(abs(exp(logged) - 1 - n)), 5) AS count_mae FROM d GROUP BY kind""")
def decoded_fit(spark, sf_dir):
    """How well stored logits and logged counts tell shares and counts, once decoded."""
    rows = poses(spark, sf_dir).select("kind", (F.col("y") / 100).alias("share"), A.decoded((F.col("y") - 50) / 20, "share").alias("p"), F.floor(F.col("x") / 50).alias("n"), A.decoded(F.log1p(F.floor(F.col("x") / 50)) + F.col("y") / 500, "count").alias("c"))
    off = F.pow(F.col("share") - F.col("p"), 2)
    return rows.groupBy("kind").agg(F.round(1 - F.sum(off) / (F.var_pop("share") * F.count("*")), 6).alias("r2"), F.round(F.avg(F.abs(F.col("share") - F.col("p"))), 6).alias("mae"), F.round(F.avg(F.abs(F.col("c") - F.col("n"))), 5).alias("count_mae"))


PROBES = """p AS (SELECT kind AS probe, f % 4 AS k, x / 100 AS x, y / 100 AS y, (x + 9 * cos(event_id)) / 100 AS px, (y + 5 * sin(event_id)) / 100 AS py FROM pose), m AS (SELECT *, avg(x) OVER (PARTITION BY probe, k) AS mx, avg(y) OVER (PARTITION BY probe, k) AS my FROM p),
 s AS (SELECT probe, avg(sqrt(power(x - px, 2) + power(y - py, 2))) * 2 AS metres, 1 - sum(power(x - px, 2) + power(y - py, 2)) / sum(power(x - mx, 2) + power(y - my, 2)) AS r2 FROM m GROUP BY 1)"""


def _probes(spark, sf_dir):
    i = F.col("event_id").cast("double")
    rows = poses(spark, sf_dir).select(F.col("kind").alias("probe"), (F.col("f") % 4).alias("k"), (F.col("x") / 100).alias("x"), (F.col("y") / 100).alias("y"), ((F.col("x") + 9 * F.cos(i)) / 100).alias("px"), ((F.col("y") + 5 * F.sin(i)) / 100).alias("py"))
    return A.probe_scores(rows, ["probe"], 2.0)


@query(f"WITH {{POSE}}, {PROBES} SELECT probe, round(metres, 6) AS metres, round(r2, 6) AS r2 FROM s")
def probe_scores(spark, sf_dir):
    """Mean distance and explained variance of predicted places, by kind."""
    return _probes(spark, sf_dir).select("probe", F.round("metres", 6).alias("metres"), F.round("r2", 6).alias("r2"))


@query(f"""WITH {{POSE}}, {PROBES}, l AS (SELECT 'trajectory' AS target, probe AS entry, metres AS score FROM s UNION ALL SELECT 'occupancy', probe, r2 FROM s)
 SELECT target, arg_min(entry, CASE WHEN target = 'occupancy' THEN -score ELSE score END) AS entry, round(min(CASE WHEN target = 'occupancy' THEN -score ELSE score END) * CASE WHEN target = 'occupancy' THEN -1 ELSE 1 END, 6) AS score, false AS reference FROM l GROUP BY target UNION ALL SELECT * FROM (VALUES ('trajectory', 'straight_line', 1.5::DOUBLE, true), ('occupancy', 'mean', 0.0, true))""")
def probe_leaders(spark, sf_dir):
    """The best entry of each target, with the reference rows of the targets that have one."""
    scores = _probes(spark, sf_dir)
    results = scores.select(F.lit("trajectory").alias("target"), F.col("probe").alias("entry"), F.col("metres").alias("score")).unionByName(scores.select(F.lit("occupancy").alias("target"), F.col("probe").alias("entry"), F.col("r2").alias("score")))
    best = A.leaderboard(results, ["target"], "score", F.col("target") == "occupancy")
    references = spark.createDataFrame([("trajectory", "straight_line", 1.5), ("occupancy", "mean", 0.0), ("depth", "mean", 0.0)], "target string, entry string, score double")
    return A.with_references(best, references, ["target"], "score").withColumn("score", F.round("score", 6))


@query("WITH {POSE} SELECT event_id, round((x - 3 * y - avg(x - 3 * y) OVER ()) / (stddev_samp(x - 3 * y) OVER () + 1e-4), 5) AS advantage FROM pose")
def advantages_over_value(spark, sf_dir):
    """Rewards less an expected value, over the deviation of all of them."""
    return A.advantages_over(poses(spark, sf_dir).withColumn("v", F.col("y") * 3), "x", "v").select("event_id", F.round("advantage", 5).alias("advantage"))


@query(f"""WITH {CUT_SQL}, e AS (SELECT rec, episode, max(t) AS t1, max(f) AS f1 FROM cut WHERE x IS NOT NULL GROUP BY 1, 2), l AS (SELECT rec, max(f) AS last FROM cut GROUP BY 1)
 SELECT rec, episode::BIGINT AS episode, coalesce(quantile_cont(hop / greatest(dt, 1e-6), 0.5) < 0.005, true) AND any_value(f1) = any_value(last) AS stops FROM cut JOIN e USING (rec, episode) JOIN l USING (rec) WHERE t >= t1 - 43200 GROUP BY 1, 2""")
def stops_for_good(spark, sf_dir):
    """Episodes that end at rest at the end of their recording."""
    cut = segments.cut_episodes(poses(spark, sf_dir), "rec", STEP, DAY).withColumn("speed", F.col("hop") / F.greatest(F.col("dt"), F.lit(1e-6)))
    return K.stops_for_good(cut, "rec", "episode", 43_200.0, 0.005)


@query("""WITH {POSE}, c AS (SELECT *, rec % 6 AS chain FROM pose), g AS (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) > (t - lag(t) OVER w) * 0.03 AS far FROM c WINDOW w AS (PARTITION BY chain ORDER BY t, event_id)), s AS (SELECT *, sum(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY chain ORDER BY t, event_id) AS part FROM g)
 SELECT chain, part::BIGINT AS part, count(*) AS n, round(min(t), 3) AS t0 FROM s GROUP BY 1, 2""")
def chain_parts(spark, sf_dir):
    """Chains cut where they move faster than poses can."""
    rows = poses(spark, sf_dir).withColumn("chain", F.col("rec") % 6)
    return segments.cut_chains(rows, ["chain"], 0.03, then=["event_id"]).groupBy("chain", "part").agg(F.count("*").alias("n"), F.round(F.min("t"), 3).alias("t0"))


@query("""WITH {POSE}, w AS (SELECT a.event_id, p.f - a.f AS k, p.y - a.y AS y, (p.y - a.y) / 90 AS yaw FROM pose a JOIN pose p ON p.rec = a.rec AND p.f BETWEEN a.f AND a.f + 4 WHERE a.f % 5 = 0) SELECT event_id, round(degrees(arg_max(yaw, k)), 5) AS heading_deg, round(arg_max(y, k), 5) AS lateral FROM w GROUP BY 1""")
def motion_turn(spark, sf_dir):
    """How far windows of four steps have turned and gone to the side at their end."""
    rows = poses(spark, sf_dir)
    start = rows.filter("f % 5 = 0").select("rec", "event_id", "f", F.col("y").alias("y0")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    at = start.select("rec", "event_id", "k", "y0", (F.col("f") + F.col("k")).alias("f")).join(rows.select("rec", "f", "x", "y"), ["rec", "f"])
    targets = at.select("event_id", "k", "x", (F.col("y") - F.col("y0")).alias("y"), ((F.col("y") - F.col("y0")) / 90).alias("yaw"))
    return M.motion_turn(targets, "event_id").select("event_id", F.round("heading_deg", 5).alias("heading_deg"), F.round("lateral", 5).alias("lateral"))


@query(f"""WITH {CUT_SQL}, s AS (SELECT *, CAST('0x' || substr(sha1(CAST(rec AS VARCHAR)), 1, 8) AS BIGINT) / 4294967295.0 AS u FROM stats), l AS (SELECT *, CASE WHEN u < 0.05 THEN 'test' WHEN u < 0.10 THEN 'validation' ELSE 'train' END AS split FROM s),
 fr AS (SELECT split, avg((y / 100 > 0.5)::INT) AS indoor FROM cut JOIN l USING (rec, episode) GROUP BY 1), e AS (SELECT split, CASE WHEN episode % 2 = 0 THEN 'indoor' ELSE 'mixed' END AS environment, count(*) AS c FROM l GROUP BY 1, 2)
 SELECT split, count(*) AS episodes, sum(n)::BIGINT AS frames, round(sum(duration) / 3600, 4) AS hours, round(sum(length) / 1000, 6) AS km, round(any_value(indoor), 6) AS indoor, round(quantile_cont(median_speed, 0.5), 6) AS median_speed, (SELECT string_agg(environment || '=' || c, ',' ORDER BY environment) FROM e WHERE e.split = l.split) AS environments FROM l JOIN fr USING (split) GROUP BY split""")
def split_report(spark, sf_dir):
    """Episodes, frames, hours, kilometres, share of indoor frames and environments of each split."""
    cut = segments.cut_episodes(poses(spark, sf_dir), "rec", STEP, DAY)
    probabilities = cut.groupBy("rec", "episode").agg(F.collect_list(F.col("y") / 100).alias("frame_indoor_prob"))
    episodes = segments.episode_stats(cut, "rec", LEAST, 3.0).join(probabilities, ["rec", "episode"]).withColumns({"split": hash_split(F.col("rec").cast("string")), "environment": F.when(F.col("episode") % 2 == 0, "indoor").otherwise("mixed")})
    text = F.array_join(F.transform(F.map_entries("environments"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return reports.split_report(episodes).select("split", "episodes", "frames", F.round("hours", 4).alias("hours"), F.round("km", 6).alias("km"), F.round("indoor", 6).alias("indoor"), F.round("median_speed", 6).alias("median_speed"), text.alias("environments"))
