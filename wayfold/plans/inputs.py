"""Queries on what a model is given: prompts, labels of views, answers read back, features and targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import scenario as S
from ..sources.tables import poses
from .registry import query


@query("""WITH {POSE}, b AS (SELECT *, CASE kind WHEN 'click' THEN 'the Red door' WHEN 'view' THEN 'NASA desk' ELSE 'exit sign' END AS said, x / 7 + 0.0123 AS gx, y / 3 + 0.0123 AS gy FROM pose)
 SELECT event_id, printf(['Walk to %s.', 'Go to %s.', 'Head towards %s.'][CAST(event_id % 3 AS INT) + 1], said) || CASE WHEN event_id % 2 = 0 THEN printf(' It is at (%.1f, %.1f).', gx, gy) ELSE '' END AS spoken,
 printf('The camera is carried by %s. The past views are sampled at 1 Hz. Please predict the next 10 positions at 2 Hz.', CASE kind WHEN 'click' THEN 'a human walking' ELSE 'a robot' END) AS body,
 printf('Frame interval 0.5 s. Current speed %.2f m/s.', x / 100 + 0.00123) || CASE WHEN event_id % 4 = 0 THEN '' ELSE printf(' Robot positions over the last 1 frames, oldest first: (%.1f, %.1f), (0.0, 0.0).', x / 9 + 0.0123, y / 9 + 0.0123) END || CASE WHEN event_id % 5 = 0 THEN printf(' Goal: (%.1f, %.1f).', gx, gy) ELSE ' Instruction: go on' END || ' Predict the robot''s position at each of the next 10 frames.' AS history,
 CASE WHEN event_id % 3 = 0 THEN 'The camera''s field of view is unknown' ELSE printf('The camera''s horizontal field of view is %.0f degrees', y + 0.123) || CASE WHEN event_id % 2 = 0 THEN '' ELSE printf(' and its vertical field of view %.0f degrees', y / 2 + 0.123) END END || CASE WHEN kind = 'click' THEN printf('; it is mounted %.2f m above the ground.', x / 300 + 0.00123) ELSE '; its height above the ground is unknown.' END AS camera,
 ['View 2 s ago:', 'View now:', 'View in 2 s:'][CAST(event_id % 3 AS INT) + 1] AS view, CASE WHEN event_id % 3 = 0 THEN 'no braces here' ELSE 'walk ' || rec END AS description, CASE WHEN event_id % 3 = 1 THEN 'hall' ELSE '' END AS place, CAST(rec AS VARCHAR) AS recording, 'r_' || rec AS "group" FROM b""")
def model_prompts(spark, sf_dir):
    """Every kind of prompt and label, and what is read from answers and names."""
    i, x, y, rec = (F.col(c) for c in ("event_id", "x", "y", "rec"))
    gx, gy = x / 7 + 0.0123, y / 3 + 0.0123
    said = F.when(F.col("kind") == "click", " The Red door.").when(F.col("kind") == "view", "NASA desk").otherwise("Exit sign..")
    points = F.when(i % 4 == 0, F.array().cast("array<struct<x:double,y:double>>")).otherwise(F.array(F.struct((x / 9 + 0.0123).alias("x"), (y / 9 + 0.0123).alias("y")), F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))))
    answer = F.when(i % 3 == 0, " no braces here ").otherwise(F.concat(F.lit('Sure: {"description": " walk '), rec.cast("string"), F.lit('"'), F.when(i % 3 == 1, ', "place": "hall"').otherwise(""), F.lit("} so.")))
    found = X.answer_fields(answer)
    return poses(spark, sf_dir).select(
        "event_id", X.language_prompt(said, i % 3, gx, gy, i % 2 == 0).alias("spoken"), X.embodiment_prompt(F.when(F.col("kind") == "click", "person_walking").otherwise("wheeled_robot")).alias("body"),
        X.history_prompt(F.lit(2.0), x / 100 + 0.00123, points, F.when(i % 5 != 0, " go on "), gx, gy, 10).alias("history"),
        X.camera_sentence(F.when(i % 3 != 0, y + 0.123), F.when(i % 2 != 0, y / 2 + 0.123), x / 300 + 0.00123, F.when(F.col("kind") == "click", "dataset").otherwise("guess")).alias("camera"),
        X.view_label(((i % 3 - 1) * 2).cast("int")).alias("view"), found["description"].alias("description"), found["place"].alias("place"), X.recording_of(F.concat(F.lit("a/b/"), rec)).alias("recording"), X.group_key(F.concat_ws("_", F.lit("r"), rec, i)).alias("group"),
    )


@query("""WITH {POSE}, b AS (SELECT event_id, x / 10 AS hx, y / 10 AS hy, x / 7 AS gx, y / 3 AS gy, y / 40 AS vx, x / 90 AS vy, event_id % 2 = 0 AS spoken FROM pose)
 SELECT event_id, round(hx + 2 * hy + 3 * 1 + 4 * 2 + 5 * CASE WHEN spoken THEN 0 ELSE gx END + 6 * CASE WHEN spoken THEN 0 ELSE gy END + 7 * vx + 8 * vy, 4) AS weighed, round((hx - vx * 0.5) / 2 + (3 - vx * 1.0) / 2, 5) AS ahead, round((hy - vy * 0.5) / 2 + (4 - vy * 1.0) / 2, 5) AS aside FROM b""")
def model_features(spark, sf_dir):
    """Kinematic features, weighed by their places, and targets less what constant velocity gives, added up."""
    x, y, v = F.col("x"), F.col("y"), (F.col("y") / 40, F.col("x") / 90)
    pair = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    features = S.kinematic_features(F.array(pair(x / 10, y / 10), pair(F.lit(1), F.lit(2))), x / 7, y / 3, *v, F.col("event_id") % 2 == 0)
    targets = S.residual_targets(F.array(pair(x / 10, y / 10), pair(F.lit(3), F.lit(4))), *v, 0.5, 2.0)
    weighed = F.aggregate(F.transform(features, lambda e, k: e * (k + 1)), F.lit(0.0), lambda s, e: s + e)
    total = lambda c: F.aggregate(targets, F.lit(0.0), lambda s, e: s + e[c])
    return poses(spark, sf_dir).select("event_id", F.round(weighed, 4).alias("weighed"), F.round(total("x"), 5).alias("ahead"), F.round(total("y"), 5).alias("aside"))
