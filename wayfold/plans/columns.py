"""Queries on column functions and small tables around paths, frames and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geom as G
from ..operators import metrics as M
from ..operators import samples as P
from ..operators import scenario as S
from ..sources.tables import poses, table
from ..streaming import streams
from .registry import query
from .sampling import ELIGIBLE
from .scoring import ARC


@query("""WITH {POSE}, p AS (SELECT event_id, x, y, y / 30 AS a FROM pose) SELECT event_id, round(10 + cos(a) * x - sin(a) * y, 6) AS world_x, round(20 + sin(a) * x + cos(a) * y, 6) AS world_y, round(199.5 - x / 0.1, 6) AS map_row, round(199.5 - y / 0.1, 6) AS map_col,
 round(CASE WHEN x - 50 > 0.3 THEN 320 - 300 * y / (x - 50) END, 5) AS pixel_u, round(CASE WHEN x - 50 > 0.3 THEN 240 - 300 * 1.5 / (x - 50) END, 5) AS pixel_v, round(atan2(2 * cos(a / 2) * sin(a / 2), 1 - 2 * sin(a / 2) * sin(a / 2)), 6) AS yaw,
 round(cos(a) * x - sin(a) * y + 1, 6) AS moved_x, round(sin(a) * x + cos(a) * y + 2, 6) AS moved_y, round(-sin(a), 6) AS level_01, round(-1.5 * x, 6) AS up_y FROM p""")
def frame_geometry(spark, sf_dir):
    """Points between frames, map cells, pixels, quaternions, rigid transforms, levelled rotations and changed axes."""
    x, y, a, zero = F.col("x"), F.col("y"), F.col("y") / 30, F.lit(0.0)
    world, cell = G.from_frame(F.lit(10.0), F.lit(20.0), a, x, y), G.map_row_col(x, y)
    pixel = G.project(x - 50, y, F.lit(1.5), F.lit(300.0), F.lit(300.0), F.lit(320.0), F.lit(240.0))
    quaternion = (zero, zero, F.sin(a / 2), F.cos(a / 2))
    rigid = F.array(F.cos(a), -F.sin(a), zero, F.lit(1.0), F.sin(a), F.cos(a), zero, F.lit(2.0), zero, zero, F.lit(1.0), F.lit(3.0), zero, zero, zero, F.lit(1.0))
    moved, flat = G.transform_point(rigid, x, y, zero), G.level(G.rotation_from_quaternion(*quaternion))
    named = {"world_x": world[0], "world_y": world[1], "map_row": cell[0], "map_col": cell[1], "yaw": G.yaw_from_quaternion(*quaternion), "moved_x": moved[0], "moved_y": moved[1], "level_01": flat[1], "up_y": G.axis_change(x, y, 1.5 * x)[1]}
    return poses(spark, sf_dir).select("event_id", *(F.round(c, 6).alias(k) for k, c in named.items()), F.round(pixel[0], 5).alias("pixel_u"), F.round(pixel[1], 5).alias("pixel_v"))


@query("""SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 3 WHEN '2' THEN 2 WHEN '3' THEN 0 ELSE 5 END AS occlusion, o_totalprice / 1000 - 150 < -0.5 AND abs(o_orderkey % 5 - 2) < 1 AS reverses, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_totalprice / 100000 END AS height, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'dataset' ELSE 'unknown' END AS height_source
 FROM orders WHERE o_totalprice > 50000 AND CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 3 <> 0 END""")
def label_columns(spark, sf_dir):
    """Occlusion codes, reverse motion and camera heights of the rows for which every rule holds; a missing value fails."""
    c = F.col
    rules = {"dear": c("o_totalprice") > 50_000, "third": F.when(c("o_orderstatus") != "P", c("o_orderkey") % 3 != 0)}
    first = F.substring("o_orderpriority", 1, 1)
    text = F.when(first == "1", "Heavy").when(first == "2", "Medium").when(first == "3", "None").otherwise("?")
    height, source = S.camera_height(c("o_orderstatus"), c("o_totalprice") / 100_000, ["F", "O"])
    return S.valid_candidates(table(spark, sf_dir, "orders"), rules).select("o_orderkey", S.occlusion_code(text).alias("occlusion"), S.reverses(c("o_totalprice") / 1000 - 150, (c("o_orderkey") % 5 - 2).cast("double")).alias("reverses"), height.alias("height"), source.alias("height_source"))


def _paths(spark, sf_dir):
    return poses(spark, sf_dir).select((F.col("rec") * 1000 + F.floor(F.col("f") / 11)).alias("rec"), (F.col("f") % 11).alias("f"), (F.col("x") / 50).alias("x"), (F.col("y") / 10).alias("y"))


@query("""WITH {POSE}, q AS (SELECT rec * 1000 + f // 11 AS rec, f % 11 AS f, x / 50 AS x, y / 10 AS y FROM pose), m AS (SELECT rec, max(f) AS m FROM q GROUP BY 1), u AS (SELECT q.rec, f / m::DOUBLE AS u, x, y FROM q JOIN m USING (rec) WHERE m > 0), n AS (SELECT *, lead(u) OVER w AS u2, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM u WINDOW w AS (PARTITION BY rec ORDER BY u)), a AS (SELECT rec, k, least(k / 6.0, 1.0) AS want FROM m, generate_series(1, 8) AS g(k) WHERE m > 0)
 SELECT a.rec, k::INT AS k, round(CASE WHEN u2 IS NULL THEN x ELSE x + (x2 - x) * (want - u) / (u2 - u) END, 4) AS x, round(CASE WHEN u2 IS NULL THEN y ELSE y + (y2 - y) * (want - u) / (u2 - u) END, 4) AS y FROM a ASOF JOIN n ON a.rec = n.rec AND a.want >= n.u""")
def even_steps(spark, sf_dir):
    """Positions at steps of paths that are spaced evenly in time up to step 6, and rest there."""
    paths = _paths(spark, sf_dir)
    longer = paths.join(paths.filter("f > 0").select("rec").distinct(), "rec", "left_semi")
    return M.timed_steps(longer, "rec", 6, 8).select("rec", "k", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"""WITH {ARC}, g AS (SELECT rec, unnest(generate_series(1, CAST(floor((total + 1e-9) / 0.5) AS BIGINT))) AS k FROM e WHERE total >= 0.5 - 1e-9), even AS (SELECT g.rec, k, CASE WHEN s2 IS NULL THEN x ELSE x + (x2 - x) * (g.s - n.s) / (s2 - n.s) END AS x, CASE WHEN s2 IS NULL THEN y ELSE y + (y2 - y) * (g.s - n.s) / (s2 - n.s) END AS y FROM (SELECT rec, k, k * 0.5 AS s FROM g) g ASOF JOIN n ON g.rec = n.rec AND g.s >= n.s)
 SELECT a.rec, round(avg(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))), 4) AS deviation FROM even a JOIN even b ON b.rec = a.rec + 1 AND b.k = a.k WHERE a.k <= 20 GROUP BY 1""")
def path_deviation(spark, sf_dir):
    """Mean distance of each path from the next one at equal distances along them."""
    even = M.resample(_paths(spark, sf_dir), "rec", 0.5)
    return M.deviation(even, even.withColumn("rec", F.col("rec") - 1), "rec", 20).select("rec", F.round("deviation", 4).alias("deviation"))


@query(f"""WITH {ELIGIBLE}, q AS (SELECT rec, t - j * 7200.0 + 1e-6 AS want FROM s, generate_series(1, 3) AS g(j)) SELECT DISTINCT q.rec, coalesce(p.f, 0) AS f FROM q ASOF LEFT JOIN pose p ON p.rec = q.rec AND q.want >= p.t""")
def needed_frames(spark, sf_dir):
    """Frames that the samples' histories need, each once."""
    frames = poses(spark, sf_dir).withColumn("yaw", F.col("y") / 40)
    return P.needed_frames(P.history(frames, P.eligible(frames, "rec", 5, 86_400.0), "rec", 3, 7_200.0), "rec")


@query("SELECT o_orderkey AS request_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def open_requests(spark, sf_dir):
    """Orders without a large item: requests without an answer."""
    answers = table(spark, sf_dir, "lineitem").filter("l_quantity > 30").select(F.col("l_orderkey").alias("request_id"))
    return streams.open_requests(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id")), answers)
