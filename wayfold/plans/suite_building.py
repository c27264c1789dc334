"""Queries on the candidates of a suite."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candidates as C
from ..operators import grid as G
from ..operators.selection import thin
from ..sources.tables import poses, table
from .choosing import _vectors
from .gridding import LOOKS, _lasting
from .registry import query

#: Events as candidates: places, flags and measures by their value and key.
CANDIDATES = """{POSE}, cand AS (SELECT event_id AS id, CASE WHEN x < 200 THEN 'indoor' WHEN x > 260 THEN 'outdoor' END AS environment, CASE WHEN event_id % 13 <> 0 THEN 'p' END AS thumb, event_id % 7 = 0 AS ref_collided, event_id % 11 = 1 AS ref_collided_lidar, event_id % 17 = 2 AS start_overlap, y / 150 AS ref_unknown,
 event_id % 19 = 3 AS stationary_collided, x / 50 AS goal_x, y / 50 AS goal_y, CASE WHEN event_id % 2 = 0 THEN event_id % 23 = 0 END AS ref_protocol_collided, CASE WHEN event_id % 5 <> 0 THEN event_id % 29 = 1 END AS ref_reverses, rec % 4 AS dataset, 'room' || rec % 3 AS indoor_scene, 'street' || rec % 2 AS outdoor_scene, event_id % 3 = 0 AS straight_ahead_success,
 CASE WHEN event_id % 4 > 0 THEN event_id % 4 = 1 END AS straight_to_goal_success, y * 2 AS luminance, CASE WHEN kind = 'view' THEN ['people:none'] WHEN kind = 'click' THEN ['people:few', 'people:crossing'] END AS people_tags, ['path:turn', 'goal:ahead'] AS path_tags, event_id % 6 = 0 AS env_by_clip FROM pose)"""
_FAILS = "list_filter([CASE WHEN NOT coalesce(straight_ahead_success, false) THEN 'baseline_fails:straight_ahead' END, CASE WHEN NOT coalesce(straight_to_goal_success, false) THEN 'baseline_fails:straight_to_goal' END], lambda v: v IS NOT NULL)"
_TAGS = f"list_concat(['env:' || environment, 'source:' || dataset, 'scene:' || CASE WHEN environment = 'indoor' THEN indoor_scene ELSE outdoor_scene END], {_FAILS}, list_filter([CASE WHEN luminance < 60 THEN 'lighting:dim' END{{more}}], lambda v: v IS NOT NULL), coalesce(people_tags, []), path_tags)"
_CLEAN = "environment IS NOT NULL AND thumb IS NOT NULL AND NOT ref_collided AND NOT ref_collided_lidar AND NOT start_overlap AND NOT coalesce(ref_reverses, false)"


def _candidates(spark, sf_dir):
    i, x, y, rec = (F.col(c) for c in ("event_id", "x", "y", "rec"))
    text = lambda *v: F.array(*map(F.lit, v))
    return poses(spark, sf_dir).select(
        i.alias("id"), F.when(x < 200, "indoor").when(x > 260, "outdoor").alias("environment"), F.when(i % 13 != 0, "p").alias("thumb"), (i % 7 == 0).alias("ref_collided"), (i % 11 == 1).alias("ref_collided_lidar"), (i % 17 == 2).alias("start_overlap"), (y / 150).alias("ref_unknown"),
        (i % 19 == 3).alias("stationary_collided"), (x / 50).alias("goal_x"), (y / 50).alias("goal_y"), F.when(i % 2 == 0, i % 23 == 0).alias("ref_protocol_collided"), F.when(i % 5 != 0, i % 29 == 1).alias("ref_reverses"), (rec % 4).alias("dataset"),
        F.concat(F.lit("room"), rec % 3).alias("indoor_scene"), F.concat(F.lit("street"), rec % 2).alias("outdoor_scene"), (i % 3 == 0).alias("straight_ahead_success"), F.when(i % 4 > 0, i % 4 == 1).alias("straight_to_goal_success"), (y * 2).alias("luminance"),
        F.when(F.col("kind") == "view", text("people:none")).when(F.col("kind") == "click", text("people:few", "people:crossing")).alias("people_tags"), text("path:turn", "goal:ahead").alias("path_tags"), (i % 6 == 0).alias("env_by_clip"),
    )


@query(f"""WITH {CANDIDATES} SELECT id, array_to_string(list_sort(list_distinct({_TAGS.format(more="")})), ',') AS tags, len({_FAILS})::INT AS n_baseline_fails FROM cand
 WHERE {_CLEAN} AND ref_unknown <= 0.3 AND NOT stationary_collided AND sqrt(goal_x * goal_x + goal_y * goal_y) >= 2 AND NOT coalesce(ref_protocol_collided, false)""")
def suite_candidates(spark, sf_dir):
    """Candidates that meet every rule of a suite, with all their tags."""
    return C.suite_candidates(_candidates(spark, sf_dir)).select("id", F.array_join("tags", ",").alias("tags"), "n_baseline_fails")


@query(f"""WITH {CANDIDATES} SELECT id, array_to_string(list_sort(list_distinct({_TAGS.format(more=", CASE WHEN ref_unknown > 0.3 THEN 'map:partly_unknown' END, CASE WHEN env_by_clip THEN 'env:by_clip' END")})), ',') AS tags, len({_FAILS})::INT AS n_baseline_fails FROM cand WHERE {_CLEAN}""")
def timed_candidates(spark, sf_dir):
    """Candidates for scoring in time: fewer rules, and tags of what is only partly known."""
    return C.suite_candidates(_candidates(spark, sf_dir), timed=True).select("id", F.array_join("tags", ",").alias("tags"), "n_baseline_fails")


_FLAGS = {"collided": "event_id % 3 = 0", "collided_dynamic": "event_id % 6 = 0", "collided_static": "event_id % 6 = 3", "collided_map": "event_id % 7 = 0", "collided_lidar": "event_id % 8 = 0", "start_overlap": "event_id % 9 = 0"}


@query(f"WITH {{POSE}} SELECT kind, {', '.join(f'round(avg(({v})::INT), 6) AS {k}' for k, v in _FLAGS.items())}, round(avg(y / 100), 6) AS unknown_fraction, round(avg(x), 4) AS ade, round(avg(x * 2), 4) AS fde, count(*) AS num_scenarios FROM pose GROUP BY 1")
def mean_verdicts(spark, sf_dir):
    """The nine means of a suite, by kind."""
    rows = poses(spark, sf_dir).select("kind", *(F.expr(v).alias(k) for k, v in _FLAGS.items()), (F.col("y") / 100).alias("unknown_fraction"), F.col("x").alias("ade"), (F.col("x") * 2).alias("fde"))
    out = C.mean_verdicts(rows, ["kind"])
    return out.select("kind", *(F.round(m, 4 if m in ("ade", "fde") else 6).alias(m) for m in C.METRICS), "num_scenarios")


@query("""WITH RECURSIVE p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id AND list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.3),
 s(k, kept) AS (SELECT -1::BIGINT, []::BIGINT[] UNION ALL SELECT k + 1, CASE WHEN (SELECT count(*) FROM p WHERE p.b = k + 1 AND list_contains(kept, p.a)) = 0 THEN list_append(kept, k + 1) ELSE kept END FROM s WHERE k < (SELECT max(vec_id) FROM embeddings)),
 k AS (SELECT unnest(kept) AS id FROM s WHERE k = (SELECT max(vec_id) FROM embeddings)), h AS (SELECT id, label, CASE WHEN id % 5 > 0 THEN id % 5 END AS house FROM k JOIN embeddings ON vec_id = id),
 r AS (SELECT *, row_number() OVER (PARTITION BY label, house ORDER BY id) AS n FROM h), c AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS m FROM r WHERE house IS NULL OR n <= 3) SELECT id, label::BIGINT AS label FROM c WHERE m <= CASE label WHEN 0 THEN 6 WHEN 1 THEN 9 ELSE 12 END""")
def thinned_and_capped(spark, sf_dir):
    """Vectors that thinning keeps, at most three of a house, then at most so many of their class."""
    kept = thin(_vectors(spark, sf_dir), ["klass"], 0.3)
    named = kept.select("id", F.lit("all").alias("source"), F.col("klass").cast("string").alias("klass"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("house"))
    return C.capped(named, "source", "klass", "house", ["id"], {"0": 6, "1": 9}, 12, 3).select("id", F.col("klass").cast("long").alias("label"))


@query(f"""WITH {LOOKS}, d AS (SELECT DISTINCT scenario, ix + a AS ix, iy + b AS iy FROM m, generate_series(-1, 1) AS g(a), generate_series(-1, 1) AS h(b) WHERE n_free > n_occ), e AS (SELECT scenario, ix + a AS ix, iy + b AS iy FROM d, generate_series(-1, 1) AS g(a), generate_series(-1, 1) AS h(b) GROUP BY 1, 2, 3 HAVING count(*) = 9)
 SELECT e.* FROM e WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.scenario = e.scenario AND o.ix = e.ix AND o.iy = e.iy)""")
def free_cells(spark, sf_dir):
    """Cells seen free, closed over small gaps, without the lasting obstacles."""
    cells = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey % 20 AS sweep", "l_quantity AS x", "l_discount * 100 AS y", "l_extendedprice / 40000 AS z").withColumns({"ix": G.cell("x", 1.0), "iy": G.cell("y", 1.0), "scenario": F.col("sweep") % 4})
    looks = G.cell_states(cells, ["scenario", "sweep"], F.col("z") > 1.0, F.lit(True), 2)
    seen = G.merge_cells(looks, ["scenario"], "sweep").filter("n_free > n_occ")
    return G.free_space(seen, _lasting(spark, sf_dir), ["scenario"], 3)
