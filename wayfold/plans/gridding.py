"""Queries on points and cells; the line items stand for scan points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid as G
from ..operators.components import components
from ..sources.tables import poses, table
from .registry import query

POINTS = "pts AS (SELECT l_suppkey % 20 AS sweep, l_orderkey * 10 + l_linenumber AS id, l_quantity AS x, l_discount * 100 AS y, l_extendedprice / 40000 AS z, l_partkey FROM lineitem)"


def points(spark, sf_dir):
    """Scan points (sweep, id, x, y, z) from line items."""
    return table(spark, sf_dir, "lineitem").selectExpr("l_suppkey % 20 AS sweep", "l_orderkey * 10 + l_linenumber AS id", "l_quantity AS x", "l_discount * 100 AS y", "l_extendedprice / 40000 AS z", "l_partkey")


@query(f"""WITH {POINTS}, c AS (SELECT sweep, CAST(floor(x / 5) AS BIGINT) AS ix, CAST(floor(y / 2) AS BIGINT) AS iy, count(*) FILTER (WHERE z > 0.2 AND z < 0.6) AS n_occ, count(*) FILTER (WHERE z < 0.4) AS n_free FROM pts WHERE sqrt(x * x + y * y) <= 40 GROUP BY 1, 2, 3)
 SELECT sweep, ix, iy, n_occ, n_free, CASE WHEN n_occ >= 20 THEN 'occupied' ELSE 'free' END AS state FROM c WHERE n_occ >= 20 OR n_free > 0""")
def cell_state(spark, sf_dir):
    """Occupied, free or unknown cells of each sweep."""
    cells = G.in_range(points(spark, sf_dir), 40.0).withColumns({"ix": G.cell("x", 5.0), "iy": G.cell("y", 2.0)})
    return G.cell_states(cells, ["sweep"], (F.col("z") > 0.2) & (F.col("z") < 0.6), F.col("z") < 0.4, 20)


@query(f"""WITH {POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY sweep, floor(x / 2.0), floor(y / 2.0), floor(z / 0.5) ORDER BY id, l_partkey, z) AS n FROM pts)
 SELECT sweep, id, CAST(round_even(x * 100, 0) AS INT) AS cx, CAST(round_even(z * 100, 0) AS INT) AS cz FROM r WHERE n = 1""")
def voxel_thin(spark, sf_dir):
    """The first point of each voxel, in whole centimetres."""
    first = G.thin(points(spark, sf_dir), ["sweep"], {"x": 2.0, "y": 2.0, "z": 0.5}, ["id", "l_partkey", "z"])
    return first.select("sweep", "id", G.centimetres("x").alias("cx"), G.centimetres("z").alias("cz"))


LOOKS = f"""{POINTS}, look AS (SELECT sweep % 4 AS scenario, sweep, CAST(floor(x) AS BIGINT) AS ix, CAST(floor(y) AS BIGINT) AS iy, CASE WHEN count(*) FILTER (WHERE z > 1.0) >= 2 THEN 'occupied' ELSE 'free' END AS state FROM pts GROUP BY 1, 2, 3, 4),
 m AS (SELECT scenario, ix, iy, count(*) FILTER (WHERE state = 'occupied') AS n_occ, count(*) FILTER (WHERE state <> 'occupied') AS n_free, min(sweep) FILTER (WHERE state = 'occupied') AS first_hit, max(sweep) FILTER (WHERE state = 'occupied') AS last_hit FROM look GROUP BY 1, 2, 3),
 o AS (SELECT * FROM m WHERE n_occ >= 2 AND n_occ >= 0.15 * (n_occ + n_free) AND last_hit - first_hit >= least(6, floor(5 / 2)))"""


def _lasting(spark, sf_dir):
    cells = points(spark, sf_dir).withColumns({"ix": G.cell("x", 1.0), "iy": G.cell("y", 1.0), "scenario": F.col("sweep") % 4})
    looks = G.cell_states(cells, ["scenario", "sweep"], F.col("z") > 1.0, F.lit(True), 2)
    return G.lasting(G.merge_cells(looks, ["scenario"], "sweep"), F.lit(5), 6)


@query(f"WITH {LOOKS} SELECT * FROM o")
def cell_merge(spark, sf_dir):
    """Obstacle cells over several sweeps: enough hits, a large enough share, over long enough."""
    return _lasting(spark, sf_dir)


@query(f"""WITH {LOOKS}, d AS (SELECT DISTINCT scenario, ix + a AS ix, iy + b AS iy FROM o, generate_series(-1, 1) AS g(a), generate_series(-1, 1) AS h(b))
 SELECT scenario, ix + a AS ix, iy + b AS iy FROM d, generate_series(-1, 1) AS g(a), generate_series(-1, 1) AS h(b) GROUP BY 1, 2, 3 HAVING count(*) = 9""")
def cell_closing(spark, sf_dir):
    """Obstacle cells closed with a 3 x 3 window."""
    return G.closing(_lasting(spark, sf_dir), ["scenario"], 3)


@query("""WITH {POSE}, c AS (SELECT DISTINCT floor(x / 50)::BIGINT AS ix, floor(y / 20)::BIGINT AS iy, floor(t / 3600)::BIGINT AS hour FROM pose) SELECT ix, iy, hour, count(*) OVER (PARTITION BY ix, iy ORDER BY hour RANGE BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS n_seen FROM c""")
def presence_count(spark, sf_dir):
    """Per cell and hour, in how many of the hours around it was occupied."""
    cells = poses(spark, sf_dir).select(F.floor(F.col("x") / 50).alias("ix"), F.floor(F.col("y") / 20).alias("iy"), F.floor(F.col("t") / 3600).alias("hour"))
    return G.presence(cells, ["ix", "iy"], "hour", 12)


@query(f"""WITH {POINTS} SELECT sweep, count(*)::DOUBLE AS n, round(regr_slope_x, 6) AS a, round(regr_slope_y, 6) AS b FROM (SELECT sweep, (sxz * syy - syz * sxy) / (sxx * syy - sxy * sxy) AS regr_slope_x, (syz * sxx - sxz * sxy) / (sxx * syy - sxy * sxy) AS regr_slope_y, n FROM
 (SELECT sweep, count(*) AS n, covar_pop(x, x) AS sxx, covar_pop(x, y) AS sxy, covar_pop(y, y) AS syy, covar_pop(x, z) AS sxz, covar_pop(y, z) AS syz FROM pts GROUP BY 1)) s JOIN pts USING (sweep) GROUP BY 1, 3, 4""")
def plane_fit(spark, sf_dir):
    """Least-squares plane of each sweep from grouped moments."""
    return G.plane_fit(points(spark, sf_dir), ["sweep"], 10).select("sweep", "n", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query(f"""WITH {POINTS}, g AS (SELECT sweep, CAST(floor(x / 8) AS BIGINT) AS ci, CAST(floor(y / 8) AS BIGINT) AS cj, list_sort(list(z)) AS zs FROM pts GROUP BY 1, 2, 3) SELECT sweep, ci, cj, round(zs[CAST(floor(len(zs) * 0.1) AS INT) + 1], 4) AS ground, len(zs)::INT AS n FROM g WHERE len(zs) >= 3""")
def ground_cells(spark, sf_dir):
    """Ground height of each coarse cell: a low point of the sorted heights."""
    cells = points(spark, sf_dir).withColumns({"ci": G.cell("x", 8.0), "cj": G.cell("y", 8.0)})
    return G.low_quantile(cells, ["sweep", "ci", "cj"]).select("sweep", "ci", "cj", F.round("ground", 4).alias("ground"), "n")


#: Heights are multiples of small fractions; exact halves would be rounded as the last bit falls.
OFF_HALVES = 3.3e-8
_inherit = lambda k: f"k{k + 1} AS (SELECT a.sweep, a.ci, a.cj, coalesce(any_value(a.ground), avg(b.ground)) AS ground FROM k{k} a LEFT JOIN k{k} b ON b.sweep = a.sweep AND b.ci BETWEEN a.ci - 1 AND a.ci + 1 AND b.cj BETWEEN a.cj - 1 AND a.cj + 1 GROUP BY 1, 2, 3)"


@query(f"""WITH {POINTS}, p AS (SELECT *, row_number() OVER () AS pid, CAST(floor(x / 8) AS BIGINT) AS ci, CAST(floor(y / 8) AS BIGINT) AS cj, x / 8 - 0.5 AS u, y / 8 - 0.5 AS v FROM pts), zs AS (SELECT sweep, ci, cj, list_sort(list(z)) AS zs FROM p GROUP BY 1, 2, 3),
 k0 AS (SELECT sweep, ci, cj, CASE WHEN len(zs) >= 30 THEN zs[CAST(floor(len(zs) * 0.1) AS INT) + 1] END AS ground FROM zs), {_inherit(0)}, {_inherit(1)}, {_inherit(2)},
 w AS (SELECT pid, p.sweep, id, z, sum((CASE WHEN g.ci = floor(u) THEN 1 - (u - floor(u)) ELSE u - floor(u) END) * (CASE WHEN g.cj = floor(v) THEN 1 - (v - floor(v)) ELSE v - floor(v) END)) AS w, sum(ground * (CASE WHEN g.ci = floor(u) THEN 1 - (u - floor(u)) ELSE u - floor(u) END) * (CASE WHEN g.cj = floor(v) THEN 1 - (v - floor(v)) ELSE v - floor(v) END)) AS wg
  FROM p JOIN k3 g ON g.sweep = p.sweep AND g.ci IN (floor(u), floor(u) + 1) AND g.cj IN (floor(v), floor(v) + 1) WHERE ground IS NOT NULL GROUP BY 1, 2, 3, 4) SELECT sweep, id, round(z - wg / nullif(w, 0) + {OFF_HALVES}, 5) AS above FROM w""")
def height_above_ground(spark, sf_dir):
    """Height of every point over the bilinear ground, with cells of few points inheriting from those around."""
    all_points = points(spark, sf_dir)
    cells = all_points.withColumns({"ci": G.cell("x", 8.0), "cj": G.cell("y", 8.0)})
    ground = G.low_quantile(cells, ["sweep", "ci", "cj"], least=30)
    wanted = cells.select("sweep", "ci", "cj").distinct()
    filled = G.inherit_ground(ground, wanted, ["sweep"])
    return G.bilinear(all_points, filled.filter("ground is not null"), ["sweep"], 8.0).select("sweep", "id", F.round(F.col("above") + OFF_HALVES, 5).alias("above"))


@query(f"""WITH {POINTS}, c AS (SELECT DISTINCT sweep, CAST(floor(x * 2) AS BIGINT) AS ix, CAST(floor(y * 8) - 40 AS BIGINT) AS iy FROM pts WHERE z > 1.5), b AS (SELECT sweep, ix // 10 AS bi, (iy + 40) // 10 AS bj, count(*) AS c FROM c WHERE ix < 80 AND iy < 40 GROUP BY 1, 2, 3)
 SELECT s.sweep, bi, bj, coalesce(c, 0) / 100.0 AS share FROM (SELECT DISTINCT sweep FROM c) s CROSS JOIN generate_series(0, 7) AS g(bi) CROSS JOIN generate_series(0, 7) AS h(bj) LEFT JOIN b USING (sweep, bi, bj)""")
def blocks_ahead(spark, sf_dir):
    """Share of occupied cells in 8 x 8 blocks."""
    cells = points(spark, sf_dir).filter("z > 1.5").select("sweep", F.floor(F.col("x") * 2).alias("ix"), (F.floor(F.col("y") * 8) - 40).alias("iy")).distinct()
    return G.blocks_ahead(cells, cells, "sweep")


CLUSTERS = """{POSE}, c AS (SELECT DISTINCT floor(t / 86400)::BIGINT AS day, floor(x / 10)::BIGINT AS ix, floor(y / 3)::BIGINT AS iy FROM pose), n AS (SELECT *, (day * 1000 + ix) * 1000 + iy AS node FROM c),
 e AS (SELECT a.node AS a, b.node AS b FROM n a JOIN n b ON a.day = b.day AND greatest(0, abs(a.ix - b.ix) - 1) + greatest(0, abs(a.iy - b.iy) - 1) <= 2)"""


@query(f"""WITH RECURSIVE {CLUSTERS}, reach(node, root) USING KEY (node) AS (SELECT node, node FROM n UNION (SELECT e.b, min(r.root) FROM reach r JOIN e ON e.a = r.node JOIN recurring.reach k ON k.node = e.b WHERE r.root < k.root GROUP BY e.b))
 SELECT root, count(*) AS cells FROM reach GROUP BY 1 HAVING count(*) >= 2""")
def cell_clusters(spark, sf_dir):
    """Connected groups of cells, by label propagation over near cells."""
    cells = poses(spark, sf_dir).select(F.floor(F.col("t") / 86400).alias("day"), F.floor(F.col("x") / 10).alias("ix"), F.floor(F.col("y") / 3).alias("iy")).distinct()
    cells = cells.withColumn("node", (F.col("day") * 1000 + F.col("ix")) * 1000 + F.col("iy"))
    return components(G.cell_edges(cells, ["day"])).groupBy("root").agg(F.count("*").alias("cells")).filter("cells >= 2")


@query(f"""WITH RECURSIVE {CLUSTERS}, reach(node, root) USING KEY (node) AS (SELECT node, node FROM n UNION (SELECT e.b, min(r.root) FROM reach r JOIN e ON e.a = r.node JOIN recurring.reach k ON k.node = e.b WHERE r.root < k.root GROUP BY e.b)),
 p AS (SELECT floor(x / 10)::BIGINT AS ix, floor(y / 3)::BIGINT AS iy, x, y, t % 86400 / 86400 AS z, (floor(t / 86400)::BIGINT * 1000 + floor(x / 10)::BIGINT) * 1000 + floor(y / 3)::BIGINT AS node FROM pose)
 SELECT root, count(*) AS n, round(avg(x), 5) AS x, round(avg(y), 5) AS y FROM p JOIN reach USING (node) GROUP BY 1 HAVING count(*) >= 3 AND greatest(max(ix) - min(ix), max(iy) - min(iy)) + 1 <= 12 AND max(z) - min(z) >= 0.3""")
def person_clusters(spark, sf_dir):
    """Clusters of points that are small enough, tall enough and have points enough, with their centres."""
    p = poses(spark, sf_dir).select(F.floor(F.col("t") / 86400).alias("day"), F.floor(F.col("x") / 10).alias("ix"), F.floor(F.col("y") / 3).alias("iy"), "x", "y", (F.col("t") % 86400 / 86400).alias("z"))
    p = p.withColumn("node", (F.col("day") * 1000 + F.col("ix")) * 1000 + F.col("iy"))
    cells = p.select("day", "ix", "iy", "node").distinct()
    joined = components(G.cell_edges(cells, ["day"]))
    alone = cells.select("node").join(joined, "node", "left_anti").select("node", F.col("node").alias("root"))
    out = G.person_clusters(p, joined.select("node", "root").unionByName(alone), 0.1, 3)
    return out.select("root", "n", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query(f"""WITH {LOOKS}, fr AS (SELECT scenario, avg(ix) AS x0, avg(iy) AS y0, scenario * 0.4 AS yaw FROM o GROUP BY 1), e AS (SELECT scenario, x0, y0, yaw, floor(cos(yaw) * (ix + 0.5 - x0) + sin(yaw) * (iy + 0.5 - y0)) AS e0, floor(cos(yaw) * (iy + 0.5 - y0) - sin(yaw) * (ix + 0.5 - x0)) AS f0 FROM o JOIN fr USING (scenario)),
 t AS (SELECT DISTINCT scenario, x0, y0, yaw, e0 + a AS ei, f0 + b AS ej FROM e, generate_series(-1, 1) AS g(a), generate_series(-1, 1) AS h(b)), mm AS (SELECT *, x0 + cos(yaw) * (ei + 0.5) - sin(yaw) * (ej + 0.5) - 0.5 AS u, y0 + sin(yaw) * (ei + 0.5) + cos(yaw) * (ej + 0.5) - 0.5 AS v FROM t)
 SELECT mm.scenario, ei::BIGINT AS ei, ej::BIGINT AS ej, round(sum((1 - abs(u - ix)) * (1 - abs(v - iy))), 6) AS weight FROM mm JOIN o ON o.scenario = mm.scenario AND o.ix IN (floor(u), floor(u) + 1) AND o.iy IN (floor(v), floor(v) + 1) GROUP BY 1, 2, 3 HAVING sum((1 - abs(u - ix)) * (1 - abs(v - iy))) >= 0.3""")
def rotated_cells(spark, sf_dir):
    """Obstacle cells in frames turned by each scenario's heading."""
    cells = _lasting(spark, sf_dir).select("scenario", "ix", "iy")
    frames = cells.groupBy("scenario").agg(F.avg("ix").alias("x0"), F.avg("iy").alias("y0")).withColumn("yaw", F.col("scenario") * 0.4)
    return G.rotate_cells(cells, frames, "scenario", 1.0, 0.3).select("scenario", "ei", "ej", F.round("weight", 6).alias("weight"))


@query(f"WITH {POINTS} SELECT least(l_partkey % 30, 24) AS klass, count(*) FILTER (WHERE z < 0.5) AS ground, count(*) FILTER (WHERE z >= 0.5 AND z < 2.0) AS obstacle, count(*) AS n FROM pts GROUP BY 1")
def class_confusion(spark, sf_dir):
    """Points of each class called ground or obstacle."""
    return points(spark, sf_dir).groupBy(F.least(F.col("l_partkey") % 30, F.lit(24)).alias("klass")).agg(F.count_if(F.col("z") < 0.5).alias("ground"), F.count_if((F.col("z") >= 0.5) & (F.col("z") < 2.0)).alias("obstacle"), F.count("*").alias("n"))
