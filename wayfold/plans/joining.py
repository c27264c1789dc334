"""Queries on joins by time, distance, interval and place."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geom import rounded
from ..operators import joins as J
from ..operators.metrics import resample
from ..sources.tables import poses, table
from .registry import query


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("ot"), "o_totalprice")


ORDER_T = "epoch_us(o_orderdate)"


@query("""WITH {POSE}, p AS (SELECT * FROM pose WHERE kind = 'purchase'), c AS (SELECT rec, t AS ct, x AS cx, event_id AS cid FROM pose WHERE kind = 'click')
 SELECT p.rec, p.event_id, c.cid AS click_id, round(c.cx, 6) AS click_x FROM p ASOF LEFT JOIN c ON p.rec = c.rec AND p.t >= c.ct""")
def asof_backward(spark, sf_dir):
    """Each purchase with the same user's last click at or before it."""
    rows = poses(spark, sf_dir)
    clicks = rows.filter("kind = 'click'").select("rec", F.col("t").alias("ct"), F.col("event_id").alias("click_id"), F.col("x").alias("click_x"))
    out = J.asof(rows.filter("kind = 'purchase'"), clicks, "rec", "t", "ct", ["click_id", "click_x"])
    return out.select("rec", "event_id", "click_id", F.round("click_x", 6).alias("click_x"))


@query("""WITH {POSE}, p AS (SELECT * FROM pose WHERE kind = 'purchase'), v AS (SELECT rec, t AS vt, event_id AS vid FROM pose WHERE kind = 'view'),
 r AS (SELECT p.rec, p.event_id, v.vid, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(v.vt - p.t), v.vt) AS n FROM p JOIN v ON p.rec = v.rec AND abs(v.vt - p.t) <= 43200)
 SELECT p.rec, p.event_id, r.vid AS view_id FROM p LEFT JOIN r ON p.event_id = r.event_id AND r.n = 1""")
def asof_nearest(spark, sf_dir):
    """Each purchase with the nearest view within half a day, the earlier one on ties."""
    rows = poses(spark, sf_dir)
    views = rows.filter("kind = 'view'").select("rec", F.col("t").alias("vt"), F.col("event_id").alias("view_id"))
    return J.asof_nearest(rows.filter("kind = 'purchase'"), views, "rec", "t", "vt", ["view_id"], 43_200.0).select("rec", "event_id", "view_id")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
 n AS (SELECT o_custkey, o_orderdate, min(o_orderkey) AS ok FROM orders GROUP BY 1, 2)
 SELECT l_orderkey, l_linenumber, l_partkey, n.ok AS last_order FROM l ASOF LEFT JOIN n ON l.o_custkey = n.o_custkey AND l.l_shipdate >= n.o_orderdate""")
def asof_orders(spark, sf_dir):
    """Each shipped line with its customer's last order at or before the ship date."""
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "o_custkey")
    firsts = orders.groupBy("o_custkey", "o_orderdate").agg(F.min("o_orderkey").alias("last_order"))
    return J.asof(lines, firsts, "o_custkey", "l_shipdate", "o_orderdate", ["last_order"]).select("l_orderkey", "l_linenumber", "l_partkey", "last_order")


@query("""WITH {POSE}, q AS (SELECT rec, t - 1800 AS qt, event_id FROM pose), s AS (SELECT rec, t, x, y, lead(t) OVER w AS t2, lead(x) OVER w AS x2, lead(y) OVER w AS y2, row_number() OVER w AS n FROM pose WINDOW w AS (PARTITION BY rec ORDER BY t)),
 b AS (SELECT q.rec, q.event_id, q.qt, s.* EXCLUDE (rec) FROM q ASOF LEFT JOIN s ON q.rec = s.rec AND q.qt >= s.t), f AS (SELECT rec, x AS fx, y AS fy FROM s WHERE n = 1)
 SELECT b.rec, b.event_id, round(CASE WHEN b.t IS NULL THEN fx WHEN t2 IS NULL THEN x ELSE x + (x2 - x) * (qt - t) / (t2 - t) END, 4) AS x, round(CASE WHEN b.t IS NULL THEN fy WHEN t2 IS NULL THEN y ELSE y + (y2 - y) * (qt - t) / (t2 - t) END, 4) AS y FROM b JOIN f USING (rec)""")
def interpolate_at(spark, sf_dir):
    """Position half an hour before each event, clamped at the first."""
    rows = poses(spark, sf_dir)
    asked = rows.select("rec", "event_id", (F.col("t") - 1800).alias("t"))
    return J.interpolate(asked, rows.select("rec", "t", "x", "y"), "rec", "t", ["x", "y"]).select("rec", "event_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("""WITH {POSE}, h AS (SELECT *, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)), 0) AS hop FROM pose WINDOW w AS (PARTITION BY rec ORDER BY f)),
 s AS (SELECT *, sum(hop) OVER (PARTITION BY rec ORDER BY f) AS s FROM h), e AS (SELECT rec, max(s) AS total FROM s GROUP BY 1), q AS (SELECT rec, k, k * 500.0 AS q FROM e, generate_series(1, CAST(floor((total + 1e-9) / 500) AS BIGINT)) AS g(k) WHERE total >= 500),
 n AS (SELECT rec, s, x, y, lead(s) OVER w AS s2, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM s WINDOW w AS (PARTITION BY rec ORDER BY f))
 SELECT q.rec, k::INT AS k, round(CASE WHEN s2 IS NULL THEN x ELSE x + (x2 - x) * (q - s) / (s2 - s) END, 4) AS x, round(CASE WHEN s2 IS NULL THEN y ELSE y + (y2 - y) * (q - s) / (s2 - s) END, 4) AS y FROM q ASOF JOIN n ON q.rec = n.rec AND q.q >= n.s""")
def pose_at_distance(spark, sf_dir):
    """Points every 500 along each path."""
    return resample(poses(spark, sf_dir).select("rec", "f", "x", "y"), "rec", 500.0).select("rec", "k", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("""WITH {POSE}, i AS (SELECT rec, event_id AS iid, t AS a, t + x * 300 AS b FROM pose WHERE kind = 'signup') SELECT p.event_id, i.iid FROM pose p JOIN i ON p.rec = i.rec AND i.a <= p.t AND p.t < i.b""")
def interval_cover(spark, sf_dir):
    """Events inside intervals that start at the same user's signups."""
    rows = poses(spark, sf_dir)
    spans = rows.filter("kind = 'signup'").select("rec", F.col("event_id").alias("iid"), F.col("t").alias("a"), (F.col("t") + F.col("x") * 300).alias("b"))
    return J.interval_join(rows.select("rec", "event_id", "t"), spans, "rec", "t", "a", "b", 86_400.0).select("event_id", "iid")


@query("""WITH {POSE}, i AS (SELECT rec, event_id AS iid, t AS a, t + x * 300 AS b FROM pose WHERE kind = 'signup'), o AS (SELECT rec, event_id AS oid, t AS s, t + y * 4000 AS e FROM pose WHERE kind = 'view') SELECT iid, oid FROM i JOIN o USING (rec) WHERE s <= a AND b < e""")
def interval_contained(spark, sf_dir):
    """Intervals that lie inside longer ones of the same user."""
    rows = poses(spark, sf_dir)
    inner = rows.filter("kind = 'signup'").select("rec", F.col("event_id").alias("iid"), F.col("t").alias("a"), (F.col("t") + F.col("x") * 300).alias("b"))
    outer = rows.filter("kind = 'view'").select("rec", F.col("event_id").alias("oid"), F.col("t").alias("s"), (F.col("t") + F.col("y") * 4000).alias("e"))
    return J.contained(inner, outer, "rec", "a", "b", "s", "e").select("iid", "oid")


@query("""WITH {POSE}, a AS (SELECT rec, f AS anchor FROM pose WHERE f % 4 = 0), w AS (SELECT a.rec, anchor, k, p.x, p.y, p.t FROM a, generate_series(-5, 5) AS g(k), pose p WHERE p.rec = a.rec AND p.f = anchor + k),
 h AS (SELECT *, sqrt(power(x - lag(x) OVER v, 2) + power(y - lag(y) OVER v, 2)) AS hop FROM w WINDOW v AS (PARTITION BY rec, anchor ORDER BY k))
 SELECT rec, anchor, round(sum(hop), 4) AS travel, round(max(t) - min(t), 3) AS span FROM h GROUP BY 1, 2 HAVING count(*) = 11 AND sum(hop) >= 1000""")
def anchor_windows(spark, sf_dir):
    """Complete windows of eleven rows around every fourth row, with enough travel."""
    from pyspark.sql import Window

    rows = poses(spark, sf_dir)
    window = J.windows_around(rows, rows.filter("f % 4 = 0"), ["rec"], "f", 5, 5)
    w = Window.partitionBy("rec", "anchor").orderBy("step")
    hop = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    out = window.withColumn("hop", hop).groupBy("rec", "anchor").agg(F.count("*").alias("n"), F.sum("hop").alias("travel"), (F.max("t") - F.min("t")).alias("span"))
    return out.filter("n = 11 and travel >= 1000").select("rec", "anchor", F.round("travel", 4).alias("travel"), F.round("span", 3).alias("span"))


BOX_SQL = """b AS (SELECT p_partkey AS box, p_size % 5 AS g, 1 + p_partkey % 50 AS cx, (p_partkey * 7) % 11 AS cy, p_partkey % 6 / 2.0 AS h, 0.2 + p_size % 4 / 5.0 AS len, 0.1 + p_size % 3 / 5.0 AS wid FROM part),
 l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey % 5 AS g, l_quantity AS px, l_discount * 100 AS py FROM lineitem),
 d AS (SELECT l.*, b.box, sqrt(power(greatest(abs(cos(h) * (px - cx) + sin(h) * (py - cy)) - len / 2, 0), 2) + power(greatest(abs(cos(h) * (py - cy) - sin(h) * (px - cx)) - wid / 2, 0), 2)) AS gap FROM l JOIN b ON l.g = b.g)"""


def _boxes(spark, sf_dir):
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    boxes = part.selectExpr("p_partkey AS box", "cast(p_size % 5 AS bigint) AS g", "cast(1 + p_partkey % 50 AS double) AS cx", "cast((p_partkey * 7) % 11 AS double) AS cy", "p_partkey % 6 / 2.0D AS heading", "0.2D + p_size % 4 / 5.0D AS length", "0.1D + p_size % 3 / 5.0D AS width")
    points = lines.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_suppkey % 5 AS g", "l_quantity AS px", "l_discount * 100 AS py", "struct(l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id")
    return points, boxes


@query(f"WITH {BOX_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, max(box) AS box, count(*) AS n FROM d WHERE gap <= 0.01 GROUP BY 1, 2, 3, 4")
def point_in_box(spark, sf_dir):
    """Points in oriented boxes of their group, with the last box that holds each."""
    points, boxes = _boxes(spark, sf_dir)
    held = J.held_points(points, boxes, ["g"], 1.0, 0.01, F.max("box").alias("box"), F.count("*").alias("n"))
    return held.groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.max("box").alias("box"), F.sum("n").alias("n"))


@query(f"""WITH {BOX_SQL}, h AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, max(box) AS box, bool_or(box % 2 = 0) AS moving FROM d WHERE gap <= 0.01 GROUP BY 1, 2, 3, 4), n AS (SELECT l.*, l_partkey % 10 = 0 AS ground, CASE WHEN l_partkey % 10 <> 0 THEN box END AS held, moving FROM l LEFT JOIN h USING (l_orderkey, l_linenumber, l_partkey, l_suppkey))
 SELECT g, CASE WHEN ground THEN 'ground' WHEN moving THEN 'dynamic' ELSE 'static' END AS label, count(*) AS n, count(held) AS boxed, coalesce(sum(held), 0)::BIGINT AS boxes FROM n GROUP BY 1, 2""")
def labelled_points(spark, sf_dir):
    """Points by label: ground, in a moving box, or static; with the boxes that hold them."""
    points, boxes = _boxes(spark, sf_dir)
    numbered = points.withColumn("ground", F.col("l_partkey") % 10 == 0)
    out = J.label_points(numbered, boxes.withColumn("moving", F.col("box") % 2 == 0), ["g"], 1.0, 0.01, "id", "ground")
    return out.groupBy("g", "label").agg(F.count("*").alias("n"), F.count("box").alias("boxed"), F.coalesce(F.sum("box"), F.lit(0)).alias("boxes"))


@query(f"""WITH {BOX_SQL}, c AS (SELECT DISTINCT g, CAST(floor(px) AS BIGINT) AS ix, CAST(floor(py) AS BIGINT) AS iy FROM l), e AS (SELECT c.g, ix, iy FROM c JOIN b ON b.g = c.g WHERE sqrt(power(greatest(abs(cos(h) * (ix + 0.5 - cx) + sin(h) * (iy + 0.5 - cy)) - len / 2, 0), 2) + power(greatest(abs(cos(h) * (iy + 0.5 - cy) - sin(h) * (ix + 0.5 - cx)) - wid / 2, 0), 2)) <= 0.31)
 SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.g = c.g AND e.ix = c.ix AND e.iy = c.iy)""")
def cells_outside(spark, sf_dir):
    """Cells whose centre is in none of the grown boxes."""
    points, boxes = _boxes(spark, sf_dir)
    cells = points.select("g", F.floor("px").alias("ix"), F.floor("py").alias("iy")).distinct()
    return J.cut_cells(cells, boxes, ["g"], 1.0, 0.31)


@query(f"WITH {BOX_SQL}, h AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM d WHERE gap <= 0.31) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) AS n FROM l ANTI JOIN h USING (l_orderkey, l_linenumber, l_partkey, l_suppkey) GROUP BY 1, 2, 3, 4")
def points_outside(spark, sf_dir):
    """Points in none of the grown boxes."""
    points, boxes = _boxes(spark, sf_dir)
    return J.outside_boxes(points, boxes, ["g"], 1.0, 0.31, "id").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.count("*").alias("n"))


@query("""WITH {POSE}, d AS (SELECT *, CAST(floor(t / 3600) AS BIGINT) AS hour FROM pose) SELECT a.event_id AS a, b.event_id AS b, round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), 6) AS dist FROM d a JOIN d b ON a.hour = b.hour AND a.event_id < b.event_id WHERE sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 12""")
def near_pairs(spark, sf_dir):
    """Events of one hour that lie close to each other."""
    rows = poses(spark, sf_dir).select(F.floor(F.col("t") / 3600).alias("hour"), "event_id", "x", "y")
    return J.close_pairs(rows, ["hour"], "event_id", 12.0).select("a", "b", rounded(F.col("dist"), 6).alias("dist"))


LINK_SQL = """{POSE}, d AS (SELECT CAST(floor(t / 86400) AS BIGINT) AS f, rec % 3 AS g, event_id AS id, x, y FROM pose),
 p AS (SELECT a.g, a.f, a.id, b.f AS nf, b.id AS nid, b.f - a.f AS k, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS d FROM d a JOIN d b ON a.g = b.g AND b.f BETWEEN a.f + 1 AND a.f + 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY g, f, id ORDER BY k, d, nid) AS o, row_number() OVER (PARTITION BY g, nf, nid ORDER BY k, d, id) AS i FROM p WHERE d <= 8 * k)"""


@query(f"WITH {LINK_SQL} SELECT g, f, id, nf AS next_f, nid AS next_id, round(d, 6) AS d FROM r WHERE o = 1 AND i = 1")
def frame_links(spark, sf_dir):
    """Mutual nearest neighbours from day to day, up to two days ahead."""
    rows = poses(spark, sf_dir).select(F.floor(F.col("t") / 86400).alias("f"), (F.col("rec") % 3).alias("g"), F.col("event_id").alias("id"), "x", "y")
    return J.link_frames(rows, "g", 8.0, 2).select("g", "f", "id", "next_f", "next_id", F.round("d", 6).alias("d"))


@query("""WITH {POSE}, d AS (SELECT CAST(floor(t / 3600) AS BIGINT) AS hour, rec, event_id, count(*) OVER (PARTITION BY floor(t / 3600), rec) AS n FROM pose) SELECT event_id, CASE WHEN n = 1 THEN rec END AS rec FROM d""")
def unambiguous_ids(spark, sf_dir):
    """User ids that occur once in their hour."""
    rows = poses(spark, sf_dir).select(F.floor(F.col("t") / 3600).alias("hour"), "rec", "event_id")
    return J.unambiguous_ids(rows, ["hour"], "rec").select("event_id", "rec")


@query("""WITH {POSE}, f AS (SELECT rec % 5 AS g, rec, min(t) AS t0, arg_min(event_id, t) AS first_id FROM pose GROUP BY 1, 2), n AS (SELECT g, rec, coalesce(lead(first_id) OVER w, first_value(first_id) OVER w) AS other FROM f WINDOW w AS (PARTITION BY g ORDER BY t0))
 SELECT event_id, other FROM pose JOIN n USING (rec)""")
def other_recording(spark, sf_dir):
    """Each row with the first row of the next recording in its group, wrapping around."""
    rows = poses(spark, sf_dir).withColumns({"g": F.col("rec") % 5, "id": F.col("event_id")})
    return J.other_recording(rows, ["t"], "rec", "g").select("event_id", "other")


@query("""WITH {POSE} SELECT event_id FROM pose WHERE (y + x / 10 < 100) AND (y > x / 8) AND (x >= 20 AND x < 400) AND (y < 70)""")
def in_polygons(spark, sf_dir):
    """Events inside a polygon; the oracle states it as half planes: as crossings are counted, points on the left edge are in, on the right ones not."""
    import pyspark.sql.types as T

    corners = [(20.0, 2.5), (400.0, 50.0), (400.0, 60.0), (300.0, 70.0), (20.0, 70.0)]
    shape = spark.createDataFrame([(0, [{"x": x, "y": y} for x, y in corners])], T.StructType.fromDDL("room int, poly array<struct<x:double,y:double>>"))
    points = poses(spark, sf_dir).select(F.lit(0).alias("room"), "event_id", F.col("x").alias("px"), F.col("y").alias("py"))
    return J.in_polygons(points, shape, "room").select("event_id")


@query("""WITH {POSE}, w AS (SELECT rec, f + 3 AS want FROM pose WHERE f % 7 = 0) SELECT w.rec, w.want FROM w LEFT JOIN pose p ON p.rec = w.rec AND p.f = w.want WHERE p.f IS NULL""")
def missing_views(spark, sf_dir):
    """Wanted frames that no row has."""
    rows = poses(spark, sf_dir)
    wanted = rows.filter("f % 7 = 0").select("rec", (F.col("f") + 3).alias("want"))
    return wanted.join(rows.select("rec", F.col("f").alias("want")), ["rec", "want"], "left_anti")


@query("SELECT o_orderkey, count(*) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'MACHINERY') AND NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = o_orderkey AND m.l_returnflag = 'R') GROUP BY 1")
def wanted_not_done(spark, sf_dir):
    """Orders of one market without returned lines: a semi and an anti join."""
    orders, lines, customers = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    wanted = orders.join(customers.filter("c_mktsegment = 'MACHINERY'"), orders["o_custkey"] == customers["c_custkey"], "left_semi").join(lines.filter("l_returnflag = 'R'"), orders["o_orderkey"] == lines["l_orderkey"], "left_anti")
    return wanted.join(lines, F.col("o_orderkey") == lines["l_orderkey"]).groupBy("o_orderkey").agg(F.count("*").alias("lines"))


@query("SELECT d.doc_id, coalesce(l.quality, 0) AS quality, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def scored_or_missing(spark, sf_dir):
    """Every document with its label; missing ones count as failures."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").withColumn("seen", F.lit(True))
    return docs.join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"), F.col("seen").isNull().alias("missing"))
