"""Points and cells of scans: rasters, voxels, merging, closing, clusters and planes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geom import around
from .folds import fold


def cell(c: str, size: float) -> Column:
    return F.floor(F.col(c) / size)


def in_range(points: DataFrame, reach: float) -> DataFrame:
    ok = F.hypot("x", "y") <= reach
    return points.filter(ok & ~F.isnan("x") & ~F.isnan("y"))


def centimetres(c: str) -> Column:
    """Rounded half to even."""
    return F.bround(F.col(c) * 100).cast("int")


def cell_states(points: DataFrame, keys: list[str], occupied: Column, free: Column, least: int = 2) -> DataFrame:
    """State of each cell: occupied with enough hits, else free with any look, else left out."""
    counted = points.groupBy(*keys, "ix", "iy").agg(F.count_if(occupied).alias("n_occ"), F.count_if(free).alias("n_free"))
    return counted.withColumn("state", F.when(F.col("n_occ") >= least, "occupied").when(F.col("n_free") > 0, "free")).filter("state is not null")


def thin(points: DataFrame, keys: list[str], sizes: dict[str, float], order: list[str]) -> DataFrame:
    """One point for each voxel, the first in order; sizes of its edges by axis, so that cells of the plane are voxels without z."""
    w = Window.partitionBy(*keys, *(cell(axis, size) for axis, size in sizes.items())).orderBy(*order)
    return points.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def merge_cells(looks: DataFrame, keys: list[str], sweep: str) -> DataFrame:
    """Per cell over several sweeps: occupied and free counts, first and last hit."""
    hit = F.col("state") == "occupied"
    return looks.groupBy(*keys, "ix", "iy").agg(F.count_if(hit).alias("n_occ"), F.count_if(~hit).alias("n_free"), F.min(F.when(hit, F.col(sweep))).alias("first_hit"), F.max(F.when(hit, F.col(sweep))).alias("last_hit"))


def lasting(merged: DataFrame, used: Column, min_span: int) -> DataFrame:
    """Cells that are obstacles: two hits, 15 % of the looks, and seen over long enough."""
    return merged.filter((F.col("n_occ") >= 2) & (F.col("n_occ") >= 0.15 * (F.col("n_occ") + F.col("n_free"))) & (F.col("last_hit") - F.col("first_hit") >= F.least(F.lit(min_span), F.floor(used / 2))))


def closing(cells: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Morphological closing of a set of cells with a k x k window: dilation, then erosion."""
    half = k // 2
    spread = lambda df: df.withColumn("ix", around(F.col("ix"), half)).withColumn("iy", around(F.col("iy"), half))
    dilated = spread(cells.select(*keys, "ix", "iy")).distinct()
    return spread(dilated).groupBy(*keys, "ix", "iy").agg(F.count("*").alias("n")).filter(F.col("n") == k * k).drop("n")


def free_space(free: DataFrame, occupied: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Free cells closed with a k x k window, less the occupied ones."""
    return closing(free, keys, k).join(occupied.select(*keys, "ix", "iy"), [*keys, "ix", "iy"], "left_anti")


def presence(cells: DataFrame, keys: list[str], frame: str, half: int) -> DataFrame:
    """Per cell and frame, in how many frames within +-half it was occupied."""
    w = Window.partitionBy(*keys).orderBy(frame).rangeBetween(-half, half)
    return cells.select(*keys, frame).distinct().withColumn("n_seen", F.count("*").over(w))


def plane_fit(points: DataFrame, keys: list[str], least: int) -> DataFrame:
    """z = a x + b y + c by least squares from grouped moments; null coefficients with too few or degenerate points."""
    s = {n: F.sum(e) for n, e in {"x": F.col("x"), "y": F.col("y"), "z": F.col("z"), "xx": F.col("x") * F.col("x"), "xy": F.col("x") * F.col("y"), "yy": F.col("y") * F.col("y"), "xz": F.col("x") * F.col("z"), "yz": F.col("y") * F.col("z")}.items()}
    m = points.groupBy(*keys).agg(F.count("*").cast("double").alias("n"), *(v.alias(f"s_{k}") for k, v in s.items()))
    c = F.col
    cov = lambda p, q, pq: c(pq) - c(p) * c(q) / c("n")
    xx, xy, yy, xz, yz = cov("s_x", "s_x", "s_xx"), cov("s_x", "s_y", "s_xy"), cov("s_y", "s_y", "s_yy"), cov("s_x", "s_z", "s_xz"), cov("s_y", "s_z", "s_yz")
    det = xx * yy - xy * xy
    ok = (c("n") >= least) & (F.abs(det) > 1e-9)
    out = m.withColumns({"a": F.when(ok, (xz * yy - yz * xy) / det), "b": F.when(ok, (yz * xx - xz * xy) / det)})
    return out.withColumn("c", (c("s_z") - c("a") * c("s_x") - c("b") * c("s_y")) / c("n")).select(*keys, "n", "a", "b", "c")


def low_quantile(points: DataFrame, keys: list[str], share: float = 0.1, least: int = 3) -> DataFrame:
    """Ground height of each coarse cell: the point at a share of the sorted heights, from counts of distinct heights."""
    counted = points.groupBy(*keys, "z").agg(F.count("*").alias("_c"))
    cell = Window.partitionBy(*keys)
    up = F.sum("_c").over(cell.orderBy("z").rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumns({"_up": up, "n": F.sum("_c").over(cell)})
    at = F.floor(F.col("n") * share)
    return placed.filter((F.col("n") >= least) & (F.col("_up") > at) & (F.col("_up") - F.col("_c") <= at)).select(*keys, F.col("z").alias("ground"), F.col("n").cast("int").alias("n"))


#: Fixed values of ground that is grown outwards: band about the expected height [m], its growth for each cell without ground, its most, points that make ground.
GROUND_BAND, SLACK_PER_CELL, MAX_SLACK, MIN_GROUND_POINTS = 0.35, 0.15, 0.6, 3


def grow_ground(points: DataFrame, sweep: str, under: float, size: float, rings: int) -> DataFrame:
    """(sweep, ci, cj, ground, seen) of all cells within `rings` of the sensor, from points (sweep, x, y, z) around it.

    The four cells around the sensor stand at height `under`.  Ring by ring outwards a cell expects the mean of its neighbours
    in the ring before and takes a low point of those within a band about it; with too few of them it keeps what it
    expects, and the band grows.  Counts of equal heights go through the rings of a sweep, one ring at a time.
    """
    low = lambda c: F.when(c >= 0, c).otherwise(-1 - c)
    placed = points.select(sweep, F.floor(F.col("x") / size).cast("int").alias("ci"), F.floor(F.col("y") / size).cast("int").alias("cj"), F.col("z").cast("double").alias("z")).filter("z is not null")
    counted = placed.withColumn("ring", F.greatest(low(F.col("ci")), low(F.col("cj")))).filter(F.col("ring") < rings).groupBy(sweep, "ring", "ci", "cj", "z").agg(F.count("*").alias("n"))
    #: every sweep has a row for its last ring, up to which cells without points inherit
    ends = counted.select(sweep).distinct().select(sweep, F.lit(rings - 1).alias("ring"), F.lit(None).cast("int").alias("ci"), F.lit(None).cast("int").alias("cj"), F.lit(None).cast("double").alias("z"), F.lit(0).cast("long").alias("n"))
    schema = T.StructType([points.schema[sweep], *(T.StructField(c, k) for c, k in (("ci", T.IntegerType()), ("cj", T.IntegerType()), ("ground", T.DoubleType()), ("seen", T.BooleanType())))])

    def step(state: tuple, rows: list[dict]) -> tuple[tuple, list[dict]]:
        last, known = state
        name, out = rows[0][sweep], []
        while last < rows[0]["ring"]:
            last += 1
            heights: dict = {}
            if last == rows[0]["ring"]:
                for r in rows:
                    if r["n"]:
                        heights.setdefault((r["ci"], r["cj"]), []).append((r["z"], r["n"]))
            known = ring_of_ground(last, known, heights, under)
            out += [{sweep: name, "ci": i, "cj": j, "ground": g, "seen": slack == 0.0} for (i, j), (g, slack) in sorted(known.items())]
        return (last, known), out

    return fold(counted.unionByName(ends), [sweep], "ring", lambda: (-1, {}), step, schema, ["ci", "cj", "z"])


def ring_of_ground(ring: int, inner: dict, heights: dict, under: float) -> dict:
    """(ground, slack) by cell of a ring, from the ring before and the sorted (height, count) of the cells' points."""
    cells = [(i, j) for i in range(-1 - ring, ring + 1) for j in ((-1 - ring, ring) if -1 - ring < i < ring else range(-1 - ring, ring + 1))]
    if not ring:
        return dict.fromkeys(cells, (under, 0.0))
    out = {}
    for i, j in cells:
        near = [inner[c] for c in ((i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)) if c in inner]
        expected, slack = sum(g for g, _ in near) / len(near), min(s for _, s in near)
        inside = [(z, n) for z, n in heights.get((i, j), ()) if abs(z - expected) <= GROUND_BAND + slack]
        total = sum(n for _, n in inside)
        if total >= MIN_GROUND_POINTS:
            place = total // 10
            for z, n in inside:
                if place < n:
                    break
                place -= n
            out[i, j] = (z, 0.0)
        else:
            out[i, j] = (expected, min(slack + SLACK_PER_CELL, MAX_SLACK))
    return out


#: Fixed values of the floor in a sweep: range of its returns [m], greatest height [m], tolerance [m], returns that make a floor.
FLOOR_NEAR, FLOOR_FAR, FLOOR_BELOW, FLOOR_TOLERANCE, FLOOR_POINTS = 3.0, 15.0, -0.8, 0.05, 300


def floor_fit(points: DataFrame, sweep: str, tolerance: float = FLOOR_TOLERANCE, least: int = FLOOR_POINTS, passes: int = 4, far: float = FLOOR_FAR, near: float = FLOOR_NEAR, below: float = FLOOR_BELOW) -> DataFrame:
    """(sweep, n, nx, ny, nz, height) of the floor under each sweep: unit normal upwards and the sensor's height over it.

    Least squares over low returns from grouped moments, again over those near the plane before, within a band that halves
    down to the tolerance; so many passes, whatever the points.  Sweeps with too few such returns, or a floor over 25 degrees off
    level, have no row.
    """
    r = F.hypot("x", "y")
    low = points.filter((r > near) & (r < far) & (F.col("z") < below)).select(sweep, "x", "y", "z")
    plane = plane_fit(low, [sweep], least)
    for k in range(1, passes):
        band = tolerance * 2 ** (passes - 1 - k)
        close = low.join(plane.select(sweep, "a", "b", "c"), sweep).filter(F.abs(F.col("z") - F.col("a") * F.col("x") - F.col("b") * F.col("y") - F.col("c")) < band)
        plane = plane_fit(close.select(sweep, "x", "y", "z"), [sweep], least)
    size = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + 1)
    out = plane.filter("a is not null").select(sweep, "n", (-F.col("a") / size).alias("nx"), (-F.col("b") / size).alias("ny"), (1 / size).alias("nz"), (-F.col("c") / size).alias("height"))
    return out.filter("nz >= 0.9")


def levelled(sweeps: DataFrame, floors: DataFrame, recording: str, frame: str, smooth: int = 5, standing: float = 1.7) -> DataFrame:
    """Sweeps (recording, frame, ox, oy, oz: the odometry's up vector) with the up vector to level by, and one height a recording.

    The floor's normal where it is seen, else the odometry's; median of each part over +-smooth sweeps, edge padded; the height is
    the median over the floors, `standing` where none is seen.
    """
    both = sweeps.join(floors.select(recording, frame, "nx", "ny", "nz", "height"), [recording, frame], "left")
    up = both.withColumns({f"u{c}": F.when(F.col("nx").isNotNull(), F.col(f"n{c}")).otherwise(F.col(f"o{c}")) for c in "xyz"})
    w = Window.partitionBy(recording).orderBy(frame)
    ends = {c: (F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))) for c in ("ux", "uy", "uz")}
    around_ = lambda c: F.array_sort(F.array(*(F.coalesce(F.lag(c, -k).over(w), ends[c][0]) if k < 0 else F.coalesce(F.lead(c, k).over(w), ends[c][1]) for k in range(-smooth, smooth + 1))))[smooth]
    smoothed = up.withColumns({f"s{c}": around_(f"u{c}") for c in "xyz"})
    size = F.sqrt(F.col("sx") ** 2 + F.col("sy") ** 2 + F.col("sz") ** 2)
    heights = both.groupBy(recording).agg(F.coalesce(F.percentile("height", F.lit(0.5)), F.lit(standing)).alias("sensor_height"), F.avg(F.col("nx").isNotNull().cast("double")).alias("floor_share"))
    return smoothed.select(recording, frame, *((F.col(f"s{c}") / size).alias(f"up_{c}") for c in "xyz")).join(heights, recording)


def inherit_ground(ground: DataFrame, wanted: DataFrame, keys: list[str], passes: int = 3) -> DataFrame:
    """Ground of wanted cells: their own, else the mean of the eight around; a fixed number of passes."""
    known = wanted.join(ground.select(*keys, "ci", "cj", "ground"), [*keys, "ci", "cj"], "left")
    for _ in range(passes):
        near = known.filter("ground is not null").select(*keys, "ci", "cj", F.col("ground").alias("g")).withColumn("ci", around(F.col("ci"), 1)).withColumn("cj", around(F.col("cj"), 1)).groupBy(*keys, "ci", "cj").agg(F.avg("g").alias("g"))
        known = known.join(near, [*keys, "ci", "cj"], "left").withColumn("ground", F.coalesce("ground", "g")).drop("g")
    return known


def bilinear(points: DataFrame, ground: DataFrame, keys: list[str], size: float) -> DataFrame:
    """Points (id, x, y, z) with height over ground, from the up to four cell centres around; every row is a point, also where ids repeat."""
    u, v = F.col("x") / size - 0.5, F.col("y") / size - 0.5
    #: each square between four centres, by its low corner, with the ground at those that have one
    offer = ground.select(*keys, "ci", "cj", "ground").withColumn("_di", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_dj", F.explode(F.array(F.lit(0), F.lit(1))))
    corner = lambda i, j: F.max(F.when((F.col("_di") == i) & (F.col("_dj") == j), F.col("ground"))).alias(f"_g{i}{j}")
    squares = offer.groupBy(*keys, (F.col("ci") - F.col("_di")).alias("_bi"), (F.col("cj") - F.col("_dj")).alias("_bj")).agg(*(corner(i, j) for i in (0, 1) for j in (0, 1)))
    placed = points.select(*keys, "id", "x", "y", "z", F.floor(u).alias("_bi"), F.floor(v).alias("_bj"), (u - F.floor(u)).alias("_u"), (v - F.floor(v)).alias("_v"))
    joined = placed.join(squares, [*keys, "_bi", "_bj"])
    weight = {(i, j): F.when(F.col(f"_g{i}{j}").isNotNull(), (F.col("_u") if i else 1 - F.col("_u")) * (F.col("_v") if j else 1 - F.col("_v"))).otherwise(0.0) for i in (0, 1) for j in (0, 1)}
    total = sum(weight.values(), F.lit(0.0))
    level = sum((w * F.coalesce(f"_g{i}{j}", F.lit(0.0)) for (i, j), w in weight.items()), F.lit(0.0))
    return joined.select(*keys, "id", "x", "y", "z", (F.col("z") - F.try_divide(level, total)).alias("above"))


def blocks_ahead(cells: DataFrame, scenarios: DataFrame, key: str, n: int = 8, per_block: int = 10) -> DataFrame:
    """Share of occupied cells in each of n x n blocks ahead, empty blocks included."""
    counted = cells.filter((F.col("ix") >= 0) & (F.col("ix") < n * per_block) & (F.col("iy") >= -n * per_block // 2) & (F.col("iy") < n * per_block // 2)).groupBy(key, F.floor(F.col("ix") / per_block).alias("bi"), F.floor((F.col("iy") + n * per_block // 2) / per_block).alias("bj")).agg(F.count("*").alias("c"))
    grid = scenarios.select(key).distinct().withColumn("bi", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("bj", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    grid = grid.withColumns({"bi": F.col("bi").cast("long"), "bj": F.col("bj").cast("long")})
    return grid.join(counted, [key, "bi", "bj"], "left").select(key, "bi", "bj", (F.coalesce("c", F.lit(0)) / (per_block * per_block)).alias("share"))


def cell_edges(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of cells of one cluster: as after dilation with a cross and 8-connectivity."""
    a = cells.select(*keys, F.col("node").alias("a"), F.col("ix").alias("ax"), F.col("iy").alias("ay"))
    look = a.withColumn("ix", around(F.col("ax"), 3)).withColumn("iy", around(F.col("ay"), 3))
    out = lambda p, q: F.greatest(F.lit(0), F.abs(F.col(p) - F.col(q)) - 1)
    return look.filter(out("ax", "ix") + out("ay", "iy") <= 2).join(cells.select(*keys, "ix", "iy", F.col("node").alias("b")), [*keys, "ix", "iy"]).filter("a < b").select(*keys, "a", "b")


def person_clusters(points: DataFrame, labels: DataFrame, size: float, least: int = 8, extent: float = 1.2, span: float = 0.3) -> DataFrame:
    """(root, n, x, y) of clusters of a person's size: enough points (node, x, y, z), cells within the extent, heights apart by the span; labels is (node, root)."""
    per = points.join(labels, "node").groupBy("root").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), *(f(c).alias(f"_{k}{c}") for c in ("ix", "iy", "z") for k, f in (("low", F.min), ("high", F.max))))
    wide = F.greatest(F.col("_highix") - F.col("_lowix"), F.col("_highiy") - F.col("_lowiy")) + 1
    return per.filter((F.col("n") >= least) & (wide * size <= extent + 1e-9) & (F.col("_highz") - F.col("_lowz") >= span)).select("root", "n", "x", "y")


def rotate_cells(cells: DataFrame, poses: DataFrame, key: str, size: float, threshold: float) -> DataFrame:
    """World cells in ego-aligned cells: each output cell near one of them asks its four world neighbours, and keeps a weighted share over the threshold."""
    c, s = F.cos("yaw"), F.sin("yaw")
    at = cells.join(poses, key).withColumns({"wx": (F.col("ix") + 0.5) * size - F.col("x0"), "wy": (F.col("iy") + 0.5) * size - F.col("y0")})
    ego = at.select(key, "x0", "y0", "yaw", F.floor((c * F.col("wx") + s * F.col("wy")) / size).alias("ei0"), F.floor((c * F.col("wy") - s * F.col("wx")) / size).alias("ej0"))
    targets = ego.withColumn("ei", around(F.col("ei0"), 1)).withColumn("ej", around(F.col("ej0"), 1)).select(key, "x0", "y0", "yaw", "ei", "ej").distinct()
    ex, ey = (F.col("ei") + 0.5) * size, (F.col("ej") + 0.5) * size
    u = (F.col("x0") + c * ex - s * ey) / size - 0.5
    v = (F.col("y0") + s * ex + c * ey) / size - 0.5
    corner = targets.withColumns({"u": u, "v": v}).withColumn("di", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("dj", F.explode(F.array(F.lit(0), F.lit(1))))
    corner = corner.withColumns({"ix": F.floor("u") + F.col("di"), "iy": F.floor("v") + F.col("dj"), "w": (1 - F.abs(F.col("u") - F.floor("u") - F.col("di"))) * (1 - F.abs(F.col("v") - F.floor("v") - F.col("dj")))})
    return corner.join(cells.select(key, "ix", "iy"), [key, "ix", "iy"]).groupBy(key, "ei", "ej").agg(F.sum("w").alias("weight")).filter(F.col("weight") >= threshold)
