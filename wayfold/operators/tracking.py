"""Objects and detections followed from frame to frame."""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folds import fold_columns
from .pairing import Looks, distances, pair_off_places

#: How far objects of a class may be from where they are expected [m], their speed [m/s] and acceleration [m/s^2].
GATE = {"Pedestrian": 1.5, "Cyclist": 3.0, "Car": 2.5}
MAX_SPEED = {"Pedestrian": 3.0, "Cyclist": 10.0, "Car": 16.0}
MAX_ACCEL = {"Pedestrian": 1.5, "Cyclist": 3.0, "Car": 4.0}
#: Share of the distance that counts where ids agree; frames over which an object may be missing; how near [m] it then must be.
ID_BONUS, MAX_MISSED, REACQUIRE_RADIUS = 0.1, 3, 1.0
#: Fixed values of detections without ids: gate [m], frames missed, hits and travel [m] of a track.
DETECTION_GATE, MAX_MISSES, MIN_HITS, MIN_TRAVEL = 0.8, 3, 8, 0.6
_KINDS = list(GATE)


def pair_off(offers: list[tuple]) -> list[tuple[int, int]]:
    """(left, right) of offers (cost, tie, left, right), cheapest first, each side once: what mutual nearest neighbours give, taken away until none is left.

    This says what is meant; queries get the same from pair_off_places.
    """
    lefts, rights, out = set(), set(), []
    for _, _, a, b in sorted(offers):
        if a not in lefts and b not in rights:
            lefts.add(a)
            rights.add(b)
            out.append((a, b))
    return out


class Crowd:
    """Rows of a frame in cells that hold a few of them each, looked through from a place outwards; rows that are taken leave."""

    def __init__(self, rows: list[dict], members: list[int]):
        members = [b for b in members if math.isfinite(rows[b]["x"]) and math.isfinite(rows[b]["y"])]
        xs, ys = [rows[b]["x"] for b in members] or [0.0], [rows[b]["y"] for b in members] or [0.0]
        wide, high, n = max(xs) - min(xs), max(ys) - min(ys), max(len(members), 1)
        self.size = max(math.sqrt(wide * high * 2 / n), max(wide, high) * 2 / n) or 1.0
        self.cells: dict[tuple[int, int], set[int]] = defaultdict(set)
        self.at = {b: (math.floor(rows[b]["x"] / self.size), math.floor(rows[b]["y"] / self.size)) for b in members}
        for b, c in self.at.items():
            self.cells[c].add(b)

    def take(self, b: int) -> None:
        cell = self.cells[self.at[b]]
        cell.discard(b)
        if not cell:
            del self.cells[self.at[b]]

    def around(self, x: float, y: float, limit: float, cost: Callable[[int], tuple | None], plus: float = 0.0) -> Iterator[tuple]:
        """cost(b) of the rows within the limit, least first; it is their distance and plus at least, None where a row can't be taken."""
        if not (math.isfinite(x) and math.isfinite(y)):
            return
        i, j, ring, found = math.floor(x / self.size), math.floor(y / self.size), 0, []
        while True:
            whole = (2 * ring + 1) ** 2 > len(self.cells)
            if whole:
                cells = [c for c in self.cells if max(abs(c[0] - i), abs(c[1] - j)) >= ring]
            else:
                edge = range(-ring, ring + 1)
                cells = {(i + a, j + b) for a in edge for b in ((-ring, ring) if abs(a) < ring else edge)}
            for c in cells:
                for b in self.cells.get(c, ()):
                    if (at := cost(b)) is not None:
                        heapq.heappush(found, at)
            bound = math.inf if whole or ring * self.size > limit else ring * self.size * (1 - 1e-9) + plus
            while found and found[0][0] < bound:
                yield heapq.heappop(found)
            if bound == math.inf:
                return
            ring += 1


def pair_off_near(offers: list[tuple], streams: list[Iterator[tuple]], crowd_of: Callable[[int], Crowd]) -> list[tuple[int, int]]:
    """What pair_off gives for offers and all that the streams have, each of which has the offers of one left in order: they are drawn as they are needed."""
    lefts, rights, out = set(), set(), []
    heap = [(*o, None) for o in offers]
    draw = lambda s: next((o for o in streams[s] if o[3] not in rights), None)
    heap += [(*o, s) for s in range(len(streams)) if (o := draw(s)) is not None]
    heapq.heapify(heap)
    while heap:
        _, _, a, b, s = heapq.heappop(heap)
        if a in lefts:
            continue
        if b not in rights:
            lefts.add(a)
            rights.add(b)
            out.append((a, b))
            if b in crowd_of(b).at:
                crowd_of(b).take(b)
        elif s is not None and (o := draw(s)) is not None:
            heapq.heappush(heap, (*o, s))
    return out


@dataclass
class Open:
    """Tracks that may go on, a row each: where and in which frame they were last seen; `moving` if their velocity comes from two frames in a row."""

    track: pa.Array
    frame: np.ndarray
    t: np.ndarray
    x: np.ndarray
    y: np.ndarray
    vx: np.ndarray
    vy: np.ndarray
    moving: np.ndarray
    kind: np.ndarray
    ident: np.ndarray

    def of(self, rows: np.ndarray) -> Open:
        return Open(self.track.take(pa.array(rows)), *(getattr(self, f.name)[rows] for f in fields(self)[1:]))

    def expected(self, t: float) -> tuple[np.ndarray, np.ndarray]:
        return self.x + self.vx * (t - self.t), self.y + self.vy * (t - self.t)

    def since(self, frame: int, most: int) -> Open:
        """Those that were seen so many frames ago at most, in order of their names."""
        near = self.of(np.flatnonzero(frame - self.frame <= most))
        return near.of(np.asarray(pc.array_sort_indices(near.track)))

    def then(self, before: np.ndarray, found: Open) -> Open:
        """What is open after a frame: those that were not seen, and what was found in it."""
        left = np.ones(len(self.frame), bool)
        left[before[before >= 0]] = False
        kept = self.of(np.flatnonzero(left))
        return Open(pa.concat_arrays([kept.track, found.track]), *(np.concatenate([getattr(kept, f.name), getattr(found, f.name)]) for f in fields(self)[1:]))


def _seen(rows: pa.RecordBatch, kinds: list[str]) -> Open:
    """The rows of a frame as tracks that begin; a frame, time or place that is null counts as NaN."""
    number = lambda c: rows.column(c).to_numpy(zero_copy_only=False).astype(float)
    n = rows.num_rows
    kind = np.array([kinds.index(k) for k in rows.column("kind").to_pylist()], np.int64) if kinds else np.zeros(n, np.int64)
    ident = np.empty(n, object)
    if kinds:
        given = rows.column("ident").to_pylist()
        times = Counter(given)
        ident[:] = [i if times[i] == 1 else None for i in given]
    return Open(rows.column("id"), np.full(n, rows.column("f")[0].as_py()), number("t"), number("x"), number("y"), np.zeros(n), np.zeros(n), np.zeros(n, bool), kind, ident)


def _continued(live: Open, found: Open, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names the found rows by the tracks they go on with; (rows that go on, their tracks)."""
    n, on = len(live.frame), np.flatnonzero(before >= 0)
    found.track = pa.concat_arrays([live.track, found.track]).take(pa.array(np.where(before >= 0, before, n + np.arange(len(before)))))
    return on, before[on]


def _follow(rows: DataFrame, key: str, kinds: list[str], most: int, pair: Callable[[Open, Open], np.ndarray], move: Callable[[Open, Open, np.ndarray, np.ndarray], None]) -> DataFrame:
    """(key, id, track): `pair` tells which open track each row of a frame goes on with, and `move` gives it its velocity.

    Rows without a frame come before or behind none, so each is a track.
    """

    def step(state: Open | None, batch: pa.RecordBatch) -> tuple[Open | None, pa.RecordBatch]:
        ids, frame = batch.column("id"), batch.column("f")[0].as_py()
        if frame is None:
            return state, pa.RecordBatch.from_arrays([batch.column(key), ids, ids], names=[key, "id", "track"])
        found = _seen(batch, kinds)
        if state is None:
            state = found
        else:
            live = state.since(frame, most)
            before = pair(live, found)
            on, was = _continued(live, found, before)
            move(live, found, on, was)
            state = live.then(before, found)
        return state, pa.RecordBatch.from_arrays([batch.column(key), ids, found.track], names=[key, "id", "track"])

    return fold_columns(rows, [key], "f", lambda: None, step, _named(rows, key), ["id"])


def _bonus(live: Open, found: Open, frame: int) -> list[tuple[float, int, int]]:
    """(cost, left, right) of rows within reach of the track that had their own id."""
    at, out = {i: b for b, i in enumerate(found.ident) if i is not None}, []
    for a, ident in enumerate(live.ident if at else ()):
        b = at.get(ident) if ident is not None else None
        if b is None or live.kind[a] != found.kind[b]:
            continue
        kind, dt = _KINDS[live.kind[a]], float(found.t[b] - live.t[a])
        ex, ey = float(live.x[a] + live.vx[a] * dt), float(live.y[a] + live.vy[a] * dt)
        off = math.hypot(ex - float(found.x[b]), ey - float(found.y[b]))
        if off <= (GATE[kind] + MAX_ACCEL[kind] * dt * dt if live.moving[a] else MAX_SPEED[kind] * dt):
            out.append((ID_BONUS * off, a, b))
    return out


def link_objects(objects: DataFrame, key: str) -> DataFrame:
    """(key, id, track) of labelled objects (key, f, t, id, kind, x, y, ident): track is the id of its first object.

    f numbers the frames of a key; ident is a label's own id, which only counts where it occurs once in its frame.  What it costs to
    take an object for one seen before: own id first, then place, then where one was lost.
    """
    gates = np.array([GATE[k] for k in _KINDS])

    def pair(live: Open, found: Open) -> np.ndarray:
        frame = found.frame[0]
        times, when = np.unique(found.t, return_inverse=True)
        late, lost, slack = np.flatnonzero(live.frame == frame - 1), np.flatnonzero(live.frame != frame - 1), gates[live.kind]
        speed, classes = 0.5 * distances(live.vx, live.vy), found.kind * len(times) + when
        looks = [Looks(lost, live.x[lost], live.y[lost], np.full(len(lost), REACQUIRE_RADIUS), live.kind[lost], found.kind, REACQUIRE_RADIUS)]
        for k, t in enumerate(times):
            (ex, ey), limit = live.expected(t), slack + speed * (t - live.t)
            looks.append(Looks(late, ex[late], ey[late], limit[late], live.kind[late] * len(times) + k, classes))
        lefts = [live.frame == frame - 1, live.kind, live.t, live.x, live.y, live.vx, live.vy]
        return pair_off_places(lefts, looks, found.x, found.y, [found.kind, when], _bonus(live, found, frame))

    def move(live: Open, found: Open, on: np.ndarray, was: np.ndarray) -> None:
        found.moving[on] = live.frame[was] == found.frame[on] - 1
        at = found.moving[on] & (found.t[on] > live.t[was])
        on, was = on[at], was[at]
        for v, c in (("vx", "x"), ("vy", "y")):
            getattr(found, v)[on] = (getattr(found, c)[on] - getattr(live, c)[was]) / (found.t[on] - live.t[was])

    wanted = objects.select(key, F.col("f").cast("long").alias("f"), *(F.col(c).cast("double").alias(c) for c in ("t", "x", "y")), "id", "kind", "ident").filter(F.col("kind").isin(list(GATE)) & F.col("x").isNotNull() & F.col("y").isNotNull())
    return _follow(wanted, key, _KINDS, MAX_MISSED, pair, move)


def follow_detections(detections: DataFrame, key: str, gate: float = DETECTION_GATE, misses: int = MAX_MISSES) -> DataFrame:
    """(key, id, track) of detections (key, f, t, id, x, y): each goes to the open track whose expected place is nearest, within a gate.

    A track's velocity is the mean of the one before and the one just seen; it stays open while it misses so many frames at most.
    """

    def pair(live: Open, found: Open) -> np.ndarray:
        times, when = np.unique(found.t, return_inverse=True)
        every, below = np.arange(len(live.frame)), np.full(len(live.frame), np.nextafter(gate, -math.inf))
        looks = [Looks(every, *live.expected(t), below, np.full(len(every), k), when) for k, t in enumerate(times)]
        return pair_off_places([live.t, live.x, live.y, live.vx, live.vy], looks, found.x, found.y, [when])

    def move(live: Open, found: Open, on: np.ndarray, was: np.ndarray) -> None:
        dt, share = np.maximum(found.t[on] - live.t[was], 1e-9), np.where(live.moving[was], 0.5, 1.0)
        for v, c in (("vx", "x"), ("vy", "y")):
            old = getattr(live, v)[was]
            getattr(found, v)[on] = old + share * ((getattr(found, c)[on] - getattr(live, c)[was]) / dt - old)
        found.moving[on] = True

    wanted = detections.select(key, F.col("f").cast("long").alias("f"), *(F.col(c).cast("double").alias(c) for c in ("t", "x", "y")), "id").filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    return _follow(wanted, key, [], misses + 1, pair, move)


def _named(rows: DataFrame, key: str) -> T.StructType:
    return T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("id", rows.schema["id"].dataType), T.StructField("track", rows.schema["id"].dataType)])


def moving_tracks(detections: DataFrame, followed: DataFrame, key: str, min_hits: int = MIN_HITS, min_travel: float = MIN_TRAVEL) -> DataFrame:
    """(key, track, hits, f0, f1, travel) of tracks with enough detections and distance between the first and the last."""
    ends = detections.join(followed, [key, "id"]).groupBy(key, "track").agg(
        F.count("*").alias("hits"), F.min("f").alias("f0"), F.max("f").alias("f1"), *(of(c, F.struct("f", "id")).alias(f"{c}{k}") for c in ("x", "y") for k, of in ((0, F.min_by), (1, F.max_by)))
    )
    return ends.withColumn("travel", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).filter((F.col("hits") >= min_hits) & (F.col("travel") >= min_travel)).select(key, "track", "hits", "f0", "f1", "travel")


def walkers(tracks: DataFrame, key: str, ground: DataFrame, length: float = 0.6, width: float = 0.6, height: float = 1.7) -> DataFrame:
    """Tracks (key, track, f, x, y) as boxes of a standing person: centre height over the ground of (key, f, ground), heading by travel."""
    from .kinematics import gradient_heading

    placed = tracks.join(ground, [key, "f"]).withColumn("z", F.col("ground") + height / 2).drop("ground")
    named = placed.withColumn("_track", F.struct(key, "track"))
    return gradient_heading(named, "_track").drop("_track").withColumns({"l": F.lit(length), "w": F.lit(width), "h": F.lit(height)})
