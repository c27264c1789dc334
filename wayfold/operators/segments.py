"""Cutting sequences into pieces: gaps and islands over window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import ordered, scan

#: Plausible step of a track, base in metres and metres a second, by coarse type.
JUMP_LIMITS = {"PEDESTRIAN": (1.0, 4.0), "CYCLE": (1.5, 15.0), "VEHICLE": (1.5, 15.0), "OTHER_MOVABLE": (1.5, 15.0), "STATIC": (1.0, 0.0)}
OTHER_JUMP = (1.5, 15.0)
#: What a distance may be off by rounding.
ROUNDING = 1e-9


def islands(df: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str, previous: dict[str, Column] | None = None, most: int | None = None) -> DataFrame:
    """Adds a running number that grows at each row where `breaks` holds.

    previous: values of the row before, by the names under which `breaks` uses them; they are not in the result.
    """
    on = ordered(df, keys, order, most)
    if previous:
        on = scan(on, previous=previous)
    marked = on.with_rows(on.rows.withColumn("_starts", F.coalesce(breaks, F.lit(False)).cast("int")))
    return scan(marked, total={name: F.col("_starts")}).plain().drop("_starts", *(previous or {}))


def cut_episodes(poses: DataFrame, key: str = "rec", max_step: float = 1.0, max_gap_s: float = 1.0, valid: Column | None = None, most: int | None = None, clock: str = "t") -> DataFrame:
    """Rows of valid poses with the island (episode) and the hop from the row before in it (null for its first).

    A row starts an island if it lies over max_step or, by the clock, max_gap_s from the raw previous row, or if that row is invalid.
    """
    ok = F.coalesce(F.col("x").isNotNull() & F.col("y").isNotNull() & (F.lit(True) if valid is None else valid), F.lit(False))
    seen = scan(ordered(poses.withColumn("ok", ok), [key], ["f"], most), previous={"_was": F.struct("x", "y", "t", F.col(clock).alias("clock"), "ok")})
    rows = seen.rows.withColumns({"hop": F.hypot(F.col("x") - F.col("_was.x"), F.col("y") - F.col("_was.y")), "gap": F.col("t") - F.col("_was.t")})
    starts = ~F.coalesce(F.col("_was.ok"), F.lit(False)) | (F.col("hop") > max_step) | (F.col(clock) - F.col("_was.clock") > max_gap_s) | F.col("hop").isNull()
    marked = rows.withColumn("starts", starts)
    cut = scan(seen.with_rows(marked), total={"episode": F.coalesce("starts", F.lit(False)).cast("int")}).plain().filter("ok")
    return cut.select(*poses.columns, "episode", F.when(~F.col("starts"), F.col("hop")).alias("hop"), F.when(~F.col("starts"), F.col("gap")).alias("dt"))


def episode_stats(cut: DataFrame, key: str = "rec", min_frames: int = 20, min_length: float = 3.0) -> DataFrame:
    """One row for each episode that is long enough: frames, start, duration, length and median speed."""
    out = cut.groupBy(key, "episode").agg(
        F.count("*").alias("n"), F.min("f").alias("f0"), F.min("t").alias("t0"), (F.max("t") - F.min("t")).alias("duration"),
        F.coalesce(F.sum("hop"), F.lit(0.0)).alias("length"),
        F.coalesce(F.percentile(F.col("hop") / F.greatest(F.col("dt"), F.lit(1e-6)), F.lit(0.5)), F.lit(0.0)).alias("median_speed"),
    )
    return out.filter((F.col("n") >= min_frames) & (F.col("length") >= min_length))


def gap_segments(df: DataFrame, key: str, position: Column, max_gap: float, most: int | None = None) -> DataFrame:
    """Adds the segment: a new one where a position (frame number or time) is over max_gap beyond the last."""
    return islands(df.withColumn("position", position), [key], ["position"], F.col("position") - F.col("_at") > max_gap, "segment", {"_at": F.col("position")}, most)


def densify(df: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """One row for every frame number between a group's first and last; absent ones hold nulls."""
    span = df.groupBy(*keys).agg(F.explode(F.sequence(F.min(frame), F.max(frame))).alias(frame))
    return span.join(df, [*keys, frame], "left")


def chain_pieces(rows: DataFrame, clip: str, max_gap_s: float, join_gap_s: float, same: list[str]) -> DataFrame:
    """Cuts inside clips, then joins pieces in order of time where 0 < gap <= join_gap_s and the `same` columns agree.

    The second step orders the aggregated pieces only.  Returns one row a piece with its chain.
    """
    cut = islands(rows, [clip], ["t"], F.col("t") - F.col("_at") > max_gap_s, "piece", {"_at": F.col("t")})
    pieces = cut.groupBy(*same, clip, "piece").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n"))
    gap = F.col("t0") - F.col("_end")
    return islands(pieces, same, ["t0", clip, "piece"], gap.isNull() | (gap <= 0) | (gap > join_gap_s), "chain", {"_end": F.col("t1")})


def cut_chains(rows: DataFrame, chain: list[str], max_speed: float, name: str = "part", then: list[str] = ()) -> DataFrame:
    """Adds part: a chain is cut where its pose moves faster than max_speed, which only wrong poses do; rows: (chain, t, x, y).

    then: order of rows of one time, without which it is left to chance.
    """
    step, dt = F.hypot(F.col("x") - F.col("_was.x"), F.col("y") - F.col("_was.y")), F.col("t") - F.col("_was.t")
    return islands(rows, chain, ["t", *then], step > dt * max_speed, name, {"_was": F.struct("x", "y", "t")})


def split_tracks(obs: DataFrame, limits: DataFrame, keys: list[str], type_col: str = "kind", then: list[str] = ()) -> DataFrame:
    """Adds part: a track is split where it steps further than base + speed * dt; limits is (type, base, speed), a small table.

    A step of the limit itself is none too far, whatever its last digits; then: order of rows of one time.
    """
    step = F.hypot(F.col("x") - F.col("_was.x"), F.col("y") - F.col("_was.y"))
    far = step > F.coalesce("base", F.lit(OTHER_JUMP[0])) + F.coalesce("speed", F.lit(OTHER_JUMP[1])) * (F.col("t") - F.col("_was.t")) + ROUNDING
    return islands(obs.join(limits, type_col, "left"), keys, ["t", *then], far, "part", {"_was": F.struct("x", "y", "t")}).drop("base", "speed")


def contiguity(frames: DataFrame, episode: str, frame: str) -> DataFrame:
    """Per episode: whether frame numbers are 0..n-1, each once."""
    return frames.groupBy(episode).agg(F.count("*").alias("n"), F.count_distinct(frame).alias("distinct_frames"), F.max(frame).alias("last")).withColumn("contiguous", (F.col("n") == F.col("distinct_frames")) & (F.col("last") == F.col("n") - 1))
