"""Conversion of files as they come: broken ones stop nothing, nothing is done twice."""

import random

import pytest
from pyspark.sql import functions as F

from wayfold.streaming import streams

OUT = "rec long, twice double"


def run(spark, tmp_path, calls, name="c"):
    def convert(rows):
        calls.append(1)
        return rows.select("rec", (F.col("x") * 2).alias("twice"))

    read = lambda path: spark.read.schema("rec long, x double").parquet(path)
    streams.convert_as_they_come(spark, str(tmp_path / "in"), convert, read, str(tmp_path / "out"), str(tmp_path / name), 2).awaitTermination()
    return sorted(tuple(r) for r in streams.published(spark, str(tmp_path / "out"), OUT).collect())


def put(spark, tmp_path, name, rows):
    spark.createDataFrame(rows, "rec long, x double").coalesce(1).write.parquet(str(tmp_path / "made" / name))
    (tmp_path / "in").mkdir(exist_ok=True)
    next((tmp_path / "made" / name).glob("part-*.parquet")).rename(tmp_path / "in" / f"{name}.parquet")


def test_a_broken_file_and_a_restart(spark, tmp_path):
    calls = []
    put(spark, tmp_path, "a", [(1, 1.0), (2, 2.0)])
    put(spark, tmp_path, "b", [(3, 3.0)])
    (tmp_path / "in" / "broken.parquet").write_text("no parquet")
    first = run(spark, tmp_path, calls)
    assert first == [(1, 2.0), (2, 4.0), (3, 6.0)]
    states = {r.file.rsplit("/", 1)[1]: (r.state, bool(r.error)) for r in streams.ledger(spark, str(tmp_path / "out")).collect()}
    assert states == {"a.parquet": ("done", False), "b.parquet": ("done", False), "broken.parquet": ("failed", True)}
    put(spark, tmp_path, "c", [(4, 4.0)])
    made = len(calls)
    assert run(spark, tmp_path, calls) == [*first, (4, 8.0)] and len(calls) == made + 1
    # a lost checkpoint offers all files again: those that are done stay as they are, the broken one is tried again
    (tmp_path / "in" / "broken.parquet").unlink()
    put(spark, tmp_path, "broken", [(5, 5.0)])
    made = len(calls)
    assert run(spark, tmp_path, calls, "other") == [*first, (4, 8.0), (5, 10.0)] and len(calls) == made + 1


def test_sources_that_grow_are_mixed_by_their_weights(spark, tmp_path):
    schema, size = "id long", [0, 0]

    def grow(source, n):
        start = source * 10_000 + size[source]
        size[source] += n
        spark.range(start, start + n).coalesce(2).write.mode("append").parquet(str(tmp_path / f"s{source}"))

    def run_once():
        read = [spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / f"s{k}")) for k in (0, 1)]
        streams.mix_as_they_come(read, [3.0, 1.0], "id", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return [(r.source, r.id) for r in streams.mix(spark, str(tmp_path / "out"), "id long, source int, place double").orderBy("place", "source").collect()]

    grow(0, 300)
    grow(1, 100)
    first = run_once()
    assert len(first) == len(set(first)) == 400 and all(abs(sum(s == 0 for s, _ in first[:n]) - 0.75 * n) <= 2 for n in range(400))
    grow(0, 90)
    grow(1, 200)
    again = run_once()
    assert again[:400] == first and sorted(i for s, i in again if s == 1) == list(range(10_000, 10_300)) and len(set(again)) == 690
    assert all(abs(sum(s == 0 for s, _ in again[:n]) - 0.75 * n) <= 2 for n in range(520)) and {s for s, _ in again[-150:]} == {1}
    assert run_once() == again


def test_nothing_published_yet(spark, tmp_path):
    assert streams.published(spark, str(tmp_path / "none"), OUT).count() == 0


@pytest.mark.parametrize("groups", [1, 5])
def test_recordings_of_one_group_are_cut_apart(spark, tmp_path, groups):
    """Open episodes of many recordings, one of them null, are followed together over batches and come out as if each were alone."""
    draw = random.Random(3)
    rows, want = [], []
    for rec in [None, *range(20)]:
        t = 1000.0
        for _ in range(4):
            n = draw.randint(1, 6)
            times = [t + k for k in range(n)]
            rows += [(rec, len(rows) + k, s, 3.0 * k, 4.0 * k) for k, s in enumerate(times)]
            want.append((-1 if rec is None else rec, times[0], times[-1], n, 5.0 * (n - 1)))
            t = times[-1] + draw.randint(11, 30)
    for k in range(3):
        some = [r for r in rows if min(2, int((r[2] - 1000) // 30)) == k]
        spark.createDataFrame(some, "rec long, event_id long, t double, x double, y double").selectExpr("rec", "event_id", "timestamp_micros(cast(t * 1e6 as bigint)) as ts", "x", "y").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.sql("select 99L as rec, -1L as event_id, timestamp_seconds(100000) as ts, 0d as x, 0d as y").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = streams.live_episodes(streams.pose_stream(spark, str(tmp_path / "in")), 100.0, 10.0, "1 second", groups)
    out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(out.schema).parquet(str(tmp_path / "out")).na.fill({"rec": -1}).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
