"""Readers and writers over small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from wayfold.sources import tables as T


def put(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, value in files.items():
        (folder / name.replace("__", ".")).write_text(value if isinstance(value, str) else json.dumps(value))
    return str(folder)


def test_predictions(spark, tmp_path):
    path = put(tmp_path / "p", a__json={"s1": [[0, 1], [2, 3]], "s2": []})
    assert [tuple(r) for r in T.predictions(spark, path).orderBy("k").collect()] == [("s1", 0, 0.0, 1.0), ("s1", 1, 2.0, 3.0)]


def test_metric_log(spark, tmp_path):
    lines = ['{"run": "a", "step": 1, "val_loss": 3.0}', "broken {", '{"run": "a", "step": 2, "val_loss": 9.0, "val_loss_trajectory": 2.0}', '{"run": "a", "step": 3, "val_loss": 2.0}']
    assert [tuple(r) for r in T.best_entry(T.metric_log(spark, put(tmp_path / "l", a__json="\n".join(lines)))).collect()] == [("a", 2, 2.0)]


def test_box_labels_and_poses(spark, tmp_path):
    box = {"instanceId": "P:1", "classId": "Pedestrian", "cX": 1.0, "cY": 2.0, "cZ": 0.5, "l": 0.5, "w": 0.5, "h": 1.7, "y": 0.1, "labelAttributes": {"isOccluded": "None"}}
    rows = T.box_labels(spark, put(tmp_path / "b", x_3_17__json={"3dbbox": [box, box]})).collect()
    assert len(rows) == 2 and (rows[0].sequence, rows[0].frame_idx, rows[0].cX) == (3, 17, 1.0)
    a, b = put(tmp_path / "dense", **{"1__txt": "0.0 1 0 0 1 0 0 0"}), put(tmp_path / "sparse", **{"1__txt": "0.0 9 0 0 1 0 0 0", "2__txt": "0.5 5 0 0 1 0 0 0"})
    assert sorted((r.sequence, r.x) for r in T.pose_text(spark, a, b).collect()) == [(1, 1.0), (2, 5.0)]


def test_label_frames_and_links(spark, tmp_path):
    labels = put(tmp_path / "labels", s1__json={"f1": [{"label_id": "p", "x": 1.0, "y": 2.0}], "f2": []}, s2__json={"f1": []})
    odo, other = put(tmp_path / "odo", s1__json={"f1": [0.0, 1.0]}), put(tmp_path / "other", s1__json={"f1": [9.0]}, s2__json={"f1": [2.0]})
    stamps = put(tmp_path / "t", s1__json={"f1": 0.5, "f2": 0.6}, s2__json={"f1": 0.7})
    assert sorted((r.sequence, r.frame, r.pose[0], r.t) for r in T.label_frames(spark, labels, odo, other, stamps).collect()) == [("s1", "f1", 0.0, 0.5), ("s2", "f1", 2.0, 0.7)]
    samples = spark.createDataFrame([("a", "s", 1, "b"), ("b", "s", 2, "c"), ("c", "s", 3, "")], "token string, scene_token string, timestamp long, next string")
    assert [(r.token, r.place, r.linked) for r in T.linked_samples(samples).orderBy("place").collect()] == [("a", 0, True), ("b", 1, True), ("c", 2, True)]


def test_episodes_json(spark, tmp_path):
    folder = tmp_path / "e"
    folder.mkdir()
    value = {"episodes": [{"episode_id": "1", "scene_id": "x/h1.glb", "object_category": "bed"}, {"episode_id": "2", "scene_id": "x/h1.glb", "object_category": "sofa"}], "goals_by_category": {"h1.glb_bed": [{"position": [1.0, 2.0, 3.0]}]}}
    goals = {"h2.glb_bed": [{"position": [4.0, 5.0, 6.0]}], "h2.glb_sofa": [{"position": [7.0, 8.0, 9.0]}]}
    other = {"episodes": [{"episode_id": str(k), "scene_id": "x/h2.glb", "object_category": "bed" if k % 2 else "sofa"} for k in range(3, 8)], "goals_by_category": goals}
    for name, content in (("h1", value), ("h2", other)):
        with gzip.open(folder / f"{name}.json.gz", "wt") as f:
            json.dump(content, f)
    got = {r.episode_id: r.goals[0].position for r in T.episodes_json(spark, str(folder)).collect()}
    assert got == {"1": [1.0, 2.0, 3.0]} | {str(k): [4.0, 5.0, 6.0] if k % 2 else [7.0, 8.0, 9.0] for k in range(3, 8)}


def test_scan_split_and_defaults(spark, tmp_path):
    spark.range(3).selectExpr("cast(id as string) episode_id").coalesce(1).write.parquet(str(tmp_path / "w"))
    part = next((tmp_path / "w").glob("part-*.parquet"))
    (tmp_path / "d").mkdir()
    part.rename(tmp_path / "d" / "train-0.parquet")
    assert T.scan_split(spark, str(tmp_path / "d"), "train", "episode_id string").count() == 3
    assert T.scan_split(spark, str(tmp_path / "d"), "test", "episode_id string").count() == 0
    assert T.with_defaults(spark.range(1), {"task": F.lit("pointgoal"), "id": F.lit(9)}).first().asDict() == {"id": 0, "task": "pointgoal"}


def test_writers(spark, tmp_path):
    sizes = spark.createDataFrame([("train", f"e{k}", 40) for k in range(6)], "split string, episode_id string, bytes long")
    shards = T.episode_shards(sizes, 100)
    assert [r.shard for r in shards.orderBy("episode_id").collect()] == [0, 0, 0, 1, 1, 2]
    frames = spark.createDataFrame([(f"e{k}", j) for k in range(6) for j in range(3)], "episode_id string, frame_index int")
    T.write_episode_shards(frames, shards, str(tmp_path / "f"))
    back = spark.read.parquet(str(tmp_path / "f")).withColumn("file", F.col("_metadata.file_path"))
    assert back.count() == 18 and back.groupBy("episode_id").agg(F.count_distinct("file").alias("n")).filter("n > 1").count() == 0
    T.write_sorted_shards(spark.range(10).withColumn("split", F.lit("a")), str(tmp_path / "s"), "id", 4, "split")
    assert max(r.n for r in spark.read.parquet(str(tmp_path / "s")).groupBy(F.col("_metadata.file_path")).agg(F.count("*").alias("n")).collect()) <= 4
    T.write_json_lines(spark.createDataFrame([(1, float("nan")), (2, 0.5)], "id int, v double"), str(tmp_path / "j"))
    assert {r.id: r.v for r in spark.read.schema("id int, v double").json(str(tmp_path / "j")).collect()} == {1: None, 2: pytest.approx(0.5)}


def test_shards_of_many_episodes_in_ranges(spark):
    rows = [(split, f"e{k:04d}", 10 + (k * 37) % 90) for split in ("a", "b") for k in range(300)]
    got = {(r.split, r.episode_id): r.shard for r in T.episode_shards(spark.createDataFrame(rows, "split string, episode_id string, bytes long"), 500).collect()}
    for split in ("a", "b"):
        before = 0
        for s, e, n in sorted(r for r in rows if r[0] == split):
            assert got[s, e] == before // 500
            before += n


def test_reduced_publication(spark, tmp_path):
    frames = spark.createDataFrame([(f"e{e}", f, float(f), bytes(200)) for e in range(6) for f in range(10)], "episode_id string, frame_index int, timestamp double, image binary")
    episodes = spark.createDataFrame([(f"e{e}", "train" if e % 2 else "test", e) for e in range(6)], "episode_id string, split string, extra int")
    samples = spark.createDataFrame([("e1", 4), ("e2", 5), ("e3", 9)], "episode_id string, frame_index int")
    views = spark.createDataFrame([(e, f + d) for e, f in (("e1", 4), ("e2", 5), ("e3", 9)) for d in (-2, 0, 0, 50)], "episode_id string, frame_index int")
    T.publish_reduced(samples, views, frames, episodes, str(tmp_path / "p"), 1500)
    back = spark.read.parquet(str(tmp_path / "p/frames")).withColumn("file", F.col("_metadata.file_path"))
    assert {(r.episode_id, r.frame_index) for r in back.filter("image is not null").collect()} == {("e1", 2), ("e1", 4), ("e2", 3), ("e2", 5), ("e3", 7), ("e3", 9)}
    assert back.count() == 30 and back.groupBy("episode_id").agg(F.count_distinct("file").alias("n")).filter("n > 1").count() == 0
    assert {r.episode_id for r in spark.read.parquet(str(tmp_path / "p/episodes")).collect()} == {"e1", "e2", "e3"} and spark.read.parquet(str(tmp_path / "p/samples")).count() == 3


def test_regrouped_by_sequence(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(s, k) for s in range(4)], "seq int, v int").write.mode("append").parquet(str(tmp_path / "batches"))
    T.regroup(spark.read.parquet(str(tmp_path / "batches")), "seq", str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).withColumn("file", F.col("_metadata.file_path"))
    assert back.count() == 12 and back.groupBy("seq").agg(F.count_distinct("file").alias("n")).filter("n <> 1").count() == 0


def test_annotation_set(spark, tmp_path):
    turn, at = [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0]
    folder = put(
        tmp_path / "n",
        sample__json=[{"token": "s1", "scene_token": "c", "timestamp": 1, "prev": "", "next": "s2"}, {"token": "s2", "scene_token": "c", "timestamp": 2, "prev": "s1", "next": ""}],
        sample_data__json=[{"token": f"d{k}", "sample_token": s, "ego_pose_token": f"p{k}", "calibrated_sensor_token": c, "is_key_frame": key, "filename": f"f{k}"} for k, (s, c, key) in enumerate([("s1", "l", True), ("s1", "l", False), ("s1", "cam", True), ("s2", "l", True)])],
        ego_pose__json=[{"token": f"p{k}", "translation": [float(k), 0.0, 0.0], "rotation": turn, "timestamp": k} for k in range(4)],
        calibrated_sensor__json=[{"token": "l", "sensor_token": "x", "translation": at, "rotation": turn}, {"token": "cam", "sensor_token": "y", "translation": at, "rotation": turn}],
        sensor__json=[{"token": "x", "channel": "LIDAR"}, {"token": "y", "channel": "CAM"}],
        sample_annotation__json=[{"token": "a1", "sample_token": "s1", "instance_token": "i1", "translation": at, "size": [1.0, 2.0, 3.0], "rotation": turn, "num_lidar_pts": 4}],
        instance__json=[{"token": "i1", "category_token": "k1"}],
        category__json=[{"token": "k1", "name": "human.pedestrian"}],
    )
    samples, boxes = T.annotated_samples(T.annotation_set(spark, folder), "LIDAR")
    assert [(r.sample_token, r.filename, r.ego_at[0]) for r in samples.orderBy("timestamp").collect()] == [("s1", "f0", 0.0), ("s2", "f3", 3.0)]
    assert [(r.sample_token, r.instance_token, r.category, r.timestamp) for r in boxes.collect()] == [("s1", "i1", "human.pedestrian", 1)]


def test_room_polygons(spark, tmp_path):
    corners = [{"x": 0.0, "y": 0.0, "z": 0.0}] * 3
    folder = put(tmp_path / "r", h1__json={"region_annotations": [{"label": "hall", "poly_loop": corners, "floor_height": 0.5}, {"label": "line", "poly_loop": corners[:2], "floor_height": 0.0}]})
    assert [(r.scene, r.label, len(r.poly_loop), r.floor_height) for r in T.room_polygons(spark, folder).collect()] == [("h1", "hall", 3, 0.5)]


def test_frames_and_episodes(spark, tmp_path):
    frames = spark.createDataFrame([(f"e{e}", f) for e in range(4) for f in range(5)], "episode_id string, frame_index int")
    episodes = spark.createDataFrame([(f"e{e}", e) for e in range(3)], "episode_id string, n int")
    T.write_frames_and_episodes(frames, episodes, str(tmp_path / "t"), "train", 4)
    got, kept = T.frames_and_episodes(spark, str(tmp_path / "t"), "train", "episode_id string, frame_index int", "episode_id string, n int")
    assert got.count() == 15 and kept.count() == 3
    assert all(x.count() == 0 for x in T.frames_and_episodes(spark, str(tmp_path / "t"), "test", "episode_id string, frame_index int", "episode_id string, n int"))
