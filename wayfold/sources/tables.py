"""Scans of recordings, labels, predictions and logs, and writers of shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geom import finite
from ..operators.lineage import cut_lineage

#: What a frame takes without its payload, in bytes.
FRAME_BYTES = 100

FRAMES = "episode_id string, frame_index int, source_frame int, timestamp double, pose array<double>, image binary"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pose rows: recording, frame, time in seconds, x, y and a kind."""
    events = table(spark, sf_dir, "events")
    in_time = Window.partitionBy("rec").orderBy("t", "event_id")
    return events.select(
        F.col("user_id").alias("rec"), "event_id", seconds(F.col("ts")).alias("t"), F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"), F.col("event_type").alias("kind"),
    ).withColumn("f", F.row_number().over(in_time) - 1)


def scan_split(spark: SparkSession, folder: str, split: str, schema: str) -> DataFrame:
    """Rows of the files <split>-*.parquet; an empty table where the folder has none."""
    try:
        return spark.read.schema(schema).parquet(f"{folder}/{split}-*.parquet").select("*")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Columns that older files lack, with a default."""
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})


def box_labels(spark: SparkSession, folder: str) -> DataFrame:
    """JSON box labels, one file a frame; sequence and frame from the file's name."""
    schema = "`3dbbox` array<struct<instanceId:string,classId:string,cX:double,cY:double,cZ:double,l:double,w:double,h:double,y:double,labelAttributes:struct<isOccluded:string>>>"
    name = F.col("_metadata.file_name")
    rows = spark.read.schema(schema).option("multiLine", True).json(folder).select("*", F.regexp_extract(name, r"_(\d+)_(\d+)\.json$", 1).cast("int").alias("sequence"), F.regexp_extract(name, r"_(\d+)_(\d+)\.json$", 2).cast("int").alias("frame_idx"))
    return rows.select("sequence", "frame_idx", F.inline("3dbbox"))


def pose_text(spark: SparkSession, preferred: str, fallback: str) -> DataFrame:
    """Space-separated pose files (t x y z qw qx qy qz), each sequence from the preferred folder where it has one."""
    schema = "t double, x double, y double, z double, qw double, qx double, qy double, qz double"
    read = lambda folder: spark.read.schema(schema).option("sep", " ").csv(folder).withColumn("sequence", F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.txt$", 1).cast("int"))
    first, second = read(preferred), read(fallback)
    return first.unionByName(second.join(first.select("sequence").distinct(), "sequence", "left_anti"))


def keyed_json(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """One table of a normalised annotation set, keyed by token."""
    return spark.read.schema(schema).option("multiLine", True).json(f"{folder}/{name}.json")


#: Columns that are read of each table of a normalised annotation set.
ANNOTATION_TABLES = {
    "sample": "token string, scene_token string, timestamp long, prev string, next string",
    "sample_data": "token string, sample_token string, ego_pose_token string, calibrated_sensor_token string, is_key_frame boolean, filename string",
    "ego_pose": "token string, translation array<double>, rotation array<double>, timestamp long",
    "calibrated_sensor": "token string, sensor_token string, translation array<double>, rotation array<double>",
    "sensor": "token string, channel string",
    "sample_annotation": "token string, sample_token string, instance_token string, translation array<double>, size array<double>, rotation array<double>, num_lidar_pts int",
    "instance": "token string, category_token string",
    "category": "token string, name string",
}


def annotation_set(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a normalised annotation set by name."""
    return {name: keyed_json(spark, folder, name, schema) for name, schema in ANNOTATION_TABLES.items()}


def annotated_samples(tables: dict[str, DataFrame], channel: str) -> tuple[DataFrame, DataFrame]:
    """(samples, boxes): every sample with file, pose and calibration of its key frame of a channel, and its boxes with instance and category."""
    named = lambda t, *columns: tables[t].select(F.col("token").alias(f"{t}_token"), *columns)
    sensors = named("calibrated_sensor", "sensor_token", F.col("translation").alias("sensor_at"), F.col("rotation").alias("sensor_turn")).join(named("sensor", "channel").filter(F.col("channel") == channel), "sensor_token")
    keys = tables["sample_data"].filter("is_key_frame").select("sample_token", "ego_pose_token", "calibrated_sensor_token", "filename")
    posed = keys.join(sensors.drop("sensor_token"), "calibrated_sensor_token").join(named("ego_pose", F.col("translation").alias("ego_at"), F.col("rotation").alias("ego_turn")), "ego_pose_token")
    samples = named("sample", "scene_token", "timestamp", "next").join(posed.drop("ego_pose_token", "calibrated_sensor_token"), "sample_token")
    instances = named("instance", "category_token").join(named("category", F.col("name").alias("category")), "category_token").drop("category_token")
    boxes = tables["sample_annotation"].select("sample_token", "instance_token", "translation", "size", "rotation", "num_lidar_pts").join(instances, "instance_token")
    return samples, boxes.join(samples.select("sample_token", "scene_token", "timestamp"), "sample_token")


def frames_and_episodes(spark: SparkSession, folder: str, split: str, frame_schema: str, episode_schema: str) -> tuple[DataFrame, DataFrame]:
    """The frames and episodes tables of a split; both empty where it has none, and frames without an episode left out."""
    frames, episodes = scan_split(spark, f"{folder}/frames", split, frame_schema), scan_split(spark, f"{folder}/episodes", split, episode_schema)
    return frames.join(episodes.select("episode_id").distinct(), "episode_id", "left_semi"), episodes


def write_frames_and_episodes(frames: DataFrame, episodes: DataFrame, folder: str, split: str, rows_per_file: int) -> None:
    """Writes both tables of a split in order, in files <split>-*.parquet of a bounded number of rows."""
    for name, rows, order in (("frames", frames, ["episode_id", "frame_index"]), ("episodes", episodes, ["episode_id"])):
        at = f"{folder}/{name}"
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", rows_per_file).mode("append").parquet(f"{at}/{split}-part.parquet")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """{id: [[x, y], ...]} as rows (id, k, x, y)."""
    text = spark.read.text(path, wholetext=True)
    paths = text.select(F.explode(F.from_json("value", "map<string,array<array<double>>>")).alias("id", "path"))
    return paths.select("id", F.posexplode("path").alias("k", "p")).select("id", "k", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def metric_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a growing log; broken lines are left out, the trajectory loss is preferred."""
    rows = spark.read.schema("run string, step long, val_loss double, val_loss_trajectory double").option("mode", "DROPMALFORMED").json(path)
    return rows.select("run", "step", F.coalesce("val_loss_trajectory", "val_loss").alias("loss")).filter("loss is not null")


def best_entry(log: DataFrame) -> DataFrame:
    """Step of the least loss of each run, the earliest on ties."""
    return log.groupBy("run").agg(F.min(F.struct("loss", "step")).alias("best")).select("run", "best.step", "best.loss")


def episodes_json(spark: SparkSession, folder: str) -> DataFrame:
    """Published episode files (gzipped JSON) with the view points of their goals; episodes without goals go."""
    schema = "episodes array<struct<episode_id:string,scene_id:string,object_category:string,start_position:array<double>>>, goals_by_category map<string,array<struct<position:array<double>>>>"
    files = spark.read.schema(schema).option("multiLine", True).json(folder).select("*", F.col("_metadata.file_path").alias("file"))
    episodes = files.select(F.explode("episodes").alias("e"), "file").select("file", "e.*")
    goals = files.select("file", F.explode("goals_by_category").alias("category", "goals"))
    key = F.concat_ws("_", F.element_at(F.split("scene_id", "/"), -1), "object_category")
    return episodes.withColumn("category", key).join(goals, ["file", "category"])


def room_polygons(spark: SparkSession, folder: str) -> DataFrame:
    """Room polygons with three corners or more, per scene."""
    schema = "region_annotations array<struct<label:string,poly_loop:array<struct<x:double,y:double,z:double>>,floor_height:double>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(folder).select(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1).alias("scene"), F.inline("region_annotations"))
    return rows.filter(F.size("poly_loop") >= 3)


def write_sorted_shards(df: DataFrame, path: str, key: str, rows_per_file: int, split: str | None = None) -> None:
    """Shards in order of a key with a bounded number of rows each."""
    writer = df.repartitionByRange(key).sortWithinPartitions(key).write.option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(split) if split else writer).parquet(path)


def episode_shards(sizes: DataFrame, most_bytes: int) -> DataFrame:
    """shard of each episode, so that a shard holds whole episodes: those that begin within most_bytes; sizes is (split, episode_id, bytes).

    So a shard is over most_bytes by less than its last episode.  The running sum is taken in ranges of the order, from the sums of the
    ranges before.
    """
    order = ["split", "episode_id"]
    parted = cut_lineage(sizes.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "sizes")
    ranges = parted.groupBy("split", "_p").agg(F.sum("bytes").alias("_sum"))
    before = ranges.select("split", "_p", (F.sum("_sum").over(Window.partitionBy("split").orderBy("_p")) - F.col("_sum")).alias("_before"))  # a row a range
    inside = F.sum("bytes").over(Window.partitionBy("split", "_p").orderBy("episode_id")) - F.col("bytes")
    at = parted.withColumn("_in", inside).join(before, ["split", "_p"]).withColumn("_at", F.col("_in") + F.col("_before"))
    return at.withColumn("shard", F.floor(F.col("_at") / most_bytes).cast("int")).select(*sizes.columns, "shard")


def write_episode_shards(frames: DataFrame, shards: DataFrame, path: str) -> None:
    """Frames of whole episodes, one file a shard, in order of episode and frame."""
    joined = frames.join(shards.select("split", "episode_id", "shard"), "episode_id")
    joined.repartition("split", "shard").sortWithinPartitions("episode_id", "frame_index").write.partitionBy("split", "shard").parquet(path)


def regroup(rows: DataFrame, key: str, path: str) -> None:
    """Outputs of many batches as one folder a sequence."""
    rows.repartition(key).write.mode("overwrite").partitionBy(key).parquet(path)


def publish_reduced(samples: DataFrame, views: DataFrame, frames: DataFrame, episodes: DataFrame, path: str, most_bytes: int) -> None:
    """Writes frames, episodes and samples of a kept set: all frames of its episodes, with the payload of those only that a sample needs.

    samples: (episode_id, frame_index, ...); views: (episode_id, frame_index) that they need; frames: (episode_id, frame_index, ..., image);
    episodes: (episode_id, split, ...).  Keys are worked out first; payload is read once, by joins on keys, and goes to shards of
    whole episodes that are balanced by its bytes.
    """
    kept = cut_lineage(episodes.join(samples.select("episode_id").distinct(), "episode_id", "left_semi"), "kept")
    needed = cut_lineage(views.select("episode_id", "frame_index").distinct().withColumn("_needed", F.lit(True)), "needed")
    whole = frames.join(kept.select("episode_id"), "episode_id", "left_semi").join(needed, ["episode_id", "frame_index"], "left")
    reduced = cut_lineage(whole.withColumn("image", F.when(F.col("_needed"), F.col("image"))).drop("_needed"), "reduced")
    sizes = reduced.groupBy("episode_id").agg(F.sum(F.coalesce(F.octet_length("image"), F.lit(0)) + FRAME_BYTES).alias("bytes")).join(kept.select("episode_id", "split"), "episode_id")
    write_episode_shards(reduced, episode_shards(sizes.select("split", "episode_id", "bytes"), most_bytes), f"{path}/frames")
    kept.write.partitionBy("split").parquet(f"{path}/episodes")
    samples.write.parquet(f"{path}/samples")


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines with non-finite numbers as null."""
    df.select(*(finite(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes)).write.json(path)


def label_frames(spark: SparkSession, labels: str, odometry: str, odometry_other: str, stamps: str) -> DataFrame:
    """Frames that have labels, odometry (from the first folder that has the sequence) and a timestamp, by frame name.

    Each folder holds one JSON map from frame name to value a sequence.
    """
    def read(folder: str, kind: str) -> DataFrame:
        text = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1).alias("sequence"), F.from_json("value", f"map<string,{kind}>").alias("m"))
        return text.select("sequence", F.explode("m").alias("frame", "v"))

    first, second = read(odometry, "array<double>"), read(odometry_other, "array<double>")
    chosen = first.unionByName(second.join(first.select("sequence").distinct(), "sequence", "left_anti")).withColumnRenamed("v", "pose")
    boxes = read(labels, "array<struct<label_id:string,x:double,y:double>>").withColumnRenamed("v", "boxes")
    return boxes.join(chosen, ["sequence", "frame"]).join(read(stamps, "double").withColumnRenamed("v", "t"), ["sequence", "frame"])


def linked_samples(samples: DataFrame, scene: str = "scene_token") -> DataFrame:
    """Samples of each scene in order: a sample's place by time is its place in the list that `next` spells out."""
    w = Window.partitionBy(scene).orderBy("timestamp", "token")
    out = samples.withColumns({"place": F.row_number().over(w) - 1, "_after": F.lead("token").over(w)})
    return out.withColumn("linked", F.col("next").eqNullSafe(F.coalesce("_after", F.lit("")))).drop("_after")
