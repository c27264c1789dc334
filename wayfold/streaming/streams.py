"""Streams: episodes from live poses, rolling best values, incremental conversion, mixed sources."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.scans import running

POSES = "rec long, event_id long, ts timestamp, x double, y double"
#: Groups of recordings that are followed together.
GROUPS = 4096


def pose_stream(spark: SparkSession, folder: str, schema: str = POSES, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of pose rows in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def sessions(poses: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of each recording: rows no further apart than the gap; rows later than the watermark are dropped."""
    return poses.withWatermark("ts", late).groupBy("rec", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"), F.min("x").alias("x_min"), F.max("x").alias("x_max")).select("rec", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "x_min", "x_max")


def live_episodes(poses: DataFrame, max_step: float, max_gap_s: float, late: str, groups: int = GROUPS) -> DataFrame:
    """Episodes that are over: cut at jumps and gaps as the batch operator does, kept per recording between batches.

    Rows of a batch are put in order of time; a row older than the last one seen of its recording is left out.  The state
    is one open episode a recording; it comes out once the watermark is past the gap after its last row.  Recordings are dealt to
    so many groups, whose open episodes are kept and gone through together, as a call a recording costs more than its rows.
    """
    held = {"rec": np.int64, "known": bool, "t0": float, "t1": float, "x": float, "y": float, "n": np.int64, "length": float}
    columns = ["t0", "t1", "n", "length"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getOption or [[] for _ in held]
        old = {c: np.array([np.nan if v is None else v for v in now[k]], kind) for k, (c, kind) in enumerate(held.items())}
        parts = [] if state.hasTimedOut else list(batches)
        new = {c: np.concatenate([np.empty(0), *(p[c].to_numpy(float) for p in parts)]) for c in ("t", "x", "y")}
        count = [len(old["t1"]), len(new["t"])]
        rec, known = (np.concatenate([old[c], *(p[c].to_numpy(held[c]) for p in parts)]) for c in ("rec", "known"))
        t, x, y = (np.concatenate([o, new[c]]) for c, o in (("t", old["t1"]), ("x", old["x"]), ("y", old["y"])))
        ids = np.concatenate([np.zeros(count[0], np.int64), *(p["event_id"].to_numpy() for p in parts)])
        fresh = np.repeat([False, True], count)
        t0, n, hop = np.concatenate([old["t0"], new["t"]]), np.concatenate([old["n"], np.ones(count[1], np.int64)]), np.concatenate([old["length"], np.zeros(count[1])])
        order = np.lexsort((ids, t, fresh, rec, known))  # what is open of a recording comes before its rows
        rec, known, t, x, y, fresh, t0, n, hop = (v[order] for v in (rec, known, t, x, y, fresh, t0, n, hop))
        starts = np.concatenate([[True], (rec[1:] != rec[:-1]) | (known[1:] != known[:-1])])[: len(t)]
        head = np.maximum.accumulate(np.where(starts, np.arange(len(t)), 0))
        kept = ~fresh | fresh[head] | (t >= t[head])
        rec, known, t, x, y, t0, n, hop, starts = (v[kept] for v in (rec, known, t, x, y, t0, n, hop, starts))
        if len(t):
            step, gap = np.hypot(np.diff(x), np.diff(y)), np.diff(t)
            cut = np.concatenate([[False], (step > max_step) | (gap > max_gap_s)]) | starts
            hop = hop + np.where(cut, 0.0, np.nan_to_num(np.concatenate([[0.0], step])))
            first = np.flatnonzero(cut)
            last = np.append(first[1:], len(t)) - 1
            found = {"rec": rec[first], "known": known[first], "t0": t0[first], "t1": t[last], "x": x[last], "y": y[last], "n": np.add.reduceat(n, first), "length": np.add.reduceat(hop, first)}
            mark = state.getCurrentWatermarkMs()
            due = np.floor((found["t1"] + max_gap_s) * 1000)
            is_open = np.append(starts[first[1:]], True) & ~(due < mark)
            over = ~is_open
            if is_open.any():
                state.update(tuple(found[c][is_open].tolist() for c in held))
                soonest = np.nanmin(np.append(due[is_open], np.inf))
                state.setTimeoutTimestamp(max(int(soonest) if np.isfinite(soonest) else 0, mark + 1))
            elif state.exists:
                state.remove()
            if over.any():
                yield pd.DataFrame({"rec": pd.arrays.IntegerArray(found["rec"][over], ~found["known"][over]), **{c: found[c][over] for c in columns}})

    rows = poses.withWatermark("ts", late).withColumn("t", F.unix_micros("ts") / 1e6)
    rows = rows.withColumns({"g": F.pmod(F.xxhash64("rec"), F.lit(groups)), "known": F.col("rec").isNotNull(), "rec": F.coalesce("rec", F.lit(0))})
    kept = "rec array<long>, known array<boolean>, t0 array<double>, t1 array<double>, x array<double>, y array<double>, n array<long>, length array<double>"
    return rows.groupBy("g").applyInPandasWithState(run, "rec long, t0 double, t1 double, n long, length double", kept, "append", GroupStateTimeout.EventTimeTimeout)


def rolling_best(log: DataFrame) -> DataFrame:
    """Step and value of the least loss of each run so far (complete mode), the earliest on ties."""
    return log.groupBy("run").agg(F.min(F.struct("loss", "step")).alias("b")).select("run", "b.step", "b.loss")


LEDGER = "file string, state string, error string"


def convert_as_they_come(spark: SparkSession, folder: str, convert: Callable[[DataFrame], DataFrame], read: Callable[[str], DataFrame], path: str, checkpoint: str, files_per_batch: int = 100):
    """Converts every new file once: its rows go to a folder of its own under path/data, and a ledger says what became of it.

    A file that fails is noted with its error and stops no other.  A restart takes up what the checkpoint had not finished; a
    file's folder is replaced when it is written again, and one that the ledger has as done is left alone, so nothing is
    published twice.  Returns the running query; published() reads what is done.
    """
    names = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).load(folder).select("path")

    def each(batch: DataFrame, number: int) -> None:
        done = {r["file"] for r in ledger(spark, path).filter("state = 'done'").join(batch.withColumnRenamed("path", "file"), "file", "left_semi").collect()}
        for name in sorted(r["path"] for r in batch.collect()):  # files_per_batch names
            if name in done:
                continue
            place = hashlib.sha1(name.encode()).hexdigest()
            try:
                convert(read(name)).write.mode("overwrite").parquet(f"{path}/data/file={place}")
                note = (name, "done", None)
            except Exception as e:  # a broken file is noted and stops no other
                note = (name, "failed", str(e).splitlines()[0][:300])
            spark.createDataFrame([note], LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/file={place}")

    return names.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """What became of each file so far."""
    return _read(spark, f"{path}/ledger/*", LEDGER)


def published(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all files that were converted."""
    done = [hashlib.sha1(r["file"].encode()).hexdigest() for r in ledger(spark, path).filter("state = 'done'").select("file").collect()]
    return spark.read.schema(schema).parquet(*(f"{path}/data/file={d}" for d in done)) if done else spark.createDataFrame([], schema)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path).select("*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def open_requests(requests: DataFrame, answers: DataFrame, key: str = "request_id") -> DataFrame:
    """Requests that have no answer yet."""
    return requests.join(answers.select(key).distinct(), key, "left_anti")


def mixed(sources: list[DataFrame]) -> DataFrame:
    """Several streams as one, each row with the number of its source."""
    out = sources[0].withColumn("source", F.lit(0))
    for k, s in enumerate(sources[1:], 1):
        out = out.unionByName(s.withColumn("source", F.lit(k)), allowMissingColumns=True)
    return out


def mix_as_they_come(streams: list[DataFrame], weights: list[float], key: str, path: str, checkpoint: str):
    """Merges growing sources in proportion to their weights: every row is written once, with its source and its place in the mix.

    A source's rows have places 1 / weight apart, in the order in which they come and, within a batch, in hashed order of key.
    So up to any place there are rows of each source by its weight, while it has some, and batches follow each other without a break.  A
    batch that is run again replaces what it wrote.  mix() reads the rows.
    """
    step = F.element_at(F.array(*(F.lit(1.0 / w) for w in weights)), F.col("source") + 1)

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _read(spark, f"{path}/counts", COUNTS).filter(F.col("batch") < number).groupBy("source").agg(F.sum("n").alias("_before"))
        numbered = running(batch.withColumn("_hash", F.xxhash64(key)), ["source"], ["_hash", key], total={"_n": F.lit(1)})
        placed = numbered.join(before, "source", "left").withColumn("place", (F.col("_n") + F.coalesce("_before", F.lit(0)) - 0.5) * step)
        placed.drop("_hash", "_n", "_before").write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        batch.groupBy("source").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/counts/batch={number}")

    return mixed(streams).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


COUNTS = "source int, n long, batch int"


def mix(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of the mix so far, to be read in order of place."""
    return _read(spark, f"{path}/rows", schema)
