"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


BATCHES, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or one of our own where that is unset and everything runs on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage is cut, and lost executors cost no recomputation.

    For this write alone, texts go to Python in batches of so many rows, so that long ones take a bounded memory.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCHES)
    try:
        spark.conf.set(BATCHES, batch_rows)
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCHES, before)
    return spark.read.schema(df.schema).parquet(path)


SLICE_ROWS, SLICE_BYTES = 1000, 16 << 20


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of at most so many rows, fewer where rows are long, so that texts are Python objects a few at a time."""
    for batch in batches:
        size = max(1, min(rows, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes)))
        for first in range(0, batch.num_rows, size):
            yield batch.slice(first, size)


#: Characters of texts that are taken together where arrays are made of all their words.
TOGETHER = 4 << 20


def in_groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts in a row of about TOGETHER characters at most, or one longer one."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text or "") > TOGETHER:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text or "")
    if group:
        yield group


def tokenizer_path(name: str) -> str:
    return public_tokenizers.path(name)


def arrow_schema(fields: list[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema([pa.field(n, t) for n, t in fields])


class Memo(dict):
    """A dict that computes what it lacks, and starts anew when it holds `limit` entries (so a worker's memory is bounded)."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.limit:
            self.clear()
        if len(key) <= 64:
            self[key] = value
        return value


_held: dict = {}


def claim(owner: str, release) -> None:
    """Says which operator's caches a Python worker holds; those of the operator before it are let go, so that a worker that serves several holds one's."""
    others = [x for x in _held if x != owner]
    for other in others:
        _held.pop(other)()
    _held[owner] = release
    if others:  # what was let go goes back to the machine
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)
