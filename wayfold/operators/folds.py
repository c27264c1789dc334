"""Work that goes through the frames of a sequence in order, with a state in hand.

Rows are dealt by key and sorted; tasks go through them batch by batch and hold one frame and the state, so a sequence of any
length takes a bounded memory.  A key's frames depend on each other, so a key is one task: keys should be pieces between gaps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Row = dict
Step = Callable[[object, list[Row]], tuple[object, list[Row]]]
#: The same for frames of many rows, which stay columns.
BatchStep = Callable[[object, pa.RecordBatch], tuple[object, pa.RecordBatch]]
#: Partitions that keys are dealt to, at least.
KEY_PARTS = 200


def fold(rows: DataFrame, keys: list[str], frame: str, begin: Callable[[], object], step: Step, schema: StructType, then: list[str] = ()) -> DataFrame:
    """What `step` gives for each frame: it takes the state and the frame's rows, and gives the new state and rows of the schema.

    begin: the state before a key's first frame; then: order of rows within a frame.
    """
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, frame, *then)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key, at, held = None, None, None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                here, now = tuple(row[k] for k in keys), row[frame]
                if held and (here != key or now != at):
                    state, found = step(state, held)
                    out += found
                    held = []
                if here != key:
                    state, key = begin(), here
                at = now
                held.append(row)
            yield pa.RecordBatch.from_pylist(out, arrow)
        if held:
            yield pa.RecordBatch.from_pylist(step(state, held)[1], arrow)

    return dealt.mapInArrow(run, schema)


def fold_columns(rows: DataFrame, keys: list[str], frame: str, begin: Callable[[], object], step: BatchStep, schema: StructType, then: list[str] = ()) -> DataFrame:
    """fold() with a `step` that takes the frame's rows as one Arrow batch and gives a batch of the schema's columns.

    The number of partitions is given, and large, so that a few keys do not share a task: Spark would put small partitions together.
    """
    parts = max(KEY_PARTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(parts, *keys).sortWithinPartitions(*keys, frame, *then)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key, here, held = None, None, None, []
        for batch in batches:
            out, begun = [], 0
            places = list(zip(*(batch.column(c).to_pylist() for c in (*keys, frame))))
            for i, place in enumerate(places):
                if place == here:
                    continue
                if i > begun:
                    held.append(batch.slice(begun, i - begun))
                if held:
                    state, found = step(state, _joined(held))
                    out.append(found)
                if here is None or place[:-1] != key:
                    state, key = begin(), place[:-1]
                here, held, begun = place, [], i
            if len(places) > begun:
                held.append(batch.slice(begun))
            if out:
                yield _cast(_joined(out), arrow)
        if held:
            yield _cast(step(state, _joined(held))[1], arrow)

    return dealt.mapInArrow(run, schema)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    some = [b for b in batches if b.num_rows] or batches[:1]
    return some[0] if len(some) == 1 else pa.Table.from_batches(some).combine_chunks().to_batches()[0]


def _cast(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema)], schema=schema)
