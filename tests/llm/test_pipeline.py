"""The stages one after the other against what each operator's plain version keeps."""

from pyspark.sql import functions as F

import corpus_pipeline
from wayfold.llm import decontam, omh, pii

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], SF))
    ids = [sorted(r.doc_id for r in f.select("doc_id").distinct().collect()) for f in frames]
    assert all(f.columns == docs.columns for f in frames[1:-1])
    assert len(ids[1]) >= 0.98 * len(ids[0])
    classes = {r.doc_id: r.class_id for r in omh.near_duplicates(frames[1]).collect()}
    assert ids[2] == sorted(set(classes.values()))
    leaks = {r.doc_id for r in decontam.find(frames[2], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert leaks and ids[3] == sorted(set(ids[2]) - leaks) and ids[4] == ids[3] == ids[5]
    assert all(not [x for x in pii.spans(r.text) if x[0] < 4] for r in frames[4].collect())


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"] and out.count() > 0


def test_odd_rows(spark, docs):
    frame = docs
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SF)
    assert set(frame.select("doc_id").distinct().toPandas().doc_id) <= {3, 4, 6, 7, 8}


def test_empty_table(docs):
    frame = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        columns, frame = frame.columns, stage(docs.sparkSession, frame, SF)
        assert frame.count() == 0 and (name == "best-fit packing" or frame.columns == columns)


def test_repeated_rows_and_missing_ids(spark, corpus):
    rows = corpus.limit(40)
    lost = rows.limit(3).withColumn("doc_id", F.lit(None).cast(corpus.schema["doc_id"].dataType))
    frame = rows.unionByName(rows).unionByName(lost)
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SF)
    placed = [tuple(r) for r in frame.select("doc_id", "piece").collect()]
    known = [p for p in placed if p[0] is not None]
    assert known and len(known) == len(set(known)) and len([p for p in placed if p == (None, 0)]) == 3
