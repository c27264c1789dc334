"""A training corpus from raw documents: language, near-duplicates, benchmark leaks, personal data, packing.

Defined cases: documents with null text, or none of whose characters are letters, have no language and go in the first
stage; those without an id are compared with none in the second and stay; rows that repeat an id become one document
there; of documents that are alike the least id stays; very long texts are taken whole; an empty table goes through every stage
and gives an empty result; extra columns stay up to the last stage, whatever their names, as they stood (n_chars is
counted anew where personal data was replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import decontam, langid, omh, packing, pii
from wayfold.llm.common import materialize

#: SQL cannot express tokenizers, trained models or alignments; tests hold the stages against brute force.
ORACLE_SQL = None

#: Least share of the best language after tempering; text that no language explains better than others falls below it.
LEAST_LANGUAGE_SCORE = 0.5

#: Executors have served four stages before they pack, so packing keeps fewer words and takes fewer texts together than alone.
PACKING_CACHE, PACKED_TOGETHER = 100_000, 500


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without letters or without a clear language go."""
    model = langid.fit(docs.filter(~langid.held_out()), F.col("doc_id"))
    return materialize(langid.accepted(docs, model, LEAST_LANGUAGE_SCORE), "language")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each class of near-duplicates."""
    return omh.deduplicated(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of test items."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced by its kind."""
    return materialize(pii.redact(docs), "redacted")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, placed in sequences of 4096 tokens."""
    return packing.pack(docs, cache=PACKING_CACHE, together=PACKED_TOGETHER)


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("PII", redact_personal_data),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other, each over all that its predecessor kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
