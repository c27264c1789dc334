"""Selection of a balanced set: quotas of classes that share caps of recordings, spacing in time and a cap of one environment."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import cut_lineage


@dataclass
class Taken:
    """What has been taken so far: at most the sum of the quotas, so it is kept on the driver."""

    ids: list = field(default_factory=list)
    spots: list[tuple] = field(default_factory=list)  # (segment, t)
    per_recording: dict = field(default_factory=dict)
    capped: int = 0

    def add(self, row, environment: str) -> None:
        self.ids.append(row["id"])
        self.spots.append((row["segment"], row["t"]))
        self.per_recording[row["recording"]] = self.per_recording.get(row["recording"], 0) + 1
        self.capped += row["environment"] == environment


def quota_selection(candidates: DataFrame, quotas: dict[str, int], per_recording: int, spacing: float, capped: str, most_capped: int, fresh: float = 0.5) -> DataFrame:
    """(id, place) of the candidates taken, by going through the classes from the smallest quota on and taking the best one left, again and again.

    candidates: (id, klass, recording, segment, t, environment, score).  A candidate's worth is its score and `fresh` divided by
    one more than what its recording has given already; ties go to the least id.  It can't be taken once its recording has given
    `per_recording`, nor within `spacing` of one taken from its segment, nor, in environment `capped`, once `most_capped` of those are taken.

    What one recording gives depends on no other, until the capped environment is full.  So each recording's candidates of a class
    are put in the order in which it would give them, best first, one aggregation for each that it may give; worth falls along
    that order, so the class takes the best rows of all the orders together.  When the environment fills up, the rest of the class
    is ordered once more.  Rounds depend on classes and caps, not on rows, and no task holds a recording.
    """
    pool, taken = cut_lineage(candidates, "pool"), Taken()
    for klass, quota in sorted(quotas.items(), key=lambda q: (q[1], q[0])):
        wanted = quota
        while wanted:
            full = taken.capped >= most_capped
            usable = pool.filter((F.col("klass") == klass) & (F.lit(True) if not full else ~F.col("environment").eqNullSafe(capped)))
            best = _offers(usable, taken, per_recording, spacing, fresh).orderBy(F.col("worth").desc(), "id").limit(wanted).collect()  # at most the quota
            for row in best:
                if row["environment"] == capped and taken.capped >= most_capped:
                    break  # from here on recordings offer others
                taken.add(row, capped)
                wanted -= 1
            else:
                break
    kind = candidates.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("place", T.IntegerType())])
    return candidates.sparkSession.createDataFrame([(i, k) for k, i in enumerate(taken.ids, 1)], schema)


def _offers(pool: DataFrame, taken: Taken, per_recording: int, spacing: float, fresh: float) -> DataFrame:
    """(id, recording, segment, t, environment, worth) of what each recording would give, in its own order."""
    spark = pool.sparkSession
    given = _local(spark, list(taken.per_recording.items()), [pool.schema["recording"].dataType, T.IntegerType()], ["recording", "given"])
    left = _apart(pool, _local(spark, taken.spots, [pool.schema["segment"].dataType, pool.schema["t"].dataType], ["segment", "at"]), spacing)
    if taken.ids:
        left = left.join(_local(spark, [(i,) for i in taken.ids], [pool.schema["id"].dataType], ["id"]), "id", "left_anti")
    left = cut_lineage(left.join(given, "recording", "left").withColumn("given", F.coalesce("given", F.lit(0))).filter(F.col("given") < per_recording), "left")
    out = None
    for k in range(per_recording):
        row = F.struct("id", "segment", "t", "environment", "score", "given")
        first = left.groupBy("recording").agg(F.min_by(row, F.struct(-F.col("score"), "id")).alias("r")).select("recording", "r.*").filter(F.col("given") + k < per_recording)
        first = cut_lineage(first.withColumn("worth", F.col("score") + fresh / (1 + F.col("given") + k)), "offers")
        out = first if out is None else out.unionByName(first)
        if k + 1 < per_recording:
            spots = first.select("segment", F.col("t").alias("at"))
            left = cut_lineage(_apart(left, spots, spacing).join(first.select("id"), "id", "left_anti"), "left")
    return out


def _apart(rows: DataFrame, spots: DataFrame, spacing: float) -> DataFrame:
    """Rows (id, segment, t) that lie at least so far from all spots (segment, at) of their segment; spots are placed in buckets of time."""
    bucket = F.floor(F.col("at") / spacing)
    near = spots.select("segment", "at", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"))
    close = rows.select("id", "segment", "t", F.floor(F.col("t") / spacing).alias("_b")).join(near, ["segment", "_b"]).filter(F.abs(F.col("t") - F.col("at")) < spacing).select("id").distinct()
    return rows.join(close, "id", "left_anti")


def _local(spark, rows: list[tuple], kinds: list, names: list[str]) -> DataFrame:
    return spark.createDataFrame(rows, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]))
