"""Analysis of stored scores, features and rewards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import running

def auroc(rows: DataFrame, score: str, label: str, most: int | None = None) -> DataFrame:
    """AUROC by the rank statistic, accuracy at 0.5 and base rate.

    Counts per distinct score are summed along their order, in ranges of it where there are many, so that no task orders all rows.
    Scores may be any numbers.
    """
    per = rows.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    summed = running(per.withColumn("_all", F.lit(1)), ["_all"], ["s"], most, total={"upto": F.col("n")})
    ranked = summed.withColumn("rank", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2)
    total = ranked.agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").cast("double").alias("p"), F.sum("n").cast("double").alias("n"), F.sum(F.when(F.col("s") >= 0.5, F.col("pos")).otherwise(F.col("n") - F.col("pos"))).alias("right"))
    neg = F.col("n") - F.col("p")
    return total.select(F.when((F.col("p") > 0) & (neg > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * neg)).alias("auroc"), (F.col("right") / F.col("n")).alias("accuracy"), (F.col("p") / F.col("n")).alias("base_rate"))


def fit_quality(rows: DataFrame, pred: Column, target: str) -> DataFrame:
    """R2 and mean absolute error."""
    y = rows.select(F.col(target).cast("double").alias("y"), pred.alias("p"))
    out = y.agg(F.count("*").alias("n"), F.var_pop("y").alias("v"), F.avg(F.pow(F.col("y") - F.col("p"), 2)).alias("mse"), F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"))
    return out.select("n", F.when(F.col("v") > 0, 1 - F.col("mse") / F.col("v")).alias("r2"), "mae")


def decoded(pred: Column, how: str) -> Column:
    """A stored prediction in the target's own units: 'share' from a logit, 'count' from log1p, 'plain' as it is."""
    return {"share": 1 / (1 + F.exp(-pred)), "count": F.expm1(pred), "plain": pred}[how]


def probe_scores(rows: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """(keys, metres, r2) of predictions (keys, row, k, px, py, x, y): mean distance in units of scale, and the share of the variance of each k that is explained."""
    w = Window.partitionBy(*keys, "k")
    off = F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2)
    spread = F.pow(F.col("x") - F.avg("x").over(w), 2) + F.pow(F.col("y") - F.avg("y").over(w), 2)
    measured = rows.select(*keys, off.alias("off"), spread.alias("spread"))
    return measured.groupBy(*keys).agg((F.avg(F.sqrt("off")) * scale).alias("metres"), F.try_divide(F.sum(F.col("spread") - F.col("off")), F.sum("spread")).alias("r2"))


def advantages_over(rewards: DataFrame, reward: str, value: str) -> DataFrame:
    """Reward less the value that was expected, over all rows' deviation of that from its mean."""
    less = F.col(reward) - F.col(value)
    all_ = rewards.agg(F.avg(less).alias("m"), F.coalesce(F.stddev_samp(less), F.lit(0.0)).alias("sd")).first()  # two numbers
    return rewards.withColumn("advantage", (less - F.lit(all_["m"])) / F.lit((all_["sd"] or 0.0) + 1e-4))


def advantages(rewards: DataFrame, group: str, reward: str) -> DataFrame:
    """Reward less its group's mean over its group's standard deviation; 0 for a constant group."""
    w = Window.partitionBy(group)
    return rewards.withColumn("advantage", (F.col(reward) - F.avg(reward).over(w)) / (F.coalesce(F.stddev_samp(reward).over(w), F.lit(0.0)) + 1e-4))


def exploded(rows: DataFrame, vector: str) -> DataFrame:
    return rows.select("*", F.posexplode(vector).alias("k", "v")).drop(vector)


def standardised(train: DataFrame, rows: DataFrame, vector: str) -> DataFrame:
    """Rows' features by the training rows' means and standard deviations, as (.., k, v)."""
    stats = exploded(train, vector).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    return exploded(rows, vector).join(stats, "k").withColumn("v", (F.col("v") - F.col("m")) / (F.col("sd") + 1e-6)).drop("m", "sd")


def ridge(rows: DataFrame, vector: str, target: str, fold: str, lambdas: list[float]) -> DataFrame:
    """Ridge regression with the penalty that does best on the held-out rows (fold = 1).

    One pass sums the Gram matrices of both folds; the driver solves d x d systems only.
    """
    spark = rows.sparkSession
    x = F.concat(F.array(F.lit(1.0)), F.transform(vector, lambda v: v.cast("double")), F.array(F.col(target).cast("double")))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One Gram matrix a fold and task, as its upper triangle."""
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            folds, values = batch.column(0).to_numpy(zero_copy_only=False), np.array(batch.column(1).to_pylist(), float)
            for k in np.unique(folds):
                some = values[folds == k]
                total[int(k)] = total.get(int(k), 0.0) + some.T @ some
        for k, gram in total.items():
            i, j = np.triu_indices(len(gram))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(gram[i, j])], names=["fold", "i", "j", "s"])

    parts = rows.select(F.col(fold).cast("int").alias("fold"), x.alias("x")).mapInArrow(grams, "fold int, i int, j int, s double")
    sums = parts.groupBy("fold", "i", "j").agg(F.sum("s").alias("s")).collect()  # d squared rows
    d = 1 + max((r["j"] for r in sums), default=1)
    gram = {0: np.zeros((d, d)), 1: np.zeros((d, d))}
    for r in sums:
        gram[r["fold"]][r["i"], r["j"]] = gram[r["fold"]][r["j"], r["i"]] = r["s"]
    fit, held, out = gram[0], gram[1], []
    for lam in lambdas:
        penalty = np.eye(d - 1) * lam
        penalty[0, 0] = 0
        w = np.linalg.solve(fit[:-1, :-1] + penalty + 1e-12 * np.eye(d - 1), fit[:-1, -1])
        n, total = held[0, 0], held[-1, -1]
        sse = total - 2 * w @ held[:-1, -1] + w @ held[:-1, :-1] @ w
        sst = total - held[0, -1] ** 2 / n
        out.append((float(lam), float(1 - sse / sst), float(sse / n)))
    return spark.createDataFrame(out, "penalty double, r2 double, mse double").orderBy(F.desc("r2")).limit(1)


def with_references(best: DataFrame, references: DataFrame, keys: list[str], score: str) -> DataFrame:
    """The best entries and, marked, the reference rows (keys, entry, score) that they are read against, for every key that has an entry."""
    columns = [*keys, "entry", score, "reference"]
    return best.withColumn("reference", F.lit(False)).select(columns).unionByName(references.join(best.select(*keys), keys, "left_semi").withColumn("reference", F.lit(True)).select(columns))


def leaderboard(results: DataFrame, keys: list[str], score: str, higher: Column) -> DataFrame:
    """Best entry per key: the highest score where higher holds, else the lowest; the earlier name on ties."""
    signed = F.when(higher, -F.col(score)).otherwise(F.col(score))
    return results.groupBy(*keys).agg(F.min_by("entry", F.struct(signed, "entry")).alias("entry"), F.min_by(score, F.struct(signed, "entry")).alias(score))


#: Prompts that are compared with every row.
MOST_PROMPTS = 1000


def zero_shot(rows: DataFrame, prompts: DataFrame, scale: float) -> DataFrame:
    """(id, group, p): softmax of scaled cosines to a small prompt table (name, group, vector), summed per group, and the best group; at most MOST_PROMPTS prompts."""
    if prompts.count() > MOST_PROMPTS:
        raise ValueError(f"more than {MOST_PROMPTS} prompts")
    d = F.aggregate(F.zip_with(F.col("embedding").cast("array<double>"), F.col("vector").cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = rows.crossJoin(prompts).select("id", "group", (d * scale).alias("z"))
    w = Window.partitionBy("id")
    soft = scored.withColumn("e", F.exp(F.col("z") - F.max("z").over(w)))
    per = soft.groupBy("id", "group").agg(F.sum("e").alias("e"))
    per = per.withColumn("p", F.col("e") / F.sum("e").over(w))
    return per.groupBy("id").agg(F.max_by("group", F.struct(F.round("p", 9), "group")).alias("group"), F.max("p").alias("p"))
