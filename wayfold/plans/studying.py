"""Queries on stored scores, features and rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis as A
from ..sources.tables import poses, table
from .registry import query

SCORED = "s AS (SELECT quality, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 2) AS BIGINT) / 256.0 * 0.7 + quality * 0.25 AS score FROM labels WHERE quality IS NOT NULL)"


@query(f"""WITH {SCORED}, r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k FROM s), t AS (SELECT sum(CASE WHEN quality = 1 THEN k END) AS r, sum(quality)::DOUBLE AS p, count(*)::DOUBLE AS n, sum(CASE WHEN (score >= 0.5) = (quality = 1) THEN 1 ELSE 0 END)::DOUBLE AS ok FROM r)
 SELECT round((r - p * (p + 1) / 2) / (p * (n - p)), 6) AS auroc, round(ok / n, 6) AS accuracy, round(p / n, 6) AS base_rate FROM t""")
def auroc(spark, sf_dir):
    """AUROC, accuracy and base rate of a hashed score against the quality label."""
    u = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 2), 16, 10).cast("double") / 256.0
    rows = table(spark, sf_dir, "labels").filter("quality is not null").withColumn("score", u * 0.7 + F.col("quality") * 0.25)
    return A.auroc(rows, "score", "quality").select(*(F.round(c, 6).alias(c) for c in ("auroc", "accuracy", "base_rate")))


@query("""WITH {POSE}, s AS (SELECT x AS y, y * 5 AS p FROM pose) SELECT count(*) AS n, round(1 - avg(power(y - p, 2)) / var_pop(y), 6) AS r2, round(avg(abs(y - p)), 5) AS mae FROM s""")
def fit_quality(spark, sf_dir):
    """R2 and mean error of one column as a prediction of another."""
    return A.fit_quality(poses(spark, sf_dir), F.col("y") * 5, "x").select("n", F.round("r2", 6).alias("r2"), F.round("mae", 5).alias("mae"))


@query("""WITH {POSE} SELECT event_id, round((x - avg(x) OVER w) / (coalesce(stddev_samp(x) OVER w, 0) + 1e-4), 5) AS advantage FROM pose WINDOW w AS (PARTITION BY rec, kind)""")
def advantages(spark, sf_dir):
    """Rewards against their group's mean and spread."""
    rows = poses(spark, sf_dir).withColumn("g", F.struct("rec", "kind"))
    return A.advantages(rows, "g", "x").select("event_id", F.round("advantage", 5).alias("advantage"))


@query("""WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS k, unnest(embedding)::DOUBLE AS v FROM embeddings), s AS (SELECT k, avg(v) AS m, stddev_pop(v) AS sd FROM e WHERE vec_id % 5 <> 0 GROUP BY 1) SELECT vec_id, k::INT AS k, round((v - m) / (sd + 1e-6), 4) AS v FROM e JOIN s USING (k) WHERE vec_id % 5 = 0""")
def standardised(spark, sf_dir):
    """Features of held-out vectors by the others' statistics."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return A.standardised(e.filter("vec_id % 5 <> 0"), e.filter("vec_id % 5 = 0"), "embedding").select("vec_id", "k", F.round("v", 4).alias("v"))


@query()
def ridge_probe(spark, sf_dir):
    """Ridge regression of the class on the vector, the penalty chosen on a fifth."""
    e = table(spark, sf_dir, "embeddings").withColumn("fold", (F.col("vec_id") % 5 == 0).cast("int"))
    return A.ridge(e, "embedding", "label", "fold", [0.1, 1.0, 10.0, 100.0])


@query("""WITH p AS (SELECT label AS grp, embedding AS v FROM embeddings WHERE vec_id < 12), z AS (SELECT e.vec_id AS id, grp, 20 * list_dot_product(e.embedding::DOUBLE[], v::DOUBLE[]) AS z FROM embeddings e, p), x AS (SELECT id, grp, exp(z - max(z) OVER (PARTITION BY id)) AS e FROM z), g AS (SELECT id, grp, sum(e) AS e FROM x GROUP BY 1, 2), q AS (SELECT id, grp, e / sum(e) OVER (PARTITION BY id) AS p FROM g)
 SELECT id, arg_max(grp, (round(p, 9), grp)) AS "group", round(max(p), 5) AS p FROM q GROUP BY 1""")
def zero_shot_class(spark, sf_dir):
    """Class of each vector by scaled cosines to a few prompts."""
    e = table(spark, sf_dir, "embeddings")
    prompts = e.filter("vec_id < 12").select(F.col("vec_id").alias("name"), F.col("label").alias("group"), F.col("embedding").alias("vector"))
    return A.zero_shot(e.select(F.col("vec_id").alias("id"), "embedding"), prompts, 20.0).select("id", "group", F.round("p", 5).alias("p"))


@query("""WITH r AS (SELECT l_returnflag AS k, l_linestatus AS probe, l_suppkey AS entry, avg(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2, 3) SELECT k, probe, arg_min(entry, (CASE WHEN probe = 'F' THEN -score ELSE score END, entry)) AS entry, round(arg_min(score, (CASE WHEN probe = 'F' THEN -score ELSE score END, entry)), 4) AS score FROM r GROUP BY 1, 2""")
def leaderboard(spark, sf_dir):
    """Best entry per target and probe, where higher or lower is better."""
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("k"), F.col("l_linestatus").alias("probe"), F.col("l_suppkey").alias("entry")).agg(F.avg("l_extendedprice").alias("score"))
    return A.leaderboard(r, ["k", "probe"], "score", F.col("probe") == "F").withColumn("score", F.round("score", 4))


@query()
def embedding_axes(spark, sf_dir):
    """Variance along the two main axes of the vectors per class."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    placed = PCA(k=2, inputCol="v", outputCol="axes").fit(e).transform(e).select("label", vector_to_array("axes").alias("a"))
    return placed.groupBy("label").agg(F.count("*").alias("n"), F.round(F.var_pop(F.col("a")[0]), 6).alias("first"), F.round(F.var_pop(F.col("a")[1]), 6).alias("second"))
