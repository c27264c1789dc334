"""Splits, quotas, thinning, coverage-driven selection and mixing."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geom import uniform
from .lineage import cut_lineage
from .similarity import near_pairs


def hash_split(key: Column, validation: float = 0.05, test: float = 0.05) -> Column:
    """train, validation or test by the first eight hexadecimal digits of the key's SHA-1."""
    u = F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("double") / 4294967295.0
    return F.when(u < test, "test").when(u < test + validation, "validation").otherwise("train")


def crc_split(key: Column, official: Column | None = None) -> Column:
    """By crc32 modulo 10 (0 test, 1 validation), unless an official split is given."""
    own = F.when(F.crc32(key.cast("binary")) % 10 == 0, "test").when(F.crc32(key.cast("binary")) % 10 == 1, "validation").otherwise("train")
    return own if official is None else F.coalesce(official, own)


def share_split(df: DataFrame, group: str, key: str, seed: str, shares: list[tuple[str, float]], rest: str) -> DataFrame:
    """Split of the first shares of each group's rows in a hashed order."""
    w = Window.partitionBy(group)
    order = w.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), key)
    at = (F.row_number().over(order) - 1) / F.count("*").over(w)
    split, upper = None, 0.0
    for name, share in shares:
        upper += share
        split = F.when(at < upper, name) if split is None else split.when(at < upper, name)
    return df.withColumn("split", split.otherwise(rest))


def hold_out(df: DataFrame, group: Column, share: float, seed: str) -> tuple[DataFrame, DataFrame]:
    """(kept, held out): whole groups, round(share * n) of them but one at least, in a hashed order."""
    named = df.withColumn("_group", group)
    groups = named.groupBy("_group").agg(F.count("*").alias("n"))
    total = groups.count()
    most = max(1, round(share * total))
    held = groups.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "_group")), "_group").limit(most).select("_group")
    return named.join(held, "_group", "left_anti").drop("_group"), named.join(held, "_group", "left_semi").drop("_group")


def first_per(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each group in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


#: Vectors that are thinned at once, at first; every later part is as large as all before it.
FIRST_PART = 8192


def thin(rows: DataFrame, group: list[str], limit: float, rounds: int = 200, first: int = FIRST_PART) -> DataFrame:
    """Rows kept by going through each group in order of rank and skipping what is similar to a row kept before (cosine over the limit).

    rows: (group, id, rank, embedding).  Of equal vectors only the first can be kept.  Parts of the order are gone through one
    after the other, each as large as all before it: what is similar to a row kept from the parts before goes without meeting
    its own part, so a cluster of any size is compared with its few kept members only.  Rows without a vector are kept.
    """
    vectors = rows.filter(F.col("embedding").isNotNull())
    firsts = vectors.groupBy(*group, "embedding").agg(F.min(F.struct("rank", "id")).alias("_at")).select(*group, "_at.id", "_at.rank", "embedding")
    firsts = cut_lineage(firsts, "distinct")
    n = firsts.count()
    shares = [0.5**k for k in range(1, 64) if n * 0.5**k >= first][::-1]
    cuts = firsts.agg(F.percentile_approx("rank", shares, 10_000)).first()[0] if shares else []
    kept = None
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = firsts.filter((F.lit(True) if low is None else F.col("rank") > low) & (F.lit(True) if high is None else F.col("rank") <= high))
        if kept is not None:
            part = part.join(near_pairs(part, kept, group, limit, some=True).select(F.col("a").alias("id")), "id", "left_anti")
        part = cut_lineage(part, "part")
        new = part.join(_skipped(part, group, limit, rounds), "id", "left_anti")
        kept = cut_lineage(new if kept is None else kept.unionByName(new), "kept")
    return rows.join(kept.select("id"), "id", "left_semi").unionByName(rows.filter(F.col("embedding").isNull()))


def _skipped(rows: DataFrame, group: list[str], limit: float, rounds: int) -> DataFrame:
    """Ids of the rows that are similar to a row kept before them.

    A fixed point of: a row goes once an earlier neighbour is kept for sure; it is kept for sure once all its earlier
    neighbours are gone. Each round settles at least the first open row of every chain.
    """
    earlier = F.struct("rank_a", "a") < F.struct(F.col("rank_b").alias("rank_a"), F.col("b").alias("a"))
    pairs = cut_lineage(near_pairs(rows, rows, group, limit).filter(earlier).select("a", "b"), "pairs")
    open_ = cut_lineage(pairs.select(F.col("b").alias("id")).distinct(), "open")
    gone = open_.limit(0)
    for _ in range(rounds):
        live = pairs.join(gone, pairs["a"] == gone["id"], "left_anti")
        waiting = live.join(open_.select(F.col("id").alias("w")), F.col("a") == F.col("w"), "left")
        state = waiting.groupBy(F.col("b").alias("id")).agg(F.bool_or(F.col("w").isNull()).alias("dropped"), F.bool_or(F.col("w").isNotNull()).alias("waits"))
        judged = cut_lineage(open_.join(state, "id", "left").select("id", F.coalesce("dropped", F.lit(False)).alias("dropped"), F.coalesce("waits", F.lit(False)).alias("waits")), "judged")
        gone = cut_lineage(gone.union(judged.filter("dropped").select("id")), "gone")
        open_ = judged.filter("not dropped and waits").select("id")
        if open_.isEmpty():
            return gone
    raise RuntimeError("thinning did not settle")


def far_from(rows: DataFrame, rejected: DataFrame, group: list[str], limit: float, exempt: str) -> DataFrame:
    """Rows that are exempt or not similar to any rejected row of their group."""
    near = near_pairs(rows.filter(~F.col(exempt)), rejected, group, limit, some=True).select(F.col("a").alias("id"))
    return rows.join(near, "id", "left_anti")


def mixing_weights(df: DataFrame, source: str, how: str) -> DataFrame:
    """Weight of each source: equal, sqrt or proportional to its rows, summing to one."""
    n = df.groupBy(source).agg(F.count("*").alias("n"))
    raw = {"equal": F.lit(1.0), "sqrt": F.sqrt("n"), "proportional": F.col("n").cast("double")}[how]
    return n.withColumn("w", raw).withColumn("weight", F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(1)))).drop("w")


def mixed_order(df: DataFrame, weights: DataFrame, source: str, key: str, seed: str) -> DataFrame:
    """Adds mix, by whose order sources come in their weights: -ln(u) / (weight / rows)."""
    u = uniform(F.lit(seed), F.col(key))
    return df.join(weights, source).withColumn("mix", -F.ln(1 - u) * F.col("n") / F.col("weight"))


def source_quota(df: DataFrame, source: str, order: list, most: int) -> DataFrame:
    """ceil(most / sources) rows of each source."""
    n = df.select(source).distinct().count()
    return first_per(df, [source], order, -(-most // max(1, n)))


def stratified(df: DataFrame, source: str, klass: str, key: str, total: int, seed: str) -> DataFrame:
    """About `total` rows: sources by the square root of their rows, classes of a source evenly."""
    counts = df.groupBy(source).agg(F.count("*").alias("n"), F.count_distinct(klass).alias("k"))
    share = F.sqrt("n") / F.sum(F.sqrt("n")).over(Window.partitionBy(F.lit(1)))
    quota = counts.withColumn("quota", F.ceil(F.round(share * total) / F.col("k"))).select(source, "quota")
    w = Window.partitionBy(source, klass).orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), key)
    return df.withColumn("_n", F.row_number().over(w)).join(quota, source).filter(F.col("_n") <= F.col("quota")).drop("_n", "quota")


def cover(candidates: DataFrame, per_stratum: int, recording_cap: int, source_cap: int, spacing: float) -> DataFrame:
    """Coverage-first selection: in rounds, each stratum takes the candidate whose tags are rarest among those taken.

    candidates: (id, stratum, source, recording, t, tags). A round scores each set of tags with the counts of tags taken so
    far and takes one row for each stratum, so there are per_stratum rounds at most.  What was taken is small and meets the
    candidates where they lie; of these only the least id of each set of tags that is left is shuffled.
    """
    all_ = cut_lineage(candidates, "candidates")
    sets = cut_lineage(all_.select("stratum", "tags").distinct(), "sets")
    taken = all_.limit(0).withColumn("round", F.lit(0))
    same = lambda x, y, *names: functools.reduce(lambda p, q: p & q, (x[n].eqNullSafe(y[n]) for n in names))
    for k in range(per_stratum):
        have = taken.select("stratum", F.explode("tags").alias("tag")).groupBy("stratum", "tag").agg(F.count("*").alias("c"))
        gain = sets.withColumn("tag", F.explode("tags")).join(have, ["stratum", "tag"], "left").groupBy("stratum", "tags").agg(F.round(F.sum(1 / (1 + F.coalesce("c", F.lit(0)))), 9).alias("gain"))
        recordings = taken.groupBy("stratum", "recording").agg(F.count("*").alias("nr"), F.collect_list("t").alias("near"))  # recording_cap rows at most
        sources = taken.groupBy("stratum", "source").agg(F.count("*").alias("ns"))
        close = F.coalesce(F.exists("near", lambda t: F.abs(F.col("t") - t) < spacing), F.lit(False))
        usable = all_.join(taken.select("id"), "id", "left_anti").join(recordings, ["stratum", "recording"], "left").join(sources, ["stratum", "source"], "left")
        usable = usable.filter((F.coalesce("nr", F.lit(0)) < recording_cap) & (F.coalesce("ns", F.lit(0)) < source_cap) & ~close)
        least = usable.groupBy("stratum", "tags").agg(F.min("id").alias("id"))
        scored = least.join(gain, same(least, gain, "stratum", "tags")).select(least["stratum"], "id", "gain")
        best = cut_lineage(scored.groupBy("stratum").agg(F.min_by("id", F.struct(-F.col("gain"), "id")).alias("id")), "best")
        if best.isEmpty():
            break
        taken = cut_lineage(taken.unionByName(all_.join(best.select("id"), "id", "left_semi").withColumn("round", F.lit(k + 1))), "taken")  # a row a stratum
    return taken


def whole_order_ids(df: DataFrame, order: list[str], prefix: str) -> DataFrame:
    """Adds suite_id, a running number in a total order, without one task that sorts everything.

    Rows are range-partitioned; each partition numbers its own rows from the count of those before it.
    """
    parted = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    parted = cut_lineage(parted, "ordered")
    before = parted.groupBy("_p").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("_p")) - F.col("n"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    out = parted.withColumn("_n", inside).join(before.select("_p", "before"), "_p").withColumn("number", F.col("_n") + F.col("before") - 1)
    return out.withColumn("suite_id", F.format_string(f"{prefix}-%04d", F.col("number"))).drop("_p", "_n", "before")
