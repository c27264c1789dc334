"""Queries on splits, quotas, thinning and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import selection as S
from ..sources.tables import poses, table
from .registry import query


@query("""SELECT doc_id, CASE WHEN u < 0.05 THEN 'test' WHEN u < 0.10 THEN 'validation' ELSE 'train' END AS split FROM (SELECT doc_id, CAST('0x' || substr(sha1(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967295.0 AS u FROM documents)""")
def recording_split(spark, sf_dir):
    """Split of each document by the hash of its id."""
    return table(spark, sf_dir, "documents").select("doc_id", S.hash_split(F.col("doc_id").cast("string")).alias("split"))


#: CRC-32 in SQL, bit by bit over the bytes of a text.
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(generate_series(1, strlen(url)), lambda i: CAST('0x' || substr(hex(encode(url)), CAST(2 * i - 1 AS INT), 2) AS BIGINT))),
 lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT)"""


@query(f"SELECT page_id, CASE c % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM (SELECT page_id, {CRC} AS c FROM pages)")
def crc_split(spark, sf_dir):
    """Split of each page by the checksum of its address."""
    return table(spark, sf_dir, "pages").select("page_id", S.crc_split(F.col("url")).alias("split"))


MD5 = lambda seed, key: f"md5('{seed}|' || CAST({key} AS VARCHAR))"


@query(f"""WITH r AS (SELECT p_partkey, p_brand, (row_number() OVER (PARTITION BY p_brand ORDER BY {MD5('7', 'p_partkey')}, p_partkey) - 1)::DOUBLE / count(*) OVER (PARTITION BY p_brand) AS place FROM part)
 SELECT p_partkey, CASE WHEN place < 0.2 THEN 'test' WHEN place < 0.5 THEN 'validation' ELSE 'train' END AS split FROM r""")
def share_split(spark, sf_dir):
    """Shares of each brand's parts in a hashed order."""
    return S.share_split(table(spark, sf_dir, "part"), "p_brand", "p_partkey", "7", [("test", 0.2), ("validation", 0.3)], "train").select("p_partkey", "split")


@query(f"""WITH g AS (SELECT DISTINCT o_custkey % 97 AS k FROM orders), h AS (SELECT k, row_number() OVER (ORDER BY {MD5('9', 'k')}, k) AS n, count(*) OVER () AS total FROM g)
 SELECT o_orderkey FROM orders JOIN h ON k = o_custkey % 97 WHERE n <= greatest(1, round_even(0.1 * total, 0))""")
def group_hold_out(spark, sf_dir):
    """Orders of whole groups of customers that are held out."""
    return S.hold_out(table(spark, sf_dir, "orders"), F.col("o_custkey") % 97, 0.1, "9")[1].select("o_orderkey")


@query("""WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem) SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM r WHERE n <= 5""")
def class_cap(spark, sf_dir):
    """The five dearest lines of each supplier and flag."""
    return S.first_per(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"], 5).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH r AS (SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) SELECT * EXCLUDE (n) FROM r WHERE n <= ceil(1000.0 / (SELECT count(DISTINCT l_returnflag) FROM lineitem))""")
def source_quota(spark, sf_dir):
    """Equal numbers of rows of each source in a bounded pass."""
    return S.source_quota(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 1000).select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(f"""WITH c AS (SELECT o_orderstatus AS s, count(*) AS n, count(DISTINCT o_orderpriority) AS k FROM orders GROUP BY 1), q AS (SELECT s, ceil(round(sqrt(n) / sum(sqrt(n)) OVER () * 600) / k) AS quota FROM c),
 r AS (SELECT o_orderkey, o_orderstatus AS s, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY {MD5('3', 'o_orderkey')}, o_orderkey) AS n FROM orders) SELECT o_orderkey FROM r JOIN q USING (s) WHERE n <= quota""")
def stratified_pick(spark, sf_dir):
    """A pilot sample: sources by the square root of their rows, classes evenly."""
    return S.stratified(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", "o_orderkey", 600, "3").select("o_orderkey")


@query("SELECT o_orderstatus, n, round(sqrt(n) / sum(sqrt(n)) OVER (), 6) AS weight FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)")
def mixing_weights(spark, sf_dir):
    """Weights of sources by the square root of their rows."""
    return S.mixing_weights(table(spark, sf_dir, "orders"), "o_orderstatus", "sqrt").select("o_orderstatus", "n", F.round("weight", 6).alias("weight"))


@query("""WITH w AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1), u AS (SELECT o_orderkey, o_orderstatus AS s, CAST('0x' || substr(md5('5|' || CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM orders),
 m AS (SELECT o_orderkey, u.s, -ln(1 - u) * n * (SELECT count(*) FROM w) AS mix FROM u JOIN w USING (s)) SELECT o_orderkey, s AS o_orderstatus, round(mix, 3) AS mix FROM m""")
def mixed_order(spark, sf_dir):
    """Every order with its place in the mixed order of the sources."""
    orders = table(spark, sf_dir, "orders")
    mixed = S.mixed_order(orders, S.mixing_weights(orders, "o_orderstatus", "equal"), "o_orderstatus", "o_orderkey", "5")
    return mixed.select("o_orderkey", "o_orderstatus", F.round("mix", 3).alias("mix"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("klass"), F.col("vec_id").alias("rank"), "embedding")


@query("""WITH RECURSIVE p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id AND list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.25),
 s(k, kept) AS (SELECT -1::BIGINT, []::BIGINT[] UNION ALL SELECT k + 1, CASE WHEN (SELECT count(*) FROM p WHERE p.b = k + 1 AND list_contains(kept, p.a)) = 0 THEN list_append(kept, k + 1) ELSE kept END FROM s WHERE k < (SELECT max(vec_id) FROM embeddings))
 SELECT unnest(kept) AS id FROM s WHERE k = (SELECT max(vec_id) FROM embeddings)""")
def near_duplicate_thin(spark, sf_dir):
    """Vectors kept per class when those near an earlier kept one are skipped."""
    return S.thin(_vectors(spark, sf_dir), ["klass"], 0.25).select("id")


@query("""SELECT a.vec_id AS id FROM embeddings a WHERE a.vec_id % 3 = 1 OR NOT EXISTS (SELECT 1 FROM embeddings b WHERE b.vec_id % 11 = 0 AND b.label = a.label AND list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.25)""")
def rejected_view_anti(spark, sf_dir):
    """Vectors that are exempt or far from every rejected one of their class."""
    rows = _vectors(spark, sf_dir).withColumn("accepted", F.col("id") % 3 == 1)
    return S.far_from(rows, rows.filter("id % 11 = 0"), ["klass"], 0.25, "accepted").select("id")


@query()
def coverage_selection(spark, sf_dir):
    """Twelve events per stratum that cover tags best, with caps per recording and source."""
    rows = poses(spark, sf_dir)
    tags = F.array(F.concat(F.lit("kind:"), "kind"), F.concat(F.lit("x:"), F.floor(F.col("x") / 100).cast("string")), F.concat(F.lit("y:"), F.floor(F.col("y") / 25).cast("string")))
    candidates = rows.select(F.col("event_id").alias("id"), (F.col("rec") % 2).alias("stratum"), (F.col("rec") % 7).alias("source"), F.col("rec").alias("recording"), "t", tags.alias("tags"))
    return S.cover(candidates, 12, 2, 4, 3600.0).select("id", "stratum", "source", "recording", "round")


@query("SELECT o_orderkey, printf('order-%04d', row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) AS suite_id FROM orders")
def suite_ids(spark, sf_dir):
    """Running ids in order of date and key."""
    return S.whole_order_ids(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], "order").select("o_orderkey", "suite_id")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderkey DESC) AS n FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE n = 1""")
def one_answer(spark, sf_dir):
    """One order for each customer, finished ones first."""
    return S.first_per(table(spark, sf_dir, "orders"), ["o_custkey"], [F.when(F.col("o_orderstatus") == "F", 0).otherwise(1), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")
