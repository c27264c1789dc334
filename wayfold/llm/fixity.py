"""Merkle fixity audit of WARC replicas (operator 5).

Rows become WARC records in numbered places; a file is 4096 places in a row, and a record's offset is the sum of the
lengths before it in its file.  Each replica gets a manifest and a tree of its own, from its own bytes and offsets: a
record's leaf hashes its place, length and content; an inner node hashes its children's places, lengths and hashes in
order, which fixes the ordered offset ranges below it, and covers their range of offsets.  The audit compares the roots
and goes down only below nodes that differ, level by level, with a full outer join of the children there.  Where the
roots are equal, nothing else is compared.

Defined cases: a null url or html counts as empty; a record that the replica lacks is `missing`, one with other bytes
`corrupt`, one that only the replica has `extra` (with the replica's offset, length and digest); places are unique in a
replica; repeated rows are records of their own; an empty table gives an empty result; columns other than those named
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialize

#: Bits by which a place shortens from level to level: 16, 256 and 4096 records in a file, then files.
STEPS = (4, 4, 4, 8, 8, 8, 8, 8, 12)
FILE_BITS = 12
#: The table does not tell when a page was fetched, and every record must say so.
CAPTURED = "1970-01-01T00:00:00Z"


def warc_record(url: Column, body: Column, number: Column) -> Column:
    """The bytes of one WARC resource record."""
    body = F.encode(F.coalesce(body, F.lit("")), "UTF-8")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), F.regexp_replace(F.md5(number.cast("string").cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
        F.lit(f">\r\nWARC-Date: {CAPTURED}\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nWARC-Payload-Digest: sha256:"), F.sha2(body, 256),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def archive(pages: DataFrame) -> DataFrame:
    """page_id, place and record of every page, written once so that places stay."""
    numbered = pages.select("page_id", "url", "html", F.monotonically_increasing_id().alias("place"))
    return materialize(numbered.select("page_id", "place", warc_record(F.col("url"), F.col("html"), F.col("place")).alias("record")), "warc")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, body, offset, length) of each record of a WARC file; ValueError where the bytes are no record."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at : max(at, end)].decode().split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/1."):
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        after = end + 4 + int(headers["Content-Length"])
        if data[after : after + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end at byte {after}")
        yield headers, data[end + 4 : after], at, after + 4 - at
        at = after + 4


def manifest(records: DataFrame) -> DataFrame:
    """page_id, place, file, offset, length and sha256 of every record of one replica."""
    in_file = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    sized = records.select("page_id", "place", F.shiftright("place", FILE_BITS).alias("file"), F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("sha256"))
    return sized.withColumn("offset", F.coalesce(F.sum("length").over(in_file), F.lit(0)))


def leaves(listed: DataFrame) -> DataFrame:
    """node (the place), first and last (its offsets, in the file), size and hash of every record of a manifest."""
    return listed.select(F.col("place").alias("node"), F.col("offset").alias("first"), (F.col("offset") + F.col("length")).alias("last"), F.col("length").alias("size"), F.sha2(F.concat_ws("|", F.lit("leaf"), "place", "length", "sha256"), 256).alias("hash"))


def parents(nodes: DataFrame, step: int) -> DataFrame:
    """The next level up: hashes over the children in order, and the range of offsets that they cover."""
    grouped = nodes.groupBy(F.shiftright("node", step).alias("node")).agg(F.sort_array(F.collect_list(F.struct("node", "size", "hash"))).alias("children"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("size").alias("size"))
    listed = F.array_join(F.transform("children", lambda c: F.concat_ws("|", c["node"], c["size"], c["hash"])), ",")
    return grouped.select("node", "first", "last", "size", F.sha2(F.concat(F.lit("node|"), listed), 256).alias("hash"))


def tree(level: DataFrame, name: str) -> list[DataFrame]:
    """All levels from the leaves to the root, each written once; at most `1 << STEPS[k]` children go into a node."""
    levels = [materialize(level, f"{name}0")]
    for k, step in enumerate(STEPS, 1):
        levels.append(materialize(parents(levels[-1], step), f"{name}{k}"))
    return levels


def mismatches(here: list[DataFrame], there: list[DataFrame]) -> DataFrame:
    """node, here and there (hashes) of the leaves that differ, found from the roots down: only children of nodes that differ are looked at."""
    found = None
    for k in range(len(here) - 1, -1, -1):
        sides = [tree[k].select("node", F.col("hash").alias(side)) for tree, side in ((here, "here"), (there, "there"))]
        if found is not None:
            above = found.select(F.col("node").alias("above"))
            sides = [side.join(above, F.shiftright(side["node"], STEPS[k]) == above["above"], "left_semi") for side in sides]
        found = materialize(sides[0].join(sides[1], "node", "full").filter(~F.col("here").eqNullSafe(F.col("there"))), f"differ{k}")
        if found.isEmpty():
            return found
    return found


def audit(records: DataFrame, replica: DataFrame) -> DataFrame:
    """page_id, file, place, offset, length, sha256 and status (intact, corrupt, missing or extra) of every record."""
    ours, theirs = (materialize(manifest(r), "manifest") for r in (records, replica))
    found = mismatches(tree(leaves(ours), "here"), tree(leaves(theirs), "there"))
    status = F.when(F.col("there").isNull(), "missing").when(F.col("here").isNull(), "extra").otherwise("corrupt")
    bad = materialize(found.select(F.col("node").alias("place"), status.alias("status")), "damage")
    columns = ["page_id", "file", "place", "offset", "length", "sha256"]
    extra = theirs.join(bad.filter("status = 'extra'"), "place").select(*columns, "status")
    return ours.join(bad, "place", "left").select(*columns, F.coalesce("status", F.lit("intact")).alias("status")).unionByName(extra)


def damaged(records: DataFrame, key: str = "page_id") -> DataFrame:
    """A replica with decay: by hash, about one record in 97 has a changed byte and one in 499 is gone."""
    h = F.pmod(F.xxhash64(F.lit("decay"), F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(97 * 499))
    at = (F.pmod(F.xxhash64(F.lit("byte"), F.col("place")), F.octet_length("record").cast("long")) + 1).cast("int")
    old = F.substring("record", at, F.lit(1))
    new = F.when(old == F.lit(b"?"), F.lit(b"!")).otherwise(F.lit(b"?"))
    return records.filter(F.coalesce(h % 499 != 0, F.lit(True))).withColumn("record", F.when(h % 97 == 0, F.overlay("record", new, at)).otherwise(F.col("record")))


def op5_merkle_fixity(spark, sf_dir: str) -> DataFrame:
    """All pages as WARC records, audited against a replica that decayed."""
    records = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return audit(records, damaged(records))
