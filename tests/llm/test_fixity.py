import hashlib
import random

from pyspark.sql import functions as F

from wayfold.llm import fixity

SCHEMA = "page_id long, url string, html string, record string, place string"


def plain_tree(rows):
    """Levels of the tree over (place, record) in plain Python, as {node: (size, hash)}."""
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    levels = [{p: (len(r), sha(f"leaf|{p}|{len(r)}|{hashlib.sha256(r).hexdigest()}")) for p, r in rows}]
    for step in fixity.STEPS:
        groups = {}
        for node in sorted(levels[-1]):
            groups.setdefault(node >> step, []).append(node)
        below = levels[-1]
        levels.append({g: (sum(below[n][0] for n in ns), sha("node|" + ",".join(f"{n}|{below[n][0]}|{below[n][1]}" for n in ns))) for g, ns in groups.items()})
    return levels


def test_tree_against_plain_python(spark):
    draw = random.Random(2)
    places = sorted(draw.sample(range(20_000), 700)) + [1 << 33, (1 << 33) + 5]
    rows = [(k, p, bytearray(draw.randbytes(draw.randint(0, 80)))) for k, p in enumerate(places)]
    records = spark.createDataFrame(rows, "page_id long, place long, record binary")
    levels = fixity.tree(fixity.leaves(fixity.manifest(records)), "plain")
    assert [{r.node: (r.size, r.hash) for r in level.collect()} for level in levels] == plain_tree([(p, bytes(r)) for _, p, r in rows])
    assert levels[-1].count() == 1


def test_damage_is_found_and_nothing_else(spark):
    draw = random.Random(4)
    rows = [(k, k * 3, bytearray(draw.randbytes(draw.randint(1, 60)))) for k in range(3000)]
    records = spark.createDataFrame(rows, "page_id long, place long, record binary")
    status = dict.fromkeys((r[0] for r in rows), "intact")
    other = []
    for k, place, record in rows:
        kind = draw.choice(["missing", "corrupt", "longer"] + ["intact"] * 200)
        if kind == "missing":
            status[k] = "missing"
            continue
        if kind != "intact":
            status[k] = "corrupt"
            record = record + b"x" if kind == "longer" else bytearray([record[0] ^ 1]) + record[1:]
        other.append((k, place, record))
    extra = [(9000, 1, bytearray(b"new")), (9001, 1 << 40, bytearray(b"far")), (9002, 8998, bytearray(b"end"))]
    replica = spark.createDataFrame(other + extra, "page_id long, place long, record binary")
    got = fixity.audit(records, replica).collect()
    assert {r.page_id: r.status for r in got} == status | {k: "extra" for k, _, _ in extra} and len(got) == len(rows) + 3
    assert len(set(status.values())) == 3
    lengths = {}
    for k, place, record in rows:
        lengths.setdefault(place >> fixity.FILE_BITS, []).append((k, len(record)))
    offsets = {k: sum(n for _, n in f[:at]) for f in lengths.values() for at, (k, _) in enumerate(f)}
    assert all(r.offset == offsets[r.page_id] for r in got if r.status != "extra")


def test_equal_replicas_are_compared_at_the_root_only(spark):
    records = spark.createDataFrame([(k, k, bytearray(b"x" * k)) for k in range(300)], "page_id long, place long, record binary")
    here, there = (fixity.tree(fixity.leaves(fixity.manifest(records)), "equal") for _ in range(2))
    assert fixity.mismatches([None] * (len(here) - 1) + here[-1:], there).isEmpty()  # levels below are not touched
    assert {r.status for r in fixity.audit(records, records).collect()} == {"intact"}


def test_records_are_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/é", "<p>x\r\n\r\ny</p>", "r", "p"), (2, None, None, "r", "p"), (2, "u", "", "r", "p")], SCHEMA)
    stored = sorted(fixity.archive(pages).collect(), key=lambda r: r.place)
    parsed = list(fixity.parse(b"".join(bytes(r.record) for r in stored)))
    assert [h["WARC-Target-URI"] for h, *_ in parsed] == ["http://a/é", "", "u"] and [b for _, b, _, _ in parsed] == ["<p>x\r\n\r\ny</p>".encode(), b"", b""]
    need = {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "Content-Type", "WARC-Payload-Digest"}
    assert all(need <= set(h) and h["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(b).hexdigest() for h, b, _, _ in parsed)
    listed = {r.place: (r.offset, r.length) for r in fixity.manifest(fixity.archive(pages.coalesce(1))).collect()}
    assert sorted(listed.values()) == [(at, n) for _, _, at, n in parsed]


def test_odd_tables(spark):
    pages = spark.createDataFrame([(k, None if k % 7 == 0 else "u", None if k % 5 == 0 else "h" * k * 50, "r", "p") for k in range(300)] + [(5, "u", "h", "r", "p")] * 2, SCHEMA)
    records = fixity.archive(pages)
    got = fixity.audit(records, fixity.damaged(records))
    assert got.count() == 302 and {r.status for r in got.select("status").distinct().collect()} >= {"intact"}
    nothing = fixity.archive(pages.limit(0))
    assert fixity.audit(nothing, nothing).count() == 0
    assert {r.status for r in fixity.audit(records, nothing).select(F.col("status")).distinct().collect()} == {"missing"}
    assert {r.status for r in fixity.audit(nothing, records).select("status").distinct().collect()} == {"extra"}
