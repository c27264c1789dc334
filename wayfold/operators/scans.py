"""Running values along an order within each key, with keys of any size split over tasks.

A key with more rows than a range may have is cut into ranges of its order, at quantiles of a mergeable sketch.  Running values
are taken in each range by itself; each range is reduced to what it carries over its end (its last row, its last value, its sum),
what the ranges before it carry is put together, a row a range, and every range is finished from its own.  The rows are
shuffled once, by key and range.  Keys that fit in a range are worked on as they are.

Rows that agree in key and in the first column of the order stay together, so they decide how far a key can be split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key that stay together, and ranges of a key at most; beyond, ranges grow.
RANGE_ROWS, MOST_RANGES = 1_000_000, 1000
#: Up to so many split keys, their cuts (a thousand numbers each) and carries (a row a range) are sent to all tasks.
FEW_KEYS = 500
RANGE = "_range"


@dataclass(frozen=True)
class Ordered:
    """Rows with their range, null where the key is not split; split is the number of keys that are."""

    rows: DataFrame
    keys: list[str]
    order: list[str]
    split: int

    def with_rows(self, rows: DataFrame) -> Ordered:
        """The same order over rows that were derived from these row by row."""
        return Ordered(rows, self.keys, self.order, self.split)

    def window(self):
        return Window.partitionBy(*self.keys, *([RANGE] if self.split else [])).orderBy(*self.order)

    def plain(self) -> DataFrame:
        return self.rows.drop(RANGE)


def ordered(rows: DataFrame, keys: list[str], order: list[str], most: int | None = None) -> Ordered:
    """Rows with large keys cut into ranges of the first column of the order, a number or a time."""
    most = most or RANGE_ROWS
    large = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > most)
    split = large.count()
    if not split:
        return Ordered(rows, keys, order, 0)
    same = [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in keys]
    parts = F.least(F.ceil(F.col("_n") / most), F.lit(MOST_RANGES)).cast("int")
    members = rows.select(*keys, F.col(order[0]).alias("_at")).alias("_l").join(large.alias("_r"), _all(same), "left_semi")
    #: the sketch is merged in tasks before it is shuffled; its thousand places are thinned to the wanted ones
    places = members.groupBy(*keys).agg(F.percentile_approx("_at", [k / 1000 for k in range(1, 1000)], 10_000).alias("_places"))
    cuts = places.alias("_l").join(large.alias("_r"), _all(same)).select(*(F.col(f"_l.{k}").alias(k) for k in keys), F.array_distinct(_thinned("_places", parts)).alias("_cuts"))
    marked = rows.alias("_l").join(_sent(cuts, split).alias("_r"), _all(same), "left").select("_l.*", _range("_cuts", F.col(f"_l.{order[0]}")).alias(RANGE))
    return Ordered(marked, keys, order, split)


def _sent(side: DataFrame, split: int) -> DataFrame:
    """A side with few rows for each split key, sent to all tasks where there are few such keys."""
    return F.broadcast(side) if split <= FEW_KEYS else side


def _thinned(places: str, parts: Column) -> Column:
    """The places of a sketch that cut into so many parts."""
    step = F.greatest(F.lit(1), F.floor(F.lit(1000) / parts)).cast("int")
    return F.filter(places, lambda _, i: (i + 1) % step == 0)


def _range(cuts: str, at: Column) -> Column:
    """How many cuts lie before a place; null without cuts."""
    return F.when(F.col(cuts).isNotNull(), F.size(F.filter(cuts, lambda c: F.coalesce(c < at, F.lit(False)))))


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def scan(
    on: Ordered,
    previous: dict[str, Column] | None = None,
    following: dict[str, Column] | None = None,
    last: dict[str, Column] | None = None,
    first: dict[str, Column] | None = None,
    total: dict[str, Column] | None = None,
) -> Ordered:
    """The rows with running values added.

    previous, following: a value of the row before or behind; last: the last value up to the row that is not null; first: the
    first one from the row on; total: the sum up to the row (null while all are null).
    """
    w = on.window()
    upto, onward = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    row = lambda c: F.struct(c.alias("v"))  # noqa: E731 - tells a null value from no row
    kinds = [
        (previous or {}, lambda c: F.lag(row(c)).over(w)), (following or {}, lambda c: F.lead(row(c)).over(w)),
        (last or {}, lambda c: F.last(c, ignorenulls=True).over(upto)), (first or {}, lambda c: F.first(c, ignorenulls=True).over(onward)), (total or {}, lambda c: F.sum(c).over(upto)),
    ]
    names = [n for wanted, _ in kinds for n in wanted]
    rows = on.rows.withColumns({n: of(c) for wanted, of in kinds for n, c in wanted.items()})
    if on.split:
        rows = _carried(on, rows, *(wanted for wanted, _ in kinds))
    whole = {**(previous or {}), **(following or {})}
    return on.with_rows(rows.select(*on.rows.columns, *((F.col(n)["v"] if n in whole else F.col(n)).alias(n) for n in names)))


def _carried(on: Ordered, rows: DataFrame, previous: dict, following: dict, last: dict, first: dict, total: dict) -> DataFrame:
    """Values of each range put together with what the ranges before and behind it carry."""
    place = F.struct(*on.order)
    known = lambda c: F.when(c.isNotNull(), place)
    ends = on.rows.filter(F.col(RANGE).isNotNull()).groupBy(*on.keys, RANGE).agg(
        F.count("*").alias("_rows"),
        *(F.max_by(F.struct(c.alias("v")), place).alias(f"_c_{n}") for n, c in previous.items()), *(F.min_by(F.struct(c.alias("v")), place).alias(f"_c_{n}") for n, c in following.items()),
        *(F.max_by(c, known(c)).alias(f"_c_{n}") for n, c in last.items()), *(F.min_by(c, known(c)).alias(f"_c_{n}") for n, c in first.items()), *(F.sum(c).alias(f"_c_{n}") for n, c in total.items()),
    )
    v = Window.partitionBy(*on.keys).orderBy(RANGE)
    before, behind = v.rowsBetween(Window.unboundedPreceding, -1), v.rowsBetween(1, Window.unboundedFollowing)
    carry = [
        *(F.lag(f"_c_{n}").over(v).alias(f"_d_{n}") for n in previous), *(F.lead(f"_c_{n}").over(v).alias(f"_d_{n}") for n in following),
        *(F.last(f"_c_{n}", ignorenulls=True).over(before).alias(f"_d_{n}") for n in last), *(F.first(f"_c_{n}", ignorenulls=True).over(behind).alias(f"_d_{n}") for n in first),
        *(F.sum(f"_c_{n}").over(before).alias(f"_d_{n}") for n in total),
    ]
    carries = ends.select(*(F.col(k).alias(f"_k_{k}") for k in on.keys), F.col(RANGE).alias("_k_range"), *carry)
    same = _all([F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in on.keys] + [F.col(RANGE) == F.col("_k_range")])
    both = rows.join(_sent(carries, on.split), same, "left")
    added = {n: F.coalesce(F.col(n), F.col(f"_d_{n}")) for wanted in (previous, following, last, first) for n in wanted}
    added |= {n: F.coalesce(F.col(n) + F.col(f"_d_{n}"), F.col(n), F.col(f"_d_{n}")) for n in total}
    return both.withColumns(added)


def running(rows: DataFrame, keys: list[str], order: list[str], most: int | None = None, **wanted: dict[str, Column]) -> DataFrame:
    """scan() over rows that are put in order for it alone."""
    return scan(ordered(rows, keys, order, most), **wanted).plain()
