"""Places paired off cheapest first, over columns: what is near is met in cells, within reaches that grow."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Candidates that are met at a time: so many for each place there is, and at most.
FEW_MET, MOST_MET = 16, 1 << 21


@dataclass
class Looks:
    """Lefts that look for a right, a row each: from a place, among rights of a class, up to a distance; `plus` is added to the cost.

    classes: the class of each right for these looks.
    """

    left: np.ndarray
    x: np.ndarray
    y: np.ndarray
    limit: np.ndarray
    klass: np.ndarray
    classes: np.ndarray
    plus: float = 0.0

    def of(self, keep: np.ndarray) -> Looks:
        return Looks(self.left[keep], self.x[keep], self.y[keep], self.limit[keep], self.klass[keep], self.classes, self.plus)


class Queues:
    """Rows that agree in all columns, in groups; of a group those with the least numbers go first."""

    def __init__(self, columns: list[np.ndarray], n: int):
        self.order = np.lexsort(columns[::-1])
        new = np.zeros(n, bool)
        new[:1] = True
        for c in columns:
            at = c[self.order]
            new[1:] |= at[1:] != at[:-1]
        self.group = np.empty(n, np.int64)
        self.group[self.order] = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        self.first = self.order[starts]
        self.head, self.end = starts.tolist(), [*starts[1:].tolist(), n][: len(starts)]
        self.row = self.order.tolist()

    def free(self) -> np.ndarray:
        return np.array(self.head, np.int64) < np.array(self.end, np.int64)


def distances(dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """math.hypot of each pair: numpy's may differ in the last place."""
    return np.fromiter(map(math.hypot, dx.tolist(), dy.tolist()), float, len(dx))


def in_cells(x: np.ndarray, y: np.ndarray, klass: np.ndarray, rx: np.ndarray, ry: np.ndarray, rclass: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, start, end): places in order of their cells, and for each look three ranges of it, which hold all places of its class within reach."""
    size = reach * 1.001
    (ux, i), uy = np.unique(cx := np.floor(rx / size), return_inverse=True), np.unique(cy := np.floor(ry / size))
    code = (rclass * len(ux) + i) * len(uy) + np.searchsorted(uy, cy)
    order = np.argsort(code, kind="stable")
    code, px, py = code[order], np.floor(x / size), np.floor(y / size)
    low, high = np.searchsorted(uy, py - 1), np.searchsorted(uy, py + 1, "right")
    start, end = np.empty((3, len(x)), np.int64), np.empty((3, len(x)), np.int64)
    for k in range(3):
        at = np.searchsorted(ux, px + (k - 1))
        there = ux[np.minimum(at, len(ux) - 1)] == px + (k - 1)
        base = (klass * len(ux) + at) * len(uy)
        start[k], end[k] = np.searchsorted(code, base + low), np.searchsorted(code, base + high)
        end[k] = np.where(there, end[k], start[k])
    return order, start, end


def spread(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(look, position) of all positions in ranges of looks."""
    n = (end - start).ravel()
    first = np.repeat(start.ravel() - (np.cumsum(n) - n), n)
    return np.repeat(np.tile(np.arange(start.shape[1]), start.shape[0]), n), first + np.arange(len(first))


def pair_off_places(lefts: list[np.ndarray], looks: list[Looks], x: np.ndarray, y: np.ndarray, alike: list[np.ndarray], named: list[tuple[float, int, int]] = ()) -> np.ndarray:
    """For each right the left it goes to, or -1: what pair_off gives for all offers (cost, tie, left, right), never made all at once.

    lefts: columns by which lefts agree in all their looks; alike: the same for rights beside x and y.  Lefts and rights are numbered in the
    order that decides between equal costs.  named: offers (cost, left, right) of their own, in place of what looks find for the two.

    Offers are made and taken up to a cost, then up to a greater one among who is left, so that those of any reach are about as
    many as places, however these crowd; places that fall together make one offer.
    """
    out = np.full(len(x), -1, np.int64)
    if not len(x) or not len(lefts[0]):
        return out
    own, partner = [np.zeros(len(c), np.int64) for c in (lefts[0], x)], {}
    for _, a, b in named:
        own[0][a], own[1][b] = a + 1, b + 1
    a, b = Queues([*lefts, own[0]], len(own[0])), Queues([*alike, x, y, own[1]], len(x))
    partner = np.full(len(a.first), -1, np.int64)
    for _, i, j in named:
        partner[a.group[i]] = b.group[j]
    asked = sorted((c, int(a.group[i]), int(b.group[j])) for c, i, j in named)
    leads = np.zeros(len(own[0]), bool)
    leads[a.first] = True
    reachable = np.isfinite(x) & np.isfinite(y)
    looks = [k.of(leads[k.left] & np.isfinite(k.x) & np.isfinite(k.y) & (k.limit >= 0)) for k in looks]
    done, step = -1.0, math.inf
    while True:
        free, open_ = a.free(), b.free()
        looks = [k.of(free[a.group[k.left]] & (k.limit + k.plus > done)) for k in looks]
        rights = np.flatnonzero(open_ & reachable[b.first])
        asked = [o for o in asked if free[o[1]] and open_[o[2]]]
        tops = [float(k.limit.max()) + k.plus for k in looks if len(k.left) and len(rights)] + [o[0] for o in asked]
        if not tops:
            return out
        top, places = max(tops), b.first[rights]
        most = min(MOST_MET, FEW_MET * (sum(len(k.left) for k in looks) + len(rights)) + 4096)
        while True:
            upto = min(max(done, 0.0) + step, top)
            met = [_met(k, x[places], y[places], k.classes[places], upto) if len(rights) else None for k in looks]
            n = sum(int((m[2] - m[1]).sum()) for m in met if m)
            if n <= most or step <= max(done / 4, 1e-9 * top):  # those within `done` of each other were met before
                break
            step = max(min(step, top) * min(0.9 * math.sqrt(most / n), 0.5), done / 4)
        offers = [[np.array(c) for c in zip(*(o for o in asked if o[0] <= upto))]] if asked and asked[0][0] <= upto else []
        for k, m in zip(looks, met):
            offers += [_offers(k, m, a, rights, places, x, y, partner, upto)] if m else []
        asked = [o for o in asked if o[0] > upto]
        if offers:
            _take(*(np.concatenate(c) for c in zip(*offers)), a, b, out)
        if upto >= top:
            return out
        done, step = upto, min(step, top) * min(max(math.sqrt(most / max(n, 1)), 1.5), 4.0)


def _met(k: Looks, x: np.ndarray, y: np.ndarray, classes: np.ndarray, upto: float) -> tuple | None:
    reach = min(upto - k.plus, float(k.limit.max(initial=0.0))) * (1 + 1e-9) + 1e-12
    return in_cells(k.x, k.y, k.klass, x, y, classes, reach) if len(k.left) and upto >= k.plus else None


def _offers(k: Looks, met: tuple, a: Queues, rights: np.ndarray, places: np.ndarray, x: np.ndarray, y: np.ndarray, partner: np.ndarray, upto: float) -> tuple:
    """(cost, left group, right group) of what looks find at a cost of `upto` at most; candidates are gone through in bounded parts."""
    order, start, end = met
    reach, found = min(max(upto - k.plus, 0.0), float(k.limit.max(initial=0.0))) * (1 + 1e-6) + 1e-9, []
    total = np.cumsum((end - start).sum(axis=0))
    cuts = np.unique(np.searchsorted(total, np.arange(1, 1 + int(total[-1]) // MOST_MET) * MOST_MET)).tolist()
    for i, j in zip([0, *cuts], [*cuts, len(total)]):
        look, at = spread(start[:, i:j], end[:, i:j])
        look, at = look + i, order[at]
        dx, dy = k.x[look] - x[places[at]], k.y[look] - y[places[at]]
        near = np.flatnonzero((np.abs(dx) <= reach) & (np.abs(dy) <= reach))
        near = near[dx[near] ** 2 + dy[near] ** 2 <= reach * reach]
        look, at = look[near], at[near]
        off, left, right = distances(dx[near], dy[near]), a.group[k.left[look]], rights[at]
        ok = (off <= k.limit[look]) & (off + k.plus <= upto) & (partner[left] != right)
        found.append((off[ok] + k.plus, left[ok], right[ok]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _take(cost: np.ndarray, left: np.ndarray, right: np.ndarray, a: Queues, b: Queues, out: np.ndarray) -> None:
    """Takes offers cheapest first; of equal ones the first left goes first and takes the first right."""
    by = np.argsort(cost, kind="stable")
    cost, left, right = cost[by], left[by], right[by]
    (ha, ea), (hb, eb) = (a.head, a.end), (b.head, b.end)
    alone = [np.array(e) - np.array(h) == 1 for h, e in ((ha, ea), (hb, eb))]
    for _ in range(3):  # those that are first on both sides and alone in that go at once, which leaves few for the loop
        first, number = [np.empty(len(k), np.int64) for k in alone], np.arange(len(cost))
        first[0][left[::-1]], first[1][right[::-1]] = number[::-1], number[::-1]
        single = np.ones(len(cost), bool)
        single[1:] &= cost[1:] != cost[:-1]
        single[:-1] &= cost[1:] != cost[:-1]
        at = np.flatnonzero((first[0][left] == number) & (first[1][right] == number) & alone[0][left] & alone[1][right] & single)
        for g, h in zip(left[at].tolist(), right[at].tolist()):
            out[b.row[hb[h]]] = a.row[ha[g]]
            ha[g], hb[h] = ha[g] + 1, hb[h] + 1
        gone = [np.zeros(len(k), bool) for k in alone]
        gone[0][left[at]], gone[1][right[at]] = True, True
        rest = ~(gone[0][left] | gone[1][right])
        cost, left, right = cost[rest], left[rest], right[rest]
    cost, left, right, i, n = cost.tolist(), left.tolist(), right.tolist(), 0, int(rest.sum())
    while i < n:
        g, h = left[i], right[i]
        if ha[g] == ea[g] or hb[h] == eb[h]:
            i += 1
            continue
        j = i + 1
        while j < n and cost[j] == cost[i]:
            j += 1
        if j == i + 1:
            for _ in range(min(ea[g] - ha[g], eb[h] - hb[h])):
                out[b.row[hb[h]]] = a.row[ha[g]]
                ha[g], hb[h] = ha[g] + 1, hb[h] + 1
        else:
            for m, o in _equal(left[i:j], right[i:j], a, b):
                out[o] = m
        i = j


def _equal(left: list[int], right: list[int], a: Queues, b: Queues) -> Iterator[tuple[int, int]]:
    """(left, right) of offers at one cost."""
    met: dict[int, list] = {}
    for g, h in zip(left, right):
        if a.head[g] < a.end[g] and b.head[h] < b.end[h]:
            met.setdefault(g, []).append((b.row[b.head[h]], h))
    for hs in met.values():
        heapq.heapify(hs)
    heap = [(a.row[a.head[g]], g) for g in met]
    heapq.heapify(heap)
    while heap:
        row, g = heapq.heappop(heap)
        hs = met[g]
        while hs and (b.head[h := hs[0][1]] == b.end[h] or b.row[b.head[h]] != hs[0][0]):
            if b.head[h] == b.end[h]:
                heapq.heappop(hs)
            else:
                heapq.heapreplace(hs, (b.row[b.head[h]], h))
        if hs:
            yield row, hs[0][0]
            h = hs[0][1]
            a.head[g], b.head[h] = a.head[g] + 1, b.head[h] + 1
            if a.head[g] < a.end[g]:
                heapq.heappush(heap, (a.row[a.head[g]], g))


def nearest_place(x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(right, distance) of the nearest right within the limit for each place, the first one on ties; -1 where there is none.

    Distances are roots of sums of squares, as in the SQL.  Rights are looked for within a reach that grows: what is found in it is the nearest.
    """
    hit, far = np.full(len(x), -1, np.int64), np.full(len(x), np.inf)
    left, reach, done, none = np.arange(len(x)), limit, 0.0, np.zeros(len(rx), np.int64)
    while len(left) and len(rx):
        most = min(MOST_MET, FEW_MET * (len(left) + len(rx)) + 4096)
        while True:
            order, start, end = in_cells(x[left], y[left], np.zeros(len(left), np.int64), rx, ry, none, reach)
            total = np.cumsum((end - start).sum(axis=0))
            if total[-1] <= most or reach <= max(1.25 * done, 1e-9 * limit):
                break
            reach = max(reach * min(0.9 * math.sqrt(most / int(total[-1])), 0.5), 1.25 * done)
        cuts = np.unique(np.searchsorted(total, np.arange(1, 1 + int(total[-1]) // MOST_MET) * MOST_MET)).tolist()
        for i, j in zip([0, *cuts], [*cuts, len(total)]):
            look, at = spread(start[:, i:j], end[:, i:j])
            look, at = left[look + i], order[at]
            dx, dy = x[look] - rx[at], y[look] - ry[at]
            d = np.sqrt(dx * dx + dy * dy)
            near = np.flatnonzero(d <= reach)
            look, at, d = look[near], at[near], d[near]
            by = np.lexsort((at, d, look))
            first = by[np.r_[True, look[by][1:] != look[by][:-1]]] if len(by) else by
            hit[look[first]], far[look[first]] = at[first], d[first]
        if reach >= limit:
            break
        left, done = left[hit[left] < 0], reach
        reach = min(limit, reach * min(max(math.sqrt(most / max(int(total[-1]), 1)), 1.5), 4.0))
    return hit, far
