"""One-to-one matchings of places in a plane of many: what is near is looked up as it is needed, so that no table of all pairs is held."""

from __future__ import annotations

import heapq
import math

import numpy as np

from ..functions.geo import EARTH_KM
from .windows import Points


class Nearby:
    """The columns (places) of each row (place), nearest first and ties by number, known as far out as they were asked for; past ``most`` held entries the lists are looked up anew."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, to_lat: np.ndarray, to_lon: np.ndarray, most: int = 10_000_000):
        self.lat, self.lon = np.radians(np.asarray(lat, float)), np.radians(np.asarray(lon, float))
        self.points = Points(to_lat, to_lon)
        self.n, self.m, self.most, self.held = len(self.lat), self.points.n, most, 0
        self.reach = np.full(self.n, self.points.reach())
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def upto(self, i: int, km: float = -1.0, count: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(kilometres, columns) of row ``i``: all within ``km``, at least ``count`` of them, or all there are."""
        known = self.lists.get(i)
        while known is None or len(known[0]) < self.m and (len(known[0]) < count or self.reach[i] < km):
            if known is not None:
                self.reach[i] = max(self.reach[i] * 1.5, km)
                self.held -= len(known[0])
            at = self.points.window(self.lat[i], self.lon[i], self.reach[i])
            away = self.points.km_from(self.lat[i], self.lon[i], at)
            if len(at) < self.m:
                at, away = at[away <= self.reach[i]], away[away <= self.reach[i]]
            order = np.lexsort((at, away))
            known = self.lists[i] = away[order], at[order]
            self.held += len(at)
        if self.held > self.most:
            self.lists, self.held = {i: known}, len(known[0])
        return known


def closest_first(lat: np.ndarray, lon: np.ndarray, to_lat: np.ndarray, to_lon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, kilometres) of the pairs that a scan of all pairs, the closest first and ties by row, then column, would take: each row and column once.

    Every row waits with its nearest free column; one whose column is gone looks anew. The columns are dealt to cells again whenever half of them are gone.
    """
    lat, lon, to_lat, to_lon = (np.asarray(v, float) for v in (lat, lon, to_lat, to_lon))
    left, points = np.arange(len(to_lat)), Points(to_lat, to_lon)
    free, n = np.ones(len(left), bool), len(left)
    place = np.arange(len(to_lat))

    def best(i: int) -> tuple[float, int, int]:
        y, x, reach = math.radians(lat[i]), math.radians(lon[i]), points.reach()
        while True:
            at = points.window(y, x, reach)
            whole = len(at) == points.n
            at = at[free[at]]
            if len(at):
                # Differences are taken in degrees, as ``geo.haversine`` takes them, so that the same pairs tie.
                to = left[at]
                h = np.sin(np.radians(to_lat[to] - lat[i]) / 2) ** 2 + math.cos(y) * points.cos[at] * np.sin(np.radians(to_lon[to] - lon[i]) / 2) ** 2
                away = 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1.0, h)))
                least = away.min()
                if least <= reach or whole:
                    return float(least), i, int(to[away == least].min())
            reach *= 2

    queue = [best(i) for i in range(len(lat))] if n else []
    heapq.heapify(queue)
    rows, columns, kms = [], [], []
    while queue and n:
        km, i, j = queue[0]
        if place[j] >= 0 and free[place[j]]:
            heapq.heappop(queue)
            rows.append(i)
            columns.append(j)
            kms.append(km)
            free[place[j]] = False
            n -= 1
            if n and 2 * n < len(left):
                gone = left[~free]
                left = left[free]
                points, free = Points(to_lat[left], to_lon[left]), np.ones(n, bool)
                place[gone], place[left] = -1, np.arange(n)
        else:
            heapq.heapreplace(queue, best(i))
    return np.array(rows, int), np.array(columns, int), np.array(kms, float)


def least_sum(near: Nearby, limit: float = np.inf) -> np.ndarray:
    """The column of each row (rows <= columns) in a one-to-one assignment of least total distance, over pairs at most ``limit`` apart: shortest augmenting paths.

    A path goes on to a row's next column only when nothing nearer is left: prices of columns are never above zero, so the distance of the next one bounds all that follow.
    """
    u, v, row_of, to = np.zeros(near.n), np.zeros(near.m), np.full(near.m, -1), np.full(near.n, -1)
    for i in range(near.n):
        best: dict[int, float] = {}
        back: dict[int, int] = {}
        done: dict[int, float] = {}
        queue: list[tuple] = []
        end = np.inf  # the shortest way to a free column so far

        def next_of(row: int, low: float, k: int) -> None:
            kms, columns = near.upto(row, count=k + 1)
            if k < len(kms) and kms[k] <= limit and (at := low + kms[k] - u[row]) < end:  # noqa: B023
                heapq.heappush(queue, (at, 1, row, k, low, int(columns[k])))  # noqa: B023

        next_of(i, 0.0, 0)
        while True:
            if not queue:
                raise ValueError("no one-to-one assignment within the limit")
            at, kind, x, k, low, column = heapq.heappop(queue)
            if kind:
                way = at - v[column]
                if column not in done and way < best.get(column, np.inf):
                    best[column], back[column] = way, x
                    heapq.heappush(queue, (way, 0, column, 0, 0.0, column))
                    if row_of[column] < 0:
                        end = min(end, way)
                next_of(x, low, k + 1)
            elif column not in done:
                if row_of[column] < 0:
                    break
                done[column] = at
                next_of(int(row_of[column]), at, 0)
        u[i] += at
        for c, low in done.items():
            u[row_of[c]] += at - low
            v[c] -= at - low
        while column >= 0:
            row = back[column]
            before = int(to[row])
            to[row], row_of[column] = column, row
            column = before
    return to


def least_most(near: Nearby) -> float:
    """The least distance within which all rows (rows <= columns) can have a column of their own: each row in turn takes the path whose longest new step is shortest."""
    row_of, to, level = np.full(near.m, -1), np.full(near.n, -1), 0.0
    after = np.zeros(near.n, int)  # the first column that may be free: taken ones stay taken
    seen = np.zeros(near.m, bool)

    def free(row: int) -> tuple[float, int]:
        while True:
            kms, columns = near.upto(row, count=int(after[row]) + 1)
            open_ = row_of[columns[after[row] :]] < 0
            if open_.any():
                after[row] += int(open_.argmax())
                return float(kms[after[row]]), int(columns[after[row]])
            after[row] = len(columns)
            if len(columns) == near.m:
                return np.inf, -1

    for i in range(near.n):
        back, touched = {}, []
        queue: list[tuple] = [(level, 0, i, -1)]
        end: tuple = (np.inf, -1, -1)
        count = 0
        while queue and queue[0][0] < end[0]:
            at, _, row, k = heapq.heappop(queue)
            if k < 0:
                k = 0
                km, column = free(row)
                if max(at, km) < end[0]:
                    end = (max(at, km), row, column)
                if end[0] <= at:
                    break
            kms, columns = near.upto(row, km=at, count=k + 1)
            stop = int(np.searchsorted(kms, at, side="right"))
            if stop < len(kms):
                count += 1
                heapq.heappush(queue, (float(kms[stop]), count, row, stop))
            new = columns[k:stop] if k < stop else columns[:0]
            new = new[~seen[new] & (row_of[new] >= 0)]
            seen[new] = True
            touched.append(new)
            for column in new.tolist():
                back[column] = row
                count += 1
                heapq.heappush(queue, (at, count, int(row_of[column]), -1))
        for new in touched:
            seen[new] = False
        level, row, column = end
        while True:
            before = int(to[row])
            to[row], row_of[column] = column, row
            if row == i:
                break
            column, row = before, back[before]
    return level
