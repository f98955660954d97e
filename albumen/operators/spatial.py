"""A packed k-d tree over points of the sphere, searched for many spots at once."""

from __future__ import annotations

import numpy as np

LEAF = 32
#: Chords are compared with this slack, so that rounding never rules out what might be nearest.
SLACK = 1e-9


def on_sphere(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    up, along = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(up) * np.cos(along), np.cos(up) * np.sin(along), np.sin(up)], axis=1)


class KdTree:
    """Points given by latitude and longitude in degrees, halved at the median of the axis in
    which they spread most. The arrays are all there is: points in the order of the leaves, and
    for each node its range in that order and its box; node i has the halves 2i + 1 and 2i + 2."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray):
        self.lat, self.lon = np.asarray(lat, np.float64), np.asarray(lon, np.float64)
        points = on_sphere(self.lat, self.lon)
        self.order = np.arange(len(points))
        self.first: dict[int, int] = {}
        self.end: dict[int, int] = {}
        self.low: dict[int, np.ndarray] = {}
        self.high: dict[int, np.ndarray] = {}
        todo = [(0, 0, len(points))] if len(points) else []
        while todo:
            node, a, b = todo.pop()
            mine = points[self.order[a:b]]
            self.first[node], self.end[node] = a, b
            self.low[node], self.high[node] = mine.min(axis=0), mine.max(axis=0)
            if b - a > LEAF:
                axis = int((self.high[node] - self.low[node]).argmax())
                half = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(mine[:, axis], half)]
                todo += [(2 * node + 1, a, a + half), (2 * node + 2, a + half, b)]
        self.points = points[self.order]

    def nearest(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest point, half the versine of the arc) of each spot; of points at one
        distance the least index. Without points all indices are -1."""
        lat, lon = np.asarray(lat, np.float64), np.asarray(lon, np.float64)
        at, best = np.full(len(lat), -1), np.full(len(lat), np.inf)
        if len(self.points) and len(lat):
            self._spots = (on_sphere(lat, lon), np.radians(lat), np.radians(lon))
            self._visit(0, np.arange(len(lat)), best, at)
        return at, best

    def _gap(self, node: int, rows: np.ndarray) -> np.ndarray:
        """A lower bound of the squared half chord from spots to a node's box."""
        spots = self._spots[0][rows]
        d = np.maximum(np.maximum(self.low[node] - spots, spots - self.high[node]), 0)
        return np.einsum("ij,ij->i", d, d) / 4

    def _visit(self, node: int, rows: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        if self.end[node] - self.first[node] <= LEAF:
            index = self.order[self.first[node] : self.end[node]]
            up, along = self._spots[1][rows, None], self._spots[2][rows, None]
            a, o = np.radians(self.lat[index])[None], np.radians(self.lon[index])[None]
            h = np.sin((a - up) / 2) ** 2 + np.cos(up) * np.cos(a) * np.sin((o - along) / 2) ** 2
            nearest = h.min(axis=1)
            which = np.where(h == nearest[:, None], index[None], len(self.order)).min(axis=1)
            better = (nearest < best[rows]) | ((nearest == best[rows]) & (which < at[rows]))
            best[rows[better]], at[rows[better]] = nearest[better], which[better]
            return
        children = (2 * node + 1, 2 * node + 2)
        gaps = [self._gap(c, rows) for c in children]
        left_first = gaps[0] <= gaps[1]
        for own in (0, 1):  # each spot's nearer half first
            part = left_first if own == 0 else ~left_first
            if part.any():
                self._visit(children[own], rows[part], best, at)
        for other in (0, 1):
            part = (~left_first if other == 0 else left_first) & (gaps[other] <= best[rows] * (1 + SLACK) + SLACK**2)
            if part.any():
                self._visit(children[other], rows[part], best, at)
