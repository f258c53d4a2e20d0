"""Snapping where each point meets every wall and every crossing: what the grids are compared with."""

from __future__ import annotations

import numpy as np

EPS = 1e-7


class Region:
    """Allowed and forbidden rings of a floor, as edge arrays (n, 4)."""

    def __init__(self, allowed: list[np.ndarray], forbidden: list[np.ndarray], margin: float):
        self.allowed, self.forbidden, self.margin = allowed, forbidden, margin

    @staticmethod
    def _distance(p: np.ndarray, e: np.ndarray) -> np.ndarray:
        d = e[:, 2:] - e[:, :2]
        n = np.maximum((d * d).sum(axis=1), 1e-300)
        t = np.clip(((p[:, None, :] - e[None, :, :2]) * d).sum(axis=2) / n, 0, 1)
        return np.hypot(*np.moveaxis(p[:, None, :] - (e[:, :2] + t[:, :, None] * d), 2, 0))

    @staticmethod
    def _inside(p: np.ndarray, e: np.ndarray) -> np.ndarray:
        y, (ax, ay, bx, by) = p[:, 1:], e.T
        cross = (ay > y) != (by > y)
        at = (bx - ax) * (y - ay) / np.where(by == ay, 1.0, by - ay) + ax
        return (cross & (p[:, :1] < at)).sum(axis=1) % 2 == 1

    def _covered(self, p: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(p), bool)
        for e in rings:
            out |= self._inside(p, e) | (self._distance(p, e).min(axis=1) <= EPS)
        return out

    def clear(self, p: np.ndarray) -> np.ndarray:
        """At least the margin away from every forbidden zone, and outside."""
        out = np.ones(len(p), bool)
        for e in self.forbidden:
            out &= ~self._inside(p, e) & (self._distance(p, e).min(axis=1) >= self.margin - EPS)
        return out

    def valid(self, p: np.ndarray) -> np.ndarray:
        return self.clear(p) & (self._covered(p, self.allowed) if self.allowed else True)

    def _lines(self) -> np.ndarray:
        """Allowed edges and both offsets of forbidden edges."""
        out = [*self.allowed]
        for e in self.forbidden:
            d = e[:, 2:] - e[:, :2]
            normal = np.stack([-d[:, 1], d[:, 0]], axis=1) / np.maximum(np.hypot(d[:, 0], d[:, 1]), 1e-300)[:, None]
            for side in (1, -1):
                out.append(e + np.tile(normal * self.margin * side, 2))
        return np.concatenate(out) if out else np.zeros((0, 4))

    def crossings(self) -> np.ndarray:
        lines = self._lines()
        points = [lines[:, :2], lines[:, 2:]]
        for i in range(len(lines)):
            a, b = lines[i], lines[i + 1 :]
            da, db = a[2:] - a[:2], b[:, 2:] - b[:, :2]
            det = da[0] * db[:, 1] - da[1] * db[:, 0]
            ok = np.abs(det) > 1e-12
            t = ((b[ok, 0] - a[0]) * db[ok, 1] - (b[ok, 1] - a[1]) * db[ok, 0]) / det[ok]
            u = ((b[ok, 0] - a[0]) * da[1] - (b[ok, 1] - a[1]) * da[0]) / det[ok]
            hit = (t >= -EPS) & (t <= 1 + EPS) & (u >= -EPS) & (u <= 1 + EPS)
            points.append(a[:2] + t[hit, None] * da)
        corners = [e[:, :2] for e in self.forbidden]
        for c in np.concatenate(corners) if corners else ():
            d = lines[:, 2:] - lines[:, :2]
            f = lines[:, :2] - c
            qa, qb, qc = (d * d).sum(axis=1), 2 * (f * d).sum(axis=1), (f * f).sum(axis=1) - self.margin**2
            disc = qb * qb - 4 * qa * qc
            ok = (disc >= 0) & (qa > 0)
            for sign in (1, -1):
                t = (-qb[ok] + sign * np.sqrt(disc[ok])) / (2 * qa[ok])
                hit = (t >= 0) & (t <= 1)
                points.append(lines[ok][hit, :2] + t[hit, None] * d[ok][hit])
        return np.concatenate(points)

    def snap(self, p: np.ndarray) -> np.ndarray:
        if not self.allowed:
            # Only forbidden zones: a point on one goes to the nearest point of its grown boundary.
            todo = self._covered(p, self.forbidden) if self.forbidden else np.zeros(len(p), bool)
        else:
            todo = ~self.valid(p)
        out = p.copy()
        if not todo.any():
            return out
        q = p[todo]
        lines, fixed = self._lines(), self.crossings()
        fixed = fixed[self.valid(fixed)] if len(fixed) else fixed
        best, at = np.full(len(q), np.inf), q.copy()

        def offer(c: np.ndarray) -> None:
            """Candidates (points, many, 2)."""
            nonlocal best, at
            d = np.hypot(*np.moveaxis(c - q[:, None, :], 2, 0))
            good = self.valid(c.reshape(-1, 2)).reshape(d.shape)
            d = np.where(good, d, np.inf)
            k = d.argmin(axis=1)
            near = d[np.arange(len(q)), k]
            win = near < best
            at[win], best[win] = c[np.arange(len(q)), k][win], near[win]

        d = lines[:, 2:] - lines[:, :2]
        t = np.clip(((q[:, None, :] - lines[None, :, :2]) * d).sum(axis=2) / np.maximum((d * d).sum(axis=1), 1e-300), 0, 1)
        offer(lines[:, :2] + t[:, :, None] * d)
        corners = np.concatenate([e[:, :2] for e in self.forbidden]) if self.forbidden else np.zeros((0, 2))
        if len(corners):
            away = q[:, None, :] - corners
            size = np.maximum(np.hypot(away[:, :, 0], away[:, :, 1]), 1e-300)[:, :, None]
            offer(corners + away / size * self.margin)
        if len(fixed):
            gap = np.hypot(q[:, None, 0] - fixed[:, 0], q[:, None, 1] - fixed[:, 1])
            k = gap.argmin(axis=1)
            near = gap[np.arange(len(q)), k]
            win = near < best
            at[win], best[win] = fixed[k][win], near[win]
        out[todo] = at
        return out
