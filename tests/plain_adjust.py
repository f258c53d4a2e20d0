"""Zone clean-up of one floor at a time, one ring after another: what the Spark operators are compared with."""

from __future__ import annotations

import numpy as np

from spatiotrack.constants import DEFAULTS, Settings
from spatiotrack.functions import rings as rg
from spatiotrack.operators.adjust import dedupe, square


def weld(rings: list[np.ndarray], fixed: list[bool], s: Settings = DEFAULTS) -> list[np.ndarray]:
    """Rings whose near vertices meet and whose vertices lie on near walls; fixed rings attract and stay."""
    tol = s.tolerance_px
    owner = np.concatenate([np.full(len(r), i) for i, r in enumerate(rings)])
    start = np.cumsum([0] + [len(r) for r in rings])
    p = np.concatenate(rings)
    # Pairs of vertices that are near in x, from a sweep; only those are measured.
    by_x = np.argsort(p[:, 0], kind="stable")
    last = np.searchsorted(p[by_x, 0], p[by_x, 0] + tol, "right")
    many = last - np.arange(len(p)) - 1
    i = np.repeat(np.arange(len(p)), many)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
    a, b = by_x[i], by_x[j]
    a, b = np.where(owner[a] < owner[b], a, b), np.where(owner[a] < owner[b], b, a)
    gap = np.sqrt(((p[a] - p[b]) ** 2).sum(axis=1))
    near = (gap <= tol) & (owner[a] != owner[b])
    a, b, gap = a[near], b[near], gap[near]
    group = np.arange(len(p))
    members = {i: [i] for i in range(len(p))}
    # Nearest pairs first; a corner never holds two vertices of one ring.
    for k in np.lexsort((b, a, gap)):
        x, y = group[a[k]], group[b[k]]
        if x == y or set(owner[members[x]]) & set(owner[members[y]]):
            continue
        members[x] += members.pop(y)
        group[members[x]] = x
    to = p.copy()
    held = np.array(fixed)[owner]
    for m in members.values():
        if len(m) < 2:
            continue
        m = np.array(sorted(m))
        at = p[m[held[m]][0]] if held[m].any() else p[m].mean(axis=0)
        to[m[~held[m]]] = at
    ends = np.concatenate([np.roll(r, -1, axis=0) for r in rings])
    d = ends - p
    size = np.maximum(np.hypot(d[:, 0], d[:, 1]), 1e-300)
    inserts: dict[int, list] = {}
    for i in np.flatnonzero(~held & (to == p).all(axis=1)):
        along = ((p[i] - p) * d).sum(axis=1) / size
        foot = p + (np.clip(along, 0, size) / size)[:, None] * d
        off = np.hypot(*(p[i] - foot).T)
        off[(owner == owner[i]) | (off > tol) | (along <= tol) | (along >= size - tol)] = np.inf
        k = int(off.argmin())
        if np.isfinite(off[k]):
            to[i] = foot[k]
            if not held[k]:
                inserts.setdefault(k, []).append(foot[k])
    out = []
    for j in range(len(rings)):
        walk = []
        for k in range(start[j], start[j + 1]):
            walk.append(to[k])
            walk += sorted(inserts.get(k, []), key=lambda q, o=to[k]: float(np.hypot(*(q - o))))
        out.append(dedupe(np.array(walk), s.min_edge_px))
    return out


def _largest(rings: list[np.ndarray]) -> np.ndarray | None:
    return max(rings, key=lambda r: abs(rg.signed_area(r)), default=None)


def adjust_group(
    originals: list[np.ndarray], s: Settings = DEFAULTS, straighten: bool = True, fixed: list[np.ndarray] = (), clamp: np.ndarray | None = None, made: list[tuple[np.ndarray, bool]] | None = None
) -> tuple[list[np.ndarray], list[bool], list[str]]:
    """Finished rings, whether each was squared, and a note for each ('' if none); ``made``: the squared rings, if they are known."""
    made = made or [square(r, s) if straighten else (r, False) for r in originals]
    rings, squared = [m[0] for m in made], [m[1] for m in made]
    notes = [""] * len(originals)
    welded = weld([*rings, *fixed], [False] * len(rings) + [True] * len(fixed), s)[: len(rings)]
    area = lambda r: abs(rg.signed_area(r)) if len(r) >= 3 else 0.0
    low, high = np.full((len(welded), 2), np.inf), np.full((len(welded), 2), -np.inf)
    for i, r in enumerate(welded):
        if area(r) < 0.5 * area(originals[i]):
            welded[i], notes[i] = originals[i], "kept as drawn: over half of its area would be lost"
    done: list[np.ndarray] = []
    out = list(welded)
    for i in sorted(range(len(welded)), key=lambda i: -area(welded[i])):
        parts = [rg.turned(welded[i])]
        # Only rings whose boxes overlap can share anything.
        a, b = (welded[i].min(axis=0), welded[i].max(axis=0)) if len(welded[i]) else (np.inf, -np.inf)
        for k in np.flatnonzero((low < b).all(axis=1) & (high > a).all(axis=1)):
            other = done[k]
            parts = [q for part in parts for q in rg.clip(part, other, keep_inside=False)]
        left = _largest(parts)
        if left is not None and len(left) >= 3:
            out[i] = rg.tidy(left) if len(parts) != 1 or not np.array_equal(left, rg.turned(welded[i])) else welded[i]
            low[len(done)], high[len(done)] = out[i].min(axis=0), out[i].max(axis=0)
            done.append(rg.turned(out[i]))
    if clamp is not None:
        for i, r in enumerate(out):
            if (rg.inside(r, clamp) | (rg.boundary_distance(r, clamp) < rg.EPS)).all():
                continue
            inner = _largest(rg.clip(r, clamp, keep_inside=True))
            if inner is not None and area(inner) > 1:
                out[i] = rg.tidy(inner)
            else:
                notes[i] = "not inside its parent zone"
    return out, squared, notes
