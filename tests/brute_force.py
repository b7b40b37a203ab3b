"""Quadratic density clustering of one station in numpy, written apart from the library.

Works on single rows (duplicates included), top-down on the dendrogram instead of bottom-up."""

from __future__ import annotations

import numpy as np


def distances(lat, lon):
    lat, lon = np.radians(lat), np.radians(lon)
    h = (
        np.sin((lat[:, None] - lat[None, :]) / 2) ** 2
        + np.cos(lat)[:, None] * np.cos(lat)[None, :] * np.sin((lon[:, None] - lon[None, :]) / 2) ** 2
    )
    return 2 * np.arcsin(np.sqrt(h))


def cluster(lat, lon, min_size: int, min_samples: int | None = None) -> list[int]:
    """Label per row, -1 for noise; label values are arbitrary."""
    n = len(lat)
    labels = [-1] * n
    if n < min_size:
        return labels
    k = max(1, min(n - 1, min_samples or min_size))
    d = distances(np.asarray(lat), np.asarray(lon))
    core = np.sort(d, axis=1)[:, k]
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    reach = np.rint(reach * 1e14) / 1e14

    def parts(rows: list[int], below: float) -> list[list[int]]:
        """Components of rows over links strictly lighter than `below`."""
        left, found = set(rows), []
        while left:
            seed = left.pop()
            comp, stack = [seed], [seed]
            while stack:
                i = stack.pop()
                near = [j for j in left if reach[i, j] < below]
                for j in near:
                    left.discard(j)
                comp += near
                stack += near
            found.append(comp)
        return found

    def heaviest(rows: list[int]) -> float:
        """Heaviest link of a minimum spanning tree of rows."""
        inside = [rows[0]]
        best = {j: reach[rows[0], j] for j in rows[1:]}
        top = 0.0
        while best:
            j = min(best, key=best.get)
            top = max(top, best.pop(j))
            inside.append(j)
            for i in best:
                best[i] = min(best[i], reach[j, i])
        return top

    def grow(rows: list[int], birth: float):
        """A condensed cluster: (stability, chosen clusters below or itself)."""
        stability, members, current = 0.0, list(rows), list(rows)
        while True:
            weight = heaviest(current) if len(current) > 1 else 0.0
            lam = np.inf if weight == 0 else 1 / weight
            pieces = [current] if weight == 0 else parts(current, weight)
            large = [p for p in pieces if len(p) >= min_size and weight > 0]
            if len(large) == 1:
                stability += (len(current) - len(large[0])) * (lam - birth)
                current = large[0]
                continue
            stability += len(current) * (lam - birth)
            kids = [grow(p, lam) for p in large]
            below = sum(s for s, _ in kids)
            if kids and below > stability:
                return below, [c for _, chosen in kids for c in chosen]
            return stability, [members]

    current = list(range(n))
    while True:  # the root: never chosen itself
        weight = heaviest(current)
        pieces = parts(current, weight) if weight > 0 else []
        large = [p for p in pieces if len(p) >= min_size]
        if len(large) == 1:
            current = large[0]
            continue
        for number, part in enumerate(c for p in large for c in grow(p, 1 / weight)[1]):
            for i in part:
                labels[i] = number
        return labels
