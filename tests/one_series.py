"""Motif discovery in one series, all rounds in plain Python and numpy: what the rounds over all series are compared with."""

import numpy as np

from subseqrules.functions import kernels as K
from subseqrules.functions import mining as M


def greedy_neighbours(d: np.ndarray, i: int, k: int, h: int) -> list[tuple[int, float]]:
    """The k nearest starts that don't overlap each other, the anchor first at 0; zones are [p - h, p + h)."""
    d = d.copy()
    d[max(0, i - h) : i + h] = np.inf
    d[i] = 0.0
    out = []
    for _ in range(k):
        p = int(d.argmin())
        if not np.isfinite(d[p]):
            break
        out.append((p, float(d[p])))
        d[max(0, p - h) : max(p + h, p + 1)] = np.inf
    return out


def set_extent(v: np.ndarray, m: int, starts: np.ndarray, kind: str) -> np.ndarray:
    """extent[k - 1]: the largest distance among the first k starts."""
    d, n = M.set_distances(np.stack([v[s : s + m] for s in starts]), kind), len(starts)
    top = np.maximum.accumulate(np.array([d[i, :i].max() if i else -np.inf for i in range(n)]))
    return np.where(np.isfinite(top) | (np.arange(n) > 0), top, 0.0)


def best_sets(v: np.ndarray, m: int, lists: dict[int, list[tuple[int, float]]], cfg, digits: int = 8) -> dict[int, tuple]:
    """For each size k (extent, distance of the k-th, start, members): the start whose first k neighbours have the least extent."""
    best: dict[int, tuple] = {}
    most = max(3, min(int(len(v) // (m * cfg.slack)), cfg.k_max))
    for start, near in lists.items():
        nbr = np.array([p for p, _ in near[:most]], int)
        extent = set_extent(v, m, nbr, cfg.distance)
        for k in range(2, min(most - 1, len(near)) + 1):
            row = (round(float(extent[k - 1]), digits), round(near[k - 1][1], digits), start, nbr[:k].tolist())
            best[k] = min(best.get(k, row), row)
    return best


def extents(best: dict[int, tuple]) -> np.ndarray:
    """The extent function by size from 0; infinite where a size has no set."""
    return np.array([best[max(k, 2)][0] if max(k, 2) in best else np.inf for k in range(max(best, default=-1) + 1)])


def neighbour_lists(v: np.ndarray, m: int, cfg) -> dict[int, list[tuple[int, float]]]:
    if len(v) < m:
        return {}
    d = K.block_distances(v, m, np.arange(len(v) - m + 1), cfg.distance)
    return {i: greedy_neighbours(own, i, cfg.k_max, int(m * cfg.slack)) for i, own in enumerate(d)}


def learned_length(v: np.ndarray, cfg) -> int | None:
    """The length whose scaled extent function has the least mean, on every subsample-th point."""
    found = []
    for m in sorted({x // cfg.subsample for x in cfg.lengths() if x // cfg.subsample >= 2}):
        if len(e := extents(best_sets(v[:: cfg.subsample], m, neighbour_lists(v[:: cfg.subsample], m, cfg), cfg))):
            e = e[np.isfinite(e)]
            spread = float(np.ptp(e)) if len(e) else 0.0
            found.append((float(((e - e.min()) / spread).mean()) if spread else 1.0, m * cfg.subsample))
    return min(found)[1] if found else None


def all_rounds(v: np.ndarray, cfg, m: int | None = None) -> list[tuple[dict, list[tuple[int, int, float]]]]:
    """(class row, occurrences) of every round over one short series, until no free run of delta_lo is left."""
    n, out = len(v), []
    m = m or learned_length(v, cfg)
    lists = neighbour_lists(v, m, cfg) if m else {}
    free = np.ones(n, bool)
    while True:
        edges = np.flatnonzero(np.diff(np.concatenate(([0], free.astype(np.int8), [0]))))
        runs = [(b - a, -a) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]
        size, at = max(runs, default=(0, 0))
        if size < cfg.delta_lo:
            return out
        members, width = [-at], min(size, cfg.delta_hi)
        if m:
            whole = np.convolve(free, np.ones(m), "valid") == m
            left = {}
            for i, near in lists.items():
                bad = next((k for k, (p, _) in enumerate(near) if not whole[p]), len(near))
                if bad:
                    left[i] = near[:bad]
            best = best_sets(v, m, left, cfg)
            if best and (k := K.elbow_points(extents(best))[0]) in best:
                members, width = [], m
                for p in sorted(best[k][3]):
                    if not members or p >= members[-1] + int(m * cfg.minimum_interval):
                        members.append(p)
        row, own = M.fit_class(v, members, width, cfg)
        shape = (row["breaks"], row["slopes"], row["intercepts"])
        hits = M.longest_matches(v, np.flatnonzero(free), shape, epsilon=row["epsilon"], bound=row["lam_min_bound"], lo=row["delta_lo"], hi=row["delta_hi"], step=cfg.double_step, rate=cfg.window_rate, kind=cfg.error_kind, gamma=row["gamma"], penalty=cfg.gamma_penalty)
        found: list[tuple[int, int, float]] = []
        for t, d, x, _ in sorted(hits):
            if not found or t >= found[-1][0] + int(found[-1][1] * cfg.minimum_interval) + 1:
                found.append((t, d, x))
        out.append((row, found))
        for t, d, _ in found or own:
            free[t : min(t + int(d * cfg.minimum_interval) + 1, n)] = False
