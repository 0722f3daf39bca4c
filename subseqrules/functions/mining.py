"""Numpy helpers of motif classes and rules: class fits, occurrence scans, hypotheses and their evaluation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

from . import kernels as K


def set_distances(w: np.ndarray, kind: str) -> np.ndarray:
    """Distances between the windows in the rows of w; the diagonal is -inf."""
    m = w.shape[1]
    mean, std, sq = w.mean(axis=1), w.std(axis=1), (w * w).sum(axis=1)
    std = np.where(std < 1e-4, 0.1, std)
    dot = w @ w.T
    if kind == "znormed_ed":
        d = 2 * m * (1 - (dot - m * np.outer(mean, mean)) / (m * np.outer(std, std)))
    elif kind == "cosine":
        both = sq[:, None] + sq[None]
        d = 1 - np.divide(dot, both, out=np.zeros_like(dot), where=both != 0)
    else:
        d = sq[:, None] + sq[None] - 2 * dot
        if kind == "cid":
            c = (np.diff(w, axis=1) ** 2).sum(axis=1)
            hi, lo = np.maximum(c[:, None], c), np.minimum(c[:, None], c)
            d = d * np.where(lo > 0, hi / np.where(lo > 0, lo, 1), np.where(hi > 0, np.inf, 1.0))
    np.fill_diagonal(d, -np.inf)
    return d


def extent_of(w: np.ndarray, kind: str) -> float:
    """The largest distance among the windows in the rows of w."""
    return float(set_distances(w, kind).max()) if len(w) > 1 else 0.0


def set_extent(v: np.ndarray, m: int, starts: np.ndarray, kind: str) -> np.ndarray:
    """extent[k - 1]: the largest distance among the first k starts."""
    d, n = set_distances(np.stack([v[s : s + m] for s in starts]), kind), len(starts)
    top = np.maximum.accumulate(np.array([d[i, :i].max() if i else -np.inf for i in range(n)]))
    return np.where(np.isfinite(top) | (np.arange(n) > 0), top, 0.0)


def shape_error(v: np.ndarray, shape: tuple, rate: float, kind: str) -> tuple[float, float]:
    """(error of the values against the shape, their range)."""
    s = v - v[0]
    lam = float(s.max() - s.min())
    p = K.piecewise_predict(np.linspace(0, 1, len(v)), *shape) * lam
    return K.aggregate(K.align_error_norm(s, p, int(rate * len(v))), kind), lam


def fit_class(v: np.ndarray, starts: list[int], m: int, cfg) -> tuple[dict, list[tuple[int, int, float]]]:
    """A motif class from the members [s, s + m), and the members after their flat ends are cut."""
    first = v[starts[0] : starts[0] + m]
    a, b = K.trim_flat_ends(first, cfg.epsilon_m, cfg.delta_lo)
    starts, m = [s + a for s in starts], b - a
    own = v[starts[0] : starts[0] + m]
    x = np.linspace(0, 1, m) if m > 1 else np.zeros(m)
    shape = K.piecewise_fit(x, K.scaled(own, own[0]), cfg.n_segments, cfg.slope_window)
    errors, lams = zip(*(shape_error(v[s : s + m], shape, cfg.window_rate, cfg.error_kind) for s in starts))
    low = min(lams)
    epsilon = max(max(e for e in errors if np.isfinite(e)) if any(map(np.isfinite, errors)) else 0.0, min(cfg.epsilon_m, low / 2 + 1e-7)) + 1e-7
    row = {
        "kind": "piecewise", "breaks": shape[0], "slopes": shape[1], "intercepts": shape[2], "coef": [], "epsilon": float(epsilon),
        "lam_min_bound": float(min(2 * epsilon, low - 1e-7)), "delta_lo": int(min(cfg.delta_lo, m)), "delta_hi": int(min(cfg.longest_delta_rate * m, cfg.delta_hi)), "gamma": float(lams[0] / m),
    }
    return row, [(s, m, x) for s, x in zip(starts, lams)]


def rows_error(s: np.ndarray, t: np.ndarray, w: int) -> np.ndarray:
    """Alignment errors of each row of s against t, or the same row of t, with window w."""
    n, t = s.shape[1], np.atleast_2d(t)
    w = max(0, min(w, n - 1))
    sp, tp = (np.pad(x, ((0, 0), (w, w)), constant_values=np.inf) for x in (s, t))
    one, two = np.full(s.shape, np.inf), np.full(s.shape, np.inf)
    for o in range(2 * w + 1):
        np.minimum(one, np.abs(sp[:, o : o + n] - t), out=one)
        np.minimum(two, np.abs(s - tp[:, o : o + n]), out=two)
    return np.maximum(one, two)


def longest_matches(v: np.ndarray, starts: np.ndarray, shape: tuple, *, epsilon, bound, lo, hi, step, rate, kind, gamma, penalty) -> list[tuple[int, int, float, float]]:
    """(start, delta, lam, error) with the longest delta whose shape error is at most epsilon; delta from hi to lo by step."""
    out, left = [], np.sort(starts)
    for delta in range(hi, lo - 1, -step):
        here = left[left + delta <= len(v)]
        if not len(here) or delta < 2:
            continue
        t = K.piecewise_predict(np.linspace(0, 1, delta), *shape)
        r = t.max() - t.min()
        t = t / r if r else np.zeros(delta)
        found = []
        for k in range(0, len(here), 2048):
            part = here[k : k + 2048]
            w = sliding_window_view(v, delta)[part]
            lam = w.max(axis=1) - w.min(axis=1)
            ok = (lam >= bound) & (lam > 0)
            part, lam = part[ok], lam[ok]
            if not len(part):
                continue
            s = (w[ok] - w[ok][:, :1]) / lam[:, None]
            e = rows_error(s, t, int(rate * delta))
            e = e.max(axis=1) if kind == "max" else e.mean(axis=1)
            if gamma and penalty:
                q = lam / delta / gamma
                e = e * np.maximum(q, 1 / q) ** penalty
            good = e <= epsilon
            found += [(int(p), delta, float(x), float(z)) for p, x, z in zip(part[good], lam[good], e[good])]
        out += found
        left = np.setdiff1d(left, [p for p, *_ in found], assume_unique=True)
    return out


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
    return {i: K.greedy_neighbours(own, i, cfg.k_max, int(m * cfg.slack)) for i, own in enumerate(d)}


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
        row, own = fit_class(v, members, width, cfg)
        shape = (row["breaks"], row["slopes"], row["intercepts"])
        hits = longest_matches(v, np.flatnonzero(free), shape, epsilon=row["epsilon"], bound=row["lam_min_bound"], lo=row["delta_lo"], hi=row["delta_hi"], step=cfg.double_step, rate=cfg.window_rate, kind=cfg.error_kind, gamma=row["gamma"], penalty=cfg.gamma_penalty)
        found: list[tuple[int, int, float]] = []
        for t, d, x, _ in sorted(hits):
            if not found or t >= found[-1][0] + int(found[-1][1] * cfg.minimum_interval) + 1:
                found.append((t, d, x))
        out.append((row, found))
        for t, d, _ in found or own:
            free[t : min(t + int(d * cfg.minimum_interval) + 1, n)] = False


@dataclass
class PairData:
    """Occurrences (t1, delta, lam) of every left class, of the right class, and the right series with its shape."""

    lhs: list[np.ndarray]
    rhs: np.ndarray
    v: np.ndarray
    shape: tuple

    def need(self) -> int:
        n = len(self.lhs)
        return 4 if n == 1 else 3 * n + 1


def draw(data: PairData, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Features and targets of aligned tuples: one at random, the others by the nearest start at the same offsets."""
    n = max(len(data.lhs) + 1, data.need())
    if min(map(len, [*data.lhs, data.rhs])) < n:
        return None
    base = [int(rng.integers(len(o))) for o in [*data.lhs, data.rhs]]
    others = rng.permutation(np.setdiff1d(np.arange(len(data.lhs[0])), base[0]))[: n - 1]
    rows = [base]
    for i in others:
        shift = data.lhs[0][i, 0] - data.lhs[0][base[0], 0]
        rows.append([int(i), *(int(np.abs(o[:, 0] - (o[b, 0] + shift)).argmin()) for o, b in zip([*data.lhs[1:], data.rhs], base[1:]))])
    x = np.stack([np.concatenate([o[k] for o, k in zip(data.lhs, r)]) for r in rows])
    return x, data.rhs[[r[-1] for r in rows]]


def combinations(data: PairData, x: np.ndarray) -> np.ndarray:
    """Tuples of left occurrences: all of the first class; for more classes those whose starts a line from the first predicts."""
    first = data.lhs[0]
    combos = np.arange(len(first))[:, None]
    for pos in range(1, len(data.lhs)):
        o, a, b = data.lhs[pos], x[:, 0], x[:, 3 * pos]
        slope, icpt = (0.0, b.mean()) if a.std() < 1e-10 else np.polyfit(a, b, 1)
        at = np.rint(slope * first[combos[:, 0], 0] + icpt)
        over = np.minimum(at[:, None] + o[:, 1], o[:, 0] + o[:, 1]) - np.maximum(at[:, None], o[:, 0])
        combos = np.concatenate((combos, over.argmax(axis=1)[:, None]), axis=1)[over.max(axis=1) > 0]
    return combos


def longest_overlaps(a: np.ndarray, b: np.ndarray, occ: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the occurrence (t1, delta, ...) that overlaps each [a, b) longest, the first on ties; the overlap, 0 if none does)."""
    order = np.argsort(occ[:, 0], kind="stable")
    start, end = occ[order, 0], occ[order, 0] + occ[order, 1]
    lo, hi = np.searchsorted(np.maximum.accumulate(end), a, side="right"), np.searchsorted(start, b, side="left")
    best, size = np.zeros(len(a), int), np.zeros(len(a))
    rows, k = np.flatnonzero(lo < hi), 0
    while len(rows):
        at = lo[rows] + k
        over = np.minimum(b[rows], end[at]) - np.maximum(a[rows], start[at])
        better = (over > size[rows]) | ((over == size[rows]) & (over > 0) & (order[at] < best[rows]))
        size[rows[better]], best[rows[better]] = over[better], order[at[better]]
        k += 1
        rows = rows[lo[rows] + k < hi[rows]]
    return best, size


def per_hypothesis(h: np.ndarray, columns: list[np.ndarray], n: int) -> np.ndarray:
    """For each hypothesis the least over the columns of how many different values its rows have: no chain is longer."""
    out = np.full(n, np.iinfo(np.int64).max)
    for c in columns:
        pair = np.unique(np.stack((h, c), axis=1), axis=0)[:, 0] if len(h) else h
        out = np.minimum(out, np.bincount(pair, minlength=n))
    return out


def forecast_errors(data: PairData, t2: np.ndarray, d2: np.ndarray, lam: np.ndarray, rate: float, cells: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(largest, mean alignment error, range of the actual values) of the forecasts [t2, t2 + d2) of height lam, rows of equal length at once."""
    top, mean, size = np.empty((3, len(t2)))
    for d in np.unique(d2).tolist():
        rows, w = np.flatnonzero(d2 == d), min(int(d * rate), d - 1)
        unit = K.piecewise_predict(np.arange(d) / (d - 1), *data.shape)
        for k in range(0, len(rows), max(1, cells // d)):
            own = rows[k : k + max(1, cells // d)]
            actual = sliding_window_view(data.v, d)[t2[own]]
            e = rows_error(unit * lam[own][:, None] + actual[:, :1], actual, w)
            top[own], mean[own], size[own] = e.max(axis=1), e.mean(axis=1), np.ptp(actual, axis=1)
    return top, mean, size


def best_of_draws(data: PairData, draws: dict[int, tuple[np.ndarray, np.ndarray]], *, epsilon_rate: float, rate: float, kind: str, floor: int = 0, fall_back: bool = False) -> tuple | None:
    """(hypothesis, coefficients, its evaluation) of the best among draws (features, targets by hypothesis), None if none chains more
    matches than there are left classes. All are fitted and predicted at once; hypotheses come in the order of how many matches
    they could chain, counted by different occurrences in reach, and end where that is below the best score, `floor` included."""
    if not draws:
        return None
    ids, n = list(draws), len(data.lhs)
    coefs = K.least_squares(np.stack([draws[h][0] for h in ids]), np.stack([draws[h][1] for h in ids]))
    combos = [combinations(data, draws[h][0]) for h in ids] if n > 1 else [combinations(data, draws[ids[0]][0])] * len(ids)
    sizes = np.array(list(map(len, combos)))
    h, c = np.repeat(np.arange(len(ids)), sizes), np.concatenate(combos)
    x = np.concatenate([o[c[:, k]] for k, o in enumerate(data.lhs)], axis=1)
    y = coefs[h, 0] + np.einsum("rf,rfk->rk", x, coefs[h, 1:]) if n > 1 else (coefs[:, :1] + x[: sizes[0]] @ coefs[:, 1:]).reshape(-1, 3)
    whole = np.rint(np.clip(y[:, :2], -(2.0**52), 2.0**52)).astype(np.int64)
    ok = (sizes[h] >= data.need()) & (whole[:, 0] >= 0) & (whole[:, 1] > 1) & (whole.sum(axis=1) <= len(data.v))
    h, c, lam, t2, d2 = h[ok], c[ok], y[ok, 2], whole[ok, 0], whole[ok, 1]
    j, over = longest_overlaps(t2, t2 + d2, data.rhs)
    h, c, lam, t2, d2, j, over = (z[over > 0] for z in (h, c, lam, t2, d2, j, over))
    reach = per_hypothesis(h, [*c.T, j], len(ids))
    best, least = None, max(floor, n + 1)
    order = np.argsort(-reach, kind="stable")
    for k in range(0, len(order), 8):
        some = order[k : k + 8][reach[order[k : k + 8]] >= least]
        if not len(some):
            break
        rows = np.flatnonzero(np.isin(h, some))
        top, mean, size = forecast_errors(data, t2[rows], d2[rows], lam[rows], rate)
        err = top if kind == "max" else mean
        good = err <= epsilon_rate * size
        for g in some.tolist():
            own = np.flatnonzero((h[rows] == g) & (size > 0))
            fit = own[good[own]]
            used = fit if len(fit) or not fall_back else own
            pairs = np.concatenate((c[rows[used]], j[rows[used]][:, None]), axis=1)
            if not len(used) or min(len(np.unique(z)) for z in pairs.T) < least:
                continue
            chain = K.heaviest_chain(pairs, over[rows[used]])
            if (score := len(chain)) < least:
                continue
            at, enough = used[chain], len(fit) >= data.need()
            e = {
                "score": score, "combos": int(sizes[g]), "supp": score / sizes[g], "matches": pairs[chain], "eps_rate": float((err[at] / size[at]).max()),
                "epsilon": float(top[fit].max()) if enough else np.inf, "avg_err": float((mean[fit] * d2[rows[fit]]).sum() / d2[rows[fit]].sum()) if enough else np.inf,
            }
            key = (-score, e["eps_rate"], e["epsilon"], e["avg_err"], ids[g])
            if best is None or key < best[0]:
                best, least = (key, ids[g], coefs[g], e), max(least, score)
    return None if best is None else best[1:]
