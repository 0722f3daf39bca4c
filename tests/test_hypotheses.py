"""Batches of sampled fits against hypotheses evaluated one by one."""

import time

import numpy as np
import pytest

from subseqrules.config import MiningConfig
from subseqrules.functions import kernels as K
from subseqrules.functions import mining as H
from subseqrules.operators import pairs as P
from subseqrules.schemas import CLASSES, OCCURRENCES, PACKED


def slow_evaluate(data: H.PairData, coef: np.ndarray, combos: np.ndarray, *, epsilon_rate: float, rate: float, kind: str, supp: float = 0.0, fall_back: bool = False) -> dict | None:
    """Chain the predictions that an occurrence of the right side bears out; None when too few can be made."""
    if len(combos) < data.need():
        return None
    x = np.concatenate([o[combos[:, i]] for i, o in enumerate(data.lhs)], axis=1)
    y = coef[0] + x @ coef[1:]
    t2, d2 = np.rint(y[:, 0]).astype(int), np.rint(y[:, 1]).astype(int)
    good = (t2 >= 0) & (d2 > 1) & (t2 + d2 <= len(data.v))
    rows, over_any = [], []
    for i in np.flatnonzero(good):
        a, b = t2[i], t2[i] + d2[i]
        over = np.minimum(b, data.rhs[:, 0] + data.rhs[:, 1]) - np.maximum(a, data.rhs[:, 0])
        j = int(over.argmax())
        actual = data.v[a:b]
        size = actual.max() - actual.min()
        if over[j] <= 0 or size <= 0:
            continue
        p = K.piecewise_predict(np.arange(d2[i]) / (d2[i] - 1), *data.shape) * y[i, 2] + data.v[a]
        e = K.align_error(p, actual, min(int(d2[i] * rate), d2[i] - 1))
        row = (i, j, float(over[j]), K.aggregate(e, kind), float(e.max()), float(e.mean()), float(size), int(d2[i]))
        over_any.append(row)
        if row[3] <= epsilon_rate * size:
            rows.append(row)
    used = rows or (over_any if fall_back else [])
    pairs = np.array([[*combos[r[0]], r[1]] for r in used]).reshape(len(used), combos.shape[1] + 1)
    chain = K.heaviest_chain(pairs, np.array([r[2] for r in used]))
    score = len(chain)
    out = {"score": score, "combos": len(combos), "supp": score / len(combos), "matches": pairs[chain], "eps_rate": max((used[c][3] / used[c][6] for c in chain), default=np.inf)}
    enough = len(rows) >= data.need() and out["supp"] >= supp
    out["epsilon"] = max(r[4] for r in rows) if enough else np.inf
    out["avg_err"] = sum(r[5] * r[7] for r in rows) / sum(r[7] for r in rows) if enough else np.inf
    return out


def series(n, seed):
    r = np.random.default_rng(seed)
    return np.cumsum(r.normal(0, 1, n)) + 3 * np.sin(np.arange(n) / 9)


def occurrences(n, count, seed, span=(8, 30)):
    r = np.random.default_rng(seed)
    t = np.sort(r.choice(n - span[1], count, replace=False))
    return np.stack((t, r.integers(*span, count), r.uniform(1, 5, count)), axis=1).astype(float)


def slow_best(data, draws, fall_back, floor=0, **how):
    best = None
    for h, (x, y) in draws.items():
        coef = K.least_squares(x, y)
        e = slow_evaluate(data, coef, H.combinations(data, x), supp=0.0, fall_back=fall_back, **how)
        if e is None or e["score"] <= len(data.lhs) or e["score"] < floor:
            continue
        key = (-e["score"], e["eps_rate"], e["epsilon"], e["avg_err"], h)
        best = min(best or (key, e), (key, e), key=lambda b: b[0])
    return best


@pytest.mark.parametrize("sides", [1, 2])
@pytest.mark.parametrize("kind", ["max", "mean"])
@pytest.mark.parametrize("fall_back", [False, True])
def test_batch_is_the_best_of_all(sides, kind, fall_back):
    shape, found = ([0.0, 0.4, 1.0], [1.5, -1.0], [0.0, 1.0]), 0
    for seed in range(12):
        n = 400
        lhs = [occurrences(n, 25 + 3 * k, seed + 50 * k) for k in range(sides)]
        rhs = lhs[0] + [12, 1, 0.2] if seed % 2 else occurrences(n, 30, seed + 9)
        rhs = rhs[rhs[:, 0] + rhs[:, 1] < n]
        data = H.PairData(lhs, rhs, series(n, seed), shape)
        draws = {h: H.draw(data, np.random.default_rng([seed, h])) for h in range(40)}
        how = {"epsilon_rate": 0.9, "rate": 0.1, "kind": kind}
        want, got = slow_best(data, draws, fall_back, **how), H.best_of_draws(data, draws, fall_back=fall_back, **how)
        assert (want is None) == (got is None)
        if got is not None:
            found += 1
            hyp, _, e = got
            assert (hyp, e["score"], e["combos"]) == (want[0][-1], want[1]["score"], want[1]["combos"])
            assert e["matches"].tolist() == want[1]["matches"].tolist()
            for k in ("supp", "eps_rate", "epsilon", "avg_err"):
                assert e[k] == pytest.approx(want[1][k], rel=1e-9), k
            assert H.best_of_draws(data, draws, fall_back=fall_back, floor=e["score"] + 1, **how) is None
            assert H.best_of_draws(data, draws, fall_back=fall_back, floor=e["score"], **how)[0] == hyp
    assert found


def test_longest_overlaps():
    r = np.random.default_rng(1)
    for _ in range(50):
        occ = np.stack((r.integers(0, 60, 20), r.integers(1, 15, 20)), axis=1)  # in no order, and overlapping each other
        a = r.integers(0, 70, 30)
        b = a + r.integers(1, 30, 30)
        over = np.minimum(b[:, None], occ.sum(axis=1)) - np.maximum(a[:, None], occ[:, 0])
        j, size = H.longest_overlaps(a, b, occ)
        assert (size == np.maximum(over.max(axis=1), 0)).all()
        assert (j[size > 0] == over.argmax(axis=1)[size > 0]).all()


def slow_chain(pairs, weights):
    total, back = weights.astype(float).copy(), np.full(len(pairs), -1)
    for i in range(1, len(pairs)):
        under = np.flatnonzero((pairs[:i] < pairs[i]).all(axis=1))
        if len(under) and total[j := under[total[under].argmax()]] > 0:
            total[i], back[i] = weights[i] + total[j], j
    out, i = [], int(total.argmax()) if len(total) else -1
    while i >= 0:
        out.append(i)
        i = int(back[i])
    return out[::-1]


@pytest.mark.parametrize("width", [1, 2, 3])
@pytest.mark.parametrize("ordered", [True, False])
def test_chains(width, ordered):
    r = np.random.default_rng(width)
    for n in (0, 1, 2, 30, 200):
        for weights in (np.ones(n), r.integers(-2, 5, n).astype(float)):
            pairs = r.integers(0, max(1, n // 2), (n, width))
            pairs = pairs[np.argsort(pairs[:, 0], kind="stable")] if ordered else pairs
            assert K.heaviest_chain(pairs, weights) == slow_chain(pairs, weights)


def test_long_chain_is_fast():
    r = np.random.default_rng(2)
    pairs = np.stack((np.arange(100_000), r.integers(0, 100_000, 100_000)), axis=1)
    began = time.time()
    chain = K.heaviest_chain(pairs, np.ones(100_000))
    assert time.time() - began < 20 and (np.diff(pairs[chain, 1]) > 0).all() and 550 < len(chain) < 700  # near 2 sqrt(n)


def test_match_all_pairs(spark):
    """Every pair of classes against hypotheses drawn with the same seeds and evaluated one by one."""
    cfg = MiningConfig(max_iter=128, supp=0.1, epsilon_rate=0.9, window_rate=0.1, error_kind="mean", seed=3)
    v = {a: series(300, 20 + a) for a in range(3)}
    occ = {(a, c): occurrences(300, 14, 10 * a + c) for a in range(3) for c in range(2)}
    occ[2, 0] = occ[0, 0] + [9, 0, 0.1]
    occ = {k: o[o[:, 0] + o[:, 1] < 300] for k, o in occ.items()}
    shape = ([0.0, 0.4, 1.0], [1.5, -1.0], [0.0, 1.0])
    rows = [("s", a, c, i, int(t), int(d), float(x)) for (a, c), o in occ.items() for i, (t, d, x) in enumerate(o)]
    table = spark.createDataFrame(rows, OCCURRENCES)
    classes = spark.createDataFrame([("s", a, c, "piecewise", *shape, [], 0.5, 0.1, 5, 40, 0.1) for a, c in occ], CLASSES)
    packed = spark.createDataFrame([("s", a, 300, x.tolist()) for a, x in v.items()], PACKED)
    got = {(tuple(r.lhs), tuple(r.rhs)): r for r in P.match_all_pairs(table, classes, packed, cfg).collect()}
    seen = 0
    for left in occ:
        for right in occ:
            if left == right or len(occ[left]) <= 2 or len(occ[right]) / len(occ[left]) < cfg.supp:
                assert (left, right) not in got
                continue
            data = H.PairData([occ[left]], occ[right], v[right[0]], shape)
            draws = {h: H.draw(data, np.random.default_rng([cfg.seed, h, *left, *right])) for h in range(128)}
            want = slow_best(data, draws, False, epsilon_rate=0.9, rate=0.1, kind="mean") if draws[0] is not None else None
            assert (want is None) == ((left, right) not in got)
            if want:
                seen += 1
                r, e = got[left, right], want[1]
                assert (r.c_phi, [(*m.lhs_occ, m.rhs_occ) for m in r.matches]) == (e["score"], [tuple(m) for m in e["matches"].tolist()])
                assert r.supp == pytest.approx(e["supp"]) and r.min_eps_rate == pytest.approx(e["eps_rate"])
                assert np.allclose(np.stack((r.coef_t1, r.coef_delta, r.coef_lam), axis=1), K.least_squares(*draws[want[0][-1]]))
    assert seen > 10


def test_no_draws():
    data = H.PairData([occurrences(200, 5, 1)], occurrences(200, 5, 2), series(200, 3), ([0.0, 1.0], [1.0], [0.0]))
    assert H.best_of_draws(data, {}, epsilon_rate=1, rate=0.1, kind="max") is None
