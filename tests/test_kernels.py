import itertools

import numpy as np
import one_series
import pytest

from subseqrules.functions import kernels as K
from subseqrules.functions import mining as M


def slow_distance(x, y, kind):
    m = len(x)
    dot = float(x @ y)
    if kind == "znormed_ed":
        sx, sy = (s if s >= 1e-4 else 0.1 for s in (x.std(), y.std()))
        return max(0.0, 2 * m * (1 - (dot - m * x.mean() * y.mean()) / (m * sx * sy)))
    both = x @ x + y @ y
    if kind == "cosine":
        return 1 - dot / both
    d = both - 2 * dot
    if kind == "cid":
        a, b = ((np.diff(z) ** 2).sum() for z in (x, y))
        d *= max(a, b) / min(a, b)
    return d


@pytest.mark.parametrize("kind", K.DISTANCES)
def test_block_distances(kind):
    v, m = np.random.default_rng(0).normal(size=60).cumsum(), 8
    d = K.block_distances(v, m, np.arange(5, 12), kind)
    want = [[slow_distance(v[i : i + m], v[j : j + m], kind) for j in range(53)] for i in range(5, 12)]
    assert np.allclose(d, want)


def test_greedy_neighbours_take_the_nearest_free_start():
    d = np.array([5.0, 1, 2, 9, 9, 0.5, 7, 3])
    assert one_series.greedy_neighbours(d, 0, 4, 2) == [(0, 0.0), (5, 0.5), (2, 2.0), (7, 3.0)]
    assert len(one_series.greedy_neighbours(d[:3], 0, 5, 2)) == 2


def test_align_error_against_the_definition():
    r = np.random.default_rng(1)
    for n, m, w in ((9, 9, 2), (7, 11, 0), (5, 5, 50), (1, 1, 3)):
        a, b = r.normal(size=n), r.normal(size=m)
        k = min(n, m)
        u = max(0, min(w, k - 1))
        want = [max(min(abs(a[j] - b[i]) for j in range(max(0, i - u), min(k, i + u + 1))), min(abs(a[i] - b[j]) for j in range(max(0, i - u), min(k, i + u + 1)))) for i in range(k)]
        assert np.allclose(K.align_error(a, b, w), want)
        assert np.allclose(M.rows_error(a[None, :k], b[:k], w)[0], want)
    assert K.aggregate(np.zeros(0), "max") == float("inf")


def test_chain_is_the_heaviest():
    r = np.random.default_rng(2)
    for _ in range(60):
        p, w = r.integers(0, 5, (7, 2)), r.integers(1, 5, 7)
        got = K.heaviest_chain(p, w)
        assert all((p[a] < p[b]).all() for a, b in zip(got, got[1:]))
        best = max(sum(w[list(c)]) for n in range(1, 8) for c in itertools.combinations(range(7), n) if all((p[a] < p[b]).all() for a, b in zip(c, c[1:])))
        assert w[got].sum() == best


def test_piecewise_fit_finds_the_break():
    x = np.linspace(0, 1, 41)
    y = np.where(x < 0.5, 2 * x, 2 - 2 * x)
    breaks, slopes, icpts = K.piecewise_fit(x, y, 10)
    assert len(slopes) == 10 and np.abs(K.piecewise_predict(x, breaks, slopes, icpts) - y).max() < 0.05
    assert K.piecewise_predict(np.array([-1.0, 2.0]), breaks, slopes, icpts).tolist() == [0, 0]
    assert len(K.piecewise_fit(np.array([0.0, 1.0]), np.array([1.0, 3.0]))[1]) == 1


def test_trim_keeps_what_moves():
    v = np.concatenate((np.zeros(20), np.arange(10), np.full(20, 9.0)))
    a, b = K.trim_flat_ends(v, 0.5, 5)
    assert 15 <= a <= 20 and 29 <= b <= 35
    assert K.trim_flat_ends(np.zeros(30), 0.5, 5) == (0, 30)


def test_elbows():
    assert K.elbow_points(np.array([1.0, 1, 1, 1.1, 1.2, 5, 5.1, 5.2, 5.3])) == [4]
    assert K.elbow_points(np.array([1.0, 1, 1])) == [2]


def test_set_extent():
    v = np.random.default_rng(3).normal(size=80)
    s = np.array([3, 20, 41, 60])
    e = one_series.set_extent(v, 10, s, "euclidean")
    d = [[slow_distance(v[a : a + 10], v[b : b + 10], "euclidean") for a in s] for b in s]
    assert np.allclose(e[1:], [max(d[i][j] for i in range(k) for j in range(i)) for k in (2, 3, 4)])


def test_longest_matches_do_not_depend_on_chunks():
    v = np.tile(np.concatenate((np.arange(10.0), np.arange(10.0)[::-1])), 6)
    shape = ([0.0, 0.5, 1.0], [2.0, -2.0], [0.0, 2.0])
    how = dict(epsilon=0.3, bound=1.0, lo=16, hi=24, step=2, rate=0.1, kind="max", gamma=0.0, penalty=0.0)
    one = sorted(M.longest_matches(v, np.arange(len(v)), shape, **how))
    two = sorted(M.longest_matches(v, np.arange(50), shape, **how) + [(s + 50, *x) for s, *x in M.longest_matches(v[50:], np.arange(len(v) - 50), shape, **how)])
    assert one == two and any(s % 20 == 0 for s, *_ in one)
